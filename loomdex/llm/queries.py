"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding, media, minhash, packing, pii, quality, suffix, toxicity, urls

#: The tokenizer file, of the installed package of public vocabularies.
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of a passage that is short for the 400 of the contract but no chance repeat; under 50 words of prose.
PASSAGE = 240


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op3_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.link(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))[0]


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), path or public_tokenizers.path(TOKENIZER))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"), passage=PASSAGE)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("blocked"))
    return urls.judge(table(spark, sf_dir, "pages"), labels)


QUERIES = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_embedding, op4_quality, op5_minhash, op6_pii, op7_media, op8_bpe, op9_suffix, op10_urls)}
ORACLE_SQL: dict[str, str] = {}

_CHAIN = """reach AS (SELECT DISTINCT a AS node, b AS other FROM edge UNION SELECT reach.node, edge.b FROM reach JOIN edge ON edge.a = reach.other)"""

ORACLE_SQL["op3_embedding"] = f"""WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  edge AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
  {_CHAIN}, low AS (SELECT node, min(other) AS m FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
  SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
  FROM embeddings LEFT JOIN low ON node = vec_id LEFT JOIN n ON a = vec_id"""

ORACLE_SQL["op5_minhash"] = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
  edge AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
  {_CHAIN}, low AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
  SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
  FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON node = doc_id"""
