"""Registered queries of the engine, with their SQL equivalents.

Each query reads whole tables.  Computed doubles are rounded to six places on both
sides, as sums may run in another order.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars, text
from .operators import audit, bm25, filters, hybrid, quality, snippets, vector
from .plans.index import StoredIndex
from .plans.layout import spread
from .sources import warc
from .sources.store import Policy, VectorStore
from .streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY = "the tion with ing"
ONE = "that"
FILTERED = {"language": "en", "collection_id": "src3"}


def register(name: str, sql: str | None = None):
    """Add a query under `name`, with its SQL if there is one."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """Archive metadata of `documents`, from its columns; dates follow the id."""
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("https://"), "source", F.lit(".example/"), n).alias("target_uri"),
        F.timestamp_add("HOUR", n % 1000, F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("warc_date"),
        F.lit("text/plain").alias("content_type"),
        F.lit(200).alias("http_status"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.lit("documents").alias("source_file"),
        F.col("n_chars").cast("int").alias("text_len"),
        F.concat("source", F.lit(".example")).alias("domain"),
        F.col("lang").alias("content_language"),
        F.when(n % 3 == 0, "text/html").otherwise("text/plain").alias("media_type"),
        F.col("source").alias("collection_id"),
    )


META_SQL = """meta AS (SELECT doc_id, 'https://' || source || '.example/' || doc_id AS target_uri,
  TIMESTAMP '2026-01-01' + (doc_id % 1000) * INTERVAL 1 HOUR AS warc_date, source || '.example' AS domain, lang AS content_language,
  CASE WHEN doc_id % 3 = 0 THEN 'text/html' ELSE 'text/plain' END AS media_type, source AS collection_id, CAST(n_chars AS INTEGER) AS text_len FROM documents)"""
_RANGES = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in text.CJK_RANGES)


def tokens_sql(x: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all(translate({x}, '{text.UPPER}', '{text.LOWER}'), '[{_RANGES}]+|[a-z0-9]{{2,}}'),
  lambda w: CASE WHEN regexp_matches(w, '^[a-z0-9]') OR length(w) = 1 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) END))"""


WORDS = f"words AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)"
INDEX = f"{WORDS}, idx AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL), lens AS (SELECT doc_id, len(w) AS dl FROM words), st AS (SELECT count(*) AS n, avg(dl) AS av FROM lens), dfs AS (SELECT term, count(*) AS df FROM idx GROUP BY term)"
WEIGHT = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))"


def scored_sql(query: str, where: str = "true") -> str:
    """CTE body: doc_id and score of a query."""
    return f"""SELECT doc_id, sum({WEIGHT}) AS score FROM idx JOIN (SELECT DISTINCT unnest({tokens_sql("'" + query + "'")}) AS term) USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), st WHERE {where} GROUP BY doc_id"""


DISTANCE = "list_sum(list_transform(list_zip(embedding, q), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"


def near_sql(k: int, where: str = "true") -> str:
    return f"SELECT vec_id AS id, {DISTANCE} AS distance FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7) WHERE {where} ORDER BY distance, id LIMIT {k}"


def _docs(spark, d):
    return spread(table(spark, d, "documents"))


def _vector_of(spark, d) -> DataFrame:
    """The vector with id 7, as the query of the examples."""
    return table(spark, d, "embeddings").filter("vec_id = 7").select(F.col("embedding").alias("q"))


@register("tokenize", f"SELECT doc_id, list_aggregate(w, 'string_agg', ' ') AS tokens FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)")
def tokenize(spark, d):
    return _docs(spark, d).select("doc_id", F.nullif(F.array_join(text.tokens(F.col("text")), " "), F.lit("")).alias("tokens"))


@register("term_frequencies", f"WITH {INDEX} SELECT doc_id, term, CAST(tf AS INTEGER) AS tf FROM idx")
def term_frequencies(spark, d):
    return bm25.postings(_docs(spark, d))


@register("doc_lengths", f"WITH {WORDS} SELECT doc_id, CAST(len(w) AS INTEGER) AS doc_len FROM words")
def doc_lengths(spark, d):
    return bm25.doc_lengths(_docs(spark, d))


@register("corpus_stats", f"WITH {WORDS} SELECT count(*) AS doc_count, round(avg(len(w)), 6) AS avg_doc_len FROM words")
def corpus_stats(spark, d):
    return bm25.corpus_stats(bm25.doc_lengths(_docs(spark, d))).select("doc_count", F.round("avg_doc_len", 6).alias("avg_doc_len"))


@register("doc_frequency", f"WITH {INDEX} SELECT term, df FROM dfs")
def doc_frequency(spark, d):
    return bm25.doc_frequency(bm25.postings(_docs(spark, d)))


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.orderBy(F.desc("score"), "doc_id")
    return df.select("doc_id", F.row_number().over(order).alias("rank"), F.round("score", 6).alias("score"))


_RANKED = "SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, round(score, 6) AS score FROM s ORDER BY rank LIMIT 10"


@register("bm25_search", f"WITH {INDEX}, s AS ({scored_sql(QUERY)}) {_RANKED}")
def bm25_search(spark, d):
    return _ranked(bm25.search(_docs(spark, d), QUERY, 10))


@register("bm25_single_term", f"WITH {INDEX}, s AS ({scored_sql(ONE)}) {_RANKED}")
def bm25_single_term(spark, d):
    return _ranked(bm25.search(_docs(spark, d), f"{ONE} {ONE} X", 10))


@register("bm25_filtered", f"WITH {INDEX}, {META_SQL}, s AS ({scored_sql(QUERY, "doc_id IN (SELECT doc_id FROM meta WHERE content_language = 'en' AND collection_id = 'src3')")}) {_RANKED}")
def bm25_filtered(spark, d):
    ids = filters.predicate(metadata(spark, d), filters.SearchFilter.parse(FILTERED)).select("doc_id")
    return _ranked(bm25.search(_docs(spark, d), QUERY, 10, ids))


@register(
    "bm25_batch",
    f"""WITH {INDEX}, asked AS (SELECT DISTINCT item_id, unnest({tokens_sql('text')}) AS term FROM benchmark),
  s AS (SELECT item_id, doc_id, sum({WEIGHT}) AS score FROM idx JOIN asked USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), st GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
  SELECT item_id AS query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
)
def bm25_batch(spark, d):
    out = bm25.search_texts(_docs(spark, d), table(spark, d, "benchmark"), 10, "item_id")
    return out.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@register("vector_search", f"SELECT id, round(distance, 6) AS distance FROM ({near_sql(10)})")
def vector_search(spark, d):
    return vector.search(table(spark, d, "embeddings"), _vector_of(spark, d), 10).select("id", F.round("distance", 6).alias("distance"))


@register("vector_search_filtered", f"WITH {META_SQL} SELECT id, round(distance, 6) AS distance FROM ({near_sql(10, 'vec_id IN (SELECT doc_id FROM meta WHERE content_language = ' + chr(39) + 'en' + chr(39) + ')')})")
def vector_search_filtered(spark, d):
    ids = filters.predicate(metadata(spark, d), filters.SearchFilter.parse({"language": "en"})).select("doc_id")
    return vector.search(table(spark, d, "embeddings"), _vector_of(spark, d), 10, ids).select("id", F.round("distance", 6).alias("distance"))


@register(
    "vector_centroid",
    """WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS position FROM embeddings),
  m AS (SELECT label, position, avg(CAST(x AS DOUBLE)) AS mean FROM e GROUP BY ALL)
  SELECT label, CAST(position AS INTEGER) AS position, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY label)), 6) AS value FROM m""",
)
def vector_centroid(spark, d):
    return vector.centroid(table(spark, d, "embeddings"), by="label").select("label", "position", F.round("value", 6).alias("value"))


def fused_sql(cand: int, k: int = 10, wb: float = 1, wv: float = 1, rrf: int = 60, where: str = "true", extra: str = "") -> str:
    lexical = f"SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS br FROM ({scored_sql(QUERY, where)}) ORDER BY br LIMIT {cand if wb else 0}"
    near = f"SELECT id AS doc_id, row_number() OVER (ORDER BY distance, id) AS vr FROM ({near_sql(cand if wv else 0, where.replace('doc_id IN', 'vec_id IN'))})"
    return f"""WITH {INDEX}, {META_SQL}, b AS ({lexical}), v AS ({near}),
  f AS (SELECT doc_id, br, vr, coalesce({wb}::DOUBLE / (br + {rrf}), 0) AS bc, coalesce({wv}::DOUBLE / (vr + {rrf}), 0) AS vc FROM b FULL JOIN v USING (doc_id)),
  t AS (SELECT doc_id, bc + vc AS score, CASE WHEN vr IS NULL THEN 'bm25' WHEN br IS NULL THEN 'vector' ELSE 'bm25+vector' END AS source,
    CAST(br AS INTEGER) AS bm25_rank, CAST(vr AS INTEGER) AS vector_rank, round(bc, 6) AS bm25_contribution, round(vc, 6) AS vector_contribution FROM f ORDER BY score DESC, doc_id LIMIT {k})"""


_EXPLAIN = " SELECT doc_id, round(score, 6) AS score, source, bm25_rank, vector_rank, bm25_contribution, vector_contribution FROM t"


def _explained(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"), "source", "bm25_rank", "vector_rank", F.round("bm25_contribution", 6).alias("bm25_contribution"), F.round("vector_contribution", 6).alias("vector_contribution"))


def _hybrid(spark, d, **options):
    return hybrid.explain(_docs(spark, d), table(spark, d, "embeddings"), QUERY, _vector_of(spark, d), **options)


@register("hybrid_search", fused_sql(10) + " SELECT doc_id, round(score, 6) AS score, source FROM t")
def hybrid_search(spark, d):
    return hybrid.search(_docs(spark, d), table(spark, d, "embeddings"), QUERY, _vector_of(spark, d)).select("doc_id", F.round("score", 6).alias("score"), "source")


@register("hybrid_explain", fused_sql(100) + _EXPLAIN)
def hybrid_explain(spark, d):
    return _explained(_hybrid(spark, d))


@register("hybrid_weighted", fused_sql(50, wb=2, wv=0.5, rrf=10) + _EXPLAIN)
def hybrid_weighted(spark, d):
    return _explained(_hybrid(spark, d, candidate_k=50, bm25_weight=2.0, vector_weight=0.5, rrf_k=10))


@register("hybrid_zero_weight", fused_sql(100, wb=0) + _EXPLAIN)
def hybrid_zero_weight(spark, d):
    return _explained(_hybrid(spark, d, bm25_weight=0.0))


_EN = "doc_id IN (SELECT doc_id FROM meta WHERE content_language = 'en' AND warc_date BETWEEN TIMESTAMP '2026-01-02' AND TIMESTAMP '2026-01-12')"
_EN_FILTER = {"language": "en", "from": "2026-01-02T00:00:00Z", "to": "2026-01-12T00:00:00Z"}


@register("hybrid_filtered", fused_sql(100, where=_EN) + _EXPLAIN)
def hybrid_filtered(spark, d):
    ids = filters.admitted(metadata(spark, d), filters.SearchFilter.parse(_EN_FILTER))
    return _explained(_hybrid(spark, d, eligible=ids))


_VIS = "vec_id IN (SELECT doc_id FROM vis)"


def _revised(spark, d) -> DataFrame:
    """Vectors with revisions, some old."""
    n = F.col("vec_id")
    return table(spark, d, "embeddings").withColumn("revision", F.when(n % 7 == 0, "old").otherwise(F.md5(F.concat(F.lit("r"), n))))


STATE_SQL = "state AS (SELECT doc_id, md5('r' || doc_id) AS revision, doc_id % 5 = 0 AS is_deleted FROM documents WHERE doc_id % 3 <> 1), rows_ AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5('r' || doc_id) END AS revision FROM documents)"
_SHOWN = "vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 1 AND (doc_id % 5 = 0 OR doc_id % 7 = 0))"


@register("vector_search_labelled", near_sql(10, _SHOWN + " AND vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')").replace("SELECT vec_id AS id,", "SELECT vec_id AS id, CAST(label AS VARCHAR) AS label,").replace(DISTANCE, f"round({DISTANCE}, 6)"))
def vector_search_labelled(spark, d):
    """Labels with the hits, deleted and stale vectors hidden before the limit."""
    ids = table(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    out = vector.search(_revised(spark, d), _vector_of(spark, d), 10, ids, label_col="label", state=_state(spark, d))
    return out.select("id", F.col("label").cast("string").alias("label"), F.round("distance", 6).alias("distance"))


def _visible_sql() -> str:
    """Candidates as without state, then the hidden ones go from the vectors."""
    return fused_sql(100).replace(") , f AS", "), f AS").replace("v AS (SELECT id AS doc_id", "v0 AS (SELECT id AS doc_id", 1).replace("),\n  f AS", f"),\n  v AS (SELECT doc_id, row_number() OVER (ORDER BY vr) AS vr FROM v0 WHERE {_SHOWN.replace('vec_id NOT', 'doc_id NOT')}),\n  f AS", 1)


@register("hybrid_visible", _visible_sql() + " SELECT doc_id, round(score, 6) AS score, source, bm25_rank, vector_rank FROM t")
def hybrid_visible(spark, d):
    """Deleted and stale vectors don't show in an unfiltered hybrid search."""
    out = hybrid.explain(_docs(spark, d), _revised(spark, d), QUERY, _vector_of(spark, d), state=_state(spark, d))
    return out.select("doc_id", F.round("score", 6).alias("score"), "source", "bm25_rank", "vector_rank")


@register("hybrid_metadata_unfiltered", fused_sql(10) + " SELECT doc_id, round(score, 6) AS score, source, target_uri, strftime(warc_date, '%Y-%m-%dT%H:%M:%SZ') AS warc_date, coalesce(text_len, 0) AS text_len FROM t LEFT JOIN meta USING (doc_id)")
def hybrid_metadata_unfiltered(spark, d):
    out = hybrid.search_metadata(_docs(spark, d), table(spark, d, "embeddings"), metadata(spark, d), QUERY, _vector_of(spark, d))
    return out.select("doc_id", F.round("score", 6).alias("score"), "source", "target_uri", text.utc_timestamp(F.col("warc_date")).alias("warc_date"), "text_len")


@register("hybrid_filtered_explain_metadata", fused_sql(100, where=_EN) + " SELECT doc_id, round(score, 6) AS score, source, bm25_rank, vector_rank, target_uri, domain, content_language FROM t LEFT JOIN meta USING (doc_id)")
def hybrid_filtered_explain_metadata(spark, d):
    out = hybrid.explain_filtered(_docs(spark, d), table(spark, d, "embeddings"), metadata(spark, d), QUERY, _vector_of(spark, d), filters.SearchFilter.parse(_EN_FILTER))
    return out.select("doc_id", F.round("score", 6).alias("score"), "source", "bm25_rank", "vector_rank", "target_uri", "domain", "content_language")


@register("hybrid_metadata", fused_sql(10, where=_EN) + " SELECT doc_id, round(score, 6) AS score, source, target_uri, coalesce(text_len, 0) AS text_len, domain, content_language, media_type, collection_id FROM t LEFT JOIN meta USING (doc_id)")
def hybrid_metadata(spark, d):
    out = hybrid.search_filtered(_docs(spark, d), table(spark, d, "embeddings"), metadata(spark, d), QUERY, _vector_of(spark, d), filters.SearchFilter.parse(_EN_FILTER))
    return out.select("doc_id", F.round("score", 6).alias("score"), "source", "target_uri", "text_len", *hybrid.FACETS)


@register("eligibility_domain_format", f"WITH {META_SQL} SELECT doc_id FROM meta WHERE domain = 'src1.example' AND media_type = 'text/html'")
def eligibility_domain_format(spark, d):
    return filters.predicate(metadata(spark, d), filters.SearchFilter.parse({"domain": "SRC1.example", "format": "Text/HTML"})).select("doc_id")


@register("eligibility_date_range", f"WITH {META_SQL} SELECT doc_id FROM meta WHERE warc_date BETWEEN TIMESTAMP '2026-01-02' AND TIMESTAMP '2026-01-03'")
def eligibility_date_range(spark, d):
    return filters.predicate(metadata(spark, d), filters.SearchFilter.parse({"from": "2026-01-02T00:00:00Z", "to": "2026-01-03T00:00:00Z"})).select("doc_id")


@register(
    "chunk_windows",
    """WITH c AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations WHERE length(text) > 0),
  w AS (SELECT *, unnest(range(0, CAST(greatest(ceil((n - 200) / 150.0), 0) AS BIGINT) + 1)) AS i FROM c)
  SELECT conv_id, turn, CAST(i AS INTEGER) AS chunk_index, CAST(i * 150 AS INTEGER) AS char_start, CAST(least(i * 150 + 200, n) AS INTEGER) AS char_end, md5(substring(text, i * 150 + 1, least(i * 150 + 200, n) - i * 150)) AS md5 FROM w""",
)
def chunk_windows(spark, d):
    rows = table(spark, d, "conversations").withColumn("c", F.explode(text.chunks(F.col("text"), 200, 50)))
    return rows.select("conv_id", "turn", "c.*", F.md5(F.substring(F.col("text"), F.col("c.char_start") + 1, F.col("c.char_end") - F.col("c.char_start"))).alias("md5"))


@register("url_host", r"SELECT page_id, nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', '')), '') AS host FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_host(F.col("url")).alias("host"))


@register("media_type_counts", f"WITH {META_SQL} SELECT lower(trim(split_part(media_type || '; charset=utf-8', ';', 1))) AS media_type, count(*) AS n FROM meta GROUP BY 1")
def media_type_counts(spark, d):
    kind = text.media_type(F.concat("media_type", F.lit("; charset=utf-8")))
    return metadata(spark, d).groupBy(kind.alias("media_type")).agg(F.count("*").alias("n"))


@register(
    "scalar_helpers",
    """SELECT l_orderkey, l_linenumber, CAST(least(CAST(l_orderkey AS HUGEINT) * 100000 % 4294967296 + 1000000000, 2147483647) AS INTEGER) AS added,
  upper(l_returnflag) || '!' AS shouted, greatest(l_linenumber, 3, l_suppkey % 5) AS top, l_orderkey % 2 = 0 AS even,
  len(list_filter(regexp_split_to_array(l_returnflag || chr(32) || l_linestatus, '\\s+'), lambda x: x <> ''))::INTEGER AS words FROM lineitem""",
)
def scalar_helpers(spark, d):
    rows = table(spark, d, "lineitem")
    big = F.least((F.col("l_orderkey") * 100000) % 4294967296, F.lit(2147483647)).cast("int")
    return rows.select("l_orderkey", "l_linenumber", scalars.add_numbers(big, F.lit(1000000000)).alias("added"), scalars.shout(F.col("l_returnflag")).alias("shouted"), scalars.greatest_of(F.col("l_linenumber"), F.lit(3), F.col("l_suppkey") % 5).alias("top"), scalars.is_even(F.col("l_orderkey")).alias("even"), scalars.word_count(F.concat_ws(" ", "l_returnflag", "l_linestatus")).alias("words"))


@register("label_filter", "SELECT page_id FROM pages WHERE contains(lower(concat_ws(chr(10), url, html)), 'casino')")
def label_filter(spark, d):
    return table(spark, d, "pages").filter(text.label_matches("Casino", F.col("url"), F.col("html"))).select("page_id")


_CJK_SQL = tokens_sql("'中文检索 ' || text || ' 日本語 한국 字'")


@register("tokenize_cjk", f"SELECT doc_id, list_aggregate({_CJK_SQL}, 'string_agg', ' ') AS tokens FROM documents")
def tokenize_cjk(spark, d):
    """Bigrams of CJK runs among ASCII words."""
    mixed = F.concat(F.lit("中文检索 "), "text", F.lit(" 日本語 한국 字"))
    return _docs(spark, d).select("doc_id", F.array_join(text.tokens(mixed), " ").alias("tokens"))


@register("term_frequencies_cjk", f"SELECT doc_id, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT doc_id, unnest({_CJK_SQL}) AS term FROM documents) GROUP BY ALL")
def term_frequencies_cjk(spark, d):
    mixed = F.concat(F.lit("中文检索 "), "text", F.lit(" 日本語 한국 字"))
    return bm25.postings(_docs(spark, d).select("doc_id", mixed.alias("text")))


@register("scalar_more", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 0 THEN 2 * l_linenumber END AS doubled, l_linenumber * 3 + l_suppkey AS summed FROM lineitem")
def scalar_more(spark, d):
    line, other = F.col("l_linenumber").cast("int"), F.col("l_suppkey").cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.double_or_none(line).alias("doubled"), scalars.array_sum(F.array(line, line, line, other)).alias("summed"))


# Change queue, state and store, over jobs and revisions derived from the tables.

JOBS_SQL = """jobs AS (SELECT event_id AS job_id, 'set' || (user_id % 7) AS uri,
  CASE WHEN event_id % 11 < 8 AND event_id < 5000 THEN 'completed' WHEN event_id % 13 = 0 THEN 'failed' ELSE 'pending' END AS state,
  CAST(event_id % 9 AS INTEGER) AS attempts, CAST(event_id % 100 AS DOUBLE) AS next_attempt FROM events)"""


def jobs(spark, d) -> DataFrame:
    n = F.col("event_id")
    state = F.when((n % 11 < 8) & (n < 5000), "completed").when(n % 13 == 0, "failed").otherwise("pending")
    return table(spark, d, "events").select(n.alias("job_id"), F.concat(F.lit("set"), F.col("user_id") % 7).alias("uri"), state.alias("state"), (n % 9).cast("int").alias("attempts"), (n % 100).cast("double").alias("next_attempt"), F.lit(None).cast("string").alias("error"))



def _state(spark, d) -> DataFrame:
    n = F.col("doc_id")
    return _docs(spark, d).filter(n % 3 != 1).select(n, F.md5(F.concat(F.lit("r"), n)).alias("revision"), (n % 5 == 0).alias("is_deleted"))


def _revisions(spark, d) -> DataFrame:
    n = F.col("doc_id")
    return _docs(spark, d).select(n, F.when(n % 7 == 0, "old").otherwise(F.md5(F.concat(F.lit("r"), n))).alias("revision"))


@register("outbox_status", f"""WITH {JOBS_SQL} SELECT uri, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'completed') AS completed,
  min(CASE WHEN state <> 'completed' THEN job_id END) AS oldest_unfinished, max(CASE WHEN state = 'completed' THEN job_id END) AS newest_completed,
  coalesce(max(CASE WHEN state <> 'completed' THEN attempts END), 0) AS most_attempts FROM jobs GROUP BY uri""")
def outbox_status(spark, d):
    return queue.status(jobs(spark, d))


@register("outbox_next", f"WITH {JOBS_SQL}, f AS (SELECT *, min(job_id) OVER (PARTITION BY uri) AS first FROM jobs WHERE state <> 'completed') SELECT job_id, uri FROM f WHERE job_id = first AND state = 'pending' AND next_attempt <= 60")
def outbox_next(spark, d):
    return queue.ready(jobs(spark, d), F.lit(60.0)).select("job_id", "uri")


@register("outbox_backoff", f"WITH {JOBS_SQL} SELECT job_id, CASE WHEN attempts >= 8 THEN 'failed' ELSE 'pending' END AS state, CAST(least(3600, pow(2, least(12, attempts - 1))) AS INTEGER) AS wait FROM jobs WHERE attempts > 0 AND state <> 'completed'")
def outbox_backoff(spark, d):
    state, wait = queue.after_failure(F.col("attempts"))
    return jobs(spark, d).filter("attempts > 0 and state <> 'completed'").select("job_id", state.alias("state"), wait.alias("wait"))


@register("latest_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_state(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return queue.latest(rows, ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@register("stale_visibility", f"WITH {STATE_SQL} SELECT r.doc_id, r.revision FROM rows_ r LEFT JOIN state s USING (doc_id) WHERE s.doc_id IS NULL OR (NOT s.is_deleted AND s.revision IS NOT DISTINCT FROM r.revision)")
def stale_visibility(spark, d):
    return queue.visible_rows(_revisions(spark, d), _state(spark, d))


@register("tombstone_filter", f"WITH {STATE_SQL} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM state WHERE is_deleted)")
def tombstone_filter(spark, d):
    return _docs(spark, d).select("doc_id").join(_state(spark, d).filter("is_deleted"), "doc_id", "left_anti")


@register("chunk_reconcile", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars < 900")
def chunk_reconcile(spark, d):
    stored = _docs(spark, d).select("doc_id", F.col("lang").alias("parent_doc_id"))
    fresh = _docs(spark, d).filter("n_chars >= 900 and lang in ('en', 'fr')").select("doc_id", F.col("lang").alias("parent_doc_id"))
    return warc.stale_chunks(stored, fresh).select("doc_id")


def _store(spark, d) -> tuple[VectorStore, str, DataFrame]:
    """A fresh data set with all vectors, in a folder every executor can read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    root = base.removeprefix("file://") if base and base.startswith(("file://", "/")) else tempfile.mkdtemp(prefix="loomdex-store-")
    store = VectorStore(spark, Policy(root, allow_destructive=True))
    uri = f"{root}/vectors-{uuid.uuid4().hex}"
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))
    store.create(uri, 64)
    store.append(uri, rows)
    return store, uri, rows


@register("store_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 AND vec_id < 20000 THEN 'new' ELSE CAST(label AS VARCHAR) END AS label, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM embeddings UNION ALL SELECT -1, 'added', 1.0")
def store_upsert(spark, d):
    store, uri, rows = _store(spark, d)
    new = rows.filter("id % 10 = 0 and id < 20000").withColumn("label", F.lit("new"))
    store.upsert(uri, new.unionByName(spark.createDataFrame([(-1, [1.0] * 64, "added")], rows.schema)))
    return store.read(uri).select("id", "label", F.round(F.col("vector")[0].cast("double"), 6).alias("x"))


@register("store_delete_restore", "SELECT 'now' AS version, vec_id AS id FROM embeddings UNION ALL SELECT 'before', vec_id FROM embeddings WHERE label <> 3")
def store_delete_restore(spark, d):
    store, uri, rows = _store(spark, d)
    deleted = store.delete(uri, rows.filter("label = '3'"))
    store.restore(uri, 2)
    now = store.read(uri).select(F.lit("now").alias("version"), "id")
    return now.unionByName(store.read(uri, deleted).select(F.lit("before").alias("version"), "id"))


@register("store_count_versions", "SELECT count(*) AS n, 64 AS dim, 2 AS versions FROM embeddings")
def store_count_versions(spark, d):
    store, uri, _ = _store(spark, d)
    return store.read(uri).agg(F.count("*").alias("n"), F.lit(store.dim(uri)).alias("dim"), F.lit(store.versions(uri).count()).cast("int").alias("versions"))


# Audits and quality.


@register("index_audit", f"WITH {WORDS}, p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL) SELECT count(*) FILTER (term = 'the' AND doc_id % 4 = 0) AS missing, (SELECT count(*) FROM documents WHERE doc_id % 50 = 0) AS extra, count(*) FILTER (term = 'of' AND doc_id % 3 = 0) AS wrong_tf, (SELECT count(*) FROM words WHERE doc_id % 10 = 0) AS wrong_length, 0::BIGINT AS unverifiable FROM p")
def index_audit(spark, d):
    docs = _docs(spark, d)
    good = bm25.postings(docs)
    stored = good.filter("not (term = 'the' and doc_id % 4 = 0)").withColumn("tf", F.when((F.col("term") == "of") & (F.col("doc_id") % 3 == 0), F.col("tf") + 1).otherwise(F.col("tf")))
    stored = stored.unionByName(docs.filter("doc_id % 50 = 0").select("doc_id", F.lit("zz-extra").alias("term"), F.lit(1).alias("tf")))
    lengths = bm25.doc_lengths(docs).withColumn("doc_len", F.when(F.col("doc_id") % 10 == 0, F.col("doc_len") + 1).otherwise(F.col("doc_len")))
    return audit.index_audit(docs, stored, lengths)


@register(
    "store_reconcile",
    f"""WITH {STATE_SQL}, v AS (SELECT vec_id AS doc_id, CASE WHEN vec_id % 7 = 0 THEN 'old' ELSE md5('r' || vec_id) END AS revision FROM embeddings),
  m AS (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0), f AS (
  SELECT doc_id, 'missing_vector' AS finding FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v)
  UNION ALL SELECT doc_id, 'orphan_vector' FROM v WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT doc_id, 'deleted_but_present' FROM v WHERE doc_id IN (SELECT doc_id FROM state WHERE is_deleted)
  UNION ALL SELECT v.doc_id, 'stale_revision' FROM v JOIN state s USING (doc_id) WHERE NOT is_deleted AND v.revision <> s.revision
  UNION ALL SELECT doc_id, 'untracked_revision' FROM v WHERE doc_id NOT IN (SELECT doc_id FROM state)
  UNION ALL SELECT doc_id, 'tracked_without_vector' FROM state WHERE NOT is_deleted AND doc_id NOT IN (SELECT doc_id FROM v)
  UNION ALL SELECT doc_id, 'text_without_metadata' FROM documents WHERE doc_id % 9 = 0) SELECT finding, count(*) AS n FROM f GROUP BY finding""",
)
def store_reconcile(spark, d):
    n = F.col("vec_id")
    v = table(spark, d, "embeddings").select(n.alias("id"), F.when(n % 7 == 0, "old").otherwise(F.md5(F.concat(F.lit("r"), n))).alias("revision"))
    found = audit.reconcile(_docs(spark, d).select("doc_id"), _docs(spark, d).filter("doc_id % 9 <> 0").select("doc_id"), v, _state(spark, d))
    return found.groupBy("finding").agg(F.count("*").alias("n"))


HITS_SQL = f"""{INDEX}, asked AS (SELECT DISTINCT item_id, unnest({tokens_sql('text')}) AS term FROM benchmark),
  s AS (SELECT item_id, doc_id, sum({WEIGHT}) AS score FROM idx JOIN asked USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), st GROUP BY ALL),
  hits AS (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 10),
  labels_ AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents WHERE doc_id % 40 = item_id % 40)"""


@register(
    "quality_metrics",
    f"""WITH {HITS_SQL}, g AS (SELECT query_id, min(rank) AS best, count(*) AS found, sum(1 / log2(rank + 1)) AS gain FROM hits JOIN labels_ USING (query_id, doc_id) GROUP BY query_id),
  n AS (SELECT query_id, count(*) AS n FROM labels_ GROUP BY query_id)
  SELECT query_id, best IS NOT NULL AS hit, round(coalesce(1.0 / best, 0), 6) AS reciprocal_rank, round(coalesce(found / n, 0), 6) AS recall,
  round(coalesce(gain / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))), 0), 6) AS ndcg FROM n LEFT JOIN g USING (query_id)""",
)
def quality_metrics(spark, d):
    docs, items = _docs(spark, d), table(spark, d, "benchmark")
    hits = bm25.search_texts(docs, items, 10, "item_id")
    labels = items.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("b")).join(docs.select("doc_id", (F.col("doc_id") % 40).alias("b")), "b")
    out = quality.metrics(hits, labels, 10)
    return out.select("query_id", "hit", *(F.round(c, 6).alias(c) for c in ("reciprocal_rank", "recall", "ndcg")))


@register(
    "method_compare",
    f"""WITH {HITS_SQL}, g AS (SELECT query_id, min(rank) AS best, count(*) AS found FROM hits JOIN labels_ USING (query_id, doc_id) GROUP BY query_id),
  n AS (SELECT query_id, count(*) AS n FROM labels_ GROUP BY query_id)
  SELECT 'bm25' AS method, count(*) AS queries, round(avg(CASE WHEN best IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr, round(avg(coalesce(found / n, 0)), 6) AS recall FROM n LEFT JOIN g USING (query_id)""",
)
def method_compare(spark, d):
    docs, items = _docs(spark, d), table(spark, d, "benchmark")
    labels = items.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("b")).join(docs.select("doc_id", (F.col("doc_id") % 40).alias("b")), "b")
    out = quality.compare_methods({"bm25": bm25.search_texts(docs, items, 10, "item_id")}, labels, 10)
    return out.select("method", "queries", *(F.round(c, 6).alias(c) for c in ("hit_rate", "mrr", "recall")))


@register("label_findings", "SELECT 'repeated_query' AS finding, NULL::BIGINT AS query_id, NULL::BIGINT AS doc_id WHERE false UNION ALL SELECT 'query_without_labels', item_id, NULL FROM benchmark WHERE item_id % 2 = 1 UNION ALL SELECT 'label_of_unknown_document', item_id, item_id + 1000000000 FROM benchmark WHERE item_id % 4 = 0")
def label_findings(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    n = F.col("query_id")
    labels = items.filter(n % 2 == 0).select("query_id", F.when(n % 4 == 0, n + 1_000_000_000).otherwise(n % 100).cast("long").alias("doc_id"))
    return quality.check_labels(items, labels, table(spark, d, "documents")).withColumn("query_id", F.col("query_id").cast("long"))


@register("regression_ratio", "WITH b AS (SELECT event_type AS metric, avg(value) AS base FROM events WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT event_type AS metric, avg(value) AS candidate FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT metric, round(base, 6) AS base, round(candidate, 6) AS candidate, round(candidate / base - 1, 6) AS ratio, candidate / base - 1 > 0.01 AS failed FROM b JOIN c USING (metric)")
def regression_ratio(spark, d):
    side = lambda bit: table(spark, d, "events").filter(F.col("event_id") % 2 == bit).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    out = quality.compare_runs(side(0), side(1), 0.01)
    return out.select("metric", *(F.round(c, 6).alias(c) for c in ("base", "candidate", "ratio")), "failed")


@register("latency_percentile", "SELECT event_type, quantile_disc(value, 0.95) AS value FROM events GROUP BY event_type")
def latency_percentile(spark, d):
    return quality.percentile(table(spark, d, "events"), "value", 0.95, ["event_type"])


@register("source_coverage", "SELECT source, count(*) AS docs, count(labels.doc_id) AS labelled, count(*) - count(labels.doc_id) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def source_coverage(spark, d):
    seen = table(spark, d, "labels").select("doc_id", F.lit(1).alias("l"))
    return _docs(spark, d).join(seen, "doc_id", "left").groupBy("source").agg(F.count("*").alias("docs"), F.count("l").alias("labelled"), (F.count("*") - F.count("l")).alias("unlabelled"))


# Byte-level operators; rows only.


def _mapped(rows: DataFrame, schema: str, make) -> DataFrame:
    """The first column, and what `make` makes of the others, over Arrow batches."""
    names = [x.split(" ", 1) for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}

    def run(batches):
        for b in batches:
            cells = zip(*(c.to_pylist() for c in b.columns[1:]))
            yield pa.record_batch([b.column(0), pa.array([make(*x) for x in cells], kinds[names[1][1]])], [n for n, _ in names])

    return rows.mapInArrow(run, schema)


@register("html_text")
def html_text(spark, d):
    return _mapped(table(spark, d, "pages").select("page_id", "html"), "page_id long, text string", lambda x: None if x is None else warc.html_text(x))


@register("stable_ids")
def stable_ids(spark, d):
    return _mapped(table(spark, d, "pages").select("page_id", "url", F.sha2("html", 256)), "page_id long, doc_id long", lambda u, x: warc.doc_id(u, None, x))


@register("revisions")
def revisions(spark, d):
    rows = _docs(spark, d).select("doc_id", F.col("doc_id").alias("i"), "text")
    return _mapped(rows, "doc_id long, revision string", lambda i, t: warc.revision({"doc_id": i}, t or ""))


@register("hash_embedding")
def hash_embedding(spark, d):
    return _mapped(_docs(spark, d).select("doc_id", "text"), "doc_id long, vector array<double>", lambda t: warc.hash_embedding(t or "", 16))


@register("snippets")
def snippets_query(spark, d):
    hits = bm25.search(_docs(spark, d), QUERY, 10).join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return snippets.with_snippets(hits, QUERY.split()).select("doc_id", "snippet.*")


@register("warc_import")
def warc_import(spark, d):
    """Archives written from `pages`, read back through the importer."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loomdex-warc-")
    out = f"{root.removeprefix('file://')}/warc-{uuid.uuid4().hex}"

    def record(url: str, page: str) -> str:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n{page}"
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nContent-Length: {len(http.encode())}\r\n\r\n{http}\r\n\r\n"

    make = F.udf(lambda u, h: record(u or "", h or ""), "string")
    table(spark, d, "pages").select(make("url", "html").alias("value")).write.option("lineSep", "\n").text(f"file://{out}")
    return warc.read(spark, f"file://{out}/*.txt").select("ordinal", "doc_id", "target_uri", "domain", "media_type", "http_status", "text_len", "status", "reason")


@register("import_accounting", "SELECT 'imported' AS status, count(*) AS n FROM pages")
def import_accounting(spark, d):
    """Outcomes of the archive import; every page is one record of its file."""
    return warc_import(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@register("bm25_stored_index", ORACLE_SQL["bm25_search"])
def bm25_stored_index(spark, d):
    """The same search over a stored, term-clustered index."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    root = base.removeprefix("file://") if base and base.startswith(("file://", "/")) else tempfile.mkdtemp(prefix="loomdex-index-")
    stored = StoredIndex(spark, f"{root}/index-{uuid.uuid4().hex}")
    stored.build(_docs(spark, d))
    return _ranked(stored.search(QUERY, 10))
