"""BM25 over documents: scan searches for one query or many, index search for many.

The scan searches count terms within each document's own row, over Arrow batches.
`search` shuffles a document's length and its frequencies of the query's terms once,
for the statistics and the scores alike.  `search_texts` makes a pass for the
statistics and one for the scores, in which each task keeps its k best documents of
every query; only these are shuffled.  `search_batch` joins an inverted index.

Document ids are keys: rows that repeat an id count as one document in `search`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument, LimitExceeded
from ..functions.terms import counted, hash_of, words_of
from ..functions.text import tokens

K1, B = 1.2, 0.75
MAX_K = 10_000
MAX_QUERY_BYTES = 2_500_000
#: Queries, and their terms in all, that `search_texts` takes at once; more go in parts of so many queries.
QUERIES, TERMS = 1024, 1 << 20


def check_k(k: int) -> int:
    if not 0 <= k <= MAX_K:
        raise InvalidArgument(f"k must be 0 to {MAX_K}")
    return k


def query_terms(docs: DataFrame, query: str) -> list[str]:
    """Distinct terms of a query, sorted."""
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise LimitExceeded(f"a query has {MAX_QUERY_BYTES} bytes at most")
    return sorted(set(words_of(query)))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1.0)


def weight(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def search(docs: DataFrame, query: str, k: int = 10, eligible: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of the k best documents, best first, ties by id.

    Statistics are those of all documents; `eligible` (doc_id) restricts only which
    are scored.
    """
    check_k(k)
    spark = docs.sparkSession
    terms = query_terms(docs, query) if k else []
    if not terms:
        return spark.createDataFrame([], "doc_id long, score double")
    rows = _asked(docs, terms, id_col, text_col)
    n = len(terms)
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"), F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0).cast("double") for i in range(n))).alias("df"))
    some = rows.filter("tf is not null")
    if eligible is not None:
        some = some.join(eligible.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    each = F.zip_with("tf", "df", lambda tf, df: F.when(tf > 0, idf(F.col("n"), df) * weight(tf, F.col("len"), F.col("avg"))).otherwise(0.0))
    score = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)
    return some.crossJoin(F.broadcast(stats)).filter("avg > 0").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def _asked(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, len, tf) of every document: frequencies of the terms in their order, null if it has none.

    Rows meet by document, an exchange that all readers of this frame share.
    """
    known, place, names = _terms(terms)

    def run(batches):
        for batch in batches:
            for i, j, c in counted(batch.column(1)):
                row, at, tf = _hits(c, known, place, names)
                some, first = np.unique(row, return_index=True)
                tfs: list = [None] * (j - i)
                cells = np.zeros((len(some), len(terms)), np.int32)
                cells[np.searchsorted(some, row), at] = tf
                for x, r in enumerate(some.tolist()):
                    tfs[r] = cells[x]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(c.lengths.astype(np.int32)), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "len", "tf"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return texts.mapInArrow(run, "doc_id long, len int, tf array<int>").groupBy("doc_id").agg(F.max("len").alias("len"), F.max("tf").alias("tf"))


def _terms(terms: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Hashes of the ASCII terms, ascending, their places among all, and the places of all by name."""
    ascii_ = [(hash_of(t), k) for k, t in enumerate(terms) if t.isascii()]
    ascii_.sort()
    return np.array([h for h, _ in ascii_], np.uint64), np.array([k for _, k in ascii_], np.int64), {t: k for k, t in enumerate(terms)}


def _hits(c, known: np.ndarray, place: np.ndarray, names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place of the term, and frequency of the asked terms of some rows, by row and place."""
    rows, at, tf = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(known) and len(c.hash):
        k = np.minimum(np.searchsorted(known, c.hash), len(known) - 1)
        hit = known[k] == c.hash
        rows, at, tf = [c.row[hit]], [place[k[hit]]], [c.tf[hit]]
    for r, bag in c.wide.items():
        found = [(names[t], n) for t, n in bag.items() if t in names]
        rows.append(np.full(len(found), r))
        at.append(np.array([x for x, _ in found], np.int64))
        tf.append(np.array([n for _, n in found], np.int64))
    row, at_, tf_ = np.concatenate(rows), np.concatenate(at), np.concatenate(tf)
    order = np.lexsort((at_, row))
    return row[order], at_[order], tf_[order]


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf) of an inverted index, counted within rows; terms over the size limit raise."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, _, c in counted(batch.column(1)):
                yield pa.record_batch([ids.take(pa.array(c.row + i)), c.strings(), pa.array(c.tf.astype(np.int32))], ["doc_id", "term", "tf"])
                for r, bag in c.wide.items():
                    yield pa.record_batch([pa.array([ids[i + r].as_py()] * len(bag), pa.int64()), pa.array(list(bag), pa.string()), pa.array(list(bag.values()), pa.int32())], ["doc_id", "term", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, term string, tf int")


def counted_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, doc_len): postings with the length of their row, and a row of null term for every document, in one scan."""

    def run(batches):
        names = ["doc_id", "term", "tf", "doc_len"]
        for batch in batches:
            ids = batch.column(0)
            for i, j, c in counted(batch.column(1)):
                lengths = c.lengths.astype(np.int32)
                yield pa.record_batch([ids.slice(i, j - i), pa.nulls(j - i, pa.string()), pa.nulls(j - i, pa.int32()), pa.array(lengths)], names)
                yield pa.record_batch([ids.take(pa.array(c.row + i)), c.strings(), pa.array(c.tf.astype(np.int32)), pa.array(lengths[c.row])], names)
                for r, bag in c.wide.items():
                    n = len(bag)
                    yield pa.record_batch([pa.array([ids[i + r].as_py()] * n, pa.int64()), pa.array(list(bag), pa.string()), pa.array(list(bag.values()), pa.int32()), pa.array(np.full(n, lengths[r]))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, term string, tf int, doc_len int")


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_len), the number of tokens."""

    def run(batches):
        for batch in batches:
            for i, j, c in counted(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(c.lengths.astype(np.int32))], ["doc_id", "doc_len"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, doc_len int")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("doc_count"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_doc_len"))


def search_texts(docs: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "query_id", text_col: str = "text", id_col: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents of every query, by scans of the texts.

    `queries` are counted first: they go to the tasks in parts of QUERIES, each of
    which scans the texts twice.  Scores don't depend on how rows lie in tasks.
    """
    check_k(k)
    spark = docs.sparkSession
    kind = dict(queries.dtypes)[query_id]
    schema = f"query_id {kind}, doc_id long, score double, rank int"
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(text_col).cast("string").alias("q"))
    n = asked.count()
    if not n or not k:
        return spark.createDataFrame([], schema)
    parts = -(-n // QUERIES)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("t"))
    out = None
    for x in range(parts):
        part = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("query_id", "q"), F.lit(parts)) == x)
        one = _scanned(texts, [(r.query_id, r.q or "") for r in part.collect()], k, kind)
        out = one if out is None else out.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def _scanned(texts: DataFrame, queries: list[tuple], k: int, kind: str) -> DataFrame:
    """(query_id, doc_id, score): each task's k best documents of some queries."""
    bags = [sorted(set(words_of(q))) for _, q in queries]
    terms = sorted({t for bag in bags for t in bag})
    if len(terms) > TERMS:
        raise LimitExceeded(f"{QUERIES} queries have {TERMS} terms at most")
    known, place, names = _terms(terms)
    holders: list[list[int]] = [[] for _ in terms]
    for q, bag in enumerate(bags):
        for t in bag:
            holders[names[t]].append(q)
    holders_ = [np.array(h, np.int64) for h in holders]

    def statistics(batches):
        df, docs, total = np.zeros(len(terms) + 2, np.int64), 0, 0
        for batch in batches:
            docs += batch.num_rows
            for _, _, c in counted(batch.column(0)):
                total += int(c.lengths.sum())
                df[:-2] += np.bincount(_hits(c, known, place, names)[1], minlength=len(terms))
        df[-2:] = docs, total
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], ["at", "n"])

    got = texts.select("t").mapInArrow(statistics, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # one row per term
    counts = np.zeros(len(terms) + 2)
    counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
    n_docs, average = counts[-2], counts[-1] / max(counts[-2], 1)
    idfs = np.log((n_docs - counts[:-2] + 0.5) / (counts[:-2] + 0.5) + 1.0)
    block = max(1, (1 << 22) // max(len(queries), 1))

    def best(batches):
        top_id = np.zeros((len(queries), 0), np.int64)
        top = np.zeros((len(queries), 0))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, c in counted(batch.column(1)):
                row, at, tf = _hits(c, known, place, names)
                size = c.lengths[row]
                w = idfs[at] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average)))
                for lo in range(0, j - i, block):
                    a, b = np.searchsorted(row, [lo, lo + block])
                    if a == b:
                        continue
                    score = np.zeros((min(block, j - i - lo), len(queries)))
                    order = np.argsort(at[a:b], kind="stable") + a
                    cuts = np.flatnonzero(np.diff(at[order])) + 1
                    for group in np.split(order, cuts):  # in the order of the terms
                        score[np.ix_(row[group] - lo, holders_[at[group[0]]])] += w[group][:, None]
                    top_id, top = _merged(top_id, top, ids[i + lo : i + lo + len(score)], score.T, k)
        q, x = np.nonzero(top > 0)
        yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(top_id[q, x]), pa.array(top[q, x])], ["at", "doc_id", "score"])

    found = texts.mapInArrow(best, "at int, doc_id long, score double")
    labels = texts.sparkSession.createDataFrame([(q, x) for q, (x, _) in enumerate(queries)], f"at int, query_id {kind}")
    return found.join(F.broadcast(labels), "at").select("query_id", "doc_id", "score")  # QUERIES rows at most


def _merged(ids: np.ndarray, scores: np.ndarray, new_ids: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of two score tables, ties by id."""
    if new.shape[1] > 4 * k:  # what can't be among the best goes before the sort, ties kept
        least = -np.partition(-new, k - 1, axis=1)[:, k - 1]
        if scores.shape[1] >= k:
            least = np.maximum(least, scores[:, k - 1])
        use = ((new >= least[:, None]) & (new > 0)).any(axis=0)
        new, new_ids = new[:, use], new_ids[use]
    every = np.concatenate([scores, new], axis=1)
    all_ids = np.concatenate([ids, np.broadcast_to(new_ids, new.shape)], axis=1)
    order = np.lexsort((all_ids, -every), axis=1)[:, :k]
    return np.take_along_axis(all_ids, order, 1), np.take_along_axis(every, order, 1)


def doc_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def search_batch(index: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents of every query, in one job.

    Weights are summed in the order of the terms, so scores don't depend on how
    rows were spread over tasks.
    """
    check_k(k)
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    wanted = index.join(asked.select("term").distinct(), "term", "left_semi")
    stats = F.broadcast(corpus_stats(lengths))
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.crossJoin(stats).select("term", idf(F.col("doc_count").cast("double"), F.col("df").cast("double")).alias("idf"))
    scored = wanted.join(lengths, "doc_id").crossJoin(stats).filter("avg_doc_len > 0").select("doc_id", "term", weight(F.col("tf"), F.col("doc_len"), F.col("avg_doc_len")).alias("w"))
    parts = scored.join(weights, "term").join(asked, "term").select("query_id", "doc_id", F.struct("term", (F.col("idf") * F.col("w")).alias("c")).alias("p"))
    sums = parts.groupBy("query_id", "doc_id").agg(F.aggregate(F.array_sort(F.collect_list("p")), F.lit(0.0), lambda acc, x: acc + x["c"]).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
