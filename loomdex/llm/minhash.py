"""Near-duplicate documents by SetSketch registers.

A document's set holds the hashes of its distinct five-word shingles.  Register i
is the minimum of an exponential variate over the set, truncated to a power of the
base: registers merge by maximum, and equal ones are the more likely the more two
sets have in common.  Bands of registers give buckets.

1. Documents of equal sets collapse into their smallest row.
2. Each bucket links its members to its smallest one (a star, not all pairs).
   The joint likelihood of two sketches, with the known set sizes, drops pairs far
   below the threshold; the rest are confirmed on the full sets.
3. A bucket whose members lie in one component needs nothing more.  For members of
   the others a prefix filter finds the remaining candidates exactly: two sets over
   the threshold share one of their rarest shingles, so shingles are ranked by
   their frequency and only each set's first ones meet.  Pairs that already are in
   one component are left out; the rest are confirmed on the full sets.

The components of confirmed links equal those of all links between members of a
common bucket; a pair at the threshold misses all buckets with a probability of
`miss_probability`.

Defined results: null, empty and wordless texts have an empty set and link with
nothing; a text of fewer words than a shingle has one shingle, the whole of it;
repeated ids stay rows of their own, and `component_id` is the smallest id; null
ids take part, are never smallest, and a component of null ids alone has a null
id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .arrow import groups, utf8
from .components import components
from .tables import ROW, cut, drop, free_name, keyed

GROUP = 1 << 20
BANDS, ROWS_PER_BAND = 32, 4
REGISTERS = BANDS * ROWS_PER_BAND
BASE = 1.001
TOP = (1 << 16) - 2
#: Pairs whose likeliest similarity is this far under the threshold are dropped:
#: over six deviations of the estimate.
SLACK = 0.22
#: Pairs whose likelihoods are in memory at once.
SLAB = 512
_RNG = np.random.default_rng(20240501)
_XOR = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(odd: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, odd, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles(raw: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct k-word shingles of each row, sorted."""
    starts, size, row = words.spans(raw, off, words.VISIBLE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(raw)
    up, down = _powers(_ODD, n + 1), _powers(_BACK, n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[words.LOWER[raw]] * up[:n], dtype=np.uint64)])
    word = _finish((sums[starts + size] - sums[starts]) * down[starts] + size.astype(np.uint64) * _STEP)
    per = np.bincount(row, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(per)])
    width = np.minimum(per, k)
    ends = first[row] + per[row] - width[row]
    at = np.flatnonzero(np.arange(len(row)) <= ends)
    wide = width[row[at]]
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        here = wide > j
        h[here] = _finish(h[here] * _STEP + word[at[here] + j])
    out = row[at]
    order = np.lexsort((h, out))
    out, h = out[order], h[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (h[1:] != h[:-1])
    return out[new], h[new]


def registers(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, REGISTERS) uint16 sketches of the sets that begin at `at` in h; none is empty."""
    least = np.empty((len(at), REGISTERS), np.uint64)
    tops = np.append(at, len(h))
    i = 0
    while i < len(at):  # runs of sets that stay in the processor's cache
        j = max(int(np.searchsorted(tops, tops[i] + (1 << 14), side="right")) - 1, i + 1)
        part, cuts = h[tops[i] : tops[j]], at[i:j] - tops[i]
        for r in range(REGISTERS):
            x = part ^ _XOR[r]
            x *= _MUL[r]
            x ^= x >> np.uint64(32)
            x *= _STEP
            least[i:j, r] = np.minimum.reduceat(x, cuts)
        i = j
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    exponential = np.maximum(-np.log1p(-u), 1e-300)
    return np.clip(np.floor(1 - np.log(exponential / 20) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def joint(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs of sketches of sets of known sizes."""
    up = (a > b).sum(axis=1)
    down = (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)[:, None]

    def p(x):
        return -np.log(np.clip(1 - x * (BASE - 1) / BASE, 1e-12, 1)) / math.log(BASE)

    more, less = p(np.clip(u[:, None] - v[:, None] * grid, 0, 1)), p(np.clip(v[:, None] - u[:, None] * grid, 0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        log = np.where(up[:, None] > 0, up[:, None] * np.log(more), 0) + np.where(down[:, None] > 0, down[:, None] * np.log(less), 0)
        log = log + np.where(same[:, None] > 0, same[:, None] * np.log(np.maximum(1 - more - less, 1e-300)), 0)
    return grid[np.arange(len(grid)), np.argmax(log, axis=1)]


def miss_probability(similarity: float) -> float:
    return (1 - similarity**ROWS_PER_BAND) ** BANDS


def _groups(batches):
    for batch in batches:
        raw, ends = utf8(batch.column(1))
        for i, j in groups(ends, GROUP):
            yield batch.slice(i, j - i), raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]


def sketches(src: DataFrame, k: int) -> DataFrame:
    """(r, id, n, print, sketch): size, fingerprint and registers of each set of (r, t, id)."""

    def run(batches):
        for part, raw, off in _groups(batches):
            row, h = shingles(raw, off, k)
            n = np.bincount(row, minlength=len(off) - 1)
            some = np.flatnonzero(n)
            at = np.searchsorted(row, some)
            prints, sketch = [None] * len(n), [None] * len(n)
            if len(some):
                regs = registers(h, at)
                stop = np.append(at[1:], len(h))
                for q, (r, a, b) in enumerate(zip(some.tolist(), at.tolist(), stop.tolist())):
                    prints[r] = hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest()
                    sketch[r] = regs[q].tobytes()
            yield pa.record_batch([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketch, pa.binary())], ["r", "id", "n", "print", "sketch"])

    return src.mapInArrow(run, "r long, id long, n long, print binary, sketch binary")


def _bands(heads: DataFrame) -> DataFrame:
    """(b, r): the bucket of each band of a set."""
    w = 2 * ROWS_PER_BAND
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * w + 1, F.lit(w)))))
    return heads.select(band.alias("b"), "r")


def _likely(pairs: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) whose joint estimate is not far below the threshold."""
    side = lambda x, s, n: heads.select(F.col("r").alias(x), F.col("sketch").alias(s), F.col("n").alias(n))
    both = pairs.join(side("u", "su", "nu"), "u").join(side("v", "sv", "nv"), "v").filter(F.least("nu", "nv") >= F.greatest("nu", "nv") * (least - 1e-9))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, SLAB):
                part = b.slice(lo, SLAB)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("su", "sv"))
                j = joint(x, y, part.column("nu").to_numpy().astype(float), part.column("nv").to_numpy().astype(float))
                yield part.filter(pa.array(j >= least - SLACK)).select(["u", "v"])

    return both.select("u", "v", "su", "sv", "nu", "nv").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= percent * union of the full sets.

    Sets meet as rows of the join, one pair at a time: no Arrow batch holds the sets of many pairs.
    """
    side = lambda x, s: sets.select(F.col("r").alias(x), F.col("h").alias(s))
    joined = pairs.join(side("u", "hu"), "u").join(side("v", "hv"), "v")
    sized = joined.select("u", "v", F.size(F.array_intersect("hu", "hv")).cast("long").alias("both"), (F.size("hu") + F.size("hv")).cast("long").alias("n"))
    return sized.filter(F.col("both") * 100 >= (F.col("n") - F.col("both")) * percent).select("u", "v")


def _sets(src: DataFrame, k: int) -> DataFrame:
    """(r, h): the shingle hashes of each text, without repeats."""

    def run(batches):
        for part, raw, off in _groups(batches):
            row, h = shingles(raw, off, k)
            at = np.searchsorted(row, np.arange(len(off)))
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))], ["r", "h"])

    return src.mapInArrow(run, "r long, h array<long>")


def _prefix_pairs(sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a shingle of their prefixes."""

    cells = sets.select("r", F.explode("h").alias("x"), F.size("h").cast("long").alias("n"))
    often = cells.groupBy("x").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = cells.join(often, "x", "left").withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy(F.coalesce("df", F.lit(1)), "x")))
    # A set over the threshold shares percent of itself: its first n - ceil(percent n) + 1 shingles can't all be missing.
    head = ranked.filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1).filter("df > 1").select("x", "r", "n")
    head = head.join(comp.select(F.col("node").alias("r"), "component"), "r")
    mixed = head.groupBy("x").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("x")
    head = cut(head.join(mixed, "x"))
    other = head.select("x", F.col("r").alias("v"), F.col("n").alias("nv"), F.col("component").alias("cv"))
    pairs = head.withColumnRenamed("r", "u").join(other, "x").filter("component < cv").filter(F.least("n", "nv") * 100 >= F.greatest("n", "nv") * percent)
    return pairs.select("u", "v").distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(_row, id, n_shingles, component_id, kept) of every row, and the confirmed links of distinct sets."""
    base = keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")), "id")
    src = base.select(F.col(ROW).alias("r"), "t", "id")
    found = cut(sketches(src, k))
    full = found.filter("n > 0")
    first = full.groupBy("print").agg(F.min("r").alias("head"))
    heads = cut(full.join(first.select(F.col("head").alias("r")), "r", "left_semi").select("r", "n", "sketch"))
    band = cut(_bands(heads))
    crowded = band.groupBy("b").agg(F.min("r").alias("u"), F.count("*").alias("c")).filter("c > 1").select("b", "u")
    star = band.join(crowded, "b").filter("r <> u").select("u", F.col("r").alias("v")).distinct()
    likely = cut(_likely(star, heads, percent / 100))
    part = likely.select(F.col("u").alias("r")).unionByName(likely.select(F.col("v").alias("r"))).distinct()
    sets = cut(_sets(src.join(part, "r", "left_semi"), k))
    links = cut(_confirmed(likely, sets, percent))
    comp = components(links)

    # Buckets whose members are not all in one component.
    owned = band.join(comp.withColumnRenamed("node", "r"), "r", "left").select("b", "r", F.coalesce("component", "r").alias("c"))
    open_ = owned.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("b")
    rest = cut(owned.join(open_, "b", "left_semi").select("r", F.col("c").alias("component")).distinct())
    if not rest.isEmpty():
        more = cut(_sets(src.join(rest.select("r"), "r", "left_semi"), k))
        pairs = _prefix_pairs(more, rest.withColumnRenamed("r", "node"), percent)
        links = cut(links.unionByName(_confirmed(pairs, more, percent)))
        comp = components(links)
        drop(more)
    drop(sets)
    drop(band)

    # From distinct sets back to rows: sets by fingerprint, then the smallest id of a component.
    owner = first.join(comp.withColumnRenamed("node", "head"), "head", "left").select("print", F.coalesce("component", "head").alias("c"))
    # Empty sets stand alone and take no part in the joins: no key holds them all.
    rows = full.select("r", "id", "n", "print").join(owner, "print").select("r", "id", "n", "c")
    alone = found.filter("n = 0").select(F.col("r").alias(ROW), "id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("first"))
    least = rows.groupBy("c").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull(), "id", "r"))["r"].alias("first"))
    out = rows.join(least, "c").select(F.col("r").alias(ROW), "id", F.col("n").alias("n_shingles"), "component_id", (F.col("r") == F.col("first")).alias("first"))
    for t in (likely, heads, rest):
        drop(t)
    return out.unionByName(alone), links


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (id = component_id)."""
    out = link(docs, id_col, text_col, percent)[0]
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """`docs` with one row of each near-duplicate group: its smallest id; all columns stay."""
    name = free_name(docs, ROW)
    base = keyed(docs, id_col, name)
    first = link(base, name, text_col, percent)[0].filter("first").select(F.col("id").alias(name))
    return base.join(first, name, "left_semi").select(docs.columns)
