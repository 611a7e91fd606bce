"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces of equal length are interchangeable, so best-fit decreasing runs on the
histogram of lengths: a bounded table whatever the corpus holds.  Each step puts
the pieces of one length into the tightest open bins, and opens new bins where
none fits.  Several opening rules are planned (each permitted length as the
preferred one, and the length that costs least per piece); all are downsized to
the least permitted length that holds their contents, and the cheapest plan wins.

The pieces then find their bin by their rank among those of their length.  A
length that holds many pieces is ranked in salted buckets of about `BUCKET` rows.

Defined results: a document longer than the longest bin is split, its pieces keep
their token offset; every piece counts one separator, so null and empty texts are
pieces of length 1; repeated rows are packed each for itself; an empty table gives
no bins; null ids stay null in `doc_ids`.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin beyond its length, in tokens.
OVERHEAD = 32
BUCKET = 1 << 20


def word_count(text: Column) -> Column:
    """Tokens of a text: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


class Plan:
    """Steps (length, first rank, pieces, first bin, pieces per bin), and each bin's content."""

    def __init__(self, counts: dict[int, int], capacities: Sequence[int], overhead: int, prefer: int | None):
        self.capacities, self.overhead = sorted(capacities), overhead
        self.steps: list[tuple[int, int, int, int, int]] = []
        self.n_bins = 0
        groups: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by free space: first bin, bins, capacity
        frees: list[int] = []

        def put(free: int, bins: tuple[int, int, int]) -> None:
            if not groups[free]:
                insort(frees, free)
            groups[free].append(bins)

        for length in sorted(counts, reverse=True):
            rank, left = 0, counts[length]
            while left:
                k = bisect_left(frees, length)
                if k < len(frees):
                    free = frees[k]
                    first, n, cap = groups[free].pop()
                    if not groups[free]:
                        frees.pop(k)
                else:
                    free = cap = self._open(length, left, prefer)
                    first, n = self.n_bins, -(-left // (cap // length))
                    self.n_bins += n
                each = free // length
                full = min(n, left // each)
                if full:
                    self.steps.append((length, rank, full * each, first, each))
                    rank, left = rank + full * each, left - full * each
                    put(free - each * length, (first, full, cap))
                if full < n:
                    if left:
                        self.steps.append((length, rank, left, first + full, left))
                        put(free - left * length, (first + full, 1, cap))
                        left, full = 0, full + 1
                    if full < n:
                        put(free, (first + full, n - full, cap))
        self.cost = sum(n * (self.least(cap - free) + overhead) for free, g in groups.items() for _, n, cap in g)

    def least(self, used: int) -> int:
        """The least permitted length that holds `used` tokens."""
        return next(c for c in self.capacities if c >= used)

    def _open(self, length: int, left: int, prefer: int | None) -> int:
        fit = [c for c in self.capacities if c >= length]
        if prefer is not None:
            return next((c for c in fit if c >= prefer), fit[-1])
        return min(fit, key=lambda c: ((c + self.overhead) / min(c // length, left), -c))


def plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """The cheapest of the plans, ties by the order of the rules."""
    return min((Plan(counts, capacities, overhead, p) for p in (None, *sorted(capacities, reverse=True))), key=lambda p: p.cost)


def pieces(df: DataFrame, longest: int, id_col: str, length: Column) -> DataFrame:
    """(doc_id, start, length): documents cut into pieces of at most longest - 1 tokens and a separator."""
    room = longest - 1
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / room) - 1, F.lit(0)).cast("long")
    out = base.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return out.select("doc_id", (F.col("k") * room).alias("start"), (F.least(F.lit(room), F.col("n") - F.col("k") * room) + 1).cast("int").alias("length"))


def pack(df: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, bucket: int = BUCKET) -> DataFrame:
    """One row per bin: bin_id, capacity, used, n_pieces, doc_ids, starts, lengths.

    `lengths` counts each piece's separator; `used` is their sum.
    """
    from .tables import cut

    if not capacities or min(capacities) < 2:
        raise ValueError("capacities must be at least 2")
    items = cut(pieces(df, max(capacities), id_col, word_count(F.col(text_col)) if length is None else length))
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length: at most max(capacities)
    best = plan(counts, capacities, overhead)
    if max(counts.values(), default=0) > bucket:
        spark = df.sparkSession
        salts = spark.createDataFrame([(k, -(-n // bucket)) for k, n in counts.items()], "length int, salts int")
        items = items.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), "salts").cast("int"))
        sizes = items.groupBy("length", "salt").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        items = items.join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"])
    else:
        items = items.withColumns({"salt": F.lit(0), "before": F.lit(0).cast("long")})
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = items.select("doc_id", "start", "length", (F.row_number().over(order) - 1 + F.col("before")).cast("long").alias("rank"))

    # The steps number a few times the permitted lengths, however many documents there are.
    table = np.array(sorted(best.steps), np.int64).reshape(-1, 5)
    keys = table[:, 0] * (1 << 44) + table[:, 1]

    def place(batches):
        for b in batches:
            n = b.column(2).to_numpy().astype(np.int64)
            rank = b.column(3).to_numpy()
            at = np.searchsorted(keys, n * (1 << 44) + rank, side="right") - 1
            bins = table[at, 3] + (rank - table[at, 1]) // table[at, 4]
            yield pa.record_batch([pa.array(bins, pa.int64()), *b.columns[:3]], ["bin_id", "doc_id", "start", "length"])

    placed = ranked.mapInArrow(place, "bin_id long, doc_id long, start long, length int")
    member = F.struct((-F.col("length")).alias("o"), "doc_id", "start", "length")
    bins = placed.groupBy("bin_id").agg(F.array_sort(F.collect_list(member)).alias("m"), F.sum("length").alias("used"))
    capacity = F.coalesce(*(F.when(F.col("used") <= c, F.lit(c)) for c in sorted(capacities)))
    return bins.select(
        "bin_id",
        capacity.cast("int").alias("capacity"),
        F.col("used").cast("long").alias("used"),
        F.size("m").alias("n_pieces"),
        F.col("m.doc_id").alias("doc_ids"),
        F.col("m.start").alias("starts"),
        F.col("m.length").alias("lengths"),
    )
