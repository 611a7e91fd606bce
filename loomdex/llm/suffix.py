"""Repeated byte strings: which bytes lie in a string of `length` bytes that starts elsewhere too.

A difference cover lets suffixes be sorted by a sample of them, because any two
suffixes reach sampled positions at the same distance.  Here the sample is chosen
by content (the least k-gram hash of each window of `length` bytes), so that two
equal strings of `length` bytes hold a sampled position at the same offset; it
takes one position in about length / 3, and the steps follow the classical ones:

1. Sample and name.  The starts that share a sampled position form a run.  A run is
   named by a 64-bit fingerprint of all the bytes that its strings cover, and by
   that of its sampled k-gram.
2. Compare names.  A run whose name occurs twice is repeated as a whole.  A run
   whose k-gram occurs under no other name has no partner.  Both are settled.
3. Merge the rest.  Each run left, and one of each settled name that shares its
   k-gram, brings its bytes.  Within a k-gram every start is named by its own
   `length` bytes and equal names meet.  All strings of a run overlap, so its least
   and its greatest repeated start say what it covers.  A k-gram with very many
   names is not gathered: its starts are counted by a distributed aggregation.

Names are compared among all rows that could hold a partner, by partial
aggregation, so no group is gathered whose size the data decide.  One shuffle of
the texts serves the third step and the result.

The triples of the textbook form (sample two of three suffixes, sort, recurse,
merge) would shuffle some 20 bytes for each byte of text on every level; names of
content-chosen samples take about a third of a byte.

Bytes are compared by fingerprints alone.  Two different runs are taken for one only
if both of their fingerprints agree, a chance of about 2 ** -128 a pair; two starts of
one k-gram with a chance of about 2 ** -64.

`digest` can count a shorter length on the way: strings of `length` bytes that repeat
lie wholly in runs of repeated `passage`-byte strings, so only texts with such a run of
`length` bytes or more, and of these only the runs, are looked at again.

Defined results: null and empty texts, and those shorter than `length`, lose
nothing unless a caller says otherwise; repeated rows are occurrences like any
others, and so are two starts in one text, overlapping ones included; rows with
repeated or null ids stay apart; matches never cross texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import groups, utf8
from .tables import ROW, cut, drop, free_name, keyed

LENGTH = 400
GROUP = 1 << 20
#: Names of one k-gram that a task may gather.
GATHERED = 1 << 14
_RNG = np.random.default_rng(90210)
_VALUE = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPAN = 2 * GROUP + 2


def _powers(odd: int, n: int) -> np.ndarray:
    out = np.full(n, odd, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list = []


def _tables():
    """Powers of both multipliers and of their inverses, made once in each worker."""
    if not _TABLES:
        _TABLES.extend((_powers(b, _SPAN), _powers(pow(b, -1, 1 << 64), _SPAN)) for b in _ODD)
    return _TABLES


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Prints:
    """Fingerprints of any substring of some bytes."""

    def __init__(self, raw: np.ndarray):
        self.sums = []
        for value, (up, _) in zip(_VALUE, _tables()):
            s = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(value[raw] * up[: len(raw)], out=s[1:])
            self.sums.append(s)

    def of(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        s, (_, down) = self.sums[which], _tables()[which]
        return (s[stop] - s[start]) * down[start]

    def name(self, which: int, start: np.ndarray, stop: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Signed 64 bits of raw[start:stop], its length and a number."""
        x = _mix(self.of(which, start, stop)) + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return _mix(x ^ (extra.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))).view(np.int64)


def runs(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first start, number of starts, k-gram name and name of each run.

    `raw` holds rows end to end and `off` their bounds; starts count within `raw`.
    """
    k = length // 3
    w = length - k + 1
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return (none,) * 5
    prints = Prints(raw)
    at = np.arange(n - k + 1)
    gram = _mix(prints.of(0, at, at + k))
    key = (gram & ~np.uint64((1 << 22) - 1)) | at.astype(np.uint64)
    size = -(-len(key) // w) * w
    padded = np.full(size, ~np.uint64(0))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    anchor = (np.minimum(after[:starts], before[w - 1 : w - 1 + starts]) & np.uint64((1 << 22) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:starts]
    good = np.arange(starts) + length <= off[1:][row]
    p = np.flatnonzero(good)
    if not len(p):
        return (none,) * 5
    a, r = anchor[p], row[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(p)))
    p1, a1 = p[head], a[head]
    stop = p1 + count - 1 + length
    return r[head], p1, count, gram[a1].view(np.int64), prints.name(1, p1, stop, a1 - p1)


def segments(raw: np.ndarray, ends: np.ndarray, length: int):
    """First row, bytes, bounds and place within the row of pieces of bounded size.

    Whole rows go together; a long row is cut into pieces that overlap so that
    each start falls into one of them.
    """
    for i, j in groups(ends, GROUP):
        if j == i + 1 and ends[j] - ends[i] > 2 * GROUP - length:
            for lo in range(int(ends[i]), int(ends[j]) - length + 1, GROUP):
                part = raw[lo : min(lo + GROUP + length - 1, int(ends[j]))]
                yield i, part, np.array([0, len(part)]), lo - int(ends[i])
        else:
            yield i, raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i], 0


def _windows(raw: np.ndarray, ends: np.ndarray, column: pa.Array | None) -> tuple[np.ndarray, ...]:
    """Bytes and bounds of the windows of rows, end to end; the row and place of each window.  Without a column: the rows."""
    if column is None:
        return raw, ends, np.arange(len(ends) - 1), np.zeros(len(ends) - 1, np.int64)
    at = column.offsets.to_numpy()
    row = np.repeat(np.arange(len(column)), np.diff(at))
    s, e = (column.values.field(k).to_numpy(zero_copy_only=False)[at[0] : at[-1]] for k in (0, 1))
    parts = [raw[ends[i] + x : ends[i] + y] for i, x, y in zip(row, s, e)]
    return np.concatenate([*parts, raw[:0]]), np.concatenate([[0], np.cumsum(e - s)]), row, s


def run_table(docs: DataFrame, length: int) -> DataFrame:
    """(r, p, n, g, u) of every run of (r, t), or of its windows w, an array of (s, e)."""
    windows = "w" in docs.columns

    def work(batches):
        for batch in batches:
            raw, ends = utf8(batch.column(1))
            keys = batch.column(0).to_numpy()
            raw, ends, owner, begin = _windows(raw, ends, batch.column(2) if windows else None)
            for i, part, off, place in segments(raw, ends, length):
                row, p, n, g, u = runs(part, off, length)
                cols = (keys[owner[i + row]], (p - off[row] + place + begin[i + row]).astype(np.int64), n.astype(np.int32), g, u)
                yield pa.record_batch([pa.array(c) for c in cols], ["r", "p", "n", "g", "u"])

    return docs.select("r", "t", *(["w"] if windows else [])).mapInArrow(work, "r long, p long, n int, g long, u long")


def start_names(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice number, place in the slice, and name of every start of some slices."""
    out = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= GROUP):
            size += len(texts[j])
            j += 1
        n = np.fromiter(map(len, texts[i:j]), np.int64, j - i)
        first = np.concatenate([[0], np.cumsum(n)])
        prints = Prints(np.frombuffer(b"".join(texts[i:j]), np.uint8))
        number = n - length + 1
        which = np.repeat(np.arange(j - i), number)
        place = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
        p = first[which] + place
        out.append((which + i, place, prints.name(0, p, p + length, np.zeros(1, np.int64)) ^ prints.name(1, p, p + length, np.ones(1, np.int64))))
        i = j
    return tuple(np.concatenate(c) for c in zip(*out))


def repeated_starts(grams: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slices with a start that occurs twice under their k-gram; its least and greatest such place."""
    which, place, name = start_names(texts, length)
    order = np.lexsort((name, grams[which]))
    g, x = grams[which][order], name[order]
    same = (g[1:] == g[:-1]) & (x[1:] == x[:-1])
    twice = np.zeros(len(x), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]
    hit.sort()
    which, place = which[hit], place[hit]
    new = np.ones(len(which), bool)
    new[1:] = which[1:] != which[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return at, at, at
    return which[at], np.minimum.reduceat(place, at), np.maximum.reduceat(place, at)


def _merge_gathered(slices: DataFrame, length: int) -> DataFrame:
    """(r, s, e) covered by the slices' repeated starts; a k-gram's slices meet in one task."""

    def solve(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        which, lo, hi = repeated_starts(t.column("g").to_numpy(), [x.as_py() for x in t.column("x")], length)
        r, p, rep = (t.column(c).to_numpy(zero_copy_only=False) for c in ("r", "p", "rep"))
        keep = ~rep[which]
        which, lo, hi = which[keep], lo[keep], hi[keep]
        return pa.record_batch([pa.array(r[which]), pa.array(p[which] + lo), pa.array(p[which] + hi + length)], ["r", "s", "e"])

    def work(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            if held and size > 4 * GROUP:  # all but the last k-gram are complete
                cut_at = int(np.argmax(g != held[-1].column(0)[-1].as_py())) if (g != held[-1].column(0)[-1].as_py()).any() else None
                if cut_at is not None:
                    yield solve([*held, batch.slice(0, cut_at)])
                    held, size, batch = [], 0, batch.slice(cut_at)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield solve(held)

    ordered = slices.select("g", "r", "p", "rep", "x").repartition("g").sortWithinPartitions("g")
    return ordered.mapInArrow(work, "r long, s long, e long")


def _merge_counted(slices: DataFrame, length: int) -> DataFrame:
    """The same for k-grams of very many names, by counting the names of starts."""

    def work(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                which, place, name = start_names([x.as_py() for x in b.column(4)], length)
                g, r, p, rep = (b.column(k).to_numpy(zero_copy_only=False)[which] for k in range(4))
                yield pa.record_batch([pa.array(c) for c in (g, name, r, p + place, rep)], ["g", "x", "r", "p", "rep"])

    starts = slices.select("g", "r", "p", "rep", "x").mapInArrow(work, "g long, x long, r long, p long, rep boolean")
    twice = starts.groupBy("g", "x").agg(F.count("*").alias("c")).filter("c > 1").select("g", "x")
    hit = starts.filter("not rep").join(twice, ["g", "x"], "left_semi")
    return hit.select("r", F.col("p").alias("s"), (F.col("p") + length).alias("e"))


def covered(docs: DataFrame, length: int = LENGTH, gathered: int = GATHERED) -> DataFrame:
    """(r, spans) of the rows of (r, t, id) that hold repeated strings.

    `spans` are pairs (s, e) of bytes, end exclusive, in no order; they may overlap.
    """
    if length < 16 or length > GROUP // 2:
        raise ValueError("length must be 16 to 524288")
    table = cut(run_table(docs, length))
    names = table.groupBy("g", "u").agg(F.count("*").alias("c"))
    names = cut(names)
    grams = names.groupBy("g").agg(F.count("*").alias("names")).filter("names > 1")
    verdict = names.join(grams, "g", "left").filter("c > 1 or names is not null")
    known = cut(table.join(verdict, ["g", "u"]).select("r", "p", "n", "g", "u", "c", "names"))
    drop(table)
    drop(names)

    whole = known.filter("c > 1").select("r", F.col("p").alias("s"), (F.col("p") + F.col("n") - 1 + length).alias("e"))
    one = known.filter("c > 1 and names is not null").groupBy("g", "u").agg(F.min(F.struct("r", "p", "n", "names")).alias("m"))
    asked = known.filter("c = 1").select("r", F.struct("p", "n", "g", "names", F.lit(False).alias("rep")).alias("q"))
    asked = asked.unionByName(one.select("m.r", F.struct("m.p", "m.n", "g", "m.names", F.lit(True).alias("rep")).alias("q")))
    lists = asked.groupBy("r").agg(F.collect_list("q").alias("q"))

    def take(batches):
        for batch in batches:
            raw, ends = utf8(batch.column(1))
            keys = batch.column(0).to_pylist()
            q = batch.column(3)
            cells = [q.values.field(k) for k in range(5)]
            at = q.offsets.to_numpy()
            p, n, g, names, rep = (c.to_numpy(zero_copy_only=False) for c in cells)
            for i, key in enumerate(keys):
                a, b = at[i], at[i + 1]
                bytes_ = [raw[ends[i] + s : ends[i] + s + m - 1 + length].tobytes() for s, m in zip(p[a:b], n[a:b])]
                yield pa.record_batch([pa.array(g[a:b]), pa.array(np.full(b - a, key)), pa.array(p[a:b]), pa.array(rep[a:b]), pa.array(names[a:b]), pa.array(bytes_, pa.binary())], ["g", "r", "p", "rep", "names", "x"])

    shuffled = docs.select("r", "t", "id").repartition("r")
    slices = shuffled.join(lists, "r").mapInArrow(take, "g long, r long, p long, rep boolean, names long, x binary")
    spans = whole.unionByName(_merge_gathered(slices.filter(F.col("names") <= gathered), length))
    if not grams_over(known, gathered):
        return spans.groupBy("r").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = spans.unionByName(_merge_counted(slices.filter(F.col("names") > gathered), length))
    return spans.groupBy("r").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def grams_over(known: DataFrame, gathered: int) -> bool:
    return not known.filter(F.col("names") > gathered).isEmpty()


def _gone(n: int, spans: np.ndarray) -> np.ndarray:
    """Merged spans (s, e), ascending, of n bytes."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    inside = np.cumsum(edge[:-1]) > 0
    step = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)


def _span_arrays(column: pa.Array) -> list[np.ndarray | None]:
    """Spans of each row; None where there are none."""
    at = column.offsets.to_numpy()
    s, e = (column.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    return [np.stack([s[a:b], e[a:b]], axis=1) if v and b > a else None for a, b, v in zip(at, at[1:], ok)]


def _keep(raw: np.ndarray, gone: np.ndarray) -> bytes:
    ends = [0, *gone.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b].tobytes() for a, b in zip(ends[::2], ends[1::2]))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")), "id")
    return base.select(F.col(ROW).alias("r"), "t", "id")


_DIGEST = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digested(texts: DataFrame) -> DataFrame:
    """The digest columns of (r, t, id, spans)."""

    def work(batches):
        for batch in batches:
            raw, ends = utf8(batch.column(1))
            out: list[tuple] = []
            for i, spans in enumerate(_span_arrays(batch.column(3))):
                text = raw[ends[i] : ends[i + 1]]
                gone = _gone(len(text), spans) if spans is not None else np.zeros((0, 2), np.int64)
                out.append((len(text), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(_keep(text, gone)).hexdigest()))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.record_batch([batch.column(2), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("r", "t", "id", "spans").mapInArrow(work, _DIGEST)


def _passages(src: DataFrame, passage: int, length: int) -> DataFrame:
    """(r, id, n_bytes, n_repeated, sha, t, w) of the rows of (r, t, id).

    `n_repeated` counts the bytes in repeated strings of `passage` bytes.  `w` are the
    runs of these of `length` bytes or more; rows without any have the digest of the
    whole text in `sha`, and no text.
    """

    def work(batches):
        for batch in batches:
            raw, ends = utf8(batch.column(1))
            total, sha, text, runs_ = [], [], [], []
            for i, spans in enumerate(_span_arrays(batch.column(3))):
                body = raw[ends[i] : ends[i + 1]]
                gone = _gone(len(body), spans) if spans is not None else np.zeros((0, 2), np.int64)
                size = gone[:, 1] - gone[:, 0]
                wide = gone[size >= length]
                total.append(int(size.sum()))
                sha.append(None if len(wide) else hashlib.sha256(body.tobytes()).hexdigest())
                text.append(batch.column(1)[i].as_py() if len(wide) else None)
                runs_.append([{"s": int(a), "e": int(b)} for a, b in wide] if len(wide) else None)
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            cells = [pa.array(np.diff(ends)), pa.array(total, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string()), pa.array(runs_, kind)]
            yield pa.record_batch([batch.column(0), batch.column(2), *cells], ["r", "id", "n_bytes", "n_repeated", "sha", "t", "w"])

    joined = src.repartition("r").join(covered(src, passage), "r", "left").select("r", "t", "id", "spans")
    return cut(joined.mapInArrow(work, "r long, id long, n_bytes long, n_repeated long, sha string, t string, w array<struct<s:long,e:long>>"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256.

    With `passage`, a shorter length, also n_repeated: the bytes in strings of so many
    bytes that start elsewhere too.  These are only counted, not removed.
    """
    src = _source(docs, id_col, text_col)
    if passage is None:
        return _digested(src.repartition("r").join(covered(src, length), "r", "left")).withColumnRenamed("id", id_col)
    if passage > length:
        raise ValueError("passage must be at most length")
    seen = _passages(src, passage, length)
    wide = seen.filter("w is not null")
    both = wide.select("r", "t", "id").repartition("r").join(covered(wide.select("r", "t", "id", "w"), length), "r", "left")
    again = _digested(both.withColumn("id", F.col("r"))).withColumnRenamed("id", "r")
    again = again.join(wide.select("r", "id", "n_repeated"), "r").select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")
    none = F.lit(0).cast("long")
    plain = seen.filter("w is null").select("id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"), "n_repeated")
    return plain.unionByName(again).withColumnRenamed("id", id_col)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, length_col: str | None = None) -> DataFrame:
    """`docs` without the characters that lie wholly in repeated strings; other columns stay.

    Rows that lose everything stay, with an empty text; null texts stay null.
    `length_col`, if given, is set to the new number of characters.
    """
    name = free_name(docs, ROW)
    spans_col = free_name(docs, "_spans")
    base = keyed(docs, id_col, name)
    src = base.select(F.col(name).alias("r"), F.col(text_col).cast("string").alias("t"), F.col(name).alias("id"))
    found = covered(src, length).select(F.col("r").alias(name), F.col("spans").alias(spans_col))
    joined = base.join(found, name, "left").select(*docs.columns, spans_col)
    columns = docs.columns
    at = columns.index(text_col)

    def work(batches):
        for batch in batches:
            raw, ends = utf8(batch.column(at))
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(_span_arrays(batch.column(batch.num_columns - 1))):
                if spans is None or texts[i] is None:
                    continue
                text = raw[ends[i] : ends[i + 1]]
                gone = _gone(len(text), spans)
                inner = np.append((text & 0xC0) == 0x80, False)
                for k in range(len(gone)):  # whole characters only
                    while gone[k, 0] < gone[k, 1] and inner[gone[k, 0]]:
                        gone[k, 0] += 1
                    while gone[k, 1] > gone[k, 0] and inner[gone[k, 1]]:
                        gone[k, 1] -= 1
                texts[i] = _keep(text, gone).decode()
            cols = list(batch.columns)[:-1]
            cols[at] = pa.array(texts, pa.string())
            yield pa.record_batch(cols, columns)

    out = joined.mapInArrow(work, docs.schema)
    if length_col:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast("long")))
    return out.select(docs.columns)
