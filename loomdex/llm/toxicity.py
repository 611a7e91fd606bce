"""Toxicity by an induced lexicon.

Words are whole words in lower case, by a 64-bit hash of all their bytes.  A run of
CJK characters has no blanks and counts as its overlapping pairs of characters.
Document frequencies of all words come from the whole corpus, those by label from a
bounded sample of labelled training rows.

1. Words of at least three labelled rows that lean to clean ones, or have `MOST` of their
   rows toxic, by more deviations than `BY_CHANCE` words would reach by chance, span a
   graph.  Its edges are positive pointwise mutual information
   of co-occurrence within a window, counted over the whole corpus.  Random walks with
   restart from toxic seeds (nodes that chance doesn't explain, the weight of each its
   log-likelihood ratio) and from clean ones give each a polarity in -1..1.  Seeds and nodes have no cap.
2. The walk goes on from the toxic seeds, taken as one node, to every other word of the
   corpus, labelled or not, that stands within the window of a seed with positive mutual
   information and more often than chance explains.  These words and their polarities
   are a table that grows with the corpus.  It goes to the tasks in slices of `SLICE`
   words, one pass over the texts for each, so a lexicon of any size is used whole.

A word that is no node of the graph may share its first six or four bytes with nodes;
the mean polarity of these is an extra feature and never stands in for a word's own.
A document's polarities become a few features, and logistic regression on the sample
turns them into a score.

Labels are used only where crc32(id as text) mod 5 is not 0; the score sees
nothing but the text.

Defined results: null, empty and wordless texts get the score of a document
without any node; null ids are never labelled nor held out; repeated label rows
count once, as toxic if one of them says so; without training labels of both
kinds every score is the share of toxic ones, 0 if there are none; repeated and null
ids stay rows of their own; very long texts are one row of a task and count once;
other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .arrow import groups, utf8
from .tables import ROW, cut, drop, free_name, keyed

#: Labelled training rows at most, by the order of a hash of their id.
SAMPLE = 1 << 17
#: A word whose lean to a label passes the level that so many words pass by chance may be a node; two deviations at least.
BY_CHANCE = 1024
MOST = 0.5
#: Seeds that count even if chance explains their lean; for small samples.
LEAST_SEEDS = 8
#: Words of the grown lexicon that go to the tasks at once: 16 MB.
SLICE = 1 << 20
WINDOW = 16
RESTART = 0.25
GROUP = 1 << 20
FEATURES = 10


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def sample(labels: DataFrame, id_col: str, label_col: str, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and labels of at most `size` training rows."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    got = rows.orderBy(F.xxhash64("i"), "i").limit(size).toPandas()
    order = np.argsort(got["i"].to_numpy(np.int64))
    return got["i"].to_numpy(np.int64)[order], got["y"].to_numpy(np.int8)[order]


def nodes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row and node of each word in order, and where the words are: lower-case bytes, starts, lengths."""
    starts, size, row = words.spans(raw, offsets, words.LETTERS)
    lead = np.flatnonzero((raw >= 0xE3) & (raw <= 0xE9))
    if len(lead):
        starts, size, row = _pairs(raw, offsets, lead)
    low = words.lowered(raw)
    return row, words.hashed(low, starts, size), (low, starts, size)


def _pairs(raw: np.ndarray, offsets: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as by `words.spans`, but CJK characters, which begin at `lead`, as overlapping pairs or alone."""
    rest = raw.copy()
    for k in range(3):
        rest[np.minimum(lead + k, len(raw) - 1)] = 32
    starts, size, row = words.spans(rest, offsets, words.LETTERS)
    owner = np.searchsorted(offsets, lead, side="right") - 1
    joined = (np.diff(lead) == 3) & (np.diff(owner) == 0)
    before, after = np.append(False, joined), np.append(joined, False)
    alone = ~before & ~after
    wide = np.where(after, 6, np.minimum(3, len(raw) - lead))
    use = after | alone
    starts, size, row = (np.concatenate([x, y[use]]) for x, y in ((starts, lead), (size, wide), (row, owner)))
    order = np.argsort(starts, kind="stable")
    return starts[order], size[order], row[order]


def heads(low: np.ndarray, starts: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The first n bytes of each word that is longer than four bytes, else -1."""
    return np.where(size > 4, words.packed(low, starts, size, n), -1)


def stems(text: list[bytes], polarity: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Heads of n bytes of the nodes, ascending, and the mean polarity of the nodes under each."""
    size = np.array([len(t) for t in text], np.int64)
    head = heads(np.frombuffer(b"".join(text), np.uint8), np.cumsum(size) - size, size, n)
    uniq, back = np.unique(head, return_inverse=True)
    mean = np.bincount(back, polarity, len(uniq)) / np.maximum(np.bincount(back, minlength=len(uniq)), 1)
    return uniq[uniq >= 0], mean[uniq >= 0]


def _rows(batches):
    for batch in batches:
        raw, ends = utf8(batch.column(1))
        ids = batch.column(0)
        for i, j in groups(ends, GROUP):
            yield ids.slice(i, j - i), raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]


def frequencies(src: DataFrame, ids: np.ndarray, y: np.ndarray) -> DataFrame:
    """(node, word, df, toxic, clean): documents that hold the node, of all and by label."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = 0

        def merged():
            keys = np.concatenate([k for k, _, _ in held])
            counts = np.concatenate([c for _, c, _ in held])
            uniq, at, back = np.unique(keys, return_index=True, return_inverse=True)
            text = pa.concat_arrays([t for _, _, t in held]).take(pa.array(at))
            return uniq, np.stack([np.bincount(back, counts[:, k], len(uniq)).astype(np.int64) for k in range(3)], axis=1), text

        for key, raw, off in _rows(batches):
            row, node, (low, starts, size_) = nodes(raw, off)
            if not len(row):
                continue
            order = np.lexsort((row, node))
            row, node, starts, size_ = row[order], node[order], starts[order], size_[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (node[1:] != node[:-1])
            row, node, starts, size_ = row[new], node[new], starts[new], size_[new]
            label = _labels_of(key, ids, y)[row]
            uniq, at = np.unique(node, return_index=True)
            counts = np.stack([np.add.reduceat(v.astype(np.int64), at) for v in (np.ones(len(row), np.int64), label == 1, label == 0)], axis=1)
            held.append((uniq, counts, words.strings(low, starts[at], size_[at])))
            size += len(uniq)
            if size > 1 << 20:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield _counted(*held[0])
                    held, size = [], 0
        if held:
            yield _counted(*merged())

    out = src.mapInArrow(run, "node long, word binary, df long, toxic long, clean long")
    return out.groupBy("node").agg(F.min("word").alias("word"), F.sum("df").alias("df"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _counted(keys: np.ndarray, counts: np.ndarray, text: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([pa.array(keys), text.cast(pa.binary()), *(pa.array(counts[:, k].copy()) for k in range(3))], ["node", "word", "df", "toxic", "clean"])


def _labels_of(key: pa.Array, ids: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1, 0, or -1 where the id has no label in the sample."""
    if not len(ids):
        return np.full(len(key), -1, np.int8)
    at = key.fill_null(-(1 << 63)).to_numpy()
    k = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
    return np.where(ids[k] == at, y[k], -1)


def lean(a, b, n_a, n_b):
    """Signed root of the log-likelihood ratio, about a z score, that a of n_a and b of n_b differ."""

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = n_a / (n_a + n_b)
    both = part(a, (a + b) * share) + part(b, (a + b) * (1 - share)) + part(n_a - a, (n_a + n_b - a - b) * share) + part(n_b - b, (n_a + n_b - a - b) * (1 - share))
    return F.signum(a * n_b - b * n_a) * F.sqrt(2 * F.greatest(both, F.lit(0.0)))


def vocabulary(freq: DataFrame, n_toxic: int, n_clean: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, int]:
    """Nodes of the graph in ascending order, their words, leans to toxic and toxic shares, and how many words were tested.

    Of the words in at least three labelled rows, those that lean to a label at the
    level of `BY_CHANCE`, toxic ones with `MOST` of their rows toxic, and the `LEAST_SEEDS` that lean most to either.
    """
    z = lean(F.col("toxic").cast("double"), F.col("clean").cast("double"), n_toxic, n_clean)
    scored = cut(freq.filter("toxic + clean >= 3").select("node", "word", z.alias("z"), (F.col("toxic") / (F.col("toxic") + F.col("clean"))).alias("share")))
    tested = scored.count()
    least = max(2.0, NormalDist().inv_cdf(1 - min(0.5, BY_CHANCE / max(tested, 1)) / 2))
    ends = scored.filter("z > 0").orderBy(F.desc("z"), "node").limit(LEAST_SEEDS).unionByName(scored.filter("z <= 0").orderBy("z", "node").limit(LEAST_SEEDS))
    got = scored.filter((F.abs("z") >= least) & ((F.col("share") >= MOST) | (F.col("z") < 0))).unionByName(ends).distinct().toPandas().sort_values("node")  # words of the sample at most
    drop(scored)
    return got["node"].to_numpy(np.int64), [bytes(w) for w in got["word"]], got["z"].to_numpy(float), got["share"].to_numpy(float), tested


#: What a row of `cooccurrences` counts.
PAIRS, NEAR, ROWS, SEEDED = range(4)


def cooccurrences(src: DataFrame, vocab: np.ndarray, seeds: np.ndarray, window: int = WINDOW) -> DataFrame:
    """(kind, i, j, n) over all texts of (id, t).

    PAIRS: how often the nodes i and j stand in different words at most `window` apart.
    NEAR: rows with the word j, no node of the graph, at most `window` from a seed.
    ROWS and SEEDED: all rows, and those with a seed.
    """
    size = len(vocab)
    is_seed = np.zeros(size, bool)
    is_seed[seeds] = True

    def tallied(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        kind, i, j, n = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((j, i, kind))
        kind, i, j, n = kind[order], i[order], j[order], n[order]
        new = np.ones(len(i), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        at = np.flatnonzero(new)
        return kind[at], i[at], j[at], np.add.reduceat(n, at) if len(at) else n

    def pairs(row, at, word):
        for s in range(1, window + 1):
            gap = word[s:] - word[:-s]
            near = (gap <= window) & (row[s:] == row[:-s])
            if not near.any():
                break
            a, b = at[:-s][near], at[s:][near]
            key, n = np.unique(np.minimum(a, b) * size + np.maximum(a, b), return_counts=True)
            yield np.full(len(key), PAIRS), key // size, key % size, n

    def near(row, node, known, at):
        """One count for each row and word."""
        beside = np.zeros(len(node), bool)
        p = np.flatnonzero(known & is_seed[at])
        for d in (*range(-window, 0), *range(1, window + 1)):
            q = p + d
            ok = (q >= 0) & (q < len(node))
            ok[ok] = row[p[ok]] == row[q[ok]]
            beside[q[ok]] = True
        q = np.flatnonzero(beside & ~known)
        order = np.lexsort((row[q], node[q]))
        j, r = node[q][order], row[q][order]
        new = np.ones(len(j), bool)
        new[1:] = (j[1:] != j[:-1]) | (r[1:] != r[:-1])
        j, n = np.unique(j[new], return_counts=True)
        yield np.full(len(j), NEAR), np.full(len(j), -1), j, n

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size_ = rows = seeded = 0
        for key, raw, off in _rows(batches):
            row, node, _ = nodes(raw, off)
            at = np.minimum(np.searchsorted(vocab, node), size - 1)
            known = vocab[at] == node
            word = np.flatnonzero(known)
            rows += len(key)
            seeded += len(np.unique(row[word][is_seed[at[word]]]))
            new = [*pairs(row[word], at[word], word), *near(row, node, known, at)]
            held += new
            size_ += sum(len(c[0]) for c in new)
            if size_ > 1 << 21:
                held = [tallied(held)]
                size_ = len(held[0][0])
                if size_ > 1 << 20:
                    yield _pair_batch(held[0])
                    held, size_ = [], 0
        one = lambda kind, n: (np.array([kind]), np.array([-1]), np.array([-1]), np.array([n]))
        yield _pair_batch(tallied([*held, one(ROWS, rows), one(SEEDED, seeded)]))

    out = src.mapInArrow(run, "kind int, i int, j long, n long")
    return out.groupBy("kind", "i", "j").agg(F.sum("n").alias("n"))


def _pair_batch(c: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c[0].astype(np.int32)), pa.array(c[1].astype(np.int32)), pa.array(c[2].astype(np.int64)), pa.array(c[3].astype(np.int64))], ["kind", "i", "j", "n"])


def grown(counts: DataFrame, freq: DataFrame, tested: int) -> DataFrame:
    """(node, word, polarity) of the words beyond the graph that the walk reaches from its toxic seeds.

    A step goes to a word with positive mutual information, in proportion to it, rare
    pairs discounted; the polarity compares its visits with the mean of such words.
    """
    total = {r.kind: r.n for r in counts.filter(F.col("kind").isin(ROWS, SEEDED)).collect()}
    n_rows, n_seeded = float(total.get(ROWS, 0)), float(total.get(SEEDED, 0))
    df = freq.select(F.col("node").alias("j"), "word", F.col("df").cast("double").alias("df"))
    near = counts.filter((F.col("kind") == NEAR) & (F.col("n") >= 3)).select("j", F.col("n").cast("double").alias("near")).join(df, "j")
    apart = lean(F.col("near"), F.col("df") - F.col("near"), n_seeded, n_rows - n_seeded)
    step = F.log(F.col("near") * n_rows / (n_seeded * F.col("df"))) * F.col("near") / (F.col("near") + 2)
    visits = near.filter(apart > np.sqrt(2 * np.log(max(tested, 2)))).select(F.col("j").alias("node"), "word", step.alias("a")).filter("a > 0")
    mean = visits.agg(F.avg("a").alias("mean"))
    return visits.crossJoin(F.broadcast(mean)).select("node", "word", (F.col("a") / (F.col("a") + F.col("mean"))).alias("polarity"))


def ppmi(i: np.ndarray, j: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symmetric positive pointwise mutual information, context counts smoothed, rare pairs discounted: from, to, weight."""
    i, j, c = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([n, n]).astype(float)
    margin = np.bincount(i, c, size)
    smooth = margin**0.75
    side = lambda x, y: np.maximum(np.log(c * smooth.sum() / (margin[x] * smooth[y])), 0)
    m = (side(i, j) + side(j, i)) / 2 * c / (c + 2)
    keep = m > 0
    return i[keep], j[keep], m[keep]


def walk(edges: tuple[np.ndarray, np.ndarray, np.ndarray], seeds: np.ndarray, restart: float = RESTART, steps: int = 60) -> np.ndarray:
    """Visits of a random walk over weighted edges that restarts at the seeds."""
    i, j, m = edges
    size = len(seeds)
    out = np.bincount(i, m, size)
    p = m / np.where(out > 0, out, 1)[i]
    s = seeds / max(seeds.sum(), 1e-300)
    v = s.copy()
    for _ in range(steps):
        v = restart * s + (1 - restart) * (np.bincount(j, v[i] * p, size) + v[out == 0].sum() * s)
    return v


@dataclass
class Model:
    """Nodes of the graph with words and polarities; `wide`, the table (node, word, polarity) of words beyond it."""

    vocab: np.ndarray
    words: list[bytes]
    polarity: np.ndarray
    coefficients: np.ndarray
    wide: DataFrame | None = None

    def lexicon(self) -> list[tuple[str, float]]:
        """Words and polarities of the graph, most toxic first."""
        order = np.argsort(-self.polarity, kind="stable")
        return [(self.words[k].decode("utf-8", "replace"), float(self.polarity[k])) for k in order]

    def slices(self) -> list[DataFrame]:
        """`wide` in parts of about SLICE words."""
        n = self.wide.count() if self.wide is not None else 0
        k = -(-n // SLICE)
        return [self.wide.filter(F.pmod(F.xxhash64("node"), F.lit(k)) == x) for x in range(k)]


def _arrays(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = part.select("node", "polarity").toPandas().sort_values("node")
    return got["node"].to_numpy(np.int64), got["polarity"].to_numpy(float)


def beyond(row: np.ndarray, node: np.ndarray, n: int, wide: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(rows, 2): sum of the polarities and number of the words of the grown lexicon."""
    out = np.zeros((n, 2))
    if len(wide[0]) and len(node):
        at = np.minimum(np.searchsorted(wide[0], node), len(wide[0]) - 1)
        hit = wide[0][at] == node
        out[:, 0] = np.bincount(row[hit], wide[1][at[hit]], n)
        out[:, 1] = np.bincount(row[hit], minlength=n)
    return out


def features(raw: np.ndarray, offsets: np.ndarray, vocab: np.ndarray, polarity: np.ndarray, six: tuple, four: tuple, wide: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(rows, FEATURES): what a row's polarities amount to; 6 and 7 are those of words that are known by their stem only.

    The last two are the sums of `beyond`, without logarithm: those of slices of a lexicon add up.
    """
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    row, node, (low, starts, size) = nodes(raw, offsets)
    out[:, 8:] = beyond(row, node, n, wide)
    if not len(vocab) or not len(row):
        return out
    at = np.minimum(np.searchsorted(vocab, node), len(vocab) - 1)
    known = vocab[at] == node
    value, row_k = polarity[at[known]], row[known]
    total = np.bincount(row, minlength=n)
    high = np.bincount(row_k, value > 0.5, n)
    out[:, 0] = np.log1p(high)
    np.maximum.at(out[:, 1], row_k, np.maximum(value, 0))
    out[:, 2] = np.log1p(np.bincount(row_k, np.maximum(value, 0), n))
    out[:, 3] = 10 * np.sqrt(high / np.maximum(total, 1))
    out[:, 4] = np.bincount(row_k, value, n) / np.maximum(np.bincount(row_k, minlength=n), 1)
    out[:, 5] = high > 0
    row, starts, size = row[~known], starts[~known], size[~known]
    value = np.zeros(len(row))
    for width, (head, mean) in ((4, four), (6, six)):
        if len(head):
            own = heads(low, starts, size, width)
            at = np.minimum(np.searchsorted(head, own), len(head) - 1)
            value = np.where(head[at] == own, mean[at], value)
    out[:, 6] = np.log1p(np.bincount(row, np.maximum(value, 0), n))
    out[:, 7] = np.log1p(np.bincount(row, np.maximum(-value, 0), n))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _design(f: np.ndarray) -> np.ndarray:
    """Features as the regression takes them."""
    return np.hstack([f[:, :8], np.log1p(f[:, 8:])])


def _probability(f: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(f) @ w[:-1] + w[-1], -30, 30)))


def _featured(src: DataFrame, model: Model, wide: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(r, id, f) of (r, t, id)."""
    vocab, polarity = model.vocab, model.polarity
    six, four = stems(model.words, polarity, 6), stems(model.words, polarity, 4)

    def run(batches):
        for batch in batches:
            raw, ends = utf8(batch.column(1))
            for i, j in groups(ends, GROUP):
                f = features(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i], vocab, polarity, six, four, wide)
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["r", "id", "f"])

    return src.select("r", "t", "id").mapInArrow(run, "r long, id long, f array<double>")


def _more(src: DataFrame, wide: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(r, p, q): the sums of `beyond` of the rows that hold words of a slice."""

    def run(batches):
        for batch in batches:
            raw, ends = utf8(batch.column(1))
            for i, j in groups(ends, GROUP):
                row, node, _ = nodes(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                f = beyond(row, node, j - i, wide)
                some = np.flatnonzero(f[:, 1])
                yield pa.record_batch([batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array(f[some, 0]), pa.array(f[some, 1])], ["r", "p", "q"])

    return src.select("r", "t").mapInArrow(run, "r long, p double, q double")


def _all_features(src: DataFrame, model: Model) -> DataFrame:
    """(r, id, f) with the sums over all slices of the lexicon."""
    parts = model.slices()
    none = (np.zeros(0, np.int64), np.zeros(0))
    rows = _featured(src, model, _arrays(parts[0]) if parts else none)
    if len(parts) < 2:
        return rows
    more = _more(src, _arrays(parts[1]))
    for part in parts[2:]:
        more = more.unionByName(_more(src, _arrays(part)))
    sums = more.groupBy("r").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    added = F.concat(F.slice("f", 1, 8), F.array(F.get("f", F.lit(8)) + F.coalesce("p", F.lit(0.0)), F.get("f", F.lit(9)) + F.coalesce("q", F.lit(0.0))))
    return rows.join(sums, "r", "left").select("r", "id", added.alias("f"))


def _fitted(src: DataFrame, labels: DataFrame, label_col: str, label_id: str) -> tuple[DataFrame, Model]:
    """(r, id, f) of every row of (r, t, id), and the model."""
    ids, y = sample(labels, label_id, label_col)
    n_toxic, n_clean = int((y == 1).sum()), int((y == 0).sum())
    model = Model(np.zeros(0, np.int64), [], np.zeros(0), np.zeros(FEATURES + 1))
    if n_toxic and n_clean:
        texts = src.select("id", "t")
        freq = cut(frequencies(texts, ids, y))
        vocab, text, z, share, tested = vocabulary(freq, n_toxic, n_clean)
        if len(vocab):
            order = np.argsort(-z, kind="stable")
            sure = np.sqrt(2 * np.log(max(tested, 2)))
            toxic, clean = np.zeros(len(vocab)), np.zeros(len(vocab))
            first = np.zeros(len(vocab), bool)
            first[order[:LEAST_SEEDS]] = True
            is_toxic = (z > 0) & (first | ((z > sure) & (share >= MOST)))
            toxic[is_toxic], clean[z < 0] = z[is_toxic] ** 2, 1
            counts = cut(cooccurrences(texts, vocab, np.flatnonzero(toxic)))
            got = counts.filter(F.col("kind") == PAIRS).select("i", F.col("j").cast("int").alias("j"), "n").toArrow()  # pairs of nodes at most
            edges = ppmi(*(got.column(c).to_numpy() for c in "ijn"), len(vocab))
            a, b = walk(edges, toxic), walk(edges, clean)
            wide = cut(grown(counts, freq, tested))
            model = Model(vocab, text, (a - b) / (a + b + 1 / len(vocab)), model.coefficients, wide)
            drop(counts)
        drop(freq)
    w = model.coefficients
    w[-1] = np.log(max(n_toxic, 1e-9) / max(n_clean, 1e-9)) if len(ids) else -30
    rows = cut(_all_features(src, model))
    if len(model.vocab):
        known = rows.filter(F.col("id").isNotNull() & ~held_out("id"))
        fit = known.join(labels.select(F.col(label_id).cast("long").alias("id")).distinct(), "id", "left_semi")
        got = fit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()  # bounded like the labels
        x = np.array(got.column("f").to_pylist(), float).reshape(-1, FEATURES)
        label = _labels_of(got.column("id").combine_chunks(), ids, y)
        model.coefficients = logistic(_design(x[label >= 0]), label[label >= 0])
    return rows, model


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    w = model.coefficients
    z = F.lit(float(w[-1]))
    for k in range(FEATURES):
        z = z + (F.col("f")[k] if k < 8 else F.log1p(F.col("f")[k])) * float(w[k])
    return rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id") -> tuple[DataFrame, Model]:
    """(id, held_out, score, predicted) of every row, and the model fitted on the way."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    src = keyed(src, "id").withColumnRenamed(ROW, "r")
    rows, model = _fitted(src, labels, label_col, label_id)
    out = _scored(rows, model).select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), model


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `threshold` or more; all columns stay.

    No text is shuffled unless the lexicon has more than one slice.
    """
    name = free_name(docs, ROW)
    base = keyed(docs, id_col, name)
    src = base.select(F.col(name).alias("r"), F.col(text_col).cast("string").alias("t"), F.col(id_col).cast("long").alias("id"))
    rows, model = _fitted(src, labels, label_col, "doc_id")
    parts = model.slices()
    if len(parts) > 1:
        good = _scored(rows, model).filter(F.col("score") < threshold).select(F.col("r").alias(name))
        return base.join(good, name, "left_semi").select(docs.columns)
    drop(rows)
    at = docs.columns.index(text_col)
    vocab, polarity, w = model.vocab, model.polarity, model.coefficients
    six, four = stems(model.words, polarity, 6), stems(model.words, polarity, 4)
    wide = _arrays(parts[0]) if parts else (np.zeros(0, np.int64), np.zeros(0))

    def run(batches):
        for batch in batches:
            raw, ends = utf8(batch.column(at))
            for i, j in groups(ends, GROUP):
                p = _probability(features(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i], vocab, polarity, six, four, wide), w)
                yield batch.slice(i, j - i).filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
