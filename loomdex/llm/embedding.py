"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Equal vectors collapse first and keep their number.  A cover of a bounded sample,
at the deepest of its halving radii that has at most `CELLS` nodes, splits the
vectors into cells whose covering radii are measured on all of them; two cells
further apart than both radii and the threshold need no comparison.  Large cells
are salted into chunks, which are written once, a folder each, to the shared folder;
tasks read the chunks of their pairs from there, so no vector is copied per pair.

A pair of chunks with many links (measured on some rows against all) takes two cover
trees (nested levels, radius halved from level to level, each node with its measured
covering radius), walked down at once: node pairs out of reach are pruned, node pairs
wholly within the threshold count as a block, and only the rest is compared point by
point.  Any other pair of chunks is filtered first by a bound of the cosine: with p the
coordinates in a few leading directions of the sample and q the length of the rest,
x.y <= px.py + qx.qy, one small product in single precision with slack for its
rounding.  What passes is compared in double precision.  A task returns each vector's
number of links and a spanning forest of its links, never all pairs.

Vectors of different lengths never meet.  Lengths of at most a chunk of vectors each
are one task each, all in one plan, however many lengths there are; only those of more
have cells, and there is less than one of these per chunk of vectors.

Bounds are exact, so no pair is lost; how much they prune depends on the data.  For
vectors without any cluster structure in many dimensions the number of chunk pairs
is quadratic, as it is for every exact method that works by distance bounds; the
filter makes a pair cheap, and the disk taken grows with the vectors only.

Defined results: null vectors, zero ones and those with null or non-finite
components link with nothing; vectors of different lengths don't link; repeated
ids stay rows of their own; null ids take part and are never smallest; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import ROW, cut, drop, keyed, shared_dir

SAMPLE = 2048
CELLS = 64
CHUNK = 4096
RADII = (1.0, 0.5, 0.25, 0.125)
#: Slack of the bounds against rounding; comparisons of points have none.
EPS = 1e-7
_SLAB = 1 << 16
#: Rows of a chunk that are filtered at once; chunks of a task's two sides.
ROWS = 128
STRIP, SEGMENT = 2, 4
#: Share of linked pairs from which a pair of chunks takes the trees.
DENSE = 1 / 64
#: Directions that the filter may use; vectors up to which it uses all coordinates.
DIRECTIONS, FEW = (8, 12, 16, 24, 32, 48, 64), 256


def _unit(cells: pa.Array, kind: str) -> list[tuple[bytes, np.ndarray] | None]:
    """Each row's values as they are, and its unit vector in double precision; None where it links with nothing."""
    out = []
    for row in cells:
        v = None
        if row.is_valid and row.values.null_count == 0 and len(row.values):
            x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            if np.isfinite(x).all() and top > 0:
                body = x.astype(kind).tobytes()
                x = x / top
                v = body, x / math.sqrt(float(x @ x))
        out.append(v)
    return out


def _units(bodies: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision of rows that have one."""
    x = np.frombuffer(b"".join(bodies.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, initial=0)[:, None]
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors, all of x to all of y."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _net(u: np.ndarray, members: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net of some points: centres, and each member's position among them."""
    owner = np.full(len(members), -1)
    centres: list[int] = []
    for lo in range(0, len(members), 512):
        block = np.arange(lo, min(lo + 512, len(members)))
        block = block[owner[block] < 0]
        if not len(block):
            continue
        near = _distance(u[members[block]], u[members[lo:]]) <= radius
        for k, b in enumerate(block):
            if owner[b] < 0:
                mine = lo + np.flatnonzero(near[k] & (owner[lo:] < 0))
                owner[mine] = len(centres)
                owner[b] = len(centres)
                centres.append(members[b])
    return np.array(centres), owner


class CoverTree:
    """levels[l]: centre, parent and covering radius of each node; `leaf` is each point's last node."""

    def __init__(self, u: np.ndarray, radii=RADII):
        self.u = u
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.starts: list[np.ndarray] = []
        node = np.zeros(len(u), np.int64)
        n_nodes = 1
        for radius in radii:
            order = np.argsort(node, kind="stable")
            cuts = np.searchsorted(node[order], np.arange(n_nodes + 1))
            centres, parents, new = [], [], np.empty(len(u), np.int64)
            for k in range(n_nodes):
                members = order[cuts[k] : cuts[k + 1]]
                if len(members) == 1:
                    new[members] = len(centres)
                    centres.append(members[0])
                    parents.append(k)
                    continue
                found, owner = _net(u, members, radius)
                new[members] = len(centres) + owner
                centres += found.tolist()
                parents += [k] * len(found)
            centre = np.array(centres, np.int64)
            away = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", u, u[centre[new]]), 0))
            cover = np.zeros(len(centre))
            np.maximum.at(cover, new, away)
            self.levels.append((centre, np.array(parents, np.int64), cover))
            self.starts.append(np.searchsorted(self.levels[-1][1], np.arange(n_nodes + 1)))
            node, n_nodes = new, len(centre)
        self.order = np.argsort(node, kind="stable")
        self.leaf_at = np.searchsorted(node[self.order], np.arange(n_nodes + 1))

    def members(self, level: int, node: np.ndarray) -> np.ndarray:
        """Points under a range of nodes of a level (nodes of a parent are consecutive)."""
        lo, hi = int(node), int(node) + 1
        for k in range(level + 1, len(self.levels)):
            lo, hi = int(self.starts[k][lo]), int(self.starts[k][hi])
        return self.order[self.leaf_at[lo] : self.leaf_at[hi]]


def _spread(a_lo, a_hi, b_lo, b_hi):
    """All pairs of two ranges, for each of many range pairs."""
    na, nb = a_hi - a_lo, b_hi - b_lo
    n = na * nb
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return a_lo[which] + k // nb[which], b_lo[which] + k % nb[which]


def dual(a: CoverTree, b: CoverTree, cosine: float):
    """Yield ("pairs", x, y) and ("block", xs, ys): which points are at `cosine` or more."""
    reach = math.sqrt(2 - 2 * cosine)
    (ca, _, ra), (cb, _, rb) = a.levels[0], b.levels[0]
    found = []
    for lo in range(0, len(ca), 512):
        d = _distance(a.u[ca[lo : lo + 512]], b.u[cb])
        i, j = np.nonzero(d <= ra[lo : lo + 512, None] + rb[None, :] + reach + EPS)
        found.append((i + lo, j, d[i, j]))
    i, j, d = (np.concatenate(c) for c in zip(*found))
    last = len(a.levels) - 1
    for level in range(last + 1):
        ra, rb = a.levels[level][2][i], b.levels[level][2][j]
        inside = d + ra + rb <= reach - EPS
        for p, q in zip(i[inside], j[inside]):
            yield "block", a.members(level, p), b.members(level, q)
        i, j = i[~inside], j[~inside]
        if level == last:
            break
        sa, sb = a.starts[level + 1], b.starts[level + 1]
        near: list[list[np.ndarray]] = [[], [], []]
        for p, q in _slabs(i, j, sa, sb):
            ci, cj = _spread(sa[p], sa[p + 1], sb[q], sb[q + 1])
            x, y = a.u[a.levels[level + 1][0][ci]], b.u[b.levels[level + 1][0][cj]]
            dd = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, y), 0))
            ok = dd <= a.levels[level + 1][2][ci] + b.levels[level + 1][2][cj] + reach + EPS
            for out, c in zip(near, (ci[ok], cj[ok], dd[ok])):
                out.append(c)
        i, j, d = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in near)
    for p, q in _slabs(i, j, a.leaf_at, b.leaf_at):
        x, y = _spread(a.leaf_at[p], a.leaf_at[p + 1], b.leaf_at[q], b.leaf_at[q + 1])
        x, y = a.order[x], b.order[y]
        for lo in range(0, len(x), _SLAB):
            s, t = x[lo : lo + _SLAB], y[lo : lo + _SLAB]
            ok = np.einsum("ij,ij->i", a.u[s], b.u[t]) >= cosine
            yield "pairs", s[ok], t[ok]


def _slabs(i: np.ndarray, j: np.ndarray, sa: np.ndarray, sb: np.ndarray):
    """Node pairs in runs whose child pairs fit a bounded slab."""
    n = np.cumsum((sa[i + 1] - sa[i]) * (sb[j + 1] - sb[j])) if len(i) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(i):
        hi = max(int(np.searchsorted(n, (n[lo - 1] if lo else 0) + _SLAB, side="right")), lo + 1)
        yield i[lo:hi], j[lo:hi]
        lo = hi


def _forest(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Points, and for each the least point of its component, where they differ."""
    label = np.arange(n)
    x = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, np.int64)
    y = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.int64)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def compare(r: np.ndarray, m: np.ndarray, u: np.ndarray, side: np.ndarray, same: bool, cosine: float):
    """Links of one chunk pair: (r, links, root) rows.

    `links` counts linked vectors with their multiplicity; `root` is a vector of the
    same component, or the vector itself.
    """
    first = np.flatnonzero(side == 0)
    second = first if same else np.flatnonzero(side == 1)
    links = np.zeros(len(r), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    if len(first) and len(second):
        a = CoverTree(u[first])
        b = a if same else CoverTree(u[second])
        for kind, x, y in dual(a, b, cosine):
            x, y = first[x], second[y]
            if kind == "block":
                links[x] += m[y].sum()
                if same:
                    links[np.intersect1d(x, y)] -= m[np.intersect1d(x, y)]
                else:
                    links[y] += m[x].sum()
                edges.append((x, np.full(len(x), y[0])))
                edges.append((y, np.full(len(y), x[0])))
            else:
                x, y = x[x != y], y[x != y]
                np.add.at(links, x, m[y])
                if not same:
                    np.add.at(links, y, m[x])
                edges.append((x, y))
            if sum(len(e[0]) for e in edges) > 1 << 20:
                edges = [_forest(len(r), edges)]
    at, to = _forest(len(r), edges)
    root = np.arange(len(r))
    root[at] = to
    some = np.flatnonzero((links > 0) | (root != np.arange(len(r))))
    return r[some], links[some], r[root[some]]


def _frame(sample: np.ndarray, cosine: float) -> np.ndarray | None:
    """Orthonormal directions for the filter, as many as make it cheapest on the sample; None: all coordinates."""
    dim = sample.shape[1]
    if len(sample) <= FEW or dim <= DIRECTIONS[0]:
        return None
    wide = min(dim, DIRECTIONS[-1])
    q = np.linalg.qr(sample.T @ (sample @ np.random.default_rng(7).normal(size=(dim, wide))))[0]
    q = q @ np.linalg.eigh((sample @ q).T @ (sample @ q))[1][:, ::-1]
    some = sample[:1024]
    far = some @ some.T < cosine
    # A pair costs about 2.5 ns and 0.03 for each direction; a pair that passes about 250.
    cost = {}
    for k in (k for k in DIRECTIONS if k <= wide):
        f = _filtered(some, q[:, :k])
        cost[k] = 0.03 * k + 250 * ((f @ f.T >= cosine) & far).mean()
    return q[:, : min(cost, key=cost.get)]


def _filtered(u: np.ndarray, frame: np.ndarray | None) -> np.ndarray:
    """Rows whose products bound the cosine from above, but for rounding."""
    if frame is None:
        return u.astype(np.float32)
    p = u @ frame
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", p, p), 0))
    return np.column_stack([p, rest]).astype(np.float32)


def _close(x: np.ndarray, y: np.ndarray, fx: np.ndarray, fy: np.ndarray, same: bool, cosine: float):
    """Yield (i, j): which rows of x and y are at `cosine` or more; i < j if they are the same rows."""
    least = np.float32(cosine - 1e-5 - 2e-7 * x.shape[1])
    whole = None
    for lo in range(0, len(x), ROWS):
        at = np.flatnonzero(fx[lo : lo + ROWS] @ fy.T >= least)
        if len(at) > ROWS * len(y) >> 4:
            whole = y.astype(np.float32).T if whole is None else whole
            at = np.flatnonzero(x[lo : lo + ROWS].astype(np.float32) @ whole >= least)
        i, j = np.divmod(at, len(y))
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), _SLAB):
            s, t = i[k : k + _SLAB], j[k : k + _SLAB]
            ok = np.einsum("ij,ij->i", x[s], y[t]) >= cosine
            yield s[ok], t[ok]


def meet(a: tuple, b: tuple, same: bool, cosine: float):
    """Links of two chunks (r, m, u, filter rows): (r, links, root) rows as of `compare`."""
    (ra, ma, ua, fa), (rb, mb, ub, fb) = a, b
    some = ua[:: max(len(ua) // 64, 1)]
    if (some @ ub.T >= cosine).mean() > DENSE and len(ua) > FEW:
        if same:
            return compare(ra, ma, ua, np.zeros(len(ra), np.int8), True, cosine)
        side = np.repeat(np.array([0, 1], np.int8), [len(ra), len(rb)])
        return compare(np.concatenate([ra, rb]), np.concatenate([ma, mb]), np.concatenate([ua, ub]), side, False, cosine)
    r, m, shift = (ra, ma, 0) if same else (np.concatenate([ra, rb]), np.concatenate([ma, mb]), len(ra))
    links = np.zeros(len(r), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    for x, y in _close(ua, ub, fa, fb, same, cosine):
        y = y + shift
        np.add.at(links, x, m[y])
        np.add.at(links, y, m[x])
        edges.append((x, y))
        if sum(len(e[0]) for e in edges) > 1 << 20:
            edges = [_forest(len(r), edges)]
    at, to = _forest(len(r), edges)
    root = np.arange(len(r))
    root[at] = to
    some = np.flatnonzero(links > 0)
    return r[some], links[some], r[root[some]]


def _cells(sample: np.ndarray, most: int) -> np.ndarray:
    """Centres of the deepest level of a cover of the sample that has at most `most` nodes."""
    centres = sample[:1]
    for radius in (1.0, 0.5, 0.25):
        at = _net(sample, np.arange(len(sample)), radius)[0]
        if len(at) > most:
            break
        centres = sample[at]
    return centres


def link(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, chunk: int = CHUNK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    src = keyed(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")), "id")
    kind = "f4" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "f8"

    def unit_rows(batches):
        for b in batches:
            units = _unit(b.column(2), kind)
            size = [None if x is None else len(x[1]) for x in units]
            body = [None if x is None else x[0] for x in units]
            prints = [None if x is None else hashlib.blake2b(x[1].tobytes(), digest_size=16).digest() for x in units]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(prints, pa.binary()), pa.array(size, pa.int32()), pa.array(body, pa.binary())], ["r", "id", "print", "dim", "u"])

    rows = cut(src.select(F.col(ROW).alias("r"), "id", "v").mapInArrow(unit_rows, "r long, id long, print binary, dim int, u binary"))
    good = rows.filter("u is not null")
    distinct = cut(good.groupBy("print").agg(F.min("r").alias("r"), F.count("*").alias("m"), F.first("dim").alias("dim")))

    sizes = distinct.groupBy("dim").agg(F.count("*").alias("n"))
    large = [x.dim for x in sizes.filter(F.col("n") > chunk).orderBy("dim").collect()]
    short = distinct.join(sizes.filter(F.col("n") <= chunk).select("dim"), "dim", "left_semi")
    found = _links_of_short(good.select("r", "u").join(short.select("r", "m", "dim"), "r"), cosine, kind)
    used = []
    for dim in large:
        part = distinct.filter(F.col("dim") == dim)
        picked = good.join(part.orderBy(F.xxhash64("r"), "r").limit(SAMPLE).select("r"), "r").select("u").toArrow().column("u")
        sample = _units(picked, dim, kind)
        centres = _cells(sample, CELLS)
        placed = _placed(good.select("r", "u").join(part.select("r", "m"), "r"), dim, centres, kind)
        linked, chunks = _links_of(placed, dim, centres, _frame(sample, cosine), cosine, chunk, kind)
        drop(placed)
        used.append(chunks)
        found = found.unionByName(linked)
    found = cut(found)
    for chunks in used:
        drop(chunks)
    comp = components(found.filter("r <> root").select(F.col("r").alias("u"), F.col("root").alias("v")))
    degree = found.groupBy("r").agg(F.sum("links").alias("links"))
    state = (
        distinct.select("r", "m", "print")
        .join(degree, "r", "left")
        .join(comp.withColumnRenamed("node", "r"), "r", "left")
        .select("print", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "r").alias("c"))
    )
    # Rows without a vector to compare stand alone and take no part in the joins: no key holds them all.
    linked = good.select("r", "id", "print").join(state, "print").select("r", "id", F.col("n_links").cast("long").alias("n_links"), "c")
    alone = rows.filter("u is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    all_rows = linked
    least = all_rows.groupBy("c").agg(F.min("id").alias("component_id"))
    out = all_rows.join(least, "c").select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links_of_short(part: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(r, links, root) of distinct vectors of any lengths, each length of a chunk of vectors at most."""

    def work(key, t):
        u = _units(t.column("u"), key[0].as_py(), kind)
        one = t.column("r").to_numpy(), t.column("m").to_numpy(), u, _filtered(u, _frame(u[:SAMPLE], cosine))
        r, links, root = meet(one, one, True, cosine)
        return pa.table({"r": r, "links": links, "root": root})

    return part.select("dim", "r", "m", "u").groupBy("dim").applyInArrow(work, "r long, links long, root long")


def _placed(part: DataFrame, dim: int, centres: np.ndarray, kind: str) -> DataFrame:
    """(r, m, u, cell, d): each vector's cell, and how far its centre is."""

    def place(batches):
        for b in batches:
            if b.num_rows:
                d = _distance(_units(b.column(2), dim, kind), centres)
                cell = d.argmin(axis=1)
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["r", "m", "u", "cell", "d"])

    return cut(part.select("r", "m", "u").mapInArrow(place, "r long, m long, u binary, cell int, d double"))


def _links_of(placed: DataFrame, dim: int, centres: np.ndarray, frame: np.ndarray | None, cosine: float, chunk: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """(r, links, root) of the distinct vectors of one length, and the table of chunks that it reads."""
    spark = placed.sparkSession
    stats = {x.cell: (x.n, x.d) for x in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("d")).collect()}  # CELLS rows at most
    reach = math.sqrt(2 - 2 * cosine)
    away = _distance(centres, centres)
    salts, base, cell_of = [1] * len(centres), [0] * len(centres), []
    for c, (n, _) in sorted(stats.items()):
        salts[c], base[c] = -(-n // chunk), len(cell_of)
        cell_of += [c] * salts[c]
    near = np.array([[away[a, b] <= stats[a][1] + stats[b][1] + reach + EPS if a in stats and b in stats else False for b in range(len(centres))] for a in range(len(centres))])
    number = lambda values: F.array(*(F.lit(x) for x in values))[F.col("cell")]
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    numbered = placed.select((number(base) + F.pmod(F.xxhash64("r"), number(salts))).cast("int").alias("chunk"), "r", "m", "u")
    numbered.repartition("chunk").write.option("compression", "zstd").partitionBy("chunk").parquet(path)
    chunks = spark.read.parquet(path)
    chunks._cut_path = path
    held = {x.chunk for x in chunks.select("chunk").distinct().collect()}  # a salt of a small cell may stay empty

    def read(c):
        files, at = FileSystem.from_uri(f"{path}/chunk={c}")
        t = pq.read_table(at, filesystem=files, columns=["r", "m", "u"], partitioning=None)
        u = _units(t.column("u"), dim, kind)
        return t.column("r").to_numpy(), t.column("m").to_numpy(), u, _filtered(u, frame)

    def meets(a, b):
        return a <= b and a in held and b in held and near[cell_of[a], cell_of[b]]

    n = len(cell_of)
    tasks = [(a, b) for a in range(0, n, STRIP) for b in range(a // SEGMENT * SEGMENT, n, SEGMENT)]

    def work(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a0, b0 = tasks[k]
                strip = {}
                for b in range(b0, min(b0 + SEGMENT, n)):
                    mine = [a for a in range(a0, min(a0 + STRIP, n)) if meets(a, b)]
                    other = read(b) if mine else None
                    for a in mine:
                        if a not in strip:
                            strip[a] = other if a == b else read(a)
                        r, links, root = meet(strip[a], strip[a] if a == b else other, a == b, cosine)
                        yield pa.record_batch([pa.array(r), pa.array(links), pa.array(root)], ["r", "links", "root"])

    return spark.range(0, len(tasks), 1, min(len(tasks), 4096)).mapInArrow(work, "r long, links long, root long"), chunks
