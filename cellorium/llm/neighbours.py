"""The most similar vectors of every vector by collision-counting hashing.

Every vector has one value per random projection, and every projection one sorted
array.  The window centred on a query is the run of a sorted array that binary
search finds around the query's value; two vectors collide in a projection if one
lies in the other's window.  Windows start narrow and are widened (virtual
rehashing: nothing is hashed anew), and only the ranks a widening adds are counted.
A pair that collides in enough projections is verified by its exact similarity;
how many follows from the share of pairs at the window's radius that must be found.  Empty positions move a vector by more than its similarity tells, and no
window bounds by how much, so pairs with an empty position in either vector are
verified without a window.

Windows of single projections hold a fixed share of the collection (a tenth for
the radius of interest), so over n vectors they alone would count n^2 pairs.
The sorted arrays are therefore cut into blocks first: a tree halves the
collection again and again at the median of one sorted projection.  A vector
whose window reaches over a cut goes to both sides, and several trees with other
projections are used, so that a close pair lies in a common block with high
probability.  Collisions are counted and verified inside blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellorium.llm.vectors import cross_pearson, pair_pearson, to_matrix, unit_rows
from cellorium.session import cut_lineage

#: Projections per block, half width of a window in standard deviations of a pair's projected distance, rows per block the trees aim at.
PROJECTIONS, HALF_WIDTH, BLOCK = 16, 1.5, 512
#: Share of the pairs at a window's radius that one block must find; windows of a search as parts of the radius of the least similarity.
BLOCK_RECALL, WIDENINGS = 0.97, (0.6, 1.0)
TREES = 8
#: Share of a tile's pairs from which candidates are verified by a matrix product.
DENSE = 0.02
#: Vectors from which the cuts of the trees are fitted; every vector is indexed.
SAMPLE = 32_768
#: Half width of the zone around a cut that goes to both sides: times the radius to the power 1.4, and per root of the share of empty positions.
MARGIN, MARGIN_EMPTY = 0.117, 0.7


def _radius(min_sim: float) -> float:
    """Distance of unit vectors of that correlation."""
    return float(np.sqrt(2 * max(1 - min_sim, 1e-4)))


def collisions_needed(projections: int = PROJECTIONS, recall: float = BLOCK_RECALL, half_width: float = HALF_WIDTH) -> int:
    """The most collisions that a pair at the window's radius still reaches with probability ``recall``."""
    p = math.erf(half_width / math.sqrt(2))
    tail = 0.0
    for k in range(projections, 0, -1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail >= recall:
            return k
    return 1


def _fit_tree(u: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (one per level and tree) and cuts of a median tree; node i has children 2i+1 and 2i+2."""
    rs = np.random.RandomState(seed)
    dirs = rs.standard_normal((depth, u.shape[1]))
    dirs /= np.linalg.norm(dirs, axis=1, keepdims=True)
    dirs *= np.sqrt(u.shape[1])
    cuts = np.zeros((1 << depth) - 1)
    node = np.zeros(len(u), np.int64)
    p = u @ dirs.T
    for lv in range(depth):
        first = (1 << lv) - 1
        order = np.lexsort((p[:, lv], node))
        n_sorted = node[order]
        lo = np.searchsorted(n_sorted, np.arange(first, 2 * first + 1), "left")
        hi = np.searchsorted(n_sorted, np.arange(first, 2 * first + 1), "right")
        v = p[order, lv]
        mid = (lo + hi) // 2
        has = hi > lo
        cuts[first : 2 * first + 1] = np.where(has, v[np.minimum(mid, len(v) - 1)], 0.0)
        node = 2 * node + 1 + (p[:, lv] >= cuts[node])
    return dirs, cuts


def _route(u: np.ndarray, margin: np.ndarray, dirs: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs; a row within its margin of a cut goes to both sides."""
    depth = len(dirs)
    p = u @ dirs.T
    row, node = np.arange(len(u)), np.zeros(len(u), np.int64)
    for lv in range(depth):
        d = p[row, lv] - cuts[node]
        near = np.abs(d) < margin[row]
        right = d >= 0
        child = 2 * node + 1 + right
        other = 2 * node[near] + 1 + ~right[near]
        row, node = np.r_[row, row[near]], np.r_[child, other]
    return row, node - ((1 << depth) - 1)


class _Windows:
    """Sorted arrays of a block's projections, and the query-centred windows in them."""

    def __init__(self, p: np.ndarray):
        self.p, self.order = p, np.argsort(p, axis=0, kind="stable")
        self.sorted = np.take_along_axis(p, self.order, axis=0)
        kind = np.uint16 if len(p) < 1 << 16 else np.uint32
        self.rank = np.empty(p.shape[::-1], kind)
        for i in range(p.shape[1]):
            self.rank[i, self.order[:, i]] = np.arange(len(p), dtype=kind)

    def around(self, rows: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First rank and number of ranks of each row's window in every projection."""
        at = range(self.p.shape[1])
        lo = np.stack([np.searchsorted(self.sorted[:, i], self.p[rows, i] - width, "left") for i in at])
        hi = np.stack([np.searchsorted(self.sorted[:, i], self.p[rows, i] + width, "right") for i in at])
        return lo.astype(self.rank.dtype), (hi - lo).astype(self.rank.dtype)

    def count(self, n: np.ndarray, new: tuple, old: tuple | None) -> None:
        """Add to ``n`` (rows, vectors) the collisions in the windows ``new`` that ``old`` did not hold."""
        for i, rank in enumerate(self.rank):
            inside = (rank - new[0][i][:, None]) < new[1][i][:, None]  # unsigned: below the window wraps round
            if old is not None:
                inside ^= (rank - old[0][i][:, None]) < old[1][i][:, None]
            n += inside


def _margins(x: np.ndarray, zone: float) -> np.ndarray:
    """Half width of the shared zone for each row: wider the more of its positions are empty."""
    return zone + MARGIN_EMPTY * np.sqrt((~np.isfinite(x)).mean(1))


def _verify(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray | None, min_sim: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the pairs of ``rows`` and ``cols`` at or over ``min_sim`` among those hit (None: all).

    Where many pairs are candidates one product of short floats screens them; what
    comes near ``min_sim`` is computed exactly, pair by pair.
    """
    if not len(rows) or not len(cols):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if hit is None or hit.mean() > DENSE:
        u = np.where(np.isfinite(x), unit_rows(x), np.nan).astype(np.float32)
        near = cross_pearson(u[rows], u[cols]) >= min_sim - 1e-3
        hit = near if hit is None else hit & near
    qi, cj = np.nonzero(hit)
    qi, cj = rows[qi], cols[cj]
    at = range(0, len(qi), 50_000)
    sim = np.concatenate([pair_pearson(x[qi[a : a + 50_000]], x[cj[a : a + 50_000]]) for a in at]) if len(qi) else np.zeros(0)
    ok = sim >= min_sim
    return qi[ok], cj[ok], sim[ok]


def _search_block(x: np.ndarray, k: int, min_sim: float, seed: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of verified pairs: for each i its k best at or over ``min_sim`` in the block.

    A query whose k best so far lie within the radius of its windows is done; the
    others get wider windows.
    """
    rs = np.random.RandomState(seed)
    gappy = ~np.isfinite(x).all(1)
    gaps, full = np.flatnonzero(gappy), np.flatnonzero(~gappy)
    win = _Windows(unit_rows(x[full]).astype(np.float32) @ rs.standard_normal((x.shape[1], PROJECTIONS)).astype(np.float32))
    need, far = collisions_needed(), _radius(min_sim)
    tile = max(32, min(tile, (1 << 20) // max(len(x), 1)))
    found = [_verify(x, gaps, np.arange(len(x)), None, min_sim), _verify(x, full, gaps, None, min_sim)]
    sure = np.zeros(len(x), np.int64)  # pairs found so far within a radius, for queries without gaps
    for s in range(0, len(full), tile):
        own = np.arange(s, min(s + tile, len(full)))  # positions in ``full``
        n, hit, old = np.zeros((len(own), len(full)), np.uint8), None, None
        for part in WIDENINGS:
            r = far * part
            new = win.around(own, np.float32(HALF_WIDTH * r))
            win.count(n, new, old)
            now = n >= need
            fresh = _verify(x, full[own], full, now if hit is None else now & ~hit, min_sim)
            found.append(fresh)
            if part == WIDENINGS[-1]:
                break
            near = fresh[2] >= 1 - r * r / 2
            np.add.at(sure, fresh[0][near & (fresh[0] != fresh[1])], 1)
            stay = sure[full[own]] < k
            own, n, hit, old = own[stay], n[stay], now[stay], tuple(w[:, stay] for w in new)
            if not len(own):
                break
    qi, cj, sim = (np.concatenate(v) for v in zip(*found))
    ok = qi != cj
    qi, cj, sim = qi[ok], cj[ok], sim[ok]
    order = np.lexsort((cj, -sim, qi))
    qi, cj, sim = qi[order], cj[order], sim[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi, "left") < k
    return qi[best], cj[best], sim[best]


def _sub_blocks(x: np.ndarray, limit: int, seed: int, margin: float = MARGIN * _radius(0.96) ** 1.4) -> list[np.ndarray]:
    """Cut a block that came out larger than planned further, with shared margins."""
    if len(x) <= limit:
        return [np.arange(len(x))]
    depth = int(np.ceil(np.log2(len(x) / (limit / 2))))
    u = unit_rows(x)
    dirs, cuts = _fit_tree(u, depth, seed)
    row, leaf = _route(u, _margins(x, margin), dirs, cuts)
    order = np.argsort(leaf, kind="stable")
    return np.split(row[order], np.flatnonzero(np.diff(leaf[order])) + 1)


def k_nearest(vectors: DataFrame, key: str, vec: str, k: int = 10, min_sim: float = 0.5, trees: int = TREES, block: int | None = None, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(query, neighbour, similarity): up to k most similar other vectors with similarity >= ``min_sim``.

    ``vectors`` has one row per key, all vectors of one length and different from
    each other (see :func:`mutual_neighbours` for exact copies).  Similarity is
    the Pearson correlation over the positions filled in both.  The result is
    approximate; the tests hold its recall at 0.9 or more against brute force.
    Equal similarities are ordered by key.  An empty table gives no row.

    The trees are fitted on a bounded sample (``sample``), their depth follows
    from the count of all vectors; every vector is indexed and is a query.  A
    block larger than planned is cut again inside its task, so the work grows
    with the number of vectors times the block size.
    """
    n = vectors.count()
    block, zone = block or BLOCK, MARGIN * _radius(min_sim) ** 1.4
    ddl = "tree int, leaf int, id string, x array<float>"
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / block))))
    depth = min(depth, int(np.log2(max(sample // 8, 1))))
    frac = min(1.0, 1.2 * sample / max(n, 1))
    probe = vectors.select(vec) if frac >= 1 else vectors.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(frac * (1 << 20))).select(vec)
    fitted = []
    if depth:
        u = unit_rows(to_matrix(probe.limit(sample).select(F.col(vec).cast("array<float>").alias("v")).toArrow().column("v"))).astype(np.float32)
        fitted = [_fit_tree(u, depth, seed + t) for t in range(trees)]
    else:
        trees = 1  # one block is searched once

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = to_matrix(b.column(1))
            if not len(x):
                continue
            u = unit_rows(x)
            margin = _margins(x, zone)
            rows, leaves, tree = [], [], []
            for t in range(trees):
                r, lf = _route(u, margin, *fitted[t]) if fitted else (np.arange(len(x)), np.zeros(len(x), np.int64))
                rows.append(r)
                leaves.append(lf)
                tree.append(np.full(len(r), t))
            r = np.concatenate(rows)
            vals = x[r].astype(np.float32)
            arr = pa.ListArray.from_arrays(pa.array(np.arange(0, vals.size + 1, vals.shape[1]), pa.int32()), pa.array(vals.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tree), pa.int32()), pa.array(np.concatenate(leaves), pa.int32()), b.column(0).take(pa.array(r)), arr], names=["tree", "leaf", "id", "x"])

    def search(key_, t):
        ids = np.array(t.column("id").to_pylist(), dtype=object)
        order = np.argsort(ids)
        ids, x = ids[order], to_matrix(t.column("x"))[order]
        s = seed * 1000 + key_[0].as_py()
        qs, ns, sims = [], [], []
        for part in _sub_blocks(x, 2 * block, s, zone):
            part = np.sort(part)
            i, j, sim = _search_block(x[part], k, min_sim, s)
            qs.append(ids[part[i]])
            ns.append(ids[part[j]])
            sims.append(sim)
        return pa.table({"query": pa.array(np.concatenate(qs), pa.string()), "neighbour": pa.array(np.concatenate(ns), pa.string()), "similarity": pa.array(np.concatenate(sims), pa.float64())})

    placed = vectors.select(F.col(key).cast("string").alias("id"), vec).mapInArrow(assign, ddl)
    pairs = placed.groupBy("tree", "leaf").applyInArrow(search, "query string, neighbour string, similarity double")
    once = pairs.groupBy("query", "neighbour").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mutual_neighbours(vectors: DataFrame, key: str, vec: str, k: int = 10, min_sim: float = 0.96, **index) -> DataFrame:
    """(cell_a, cell_b, similarity), a < b: each among the other's k most similar, similarity >= ``min_sim``.

    Exact copies are one class: one representative is indexed, and of a class only
    the first k + 1 keys can be in a mutual pair (similarity ties go to the
    smaller key), so no class is expanded further, however large.
    """
    ranked = vectors.select(F.col(key).cast("string").alias("id"), F.col(vec).alias("vec"), F.transform(vec, lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"))
    w = Window.partitionBy("x").orderBy("id")
    first = ranked.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1)
    first = cut_lineage(first.withColumn("class", F.min("id").over(Window.partitionBy("x"))).select("id", "class", "rn", "vec"))
    reps = first.filter("rn = 1").select("id", "vec")
    members = first.select("class", "id")
    near = k_nearest(reps, "id", "vec", k, min_sim, **index).select("query", "neighbour", "similarity")
    both = near.unionByName(near.select(F.col("neighbour").alias("query"), F.col("query").alias("neighbour"), "similarity")).distinct()
    a = members.select(F.col("class").alias("query"), F.col("id").alias("a"))
    b = members.select(F.col("class").alias("neighbour"), F.col("id").alias("b"))
    apart = both.join(a, "query").join(b, "neighbour").select("a", "b", "similarity")
    twins = first.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class")
    t = members.join(twins, "class")
    same = t.select("class", F.col("id").alias("a")).join(t.select("class", F.col("id").alias("b")), "class").filter("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    r = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    best = apart.unionByName(same).withColumn("rn", F.row_number().over(r)).filter(F.col("rn") <= k)
    return best.withColumn("cell_a", F.least("a", "b")).withColumn("cell_b", F.greatest("a", "b")).groupBy("cell_a", "cell_b").agg(F.count(F.lit(1)).alias("sides"), F.max("similarity").alias("similarity")).filter("sides = 2").drop("sides")
