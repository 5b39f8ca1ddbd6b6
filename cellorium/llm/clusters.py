"""Similarity clusters from mergeable cluster-feature trees.

A cluster feature is (count, linear sum, squared sum) of the vectors it has
absorbed.  Each task builds a tree of features over its vectors and hands on its
leaves; leaves of several tasks are merged in rounds; the last set of leaves,
as many as the groups need, is agglomerated by Ward's criterion on the driver.  Passes over all
vectors then assign them to the nearest average and repair the groups until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellorium.llm.vectors import cross_pearson, to_matrix, unit_rows
from cellorium.session import cut_lineage

#: Squared radius a leaf may have, leaves a tree may have, leaves under one inner node; the first two to start with.
RADIUS2, MAX_LEAVES, FANOUT = 0.30, 512, 32
#: Passes after which groups are taken as they are; a pass that changes nothing comes long before.
PASSES = 30


class CFTree:
    """Two-level tree of cluster features: inner nodes route to leaves; rebuilt with a larger radius when full.

    With ``least_corr`` a leaf takes only features that correlate with its average
    by that much, and no radius passes 1 - least_corr (two groups whose averages
    correlate by less have a larger one together): a tree that is still full then
    gets twice the leaves it needs, so no group is merged away for want of leaves.
    """

    def __init__(self, dim: int, radius2: float = RADIUS2, max_leaves: int = MAX_LEAVES, fanout: int = FANOUT, least_corr: float | None = None):
        self.dim, self.radius2, self.max_leaves, self.fanout, self.least_corr = dim, radius2, max_leaves, fanout, least_corr
        self._clear()

    def _clear(self) -> None:
        self.n = np.zeros(0)
        self.ls = np.zeros((0, self.dim))
        self.ss = np.zeros(0)
        self.node = np.zeros(0, np.int64)  # inner node of each leaf

    def _centres(self) -> np.ndarray:
        return self.ls / self.n[:, None]

    def _route(self, c: np.ndarray) -> np.ndarray:
        """Nearest leaf of the nearest inner node for each centre."""
        k = self.node.max() + 1
        nn = np.bincount(self.node, weights=self.n, minlength=k)
        nc = np.zeros((k, self.dim))
        np.add.at(nc, self.node, self.ls)
        nc /= np.maximum(nn, 1)[:, None]
        at = np.argmax(c @ nc.T - 0.5 * (nc**2).sum(1), axis=1)
        cen = self._centres()
        half = 0.5 * (cen**2).sum(1)
        leaf = np.zeros(len(c), np.int64)
        for j in np.unique(at):
            mine, own = np.flatnonzero(at == j), np.flatnonzero(self.node == j)
            leaf[mine] = own[np.argmax(c[mine] @ cen[own].T - half[own], axis=1)]
        return leaf

    def _absorb(self, leaf, left, n, ls, ss) -> np.ndarray:
        """Add to each leaf as many of its features, nearest first, as keep its radius; True for those added."""
        cen = self._centres()
        own = ls[left] / n[left][:, None]
        dist = ((own - cen[leaf]) ** 2).sum(1)
        order = np.lexsort((dist, leaf))
        ok = np.zeros(len(left), bool)
        if self.least_corr is not None:
            norm = np.sqrt((own**2).sum(1) * (cen[leaf] ** 2).sum(1))
            order = order[((own * cen[leaf]).sum(1) >= self.least_corr * norm)[order]]
            if not len(order):
                return ok
        cuts = np.r_[0, np.flatnonzero(np.diff(leaf[order])) + 1, len(order)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            own, lf = order[s:e], leaf[order[s]]
            rows = left[own]
            m = self.n[lf] + np.cumsum(n[rows])
            sums = self.ls[lf] + np.cumsum(ls[rows], axis=0)
            sq = self.ss[lf] + np.cumsum(ss[rows])
            bad = np.flatnonzero(sq / m - (sums**2).sum(1) / m**2 > self.radius2)
            k = int(bad[0]) if len(bad) else len(rows)
            if k:
                self.n[lf], self.ls[lf], self.ss[lf] = m[k - 1], sums[k - 1], sq[k - 1]
                ok[own[:k]] = True
        return ok

    def insert(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        """Insert features (single vectors: n = 1, ss = squared length)."""
        left = np.arange(len(n))
        while len(left):
            if not len(self.n):
                self._add(n[left[:1]], ls[left[:1]], ss[left[:1]])
                left = left[1:]
                continue
            leaf = self._route(ls[left] / n[left][:, None])
            ok = self._absorb(leaf, left, n, ls, ss)
            left = left[~ok]
            if len(left) and self.least_corr is not None:  # the nearest leaf may lie under another inner node
                cen = self._centres()
                leaf = np.argmax((ls[left] / n[left][:, None]) @ cen.T - 0.5 * (cen**2).sum(1), axis=1)
                left = left[~self._absorb(leaf, left, n, ls, ss)]
            if len(left):  # the first that fits nowhere becomes a leaf, the others are tried again
                seeds = left[: max(1, len(left) // 64)]
                self._add(n[seeds], ls[seeds], ss[seeds])
                left = left[len(seeds) :]
            if len(self.n) > self.max_leaves:
                self._rebuild()

    def _add(self, n, ls, ss) -> None:
        node = np.full(len(n), 0) if not len(self.n) else self.node[self._route(ls / n[:, None])]
        self.n, self.ls, self.ss, self.node = np.r_[self.n, n], np.r_[self.ls, ls], np.r_[self.ss, ss], np.r_[self.node, node]
        for j, size in enumerate(np.bincount(self.node)):
            if size > self.fanout:
                self._split(j)

    def _split(self, j: int) -> None:
        own = np.flatnonzero(self.node == j)
        c = self._centres()[own]
        a = int(np.argmax(((c - c.mean(0)) ** 2).sum(1)))
        b = int(np.argmax(((c - c[a]) ** 2).sum(1)))
        far = ((c - c[a]) ** 2).sum(1) > ((c - c[b]) ** 2).sum(1)
        if far.any() and not far.all():
            self.node[own[far]] = self.node.max() + 1

    def _rebuild(self) -> None:
        n, ls, ss = self.n, self.ls, self.ss
        most = np.inf if self.least_corr is None else max(1 - self.least_corr, RADIUS2)
        full = self.radius2 >= most
        if full:
            self.max_leaves *= 2
        else:
            self.radius2 = min(1.15 * self.radius2, most)
        self._clear()
        order = np.argsort(-n, kind="stable")
        self.insert(n[order], ls[order], ss[order])
        if full:
            self.max_leaves = max(self.max_leaves // 2, 2 * len(self.n))


def _leaf_batch(tree: CFTree) -> pa.RecordBatch:
    k = len(tree.n)
    ls = pa.ListArray.from_arrays(pa.array(np.arange(0, k * tree.dim + 1, tree.dim), pa.int32()), pa.array(tree.ls.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(tree.n), ls, pa.array(tree.ss)], names=["n", "ls", "ss"])


def ward(n: np.ndarray, ls: np.ndarray, least_corr: float = 0.5) -> np.ndarray:
    """Cluster number of each leaf: Ward merges among pairs whose averages correlate by at least ``least_corr``."""
    k = len(n)
    n, ls = n.astype(float).copy(), ls.copy()
    label, alive = np.arange(k), np.ones(k, bool)

    def costs(i: int) -> np.ndarray:
        c = ls / n[:, None]
        norm = np.sqrt((c**2).sum(1))
        r = c @ c[i] / np.maximum(norm * norm[i], 1e-12)
        w = n * n[i] / (n + n[i]) * ((c - c[i]) ** 2).sum(1)
        w = np.where(alive & (r >= least_corr), w, np.inf)
        w[i] = np.inf
        return w

    cost = np.full((k, k), np.inf)
    for i in range(k):
        cost[i] = costs(i)
    near = cost.argmin(1) if k else np.zeros(0, np.int64)
    least = cost[np.arange(k), near]
    for _ in range(k - 1):
        i = int(np.argmin(least))
        j = int(near[i])
        if not np.isfinite(least[i]):
            break
        i, j = min(i, j), max(i, j)
        n[i] += n[j]
        ls[i] += ls[j]
        alive[j] = False
        label[label == j] = i
        cost[j, :] = cost[:, j] = np.inf
        cost[i, :] = cost[:, i] = costs(i)
        again = (near == i) | (near == j)
        again[[i, j]] = True
        closer = ~again & ((cost[i] < least) | ((cost[i] == least) & (i < near)))
        near[closer], least[closer] = i, cost[i, closer]
        at = np.flatnonzero(again)
        near[at] = cost[at].argmin(1)
        least[at] = cost[at, near[at]]
    return np.unique(label, return_inverse=True)[1]


def _corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.nan_to_num(cross_pearson(a, b), nan=-2.0)


class Groups:
    """The groups between two passes: members' sum, filled counts and number for both halves of every group.

    The halves of a group follow 2-means from pass to pass; they tell whether the
    group is really two.
    """

    def __init__(self, n: np.ndarray, z: np.ndarray, filled: np.ndarray):
        self.n, self.z, self.filled = n, z, filled  # (groups, 2), (groups, 2, dim), (groups, 2, dim)

    @classmethod
    def of_leaves(cls, n: np.ndarray, ls: np.ndarray, label: np.ndarray) -> Groups:
        """Halves: the leaf that correlates least with the group's average, with those nearer to it than to the average."""
        k = int(label.max()) + 1 if len(label) else 0
        out = cls(np.zeros((k, 2)), np.zeros((k, 2, ls.shape[1])), np.zeros((k, 2, ls.shape[1])))
        for g in range(k):
            own = np.flatnonzero(label == g)
            side = np.zeros(len(own), np.int64)
            if len(own) > 1:
                c = ls[own] / n[own][:, None]
                middle = ls[own].sum(0) / n[own].sum()
                far = c[np.argmin(_corr(c, middle[None])[:, 0])]
                r = _corr(c, np.stack([middle, far]))
                side = (r[:, 1] > r[:, 0]).astype(np.int64)
            for h in (0, 1):
                m = own[side == h]
                out.n[g, h], out.z[g, h], out.filled[g, h] = n[m].sum(), ls[m].sum(0), n[m].sum()
        return out

    def averages(self) -> np.ndarray:
        return self.z.sum(1) / np.maximum(self.filled.sum(1), 1)

    def halves(self) -> np.ndarray:
        """(groups, 2, dim); an empty half stands where no member goes."""
        return np.where(self.n[:, :, None] > 0, self.z / np.maximum(self.filled, 1), np.nan)

    def repaired(self, least_corr: float) -> Groups:
        """Groups whose halves correlate by less than ``least_corr`` cut in two; averages that correlate by as much put together; empty ones dropped."""
        cut = []
        h = self.halves()
        for g in np.flatnonzero(self.n.sum(1) > 0):
            pair = [(self.n[g, i], self.z[g, i], self.filled[g, i]) for i in (0, 1)]
            if (self.n[g] > 0).all() and _corr(h[g, :1], h[g, 1:])[0, 0] < least_corr:
                cut += [[p, (0.0, 0 * p[1], 0 * p[2])] for p in pair]
            else:
                cut.append(pair)
        while len(cut) > 1:
            avg = np.stack([(p[0][1] + p[1][1]) / np.maximum(p[0][2] + p[1][2], 1) for p in cut])
            r = np.triu(_corr(avg, avg), 1)
            i, j = np.unravel_index(np.argmax(r), r.shape)
            if r[i, j] < least_corr:
                break
            cut[i] = [tuple(a + b for a, b in zip(*cut[x])) for x in (i, j)]  # the two become the halves
            del cut[j]
        cut.sort(key=lambda p: (-(p[0][0] + p[1][0]), *np.round((p[0][1] + p[1][1])[:4], 6)))
        if not cut:
            return Groups(self.n[:0], self.z[:0], self.filled[:0])
        return Groups(*(np.array([[p[h][i] for h in (0, 1)] for p in cut]) for i in range(3)))


def _place(x: np.ndarray, groups: Groups, least_corr: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group or -1, half, correlation with the group's average) of every vector."""
    if not len(groups.n):
        return np.full(len(x), -1), np.zeros(len(x), np.int64), np.full(len(x), -2.0)
    r = _corr(x, groups.averages())
    best = r.argmax(1)
    sim = r[np.arange(len(x)), best]
    h = groups.halves()
    half = np.zeros(len(x), np.int64)
    for g in np.unique(best):
        own = best == g
        half[own] = _corr(x[own], h[g]).argmax(1)
    return np.where(sim >= least_corr, best, -1), half, sim


def _sums(x: np.ndarray, group: np.ndarray, half: np.ndarray, k: int) -> Groups:
    """Sums over the members of every half of standardised values and of filled positions."""
    m = np.isfinite(x)
    z = unit_rows(x) * np.sqrt(m.sum(1, keepdims=True))
    ok = group >= 0
    at = group[ok] * 2 + half[ok]
    n, zs, fs = np.bincount(at, minlength=2 * k).astype(float), np.zeros((2 * k, x.shape[1])), np.zeros((2 * k, x.shape[1]))
    np.add.at(zs, at, z[ok])
    np.add.at(fs, at, m[ok].astype(float))
    return Groups(n.reshape(k, 2), zs.reshape(k, 2, -1), fs.reshape(k, 2, -1))


def similarity_clusters(vectors: DataFrame, key: str, vec: str, least_corr: float = 0.5, max_leaves: int = MAX_LEAVES, fan_in: int = 16, typical: int = 5, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(assignment, clusters) of vectors by correlation.

    assignment: key, cluster_no, similarity (correlation with the cluster's
    average over the positions filled); cluster_no and similarity are null for a
    vector that correlates with no average by ``least_corr``.  clusters:
    cluster_no, n_members, rank, key, similarity of the ``typical`` members nearest
    the average (ties by key).  Cluster numbers follow the size.  Empty input: both are empty.

    The leaves' agglomeration only starts the groups.  Each pass then assigns all
    vectors, sums the members of both halves of every group and gathers the
    vectors that fit no average in feature trees; groups whose halves correlate
    by less than ``least_corr`` are cut, groups whose averages correlate by as much
    are joined, leaves of vectors left over become groups, until a pass changes
    nothing (or after ``passes``): averages of two clusters then correlate by less than
    ``least_corr``, whatever the order and the split of the rows.

    Trees start with ``max_leaves`` leaves and get more where the groups need more;
    trees of ``fan_in`` tasks are merged in as many rounds as the tasks need.
    The driver holds the last leaves and a matrix of their pairs, so its memory
    grows with the number of groups and of vectors like no other, squared.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            u = unit_rows(to_matrix(b.column(0)))
            if not len(u):
                continue
            tree = tree or CFTree(u.shape[1], max_leaves=max_leaves, least_corr=least_corr)
            tree.insert(np.ones(len(u)), u, (u**2).sum(1))
        if tree is not None:
            yield _leaf_batch(tree)

    def merge_group(key_, t):
        ls = to_matrix(t.column("ls"))
        n, ss = t.column("n").to_numpy(), t.column("ss").to_numpy()
        order = np.lexsort((*ls.T[:4], -n))  # the same order whatever task came first
        tree = CFTree(ls.shape[1], max_leaves=max_leaves, least_corr=least_corr)
        tree.insert(n[order], ls[order], ss[order])
        m = pa.Table.from_batches([_leaf_batch(tree)])
        return m.append_column("g", pa.array([key_[0].as_py()] * len(m), pa.int32()))

    def merged(leaves: DataFrame, tasks: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, ls) of one tree's leaves out of the leaves of numbered tasks."""
        while tasks > 1:
            leaves = leaves.withColumn("g", F.floor(F.col("g") / fan_in).cast("int")).groupBy("g").applyInArrow(merge_group, ddl + ", g int")
            tasks = -(-tasks // fan_in)
        got = leaves.select("n", "ls").toArrow()
        return got.column("n").to_numpy(), to_matrix(got.column("ls")) if len(got) else np.zeros((0, 1))

    ddl = "n double, ls array<double>, ss double"
    first = cut_lineage(vectors.select(vec).mapInArrow(build, ddl).withColumn("g", F.spark_partition_id()))
    n, ls = merged(first, 1 + (first.agg(F.max("g")).first()[0] or 0))
    groups = Groups.of_leaves(n, ls, ward(n, ls, least_corr)).repaired(least_corr)

    def pass_over(now: Groups):
        """Sums of the groups' halves (side 0, 1) and leaves of the vectors left over (side 2) of a task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rest = None, None
            for b in batches:
                x = to_matrix(b.column(0))
                if not len(x):
                    continue
                g, half, _ = _place(x, now, least_corr)
                s = _sums(x, g, half, len(now.n))
                total = s if total is None else Groups(total.n + s.n, total.z + s.z, total.filled + s.filled)
                if (g < 0).any():
                    u = unit_rows(x[g < 0])
                    rest = rest or CFTree(x.shape[1], max_leaves=max_leaves, least_corr=least_corr)
                    rest.insert(np.ones(len(u)), u, (u**2).sum(1))
            if total is not None:
                i, h = np.nonzero(total.n)
                as_list = lambda a: pa.array([*a], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(h, pa.int32()), pa.array(total.n[i, h]), as_list(total.z[i, h]), as_list(total.filled[i, h])], names=names)
            if rest is not None:
                t = _leaf_batch(rest)
                yield pa.RecordBatch.from_arrays([pa.array([-1] * len(t), pa.int32()), pa.array([2] * len(t), pa.int32()), t.column("n"), t.column("ls"), pa.array([[v] for v in t.column("ss").to_pylist()], pa.list_(pa.float64()))], names=names)

        return run

    def add_up(key_, t):
        one = lambda c: pa.array([to_matrix(t.column(c)).sum(0)], pa.list_(pa.float64()))
        return pa.table({"grp": pa.array([key_[0].as_py()], pa.int32()), "side": pa.array([key_[1].as_py()], pa.int32()), "n": pa.array([sum(t.column("n").to_pylist())]), "z": one("z"), "filled": one("filled")})

    names = ["grp", "side", "n", "z", "filled"]
    sum_ddl = "grp int, side int, n double, z array<double>, filled array<double>"
    for _ in range(passes):
        if not len(groups.n):
            break
        out = cut_lineage(vectors.select(vec).mapInArrow(pass_over(groups), sum_ddl).withColumn("g", F.spark_partition_id()))
        sums = out.filter("side < 2").drop("g").groupBy("grp", "side").applyInArrow(add_up, sum_ddl).toArrow()
        new = Groups(np.zeros_like(groups.n), np.zeros_like(groups.z), np.zeros_like(groups.filled))
        i, h = sums.column("grp").to_numpy(), sums.column("side").to_numpy()
        if len(sums):
            new.n[i, h], new.z[i, h], new.filled[i, h] = sums.column("n").to_numpy(), to_matrix(sums.column("z")), to_matrix(sums.column("filled"))
        left = out.filter("side = 2").select("n", F.col("z").alias("ls"), F.col("filled")[0].alias("ss"), "g")
        n_left, ls_left = merged(left, 1 + (left.agg(F.max("g")).first()[0] or 0)) if not left.isEmpty() else (np.zeros(0), np.zeros((0, 1)))
        if len(n_left):
            more = Groups.of_leaves(n_left, ls_left, ward(n_left, ls_left, least_corr))
            new = Groups(np.r_[new.n, more.n], np.r_[new.z, more.z], np.r_[new.filled, more.filled])
        new = new.repaired(least_corr)
        same = new.n.shape == groups.n.shape and np.array_equal(new.n.sum(1), groups.n.sum(1)) and np.allclose(new.averages(), groups.averages(), rtol=0, atol=1e-9)
        groups = new
        if same:
            break

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = to_matrix(b.column(1))
            if not len(x) or not len(groups.n):
                continue
            g, _, sim = _place(x, groups, least_corr)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(g.astype(np.int32), mask=g < 0), pa.array(sim, mask=g < 0)], names=[key, "cluster_no", "similarity"])

    kind = dict(vectors.dtypes)[key]
    assigned = vectors.select(key, vec).mapInArrow(assign, f"`{key}` {kind}, cluster_no int, similarity double")
    inside = assigned.filter(F.col("cluster_no").isNotNull())
    sizes = inside.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("n_members"))
    w = Window.partitionBy("cluster_no").orderBy(F.desc("similarity"), key)
    near = inside.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= typical)
    return assigned, near.join(sizes, "cluster_no").select("cluster_no", "n_members", "rank", key, "similarity")
