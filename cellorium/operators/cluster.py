"""Clustering of cells on an embedding, one labelling per k."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellorium.exprset import CELL, ExprSet
from cellorium.operators import community
from cellorium.operators.neighbors import knn_graph, snn_edges
from cellorium.operators.reduce import MAX_CELLS, collect_matrix
from cellorium.operators.vgene import VGENE_COLUMN

METHODS = ("kmeans", "hclust", "dynamicTreeCut", "adpclust", "dpclust", "SNN", "SC3")


def kmeans(vectors: DataFrame, k: int, starts: int = 5, max_iter: int = 1000, seed: int = 1) -> DataFrame:
    """(cell_id, cluster INT from 1): the start of least cost; a distributed fit for any number of cells."""
    v = vectors.select(CELL, array_to_vector("features").alias("features")).persist()
    try:
        fits = [KMeans(k=k, maxIter=max_iter, seed=seed + s, featuresCol="features").fit(v) for s in range(starts)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        return best.transform(v).select(CELL, (F.col("prediction") + 1).alias("cluster"))
    finally:
        v.unpersist()


def bisecting_kmeans(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """A hierarchical alternative for more cells than a distance matrix allows."""
    v = vectors.select(CELL, array_to_vector("features").alias("features"))
    return BisectingKMeans(k=k, seed=seed, featuresCol="features").fit(v).transform(v).select(CELL, (F.col("prediction") + 1).alias("cluster"))


def distances(x: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def linkage(d: np.ndarray, method: str = "ward") -> list[tuple[int, int, float]]:
    """Agglomeration by the Lance-Williams recurrence: (kept, absorbed, height) in order of merging.

    ward squares Euclidean distances and reports their root; average and complete
    use them as they are.
    """
    n = len(d)
    c = d.astype(float) ** 2 if method == "ward" else d.astype(float).copy()
    np.fill_diagonal(c, np.inf)
    size, out = np.ones(n), []
    nearest = c.argmin(1) if n else np.zeros(0, int)
    low = c[np.arange(n), nearest] if n else np.zeros(0)
    for _ in range(n - 1):
        i = int(low.argmin())
        j = int(nearest[i])
        h = c[i, j]
        i, j = min(i, j), max(i, j)
        out.append((i, j, float(np.sqrt(h) if method == "ward" else h)))
        if method == "ward":
            new = ((size + size[i]) * c[i] + (size + size[j]) * c[j] - size * h) / (size + size[i] + size[j])
        elif method == "average":
            new = (size[i] * c[i] + size[j] * c[j]) / (size[i] + size[j])
        elif method == "complete":
            new = np.maximum(c[i], c[j])
        else:
            raise ValueError(f"unknown linkage {method!r}")
        gone = ~np.isfinite(c[i]) | ~np.isfinite(c[j])
        new[gone] = np.inf
        new[[i, j]] = np.inf
        c[i], c[:, i] = new, new
        c[j], c[:, j] = np.inf, np.inf
        size[i] += size[j]
        low[j] = np.inf
        redo = np.flatnonzero((nearest == i) | (nearest == j))
        for r in np.unique(np.r_[redo, i]):
            if r != j and np.isfinite(low[r]) or r == i:
                nearest[r] = c[r].argmin()
                low[r] = c[r, nearest[r]]
        closer = new < low
        closer[[i, j]] = False
        nearest[closer], low[closer] = i, new[closer]
    return out


def cut_tree(merges: list, n: int, k: int) -> np.ndarray:
    """Labels from 1, numbered by first member, of the k clusters left before the last k - 1 merges."""
    lab = np.arange(n)
    for i, j, _ in merges[: max(0, n - k)]:
        lab[lab == lab[j]] = lab[i]
    return community._tidy(lab) + 1


def mean_silhouette(d: np.ndarray, lab: np.ndarray) -> float:
    names, own = np.unique(lab, return_inverse=True)
    if len(names) < 2:
        return -1.0
    h = np.eye(len(names))[own]
    size = h.sum(0)
    s = d @ h
    r = np.arange(len(d))
    a = s[r, own] / np.maximum(size[own] - 1, 1)
    m = s / size
    m[r, own] = np.inf
    b = m.min(1)
    return float(np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0).mean())


def hclust(x: np.ndarray, k: int = 0, method: str = "ward", most: int = 10) -> np.ndarray:
    """Agglomerative labels; k = 0 takes the k in 2..most of largest mean silhouette."""
    d = distances(x)
    merges = linkage(d, method)
    if k:
        return cut_tree(merges, len(x), k)
    tries = [cut_tree(merges, len(x), i) for i in range(2, min(most, len(x) - 1) + 1)]
    return max(tries, key=lambda lab: mean_silhouette(d, lab)) if tries else np.ones(len(x), int)


def dynamic_tree_cut(x: np.ndarray, least: int | None = None, depth: float = 0.64) -> np.ndarray:
    """Ward tree cut branch by branch (our rule): a merge joins two clusters for good when both branches hold
    ``least`` members and the height jumps over ``depth`` of the range between the 5th percentile and the top.
    Branches too small stay with label 0 unless they join a cluster below the cut."""
    n = len(x)
    least = least or max(2, min(20, n // 10))
    merges = linkage(distances(x), "ward")
    if not merges:
        return np.ones(n, int)
    h = np.array([m[2] for m in merges])
    cut = np.percentile(h, 5) + depth * (h.max() - np.percentile(h, 5))
    members = {i: [i] for i in range(n)}
    basic: dict[int, list[list[int]]] = {i: [] for i in range(n)}
    for i, j, height in merges:
        split = height > cut * 0.5 and min(len(members[i]), len(members[j])) >= least
        if split:
            parts = (basic[i] or [members[i]]) + (basic[j] or [members[j]])
        elif basic[i] or basic[j]:
            parts = basic[i] + basic[j]
            if height <= cut:  # small branch close enough: to the only or the first cluster of the other side
                small = members[j] if basic[i] else members[i]
                if not (basic[i] and basic[j]):
                    parts = [parts[0] + small] + parts[1:] if len(parts) == 1 else parts
        else:
            parts = []
        members[i] = members[i] + members.pop(j)
        basic[i] = parts
        basic.pop(j)
    root = merges[-1][0]
    parts = sorted(basic[root] or [members[root]], key=lambda p: (-len(p), min(p)))
    lab = np.zeros(n, int)
    for c, p in enumerate(parts, 1):
        lab[p] = c
    return lab


def density_peaks(d: np.ndarray, dc: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(rho, delta, nearest denser point or -1, dc) with a Gaussian kernel; dc defaults to the 2 % distance quantile."""
    n = len(d)
    if dc is None:
        dc = float(np.quantile(d[np.triu_indices(n, 1)], 0.02)) if n > 1 else 1.0
        dc = dc or 1e-12
    rho = np.exp(-((d / dc) ** 2)).sum(1) - 1
    order = np.lexsort((np.arange(n), -rho))
    delta, up = np.zeros(n), np.full(n, -1)
    for r, i in enumerate(order):
        if r == 0:
            delta[i] = d[i].max() if n > 1 else 0.0
        else:
            prev = order[:r]
            j = prev[int(d[i, prev].argmin())]
            delta[i], up[i] = d[i, j], j
    return rho, delta, up, dc


def _assign_peaks(rho, up, peaks: np.ndarray) -> np.ndarray:
    lab = np.zeros(len(rho), int)
    for c, p in enumerate(peaks, 1):
        lab[p] = c
    for i in np.lexsort((np.arange(len(rho)), -rho)):
        if lab[i] == 0:
            lab[i] = lab[up[i]] if up[i] >= 0 else 1
    return lab


def dpclust(x: np.ndarray, rho_cut: float | None = None, delta_cut: float | None = None) -> np.ndarray:
    """Density peaks: centres reach the 90 % quantile of rho and the 95 % quantile of delta; fewer than two: one cluster."""
    rho, delta, up, _ = density_peaks(distances(x))
    a = np.quantile(rho, 0.90) if rho_cut is None else rho_cut
    b = np.quantile(delta, 0.95) if delta_cut is None else delta_cut
    peaks = np.flatnonzero((rho >= a) & (delta >= b))
    if len(peaks) < 2:
        return np.ones(len(x), int)
    return _assign_peaks(rho, up, peaks[np.argsort(-rho[peaks], kind="stable")])


def adpclust(x: np.ndarray, ks: Sequence[int]) -> np.ndarray:
    """Adaptive density peaks (our search): bandwidth quantile and number of centres of largest mean silhouette."""
    d = distances(x)
    off = d[np.triu_indices(len(d), 1)]
    best = (-2.0, np.ones(len(x), int))
    for q in (0.01, 0.02, 0.05, 0.1):
        rho, delta, up, _ = density_peaks(d, float(np.quantile(off, q)) or 1e-12)
        order = np.argsort(-(rho * delta), kind="stable")
        for k in ks:
            if 2 <= k < len(x):
                lab = _assign_peaks(rho, up, order[:k])
                s = mean_silhouette(d, lab)
                if s > best[0] + 1e-12:
                    best = (s, lab)
    return best[1]


def snn_cluster(vectors: DataFrame, k: int = 10, method: str = "eigen", seed: int = 1) -> tuple[DataFrame, list, np.ndarray]:
    """(edges, cell ids, labels from 1) of the shared-neighbour graph's communities."""
    ids, _ = collect_matrix(vectors)
    edges = snn_edges(knn_graph(vectors, k), k).persist()
    e = edges.toPandas()
    pos = {c: i for i, c in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    i, j = e["src"].map(pos).to_numpy(int), e["dst"].map(pos).to_numpy(int)
    w[i, j] = w[j, i] = e["weight"].to_numpy(float)
    kw = {"seed": seed} if method in ("louvain", "leiden", "prop", "spinglass", "infomap") else {}
    if method == "infomap":
        sc = vectors.sparkSession.sparkContext
        kw["each"] = lambda f, seeds: sc.parallelize(seeds, len(seeds)).map(f).collect()
    return edges, ids, community.detect(w, method, **kw) + 1


def _lloyd(x: np.ndarray, k: int, rs, rounds: int = 50) -> np.ndarray:
    cen = x[rs.choice(len(x), k, replace=False)]
    lab = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((cen**2).sum(1)[None] - 2 * x @ cen.T).argmin(1)
        for c in range(k):
            if (new == c).any():
                cen[c] = x[new == c].mean(0)
        if (new == lab).all():
            break
        lab = new
    return lab


def consensus(x: np.ndarray, k: int, seed: int = 1, starts: int = 3) -> np.ndarray:
    """Consensus of k-means over {euclidean, pearson, spearman} x {pca, laplacian} spaces, Ward on co-association."""
    from cellorium.operators.reduce import _standard

    n, rs, co, runs = len(x), np.random.RandomState(seed), np.zeros((len(x), len(x))), 0
    for d in (distances(x), 1 - _standard(x, "pearson") @ _standard(x, "pearson").T, 1 - _standard(x, "spearman") @ _standard(x, "spearman").T):
        c = d - d.mean(0)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        a = np.exp(-d / max(d.max(), 1e-12))
        g = 1 / np.sqrt(a.sum(1))
        _, vec = np.linalg.eigh(np.eye(n) - g[:, None] * a * g[None])
        top = max(2, int(np.ceil(0.07 * n)))
        for y in (u[:, :top] * s[:top], vec[:, :top]):
            for _ in range(starts):
                lab = _lloyd(y.copy(), k, rs)
                co += lab[:, None] == lab[None]
                runs += 1
    return cut_tree(linkage(1 - co / runs, "complete"), n, k)


def clust(es: ExprSet, reduction: str = "iCor", method: str = "kmeans", ks: Sequence[int] = (2, 3, 4, 5, 6), assay: str = "exprs", vgene: str = "HVG.sd", snn_k: int = 10, snn_method: str = "eigen", rho: float | None = None, delta: float | None = None, starts: int = 5, seed: int = 1) -> ExprSet:
    """Add label columns ``<reduction>.<method>.k<k>`` (k = ``kauto`` for methods that choose it) to the cells.

    Labels are ``C1``... for kmeans, hclust, SNN and SC3, two digits for the density
    methods and the tree cut (``C00``: unassigned).  ``reduction="none"`` uses the
    variable genes.  A missing embedding labels every cell ``C0``.  The SNN graph is
    kept under its embedding and k.  Unknown methods raise.
    """
    if method not in METHODS:
        raise ValueError(f"unknown clustering method {method!r}; known: {METHODS}")
    auto = method in ("dynamicTreeCut", "adpclust", "dpclust", "SNN")
    names = [f"{reduction}.{method}.kauto"] if auto else [f"{reduction}.{method}.k{k}" for k in ks]
    if reduction == "none":
        v = es.cell_vectors(assay, VGENE_COLUMN.get(vgene, vgene))
    elif reduction in es.emb:
        v = es.emb[reduction]
    else:
        return es.with_(cells=es.cells.withColumns({n: F.lit("C0") for n in names}))
    like = dict(v.dtypes)[CELL]
    frame = lambda ids, lab: es.expr.sparkSession.createDataFrame([(i, int(c)) for i, c in zip(ids, lab)], f"{CELL} {like}, cluster int")
    if method == "kmeans":
        for n, k in zip(names, ks):
            es = _attach(es, n, kmeans(v, k, starts, seed=seed), "C%d")
        return es
    if method == "SNN":
        edges, ids, lab = snn_cluster(v, snn_k, snn_method, seed)
        return _attach(es.with_meta(**{f"snn.{reduction}.{snn_k}": edges}), names[0], frame(ids, lab), "C%d")
    ids, x = collect_matrix(v, limit=MAX_CELLS)
    if method == "dynamicTreeCut":
        return _attach(es, names[0], frame(ids, dynamic_tree_cut(x)), "C%02d")
    if method == "adpclust":
        return _attach(es, names[0], frame(ids, adpclust(x, ks)), "C%02d")
    if method == "dpclust":
        return _attach(es, names[0], frame(ids, dpclust(x, rho, delta)), "C%02d")
    for n, k in zip(names, ks):
        lab = hclust(x, k) if method == "hclust" else consensus(x, k, seed)
        es = _attach(es, n, frame(ids, lab), "C%d")
    return es


def _attach(es: ExprSet, name: str, labels: DataFrame, pattern: str) -> ExprSet:
    col = labels.select(CELL, F.format_string(pattern, F.col("cluster")).alias(name))
    keep = [c for c in es.cells.columns if c != name]
    return es.with_(cells=es.cells.select(*[F.col(f"`{c}`") for c in keep]).join(col, CELL, "left"))
