"""Dimension reduction: centred PCA, correlation space, projections of new cells, embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellorium.exprset import CELL, GENE, ExprSet
from cellorium.operators import embed
from cellorium.operators.groupstats import drop_flat_genes
from cellorium.operators.knee import find_knee
from cellorium.operators.relational import midrank
from cellorium.operators.vgene import VGENE_COLUMN

#: Cells up to which a cell x cell matrix is made; larger sets go through the subsample path.
MAX_CELLS = 5000


def collect_matrix(vectors: DataFrame, key: str = CELL, limit: int = MAX_CELLS) -> tuple[list, np.ndarray]:
    """(ids, matrix) of an embedding, ids in order; raises over ``limit`` rows."""
    rows = vectors.select(key, "features").limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} cells; use subsample_cluster_classify instead")
    rows = rows.sort_values(key, ignore_index=True)
    return rows[key].tolist(), np.stack(rows["features"].to_numpy()).astype(float) if len(rows) else np.zeros((0, 0))


def matrix_frame(like: DataFrame, ids: list, x: np.ndarray, key: str = CELL) -> DataFrame:
    return like.sparkSession.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], f"{key} {dict(like.dtypes)[key]}, features array<double>")


def pca(vectors: DataFrame, n_components: int | None = None, most: int = 100) -> tuple[DataFrame, dict]:
    """(scores, info) of a centred, unscaled PCA of the cell vectors.

    Components: the argument, else the knee of the first 100 explained shares,
    else 30.  Signs: the largest absolute loading is positive.  info: mean,
    rotation (genes x components), explained (shares of the whole variance), gap.
    """
    width = len(vectors.select("features").first()[0])
    v = vectors.select(CELL, array_to_vector("features").alias("raw")).persist()
    try:
        scaler = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="x").fit(v)
        c = scaler.transform(v)
        n = v.count()
        k = max(1, min(most, width, n))
        model = PCA(k=k, inputCol="x", outputCol="y").fit(c)
        load = model.pc.toArray()
        sign = np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])
        sign[sign == 0] = 1
        load = load * sign
        share = model.explainedVariance.toArray()
        npc = min(n_components or (find_knee(share[:100]) if k > 1 else 1) or 30, k)
    finally:
        v.unpersist()
    info = {"mean": scaler.mean.toArray(), "rotation": load[:, :npc], "explained": share, "gap": np.diff(-share), "npc": npc}
    return project_pca(vectors, info), info


def project_pca(vectors: DataFrame, info: dict) -> DataFrame:
    """Scores of (new) cells: centred with the training means, then rotated."""
    mean, rot = info["mean"], info["rotation"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["features"].to_numpy()).astype(float)
                yield pd.DataFrame({CELL: pdf[CELL], "features": list((x - mean) @ rot)})

    return vectors.select(CELL, "features").mapInPandas(run, f"{CELL} {dict(vectors.dtypes)[CELL]}, features array<double>")


def gene_pairs_correlation(expr: DataFrame, value: str, method: str = "spearman") -> DataFrame:
    """(cell_a, cell_b, r) for all pairs a <= b as a join on genes: for small sets and as a check."""
    e = midrank(expr, [CELL], value, "__v").select(GENE, CELL, "__v") if method == "spearman" else expr.select(GENE, CELL, F.col(value).alias("__v"))
    a, b = e.select(GENE, F.col(CELL).alias("cell_a"), F.col("__v").alias("x")), e.select(GENE, F.col(CELL).alias("cell_b"), F.col("__v").alias("y"))
    return a.join(b, GENE).filter("cell_a <= cell_b").groupBy("cell_a", "cell_b").agg(F.corr("x", "y").alias("r"))


def _ranks(x: np.ndarray) -> np.ndarray:
    """Mid-ranks of each row."""
    out = np.empty_like(x, dtype=float)
    for i, row in enumerate(x):
        u, inv, cnt = np.unique(row, return_inverse=True, return_counts=True)
        out[i] = (np.cumsum(cnt) - (cnt - 1) / 2.0)[inv]
    return out


def _standard(x: np.ndarray, method: str) -> np.ndarray:
    if method == "spearman":
        x = _ranks(x)
    elif method != "pearson":
        raise ValueError(f"unknown correlation {method!r}")
    c = x - x.mean(1, keepdims=True)
    n = np.sqrt((c**2).sum(1, keepdims=True))
    return c / np.where(n > 0, n, 1.0)


def correlation_space(vectors: DataFrame, method: str = "spearman", n_iter: int = 1, against: DataFrame | None = None) -> DataFrame:
    """Each cell's correlations with the reference cells (``against``, else all cells) as its features.

    The reference side is bounded by ``MAX_CELLS`` and broadcast in rank-standardised
    form; the other side may be of any size: one matrix product per batch, no
    shuffle.  ``n_iter`` > 1 correlates the columns of the previous matrix again
    and is for all cells only.
    """
    ref = against if against is not None else vectors
    ids, x = collect_matrix(ref)
    z = _standard(x, method)
    if n_iter > 1:
        if against is not None:
            raise ValueError("iterated correlation cannot be applied to new cells")
        m = z @ z.T
        for _ in range(n_iter - 1):
            s = _standard(m.T, method)
            m = s @ s.T
        return matrix_frame(vectors, ids, m)
    held = vectors.sparkSession.sparkContext.broadcast(z)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                y = _standard(np.stack(pdf["features"].to_numpy()).astype(float), method)
                yield pd.DataFrame({CELL: pdf[CELL], "features": list(y @ held.value.T)})

    return vectors.select(CELL, "features").mapInPandas(run, f"{CELL} {dict(vectors.dtypes)[CELL]}, features array<double>")


def map_out_of_sample(cross: DataFrame, similarity: np.ndarray, y_train: np.ndarray) -> DataFrame:
    """A . pinv(S) . Y: places new cells in the training cells' embedding; one small product per batch."""
    m = np.linalg.pinv(similarity) @ y_train

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield pd.DataFrame({CELL: pdf[CELL], "features": list(np.stack(pdf["features"].to_numpy()) @ m)})

    return cross.select(CELL, "features").mapInPandas(run, f"{CELL} {dict(cross.dtypes)[CELL]}, features array<double>")


def prepare(es: ExprSet, assay: str = "exprs") -> ExprSet:
    """Drop genes with missing values or zero sd."""
    return es.subset_genes(drop_flat_genes(es.expr, assay))


def reduce_dim(es: ExprSet, method: str = "iCor", assay: str = "exprs", vgene: str = "HVG.sd", n_pc: int | None = None, perplexity: float = 30.0, use_pca: bool = True, auto_tsne: bool = True, name: str | None = None, icor_iter: int = 1, icor_method: str = "spearman", reuse: bool = False, seed: int = 9997, max_iter: int = 1000) -> ExprSet:
    """Add the embedding ``name`` (default: the method) and, if ``auto_tsne``, ``<name>.tsne``."""
    name = name or method
    if reuse and name in es.emb:
        return es
    column = VGENE_COLUMN.get(vgene, vgene)
    if column not in es.genes.columns:
        raise ValueError(f"gene column {column!r} is missing; select variable genes first")
    es = prepare(es, assay)
    v = es.cell_vectors(assay, column).persist()
    if method == "pca":
        scores, info = pca(v, n_pc)
        es = es.with_embedding(name, scores).with_meta(**{f"pca.res.{name}": info})
    elif method == "iCor":
        es = es.with_embedding(name, correlation_space(v, icor_method, icor_iter))
    elif method in ("tsne", "umap"):
        ids, x = collect_matrix(v)
        y = embed.run_tsne(x, perplexity, use_pca, seed=seed, max_iter=max_iter) if method == "tsne" else embed.umap(x, n_pca=n_pc or 50, seed=seed)
        return es if y is None else es.with_embedding(name, matrix_frame(v, ids, y))
    else:
        raise ValueError(f"unknown reduction {method!r}")
    if auto_tsne:
        ids, x = collect_matrix(es.emb[name])
        y = embed.run_tsne(x, perplexity, use_pca, seed=seed, max_iter=max_iter)
        if y is not None:
            es = es.with_embedding(f"{name}.tsne", matrix_frame(v, ids, y))
    return es
