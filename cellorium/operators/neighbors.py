"""Nearest neighbours, shared-neighbour graphs and kNN classification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellorium.exprset import CELL
from cellorium.operators.reduce import MAX_CELLS, collect_matrix


def knn_graph(vectors: DataFrame, k: int = 10, reference: DataFrame | None = None, limit: int = MAX_CELLS) -> DataFrame:
    """(src, dst, rank, dist): exact k nearest Euclidean neighbours, self excluded, ties by id.

    The reference side (all cells by default) is bounded by ``limit`` and
    broadcast; the other side streams through in batches without a shuffle.
    """
    ref = reference if reference is not None else vectors
    ids, x = collect_matrix(ref, limit=limit)
    held = vectors.sparkSession.sparkContext.broadcast((np.array(ids, dtype=object), x))
    kind = dict(vectors.dtypes)[CELL]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, m = held.value
        pos = {v: i for i, v in enumerate(names)}
        for pdf in it:
            for s in range(0, len(pdf), 500):
                part = pdf.iloc[s : s + 500]
                y = np.stack(part["features"].to_numpy()).astype(float)
                d = np.sqrt(np.maximum((y**2).sum(1)[:, None] + (m**2).sum(1)[None, :] - 2 * y @ m.T, 0.0))
                me = [pos.get(c) for c in part[CELL]]
                for r, p in enumerate(me):
                    if p is not None:
                        d[r, p] = np.inf
                kk = min(k, int(np.isfinite(d).sum(1).min()))
                near = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :kk]
                yield pd.DataFrame({
                    "src": np.repeat(part[CELL].to_numpy(), kk), "dst": names[near.ravel()], "rank": np.tile(np.arange(1, kk + 1), len(part)).astype(np.int32),
                    "dist": np.take_along_axis(d, near, 1).ravel(),
                })

    return vectors.select(CELL, "features").mapInPandas(run, f"src {kind}, dst {kind}, rank int, dist double")


def snn_edges(knn: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight), src < dst: rank-weighted shared-neighbour graph.

    A cell is its own neighbour of rank 0; weight = max(k - (r1 + r2) / 2, 1e-6) of
    the best shared neighbour.  A join on the shared neighbour: each cell is named
    by about k others, so pairs stay near n k^2.
    """
    me = knn.select(F.col("src").alias("c")).distinct().select("c", F.col("c").alias("via"), F.lit(0).alias("r"))
    nb = knn.select(F.col("src").alias("c"), F.col("dst").alias("via"), F.col("rank").alias("r")).unionByName(me)
    a, b = nb.select(F.col("c").alias("src"), "via", F.col("r").alias("r1")), nb.select(F.col("c").alias("dst"), "via", F.col("r").alias("r2"))
    w = F.greatest(F.lit(float(k)) - (F.col("r1") + F.col("r2")) / 2, F.lit(1e-6))
    return a.join(b, "via").filter("src < dst").groupBy("src", "dst").agg(F.max(w).alias("weight"))


def knn_classify(train: DataFrame, label: str, pred: DataFrame, k: int = 1, limit: int = MAX_CELLS) -> DataFrame:
    """(cell_id, predicted): majority of the k nearest training cells and of all at the k-th distance; ties by label."""
    rows = train.select("features", label).limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} training cells")
    x = np.stack(rows["features"].to_numpy()).astype(float)
    names = np.array(sorted(rows[label].unique()), dtype=object)
    y = np.array([list(names).index(v) for v in rows[label]])
    kinds = dict(pred.dtypes) | {label: dict(train.dtypes)[label]}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            q = np.stack(pdf["features"].to_numpy()).astype(float)
            d = np.round(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0.0), 9)
            at = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1][:, None]
            votes = (d <= at).astype(float) @ np.eye(len(names))[y]
            yield pd.DataFrame({CELL: pdf[CELL], "predicted": names[votes.argmax(1)]})

    return pred.select(CELL, "features").mapInPandas(run, f"{CELL} {kinds[CELL]}, predicted {kinds[label]}")
