"""Agreement of two labellings, and silhouette widths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari): adjusted Rand index from the contingency table; 1 if both have one class."""
    t = _contingency(df, a, b)
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    n = F.col("n")
    sums = t.agg(pairs(n).alias("s_ab"), F.sum("n").alias("n_all"))
    sa = t.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(n).alias("s_a"))
    sb = t.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(n).alias("s_b"))
    row = sums.crossJoin(sa).crossJoin(sb)  # three tables of one row each
    total = F.col("n_all") * (F.col("n_all") - 1) / 2
    expect = F.col("s_a") * F.col("s_b") / total
    top = (F.col("s_a") + F.col("s_b")) / 2
    return row.select(F.when(top == expect, F.lit(1.0)).otherwise((F.col("s_ab") - expect) / F.nullif(top - expect, F.lit(0.0))).alias("ari"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (nmi): mutual information over the mean of the entropies (natural logarithm)."""
    t = _contingency(df, a, b)
    tot = t.agg(F.sum("n").alias("n_all"))
    h = lambda key, out: t.groupBy(key).agg(F.sum("n").alias("n")).crossJoin(tot).agg(-F.sum(F.col("n") / F.col("n_all") * F.log(F.col("n") / F.col("n_all")))).toDF(out)
    na, nb = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    mi = t.join(na, "a").join(nb, "b").crossJoin(tot).agg(F.sum(F.col("n") / F.col("n_all") * F.log(F.col("n") * F.col("n_all") / (F.col("na") * F.col("nb")))).alias("mi"))
    row = mi.crossJoin(h("a", "h_a")).crossJoin(h("b", "h_b"))
    mean = (F.col("h_a") + F.col("h_b")) / 2
    return row.select(F.when(mean == 0, F.lit(1.0)).otherwise(F.col("mi") / F.nullif(mean, F.lit(0.0))).alias("nmi"))


def silhouette(vectors: DataFrame, labels: DataFrame, key: str = "cell_id", label: str = "label", limit: int = 5000) -> DataFrame:
    """(key, label, a, b, width) with Euclidean distances; a class of one has width 0.

    The labelled points (at most ``limit``, else it raises) are broadcast and each
    batch of cells is held against them; nothing is shuffled.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    j = vectors.join(labels.select(key, label), key).filter(F.col(label).isNotNull())
    ref = j.limit(limit + 1).toPandas()
    if len(ref) > limit:
        raise ValueError(f"more than {limit} cells; sample first")
    names = sorted(ref[label].unique()) if len(ref) else []
    x = np.stack(ref["features"].to_numpy()).astype(float) if len(ref) else np.zeros((0, 1))
    onehot = (ref[label].to_numpy()[:, None] == np.array(names, dtype=object)[None, :]).astype(float) if len(ref) else np.zeros((0, 0))
    size = onehot.sum(0)
    kinds = dict(j.dtypes)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            y = np.stack(pdf["features"].to_numpy()).astype(float)
            d = np.sqrt(np.maximum((y**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * y @ x.T, 0))
            d[d < 1e-7] = 0.0
            own = np.array([names.index(v) for v in pdf[label]])
            s = d @ onehot
            r = np.arange(len(y))
            a = np.where(size[own] > 1, s[r, own] / np.maximum(size[own] - 1, 1), 0.0)
            m = s / size
            m[r, own] = np.inf
            b = m.min(1) if m.shape[1] > 1 else np.full(len(y), np.nan)
            w = np.where(size[own] > 1, (b - a) / np.where(np.maximum(a, b) > 0, np.maximum(a, b), 1.0), 0.0)
            yield pd.DataFrame({key: pdf[key], label: pdf[label], "a": a, "b": b, "width": w})

    return j.select(key, label, "features").mapInPandas(run, f"{key} {kinds[key]}, {label} {kinds[label]}, a double, b double, width double")
