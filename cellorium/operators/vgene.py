"""Variable-gene selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cellorium.exprset import GENE, ExprSet
from cellorium.functions import special
from cellorium.operators.groupstats import gene_moments
from cellorium.operators.relational import bh_adjust, top_k_flag

METHODS = ("HVG.sd", "HVG.mean.sd", "trendVar")


def _moments(es: ExprSet, assay: str):
    return gene_moments(es.expr, assay)


def hvg_sd(es: ExprSet, n: int = 1500, assay: str = "exprs") -> ExprSet:
    """Flag the n genes with the largest sd: columns row_sd, hvg_sd; ties by gene id, null sd never."""
    m = _moments(es, assay)
    flagged = top_k_flag(m.filter(F.col("row_sd").isNotNull()), [F.desc("row_sd"), F.asc(GENE)], n, GENE, "hvg_sd")
    return es.with_gene_columns(flagged, "row_sd", "hvg_sd")


def hvg_mean_sd(es: ExprSet, n: int = 1500, assay: str = "exprs", least_sd: float = 1.0, least_mean: float = 1.0) -> ExprSet:
    """The n largest sd among genes with sd and mean over the limits."""
    m = _moments(es, assay)
    able = m.filter((F.col("row_sd") > least_sd) & (F.col("row_mean") > least_mean))
    best = able.orderBy(F.desc("row_sd"), GENE).limit(n).select(GENE, F.lit(True).alias("hvg_mean_sd"))
    flagged = m.join(best, GENE, "left").withColumn("hvg_mean_sd", F.coalesce("hvg_mean_sd", F.lit(False)))
    return es.with_gene_columns(flagged, "row_sd", "row_mean", "hvg_mean_sd")


def trend_var(es: ExprSet, mean_min: float = 0.1, fdr: float = 0.001, span: float = 0.3, assay: str = "norm_exprs", block: str | None = None) -> ExprSet:
    """Flag genes whose variance exceeds the mean-variance trend (our fit).

    Per-gene moments are one aggregation (residual variance inside blocks if
    ``block`` is given); the trend over genes is a local linear regression of log
    variance on the mean (tricube weights, ``span`` of the genes) on the gene-level
    table; p is the upper chi-squared tail of df * total / trend.
    """
    assay = assay if assay in es.expr.columns else "exprs"
    if block:
        e = es.expr.join(es.cells.select("cell_id", block), "cell_id")
        b = e.groupBy(GENE, block).agg(F.avg(assay).alias("m"), F.coalesce(F.var_samp(assay), F.lit(0.0)).alias("v"), F.count(assay).alias("n"))
        m = b.groupBy(GENE).agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("row_mean"), (F.sum(F.col("v") * (F.col("n") - 1)) / F.nullif(F.sum(F.col("n") - 1), F.lit(0))).alias("total_var"), F.sum(F.col("n") - 1).alias("df"))
    else:
        m = es.expr.groupBy(GENE).agg(F.avg(assay).alias("row_mean"), F.var_samp(assay).alias("total_var"), (F.count(assay) - 1).alias("df"))
    pdf = m.toPandas().sort_values(GENE, ignore_index=True)  # one row per gene
    mean, var, df = pdf["row_mean"].to_numpy(float), pdf["total_var"].to_numpy(float), pdf["df"].to_numpy(float)
    fit = np.isfinite(mean) & (mean >= mean_min) & (var > 0)
    trend = np.full(len(pdf), np.nan)
    if fit.sum() >= 3:
        xs, ys = mean[fit], np.log(var[fit])
        k = max(3, int(np.ceil(span * fit.sum())))
        for i in np.flatnonzero(np.isfinite(mean)):
            d = np.abs(xs - mean[i])
            h = max(np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1], 1e-12) * 1.0001
            w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
            xm = np.average(xs, weights=w)
            ym = np.average(ys, weights=w)
            s = (w * (xs - xm) ** 2).sum()
            slope = (w * (xs - xm) * (ys - ym)).sum() / s if s > 1e-12 else 0.0
            trend[i] = np.exp(ym + slope * (mean[i] - xm))
    pdf["trend_var"], pdf["bio_var"] = trend, var - trend
    pdf["p_value"] = special.chi2_sf(df * var / trend, df)
    pdf = pdf.astype({"p_value": float}).replace({np.nan: None})
    detail = bh_adjust(es.expr.sparkSession.createDataFrame(pdf.where(pd.notna(pdf), None), f"{GENE} {dict(es.genes.dtypes)[GENE]}, row_mean double, total_var double, df long, trend_var double, bio_var double, p_value double"), "p_value", out="fdr")
    detail = detail.withColumn("trend_hvg", F.coalesce((F.col("fdr") < fdr) & (F.col("row_mean") > mean_min), F.lit(False)))
    return es.with_gene_columns(detail, "trend_hvg").with_meta(trend_var=detail.orderBy(F.asc_nulls_last("fdr"), F.desc(F.col("bio_var") / F.col("total_var"))))


def variable_genes(es: ExprSet, method: str = "HVG.sd", n: int = 1500, mean_min: float = 0.1, fdr: float = 0.001, assay: str = "exprs", block: str | None = None, reuse: bool = False) -> ExprSet:
    """Dispatch; unknown methods raise.  ``reuse`` keeps a flag column computed before."""
    column = {"HVG.sd": "hvg_sd", "HVG.mean.sd": "hvg_mean_sd", "trendVar": "trend_hvg"}.get(method)
    if column is None:
        raise ValueError(f"unknown variable-gene method {method!r}; known: {METHODS}")
    if reuse and column in es.genes.columns:
        return es
    if method == "HVG.sd":
        return hvg_sd(es, n, assay)
    if method == "HVG.mean.sd":
        return hvg_mean_sd(es, n, assay)
    return trend_var(es, mean_min, fdr, assay="norm_exprs", block=block)


VGENE_COLUMN = {"HVG.sd": "hvg_sd", "HVG.mean.sd": "hvg_mean_sd", "trendVar": "trend_hvg"}
