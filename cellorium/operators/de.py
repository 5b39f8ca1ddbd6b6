"""Differential expression: variance analysis, rank tests, markers, moderated and plain linear models.

Everything rests on two aggregations with map-side combine: moments per (gene,
group) or (gene, group, batch), and counts per (gene, group, value) for ranks.
No step holds the cells of a gene in one place; what follows works on rows per
gene and group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellorium.functions import special, udfs
from cellorium.operators.relational import bh_adjust, downsample_per_group, fractional_rank, nan_to_null
from cellorium.session import cut_lineage

GENE = "gene_id"


def moments(expr: DataFrame, value: str, by: Sequence[str], gene: str = GENE, positive: bool = False) -> DataFrame:
    """(gene, by..., n_group, mean, ss): ss is the sum of squared deviations from the group's mean.

    ``positive`` adds n_positive, the number of values over 0.
    """
    x = nan_to_null(F.col(value))
    more = [F.sum((x > 0).cast("long")).alias("n_positive")] if positive else []
    return expr.groupBy(gene, *by).agg(*more, F.count(x).alias("n_group"), F.avg(x).alias("mean"), F.coalesce(F.var_samp(x) * (F.count(x) - 1), F.lit(0.0)).alias("ss")).filter("n_group > 0")


def aov_f(expr: DataFrame, value: str, group: str, gene: str = GENE, m: DataFrame | None = None) -> DataFrame:
    """(gene, n_total, n_groups, ss_between, ss_within, f_stat) of a one-way analysis of variance.

    Nulls are left out; f_stat is null with fewer than two groups, no residual
    degrees of freedom or no residual variance.  ``m``: moments made before.
    """
    m = moments(expr, value, [group], gene) if m is None else m
    w = Window.partitionBy(gene)
    m = m.withColumn("n_total", F.sum("n_group").over(w)).withColumn("grand", F.sum(F.col("n_group") * F.col("mean")).over(w) / F.col("n_total"))
    a = m.groupBy(gene).agg(F.max("n_total").alias("n_total"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("n_group") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ss_between"), F.sum("ss").alias("ss_within"))
    d1, d2 = F.col("n_groups") - 1, F.col("n_total") - F.col("n_groups")
    return a.withColumn("f_stat", F.when((d1 > 0) & (d2 > 0), (F.col("ss_between") / d1) / F.nullif(F.col("ss_within") / F.nullif(d2, F.lit(0)), F.lit(0.0))))


def aov(expr: DataFrame, value: str, group: str, gene: str = GENE, m: DataFrame | None = None) -> DataFrame:
    f = aov_f(expr, value, group, gene, m)
    return f.withColumn("f_pvalue", udfs.f_sf(F.col("f_stat"), F.col("n_groups") - 1, F.col("n_total") - F.col("n_groups")))


def _additive_fit(rows) -> tuple[float, float, int, float]:
    """(between SS of groups, residual SS, residual df) of x ~ group + batch from per-cell moments."""
    gs, bs = sorted({r["g"] for r in rows}), sorted({r["b"] for r in rows})
    x = np.zeros((len(rows), len(gs) + len(bs) - 1))
    for i, r in enumerate(rows):
        x[i, gs.index(r["g"])] = 1
        j = bs.index(r["b"])
        if j:
            x[i, len(gs) + j - 1] = 1
    n, y = np.array([r["n"] for r in rows], float), np.array([r["m"] for r in rows], float)
    grand = (n * y).sum() / n.sum()
    sw = np.sqrt(n)[:, None]
    beta, _, rank, _ = np.linalg.lstsq(x * sw, (y - grand) * sw[:, 0], rcond=None)
    rss = (n * (y - grand - x @ beta) ** 2).sum() + sum(r["ss"] for r in rows)
    gm = {g: sum(r["n"] * r["m"] for r in rows if r["g"] == g) / sum(r["n"] for r in rows if r["g"] == g) for g in gs}
    ssb = sum(r["n"] * (gm[r["g"]] - grand) ** 2 for r in rows)
    return float(ssb), float(rss), int(n.sum()) - int(rank), float(len(gs))


def aov_batch(expr: DataFrame, value: str, group: str, batch: str, gene: str = GENE) -> DataFrame:
    """F of the group (entered first) over the residual of the additive group + batch model, with p.

    The model is fitted on (group, batch) moments, a few rows per gene.
    """
    m = moments(expr.filter(F.col(group).isNotNull() & F.col(batch).isNotNull()), value, [group, batch], gene)
    packed = m.groupBy(gene).agg(F.collect_list(F.struct(F.col(group).cast("string").alias("g"), F.col(batch).cast("string").alias("b"), F.col("n_group").alias("n"), F.col("mean").alias("m"), "ss")).alias("r"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for g, rows in zip(pdf[gene], pdf["r"]):
                ssb, rss, df, k = _additive_fit([x if isinstance(x, dict) else x.asDict() for x in rows])
                ok = k > 1 and df > 0 and rss > 0
                f = (ssb / (k - 1)) / (rss / df) if ok else None
                out.append((g, f, float(special.f_sf(f, k - 1, df)) if ok else None, rss / df if df > 0 else None, float(df)))
            yield pd.DataFrame(out, columns=[gene, "f_stat", "f_pvalue", "mse", "df_residual"])

    return packed.mapInPandas(run, f"{gene} {dict(expr.dtypes)[gene]}, f_stat double, f_pvalue double, mse double, df_residual double")


def rank_sums(expr: DataFrame, value: str, group: str, gene: str = GENE) -> DataFrame:
    """(gene, group, n_group, rank_sum, n_total, tie_sum): mid-ranks over all cells of a gene.

    Ranks come from counts of distinct values, so repeated values (zeros) of a gene
    are one row before anything is sorted.  tie_sum = sum of t^3 - t.
    """
    x = nan_to_null(F.col(value))
    rows = expr.select(F.col(gene).alias("__gene"), F.col(group).alias("__g"), x.alias("__x")).filter(F.col("__x").isNotNull())
    c = rows.groupBy("__gene", "__g", "__x").agg(F.count(F.lit(1)).alias("__c"))
    t = c.groupBy("__gene", "__x").agg(F.sum("__c").alias("__t"), F.collect_list(F.struct("__g", "__c")).alias("parts"))
    w = Window.partitionBy("__gene").orderBy("__x")
    t = t.withColumn("mid", F.sum("__t").over(w) - (F.col("__t") - 1) / F.lit(2.0))
    p = t.select("__gene", "mid", "__t", F.posexplode("parts").alias("pos", "p"))
    tie = F.when(F.col("pos") == 0, F.col("__t").cast("double") * F.col("__t") * F.col("__t") - F.col("__t")).otherwise(0.0)
    s = p.groupBy("__gene", F.col("p.__g").alias("__g")).agg(F.sum("p.__c").alias("n_group"), F.sum(F.col("p.__c") * F.col("mid")).alias("rank_sum"), F.sum(tie).alias("ties"))
    g = Window.partitionBy("__gene")
    return s.select(F.col("__gene").alias(gene), F.col("__g").alias(group), "n_group", "rank_sum", F.sum("n_group").over(g).alias("n_total"), F.sum("ties").over(g).alias("tie_sum"))


def kruskal_h(expr: DataFrame, value: str, group: str, gene: str = GENE, r: DataFrame | None = None) -> DataFrame:
    """(gene, h_stat, n_groups): tie-corrected; null if all values are equal or there is one group."""
    r = rank_sums(expr, value, group, gene) if r is None else r
    a = r.groupBy(gene).agg(F.max("n_total").alias("n"), F.max("tie_sum").alias("ties"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.pow("rank_sum", F.lit(2)) / F.col("n_group")).alias("s"))
    n = F.col("n").cast("double")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    fix = 1 - F.col("ties") / F.nullif(n * n * n - n, F.lit(0.0))
    return a.select(gene, F.when(F.col("n_groups") > 1, h / F.nullif(fix, F.lit(0.0))).alias("h_stat"), "n_groups")


def kruskal(expr: DataFrame, value: str, group: str, gene: str = GENE, r: DataFrame | None = None) -> DataFrame:
    return kruskal_h(expr, value, group, gene, r).withColumn("kruskal_pvalue", udfs.chi2_sf(F.col("h_stat"), F.col("n_groups") - 1))


def pair_differences(expr: DataFrame, value: str, group: str, gene: str = GENE, m: DataFrame | None = None) -> DataFrame:
    """(gene, g_low, g_high, diff, n_low, n_high): mean of the later level minus mean of the earlier, all pairs of groups."""
    m = moments(expr, value, [group], gene) if m is None else m
    a = m.select(gene, F.col(group).alias("g_low"), F.col("mean").alias("m1"), F.col("n_group").alias("n_low"))
    b = m.select(gene, F.col(group).alias("g_high"), F.col("mean").alias("m2"), F.col("n_group").alias("n_high"))
    return a.join(b, gene).filter("g_low < g_high").select(gene, "g_low", "g_high", (F.col("m2") - F.col("m1")).alias("diff"), "n_low", "n_high")


def tukey_hsd(expr: DataFrame, value: str, group: str, batch: str | None = None, gene: str = GENE, m: DataFrame | None = None) -> DataFrame:
    """Pairs with Tukey-Kramer adjusted p; with ``batch`` the additive model's error and degrees of freedom are used."""
    m = moments(expr, value, [group], gene) if m is None else m
    d = pair_differences(expr, value, group, gene, m)
    if batch:
        k = m.groupBy(gene).agg(F.count(F.lit(1)).alias("k"))
        err = aov_batch(expr, value, group, batch, gene).select(gene, "mse", F.col("df_residual").alias("df")).join(k, gene)
    else:
        err = aov_f(expr, value, group, gene, m).select(gene, (F.col("ss_within") / F.nullif(F.col("n_total") - F.col("n_groups"), F.lit(0))).alias("mse"), (F.col("n_total") - F.col("n_groups")).alias("df"), F.col("n_groups").alias("k"))
    q = F.abs("diff") / F.nullif(F.sqrt(F.col("mse") / 2 * (1 / F.col("n_low") + 1 / F.col("n_high"))), F.lit(0.0))
    return d.join(err, gene).withColumn("p_adj", udfs.ptukey_sf(q, F.col("k"), F.col("df"))).drop("mse", "df", "k")


def kruskal_posthoc(expr: DataFrame, value: str, group: str, gene: str = GENE, r: DataFrame | None = None) -> DataFrame:
    """Conover's pairwise comparison of mean ranks, p adjusted (BH) inside a gene."""
    r = rank_sums(expr, value, group, gene) if r is None else r
    h = kruskal_h(expr, value, group, gene, r).select(gene, "h_stat", F.col("n_groups").alias("k"))
    cols = lambda s, g: r.select(gene, F.col(group).alias(g), (F.col("rank_sum") / F.col("n_group")).alias(f"r{s}"), F.col("n_group").alias(f"n{s}"), *([F.col("n_total").cast("double").alias("n"), "tie_sum"] if s == 1 else []))
    p = cols(1, "g_low").join(cols(2, "g_high"), gene).filter("g_low < g_high").join(h, gene)
    n = F.col("n")
    s2 = (n * (n + 1) * (2 * n + 1) / 6 - F.col("tie_sum") / 12 - n * F.pow(n + 1, F.lit(2)) / 4) / (n - 1)
    se = F.sqrt(F.greatest(s2 * (n - 1 - F.col("h_stat")) / F.nullif(n - F.col("k"), F.lit(0.0)) * (1 / F.col("n1") + 1 / F.col("n2")), F.lit(0.0)))
    p = p.withColumn("diff", F.col("r2") - F.col("r1")).withColumn("p", udfs.t_sf2(F.col("diff") / F.nullif(se, F.lit(0.0)), n - F.col("k")))
    return bh_adjust(p, "p", [gene]).select(gene, "g_low", "g_high", "diff", "p_adj", F.col("n1").alias("n_low"), F.col("n2").alias("n_high"))


def best_pair(pairs: DataFrame, gene: str = GENE) -> DataFrame:
    """The pair of smallest p_adj (nulls last), then largest absolute difference, then name."""
    w = Window.partitionBy(gene).orderBy(F.asc_nulls_last("p_adj"), F.desc(F.abs("diff")), "g_low", "g_high")
    return pairs.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(gene, F.col("p_adj").alias("min_padj"), F.col("diff").alias("min_padj_diff"), F.concat_ws("-", "g_high", "g_low").alias("min_padj_cmp"))


def top_two_groups(expr: DataFrame, value: str, group: str, gene: str = GENE, m: DataFrame | None = None) -> DataFrame:
    """(gene, g_first, g_second, mean_first, mean_second): the two groups of highest mean; ties by name."""
    m = moments(expr, value, [group], gene) if m is None else m
    w = Window.partitionBy(gene).orderBy(F.desc("mean"), group)
    r = m.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    pick = lambda i, c: F.max(F.when(F.col("rn") == i, F.col(c)))
    return r.groupBy(gene).agg(pick(1, group).alias("g_first"), pick(2, group).alias("g_second"), pick(1, "mean").alias("mean_first"), pick(2, "mean").alias("mean_second"))


def top_pair_test(pairs: DataFrame, tops: DataFrame, gene: str = GENE) -> DataFrame:
    """The comparison of the two highest groups, found by equality of names."""
    t = tops.select(gene, F.least("g_first", "g_second").alias("g_low"), F.greatest("g_first", "g_second").alias("g_high"))
    return pairs.join(t, [gene, "g_low", "g_high"]).select(gene, F.col("p_adj").alias("min_diff_padj"), F.col("diff").alias("min_diff"), F.concat_ws("-", "g_high", "g_low").alias("min_diff_cmp"))


def specific_groups(pairs: DataFrame, theta: float, gene: str = GENE) -> DataFrame:
    """(gene, is_specific, label, direction): a group is specific if all its pairs have p_adj < theta.

    A gene is labelled if exactly one group is; UP / DOWN if all its differences
    point one way, else INCONSISTANT.
    """
    a = pairs.select(gene, F.col("g_high").alias("g"), "p_adj", "diff")
    b = pairs.select(gene, F.col("g_low").alias("g"), "p_adj", (-F.col("diff")).alias("diff"))
    ok = F.coalesce(F.col("p_adj") < theta, F.lit(False))
    per = a.unionByName(b).groupBy(gene, "g").agg(F.bool_and(ok).alias("sp"), F.bool_and(F.col("diff") > 0).alias("up"), F.bool_and(F.col("diff") < 0).alias("down"))
    way = F.when(F.col("up"), "UP").when(F.col("down"), "DOWN").otherwise("INCONSISTANT")
    one = per.groupBy(gene).agg(F.sum(F.col("sp").cast("long")).alias("k"), F.max(F.when(F.col("sp"), F.col("g"))).alias("label"), F.max(F.when(F.col("sp"), way)).alias("direction"))
    hit = F.col("k") == 1
    return one.select(gene, hit.alias("is_specific"), F.when(hit, F.col("label")).alias("label"), F.when(hit, F.col("direction")).alias("direction"))


def find_de_genes(expr: DataFrame, value: str, group: str, batch: str | None = None, f_fdr: float = 0.01, pair_fdr: float = 0.01, pair_diff: float = 1.0, use_kruskal: bool = False, f_only: bool = False, specific: bool = False, per_group: int | None = None, gene: str = GENE, m: DataFrame | None = None, r: DataFrame | None = None) -> DataFrame:
    """The variance-analysis table of all genes with the flag ``significant``.

    Genes without any value > 0 are dropped.  Adjusted p-values over non-null ones.
    Fewer than two groups raise.  Moments and rank sums (rows per gene and group)
    are made once, in two passes over the cells, and kept in the shared folder;
    ``m`` and ``r`` hand in those made before.
    """
    expr = expr.filter(F.col(group).isNotNull())
    if expr.select(group).distinct().limit(2).count() < 2:
        raise ValueError("at least two groups are needed")
    if per_group:
        cells = downsample_per_group(expr.select("cell_id", group).distinct(), [group], "cell_id", per_group)
        expr = expr.join(cells.select("cell_id"), "cell_id", "left_semi")
    if m is None:
        m = cut_lineage(moments(expr, value, [group], gene, positive=True))
    if r is None:
        r = cut_lineage(rank_sums(expr, value, group, gene))
    some = m.groupBy(gene).agg(F.max("n_positive").alias("p")).filter("p > 0").select(gene)
    m, r = m.join(some, gene, "left_semi"), r.join(some, gene, "left_semi")
    f = (aov_batch(expr.join(some, gene, "left_semi"), value, group, batch, gene) if batch else aov(expr, value, group, gene, m)).select(gene, "f_stat", "f_pvalue")
    out = f.join(kruskal(expr, value, group, gene, r).select(gene, "h_stat", "kruskal_pvalue"), gene, "left")
    if not f_only:
        pairs = cut_lineage(kruskal_posthoc(expr, value, group, gene, r) if use_kruskal else tukey_hsd(expr, value, group, batch, gene, m))  # rows per gene and pair, used three times
        out = out.join(best_pair(pairs, gene), gene, "left").join(top_pair_test(pairs, top_two_groups(expr, value, group, gene, m), gene), gene, "left")
        if specific:
            out = out.join(specific_groups(pairs, pair_fdr, gene), gene, "left")
    out = bh_adjust(bh_adjust(out, "f_pvalue", out="f_adjp"), "kruskal_pvalue", out="kruskal_adjp")
    first = F.col("kruskal_adjp" if use_kruskal else "f_adjp") < f_fdr
    sig = first if f_only else first & (F.col("min_padj") < pair_fdr) & (F.abs("min_padj_diff") >= pair_diff)
    return out.withColumn("significant", F.coalesce(sig, F.lit(False)))


def rank_test_p(rank_sum: Column, n1: Column, n0: Column, ties: Column) -> Column:
    """Two-sided rank-sum p by the normal approximation with tie and continuity correction."""
    n1, n0 = n1.cast("double"), n0.cast("double")
    n = n1 + n0
    u = rank_sum - n1 * (n1 + 1) / 2
    d = u - n1 * n0 / 2
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - ties / F.nullif(n * (n - 1), F.lit(0.0))))
    return udfs.norm_sf2((d - F.signum(d) * 0.5) / F.nullif(sd, F.lit(0.0)))


def marker_auc(expr: DataFrame, value: str, group: str, by: str = "mean", gene: str = GENE, m: DataFrame | None = None, r: DataFrame | None = None) -> DataFrame:
    """(gene, cluster, auc, u_stat, n1, n0, tie_sum, rank_sum): the group of highest mean / median / mean rank against the rest.

    A tie for the highest: AUC -1 and the first group.
    """
    r = rank_sums(expr, value, group, gene) if r is None else r
    x = nan_to_null(F.col(value))
    if by == "mean":
        m = moments(expr, value, [group], gene) if m is None else m
        r = r.join(m.select(gene, group, F.col("mean").alias("score")), [gene, group])
    elif by == "median":
        r = r.join(expr.groupBy(gene, group).agg(F.median(x).alias("score")), [gene, group])
    elif by == "rank":
        r = r.withColumn("score", F.col("rank_sum") / F.col("n_group"))
    else:
        raise ValueError(f"unknown method {by!r}")
    r = r.withColumn("score", F.round("score", 12))
    w = Window.partitionBy(gene)
    top = F.max("score").over(w)
    r = r.withColumn("n_top", F.sum((F.col("score") == top).cast("int")).over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("score"), group))).filter("rn = 1")
    n1, n0 = F.col("n_group"), F.col("n_total") - F.col("n_group")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    tie = F.col("n_top") > 1
    return r.select(gene, F.col(group).alias("cluster"), F.when(tie, F.lit(-1.0)).otherwise(u / F.nullif(n1 * n0, F.lit(0))).alias("auc"), u.alias("u_stat"), n1.alias("n1"), n0.alias("n0"), "tie_sum", "rank_sum", tie.alias("tied"))


def marker_test(expr: DataFrame, value: str, group: str, by: str = "mean", gene: str = GENE, m: DataFrame | None = None, r: DataFrame | None = None) -> DataFrame:
    """marker_auc with the two-sided rank-sum p: exact for both sides under 50 without ties, else normal; 1 on a tie."""
    a = marker_auc(expr, value, group, by, gene, m, r)
    normal = rank_test_p(F.col("rank_sum"), F.col("n1"), F.col("n0"), F.col("tie_sum"))
    a = a.withColumn("p_normal", normal)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            small = (pdf["n1"] < 50) & (pdf["n0"] < 50) & (pdf["tie_sum"] == 0) & (pdf["n0"] > 0)
            p = pdf["p_normal"].astype(float).to_numpy(copy=True)
            for i in np.flatnonzero(small.to_numpy()):
                p[i] = special.wilcoxon_exact_p(float(pdf["u_stat"].iloc[i]), int(pdf["n1"].iloc[i]), int(pdf["n0"].iloc[i]))
            p[pdf["tied"].to_numpy(bool)] = 1.0
            yield pd.DataFrame({gene: pdf[gene], "cluster": pdf["cluster"], "auc": pdf["auc"], "score_p_value": p})

    kinds = dict(a.dtypes)
    return a.mapInPandas(run, f"{gene} {kinds[gene]}, cluster {kinds['cluster']}, auc double, score_p_value double")


def marker_genes(expr: DataFrame, value: str, group: str, batch: str | None = None, binary: str | None = None, per_group: int | None = None, f_fdr: float = 0.01, pair_fdr: float = 0.01, pair_diff: float = 1.0, use_kruskal: bool = False, by: str = "mean", keep_all: bool = False, gene: str = GENE) -> tuple[DataFrame, DataFrame]:
    """(markers, group statistics long): expressed genes with AUC, variance analysis, and q over the significant ones only."""
    from cellorium.operators.groupstats import expressed_fraction, expressed_genes, group_mean_sd

    if per_group:
        cells = downsample_per_group(expr.select("cell_id", group).distinct(), [group], "cell_id", per_group)
        expr = expr.join(cells.select("cell_id"), "cell_id", "left_semi")
    expr = expr.join(expressed_genes(expr, value, gene).select(gene), gene, "left_semi")
    kept = expr.filter(F.col(group).isNotNull())
    m, r = cut_lineage(moments(kept, value, [group], gene, positive=True)), cut_lineage(rank_sums(kept, value, group, gene))
    table = marker_test(kept, value, group, by, gene, m, r).join(find_de_genes(kept, value, group, batch, f_fdr, pair_fdr, pair_diff, use_kruskal, gene=gene, m=m, r=r), gene)
    if not keep_all:
        table = table.filter("significant")
    table = bh_adjust(table, "score_p_value", out="score_q_value")
    stats = group_mean_sd(expr, value, group, gene)
    if binary:
        stats = stats.join(expressed_fraction(expr, binary, group, gene), [gene, group])
    return table.orderBy("cluster", F.desc("auc"), gene), stats


def one_vs_rest(expr: DataFrame, value: str, group: str, gene: str = GENE) -> DataFrame:
    """(gene, cluster, n_case, n_control, mean_case, mean_control, ss_case, ss_control) for every group at once.

    The rest is the total minus the group: one pass over the cells however many
    groups there are.
    """
    m = moments(expr.filter(F.col(group).isNotNull()), value, [group], gene)
    w = Window.partitionBy(gene)
    m = m.withColumn("n_all", F.sum("n_group").over(w)).withColumn("grand", F.sum(F.col("n_group") * F.col("mean")).over(w) / F.col("n_all"))
    m = m.withColumn("dev", F.sum(F.col("ss") + F.col("n_group") * F.pow(F.col("mean") - F.col("grand"), 2)).over(w))
    n0 = F.nullif(F.col("n_all") - F.col("n_group"), F.lit(0))
    m0 = (F.col("grand") * F.col("n_all") - F.col("mean") * F.col("n_group")) / n0
    ss0 = F.greatest(F.col("dev") - F.col("ss") - F.col("n_group") * F.pow(F.col("mean") - F.col("grand"), 2) - n0 * F.pow(m0 - F.col("grand"), 2), F.lit(0.0))
    return m.select(gene, F.col(group).alias("cluster"), F.col("n_group").alias("n_case"), n0.alias("n_control"), F.col("mean").alias("mean_case"), m0.alias("mean_control"), F.col("ss").alias("ss_case"), ss0.alias("ss_control"))


def naive_t(v: DataFrame) -> DataFrame:
    """Add log_fc, sd_case, sd_control, t_stat and df of the two-sample t test with pooled variance."""
    n1, n0 = F.col("n_case"), F.col("n_control")
    df = n1 + n0 - 2
    s2 = (F.col("ss_case") + F.col("ss_control")) / F.nullif(df, F.lit(0))
    se = F.sqrt(s2 * (1 / n1 + 1 / n0))
    sd = lambda ss, n: F.when(n > 1, F.sqrt(F.col(ss) / (n - 1)))
    return v.withColumn("log_fc", F.col("mean_case") - F.col("mean_control")).withColumn("sd_case", sd("ss_case", n1)).withColumn("sd_control", sd("ss_control", n0)).withColumn("t_stat", F.col("log_fc") / F.nullif(se, F.lit(0.0))).withColumn("df", df)


def naive_de(expr: DataFrame, value: str, group: str, fdr: float = 0.05, least_fc: float = 1.0, gene: str = GENE) -> DataFrame:
    """Every group against the rest: log_fc, t, p, rank-sum p, both adjusted inside each group, flag ``significant``."""
    v = naive_t(one_vs_rest(expr, value, group, gene)).withColumn("p_value", udfs.t_sf2(F.col("t_stat"), F.col("df")))
    r = rank_sums(expr.filter(F.col(group).isNotNull()), value, group, gene)
    r = r.select(gene, F.col(group).alias("cluster"), rank_test_p(F.col("rank_sum"), F.col("n_group"), F.col("n_total") - F.col("n_group"), F.col("tie_sum")).alias("wilcox_p_value"))
    v = v.join(r, [gene, "cluster"]).drop("ss_case", "ss_control")
    v = bh_adjust(bh_adjust(v, "p_value", ["cluster"], "adj_p_value"), "wilcox_p_value", ["cluster"], "wilcox_adj_p_value")
    return v.withColumn("significant", F.coalesce((F.col("adj_p_value") < fdr) & (F.abs("log_fc") > least_fc), F.lit(False)))


def level_order(levels: Sequence[str], target: str | None = None) -> tuple[list[str], str]:
    """Levels with ``_control`` first and the target last; ``"a:b"`` means level a shown as b."""
    shown = target
    if target and ":" in target and target not in levels:
        target, shown = target.split(":", 1)
    rest = sorted(x for x in levels if x not in ("_control", target))
    order = (["_control"] if "_control" in levels else []) + rest
    if target is None:
        target = shown = order[-1]
        order = order[:-1]
    return order + [target], shown or target


def _designs(layout: set[tuple[str, str]], targets: Sequence[str | None], as_two: bool, batched: bool) -> list[tuple[str, str, list[str], list[str]]]:
    """(target, shown, levels, modelled batches) of each comparison; ``layout`` are the (group, batch) pairs with cells."""
    names, batches = sorted({g for g, _ in layout}), sorted({b for _, b in layout})
    if len(names) < 2:
        raise ValueError("at least two groups are needed")
    out = []
    for t in targets:
        levels, shown = level_order(names, t)
        tg = levels[-1]
        mine = {b for g, b in layout if g == tg}
        only = len(mine) == 1 and not any(b in mine and g != tg for g, b in layout)
        cols = [b for b in batches[1:] if not (only and b in mine)] if batched else []
        out.append((tg, shown, ["", tg] if as_two else levels, cols))
    return out


def linear_fits(expr: DataFrame, value: str, group: str, targets: Sequence[str | None], batch: str | None = None, as_two: bool = False, include_baseline: bool = False, gene: str = GENE) -> DataFrame:
    """(gene, cluster, log_fc, ave_expr, s2, df, u) of the contrast of every target, from one pass over the cells.

    The moments of (gene, group, batch) hold all that the fits of any number of
    targets need.  ``as_two``: the target against all other groups as one level.
    The layout (groups x batches) is collected, a short list.
    """
    e = expr.filter(F.col(group).isNotNull()).withColumn("__b", F.coalesce(F.col(batch).cast("string"), F.lit("")) if batch else F.lit(""))
    layout = {(r["g"], r["b"]) for r in e.select(F.col(group).cast("string").alias("g"), F.col("__b").alias("b")).distinct().collect()}
    designs = _designs(layout, targets, as_two, batch is not None)
    m = moments(e, value, [group, "__b"], gene)
    packed = m.groupBy(gene).agg(F.collect_list(F.struct(F.col(group).cast("string").alias("g"), F.col("__b").alias("b"), F.col("n_group").alias("n"), F.col("mean").alias("m"), "ss")).alias("r"))

    def one(rows: list, design: tuple) -> tuple | None:
        tg, _, levels, cols = design
        x = np.zeros((len(rows), len(levels) + len(cols)))
        x[:, 0] = 1
        for i, r in enumerate(rows):
            at = int(r["g"] == tg) if as_two else levels.index(r["g"])
            if at:
                x[i, at] = 1
            if r["b"] in cols:
                x[i, len(levels) + cols.index(r["b"])] = 1
        n = np.array([r["n"] for r in rows], float)
        y = np.array([r["m"] for r in rows], float)
        xtx = (x * n[:, None]).T @ x
        inv = np.linalg.pinv(xtx)
        beta = inv @ (x.T @ (n * y))
        df = n.sum() - np.linalg.matrix_rank(xtx)
        rss = (n * (y - x @ beta) ** 2).sum() + sum(r["ss"] for r in rows)
        c = np.zeros(x.shape[1])
        c[len(levels) - 1] = 1
        if len(levels) > 2:
            c[1 : len(levels) - 1] = -1.0 / (len(levels) - 2 + include_baseline)
        if not (df > 0 and rss > 0):
            return None
        return float(c @ beta), float((n * y).sum() / n.sum()), float(rss / df), float(df), float(np.sqrt(max(c @ inv @ c, 0)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(g, d[1], *fit) for g, rows in zip(pdf[gene], pdf["r"]) for d in designs if (fit := one(rows, d))]
            yield pd.DataFrame(out, columns=[gene, "cluster", "log_fc", "ave_expr", "s2", "df", "u"])

    return packed.mapInPandas(run, f"{gene} {dict(expr.dtypes)[gene]}, cluster string, log_fc double, ave_expr double, s2 double, df double, u double")


def moderated(fits: DataFrame, fdr: float = 0.05, least_fc: float = 1.0, gene: str = GENE) -> DataFrame:
    """Moderated t, p, adjusted p and log odds of every cluster's fits; the prior of a cluster is fitted on its table of genes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(gene)
        s2, df, u = (pdf[c].to_numpy(float) for c in ("s2", "df", "u"))
        d0, s02 = fit_prior(s2, df)
        post = s2 if not np.isfinite(s02) else np.full_like(s2, s02) if np.isinf(d0) else (d0 * s02 + df * s2) / (d0 + df)
        dft = np.minimum(df + (d0 if np.isfinite(d0) else 1e10), max(float(df.sum()), 1.0))
        with np.errstate(all="ignore"):
            t = np.where((post > 0) & (u > 0), pdf["log_fc"].to_numpy(float) / np.sqrt(post) / u, np.nan)
            r = (u**2 + prior_variance(pdf, d0, s02)) / u**2
            b = np.log(0.01 / 0.99) - np.log(r) / 2 + (1 + dft) / 2 * np.log((t**2 + dft) / (t**2 / r + dft))
        return pdf[[gene, "cluster", "log_fc", "ave_expr"]].assign(t_stat=t, p_value=special.t_sf2(t, dft), b_stat=b)

    kind = dict(fits.dtypes)[gene]
    t = fits.groupBy("cluster").applyInPandas(run, f"{gene} {kind}, cluster string, log_fc double, ave_expr double, t_stat double, p_value double, b_stat double")
    t = t.select(gene, "cluster", *[nan_to_null(F.col(c)).alias(c) for c in ("log_fc", "ave_expr", "t_stat", "p_value", "b_stat")])
    t = bh_adjust(t, "p_value", ["cluster"], "adj_p_value")
    sig = F.coalesce((F.col("adj_p_value") < fdr) & (F.abs("log_fc") > least_fc), F.lit(False))
    return t.select(gene, "cluster", "log_fc", "ave_expr", "t_stat", "p_value", "adj_p_value", "b_stat", sig.alias("significant"))


def limma(expr: DataFrame, value: str, group: str, target: str | None = None, batch: str | None = None, include_baseline: bool = False, fdr: float = 0.05, least_fc: float = 1.0, per_group: int | None = None, stats_over: float | None = None, gene: str = GENE) -> DataFrame:
    """Moderated t test of the target group, by moments of (group, batch) cells.

    Two levels: the target's coefficient.  More: the coefficient minus the mean of
    the other coefficients, where the first level has none; ``include_baseline``
    counts it as 0.  A batch that holds only target cells while the target lives in
    no other is not modelled.  Genes with missing values or no variance are left
    out.  The prior (d0, s0^2) is fitted on the gene-level table.
    Columns: gene, cluster, log_fc, ave_expr, t_stat, p_value, adj_p_value, b_stat, significant;
    with ``stats_over`` also the target's mean, sd, length, freq (share over it) and snr.
    ``per_group``: at most that many cells of each group, in hash order.
    """
    if per_group:
        cells = downsample_per_group(expr.filter(F.col(group).isNotNull()).select("cell_id", group).distinct(), [group], "cell_id", per_group)
        expr = expr.join(cells.select("cell_id"), "cell_id", "left_semi")
    out = moderated(linear_fits(expr, value, group, [target], batch, False, include_baseline, gene), fdr, least_fc, gene)
    if stats_over is not None:
        prof = group_profile(expr.filter(F.col(group).isNotNull()), value, group, stats_over, gene=gene)
        mine = (target.split(":", 1)[0] if target and ":" in target else target) if target else None
        named = prof.withColumn("__g", F.col(group).cast("string"))
        out = out.join(named.filter(F.col("__g") == mine).drop(group, "__g") if mine else named.withColumnRenamed("__g", "cluster").drop(group), gene if mine else [gene, "cluster"], "left")
    return out


def fit_prior(s2: np.ndarray, df: np.ndarray) -> tuple[float, float]:
    """(d0, s0^2) of the scaled inverse chi-squared prior by moments of log s^2."""
    ok = (s2 > 0) & (df > 0)
    if ok.sum() < 2:
        return 0.0, float(s2[ok].mean()) if ok.any() else np.nan
    half = df[ok] / 2
    e = np.log(s2[ok]) - special.digamma(half) + np.log(half)
    extra = e.var(ddof=1) - special.trigamma(half).mean()
    if extra <= 0:
        return np.inf, float(np.exp(e.mean()))
    d0 = 2 * special.trigamma_inverse(float(extra))
    return float(d0), float(np.exp(e.mean() + special.digamma(d0 / 2) - np.log(d0 / 2)))


def prior_variance(fits: pd.DataFrame, d0: float, s02: float, share: float = 0.01) -> float:
    """Prior variance of a true effect in units of the error variance, from the most extreme genes (our estimate)."""
    if not len(fits) or not np.isfinite(s02) or s02 <= 0:
        return 1.0
    u2 = fits["u"].to_numpy() ** 2
    t2 = fits["log_fc"].to_numpy() ** 2 / np.maximum(s02 * u2, 1e-300)
    top = np.argsort(-t2)[: max(1, int(np.ceil(share * len(t2))))]
    return float(np.clip(np.mean(u2[top] * np.maximum(t2[top] - 1, 0)), 0.01 / s02, 16 / s02))


def remove_batch_coefficients(expr: DataFrame, value: str, group: str, batch: str, out: str, gene: str = GENE) -> DataFrame:
    """value minus the batch effects of the additive group + batch model of its gene."""
    m = moments(expr, value, [group, batch], gene)
    packed = m.groupBy(gene).agg(F.collect_list(F.struct(F.col(group).cast("string").alias("g"), F.col(batch).cast("string").alias("b"), F.col("n_group").alias("n"), F.col("mean").alias("m"))).alias("r"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows_out = []
            for g, rows in zip(pdf[gene], pdf["r"]):
                gs, bs = sorted({r["g"] for r in rows}), sorted({r["b"] for r in rows})
                x = np.zeros((len(rows), len(gs) + len(bs) - 1))
                for i, r in enumerate(rows):
                    x[i, gs.index(r["g"])] = 1
                    if bs.index(r["b"]):
                        x[i, len(gs) + bs.index(r["b"]) - 1] = 1
                w = np.sqrt(np.array([r["n"] for r in rows], float))
                beta = np.linalg.lstsq(x * w[:, None], np.array([r["m"] for r in rows]) * w, rcond=None)[0]
                rows_out += [(g, b, float(beta[len(gs) + j - 1]) if j else 0.0) for j, b in enumerate(bs)]
            yield pd.DataFrame(rows_out, columns=[gene, "__bb", "__eff"])

    eff = packed.mapInPandas(run, f"{gene} {dict(expr.dtypes)[gene]}, __bb string, __eff double")
    return expr.withColumn("__bb", F.col(batch).cast("string")).join(eff, [gene, "__bb"], "left").withColumn(out, F.col(value) - F.coalesce("__eff", F.lit(0.0))).drop("__bb", "__eff")


def group_profile(expr: DataFrame, value: str, group: str, threshold: float = 0.3, use_z: bool = True, gene: str = GENE) -> DataFrame:
    """(gene, group, mean, mean_scale, sd, length, freq, snr): snr = (mean - mean of the rest) / sum of both sd."""
    from cellorium.operators.groupstats import pseudobulk
    from cellorium.operators.relational import zscore

    x = nan_to_null(F.col(value))
    z = zscore(expr, [gene], value, "__z")
    over = F.col("__z") if use_z else x
    s = z.groupBy(gene, group).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("length"), F.avg((over > threshold).cast("double")).alias("freq"))
    s = s.join(pseudobulk(expr, value, [group], "zscore", gene).withColumnRenamed("avg", "mean_scale"), [gene, group])
    v = naive_t(one_vs_rest(expr, value, group, gene)).select(gene, F.col("cluster").alias(group), (F.col("log_fc") / F.nullif(F.col("sd_case") + F.col("sd_control"), F.lit(0.0))).alias("snr"))
    return s.join(v, [gene, group])


def de_genes(expr: DataFrame, value: str, group: str, groups: Sequence[str] | None = None, batch: str | None = None, mode: str = "multiAsTwo", method: str = "limma", fdr: float = 0.01, least_fc: float = 1.0, threshold: float = 0.3, per_group: int | None = None, gene: str = GENE) -> DataFrame:
    """One table for all groups with F rank: mode ``multi`` (target against the other levels) or ``multiAsTwo`` (against the rest, with Fisher's test of the expressing shares).

    The contrasts of all groups come from one table of moments.  ``per_group``: at most that many cells of each group, in hash order.
    """
    e = expr.filter(F.col(group).isNotNull())
    if per_group:
        cells = downsample_per_group(e.select("cell_id", group).distinct(), [group], "cell_id", per_group)
        e = e.join(cells.select("cell_id"), "cell_id", "left_semi")
    groups = list(groups or [r[0] for r in e.select(group).distinct().orderBy(group).collect()])
    f = find_de_genes(e, value, group, batch, f_only=True, gene=gene)
    f = fractional_rank(f, [], "f_stat", "f_rank").select(gene, "f_stat", "f_pvalue", "f_adjp", "f_rank")
    if method == "lm":
        table = naive_de(e, value, group, fdr, least_fc, gene).filter(F.col("cluster").isin(groups))
    elif method == "limma":
        names = [str(g) for g in groups]
        table = moderated(linear_fits(e, value, group, names, batch, mode == "multiAsTwo", gene=gene), fdr, least_fc, gene)
    else:
        raise ValueError(f"unknown method {method!r}")
    if mode == "multiAsTwo":
        table = table.join(fisher_expressing(e, value, group, threshold, gene), [gene, "cluster"], "left")
    tcol = "t_stat"
    return table.join(f, gene).orderBy("cluster", F.asc_nulls_last("adj_p_value"), F.desc_nulls_last(tcol), F.desc_nulls_last("log_fc"), gene)


def expressing_counts(expr: DataFrame, value: str, group: str, threshold: float = 0.3, gene: str = GENE) -> DataFrame:
    """(gene, cluster, a, b, c, d): cells over the threshold and not over it, in the group and in the rest."""
    x = nan_to_null(F.col(value))
    over = (x > threshold).cast("long")
    m = expr.groupBy(gene, group).agg(F.sum(over).alias("a"), (F.count(x) - F.sum(over)).alias("b"))
    w = Window.partitionBy(gene)
    return m.withColumn("c", F.sum("a").over(w) - F.col("a")).withColumn("d", F.sum("b").over(w) - F.col("b")).withColumnRenamed(group, "cluster")


def fisher_expressing(expr: DataFrame, value: str, group: str, threshold: float = 0.3, gene: str = GENE) -> DataFrame:
    """(gene, cluster, a, b, c, d, odds_ratio, or_p_value, or_adj_p_value): cells over the threshold in the group and the rest."""
    m = expressing_counts(expr, value, group, threshold, gene)
    m = m.withColumn("__f", udfs.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    m = m.withColumn("odds_ratio", F.col("__f.odds_ratio")).withColumn("or_p_value", F.col("__f.p_value")).drop("__f")
    return bh_adjust(m, "or_p_value", ["cluster"], "or_adj_p_value")


def effect_size(v: DataFrame) -> DataFrame:
    """Add dprime and vardprime (Cohen's d with pooled sd, and its variance; our definition) to one-vs-rest moments."""
    n1, n0 = F.col("n_case"), F.col("n_control")
    s = F.sqrt((F.col("ss_case") + F.col("ss_control")) / F.nullif(n1 + n0 - 2, F.lit(0)))
    d = (F.col("mean_case") - F.col("mean_control")) / F.nullif(s, F.lit(0.0))
    return v.withColumn("dprime", d).withColumn("vardprime", (n1 + n0) / (n1 * n0) + d * d / (2 * (n1 + n0)))


def combine_effects(study: DataFrame, by: Sequence[str], d: str = "dprime", v: str = "vardprime") -> DataFrame:
    """(by..., es_combi, es_combi_sd, es_combi_z, es_combi_p): inverse-variance combination over studies (our definition)."""
    ok = study.filter(F.col(d).isNotNull() & (F.col(v) > 0))
    a = ok.groupBy(*by).agg(F.sum(F.col(d) / F.col(v)).alias("s"), F.sum(1 / F.col(v)).alias("w"))
    a = a.select(*by, (F.col("s") / F.col("w")).alias("es_combi"), (1 / F.sqrt("w")).alias("es_combi_sd"))
    a = a.withColumn("es_combi_z", F.col("es_combi") / F.col("es_combi_sd"))
    return a.withColumn("es_combi_p", udfs.norm_sf2(F.col("es_combi_z")))
