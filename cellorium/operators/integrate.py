"""Integration of several data sets: pseudo-bulk, gene choice, meta-clusters, ranking, meta-analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellorium.exprset import CELL, GENE, ExprSet
from cellorium.functions import udfs
from cellorium.operators import cluster, de, reduce
from cellorium.operators.groupstats import median_rank_filled, occurrence, pseudobulk, weighted_mean
from cellorium.operators.relational import bh_adjust, common_keys, dedup_first, downsample_per_group, fractional_rank, max_companion, top_k_per_group, zscore
from cellorium.session import cut_lineage


def dataset_of(c: Column) -> Column:
    """The part of an id before its first dot."""
    return F.regexp_extract(c, r"^(.+?)\.", 1)


def dataset_names(n: int) -> list[str]:
    return [f"D{i:02d}" for i in range(1, n + 1)]


def unite(sets: Sequence[ExprSet], names: Sequence[str] | None = None) -> ExprSet:
    """One set with prefixed cells, restricted to the genes all sets share (one aggregation, not a chain of intersects)."""
    names = list(names or dataset_names(len(sets)))
    parts = [s.prefixed(n) for s, n in zip(sets, names)]
    expr, cells = parts[0].expr.withColumn("dataset_id", F.lit(names[0])), parts[0].cells
    genes = parts[0].genes.select(GENE).withColumn("dataset_id", F.lit(names[0]))
    for p, n in zip(parts[1:], names[1:]):
        expr = expr.unionByName(p.expr.withColumn("dataset_id", F.lit(n)), allowMissingColumns=True)
        cells = cells.unionByName(p.cells, allowMissingColumns=True)
        genes = genes.unionByName(p.genes.select(GENE).withColumn("dataset_id", F.lit(n)))
    ok = common_keys(genes, GENE, "dataset_id", len(sets))
    return ExprSet(expr.join(ok, GENE, "left_semi"), sets[0].genes.join(ok, GENE, "left_semi"), cells)


def choose_genes(de_list: DataFrame, genes: DataFrame, by: str = "F.rank.median", threshold: float = 1500, source: str = "dataset_id", rank: str = "f_rank") -> DataFrame:
    """Genes by median F rank over data sets (top n, or under a threshold below 1) or by occurrence; empty: all common genes."""
    if by == "F.rank.median":
        m = median_rank_filled(de_list, genes, GENE, source, rank)
        got = m.filter(F.col("median_rank") < threshold).select(GENE) if threshold < 1 else m.orderBy("median_rank", GENE).limit(int(threshold)).select(GENE)
    elif by == "occurence":
        got = occurrence(de_list, GENE, source, threshold).select(GENE)
    else:
        raise ValueError(f"unknown gene choice {by!r}")
    got = got.join(genes.select(GENE), GENE, "left_semi")
    return got if not got.isEmpty() else genes.select(GENE)


def integrate_by_average(united: ExprSet, avg_by: str, assay: str = "exprs", avg: str = "zscore", is_avg: bool = False, n_downsample: int | None = None, par_clust: dict | None = None, de_list: DataFrame | None = None, gene_by: str = "F.rank.median", gene_threshold: float = 1500, n_pc: int = 15, scale: bool = True, snn_k: int = 3, snn_method: str = "leiden", seed: int = 9997) -> tuple[ExprSet, DataFrame]:
    """(pseudo-bulk set with label column meta_cluster, cluster-to-cluster correlations).

    Pseudo-bulk means per (data set, group) are one aggregation over all cells; what
    follows works on genes x groups.  Without a DE list genes come from the
    marker table of each data set.  ``is_avg``: the columns are averages already and
    taken as they are.  ``n_downsample``: at most that many cells of each group of a
    data set, in hash order.  ``par_clust``: another clustering of the averages, for
    example {"method": "hclust", "ks": [5]}; its first label column is meta_cluster.
    """
    if n_downsample and not is_avg:
        kept = downsample_per_group(united.cells.filter(F.col(avg_by).isNotNull()), ["dataset_id", avg_by], CELL, n_downsample)
        united = united.subset_cells(kept)
    e = united.expr.join(united.cells.select(CELL, avg_by), CELL).filter(F.col(avg_by).isNotNull())
    if de_list is None:
        de_list = None
        for (d,) in united.cells.select("dataset_id").distinct().orderBy("dataset_id").collect():  # data sets, a short list
            f = de.find_de_genes(e.filter(F.col("dataset_id") == d), assay, avg_by, f_only=True)
            part = fractional_rank(f, [], "f_stat", "f_rank").select(GENE, "f_rank", F.lit(d).alias("dataset_id"))
            de_list = part if de_list is None else de_list.unionByName(part)
    genes = choose_genes(de_list, united.genes, gene_by, gene_threshold)
    if is_avg:
        bulk = e.select(GENE, F.col(CELL).cast("string").alias(CELL), F.coalesce(assay, F.lit(0.0)).alias("value"))
    else:
        bulk = pseudobulk(e, assay, ["dataset_id", avg_by], avg, GENE, over=["dataset_id"])
        bulk = bulk.withColumn(CELL, F.concat_ws(".", "dataset_id", F.col(avg_by).cast("string"))).select(GENE, CELL, F.coalesce("avg", F.lit(0.0)).alias("value"))
    columns = bulk.select(CELL).distinct().withColumn("dataset_id", dataset_of(F.col(CELL)))
    bulk = bulk.join(genes, GENE, "left_semi")
    if scale:
        bulk = zscore(bulk, [GENE], "value", "z").select(GENE, CELL, F.coalesce("z", F.lit(0.0)).alias("value"))
    es = ExprSet.from_long(bulk, columns, genes.withColumn("display_name", F.col(GENE)))
    v = es.cell_vectors("exprs").persist()
    scores, info = reduce.pca(v, n_pc)
    es = es.with_embedding("pca", scores.persist()).with_meta(**{"pca.res.pca": info})
    par = {"method": "SNN", "snn_k": snn_k, "snn_method": snn_method, "seed": seed} | (par_clust or {})
    before = set(es.cells.columns)
    es = cluster.clust(es, "pca", **par)
    label = next(c for c in es.cells.columns if c not in before)
    es = es.with_(cells=es.cells.withColumnRenamed(label, "meta_cluster"))
    return es, column_correlations(es.expr, "exprs")


def column_correlations(expr: DataFrame, value: str) -> DataFrame:
    """(cell_a, cell_b, r), Pearson, all pairs of the few pseudo-bulk columns."""
    return reduce.gene_pairs_correlation(expr, value, "pearson")


def correlations_with(expr: DataFrame, value: str, x: str, markers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(correlations with column x sorted descending, long plot data with is_marker)."""
    a = expr.filter(F.col(CELL) == x).select(GENE, F.col(value).alias("x"))
    long = expr.filter(F.col(CELL) != x).join(a, GENE).select(GENE, CELL, "x", F.col(value).alias("y"))
    if markers is not None:
        long = long.join(markers.select(GENE).distinct().withColumn("m", F.lit(True)), GENE, "left").withColumn("is_marker", F.coalesce("m", F.lit(False))).drop("m")
    return long.groupBy(CELL).agg(F.corr("x", "y").alias("r")).orderBy(F.desc_nulls_last("r"), CELL), long


def stouffer(z: str, weight: str) -> tuple[Column, Column]:
    """(aggregate column of the combined z, its two-sided p as a function of that column)."""
    zs = F.sum(F.col(z) * F.col(weight)) / F.nullif(F.sqrt(F.sum(F.when(F.col(z).isNotNull(), F.col(weight) * F.col(weight)))), F.lit(0.0))
    return zs, udfs.norm_sf2(F.col("z_sum"))


def combine_pvalues(p: DataFrame, key: str, study: str, value: str, strict_df: bool = False) -> DataFrame:
    """(key, n_p, p_comb): Fisher's method over the non-null p; none: 1, one: itself.

    The tail of chi-squared with even df is a finite sum, evaluated in the JVM.
    ``strict_df``: a row with some but not all p null has no result and all rows use
    every study's degrees of freedom.
    """
    k = p.select(study).distinct().count() if strict_df else None
    v = F.when(~F.isnan(value), F.col(value))
    a = p.groupBy(key).agg(F.count(v).alias("n_p"), F.sum(-F.log(F.greatest(v, F.lit(1e-300)))).alias("h"), F.max(v).alias("one"))
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_p") - 1, F.lit(1)).cast("int")), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda acc, i: F.struct((acc["t"] * F.col("h") / i).alias("t"), (acc["s"] + acc["t"] * F.col("h") / i).alias("s")))
    tail = F.least(F.lit(1.0), F.exp(-F.col("h")) * terms["s"])
    res = F.when(F.col("n_p") == 0, 1.0).when(F.col("n_p") == 1, F.col("one")).otherwise(F.when(F.lit(k is None) | (F.col("n_p") == F.lit(k or 0)), tail))
    return a.select(key, "n_p", res.alias("p_comb"))


def collapse_studies(study: DataFrame, group_2nd: str, mode: str = "comb", adj_p: float = 0.01, least_d: float = 0.15) -> DataFrame:
    """(meta_cluster, gene_id, group_2nd, dprime, p_value, adj_p, sig): the studies of each second group as one.

    ``comb``: inverse-variance combination with its normal p; ``max``: the study of
    largest dprime (ties by name) with its p.  p is adjusted inside (meta_cluster,
    second group); sig: adj_p < ``adj_p`` and dprime > ``least_d``.
    """
    keys = ["meta_cluster", GENE, group_2nd]
    if mode == "comb":
        one = de.combine_effects(study, keys).select(*keys, F.col("es_combi").alias("dprime"), F.col("es_combi_p").alias("p_value"))
    elif mode == "max":
        ranked = study.withColumn("__o", F.dense_rank().over(Window.partitionBy(*keys).orderBy("study")))
        one = max_companion(ranked, keys, "dprime", ["p_value"], "__o")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    one = bh_adjust(one, "p_value", ["meta_cluster", group_2nd], "adj_p")
    return one.withColumn("sig", F.coalesce((F.col("adj_p") < adj_p) & (F.col("dprime") > least_d), F.lit(False)).cast("int"))


def rank_genes(study: DataFrame, sort_by: str = "median_rank", weight: str | None = None, adj_p: float = 0.01, least_d: float = 0.15, group_2nd: str | None = None, mode_collapse: str = "comb") -> DataFrame:
    """The gene table of every meta-cluster from one long table of studies.

    study: meta_cluster, gene_id, study, dprime, vardprime, t, p_value, adj_p, sig,
    freq_case, freq_control, n_case, n_control, log_fc, mean_scale, z.  All columns are
    aggregates of one groupBy (meta_cluster, gene_id); ranks are per (meta_cluster, study).
    ``group_2nd`` adds counts and the largest effect over second groups, see :func:`collapse_studies`.
    """
    keys = ["meta_cluster", GENE]
    study = cut_lineage(study)  # a row per meta-cluster, gene and study, used three times
    s = fractional_rank(study, ["meta_cluster", "study"], "t", "t_rank")
    s = s.withColumn("w", F.sqrt((F.col("n_case") + F.col("n_control")).cast("double")) * (F.col(weight) if weight else F.lit(1.0)))
    zs, zp = stouffer("z", "w")
    sg = F.coalesce(F.col("sig"), F.lit(0))
    a = s.groupBy(*keys).agg(
        F.sum(sg).alias("n_sig"), F.avg(sg.cast("double")).alias("freq_sig"), F.count(F.lit(1)).alias("n_studies"), F.median("log_fc").alias("median_log_fc"), F.median("mean_scale").alias("median_mean_scale"),
        F.median("t_rank").alias("median_rank"), zs.alias("z_sum"), weighted_mean("freq_case", "n_case").alias("freq_comb"), F.median("freq_case").alias("freq_median"), F.avg("freq_case").alias("freq_mean"),
        F.sum(F.col("freq_case") * F.col("n_case")).alias("a"), F.sum((1 - F.col("freq_case")) * F.col("n_case")).alias("b"), F.sum(F.col("freq_control") * F.col("n_control")).alias("c"), F.sum((1 - F.col("freq_control")) * F.col("n_control")).alias("d"),
    )
    best = max_companion(s.withColumn("__o", F.dense_rank().over(Window.partitionBy(*keys).orderBy("study"))), keys, "dprime", ["p_value", "adj_p"], "__o")
    best = best.withColumnRenamed("dprime", "dprime_max").withColumnRenamed("p_value", "dprime_max_p").withColumnRenamed("adj_p", "dprime_max_adj_p")
    a = a.join(best, keys, "left").withColumn("p_stouffer", zp).withColumn("__f", udfs.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    a = a.withColumn("or_comb", F.coalesce(F.col("__f.odds_ratio"), F.lit(1.0))).withColumn("or_comb_p", F.coalesce(F.col("__f.p_value"), F.lit(1.0))).drop("__f", "a", "b", "c", "d")
    a = a.join(de.combine_effects(study, keys), keys, "left")
    pv = study.select(F.struct(*keys).alias("k"), "study", "p_value")
    fp = combine_pvalues(pv, "k", "study", "p_value").select("k.*", F.col("p_comb").alias("p_fisher"))
    a = a.join(fp, keys)
    for p in ("p_stouffer", "or_comb_p", "p_fisher"):
        a = bh_adjust(a, p, ["meta_cluster"], p + "_adj")
    if group_2nd:
        c = collapse_studies(study, group_2nd, mode_collapse, adj_p, least_d)
        by = F.struct(F.col("dprime"), F.col(group_2nd))
        c = c.groupBy(*keys).agg(F.sum("sig").alias("n_sig_2nd"), F.avg(F.col("sig").cast("double")).alias("freq_sig_2nd"), F.count(F.lit(1)).alias("n_2nd"), F.max("dprime").alias("dprime_max_2nd"), F.max_by("p_value", by).alias("dprime_max_p_2nd"), F.max_by("adj_p", by).alias("dprime_max_adj_p_2nd"))
        a = a.join(c, keys, "left")
    a = a.withColumn("sig_comb", (F.col("es_combi") > least_d) & (F.col("p_stouffer_adj") < adj_p))
    return a.orderBy("meta_cluster", F.asc_nulls_last(sort_by), GENE)


def top_meta_genes(ranked: DataFrame, n: int = 30, least_freq: float = 0.3, most_rank: float = 0.1) -> DataFrame:
    """The first n genes of each meta-cluster that pass both limits; a gene stays with its best meta-cluster."""
    ok = ranked.filter((F.col("freq_sig") > least_freq) & (F.col("median_rank") < most_rank))
    return dedup_first(top_k_per_group(ok, ["meta_cluster"], [F.asc("median_rank"), F.asc(GENE)], n), [GENE], [F.asc("median_rank"), F.asc("meta_cluster")])


def signature_heatmap(expr: DataFrame, value: str, signature: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """(meta_cluster, group, gene_id, avg): mean z of each signature gene per group, the data of a heat map."""
    z = zscore(expr, [GENE], value, "z").join(cells.select(CELL, group), CELL).join(signature.select("meta_cluster", GENE).distinct(), GENE)
    return z.groupBy("meta_cluster", group, GENE).agg(F.avg("z").alias("avg"))


def signature_violin(expr: DataFrame, value: str, signature: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """(meta_cluster, gene_id, cell_id, group, z): the data of violin plots."""
    z = zscore(expr, [GENE], value, "z").join(cells.select(CELL, group), CELL)
    return z.join(signature.select("meta_cluster", GENE).distinct(), GENE).select("meta_cluster", GENE, CELL, group, "z")
