"""Per-gene statistics over groups of cells; long results, pivoted only on request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellorium.operators.relational import nan_to_null, with_group_columns, zscore


def gene_moments(expr: DataFrame, value: str, gene: str = "gene_id") -> DataFrame:
    """(gene, row_mean, row_sd, n): null and NaN skipped; sd of fewer than two values null."""
    x = nan_to_null(F.col(value))
    return expr.groupBy(gene).agg(F.avg(x).alias("row_mean"), F.stddev_samp(x).alias("row_sd"), F.count(x).alias("n"))


def sparse_gene_moments(expr: DataFrame, value: str, n_cells: int, gene: str = "gene_id") -> DataFrame:
    """Mean and sd over all ``n_cells`` where absent rows are zeros."""
    x = nan_to_null(F.col(value))
    m = expr.groupBy(gene).agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    mean = F.col("s") / F.lit(n_cells)
    var = F.greatest((F.col("q") - F.lit(n_cells) * mean * mean) / F.lit(max(n_cells - 1, 1)), F.lit(0.0))
    return m.select(gene, mean.alias("row_mean"), F.sqrt(var).alias("row_sd"))


def cell_sd(expr: DataFrame, value: str, cell: str = "cell_id") -> DataFrame:
    x = nan_to_null(F.col(value))
    return expr.groupBy(cell).agg(F.stddev_samp(x).alias("cell_sd"))


def drop_flat_genes(expr: DataFrame, value: str, gene: str = "gene_id", n_cells: int | None = None) -> DataFrame:
    """Genes without nulls and with sd > 0.

    ``n_cells``: the number of cells of a sparse set, whose absent rows are zeros
    (one row for a gene and cell); without it every cell has a row.
    """
    x = nan_to_null(F.col(value))
    m = expr.groupBy(gene).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"), F.count(F.lit(1)).alias("n_all"))
    absent = F.lit(0) if n_cells is None else F.lit(n_cells) - F.col("n_all")
    lo, hi = F.when(absent > 0, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")), F.when(absent > 0, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))
    return m.filter((hi > lo) & (F.col("n") == F.col("n_all"))).select(gene)


def genes_varying_in_both(expr: DataFrame, value: str, is_train: str, gene: str = "gene_id") -> DataFrame:
    """Genes with sd > 0 in the training and in the other cells."""
    x = nan_to_null(F.col(value))
    m = expr.groupBy(gene).agg(F.stddev_samp(F.when(F.col(is_train), x)).alias("a"), F.stddev_samp(F.when(~F.col(is_train), x)).alias("b"))
    return m.filter((F.col("a") > 0) & (F.col("b") > 0)).select(gene)


def expressed_genes(expr: DataFrame, value: str, gene: str = "gene_id", more_than: int = 5, share: float = 0.01, n_cells: int | None = None) -> DataFrame:
    """Genes with value > 0 in more than ``more_than`` cells and in more than ``share`` of all cells (both strict).

    ``n_cells``: the number of cells of a sparse set; without it every cell has a row.  Null and NaN are not > 0.
    """
    x = nan_to_null(F.col(value))
    m = expr.groupBy(gene).agg(F.coalesce(F.sum((x > 0).cast("long")), F.lit(0)).alias("n_pos"), (F.count(F.lit(1)) if n_cells is None else F.lit(n_cells).cast("long")).alias("n_cells"))
    return m.filter((F.col("n_pos") > more_than) & (F.col("n_pos") / F.col("n_cells") > share))


def group_mean_sd(expr: DataFrame, value: str, group: str, gene: str = "gene_id") -> DataFrame:
    """(gene, group, avg, sd, n)."""
    x = nan_to_null(F.col(value))
    return expr.groupBy(gene, group).agg(F.avg(x).alias("avg"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"))


def widen(long: DataFrame, gene: Sequence[str], group: str, levels: Sequence, stats: dict[str, str]) -> DataFrame:
    """One column ``<prefix>.<level>`` for each level and statistic; an explicit list keeps it one pass."""
    cols = [F.max(F.when(F.col(group) == F.lit(lv), F.col(stat))).alias(f"{prefix}.{lv}") for prefix, stat in stats.items() for lv in levels]
    return long.groupBy(*gene).agg(*cols)


def expressed_fraction(expr: DataFrame, binary: str, group: str, gene: str = "gene_id") -> DataFrame:
    """Share of cells of a group with binary value 1."""
    return expr.groupBy(gene, group).agg(F.avg((F.col(binary) == 1).cast("double")).alias("hi_frac"))


def hi_expressor_mean(expr: DataFrame, binary: str, value: str, group: str, gene: str = "gene_id") -> DataFrame:
    """Mean of ``value`` over the cells with binary value 1; null where there is none."""
    hi = F.col(binary) == 1
    return expr.groupBy(gene, group).agg((F.sum(F.when(hi, F.col(value))) / F.nullif(F.sum(hi.cast("long")), F.lit(0))).alias("avg_hi_expr"))


def sparse_group_stats(expr: DataFrame, value: str, cells: DataFrame, group: str, threshold: float, gene: str = "gene_id", cell: str = "cell_id") -> DataFrame:
    """(gene, group, mean, sd, length, freq) over all cells of a group where absent rows are zeros.

    Group sizes come from ``cells`` (one row for a cell); a gene and a group without
    a row in common still come out.  Null and NaN values are left out of their group's
    length.  Cells without a group and rows of other cells do not count.
    """
    known = cells.filter(F.col(group).isNotNull()).select(cell, F.col(group).alias("__g"))
    size = known.groupBy("__g").agg(F.count(F.lit(1)).alias("size"))
    x = nan_to_null(F.col(value))
    got = expr.select(F.col(gene).alias("__gene"), F.col(cell).alias("__c"), x.alias("__x")).join(known, F.col("__c") == F.col(cell))
    got = got.groupBy("__gene", "__g").agg(F.sum("__x").alias("s"), F.sum(F.col("__x") * F.col("__x")).alias("q"), F.count(F.when(F.col("__x").isNull(), 1)).alias("bad"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("__x") > threshold, 1)).alias("over"))
    wide = got.groupBy("__gene").agg(F.map_from_entries(F.collect_list(F.struct("__g", F.struct("s", "q", "bad", "rows", "over")))).alias("m"))  # a few groups a gene
    sizes = [(r["__g"], r["size"]) for r in size.collect()]  # one row for a group
    every = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(n).alias("size")) for g, n in sizes])) if sizes else F.explode(F.array().cast(f"array<struct<g:{dict(known.dtypes)['__g']},size:bigint>>"))
    t = wide.select("__gene", "m", every.alias("e")).select("__gene", "e.*", F.try_element_at("m", F.col("e.g")).alias("x"))
    v = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(0))
    n = F.col("size") - v("bad")
    mean = v("s") / F.nullif(n, F.lit(0))
    var = F.greatest((v("q") - n * mean * mean) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
    zeros = F.when(F.lit(threshold) < 0, F.col("size") - v("rows")).otherwise(F.lit(0))
    return t.select(F.col("__gene").alias(gene), F.col("g").alias(group), mean.alias("mean"), F.sqrt(var).alias("sd"), n.alias("length"), ((v("over") + zeros) / F.nullif(n, F.lit(0))).alias("freq"))


def group_stats(expr: DataFrame, value: str, group: str, threshold: float, gene: str = "gene_id") -> DataFrame:
    """(gene, group, mean, sd, length, freq): freq is the share of values over the threshold."""
    x = nan_to_null(F.col(value))
    return expr.groupBy(gene, group).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("length"), F.avg((x > threshold).cast("double")).alias("freq"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def error_rates(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Error rate of each class and, with a null class, over all."""
    wrong = (~F.col(actual).eqNullSafe(F.col(predicted))).cast("double")
    return df.groupingSets([[actual], []], actual).agg(F.avg(wrong).alias("error_rate"), F.count(F.lit(1)).alias("n"))


def occurrence(df: DataFrame, gene: str, source: str, least: float) -> DataFrame:
    """Genes found in at least ``least`` sources (a share of all sources if below 1)."""
    pairs = df.select(gene, source).distinct()
    need = least if least >= 1 else least * pairs.select(source).distinct().count()
    return pairs.groupBy(gene).agg(F.count(F.lit(1)).alias("n_sources")).filter(F.col("n_sources") >= need)


def median_rank_filled(df: DataFrame, genes: DataFrame, gene: str, source: str, rank: str, fill: float = 1.0) -> DataFrame:
    """Median over all sources of a gene's rank, ``fill`` where a source lacks it.

    The grid is not built: a gene's absent sources are ``fill`` repeated, appended
    to its short list of ranks.
    """
    k = df.select(source).distinct().count()
    got = df.groupBy(gene).agg(F.collect_list(F.coalesce(F.col(rank), F.lit(fill))).alias("r"))
    full = genes.select(gene).distinct().join(got, gene, "left").withColumn("r", F.coalesce("r", F.array().cast("array<double>")))
    s = F.sort_array(F.concat("r", F.array_repeat(F.lit(fill), F.greatest(F.lit(k) - F.size("r"), F.lit(0)))))
    full = full.withColumn("s", s)
    mid = F.size("s") / 2
    med = F.when(F.size("s") % 2 == 1, F.get("s", F.floor(mid).cast("int"))).otherwise((F.get("s", (mid - 1).cast("int")) + F.get("s", mid.cast("int"))) / 2)
    return full.select(gene, med.alias("median_rank"))


def pseudobulk(expr: DataFrame, value: str, group: Sequence[str], mode: str = "mean", gene: str = "gene_id", over: Sequence[str] = ()) -> DataFrame:
    """(gene, group, avg): mean of the values or of their per-gene z-scores (``over``: z-scores inside these columns).

    The z-score mode is our definition: mean over the group of (x - gene mean) /
    gene sd; genes with zero sd get null.  It needs moments only, no window.
    """
    x = nan_to_null(F.col(value))
    g = expr.groupBy(*over, gene, *[c for c in group if c not in over]).agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count(x).alias("n"))
    if mode == "mean":
        return g.select(*over, gene, *[c for c in group if c not in over], (F.col("s") / F.col("n")).alias("avg"))
    if mode != "zscore":
        raise ValueError(f"unknown mode {mode!r}")
    w = Window.partitionBy(*over, gene)
    n, s, q = F.sum("n").over(w), F.sum("s").over(w), F.sum("q").over(w)
    sd = F.sqrt(F.greatest((q - s * s / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))
    return g.select(*over, gene, *[c for c in group if c not in over], ((F.col("s") / F.col("n") - s / n) / F.nullif(sd, F.lit(0.0))).alias("avg"))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Sum(x w) / sum(w) over rows where x is not null."""
    x = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))


def remove_batch_effect(expr: DataFrame, value: str, batch: str, out: str, gene: str = "gene_id") -> DataFrame:
    """value - (batch mean - grand mean) per gene (our definition of the simple correction)."""
    x = nan_to_null(F.col(value))
    m = expr.groupBy(gene, batch).agg(F.avg(x).alias("__mb"), F.sum(x).alias("__s"), F.count(x).alias("__n"))
    w = Window.partitionBy(gene)  # over batches of a gene, a few rows
    m = m.withColumn("__off", F.sum("__s").over(w) / F.sum("__n").over(w) - F.col("__mb")).select(gene, batch, "__off")
    return with_group_columns(expr, m, [gene, batch]).withColumn(out, x + F.col("__off")).drop("__off")


def module_score(expr: DataFrame, value: str, signature: DataFrame, gene: str = "gene_id", cell: str = "cell_id", module: str = "meta_cluster") -> DataFrame:
    """(cell, module, score): mean z-score of the module's genes minus the mean over all other genes (our definition)."""
    z = zscore(expr, [gene], value, "z")
    whole = z.groupBy(cell).agg(F.sum("z").alias("s_all"), F.count("z").alias("n_all"))
    sig = z.join(signature.select(gene, module).distinct(), gene).groupBy(cell, module).agg(F.sum("z").alias("s"), F.count("z").alias("n"))
    rest = (F.col("s_all") - F.col("s")) / F.nullif(F.col("n_all") - F.col("n"), F.lit(0))
    return sig.join(whole, cell).select(cell, module, (F.col("s") / F.col("n") - F.coalesce(rest, F.lit(0.0))).alias("score"))
