"""The N best rows of every group.

A histogram of scores per group gives a lower threshold above which at least N
rows survive; everything below is dropped before rows of a group come together,
and the survivors are ranked exactly with tie keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellorium.operators.relational import finite
from cellorium.session import cut_lineage

#: Histogram bins for each doubling of 1 + |score|; scores in [0, 1] get this many bins.
RESOLUTION = 48
#: Groups with at least this part of all rows (one in HOT) are hot; there are HOT of them at most.
HOT = 1000


def score_bin(score: Column, resolution: int = RESOLUTION) -> Column:
    """A bin number that never decreases as the score grows, for any finite score."""
    return F.floor(F.signum(score) * F.log2(F.abs(score) + 1.0) * F.lit(float(resolution))).cast("int")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def top_n_per_group(
    df: DataFrame, group: Sequence[str], score: str, ties: Sequence[str], n: int, resolution: int = RESOLUTION
) -> DataFrame:
    """The n rows with the highest ``score`` of each group, with their ``rank`` from 1.

    Order: score descending, then ``ties`` ascending (nulls first), so the result
    is the same for any row order as long as ties identify a row; fully repeated
    rows are interchangeable.  Rows whose score is null, NaN or infinite are
    never ranked.  A null group value is a group of its own.  A group with fewer
    than n usable rows comes out whole, an empty table gives no row, and further
    columns are carried along whatever their names (an input column ``rank`` is
    replaced).

    Plan: (1) rows per group and bin, with map-side combine: at most bins rows
    for a group whatever its size; (2) the running count from the best bin down
    gives the last bin needed; (3) the thresholds of groups with at least 1 / ``HOT`` of all
    rows, so ``HOT`` groups at most, are broadcast, and rows of such groups never
    move for the join: those that reach their threshold take a salt; all other
    rows meet their group's threshold by a shuffle in which no group holds more
    than 1 / ``HOT`` of the rows; (4) the exact row number over the survivors, of
    which Catalyst again keeps n per task before the last shuffle.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    gs = [f"g{i}" for i in range(len(group))]
    ts = [f"t{i}" for i in range(len(ties))]
    quoted = [F.col(f"`{c}`") for c in df.columns if c != "rank"]
    rows = df.filter(finite(F.col(score))).select(
        F.struct(*quoted).alias("row"), *[F.col(g).alias(a) for g, a in zip(group, gs)], F.col(score).cast("double").alias("s"), *[F.col(t).alias(a) for t, a in zip(ties, ts)]
    )
    rows = rows.withColumn("bin", score_bin(F.col("s"), resolution))
    names = [f"h{i}" for i in range(len(group))]
    hist = rows.groupBy(*[F.col(g).alias(a) for g, a in zip(gs, names)], "bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*names).orderBy(F.desc("bin"))
    counted = hist.withColumn("before", F.sum("n").over(down) - F.col("n"))
    least = cut_lineage(counted.groupBy(*names).agg(F.min(F.when(F.col("before") < n, F.col("bin"))).alias("least"), F.sum("n").alias("total")))
    everything = least.agg(F.sum("total")).first()[0] or 0
    hot = least.filter(F.col("total") * HOT >= everything).select(*[F.col(a).alias(f"hot_{a}") for a in names], F.col("least").alias("hot"))
    near = rows.join(F.broadcast(hot), _same(gs, [f"hot_{a}" for a in names]), "left").filter(F.col("hot").isNull() | (F.col("bin") >= F.col("hot")))
    near = near.withColumn("part", F.when(F.col("hot").isNotNull(), 1 + F.pmod(F.xxhash64(*ts, "s"), F.lit(1 << 20))).otherwise(0).cast("int"))
    met = near.join(least.withColumn("salt", F.lit(0)), _same(gs, names) & (F.col("part") == F.col("salt")), "left")
    kept = met.filter(F.col("hot").isNotNull() | (F.col("bin") >= F.col("least")))
    w = Window.partitionBy(*gs).orderBy(F.desc("s"), *[F.asc(t) for t in ts])
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("row.*", "rank")


def current_marker_scores(de: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(cluster_id, gene_id, auc): the greatest usable score of a gene in a cluster over the data sets.

    Of each data set, cluster and gene only the row delivered last counts, and
    only if its ``auc`` is a number in [low, high].
    """
    usable = F.when(finite(F.col("auc")) & F.col("auc").between(low, high), F.col("auc"))
    key = ["dataset_id", "cluster_id", "gene_id"]
    last = de.groupBy(*key).agg(F.max(F.struct("loaded_at", usable.alias("auc"))).alias("b")).select("cluster_id", "gene_id", F.col("b.auc").alias("auc"))
    return last.filter(F.col("auc").isNotNull()).groupBy("cluster_id", "gene_id").agg(F.max("auc").alias("auc"))
