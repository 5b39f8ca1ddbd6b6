"""Samples whose categories match target proportions.

Each category keeps a mergeable reservoir: its rows with the smallest hash
priorities.  The union of two reservoirs cut to the same size is the reservoir
of the union, so tasks reduce their rows before any shuffle.  After the final
counts each reservoir is trimmed to a feasible quota; the smallest priorities of
a uniform sample are again a uniform sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellorium.operators.labels import label_key
from cellorium.operators.relational import latest_per_key
from cellorium.session import cut_lineage


def current_cells(cells: DataFrame) -> DataFrame:
    """The row delivered last of each cell, with comparison forms of its labels."""
    cur = latest_per_key(cells.filter(F.col("cell_id").isNotNull()), ["cell_id"], "loaded_at", ["dataset_id", "major_cluster", "cell_type1"])
    return cur.select("cell_id", "dataset_id", label_key(F.col("major_cluster")).alias("major_cluster"), label_key(F.col("cell_type1")).alias("cell_type1"))


def members_by_field(current: DataFrame, fields=("major_cluster", "cell_type1")) -> DataFrame:
    """(dataset_id, field_name, category, cell_id): one row for each field that names a category."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("category")) for f in fields]))
    return current.select("cell_id", "dataset_id", pairs.alias("p")).select("dataset_id", "p.field_name", "p.category", "cell_id").filter(F.col("category").isNotNull() & F.col("dataset_id").isNotNull())


def feasible(t: DataFrame) -> DataFrame:
    """Add ``quota`` to targets with ``share``, ``lo``, ``hi`` and ``size``; a set is a data set and field.

    Every category gets the same multiple of its share, but not less than ``lo`` (its
    minimum, as far as supplied) nor more than ``hi`` (its supply), so that the quotas of
    a set add up to ``size``: what one category cannot supply, or a minimum takes, is
    shared by the others.  Fractions are rounded by largest remainders.  Where all
    supply is not enough everything is taken; where the minimums exceed the size
    they win.  The multiple lies between two of the set's bounds lo / share and
    hi / share; sets have a few dozen categories.
    """
    sets = ["dataset_id", "field_name"]
    w = Window.partitionBy(*sets)
    same = F.col("b_ds").eqNullSafe(F.col("dataset_id")) & F.col("b_f").eqNullSafe(F.col("field_name"))
    both = F.when(F.col("share") > 0, F.array(F.lit(0.0), F.round(F.col("lo") / F.col("share"), 9), F.round(F.col("hi") / F.col("share"), 9)))
    bound = F.explode(F.coalesce(both, F.array(F.lit(0.0))))
    bounds = t.select(F.col("dataset_id").alias("b_ds"), F.col("field_name").alias("b_f"), bound.alias("at")).distinct()
    clip = lambda x: F.greatest(F.least(x, F.col("hi")), F.col("lo"))
    upto = bounds.join(t, same).groupBy("b_ds", "b_f", "at").agg(
        F.sum(clip(F.col("at") * F.col("share"))).alias("filled"), F.max("size").alias("size"),
        F.sum(F.when((F.col("share") > 0) & (F.col("lo") / F.col("share") <= F.col("at") + 1e-9) & (F.col("hi") / F.col("share") > F.col("at") + 1e-9), F.col("share")).otherwise(0.0)).alias("free"),
    )
    start = upto.filter(F.col("filled") <= F.col("size") + 1e-6).groupBy("b_ds", "b_f").agg(F.max_by(F.struct("at", "filled", "free", "size"), "at").alias("x"))
    times = F.col("x.at") + F.when(F.col("x.free") > 0, (F.col("x.size") - F.col("x.filled")) / F.col("x.free")).otherwise(0.0)
    t = t.join(start.select("b_ds", "b_f", times.alias("times")), same, "left").drop("b_ds", "b_f")
    t = t.withColumn("exact", F.round(clip(F.coalesce(F.col("times") * F.col("share"), F.lit(0.0))), 6)).withColumn("whole", F.floor("exact"))
    spare = F.round(F.sum("exact").over(w)).cast("long") - F.sum("whole").over(w)
    nth = F.row_number().over(w.orderBy(F.desc(F.col("exact") - F.col("whole")), "target_id"))
    return t.withColumn("quota", (F.col("whole") + F.when((nth <= spare) & (F.col("exact") > F.col("whole")), 1).otherwise(0)).cast("long")).drop("times", "exact", "whole")


def quotas(targets: DataFrame, supply: DataFrame) -> DataFrame:
    """Every target with its supply, wanted count, feasible quota and what keeps it from being met.

    ``wanted`` are the shares of ``sample_size`` rounded by largest remainders so
    that they add up within a target set; ``quota``: see :func:`feasible`.  A null
    share, size or minimum counts as 0.  ``short_share``: supply < target_share *
    sample_size; ``short_min``: supply < min_cells; ``exhausted``: the whole supply
    is taken and is less than wanted or than the minimum.  Targets whose category is missing have supply 0.
    """
    t = targets.select("target_id", "dataset_id", "field_name", "category", "target_share", "min_cells", "sample_size")
    t = t.withColumn("category_key", label_key(F.col("category"))).withColumn("ideal", F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0)))
    keys = ["dataset_id", "field_name", "category_key"]
    s = supply.withColumnRenamed("category", "category_key")
    t = t.join(s, keys, "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    w = Window.partitionBy("dataset_id", "field_name")
    t = t.withColumn("low", F.floor("ideal"))
    t = t.withColumn("spare", F.round(F.sum("ideal").over(w)).cast("long") - F.sum("low").over(w))
    nth = F.row_number().over(w.orderBy(F.desc(F.col("ideal") - F.col("low")), "target_id"))
    t = t.withColumn("wanted", (F.col("low") + F.when(nth <= F.col("spare"), 1).otherwise(0)).cast("long"))
    least = F.coalesce(F.col("min_cells"), F.lit(0))
    t = t.withColumn("share", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).withColumn("hi", F.col("supply").cast("double")).withColumn("lo", F.least(F.col("hi"), least.cast("double"))).withColumn("size", F.coalesce("sample_size", F.lit(0)))
    t = feasible(t)
    need = F.greatest(F.col("wanted"), least)
    return t.select(
        "target_id", *keys, "category", "target_share", "min_cells", "sample_size", F.col("supply").cast("long").alias("supply"), "wanted", "quota",
        (F.col("supply") < F.col("ideal")).alias("short_share"), (F.col("supply") < least).alias("short_min"), ((F.col("quota") == F.col("supply")) & (F.col("supply") < need)).alias("exhausted"),
    )


_RES = "dataset_id string, field_name string, category string, priority string, cell_id string, seen long"


def _reservoirs(batches: Iterator[pd.DataFrame], chunk: int = 200_000) -> Iterator[pd.DataFrame]:
    """The reservoirs of a task: of each category the ``k`` smallest priorities; the first row also carries how many rows were seen."""
    keys = ["dataset_id", "field_name", "category"]
    held: pd.DataFrame | None = None
    wait, n = [], 0

    def merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        t = pd.concat(parts, ignore_index=True).sort_values([*keys, "priority", "cell_id"], kind="stable", ignore_index=True)
        g = t.groupby(keys, sort=False)
        t["seen"] = np.where(g.cumcount() == 0, g["seen"].transform("sum"), 0)
        return t[(g.cumcount() < t["k"]) | (g.cumcount() == 0)]

    for b in batches:
        wait.append(b)
        n += len(b)
        if n >= chunk:
            held = merged([*wait] if held is None else [held, *wait])
            wait, n = [], 0
    if wait:
        held = merged([*wait] if held is None else [held, *wait])
    if held is not None and len(held):
        yield held.drop(columns="k")


def sample_to_targets(cells: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every target set.

    sample: target_id, dataset_id, field_name, category_key, cell_id, priority.
    report: see :func:`quotas`.  Superseded rows of a cell do not count; a cell
    delivered many times is one cell.  Categories without a target are counted and not
    sampled.  Empty cells leave every target short; empty targets give no row.

    One pass over the current cells makes the reservoirs and the counts of every
    task; they meet in one shuffle.  A reservoir holds the sample size of its target
    set, the most its quota can become, so a category of a third of all cells leaves
    each task as one bounded reservoir.  Priorities are md5 of cell and seed.
    """
    m = members_by_field(current_cells(cells))
    keys = ["dataset_id", "field_name", "category"]
    most = F.greatest(F.coalesce("sample_size", F.lit(0)), F.coalesce("min_cells", F.lit(0)))
    size = targets.select("dataset_id", "field_name", label_key(F.col("category")).alias("category"), most.alias("k")).groupBy(*keys).agg(F.max("k").alias("k"))
    pri = F.md5(F.concat_ws(":", F.col("cell_id").cast("string"), "field_name", F.lit(str(seed))))
    rows = m.join(size, keys, "left").select(*keys, pri.alias("priority"), F.col("cell_id").cast("string").alias("cell_id"), F.lit(1).cast("long").alias("seen"), F.coalesce("k", F.lit(0)).cast("long").alias("k"))
    w = Window.partitionBy(*keys)
    met = rows.mapInPandas(_reservoirs, _RES).withColumn("supply", F.sum("seen").over(w)).withColumn("rn", F.row_number().over(w.orderBy("priority", "cell_id")))
    met = cut_lineage(met.withColumnRenamed("category", "category_key"))
    report = quotas(targets, met.filter("rn = 1").select("dataset_id", "field_name", F.col("category_key").alias("category"), "supply"))
    sample = met.join(report.select("target_id", "dataset_id", "field_name", "category_key", "quota"), ["dataset_id", "field_name", "category_key"]).filter(F.col("rn") <= F.col("quota"))
    return sample.select("target_id", "dataset_id", "field_name", "category_key", "cell_id", "priority"), report
