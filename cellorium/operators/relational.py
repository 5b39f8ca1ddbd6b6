"""Relational primitives on long tables: selection, ranking, scaling, sampling.

Ties are always broken by explicit columns; null and NaN handling is stated in
every docstring.  Windows are partitioned by a key wherever the input may be
large; the few unpartitioned ones work on gene-level tables only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def nan_to_null(c: Column) -> Column:
    """NaN becomes null, so that every aggregate skips it."""
    return F.when(~F.isnan(c), c)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str]) -> DataFrame:
    """For each key the payload of the row with the greatest ``order``.

    One aggregation with map-side combine, so a key delivered very often is
    reduced before the shuffle.  Equal ``order``: the greatest payload in column
    order wins (null smallest, NaN greatest), so repeated rows give one row and
    the result does not depend on row order.  Null keys form a key; a null
    ``order`` loses to any other.
    """
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(order), *[F.col(p) for p in payload])).alias("__best"))
    return best.select(*keys, *[F.col("__best").getField(p).alias(p) for p in payload], F.col("__best").getField(order).alias(order))


def subset(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` occurs in ``ids``; null keys never match."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def anti_subset(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` does not occur in ``ids``; null keys stay."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def midrank(df: DataFrame, part: Sequence[str], value: str, out: str = "mid_rank") -> DataFrame:
    """Rank with ties averaged inside each partition; rows with null or NaN value get null."""
    ok = finite(F.col(value))
    w = Window.partitionBy(*part, ok).orderBy(value)
    ties = Window.partitionBy(*part, ok, F.col(value))
    return df.withColumn(out, F.when(ok, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)))


def fractional_rank(df: DataFrame, part: Sequence[str], value: str, out: str = "frac_rank") -> DataFrame:
    """Mid-rank of the negated value over the count of usable rows: 0 < r <= 1, small is best."""
    w = Window.partitionBy(*part)
    neg = df.withColumn("__neg", -F.col(value))
    ranked = midrank(neg, part, "__neg", "__mr")
    n = F.count(F.when(finite(F.col("__neg")), 1)).over(w)
    return ranked.withColumn(out, F.col("__mr") / n).drop("__mr", "__neg")


def bh_adjust(df: DataFrame, p: str, family: Sequence[str] = (), out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values over the non-null rows of each family.

    Null and NaN p-values stay null.  Without ``family`` the table is one
    family; use that for gene-level tables only.
    """
    ok = finite(F.col(p))
    part = [F.col(c) for c in family] + [ok]
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    rk = F.rank().over(Window.partitionBy(*part).orderBy(p)) + F.count(F.lit(1)).over(Window.partitionBy(*part, F.col(p))) - 1
    raw = df.withColumn("__n", n).withColumn("__rk", rk).withColumn("__q", F.col(p) * F.col("__n") / F.col("__rk"))
    w = Window.partitionBy(*part).orderBy(F.desc("__rk")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn(out, F.when(ok, F.least(F.lit(1.0), F.min("__q").over(w)))).drop("__n", "__rk", "__q")


def zscore(df: DataFrame, part: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(x - mean) / sd (n - 1) inside each partition; zero or undefined sd gives null.

    Moments are aggregated with map-side combine and joined back, so no task holds
    the rows of a partition; Catalyst broadcasts the moments where they are small.
    """
    x = nan_to_null(F.col(value))
    m = df.groupBy(*part).agg(F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__sd"))
    return with_group_columns(df, m, part).withColumn(out, (x - F.col("__mean")) / F.nullif(F.col("__sd"), F.lit(0.0))).drop("__mean", "__sd")


def with_group_columns(df: DataFrame, groups: DataFrame, part: Sequence[str]) -> DataFrame:
    """Every row of ``df`` with the columns of its group; a null key is a group."""
    keys = [f"__k{i}" for i in range(len(part))]
    g = groups.select(*[F.col(p).alias(k) for p, k in zip(part, keys)], *[c for c in groups.columns if c not in part])
    cond = F.lit(True)
    for p, k in zip(part, keys):
        cond = cond & F.col(p).eqNullSafe(F.col(k))
    return df.join(g, cond, "left").drop(*keys)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global first k rows; a TakeOrderedAndProject, no full sort."""
    return df.orderBy(*order).limit(k)


def top_k_flag(df: DataFrame, order: Sequence[Column], k: int, key: str, out: str) -> DataFrame:
    """Flag the k first rows of a gene-level table; other rows get False."""
    best = df.orderBy(*order).limit(k).select(key).withColumn("__hit", F.lit(True))
    return df.join(best, key, "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit")


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of every group; Catalyst limits groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every key."""
    return top_k_per_group(df, key, order, 1)


def hash_order(key: str, seed: int) -> Column:
    """A reproducible pseudo-random order; the same in every engine that has md5."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.lit(str(seed))))


def downsample_per_group(df: DataFrame, group: Sequence[str], key: str, n: int, seed: int = 9999) -> DataFrame:
    """At most n rows of each group in hash order; ties by the key itself."""
    return top_k_per_group(df, group, [hash_order(key, seed), F.col(key)], n)


def split_sample(cells: DataFrame, key: str, frac: float, seed: int = 1, out: str = "is_train") -> DataFrame:
    """Mark ``frac`` (<= 1: share, > 1: count) of the cells as training set.

    Fewer than 10 training cells raise.  The order is a hash of the key, so the
    split is reproducible and needs no unpartitioned window.
    """
    n = cells.count()
    k = int(frac) if frac > 1 else int(n * frac)
    if k < 10:
        raise ValueError(f"only {k} cells would be sampled; at least 10 are needed")
    train = cells.select(key).orderBy(hash_order(key, seed), key).limit(k).withColumn("__t", F.lit(True))
    return cells.join(train, key, "left").withColumn(out, F.coalesce("__t", F.lit(False))).drop("__t")


def common_keys(df: DataFrame, key: str, source: str, k: int) -> DataFrame:
    """Keys present in k distinct sources: one shuffle instead of chained intersects."""
    return df.select(key, source).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_sources")).filter(F.col("n_sources") >= k).select(key)


def complete_grid(df: DataFrame, rows: DataFrame, row_key: str, cols: DataFrame, col_key: str, value: str, fill: float) -> DataFrame:
    """One row for each (row, column) pair, ``fill`` where the long table has none.

    The grid is by nature rows x columns; ``cols`` is a short dimension (data
    sets, groups), not cells.
    """
    grid = rows.select(row_key).distinct().crossJoin(F.broadcast(cols.select(col_key).distinct()))
    return grid.join(df.select(row_key, col_key, value), [row_key, col_key], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def pad_missing(df: DataFrame, required: DataFrame, gene: str, cells: DataFrame, cell: str, value: str) -> DataFrame:
    """Add zero rows for required genes that the table lacks; genes not required are dropped."""
    absent = required.select(gene).distinct().join(df.select(gene).distinct(), gene, "left_anti")
    zeros = absent.crossJoin(cells.select(cell).distinct()).withColumn(value, F.lit(0.0))
    kept = df.join(required.select(gene).distinct(), gene, "left_semi").select(gene, cell, value)
    return kept.unionByName(zeros.select(gene, cell, value))


def max_companion(df: DataFrame, keys: Sequence[str], by: str, carry: Sequence[str], tie: str) -> DataFrame:
    """The largest ``by`` of each key with companions of the same row; first ``tie`` wins."""
    best = F.max_by(F.struct(by, *carry), F.struct(F.col(by), -F.col(tie)))
    ok = df.filter(finite(F.col(by)))
    return ok.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col("__b").getField(c).alias(c) for c in (by, *carry)])


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where null matches null; the keys come out once."""
    r = b.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return a.join(r, cond).drop(*[f"__k_{k}" for k in keys])


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: str, out: str) -> DataFrame:
    """Add the value of the first row (by ``order``) of ``table`` with that key; null where there is none."""
    first = table.filter(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias("__k")).agg(F.min_by(value, order).alias(out))
    return df.join(first, F.col(key) == F.col("__k"), "left").drop("__k")


def scatter(df: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """Replace ``value`` where ``updates`` has the key with a non-null value; keys must be unique in ``updates``."""
    u = updates.select(key, F.col(value).alias("__new"))
    return df.join(u, key, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def reorder(df: DataFrame, order: DataFrame, key: str, index: str) -> DataFrame:
    """One row for each key of ``order`` in its order, nulls where ``df`` has none."""
    return df.join(order.select(key, index), key, "right").orderBy(index, key)


def union_filled(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with different columns; missing columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def group_average_wide(long: DataFrame, row: Sequence[str], column: str, value: str, levels: Sequence[str]) -> DataFrame:
    """Mean by (row, column), one column per level; the explicit levels keep it one pass."""
    return long.groupBy(*row).pivot(column, list(levels)).agg(F.avg(value))
