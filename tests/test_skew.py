import numpy as np
import pandas as pd
import pytest

from cellorium.operators.skew import balanced_key_stats

DDL = "k string, s string, v double, pid int, r double, n_rows int, runs string"


def _want(rows):
    p = pd.DataFrame(rows, columns=["k", "s", "v"]).dropna(subset="k")
    out = {}
    for k, g in p.groupby("k"):
        v = g.v[np.isfinite(g.v.astype(float))].astype(float)
        c = g.s.map(lambda x: ("0", "") if x is None else ("1", x)).value_counts()
        top = min(c[c == c.max()].index)
        out[k] = (len(g), len(v), round(v.sum(), 6), None if not len(v) else v.min(), len(c), None if top[0] == "0" else top[1], int(c.max()))
    return out


@pytest.mark.parametrize("n", [1, 3, 16])
def test_hot_keys_against_pandas(spark, n):
    rs = np.random.RandomState(n)
    rows = [(f"k{k}", f"s{s}", float(v)) for k, s, v in zip(rs.choice(50, 6000, p=np.r_[0.4, 0.3, np.full(48, 0.3 / 48)]), rs.randint(0, 9, 6000), rs.randn(6000))]
    rows += [("hot", "same", 1.0)] * 3000 + [(None, "x", 1.0), ("k0", None, None), ("k1", "s1", float("nan")), ("k2", "s1", float("inf")), ("lone", None, None)]
    df = spark.createDataFrame([(*r, 1, 0.5, 3, "z") for r in rows], DDL).repartition(5)
    got = {r["key_value"]: (r["n_rows"], r["n_values"], round(r["sum_value"], 6), r["min_value"], r["n_secondary"], r["mode_secondary"], r["mode_count"]) for r in balanced_key_stats(df, "k", "s", "v", n).collect()}
    assert got == _want([(a, b, c) for a, b, c in rows])


def test_work_is_even(spark):
    from pyspark.sql import functions as F

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"), (F.col("id") % 11).cast("string").alias("s"), F.rand(7).alias("r"))
    sizes = [r["count"] for r in rows.repartitionByRange(10, "k", "s", "r").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 30_000 / 10


def test_empty(spark):
    assert balanced_key_stats(spark.createDataFrame([], DDL), "k", "s", "v").count() == 0
    assert balanced_key_stats(spark.createDataFrame([(None, "a", 1.0, 1, 1.0, 1, "")], DDL), "k", "s").count() == 0
