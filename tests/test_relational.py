from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellorium.operators import groupstats as gs
from cellorium.operators import relational as rl
from cellorium.operators.labels import canonical_spellings, label_key


def _col(df, c):
    return [r[c] for r in df.collect()]


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04, None, float("nan")]
    d = rl.bh_adjust(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").orderBy("i")
    got = _col(d, "p_adj")
    np.testing.assert_allclose(got[:6], [0.03, 0.048, 0.048, 0.03, 0.5, 0.048])
    assert got[6:] == [None, None]
    assert rl.bh_adjust(spark.createDataFrame([], "i int, p double"), "p").count() == 0


def test_midrank_and_fraction(spark):
    x = [3.0, 1.0, 1.0, None, 7.0, float("nan"), 3.0, 3.0]
    d = spark.createDataFrame([("g", i, v) for i, v in enumerate(x)], "g string, i int, x double")
    assert _col(rl.midrank(d, ["g"], "x").orderBy("i"), "mid_rank") == [4.0, 1.5, 1.5, None, 6.0, None, 4.0, 4.0]
    assert _col(rl.fractional_rank(d, ["g"], "x").orderBy("i"), "frac_rank")[4] == pytest.approx(1 / 6)


def test_zscore_flat_is_null(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0), ("b", float("nan"))], "g string, x double")
    z = {(r["g"], str(r["x"])): r["z"] for r in rl.zscore(d, ["g"], "x").collect()}
    assert z["a", "1.0"] is None and z["b", "3.0"] == pytest.approx(2**-0.5) and z["b", "nan"] is None


def test_latest_row(spark):
    t = datetime(2024, 1, 1)
    d = spark.createDataFrame([("a", t, 1.0, "x"), ("a", t + timedelta(1), 2.0, "y"), ("a", t + timedelta(1), 3.0, "y"), ("b", None, 9.0, "z"), (None, t, 4.0, "n"), ("c", t, None, None)], "k string, at timestamp, v double, extra string")
    got = {r["k"]: r["v"] for r in rl.latest_per_key(d, ["k"], "at", ["v"]).collect()}
    assert got == {"a": 3.0, "b": 9.0, None: 4.0, "c": None}


def test_split_and_downsample(spark):
    d = spark.range(200).select(F.col("id").alias("cell_id"), (F.col("id") % 3).alias("g"))
    s = rl.split_sample(d, "cell_id", 0.2, 5)
    assert s.filter("is_train").count() == 40 and s.count() == 200
    assert s.filter("is_train").exceptAll(rl.split_sample(d.repartition(5), "cell_id", 0.2, 5).filter("is_train")).count() == 0
    with pytest.raises(ValueError):
        rl.split_sample(d, "cell_id", 0.04)
    assert rl.split_sample(d, "cell_id", 12).filter("is_train").count() == 12
    k = rl.downsample_per_group(d, ["g"], "cell_id", 10)
    assert {r["count"] for r in k.groupBy("g").count().collect()} == {10}


def test_companion_first_of_equal(spark):
    d = spark.createDataFrame([("g", 1, 0.5, "a"), ("g", 2, 0.9, "b"), ("g", 3, 0.9, "c"), ("g", 4, float("nan"), "d"), ("h", 1, None, "e")], "g string, no int, v double, p string")
    assert [tuple(r) for r in rl.max_companion(d, ["g"], "v", ["p"], "no").collect()] == [("g", 0.9, "b")]


def test_pad_and_grid(spark):
    e = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0), ("b", 2, 4.0)], "gene_id string, cell_id int, v double")
    need = spark.createDataFrame([("b",), ("z",)], "gene_id string")
    got = {tuple(r) for r in rl.pad_missing(e, need, "gene_id", e.select("cell_id").distinct(), "cell_id", "v").collect()}
    assert got == {("b", 1, 3.0), ("b", 2, 4.0), ("z", 1, 0.0), ("z", 2, 0.0)}


def test_labels(spark):
    raw = ["K05_C1-X", " k05 c1 x", "K05-C1-X", "K05_C1-X", "NA", "unknown", "", None, "Unassigned ", "b"]
    d = spark.createDataFrame([(v,) for v in raw], "l string")
    assert _col(d.select(label_key(F.col("l")).alias("k")), "k") == ["k05_c1_x"] * 4 + [None] * 5 + ["b"]
    assert {tuple(r) for r in canonical_spellings(d, "l").collect()} == {("k05_c1_x", "K05_C1-X"), ("b", "b")}


def test_group_statistics(spark):
    rows = [("g", c, x, b) for c, x, b in [("u", 1.0, 1), ("u", 3.0, 0), ("v", 5.0, 0), ("v", None, 0), ("v", float("nan"), 0)]]
    e = spark.createDataFrame(rows, "gene_id string, c string, x double, b int")
    m = {r["c"]: r for r in gs.group_mean_sd(e, "x", "c").collect()}
    assert m["u"]["avg"] == 2.0 and m["u"]["sd"] == pytest.approx(2**0.5) and m["v"]["n"] == 1 and m["v"]["sd"] is None
    hi = {r["c"]: r["avg_hi_expr"] for r in gs.hi_expressor_mean(e, "b", "x", "c").collect()}
    assert hi == {"u": 1.0, "v": None}


def test_sparse_moments_equal_dense(spark):
    rs = np.random.RandomState(0)
    x = rs.poisson(0.7, (20, 6)).astype(float)
    rows = [(f"g{j}", i, float(x[i, j])) for i in range(20) for j in range(6) if x[i, j] > 0]
    got = {r["gene_id"]: r for r in gs.sparse_gene_moments(spark.createDataFrame(rows, "gene_id string, cell_id int, v double"), "v", 20).collect()}
    for j in range(6):
        assert got[f"g{j}"]["row_mean"] == pytest.approx(x[:, j].mean()) and got[f"g{j}"]["row_sd"] == pytest.approx(x[:, j].std(ddof=1))


def test_median_rank_with_absent_sources(spark):
    d = spark.createDataFrame([("a", "1", 0.1), ("a", "2", 0.3), ("b", "1", 0.2), ("c", "3", None)], "gene_id string, dataset_id string, r double")
    genes = spark.createDataFrame([("a",), ("b",), ("z",)], "gene_id string")
    got = {r[0]: r[1] for r in gs.median_rank_filled(d, genes, "gene_id", "dataset_id", "r").collect()}
    assert got == {"a": 0.3, "b": 1.0, "z": 1.0}
