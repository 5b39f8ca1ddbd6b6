from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellorium.llm import quantiles, quota, topn

MANY = "c string, g string, s double, rank int, bin int, n int, salt int"


def test_top_n_against_sorting(spark):
    rs = np.random.RandomState(1)
    rows = [(None if c == 0 else f"c{c}", f"g{i:05d}", float(np.round(v, 2)), 7, 7, 7, 7) for i, (c, v) in enumerate(zip(rs.choice(6, 4000, p=[0.05, 0.5, 0.3, 0.1, 0.04, 0.01]), rs.randn(4000) * 10))]
    rows += [("c1", "a", float("nan"), 1, 1, 1, 1), ("c1", "b", None, 1, 1, 1, 1), ("c9", "x", float("inf"), 1, 1, 1, 1), ("c1", None, 1e9, 1, 1, 1, 1)]
    got = topn.top_n_per_group(spark.createDataFrame(rows, MANY), ["c"], "s", ["g"], 5)
    assert got.columns == ["c", "g", "s", "bin", "n", "salt", "rank"]
    want = {}
    for r in rows:
        if r[2] is not None and np.isfinite(r[2]):
            want.setdefault(r[0], []).append((-r[2], r[1] or "", r[1]))
    want = {(c, x[2], i + 1) for c, v in want.items() for i, x in enumerate(sorted(v)[:5])}
    assert {(r["c"], r["g"], r["rank"]) for r in got.collect()} == want


def test_top_n_ties_repeats_empty(spark):
    rows = [("c", f"g{i % 40:02d}", 0.5) for i in range(4000)]
    got = topn.top_n_per_group(spark.createDataFrame(rows, "c string, g string, s double"), ["c"], "s", ["g"], 7).collect()
    assert [r["g"] for r in sorted(got, key=lambda r: r["rank"])] == ["g00"] * 7
    assert topn.top_n_per_group(spark.createDataFrame([], "c string, g string, s double"), ["c"], "s", ["g"], 7).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(spark.createDataFrame([], "c string, g string, s double"), ["c"], "s", ["g"], 0)


def test_score_bin_never_decreases(spark):
    v = sorted(np.r_[np.random.RandomState(0).randn(500) * 100, [0.0, 1e-300, -1e-300, 1e300, -1e300]].tolist())
    bins = [r[0] for r in spark.createDataFrame([(x,) for x in v], "x double").orderBy("x").select(topn.score_bin(F.col("x"))).collect()]
    assert bins == sorted(bins)


def test_sketch_adds_deletes_and_bounds():
    lay = quantiles.Layout()
    rs = np.random.RandomState(2)
    a, b = rs.randint(0, 1 << 14, 20_000), rs.randint(0, 1 << 13, 5000)

    def sketch(*parts):
        m = np.zeros((1, lay.size), np.int64)
        for codes, w in parts:
            lay.insert(m, np.zeros(len(codes), np.int64), codes, np.full(len(codes), w))
        return m

    both = sketch((a, 1), (b, 1))
    assert (both == sketch((a, 1)) + sketch((b, 1))).all()
    assert (sketch((a, 1), (b, 1), (b, -1)) == sketch((a, 1))).all()
    every = np.sort(np.r_[a, b])
    err = 4 * lay.rank_error(both)[0]
    assert err < 0.03 * len(every)
    for q in (0.0, 0.1, 0.5, 0.9, 0.99, 1.0):
        r = round(q * (len(every) - 1))
        code = int(lay.quantile(both, np.array([r]))[0])
        lo, hi = np.searchsorted(every, code, "left"), np.searchsorted(every, code, "right")
        assert lo - err <= r <= hi + err


def _frame(rs, k, days, n):
    return pd.DataFrame({"k": [f"k{i}" for i in rs.choice(k, n, p=np.r_[0.5, np.full(k - 1, 0.5 / (k - 1))])], "d": [f"d{i}" for i in rs.randint(0, days, n)], "x": rs.gamma(2, 8, n).clip(0, 99)})


@pytest.mark.parametrize("buffer", [1024, 16])
def test_percentiles_lie_in_their_bounds(spark, buffer):
    rs = np.random.RandomState(3)
    pdf = _frame(rs, 6, 4, 30_000)
    got = quantiles.percentile_sketches(spark.createDataFrame(pdf).repartition(7), "k", "d", "x", 0, 100, (0.5, 0.9), buffer=buffer).toPandas()
    assert len(got) == 6 * 4 + 6
    for r in got.itertuples():
        x = np.sort(pdf[(pdf.k == r.k) & ((pdf.d == r.d) if r.d is not None else True)].x)
        assert r.n == len(x)
        for q, lo, est, hi in ((0.5, r.q0_lo, r.q0, r.q0_hi), (0.9, r.q1_lo, r.q1, r.q1_hi)):
            exact = np.percentile(x, q * 100)
            assert lo <= exact <= hi and abs(est - exact) <= (hi - lo)


def test_percentiles_nulls_weights_empty(spark):
    ddl = "k string, d string, x double, w int, n int, q0 int"
    rows = [("a", "1", float(i % 10), 1, 0, 0) for i in range(100)] + [("a", "1", 50.0, 1, 0, 0), ("a", "1", 50.0, -1, 0, 0), (None, None, 3.0, 1, 0, 0), ("a", "1", None, 1, 0, 0), ("b", "1", float("nan"), 1, 0, 0)]
    got = {(r["k"], r["d"]): r for r in quantiles.percentile_sketches(spark.createDataFrame(rows, ddl), "k", "d", "x", 0, 100, (0.5,), weight="w").collect()}
    assert set(got) == {("a", "1"), ("a", None), (None, ""), (None, None)}
    assert got["a", None]["n"] == 100 and abs(got["a", None]["q0"] - 4.5) <= 1 and abs(got[None, ""]["q0"] - 3) < 0.1
    assert quantiles.percentile_sketches(spark.createDataFrame([], ddl), "k", "d", "x", 0, 100).count() == 0


def test_bounds_stay_inside_the_exact_node():
    lay = quantiles.Layout()
    rs = np.random.RandomState(5)
    for n in (1, 300, 3000, 40_000):
        m = np.zeros((1, lay.size), np.int64)
        codes = np.sort((rs.gamma(2, 1000, n)).astype(np.int64).clip(0, (1 << 14) - 1))
        lay.insert(m, np.zeros(n, np.int64), codes, np.ones(n, np.int64))
        for r in np.linspace(0, n - 1, 150).astype(int):
            lo, hi = (int(lay.quantile(m, np.array([r]), quantiles.SIGMAS, u)[0]) for u in (False, True))
            assert lo <= codes[r] <= hi and hi - lo < (1 << 14) // 512


def test_salted_chunks_and_log_scale(spark):
    rs = np.random.RandomState(8)
    pdf = _frame(rs, 3, 2, 20_000)
    a = quantiles.percentile_sketches(spark.createDataFrame(pdf).repartition(5), "k", "d", "x", 0, 100, log_scale=True).toPandas()
    b = quantiles.percentile_sketches(spark.createDataFrame(pdf).repartition(3), "k", "d", "x", 0, 100, log_scale=True, chunk=700, buffer=50, salts=3).toPandas()
    order = lambda t: t.sort_values(["k", "d"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(a), order(b))  # the sketch does not depend on how rows were split


def test_exact_percentiles_against_numpy(spark):
    rs = np.random.RandomState(4)
    pdf = pd.DataFrame({"k": rs.choice(["a", "b"], 3000), "day": rs.choice(["1", "2"], 3000), "x": np.round(rs.gamma(2, 2, 3000), 2)})
    pdf.loc[:40, "x"] = np.nan
    want = []
    for k, day in (("a", "1"), ("a", None), ("b", "2")):
        x = pdf[(pdf.k == k) & ((pdf.day == day) | (day is None))].x.dropna()
        for i, q in enumerate((0.0, 0.37, 0.5, 1.0)):
            lo, hi = (0.0, 1000.0) if i % 2 else (900.0, 950.0)  # the second kind of bounds does not hold
            want.append((k, day, i, q, len(x), lo, hi, float(np.percentile(x, q * 100))))
    ddl = "k string, day string, i int, q double, n long, a double, b double"
    got = quantiles.exact_percentiles(spark.createDataFrame(pdf), spark.createDataFrame([w[:7] for w in want], ddl), cells=16)
    got = {(r["k"], r["day"], r["i"]): r["value"] for r in got.collect()}
    assert got == pytest.approx({w[:3]: w[7] for w in want})
    assert quantiles.exact_percentiles(spark.createDataFrame(pdf), spark.createDataFrame([], ddl)).count() == 0


CELLS = "cell_id string, dataset_id string, major_cluster string, cell_type1 string, loaded_at timestamp, supply int, category string"
TARGETS = "target_id long, dataset_id string, field_name string, category string, target_share double, min_cells int, sample_size int, supply int, cell_id string, low int"


def _cells(spark):
    t = datetime(2024, 1, 1)
    rows = [(f"x{i}", "D1", ["A-1", "a_1 ", "A 1", "B-2"][i % 4], None if i % 3 else "T", t, 1, "z") for i in range(40)]
    rows += [("x0", "D1", "unknown", "T", t + timedelta(days=1), 1, "z"), ("x1", "D1", "A-1", None, t, 1, "z"), (None, "D1", "A-1", "T", t, 1, "z"), ("y", None, "A-1", "T", None, 1, "z")]
    return spark.createDataFrame(rows, CELLS)


def test_quota_sample_and_report(spark):
    targets = spark.createDataFrame([(1, "D1", "major_cluster", "a 1", 0.5, None, 11, 9, "c", 3), (2, "D1", "major_cluster", "B-2", 0.5, 20, 11, 9, "c", 3), (3, "D1", "cell_type1", "nope", 1.0, None, 4, 9, "c", 3), (4, "D2", "cell_type1", "T", None, 2, None, 9, "c", 3)], TARGETS)
    sample, report = quota.sample_to_targets(_cells(spark), targets)
    rep = {r["target_id"]: r for r in report.collect()}
    assert [rep[i]["supply"] for i in (1, 2, 3, 4)] == [29, 10, 0, 0]  # x0 lost its label, x1 came twice
    assert rep[1]["wanted"] + rep[2]["wanted"] == 11 and rep[2]["quota"] == 10 and rep[2]["exhausted"] and rep[2]["short_min"] and not rep[2]["short_share"]
    assert rep[3]["short_share"] and rep[4]["short_min"]
    got = sample.groupBy("target_id").agg(F.count("*").alias("n"), F.countDistinct("cell_id").alias("k")).collect()
    assert {(r["target_id"], r["n"], r["k"]) for r in got} == {(1, rep[1]["quota"], rep[1]["quota"]), (2, 10, 10)}


def test_quotas_share_out_what_is_missing(spark):
    t = datetime(2024, 1, 1)
    have = {"A": 5, "B": 100, "C": 100, "D": 30}
    cells = spark.createDataFrame([(f"{c}{i}", "D1", c, None, t, 0, "") for c, n in have.items() for i in range(n)], CELLS)
    rows = [(1, "A", 0.5, None), (2, "B", 0.3, None), (3, "C", 0.15, None), (4, "D", 0.05, 20), (5, "E", None, 3)]
    targets = spark.createDataFrame([(i, "D1", "major_cluster", c, s, m, 100, 0, "", 0) for i, c, s, m in rows], TARGETS)
    sample, report = quota.sample_to_targets(cells, targets)
    q = {r["target_id"]: r for r in report.collect()}
    assert [q[i]["quota"] for i in range(1, 6)] == [5, 50, 25, 20, 0]  # 75 for B and C, 2 to 1
    assert [q[i]["exhausted"] for i in range(1, 6)] == [True, False, False, False, True]
    assert sample.count() == 100


def test_reservoirs_do_not_depend_on_the_tasks(spark):
    t = datetime(2024, 1, 1)
    cells = spark.createDataFrame([(f"c{i}", "D1", "A" if i % 3 else "B", None, t, 0, "") for i in range(500)], CELLS)
    targets = spark.createDataFrame([(1, "D1", "major_cluster", "A", 0.7, None, 60, 0, "", 0), (2, "D1", "major_cluster", "B", 0.3, None, 60, 0, "", 0)], TARGETS)
    got = [{tuple(r) for r in quota.sample_to_targets(cells.repartition(n), targets)[0].collect()} for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 60
    parts = list(quota._reservoirs(iter([pd.DataFrame({"dataset_id": "d", "field_name": "f", "category": "c", "priority": [f"{i:03d}" for i in range(a, 90, 3)], "cell_id": "x", "seen": 1, "k": 4}) for a in (0, 1, 2)]), chunk=40))
    assert len(parts) == 1 and list(parts[0]["priority"]) == ["000", "001", "002", "003"] and parts[0]["seen"].sum() == 90


def test_quota_is_uniform(spark):
    t = datetime(2024, 1, 1)
    cells = spark.createDataFrame([(f"c{i}", "D", "A", None, t, 0, "") for i in range(3000)], CELLS)
    targets = spark.createDataFrame([(1, "D", "major_cluster", "A", 1.0, None, 1000, 0, "", 0)], TARGETS)
    ids = np.array([int(r["cell_id"][1:]) for r in quota.sample_to_targets(cells, targets)[0].collect()])
    assert len(set(ids)) == 1000 and abs(ids.mean() - 1500) < 90


def test_quota_empty(spark):
    s, r = quota.sample_to_targets(spark.createDataFrame([], CELLS), spark.createDataFrame([], TARGETS))
    assert s.count() == 0 and r.count() == 0
    s, r = quota.sample_to_targets(spark.createDataFrame([], CELLS), spark.createDataFrame([(1, "D", "major_cluster", "A", 1.0, None, 10, 0, "", 0)], TARGETS))
    assert s.count() == 0 and r.first()["exhausted"]
