import math

import numpy as np
import pytest

from cellorium.functions import special
from cellorium.operators import de

LV = ["C1", "C10", "C1.1"]


def _data(seed=0, genes=6, cells=60, ties=False):
    rs = np.random.RandomState(seed)
    g, b = rs.randint(0, 3, cells), rs.randint(0, 2, cells)
    x = rs.randn(genes, cells) + 1 + np.arange(genes)[:, None] * 0.3 * (g == 2) + 0.5 * b
    return (np.round(x) if ties else x), g, b


def _frame(spark, x, g, b):
    rows = [(f"g{i}", j, float(x[i, j]), LV[g[j]], f"b{b[j]}") for i in range(len(x)) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "gene_id string, cell_id int, v double, c string, batch string")


def _ols(y, X):
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    rss = ((y - X @ beta) ** 2).sum()
    return beta, rss, len(y) - np.linalg.matrix_rank(X)


def test_f_and_batch_f(spark):
    x, g, b = _data()
    e = _frame(spark, x, g, b)
    f = {r["gene_id"]: r for r in de.aov(e, "v", "c").collect()}
    fb = {r["gene_id"]: r for r in de.aov_batch(e, "v", "c", "batch").collect()}
    G = np.eye(3)[g]
    for i in range(len(x)):
        _, r1, d1 = _ols(x[i], G)
        _, r2, d2 = _ols(x[i], np.c_[G, b])
        ssb = ((x[i] - x[i].mean()) ** 2).sum() - r1
        assert f[f"g{i}"]["f_stat"] == pytest.approx(ssb / 2 / (r1 / d1))
        assert f[f"g{i}"]["f_pvalue"] == pytest.approx(float(special.f_sf(ssb / 2 / (r1 / d1), 2, d1)))
        assert fb[f"g{i}"]["f_stat"] == pytest.approx(ssb / 2 / (r2 / d2)) and fb[f"g{i}"]["df_residual"] == d2


def _mid(v):
    _, inv, c = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(c) - (c - 1) / 2)[inv], c


def test_kruskal_with_ties(spark):
    x, g, b = _data(1, ties=True)
    h = {r["gene_id"]: r["h_stat"] for r in de.kruskal(_frame(spark, x, g, b), "v", "c").collect()}
    for i in range(len(x)):
        r, c = _mid(x[i])
        n = len(r)
        s = sum(r[g == k].sum() ** 2 / (g == k).sum() for k in range(3))
        want = (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - (c**3 - c).sum() / (n**3 - n))
        assert h[f"g{i}"] == pytest.approx(want)


def test_pairs_are_found_by_name(spark):
    """Names that contain each other (C1, C10, C1.1) must not be mixed up."""
    x, g, b = _data(2)
    e = _frame(spark, x, g, b)
    t = {(r["gene_id"], r["g_low"], r["g_high"]): r for r in de.tukey_hsd(e, "v", "c").collect()}
    assert len(t) == 6 * 3
    mean = {(i, LV[k]): x[i][g == k].mean() for i in range(6) for k in range(3)}
    for (gene, lo, hi), r in t.items():
        i = int(gene[1:])
        assert lo < hi and r["diff"] == pytest.approx(mean[i, hi] - mean[i, lo])
        rss = sum(((x[i][g == k] - x[i][g == k].mean()) ** 2).sum() for k in range(3))
        se = math.sqrt(rss / 57 / 2 * (1 / (g == LV.index(lo)).sum() + 1 / (g == LV.index(hi)).sum()))
        assert r["p_adj"] == pytest.approx(float(special.ptukey_sf(abs(r["diff"]) / se, 3, 57)), abs=1e-9)
    tops = {r["gene_id"]: r for r in de.top_two_groups(e, "v", "c").collect()}
    cmp = {r["gene_id"]: r["min_diff_cmp"] for r in de.top_pair_test(de.tukey_hsd(e, "v", "c"), de.top_two_groups(e, "v", "c")).collect()}
    for gene, r in tops.items():
        assert set(cmp[gene].split("-")) == {r["g_first"], r["g_second"]}


def test_specific_direction(spark):
    rows = [("g", a, b, d, p) for a, b, d, p in [("A", "B", 2.0, 0.001), ("A", "C", 0.1, 0.9), ("B", "C", -1.9, 0.001)]]
    p = spark.createDataFrame(rows, "gene_id string, g_low string, g_high string, diff double, p_adj double")
    assert tuple(de.specific_groups(p, 0.01).first()) == ("g", True, "B", "UP")


def test_auc_symmetry_and_exact_p(spark):
    x, g, b = _data(3, cells=30)
    g = (g > 0).astype(int)
    a = {r["gene_id"]: r for r in de.marker_test(_frame(spark, x, g, b), "v", "c").collect()}
    m = {r["gene_id"]: r for r in de.marker_test(_frame(spark, -x, g, b), "v", "c").collect()}
    for i in range(len(x)):
        hi = a[f"g{i}"]["cluster"]
        pos = g == LV.index(hi)
        u = (x[i][pos][:, None] > x[i][~pos][None]).sum()
        assert a[f"g{i}"]["auc"] == pytest.approx(u / (pos.sum() * (~pos).sum()))
        assert a[f"g{i}"]["auc"] == pytest.approx(m[f"g{i}"]["auc"])  # the other group is highest in -x
        assert a[f"g{i}"]["score_p_value"] == pytest.approx(special.wilcoxon_exact_p(u, pos.sum(), (~pos).sum()))


def test_auc_tie_of_means(spark):
    e = spark.createDataFrame([("g", i, 1.0, c, "b") for i, c in enumerate("AABB")], "gene_id string, cell_id int, v double, c string, batch string")
    r = de.marker_test(e, "v", "c").first()
    assert (r["cluster"], r["auc"], r["score_p_value"]) == ("A", -1.0, 1.0)


def test_one_vs_rest_and_naive(spark):
    x, g, b = _data(4)
    v = {(r["gene_id"], r["cluster"]): r for r in de.naive_de(_frame(spark, x, g, b), "v", "c").collect()}
    for i in range(len(x)):
        for k in range(3):
            y, d = x[i], (g == k).astype(float)
            beta, rss, df = _ols(y, np.c_[np.ones(60), d])
            se = math.sqrt(rss / df / (60 * d.var()))
            r = v[f"g{i}", LV[k]]
            assert r["log_fc"] == pytest.approx(beta[1]) and r["t_stat"] == pytest.approx(beta[1] / se) and r["p_value"] == pytest.approx(float(special.t_sf2(beta[1] / se, df)), abs=1e-12)


def test_limma_fit_and_prior(spark):
    x, g, b = _data(5, genes=40)
    e = _frame(spark, x, g, b)
    got = {r["gene_id"]: r for r in de.limma(e, "v", "c", "C1.1", "batch").collect()}
    order, _ = de.level_order(sorted(LV), "C1.1")
    X = np.c_[np.ones(60), (g == LV.index(order[1])).astype(float), (g == LV.index("C1.1")).astype(float), b]
    con = np.array([0, -1.0, 1.0, 0])
    inv = np.linalg.inv(X.T @ X)
    fits = [_ols(x[i], X) for i in range(40)]
    s2, df = np.array([f[1] / f[2] for f in fits]), np.full(40, 56.0)
    d0, s02 = de.fit_prior(s2, df)
    post = np.full(40, s02) if np.isinf(d0) else (d0 * s02 + df * s2) / (d0 + df)
    for i in range(40):
        fc = con @ fits[i][0]
        assert got[f"g{i}"]["log_fc"] == pytest.approx(fc)
        assert got[f"g{i}"]["t_stat"] == pytest.approx(fc / math.sqrt(post[i] * (con @ inv @ con)))


def test_prior_is_recovered():
    rs = np.random.RandomState(0)
    d0, s0, d = 8.0, 2.0, 20
    s2 = d0 * s0 / rs.chisquare(d0, 20_000) * rs.chisquare(d, 20_000) / d
    a, b = de.fit_prior(s2, np.full(20_000, float(d)))
    assert a == pytest.approx(d0, rel=0.1) and b == pytest.approx(s0, rel=0.05)


def test_confounded_batch_is_left_out(spark):
    rows = [("g", j, float(j % 5 + (j >= 20)), "_case" if j >= 20 else "_control", "b2" if j >= 20 else f"b{j % 2}") for j in range(40)]
    r = de.limma(spark.createDataFrame(rows, "gene_id string, cell_id int, v double, c string, batch string"), "v", "c", "_case", "batch").first()
    assert r["log_fc"] == pytest.approx(1.0, abs=0.6) and r["cluster"] == "_case"


def test_level_order():
    assert de.level_order(["b", "_control", "a"], "a") == (["_control", "b", "a"], "a")
    assert de.level_order(["x", "y"], "x:shown") == (["y", "x"], "shown")


def test_batch_coefficients(spark):
    x, g, b = _data(6)
    got = de.remove_batch_coefficients(_frame(spark, x, g, b), "v", "c", "batch", "adj").toPandas()
    for i in range(len(x)):
        beta = _ols(x[i], np.c_[np.eye(3)[g], b])[0]
        y = got[got.gene_id == f"g{i}"].sort_values("cell_id").adj.to_numpy()
        np.testing.assert_allclose(y, x[i] - beta[3] * b, atol=1e-9)


def test_find_de_needs_two_groups(spark):
    e = spark.createDataFrame([("g", 1, 1.0, "A", "b")], "gene_id string, cell_id int, v double, c string, batch string")
    with pytest.raises(ValueError):
        de.find_de_genes(e, "v", "c")
