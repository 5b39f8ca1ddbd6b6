"""Options and operators added to the analysis: sparse statistics, second groups, projection of new cells, checkpoint folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellorium import session
from cellorium.exprset import ExprSet
from cellorium.operators import classify, de, groupstats, integrate, relational
from cellorium.sources.tables import map_orthologs


def test_sparse_statistics_count_zeros(spark):
    cells = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "y", 1), ("d", "y", 1), ("e", None, 1)], "cell_id string, grp string, mean int")
    expr = spark.createDataFrame([("g1", "a", 2.0, 0), ("g1", "c", 4.0, 0), ("g1", "e", 9.0, 0), ("g2", "a", float("nan"), 0), ("g2", "zz", 5.0, 0)], "gene_id string, cell_id string, v double, size int")
    got = {(r["gene_id"], r["grp"]): r for r in groupstats.sparse_group_stats(expr, "v", cells, "grp", 1.0).collect()}
    assert set(got) == {("g1", "x"), ("g1", "y"), ("g2", "x"), ("g2", "y")}
    assert (got["g1", "x"]["mean"], got["g1", "x"]["length"], got["g1", "x"]["freq"]) == (1.0, 2, 0.5)
    assert got["g1", "y"]["sd"] == pytest.approx(np.std([0, 4], ddof=1)) and got["g2", "x"]["length"] == 1 and got["g2", "x"]["mean"] == 0
    assert {r[0] for r in groupstats.drop_flat_genes(expr.filter("gene_id = 'g1' AND cell_id = 'a'"), "v", n_cells=4).collect()} == {"g1"}
    assert groupstats.drop_flat_genes(expr.filter("gene_id = 'g1' AND cell_id = 'a'"), "v").count() == 0
    assert groupstats.sparse_group_stats(expr.limit(0), "v", cells.limit(0), "grp", 1.0).count() == 0


def test_zscore_with_null_keys_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), (None, 5.0, 3), (None, 7.0, 4), ("b", 1.0, 5), ("c", float("nan"), 6)], "k string, v double, n int")
    z = {r["n"]: r["z"] for r in relational.zscore(df, ["k"], "v").collect()}
    assert z[1] == pytest.approx(-(0.5**0.5)) and z[4] == pytest.approx(0.5**0.5) and z[5] is None and z[6] is None and len(z) == 6


def test_orthologs_right_join(spark):
    expr = spark.createDataFrame([("h1", "a", 1.0), ("h1", "b", float("nan")), ("h3", "a", 1.0)], "gene_id string, cell_id string, v double")
    m = spark.createDataFrame([("h1", "m1", "ortholog_one2one", 1), ("h2", "m2", "ortholog_one2one", 1), ("h3", "m3", "ortholog_one2many", 1)], "s string, t string, orthology_type string, orthology_confidence int")
    assert {(r["gene_id"], r["cell_id"], r["v"]) for r in map_orthologs(expr, m, "s", "t", keep_all=True).collect()} == {("m1", "a", 1.0), ("m1", "b", None), ("m2", None, None)}
    assert map_orthologs(expr, m, "s", "t").count() == 2


def test_checkpoint_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_second_group_modes(spark):
    rows = [("m", "g", s, l, d, 0.1, p) for s, l, d, p in (("s1", "a", 1.0, 0.01), ("s2", "a", 0.6, 0.02), ("s3", "b", 0.2, 0.5))]
    t = spark.createDataFrame(rows, "meta_cluster string, gene_id string, study string, lab string, dprime double, vardprime double, p_value double").withColumn("adj_p", F.col("p_value"))
    comb = {r["lab"]: r for r in integrate.collapse_studies(t, "lab").collect()}
    assert comb["a"]["dprime"] == pytest.approx(0.8) and comb["a"]["sig"] == 1 and comb["b"]["sig"] == 0
    assert {r["lab"]: r["dprime"] for r in integrate.collapse_studies(t, "lab", "max").collect()} == {"a": 1.0, "b": 0.2}
    with pytest.raises(ValueError):
        integrate.collapse_studies(t, "lab", "other")


def test_contrasts_of_all_groups_equal_single_ones(spark):
    rs = np.random.RandomState(0)
    rows = [(f"g{g}", f"c{c}", float(rs.randn() + (g == c % 3)), f"k{c % 3}", f"b{c % 2}") for g in range(4) for c in range(40)]
    e = spark.createDataFrame(rows, "gene_id string, cell_id string, v double, k string, b string")
    every = {(r["gene_id"], r["cluster"]): r["log_fc"] for r in de.linear_fits(e, "v", "k", ["k0", "k1", "k2"], "b", as_two=True).collect()}
    for t in ("k0", "k2"):
        two = e.withColumn("two", F.when(F.col("k") == t, "_case").otherwise("_control"))
        for r in de.limma(two, "v", "two", "_case", "b", per_group=100, stats_over=0.5).collect():
            assert every[r["gene_id"], t] == pytest.approx(r["log_fc"]) and r["length"] > 0


def test_new_cells_land_where_their_copies_are(spark):
    rs = np.random.RandomState(2)
    x = rs.rand(30, 60)
    cells = [(f"c{i:02d}", [float(v) for v in x[i % 30]]) for i in range(60)]  # every cell twice
    df = spark.createDataFrame(cells, "cell_id string, f array<double>")
    emb = spark.createDataFrame([(f"c{i:02d}", [float(i % 30), float((i % 30) ** 2)]) for i in range(60)], "cell_id string, features array<double>")
    got = {r["cell_id"]: (r["is_train"], np.array(r["features"])) for r in classify.out_of_sample_embedding(ExprSet.from_array_column(df, "cell_id", "f"), 0.5, embedding=emb, icor_method="pearson").collect()}
    assert len(got) == 60 and sum(t for t, _ in got.values()) == 30
    pairs = [(got[f"c{i:02d}"], got[f"c{i + 30:02d}"]) for i in range(30)]
    both = [(a, b) for a, b in pairs if a[0] != b[0]]
    near = [np.abs(a[1] - b[1]).sum() for a, b in both]
    far = [np.abs(both[i][0][1] - both[i - 1][1][1]).sum() for i in range(len(both))]
    assert max(near) < 1e-6 < np.median(far)
