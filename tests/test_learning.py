import numpy as np
import pytest
from pyspark.sql import functions as F

from cellorium.exprset import ExprSet
from cellorium.operators import classify, cluster, community, embed, metrics, mixture, neighbors, reduce, vgene
from cellorium.operators.knee import find_knee
from cellorium.plans.pipeline import run


def blobs(n=20, k=3, d=8, seed=0, far=6.0):
    rs = np.random.RandomState(seed)
    return np.concatenate([rs.randn(n, d) * 0.4 + c for c in rs.randn(k, d) * far]), np.repeat(np.arange(k), n)


def _vec(spark, x, lab=None):
    rows = [(f"c{i:03d}", v.tolist(), f"L{lab[i]}" if lab is not None else "") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "cell_id string, features array<double>, label string")


def _set(spark, x, lab):
    v = _vec(spark, x, lab)
    return ExprSet.from_array_column(v, "cell_id", "features", keep=("label",))


def same(a, b) -> bool:
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_knee():
    assert [find_knee(y) for y in ([3.0, 2.0, 1.0], [5.0, 4.0], [10.0, 1.0, 0.9, 0.8])] == [3, 2, 1]
    y = np.r_[np.linspace(50, 10, 10), np.linspace(2, 0, 90)]
    assert find_knee(y, corrected=True) == find_knee(y) + 1 == 11


def test_pca_is_centred(spark):
    x, lab = blobs()
    x = x + 50
    scores, info = reduce.pca(_vec(spark, x), 3)
    got = np.stack(scores.orderBy("cell_id").toPandas()["features"].to_numpy())
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    np.testing.assert_allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6)
    np.testing.assert_allclose(info["explained"], s**2 / (s**2).sum(), atol=1e-8)
    np.testing.assert_allclose(got.mean(0), 0, atol=1e-9)
    assert (info["rotation"][np.abs(info["rotation"]).argmax(0), range(3)] > 0).all()


def test_correlation_space(spark):
    x, lab = blobs()
    x = np.round(x)
    v = _vec(spark, x)
    m = np.stack(reduce.correlation_space(v, "pearson").orderBy("cell_id").toPandas()["features"].to_numpy())
    np.testing.assert_allclose(m, np.corrcoef(x), atol=1e-9)
    r = np.stack(reduce.correlation_space(v, "spearman").orderBy("cell_id").toPandas()["features"].to_numpy())
    np.testing.assert_allclose(r, np.corrcoef(reduce._ranks(x)), atol=1e-9)
    with pytest.raises(ValueError):
        reduce.correlation_space(v, "spearman", 2, against=v)


@pytest.mark.parametrize("method", ["kmeans", "hclust", "dynamicTreeCut", "adpclust", "dpclust", "SNN", "SC3"])
def test_blobs_are_found(spark, method):
    x, lab = blobs()
    es = _set(spark, x, lab).with_embedding("emb", _vec(spark, x))
    cells = cluster.clust(es, "emb", method, [3], snn_k=8, snn_method="louvain").cells.toPandas().sort_values("cell_id")
    name = f"emb.{method}.k3" if method in ("kmeans", "hclust", "SC3") else f"emb.{method}.kauto"
    assert same(cells[name], lab)


def test_cluster_dispatch(spark):
    x, lab = blobs(5)
    es = _set(spark, x, lab)
    got = cluster.clust(es, "absent", "kmeans", [2, 3]).cells.toPandas()
    assert set(got["absent.kmeans.k2"]) == {"C0"} == set(got["absent.kmeans.k3"])
    for f in (lambda: cluster.clust(es, "emb", "nope"), lambda: vgene.variable_genes(es, "HVG.trendVar"), lambda: reduce.reduce_dim(es, "pca"), lambda: community.detect(np.zeros((2, 2)), "nope")):
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize("method", sorted(community.METHODS))
def test_communities(method):
    w = np.zeros((9, 9))
    for a in range(3):
        w[3 * a : 3 * a + 3, 3 * a : 3 * a + 3] = 1
    np.fill_diagonal(w, 0)
    w[2, 3] = w[3, 2] = w[5, 6] = w[6, 5] = 0.2
    assert same(community.detect(w, method), np.repeat([0, 1, 2], 3))


def test_label_propagation_by_joins(spark):
    e = [(3 * a + i, 3 * a + j, 1.0) for a in range(3) for i in range(3) for j in range(i + 1, 3)] + [(2, 3, 0.1), (5, 6, 0.1)]
    got = community.propagate_labels(spark.createDataFrame(e, "src int, dst int, weight double"), 6).orderBy("node").collect()
    assert same([r["label"] for r in got], np.repeat([0, 1, 2], 3))


def test_embeddings_keep_neighbours():
    x, lab = blobs()
    for y in (embed.tsne(x, perplexity=8, max_iter=400, early_stop=100), embed.umap(x, epochs=60)):
        assert same(cluster.hclust(y, 3), lab)
    with pytest.raises(ValueError):
        embed.tsne(x, perplexity=30, theta=2)
    assert embed.run_tsne(x[:30], 30, max_iter=20) is not None  # falls back to perplexity 5
    assert embed.run_tsne(x[:10], 30) is None


def test_knn_and_snn(spark):
    x, lab = blobs(8)
    v = _vec(spark, x, lab)
    d = cluster.distances(x)
    np.fill_diagonal(d, np.inf)
    g = neighbors.knn_graph(v, 3).toPandas()
    for i in range(len(x)):
        assert list(g[g.src == f"c{i:03d}"].sort_values("rank").dst) == [f"c{j:03d}" for j in np.argsort(np.round(d[i], 9), kind="stable")[:3]]
    p = neighbors.knn_classify(v.filter("cell_id < 'c012'"), "label", v.filter("cell_id >= 'c012'"), 1)
    assert p.count() == len(x) - 12


def test_classifiers(spark):
    x, lab = blobs(15)
    v = _vec(spark, x, lab)
    tr, te = v.filter(F.crc32("cell_id") % 2 == 0), v.filter(F.crc32("cell_id") % 2 == 1)
    rf = classify.predict_forest(classify.train_forest(tr, "label", 20), te)
    svm = classify.predict_svm(classify.train_svm(tr, "label"), te)
    for p in (rf, svm):
        assert classify.error_table(p, te, "label").filter("label IS NULL").first()["error_rate"] == 0
    r = rf.first()
    assert r["prob"] >= r["second_prob"] and abs(sum(r["probs"].values()) - 1) < 1e-9
    assert set(classify.select_features(v, "label", 10)) <= set(range(8))


def test_top_two_first_wins(spark):
    d = spark.createDataFrame([("a", [0.4, 0.4, 0.2]), ("b", [0.1, 0.2, 0.7])], "cell_id string, p array<double>")
    got = {r["cell_id"]: (r["predicted"], r["second"]) for r in classify.top_two(d, ["x", "y", "z"]).collect()}
    assert got == {"a": ("x", "y"), "b": ("z", "y")}


def test_subsample_path(spark):
    x, lab = blobs(30, d=12)
    es = vgene.hvg_sd(_set(spark, x, lab), 12)
    for red, cls in (("iCor", "knn"), ("pca", "RF")):
        got = classify.subsample_cluster_classify(es, 0.4, red, "hclust", [3], cls, trees=20).toPandas().sort_values("cell_id")
        assert got.is_train.sum() == 36 and same(got[f"{red}.hclust.k3"], lab)


def test_signatures(spark):
    x, lab = blobs(20, d=6)
    es = _set(spark, x, lab)
    sig = spark.createDataFrame([("M1", "G0000"), ("M1", "G0001"), ("M2", "G0002"), ("M2", "G9999")], "meta_cluster string, gene_id string")
    s = classify.signature_scores(es.expr, "exprs", sig).toPandas()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    for r in s.itertuples():
        i = int(r.cell_id[1:])
        assert r.score == pytest.approx(np.mean(z[i, [0, 1]] > 0.3) if r.meta_cluster == "M1" else float(z[i, 2] > 0.3))
    got = classify.classify_by_signature(es, "exprs", sig, trees=10, least=10)
    assert got.count() == 60 and {"rf_max", "rf_class_max"} <= set(got.columns)


def test_silhouette_and_agreement(spark):
    x, lab = blobs(10)
    v = _vec(spark, x, lab)
    s = metrics.silhouette(v.select("cell_id", "features"), v).toPandas()
    assert s.width.mean() == pytest.approx(cluster.mean_silhouette(cluster.distances(x), lab)) and s.width.between(-1, 1).all()
    d = spark.createDataFrame([(a, b) for a, b in zip("AABBCC", "xxyyzz")], "a string, b string")
    assert metrics.ari(d, "a", "b").first()[0] == pytest.approx(1.0) and metrics.nmi(d, "a", "b").first()[0] == pytest.approx(1.0)
    e = spark.createDataFrame([(a, b) for a, b in zip("AAABBB", "xxyyyx")], "a string, b string")
    assert metrics.ari(e, "a", "b").first()[0] == pytest.approx(-1 / 9, abs=0.2)


def test_mixture_uses_all_values():
    rs = np.random.RandomState(3)
    x = np.r_[rs.randn(60_000), 2.5 + 0.5 * rs.randn(600)]
    full = max((mixture.fit_mixture(x, 2, e) for e in (True, False)), key=lambda f: f["bic"])
    _, c = mixture.binarize_vector(x, g=2)
    assert (c == mixture.posterior_class(x, full)).all()


def test_mixture_states():
    rs = np.random.RandomState(0)
    x = np.r_[rs.normal(0, 0.3, 200), rs.normal(5, 0.3, 100)]
    s, _ = mixture.binarize_vector(x, g=2)
    assert (s[:200] == 0).all() and (s[200:] == 1).all()
    s, _ = mixture.binarize_vector(x)
    assert (s[:200] == 0).mean() > 0.95 and (s[200:] == 1).mean() > 0.6
    y = np.r_[x, rs.normal(10, 0.3, 100)]
    s, _ = mixture.binarize_vector(y, g=3)
    assert set(s[200:300]) == {0.5} and set(s[300:]) == {1.0}
    assert (mixture.binarize_vector(np.array([1.0, np.nan]))[0] == -1).all()
    assert mixture.qq_r2(x, mixture.fit_mixture(x, 2, True)) > 0.98


def test_outliers(spark):
    rs = np.random.RandomState(1)
    x = np.r_[rs.randn(300), [9.0, 12.0]]
    d = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)] + [("n", 0, None), ("n", 1, float("nan"))], "g string, s int, x double")
    got = mixture.classify_outliers(d, "g", "s", "x", 0.1).filter("outlier = 1").toPandas()
    assert set(got.s) == {300, 301}


def test_trend_and_reuse(spark):
    x, lab = blobs(20, d=10)
    es = _set(spark, np.abs(x), lab)
    t = vgene.trend_var(es, mean_min=0.0, assay="exprs")
    assert t.genes.filter("trend_hvg IS NULL").count() == 0 and t.meta["trend_var"].count() == 10
    a = vgene.hvg_sd(es, 4)
    assert a.genes.filter("hvg_sd").count() == 4 and vgene.variable_genes(a, "HVG.sd", 2, reuse=True) is a


def test_pipeline_labels(spark):
    x, lab = blobs(14, d=6, far=8)
    es = _set(spark, x, lab)
    got = run(es, method_reduction="pca", method_clust="kmeans", ks=[3], sd_n=6, n_pc=3).cells.toPandas().sort_values("cell_id")
    assert same(got["pca.kmeans.k3"], lab)
    two = run(es, method_reduction="pca", method_clust="kmeans", ks=[3], sd_n=6, n_pc=3, n_iter=2, params={"L1C1.L1C02": {"k": 2}}).cells.toPandas().sort_values("cell_id")
    names = set(two["pca.kmeans.k3"])
    assert all(n.startswith("L1C1.L1C") and ".L2C" in n for n in names) and len(names) > 3


def test_tsne_query_passes_early_exaggeration(spark, sf, monkeypatch):
    from cellorium.plans import suite

    seen = {}
    monkeypatch.setattr(embed, "tsne", lambda x, dims=2, perplexity=30.0, max_iter=1000, early_stop=250: seen.update(it=max_iter, early=early_stop) or np.zeros((len(x), 2)))
    suite.tsne_embedding(spark, sf)
    assert seen["it"] == 1000 > seen["early"]


def test_forest_does_not_depend_on_partitions(spark):
    x, lab = blobs(20, d=6, far=0.5)
    v = _vec(spark, x, lab)
    got = []
    for parts in (1, 30):
        m = classify.train_forest(v.repartition(parts), "label", 20)
        got.append({r["cell_id"]: r["prob"] for r in classify.predict_forest(m, v).collect()})
    assert got[0] == pytest.approx(got[1], abs=1e-12)
    assert "trees" not in vars(m.stages[1]) and len(m.stages[1].trees) == 20


def test_signature_forests_run_few_tasks(spark):
    x, lab = blobs(20, d=6)
    es = _set(spark, x, lab)
    sig = spark.createDataFrame([(f"M{i % 3}", f"G{i:04d}") for i in range(6)], "meta_cluster string, gene_id string")
    sc, old = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    sc.setJobGroup("signatures", "")
    try:
        got = classify.classify_by_signature(es, "exprs", sig, trees=20, least=10).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        sc.setLocalProperty("spark.jobGroup.id", None)
    st = sc.statusTracker()
    stages = [s for j in st.getJobIdsForGroup("signatures") for s in st.getJobInfo(j).stageIds]
    tasks = sum(i.numTasks for s in set(stages) if (i := st.getStageInfo(s)) and "RandomForest" in i.name)
    assert len(got) == 60 and (got.rf_max >= 0).all() and 0 < tasks < 150


def _rings(k=12, n=5, seed=0):
    rs, w = np.random.RandomState(seed), np.zeros((k * n, k * n))
    for a in range(k):
        w[a * n : a * n + n, a * n : a * n + n] = rs.rand(n, n) + 1
        b = (a * n + n) % (k * n)
        w[a * n, b] = 0.3
    w = np.triu(w + w.T, 1)
    return w + w.T, np.repeat(np.arange(k), n)


def test_infomap_aggregates_the_graph_once_a_start(monkeypatch):
    w, lab = _rings()
    calls, old = [], community._aggregate
    monkeypatch.setattr(community, "_aggregate", lambda *a: calls.append(1) or old(*a))
    assert same(community.detect(w, "infomap"), lab)
    assert len(calls) < 30


def test_walktrap_sums_no_matrix_per_merge(monkeypatch):
    w, lab = _rings(seed=1)
    calls, old = [], community.modularity
    monkeypatch.setattr(community, "modularity", lambda *a: calls.append(1) or old(*a))
    assert same(community.detect(w, "walktrap"), lab)
    assert len(calls) < 3
    two = np.zeros((6, 6))
    two[0, 1] = two[1, 0] = two[2, 3] = two[3, 2] = 1.0
    assert list(community.detect(two, "walktrap")) == [0, 0, 1, 1, 2, 3]


def _code_length(w, lab, tau=0.15):
    n, d = len(w), w.sum(1, keepdims=True)
    step = np.where(d > 0, (1 - tau) * w / np.maximum(d, 1e-300) + tau / n, 1 / n)
    p = np.linalg.matrix_power(step, 400)[0]
    flow, own = p[:, None] * step, np.eye(lab.max() + 1)[lab]
    out = np.array([flow[np.ix_(lab == c, lab != c)].sum() for c in range(lab.max() + 1)])
    h = lambda v: (v[v > 0] * np.log2(v[v > 0])).sum()
    return h(np.array([out.sum()])) - 2 * h(out) + h(out + p @ own) - h(p)


def test_infomap_moves_single_nodes():
    rs, lab = np.random.RandomState(17), np.repeat(np.arange(6), 7)
    w = np.triu(rs.rand(42, 42) < np.where(lab[:, None] == lab, 0.6, 0.05), 1).astype(float)
    w = w + w.T
    got = community.detect(w, "infomap")
    assert same(got, lab)  # a merge of the modularity partitions leaves nodes in a neighbouring group
    cost = _code_length(w, got)
    for i in range(42):
        for c in {*got[w[i] > 0], 6}:
            assert _code_length(w, np.where(np.arange(42) == i, c, got)) > cost - 1e-9


def test_infomap_trials_run_on_executors(spark):
    x, lab = blobs(12)
    got = cluster.snn_cluster(_vec(spark, x).select("cell_id", "features"), 6, "infomap")[2]
    assert same(got, lab)
    tries = []
    w, lab = _rings()
    assert same(community.detect(w, "infomap", each=lambda f, seeds: [tries.append(s) or f(s) for s in seeds]), lab)
    assert tries == list(range(1, 11))
    alone = np.zeros((4, 4))
    alone[0, 1] = alone[1, 0] = 1.0
    assert list(community.detect(alone, "infomap")) == [0, 0, 1, 2]
