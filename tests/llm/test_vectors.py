from datetime import datetime, timedelta

import numpy as np
import pytest

from cellorium.llm import clusters, neighbours, vectors

T = datetime(2024, 1, 1)
DDL = "cell_id string, exprs array<double>, loaded_at timestamp, id int, x int, vec int, leaf string"


def _df(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if a is None else float(a) for a in v], t, 1, 1, 1, "l") for i, v, t in rows], DDL)


def _planted(n=1500, groups=5, seed=0, noise=0.8):
    rs = np.random.RandomState(seed)
    c = rs.gamma(1.5, 1.2, (groups, 64))
    g = rs.choice(groups, n, p=np.r_[0.45, np.full(groups - 1, 0.55 / (groups - 1))])
    x = np.maximum(c[g] + noise * rs.randn(n, 64), 0)
    for i in range(0, n // 10, 2):
        x[i + 1] = x[i] + 0.05 * rs.randn(64)
        g[i + 1] = g[i]
    x[rs.rand(n, 64) < 0.004] = np.nan
    return np.round(x, 2), g


def test_usable_vectors(spark):
    full = list(range(64))
    rows = [("late", [1.0] * 63 + [2.0], T), ("late", full, T + timedelta(days=1)), ("short", full[:23], T), ("flat", [3.0] * 64, T), ("few", full[:31] + [None] * 33, T), ("enough", full[:32] + [float("nan")] * 32, T), (None, full, T), ("none", None, T), ("copy", full, T), ("copy", full, T), ("inf", full[:32] + [float("inf")] * 32, None)]
    got = {r["cell_id"]: r["exprs"] for r in vectors.usable_vectors(_df(spark, rows)).collect()}
    assert set(got) == {"late", "enough", "copy", "inf"}
    assert got["late"] == [float(i) for i in full] and got["enough"][32:] == [None] * 32
    assert vectors.usable_vectors(_df(spark, [])).count() == 0


def test_pearson_forms_agree():
    x, _ = _planted(60)
    r = vectors.cross_pearson(x, x)
    i, j = np.meshgrid(np.arange(60), np.arange(60), indexing="ij")
    p = vectors.pair_pearson(x[i.ravel()], x[j.ravel()]).reshape(60, 60)
    np.testing.assert_allclose(r, p, atol=1e-9)
    m = np.isfinite(x[3]) & np.isfinite(x[7])
    assert abs(r[3, 7] - np.corrcoef(x[3][m], x[7][m])[0, 1]) < 1e-12


def _brute(x, k, least):
    r = np.nan_to_num(vectors.cross_pearson(x, x), nan=-9)
    np.fill_diagonal(r, -9)
    out = {}
    for i in range(len(x)):
        o = np.lexsort((np.arange(len(x)), -np.round(r[i], 9)))[:k]
        out[i] = {j for j in o if r[i, j] >= least}
    return out


@pytest.mark.parametrize("least,block", [(0.96, 128), (0.5, 512)])
def test_recall_of_neighbours(spark, least, block):
    x, _ = _planted(2000)
    df = _df(spark, [(f"c{i:05d}", [None if np.isnan(a) else a for a in v], T) for i, v in enumerate(x)])
    got = {}
    for r in neighbours.k_nearest(df, "cell_id", "exprs", 10, least, block=block).collect():
        got.setdefault(int(r["query"][1:]), set()).add(int(r["neighbour"][1:]))
    want = _brute(x, 10, least)
    hit = sum(len(got.get(i, set()) & w) for i, w in want.items())
    assert hit / sum(map(len, want.values())) >= 0.9
    assert all(len(v) <= 10 for v in got.values())


@pytest.mark.parametrize("empties", [16, 24, 32])
def test_recall_of_gappy_vectors(spark, empties):
    x, _ = _planted(2000, seed=7)
    rs = np.random.RandomState(empties)
    for i in range(1000, 1300, 2):
        x[i] = np.where(np.isfinite(x[i]), x[i], 1.0)
        x[i + 1] = x[i] + 0.05 * rs.randn(64)
        x[i + 1, rs.permutation(64)[:empties]] = np.nan
    df = _df(spark, [(f"c{i:05d}", [None if np.isnan(a) else a for a in v], T) for i, v in enumerate(x)])
    got = {(int(r["query"][1:]), int(r["neighbour"][1:])) for r in neighbours.k_nearest(df, "cell_id", "exprs", 10, 0.96, block=128).collect()}
    want = {(i, j) for i, w in _brute(x, 10, 0.96).items() for j in w if 1000 <= min(i, j) and max(i, j) < 1300}
    assert len(want) >= 290 and len(want & got) / len(want) >= 0.95
    rows = neighbours._sub_blocks(np.tile(x[1000:1300], (2, 1)), 200, 3)
    met = sum(any({i, i + 1} <= set(part) for part in rows) for i in range(0, 300, 2))
    assert met >= 75


def test_windows_count_each_collision_once():
    rs = np.random.RandomState(6)
    p = np.round(rs.randn(300, 5), 1).astype(np.float32)
    win, rows = neighbours._Windows(p), np.arange(0, 300, 7)
    n, old = np.zeros((len(rows), 300), np.uint8), None
    for w in (0.25, 0.55, 1.05):
        new = win.around(rows, np.float32(w))
        win.count(n, new, old)
        assert (n == (np.abs(p[rows][:, None] - p[None]) <= w).sum(2)).all()
        old = new
    need = neighbours.collisions_needed()
    hits = (np.abs(rs.randn(20_000, neighbours.PROJECTIONS)) <= neighbours.HALF_WIDTH).sum(1)
    assert (hits >= need).mean() >= neighbours.BLOCK_RECALL - 0.01 > (hits > need).mean() - 0.03


def test_mutual_pairs_with_copies(spark):
    x, _ = _planted(600, seed=4)
    rows = [(f"c{i:05d}", [None if np.isnan(a) else a for a in v], T) for i, v in enumerate(x)]
    rows += [(f"k{i:05d}", rows[0][1], T) for i in range(400)] + [("p1", rows[50][1], T), ("p2", rows[50][1], T)]  # a third are copies of one vector
    got = {(r["cell_a"], r["cell_b"]) for r in neighbours.mutual_neighbours(_df(spark, rows), "cell_id", "exprs", 10, 0.96, block=128).collect()}
    ids = np.array([r[0] for r in rows])
    order = np.argsort(ids)
    m = np.array([[np.nan if a is None else a for a in rows[i][1]] for i in order])
    near = _brute(m, 10, 0.96)
    want = {(ids[order][i], ids[order][j]) for i, w in near.items() for j in w if i < j and i in near[j]}
    assert got == want
    assert neighbours.mutual_neighbours(_df(spark, []), "cell_id", "exprs").count() == 0


def test_blocks_cut_again():
    x, _ = _planted(900)
    parts = neighbours._sub_blocks(x, 200, 3)
    assert set(np.concatenate(parts)) == set(range(900)) and max(map(len, parts)) < 400


def test_features_merge_in_any_order():
    x, _ = _planted(400)
    u = vectors.unit_rows(x)
    a = clusters.CFTree(64)
    a.insert(np.ones(400), u, (u**2).sum(1))
    assert abs(a.n.sum() - 400) < 1e-9
    np.testing.assert_allclose(a.ls.sum(0), u.sum(0), atol=1e-9)
    b = clusters.CFTree(64, max_leaves=20)
    b.insert(np.ones(400), u, (u**2).sum(1))
    assert len(b.n) <= 20 and abs(b.n.sum() - 400) < 1e-9 and b.radius2 >= a.radius2
    r2 = a.ss / a.n - ((a.ls / a.n[:, None]) ** 2).sum(1)
    assert (r2 <= a.radius2 + 1e-9).all()


def test_clusters_found(spark):
    x, g = _planted(1200, noise=0.6)
    df = _df(spark, [(f"c{i:05d}", [None if np.isnan(a) else a for a in v], T) for i, v in enumerate(x)]).repartition(5)
    assigned, typical = clusters.similarity_clusters(df, "cell_id", "exprs")
    lab = {int(r["cell_id"][1:]): r["cluster_no"] for r in assigned.collect()}
    assert len(lab) == 1200
    pairs = {(g[i], c) for i, c in lab.items() if c is not None}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == 5
    t = typical.toPandas()
    assert (t.groupby("cluster_no").size() == 5).all() and t.n_members.iloc[0] == sum(c == t.cluster_no.iloc[0] for c in lab.values())


def test_more_groups_than_leaves(spark):
    rs = np.random.RandomState(5)
    c = rs.randn(900, 64)
    c = c[(np.triu(np.corrcoef(c), 1) > 0.4).sum(0) == 0][:540]
    g = np.repeat(np.arange(540), 8)
    df = _df(spark, [(f"c{i:05d}", v, T) for i, v in enumerate(c[g] + 0.7 * rs.randn(len(g), 64))]).repartition(2)
    assigned, _ = clusters.similarity_clusters(df, "cell_id", "exprs")
    lab = {int(r["cell_id"][1:]): r["cluster_no"] for r in assigned.collect() if r["cluster_no"] is not None}
    pairs = {(g[i], k) for i, k in lab.items()}
    assert len(lab) == len(g) and len(pairs) == len({p[0] for p in pairs}) == 540
    assert len({p[1] for p in pairs}) >= 535  # close groups of eight may still share a leaf


def _near_groups(sizes, corr, seed=3):
    """Groups whose averages correlate by ``corr`` in pairs, given with their numbers."""
    rs = np.random.RandomState(seed)
    base = vectors.unit_rows(rs.randn(len(sizes) // 2 + 1, 64)) * 8
    own = vectors.unit_rows(rs.randn(len(sizes), 64)) * 8
    c = np.stack([np.sqrt(corr) * base[i // 2] + np.sqrt(1 - corr) * own[i] for i in range(len(sizes))])
    g = np.repeat(np.arange(len(sizes)), sizes)
    return c[g] + 0.8 * rs.randn(len(g), 64), g


def test_same_clusters_in_ten_layouts(spark):
    x, g = _near_groups([400, 300, 120, 60, 30, 14, 12, 10], 0.4)
    rs = np.random.RandomState(1)
    want, by_group = None, np.argsort(g, kind="stable")
    orders = [by_group, by_group[::-1], np.argsort(np.arange(len(g)) % 7, kind="stable"), *(rs.permutation(len(g)) for _ in range(7))]
    for i, order in enumerate(orders):
        df = _df(spark, [(f"c{j:05d}", x[j], T) for j in order]).coalesce(1 + i % 4) if i else _df(spark, [(f"c{j:05d}", x[j], T) for j in order])
        assigned, _ = clusters.similarity_clusters(df, "cell_id", "exprs", max_leaves=(512, 40)[i % 2])
        lab = {int(r["cell_id"][1:]): r["cluster_no"] for r in assigned.collect()}
        groups = {frozenset(j for j in lab if lab[j] == k) for k in set(lab.values())}
        want = groups if want is None else want
        assert groups == want
    assert want == {frozenset(np.flatnonzero(g == k).tolist()) for k in range(8)}


def test_repair_cuts_and_joins():
    x, g = _near_groups([40, 40, 40, 40], 0.3)
    mixed = clusters._sums(x, g // 2, g % 2, 2).repaired(0.5)  # two groups each of two
    assert len(mixed.n) == 4 and sorted(mixed.n.sum(1)) == [40] * 4
    halved = clusters._sums(x, g * 2 + np.arange(160) % 2, np.zeros(160, np.int64), 8).repaired(0.5)  # every group cut in two
    assert len(halved.n) == 4 and sorted(halved.n.sum(1)) == [40] * 4


def test_clusters_of_nothing_and_of_copies(spark):
    a, t = clusters.similarity_clusters(_df(spark, []), "cell_id", "exprs")
    assert a.count() == 0 and t.count() == 0
    v = np.random.RandomState(1).rand(64).tolist()
    a, t = clusters.similarity_clusters(_df(spark, [(f"c{i}", v, T) for i in range(50)]), "cell_id", "exprs")
    assert {r["cluster_no"] for r in a.collect()} == {0} and t.first()["n_members"] == 50
