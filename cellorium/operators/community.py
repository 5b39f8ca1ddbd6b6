"""Communities of a weighted undirected graph, for graphs that fit the driver.

All take a symmetric weight matrix without self loops and return labels from 0 in
the order of first members.  Label propagation also exists as DataFrame joins for
graphs of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from math import log2
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _tidy(lab) -> np.ndarray:
    seen: dict = {}
    return np.array([seen.setdefault(v, len(seen)) for v in lab], dtype=np.int64)


def modularity(w: np.ndarray, lab: np.ndarray, resolution: float = 1.0) -> float:
    m2 = w.sum()
    if m2 == 0:
        return 0.0
    d = w.sum(1)
    same = lab[:, None] == lab[None, :]
    return float(((w - resolution * np.outer(d, d) / m2) * same).sum() / m2)


def _move(w: np.ndarray, lab: np.ndarray, rs, resolution: float) -> np.ndarray:
    """Local moves until no node gains modularity."""
    d, m2 = w.sum(1), w.sum()
    lab = lab.copy()
    tot = np.bincount(lab, weights=d, minlength=len(w))
    moved = True
    while moved:
        moved = False
        for i in rs.permutation(len(w)):
            a = lab[i]
            tot[a] -= d[i]
            links = np.bincount(lab, weights=w[i], minlength=len(w))
            links[a] -= w[i, i]
            near = np.unique(np.r_[lab[w[i] > 0], a])
            gain = links[near] - resolution * tot[near] * d[i] / m2
            b = near[int(np.argmax(np.round(gain, 12)))]
            if gain[near == b][0] > gain[near == a][0] + 1e-12:
                moved = True
            else:
                b = a
            lab[i] = b
            tot[b] += d[i]
    return _tidy(lab)


def _aggregate(w: np.ndarray, lab: np.ndarray) -> np.ndarray:
    h = np.eye(lab.max() + 1)[lab]
    return h.T @ w @ h


def louvain(w: np.ndarray, seed: int = 1, resolution: float = 1.0) -> np.ndarray:
    """Modularity by local moves and aggregation."""
    if w.sum() == 0:
        return np.arange(len(w))
    rs, lab, g = np.random.RandomState(seed), np.arange(len(w)), w.copy()
    while True:
        part = _move(g, np.arange(len(g)), rs, resolution)
        if part.max() + 1 == len(g):
            return _tidy(lab)
        lab, g = part[lab], _aggregate(g, part)


def leiden(w: np.ndarray, seed: int = 1, resolution: float = 1.0) -> np.ndarray:
    """Louvain with a refinement: communities are split into well-connected parts before aggregation."""
    if w.sum() == 0:
        return np.arange(len(w))
    rs, lab, g = np.random.RandomState(seed), np.arange(len(w)), w.copy()
    start = np.arange(len(g))
    while True:
        part = _move(g, start, rs, resolution)
        if part.max() + 1 == len(g):
            return _tidy(lab)
        fine = np.arange(len(g))
        for c in range(part.max() + 1):
            own = np.flatnonzero(part == c)
            fine[own] = own[_move(g[np.ix_(own, own)], np.arange(len(own)), rs, resolution)] if g[np.ix_(own, own)].sum() > 0 else own
        fine = _tidy(fine)
        lab, g = fine[lab], _aggregate(g, fine)
        first = [int(np.flatnonzero(fine == f)[0]) for f in range(fine.max() + 1)]
        start = _tidy(part[first])
        if len(g) == len(fine):
            return _tidy(start[lab])


def label_propagation(w: np.ndarray, seed: int = 1, most: int = 100) -> np.ndarray:
    rs, lab = np.random.RandomState(seed), np.arange(len(w))
    for _ in range(most):
        old = lab.copy()
        for i in rs.permutation(len(w)):
            if w[i].any():
                v = np.bincount(lab, weights=w[i], minlength=len(w))
                best = np.flatnonzero(v >= v.max() - 1e-12)
                lab[i] = lab[i] if lab[i] in best else best[0]
        if (lab == old).all():
            break
    return _tidy(lab)


def fast_greedy(w: np.ndarray, **_) -> np.ndarray:
    """Merge the pair of communities with the largest gain of modularity while it grows."""
    n, m2 = len(w), w.sum()
    if m2 == 0:
        return np.arange(n)
    e, lab = w / m2, np.arange(n)
    e = e.copy()
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        a = e.sum(1)
        dq = np.where((e > 0) & alive[:, None] & alive[None, :], 2 * (e - np.outer(a, a)), -np.inf)
        np.fill_diagonal(dq, -np.inf)
        i, j = np.unravel_index(np.argmax(dq), dq.shape)
        if not dq[i, j] > 0:
            break
        e[i] += e[j]
        e[:, i] += e[:, j]
        e[j] = e[:, j] = 0
        alive[j] = False
        lab[lab == j] = i
    return _tidy(lab)


def leading_eigenvector(w: np.ndarray, **_) -> np.ndarray:
    """Split along the leading eigenvector of the modularity matrix while modularity grows, then fine-tune by local moves."""
    m2, lab = w.sum(), np.zeros(len(w), np.int64)
    if m2 == 0:
        return np.arange(len(w))
    d = w.sum(1)
    todo, new = [0], 1
    while todo:
        c = todo.pop()
        own = np.flatnonzero(lab == c)
        b = w[np.ix_(own, own)] - np.outer(d[own], d[own]) / m2
        b -= np.diag(b.sum(1))
        val, vec = np.linalg.eigh(b)
        s = np.where(vec[:, -1] > 0, 1.0, -1.0)
        if val[-1] > 1e-9 and abs(s.sum()) < len(s) and s @ b @ s > 1e-9:
            lab[own[s > 0]] = new
            todo += [c, new]
            new += 1
    return _move(w, _tidy(lab), np.random.RandomState(0), 1.0)


def walktrap(w: np.ndarray, steps: int = 4, **_) -> np.ndarray:
    """Ward merges of adjacent communities by random-walk distance; the cut of largest modularity."""
    n = len(w)
    d = np.maximum(w.sum(1), 1e-12)
    p = np.linalg.matrix_power((w + np.diag(d / 10)) / (d + d / 10)[:, None], steps) / np.sqrt(d)[None, :]
    size, lab, adj = np.ones(n), np.arange(n), w > 0
    np.fill_diagonal(adj, False)
    far = lambda i, near: ((p[near] - p[i]) ** 2).sum(1) * (size[i] * size[near] / (size[i] + size[near]))
    # distances of adjacent communities, of each the least, and weights between communities: a merge changes one row and column of them
    d2, e, m2 = np.full((n, n), np.inf), w.astype(float), w.sum()
    for i in range(n):
        near = np.flatnonzero(adj[i, i:]) + i
        d2[i, near] = d2[near, i] = far(i, near)
    least, total = d2.min(1) if n else np.zeros(0), w.sum(1)
    best, best_q, q = lab.copy(), 0.0, 0.0
    for _ in range(n - 1):
        i = int(np.argmin(least))
        if not np.isfinite(least[i]):
            break
        j = int(np.argmin(d2[i]))
        q += 2 * (e[i, j] - total[i] * total[j] / m2) / m2
        p[i] = (p[i] * size[i] + p[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        total[i] += total[j]
        e[i] += e[j]
        e[:, i] += e[:, j]
        adj[i] |= adj[j]
        adj[j] = adj[:, j] = adj[i, i] = False
        near = np.flatnonzero(adj[i])
        adj[near, i] = True
        d2[i] = d2[j] = d2[:, j] = np.inf
        d2[i, near] = d2[near, i] = far(i, near)
        least[j] = np.inf
        least[near] = d2[near].min(1)
        least[i] = d2[i].min()
        lab[lab == j] = i
        if q > best_q + 1e-12:
            best, best_q = lab.copy(), q
    return _tidy(best)


def edge_betweenness(w: np.ndarray, **_) -> np.ndarray:
    """Remove the edge most shortest paths use, again and again; the partition of largest modularity (small graphs)."""
    g = w > 0
    n = len(w)

    def parts() -> np.ndarray:
        lab, k = np.full(n, -1), 0
        for s in range(n):
            if lab[s] < 0:
                todo = [s]
                lab[s] = k
                while todo:
                    for v in np.flatnonzero(g[todo.pop()] & (lab < 0)):
                        lab[v] = k
                        todo.append(v)
                k += 1
        return lab

    best = parts()
    best_q = modularity(w, best)
    while g.any():
        score = np.zeros((n, n))
        for s in range(n):
            dist, ways, order = np.full(n, -1), np.zeros(n), [s]
            dist[s], ways[s] = 0, 1
            for u in order:
                for v in np.flatnonzero(g[u]):
                    if dist[v] < 0:
                        dist[v] = dist[u] + 1
                        order.append(v)
                    if dist[v] == dist[u] + 1:
                        ways[v] += ways[u]
            flow = np.ones(n)
            for v in reversed(order):
                for u in np.flatnonzero(g[v] & (dist == dist[v] - 1)):
                    f = flow[v] * ways[u] / ways[v]
                    score[u, v] += f
                    score[v, u] += f
                    flow[u] += f
        i, j = np.unravel_index(np.argmax(np.where(g, score, -1)), g.shape)
        g[i, j] = g[j, i] = False
        lab = parts()
        q = modularity(w, lab)
        if q > best_q + 1e-12:
            best, best_q = lab, q
    return _tidy(best)


def spinglass(w: np.ndarray, seed: int = 1, spins: int = 25, sweeps: int = 60, **_) -> np.ndarray:
    """Simulated annealing of modularity over at most ``spins`` states, then local moves."""
    rs, n, m2 = np.random.RandomState(seed), len(w), w.sum()
    if m2 == 0:
        return np.arange(n)
    d, k = w.sum(1), min(spins, n)
    lab = rs.randint(0, k, n)
    tot = np.bincount(lab, weights=d, minlength=k)
    for t in np.geomspace(1.0, 0.01, sweeps):
        for i in rs.permutation(n):
            tot[lab[i]] -= d[i]
            gain = np.bincount(lab, weights=w[i], minlength=k) - tot * d[i] / m2
            p = np.exp((gain - gain.max()) / (t * max(d[i], 1e-12)))
            lab[i] = rs.choice(k, p=p / p.sum())
            tot[lab[i]] += d[i]
    return _move(w, _tidy(lab), rs, 1.0)


class _Flow(NamedTuple):
    """A random walk between nodes (or modules): links, and per node its size, the flow that leaves it, jumps from it and its share of landings.

    ``both`` is the flow over a link in both directions; links are sorted by ``src``.
    """

    src: np.ndarray
    dst: np.ndarray
    both: np.ndarray
    size: np.ndarray
    leave: np.ndarray
    jump: np.ndarray
    land: np.ndarray

    @classmethod
    def walk(cls, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, tau: float) -> _Flow:
        """Stationary flow over links ``w`` with jumps to any node at the rate ``tau``, always from nodes without links."""
        d, land = np.bincount(src, weights=w, minlength=n), np.full(n, 1 / n)
        p, share, far = land, w / d[src], 1.0
        while far > 1e-14:
            new = (1 - tau) * np.bincount(dst, weights=p[src] * share, minlength=n) + (tau + (1 - tau) * p[d == 0].sum()) * land
            new /= new.sum()
            p, far = new, np.abs(new - p).sum()
        f, jump = (1 - tau) * p[src] * share, np.where(d == 0, p, tau * p)
        return cls(src, dst, f + f[np.lexsort((src, dst))], p, p - jump * land, jump, land)

    def sums(self, lab: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(size, leave, jump, land) of ``k`` modules."""
        add = lambda v: np.bincount(lab, weights=v, minlength=k)
        inner, jump, land = lab[self.src] == lab[self.dst], add(self.jump), add(self.land)
        links = np.bincount(lab[self.src[inner]], weights=self.both[inner], minlength=k) / 2
        return add(self.size), add(self.leave) - links - (jump * land - add(self.jump * self.land)), jump, land

    def modules(self, lab: np.ndarray) -> _Flow:
        """The walk between the modules of ``lab``."""
        k, a, b = int(lab.max()) + 1, lab[self.src], lab[self.dst]
        key, at = np.unique(a[a != b] * k + b[a != b], return_inverse=True)
        return _Flow(key // k, key % k, np.bincount(at, weights=self.both[a != b], minlength=len(key)), *self.sums(lab, k))

    def length(self) -> float:
        """Code length of the walk if every node is a module, without the entropy of the single nodes, which no partition changes."""
        return float(_plogp(self.leave.sum()) - 2 * _plogp(self.leave).sum() + _plogp(self.leave + self.size).sum())

    def moved(self, lab: np.ndarray, rs) -> np.ndarray:
        """Labels after moves of one node to the module of a neighbour or an empty one, each the best for its node, until none shortens the code."""
        n, lab = len(self.size), lab.copy()
        size, leave, jump, land = self.sums(lab, n)
        count, total, code = np.bincount(lab, minlength=n), float(leave.sum()), _plogp(leave + size) - 2 * _plogp(leave)
        free, at = list(np.flatnonzero(count == 0)[::-1]), np.searchsorted(self.src, np.arange(n + 1)).tolist()
        nodes = list(zip(self.leave.tolist(), self.size.tolist(), self.jump.tolist(), self.land.tolist()))
        moved = True
        while moved:
            moved = False
            for i in rs.permutation(n):
                a, own, (x, p, j, t) = lab[i], slice(at[i], at[i + 1]), nodes[i]
                links = np.bincount(lab[self.dst[own]], weights=self.both[own], minlength=n)
                near = np.flatnonzero(links)
                near = near[near != a]
                if count[a] > 1:
                    near = np.append(near, free[-1])
                if not len(near):
                    continue
                old = links[a] + j * (land[a] - t) + (jump[a] - j) * t
                new = links[near] + j * land[near] + jump[near] * t
                rest, wide, out = float(leave[a] - x + old), leave[near] + x - new, total + old - new
                code_a, code_b = _plogp(float(rest + size[a] - p)) - 2 * _plogp(rest), _plogp(wide + size[near] + p) - 2 * _plogp(wide)
                change = _plogp(out) - _plogp(total) + code_a - code[a] + code_b - code[near]
                if change.min() >= -1e-10:
                    continue
                k = int(np.argmin(np.round(change, 12)))
                b, moved = near[k], True
                if not count[b]:
                    free.pop()
                leave[a], code[a], leave[b], code[b], total = rest, code_a, wide[k], code_b[k], float(out[k])
                for m, v in ((size, p), (jump, j), (land, t), (count, 1)):
                    m[a] -= v
                    m[b] += v
                if not count[a]:
                    free.append(a)
                    leave[a] = size[a] = jump[a] = land[a] = code[a] = 0
                lab[i] = b
        return _tidy(lab)


def _plogp(x):
    return x * np.log2(np.maximum(x, 1e-300)) if isinstance(x, np.ndarray) else x * log2(max(x, 1e-300))


def _two_level(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, tau: float, rs) -> np.ndarray:
    """One search of the map equation: nodes, then modules of modules move while the code gets shorter; then, in turn, single
    nodes and the submodules of every module (found by the same search inside it) move again, until neither shortens it."""
    base = _Flow.walk(src, dst, w, n, tau)
    lab, best, turn, idle = np.arange(n), np.inf, 0, 0
    while True:
        member, g, start = np.arange(n), base, lab
        if turn and turn % 2 == 0 and lab.max() > 0:
            k, place = 0, np.zeros(n, np.int64)
            for c in range(lab.max() + 1):
                own, e = np.flatnonzero(lab == c), (lab[src] == c) & (lab[dst] == c)
                place[own] = np.arange(len(own))
                member[own] = k + (_two_level(place[src[e]], place[dst[e]], w[e], len(own), tau, rs) if len(own) > 1 else 0)
                k = member[own].max() + 1
            g, start = base.modules(member), np.zeros(k, np.int64)
            start[member] = lab
        last, new = np.inf, np.inf
        while new == np.inf or new < last - 1e-10:
            part, last = g.moved(start, rs), new
            member, g = part[member], g.modules(part)
            start, new = np.arange(len(g.size)), g.length()
        idle = 0 if new < best - 1e-10 else idle + 1
        lab, best, turn = member, min(best, new), turn + 1
        if idle == 2 or (idle and lab.max() == 0):
            return _tidy(lab)


def infomap(w: np.ndarray, seed: int = 1, trials: int = 10, tau: float = 0.15, each: Callable[[Callable, Sequence], Iterable] = map, **_) -> np.ndarray:
    """Two-level map equation of the walk with jumps: the shortest code of ``trials`` searches, each from single nodes in its own order.

    ``each`` applies the search to the seeds, in order; ``snn_cluster`` does so on the executors.
    """
    n = len(w)
    if w.sum() == 0:
        return np.arange(n)
    src, dst = np.nonzero(w)
    links = w[src, dst]
    base, best = _Flow.walk(src, dst, links, n, tau), (np.inf, None)
    for lab in each(lambda t: _two_level(src, dst, links, n, tau, np.random.RandomState(t)), range(seed, seed + trials)):
        cost = base.modules(lab).length()
        if cost < best[0] - 1e-10:
            best = (cost, lab)
    return best[1]


def optimal(w: np.ndarray, most: int = 12, **_) -> np.ndarray:
    """The partition of largest modularity by enumeration; raises for more than ``most`` nodes."""
    n = len(w)
    if n > most:
        raise ValueError(f"enumeration is limited to {most} nodes")
    best = [-np.inf, None]

    def go(i: int, lab: list[int], k: int) -> None:
        if i == n:
            q = modularity(w, np.array(lab))
            if q > best[0] + 1e-12:
                best[:] = [q, np.array(lab)]
            return
        for c in range(k + 1):
            go(i + 1, lab + [c], max(k, c + 1))

    go(0, [], 0)
    return _tidy(best[1]) if n else np.zeros(0, np.int64)


METHODS = {"louvain": louvain, "leiden": leiden, "prop": label_propagation, "greedy": fast_greedy, "eigen": leading_eigenvector, "walktrap": walktrap, "betweenness": edge_betweenness, "spinglass": spinglass, "infomap": infomap, "optimal": optimal}


def detect(w: np.ndarray, method: str = "eigen", **kw) -> np.ndarray:
    if method not in METHODS:
        raise ValueError(f"unknown community method {method!r}; known: {sorted(METHODS)}")
    return METHODS[method](w, **kw)


def propagate_labels(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label) for a graph of any size: synchronous weighted label propagation by joins.

    Ties and isolated oscillation are settled by preferring the smaller label;
    lineage is cut in the shared folder each second round.
    """
    from cellorium.session import cut_lineage

    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    lab = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for r in range(rounds):
        votes = both.join(lab, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.sum("weight").alias("v"))
        own = lab.select(F.col("node").alias("src"), "label", F.lit(1e-9).alias("v"))
        votes = votes.unionByName(own).groupBy("src", "label").agg(F.sum("v").alias("v"))
        w = Window.partitionBy("src").orderBy(F.desc(F.round("v", 9)), "label")
        lab = votes.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(F.col("src").alias("node"), "label")
        if r % 2:
            lab = cut_lineage(lab)
    return lab
