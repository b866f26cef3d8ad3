"""Density clusters over blocks against a tree from the full distance matrix."""

import numpy as np
import pytest

from tidemark.operators import density as D


def brute(keys, x, least):
    """Kruskal over all pairs, then every cluster's members as sets, from the root down."""
    n = len(keys)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, least]
    edges = sorted((max(d[i, j], core[i], core[j]), min(keys[i], keys[j]), max(keys[i], keys[j])) for i in range(n) for j in range(i))
    held = {k: frozenset([k]) for k in keys}
    tree, splits = [], {}
    for w, a, b in edges:
        if held[a] is not held[b]:
            both = held[a] | held[b]
            splits[both] = (w, held[a], held[b])
            tree.append((w, a, b))
            for k in both:
                held[k] = both

    def grown(members, born):
        """(stability, chosen clusters) of the cluster that begins as ``members``."""
        total, now, parts = 0.0, members, []
        while now in splits:
            w, one, two = splits[now]
            density = 1 / w if w > 0 else 1e300
            big = [m for m in (one, two) if len(m) >= least]
            total += sum(len(m) * (density - born) for m in (one, two) if len(big) == 2 or m not in big)
            if len(big) == 2:
                parts = [grown(m, density) for m in big]
                break
            if not big:
                break
            now = big[0]
        below = sum(p[0] for p in parts)
        if not parts or total >= below:
            return total, [members], parts
        return below, [m for p in parts for m in p[1]], parts

    whole = frozenset(keys)
    chosen = [m for p in grown(whole, 0.0)[2] for m in p[1]]
    label = {k: i for i, m in enumerate(sorted(chosen, key=min)) for k in m}
    return tree, {k: label.get(k, -1) for k in keys}


def points(seed, n=84, d=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (m, d)) for c, s, m in ((0, 0.3, n // 3), (4, 0.6, n // 3), (9, 0.2, n // 6))] + [rng.uniform(-5, 14, (n // 6, d))])
    x[7], x[8], x[9] = x[3], x[3], x[50]  # equal vectors
    return rng.permutation(10 * len(x))[: len(x)].tolist(), x


@pytest.mark.parametrize(("seed", "least", "block", "pivots"), [(1, 3, 16, 5), (3, 2, 1024, 1)])
def test_clusters_equal_brute_force(spark, seed, least, block, pivots):
    keys, x = points(seed)
    df = spark.createDataFrame([(k, v.tolist(), "c") for k, v in zip(keys, x, strict=True)], "id long, v array<double>, block string").repartition(4)
    tree, want = brute(keys, x, least)
    blocks, cells = D._blocks(df, "id", "v", pivots, block)
    cores = D.core_distances(blocks, cells, least).join(D._members(blocks), "id")
    assert sorted((r.w, r.a, r.b) for r in D.spanning_tree(blocks, cells, cores).collect()) == tree
    got = {r.id: r.cluster for r in D.density_clusters(df, "id", "v", least, pivots, block).collect()}
    assert got == want and len(set(want.values())) > 2


def test_rows_that_have_no_cluster(spark):
    rows = [(1, [0.0]), (2, [0.1]), (3, None), (None, [0.0]), (4, [0.2])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert sorted(((r.id or 0), r.cluster) for r in D.density_clusters(df, "id", "v", 3).collect()) == [(0, -1), (1, -1), (2, -1), (3, -1), (4, -1)]
    more = df.unionByName(spark.createDataFrame([(10 + i, [9 + i / 100]) for i in range(8)] + [(30 + i, [50 + i / 100]) for i in range(5)], "id long, v array<double>"))
    known = sorted((r.id, r.v) for r in more.collect() if r.id is not None and r.v is not None)
    want = brute([k for k, _ in known], np.array([v for _, v in known]), 3)[1]
    assert {r.id: r.cluster for r in D.density_clusters(more, "id", "v", 3).collect()} == want | {None: -1, 3: -1}
    assert D.density_clusters(df.where("id > 99"), "id", "v").collect() == []


def test_bounds_are_below_every_distance():
    rng = np.random.default_rng(3)
    x, heads = rng.normal(size=(200, 5)), rng.normal(size=(6, 5))
    d = D.distances(x, heads)
    cell = d.argmin(1)
    own = d[np.arange(200), cell]
    cells = D.Cells(heads, np.array([own[cell == c].min(initial=np.inf) for c in range(6)]), np.array([own[cell == c].max(initial=-np.inf) for c in range(6)]))
    all_pairs, low = D.distances(x, x), cells.bound(x)
    assert all((low[:, cell[j]] <= all_pairs[:, j]).all() for j in range(200))


def test_no_block_of_vectors_is_broadcast(spark):
    """Blocks were repeated for every cell they meet and then broadcast, as they look small in files."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = D.neighbours(df, "id", "v", 3, pivots=4, block=16)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    steps = [step for step in plan.split("\n\n") if ") BroadcastExchange" in step and "Input [" in step]
    assert steps and "vectors" in plan and not any("vectors" in step for step in steps)
    d = D.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), float(d[i, j]), k + 1) for i in range(300) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert {tuple(r) for r in found.select("id", "match", "distance", "place").collect()} == want


def test_a_pair_of_blocks_is_measured_once_and_only_where_it_can_matter(monkeypatch):
    """All pairs were measured, both ways, in every round."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[650:], ids = x[7], np.arange(700)  # 51 equal vectors
    counted, plain = [], D.measured
    monkeypatch.setattr(D, "measured", lambda a, b, i, j: counted.append(len(i)) or plain(a, b, i, j))
    d = D.distances(x, x)
    np.fill_diagonal(d, np.inf)
    parts = [D.Nearest(ids[at], x[at], 3) for at in (slice(0, 350), slice(350, 700))]
    for one, two in ((0, 0), (1, 1), (0, 1)):
        parts[one].meet(parts[two])
    order = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert (np.concatenate([p.m for p in parts]) == order).all() and (np.concatenate([p.d for p in parts]) == np.take_along_axis(d, order, axis=1)).all()
    core = np.sort(d, axis=1)[:, 2]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    edges = D.LeastEdges(ids, np.full(700, np.inf))
    halves = [(ids[at], x[at], core[at], ids[at]) for at in (slice(0, 350), slice(350, 700))]
    for one, two in ((0, 0), (1, 1), (0, 1)):
        edges.meet(halves[one], halves[two])
    want = [min((w[i, j], min(i, j), max(i, j), j) for j in range(700) if j != i) for i in range(700)]
    assert list(zip(*(v.tolist() for v in edges.best[1:]), strict=True)) == want
    assert sum(counted) < 0.1 * 700 * 700


def test_only_vectors_whose_lists_end_within_the_best_edge_are_compared():
    """Every round of the tree compared all vectors of all components again."""
    rng = np.random.default_rng(9)
    x, ids = rng.normal(size=(800, 8)), np.arange(800)
    x[790:] = x[3]  # equal vectors
    d = D.distances(x, x)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, : D.LISTED]
    near = np.take_along_axis(d, order, axis=1)
    core, reach = near[:, 2], near[:, -1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    comp = D.distances(x, x[:6]).argmin(1)
    listed = np.zeros((800, 800), bool)
    np.put_along_axis(listed, order, True, axis=1)
    listed |= listed.T

    def least(pairs):
        return [min(((w[i, j], min(i, j), max(i, j), comp[j]) for i, j in np.argwhere(pairs & (comp[:, None] == c) & (comp[None] != c)).tolist()), default=(np.inf,)) for c in range(6)]

    known = least(listed)
    best = np.array([e[0] for e in known])[comp]
    edges = D.LeastEdges(np.arange(6), np.array([e[0] for e in known]))
    halves = [slice(0, 400), slice(400, 800)]
    kept = 0
    for one, two in ((0, 0), (1, 1), (0, 1)):
        some = D.needed(*((reach[halves[k]], best[halves[k]]) for k in (one, two)))
        kept += sum(s.sum() for s in some)
        sides = [tuple(v[halves[k]][s] for v in (ids, x, core, comp)) for k, s in zip((one, two), some, strict=True)]
        if some[0].any() and some[1].any():
            edges.meet(*sides)
    met = dict(zip(edges.best[0].tolist(), zip(*(v.tolist() for v in edges.best[1:]), strict=True), strict=True))
    assert [min(known[c], met.get(c, (np.inf,))) for c in range(6)] == least(np.ones((800, 800), bool))
    assert kept < 0.5 * 2400
