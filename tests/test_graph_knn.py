import math

import numpy as np
from helpers import image  # noqa: F401

from pagewright.functions import lists as L
from pagewright.operators import geometry as G
from pagewright.operators import graph as H
from pagewright.operators import blocks, kernels, knn, segment, stats, workflow
from pagewright.plans.scratch import keep


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(c), "") for a, b, c in rows], "src long, dst long, cost double, label string")


DIJKSTRA = [(1, 2, 10), (1, 7, 5), (2, 6, 1), (2, 7, 2), (6, 8, 4), (7, 8, 2), (7, 2, 3), (7, 6, 9), (8, 1, 7), (8, 6, 6)]


def test_shortest_paths_golden(spark):
    start = spark.createDataFrame([(2,)], "id long")
    got = {r["id"]: (r["cost"], r["path"]) for r in H.shortest_paths(edges(spark, DIJKSTRA), start, keep).collect()}
    assert {k: v[0] for k, v in got.items()} == {2: 0, 8: 4, 1: 11, 6: 1, 7: 2}
    assert got[6][1] == [6, 2] and got[8][1] == [8, 7, 2]


def test_cycles_and_components(spark):
    e = edges(spark, [(1, 2, 1), (2, 3, 1), (5, 6, 1)])
    assert not H.is_cyclic(e, keep) and H.is_cyclic(edges(spark, DIJKSTRA), keep)
    assert H.nsubgraphs(H.nodes_of(e), e, keep) == 2 and H.size_of_subgraph(H.nodes_of(e), e, 3, keep) == 3
    assert H.has_path(e, 1, 3, keep) and not H.has_path(e, 3, 1, keep)


def test_spanning_tree_and_colours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, j, float(rng.integers(1, 50))) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.5]
    tree = H.minimum_spanning_tree(edges(spark, rows), keep).collect()
    parent = list(range(12))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    total = 0.0
    for a, b, c in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += c
    assert math.isclose(sum(r["cost"] for r in tree), total)
    colour = {r["id"]: r["color"] for r in H.colorize(H.nodes_of(edges(spark, rows)), edges(spark, rows), keep, 12).collect()}
    assert all(colour[a] != colour[b] for a, b, _ in rows)


def test_long_chain_is_one_component(spark):
    e = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in H.connected_components(e, keep).collect()} == {0}


KD = [(1, 1), (2, 1), (1, 3), (2, 4), (3, 4), (7, 2), (8, 3), (8, 4), (7, 5), (7, 5)]


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(rows)], "id long, p array<double>")


def nearest(spark, rows, q, k, **more):
    r = G.k_nearest_points(points(spark, [q]), points(spark, rows), k, **more).orderBy("rank").collect()
    return [tuple(rows[x["t"]]) for x in r]


def test_kd_golden(spark):
    assert nearest(spark, KD, (5.5, 3), 1) == [(7, 2)]
    assert nearest(spark, KD, (7, 5), 3) == [(7, 5), (7, 5), (8, 4)]
    more = [(1, 4), (2, 4), (1, 5), (3, 6), (8, 9), (3.2, 4.2), (4, 4), (5, 5), (3.8, 6), (8, 3)]
    assert nearest(spark, more, (5, 6), 3, kind=0)[0] == (5, 5)
    assert set(nearest(spark, more, (5, 6), 3, kind=0)) == {(5, 5), (3.8, 6), (3.2, 4.2)}
    assert nearest(spark, more, (5, 6), 3, kind=1) == [(5, 5), (3.8, 6), (3, 6)]
    assert set(nearest(spark, more, (5, 6), 3, kind=2, weights=[1, 0.5])) == {(5, 5), (3.8, 6), (4, 4)}


def train(spark, n=60, d=4):
    rng = np.random.default_rng(8)
    return spark.createDataFrame([(i, "ab"[i % 2], [float(x) + 3 * (i % 2) for x in rng.random(d)]) for i in range(n)], "id long, class string, features array<double>")


def test_blocks_find_what_broadcast_finds(spark, monkeypatch):
    t = train(spark)
    want = knn.nearest(t, t, 3, skip_self=True).select("q", "t", "rank").collect()
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 10)
    got = knn.nearest(t, t, 3, skip_self=True).select("q", "t", "rank").collect()
    assert sorted(got) == sorted(want)


def test_small_graphs_and_stores_are_as_large_ones(spark, monkeypatch):
    t = train(spark)
    want = sorted(r["id"] for r in knn.edit_cnn(t).collect())
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 10)
    assert sorted(r["id"] for r in knn.edit_cnn(t, keep=keep).collect()) == want
    rng = np.random.default_rng(3)
    e = spark.createDataFrame([(int(a), int(b), float(rng.integers(1, 9)), "") for a, b in rng.integers(0, 60, (70, 2))], "src long, dst long, cost double, label string")
    many = [sorted(map(tuple, H.minimum_spanning_tree(e, keep, small=n).collect())) for n in (0, 1000)]
    assert many[0] == many[1]
    roots = [sorted(map(tuple, H.connected_components(e, keep, "src", "dst", small=n).collect())) for n in (0, 1000)]
    assert roots[0] == roots[1]


def test_components_of_an_image_in_one_pass(spark):
    rng = np.random.default_rng(4)
    for density in (0.2, 0.5, 0.8):
        a = (rng.random((17, 23)) < density).astype(int)
        labels = kernels.label(a)
        got = kernels.components(a)
        assert ((got > 0) == (a > 0)).all()
        for k in range(1, labels.max() + 1):
            y, x = np.nonzero(labels == k)
            assert (got[y, x] == y[0] * 23 + x[0] + 2).all()
    px = spark.createDataFrame([(1, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, v int")
    one, other = (sorted(map(tuple, segment.cc_analysis(px, keep, largest=n).collect())) for n in (10**6, 1))
    assert one == other


def test_separable_classes(spark):
    t = train(spark)
    r = knn.accuracy(t, 3).first()
    assert (r["correct"], r["total"]) == (60, 60)
    assert knn.edit_mnn(t).count() == 60 and knn.edit_cnn(t).count() < 10
    assert workflow.guess_glyphs(t.select("id", "features"), t.limit(0)).select("name").distinct().first()["name"] == "unknown"


def test_lists(spark):
    v = [1, 2, 3]
    seen = [list(v)]
    while L.permute_list(v):
        seen.append(list(v))
    assert len(seen) == 6 and v == [1, 2, 3]
    df = spark.createDataFrame([([4, 1, 3, 2],)], "a array<int>")
    assert df.select(L.median("a"), L.median("a", True), L.argmax("a"), L.argmin("a")).first()[:] == (2.5, 3, 0, 1)
    assert L.decode_binary(L.encode_binary(b"abc" * 9)) == b"abc" * 9
    import re

    assert re.match(L.build_id_regex("latin.*.a"), "latin.small.a") and not re.match(L.build_id_regex("latin.*"), "greek")


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r, p = stats.pearsonr(df, "x", "y")
    assert math.isclose(r, np.corrcoef(x, y)[0, 1]) and 0 <= p <= 1
    assert math.isclose(stats.betai(2, 3, 0.4), 0.5248, abs_tol=1e-9) and math.isclose(stats.chisqprob(3.841458820694124, 1), 0.05, abs_tol=1e-9)
    assert math.isclose(stats.tprob(2.2281388519649385, 10), 0.05, abs_tol=1e-9)
    assert np.allclose(stats.glm(df, "y", ["x"]), np.polyfit(x, y, 1)[::-1])
