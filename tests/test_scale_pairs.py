"""Pairs of rows by blocks: the same results as brute force, whatever the blocks, and no pair sent through a join."""

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from pagewright.operators import blocks, knn, workflow
from pagewright.plans import base, library
from pagewright.plans.scratch import keep

Q = library.queries()


def rows(df) -> list:
    return sorted(map(tuple, df.collect()))


def vectors(spark, m: np.ndarray, names=("p", "q")):
    return spark.createDataFrame([(i, names[i % len(names)], [float(x) for x in r]) for i, r in enumerate(m)], "id long, class string, features array<double>")


def no_pairs(monkeypatch):
    def stop(*_, **__):
        raise AssertionError("all pairs in a join")

    monkeypatch.setattr(knn, "unique_distances", stop)
    monkeypatch.setattr(knn, "distance", stop)


@pytest.mark.parametrize("name", ["kdtree_k_nearest_neighbors", "knn_nearest", "knn_classify", "knndistance_statistics"])
def test_blocks_are_not_broadcast(spark, name):
    assert "BroadcastExchange HashedRelation" not in Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["city_block", "l2", "fast_euclidean", "chebyshev"])
@pytest.mark.parametrize("width", [3, 16])
def test_rough_distances_lose_no_neighbour(kind, width):
    r = np.random.default_rng(3)
    for scale in (1.0, 1e-30, 1e20, 0.0):
        a = np.round(r.normal(size=(40, width)) * 3) / 3 * scale
        ids = np.arange(40)
        near = blocks.Near(a, a, kind, np.ones(width))
        i, j, d, rank = near.best(slice(0, 40), 4, ids, ids)
        full = blocks.distances(a, a, kind, np.ones(width))
        np.fill_diagonal(full, np.inf)
        want = np.argsort(full, axis=1, kind="stable")[:, :4]
        assert j.reshape(40, 4).tolist() == want.tolist() and d.tolist() == np.take_along_axis(full, want, axis=1).ravel().tolist()


def test_graph_stats_by_blocks(spark, monkeypatch):
    no_pairs(monkeypatch)
    g = vectors(spark, np.round(np.random.default_rng(7).normal(size=(40, 3)), 1))
    whole = rows(workflow.get_graph_stats(g, keep).withColumn("mean", F.round("mean", 6)))
    monkeypatch.setattr(blocks.block_pairs, "__defaults__", (12,))
    assert rows(workflow.get_graph_stats(g, keep).withColumn("mean", F.round("mean", 6))) == whole


def test_spanning_tree_breaks_ties_by_ends():
    m = np.zeros((5, 2))
    src, dst, cost = blocks.spanning(np.arange(5), m, None, None, "city_block")
    assert sorted(zip(src.tolist(), dst.tolist(), strict=True)) == [(0, 1), (0, 2), (0, 3), (0, 4)] and not cost.any()


def test_cluster_links_glyphs_of_different_classes(spark):
    of = Q["cluster"](spark, SF).join(base.glyphs(spark, SF), "id").groupBy("cluster").agg(F.countDistinct("class").alias("n"))
    assert of.where("n > 1").count() > 0


def test_glyph_stats_by_blocks(spark, monkeypatch):
    no_pairs(monkeypatch)
    m = np.round(np.random.default_rng(5).normal(size=(41, 3)) * 2)
    monkeypatch.setattr(blocks.block_pairs, "__defaults__", (12,))
    got = {r[0]: tuple(r)[1:] for r in knn.get_glyphs_stats(vectors(spark, m), keep=keep).collect()}
    for c, part in (("p", m[::2]), ("q", m[1::2])):
        d = np.abs(part[:, None] - part[None]).sum(axis=2)[np.triu_indices(len(part), 1)]
        assert got[c] == pytest.approx((len(part), d.mean(), d.std(ddof=1), np.median(d)))


def test_rows_within_by_blocks(spark, monkeypatch):
    no_pairs(monkeypatch)
    m = np.round(np.random.default_rng(6).normal(size=(50, 9)), 1)
    got = rows(knn.distances_from(vectors(spark, m[:5]), vectors(spark, m), 9.0))
    d = blocks.distances(m[:5], m, "city_block", np.ones(9))
    assert got == sorted((i, j, d[i, j]) for i in range(5) for j in range(50) if d[i, j] < 9.0)


def test_components_are_clustered_without_a_join_of_pairs(spark, monkeypatch):
    no_pairs(monkeypatch)
    assert Q["cc_and_cluster"](spark, SF).count() > 0
