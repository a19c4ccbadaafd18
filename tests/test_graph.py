import math

import pytest
from pyspark.sql import functions as F

from tesselark.operators import graph

from .conftest import rows


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


RING = [(i, (i + 1) % 8) for i in range(8)] + [(i, (i + 3) % 8) for i in range(0, 8, 2)]
MULTI = [(1, 2), (1, 2), (1, 3), (2, 1), (3, 4), (5, 1), (4, 4)]


def brute_rank(pairs, nodes, damping, steps, chosen=None):
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    on = {n: 1.0 if chosen is None or n in chosen else 0.0 for n in nodes}
    w = dict(on)
    for _ in range(steps):
        lost = sum(w[n] for n in nodes if n not in out)
        new = {n: (1 - damping) * on[n] + damping * lost / len(nodes) for n in nodes}
        for a, bs in out.items():
            for b in bs:
                new[b] += damping * w[a] / len(bs)
        w = new
    return w


def test_pagerank_equals_brute_force_and_keeps_its_mass(spark):
    nodes = {1, 2, 3, 4, 5, 6}
    table = spark.createDataFrame([(n, n % 2) for n in nodes], "id long, odd int")
    got = {r.id: r.pagerank for r in graph.pagerank(edges(spark, MULTI), table, steps=10).collect()}
    want = brute_rank(MULTI, nodes, 0.85, 10)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(6)
    odd = {r.id: r.pagerank for r in graph.pagerank(edges(spark, MULTI), table, steps=5, chosen=F.col("odd") == 1).collect()}
    even = {r.id: r.pagerank for r in graph.pagerank(edges(spark, MULTI), table, steps=5, chosen=F.col("odd") == 0).collect()}
    assert odd == pytest.approx(brute_rank(MULTI, nodes, 0.85, 5, {1, 3, 5})) and sum(odd.values()) == pytest.approx(3)
    assert {n: odd[n] + even[n] for n in nodes} == pytest.approx(brute_rank(MULTI, nodes, 0.85, 5))


def test_pagerank_converges(spark):
    got = {r.id: r.pagerank for r in graph.pagerank(edges(spark, RING)).collect()}
    assert got == pytest.approx(brute_rank(RING, set(range(8)), 0.85, 200), rel=1e-6)


def test_markov_weights(spark):
    splits = [(i, (i + 1) % 4) for i in range(4)] + [(i, (i + 2) % 4) for i in (0, 2)]
    got = {r.id: r.weight for r in graph.markov(edges(spark, splits), 1e-9, 400).collect()}
    w = dict.fromkeys(range(4), 1.0)
    out = {0: [1, 2], 1: [2], 2: [3, 0], 3: [0]}
    for _ in range(2000):
        new = dict.fromkeys(range(4), 0.0)
        for a, bs in out.items():
            for b in bs:
                new[b] += w[a] / len(bs)
        w = new
    assert got == pytest.approx(w, rel=1e-3)


def test_uniform_rank_sums_to_one(spark):
    got = [r.weight for r in graph.uniform_rank(edges(spark, MULTI), steps=12).collect()]
    assert sum(got) == pytest.approx(1.0)


def test_degrees(spark):
    nodes = spark.createDataFrame([(n,) for n in range(1, 7)], "id long")
    assert rows(graph.out_degree(edges(spark, MULTI), nodes)) == [(1, 3), (2, 1), (3, 1), (4, 1), (5, 1), (6, 0)]
    assert rows(graph.in_degree(edges(spark, MULTI), nodes)) == [(1, 2), (2, 2), (3, 1), (4, 1), (5, 0), (6, 0)]


def test_paths_and_circles(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (1, 4), (4, 3), (3, 5), (6, 6), (7, 8)])
    assert graph.shortest_path(e, 1, 5) == [1, 2, 3, 5]
    assert graph.shortest_path(e, 5, 1) == []
    assert graph.find_cycle(e, 1) == [1, 2, 3]
    assert graph.find_cycle(e, 6) == [] and graph.find_cycle(e, 7) == [] and graph.find_cycle(e, 99) == []
    assert graph.find_cycle(edges(spark, [(1, 2), (2, 1)]), 2) == [2, 1]
    assert rows(graph.distances(e, 1).select("id", "steps")) == [(1, 0), (2, 1), (3, 2), (4, 1), (5, 3)]


def test_closeness(spark):
    row = graph.closeness_harmonic(edges(spark, [(1, 2), (2, 3), (4, 1)]), 1).first()
    assert row.closeness == pytest.approx(3 / 3) and row.harmonic == pytest.approx((1 + 0.5) / 3)
    assert math.isinf(graph.closeness_harmonic(edges(spark, [(1, 2), (2, 3)]), 3).first().closeness)


def test_reach_and_topics(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 2), (1, 1)])
    assert rows(graph.reachable(e)) == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
    roots = spark.createDataFrame([(1,), (3,)], "id long")
    assert rows(graph.two_hop_topics(e, roots)) == [(2, 2), (3, 1)]


def test_hubs_are_split_and_weigh_the_same(spark, monkeypatch):
    pairs = [(1, i) for i in range(2, 60)] + [(i, 1) for i in range(2, 30)] + [(i, i + 1) for i in range(2, 59)] + [(1, 5)] * 3
    want = {r.id: r.pagerank for r in graph.pagerank(edges(spark, pairs), steps=4).collect()}
    monkeypatch.setattr(graph, "HUB_LINKS", 10)
    walk = graph._Walk(graph.multiplicities(edges(spark, pairs)), graph.nodes_of(edges(spark, pairs)))
    assert walk.split and walk.links.where("src = 1").select("key").distinct().count() == 6
    assert {r.id: r.pagerank for r in graph.pagerank(edges(spark, pairs), steps=4).collect()} == pytest.approx(want)


def test_plans_do_not_grow_with_the_steps(spark):
    """Scans in the plan before any exchange is reused."""

    def scans(steps):
        plan = graph.pagerank(edges(spark, MULTI), steps=steps)._jdf.queryExecution().sparkPlan().toString()
        return plan.count("FileScan")

    assert scans(1) == scans(2) == scans(6) == 1


def test_a_step_moves_no_link(spark):
    walk = graph._Walk(graph.multiplicities(edges(spark, MULTI)), graph.nodes_of(edges(spark, MULTI)))
    plan = walk.step(walk.start(F.lit(1.0)), 0.85, F.lit(0.15), 0.0)._jdf.queryExecution().executedPlan().toString()
    tree = plan.split("FileScan parquet spark_catalog.default.links")[0].rsplit("Join", 1)[-1]
    assert "Exchange" not in tree.rsplit("BroadcastExchange", 1)[0] or "BroadcastHashJoin" in plan


def test_cached_distances(spark):
    cache = graph.DistanceCache(edges(spark, [(1, 2), (2, 3), (3, 1), (None, 2)]))
    assert [cache.distance(1, x) for x in (1, 2, 3, 9)] == [0, 1, 2, None] and list(cache.known) == [1]
    assert cache.distance(3, 2) == 2


def test_classes_of_ancestors_with_many_classes(spark):
    from tesselark.operators import classify

    parents = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (9, 10)], "id long, parent long")
    labels = spark.createDataFrame([(i, c) for i, c in [(1, 7), (2, 8), (3, 150), (4, 3), (9, None)]] + [(3, c) for c in range(200, 300)], "id long, classification int")
    circle = [7, 8, 150, *range(200, 300)]
    got = {r.id: list(r.classes) for r in classify.ancestor_classes(parents, labels).collect()}
    assert got == {1: circle, 2: circle, 3: circle, 4: sorted([3, *circle])}
