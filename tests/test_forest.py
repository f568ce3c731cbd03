"""Forests: golden values, strategies against each other, invariants, edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from grovekit.graph import Graph, InvalidGraph, encoded_key, packed_key, ranked
from grovekit.operators.components import connected_components, union_find
from grovekit.operators.forest import component_trace, components, minimum_spanning_forest
from grovekit.operators.verify import faults, verify
from grovekit.sources import graphs as G
from grovekit.storage import discard, materialize, scratch, work_dir

GOLDEN = {
    "triangle": (5, [0, 1], [3, 1]),
    "square": (5, [0, 2, 4], [4, 1]),
    "tie": (4, [0, 1, 2, 3], [5, 1]),
    "test": (30, [1, 3, 6, 9, 10, 12, 16, 19, 21, 23, 24], [12, 4, 1]),
    "dense16": (42, [0, 1, 2, 3, 5, 7, 8, 9, 10, 14, 15, 29, 31, 45, 46], [16, 3, 1]),
}


def ids(forest):
    return sorted(r.eid for r in forest.edges.select("eid").collect())


def kruskal(edges):
    """The independent check: (eid) of the forest and the component of each vertex."""
    up, out = {}, []

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for eid, u, v, w in sorted(edges, key=lambda e: (e[3], e[0])):
        a, b = root(u), root(v)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append(eid)
    return sorted(out), {x: root(x) for x in up}


def random_edges(seed, n, m, weights, kind=int):
    rnd = random.Random(seed)
    return [(i, rnd.randrange(n), rnd.randrange(n), kind(rnd.randint(*weights))) for i in range(m)]


@pytest.mark.parametrize(
    ("name", "strategy", "tail"),
    [*((name, "boruvka", 1 << 20) for name in GOLDEN), ("test", "boruvka", 0), ("test", "boruvka", 10), ("test", "filter", 1 << 20), ("test", "filter", 5), ("test", "kruskal", 1 << 20), ("dense16", "boruvka", 0)],
)
def test_named_graphs(spark, name, strategy, tail):
    """Edges, weight and the trace of rounds, by default and wherever the rounds run."""
    weight, expected, trace = GOLDEN[name]
    forest = minimum_spanning_forest(G.load(spark, name), strategy, tail)
    assert ids(forest) == expected
    assert forest.edges.agg(F.sum("w")).first()[0] == weight
    assert component_trace(forest) == trace
    assert forest.rounds == len(trace) - 1


@pytest.mark.parametrize("strategy", ["boruvka", "filter", "kruskal"])
@pytest.mark.parametrize("weights", [(1, 3), (-50, 50), (7, 7)])
def test_strategies_agree(spark, strategy, weights):
    """Loops, parallel edges, several components, ties, negative weights."""
    edges = random_edges(5, 40, 60, weights)
    graph = Graph.from_edges(spark.createDataFrame(edges, G.EDGE).repartition(3), 42)
    forest = minimum_spanning_forest(graph, strategy)
    expected, label = kruskal(edges)
    assert ids(forest) == expected
    found = {r.v: r.c for r in components(graph).collect()}
    assert found == {v: label.get(v, v) for v in range(42)}
    assert forest.edges.count() == 42 - len(set(found.values()))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_rounds_do_not_depend_on_partitions(spark, parts):
    edges = random_edges(9, 30, 80, (1, 4))
    graph = Graph.from_edges(spark.createDataFrame(edges, G.EDGE).repartition(parts))
    assert ids(minimum_spanning_forest(graph, tail_edges=0)) == kruskal(edges)[0]


def test_filter_falls_back_to_rounds(spark):
    edges = random_edges(2, 30, 90, (1, 9))
    graph = Graph.from_edges(spark.createDataFrame(edges, G.EDGE).repartition(4))
    assert ids(minimum_spanning_forest(graph, "filter", tail_edges=3)) == kruskal(edges)[0]


def test_doubles(spark):
    edges = [(0, 1, 2, 0.5), (1, 2, 3, -0.25), (2, 1, 3, 0.125)]
    graph = Graph.from_edges(spark.createDataFrame(edges, "eid long, u long, v long, w double"))
    assert ids(minimum_spanning_forest(graph)) == [1, 2]
    assert verify(graph, minimum_spanning_forest(graph).edges).first().success


@pytest.mark.parametrize("strategy", ["boruvka", "filter", "kruskal"])
def test_empty_and_single(spark, strategy):
    none = spark.createDataFrame([], G.EDGE)
    forest = minimum_spanning_forest(Graph.from_edges(none, 1), strategy)
    assert (forest.edges.count(), forest.rounds) == (0, 0)
    assert [tuple(r) for r in forest.components().collect()] == [(0, 0)]
    loop = spark.createDataFrame([(0, 3, 3, 1)], G.EDGE)
    assert minimum_spanning_forest(Graph.from_edges(loop), strategy).edges.count() == 0


def test_kruskal_refuses_what_one_task_can_not_hold(spark):
    with pytest.raises(ValueError, match="boruvka"):
        minimum_spanning_forest(G.load(spark, "test"), "kruskal", tail_edges=0)


@pytest.mark.parametrize("parts", [1, 5])
def test_kruskal_takes_more_edges_than_one_task_holds(spark, parts):
    """160 edges, of which a task holds 16 at a time."""
    edges = random_edges(11, 60, 160, (1, 9))
    graph = Graph.from_edges(spark.createDataFrame(edges, G.EDGE).repartition(parts), 62)
    found = minimum_spanning_forest(graph, "kruskal", tail_edges=4)
    assert ids(found) == kruskal(edges)[0]
    rounds = sorted(map(tuple, found.edges.select("eid", "round").collect()))
    assert rounds == sorted(map(tuple, minimum_spanning_forest(graph).edges.select("eid", "round").collect()))


def test_components_by_rounds_on_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    frame = spark.createDataFrame(path + star, "u long, v long")
    found = {r.v: r.c for r in connected_components(frame, tail_edges=0).collect()}
    assert found == union_find(*zip(*(path + star)))
    assert set(found.values()) == {0, 100}


def test_ranks_follow_the_order(spark):
    edges = random_edges(3, 50, 500, (1, 5))
    rows = sorted(ranked(spark.createDataFrame(edges, G.EDGE).repartition(7)).collect(), key=lambda r: r.k)
    assert [(r.w, r.eid) for r in rows] == sorted((w, e) for e, _, _, w in edges)


def test_verification_finds_differences(spark):
    graph = G.load(spark, "square")
    forest = minimum_spanning_forest(graph).edges
    assert verify(graph, forest).first().success
    row = verify(graph, forest.withColumn("w", F.col("w") + 1)).first()
    assert not row.success
    assert (row.expected_total_weight, row.actual_total_weight) == (5, 8)
    assert not verify(graph, forest.limit(2)).first().success


def test_faults_need_no_second_forest(spark):
    for seed in range(4):
        edges = random_edges(seed, 30, 90, (1, 6))
        graph = Graph.from_edges(spark.createDataFrame(edges, G.EDGE).repartition(3), 32)
        forest = minimum_spanning_forest(graph).edges.cache()
        assert not any(faults(graph, forest).values())
        assert verify(graph, forest, most=0).first().success
    inside = set(ids(minimum_spanning_forest(graph)))
    out = [e for e in edges if e[0] not in inside and e[1] != e[2]]
    more = forest.select("eid", "u", "v", "w").unionByName(spark.createDataFrame(out[:1], G.EDGE))
    assert faults(graph, more)["cycles"] == 1
    assert faults(graph, forest.where(F.col("eid") != min(inside)))["open"] > 0
    assert faults(graph, more.unionByName(spark.createDataFrame([(999, 1, 2, 1)], G.EDGE)))["unknown"] == 1
    square = G.load(spark, "square")
    heavy = square.edges.where("eid in (0, 2, 1)")
    assert faults(square, heavy)["lighter"] == 1 and not verify(square, heavy, most=0).first().success
    row = verify(square, heavy, most=0).first()
    assert (row.expected_total_weight, row.actual_total_weight, row.actual_edge_count) == (None, 6, 3)


def test_packed_keys_refuse_what_does_not_fit(spark):
    for row in ((1 << 31, 0), (0, 1 << 32), (0, -1)):
        with pytest.raises(Exception, match="too large"):
            spark.createDataFrame([row], "w long, eid long").select(packed_key()).collect()
    with pytest.raises(Exception, match="too large"):
        spark.createDataFrame([(1, 1 << 31)], "u long, v long").select(encoded_key()).collect()


def test_storage(spark, monkeypatch):
    with scratch(spark) as kept:
        a, b = (materialize(spark.range(3), "x") for _ in range(2))
        kept.append(b)
    assert b.count() == 3
    with pytest.raises(Exception, match="exist"):
        a.count()
    discard(b, spark.range(1))
    with pytest.raises(Exception, match="exist"):
        b.count()

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return Context

        @staticmethod
        def isDefined():
            return False

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        work_dir(Session)


def test_validation(spark):
    bad = [(0, 1, 2, 1.0), (0, 1, 3, float("nan")), (2, None, 1, 2.0), (3, 1, 9, None), (None, 1, 2, 1.0)]
    graph = Graph.from_edges(spark.createDataFrame(bad, "eid long, u long, v long, w double"), 4)
    with pytest.raises(InvalidGraph) as e:
        graph.validate()
    assert str(e.value) == "1 x edge id twice, 1 x null edge id, 1 x null end, 1 x unknown end, 2 x weight missing"
    assert G.load(spark, "tie").validate()


def test_simple_graph_keeps_the_lightest(spark):
    edges = spark.createDataFrame([(0, 1, 2, 5), (1, 2, 1, 3), (2, 2, 2, 1), (3, 1, 2, 3)], G.EDGE)
    assert [tuple(r) for r in Graph.from_edges(edges).simple().edges.select("eid", "u", "v", "w").collect()] == [(1, 1, 2, 3)]
