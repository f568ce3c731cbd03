"""Verification of a forest: against one by Kruskal's way, or, beyond what one task holds, by the cycle property."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.functions.scalars import near
from grovekit.graph import Graph, ranked
from grovekit.operators import rounds
from grovekit.operators.forest import KRUSKAL_TIMES, TAIL_EDGES, Forest, minimum_spanning_forest
from grovekit.storage import discard, materialize


def totals(edges: DataFrame) -> DataFrame:
    return edges.agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("n"))


def verify(graph: Graph, found: DataFrame, strategy: str = "kruskal", eps: float = 1e-9, most: int = KRUSKAL_TIMES * TAIL_EDGES) -> DataFrame:
    """One row: success, expected and actual total weight and edge count.

    Success needs the same edges by id, the same number, and, since sums of
    doubles depend on their order, weights within ``eps``. Graphs of more than
    ``most`` edges are checked by ``faults`` instead of a second forest; what is
    expected is then the weight of the found ids in the graph, and null where
    there are faults.
    """
    b = totals(found).alias("b")
    if graph.edges.count() <= most:
        expected = minimum_spanning_forest(graph, strategy).edges
        sides = expected.select("eid", F.lit(1).alias("side")).unionAll(found.select("eid", F.lit(-1).alias("side")))
        wrong = sides.groupBy("eid").agg(F.sum("side").alias("more")).where("more <> 0").limit(1).count()
        a = totals(expected).alias("a")
    else:
        wrong = sum(faults(graph, found).values())
        known = totals(graph.edges.join(found.select("eid").distinct(), "eid"))
        a = (known if not wrong else known.select(F.lit(None).cast(known.schema["weight"].dataType).alias("weight"), F.lit(None).cast("long").alias("n"))).alias("a")
    weight = F.coalesce(near(F.col("b.weight"), F.col("a.weight"), eps), F.col("a.weight").isNull() & F.col("b.weight").isNull())
    same = F.coalesce(F.col("a.n") == F.col("b.n"), F.lit(False))
    return a.crossJoin(b).select(
        (F.lit(wrong == 0) & same & weight).alias("success"),
        F.col("a.weight").alias("expected_total_weight"),
        F.col("b.weight").alias("actual_total_weight"),
        F.col("a.n").alias("expected_edge_count"),
        F.col("b.n").alias("actual_edge_count"),
    )


def faults(graph: Graph, found: DataFrame) -> dict[str, int]:
    """What keeps ``found`` from being the forest of ``graph``, without another forest and for any size.

    ``unknown``: its edges that the graph hasn't, or has as loops; ``cycles``: its
    edges that close one; ``open``: other edges between its trees; ``lighter``:
    other edges that come before the last one on the path between their ends.
    That a forest without them is the one of least edges is the cycle property.
    The heaviest edge of a path is found along the rounds over the forest alone:
    it is one that a component of an end picked before both ends met.
    """
    order = ranked(graph.without_loops().edges)
    ids = found.select("eid")
    tree = order.join(ids.distinct(), "eid", "left_semi")
    left = materialize(tree.select("k", F.col("u").alias("cu"), F.col("v").alias("cv")), "tree")
    count, picked = left.count(), 0
    out = {"unknown": ids.count() - count, "cycles": 0, "open": 0, "lighter": 0}
    others = order.join(ids, "eid", "left_anti").select("k", F.col("u").alias("cu"), F.col("v").alias("cv"), F.lit(-1).cast("long").alias("last"))
    others = materialize(others, "others")
    while left.take(1):
        best = materialize(rounds.candidates(left), "best")
        picked += rounds.chosen(best).count()
        parent = materialize(rounds.jump(rounds.jump(rounds.broken(rounds.successors(best, left)))), "parent")
        while not rounds.is_settled(parent):
            parent = materialize(rounds.jump(rounds.jump(parent)), "parent")
        step = best.join(parent, best["c"] == parent["v"]).select(parent["v"], parent["c"].alias("top"), best["k"].alias("pick"))
        risen = others
        for end in ("cu", "cv"):
            own = step.select(F.col("v").alias(end), F.col("top").alias("t"), "pick")
            risen = risen.join(own, end, "left").withColumns({"last": F.greatest("last", "pick"), end: F.coalesce("t", end)}).drop("t", "pick")
        before, others = others, materialize(risen, "others")
        discard(before)
        out["lighter"] += others.where("cu = cv and k < last").count()
        before, others = others, materialize(others.where("cu <> cv"), "others")
        discard(before)
        before, left = left, materialize(rounds.contracted(left, parent), "tree")
        discard(before, best, parent)
    return out | {"cycles": count - picked, "open": others.count()}


def membership(graph: Graph, forest: Forest) -> DataFrame:
    """Every edge with is_msf."""
    flag = forest.edges.select("eid", F.lit(True).alias("is_msf"))
    return graph.edges.join(flag, "eid", "left").withColumn("is_msf", F.coalesce("is_msf", F.lit(False)))


def left_out(graph: Graph, forest: Forest) -> DataFrame:
    return graph.edges.join(forest.edges.select("eid"), "eid", "left_anti")
