"""Generators, the catalog, text files and reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from grovekit.functions import runs as R
from grovekit.functions import scalars as S
from grovekit.operators import report
from grovekit.operators.forest import components, minimum_spanning_forest
from grovekit.operators.verify import verify
from grovekit.sources import graphs as G


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("weights", list(G.WEIGHTS))
@pytest.mark.parametrize("permute", [True, False])
def test_random_connected(spark, weights, permute):
    graph = G.random_connected(spark, 50, 120, 7, weights, permute)
    assert graph.validate().edges.count() == 120
    assert graph.edges.where("u = v").isEmpty()
    assert components(graph).select("c").distinct().count() == 1
    assert rows(graph.edges) == rows(G.random_connected(spark, 50, 120, 7, weights, permute).edges.repartition(5))


def test_random_connected_refuses(spark):
    for n, m in ((1, 3), (5, 3)):
        with pytest.raises(ValueError, match="connected"):
            G.random_connected(spark, n, m, 1)


@pytest.mark.parametrize("config", [(64, 128, 886261, 100), (2, 0, 1, 5), (9, 28, 3, 4), (300, 500, 5, 10)])
def test_random_simple(spark, config):
    config = G.RandomConfig(*config)
    edges = rows(G.random_simple(spark, config).edges)
    assert len(edges) == config.vertices - 1 + config.extra_edges
    assert [e[0] for e in edges] == list(range(len(edges)))
    assert all(u < v and 1 <= w <= config.max_weight for _, u, v, w in edges)
    assert len({(u, v) for _, u, v, _ in edges}) == len(edges)
    assert edges == rows(G.random_simple(spark, config).edges)


@pytest.mark.parametrize("config", [(1, 0, 1, 5), (4, 4, 1, 5), (4, 1, 1, 0), (4, -1, 1, 5)])
def test_random_config_refuses(config):
    with pytest.raises(ValueError, match="invalid random graph"):
        G.RandomConfig(*config)


def test_catalog(spark):
    sizes = {n: (g.vertex_ids().count(), g.edges.count()) for n in ("triangle", "square", "tie", "test", "sparse12", "dense16") for g in [G.load(spark, n)]}
    assert sizes == {"triangle": (3, 3), "square": (4, 5), "tie": (5, 5), "test": (12, 29), "sparse12": (12, 29), "dense16": (16, 55)}
    with pytest.raises(ValueError, match="unknown graph"):
        G.load(spark, "nothing")


def test_text_round_trip(spark, tmp_path):
    graph = G.load(spark, "test")
    path = f"file://{tmp_path}/g"
    G.write_text(graph, path)
    again = G.read_text(spark, path)
    assert rows(again.edges) == [(e, u, v, float(w)) for e, u, v, w in rows(graph.edges)]
    assert again.vertex_ids().count() == 12


def test_text_with_odd_blanks(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\n  3\t2 \n0 1   2.5\n\n 1\t2 -1\n")
    graph = G.read_text(spark, f"file://{tmp_path}/g.txt")
    assert rows(graph.edges) == [(0, 0, 1, 2.5), (1, 1, 2, -1.0)]
    (tmp_path / "stream.txt").write_text("3\n2 0 1\n2.5 1 2 -1 and more")
    assert rows(G.read_text(spark, f"file://{tmp_path}/stream.txt").edges) == [(0, 0, 1, 2.5), (1, 1, 2, -1.0)]
    (tmp_path / "parts").mkdir()
    for name, text in (("part-1", "2 3 1\n"), ("part-0", "4 3\n0 1 5\n1 2 4\n"), ("part-2", "\n")):
        (tmp_path / "parts" / name).write_text(text)
    assert rows(G.read_text(spark, f"file://{tmp_path}/parts").edges) == [(0, 0, 1, 5.0), (1, 1, 2, 4.0), (2, 2, 3, 1.0)]
    (tmp_path / "none.txt").write_text("x\n")
    with pytest.raises(ValueError, match="header"):
        G.read_text(spark, f"file://{tmp_path}/none.txt")
    (tmp_path / "bad.txt").write_text("3 5\n0 1 2\n")
    with pytest.raises(ValueError, match="edges"):
        G.read_text(spark, f"file://{tmp_path}/bad.txt")


def test_reports(spark, tmp_path):
    graph = G.load(spark, "square")
    forest = minimum_spanning_forest(graph)
    checked = verify(graph, forest.edges)
    made = json.loads(report.json_report(forest, checked, 'a "b"', {"mst_loop": 2.0, "scan": 0.001}).first().json)
    assert made["graph"]["name"] == 'a "b"'
    assert made["timings"]["algorithm_seconds"] == 2.0
    assert made["telemetry_details"]["scan_time_pure_ms"] == 1.0
    assert made["verification"]["success"] and made["mst"]["total_weight"] == 5
    path = tmp_path / "deep" / "r.json"
    assert report.write_report(report.json_report(forest, checked, "x", {}), str(path)) and json.loads(path.read_text())
    assert not report.write_report(checked, None)
    assert [r.line for r in report.text_summary(forest).collect()] == ["MST weight = 5, edges = 3", "  0-1 (1)", "  0-2 (1)", "  2-3 (3)"]
    lines = report.key_values(forest, {"overhead": 1.0, "exec": 2.0, "verify": 5.0}, True)
    assert "total_seconds=3.000000" in lines and "verification=MATCH" in lines


def test_runs_round_trip(spark, tmp_path):
    one = spark.createDataFrame([("mpi", 8, 16, 2.0, 1, 8, 0.5, 1.5, 2.0, "MATCH")], R.SCHEMA)
    R.append_runs(one, f"file://{tmp_path}/runs")
    R.append_runs(one.withColumn("backend", F.lit("sequential")).withColumn("exec_seconds", F.lit(3.0)), f"file://{tmp_path}/runs")
    back = R.read_runs(spark, f"file://{tmp_path}/runs")
    assert back.count() == 2 and back.schema == one.schema
    assert [tuple(r) for r in R.measured(back).collect()] == [("mpi", 16, 2.0, 0.25)]


def test_scalars(spark):
    row = spark.range(1).select(
        S.near(F.lit(-1000.0), F.lit(-1000.0001), 1e-6).alias("near"), S.verified(F.lit("pass")).alias("ok"), S.metric(F.lit("a=1 exec_seconds=0.25"), "exec_seconds").alias("m"), S.density(F.lit(7), F.lit(3)).alias("d")
    ).first()
    assert tuple(row) == (True, True, "0.25", 2.3333)


def test_edge_ids_follow_the_ends_whatever_their_size(spark, tmp_path):
    """keys that don't fit one number together."""
    for name, shift in (("small", 0), ("large", 1 << 32), ("huge", 1 << 40)):
        rows = [(s + shift, p + shift, 1 + (s + p) % 2, "A", 1.0) for s in range(4) for p in range(3)]
        spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_returnflag string, l_extendedprice double").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        found = G.supply(spark, f"{tmp_path}/{name}").edges.orderBy("eid").collect()
        assert [(r.u, r.v) for r in found] == sorted((s, p + 1_000_000) for s, p, *_ in rows)
        assert len({r.eid for r in found}) == len(rows)
