"""The command line, and drawings."""

from __future__ import annotations

import json

import pytest

from grovekit.__main__ import main
from grovekit.functions.layout import FOREST_COLOUR, PALETTE, PLAIN, drawing, layout, painted
from grovekit.operators.forest import minimum_spanning_forest
from grovekit.sources import graphs as G


def test_run(spark, tmp_path, capsys):
    path = tmp_path / "report.json"
    assert main(["--graph=triangle", "--report", str(path), "--render"], spark) == 0
    out = capsys.readouterr().out
    assert "MST weight = 5, edges = 2\n  0-1 (3)\n  1-2 (2)\n" in out and "verification=MATCH" in out and "#" in out
    made = json.loads(path.read_text())
    assert made["mst"]["selected_edge_count"] == 2 and made["mst"]["rounds"] == 1
    assert made["configuration"] == {"render_requested": True, "render_enabled": True}
    assert made["graph"]["source"] == "named" and made["timings"]["total_seconds"] > made["timings"]["scan_seconds"] > 0
    assert len(made["telemetry_details"]) == 9


def test_sources_are_told(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text("3 2 0 1 2.5 1\n2 1.5")
    for args, source in ((["--input", f"file://{tmp_path}/g.txt"], "file"), (["--generate", "30", "60"], "generated"), (["--graph", "random"], "random")):
        assert main([*args, "--report", str(tmp_path / "r.json"), "--benchmark"], spark) == 0
        made = json.loads((tmp_path / "r.json").read_text())
        assert made["graph"]["source"] == source and made["configuration"] == {"render_enabled": False}


def test_generated_benchmark(spark, capsys):
    assert main(["--generate", "40", "90", "3", "--benchmark", "--strategy", "filter"], spark) == 0
    out = capsys.readouterr().out
    assert "selected_edge_count=39" in out and "MST weight" not in out


@pytest.mark.parametrize("args", [["--graph", "none"], ["--graph", "random", "--random-vertices", "1"], ["--generate", "5", "2", "1"], ["--strategy", "x"]])
def test_refusals(spark, args, capsys):
    with pytest.raises(SystemExit) as e:
        main(args, spark)
    assert e.value.code == 2


def test_layout(spark):
    places = {r.v: (r.x, r.y) for r in layout(G.load(spark, "test")).collect()}
    assert len(places) == 12 and len(set(places.values())) == 12
    assert all(0 <= x <= 1 and 0 <= y <= 1 for x, y in places.values())
    large = minimum_spanning_forest(G.random_connected(spark, 129, 200, 1))
    weight = large.edges.agg({"w": "sum"}).first()[0]
    assert drawing(large) == f"Graph visualization skipped for large graph: vertices = 129, edges = 200, MST weight = {weight}, MST edges = 128"
    with pytest.raises(ValueError, match="128"):
        layout(large.graph)


def test_vertices_stand_above_weights():
    place = {0: (2, 1), 1: (8, 1), 2: (5, 1)}
    rows = painted([(0, 1, 9, False)], place, 11, 3).split("\n")
    assert rows[1][5] == "2" and rows[1][2] == "0" and rows[1][8] == "1"
    rows = painted([(0, 1, 9, True)], {0: (2, 1), 1: (8, 1)}, 11, 3).split("\n")
    assert rows[1] == "  0# 9 ##1" or " 9 " in rows[1]
    coloured = painted([(0, 1, 9, True), (0, 2, 4, False)], {0: (0, 0), 1: (9, 0), 2: (0, 5)}, 11, 6, True)
    assert FOREST_COLOUR in coloured and PALETTE[2 % 5] in coloured and coloured.count("\x1b") >= 2 * coloured.count(PLAIN)
