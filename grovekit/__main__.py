"""Command line: a graph by name, from a file or generated; its forest, verified; exit status 0 if that holds."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from grovekit.functions.layout import drawing
from grovekit.operators import report
from grovekit.operators.forest import STRATEGIES, minimum_spanning_forest
from grovekit.operators.verify import verify
from grovekit.sources import graphs as G
from grovekit.storage import materialize


#: Vertices, edges and seed of a generated graph that aren't given.
GENERATED = (200_000, 2_000_000, 12345)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grovekit", description=__doc__)
    p.add_argument("--graph", default="test", choices=sorted(G.CATALOG))
    p.add_argument("--input", help="a text file: V E, then u v w on each line")
    p.add_argument("--generate", nargs="*", type=int, metavar="N", help="a random connected graph of V vertices, E edges and a seed; by default 200000, 2000000 and 12345")
    p.add_argument("--random-vertices", type=int, default=64)
    p.add_argument("--random-extra-edges", type=int, default=128)
    p.add_argument("--random-seed", type=int, default=886261)
    p.add_argument("--random-max-weight", type=int, default=100)
    p.add_argument("--strategy", default="boruvka", choices=sorted(STRATEGIES))
    p.add_argument("--report", help="where to write the JSON report")
    p.add_argument("--render", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--benchmark", action="store_true", help="only the figures")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    began = time.perf_counter()
    spark = spark or SparkSession.builder.appName("grovekit").getOrCreate()
    timings: dict[str, float] = {}
    random = None
    try:
        with report.phase(timings, "overhead"):
            if a.input:
                graph, name = G.read_text(spark, a.input), a.input
                source = "file"
            elif a.generate is not None:
                if len(a.generate) > 3:
                    raise ValueError("--generate takes three numbers at most")
                graph, name, source = G.random_connected(spark, *a.generate, *GENERATED[len(a.generate) :]), "generated", "generated"
            else:
                config = G.RandomConfig(a.random_vertices, a.random_extra_edges, a.random_seed, a.random_max_weight) if a.graph == "random" else None
                if config:
                    random = {"random_vertices": config.vertices, "random_extra_edges": config.extra_edges, "seed": config.seed, "max_weight": config.max_weight}
                graph, name, source = G.load(spark, a.graph, config), a.graph, "random" if config else "named"
            graph = G.Graph(materialize(graph.edges, "input"), graph.vertices).validate()
    except ValueError as e:
        p.error(str(e))
    with report.phase(timings, "exec"):
        forest = minimum_spanning_forest(graph, a.strategy)
    with report.phase(timings, "verify"):
        checked = materialize(verify(graph, forest.edges), "checked")
        success = checked.first().success
    if not a.benchmark:
        for r in report.text_summary(forest).toLocalIterator():
            print(r.line)
        if a.render:
            print(drawing(forest, colours=sys.stdout.isatty()))
    timings["total"] = time.perf_counter() - began
    print(*report.key_values(forest, timings, success), sep="\n")
    report.write_report(report.json_report(forest, checked, name, timings, random, source, (a.render, bool(a.render) and not a.benchmark)), a.report)
    return int(not success)


if __name__ == "__main__":
    sys.exit(main())
