"""Summaries and reports of a run."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.functions.scalars import env, hostname, utc_now
from grovekit.operators.forest import Forest, phase


def summary(forest: Forest) -> DataFrame:
    """One row: vertex_count, input_edge_count, selected_edge_count, rounds, total_weight."""
    e = forest.edges.agg(F.count(F.lit(1)).alias("selected_edge_count"), F.coalesce(F.sum("w"), F.lit(0)).alias("total_weight"))
    return e.select(
        F.lit(forest.graph.vertex_ids().count()).cast("long").alias("vertex_count"),
        F.lit(forest.graph.edges.count()).cast("long").alias("input_edge_count"),
        "selected_edge_count",
        F.lit(forest.rounds).alias("rounds"),
        "total_weight",
    )


def edge_lines(forest: Forest) -> DataFrame:
    """(line, a, b, w): the edges as text, for sorting by ends and weight."""
    e = forest.edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "w")
    return e.select(F.format_string("  %d-%d (%s)", "a", "b", F.col("w").cast("string")).alias("line"), "a", "b", "w")


def tree_lines(forest: Forest) -> DataFrame:
    """(line): each edge as ``u v w``, as text files of graphs have it."""
    return forest.edges.select(F.concat_ws(" ", "u", "v", F.col("w").cast("string")).alias("line"))


def text_summary(forest: Forest) -> DataFrame:
    """(line): a header with weight and count, then the edges by ends and weight."""
    head = summary(forest).select(F.format_string("MST weight = %s, edges = %d", F.col("total_weight").cast("string"), "selected_edge_count").alias("line"))
    body = edge_lines(forest).orderBy("a", "b", "w").select("line")
    return head.unionAll(body)


def key_values(forest: Forest, timings: dict[str, float], verified: bool) -> list[str]:
    """Lines for the console; the total is overhead and execution, without verification."""
    row = summary(forest).first()
    out = [f"{k}={v}" for k, v in row.asDict().items()]
    out += [f"{k}_seconds={timings.get(k, 0.0):.6f}" for k in ("overhead", "exec")]
    out.append(f"total_seconds={timings.get('overhead', 0.0) + timings.get('exec', 0.0):.6f}")
    out.append(f"verify_seconds={timings.get('verify', 0.0):.6f}")
    return [*out, f"verification={'MATCH' if verified else 'MISMATCH'}"]


def json_report(forest: Forest, checked: DataFrame, name: str, timings: dict[str, float], random: dict | None = None, source: str | None = None, render: tuple[bool | None, bool] = (None, False)) -> DataFrame:
    """(json): metadata, graph, configuration, timings, telemetry, capabilities, forest and verification.

    Seconds of phases that ``timings`` hasn't are those that the forest took.
    ``source`` is where the graph is from (by default named, or random with its
    parameters), ``render`` whether a drawing was asked for (None: not said) and
    made. Locks, kernels and atomic minima have no counterpart in this engine, so
    their counts are zero.
    """
    spark = forest.edges.sparkSession
    seconds = {**forest.seconds, **{k: float(v) for k, v in timings.items()}}
    loop = seconds.get("mst_loop", seconds.get("exec", 0.0))
    algorithm = seconds.get("algorithm", -1.0)
    lit = F.lit
    graph = [lit(name).alias("name"), lit(source or ("random" if random else "named")).alias("source"), F.col("m.vertex_count"), F.col("m.input_edge_count").alias("edge_count")]
    graph += [lit((random or {}).get(k)).cast("long").alias(k) for k in ("random_vertices", "random_extra_edges", "seed", "max_weight")]
    phases = ("scan", "reduce", "contract", "compress")
    time_ = [
        lit(seconds.get("total", seconds.get("overhead", 0.0) + loop)).alias("total_seconds"),
        lit(loop).alias("mst_loop_seconds"),
        lit(algorithm if algorithm >= 0 else loop).alias("algorithm_seconds"),
        lit(seconds.get("verify", 0.0)).alias("sequential_cpu_verification_seconds"),
        *[lit(seconds.get(p, 0.0)).alias(f"{p}_seconds") for p in phases],
    ]
    rest = loop - sum(seconds.get(p, 0.0) for p in phases)
    telemetry = [
        *[(lit(seconds.get(p, 0.0)) * 1000).alias(f"{p}_time_pure_ms") for p in phases[:3]],
        (lit(seconds.get("overhead", 0.0)) * 1000).alias("allocation_and_overhead_ms"),
        lit(0).cast("long").alias("dsu_contention_retries"),
        lit(0.0).alias("kernel_launch_overhead_estimated_ms"),
        lit(0).cast("long").alias("cuda_atomic_min_collision_count"),
        lit(0.0).alias("cuda_atomic_min_collision_rate"),
        (lit(rest) * 1000).alias("unattributed_residual_ms"),
    ]
    m, v = summary(forest).alias("m"), checked.alias("v")
    whole = F.struct(
        lit("spark").alias("backend"),
        F.col("v.success").alias("success"),
        lit(utc_now()).alias("timestamp"),
        lit(hostname()).alias("hostname"),
        lit(env("SLURM_JOB_ID")).alias("slurm_job_id"),
        F.struct(*graph).alias("graph"),
        F.struct(lit(render[0]).cast("boolean").alias("render_requested"), lit(render[1]).alias("render_enabled")).alias("configuration"),
        F.struct(*time_).alias("timings"),
        F.struct(*telemetry).alias("telemetry_details"),
        F.struct(lit(spark.version).alias("spark"), lit(spark.sparkContext.defaultParallelism).alias("parallelism")).alias("capabilities"),
        F.struct("m.*").alias("mst"),
        F.struct("v.*").alias("verification"),
    )
    return m.crossJoin(v).select(F.to_json(whole).alias("json"))


def write_report(report: DataFrame, path: str | None) -> bool:
    """Writes the report if there is a path; False where that fails or isn't asked for."""
    if not path:
        return False
    try:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(report.first().json + "\n")
    except OSError:
        return False
    return True
