"""Analysis of benchmark runs: theory, measured speedup, shares and pivots, as DataFrames.

A run has backend, vertices, edges, density, seed, resources,
overhead_seconds, exec_seconds, total_seconds and verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "backend string, vertices int, edges int, density double, seed int, resources int, overhead_seconds double, exec_seconds double, total_seconds double, verified string"
)
#: Multiprocessors of the GPU, and the density of the slice.
MULTIPROCESSORS, REFERENCE_DENSITY = 142, 6.0


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV files with a header, by a fixed schema, as one frame."""
    return spark.read.schema(SCHEMA).option("header", True).csv(list(paths))


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").option("header", True).csv(path)


def of_backend(runs: DataFrame, backend: str) -> DataFrame:
    return runs.where(F.col("backend") == backend)


def run_at(runs: DataFrame, backend: str, density: float) -> DataFrame:
    return of_backend(runs, backend).where(F.col("density") == density).orderBy("edges").limit(1)


def reference_slice(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("density") == REFERENCE_DENSITY)


def _parts() -> tuple[Column, Column, Column, Column]:
    return F.col("edges").cast("double"), F.col("vertices").cast("double"), F.col("resources").cast("double"), F.col("backend")


def theoretical_speedup() -> Column:
    e, v, p, b = _parts()
    d = e / v
    return (
        F.when(b == "mpi", (e + v) / (e / p + v * F.log2(p)))
        .when(b == "openmp", (e + v) / (e / p + v))
        .when(b == "cuda", MULTIPROCESSORS * (d + 1) / (d + F.log2(v)))
        .otherwise(F.lit(1.0))
    )


def processors() -> Column:
    return F.when(F.col("backend") == "cuda", F.lit(float(MULTIPROCESSORS))).otherwise(F.col("resources").cast("double"))


def theory(runs: DataFrame) -> DataFrame:
    return runs.withColumn("speedup", F.round(theoretical_speedup(), 4)).withColumn("efficiency", F.round(theoretical_speedup() / processors(), 4))


def isoefficiency() -> Column:
    """Edges for each vertex from which half of the speedup is reached."""
    _, v, p, b = _parts()
    return F.when(b == "mpi", p * F.log2(p)).when(b == "openmp", p).when(b == "cuda", F.log2(v))


def thresholds(runs: DataFrame) -> DataFrame:
    return runs.where("backend <> 'sequential'").select("backend", F.round(isoefficiency(), 4).alias("threshold")).distinct()


def measured(runs: DataFrame) -> DataFrame:
    """Speedup and efficiency against the sequential run with as many edges."""
    base = of_backend(runs, "sequential").groupBy("edges").agg(F.min("exec_seconds").alias("base_seconds"))
    joined = runs.where("backend <> 'sequential'").join(base, "edges")
    speedup = F.col("base_seconds") / F.col("exec_seconds")
    return joined.select("backend", "edges", F.round(speedup, 4).alias("speedup"), F.round(speedup / processors(), 4).alias("efficiency"))


def by_density(runs: DataFrame) -> DataFrame:
    return runs.groupBy("density").pivot("backend", ["sequential", "openmp", "mpi", "cuda"]).agg(F.first("total_seconds", ignorenulls=True))


def overhead_share(runs: DataFrame) -> DataFrame:
    return runs.select("backend", "edges", F.round(F.col("overhead_seconds") / (F.col("overhead_seconds") + F.col("exec_seconds")), 4).alias("share"))
