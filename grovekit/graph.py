"""The graph: an edge list with explicit ids, and the vertices if they are known.

An edge is (eid BIGINT, u BIGINT, v BIGINT, w of any orderable type). The order
of edges is by (w, eid), which is total, so the minimum spanning forest is one
set of edges whatever the strategy.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.storage import materialize


class InvalidGraph(ValueError):
    """The edges or vertices break a rule of the data model."""


@dataclass(frozen=True)
class Graph:
    edges: DataFrame  # eid, u, v, w
    vertices: DataFrame | None = None  # v; None: the ends of the edges

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | int | None = None) -> Graph:
        """``vertices``: a frame with v, or their number if they are 0 to that less one."""
        if isinstance(vertices, int):
            vertices = edges.sparkSession.range(vertices).select(F.col("id").alias("v"))
        return Graph(edges.select("eid", "u", "v", "w"), vertices)

    def vertex_ids(self) -> DataFrame:
        return self.vertices if self.vertices is not None else ends(self.edges).distinct()

    def written(self) -> Graph:
        """The same with its edges in the shared folder, for what reads them more than once."""
        return replace(self, edges=materialize(self.edges, "graph"))

    def normalized(self) -> Graph:
        """Ends in order, the smaller first."""
        return replace(self, edges=self.edges.select("eid", *normalized_ends(), "w"))

    def without_loops(self) -> Graph:
        return replace(self, edges=self.edges.where("u <> v"))

    def simple(self) -> Graph:
        """Without loops, and the lightest edge of each two ends. The forest stays the same."""
        best = lightest(self.edges.where("u <> v").withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")}), "a", "b")
        return replace(self, edges=best.select("eid", F.col("a").alias("u"), F.col("b").alias("v"), "w"))

    def validate(self) -> Graph:
        """Itself; ``InvalidGraph`` if there are null or NaN weights, null or unknown ends, or an id twice."""
        checks = violations(self).groupBy("reason").count().orderBy("reason").collect()
        if checks:
            raise InvalidGraph(", ".join(f"{r['count']} x {r.reason}" for r in checks))
        return self


def normalized_ends(u: str = "u", v: str = "v") -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def encoded_key(u: str = "u", v: str = "v") -> Column:
    """Both ends in one number, whichever comes first; ids that aren't from 0 to under 2^31 are an error."""
    low, high = F.least(u, v).cast("long"), F.greatest(u, v).cast("long")
    return _fitting((low >= 0) & (high < 1 << 31), F.shiftleft(low, 32).bitwiseOR(high), "a vertex")


def _fitting(fits: Column, key: Column, what: str) -> Column:
    return F.when(fits, key).when(fits.isNull(), None).otherwise(F.raise_error(F.lit(f"{what} is too large for a packed key")).cast("long"))


def packed_key(w: str = "w", eid: str = "eid") -> Column:
    """Weight and edge id in one number that sorts as they do; weights beyond 31 bits and ids beyond 32 are an error."""
    weight, number = F.col(w).cast("long"), F.col(eid).cast("long")
    return _fitting((F.abs(weight) < 1 << 31) & (number >= 0) & (number < 1 << 32), F.shiftleft(weight, 32).bitwiseOR(number), "a weight or an edge id")


def unpacked_id(key: str = "k") -> Column:
    return F.col(key).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def ends(edges: DataFrame) -> DataFrame:
    """(v) of both ends of each edge, repeats included."""
    return edges.select(F.explode(F.array("u", "v")).alias("v"))


def lightest(edges: DataFrame, *by: str) -> DataFrame:
    """The first edge, in the order of (w, eid), of each group; NULL weights come last."""
    order = F.struct(F.col("w").isNull().alias("none"), "w", "eid")
    rest = [c for c in edges.columns if c not in {"w", "eid", *by}]
    best = edges.groupBy(*by).agg(F.min(F.struct(order.alias("k"), *rest)).alias("best"))
    return best.select(*by, "best.k.w", "best.k.eid", *[f"best.{c}" for c in rest])


def violations(graph: Graph) -> DataFrame:
    """(eid, reason) for each rule that an edge breaks."""
    e = graph.edges
    floating = e.schema["w"].dataType.typeName() in ("double", "float")
    reasons = [
        F.when(F.col("eid").isNull(), "null edge id"),
        F.when(F.col("u").isNull() | F.col("v").isNull(), "null end"),
        F.when(F.col("w").isNull() | (F.isnan("w") if floating else F.lit(False)), "weight missing"),
    ]
    out = e.select("eid", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))
    twice = e.groupBy("eid").count().where("count > 1 and eid is not null").select("eid", F.lit("edge id twice").alias("reason"))
    out = out.unionByName(twice)
    if graph.vertices is not None:
        out = out.unionByName(unknown_ends(graph).select("eid", F.lit("unknown end").alias("reason")))
    return out


def unknown_ends(graph: Graph) -> DataFrame:
    """(eid, v) of each end that is no vertex."""
    at = graph.edges.select("eid", F.explode(F.array("u", "v")).alias("v")).where("v is not null")
    return at.join(graph.vertex_ids(), "v", "left_anti").select("eid", "v").distinct()


def ranked(edges: DataFrame) -> DataFrame:
    """``edges`` with k: increasing along (w, eid), in one sort over ranges and without a single task.

    The ids follow the order of the sorted partitions. They aren't repeatable,
    so the result is written.
    """
    return materialize(edges.orderBy("w", "eid").withColumn("k", F.monotonically_increasing_id()), "ranked")


def dense_ids(df: DataFrame, *order: str, name: str = "eid") -> DataFrame:
    """``df`` with gapless numbers from 0 along ``order``, by counts of the sorted partitions."""
    spark = df.sparkSession
    part = materialize(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "sorted")
    cut = F.shiftright("__m", 33)
    counts = {r[0]: r[1] for r in part.groupBy(cut).count().collect()}
    first, total = [], 0
    for p in sorted(counts):
        first.append((p, total))
        total += counts[p]
    base = F.broadcast(spark.createDataFrame(first, "__p long, __first long"))
    numbered = part.join(base, cut == F.col("__p")).withColumn(name, F.col("__first") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.drop("__m", "__p", "__first")
