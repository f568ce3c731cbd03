"""The relational steps of a round: project labels, filter, reduce, contract, relabel.

Frames: ``work`` (k, cu, cv) has the edges left, between components, with k
their rank; ``parent`` (v, c) leads from a component to the one it merges into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.operators.components import jump


def identity(vertices: DataFrame) -> DataFrame:
    """Each vertex is its own component."""
    return vertices.select("v", F.col("v").alias("c"))


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` with the components of both ends: cu, cv."""
    out = edges
    for end in ("u", "v"):
        out = out.join(labels.select(F.col("v").alias(end), F.col("c").alias(f"c{end}")), end)
    return out


def external(edges: DataFrame) -> DataFrame:
    """Without edges inside a component, loops among them."""
    return edges.where("cu <> cv")


def offers(work: DataFrame) -> DataFrame:
    """(c, k): every edge offered to the components of both its ends."""
    return work.select(F.explode(F.array("cu", "cv")).alias("c"), "k")


def candidates(work: DataFrame) -> DataFrame:
    """(c, k): the lightest edge that leaves each component. One number is aggregated, by hash, with partial minima."""
    return offers(work).groupBy("c").agg(F.min("k").alias("k"))


def chosen(best: DataFrame) -> DataFrame:
    """(k): the candidates, each edge once."""
    return best.select("k").distinct()


def successors(best: DataFrame, work: DataFrame) -> DataFrame:
    """(c, p): the component at the other end of each one's lightest edge."""
    return best.join(work, "k").select("c", F.when(F.col("cu") == F.col("c"), F.col("cv")).otherwise(F.col("cu")).alias("p"))


def mutual(succ: DataFrame) -> DataFrame:
    """(c, p) of the smaller of each two components that chose each other."""
    a, b = succ.alias("a"), succ.alias("b")
    return a.join(b, F.col("a.p") == F.col("b.c")).where("b.p = a.c and a.c < a.p").select("a.c", "a.p")


def broken(succ: DataFrame) -> DataFrame:
    """(v, c): ``succ`` as parents, the smaller of two that chose each other becoming a root.

    Under a total order of edges these pairs are the only cycles.
    """
    back = succ.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    root = (F.col("pp") == F.col("c")) & (F.col("c") < F.col("p"))
    return succ.join(back, "p").select(F.col("c").alias("v"), F.when(root, F.col("c")).otherwise(F.col("p")).alias("c"))


def is_settled(parent: DataFrame) -> bool:
    """Whether every parent is a root."""
    return parent.alias("a").join(parent.alias("b"), F.col("a.c") == F.col("b.v")).where("b.c <> b.v").isEmpty()


def roots(parent: DataFrame) -> DataFrame:
    return parent.where("v = c").select("v")


def moved(labels: DataFrame, parent: DataFrame) -> DataFrame:
    """``labels`` with each component replaced by its parent."""
    up = parent.select(F.col("v").alias("c"), F.col("c").alias("top"))
    return labels.join(up, "c", "left").select("v", F.coalesce("top", "c").alias("c"))


def contracted(work: DataFrame, parent: DataFrame) -> DataFrame:
    """The edges between the merged components, the lightest of each two; the others can't be chosen any more."""
    out = work
    for end in ("cu", "cv"):
        up = parent.select(F.col("v").alias(end), F.col("c").alias("top"))
        out = out.join(up, end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
    out = out.where("cu <> cv").select("k", F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv"))
    return out.groupBy("cu", "cv").agg(F.min("k").alias("k")).select("k", "cu", "cv")


__all__ = [
    "broken", "candidates", "chosen", "contracted", "external", "identity", "is_settled", "jump", "labelled", "moved", "mutual", "offers", "roots", "successors",
]
