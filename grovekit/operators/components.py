"""Connected components of an edge list, in rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.storage import discard, materialize

#: With so many edges or fewer (4 MB), one task ends the work.
TAIL_EDGES = 1 << 18


def union_find(u: list, v: list) -> dict:
    """Each node's smallest connected node."""
    up: dict = {}

    def root(x):
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for a, b in zip(u, v, strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for b in batches:
        u += b["u"].to_pylist()
        v += b["v"].to_pylist()
    found = union_find(u, v)
    yield pa.record_batch({"v": pa.array(found.keys(), pa.int64()), "c": pa.array(found.values(), pa.int64())})


def lightest_neighbour(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest id among each node and its neighbours. Partial minima come before the shuffle."""
    ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
    return ends.groupBy(F.col("e.u").alias("v")).agg(F.least(F.min("e.v"), F.col("v")).alias("c"))


def jump(parent: DataFrame) -> DataFrame:
    """One step of pointer jumping: each node's parent becomes its parent's parent."""
    up = parent.select(F.col("v").alias("c"), F.col("c").alias("top"))
    return parent.join(up, "c", "left").select("v", F.coalesce("top", "c").alias("c"))


def relabel(edges: DataFrame, parent: DataFrame) -> DataFrame:
    """Edges between what their ends have become, without internal and parallel ones."""
    out = edges
    for end in ("u", "v"):
        out = out.join(parent.select(F.col("v").alias(end), F.col("c").alias(f"{end}_c")), end).drop(end).withColumnRenamed(f"{end}_c", end)
    return out.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, tail_edges: int = TAIL_EDGES) -> DataFrame:
    """(v, c) for every node of ``edges`` (u long, v long): c is the smallest node that v reaches.

    Each round merges every node into the smallest of its neighbours, so at
    least half of the nodes that still have edges go. The number of edges is
    checked each round; few enough of them end in one task.
    """
    left = materialize(edges.select("u", "v").where("u is not null and v is not null"), "cc-edges")
    done: list[DataFrame] = []
    while (n := left.count()) > tail_edges:
        parent = materialize(jump(jump(lightest_neighbour(left))), "cc-parent")
        done.append(parent)
        before, left = left, materialize(relabel(left, parent), "cc-edges")
        discard(before)
    schema = "v long, c long"
    if n:
        label = materialize(left.coalesce(1).mapInArrow(_tail, schema), "cc-tail")
    else:
        label = edges.sparkSession.createDataFrame([], schema)
    for parent in reversed(done):
        up = label.select(F.col("v").alias("c"), F.col("c").alias("top"))
        label = materialize(parent.join(up, "c", "left").select("v", F.coalesce("top", "c").alias("c")), "cc-label")
    return label


def spanning_links(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Joins ``label`` (in place: each node's smallest node so far) along the links i-j."""
    while True:
        a, b = label[i], label[j]
        far = a != b
        if not far.any():
            return label
        i, j, a, b = i[far], j[far], a[far], b[far]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := label[label], label):
            label[:] = nxt
