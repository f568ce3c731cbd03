"""Minimum spanning forests: ``boruvka``, ``kruskal`` and ``filter``.

All give the same edges, since the order by (w, eid) is total, and the same
rounds: a component's lightest edge is in the forest, so the rounds over the
forest's edges alone are those over all edges, wherever they are counted.
"""

from __future__ import annotations

import time
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.graph import Graph, ranked
from grovekit.operators import rounds
from grovekit.operators.components import connected_components, spanning_links
from grovekit.storage import discard, materialize

#: With so many contracted edges or fewer (24 MB), one task ends the work.
TAIL_EDGES = 1 << 20
#: ``kruskal`` takes so many times that in one task, and of more edges half as many at a time.
KRUSKAL_TIMES = 8
#: Edges of a partition that are reduced to their forest together.
CHUNK = 1 << 19
PICK = "k long, round int"


@dataclass(frozen=True)
class Forest:
    graph: Graph
    edges: DataFrame  # eid, u, v, w, round
    rounds: int
    seconds: dict[str, float] = field(default_factory=dict)  # of scan, reduce, contract and compress

    def components(self) -> DataFrame:
        """(v, c) of every vertex: c is the smallest vertex of its component."""
        label = connected_components(self.edges.select("u", "v"))
        every = self.graph.vertex_ids().select("v")
        return every.join(label, "v", "left").select("v", F.coalesce("c", "v").alias("c"))


class Strategy(Protocol):
    """From written work (k, cu, cv) to the picked ranks: (k, round)."""

    def __call__(self, work: DataFrame, tail_edges: int, seconds: dict[str, float]) -> DataFrame: ...


@contextmanager
def phase(seconds: dict[str, float], name: str) -> Iterator[None]:
    """Adds the seconds of a block, which has to run its own actions, to ``seconds``."""
    began = time.perf_counter()
    try:
        yield
    finally:
        seconds[name] = seconds.get(name, 0.0) + time.perf_counter() - began


def by_rounds(k: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranks that rounds pick, and the round of each, from 1 on."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.argsort(k, kind="stable")
    a, b = at[: len(u)][order], at[len(u) :][order]
    label, left = np.arange(len(nodes)), np.arange(len(k))
    picked, round_of = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    while True:
        x, y = label[a[left]], label[b[left]]
        between = x != y
        left, x, y = left[between], x[between], y[between]
        if not len(left):
            break
        best = np.full((2, len(nodes)), len(k))
        for side, ends in enumerate((x, y)):
            best[side, ends[::-1]] = left[::-1]  # the last one written is the lightest
        best = best.min(axis=0)
        chosen = np.unique(best[best < len(k)])
        picked.append(chosen)
        round_of.append(np.full(len(chosen), len(picked) - 1, np.int32))
        label = spanning_links(label[a[chosen]], label[b[chosen]], np.arange(len(nodes)))[label]
    return k[order][np.concatenate(picked)], np.concatenate(round_of)


def _joined(k: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kruskal's way, which shares nothing with the rounds: the ranks that join two trees, in order, then the ends and the smallest end of each one's tree."""
    order = np.argsort(k, kind="stable")
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)][order], at[len(u) :][order]
    up, left, out = array("q", range(len(nodes))), len(nodes) - 1, []
    for first in range(0, len(order), CHUNK):
        part = slice(first, first + CHUNK)
        for i, (x, y) in enumerate(zip(a[part].tolist(), b[part].tolist(), strict=True), first):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append(i)
                left -= 1
        if not left:  # one tree is left
            break
    top = np.array(up)
    while not np.array_equal(above := top[top], top):
        top = above
    return k[order[out]], nodes, nodes[top]


def _picks(k: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _joined(k, u, v)[0]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (eid, u, v, w) without those that the forest of their chunk leaves out: they are in no forest of more edges."""
    for whole in _chunks(batches):
        order = pc.sort_indices(whole, sort_keys=[("w", "ascending"), ("eid", "ascending")]).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        kept, _ = by_rounds(rank, whole["u"].to_numpy(), whole["v"].to_numpy())
        yield from whole.take(pa.array(np.sort(order[kept]))).combine_chunks().to_batches()


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for work (k, cu, cv)."""
    for whole in _chunks(batches):
        k = whole["k"].to_numpy()
        kept, _ = by_rounds(k, whole["cu"].to_numpy(), whole["cv"].to_numpy())
        yield from whole.filter(pa.array(np.isin(k, kept))).combine_chunks().to_batches()


def _forests(work: DataFrame) -> DataFrame:
    return work.mapInArrow(_local, "k long, cu long, cv long")


def _whole(at: int, pick):
    """One task's edges: the picked ranks with their rounds, of which the first is ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _chunks(batches, 1 << 62):
            k, u, v = (whole[c].to_numpy() for c in ("k", "cu", "cv"))
            if pick:
                kept = np.isin(k, pick(k, u, v))
                k, u, v = k[kept], u[kept], v[kept]
            k, round_of = by_rounds(k, u, v)
            yield pa.record_batch({"k": pa.array(k), "round": pa.array(round_of + np.int32(at - 1))})

    return run


def _tail(work: DataFrame, at: int) -> DataFrame:
    """(k, round) for inputs whose size has been checked: forests of the partitions, then that of their union by one task."""
    return materialize(_forests(work).repartition(1).mapInArrow(_whole(at, None), PICK), "tail")


def boruvka(work: DataFrame, tail_edges: int, seconds: dict[str, float]) -> DataFrame:
    """Rounds of contraction; once few edges are left, one task runs the last rounds."""
    found: list[DataFrame] = []
    left = work
    while n := left.count():
        if n <= tail_edges:
            with phase(seconds, "reduce"):
                found.append(_tail(left, len(found) + 1))
            break
        with phase(seconds, "reduce"):
            best = materialize(rounds.candidates(left), "best")
        found.append(rounds.chosen(best).select("k", F.lit(len(found) + 1).alias("round")))
        with phase(seconds, "contract"):
            succ = materialize(rounds.successors(best, left), "succ")
            parent = materialize(rounds.jump(rounds.jump(rounds.broken(succ))), "parent")
            while not rounds.is_settled(parent):
                before, parent = parent, materialize(rounds.jump(rounds.jump(parent)), "parent")
                discard(before)
        with phase(seconds, "compress"):
            before, left = left, materialize(rounds.contracted(left, parent), "work")
        discard(succ, parent, *([before] if before is not work else []))
    out = work.sparkSession.createDataFrame([], PICK)
    for f in found:
        out = out.unionByName(f)
    return out


def filtered(work: DataFrame, tail_edges: int, seconds: dict[str, float]) -> DataFrame:
    """Forests of the partitions, then of what is left, while that shrinks; then rounds.

    The forest of all edges is that of the union of the forests of any parts.
    """
    with phase(seconds, "reduce"):
        left, n, parts = materialize(_forests(work), "filtered"), None, int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        while (m := left.count()) > tail_edges and (n is None or m < 0.75 * n):
            n, parts = m, max(2, parts // 2)
            before, left = left, materialize(_forests(left.repartition(parts)), "filtered")
            discard(before)
    return boruvka(left, tail_edges, seconds)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's edges: rows with a picked rank (k), and rows with an end and the smallest one of its tree (v, c)."""
    for whole in _chunks(batches, 1 << 62):
        k, v, c = _joined(*(whole[x].to_numpy() for x in ("k", "cu", "cv")))
        none = pa.nulls(len(k), pa.int64())
        yield from pa.table({"k": pa.array(k), "v": none, "c": none}).to_batches(CHUNK)
        yield from pa.table({"k": pa.nulls(len(v), pa.int64()), "v": pa.array(v), "c": pa.array(c)}).to_batches(CHUNK)


def _between(work: DataFrame, tree: DataFrame) -> DataFrame:
    """``work`` between the trees (v, c), the first edge of each two."""
    for end in ("cu", "cv"):
        work = work.join(tree.select(F.col("v").alias(end), F.col("c").alias("top")), end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
    ends = F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")
    return work.where("cu <> cv").groupBy(*ends).agg(F.min("k").alias("k")).select("k", "cu", "cv")


def _by_blocks(work: DataFrame, most: int) -> DataFrame:
    """(k): Kruskal's picks, ``most`` edges at a time in the order of ranks: a task joins trees along them, and what they have joined leaves the edges that follow."""
    bits, left, found = most.bit_length() - 1, work, []
    while counts := sorted(left.groupBy(F.shiftright("k", bits).alias("p")).count().collect()):
        held, end = 0, 0
        for p, n in counts:  # none has more than ``most``, as ranks differ
            if held + n > most:
                break
            held, end = held + n, (p + 1) << bits
        block = materialize(left.where(F.col("k") < end).repartition(1).mapInArrow(_block, "k long, v long, c long"), "block")
        found.append(block.where("k is not null").select("k"))
        if held == sum(n for _, n in counts):
            break
        before, left = left, materialize(_between(left.where(F.col("k") >= end), block.where("k is null")), "work")
        if before is not work:
            discard(before)
    return materialize(reduce(DataFrame.unionByName, found), "picks")


def kruskal(work: DataFrame, tail_edges: int, seconds: dict[str, float]) -> DataFrame:
    """All edges in order, the independent check: by one task, and beyond ``tail_edges`` times ``KRUSKAL_TIMES`` by one after the other.

    ``ValueError`` if a task may hold none.
    """
    n, most = work.count(), KRUSKAL_TIMES * tail_edges
    if n and not most:
        raise ValueError("kruskal needs a task that holds edges; use boruvka")
    if n <= most:
        with phase(seconds, "reduce"):
            return materialize(work.coalesce(1).mapInArrow(_whole(1, _picks), PICK), "kruskal")
    with phase(seconds, "reduce"):
        picks = _by_blocks(work, most // 2)
        tree = materialize(work.join(picks, "k", "left_semi"), "tree")
    # The rounds only number the picks.
    return picks.join(boruvka(tree, tail_edges, seconds), "k", "left")


STRATEGIES: dict[str, Strategy] = {"boruvka": boruvka, "filter": filtered, "kruskal": kruskal}


def minimum_spanning_forest(graph: Graph, strategy: str = "boruvka", tail_edges: int = TAIL_EDGES) -> Forest:
    """The forest of ``graph``: a tree for each component; loops and heavier parallel edges are never in it.

    ``round`` is the round of contraction that picks the edge, whatever the
    strategy. Edges that can't be in the forest go before the sort, chunk by
    chunk and without a shuffle, but for ``kruskal``, which sees all of them.
    """
    seconds: dict[str, float] = {}
    with phase(seconds, "scan"):
        edges = graph.without_loops().edges.select("eid", "u", "v", "w")
        thin = materialize(edges.mapInArrow(_thin, edges.schema) if strategy != "kruskal" else edges, "edges")
        order = ranked(thin)
        discard(thin)
    work = order.select("k", F.col("u").alias("cu"), F.col("v").alias("cv"))
    picked = STRATEGIES[strategy](work, tail_edges, seconds)
    forest = materialize(order.join(picked, "k").select("eid", "u", "v", "w", "round"), "forest")
    return Forest(graph, forest, forest.agg(F.max("round")).first()[0] or 0, seconds)


def components(graph: Graph, tail_edges: int | None = None) -> DataFrame:
    """(v, c) of every vertex of ``graph``, without a forest."""
    label = connected_components(graph.edges.select("u", "v"), *([tail_edges] if tail_edges is not None else []))
    return graph.vertex_ids().select("v").join(label, "v", "left").select("v", F.coalesce("c", "v").alias("c"))


def component_trace(forest: Forest) -> list[int]:
    """Number of components before the first round and after each."""
    n = forest.graph.vertex_ids().count()
    out = [n]
    for r in sorted(forest.edges.groupBy("round").count().collect()):
        out.append(out[-1] - r["count"])
    return out
