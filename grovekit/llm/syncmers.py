"""Document fingerprints from closed syncmers.

A k-mer of code points is kept if the smallest hash among its s-mers is that of
its first or last one. Whether it is depends on the k-mer alone, so what two
texts share gives the same anchors in both, wherever it stands, and windows
guarantee one every k - s code points.

A fingerprint is the ``SIZE`` anchors of the smallest hashes, in the order of
their positions. Two fingerprints are matched by position: of the anchors that
both have, the longest run that stands in the same order in both counts.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import partitions, pieces

K, S = 24, 8
#: Anchors of a fingerprint at most, of 4 bytes each.
SIZE = 64
BLOCK = 1 << 21
#: Buckets at most that rows are dealt into, and so bounds that the driver holds, whatever the input; at 100 TB a bucket has 1.6 GB, which is sorted with spilling and read as a stream.
BUCKETS = 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    x ^= x >> np.uint64(29)
    x *= ODD
    x ^= x >> np.uint64(32)
    return x


def _runs(x: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over each window of ``width``, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = join(out[:-have], out[have:], have)
        have *= 2
    if have < width:
        out = join(out[: -(width - have)], out[width - have :], width - have) if join is _least else _rest(x, out, have, width, join)
    return out


def _least(a: np.ndarray, b: np.ndarray, _: int) -> np.ndarray:
    return np.minimum(a, b)


def _poly(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    return a * np.uint64(pow(int(ODD), width, 1 << 64)) + b


def _rest(x: np.ndarray, out: np.ndarray, have: int, width: int, join) -> np.ndarray:
    tail = _runs(x, width - have, join)
    n = len(x) - width + 1
    return join(out[:n], tail[have : have + n], width - have)


def _select(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of one run of code points."""
    if len(points) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _mix(_runs(points, s, _poly))
    least = _runs(h, k - s + 1, _least)
    at = np.flatnonzero((h[: len(least)] == least) | (h[k - s :] == least))
    kmer = h[at].copy()
    for o in [*range(s, k - s, s), k - s]:
        kmer = kmer * ODD + h[at + o]
    return at, _mix(kmer) >> np.uint64(32)


def anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, 32-bit hash) of all anchors, in order.

    A text without any, such as one of fewer than k code points, has one anchor
    at 0, the hash of the whole; an empty text has none.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    found = []
    for a in range(0, max(len(points) - k + 1, 0), BLOCK):
        at, h = _select(points[a : a + BLOCK + k - 1].astype(np.uint64), k, s)
        found.append((at + a, h))
    at = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    h = np.concatenate([x for _, x in found]) if found else np.empty(0, np.uint64)
    own = np.searchsorted(ends, at, "right")
    inside = at + k <= ends[own] if len(at) else np.empty(0, bool)
    own, at, h = own[inside], at[inside], h[inside]
    pos = at - (ends - lens)[own]
    bare = np.setdiff1d(np.flatnonzero(lens), own)
    if len(bare):
        whole = np.array([xxhash.xxh32_intdigest(texts[i].encode("utf-8", "surrogatepass")) for i in bare], np.uint64)
        own, pos, h = np.r_[own, bare], np.r_[pos, np.zeros(len(bare), np.int64)], np.r_[h, whole]
        order = np.argsort(own, kind="stable")
        own, pos, h = own[order], pos[order], h[order]
    return own, pos, h


def smallest(own: np.ndarray, pos: np.ndarray, h: np.ndarray, n: int, size: int = SIZE) -> list[np.ndarray]:
    """Each of n texts' fingerprint: the hashes of its ``size`` smallest different ones, in order of their first positions."""
    order = np.lexsort((pos, h, own))
    own, pos, h = own[order], pos[order], h[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (h[1:] != h[:-1])] if len(own) else np.empty(0, bool)
    own, pos, h = own[new], pos[new], h[new]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    few = rank < size
    own, pos, h = own[few], pos[few], h[few]
    h = h[np.lexsort((pos, own))]
    cut = np.searchsorted(own, np.arange(n + 1)).tolist()
    return [h[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def in_order(a: list[int], b: list[int], among: set[int]) -> int:
    """The most anchors of ``among`` that stand in the same order in both."""
    place = {x: i for i, x in enumerate(b)}
    ends: list[int] = []
    for x in a:
        if x in among:
            at = bisect.bisect_left(ends, place[x])
            ends[at : at + 1] = [place[x]]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Of the ``size`` smallest anchors of both fingerprints together, the share that both have in the same order; empty ones are alike."""
    x, y = a.tolist(), b.tolist()
    if x == y:
        return 1.0
    least = set(sorted({*x, *y})[:size])
    return in_order(x, y, least & set(x) & set(y)) / len(least)


def encode(h: np.ndarray) -> str:
    """A fingerprint as base64 of little-endian 32-bit integers."""
    return base64.b64encode(h.astype("<u4").tobytes()).decode()


def _anchored(k: int, s: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            own, pos, h = anchors([t or "" for t in b["text"].to_pylist()], k, s)
            cut = pa.array(np.searchsorted(own, np.arange(b.num_rows + 1)), pa.int32())
            yield pa.record_batch({
                "doc_id": b["doc_id"],
                "positions": pa.ListArray.from_arrays(cut, pa.array(pos, pa.int64())),
                "hashes": pa.ListArray.from_arrays(cut, pa.array(h.astype(np.int64))),
            })

    return run


def anchor_lists(docs: DataFrame, *, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's anchors: doc_id, positions array<long> in code points, hashes array<long>."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(_anchored(k, s), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, positions array<long>, hashes array<long>")


def edited(text: str, following: str) -> str:
    """``text`` with its last half of code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(k: int, s: int, size: int):
    """Rows come sorted within their bucket; the one after the bucket's last is its tail."""

    def out(rows: list[tuple]) -> pa.RecordBatch | None:
        texts = [r[3] or "" for r in rows]
        use = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not use:
            return None
        new = [edited(texts[i], texts[i + 1]) for i in use]
        prints = smallest(*anchors(texts, k, s), len(texts), size)
        e_prints = smallest(*anchors(new, k, s), len(new), size)
        return pa.record_batch({
            "doc_id": pa.array([rows[i][2] for i in use], pa.int64()),
            "n_chars": pa.array([len(texts[i]) for i in use], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
            "fingerprint": pa.array([encode(prints[i]) for i in use]),
            "edited_fingerprint": pa.array([encode(x) for x in e_prints]),
            "near_edited": pa.array([likeness(prints[i], x, size) for i, x in zip(use, e_prints, strict=True)]),
            "near_next": pa.array([likeness(prints[i], prints[i + 1], size) for i in use]),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for b in pieces(batches, "text"):
            rows = [*last, *zip(*(b[c].to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True)]
            if (found := out(rows)) is not None:
                yield found
            last = rows[-1:]

    return run


def with_next(docs: DataFrame, key: str, descending_parts: int) -> DataFrame:
    """The rows dealt into buckets of the order by ``key``, descending, each bucket with a copy of the next one's first row.

    Bounds are quantiles of the key; they and the buckets' largest keys are all
    that the driver gets. Adds bucket int and tail boolean.
    """
    keys = docs.select(key)
    shares = [i / descending_parts for i in range(1, descending_parts)]
    cuts = sorted({float(x) for x in keys.approxQuantile(key, shares, 0.2 / descending_parts)}) if shares else []
    bounds = np.array(cuts)

    @F.pandas_udf("int")
    def bucket(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(-bounds[::-1], -x.to_numpy(np.float64), "right").astype("i4"))

    tops = {r[0]: r[1] for r in keys.groupBy(bucket(key).alias("b")).agg(F.max(key)).collect()}
    order = sorted(tops)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    heads = docs.sparkSession.createDataFrame([(tops[b], before[b]) for b in order], f"{key} long, before int")
    placed = docs.withColumn("bucket", bucket(key)).join(F.broadcast(heads), key, "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail"))
    to = F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, tail)))
    return placed.withColumn("to", to).drop("bucket", "before").select("*", "to.bucket", "to.tail").drop("to")


def compare_with_edits(docs: DataFrame, *, k: int = K, s: int = S, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint against its edited text's and the next row's, in descending order of id.

    After the last row comes the first. Null texts are empty. Rows with equal
    ids follow each other by text; rows without id come last, by their text's
    checksum. The texts are shuffled once, by ranges of the id. Texts of any
    length are read whole, in blocks; a fingerprint has ``size`` anchors at most,
    so 4 bytes times that, whatever the text's length. Other columns are
    ignored, and an empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    n, ids = source.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if not n:
        return docs.sparkSession.createDataFrame([], OUT)
    key = F.col("doc_id") if n == ids else F.coalesce("doc_id", F.lit(-(1 << 62)) - F.crc32(F.col("text").cast("binary")))
    parts = min(partitions(docs), BUCKETS)
    dealt = with_next(source.withColumn("key", key), "key", min(8 * parts, BUCKETS))
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), "text")
    return ordered.select("bucket", "tail", "doc_id", "text").mapInArrow(_pairs(k, s, size), OUT)
