"""Exact deduplication by a Grace hash.

Records are dealt by the hash of their content (Spark's shuffle files are the
first level of spill files). A task that gets more distinct content than its
memory bound partitions it again into spill files of its own, under another
hash at each level, until a bucket fits an open-addressing table that compares
complete content. Copies are merged within each input batch before they are
dealt, so a group with any share of the rows reaches its task as one record a
batch.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import lookup, partitions, pieces
from grovekit.storage import materialize

#: Bytes of distinct content that a task holds before it partitions again.
TABLE_BYTES = 128 << 20
FAN_OUT, MAX_LEVEL = 16, 8
#: What a record costs beside its content.
RECORD_BYTES = 150

Record = tuple[int, bytes, int | None, int]  # hash, content, largest id, rows


class OpenTable:
    """Open addressing with linear probing; equal hashes are told apart by their content."""

    def __init__(self, size: int = 1024) -> None:
        self.slots: list[int] = [-1] * size
        self.records: list[list] = []

    def add(self, h: int, content: bytes, top: int | None, rows: int) -> bool:
        """Whether the content is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            found = self.records[k]
            if found[0] == h and found[1] == content:
                if top is not None and (found[2] is None or top > found[2]):
                    found[2] = top
                found[3] += rows
                return False
            at = (at + 1) & mask
        self.slots[at] = len(self.records)
        self.records.append([h, content, top, rows])
        if 2 * len(self.records) > len(self.slots):
            self._grow()
        return True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, r in enumerate(self.records):
            at = r[0] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _read(file) -> Iterator[Record]:
    with file:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def grace(records: Iterable[Record], limit: int = TABLE_BYTES, level: int = 0) -> Iterator[Record]:
    """One record for each distinct content, with the largest id and the sum of rows.

    Spill files have no name, belong to the running task and go with it: they
    are scratch space, as Spark's own spills are, and a retried task starts
    anew.
    """
    table, held, stream = OpenTable(), 0, iter(records)
    for r in stream:
        if table.add(*r):
            held += len(r[1]) + RECORD_BYTES
            if held > limit and level < MAX_LEVEL and len(table.records) > 1:
                break
    else:
        yield from map(tuple, table.records)
        return
    files = [tempfile.TemporaryFile() for _ in range(FAN_OUT)]
    for rest in (table.records, stream):
        for r in rest:
            pickle.dump(tuple(r), files[xxhash.xxh64_intdigest(r[0].to_bytes(8, "little"), level + 1) % FAN_OUT], 5)
    del table
    for file in files:
        yield from grace(_read(file), limit, level + 1)


def normalized(text: str | None) -> bytes:
    """UTF-8 with A to Z in lower case; null is empty. bytes.lower() leaves all else alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        sha = [hashlib.sha256(normalized(t)).digest() for t in b["text"].to_pylist()]
        yield pa.record_batch({"doc_id": b["doc_id"], "sha": pa.array(sha, pa.binary())})


def _batch(records: Iterable[Record]) -> pa.RecordBatch:
    h, content, top, rows = zip(*records, strict=True)
    signed = [x - (1 << 64) if x >> 63 else x for x in h]
    return pa.record_batch({"h": pa.array(signed, pa.int64()), "content": pa.array(content, pa.binary()), "top": pa.array(top, pa.int64()), "n": pa.array(rows, pa.int64())})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a piece of the input become one record."""
    for b in pieces(batches, "text", 32 << 20):
        table = OpenTable()
        for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            content = normalized(t)
            table.add(xxhash.xxh64_intdigest(content), content, i, 1)
        if table.records:
            yield _batch(table.records)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[Record]:
        for b in batches:
            for h, content, top, n in zip(*(b[c].to_pylist() for c in ("h", "content", "top", "n")), strict=True):
                yield h & 0xFFFFFFFFFFFFFFFF, content, top, n

    held: list[tuple[bytes, int | None, int]] = []

    def out() -> pa.RecordBatch:
        sha, top, n = zip(*held, strict=True)
        held.clear()
        return pa.record_batch({"sha": pa.array(sha, pa.binary()), "keep_id": pa.array(top, pa.int64()), "group_size": pa.array(n, pa.int64())})

    for _, content, top, n in grace(rows()):
        held.append((hashlib.sha256(content).digest(), top, n))
        if len(held) == 50_000:
            yield out()
    if held:
        yield out()


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical once A to Z are in lower case; a null text is
    an empty one. The row with the largest id stays. Rows with equal ids and
    texts stay or go together; a row without id is dropped if its text has a
    row with one, and where no row of the text has an id, keep_id is null and
    all of them stay.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(source.mapInArrow(_names, "doc_id long, sha binary"), "names")
    merged = source.mapInArrow(_merged, "h long, content binary, top long, n long")
    groups = merged.repartition(partitions(docs), "h").mapInArrow(_groups, "sha binary, keep_id long, group_size long")
    found = lookup(rows, materialize(groups, "groups"), "sha", "group_size")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
