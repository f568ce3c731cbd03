"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.storage import materialize

#: At most so many keys count as hot in ``lookup``; their rows alone are broadcast.
HOT_KEYS = 1000
#: Bytes that a shuffle partition should hold, and rows that are read at a time from sorted partitions.
PARTITION_BYTES, CHUNK_ROWS = 128 << 20, 1 << 17
#: Keys of more rows than the first are split into tiles, at least of the first, at most of the second many rows.
LEAST_TILE, MOST_TILE = 64, 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the keywords as names, so that no other column can clash."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` that has one row for each key.

    ``weight`` is the column of ``table`` with the number of ``rows`` that have
    the key. Keys with more than a thousandth of all rows (so fewer than
    ``hot_keys`` of them, whatever the size of the input) are joined by
    broadcast; the rest meet in a shuffle in which no key is large. Both inputs
    are read more than once and so should be materialized.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    bound = max(total // hot_keys, 1)
    hot = F.broadcast(table.where(F.col(weight) > bound))
    cold = table.where(F.col(weight) <= bound)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def unit(*parts: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11) / F.lit(float(1 << 53))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``limit`` bytes in each, one row at least."""
    for batch in batches:
        done, held = 0, 0
        for i, n in enumerate(pc.binary_length(batch[column]).to_pylist()):
            if held and held + (n or 0) > limit:
                yield batch.slice(done, i - done)
                done, held = i, 0
            held += n or 0
        if done < batch.num_rows:
            yield batch.slice(done)


def carried(df: DataFrame) -> DataFrame:
    """All columns under neutral names (``c0``, ``c1`` ...), so that what an operator adds can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(like.columns)])


def partitions(source: DataFrame, times: float = 1.0) -> int:
    """Shuffle partitions for ``times`` the bytes of the tables and files under ``source``; the session's setting at least, and where they aren't known."""
    least = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(least, int(sum(sizes) * times) // PARTITION_BYTES) if max(sizes) < 1 << 50 else least


def groups(batches: Iterator[pa.RecordBatch], *keys: str, limit: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``, of about ``limit`` rows, one group at least.

    No more than that and one group is held at any time.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < limit:
            continue
        whole = pa.Table.from_batches(held)
        last = np.ones(count, bool)
        for k in keys:
            column = whole[k].to_numpy()
            last &= column == column[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield whole.slice(0, cut)
            held, count = whole.slice(cut).combine_chunks().to_batches(), count - cut
    if held:
        yield pa.Table.from_batches(held)


def tiled(points: DataFrame, key: str, node: str, most: int = MOST_TILE, least: int = LEAST_TILE, alone: int | None = None) -> DataFrame:
    """``points`` dealt to tasks that together hold every two rows of a key: adds task long and part byte.

    A key of up to ``alone`` rows (``most``, unless it is given) is one task. Others are split into
    parts by a hash of the node, a thirty-second of the key's rows each within
    ``least`` and ``most``, and each pair of parts is a task: rows of the first
    part have part 0, those of the second 1, and only rows of different parts
    need to be compared; where a part meets itself, all rows have part 0.
    """
    alone = most if alone is None else alone
    counts = points.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > alone)
    size = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.col("n") / 32)))
    split = materialize(counts.select(key, F.ceil(F.col("n") / (0.8 * size)).cast("int").alias("__parts")), "split-keys")
    small = F.broadcast(split) if split.count() <= 100_000 else split
    own = F.pmod(F.xxhash64(node), F.col("__parts")).cast("int")
    # Of parts p <= q the task is p * parts + q; a row of part p takes side 0 in those, and side 1 where it is the higher.
    pair = F.transform(
        F.sequence(F.lit(0), F.col("__parts") - 1),
        lambda q: F.struct((F.least(own, q).cast("long") * F.col("__parts") + F.greatest(own, q)).alias("task"), (q < own).cast("byte").alias("part")),
    )
    one = F.array(F.struct(F.lit(-1).cast("long").alias("task"), F.lit(0).cast("byte").alias("part")))
    dealt = points.join(small, key, "left").withColumn("__to", F.explode(F.when(F.col("__parts").isNull(), one).otherwise(pair)))
    return dealt.select(*points.columns, "__to.task", "__to.part")
