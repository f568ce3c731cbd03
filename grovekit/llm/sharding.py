"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 places. Every shard owns ``vnodes`` of them, and the rows
of a place belong to the first virtual node clockwise. A shard takes rows until
its capacity is reached; what overflows goes on clockwise to the next shard
that has room. Capacities add up to no less than the rows, so balance is
guaranteed, and without ``slack`` shard sizes are at most one row apart.

The ring is walked with counts by place (65,536 numbers, whatever the input),
which give, for each place, ranges of ranks and their shard. Rows find their
range by their rank within the place, so no task ever sees a whole shard.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovekit.storage import materialize

PLACE_BITS = 16


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, in ring order; adding a shard adds nodes and moves none."""
    return sorted((xxhash.xxh64_intdigest(f"{s}:{v}") >> (64 - PLACE_BITS), s) for s in range(n_shards) for v in range(vnodes))


def capacities(rows: int, n_shards: int, slack: float) -> list[int]:
    if slack:
        return [-(-int(rows * (1 + slack) + n_shards) // n_shards)] * n_shards
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def walk(counts: dict[int, int], n_shards: int, vnodes: int = 256, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, first slot) for ``counts`` of rows by place.

    Places come in an order of their own hash, as keys would arrive, so that no
    region of the ring is favoured.
    """
    nodes = ring(n_shards, vnodes)
    places = [p for p, _ in nodes]
    room = capacities(sum(counts.values()), n_shards, slack)
    load = [0] * n_shards
    out = []
    for place in sorted(counts, key=lambda p: xxhash.xxh64_intdigest(f"place {p}")):
        at, rank, end = bisect.bisect_left(places, place), 0, counts[place]
        while rank < end:
            s = nodes[at % len(nodes)][1]
            take = min(end - rank, room[s] - load[s])
            if take > 0:
                out.append((place, rank, rank + take, s, load[s]))
                load[s] += take
                rank += take
            at += 1
    return out


def shard_documents(docs: DataFrame, n_shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 256, slack: float = 0.0) -> DataFrame:
    """Every row with its shard: doc_id, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 length of the text (null counts as empty) plus one.
    The ring's key is the id; a row without one is placed by its text's
    checksum. Rows that are equal in all of this share a place and get slots of
    their own. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("h", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text_crc32", "size")))
    rows = materialize(rows.withColumn("place", F.shiftrightunsigned("h", 64 - PLACE_BITS).cast("int")), "ring")
    counts = {r[0]: r[1] for r in rows.groupBy("place").count().collect()}
    spark = docs.sparkSession
    ranges = spark.createDataFrame(walk(counts, n_shards, vnodes, slack), "place int, low long, high long, shard int, first long")
    order = Window.partitionBy("place").orderBy("h", F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    hit = (ranked["place"] == ranges["place"]) & (ranked["rank"] >= ranges["low"]) & (ranked["rank"] < ranges["high"])
    return ranked.join(F.broadcast(ranges), hit).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"))
