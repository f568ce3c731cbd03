"""Graphs by name, from files, tables and seeded generators."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.graph import Graph, dense_ids, normalized_ends
from grovekit.storage import materialize

EDGE = "eid long, u long, v long, w long"

# The named graphs as their number of vertices and (u, v, w), in the order of their edge ids.
LITERAL = {
    "triangle": (3, [(0, 1, 3), (1, 2, 2), (0, 2, 5)]),
    "square": (4, [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 0, 4), (0, 2, 1)]),
    "tie": (5, [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 4, 1), (3, 4, 2)]),
    "test": (12, [
        (0, 1, 4), (0, 2, 3), (0, 3, 8), (1, 2, 1), (1, 4, 7), (1, 5, 9), (2, 4, 2), (2, 5, 6), (2, 6, 7), (3, 5, 5), (3, 6, 4), (3, 7, 9), (4, 5, 3), (4, 7, 8),
        (4, 8, 6), (5, 7, 4), (5, 8, 2), (6, 8, 7), (6, 9, 6), (7, 8, 1), (7, 10, 5), (8, 10, 3), (8, 11, 9), (9, 11, 2), (10, 11, 4), (1, 3, 9), (4, 9, 10), (5, 10, 7), (6, 11, 8),
    ]),
}


@dataclass(frozen=True)
class RandomConfig:
    """Parameters of a simple random graph; ``ValueError`` if there is no such graph."""

    vertices: int
    extra_edges: int
    seed: int
    max_weight: int

    def __post_init__(self) -> None:
        if self.vertices < 2:
            raise ValueError("invalid random graph: under two vertices")
        if self.max_weight < 1:
            raise ValueError("invalid random graph: no positive weight")
        room = self.vertices * (self.vertices - 1) // 2 - (self.vertices - 1)
        if not 0 <= self.extra_edges <= room:
            raise ValueError(f"invalid random graph: room for {room} extra edges")


DEFAULT_LARGE = RandomConfig(32768, 196608, 886261, 10000)


def literal_edges(name: str) -> list[tuple[int, int, int, int]]:
    return [(eid, *edge) for eid, edge in enumerate(LITERAL[name][1])]


def literal(spark: SparkSession, name: str) -> Graph:
    return Graph.from_edges(spark.createDataFrame(literal_edges(name), EDGE), LITERAL[name][0])


def dense16(spark: SparkSession) -> Graph:
    """A ring of 16 and the chords of 2 to 4 steps."""
    x, s = F.col("x"), F.col("s")
    ring = spark.range(16).select(F.col("id").alias("x"), F.lit(1).alias("s"), F.pmod(F.col("id") + 1, F.lit(16)).alias("o"), (1 + F.col("id") % 7).alias("w"))
    steps = spark.range(16).select(F.col("id").alias("x"), F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("s"))
    chords = steps.withColumn("o", (x + s) % 16).where("x < o").withColumn("w", 3 + (x + F.col("o")) % 11)
    edges = ring.unionByName(chords).withColumn("step", (s > 1).cast("int"))
    return Graph.from_edges(dense_ids(edges, "step", "x", "s").select("eid", x.alias("u"), F.col("o").alias("v"), "w"), 16)


def _hash(*parts: Column | int) -> Column:
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


#: Weights of the generators, from two values to hash.
WEIGHTS: dict[str, Callable[[Column, int], Column]] = {
    "int": lambda i, seed: 1 + F.pmod(_hash(i, seed, 3), F.lit(1000)),
    "uniform_int": lambda i, seed: (1 + F.pmod(_hash(i, seed, 3), F.lit(100))).cast("double"),
    "unit_float": lambda i, seed: (F.shiftrightunsigned(_hash(i, seed, 3), 40) / float(1 << 24)).cast("float"),
}


def _shuffled(i: Column, n: int, seed: int) -> Column:
    """A bijection of 0 to n - 1."""
    a = (seed * 2654435761 + 12345) % n or 1
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return F.pmod(i * a + seed % n, F.lit(n))


def _tree(spark: SparkSession, n: int, seed: int, permute: bool) -> DataFrame:
    """(i, u, v): each vertex but the first is joined to an earlier one."""
    i = F.col("id")
    up = F.pmod(_hash(i, seed, 1), i)
    place = (lambda x: _shuffled(x, n, seed)) if permute else (lambda x: x)
    return spark.range(1, n).select((i - 1).alias("i"), place(up).alias("u"), place(i).alias("v"))


def random_connected(spark: SparkSession, n: int, m: int, seed: int, weights: str = "int", permute: bool = True) -> Graph:
    """``m`` edges over ``n`` vertices: a random tree and random pairs; parallel edges may occur, loops don't.

    Everything comes from hashes of the edge number and the seed, so the graph
    is the same however it is partitioned.
    """
    if n < 2 or m < n - 1:
        raise ValueError(f"a connected graph of {n} vertices needs two of them and {max(n - 1, 1)} edges at least, not {m}")
    i = F.col("id")
    u = F.pmod(_hash(i, seed, 4), F.lit(n))
    more = spark.range(n - 1, m).select(i.alias("i"), u.alias("u"), F.pmod(u + 1 + F.pmod(_hash(i, seed, 5), F.lit(n - 1)), F.lit(n)).alias("v"))
    edges = _tree(spark, n, seed, permute).unionByName(more)
    return Graph.from_edges(edges.select(F.col("i").alias("eid"), "u", "v", WEIGHTS[weights](F.col("i"), seed).alias("w")), n)


def random_simple(spark: SparkSession, config: RandomConfig) -> Graph:
    """A connected graph without loops and parallel edges, with exactly the edges asked for."""
    n, extra, seed = config.vertices, config.extra_edges, config.seed
    tree = _tree(spark, n, seed, True).select(F.col("i").alias("eid"), *normalized_ends())
    pairs, p = n * (n - 1) // 2, F.col("id")
    if extra * 4 >= pairs:
        numbers = spark.range(pairs)
    else:
        # Enough draws that distinct pairs beyond the tree suffice.
        numbers = spark.range(3 * extra + 4 * n).select(F.pmod(_hash(p, seed, 6), F.lit(pairs)).alias("id")).distinct()
    hi = F.floor((1 + F.sqrt(1 + 8 * p.cast("double"))) / 2).cast("long")
    hi = F.when(hi * (hi - 1) / 2 > p, hi - 1).when(hi * (hi + 1) / 2 <= p, hi + 1).otherwise(hi)
    more = numbers.select((p - (hi * (hi - 1) / 2).cast("long")).alias("u"), hi.alias("v")).join(tree.select("u", "v"), ["u", "v"], "left_anti")
    more = dense_ids(more.withColumn("h", _hash(F.col("u"), F.col("v"), seed)), "h", "u", "v", name="i").where(F.col("i") < extra)
    edges = tree.unionByName(more.select((F.col("i") + n - 1).alias("eid"), "u", "v"))
    w = 1 + F.pmod(_hash(F.col("u"), F.col("v"), seed, 7), F.lit(config.max_weight))
    return Graph.from_edges(edges.withColumn("w", w), n)


CATALOG: dict[str, Callable[..., Graph]] = {name: (lambda spark, config=None, name=name: literal(spark, name)) for name in LITERAL}
CATALOG |= {
    "sparse12": lambda spark, config=None: literal(spark, "test"),
    "dense16": lambda spark, config=None: dense16(spark),
    "random": lambda spark, config=None: random_simple(spark, config or RandomConfig(64, 128, 886261, 100)),
    "large": lambda spark, config=None: random_simple(spark, DEFAULT_LARGE),
}


def load(spark: SparkSession, name: str, config: RandomConfig | None = None) -> Graph:
    """The named graph, validated; ``ValueError`` for an unknown name."""
    if name not in CATALOG:
        raise ValueError(f"unknown graph {name!r}; there are {', '.join(CATALOG)}")
    return CATALOG[name](spark, config).validate()


def read_text(spark: SparkSession, path: str) -> Graph:
    """Text of ``V E`` and then ``u v w`` for each edge, between any blanks and line ends; edge ids follow the text.

    A folder is read in the order of its files' names. What follows the last of
    the ``E`` edges is ignored. ``ValueError`` if the header is wrong or edges are
    missing; a malformed number fails the read. Where every edge has a line of
    its own, lines are numbered, else every word is.
    """
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("line"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("p")).where("p[0] <> ''")
    numbered = materialize(dense_ids(lines, "file", "block", "line", name="n").select("n", "p"), "lines")
    head = numbered.where("n = 0").first()
    if head is not None and len(head.p) == 2 and not numbered.where("n > 0 and size(p) <> 3").take(1):
        p, words = F.col("p"), head.p
        edges = numbered.where("n > 0").select((F.col("n") - 1).alias("eid"), p[0].alias("u"), p[1].alias("v"), p[2].alias("w"))
    else:
        each = dense_ids(numbered.select("n", F.posexplode("p").alias("at", "word")), "n", "at", name="i")
        words = [r.word for r in each.where("i < 2").orderBy("i").collect()]
        part = lambda k: F.max(F.when((F.col("i") - 2) % 3 == k, F.col("word")))
        rest = each.where("i >= 2").groupBy(F.floor((F.col("i") - 2) / 3).cast("long").alias("eid"))
        edges = rest.agg(part(0).alias("u"), part(1).alias("v"), part(2).alias("w")).where("w is not null")
    if len(words) != 2 or not all(re.fullmatch("[0-9]+", x) for x in words):
        raise ValueError(f"{path}: no header")
    vertices, count = map(int, words)
    edges = edges.where(F.col("eid") < count).select("eid", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))
    if (found := edges.count()) != count:
        raise ValueError(f"{path}: {found} edges, not {count}")
    return Graph.from_edges(edges, vertices)


def write_text(graph: Graph, path: str) -> None:
    """The inverse of ``read_text``, as a folder of files in order, each with a range of edges; the first begins with the header."""
    n, m = graph.vertex_ids().count(), graph.edges.count()
    spark = graph.edges.sparkSession
    head = spark.createDataFrame([(-1, f"{n} {m}")], "eid long, value string")
    body = graph.edges.select("eid", F.concat_ws(" ", "u", "v", "w").alias("value"))
    head.unionByName(body).orderBy("eid").select("value").write.text(path)


# Graphs derived from the tables.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_id(edges: DataFrame, ends: DataFrame) -> Graph:
    """The id follows (u, v): both in one number where all ``ends`` (u, v) fit, which needs no sort, else their place in a sort."""
    least_u, most_u, least_v, most_v = ends.agg(F.min("u"), F.max("u"), F.min("v"), F.max("v")).first()
    fits = least_u is None or least_v is None or -1 << 31 <= least_u and most_u < 1 << 31 and least_v >= 0 and most_v < 1 << 32
    return Graph.from_edges(edges.withColumn("eid", F.shiftleft("u", 32).bitwiseOR(F.col("v"))) if fits else dense_ids(edges, "u", "v"))


def supply(spark: SparkSession, sf_dir: str, kind: str = "supply") -> Graph:
    """Suppliers and parts that meet in an order line.

    ``supply``: weighted by the least line number; ``supply_flags``: apart for
    each return flag, so there are several components; ``supply_price``:
    weighted by the least price in cents; ``supply_double``: by the price as it
    is; ``supply_negative``: by the greatest line number, negated, so that the
    forest is a heaviest one.
    """
    lines = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    apart = flag * F.lit(1_000_000_000) if kind == "supply_flags" else F.lit(0)
    weights = {"supply_price": F.round(F.col("l_extendedprice") * 100).cast("long"), "supply_double": F.col("l_extendedprice"), "supply_negative": -F.col("l_linenumber").cast("long")}
    w = weights.get(kind, F.col("l_linenumber").cast("long"))
    ends = lines.select((F.col("l_suppkey") + apart).alias("u"), (F.col("l_partkey") + apart + 1000000).alias("v"), w.alias("w"))
    return _with_id(ends.groupBy("u", "v").agg(F.min("w").alias("w")), ends)


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, suppliers and customers as a tree; ids are moved apart by kind."""
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    long = lambda c: F.col(c).cast("long")
    edges = nation.select(long("n_regionkey").alias("u"), (long("n_nationkey") + 100).alias("v"), (long("n_nationkey") % 7 + 1).alias("w"))
    edges = edges.unionByName(supplier.select((long("s_nationkey") + 100).alias("u"), (long("s_suppkey") + 1000000).alias("v"), (long("s_suppkey") % 11 + 1).alias("w")))
    edges = edges.unionByName(customer.select((long("c_nationkey") + 100).alias("u"), (long("c_custkey") + 2000000000).alias("v"), (long("c_custkey") % 13 + 1).alias("w")))
    return _with_id(edges, edges)
