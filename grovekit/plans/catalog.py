"""Every registered graph query and its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions import runs as R
from grovekit.functions import scalars as S
from grovekit.graph import Graph, dense_ids, encoded_key, lightest, normalized_ends, packed_key, ranked, unknown_ends, unpacked_id, violations
from grovekit.operators import report, rounds
from grovekit.operators.forest import component_trace, components, minimum_spanning_forest
from grovekit.operators.verify import left_out, membership, totals, verify
from grovekit.plans import oracles as O
from grovekit.sources import graphs as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
UVW = ("u", "v", "w")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def _graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    if name in G.LITERAL or name == "dense16":
        return G.load(spark, name)
    return G.geography(spark, sf_dir) if name == "geo" else G.supply(spark, sf_dir, name)


# Forests.


def _forest(name: str, kind: str, strategy: str = "boruvka", tail: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        more = {} if tail is None else {"tail_edges": tail}
        return minimum_spanning_forest(_graph(spark, sf_dir, kind), strategy, **more).edges.select(*UVW)

    query(O.forest(kind, "SELECT u, v, w FROM msf"), name)(run)


_forest("msf_edges", "supply")
_forest("msf_forest", "supply_flags")
_forest("msf_price", "supply_price")
_forest("msf_geo", "geo")
_forest("msf_double", "supply_double")
_forest("msf_negative", "supply_negative")
_forest("msf_rounds_only", "supply", tail=0)
_forest("kruskal_edges", "supply_price", "kruskal")
_forest("filter_edges", "supply_price", "filter")


def _named(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return minimum_spanning_forest(G.load(spark, name), tail_edges=0).edges.select("eid", *UVW)

    query(O.forest(name, "SELECT eid, u, v, w FROM msf"), f"msf_named_{name}")(run)


for _name in (*G.LITERAL, "dense16"):
    _named(_name)


@query(
    O.forest(
        "supply_flags",
        """SELECT (SELECT count(*) FROM vs) AS vertex_count, (SELECT count(*) FROM e) AS input_edge_count, count(*) AS selected_edge_count,
        (SELECT count(DISTINCT c) FROM last) AS component_count, CAST(sum(w) AS BIGINT) AS total_weight FROM msf""",
    )
)
def msf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = minimum_spanning_forest(_graph(spark, sf_dir, "supply_flags").written())
    s = report.summary(forest)
    return s.select("vertex_count", "input_edge_count", "selected_edge_count", (F.col("vertex_count") - F.col("selected_edge_count")).alias("component_count"), "total_weight")


@query(O.forest("supply", "SELECT true AS success, CAST(sum(w) AS BIGINT) AS expected_total_weight, CAST(sum(w) AS BIGINT) AS actual_total_weight, count(*) AS expected_edge_count, count(*) AS actual_edge_count FROM msf"))
def verify_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir, "supply").written()
    return verify(graph, minimum_spanning_forest(graph).edges)


@query(O.forest("supply", "SELECT k IN (SELECT k FROM msf) AS is_msf, u, v, w FROM e"))
def msf_membership_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir, "supply").written()
    return membership(graph, minimum_spanning_forest(graph)).select("is_msf", *UVW)


@query(O.forest("supply", "SELECT u, v, w FROM e WHERE k NOT IN (SELECT k FROM msf)"))
def non_msf_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir, "supply").written()
    return left_out(graph, minimum_spanning_forest(graph)).select(*UVW)


@query(O.forest("supply_flags", "SELECT CAST(sum(w) AS BIGINT) AS weight, count(*) AS n FROM msf"))
def total_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(minimum_spanning_forest(_graph(spark, sf_dir, "supply_flags")).edges)


@query(O.trace("supply", 4))
def round_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components before the first round and after each; rounds that pick none don't count."""
    trace = component_trace(minimum_spanning_forest(_graph(spark, sf_dir, "supply")))
    return spark.createDataFrame(list(enumerate(trace)), "round int, components long")


TRACE = "SELECT CAST(round AS INTEGER) AS round, CAST(components AS BIGINT) AS components FROM (VALUES (0, 12), (1, 4), (2, 1)) t(round, components)"


@query(TRACE)
def round_trace_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = component_trace(minimum_spanning_forest(G.load(spark, "test")))
    return spark.createDataFrame(list(enumerate(trace)), "round int, components long")


# Components.


@query(O.forest("supply_flags", "SELECT v, c FROM last"), "components")
def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_graph(spark, sf_dir, "supply_flags").written())


@query(O.forest("supply_flags", "SELECT v, c FROM last"))
def components_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_graph(spark, sf_dir, "supply_flags").written(), tail_edges=0)


@query(O.forest("supply_flags", "SELECT v, c FROM last"))
def components_of_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimum_spanning_forest(_graph(spark, sf_dir, "supply_flags")).components()


@query(O.forest("supply_flags", "SELECT c, count(*) AS size FROM last GROUP BY c"))
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_graph(spark, sf_dir, "supply_flags").written()).groupBy("c").agg(F.count(F.lit(1)).alias("size"))


@query(O.forest("supply_flags", "SELECT count(DISTINCT c) AS n FROM last"))
def component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_graph(spark, sf_dir, "supply_flags").written()).agg(F.countDistinct("c").alias("n"))


# The steps of a round, each on the first round of the supply graph.


def _first(spark: SparkSession, sf_dir: str, name: str = "supply") -> tuple[DataFrame, DataFrame]:
    edges = ranked(_graph(spark, sf_dir, name).without_loops().edges)
    return edges, rounds.external(rounds.labelled(edges, rounds.identity(Graph.from_edges(edges).vertex_ids())))


@query(O.first_round("supply", "SELECT best.c, e.u, e.v, e.w FROM best JOIN e USING (k)"))
def round1_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, work = _first(spark, sf_dir)
    return rounds.candidates(work).join(edges, "k").select("c", *UVW)


@query(O.first_round("supply", "SELECT u, v, w FROM e JOIN (SELECT DISTINCT k FROM best) USING (k)"))
def round1_chosen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, work = _first(spark, sf_dir)
    return rounds.chosen(rounds.candidates(work)).join(edges, "k").select(*UVW)


@query(O.first_round("supply", "SELECT c, p FROM succ"))
def round1_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, work = _first(spark, sf_dir)
    return rounds.successors(rounds.candidates(work), work)


@query(O.first_round("supply", "SELECT a.c, a.p FROM succ a JOIN succ b ON a.p = b.c WHERE b.p = a.c AND a.c < a.p"))
def round1_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, work = _first(spark, sf_dir)
    return rounds.mutual(rounds.successors(rounds.candidates(work), work))


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, work = _first(spark, sf_dir)
    return rounds.broken(rounds.successors(rounds.candidates(work), work))


@query(O.first_round("supply", "SELECT v, c FROM parent"))
def round1_cycles_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(spark, sf_dir)


@query(O.first_round("supply", "SELECT a.v, b.c FROM parent a JOIN parent b ON a.c = b.v"))
def pointer_jump_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.jump(_parents(spark, sf_dir))


@query(O.first_round("supply", "SELECT vs.v, coalesce(parent.c, vs.v) AS c FROM vs LEFT JOIN parent ON parent.v = vs.v"))
def relabel_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.moved(rounds.identity(_graph(spark, sf_dir, "supply").vertex_ids()), _parents(spark, sf_dir))


@query(O.first_round("supply", "SELECT v FROM parent WHERE v = c"))
def component_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.roots(_parents(spark, sf_dir))


CONTRACT = """, m AS (SELECT least(a.c, b.c) AS cu, greatest(a.c, b.c) AS cv, e.k FROM e JOIN parent a ON a.v = e.u JOIN parent b ON b.v = e.v WHERE a.c <> b.c)
    SELECT cu, cv, e.u, e.v, e.w FROM (SELECT cu, cv, min(k) AS k FROM m GROUP BY ALL) JOIN e USING (k)"""


@query(O.first_round("supply", CONTRACT))
def contract_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, work = _first(spark, sf_dir)
    parent = rounds.broken(rounds.successors(rounds.candidates(work), work))
    return rounds.contracted(work, parent).join(edges, "k").select("cu", "cv", *UVW)


@query(O.first_round("supply", "SELECT EXISTS (SELECT 1 FROM parent a JOIN parent b ON a.c = b.v WHERE b.c <> b.v) AS changed"))
def any_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _parents(spark, sf_dir)
    b = a.select(F.col("v").alias("c"), F.col("c").alias("top"))
    return a.join(b, "c").agg(F.coalesce(F.bool_or(F.col("top") != F.col("c")), F.lit(False)).alias("changed"))


@query(O.first_round("supply", "SELECT (SELECT count(*) FROM offers) AS offers, count(*) AS components, (SELECT count(*) FROM offers) - count(*) AS beaten, round(((SELECT count(*) FROM offers) - count(*)) / (2.0 * (SELECT count(*) FROM e)), 6) AS rate FROM best"))
def offer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers that were beaten: what the collision counter of an atomic minimum has as its counterpart."""
    _, work = _first(spark, sf_dir)
    per = rounds.offers(work).groupBy("c").count().agg(F.sum("count").alias("offers"), F.count(F.lit(1)).alias("components"))
    rate = S.collision_rate(F.col("beaten"), F.col("offers") / 2, F.lit(1))
    return per.withColumn("beaten", F.col("offers") - F.col("components")).withColumn("rate", F.round(rate, 6))


@query(f"WITH {O.edges('supply_price')} SELECT u, arg_min(v, k) AS v, min(w) AS w FROM e GROUP BY u")
def candidate_struct_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lightest edge of each end by a struct, for weights without a rank."""
    return lightest(_graph(spark, sf_dir, "supply_price").edges, "u").select("u", "v", "w")


@query(f"WITH {O.edges('supply')} SELECT u, v, w, row_number() OVER (PARTITION BY u ORDER BY w, v) AS place FROM e")
def tie_break_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("u").orderBy("w", "eid")).cast("long")
    return _graph(spark, sf_dir, "supply").edges.select(*UVW, place.alias("place"))


# Keys, ends and checks.

NATION = "SELECT CAST(s_nationkey AS BIGINT) AS u, CAST(c_nationkey AS BIGINT) AS v, CAST(s_suppkey AS BIGINT) AS w, CAST(s_suppkey AS BIGINT) * 4294967296 + c_custkey AS eid FROM supplier JOIN customer ON s_suppkey = c_custkey"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a supplier and a customer with the same key: with loops and parallel edges."""
    s, c = (G.table(spark, sf_dir, t) for t in ("supplier", "customer"))
    key = F.col("s_suppkey").cast("long")
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey")).select(
        F.shiftleft(key, 32).bitwiseOR(F.col("c_custkey").cast("long")).alias("eid"), F.col("s_nationkey").cast("long").alias("u"), F.col("c_nationkey").cast("long").alias("v"), key.alias("w")
    )


@query(f"WITH {O.edges('supply')} SELECT u, v, w * 4294967296 + u AS k FROM e")
def packed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, "supply").edges.select("u", "v", packed_key("w", "u").alias("k"))


@query(f"WITH {O.edges('supply')} SELECT u, v, u AS id FROM e")
def unpacked_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, "supply").edges.withColumn("k", packed_key("w", "u")).select("u", "v", unpacked_id().alias("id"))


@query(f"SELECT u, v, w FROM ({NATION}) WHERE u <> v")
def self_loop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edges(_nations(spark, sf_dir)).without_loops().edges.select(*UVW)


@query(f"SELECT least(u, v) AS u, greatest(u, v) AS v, min(w) AS w FROM ({NATION}) WHERE u <> v GROUP BY ALL")
def dedup_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edges(_nations(spark, sf_dir)).simple().edges.select(*UVW)


@query(f"SELECT least(u, v) AS u, greatest(u, v) AS v, w FROM ({NATION})")
def normalized_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).select(*normalized_ends(), "w")


@query(f"SELECT least(u, v) * 4294967296 + greatest(u, v) AS k, w FROM ({NATION})")
def encoded_edge_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).select(encoded_key().alias("k"), "w")


@query(f"SELECT DISTINCT eid, v FROM (SELECT eid, u AS v FROM ({NATION}) UNION ALL SELECT eid, v FROM ({NATION})) WHERE v NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def invalid_vertex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = G.table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").cast("long").alias("v"))
    return unknown_ends(Graph.from_edges(_nations(spark, sf_dir), known))


@query(
    f"""SELECT reason, count(*) AS n FROM (SELECT eid, 'unknown end' AS reason FROM (SELECT DISTINCT eid, v FROM (SELECT eid, u AS v FROM ({NATION}) UNION ALL SELECT eid, v FROM ({NATION}))
    WHERE v NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2))) GROUP BY reason"""
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = G.table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").cast("long").alias("v"))
    return violations(Graph.from_edges(_nations(spark, sf_dir), known)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {O.edges('supply')}, {O.VERTICES} SELECT (SELECT count(*) FROM vs) AS vertices, count(*) AS edges, min(w) AS least, max(w) AS most, round(count(*) / (SELECT count(*) FROM vs), 4) AS density FROM e")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir, "supply")
    n = graph.vertex_ids().agg(F.count(F.lit(1)).alias("vertices"))
    e = graph.edges.agg(F.count(F.lit(1)).alias("edges"), F.min("w").alias("least"), F.max("w").alias("most"))
    return n.crossJoin(e).withColumn("density", S.density(F.col("edges"), F.col("vertices")))


@query(O.forest("supply_flags", "SELECT '  ' || least(u, v) || '-' || greatest(u, v) || ' (' || w || ')' AS line FROM msf"))
def edges_sorted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.edge_lines(minimum_spanning_forest(_graph(spark, sf_dir, "supply_flags"))).orderBy("a", "b", "w").select("line")


@query(f"SELECT u, v, w, 'tree' AS part FROM ({O.GEO}) UNION ALL SELECT u, v, w, 'extra' FROM ({O.SUPPLY['supply']})")
def tree_union_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, extra = _graph(spark, sf_dir, "geo").edges, _graph(spark, sf_dir, "supply").edges
    return tree.select(*UVW, F.lit("tree").alias("part")).unionByName(extra.select(*UVW, F.lit("extra").alias("part")))


@query("SELECT CAST(a.n_nationkey AS BIGINT) AS u, CAST(b.n_nationkey AS BIGINT) AS v FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def all_pairs_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vertices, as the layout of small graphs needs them; 128 vertices at most."""
    v = G.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("v"))
    return v.select(F.col("v").alias("u")).join(F.broadcast(v), F.col("u") < F.col("v"))


@query("SELECT min(s_acctbal) AS min_x, max(s_acctbal) AS max_x, CAST(min(s_nationkey) AS BIGINT) AS min_y, CAST(max(s_nationkey) AS BIGINT) AS max_y FROM supplier")
def bbox_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("s_nationkey").cast("long")
    return G.table(spark, sf_dir, "supplier").agg(F.min("s_acctbal").alias("min_x"), F.max("s_acctbal").alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


@query(f"WITH {O.edges('supply')} SELECT u, v, (31 * least(u, v) + greatest(u, v)) % 5 AS colour FROM e")
def edge_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, "supply").edges.select("u", "v", S.palette(F.col("u"), F.col("v")).alias("colour"))


@query("SELECT l_linestatus AS phase, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL")
def phase_max_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("phase")).agg(F.max("l_quantity").alias("most"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("SELECT l_returnflag AS backend, bool_and(l_discount <= 0.1) AS verified FROM lineitem GROUP BY ALL")
def all_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("backend")).agg(F.bool_and(F.col("l_discount") <= 0.1).alias("verified"))


# Benchmark analysis, over literal runs: four backends at the ten densities of a sweep.

RUNS_SQL = """r AS (SELECT backend, 32768 AS vertices, 32768 * d AS edges, CAST(d AS DOUBLE) AS density, CASE backend WHEN 'sequential' THEN 1 ELSE 8 END AS resources,
    0.01 * d AS overhead_seconds, 0.02 * d / CASE backend WHEN 'sequential' THEN 1 WHEN 'mpi' THEN 3 WHEN 'openmp' THEN 0.5 ELSE 20 END + 0.001 AS exec_seconds
    FROM (VALUES ('sequential'), ('openmp'), ('mpi'), ('cuda')) b(backend), (VALUES (1), (2), (4), (6), (12), (24), (48), (96), (192), (384)) t(d))"""


def _runs(spark: SparkSession) -> DataFrame:
    d, b = F.col("d"), F.col("backend")
    by = spark.createDataFrame([(x, y) for x in S.LABELS for y in (1, 2, 4, 6, 12, 24, 48, 96, 192, 384)], "backend string, d int")
    factor = F.when(b == "sequential", 1.0).when(b == "mpi", 3.0).when(b == "openmp", 0.5).otherwise(20.0)
    out = by.select(b, F.lit(32768).alias("vertices"), (d * 32768).alias("edges"), d.cast("double").alias("density"), F.lit(886261).alias("seed"), F.when(b == "sequential", 1).otherwise(8).alias("resources"), (d * 0.01).alias("overhead_seconds"), (d * 0.02 / factor + 0.001).alias("exec_seconds"))
    return out.withColumn("total_seconds", F.col("overhead_seconds") + F.col("exec_seconds")).withColumn("verified", F.lit("MATCH"))


THEORY = """CASE backend WHEN 'mpi' THEN (edges + vertices) / (edges / 8.0 + vertices * 3.0) WHEN 'openmp' THEN (edges + vertices) / (edges / 8.0 + vertices)
    WHEN 'cuda' THEN 142 * (density + 1) / (density + 15.0) ELSE 1.0 END"""


@query(f"WITH {RUNS_SQL} SELECT backend, edges, CAST(round({THEORY}, 4) AS DOUBLE) AS speedup, CAST(round({THEORY} / CASE backend WHEN 'cuda' THEN 142.0 ELSE resources END, 4) AS DOUBLE) AS efficiency FROM r")
def bench_theory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.theory(_runs(spark)).select("backend", "edges", "speedup", "efficiency")


@query("SELECT backend, CAST(threshold AS DOUBLE) AS threshold FROM (VALUES ('mpi', 24.0), ('openmp', 8.0), ('cuda', 15.0)) t(backend, threshold)")
def bench_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.thresholds(_runs(spark))


@query(
    f"""WITH {RUNS_SQL} SELECT r.backend, r.edges, CAST(round(b.exec_seconds / r.exec_seconds, 4) AS DOUBLE) AS speedup,
    CAST(round(b.exec_seconds / r.exec_seconds / CASE r.backend WHEN 'cuda' THEN 142.0 ELSE r.resources END, 4) AS DOUBLE) AS efficiency
    FROM r JOIN r b ON b.edges = r.edges AND b.backend = 'sequential' WHERE r.backend <> 'sequential'"""
)
def bench_measured_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.measured(_runs(spark))


_cell = "CAST(round(max(overhead_seconds + exec_seconds) FILTER (WHERE backend = '{0}'), 6) AS DOUBLE) AS {0}"


@query(f"WITH {RUNS_SQL} SELECT density, {', '.join(_cell.format(b) for b in S.LABELS)} FROM r GROUP BY density")
def bench_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_density(_runs(spark)).select("density", *[F.round(b, 6).alias(b) for b in S.LABELS])


@query(f"WITH {RUNS_SQL} SELECT backend, edges, CAST(round(overhead_seconds / (overhead_seconds + exec_seconds), 4) AS DOUBLE) AS share FROM r")
def bench_overhead_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overhead_share(_runs(spark))


@query(f"WITH {RUNS_SQL} SELECT backend, edges, density FROM r WHERE density = 6")
def bench_reference_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reference_slice(_runs(spark)).select("backend", "edges", "density")


@query(f"WITH {RUNS_SQL} SELECT backend, edges, density FROM r WHERE backend = 'mpi' AND density = 24")
def bench_run_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_at(_runs(spark), "mpi", 24.0).select("backend", "edges", "density")


@query(
    """SELECT backend, label, worker, took, share, times FROM (VALUES ('sequential', 'Sequential', '1 core', '250 us', '12.5%', '1.5x'), ('openmp', 'OpenMP', '8 thread', '12.346 ms', '25%', '3x'),
    ('mpi', 'MPI', '8 processi', '500 ms', '33.3%', '4.07x'), ('cuda', 'CUDA', '1 GPU', '2.5 s', '100%', '22.1x')) t(backend, label, worker, took, share, times)"""
)
def bench_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("sequential", 1, 0.00025, 1.0, 8.0, 1.5), ("openmp", 8, 0.0123456, 1.0, 4.0, 3.0), ("mpi", 8, 0.5, 1.0, 3.0, 4.0712), ("cuda", 1, 2.5, 5.0, 5.0, 22.1)]
    frame = spark.createDataFrame(rows, "backend string, n int, s double, part double, total double, x double")
    b = F.col("backend")
    return frame.select(b, S.backend_label(b).alias("label"), S.workers(b, F.col("n")).alias("worker"), S.duration(F.col("s")).alias("took"), S.percent(F.col("part"), F.col("total")).alias("share"), S.ratio(F.col("x")).alias("times"))


@query(f"WITH {RUNS_SQL} SELECT backend, edges, density, CAST(round(exec_seconds, 6) AS DOUBLE) AS exec_seconds FROM r")
def bench_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended to a folder of CSV files, one backend after another, and read back together."""
    import uuid

    from grovekit.storage import work_dir

    path = f"{work_dir(spark)}/grovekit/runs-{uuid.uuid4().hex}"
    for backend in S.LABELS:
        R.append_runs(_runs(spark).where(F.col("backend") == backend), path)
    return R.read_runs(spark, path).select("backend", "edges", "density", F.round("exec_seconds", 6).alias("exec_seconds"))


# Text functions, over lines made from orders.


@query("SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS edges FROM orders")
def parse_metrics_regexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("backend=mpi edges="), "o_custkey", F.lit(" exec_seconds=0.5"))
    return G.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.metric(line, "edges").alias("edges"))


@query("SELECT r_regionkey AS id, n FROM region, (VALUES ('1'), ('2'), ('4'), ('384')) t(n)", "split_list")
def _split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.explode(S.split_list(F.lit("1,2,4,384"))).alias("n"))


@query("SELECT s, CAST(n AS BIGINT) AS n FROM (VALUES ('12', 12), ('-7', -7), ('1x', NULL), ('', NULL), (' 3', NULL), ('4.0', NULL)) t(s, n)")
def try_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in ("12", "-7", "1x", "", " 3", "4.0")], "s string")
    return rows.select("s", S.strict_int(F.col("s")).alias("n"))


@query("SELECT s_suppkey AS id, true AS near, round(s_acctbal * 1000, 2) AS ms FROM supplier")
def tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("s_acctbal")
    return G.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), S.near(x * (1 + 1e-9), x, 1e-6).alias("near"), F.round(S.milliseconds(x), 2).alias("ms"))


@query(f"WITH {O.edges('supply_price')} SELECT k - 1 AS place, u, v, w FROM e")
def edge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapless places along (weight, id), by a range sort and counts of its partitions."""
    return dense_ids(_graph(spark, sf_dir, "supply_price").edges, "w", "eid", name="place").select("place", *UVW)


@query(f"SELECT eid, min(eid) OVER same AS first, count(*) OVER same AS n FROM ({NATION}) WINDOW same AS (PARTITION BY least(u, v), greatest(u, v))")
def same_undirected_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge with the first of those between the same two ends, whichever comes first, and their number."""
    e = _nations(spark, sf_dir).select("eid", encoded_key().alias("k"))
    return e.join(e.groupBy("k").agg(F.min("eid").alias("first"), F.count(F.lit(1)).alias("n")), "k").select("eid", "first", "n")


@query(O.forest("supply_flags", "SELECT u || ' ' || v || ' ' || w AS line FROM msf"))
def tree_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tree_lines(minimum_spanning_forest(_graph(spark, sf_dir, "supply_flags")))


SIZES = "(VALUES ('triangle', 3, 3), ('square', 4, 5), ('tie', 5, 5), ('test', 12, 29), ('sparse12', 12, 29), ('dense16', 16, 55))"


@query(f"SELECT name, CAST(vertices AS BIGINT) AS vertices, CAST(edges AS BIGINT) AS edges FROM {SIZES} t(name, vertices, edges)")
def catalog_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("triangle", "square", "tie", "test", "sparse12", "dense16"):
        graph = G.CATALOG[name](spark)
        v, e = graph.vertex_ids().agg(F.count(F.lit(1)).alias("vertices")), graph.edges.agg(F.count(F.lit(1)).alias("edges"))
        row = v.crossJoin(e).select(F.lit(name).alias("name"), "vertices", "edges")
        out = row if out is None else out.unionByName(row)
    return out


# Reports, generators and files: rows that SQL can't give.


@query()
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = G.load(spark, "test")
    forest = minimum_spanning_forest(graph)
    return report.json_report(forest, verify(graph, forest.edges), "test", {"exec": 0.0})


@query("""SELECT line FROM (VALUES ('MST weight = 30, edges = 11'), ('  1-2 (1)'), ('  7-8 (1)'), ('  2-4 (2)'), ('  5-8 (2)'), ('  9-11 (2)'), ('  0-2 (3)'), ('  4-5 (3)'), ('  8-10 (3)'), ('  3-6 (4)'), ('  10-11 (4)'), ('  3-5 (5)')) t(line)""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.text_summary(minimum_spanning_forest(G.load(spark, "test")))


GENERATED: dict[str, tuple[tuple[int, int, int, int], Callable[[SparkSession], Graph]]] = {
    "gen_random_int": ((2000, 12000, 1, 1000), lambda spark: G.random_connected(spark, 2000, 12000, 886261)),
    "gen_random_double": ((2000, 12000, 1, 100), lambda spark: G.random_connected(spark, 2000, 12000, 886261, "uniform_int", permute=False)),
    "gen_random_float": ((2000, 12000, 0, 1), lambda spark: G.random_connected(spark, 2000, 12000, 886261, "unit_float")),
    "gen_random_simple": ((64, 191, 1, 100), lambda spark: G.load(spark, "random")),
    "gen_large": ((32768, 229375, 1, 10000), lambda spark: G.load(spark, "large")),
}


def _generated(name: str, sizes: tuple[int, int, int, int], make: Callable[[SparkSession], Graph]) -> None:
    """What holds for every graph of the generator: its size, one component, no loop, weights in their range."""
    n, m, low, high = sizes

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = make(spark)
        e = graph.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("u") == F.col("v")).alias("loops"), F.count_if(~F.col("w").between(low, high)).alias("odd_weights"), F.countDistinct("eid").alias("ids"))
        c = components(graph).agg(F.count(F.lit(1)).alias("vertices"), F.countDistinct("c").alias("components"))
        return e.crossJoin(c)

    query(f"SELECT CAST({m} AS BIGINT) AS edges, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS odd_weights, CAST({m} AS BIGINT) AS ids, CAST({n} AS BIGINT) AS vertices, CAST(1 AS BIGINT) AS components", name)(run)


for _name, (_sizes, _make) in GENERATED.items():
    _generated(_name, _sizes, _make)


@query(f"SELECT eid, u, v, CAST(w AS DOUBLE) AS w FROM ({O.named('dense16')})")
def read_text_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as text and read back."""
    import uuid

    from grovekit.storage import materialize, work_dir

    path = f"{work_dir(spark)}/grovekit/graph-{uuid.uuid4().hex}.txt"
    G.write_text(G.load(spark, "dense16"), path)
    return materialize(G.read_text(spark, path).edges, "read")
