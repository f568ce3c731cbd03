"""DuckDB SQL that gives the same results by other means; used by checks and tests only."""

from __future__ import annotations

from grovekit.sources.graphs import LITERAL, literal_edges

SUPPLY = {
    "supply": "SELECT l_suppkey AS u, 1000000 + l_partkey AS v, CAST(min(l_linenumber) AS BIGINT) AS w FROM lineitem GROUP BY ALL",
    "supply_flags": """SELECT l_suppkey + f * 1000000000 AS u, 1000000 + l_partkey + f * 1000000000 AS v, CAST(min(l_linenumber) AS BIGINT) AS w
        FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS f FROM lineitem) GROUP BY ALL""",
    "supply_double": "SELECT l_suppkey AS u, 1000000 + l_partkey AS v, min(l_extendedprice) AS w FROM lineitem GROUP BY ALL",
    "supply_negative": "SELECT l_suppkey AS u, 1000000 + l_partkey AS v, CAST(-max(l_linenumber) AS BIGINT) AS w FROM lineitem GROUP BY ALL",
    "supply_price": "SELECT l_suppkey AS u, 1000000 + l_partkey AS v, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS w FROM lineitem GROUP BY ALL",
}
GEO = """SELECT CAST(n_regionkey AS BIGINT) AS u, CAST(n_nationkey AS BIGINT) + 100 AS v, CAST(n_nationkey % 7 + 1 AS BIGINT) AS w FROM nation
    UNION ALL SELECT CAST(s_nationkey AS BIGINT) + 100, CAST(s_suppkey AS BIGINT) + 1000000, CAST(s_suppkey % 11 + 1 AS BIGINT) FROM supplier
    UNION ALL SELECT CAST(c_nationkey AS BIGINT) + 100, CAST(c_custkey AS BIGINT) + 2000000000, CAST(c_custkey % 13 + 1 AS BIGINT) FROM customer"""


def named(name: str) -> str:
    """(eid, u, v, w) of a named graph as literals."""
    if name == "dense16":
        return """SELECT CAST(row_number() OVER (ORDER BY step, x, s) - 1 AS BIGINT) AS eid, CAST(x AS BIGINT) AS u, CAST(o AS BIGINT) AS v, CAST(w AS BIGINT) AS w FROM (
            SELECT 0 AS step, x, 1 AS s, (x + 1) % 16 AS o, 1 + x % 7 AS w FROM range(16) r(x)
            UNION ALL SELECT 1, x, s, (x + s) % 16, 3 + (x + (x + s) % 16) % 11 FROM range(16) r(x), range(2, 5) t(s) WHERE x < (x + s) % 16)"""
    rows = ", ".join(f"({e}, {u}, {v}, {w})" for e, u, v, w in literal_edges(name))
    return f"SELECT CAST(eid AS BIGINT) AS eid, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, CAST(w AS BIGINT) AS w FROM (VALUES {rows}) t(eid, u, v, w)"


def edges(name: str) -> str:
    """(k, u, v, w): ranked edges, as common table expressions that begin a query."""
    if name in LITERAL or name == "dense16":
        source, order = named(name), "w, eid"
    else:
        source, order = GEO if name == "geo" else SUPPLY[name], "w, u, v"
    return f"e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}) AS k, * FROM ({source}))"


VERTICES = "vs AS MATERIALIZED (SELECT u AS v FROM e UNION SELECT v FROM e)"


def forest(name: str, tail: str) -> str:
    """``tail`` over e, vs, msf (k, u, v, w), and cc (it, v, comp): labels that merge by hooking along lightest edges."""
    crossing = "SELECT a.it, a.comp AS ca, b.comp AS cb, e.k FROM e JOIN {cc} a ON a.v = e.u JOIN {cc} b ON b.v = e.v AND b.it = a.it WHERE a.comp <> b.comp"
    return f"""
    WITH RECURSIVE {edges(name)}, {VERTICES},
    cc(it, v, comp) AS (
        SELECT 0, v, v FROM vs
        UNION ALL
        (WITH x AS (SELECT a.it, a.comp AS ca, b.comp AS cb, e.k FROM e JOIN cc a ON a.v = e.u JOIN cc b ON b.v = e.v WHERE a.comp <> b.comp),
            best AS (SELECT comp, min(k) AS k FROM (SELECT ca AS comp, k FROM x UNION ALL SELECT cb, k FROM x) GROUP BY comp),
            hook AS (SELECT best.comp, least(best.comp, a.comp, b.comp) AS top FROM best JOIN e USING (k) JOIN cc a ON a.v = e.u JOIN cc b ON b.v = e.v)
        SELECT cc.it + 1, cc.v, coalesce(hook.top, cc.comp) FROM cc LEFT JOIN hook ON hook.comp = cc.comp WHERE EXISTS (SELECT 1 FROM best))
    ),
    crossing AS ({crossing.format(cc="cc")}),
    msf AS MATERIALIZED (SELECT e.* FROM e JOIN (
        SELECT DISTINCT k FROM (SELECT it, comp, min(k) AS k FROM (SELECT it, ca AS comp, k FROM crossing UNION ALL SELECT it, cb, k FROM crossing) GROUP BY it, comp)) USING (k)),
    last AS (SELECT v, min(v) OVER (PARTITION BY comp) AS c FROM cc WHERE it = (SELECT max(it) FROM cc))
    {tail}"""


#: The first round over a graph: the candidates, the components' successors.
def first_round(name: str, tail: str) -> str:
    return f"""
    WITH {edges(name)}, {VERTICES},
    offers AS (SELECT u AS c, k FROM e WHERE u <> v UNION ALL SELECT v, k FROM e WHERE u <> v),
    best AS MATERIALIZED (SELECT c, min(k) AS k FROM offers GROUP BY c),
    succ AS MATERIALIZED (SELECT best.c, CASE WHEN e.u = best.c THEN e.v ELSE e.u END AS p FROM best JOIN e USING (k)),
    parent AS MATERIALIZED (SELECT a.c AS v, CASE WHEN b.p = a.c AND a.c < a.p THEN a.c ELSE a.p END AS c FROM succ a JOIN succ b ON b.c = a.p)
    {tail}"""


def trace(name: str, most: int) -> str:
    """(round, components) before the first round and after each of ``most`` rounds at most, each spelt out: best edges, then what they connect."""
    parts = [f"WITH RECURSIVE {edges(name)}, {VERTICES}, lab0 AS MATERIALIZED (SELECT v, v AS c FROM vs)"]
    for r in range(1, most + 1):
        parts.append(f"""
    x{r} AS MATERIALIZED (SELECT a.c AS ca, b.c AS cb, e.k FROM e JOIN lab{r - 1} a ON a.v = e.u JOIN lab{r - 1} b ON b.v = e.v WHERE a.c <> b.c),
    best{r} AS MATERIALIZED (SELECT DISTINCT k FROM (SELECT c, min(k) AS k FROM (SELECT ca AS c, k FROM x{r} UNION ALL SELECT cb, k FROM x{r}) GROUP BY c)),
    link{r} AS MATERIALIZED (SELECT ca AS a, cb AS b FROM x{r} JOIN best{r} USING (k) UNION SELECT cb, ca FROM x{r} JOIN best{r} USING (k)),
    reach{r}(c, top) AS (SELECT a, a FROM link{r} UNION SELECT l.b, s.top FROM reach{r} s JOIN link{r} l ON l.a = s.c),
    lab{r} AS MATERIALIZED (SELECT v, coalesce(top, p.c) AS c FROM lab{r - 1} p LEFT JOIN (SELECT c, min(top) AS top FROM reach{r} GROUP BY c) t ON t.c = p.c)""")
    counts = " UNION ALL ".join(f"SELECT {r} AS round, count(DISTINCT c) AS components FROM lab{r}" for r in range(most + 1))
    return f"{', '.join(parts)}, n AS ({counts}) SELECT CAST(round AS INTEGER) AS round, components FROM n WHERE round = 0 OR components < (SELECT p.components FROM n p WHERE p.round = n.round - 1)"
