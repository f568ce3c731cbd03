"""Scalar functions, as column expressions."""

from __future__ import annotations

import datetime
import os
import socket

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the backends and their workers are named.
LABELS = {"sequential": "Sequential", "openmp": "OpenMP", "mpi": "MPI", "cuda": "CUDA"}
WORKERS = {"sequential": "core", "mpi": "processi", "openmp": "thread", "cuda": "GPU"}


def near(a: Column, b: Column, eps: float) -> Column:
    """Equal up to a relative tolerance."""
    return F.abs(a - b) < eps * (1 + F.abs(b))


def density(edges: Column, vertices: Column) -> Column:
    return F.round(edges / vertices, 4)


def palette(u: Column, v: Column, colours: int = 5) -> Column:
    """A colour number for an edge, the same from either end."""
    return F.pmod(F.least(u, v) * 31 + F.greatest(u, v), F.lit(colours))


def milliseconds(seconds: Column) -> Column:
    return seconds * 1000


def metric(text: Column, key: str) -> Column:
    """The number after ``key=`` in program output; null without one."""
    found = F.regexp_extract(text, rf"(?:^|\s){key}=([0-9.]*)", 1)
    return F.when(found != "", found)


def split_list(text: Column) -> Column:
    return F.split(text, ",")


def strict_int(text: Column) -> Column:
    """The whole string as an integer, else null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text).try_cast("long")


def _short(x: Column, digits: int) -> Column:
    """At most so many decimals, without zeros at the end."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", x.cast("double")), r"\.?0+$", "")


def duration(seconds: Column) -> Column:
    """Microseconds to 2 decimals, or milliseconds or seconds to 3, whichever reads best."""
    us, ms, s = (F.concat(_short(x, n), F.lit(unit)) for x, n, unit in ((seconds * 1e6, 2, " us"), (seconds * 1e3, 3, " ms"), (seconds, 3, " s")))
    return F.when(seconds < 1e-3, us).when(seconds < 1, ms).otherwise(s)


def percent(part: Column, total: Column) -> Column:
    return F.concat(_short(100 * part / total, 1), F.lit("%"))


def ratio(x: Column) -> Column:
    return F.concat(_short(x, 2), F.lit("x"))


def _named(key: Column, names: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in names.items():
        out = out.when(key == k, v)
    return out.otherwise(key)


def backend_label(backend: Column) -> Column:
    return _named(backend, LABELS)


def workers(backend: Column, resources: Column) -> Column:
    """How many workers a run had, with their name."""
    return F.concat_ws(" ", resources.cast("string"), _named(backend, WORKERS))


def collision_rate(count: Column, edges: Column, rounds: Column) -> Column:
    """Beaten offers as a share of all that the rounds could make, two for each edge."""
    return count / (F.greatest(edges, F.lit(1)) * F.greatest(rounds, F.lit(1)) * 2.0)


def verified(text: Column) -> Column:
    """One boolean from the words that programs report: MATCH, PASS and the like."""
    return F.upper(text).isin("MATCH", "PASS", "TRUE", "OK")


def utc_now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def hostname() -> str:
    return socket.gethostname()


def env(name: str) -> str:
    return os.environ.get(name, "")
