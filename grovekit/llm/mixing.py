"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). The table of cells
is raked to the marginal targets of each of the three, no cell above what it
has, and each document is drawn with its cell's probability by a hash of its
id. Cells are sums over the corpus, and raking them never needs the documents.

Topics come from what the texts say: every text is a vector of its hashed words,
and the directions in which the texts of one language differ most, taken from
the second moments of all texts, part them by their signs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from grovekit.llm.common import pieces, restored, unit
from grovekit.storage import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Directions whose signs make the topics, buckets that words are hashed to, and groups that languages are hashed to.
DIRECTIONS, BUCKETS, LANGUAGES = 3, 64, 64
#: Vectors have whole numbers up to this, so that their sums don't depend on the order of rows.
SCALE = 1024
#: Words whose buckets a task remembers.
REMEMBERED = 1 << 16
#: Share of all tokens in the mixture, and the powers that flatten the shares of each marginal.
BUDGET, FLATTEN = 0.8, {"source": 0.7, "lang": 0.7, "topic": 0.5}
ROUNDS, TOLERANCE = 200, 1e-9
#: A marginal is met if no more than this share of what is wanted is missing.
MISSING = 1e-3
#: Beyond so many cells the raking runs as joins and aggregates.
DRIVER_CELLS = 200_000
DRAW_SEED = 17


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def language(lang: str | None) -> int:
    return LANGUAGES if lang is None else xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass")) % LANGUAGES


class Places(dict):
    """Each word's place: its bucket, and whether it counts for or against it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        place = self[word] = xxhash.xxh32_intdigest(word) % (2 * BUCKETS)
        return place


def vector(words: list[bytes], places: Places) -> np.ndarray:
    """Counts of words by bucket, with a sign of each word's own; the square roots, to a length of ``SCALE``."""
    whole = np.bincount(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), minlength=2 * BUCKETS)
    x = whole[:BUCKETS] - whole[BUCKETS:]
    x = np.sign(x) * np.sqrt(np.abs(x))
    return np.rint(x * (SCALE / max(math.sqrt(float(x @ x)), 1e-12))).astype(np.int64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the texts of a task: the products of buckets, then for each language the buckets and the number of texts."""
    places, products, sums = Places(), np.zeros((BUCKETS, BUCKETS), np.int64), np.zeros((LANGUAGES + 1, BUCKETS + 1), np.int64)
    for b in pieces(batches, "text"):
        x = np.array([vector(words_of(t.as_py()), places) for t in b["text"]], np.int64).reshape(-1, BUCKETS)
        products += x.T @ x
        np.add.at(sums, [language(v) for v in b["lang"].to_pylist()], np.c_[x, np.ones(len(x), np.int64)])
    flat = np.r_[products.ravel(), sums.ravel()]
    used = np.flatnonzero(flat)
    yield pa.record_batch({"place": pa.array(used, pa.int32()), "value": pa.array(flat[used])})


class Topics:
    """The directions in which texts differ most from the mean of their language, from the moments of all texts."""

    def __init__(self, flat: np.ndarray) -> None:
        products, sums = flat[: BUCKETS * BUCKETS].reshape(BUCKETS, BUCKETS), flat[BUCKETS * BUCKETS :].reshape(LANGUAGES + 1, BUCKETS + 1)
        n = np.maximum(sums[:, -1:], 1)
        self.mean = sums[:, :-1] / n
        values, vectors = np.linalg.eigh(products / SCALE**2 - (self.mean * n / SCALE).T @ (self.mean / SCALE))
        found = vectors[:, np.argsort(-values)[:DIRECTIONS]]
        self.directions = found * np.sign(found[np.argmax(np.abs(found), axis=0), np.arange(found.shape[1])])

    @classmethod
    def of(cls, docs: DataFrame) -> Topics:
        """From all rows of ``docs`` (lang, text); the driver gets ``BUCKETS`` times (``BUCKETS`` + ``LANGUAGES``) sums."""
        flat = np.zeros(BUCKETS * BUCKETS + (LANGUAGES + 1) * (BUCKETS + 1), np.int64)
        for r in docs.select("lang", "text").mapInArrow(_moments, "place int, value long").groupBy("place").agg(F.sum("value")).collect():
            flat[r[0]] = r[1]
        return cls(flat)

    def topic(self, x: np.ndarray, langs: list[str | None]) -> list[int]:
        if not len(x):
            return []
        signs = np.round((x - self.mean[[language(v) for v in langs]]) @ self.directions, 6) > 0
        return (signs @ (1 << np.arange(signs.shape[1]))).tolist()


def _measured(topics: Topics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for b in pieces(batches, "text"):
            x, counts = np.zeros((b.num_rows, BUCKETS), np.int64), np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b["text"]):  # one text's words at a time
                words = words_of(t.as_py())
                x[i], counts[i] = vector(words, places), len(words)
            found = topics.topic(x, b["lang"].to_pylist())
            kept = {c: b[c] for c in b.schema.names if c != "text"}
            yield pa.record_batch({**kept, "topic": pa.array([str(t) for t in found], pa.string()), "n_tokens": pa.array(counts)})

    return run


def wanted(have: np.ndarray, power: float, whole: float) -> np.ndarray:
    """Tokens to take of each value of a marginal, ``whole`` in all: in proportion to what it has to a power under 1, and no more than it has.

    Small values are lifted and large ones lowered; what a value lacks goes to the others.
    """
    raised = np.where(have > 0, np.maximum(have, 0.0) ** power, 0.0)
    low, high = 0.0, float((have[have > 0] / raised[have > 0]).max()) if (have > 0).any() else 0.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if np.minimum(have, middle * raised).sum() < whole else (low, middle)
    return np.minimum(have, high * raised)


def rake(cells: np.ndarray, keys: Sequence[np.ndarray], wanted: Sequence[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Tokens to take from each cell: raked to the marginals in turn, never above ``cells``.

    Where the marginals can be met within what the cells have, the result meets
    them; where not, it comes as near as scaling and capping in turn bring it
    (``missing`` tells by how much).
    """
    fitted = cells * min(1.0, sum(map(float, wanted[0])) / max(cells.sum(), 1e-12))
    for _ in range(rounds):
        before = fitted
        for key, want in zip(keys, wanted, strict=True):
            have = np.bincount(key, fitted, len(want))
            factor = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            fitted = np.minimum(fitted * factor[key], cells)
        if np.abs(fitted - before).sum() <= TOLERANCE * max(cells.sum(), 1.0):
            break
    return fitted


def missing(fitted: np.ndarray, key: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The share of what each value of a marginal wants that it doesn't get; below zero where it gets more."""
    return np.where(want > 0, 1 - np.bincount(key, fitted, len(want)) / np.maximum(want, 1e-300), 0.0)


def fit_cells(cells: DataFrame, budget: float, flatten: dict[str, float], driver_cells: int = DRIVER_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the dimensions and tokens) with the probability of each, and for each dimension d, as d_missing, what its value lacks."""
    spark, dims = cells.sparkSession, list(flatten)
    schema = ", ".join(f"{d} string" for d in dims) + ", probability double, " + ", ".join(f"{d}_missing double" for d in dims)
    if cells.count() > driver_cells:
        return _fit_joined(cells, budget, flatten, rounds)
    rows = sorted(cells.collect(), key=lambda r: tuple((r[d] is None, r[d] or "") for d in dims))
    tokens = np.array([r.tokens for r in rows], float)
    keys, wants = [], []
    for d in dims:
        place: dict = {}
        keys.append(np.array([place.setdefault(r[d], len(place)) for r in rows], int))
        wants.append(wanted(np.bincount(keys[-1], tokens, len(place)), flatten[d], budget * tokens.sum()))
    fitted = rake(tokens, keys, wants, rounds) if len(rows) else tokens
    chance = np.where(tokens > 0, fitted / np.maximum(tokens, 1), 1.0)
    lack = [missing(fitted, k, w)[k].tolist() for k, w in zip(keys, wants, strict=True)] if len(rows) else [[]] * len(dims)
    return spark.createDataFrame([(*[r[d] for d in dims], float(p), *x) for r, p, *x in zip(rows, chance, *lack, strict=True)], schema)


def _wanted_joined(sums: DataFrame, power: float, whole: float) -> DataFrame:
    """``wanted`` for a table (value, s), by a search of 16 factors at a time."""
    sums = materialize(sums.withColumn("raised", F.when(F.col("s") > 0, F.pow(F.col("s"), F.lit(power))).otherwise(0.0)), "marginal")
    low, high = 0.0, sums.where("s > 0").agg(F.max(F.col("s") / F.col("raised"))).first()[0] or 0.0
    for _ in range(11):
        steps = [low + (high - low) * i / 16 for i in range(17)]
        got = sums.agg(*[F.sum(F.least(F.col("s").cast("double"), F.lit(x) * F.col("raised"))) for x in steps]).first()
        at = next((i for i in range(1, 16) if (got[i] or 0) >= whole), 16)
        low, high = steps[at - 1], steps[at]
    return materialize(sums.select("value", F.least(F.col("s").cast("double"), F.lit(high) * F.col("raised")).alias("want")), "wanted")


def _fit_joined(cells: DataFrame, budget: float, flatten: dict[str, float], rounds: int) -> DataFrame:
    """The same raking as aggregates and joins, for tables of cells too large for the driver; it equals ``rake`` but for rounding."""
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    shares = {d: _wanted_joined(cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("s")), power, budget * whole) for d, power in flatten.items()}
    start = min(1.0, (shares[next(iter(flatten))].agg(F.sum("want")).first()[0] or 0.0) / max(whole, 1e-12))
    now = materialize(cells.withColumn("fitted", F.col("tokens") * start).withColumn("was", F.lit(0.0)), "rake")

    def factors(frame: DataFrame, d: str) -> DataFrame:
        have = frame.groupBy(F.col(d).alias("value")).agg(F.sum("fitted").alias("have"))
        return have.join(shares[d], have["value"].eqNullSafe(shares[d]["value"])).select(have["value"], F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0).alias("factor"))

    for _ in range(rounds):
        now = now.withColumn("was", F.col("fitted"))
        for d in flatten:
            factor = factors(now, d)
            now = now.join(factor, now[d].eqNullSafe(factor["value"])).withColumn("fitted", F.least(F.col("fitted") * F.col("factor"), F.col("tokens").cast("double"))).drop("value", "factor")
        now = materialize(now, "rake")
        if (now.agg(F.sum(F.abs(F.col("fitted") - F.col("was")))).first()[0] or 0) <= TOLERANCE * max(whole, 1):
            break
    for d in flatten:
        factor = factors(now, d)
        lack = F.when(F.col("factor") > 0, 1 - 1 / F.col("factor")).otherwise(0.0)
        now = now.join(factor, now[d].eqNullSafe(factor["value"])).withColumn(f"{d}_missing", lack).drop("value", "factor")
    return now.select(*flatten, F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(1.0).alias("probability"), *[f"{d}_missing" for d in flatten])


def _cells(docs: DataFrame, topics: Topics, carry: bool, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """Each row's cell and tokens, and with ``carry`` all its columns."""
    given = docs.select(
        *([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] if carry else []),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.crc32(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")).alias("crc"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    schema = StructType([f for f in given.schema.fields if f.name != "text"]).add("topic", StringType()).add("n_tokens", LongType())
    return given.mapInArrow(_measured(topics), schema)


def _topics(docs: DataFrame, text_col: str, lang_col: str) -> Topics:
    return Topics.of(docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")))


def _drawn(rows: DataFrame, cells: DataFrame, budget: float, flatten: dict[str, float], seed: int) -> DataFrame:
    fitted = fit_cells(cells, budget, flatten).select(*[F.col(d).alias(f"cell_{d}") for d in DIMENSIONS], "probability", *[f"{d}_missing" for d in DIMENSIONS])
    small = F.broadcast(fitted) if cells.count() <= DRIVER_CELLS else fitted
    match = [rows[d].eqNullSafe(small[f"cell_{d}"]) for d in DIMENSIONS]
    draw = unit(F.coalesce(F.col("doc_id").cast("string"), F.col("crc").cast("string")), seed=seed)
    return rows.join(small, match[0] & match[1] & match[2]).withColumn("draw", draw).withColumn("kept", F.col("draw") < F.col("probability"))


def mix_documents(docs: DataFrame, *, budget: float = BUDGET, flatten: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = DRAW_SEED) -> DataFrame:
    """Every row with its cell and draw: doc_id, source, lang, topic, n_tokens, probability, draw, kept, source_missing, lang_missing, topic_missing, met.

    Tokens are words between ASCII white space; the topic comes from the whole
    text. No value of a marginal is to give more than it has; where all
    three can't be met together, the missing shares of the row's values tell it,
    and ``met`` whether every value of all three is met. A null source or
    language is a value of its own. Texts without words
    have no tokens, so they cannot change the mixture: where their cell has no
    tokens they are kept. Rows with equal ids are drawn alike in a cell; rows
    without id are drawn by their text's checksum. An empty table stays empty.
    """
    rows = materialize(_cells(docs, _topics(docs, text_col, lang_col), False, id_col, text_col, source_col, lang_col), "measured")
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    drawn = _drawn(rows, cells, budget, flatten or FLATTEN, seed)
    lacks = [f"{d}_missing" for d in DIMENSIONS]
    most = drawn.agg(F.max(F.greatest(*[F.abs(c) for c in lacks]))).first()[0] or 0.0
    return drawn.select("doc_id", *DIMENSIONS, "n_tokens", "probability", "draw", "kept", *lacks, F.lit(most <= MISSING).alias("met"))


def mixture(docs: DataFrame, *, budget: float = BUDGET, flatten: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = DRAW_SEED) -> DataFrame:
    """The rows of ``docs`` that ``mix_documents`` keeps, with all their columns; the texts aren't shuffled."""
    names, topics = (id_col, text_col, source_col, lang_col), _topics(docs, text_col, lang_col)
    cells = _cells(docs, topics, False, *names).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    drawn = _drawn(_cells(docs, topics, True, *names), materialize(cells, "cells"), budget, flatten or FLATTEN, seed)
    return restored(drawn.where("kept"), docs)
