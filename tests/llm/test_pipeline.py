"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grovekit.llm import mixing, quality, registry
from grovekit.llm.common import unit

from .test_groups import expected_drops, similar_components
from .test_models import brute_score, brute_topics, plain_raking

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("kept", F.lit(1)).cache()
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: stages[name](spark, df, str(DATA)).cache()

    good = step("quality", docs)
    texts, labels = {i: r.text for i, r in rows(docs).items()}, spark.read.parquet(f"{DATA}/labels.parquet").collect()
    known = sorted((r.doc_id, r.quality) for r in labels if r.doc_id in texts and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    sample = [quality.terms(texts[i]) for i, _ in known]
    space = quality.Space(sample, np.array([q for _, q in known]))
    assert rows(good) == {i: r for i, r in rows(docs).items() if brute_score(space, sample, quality.terms(r.text)) >= 0.5}

    lines = step("lines", good)
    drops = expected_drops([(r.doc_id, r.text) for r in good.collect()])
    texts = {i: "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in drops[i]) for i, r in rows(good).items()}
    assert {i: (r.text, r.n_chars) for i, r in rows(lines).items()} == {i: (t, len(t)) for i, t in texts.items()}

    near = step("near duplicates", lines)
    label = similar_components(texts.items())
    assert set(rows(near)) == set(label.values())

    mixed = step("mixture", near)
    left, cells = rows(near.withColumn("draw", unit(F.col("doc_id").cast("string"), seed=mixing.DRAW_SEED))), {}
    topics = dict(zip(left, brute_topics([(r.lang, r.text) for r in left.values()]), strict=True))
    for i, r in left.items():
        cells[r.source, r.lang, topics[i]] = cells.get((r.source, r.lang, topics[i]), 0) + len((r.text or "").encode().split())
    chance = plain_raking(cells, mixing.FLATTEN, mixing.BUDGET)
    sure = lambda i: abs(left[i].draw - chance[left[i].source, left[i].lang, topics[i]]) > 1e-5
    kept = {i for i, r in left.items() if r.draw < chance[r.source, r.lang, topics[i]]}
    assert {i for i in rows(mixed) if sure(i)} == {i for i in kept if sure(i)} and len(kept) > 20

    assert all(x.columns == names for x in (good, lines, near, mixed))
    tokens = rows(step("tokens", mixed))
    assert set(tokens) == set(rows(mixed))
    assert all(r.n_tokens == len(r.ids) and r.n_bytes == len(texts[i].encode()) for i, r in tokens.items())
    assert rows(corpus_pipeline.run(spark, str(DATA))) == tokens


def test_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(DATA))
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.tokenized(spark, docs, str(DATA)).count() == docs.count()


def test_registered_queries(spark):
    assert sorted(registry.QUERIES, key=lambda x: int(x[2:].split("_")[0])) == [f for f in registry.QUERIES]
    assert [x.split("_")[0] for x in registry.QUERIES] == [f"op{n}" for n in range(1, 11)]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = registry.QUERIES[name](spark, str(DATA))
    cols = ", ".join(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"SELECT {cols} FROM ({registry.ORACLES[name]})").fetchall())
