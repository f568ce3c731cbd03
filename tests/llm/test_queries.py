"""The registered queries on the small tables, each against brute force over all its rows."""

from __future__ import annotations

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from grovekit.llm import html_text, mixing, quality, registry
from grovekit.llm.bpe import read_ranks

from .test_groups import fingerprint, linked
from .test_models import brute_score, brute_topics, plain_raking
from .test_rows import PATH, P, brute_fingerprint, brute_likeness, encoded, longest_match, regex, tiktoken

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    return {i: dict(text=x or "", lang=g, source=s) for i, x, g, s in zip(t["doc_id"], t["text"], t["lang"], t["source"], strict=True)}


def found(spark, name):
    return registry.QUERIES[name](spark, str(DATA)).collect()


def test_op1(spark, docs):
    rows = found(spark, "op1_sharding")
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(d["text"].encode()) + 1, zlib.crc32(d["text"].encode())) for i, d in docs.items()}
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert (r.law, r.grown_shard) == ("rows", None)
    assert sorted(slots) == list(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(rows) == len(docs)


def test_op2(spark, docs):
    rows = found(spark, "op2_mixing")
    topics = dict(zip(docs, brute_topics([(d["lang"], d["text"]) for d in docs.values()]), strict=True))
    cells = {}
    for i, d in docs.items():
        cell = d["source"], d["lang"], str(topics[i])
        cells[cell] = cells.get(cell, 0) + len(d["text"].encode().split())
    chance = plain_raking(cells, mixing.FLATTEN, mixing.BUDGET)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.topic == str(topics[r.doc_id]) and abs(r.probability - chance[r.source, r.lang, r.topic]) < 1e-5 and r.kept == (r.draw < r.probability)


def test_op4_and_op10(spark, docs):
    ranks = read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = found(spark, "op4_bpe")
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]["text"]
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    whole, known = regex.compile(P.PATTERN), {}
    for r in found(spark, "op10_token_counts"):
        words = whole.findall(docs[r.doc_id]["text"])
        for w in words:
            if w not in known:
                known[w] = longest_match(w.encode(), ranks)
        assert tuple(r)[1:] == (len(words), sum(known[w] for w in words))


def test_op5(spark):
    t = pq.read_table(f"{DATA}/pages.parquet").to_pydict()
    rows = {r.page_id: r for r in found(spark, "op5_html")}
    assert len(rows) == len(t["page_id"])
    for i, url, html in zip(t["page_id"], t["url"], t["html"], strict=True):
        # Pages of this table have one article each, and no block that its host repeats.
        assert (rows[i].url, rows[i].text, rows[i].n_chars) == (url, html_text.main_text(html, ()), len(html_text.main_text(html, ())))


def test_op6(spark, docs):
    own = {i: fingerprint(d["text"]) for i, d in docs.items()}
    smallest = {}
    for i in sorted(docs):
        smallest.setdefault(own[i], i)
    label = linked(list(smallest), lambda a, b: (a ^ b).bit_count() <= 2)
    top = {}
    for f, i in smallest.items():
        top[label[f]] = min(i, top.get(label[f], i))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found(spark, "op6_simhash")} == {i: (f"{f:016x}", top[label[f]]) for i, f in own.items()}


def test_op8(spark, docs):
    t = pq.read_table(f"{DATA}/labels.parquet").to_pydict()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = sorted((i, q) for i, q in zip(t["doc_id"], t["quality"], strict=True) if i in docs and q is not None and not held(i))
    sample = [quality.terms(docs[i]["text"]) for i, _ in known]
    space = quality.Space(sample, np.array([q for _, q in known]))
    rows = found(spark, "op8_quality")
    assert len(rows) == len(docs)
    for r in rows:
        assert abs(r.score - brute_score(space, sample, quality.terms(docs[r.doc_id]["text"]))) < 1e-6
        assert r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id)


def test_op9(spark, docs):
    order = sorted(docs, reverse=True)
    rows = {r.doc_id: r for r in found(spark, "op9_syncmers")}
    assert sorted(rows) == sorted(docs)
    for at, i in enumerate(order):
        text, after = docs[i]["text"], docs[order[(at + 1) % len(order)]]["text"]
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        if at < 25 and len(text) < 6000 and len(after) < 6000:
            own, edit, nxt = map(brute_fingerprint, (text, new, after))
            assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (encoded(own), encoded(edit))
            assert (rows[i].near_edited, rows[i].near_next) == (brute_likeness(own, edit), brute_likeness(own, nxt))
