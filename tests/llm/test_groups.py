"""Operators that find groups: exact dedup, SimHash, near-equal lines."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from grovekit.llm import common, exact_dedup, linededup, simhash
from grovekit.llm.editdistance import within

from .conftest import odd_rows, prose


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_groups(odd, none):
    rows = odd_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    expected = []
    for r in rows:
        ids = groups[lowered(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        expected.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(lowered(r[1]).encode()).hexdigest()))
    found = exact_dedup.exact_groups(odd).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert exact_dedup.exact_groups(none).count() == 0


def test_only_latin_capitals_are_lowered(make):
    found = exact_dedup.exact_groups(make([(1, "ÄB"), (2, "Äb"), (3, "äb"), (4, "\u212a"), (5, "K"), (6, "k")])).collect()
    assert {r.doc_id: r.keep_id for r in found} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 6, 6: 6}


@pytest.mark.parametrize("limit", [1, 500, 4000, 1 << 30])
def test_grace_partitions_again(limit):
    rnd = random.Random(1)
    content = [prose(rnd, rnd.randint(0, 8)).encode() for _ in range(400)]
    records = [(xxhash.xxh64_intdigest(c), c, rnd.choice([None, i]), 1 + i % 3) for i, c in enumerate(rnd.choices(content, k=3000))]
    expected: dict = {}
    for _, c, top, n in records:
        a, b = expected.get(c, (None, 0))
        expected[c] = (max((x for x in (a, top) if x is not None), default=None), b + n)
    found = {c: (top, n) for _, c, top, n in exact_dedup.grace(iter(records), limit)}
    assert found == expected


def test_equal_hashes_are_told_apart():
    records = [(7, b"a", 1, 1), (7, b"b", 2, 1), (7, b"a", 3, 1)]
    for limit in (1, 1 << 20):
        assert sorted(exact_dedup.grace(records, limit)) == [(7, b"a", 3, 2), (7, b"b", 2, 1)]


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(nodes, near):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[:i]:
            if near(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_near_duplicates(odd, none):
    rows = odd_rows()
    ids: dict[int, list] = defaultdict(list)
    for r in rows:
        ids[fingerprint(r[1])].append(r[0])
    smallest = {f: min((i for i in v if i is not None), default=None) for f, v in ids.items()}
    named = {f: i for f, i in smallest.items() if i is not None}
    label = linked(named, lambda a, b: (a ^ b).bit_count() <= 2)
    component = {f: min(named[g] for g in named if label[g] == label[f]) for f in named}
    expected = [(r[0], fingerprint(r[1]), component.get(fingerprint(r[1]))) for r in rows]
    found = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    assert simhash.near_duplicates(none).count() == 0


def wide_bits(text):
    """Fingerprint as one number, and the keys, of the different shingles of five words."""
    h = sorted(set(simhash.shingle_hashes(text, 5)))
    bits, keys = 0, set()
    for w in range(simhash.WORDS):
        mixed = [int(x) for x in simhash._word(np.array(h, np.uint64), w)]
        for b in range(64 if h else 0):
            twice = 2 * sum(x >> b & 1 for x in mixed)
            bits |= (mixed[0] >> b & 1 if twice == len(h) else twice > len(h)) << (64 * w + b)
    for i in range(simhash.KEYS if h else 0):
        salt = xxhash.xxh64_intdigest(f"key {i}") | 1
        keys.add(min(simhash._word(np.array([x * salt & (1 << 64) - 1 for x in h], np.uint64), 1).tolist()))
    return bits, frozenset(keys)


def similar_components(docs):
    """docs: (id, text) with different ids; the component of each id by brute force."""
    radius = simhash.radius_of(simhash.SIMILARITY)
    whole = {i: wide_bits(t) for i, t in docs}
    return linked(whole, lambda a, b: whole[a][0] == whole[b][0] or (whole[a][0] ^ whole[b][0]).bit_count() <= radius and whole[a][1] & whole[b][1])


def similar_docs():
    rnd = random.Random(31)
    docs, base = [], [prose(rnd, 150) for _ in range(12)]
    for i in range(90):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 1, 2, 6, 40])):
            words[rnd.randrange(len(words))] = prose(rnd, 1)
        docs.append((i, " ".join(words)))
    return docs + [(200, ""), (201, None), (202, "\n"), (203, "only three words"), (204, "Only three words"), (205, "only four words here")]


@pytest.mark.parametrize("tile", [4096, 3])
def test_similar_groups(make, tile):
    docs = similar_docs()
    expected = similar_components(docs)
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(make(docs), tile=tile).collect()}
    assert found == expected
    assert 12 <= len(set(expected.values())) < 60


def jaccard(a, b, width):
    words = [re.findall("[^\x20\x09-\x0d]+", lowered(t)) for t in (a, b)]
    x, y = ({" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} for w in words)
    return len(x & y) / len(x | y)


def test_near_copies_are_found():
    """By exact shingle sets: all pairs of 3-word similarity 0.5 and more are near, none under 0.3."""
    docs = dict(similar_docs()[:90])
    radius = simhash.radius_of(simhash.SIMILARITY)
    whole = {i: wide_bits(t) for i, t in docs.items()}
    near = {(a, b): (whole[a][0] ^ whole[b][0]).bit_count() <= radius and bool(whole[a][1] & whole[b][1]) for a in docs for b in docs if a < b}
    share = {(a, b): jaccard(docs[a], docs[b], 3) for a, b in near}
    high = [p for p, j in share.items() if j >= 0.5]
    assert len(high) > 100 and sum(near[p] for p in high) >= 0.99 * len(high)
    assert not [p for p, j in share.items() if j < 0.3 and near[p]]
    assert abs(simhash.jaccard_of(0.85) - 0.285) < 0.001 and simhash.radius_of(0.85) == 181


def test_one_of_each_group_stays(odd, none):
    rows = odd_rows()
    label = similar_components([(n, r[1]) for n, r in enumerate(rows)])
    smallest: dict = {}
    for n, r in enumerate(rows):
        if r[0] is not None:
            smallest[label[n]] = min(r[0], smallest.get(label[n], r[0]))
    found = simhash.similar_groups(odd).collect()
    assert sorted(map(repr, ((r.doc_id, r.component_id) for r in found))) == sorted(repr((r[0], smallest.get(label[n]))) for n, r in enumerate(rows))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(smallest.get(c)) for c in set(label.values()))
    assert simhash.keep_one(none).count() == 0


def test_repeated_rows_go(make):
    rnd = random.Random(51)
    a, b, c = (prose(rnd, 60) for _ in range(3))
    frame = make([(1, a), (1, a), (2, a), (3, b), (3, c), (3, c), (None, a), (None, "x y z"), (None, "x y z")])
    found = simhash.keep_one(frame).collect()
    assert sorted((repr(r.doc_id), r.text) for r in found) == sorted([("1", a), ("3", b), ("3", c), ("None", "x y z")])


@pytest.mark.parametrize(("radius", "segments", "most"), [(0, 4, 4096), (2, 4, 4096), (2, 4, 3), (2, 8, 4096), (3, 2, 20)])
def test_tiles_lose_no_link(spark, radius, segments, most):
    rnd = random.Random(radius)
    points = [rnd.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for _ in range(240):
        points.append(points[rnd.randrange(len(points))] ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))))
    points = list(dict.fromkeys(points))
    rows = [(p - (p >> 63 << 64), i) for i, p in enumerate(points)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, rep long").repartition(3), radius, segments, most).collect()
    label = linked(range(len(points)), lambda a, b: (points[a] ^ points[b]).bit_count() <= radius)
    pairs = {(r.u, r.v) for r in links}
    assert linked(range(len(points)), lambda a, b: (a, b) in pairs or (b, a) in pairs) == label
    assert most < 4096 or len(links) < 8 * len(points)


def test_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rnd = random.Random(3)
    for _ in range(1500):
        a = [rnd.choice("abé") for _ in range(rnd.randint(0, 140))]
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b"])
        a, b = "".join(a), "".join(b)
        d = distance(a, b)
        assert all(within(a, b, k) == within(b, a, k) == (d <= k) for k in (0, 1, 2, 3, 5)), (a, b, d)


def edited_lines(rnd, n, least):
    lines = [prose(rnd, 12)[: least + rnd.randint(0, 30)].ljust(least, "q") for _ in range(n)]
    for _ in range(4 * n):
        x = list(rnd.choice(lines))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(x))
            x[at : at + rnd.randint(0, 1)] = rnd.choice(["", "k", "é", "🙂"])
        lines.append("".join(x))
    return list(dict.fromkeys(lines))


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_every_pair_of_near_lines_meets(threshold):
    lines = edited_lines(random.Random(threshold), 40, 40)
    lines += edited_lines(random.Random(threshold + 9), 20, 10)
    key, kind, own = linededup.probes(lines, threshold, 11)
    index, probe = defaultdict(set), defaultdict(set)
    for k, t, o in zip(key.tolist(), kind.tolist(), own.tolist(), strict=True):
        probe[o].add(k)
        if not t:
            index[k].add(o)
    bags = linededup.bags(lines)
    near = 0
    for a in range(len(lines)):
        met = set().union(*(index[k] for k in probe[a]))
        for b in range(len(lines)):
            if a != b and len(lines[a]) >= len(lines[b]) and lines[a] != lines[b] and within(lines[a], lines[b], min(threshold, len(lines[b]) // 11)):
                near += 1
                assert b in met
                assert linededup.bag_distance(bags[[a]], bags[[b]])[0] <= 2 * threshold
    assert near > 50


def near_lines(a, b):
    return within(a, b, min(linededup.THRESHOLD, min(len(a), len(b)) // linededup.SHARE))


def expected_drops(docs):
    """docs: (id, text); the numbers of the lines that go, by id."""
    places = defaultdict(list)
    for i, text in docs:
        for n, x in enumerate((text or "").split("\n")):
            if x.strip(" \t\r\v\f"):
                places[x].append((i is None, i, n))
    label = linked(places, near_lines)
    first: dict = {}
    for x, p in places.items():
        first[label[x]] = min(*p, first[label[x]]) if label[x] in first else min(p)
    out = defaultdict(set)
    for x, p in places.items():
        for q in p:
            if q != first[label[x]] and q[1] is not None:
                out[q[1]].add(q[2])
    return out


def line_docs():
    rnd = random.Random(12)
    lines = edited_lines(rnd, 10, 40) + edited_lines(rnd, 4, 22) + ["short", "", "short too", "short to", " \t", "\u00a0"]
    return [(i, "\n".join(rnd.choices(lines, k=rnd.randint(1, 7)))) for i in range(30)] + [(31, None), (32, ""), (33, "\n\n"), (34, lines[0] + "\n" + lines[0])]


def test_lines(make):
    docs = line_docs()
    frame = make(docs)
    drops = expected_drops(docs)
    report = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in linededup.line_report(frame).collect()}
    assert report == {i: (len((t or "").split("\n")), len(drops[i]), ",".join(map(str, sorted(drops[i])))) for i, t in docs}
    texts = {r.doc_id: r.text for r in linededup.dedup_lines(frame).collect()}
    assert texts == {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drops[i]) for i, t in docs}


@pytest.mark.parametrize("batch", [1, 7, 1000])
@pytest.mark.parametrize("paired", [1, 4, 64])
def test_keys_give_pairs_or_lines(paired, batch):
    """Every pair that shares a key comes as such, or both of its lines come under a key, however the rows are cut."""
    rnd = random.Random(paired)
    base = prose(rnd, 14)[:60].ljust(60, "z")
    lines = list(dict.fromkeys([f"{base[:50]}{a}{b}{base[52:]}" for a in "abcd" for b in "wxyz"] + edited_lines(rnd, 6, 40)))
    key, kind, own = linededup.probes(lines)
    bag = linededup.bags(lines)[own]
    rows = sorted(zip(key.view(np.int64).tolist(), own.tolist(), kind.tolist(), bag.view(np.int64).tolist(), strict=True))
    batches = [pa.record_batch({c: pa.array([r[i] for r in rows[at : at + batch]], t) for i, (c, t) in enumerate((("key", pa.int64()), ("line", pa.int64()), ("kind", pa.int8()), ("bag", pa.int64())))}) for at in range(0, len(rows), batch)]
    by_key, links, shared = defaultdict(dict), set(), defaultdict(dict)
    for k, o, t, _ in rows:
        by_key[k].setdefault(o, t)
    for b in linededup._met(2, paired)(iter(batches)):
        for u, v, t in zip(*(b[c].to_pylist() for c in ("u", "v", "kind")), strict=True):
            links.add((u, v)) if t < 0 else shared[v].update({u: min(t, shared[v].get(u, 1))})
    assert {k for k in by_key if len(by_key[k]) > paired} == set(shared)
    assert all(shared[k] == by_key[k] for k in shared)
    for u in range(len(lines)):
        for v in range(u):
            if near_lines(lines[u], lines[v]):
                assert (v, u) in links or any(u in s and v in s for s in shared.values())


def test_tiles_hold_every_two_rows(spark):
    rows = [("hot", i) for i in range(700)] + [("warm", i) for i in range(90)] + [("cold", 1), ("cold", 2)]
    frame = spark.createDataFrame(rows, "key string, node long").repartition(3)
    found = common.tiled(frame, "key", "node", most=100, least=16, alone=80).collect()
    tasks = defaultdict(list)
    for r in found:
        tasks[r.key, r.task].append((r.node, r.part))
    for key, n in (("hot", 700), ("warm", 90), ("cold", 2)):
        met = set()
        for (k, _), members in tasks.items():
            if k == key:
                two = {p for _, p in members} == {0, 1}
                met |= {(a, b) for a, p in members for b, q in members if a < b and (p != q or not two)}
        nodes = [i for k, i in rows if k == key]
        assert met == {(a, b) for a in nodes for b in nodes if a < b}
    assert max(map(len, tasks.values())) < 100 and len({t for k, t in tasks if k == "cold"}) == 1


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_groups_are_whole(limit):
    rnd = random.Random(limit)
    rows = sorted((rnd.randint(0, 9), rnd.randint(0, 2)) for _ in range(120))
    batches = [pa.record_batch({"a": pa.array([r[0] for r in rows[i : i + 4]]), "b": pa.array([r[1] for r in rows[i : i + 4]])}) for i in range(0, 120, 4)]
    tables = list(common.groups(iter(batches), "a", "b", limit=limit))
    found = [list(zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)) for t in tables]
    assert [r for t in found for r in t] == rows
    assert all(x[-1] != y[0] for x, y in zip(found, found[1:], strict=False))


def test_long_lines_meet_their_like(monkeypatch):
    rnd = random.Random(77)
    lines = edited_lines(rnd, 10, 60)
    plain = [x.tolist() for x in linededup.probes(lines)]
    bags = linededup.bags(lines).tolist()
    monkeypatch.setattr(linededup, "LONG", 64)
    assert sorted(zip(*(x.tolist() for x in linededup.probes(lines)), strict=True)) == sorted(zip(*plain, strict=True))
    assert linededup.bags(lines).tolist() == bags


def test_lines_by_tiles(make, monkeypatch):
    docs = line_docs()
    frame = make(docs)
    expected = sorted(map(tuple, linededup.line_report(frame).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, linededup.line_report(frame, paired=1, tile=2, most=4).collect())) == expected


def test_lines_of_odd_rows(odd, none):
    out = linededup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    drops = expected_drops([r[:2] for r in odd_rows()])
    found = {r.doc_id: set(map(int, r.dropped.split(","))) for r in linededup.line_report(odd).collect() if r.dropped}
    assert found == {i: d for i, d in drops.items() if d}
    assert linededup.dedup_lines(none).count() == 0 and linededup.line_report(none).count() == 0


def test_bag_counts_wrap():
    a, b = linededup.bags(["a" * 17 + "b", "a" * 15 + "b"])
    assert linededup.bag_distance(np.array([a]), np.array([b]))[0] == 2


def test_rows_of_one_id_lose_their_own_lines(make):
    rnd = random.Random(40)
    a, b, c, d = (prose(rnd, 20).ljust(60, x) for x in "abcd")
    docs = [(1, a), (2, f"{a}\n{b}"), (2, f"{c}\n{a}"), (3, f"{d}\nx"), (3, f"{d}\ny")]
    frame = make(docs)
    texts = [(r.doc_id, r.text) for r in linededup.dedup_lines(frame).collect()]
    assert sorted(texts)[:3] == sorted([(1, a), (2, b), (2, c)])
    assert sorted(len(t) for i, t in texts if i == 3) == [1, len(d) + 2]
    assert sorted((r.doc_id, r.dropped) for r in linededup.line_report(frame).collect()) == [(1, ""), (2, "0"), (2, "1"), (3, ""), (3, "0")]
