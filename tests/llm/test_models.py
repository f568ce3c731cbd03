"""Quality, mixing and HTML extraction."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from grovekit.llm import html_text, mixing, quality

from .conftest import odd_rows, prose

LABELS = "doc_id long, quality int, toxic int, text string"


def labelled(n):
    rnd = random.Random(21)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        words = prose(rnd, rnd.randint(20, 120)).split()
        if not good:
            words = [w.upper() + "!!" for w in words] if rnd.random() < 0.5 else [w for w in words[:8] for _ in range(9)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), 0, None))
    return docs, labels


def test_held_out_quality(spark, make):
    docs, labels = labelled(300)
    frame = spark.createDataFrame([*labels, (3, None, 0, None), (None, 1, 0, None), (7000, 1, 0, None)], LABELS)
    found = quality.score_documents(make(docs), frame).collect()
    truth = {i: q for i, q, _, _ in labels}
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    flags = {r.doc_id for r in make(docs).where(quality.held_out(F.col("doc_id"))).collect()}
    assert flags == held
    assert np.mean([r.predicted == truth[r.doc_id] for r in found if r.doc_id in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    kept = quality.keep_good(make(docs), frame)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.predicted}


def test_held_out_labels_do_not_matter(spark, make):
    docs, labels = labelled(200)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t, x) for i, q, t, x in labels]
    a, b = (sorted(map(tuple, quality.score_documents(make(docs), spark.createDataFrame(x, LABELS)).collect())) for x in (labels, turned))
    assert a == b


def test_quality_of_odd_rows(spark, odd, none):
    few = spark.createDataFrame([(0, 1, 0, None), (3, 0, 0, None), (6, 0, 1, None), (30, 1, 0, None), (30, 0, 0, None), (33, 1, 0, None)], LABELS)
    found = quality.score_documents(odd, few)
    assert found.count() == len(odd_rows()) and found.where("score is null or score < 0 or score > 1").isEmpty()
    assert {r.score for r in quality.score_documents(odd, few.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.score_documents(odd, few.where("doc_id = 0")).collect()} <= {0.5, 1.0}
    assert quality.keep_good(odd, few).columns == odd.columns
    assert quality.score_documents(none, few).count() == 0 and quality.keep_good(none, few).count() == 0


def test_equal_texts_score_alike(spark, make):
    docs, labels = labelled(120)
    docs += [(1000 + i, t) for i, t in docs[:40]]
    score = {r.doc_id: r.score for r in quality.score_documents(make(docs), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(score[1000 + i] == score[i] for i in range(40))


def brute_score(space, sample, counts):
    """The vote, neighbour by neighbour: by cosine to nine decimals, then by the order of ids."""
    def latent(c):
        x = np.zeros(len(space.column))
        for t, share in c.items():
            if t in space.column:
                x[space.column[t]] = np.sqrt(max(share, 0)) * 1.0
        x = x * space.idf
        n = np.sqrt(sum(np.sqrt(max(c.get(t, 0), 0)) ** 2 * space.idf[i] ** 2 for t, i in space.column.items()))
        y = (x / max(n, 1e-12)) @ space.projection
        return y / max(np.linalg.norm(y), 1e-12)

    own = latent(counts)
    order = sorted((-round(float(own @ latent(s)), 9), i) for i, s in enumerate(sample))[: quality.NEIGHBOURS]
    w = [max(-c, 0) ** quality.SHARPNESS for c, _ in order]
    return (sum(x * space.labels[i] for x, (_, i) in zip(w, order, strict=True)) + 1e-6 * space.prior) / (sum(w) + 1e-6)


def test_votes_against_brute_force():
    docs, labels = labelled(150)
    sample = [quality.terms(t) for _, t in docs] + [quality.terms(docs[0][1])] * 40  # 41 equal neighbours, with either label
    truth = np.array([q for _, q, _, _ in labels] + [i % 2 for i in range(40)])
    space = quality.Space(sample, truth)
    new = [quality.terms(t) for _, t in labelled(170)[0][150:]] + sample[:3] + [quality.terms(""), quality.terms(None)]
    found = space.score(new)
    assert np.allclose(found, [brute_score(space, sample, c) for c in new], rtol=0, atol=1e-6)
    assert all(space.score([c])[0] == x for c, x in zip(new, found, strict=True))
    tied = space.nearest(space.cosines([sample[0]]))[0]
    assert tied.tolist() == [0, *range(150, 150 + quality.NEIGHBOURS - 1)]


def test_ids_with_several_texts_teach_nothing(spark, make):
    docs, labels = labelled(120)
    frame = spark.createDataFrame(labels, LABELS)
    twice = next(i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1)
    rest = make([d for d in docs if d[0] != twice])
    a = {r.doc_id: r.score for r in quality.score_documents(rest, frame).collect()}
    b = {r.doc_id: r.score for r in quality.score_documents(make([*docs, (twice, "QUITE !! another")]), frame).collect()}
    assert all(b[i] == x for i, x in a.items())


def test_long_shapes_are_terms():
    dashes = quality.terms("-" * 40 + " " + "=" * 50)
    assert sum(len(t) == 9 and t.startswith(b"=") and not t.startswith(b"=length") for t in dashes) >= 3


def test_raking_meets_all_marginals():
    rnd = np.random.default_rng(1)
    cells = rnd.integers(50, 100, 4 * 3 * 2).astype(float)
    keys = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(3), 2), 4), np.tile(np.arange(2), 12)]
    budget = 0.4 * cells.sum()
    wanted = [np.array(s) * budget for s in ([0.2, 0.3, 0.25, 0.25], [0.3, 0.4, 0.3], [0.55, 0.45])]
    out = mixing.rake(cells, keys, wanted)
    assert (out <= cells + 1e-9).all()
    for k, w in zip(keys, wanted, strict=True):
        assert np.allclose(np.bincount(k, out), w, rtol=1e-6)


def test_raking_never_takes_more_than_there_is():
    cells, keys = np.array([10.0, 1000.0]), [np.array([0, 1])]
    out = mixing.rake(cells, keys, [np.array([300.0, 300.0])])
    assert out.tolist() == [10.0, 300.0]


def test_joined_raking_is_the_same(spark):
    rnd = random.Random(3)
    rows = [(s, g, t, rnd.randint(0, 90)) for s in ("a", "b", None) for g in ("en", "de") for t in ("0", "1")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    flatten = {"source": 0.6, "lang": 0.7, "topic": 0.5}
    a, b = ({tuple(r[:3]): r.probability for r in mixing.fit_cells(cells, 0.6, flatten, driver_cells=n, rounds=4).collect()} for n in (1000, 0))
    assert a.keys() == b.keys() == {r[:3] for r in rows}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def brute_vector(text):
    x = [0] * mixing.BUCKETS
    for w in (text or "").encode().lower().split():
        h = xxhash.xxh32_intdigest(w) % (2 * mixing.BUCKETS)
        x[h % mixing.BUCKETS] += 1 if h < mixing.BUCKETS else -1
    norm = sum(abs(v) for v in x) ** 0.5
    return [round((1 if v > 0 else -1) * abs(v) ** 0.5 * 1024 / norm) if v else 0 for v in x]


def brute_topics(docs):
    """docs: (lang, text); signs along the directions of the texts' differences from their languages' means."""
    x = np.array([brute_vector(t) for _, t in docs], float)
    group = [None if g is None else xxhash.xxh32_intdigest(g.encode()) % mixing.LANGUAGES for g, _ in docs]
    own = np.array([x[[i for i in range(len(docs)) if group[i] == g]].mean(axis=0) for g in group])
    values, vectors = np.linalg.eigh(np.cov((x - own).T, bias=True))
    out = []
    for row in x - own:
        signs = 0
        for k in range(mixing.DIRECTIONS):
            v = vectors[:, -1 - k]
            v = v * np.sign(v[np.argmax(np.abs(v))])
            signs += int(row @ v > 1e-6) << k
        out.append(signs)
    return out


def test_topics_come_from_what_texts_say(make):
    """Two subjects in each of two languages: the first direction parts the subjects, not the languages."""
    rnd = random.Random(15)
    words = {(g, s): [f"{g}{s}{i}" for i in range(30)] for g in ("en", "de") for s in "ab"}
    docs = []
    for i in range(400):
        g, s = rnd.choice(["en", "de"]), rnd.choice("ab")
        docs.append((i, " ".join([*rnd.choices(words[g, s], k=40), *[f"{g}x{k}" for k in range(20)]]), g, s, 0))
    frame = make([(d[0], d[1:]) for d in docs])
    found = {r.doc_id: int(r.topic) for r in mixing.mix_documents(frame).collect()}
    assert found == dict(zip((d[0] for d in docs), brute_topics([(d[2], d[1]) for d in docs]), strict=True))
    for g in ("en", "de"):
        seen = {}
        for i, _, lang, s, _ in docs:
            if lang == g:
                seen.setdefault(s, set()).add(found[i] & 3)
        assert not seen["a"] & seen["b"]


def test_targets_stay_within_what_there_is():
    have = np.array([10.0, 0.0, 500.0, 4000.0])
    for whole in (20.0, 1000.0, 4400.0):
        want = mixing.wanted(have, 0.5, whole)
        assert abs(want.sum() - whole) < 1e-6 and (want <= have).all() and want[1] == 0
        free = (want < have) & (have > 0)
        assert np.ptp(want[free] / have[free] ** 0.5) < 1e-6 if free.sum() > 1 else True


def plain_raking(cells, flatten, budget):
    """cells: {(source, lang, topic): tokens}; raked with dictionaries alone."""
    total = sum(cells.values())
    wants = []
    for d, power in enumerate(flatten.values()):
        have = {}
        for c, n in cells.items():
            have[c[d]] = have.get(c[d], 0) + n
        low, high = 0.0, max(have.values()) + 1.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(n, mid * n**power) for n in have.values() if n) < budget * total else (low, mid)
        wants.append({v: min(n, high * n**power) if n else 0.0 for v, n in have.items()})
    fitted = {c: n * budget for c, n in cells.items()}
    for _ in range(mixing.ROUNDS):
        for d, want in enumerate(wants):
            have = {}
            for c, n in fitted.items():
                have[c[d]] = have.get(c[d], 0) + n
            fitted = {c: min(cells[c], n * want[c[d]] / have[c[d]]) if have[c[d]] else 0.0 for c, n in fitted.items()}
    return {c: fitted[c] / n if n else 1.0 for c, n in cells.items()}


def test_probabilities_against_plain_raking(spark):
    rnd = random.Random(18)
    rows = [(i, prose(rnd, rnd.randint(0, 60)), rnd.choice(["en", "en", "de", None]), rnd.choice(["s0", "s0", "s0", "s1", None]), 0) for i in range(400)]
    found = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), budget=0.6).collect()
    cells = {}
    for r in found:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    expected = plain_raking(cells, mixing.FLATTEN, 0.6)
    assert all(abs(r.probability - expected[r.source, r.lang, r.topic]) < 1e-5 for r in found)
    assert all(r.met and abs(r.source_missing) < 1e-3 and abs(r.lang_missing) < 1e-3 and abs(r.topic_missing) < 1e-3 for r in found)


def test_what_cannot_be_met_is_told(spark):
    cells = spark.createDataFrame([("a", "en", "0", 1000), ("b", "de", "1", 10)], "source string, lang string, topic string, tokens long")
    for n in (1000, 0):
        found = {r.source: r for r in mixing.fit_cells(cells, 0.5, {"source": 0.1, "lang": 1.0, "topic": 1.0}, driver_cells=n, rounds=30).collect()}
        assert max(abs(found[s][f"{d}_missing"]) for s in "ab" for d in mixing.DIMENSIONS) > 0.1
        assert all(0 <= r.probability <= 1 for r in found.values())


def test_mixture_brute_force(odd, none):
    found = mixing.mix_documents(odd).collect()
    rows = odd_rows()
    assert len(found) == len(rows)
    topics, measure = brute_topics([(r[2], r[1]) for r in rows]), {}
    for r, t in zip(rows, topics, strict=True):
        measure.setdefault(r[0], []).append((r[3], r[2], str(t), len((r[1] or "").encode().split())))
    assert sorted(map(repr, ((r.doc_id, r.source, r.lang, r.topic, r.n_tokens) for r in found))) == sorted(repr((i, *m)) for i, ms in measure.items() for m in ms)
    assert all(0 <= r.probability <= 1 + 1e-9 and 0 <= r.draw < 1 and r.kept == (r.draw < r.probability) for r in found)
    kept = mixing.mixture(odd)
    assert kept.columns == odd.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in found if r.kept)
    assert mixing.mixture(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_draws_are_calibrated(spark):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, 20), "en" if i % 4 else "de", f"s{min(i % 7, 2)}", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    found = mixing.mix_documents(docs, budget=0.5).collect()
    for d in mixing.DIMENSIONS:
        expected, got = {}, {}
        for r in found:
            expected[r[d]] = expected.get(r[d], 0) + r.n_tokens * r.probability
            got[r[d]] = got.get(r[d], 0) + r.n_tokens * r.kept
        total = sum(expected.values())
        assert abs(total - 0.5 * 60000) < 60
        assert all(abs(got[k] - expected[k]) < 0.05 * total for k in expected)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{{}}</style><script>var a = "</p><article>x";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li>More</ul></nav><!-- c --><div class="cookie-notice">We use cookies</div>
<div class=ad>Buy {0}</div><article id=a{0} class="post"><header><h1>Title  {0}</h1></header><p><b>First &lt;b&gt;&nbsp;{0}<br>line<p>Second
   line {0}</p><ul><li>one {0}<li>two</ul><form><input value=x><button>Send</button></form><p class="fixed">Follow us everywhere</p>
<table><tr><td>a{0}<td>b</table><section id="comments"><p>Nice post!</p></section></article><aside>Elsewhere {0}</aside><footer>&copy; {0}</footer>"""


def blocks(i):
    return ["Title " + str(i), f"First <b> {i} line", f"Second line {i}", f"one {i}", "two"], ["Follow us everywhere"], [f"a{i}", "b"]


def test_extraction(spark):
    pages = [(i, f"https://host.example/{i}", PAGE.format(i), "x") for i in range(6)]
    pages += [(50, "http://once.example/", PAGE.format(50), "x"), (51, None, None, None), (52, None, "", "x"), (53, "bad url", "just <b>text</b> &amp; more", "x"), (None, "http://once.example/", "<main><p>a<p>b</main>", "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, host string").repartition(3)
    found = {(r.page_id, r.url): r.text for r in html_text.extract_pages(frame).collect()}
    assert len(found) == len(pages)
    for i in range(6):
        head, _, tail = blocks(i)
        assert found[i, f"https://host.example/{i}"] == "\n\n".join(["Title " + str(i), f"First <b> {i} line", f"Second line {i}", f"one {i}", "two", *tail]), head
    head, fixed, tail = blocks(50)
    assert found[50, "http://once.example/"] == "\n\n".join([*head, *fixed, *tail])
    assert found[51, None] == found[52, None] == ""
    assert found[53, "bad url"] == "just text & more"
    assert found[None, "http://once.example/"] == "a\n\nb"
    assert html_text.extract_pages(frame.limit(0)).count() == 0


def test_hot_hosts_get_the_same_wrapper(spark, monkeypatch):
    pages = [(i, f"https://host.example/{i}", PAGE.format(i)) for i in range(40)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    hot = {r.page_id: r.text for r in html_text.extract_pages(frame).collect()}
    monkeypatch.setattr(html_text, "HOT_KEYS", 1)
    assert hot == {r.page_id: r.text for r in html_text.extract_pages(frame).collect()}
    assert all("Follow us" not in t and "Second line" in t for t in hot.values())


def test_copies_are_no_template():
    assert html_text.induce([PAGE.format(1)] * 8) == []
    learnt = html_text.induce([PAGE.format(i) for i in range(5)])
    assert [t for _, t in learnt if "Follow" in t] == ["Follow us everywhere"]
    assert not any("Second" in t for _, t in learnt)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>a<div>b</div>c</article>", "a\n\nb\n\nc"),
        ("<p>x<script>if (a < b) {}</script>y</p>", "xy"),
        ("<body><p>a &amp;amp; b &#233; &unknown; &lt</p>", "a &amp; b é &unknown; <"),
        ("<article><p>open <b>bold<i>both</b> rest", "open boldboth rest"),
        ("<p title=\"a>b\" class='comments-off'>a</p><p hidden>b</p>", "a"),
        ("<div id=header>x</div><article><div class='post-header'><h1>a</h1></div>b</article>", "a\n\nb"),
        ("<body class='has-sidebar'><div class='has-comments'>a</div><div class='sidebar-2'>b</div>", "a"),
        ("<article><h1>a</h1><article class=comment>b</article></article>", "a"),
        ("a<!-- never closed <p>b", "a"),
        ("1 < 2 <p>x", "1 < 2\n\nx"),
        ("<main><p>m</p></main><p>outside</p>", "m"),
        ("", ""),
    ],
)
def test_markup(html, text):
    assert html_text.main_text(html, {}) == text


def test_long_and_deep_pages():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_text.main_text(f"<article>{deep}<p>{'word ' * 100_000}</article>", {}).startswith("x\n\nword word")
    assert html_text.induce([f"<article>{deep}{i}</article>" for i in range(5)]) == [("/article/div", "x")]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article style='overflow:hidden'><p>a</article>", "a"),
        ('<article><p>see <a href="/hidden-gems">gems</a> and <a href="/x?id=search">more</a></article>', "see gems and more"),
        ('<div data-id="menu" data-class=footer title="role=search"><p>a</div>', "a"),
        ("<p href=/a/hidden>a</p><p class=x HIDDEN>b</p><p aria-hidden = 'true'>c</p><div id = menu>d</div>", "a"),
    ],
)
def test_attributes_are_not_read_inside_values(html, text):
    assert html_text.main_text(html, {}) == text


def extracted(spark, pages):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in html_text.extract_pages(frame).collect()}


def test_siblings_are_template_singly(spark):
    plain = [(i, f"http://plain.example/{i}", f"<div>Start Contact</div><div>Story {i}</div><div>All rights kept</div>") for i in range(6)]
    closing = [(10 + i, f"http://closing.example/{i}", f"<article>{''.join(f'<p>Part {k} of {i}</p>' for k in range(i))}<p>Word {i}</p><p>Write to us</p></article>") for i in range(6)]
    found = extracted(spark, plain + closing)
    assert [found[i] for i in range(6)] == [f"Story {i}" for i in range(6)]
    assert [found[10 + i] for i in range(6)] == ["\n\n".join([*(f"Part {k} of {i}" for k in range(i)), f"Word {i}"]) for i in range(6)]


@pytest.mark.parametrize("depth", [38, 45, 3000])
def test_blocks_at_any_depth_are_template_or_content(spark, depth):
    """nothing tells the parts but what the pages have in common, below any depth."""
    page = "<div>" * depth + "<div>Start Contact</div><div>Story {0}<p>of {0}</p>end</div><div>All rights kept</div>" + "</div>" * depth
    found = extracted(spark, [(i, f"http://deep.example/{i}", page.format(i)) for i in range(6)])
    assert [found[i] for i in range(6)] == [f"Story {i}\n\nof {i}\n\nend" for i in range(6)]


def test_numbers_of_texts_are_those_of_flat():
    rnd, known = random.Random(4), {}
    for _ in range(200):
        html = "<body>" + "".join(rnd.choice(["a", "b", " ", "<div>", "</div>", "<p>", "<b>", "</b>", "<br>", "<nav>", "</nav>"]) for _ in range(rnd.randint(1, 25)))
        root = html_text.parse(html)
        texts = html_text.Texts(root)
        for s in html_text.slots(root):
            if not s.noise:
                number, text = texts.number(s.node), html_text.flat(s.node)
                assert known.setdefault(text, number) == number and (number == "") == (text == "")
    assert len(set(known.values())) == len(known)


def test_the_region_is_where_the_text_varies(spark):
    outside = [(i, f"http://outside.example/{i}", f"<article>Teaser {i}</article><div>{'Long story. ' * 5}{i}</div>") for i in range(6)]
    inside = [(10 + i, f"http://inside.example/{i}", f"<article>{'Long story. ' * 5}{i}</article><div>Seen {i} times</div>") for i in range(6)]
    found = extracted(spark, outside + inside)
    story = ("Long story. " * 5).strip()
    assert [found[i] for i in range(6)] == [f"Teaser {i}\n\n{story} {i}" for i in range(6)]
    assert [found[10 + i] for i in range(6)] == [f"{story} {i}" for i in range(6)]


@pytest.mark.parametrize("hot_keys", [1000, 1])
def test_templates_come_from_all_pages_of_a_host(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(html_text, "HOT_KEYS", hot_keys)
    page = "<article><p>Story {}</p><div>Write to us</div></article>"
    rows = [(None, None, page.format("copied"))] * 300 + [(None, None, page.format(i)) for i in range(6)]
    rows += [(i, None, f"<article><p>Other layout {i}</p></article>") for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = sorted((r.page_id is None, r.text) for r in html_text.extract_pages(frame).collect())
    assert found == sorted([(True, "Story copied")] * 300 + [(True, f"Story {i}") for i in range(6)] + [(False, f"Other layout {i}") for i in range(2)])


HIDDEN = """<html><body><div>{menu}</div><div>{advert}</div><div><h1>{title}</h1>{story}</div><div>{foot}</div></body></html>"""


def test_the_region_comes_from_the_alignment(spark):
    """No tag or class tells the parts: only the alignment can, as the menu, the advert and the foot vary too."""
    rnd, pages, expected = random.Random(5), [], {}
    for i in range(12):
        story = [prose(rnd, rnd.randint(30, 60)) for _ in range(rnd.randint(1, 9))]
        title = prose(rnd, 5)
        links = "".join(f"<a href=/{k}>{prose(rnd, 2)}</a> " for k in range(rnd.randint(4, 8)))
        pages.append((i, f"http://hidden.example/{i}", HIDDEN.format(menu=links, advert=prose(rnd, 8), title=title, story="".join(f"<p>{x}" for x in story), foot=f"From {prose(rnd, 6)}")))
        expected[i] = "\n\n".join([title, *story])
    assert extracted(spark, pages) == expected
    alone = extracted(spark, pages[:1])[0]
    assert expected[0] in alone and alone != expected[0]


def test_flat_pages_keep_headings_and_flowing_text(spark):
    rnd = random.Random(6)
    pages, expected = [], {}
    for i in range(8):
        title, first, last = prose(rnd, 4), prose(rnd, 40), prose(rnd, 3)
        pages.append((i, f"http://flat.example/{i}", f"<div>{prose(rnd, 4)}</div><h1>{title}</h1><p>{first}</p><p>{last}</p><div><a href=/>{prose(rnd, 30)}</a></div>"))
        expected[i] = "\n\n".join([title, first, last])
    assert extracted(spark, pages) == expected


def test_tree_matching_is_best():
    def tree(rnd, labels, size):
        out = html_text.Tree([rnd.choice(labels)], [[]])
        for _ in range(size):
            out.kids[rnd.randrange(len(out.kids))].append(len(out.labels))
            out.labels.append(rnd.choice(labels))
            out.kids.append([])
        return out

    def best(a, x, b, y):
        if a.labels[x] != b.labels[y]:
            return 0

        def lists(p, q):
            if not p or not q:
                return 0
            return max(lists(p[1:], q), lists(p, q[1:]), lists(p[1:], q[1:]) + best(a, p[0], b, q[0]))

        return 1 + lists(a.kids[x], b.kids[y])

    rnd = random.Random(9)
    for _ in range(200):
        a, b = (tree(rnd, "xy", rnd.randint(0, 9)) for _ in range(2))
        found = html_text.matched(a, b)
        assert len(found) == len(set(found.values())) == best(a, 0, b, 0)
        assert all(a.labels[i] == b.labels[j] for i, j in found.items())
        up = [{k: i for i in range(len(t.kids)) for k in t.kids[i]} for t in (a, b)]
        assert all(i == 0 or found[up[0][i]] == up[1][j] for i, j in found.items())
    for _ in range(50):
        named = html_text.Tree.of(html_text.slots(html_text.parse("<body>" + "<div><p>a</div><ul><li>x<li>y</ul>" * rnd.randint(1, 4))))
        again = html_text.Tree.load(named.dump())
        assert (again.labels, again.kids) == (named.labels, named.kids)


def test_children_beyond_the_bound_match_by_number(monkeypatch):
    monkeypatch.setattr(html_text, "MATCHED_PAIRS", 3)
    a, b = (html_text.Tree(["t", *labels], [[*range(1, len(labels) + 1)], *[[] for _ in labels]]) for labels in ("pqp", "ppq"))
    assert html_text.matched(a, b) == {0: 0, 1: 1, 2: 3, 3: 2}
