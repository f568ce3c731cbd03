"""Line deduplication by a segment-partition edit join.

Equal lines of any length are one class. Beyond that, lines are near within one
edit for every ``SHARE`` code points of the shorter one, up to a threshold. A
line is split into its threshold plus one segments, of which one at least stands
unchanged, and little moved, in any line within the threshold. Lines enter an
index by their segments; each line probes it with the substrings that can match
a segment of a line of its own length or a shorter one (the length-aware,
multi-match-aware selection of Li et al., "Pass-Join", 2011). Pairs that meet
and have near counts of characters are verified by banded bit-parallel edit
distance. Lines that are linked, directly or along others, are one class; the
first line of a class stays. Blank lines part paragraphs and always stay.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import LEAST_TILE, MOST_TILE, groups, lookup, partitions, pieces, tiled
from grovekit.llm.editdistance import within
from grovekit.operators.components import connected_components
from grovekit.storage import materialize

#: Edits at most, and code points of the shorter line that each of them takes.
THRESHOLD, SHARE = 2, 20
#: What a line has only of is blank.
BLANK = " \t\r\x0b\x0c"
#: Keys of more lines than this are compared in tiles, and give links, not pairs.
PAIRED = 64
#: Longer lines are hashed segment by segment, which holds no array of numbers for each of their points.
LONG = 1 << 20
#: Lines that a task remembers so as not to deal them twice.
REMEMBERED = 50_000
#: Candidate lines up to so many (8 MB of ids) are broadcast to fetch their texts.
BROADCAST_IDS = 1_000_000
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
_U = np.uint64


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def line_id(line: str) -> tuple[int, int]:
    """128 bits of a line's content as two signed halves."""
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    lo, hi = h & ((1 << 64) - 1), h >> 64
    return lo - (lo >> 63 << 64), hi - (hi >> 63 << 64)


def is_blank(line: str) -> bool:
    return not line.strip(BLANK)


def allowed(length: int, threshold: int = THRESHOLD, share: int = SHARE) -> int:
    """Edits that make a near line of one with ``length`` code points."""
    return min(threshold, length // share)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(ODD)
    return x ^ (x >> _U(29))


def _moves(threshold: int, drop: int, j: int) -> range:
    """By how much later segment j of a line that is ``drop`` shorter can stand in a probing line."""
    return range(max(-j, drop - (threshold - j)), min(j, drop + threshold - j) + 1)


def _segment(length, j: int, k: int):
    """Start and length of segment j of k; the last ones have the rest."""
    base, longer = length // k, length % k
    return j * base + np.maximum(0, j - (k - longer)), base + (j >= k - longer)


def _points(text: str) -> np.ndarray:
    return _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(_U) + _U(1))


def probes(lines: list[str], threshold: int = THRESHOLD, share: int = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, kind, line number): kind 0 is an index entry, which also probes; 1 only probes.

    ``drop`` is by how much the indexed line is shorter than the probing one, j
    the segment, and o by how much later it stands in the probing line. The
    indexed line's length sets the edits, and so the segments.
    """
    keys, kinds, owners = [], [], []

    def add(key: np.ndarray, own: np.ndarray, j: int, kind: int, number: np.ndarray) -> None:
        keys.append(_mix(key ^ _mix((own * 64 + j).astype(_U) * _U(ODD))))
        kinds.append(np.full(len(key), kind, np.int8))
        owners.append(number)

    long_ones = [i for i, x in enumerate(lines) if len(x) > LONG]
    number = np.array([i for i, x in enumerate(lines) if len(x) <= LONG], np.int64)
    size = np.array([len(lines[i]) for i in number.tolist()], np.int64)
    start = np.cumsum(size) - size
    points = _points("".join(lines[i] for i in number.tolist()))
    n = len(points)
    summed = np.zeros(n + 1, _U)
    np.cumsum(points * _powers(ODD, n) if n else points, dtype=_U, out=summed[1:])
    back = _powers(INVERSE, n + 1)
    for drop in range(threshold + 1):
        own = size - drop
        edits = np.minimum(threshold, own // share)
        for t in range(max(drop, 1), threshold + 1):
            at = np.flatnonzero(edits == t)
            for j in range(t + 1):
                first, length = _segment(own[at], j, t + 1)
                for o in _moves(t, drop, j):
                    ok = (first + o >= 0) & (first + o + length <= size[at])
                    a, m = start[at][ok] + (first + o)[ok], length[ok]
                    add((summed[a + m] - summed[a]) * back[a], own[at][ok], j, int(drop > 0 or o != 0), number[at][ok])
    for i in long_ones:
        for drop in range(threshold + 1):
            own = len(lines[i]) - drop
            t = allowed(own, threshold, share)
            for j in range(t + 1 if t >= max(drop, 1) else 0):
                first, length = (int(x) for x in _segment(own, j, t + 1))
                for o in _moves(t, drop, j):
                    if first + o >= 0 and first + o + length <= len(lines[i]):
                        key = _U(0)
                        for cut in range(0, length, LONG):
                            part = _points(lines[i][first + o + cut : first + o + min(cut + LONG, length)])
                            key += (part * _powers(ODD, len(part))).sum(dtype=_U) * _U(pow(ODD, cut, 1 << 64))
                        add(np.array([key], _U), np.array([own]), j, int(drop > 0 or o != 0), np.array([i]))
    none = [np.empty(0, _U)], [np.empty(0, np.int8)], [np.empty(0, np.int64)]
    return tuple(np.concatenate(have or empty) for have, empty in zip((keys, kinds, owners), none, strict=True))


def bags(lines: list[str]) -> np.ndarray:
    """16 counts of characters by a hash of them, modulo 16, in 64 bits."""
    out = np.zeros((len(lines), 16), np.int64)
    at = 0
    while at < len(lines):
        end, held = at + 1, len(lines[at])
        while end < len(lines) and held + len(lines[end]) <= LONG:
            held += len(lines[end])
            end += 1
        owner = np.repeat(np.arange(end - at), [len(x) for x in lines[at:end]])
        flat = "".join(lines[at:end])
        for cut in range(0, len(flat), LONG):
            points = np.frombuffer(flat[cut : cut + LONG].encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
            bucket = (points * _U(ODD) >> _U(60)).astype(np.int64)
            out[at:end] += np.bincount(owner[cut : cut + LONG] * 16 + bucket, minlength=16 * (end - at)).reshape(-1, 16)
        at = end
    return ((out & 15).astype(_U) << (_U(4) * np.arange(16, dtype=_U))).sum(axis=1, dtype=_U)


def bag_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the difference of the counts: an edit changes it by two at most."""
    out = np.zeros(len(a), np.uint8)
    for i in range(16):
        d = ((a >> _U(4 * i)) - (b >> _U(4 * i)) & _U(15)).astype(np.uint8)
        out += np.minimum(d, 16 - d)
    return out


def _dealt(threshold: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in pieces(batches, "text", 500_000):
            found = dict.fromkeys(x for t in b["text"].to_pylist() for x in lines_of(t) if allowed(len(x), threshold, share) and not is_blank(x))
            ids = {x: i for x in found if (i := line_id(x)[0]) not in seen}
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(ids.values())
            if ids:
                lines = list(ids)
                key, kind, own = probes(lines, threshold, share)
                line = np.array(list(ids.values()), np.int64)
                yield pa.record_batch({"key": pa.array(key.view(np.int64)), "kind": pa.array(kind), "line": pa.array(line[own]), "bag": pa.array(bags(lines)[own].view(np.int64))})

    return run


def _met(threshold: int, paired: int = PAIRED):
    """Different lines that share a key, one of them as an index entry, from rows sorted by key.

    As pairs with near bags (kind -1), where the key has few lines; else each
    line as (line, key, kind), maybe more than once, to be compared in tiles. A key's
    rows pass through, however many they are; a chunk of them at most is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u: np.ndarray, v: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"u": pa.array(u), "v": pa.array(v), "kind": pa.array(kind.astype(np.int8))})

        def cut(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            """What is done of the sorted rows; leaves those of the last key in ``columns``, unless they are known to be many."""
            nonlocal many
            order = np.lexsort((columns[1], columns[2], columns[0]))
            key, kind, line, bag = (x[order] for x in columns)
            new = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])]
            key, kind, line, bag = key[new], kind[new], line[new], bag[new]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            known = many if many is not None and int(key[0]) == many else None
            large = size > paired
            large[0] |= known is not None
            end = len(key) if last or large[-1] else int(first[-1])
            many = int(key[-1]) if large[-1] and not last else None
            whole = np.repeat(large, size)
            if whole[:end].any():
                at = np.flatnonzero(whole[:end])
                yield out(line[at], key[at], kind[at])
            at, step = np.flatnonzero(~whole[:end]), 0
            while len(at):
                step += 1
                at = at[at + step < end]
                at = at[key[at] == key[at + step]]
                to = at + step
                hit = (kind[at] == 0) | (kind[to] == 0)
                i, j = at[hit], to[hit]
                near = bag_distance(bag[i], bag[j]) <= 2 * threshold
                i, j = line[i[near]], line[j[near]]
                if len(i):
                    pair = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
                    yield out(pair[0], pair[1], np.full(pair.shape[1], -1))
            columns[:] = [key[end:], kind[end:], line[end:], bag[end:]]

        many: int | None = None
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, _U)]
        for b in batches:
            if b.num_rows:
                got = (b["key"].to_numpy(), b["kind"].to_numpy(), b["line"].to_numpy(), b["bag"].to_numpy().view(_U))
                held = [np.concatenate(x) for x in zip(held, got, strict=True)]
                if len(held[0]) > 1 << 16:
                    yield from cut(held, False)
        if len(held[0]):
            yield from cut(held, True)

    return run


def tile_links(lines: list[int], texts: list[str], kinds: list[int], parts: list[int], threshold: int = THRESHOLD, share: int = SHARE) -> list[tuple[int, int]]:
    """Links that join all near lines of a task, no more of them than lines; with two parts, of lines of different ones.

    Lines that only probe the key (kind 1) are not compared with one another.
    """
    bag, kind, part = bags(texts), np.array(kinds), np.array(parts)
    two = bool(part.any())
    up = list(range(len(lines)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i in range(len(lines)):
        j = np.arange(i + 1, len(lines))
        j = j[(kind[j] & kind[i]) == 0]
        if two:
            j = j[part[j] != part[i]]
        j = j[bag_distance(bag[j], np.broadcast_to(bag[i], len(j))) <= 2 * threshold]
        for k in j.tolist():
            x, y = root(i), root(k)
            if x != y and near(texts[i], texts[k], threshold, share):
                up[max(x, y)] = min(x, y)
                out.append((lines[i], lines[k]))
    return out


def near(a: str, b: str, threshold: int = THRESHOLD, share: int = SHARE) -> bool:
    return within(a, b, allowed(min(len(a), len(b)), threshold, share))


def _tiled(threshold: int, share: int):
    """Rows sorted by key and task: each task's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in pieces(batches, "content"):
                yield from zip(*(b[c].to_pylist() for c in ("v", "task", "node", "content", "kind", "part")), strict=True)

        for _, group in itertools.groupby(rows(), key=lambda r: r[:2]):
            lines, texts, kinds, parts = map(list, zip(*(r[2:] for r in group), strict=True))
            if found := tile_links(lines, texts, kinds, parts, threshold, share):
                u, v = zip(*found, strict=True)
                yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _texts(threshold: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = {x: line_id(x) for t in b["text"].to_pylist() for x in lines_of(t) if allowed(len(x), threshold, share) and not is_blank(x)}
            if found:
                line, rest = zip(*found.values(), strict=True)
                yield pa.record_batch({"line": pa.array(line, pa.int64()), "rest": pa.array(rest, pa.int64()), "content": pa.array(found, pa.string())})

    return run


def _verified(threshold: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [near(x, y, threshold, share) for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True)]
            out = b.select(["u", "v"]).filter(pa.array(found, pa.bool_()))
            if out.num_rows:
                yield out

    return run


def near_classes(docs: DataFrame, threshold: int = THRESHOLD, share: int = SHARE, paired: int = PAIRED, tile: int = LEAST_TILE, most: int = MOST_TILE) -> DataFrame:
    """(line, rest, c) for the lines of ``docs`` (a text column) that are near others: equal c for those of one class.

    Lines meet by 64 bits of their content, and are told apart by 128 and by the content itself.
    """
    dealt = docs.mapInArrow(_dealt(threshold, share), "key long, kind byte, line long, bag long")
    ordered = dealt.repartition(partitions(docs, 2), "key").sortWithinPartitions("key")
    met = materialize(ordered.mapInArrow(_met(threshold, paired), "u long, v long, kind byte").distinct(), "line-pairs")
    pairs, shared = met.where("kind < 0").select("u", "v"), met.where("kind >= 0").groupBy("u", "v").agg(F.min("kind").alias("kind"))
    ids = pairs.select(F.explode(F.array("u", "v")).alias("line")).unionByName(shared.select(F.col("u").alias("line")))
    wanted = materialize(ids.distinct(), "line-ids")
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    found = docs.mapInArrow(_texts(threshold, share), "line long, rest long, content string").join(small, "line", "left_semi")
    texts = found.groupBy("line", "rest").agg(F.min("content").alias("content")).withColumn("node", F.monotonically_increasing_id())
    texts = materialize(texts, "line-texts")  # once written, a node's number is fixed
    named = lambda end, node, content: texts.select(F.col("line").alias(end), F.col("node").alias(node), F.col("content").alias(content))
    both = pairs.join(named("u", "i", "x"), "u").join(named("v", "j", "y"), "v").select(F.col("i").alias("u"), F.col("j").alias("v"), "x", "y")
    verified = both.mapInArrow(_verified(threshold, share), "u long, v long")
    tasks = tiled(shared, "v", "u", most=most, least=tile, alone=0).join(named("u", "node", "content"), "u")
    tasks = tasks.repartition(partitions(docs), "v", "task").sortWithinPartitions("v", "task", "part", "node")
    linked = materialize(tasks.select("v", "task", "node", "content", "kind", "part").mapInArrow(_tiled(threshold, share), "u long, v long"), "tile-links")
    label = connected_components(verified.unionByName(linked)).select(F.col("v").alias("node"), "c")
    return texts.select("line", "rest", "node").join(label, "node").select("line", "rest", "c")


def _copy(text_col: str) -> Column:
    """Tells rows of equal id but different texts apart."""
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def _places():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows = [(i, c, n, *line_id(x)) for i, c, t in zip(b["doc_id"].to_pylist(), b["copy"].to_pylist(), b["text"].to_pylist(), strict=True) for n, x in enumerate(lines_of(t)) if not is_blank(x)]
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.record_batch({k: pa.array(c, kind) for (k, kind), c in zip((("doc_id", pa.int64()), ("copy", pa.int64()), ("line_no", pa.int32()), ("line", pa.int64()), ("rest", pa.int64())), cols, strict=True)})

    return run


def line_classes(docs: DataFrame, *, threshold: int = THRESHOLD, share: int = SHARE, paired: int = PAIRED, tile: int = LEAST_TILE, most: int = MOST_TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line that isn't blank: doc_id, copy, line_no (from 0), class_lines, first_doc, first_copy, first_line.

    Lines end at \\n. A class is the lines that are equal or linked; its first
    line is that of the smallest id, then number. Documents with equal ids and
    texts count as one; ``copy``, a hash of the text, tells those with equal ids
    and different texts apart. Documents without id come last.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _copy(text_col).alias("copy"), F.col(f"`{text_col}`").cast("string").alias("text"))
    places = materialize(source.mapInArrow(_places(), "doc_id long, copy long, line_no int, line long, rest long"), "line-places")
    label = near_classes(source.select("text"), threshold, share, paired, tile, most)
    lines = places.groupBy("line", "rest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "copy")).alias("first"))
    lines = materialize(lines.join(label, ["line", "rest"], "left"), "line-groups")
    linked = lines.where("c is not null")
    classes = linked.groupBy("c").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("class_lines"), F.min("first").alias("of_class"))
    linked = lookup(linked, materialize(classes, "line-classes"), "c", "lines").select("line", "rest", "n", "class_lines", F.col("of_class").alias("first"))
    alone = lines.where("c is null").select("line", "rest", "n", F.col("n").alias("class_lines"), "first")
    table = linked.unionByName(alone).select(
        F.struct("line", "rest").alias("key"), "n", "class_lines", F.col("first.doc_id").alias("first_doc"), F.col("first.copy").alias("first_copy"), F.col("first.line_no").alias("first_line")
    )
    found = lookup(places.select(F.struct("line", "rest").alias("key"), "doc_id", "copy", "line_no"), materialize(table, "line-table"), "key", "n")
    return found.select("doc_id", "copy", "line_no", "class_lines", "first_doc", "first_copy", "first_line")


def dropped_lines(docs: DataFrame, **options) -> DataFrame:
    """For each id and text with lines that aren't the first of their class: doc_id, copy, dropped array<int>, in order."""
    lines = line_classes(docs, **options)
    first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("copy") == F.col("first_copy")) & (F.col("line_no") == F.col("first_line"))
    gone = lines.where(~first).groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))
    return gone.where("doc_id is not null")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its texts freed of lines that are not the first of their class; all columns and rows stay.

    A null text stays null. A document all of whose lines go has an empty text.
    Documents without id lose no lines.
    """
    gone = materialize(dropped_lines(docs, id_col=id_col, text_col=text_col, **options), "dropped").select(F.col("doc_id").alias("__gone_id"), F.col("copy").alias("__gone_copy"), F.col("dropped").alias("__gone"))
    own = F.col(f"`{id_col}`")
    named = docs.where(own.isNotNull())  # null ids would all meet in one task
    joined = named.join(gone, (named[f"`{id_col}`"] == gone["__gone_id"]) & (_copy(text_col) == gone["__gone_copy"]), "left")
    text = F.col(f"`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    freed = joined.withColumn(text_col, F.when(F.col("__gone").isNull(), text).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return freed.unionByName(docs.where(own.isNull()))


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row: doc_id, n_lines, n_dropped, dropped (numbers of the lines that go, joined by commas)."""
    gone = dropped_lines(docs, id_col=id_col, text_col=text_col, **options)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _copy(text_col).alias("copy"), (breaks + 1).cast("long").alias("n_lines"))
    joined = rows.where("doc_id is not null").join(gone, ["doc_id", "copy"], "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    return joined.select(
        "doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(F.transform("dropped", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped")
    )
