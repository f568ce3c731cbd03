"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each node has a failure link and the count
of pieces that are complete once matching falls back along it (Song et al.,
"Fast WordPiece Tokenization", 2021, with counts in place of the pieces). Each
byte moves forward once, so a word costs time linear in its length, and no
piece is ever built.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.bpe import read_ranks
from grovekit.llm.common import pieces
from grovekit.llm.pretokens import Memory, matcher, split_chunk


class Automaton:
    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        self.step: dict[int, int] = {}  # node << 8 | byte -> node
        ends = [False]
        for piece in vocabulary:
            at = 0
            for b in piece:
                nxt = self.step.get(at << 8 | b)
                if nxt is None:
                    nxt = self.step[at << 8 | b] = len(ends)
                    ends.append(False)
                at = nxt
            ends[at] = at > 0
        kids: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, node in self.step.items():
            kids[key >> 8].append((key & 255, node))
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for b, v in kids[u]:
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and (to := self.step.get(z << 8 | b)) is None:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = to, n
                todo.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match; a word that can't be covered is one unknown piece."""
        step, fail, popped, u, n = self.step.get, self.fail, self.popped, 0, 0
        for b in word:
            while (to := step(u << 8 | b)) is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
            u = to
        while u:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 1
        return n


class Counter:
    """Words and pieces of texts: a word is a match of the pattern, its leading blank included."""

    def __init__(self, vocabulary: Iterable[bytes], pattern: str) -> None:
        self.automaton, self.split = Automaton(vocabulary), matcher(pattern)
        self.memory = Memory(self._chunks)

    def _chunks(self, chunks: list[str]) -> list[tuple[int, int]]:
        count = self.automaton.count
        return [(len(ws), sum([count(w.encode("utf-8", "surrogatepass")) for w in ws])) for ws in (split_chunk(c, self.split) for c in chunks)]

    def counts(self, texts: Iterable[str]) -> list[tuple[int, int]]:
        return [tuple(map(sum, zip(*v, strict=True))) if v else (0, 0) for v in self.memory.values(texts)]


@functools.lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> Counter:
    return Counter(read_ranks(path), pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's whole text counted: doc_id, n_words, n_tokens.

    The pieces are those of a rank file, used as a longest-match vocabulary: a
    piece with a leading blank begins a word, any other continues one. A null
    text is an empty one and has none. Rows are neither moved nor merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for b in pieces(batches, "text", 1_000_000):
            found = own.counts(t or "" for t in b["text"].to_pylist())
            yield pa.record_batch({"doc_id": b["doc_id"], "n_words": pa.array([x[0] for x in found], pa.int64()), "n_tokens": pa.array([x[1] for x in found], pa.int64())})

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
