"""Byte-level BPE by corpus-level merge replay.

All words of a block of texts that are not known yet are encoded at once. An
inverted index leads from each rank to the positions, over all words, of the
adjacent pairs whose joined bytes have that rank. Ranks are replayed in order;
a merge touches only its two neighbours, whose new pairs enter the index.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import pieces
from grovekit.llm.pretokens import Memory, matcher, split_chunk

#: Words that a worker keeps, the longest that it does, and the pairs of tokens whose rank it knows.
WORDS, LONG_WORD, PAIRS = 200_000, 100, 500_000
#: Bytes of text whose new words are replayed together; what the replay holds is some hundred times that.
BLOCK_BYTES = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.piece = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.piece[rank] = piece
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}

        width = np.full((256, 256), -1, np.int32)
        for piece, rank in ranks.items():
            if len(piece) == 2:
                width[piece[0], piece[1]] = rank
        self.first = width

    def pair(self, a: int, b: int) -> int:
        """Rank of two tokens joined; -1 if they can't be."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self.ranks.get(self.piece[a] + self.piece[b], -1)
        return found

    def encode(self, words: list[bytes]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_raw(words)]

    def encode_raw(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word, as greedy merging by lowest rank, leftmost first, gives them.

        Each word's are little-endian unsigned 32-bit integers.
        """
        flat = np.frombuffer(b"".join(words), np.uint8)
        n, starts = len(flat), np.cumsum([0, *map(len, words)])
        if not n:
            return [b"" for _ in words]
        tok = np.array(self.byte, np.int64)[flat].tolist()
        now = np.full(n, -1, np.int64)  # rank of the pair that begins at each position
        now[:-1] = self.first[flat[:-1], flat[1:]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        edge = starts[1:][starts[1:] > starts[:-1]] - 1
        after[edge] = now[edge] = -1
        before[starts[:-1][starts[1:] > starts[:-1]]] = -1
        order = np.argsort(now, kind="stable")
        order = order[np.searchsorted(now[order], 0) :]
        ranks, cut = np.unique(now[order], return_index=True)
        flat_order, cut = order.tolist(), [*cut.tolist(), len(order)]
        index = {r: flat_order[x:y] for r, x, y in zip(ranks.tolist(), cut, cut[1:], strict=False)}
        heap = list(index)  # sorted, and so a heap
        now, after, before, starts = now.tolist(), after.tolist(), before.tolist(), starts.tolist()
        known, pair = self.pairs.get, self.pair
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            at = index.pop(rank)
            at.sort()
            waiting: set[int] = set()  # words that got a pair of a lower rank meanwhile
            for i in at:
                if now[i] != rank:
                    continue
                if waiting and bisect_right(starts, i) in waiting:
                    if rank not in index:
                        index[rank] = []
                        push(heap, rank)
                    index[rank].append(i)
                    continue
                j = after[i]
                tok[i], tok[j], now[j] = rank, -1, -1
                k = after[i] = after[j]
                r = -1
                if k >= 0:
                    before[k] = i
                    r = known(rank << 32 | tok[k])
                    if r is None:
                        r = pair(rank, tok[k])
                    if r >= 0:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            push(heap, r)
                        if r < rank:
                            waiting.add(bisect_right(starts, i))
                now[i] = r
                p = before[i]
                if p >= 0:
                    r = known(tok[p] << 32 | rank)
                    if r is None:
                        r = pair(tok[p], rank)
                    now[p] = r
                    if r >= 0:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            push(heap, r)
                        if r < rank:
                            waiting.add(bisect_right(starts, i))
        whole = np.array(tok)
        left = whole >= 0
        ids, cut = whole[left].astype("<u4").tobytes(), (4 * np.r_[0, np.cumsum(left)][starts]).tolist()
        return [ids[x:y] for x, y in zip(cut, cut[1:], strict=False)]


class Codec:
    """Encodes texts to the ids of a rank file, each match of a pattern separately, and decodes them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.replay, self.split = MergeReplay(ranks), matcher(pattern)
        self.memory, self.words = Memory(self._chunks), {}

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian unsigned 32-bit integers."""
        words = [split_chunk(c, self.split) for c in chunks]
        if len(self.words) > WORDS:
            self.words.clear()
        known = self.words
        new = list({w: None for ws in words for w in ws if w not in known})
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        known.update(zip(new, self.replay.encode_raw(raw), strict=True))
        out = [known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for ws in words]
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        return [b"".join(v) for v in self.memory.values(texts)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.piece.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, which keeps what it has encoded."""
    return Codec(read_ranks(path), pattern)


def _encoder(path: str, pattern: str, finish: Callable[[Codec, list[bytes]], dict]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in pieces(batches, "text", BLOCK_BYTES):
            ids = own.encode(t or "" for t in b["text"].to_pylist())
            yield pa.record_batch({"doc_id": b["doc_id"], **finish(own, ids)})

    return run


def _real(own: Codec, ids: list[bytes]) -> dict:
    lists = pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()),
        pa.array(np.frombuffer(b"".join(ids), "<u4").astype("i4")),
    )
    return {"ids": lists, "decoded": pa.array([own.decode(x) for x in ids], pa.binary())}


def _digests(own: Codec, ids: list[bytes]) -> dict:
    return {
        "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
    }


def encode_documents(docs: DataFrame, path: str, pattern: str, *, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text encoded and decoded again: doc_id, ids array<int>, decoded binary.

    With ``digests``: doc_id, n_tokens, ids_sha256, decoded_sha256. A null text
    is an empty one and has no tokens. The rows are neither moved nor merged;
    other columns are ignored. Special tokens' strings are ordinary text.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    if digests:
        return source.mapInArrow(_encoder(path, pattern, _digests), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return source.mapInArrow(_encoder(path, pattern, _real), f"doc_id {kind}, ids array<int>, decoded binary")
