"""Document quality by nearest-neighbour voting in a latent-semantic space.

Terms describe how a text is written, in any language: the shapes of its words
(letters, capitals and digits as classes, runs of a class as one), pairs of
adjacent shapes, repeated words, and the text's length class. Their weighted
counts in the labelled sample are decomposed into latent dimensions; the
sample's vectors and the projection are broadcast (both bounded by parameters),
and every document gets exact cosine products with all of them, in blocks. The
labels of the nearest are weighted by similarity; of equally similar ones, those
of the smaller ids count. Blocks have one size and cosines nine decimals, so a
score depends on the text alone, not on the rows that are scored with it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import carried, pieces, restored

#: At most so many labelled rows are learnt from, chosen by a hash of the id.
SAMPLE_ROWS = 4096
#: The model: terms that most of the sample's texts have, latent dimensions, neighbours that vote, and the power of a cosine in a vote.
TERMS, DIMENSIONS, NEIGHBOURS, SHARPNESS = 1024, 64, 25, 8
#: Longer terms go by a digest. Texts that are scored together; decimals of a cosine.
TERM_BYTES, BLOCK, DECIMALS = 16, 128, 9

_CLASS = bytes(
    97 if chr(b).islower() and b < 128 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in b" \t\r\x0b\x0c" else b
    for b in range(256)
)
_FOLDED = np.isin(np.arange(256), list(b"aA0 "))


def _term(shape: bytes) -> bytes:
    return shape if len(shape) <= TERM_BYTES else b"=" + xxhash.xxh64_digest(shape)


def terms(text: str | None) -> Counter:
    """Each term's share of the text's words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    out = Counter({b"=length %d" % n.bit_length(): 1.0})
    if not n:
        return out
    flat = np.frombuffer(raw.translate(_CLASS), np.uint8)
    shape = flat[np.r_[True, (flat[1:] != flat[:-1]) | ~_FOLDED[flat[1:]]]].tobytes()
    shapes = shape.replace(b"\n", b" \n ").split(b" ")
    for term, count in Counter(shapes).items():
        out[_term(term)] += count / n
    for (a, b), count in Counter(zip(shapes, shapes[1:], strict=False)).items():
        out[_term(a + b" " + b)] += count / n
    again, before = sum(map(eq, words, words[1:])) / n, 1 - len(set(words)) / n
    out[b"=repeated"] = again
    out[b"=repeated %d" % int(8 * again + 0.75)] = 2.0
    out[b"=used before"] = before
    return out


class Space:
    """The latent-semantic space of a labelled sample."""

    def __init__(self, sample: list[dict[bytes, float]], labels: np.ndarray) -> None:
        self.labels = labels.astype(np.float64)
        used = Counter(t for s in sample for t in s)
        chosen = sorted(used, key=lambda t: (-used[t], t))[:TERMS]
        self.column = {t: i for i, t in enumerate(chosen)}
        self.idf = np.log((1 + len(sample)) / (1 + np.array([used[t] for t in chosen], np.float64))) + 1
        x = self._weighted(sample)
        values, vectors = np.linalg.eigh(x.T @ x)
        self.projection = np.ascontiguousarray(vectors[:, np.argsort(-values)[:DIMENSIONS]])
        self.vectors = self._latent(sample)
        self.prior = float(self.labels.mean())

    def _weighted(self, counts: list[dict[bytes, float]]) -> np.ndarray:
        x = np.zeros((len(counts), len(self.column)))
        for row, found in zip(x, counts, strict=True):
            for t, share in found.items():
                if (i := self.column.get(t)) is not None:
                    row[i] = share
        return self._unit(np.sqrt(np.maximum(x, 0)) * self.idf)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _latent(self, counts: list[dict[bytes, float]]) -> np.ndarray:
        """Unit vectors in the latent space; each product is one of ``BLOCK`` rows, so rows don't depend on their number."""
        out = []
        for at in range(0, len(counts), BLOCK):
            part = counts[at : at + BLOCK]
            x = self._weighted(part + [{}] * (BLOCK - len(part)))
            out.append(self._unit(x @ self.projection)[: len(part)])
        return np.concatenate(out) if out else np.empty((0, self.projection.shape[1]))

    def cosines(self, counts: list[dict[bytes, float]]) -> np.ndarray:
        """The cosine of each of up to ``BLOCK`` texts with each row of the sample."""
        latent = np.zeros((BLOCK, self.projection.shape[1]))
        latent[: len(counts)] = self._latent(counts)
        return np.round(latent @ self.vectors.T, DECIMALS)[: len(counts)]

    def nearest(self, near: np.ndarray) -> np.ndarray:
        """For each row of cosines the numbers of the ``NEIGHBOURS`` largest, ascending; of equal ones the first count."""
        k = min(NEIGHBOURS, near.shape[1])
        at = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
        least = np.take_along_axis(near, at, 1).min(axis=1)
        for row in np.flatnonzero((near >= least[:, None]).sum(axis=1) > k).tolist():
            above = np.flatnonzero(near[row] > least[row])
            at[row] = np.sort(np.r_[above, np.flatnonzero(near[row] == least[row])[: k - len(above)]])
        return at

    def score(self, counts: list[dict[bytes, float]]) -> np.ndarray:
        """Share of label 1 among the nearest, each weighted by its cosine to a power; the prior where nothing is near."""
        out = []
        for at in range(0, len(counts), BLOCK):
            near = self.cosines(counts[at : at + BLOCK])
            found = self.nearest(near)
            w = np.maximum(np.take_along_axis(near, found, 1), 0) ** SHARPNESS
            out.append(((w * self.labels[found]).sum(1) + 1e-6 * self.prior) / (w.sum(1) + 1e-6))
        return np.concatenate(out) if out else np.empty(0)


def held_out(doc_id):
    """Whether crc32 of the id as text has remainder 1 by 3; such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        found = [terms(t) for t in b["text"].to_pylist()]
        yield pa.record_batch({
            "doc_id": b["doc_id"],
            "quality": b["quality"],
            "term": pa.array([list(f) for f in found], pa.list_(pa.binary())),
            "share": pa.array([list(f.values()) for f in found], pa.list_(pa.float64())),
        })


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Space | float:
    """The space of ``sample_rows`` labelled rows, or the score of all texts where there are no labels to learn.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality. A row whose
    labels contradict each other counts as 0; null labels are left out, and so
    are ids with several different texts, as it isn't known which of them the
    label is of. Repeated rows count once.
    """
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").dropDuplicates(["doc_id", "text"])
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n")).where("n = 1")
    rows = texts.mapInArrow(_listed, "doc_id long, quality int, term array<binary>, share array<double>").collect()
    rows.sort(key=lambda r: r.doc_id)
    known = np.array([r.quality for r in rows])
    if len(set(known.tolist())) < 2:
        return float(known.mean()) if len(known) else 0.5
    return Space([dict(zip(map(bytes, r.term), r.share, strict=True)) for r in rows], known)


def _scores(own: Space | float, texts: list[str | None]) -> np.ndarray:
    return own.score([terms(t) for t in texts]) if isinstance(own, Space) else np.full(len(texts), own)


def _space(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str):
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source, docs.sparkSession.sparkContext.broadcast(fit(source, labels.select("doc_id", "quality"), sample_rows))


def score_documents(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's quality: doc_id, score, predicted.

    The score comes from the whole text alone; a null text is an empty one,
    whose only term is its length. Equal texts score alike, whatever their rows,
    so repeated rows and ids do too; columns of other names are ignored. An empty
    table gives an empty result. Without labels of both kinds every score is
    the share of label 1, or 0.5 without any.
    """
    source, shared = _space(docs, labels, sample_rows, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                score = _scores(shared.value, part["text"].to_pylist())
                yield pa.record_batch({"doc_id": part["doc_id"], "score": pa.array(score, pa.float64()), "predicted": pa.array(score >= 0.5).cast(pa.int32())})

    return source.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` predicts to be good, with all their columns."""
    _, shared = _space(docs, labels, sample_rows, id_col, text_col)
    given, name = carried(docs), f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, name):
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                yield part.filter(pa.array(_scores(shared.value, part[name].to_pylist()) >= 0.5))

    return restored(given.mapInArrow(run, given.schema), docs)
