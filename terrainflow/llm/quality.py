"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are hashed words, hashed three-grams of character shapes and words that repeat the one before. Their document
frequencies are counted over all documents. A bounded sample of labelled documents (SAMPLE of each label) spans the
latent space and votes: its vectors, at most 2 * SAMPLE * RANK numbers, are broadcast, every document is compared
with all of them in blocks of exact cosine products, and the NEIGHBOURS most similar vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainflow.llm.common import text_batches, word_ids, word_spans

TERMS = 1024
DIMENSIONS = 2 * TERMS
#: Labelled documents of each label that are used at most: the bound of what is broadcast.
SAMPLE = 2000
RANK = 64
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3

_SHAPE = np.zeros(256, np.uint32)
_SHAPE[ord("a") : ord("z") + 1] = 1
_SHAPE[128:] = 1
_SHAPE[ord("A") : ord("Z") + 1] = 2
_SHAPE[ord("0") : ord("9") + 1] = 3
_SHAPE[ord("\n")] = 4
for _k, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _SHAPE[_c] = 5 + _k


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x DIMENSIONS counts of hashed terms."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros((rows, DIMENSIONS), np.float32)
    shape = _SHAPE[data]
    gram = np.zeros(len(data), np.uint32)
    gram[:] = shape * 1600
    gram[1:] += shape[:-1] * 40
    gram[2:] += shape[:-2]
    gram = (gram * np.uint32(2654435761)) >> np.uint32(22)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    starts, ends, first = word_spans(data, offsets)
    ids = word_ids(data, starts, ends)
    word = (ids >> np.uint64(40)).astype(np.int64) % (TERMS - 1)
    word_owner = np.repeat(np.arange(rows), np.diff(first))
    again = np.flatnonzero((ids[1:] == ids[:-1]) & (word_owner[1:] == word_owner[:-1])) + 1
    key = np.concatenate([owner * DIMENSIONS + gram, word_owner * DIMENSIONS + TERMS + word, word_owner[again] * DIMENSIONS + DIMENSIONS - 1])
    return np.bincount(key, minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS).astype(np.float32)


def _frequencies(batches):
    """One row per task and term: documents that hold it; term -1: all documents."""
    total, n = np.zeros(DIMENSIONS, np.int64), 0
    for _, _, _, data, offsets in text_batches(batches):
        counts = term_counts(data, offsets)
        total += (counts > 0).sum(axis=0)
        n += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[n], total]))], names=["term", "n"])


def _counts(batches):
    for batch, lo, hi, data, offsets in text_batches(batches):
        rows = term_counts(data, offsets).astype("<u4")
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "terms"])


@dataclass
class Voters:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        out = (np.log1p(counts) * self.idf) @ self.basis
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the votes of the most similar; without any similar voter the prior."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        likeness = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(likeness, len(self.labels) - k, axis=1)[:, -k:]
        votes = np.maximum(np.take_along_axis(likeness, near, axis=1), 0).astype(float) ** SHARPNESS * self.weights[near]
        total = votes.sum(axis=1)
        return np.where(total > 1e-12, (votes * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), self.prior)


def train(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE, rank: int = RANK) -> Voters:
    """Voters from the labelled documents for which held_out(doc_id column) is false."""
    df = dict(docs.select("doc_id", "text").mapInArrow(_frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect())  # DIMENSIONS + 1 rows
    n = max(df.get(-1, 0), 1)
    idf = np.log((1 + n) / (1 + np.array([df.get(t, 0) for t in range(DIMENSIONS)]))).astype(np.float32) + 0.1
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("quality").isin(0, 1))
    of = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # one row per label
    first = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = first[0].unionByName(first[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(_counts, "doc_id bigint, terms binary")
    rows = rows.groupBy("doc_id").agg(F.min("terms").alias("terms"))  # of rows that share an id, one
    terms = {r.doc_id: r.terms for r in rows.collect()}  # at most 2 * SAMPLE rows of DIMENSIONS numbers
    marked = [(r.doc_id, r.quality) for r in chosen.orderBy("doc_id").collect() if r.doc_id in terms]
    total = sum(of.values())
    prior = of.get(1, 0) / total if total else 0.5
    if not marked:
        return Voters(idf, np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior)
    counts = np.stack([np.frombuffer(terms[d], "<u4") for d, _ in marked]).astype(np.float32)
    x = np.log1p(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    # Randomized subspace iteration for the leading right singular vectors.
    basis = np.random.default_rng(7).standard_normal((DIMENSIONS, min(rank + 16, DIMENSIONS))).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    basis = np.ascontiguousarray((basis @ turn.T)[:, :rank], np.float32)
    y = np.array([q for _, q in marked], float)
    share = {q: of[q] / max((y == q).sum(), 1) for q in of}  # a voter stands for the labelled documents of its label
    voters = Voters(idf, basis, np.zeros((0, 1), np.float32), y, np.array([share[int(q)] for q in y]), prior)
    voters.vectors = voters.embed(counts).astype(np.float32)
    return voters


def classify(docs: DataFrame, voters: Voters) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        for batch, lo, hi, data, offsets in text_batches(batches):
            score = shared.value.score(term_counts(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def fifth(doc_id):
    """Rows held out of training: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, held_out=fifth, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality 0/1) -> doc_id, held_out, score, predicted, one row per input row.

    Null or empty text: no terms, so the share of label 1 among all usable labels. Null doc_id: scored, never trained
    on, not held out. Several labels of a document: the lowest counts; null labels are left out. Repeated rows get equal
    scores; ties among neighbours and the sample's order are settled by hashed doc_id. Without labels: 0.5.
    Empty table: empty result. Other columns (n_chars, lang, source, toxic) are never read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    scored = classify(docs, train(docs, labels, held_out, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
