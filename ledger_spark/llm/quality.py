"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes a weighted term vector: hashed byte pairs (what it is written
with) and bucketed shape terms (how it repeats, shouts, is strewn with symbols).
A truncated SVD of the labelled sample gives the latent space; its projected,
unit-length rows and labels are broadcast (a proven bound: ``SAMPLE_ROWS`` rows
of ``RANK`` floats). Every document is projected and compared with every
labelled vector by exact blocked cosine products; its ``NEIGHBOURS`` nearest
vote for their label, weighted by similarity.

Fitting uses at most ``SAMPLE_ROWS`` labelled rows, those with the smallest key
hash. Scoring covers all rows and whole texts.

Nulls and ties: a NULL or empty text has no direction and gets the sample's
share of label 1, as does every text when nothing is labelled 0 or 1 (0.5 when
no row is labelled at all). Equal similarities keep the labelled row of the
smaller key hash. Repeated rows score alike; a key labelled twice counts as
often as it is labelled. An empty table gives an empty result. Columns of the input
are kept, but the score's own is replaced; :func:`keep_good` takes a free name for it.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledger_spark.llm.common import free_name, held_out, may_learn, slices, smallest_by_hash, table

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 4096
PAIR_TERMS = 4096
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.3
BLOCK_ROWS = 256
#: Byte pairs are counted in pieces of this many bytes, so memory stays bounded.
PIECE = 1 << 22
#: Bucket edges of the shape shares.
EDGES = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8])
SHAPES = 8
SHAPE_TERMS = SHAPES * (len(EDGES) + 1)
TERMS = PAIR_TERMS + SHAPE_TERMS
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def shape_shares(text: str, raw: np.ndarray) -> np.ndarray:
    """Eight shares in [0, 1] that tell prose from junk."""
    words = text.split()
    lines = text.split("\n")
    n, m = max(1, len(words) - 1), max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    return np.array([
        sum(map(operator.eq, words, words[1:])) / n,          # a word right after itself
        1 - len(set(words)) / max(1, len(words)),             # words seen before
        1 - len(set(lines)) / len(lines),                     # lines seen before
        counts[_SYMBOL].sum() / m,
        counts[_UPPER].sum() / m,
        counts[_DIGIT].sum() / m,
        sum(len(w) == 1 for w in words) / max(1, len(words)),
        min(1.0, len(words) / 200),
    ])


def term_vector(text: str | None) -> np.ndarray:
    """Unit-length term vector; all zeros for a text without characters."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    pairs = np.zeros(PAIR_TERMS, np.int64)
    for at in range(0, len(raw), PIECE):
        piece = raw[at:at + PIECE + 1].astype(np.uint32)
        key = ((piece[:-1] * 0x9E37 + piece[1:] * 0x85EB) >> 3) % PAIR_TERMS
        pairs += np.bincount(key, minlength=PAIR_TERMS)
    weights = np.sqrt(pairs, dtype=np.float32)
    norm = np.linalg.norm(weights)
    if norm:
        out[:PAIR_TERMS] = weights / norm
    buckets = np.searchsorted(EDGES, shape_shares(text, raw), side="right")
    out[PAIR_TERMS + np.arange(SHAPES) * (len(EDGES) + 1) + buckets] = 1 / np.sqrt(SHAPES)
    return out / np.linalg.norm(out)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's ``k`` greatest values, in order of place; of equal ones the first."""
    least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, [cosine.shape[1] - k]]
    picked = cosine >= least
    for r in np.flatnonzero(picked.sum(axis=1) > k):  # more rows share the last value than are wanted
        ties = np.flatnonzero(cosine[r] == least[r])
        picked[r, ties[k - int((cosine[r] > least[r]).sum()):]] = False
    return np.nonzero(picked)[1].reshape(len(cosine), k)


class Model:
    """Latent space, labelled vectors in it, and their labels."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.neighbours = neighbours
        self.labels = labels.astype(np.float32)
        seen = (terms > 0).sum(axis=0)
        self.weight = np.log((1 + len(terms)) / (1 + seen)).astype(np.float32) + 0.1
        weighted = terms * self.weight
        self.basis = self._basis(weighted, rank)
        self.vectors = _unit(weighted @ self.basis) if len(terms) else np.zeros((0, self.basis.shape[1]), np.float32)

    @staticmethod
    def _basis(rows: np.ndarray, rank: int) -> np.ndarray:
        """Leading right singular vectors by subspace iteration."""
        rank = min(rank, *rows.shape) or 1
        q = np.random.default_rng(7).standard_normal((rows.shape[1], rank)).astype(np.float32)
        for _ in range(6):
            q, _ = np.linalg.qr(rows.T @ (rows @ q)) if len(rows) else (q, None)
        return np.ascontiguousarray(q, dtype=np.float32)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows, weighted by cosine."""
        out = np.full(len(terms), self.prior)
        if not len(self.labels):
            return out
        cosine = _unit((terms * self.weight) @ self.basis) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = nearest(cosine, k)
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, None).astype(np.float64)
        total = weight.sum(axis=1)
        voted = total > 0
        out[voted] = (weight * self.labels[near]).sum(axis=1)[voted] / total[voted]
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
        learnable: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that ``learnable`` admits."""
    admitted = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if learnable is not None:
        admitted = admitted.filter(learnable)
    chosen = smallest_by_hash(admitted.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")),
                              "__key", sample_rows, admitted.count())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows = [term_vector(t).astype(np.float16).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary()), part.column(2)],
                                             ["key", "terms", "label"])

    texts = docs.select(F.col(key).alias("__key"), F.col("text").alias("__text"))
    sample = texts.join(F.broadcast(chosen), "__key").select("__key", "__text", "__label")  # <= sample_rows rows
    kind = sample.schema["__key"].dataType.simpleString()
    found = smallest_by_hash(sample.mapInArrow(vectors, f"key {kind}, terms binary, label int"), "key", sample_rows)
    rows = found.collect()
    terms = np.array([np.frombuffer(r.terms, np.float16) for r in rows], np.float32).reshape(len(rows), TERMS)
    return Model(terms, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model, into: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column ``into``: the vote for label 1, from 0 to 1.

    An input column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(into) if into != text else docs
    at, names = rest.columns.index(text), [*rest.columns, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, BLOCK_ROWS):
            terms = np.stack([term_vector(t) for t in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(terms))], names)

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(into, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0,
             threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, learnable=may_learn(F.col("doc_id"), modulus, remainder))
    return (score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD, modulus: int = 5,
              remainder: int = 0) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns.

    Labels come from the ``labels`` table, for the keys of ``docs``.
    """
    labels = table(docs.sparkSession, sf_dir, "labels")
    model = fit(docs, labels, learnable=may_learn(F.col("doc_id"), modulus, remainder))
    into = free_name("quality", docs.columns)
    return score(docs, model, into=into).filter(F.col(into) >= threshold).select(*docs.columns)
