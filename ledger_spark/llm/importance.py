"""Importance resampling towards a target: hashed word and word-pair features.

A document's features are its words and its pairs of neighbouring words; a feature's
bucket is its CRC-32 modulo ``BUCKETS``. A bucket's gain is the logarithm of its
share in the target over its share in the documents (both smoothed by one). The
mean gain of a document's features, plus Gumbel noise that its id fixes, is its
score; the highest scores are drawn, which samples without replacement in
proportion to the exponential of the mean gain.

Head-tail vocabulary. A CRC can be continued: the CRC of "a b" goes on from the
state after "a". Frequent words with their CRC states and frequent pairs with
their buckets (:func:`head`) are broadcast, and a text's features are looked up
there; a feature that is not in the tables takes its CRC directly, a pair from the
state of its first word. Both give the same, exact bucket, so the tables decide
nothing but time. They are drawn from all texts: each task hands on what made up
one in ``HEAD`` of the occurrences in some stretch that it read, and of the sums
those that reach one in ``HEAD`` of all occurrences stay. There are at most
``HEAD`` of each kind, of at most ``HEAD_BYTES`` bytes a word: a proven bound.

Each text is cut and hashed once: its buckets are written (two bytes a feature).
Exact bucket totals come from that table, one row per task and bucket; then the
weights, by array look-ups. Scores are whole numbers in a range that the gains'
and the noise's bounds fix, so the score that cuts the draw off comes from a
histogram of bounded size. Only rows from that score on are ranked, by a range
sort whose last key is the row itself, so that equal keys can be split.

Nulls and ties: a NULL or empty text has no words, weight 0 and is not drawn. A
NULL id has no noise and so no score; its row counts in the totals, but is
neither drawn nor counted among those drawn from. Equal scores rank by the
smaller id, rows of one id and score in any order. Repeated rows are as many
documents. Very long texts are read whole. An empty table gives an empty result;
an empty target makes every gain a smoothed one over none. Extra columns of the
input are ignored, and no internal name can clash with them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledger_spark.llm.common import slices, written
from ledger_spark.sources.maintenance import assign_ids

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: A word or pair is broadcast if it makes up at least one in so many occurrences.
HEAD = 1 << 16
HEAD_BYTES = 64
#: Distinct words, and pairs, that a task holds while it counts a stretch of texts.
HELD = 200_000

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_BYTES = bytes(c if (c := b + 32 if 65 <= b <= 90 else b) in _WORD else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: A-Z lower-cased, ASCII other than letters and digits between."""
    return text.translate(_BYTES).split()


@dataclass
class Head:
    """CRC states of frequent words, buckets of frequent pairs."""

    states: dict[bytes, int]
    pairs: dict[tuple[bytes, bytes], int]
    buckets: int = BUCKETS

    def of(self, text: bytes) -> np.ndarray:
        """The bucket of every word, then of every pair of neighbours."""
        w, n = words(text), self.buckets
        state, pair = self.states.get, self.pairs.get
        crcs = [crc32(x) if s is None else s for x, s in zip(w, map(state, w))]
        later = w[1:]
        pairs = [crc32(b" " + x, s) % n if b is None else b for x, s, b in zip(later, crcs, map(pair, zip(w, later)))]
        return np.concatenate([np.array(crcs, np.int64) % n, np.array(pairs, np.int64)]).astype(bucket_type(n))


def bucket_type(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary()))


def frequent(texts: DataFrame, share: int = HEAD, held: int = HELD) -> DataFrame:
    """(first binary, second binary, n long): words (no second) and pairs that make up
    at least one in ``share`` of the occurrences in ``texts(text)``; ``n`` is at
    most the true count. Whatever made up that share of every stretch is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones: Counter = Counter()
        twos: Counter = Counter()

        def handed() -> pa.RecordBatch:
            out: list[tuple] = []
            for counts in (ones, twos):
                n = counts.total()
                out.append((None, b"" if counts is twos else None, n))
                out += [(*(k if counts is twos else (k, None)), c) for k, c in counts.items() if c * share >= n]
                counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()),
                                               pa.array([x[2] for x in out], pa.int64())], ["first", "second", "n"])

        for part in slices(batches, 64):
            for t in _texts(part.column(0)):
                w = words(t)
                ones.update(w)
                twos.update(zip(w, w[1:]))
            if len(ones) + len(twos) >= held:
                yield handed()
        yield handed()

    found = (texts.mapInArrow(run, "first binary, second binary, n long")
             .groupBy("first", "second").agg(F.sum("n").alias("n")))
    found = written(found, "importance-head")
    totals = {r.second is not None: r.n for r in found.filter("first IS NULL").collect()}
    least = F.when(F.col("second").isNull(), totals.get(False, 0)).otherwise(totals.get(True, 0))
    short = (F.octet_length("first") <= HEAD_BYTES) & (F.coalesce(F.octet_length("second"), F.lit(0)) <= HEAD_BYTES)
    return found.filter(F.col("first").isNotNull() & (F.col("n") * share >= least) & short)


def head(texts: DataFrame, buckets: int = BUCKETS, share: int = HEAD) -> Head:
    """The broadcast tables for ``texts(text)``: at most ``share`` words and as many pairs."""
    rows = frequent(texts, share).toArrow()
    states, pairs = {}, {}
    for a, b in zip(rows.column("first").to_pylist(), rows.column("second").to_pylist()):
        if b is None:
            states[a] = crc32(a)
        else:
            pairs[a, b] = crc32(b" " + b, crc32(a)) % buckets
    return Head(states, pairs, buckets)


def hashed(docs: DataFrame, tables: Head, key: str | None, text: str) -> DataFrame:
    """(id, n_features, buckets binary): the buckets of every row's features."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    kind = docs.schema[key].dataType.simpleString() if key else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.of
        for part in slices(batches):
            found = [of(t) for t in _texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int64()),
                                              pa.array([x.tobytes() for x in found], pa.binary())], ["id", "n_features", "buckets"])

    own = F.col(key) if key else F.lit(0)
    return (docs.select(own.alias("id"), F.col(text).alias("text"))
            .mapInArrow(run, f"id {kind}, n_features long, buckets binary"))


def _flat(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(all buckets of a batch, where each row's begin and end)."""
    kind = np.dtype(bucket_type(buckets))
    sizes = np.array([0, *(len(x) for x in column.to_pylist())], np.int64) // kind.itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), np.cumsum(sizes)


def bucket_totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``rows(buckets)`` fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for part in slices(batches):
            n += np.bincount(_flat(part.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["bucket", "n"])

    sums = (rows.select("buckets").mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())  # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed target share / smoothed source share)) per bucket."""
    k = len(source)
    every, wanted = float(source.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((float(t + 1) * every) / (float(s + 1) * wanted)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_features, weight): the floored mean gain of each row's features, 0 without any."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for part in slices(batches):
            every, ends = _flat(part.column(2), len(g))
            sums = np.concatenate([[0], np.cumsum(g[every])])[ends]
            mean = np.diff(sums) // np.maximum(np.diff(ends), 1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(mean, pa.int64())],
                                             ["id", "n_features", "weight"])

    return rows.select("id", "n_features", "buckets").mapInArrow(run, f"id {kind}, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             share: int = HEAD) -> DataFrame:
    """(``key``, n_features, weight, score, rank) per row of ``docs``: ``rank`` numbers the
    ``percent`` of the rows with at least ``least_words`` words that are drawn."""
    tables = head(docs.select(F.col(text).alias("text")), buckets, share)
    rows = written(hashed(docs, tables, key, text), "importance-buckets")
    gain = gains(bucket_totals(rows, buckets), bucket_totals(hashed(target, tables, None, target_text), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")
    scored = written(weighed(rows, gain).withColumn("score", F.col("weight") + noise), "importance-scores")
    fit = (F.col("n_features") >= 2 * least_words - 1) & F.col("score").isNotNull()
    # gains and noise are bounded, so is the number of different scores
    heights = scored.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()
    score, n = heights.column("score").to_numpy(), heights.column("n").to_numpy()
    draws = percent * int(n.sum()) // 100
    order = np.argsort(-score)
    if draws:
        last = int(score[order][np.searchsorted(np.cumsum(n[order]), draws)])
        among = F.coalesce(fit & (F.col("score") >= last), F.lit(False))
    else:
        among = F.lit(False)
    out = ["id", "n_features", "weight", "score"]
    ranked = assign_ids(scored.filter(among), order_cols=(F.desc("score"), F.asc("id")), id_col="place")
    place = F.when(F.col("place") <= draws, F.col("place"))
    return (scored.filter(~among).select(*out, F.lit(None).cast("long").alias("rank"))
            .unionByName(ranked.select(*out, place.alias("rank"))).withColumnRenamed("id", key))
