"""Hard-negative mining with Fagin's threshold algorithm.

Vectors become integers (``floor(256 * x)``); a row's score for an anchor is their
inner product. An anchor's positives are its best rows of the same label. The hard
negatives of a positive are the best rows of other labels whose scores lie in the
positive's window: at least ``LOW`` and at most ``HIGH`` hundredths of its score.

Both searches run over shards of the rows. A shard holds, for every dimension, a
list of its rows sorted by value. For an anchor the lists are read from the end
that its component's sign makes the better one, all to the same depth
(anchor-signed sorted access); every row met for the first time is scored in full
(random access). What no list has shown yet scores at most the threshold, the sum
over dimensions of the anchor's component times the last value read. Reading stops

* for positives, once the threshold falls strictly below the k-th score found;
* for negatives, once for every window it falls strictly below the window's k-th
  score found, or below the window itself if fewer are in it.

Strictly, since an equal score with a smaller id would win. The depth doubles from
one look to the next. If the lists run out, every row has been scored.

Rows are dealt into shards by a hash; a shard's rows come to a task before the
anchors that ask it, so its lists are built once and anchors stream past them.
Every anchor meets every shard (a stated query set against all rows); a shard
returns at most k rows per question, and a window picks the best of all shards.
Nothing is broadcast or collected.

Nulls and ties: labels are whole numbers. Rows with a NULL id, label or vector, an empty vector, or a NULL or
non-finite component take no part. Vectors are compared with those of the same
length only. Equal scores rank by the smaller id. Repeated rows are as many
candidates, and so as many positives (each with its own negatives); as an anchor an
id counts once, with its smallest vector (then label); rows with the anchor's own id
are neither its positives nor its negatives. An anchor without positives, or a
positive without rows in its window, has no result. Scores are exact below 2**63.
Empty tables give an empty result; extra columns of the input are ignored, and no
internal name can clash with them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledger_spark.llm.common import written

SCALE = 256
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: The window, in hundredths of the positive's score.
LOW, HIGH = 50, 95
SHARD_ROWS = 16_384
#: Depth of the first look into the lists.
DEPTH = 32


def relabelled(key: Column, label: Column, divisor: int = 7, labels: int = 10) -> Column:
    """The contract's label: one further where ``divisor`` divides the id."""
    return F.when(key % divisor == 0, (label + 1) % labels).otherwise(label)


def usable(vectors: DataFrame, key: Column, vector: Column, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, v, dims): integer vectors of the rows that take part."""
    rows = vectors.select(key.cast("long").alias("id"), label.cast("long").alias("label"),
                          F.transform(vector, lambda c: c.cast("double")).alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)
            .select("id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"), F.size("x").alias("dims")))


class Lists:
    """Rows of a shard, sorted in every dimension."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.order = np.argsort(values, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, 0)
        self.most = float(np.abs(values.astype(float)).max(initial=0.0))
        self.floats = values.astype(float)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products; by floating point where every partial sum is a whole number that it holds."""
        if self.most * float(np.abs(anchor.astype(float)).sum()) < 2 ** 53:
            return (self.floats @ anchor.astype(float)).astype(np.int64)
        return self.values @ anchor

    def read(self, anchor: np.ndarray, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """(rows met first, their scores, threshold for all others), look by look. The
        last threshold is None: no others are left."""
        n = len(self.values)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, every, at = np.zeros(n, bool), None, 0
        while at < n and len(up) + len(down):
            stop = min(n, max(depth, 2 * at))
            met = np.zeros(n, bool)
            met[self.order[n - stop:n - at, up]] = True
            met[self.order[at:stop, down]] = True
            rows = np.flatnonzero(met & ~seen)
            seen |= met
            if every is None and 8 * len(rows) < n:
                scores = self.values[rows] @ anchor
            else:
                every = self.scores(anchor) if every is None else every
                scores = every[rows]
            at = stop
            if at == n or seen.all():
                yield rows, scores, None
                return
            yield rows, scores, int(self.sorted[n - at, up] @ anchor[up]) + int(self.sorted[at - 1, down] @ anchor[down])
        yield np.arange(n), np.zeros(n, np.int64), None  # an anchor of zeros, or no rows


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
        return among[np.lexsort((ids[among], -scores[among]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest score of a negative: ``low * p <= 100 * s <= high * p``."""
    return -(-low * positive // 100), high * positive // 100


def top(lists: Lists, ids: np.ndarray, allowed: np.ndarray, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the best ``k`` allowed rows."""
    found, value = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows, scores, threshold in lists.read(anchor):
        fit = allowed[rows]
        found, value = np.append(found, ids[rows[fit]]), np.append(value, scores[fit])
        keep = best(found, value, k)
        found, value = found[keep], value[keep]
        if threshold is not None and len(value) == k and threshold < value[-1]:
            break
    return found, value


def top_in_windows(lists: Lists, ids: np.ndarray, allowed: np.ndarray, anchor: np.ndarray,
                   windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per window (least, greatest score): (ids, scores) of the best ``k`` allowed rows in it."""
    nothing = np.zeros(0, np.int64)
    out = [(nothing, nothing) for _ in windows]
    for rows, scores, threshold in lists.read(anchor):
        fit = allowed[rows] & (scores >= min(w[0] for w in windows))
        own, value = ids[rows[fit]], scores[fit]
        done = True
        for w, (low, high) in enumerate(windows):
            inside = (value >= low) & (value <= high)
            found, got = np.append(out[w][0], own[inside]), np.append(out[w][1], value[inside])
            keep = best(found, got, k)
            out[w] = found[keep], got[keep]
            done &= threshold is not None and threshold < (out[w][1][-1] if len(keep) == k else low)
        if done:
            break
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """((dims, shard), whether they ask, rows) for each run of rows that agree in these."""
    key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
    cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield (int(key[0, a]), int(key[1, a])), bool(key[2, a]), batch.slice(a, b - a)


def over_shards(rows: DataFrame, asking: DataFrame, shards: int, columns: str, answer: Callable) -> DataFrame:
    """Every row of ``asking(id, label, v, dims, asked)`` meets every shard of ``rows``.

    ``answer(shard, id, label, anchor, asked)`` returns result rows; ``shard`` is
    ``(ids, labels, lists)`` where ``lists(label)`` gives the lists over all rows, or
    those of one label, with their places.
    """
    names = ["dims", "shard", "asks", "id", "label", "v", "asked"]
    kind = asking.schema["asked"].dataType
    # the place of a row in its input is part of the hash: repeats of one row spread as well
    held = rows.select("dims", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"),
                       F.lit(0).alias("asks"), "id", "label", "v", F.lit(None).cast(kind).alias("asked"))
    asks = asking.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                         F.lit(1).alias("asks"), "id", "label", "v", "asked")
    both = held.select(names).unionByName(asks.select(names)).repartition("dims", "shard").sortWithinPartitions("dims", "shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for batch in batches:
            out = []
            for key, asks, part in _runs(batch) if batch.num_rows else ():
                if key != at:
                    at, parts, shard = key, [], None
                ids, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
                values = _matrix(part.column(5), key[0])
                if not asks:
                    parts.append((ids, labels, values))
                elif parts:
                    shard = shard or Shard(*(np.concatenate(x) for x in zip(*parts)))
                    for i, label, anchor, asked in zip(ids.tolist(), labels.tolist(), values, part.column(6).to_pylist()):
                        out += answer(shard, i, label, anchor, asked)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], columns.split())

    return both.mapInArrow(run, ", ".join(f"{c} long" for c in columns.split()))


class Shard:
    """The rows of a shard, with lists over all of them and over each label's, built when asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.labels, self.values = ids, labels, values
        self.index = None  # whatever else a caller builds once over the rows
        self.every: Lists | None = None
        self.of_label: dict[int, tuple[np.ndarray, Lists]] = {}

    def all(self) -> Lists:
        self.every = self.every or Lists(self.values)
        return self.every

    def of(self, label: int) -> tuple[np.ndarray, Lists]:
        if label not in self.of_label:
            rows = np.flatnonzero(self.labels == label)
            self.of_label[label] = rows, Lists(self.values[rows])
        return self.of_label[label]


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
         every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         shard_rows: int = SHARD_ROWS, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): up to
    ``negatives`` hard negatives for each of the ``positives`` of each row whose id
    ``every`` divides."""
    rows = written(usable(vectors, F.col(key), F.col(vector), F.col(label) if isinstance(label, str) else label, scale),
                   "negatives-vectors")
    asked = (rows.filter(F.col("id") % every == 0).groupBy("id")
             .agg(F.min(F.struct("dims", "v", "label")).alias("a")).select("id", "a.label", "a.v", "a.dims"))
    shards = max(1, math.ceil(rows.count() / shard_rows))

    def nearest(shard: Shard, i: int, own: int, anchor: np.ndarray, _) -> list[tuple]:
        at, lists = shard.of(own)
        if not len(at):
            return []
        ids = shard.ids[at]
        found, scores = top(lists, ids, ids != i, anchor, positives)
        return [(i, p, s) for p, s in zip(found.tolist(), scores.tolist())]

    near = over_shards(rows, asked.withColumn("asked", F.lit(None).cast("int")), shards, "anchor positive score", nearest)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc("positive"))
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    asks = (near.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive", "score")).alias("asked"))  # a few each
            .join(asked, F.col("anchor") == F.col("id")).select("id", "label", "v", "dims", "asked"))

    def hard(shard: Shard, i: int, own: int, anchor: np.ndarray, near: list[dict]) -> list[tuple]:
        near = [p for p in near if window(p["score"], low, high)[0] <= window(p["score"], low, high)[1]]
        if not near:
            return []
        found = top_in_windows(shard.all(), shard.ids, (shard.labels != own) & (shard.ids != i), anchor,
                               [window(p["score"], low, high) for p in near], negatives)
        return [(i, p["place"], p["positive"], p["score"], n, s)
                for p, (ids, scores) in zip(near, found) for n, s in zip(ids.tolist(), scores.tolist())]

    found = over_shards(rows, written(asks, "negatives-positives"), shards,
                        "anchor_id place positive_id positive_score negative_id negative_score", hard)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), F.asc("negative_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
