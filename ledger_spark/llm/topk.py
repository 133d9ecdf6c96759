"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors become integers (``floor(1024 * x)``). Candidates are dealt into shards.
A shard is an index: per dimension, the postings (candidate, value) ordered by
value and cut into segments of equal quantised value; from one end they come in
descending impact for a positive query weight, from the other for a negative.

A query reads the segments of all dimensions in descending order of their
quantised impact (the greatest product that the segment can hold) and adds it to
the accumulators of the segment's candidates. Whatever a candidate has not met
yet is at most the last impact read, so

    bound = impacts met + dimensions not met * last impact

is never below its score. A few of the best bounds are scored exactly; their
k-th score is a floor. Candidates whose bound reaches the floor are the possible
members: this is the proof by which all others stop being looked at. Reading ends
when at most ``RESCORE`` possible members are left, or with the last segment;
possible members are then scored exactly, so no quantised score reaches a result.

Every query meets every shard (a stated query set against all rows): a shard's
candidates come to a task first, its index is built once, and the queries stream
past it. A shard returns k rows per query, and a window picks the best k of all
shards. Candidates are shuffled once, nothing is broadcast or collected.

Nulls and ties: a vector that is NULL, empty, or holds a NULL or non-finite
component takes no part, nor does one without an id; vectors are compared with
those of the same length only. Equal scores rank by the smaller id. A repeated id
is as many candidates as it has rows; as a query it counts once, with its
smallest vector; no row with the query's own id is its candidate. A query without
candidates has no rows. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ledger_spark.llm.hardneg import Shard as Candidates, over_shards

SCALE = 1024
K = 10
QUERY_EVERY = 100
SHARD_ROWS = 8192
#: Width of a quantisation level, in units of 1 / SCALE.
STEP = 64
#: Tests on the way through all postings.
ROUNDS = 12
RESCORE = 256


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): integer vectors of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
            .select(F.col(key).cast("long").alias("id"),
                    F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v")))


class Shard:
    """Impact-ordered index over the rows of an integer matrix."""

    def __init__(self, values: np.ndarray, step: int = STEP):
        self.values = values
        n, dims = values.shape
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        dim, start, end, level = [], [], [], []
        for d in range(dims):
            of = values[self.order[d], d] // step
            starts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
            dim.append(np.full(len(starts), d))
            start.append(starts)
            end.append(np.append(starts[1:], n))
            level.append(of[starts])
        self.dim, self.start, self.end = np.concatenate(dim), np.concatenate(start), np.concatenate(end)
        self.low = np.concatenate(level) * step
        self.high = self.low + step - 1

    def possible(self, query: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the best ``k`` of the ``allowed`` ones."""
        weight = query[self.dim]
        used = np.flatnonzero(weight)
        impact = np.where(weight > 0, weight * self.high, weight * self.low)[used]
        used = used[np.argsort(-impact, kind="stable")]
        impact = np.sort(impact)[::-1]
        read = np.cumsum(self.end[used] - self.start[used])
        met = np.zeros(len(self.values), np.complex128)  # real: impacts met, imaginary: dimensions met
        dims, at, left = int(np.count_nonzero(query)), 0, np.flatnonzero(allowed)
        for r in range(1, ROUNDS + 1):
            stop = len(used) if r == ROUNDS else int(np.searchsorted(read, read[-1] * r / ROUNDS)) + 1
            for s, value in zip(used[at:stop].tolist(), impact[at:stop].tolist()):
                met[self.order[self.dim[s], self.start[s]:self.end[s]]] += value + 1j
            if stop > at:
                at = stop
            bound = met.real[left] + (dims - met.imag[left]) * impact[at - 1]
            likely = left[np.argpartition(-bound, 2 * k)[:2 * k]] if len(left) > 2 * k else left
            floor = np.sort(self.values[likely] @ query)[-k] if len(likely) >= k else -np.inf
            left = left[bound >= floor]
            if len(left) <= RESCORE or at == len(used):
                break
        return left

    def top(self, query: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best ``k`` allowed rows, ties to the smaller id."""
        rows = np.flatnonzero(allowed)
        if len(rows) > RESCORE and query.any():
            rows = self.possible(query, allowed, k)
        scores = self.values[rows] @ query
        best = np.lexsort((ids[rows], -scores))[:k]
        return rows[best], scores[best]


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = QUERY_EVERY,
          k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` for each row whose id ``every`` divides."""
    rows = usable(vectors, key, vector).withColumns({"dims": F.size("v"), "label": F.lit(0)})
    asked = (rows.filter(F.col("id") % every == 0).groupBy("dims", "id").agg(F.min("v").alias("v"))
             .withColumns({"label": F.lit(0), "asked": F.lit(None).cast("int")}))
    shards = max(1, math.ceil(rows.count() / shard_rows))

    def best_of(shard: Candidates, own: int, _: int, query: np.ndarray, __: None) -> list[tuple]:
        shard.index = shard.index or Shard(shard.values)
        best, scores = shard.index.top(query, shard.ids != own, shard.ids, k)
        return [(own, i, s) for i, s in zip(shard.ids[best].tolist(), scores.tolist())]

    found = over_shards(rows, asked, shards, "query_id vec_id score", best_of)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
