"""Exact top-k against brute force."""

import math

import numpy as np

from ledger_spark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    fine = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v, *_ in rows
            if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    asked = {}
    for i, v in fine:
        if i % every == 0:
            asked[(len(v), i)] = min(asked.get((len(v), i), v), v)
    out = []
    for (_, q), v in asked.items():
        found = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v)))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_matches_brute_force_over_shards_and_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.2, 16).round(2).tolist(), 0) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(topk.top_k(df, every=100, shard_rows=400)) == brute(rows, 100, 10)


def test_nulls_ties_repeats_and_lengths(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, -0.5], 1), (3, None, 1), (4, [None, 1.0], 1),
            (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (7, [], 1), (1, [0.5, 0.5], 1),
            (100, [0.0, 0.0], 1), (200, [1.0, 1.0, 1.0], 1), (0, [0.9, 0.0], 1), (300, [-1.0, -1.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"label": "score"})
    assert rows_of(topk.top_k(df, k=3)) == brute(rows, 100, 3)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_possible_members_keep_the_best_and_prune():
    rng = np.random.default_rng(3)
    values = rng.integers(-400, 400, (5000, 24))
    values[:40] = values[0] + rng.integers(-20, 20, (40, 24))
    shard, allowed = topk.Shard(values), np.arange(5000) != 0
    left = shard.possible(values[0], allowed, 10)
    best = sorted(range(1, 5000), key=lambda i: (-int(values[i] @ values[0]), i))[:10]
    assert set(best) <= set(left.tolist()) and len(left) < 4999
