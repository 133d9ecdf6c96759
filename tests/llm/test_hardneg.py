"""Hard negatives against brute force and SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledger_spark.llm import hardneg
from ledger_spark.llm.catalog import SPARK, SQL
from tests.conftest import SF_MID

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    """All scores, all windows; ``rows`` are (id, vector, label after relabelling)."""
    fine = [(i, [math.floor(256 * float(np.float32(c))) for c in v], y) for i, v, y in rows
            if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {}
    for i, v, y in fine:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (len(v), v, y)), (len(v), v, y))
    out = []
    for a, (dims, v, y) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, w, z in fine if i != a and len(w) == dims)
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            inside = [(t, n) for t, n, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(n, dims, seed, labels=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.2, (labels, dims))
    return [(i, (middle[i % labels] + middle[0] + rng.normal(0, 0.15, dims)).round(2).tolist(), int(rng.integers(labels)))
            for i in range(n)]


def test_the_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_MID}/embeddings.parquet')")
    want = sorted(con.execute(SQL["op12_hard_negatives"]).fetchall())
    assert rows_of(SPARK["op12_hard_negatives"](spark, SF_MID)) == want and len(want) > 20


@pytest.mark.parametrize("shard_rows", [150, 700, 100_000])
def test_matches_brute_force_over_shards(spark, shard_rows):
    rows = clustered(1400, 12, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert rows_of(hardneg.mine(df, shard_rows=shard_rows)) == want and len(want) > 200


def test_whole_values_tie_often(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-2, 3, 5) / 4).tolist(), int(rng.integers(3))) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(hardneg.mine(df, shard_rows=200)) == brute(rows)


def test_nulls_repeats_lengths_and_clashing_names(spark):
    rows = clustered(300, 6, 9) + [
        (50, [1.0] * 6, 1), (50, [0.5] * 6, 2), (7, [0.4] * 6, 1), (7, [0.4] * 6, 1), (None, [1.0] * 6, 1), (400, None, 1),
        (401, [1.0] * 5 + [None], 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (404, [], 1), (450, [0.0] * 6, 1),
        (500, [1.0, 2.0], 1), (501, [1.0, 1.5], 1), (502, [1.0, 1.4], 2), (503, [0.5, 1.4], None), (550, [-1.0] * 6, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "v", "dims", "shard", "asks", "asked", "anchor", "positive", "score", "place", "rank"):
        df = df.withColumn(name, F.lit("x"))
    got = rows_of(hardneg.mine(df, shard_rows=90))
    assert got == brute(rows)
    assert (500, 501, 1, 502, 256 * 256 + 512 * 384, 256 * 256 + 512 * math.floor(256 * float(np.float32(1.4)))) in got


def test_empty_and_lonely(spark):
    assert hardneg.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hardneg.mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], SCHEMA)).collect() == []


def test_relabelling(spark):
    df = spark.createDataFrame([(7, 9), (14, 3), (8, 9), (0, 0)], "vec_id long, label int")
    got = {r.vec_id: r.y for r in df.select("vec_id", hardneg.relabelled(F.col("vec_id"), F.col("label")).alias("y")).collect()}
    assert got == {7: 0, 14: 4, 8: 9, 0: 1}


def test_reading_stops_before_the_lists_end():
    """On a long tail the threshold proves most rows out; what was read suffices."""
    rng = np.random.default_rng(0)
    values = (rng.pareto(1.2, (20_000, 4)) * 50).astype(np.int64)
    lists, anchor = hardneg.Lists(values), np.array([3, 1, 2, 1])
    met = 0
    for rows, _, threshold in lists.read(anchor):
        met += len(rows)
        every = np.sort(values @ anchor)[::-1]
        if threshold is not None and threshold < every[4]:
            break
    ids, scores = hardneg.top(lists, np.arange(20_000), np.ones(20_000, bool), anchor, 5)
    assert met < 2_000 and scores.tolist() == every[:5].tolist()


def test_windows_are_exact_at_their_edges():
    for p in range(-60, 300):
        low, high = hardneg.window(p)
        inside = [s for s in range(-400, 400) if 50 * p <= 100 * s <= 95 * p]
        assert inside == list(range(low, high + 1))


def test_scores_beyond_floating_point_are_exact():
    values = np.array([[2 ** 31 + 1, 2 ** 30 - 1], [3, 2 ** 31]], np.int64)
    anchor = np.array([2 ** 30 + 1, -1])
    assert hardneg.Lists(values).scores(anchor).tolist() == [int(a) * (2 ** 30 + 1) - int(b) for a, b in values.tolist()]
