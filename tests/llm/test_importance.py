"""Importance resampling against a plain version and its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledger_spark.llm import importance
from ledger_spark.llm.catalog import SPARK
from tests.conftest import SF_SMALL

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, target, percent=25, least=20, k=10_000, seed=7):
    """(id, n_features, weight, score, rank) by the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % k
    source = Counter(bucket(f) for _, t in docs for f in features(t))
    wanted = Counter(bucket(f) for t in target for f in features(t))
    n_s, n_t = source.total(), wanted.total()

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1.0) * (n_s + k) / ((source[b] + 1.0) * (n_t + k))))

    rows = []
    for i, t in docs:
        f = features(t)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(f), weight, score))
    able = sorted((r for r in rows if r[3] is not None and (r[1] + 1) // 2 >= least), key=lambda r: (-r[3], r[0], r[1:]))
    rank = Counter()
    ranks = {}
    for place, r in enumerate(able[:percent * len(able) // 100], 1):
        ranks.setdefault(r, []).append(place)
    out = []
    for r in rows:
        out.append((*r, ranks[r].pop(0) if ranks.get(r) else None))
    del rank
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_the_query_equals_the_definition(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert got(SPARK["op11_importance_resample"](spark, SF_SMALL)) == plain(docs, target)


ODD = ["", None, "  .,!? ", "One two ONE Two. one-two; ÉCOLE école Straße 日本語 x1y2 " * 6, "a" * 300 + " " + "b" * 70 + " tail",
       "İI ſK \x7f\x00mid dle em—dash", "same words here " * 20, "same words here " * 20, "long " * 30000]


@pytest.mark.parametrize("share", [1, 8, importance.HEAD])
def test_odd_texts_repeats_nulls_and_clashing_names(spark, share):
    rng = np.random.default_rng(1)
    rows = [*enumerate(ODD), (7, ODD[7]), (3, "another text under one id " * 9), (None, ODD[3])]
    rows += [(100 + i, " ".join(f"w{x}" for x in rng.zipf(1.3, 40) % 900)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "n_features", "buckets", "weight", "score", "rank", "place", "_tie", "_mid", "_pid"):
        docs = docs.withColumn(name, F.lit("x"))
    target = [" ".join(f"w{x}" for x in range(40)), None, "", "One two"]
    aim = spark.createDataFrame([(t,) for t in target], "text string").withColumn("id", F.lit(1))
    found = importance.resample(docs, aim, share=share)
    assert got(found) == plain(rows, target)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_ties_go_to_the_smaller_id_and_ranks_are_dense(spark):
    text = "one text that a third of all documents hold and that has at least twenty words so it can be drawn in the end"
    rows = [(i // 2, text) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    aim = spark.createDataFrame([(text,)], "text string")
    found = got(importance.resample(docs, aim, percent=50))
    drawn = sorted((r for r in found if r[4]), key=lambda r: r[4])
    assert [r[4] for r in drawn] == list(range(1, 1501))
    assert drawn == sorted(drawn, key=lambda r: (-r[3], r[0], r[4]))
    assert [r[:4] for r in sorted(found, key=str)] == [r[:4] for r in plain(rows, [text], percent=50)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(i, "word " * 25) for i in range(8)], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    assert got(importance.resample(some, none)) == plain([(i, "word " * 25) for i in range(8)], [])


def test_frequent_features_are_exact_and_bounded(spark):
    texts = ["common pair of words"] * 200 + [f"u{i} v{i}" for i in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    tables = importance.head(df, share=20)
    assert set(tables.states) == {b"common", b"pair", b"of", b"words"} and len(tables.pairs) <= 20
    for (a, b), bucket in tables.pairs.items():
        assert bucket == zlib.crc32(a + b" " + b) % importance.BUCKETS
    stretches = importance.frequent(df, share=20, held=50)  # handed on in many stretches
    assert {r.first for r in stretches.collect()} >= {b"common", b"pair", b"of", b"words"}


def test_many_buckets(spark):
    rows = [(i, f"word{i} other{i} " * 12) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aim = spark.createDataFrame([("word3 other3",)], "text string")
    assert got(importance.resample(docs, aim, buckets=100_003)) == plain(rows, ["word3 other3"], k=100_003)


def test_the_sql_equals_the_definition():
    import duckdb

    from ledger_spark.llm.catalog import SQL

    con = duckdb.connect()
    rows = [(i, t) for i, t in enumerate(ODD[:-1])] + [(50 + i, f"Some words, number {i} " * (3 + i)) for i in range(20)]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t and t.replace("\x00", " ")) for i, t in rows])
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO benchmark VALUES (1, 'some words, one two école')")
    found = con.execute(SQL["op11_importance_resample"]).fetchall()
    assert sorted(found, key=str) == plain([(i, t and t.replace("\x00", " ")) for i, t in rows], ["some words, one two école"])
