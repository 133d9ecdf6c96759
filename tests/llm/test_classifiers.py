"""Toxicity, quality and language: automaton and votes against brute force, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledger_spark.llm import catalog, language, quality, toxicity
from ledger_spark.llm.common import fold, may_learn

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def edits(a, b):
    """Edit distance with neighbouring swaps, the plain way."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            best = min(rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]), rows[i - 1][j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def test_automaton_agrees_with_edit_distances():
    entries = {"idiot": 3.0, "stupid": 2.0, "scum": 4.0, "stupor": 1.0, "abcab*": 5.0}
    fuzzy = {"idiot", "stupid", "stupor"}
    machine, rng = toxicity.Automaton(entries, fuzzy), random.Random(1)
    words = ["idiot", "idoit", "idiots", "diot", "xdiot", "ididot", "stupd", "stpuid", "scm", "scum", "abcabx", "abca", ""]
    words += ["".join(rng.choice("idotsup") for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    for word in words:
        exact, near, found = machine.match(word)
        want = max([w for e, w in entries.items() if e == word or e.endswith("*") and word.startswith(e[:-1])], default=0.0)
        close = sorted(e for e in fuzzy if edits(e, word) == 1)
        assert exact == want
        assert set(close) <= set(found) and all(edits(e, word) <= 1 for e in found)
        if not exact:
            assert near == max([entries[e] for e in close], default=0.0)


def test_context_tells_quotation_from_abuse():
    scorer = toxicity.Scorer({"idiot": 6.0}, frozenset({"idiot"}), frozenset({"idiom"}))
    plain, _ = scorer.features("you utter idiot go away")
    quoted, _ = scorer.features('he was named "an idiot" again')
    mention, _ = scorer.features("the word idiot comes from greek")
    unclosed, _ = scorer.features('an open " mark and an idiot here')
    assert plain[0] == 6.0 == unclosed[0] and quoted[0] == mention[0] == 6.0 * toxicity.QUOTED
    assert scorer.features("you idi0t!")[0][0] == pytest.approx(6.0 * toxicity.FUZZY)
    assert scorer.features("an idiom")[1] == 0 and scorer.features(None)[1] == 0 and scorer.features(" \n")[1] == 0


def test_stems_must_stand_for_several_words():
    rows = [("trash", 50, 0), ("tras*", 50, 0), ("blurka", 9, 0), ("blurke", 9, 0), ("blur*", 30, 0),
            ("blurk*", 30, 0), ("fine", 50, 50), ("rare", 2, 0)]
    assert set(toxicity.lexicon(rows, 100, 100)) == {"trash", "blur*"}


def held_out_rows(spark, name, column):
    got = catalog.SPARK[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    return got.filter("held_out").select("predicted", "score", F.col(column).alias("truth")).collect()


def test_toxicity_on_held_out_rows(spark):
    rows = held_out_rows(spark, "op1_toxicity_lexicon", "toxic")
    found = sum(r.predicted for r in rows if r.truth)
    assert found >= 0.6 * sum(r.truth for r in rows)
    assert sum(r.predicted for r in rows if not r.truth) <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_on_held_out_rows(spark):
    rows = held_out_rows(spark, "op2_quality_neighbours", "quality")
    assert sum(r.predicted == r.truth for r in rows) >= 0.93 * len(rows)
    assert sum(r.predicted for r in rows if r.truth) == sum(r.truth for r in rows)


def test_language_on_held_out_rows(spark):
    got = catalog.SPARK["op8_language_hierarchy"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    rows = got.filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)


def test_votes_agree_with_brute_force():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcd !#"), 60)) for _ in range(120)]
    terms = np.stack([quality.term_vector(t) for t in texts])
    labels = rng.integers(0, 2, 80)
    model = quality.Model(terms[:80], labels, rank=10, neighbours=5)
    latent = (terms * model.weight) @ model.basis
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    got = model.scores(terms[80:])
    for i, score in enumerate(got):
        cosine = [float(latent[80 + i] @ latent[j]) for j in range(80)]
        near = sorted(range(80), key=lambda j: -cosine[j])[:5]
        want = sum(max(0, cosine[j]) * labels[j] for j in near) / sum(max(0, cosine[j]) for j in near)
        assert score == pytest.approx(want, abs=1e-3)


def test_svm_separates():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (200, 8)).astype(np.float32)
    sign = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w = language.svm(x, sign)
    assert (np.sign(x @ w[:-1] + w[-1]) == sign).mean() > 0.97


def fixtures(spark):
    docs = [(None, "no id", "en"), (1, None, "en"), (2, "", None), (3, "12345 !!", "en"), (4, "the cat and the dog" * 2000, "en"),
            (4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr"), (6, "the house is the house", "en"),
            (7, "la maison est une maison", "fr"), (8, "you idiot", "en")]
    labels = [(i, 1, int(i == 8)) for i in range(1, 9)] + [(6, 0, 0), (None, 1, 1), (99, None, None)]
    return (spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS label", "5 AS held_out"),
            spark.createDataFrame(labels, LABELS).selectExpr("*", "'y' AS text"))


def test_nulls_ties_and_extra_columns(spark):
    docs, labels = fixtures(spark)
    for got in (quality.classify(docs, labels), toxicity.classify(docs, labels)):
        rows = got.collect()
        assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(rows) == 10
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    rows = language.identify(docs).collect()
    assert len(rows) == 10
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3} and all(r.lang_pred in ("en", "fr", "und") for r in rows)


@pytest.mark.parametrize("labelled", [False, True])
def test_empty_tables_and_no_labels(spark, labelled):
    docs, labels = fixtures(spark)
    empty, none = docs.limit(0), labels.limit(0)
    for classify in (quality.classify, toxicity.classify):
        assert classify(empty, labels if labelled else none).count() == 0
        assert {r.score for r in classify(docs, none).collect()} in ({0.5}, {0.0})
    assert language.identify(empty).count() == 0
    unknown = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for classify, column, modulus, rest in ((quality.classify, "quality", 5, 0), (toxicity.classify, "toxic", 4, 2)):
        hidden = fold(F.col("doc_id"), modulus) == rest
        flipped = labels.withColumn(column, F.when(hidden, 1 - F.col(column)).otherwise(F.col(column)))
        one, two = (classify(docs, x).select("doc_id", F.round("score", 6).alias("score")) for x in (labels, flipped))
        assert one.exceptAll(two).count() == 0


def test_quality_stage_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1))
    kept = quality.keep_good(docs, SF)
    assert kept.columns == docs.columns and 700 < kept.count() < 1000
    assert may_learn(F.lit(None), 4, 2) is not None


def test_nearest_takes_the_first_of_equal_values():
    rng = np.random.default_rng(0)
    for k in (1, 5, 15):
        values = rng.integers(0, 6, (200, 40)).astype(np.float32)
        want = [sorted(sorted(range(40), key=lambda i: (-row[i], i))[:k]) for row in values.tolist()]
        assert quality.nearest(values, k).tolist() == want
    assert quality.nearest(np.ones((3, 4096), np.float32), 15).tolist() == [list(range(15))] * 3


def test_good_rows_keep_any_column(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clash = docs
    for name in ("quality", "_quality", "__quality", "score"):
        clash = clash.withColumn(name, F.lit("kept"))
    got = quality.keep_good(clash, "/root/testdata/sf0.001")
    assert got.columns == clash.columns and {r.quality for r in got.collect()} == {"kept"}
    assert got.count() == quality.keep_good(docs, "/root/testdata/sf0.001").count()


def test_a_frequent_language_keeps_its_share_of_the_sample():
    """Rows beyond 2**24 times the sample must not round the cut to nothing."""
    for count in (10, 10 ** 11, 10 ** 15):
        assert 0 < min(language.CUTS, language.CUTS * 800 // count) <= language.CUTS


def test_calibration_rows_are_bounded_where_keys_repeat(spark, monkeypatch):
    """Thirty labelled keys with many rows each: the driver gets the sample's bound, not all rows."""
    rows = [(k, f"you scum idiot {k} {i}" if k % 2 else f"a calm walk {k} {i}") for k in range(30) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_PER_LABEL", 30)
    monkeypatch.setattr(toxicity, "_calibrate", lambda x, y, share: seen.append(len(x)) or np.zeros(5))
    toxicity.fit(docs, labels)
    assert seen and seen[0] <= 60 < 300
