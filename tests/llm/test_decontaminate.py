"""Decontamination against brute-force edit distances."""

import random

import numpy as np
import pytest

from ledger_spark.llm import decontaminate as D

DOCS = "doc_id long, text string, source string"
ITEMS = "item_id long, text string"


def least_edits(item, text):
    """Semi-global edit distance, the plain way."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeghilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def noisy(text, edits, seed):
    rng, s = random.Random(seed), list(text)
    for _ in range(edits):
        p = rng.randrange(len(s))
        kind = rng.random()
        if kind < 0.4:
            s[p] = rng.choice("xyz")
        elif kind < 0.7:
            s.insert(p, rng.choice("xyz"))
        else:
            del s[p]
    return "".join(s)


@pytest.mark.parametrize("seed", range(6))
def test_search_agrees_with_brute_force(seed):
    items = [(i, words(20, 100 * seed + i)) for i in range(4)]
    index = D.Index(items)
    texts = []
    for k in range(12):
        item = items[k % 4][1]
        texts.append(words(30, 7 * k + seed) + " " + noisy(item, 2 * (k // 2), k + seed) + " " + words(15, k))
    for text, hits in zip(texts, D.search(texts, index)):
        found = {index.ids[i] for i, *_ in hits}
        codes = D.normalise(text)[0].tolist()
        for n, (key, _) in enumerate(items):
            assert (key in found) == (least_edits(index.codes[n].tolist(), codes) <= index.edits[n])


def test_banded_alignment_agrees_with_the_plain_distance():
    rng = random.Random(5)
    for _ in range(60):
        item = [rng.randrange(4) for _ in range(rng.randint(8, 30))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 60))]
        plain = least_edits(item, text)
        found = D.banded(np.array(item, np.uint32), np.array(text, np.uint32), -len(item), len(text), len(item))
        assert found[0] == plain
        assert least_edits(item, text[found[1]:found[2]]) == plain


def test_pieces_of_a_long_text_overlap(monkeypatch):
    item = words(25, 1)
    text = words(300, 2) + " " + item.upper().replace(" ", " ... ") + " " + words(300, 3)
    whole = D.search([text], D.Index([(1, item)]))
    monkeypatch.setattr(D, "PIECE", 64)
    assert D.search([text], D.Index([(1, item)])) == whole and len(whole[0]) == 1
    _, start, end, edits = whole[0][0]
    assert edits == 0 and text[start:end] == item.upper().replace(" ", " ... ")


def test_nulls_short_items_repeats_and_columns(spark):
    item = words(20, 9)
    docs = spark.createDataFrame([(1, "x " + item + " y", "a"), (1, "x " + item + " y", "a"), (2, None, "a"), (3, "", None),
                                  (None, item, "b"), (4, words(50, 8), "b")], DOCS).selectExpr("*", "7 AS item_id")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "tiny"), (None, item)], ITEMS)
    got = sorted(((r.doc_id, r.item_id) for r in D.matches(docs, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 1, None) for i in (10, None)], key=str)


def test_chunks_find_the_same(spark):
    bench = spark.createDataFrame([(i, words(20, i)) for i in range(8)], ITEMS)
    assert sum(len(x.ids) for x in D.chunks(bench, chunk_chars=200)) == 8


def test_drop_contaminated(spark, tmp_path):
    item = words(20, 9)
    docs = spark.createDataFrame([(1, "x " + item, "a"), (2, None, "a"), (3, words(40, 4), "b")], DOCS)
    spark.createDataFrame([(10, item)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = D.drop_contaminated(docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_empty_tables(spark):
    empty, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    item = spark.createDataFrame([(1, words(20, 1))], ITEMS)
    one = spark.createDataFrame([(1, words(20, 1), "a")], DOCS)
    for found in (D.matches(empty, bench), D.matches(empty, item), D.matches(one, bench)):
        assert found.columns == ["doc_id", "item_id", "start", "end", "edits"] and found.count() == 0
