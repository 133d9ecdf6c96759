"""Brown-class scores: counts and base score against plain Python, exchange against full likelihoods."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ledger_spark.llm import brown

DOCS = "doc_id long, text string, n long"


def test_exchange_gains_are_those_of_the_full_likelihood():
    rng = np.random.default_rng(1)
    table = rng.poisson(1.5, (13, 13)).astype(np.int64)
    words, k = 10, 3
    total = 1 + k + 2
    first = brown.exchange(table, words, k, rounds=0)
    done = brown.exchange(table, words, k, rounds=50)
    assert brown.likelihood(table, done, total) >= brown.likelihood(table, first, total)
    for w in range(1, words + 1):  # no single move is left that gains
        for c in range(1, k + 1):
            moved = done.copy()
            moved[w] = c
            assert brown.likelihood(table, moved, total) <= brown.likelihood(table, done, total) + 1e-6
    assert done[0] == 0 and done[11:].tolist() == [4, 5]


def test_transitions_sum_to_one():
    p = 10 ** brown.transitions(np.array([[3.0, 0, 1], [0, 0, 0], [2, 2, 2]]))
    assert np.allclose(p.sum(axis=1), 1)


@pytest.mark.parametrize("head,clustered", [(40_000, 1000), (6, 3)])
def test_scores_against_plain_python(spark, head, clustered):
    """With a small head, most words take the way over the vocabulary table."""
    texts = [f"The cat{i % 5} sat on THE mat, and dog{i % 7} ran; x{i} Éa éa" for i in range(60)] + [None, "", " \t\n"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "the cat1 again", 2)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1.0 AS score")
    learn = docs.filter(brown.may_learn(docs.doc_id, 7, 2)).select("text")
    model, vocab = brown.fit(learn, head, clustered, 4)
    got = brown.score(docs.select("doc_id", "text"), model, vocab).collect()
    count = Counter()
    for i, t, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            count.update((t or "").encode().lower().split() + [b""])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t, _ in rows:
        words = (t or "").encode().lower().split() + [b""]
        want.append((i, len(words), sum(count[w] > 0 for w in words), n,
                     round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), 6)))
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) \
        == sorted(want, key=str)
    assert all(r.score < 0 for r in got)


def test_the_way_a_word_takes_does_not_change_its_score(spark):
    """Words scored by the worker and by the vocabulary table score the same."""
    rows = [(i, f"aa bb cc{i % 9} dd{i % 4} ee{i} ,", 1) for i in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    scores = []
    for head in (5, 1000):
        model, vocab = brown.fit(docs.select("text").filter("doc_id < 60"), head, 5, 3)
        scores.append(sorted((r.doc_id, round(r.score, 6)) for r in brown.score(docs.select("doc_id", "text"), model, vocab).collect()))
    assert scores[0] == scores[1]


def test_emissions_and_unseen_words_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"aa bb cc{i % 9} dd{i % 4} ee{i} ,", 1) for i in range(50)], DOCS)
    model, vocab = brown.fit(docs.select("text"), 4, 4, 2)
    rows = [r for r in vocab.collect() if r.open >= 0]
    clustered = {w.decode() for w in list(model.word)[:4]}
    for c in range(brown.OPEN):
        mine = [r.n for r in rows if r.open == c and r.word not in clustered]
        if mine:
            size = 10 ** model.open_size[c]
            assert sum(mine) / size + 10 ** model.open_unseen[c] / size == pytest.approx(1)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert brown.score_held_out(empty).count() == 0
    only = spark.createDataFrame([(13, "held out only", 1)], DOCS)  # crc32('13') mod 7 is 2
    row = brown.score_held_out(only).first()
    assert zlib.crc32(b"13") % 7 != 2 or (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)


def test_held_out_rows_score_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = brown.score_held_out(docs).filter("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert got.s > got.b


def _learned(spark, texts, head=40, clustered=4, k=3):
    learn = spark.createDataFrame([(t,) for t in texts], "text string")
    model, vocab = brown.fit(learn, head, clustered, k)
    cls = {r.word.encode(): r.cls for r in vocab.collect()}
    seeds = model.word[:clustered]
    return model, {**cls, **dict(zip(seeds, model.classes[1:]))}, [w for w in cls if w not in seeds]


CONTEXTS = [f"the {w} is a w{i}x of {v}ing, the q{i % 3}" for i in range(40)
            for w, v in ((f"cat{'abcdefgh'[i % 8]}", "run"),)] + ["is ruby a the garnet of is a", None, " "]


@pytest.mark.parametrize("head", [4, 9, 1000])
def test_every_training_word_is_in_the_class_of_its_greatest_gain(spark, head):
    """Words beyond the seeds, by whichever way they come, against contexts counted in plain Python."""
    clustered, k = 4, 3
    model, cls, tail = _learned(spark, CONTEXTS, head)
    count, words = Counter(), [[b"", *(t or "").encode().lower().split(), b""] for t in CONTEXTS]
    count.update(w for text in words for w in text[1:])
    assert set(cls) == set(count) - {b""}
    seeds = sorted((w for w in count if w), key=lambda w: (-count[w], w))[:clustered]
    assert seeds == model.word[:clustered]
    start = {b"": 0, **{w: cls[w] for w in seeds}}
    start.update({w: 1 + k + brown.open_class(w) for w in tail})
    table, final = np.zeros((1 + k + brown.OPEN,) * 2), np.zeros((1 + k + brown.OPEN,) * 2)
    near = {w: np.zeros(2 * len(table)) for w in tail}
    for text in words:
        for a, b in zip(text, text[1:]):
            table[start[a], start[b]] += 1
            final[{b"": 0, **cls}[a], {b"": 0, **cls}[b]] += 1
            if b in near:
                near[b][start[a]] += 1
            if a in near:
                near[a][len(table) + start[b]] += 1
    gain = brown.gains(table)
    assert {w: 1 + int(np.argmax(near[w] @ gain)) for w in tail} == {w: cls[w] for w in tail}
    assert np.allclose(model.steps[:len(final), :len(final)], brown.transitions(final))


def test_rare_words_of_one_spelling_part_by_their_neighbours(spark):
    texts = ["red bib to", "to did red"] * 30
    texts += [f"red {x}{y}b to" for x in "abcdefgh" for y in "xyz"] + [f"to {x}{y}d red" for x in "abcdefgh" for y in "xyz"]
    _, cls, tail = _learned(spark, texts, clustered=4, k=4)
    assert len({brown.open_class(w) for w in tail}) == 1 and len(tail) == 48
    assert {cls[w] for w in tail if w.endswith(b"b")} == {cls[b"bib"]}
    assert {cls[w] for w in tail if w.endswith(b"d")} == {cls[b"did"]} != {cls[b"bib"]}


def test_what_follows_any_word_sums_to_one(spark):
    """All training words, the end mark and one unseen word per spelling, after every class and spelling."""
    model, cls, tail = _learned(spark, CONTEXTS, head=9)
    count = Counter(w for t in CONTEXTS for w in (t or "").encode().lower().split())
    emit = {w: model.emit[model.word.index(w) + 1] if w in model.word
            else math.log10(count[w]) + model.share[cls[w], brown.open_class(w)] for w in count}
    for row in model.steps:
        seen = sum(10 ** (row[cls[w]] + emit[w]) for w in count)
        assert seen + 10 ** row[0] + (10 ** row[model.k:]).sum() == pytest.approx(1)


def test_score_is_the_sum_of_its_steps(spark):
    model, cls, _ = _learned(spark, CONTEXTS, head=9)
    learn = spark.createDataFrame([(t,) for t in CONTEXTS], "text string")
    _, vocab = brown.fit(learn, 9, 4, 3)
    count = Counter(w for t in CONTEXTS for w in (t or "").encode().lower().split())
    texts = ["the cata is a w1x new words, 77 w2x", "", "unseen", "garnet ruby w3x w4x of", CONTEXTS[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in brown.score(docs, model, vocab).collect()}
    for i, text in enumerate(texts):
        at, total = 0, 0.0
        for w in [*text.encode().lower().split(), b""]:
            c = 0 if not w else cls.get(w, model.k + brown.open_class(w))
            total += model.steps[at, c]
            if w in model.word:
                total += model.emit[model.word.index(w) + 1]
            elif w in cls:
                total += math.log10(count[w]) + model.share[c, brown.open_class(w)]
            at = c
        assert got[i] == pytest.approx(total, abs=1e-9)


def test_numbers_of_texts_are_shuffled_as_bytes(spark):
    """Frequent words take one byte, and a word beyond the head eight for its neighbours."""
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 2**28 - 1, 2**28, 2**31 - 1, 5])
    texts = brown.packed(numbers, np.array([0, 0, 3, 3, 11, 12, 12]))
    assert [len(x.as_py()) for x in texts] == [0, 3, 0, 2 + 2 + 3 + 3 + 4 + 4 + 5 + 5, 1, 0]
    for at in range(len(texts) + 1):
        got, sizes = brown.unpacked(texts.slice(at))
        assert sizes.tolist() == [0, 3, 0, 8, 1, 0][at:] and got.tolist() == numbers[len(numbers) - sum(sizes):].tolist()
    assert [x.tolist() for x in brown.unpacked(brown.packed(numbers[:0], np.array([0, 0])))] == [[], [0]]
    docs = spark.createDataFrame([("aa bb aa cc aa dd",), (None,)], "text string")
    lexicon = brown.Lexicon([(b"aa", 3), (b"bb", 1)], 1, 2)
    rows = brown.coded(docs, lexicon)
    assert sorted((bytes(r.ids), r.rest) for r in rows.collect()) == [(b"", []), (b"\x01\x02\x01\x03\x01\x03", ["cc", "dd"])]
    near = brown.contexts(rows, lexicon, np.arange(3 + brown.OPEN), 3 + brown.OPEN).collect()
    assert {r.word: (r.id, len(r.near)) for r in near} == {"bb": (2, 8), "cc": (3, 8), "dd": (3, 8)}
