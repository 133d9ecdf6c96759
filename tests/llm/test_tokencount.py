"""Token counts against the tokenizer's own encoding."""

import pytest
from pyspark.sql import functions as F

from ledger_spark.llm import tokencount
from ledger_spark.llm.catalog import SPARK
from tests.conftest import SF_SMALL

ODD = [
    None, "", " \t\n\x0b\x0c\r", "Hello, don't STOP it's we'LL 'S''t 123 45.6", "a<|endoftext|>b <|startoftext|><|endoftext|>",
    "<|ENDOFTEXT|> <|end <|endoftext|", "J̌ǰ H̱ Å K İstanbul ΣΑΣ ς ẞ ﬁ", "日本語 テスト 한국어 ١٢٣ ½ Ⅷ",
    "a b c d\x1ce\x85f　g", "\x00\x01 x\x7fy ​zero‍width", "😀👩‍👩‍👧 é ́x ̈",
    "x" * 20000, "'" * 3000, "word " * 5000, "<|endoftext|>" * 50, "tab\tsep  two", "don''t'd 's<|endoftext|>'t",
]


def library(texts, path=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or tokencount.tokenizer_path())
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def counted(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()), key=str)


def wanted(rows, limit=2048, path=None):
    return sorted(((i, len((t or "").encode()), n, n > limit)
                   for (i, t), n in zip(rows, library([t for _, t in rows], path))), key=str)


def test_the_query_equals_the_library_on_every_given_document(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert counted(SPARK["op13_token_counts"](spark, SF_SMALL)) == wanted(rows)


@pytest.mark.parametrize("head", [1, 40, tokencount.HEAD])
def test_odd_texts_repeats_and_clashing_names(spark, head):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "no id"), (3, "other text, same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "piece", "pieces", "n", "rest", "sure", "id", "n_tokens"):
        docs = docs.withColumn(name, F.lit("x"))
    assert counted(tokencount.token_counts(docs, head=head)) == wanted(rows)


def test_a_hot_word_and_text_keys(spark):
    rows = [(f"d{i}", "the " * (i % 7) + f"the rare{i % 50}word") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert counted(tokencount.token_counts(docs, limit=6, head=10)) == wanted(rows, 6)


def test_a_tokenizer_that_keeps_white_space(spark):
    path = tokencount.tokenizer_path("byte_bpe_50k.json")
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not tokencount.Cutter(path).by_word
    assert counted(tokencount.token_counts(docs, path=path, head=20)) == wanted(rows, path=path)


def test_the_plain_cut_equals_the_tokenizers(spark):
    """Every pair of printable ASCII, Latin letters in all surroundings, beside the library's cut."""
    own = tokencount.Cutter(tokencount.tokenizer_path())
    assert own.by_word and own.knows_simple and {ord(c) for c in "azAZéÉñßüÿÀſ"} <= own.shown.keys()
    assert not {0x130, 0xD7, 0xF7} & own.shown.keys()
    marks = [chr(c) for c in range(33, 127)]
    latin = [chr(c) for c in range(0xA0, 0x250)]
    words = [a + b for a in marks for b in marks] + [a + "'" + b + c for a in "aA1'!é" for b in "sStTrRvVmMlLdDÉ" for c in "eElLx1'ö"]
    words += [x for c in latin for x in (c, c + "a", "A" + c, "é" + c + "Ö", "1" + c, "'" + c, c + "'s", "." + c + "!", c + "\u0301")]
    for w in words:
        assert own.word(w.encode()) == (0, tuple(own._own(w))), w


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = tokencount.token_counts(docs)
    assert got.collect() == [] and got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_pieces_are_counted_once_per_distinct_pre_token(spark):
    docs = spark.createDataFrame([(i, "one two two three") for i in range(100)], "doc_id long, text string")
    vocab = tokencount.vocabulary(docs)
    assert {(r.piece, r.n) for r in vocab.collect()} == {("one", 100), ("two", 200), ("three", 100)}


def test_a_known_word_is_looked_up_and_not_cut_again(spark, monkeypatch):
    """Letters, alone or before one mark, need no search; a word is cut once however many texts hold it."""
    own = tokencount.Cutter(tokencount.tokenizer_path())
    words = ["Hello", "x", "WORLD,", "a1", "it'", "Zq%", "T>"]
    want = {w: (0, tuple(own._own(w))) for w in words}
    calls = []
    monkeypatch.setattr(own, "cut", lambda text: calls.append(text) or (0, [text]))
    monkeypatch.setattr(own, "plain", None)
    monkeypatch.setattr(own, "simple", None)
    assert {w: own.word(w.encode()) for w in words} == want
    cuts = []
    cut = own.cut_word
    monkeypatch.setattr(own, "cut_word", lambda word: cuts.append(word) or cut(word))
    sure = tokencount.Sure(own, {"hello": 1, ",": 1, "world": 2})
    assert [sure.text(b"Hello WORLD, rare rare, hello") for _ in range(3)] == [(6, {"rare": 2})] * 3
    assert len(cuts) == 5 and calls == []
