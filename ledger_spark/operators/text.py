"""Text features.

Tokens are kept as an array column per row (the row's own id is the stable
row id, E4). Presence features never explode the text: the row's token array
is intersected with the (bounded) vocabulary array first -- a hash set
operation linear in the row's length -- and the 0/1 columns read that small
intersection. Only the vocabulary count explodes tokens, and it reduces them
with a map-side partial count before the shuffle, so a very frequent word
costs one row per task, not one per occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.text import tokens as token_array
from ledger_spark.functions.text import tokens_among
from ledger_spark.schema import VOCAB_SIZE
from ledger_spark.session import materialize


def tokenize(df: DataFrame, id_col: str = "id", text_col: str = "description") -> DataFrame:
    """H1: long form (row id, word): lower-case, split on non-letters/digits,
    drop all-digit tokens."""
    return df.select(F.col(id_col).alias("row_id"), F.explode(token_array(text_col)).alias("word"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """Occurrences per word (partial + final count)."""
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(tokens: DataFrame, n: int = VOCAB_SIZE) -> DataFrame:
    """The ``n`` most frequent words; ties alphabetical (top-n plan)."""
    return token_counts(tokens).orderBy(F.col("n").desc(), F.col("word").asc()).limit(n)


#: Words that the sketch of :func:`frequent_words` tracks.
TRACKED = 16_384


def sure_count(n_tokens: int, tracked: int = TRACKED) -> float:
    """A word that occurs more often than this is surely reported by the sketch.

    A frequent-items sketch over a table of ``m`` slots (the power of two above
    tracked / 0.75) misjudges a count by at most 3.5 n / m, and reports every word
    whose lower bound lies above that error: surely those above twice the error.
    """
    slots = 1
    while slots * 0.75 < tracked:
        slots *= 2
    return 7.0 * n_tokens / slots


def frequent_words(tokens: DataFrame, n: int = VOCAB_SIZE, tracked: int = TRACKED) -> DataFrame:
    """D14 without a shuffle of all distinct words: exactly :func:`vocabulary`, in two passes.

    A mergeable frequent-items sketch (Spark's ``approx_top_k``) of all tokens names at
    most ``tracked`` candidates; they alone are counted exactly. If the n-th count is one
    that the sketch cannot have missed, no other word can belong to the result, ties
    included. Otherwise (flat distributions) every word is counted.
    """
    spark = tokens.sparkSession
    sketch = tokens.agg(F.expr(f"approx_top_k(word, {tracked}, {tracked})").alias("top"), F.count("word").alias("n")).first()
    found = spark.createDataFrame([(r["item"],) for r in sketch["top"] or []], "word string")  # at most `tracked`
    counts = materialize(token_counts(tokens.join(found, "word", "left_semi")))
    best = counts.orderBy(F.col("n").desc(), F.col("word").asc()).limit(n)
    least = best.agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("rows")).first()
    if least["rows"] == n and least["least"] > sure_count(sketch["n"], tracked):
        return best
    return vocabulary(tokens, n)


def vocabulary_list(tokens: DataFrame, n: int = VOCAB_SIZE) -> list[str]:
    """The vocabulary as a driver-side list (bounded by ``n``): it parameterises
    the feature columns, like any fitted model's parameters."""
    return [r["word"] for r in vocabulary(tokens, n).collect()]  # at most n rows (top-n)


def present_words(df: DataFrame, vocab: list[str], text_col: str = "description",
                  out_col: str = "words") -> DataFrame:
    """Row's vocabulary words as a small array (C7 done per row: a semi-join of
    the row's tokens against the vocabulary)."""
    v = F.array(*[F.lit(w) for w in vocab]) if vocab else F.array().cast("array<string>")
    return df.withColumn(out_col, F.array_intersect(token_array(text_col), v))


def word_numbers(df: DataFrame, vocab: list[str], words_col: str = "words", out_col: str = "_numbers") -> DataFrame:
    """The row's vocabulary words as their positions in the vocabulary."""
    v = F.array(*[F.lit(w) for w in vocab]) if vocab else F.array().cast("array<string>")
    return df.withColumn(out_col, F.transform(words_col, lambda w: F.array_position(v, w).cast("int") - 1))


def document_term_matrix(df: DataFrame, vocab: list[str], id_col: str = "id",
                         text_col: str = "description") -> DataFrame:
    """One 0/1 column per vocabulary word (column name = the word)."""
    p = present_words(df, vocab, text_col, "_w")
    return p.select(id_col, *[F.array_contains("_w", w).cast("int").alias(w) for w in vocab])


def bag_of_words(df: DataFrame, vocab: list[str], text_col: str = "description",
                 out_col: str = "bow", words_col: str | None = None):
    """H3: binary presence as a sparse vector (MLlib ``CountVectorizerModel``), of the
    text's tokens (those outside the vocabulary never reach it) or of an array of words
    that is there already."""
    from pyspark.ml.feature import CountVectorizerModel

    cv = CountVectorizerModel.from_vocabulary(vocab, inputCol=words_col or "_tok", outputCol=out_col, binary=True)
    if words_col:
        return cv.transform(df)
    return cv.transform(df.withColumn("_tok", tokens_among(text_col, vocab))).drop("_tok")
