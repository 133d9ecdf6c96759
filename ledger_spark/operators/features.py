"""Feature engineering and the exact stratified split.

The split is exact (the first ceil(0.8 n_c) rows of each class in a seeded
hash order go to training) yet never sorts a whole class in one task: a
histogram of the hash's top 16 bits per class (one small aggregate) locates
the boundary bucket of each class, and the ids inside it (about n_c / 65536 of
them) are ranked to find the class's exact (hash, id) threshold. Both passes read
ids and labels only. The rows themselves, texts and all, are read once and decided
by comparison with their class's threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledger_spark.functions.rules import amount_bucket, is_large, is_round, log_amount
from ledger_spark.schema import BUCKET_LABELS
from ledger_spark.session import materialize


def amount_features(df: DataFrame, amount_col: str = "amount") -> DataFrame:
    """B14 + B15: log_amount, is_round, is_large, amount_bucket."""
    return df.withColumns({
        "log_amount": log_amount(amount_col), "is_round": is_round(amount_col),
        "is_large": is_large(amount_col), "amount_bucket": amount_bucket(amount_col)})


def bucket_columns() -> list[str]:
    return [f"amount_bucket{b}" for b in BUCKET_LABELS]


def one_hot_bucket(df: DataFrame, bucket_col: str = "amount_bucket") -> DataFrame:
    """Six indicator columns, always all levels, in level order."""
    return df.withColumns({f"amount_bucket{b}": (F.col(bucket_col) == b).cast("int") for b in BUCKET_LABELS})


def split_key(id_col: str = "id", seed: int = 42):
    """Seeded, engine-independent order key: md5 of ``"<seed>:<id>"``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_split(df: DataFrame, label: str = "category", p_num: int = 4, p_den: int = 5,
                     seed: int = 42, id_col: str = "id") -> DataFrame:
    """H5: add ``split`` = train/test; per class the first ceil(p*n) rows in
    md5 order (ties by id) are training rows. p = p_num / p_den.
    """
    out_cols = [F.col(c) for c in df.columns]
    # internal class key: text, with NULL labels kept as a class of their own
    df = df.withColumns({"_lab": F.coalesce(F.col(label).cast("string"), F.lit("\u0000")),
                         "_h": split_key(id_col, seed)})
    keys = df.select("_lab", "_h", F.col(id_col).alias("_id")).withColumn(
        "_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    hist = keys.groupBy("_lab", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy("_lab").orderBy("_b")  # per class: <= 65536 histogram rows
    hist = (hist.withColumn("_cum", F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_tot", F.sum("_cnt").over(Window.partitionBy("_lab"))))
    hist = hist.withColumn("_k", F.expr(f"(({p_num} * _tot + {p_den} - 1) div {p_den})"))
    bound = materialize(hist.where(F.col("_cum") >= F.col("_k")).groupBy("_lab").agg(
        F.min_by(F.struct("_b", (F.col("_k") - F.col("_cum") + F.col("_cnt")).alias("_need")), "_b").alias("_x"))
        .select("_lab", F.col("_x._b").alias("_b"), F.col("_x._need").alias("_need")))
    inside = keys.join(bound, ["_lab", "_b"])
    rank = F.row_number().over(Window.partitionBy("_lab").orderBy("_h", "_id"))
    # one row per class in a table of known size
    last = materialize(inside.withColumn("_r", rank).where(F.col("_r") == F.col("_need"))
                       .select("_lab", F.struct("_h", "_id").alias("_last")))
    j = df.join(last, "_lab", "left")
    in_train = F.struct(F.col("_h"), F.col(id_col).alias("_id")) <= F.col("_last")
    return j.select(*out_cols, F.when(in_train, "train").otherwise("test").alias("split"))


def feature_names(vocab: list[str], with_bucket: bool = True) -> list[str]:
    """Names of :func:`build_features`' vector slots."""
    return [*vocab, "log_amount", "is_round", "is_large", *(bucket_columns() if with_bucket else [])]


def build_features(df: DataFrame, vocab: list[str], with_bucket: bool = True,
                   text_col: str = "description", amount_col: str = "amount",
                   out_col: str = "features", words_col: str | None = None) -> DataFrame:
    """H4: words (sparse binary) + log_amount, is_round, is_large (+ the six
    bucket indicators) assembled into one vector. With ``words_col`` (the row's
    vocabulary words, see ``present_words``) the text is not tokenised again."""
    from pyspark.ml.feature import VectorAssembler

    from ledger_spark.operators.text import bag_of_words

    f = one_hot_bucket(amount_features(bag_of_words(df, vocab, text_col, "bow", words_col), amount_col))
    inputs = ["bow", "log_amount", "is_round", "is_large"] + (bucket_columns() if with_bucket else [])
    return VectorAssembler(inputCols=inputs, outputCol=out_col).transform(f)
