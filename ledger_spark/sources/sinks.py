"""Sinks (A11, A12): CSV export and the nested JSON model summary.

Both write distributed output (one file per partition) to a folder; nothing
is gathered on the driver except the handful of summary rows of A12, which
are aggregates already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Header CSV, overwriting; values written verbatim (no whitespace
    trimming, so cleaning rules can be exercised on read-back)."""
    (df.write.mode("overwrite").option("header", header)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def summary_document(comparison: DataFrame, per_class: DataFrame, best_model: str,
                     best_accuracy: DataFrame) -> DataFrame:
    """A12 as a one-row frame: model_comparison[], best_model, best_accuracy,
    per_class[] -- assembled with collect_list(struct) on the executors."""
    cmp_arr = comparison.agg(F.collect_list(F.struct("attempt", "accuracy")).alias("model_comparison"))
    pc = per_class.agg(F.collect_list(F.struct(
        F.col("class"), F.col("precision").alias("Precision"), F.col("recall").alias("Recall"),
        F.col("f1").alias("F1"))).alias("per_class"))
    best = best_accuracy.select(F.col("accuracy").alias("best_accuracy"))
    # three one-row aggregates glued on a constant key (equi-join, one row each)
    return (cmp_arr.withColumn("_k", F.lit(1))
            .join(pc.withColumn("_k", F.lit(1)), "_k")
            .join(best.withColumn("_k", F.lit(1)), "_k")
            .select("model_comparison", F.lit(best_model).alias("best_model"), "best_accuracy", "per_class"))


def write_summary_json(doc: DataFrame, path: str) -> None:
    """The summary document as JSON (one line)."""
    doc.coalesce(1).write.mode("overwrite").json(path)
