"""Classifier evaluation.

Everything derives from one grouped count of (predicted, actual) pairs --
at most classes^2 rows -- so the metrics cost one pass over the scored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledger_spark.session import materialize


def pair_counts(scored: DataFrame, pred: str, actual: str = "category") -> DataFrame:
    return scored.groupBy(F.col(pred).alias("predicted"), F.col(actual).alias("actual")).agg(
        F.count(F.lit(1)).alias("n"))


def stacked_counts(scored: DataFrame, attempts: list[tuple], actual: str = "category") -> DataFrame:
    """Counts of (attempt, scope, predicted, actual) for several predictions of the same
    rows, from one pass: at most attempts x classes^2 rows.

    An attempt is ``(name, scope, prediction column, condition)``: the rows it is
    measured on are those where the condition holds (None: all).
    """
    each = []
    for name, scope, pred, on in attempts:
        row = F.struct(F.lit(name).alias("attempt"), F.lit(scope).alias("scope"),
                       F.col(pred).cast("string").alias("predicted"), F.col(actual).cast("string").alias("actual"))
        each.append(row if on is None else F.when(on, row))
    return (scored.select(F.explode(F.array_compact(F.array(*each))).alias("a")).select("a.*")
            .groupBy("attempt", "scope", "predicted", "actual").agg(F.count(F.lit(1)).alias("n")))


def compare_attempts(counts: DataFrame) -> DataFrame:
    """D22 / H10 from :func:`stacked_counts`: one row per attempt, accuracy in % to 1 dp."""
    right = F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0))
    return counts.groupBy("attempt", "scope").agg(F.round(right / F.sum("n") * 100, 1).alias("accuracy"))


def _confusion(counts: DataFrame, labels: list[str]) -> DataFrame:
    spark = counts.sparkSession
    grid = spark.createDataFrame([(p, a) for p in labels for a in labels], "predicted string, actual string")
    return (grid.join(counts.select("predicted", "actual", "n"), ["predicted", "actual"], "left")
            .select("predicted", "actual", F.coalesce("n", F.lit(0)).alias("n")))


def confusion_matrix(scored: DataFrame, pred: str, labels: list[str], actual: str = "category") -> DataFrame:
    """Predicted x actual counts, zero-filled, fixed label order (long form)."""
    return _confusion(pair_counts(scored, pred, actual), labels)


def confusion_matrix_wide(scored: DataFrame, pred: str, labels: list[str], actual: str = "category"):
    """D18 in the printed (pivoted) shape: one row per predicted label."""
    return (scored.groupBy(F.col(pred).alias("predicted")).pivot(actual, labels)
            .agg(F.count(F.lit(1))).na.fill(0))


def accuracy(scored: DataFrame, pred: str, actual: str = "category") -> DataFrame:
    """Share of rows with pred == actual."""
    return scored.agg(F.avg(F.when(F.col(pred) == F.col(actual), 1.0).otherwise(0.0)).alias("accuracy"))


def per_class_metrics(scored: DataFrame, pred: str, labels: list[str], actual: str = "category") -> DataFrame:
    """Precision, recall, F1 (NULL when undefined) and the other per-class
    statistics of a confusion report."""
    return _per_class(pair_counts(scored, pred, actual), labels)


def _per_class(counts: DataFrame, labels: list[str]) -> DataFrame:
    cm = _confusion(counts, labels)
    total = F.sum("support").over(Window.partitionBy())  # over <= #classes rows
    tp = cm.groupBy(F.col("actual").alias("class")).agg(
        F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"))
    pp = cm.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("pred_pos"))
    j = tp.join(pp, "class").withColumn("total", total)
    tpc, sup, ppos, tot = F.col("tp"), F.col("support"), F.col("pred_pos"), F.col("total")
    fp, fn = ppos - tpc, sup - tpc
    tn = tot - tpc - fp - fn
    prec = tpc / F.nullif(ppos, F.lit(0))
    rec = tpc / F.nullif(sup, F.lit(0))
    spec = tn / F.nullif(tn + fp, F.lit(0))
    f1 = 2 * prec * rec / F.nullif(prec + rec, F.lit(0.0))
    return j.select(
        "class", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), rec.alias("sensitivity"),
        spec.alias("specificity"), prec.alias("ppv"), (tn / F.nullif(tn + fn, F.lit(0))).alias("npv"),
        (sup / tot).alias("prevalence"), (tpc / tot).alias("detection_rate"),
        (ppos / tot).alias("detection_prevalence"), ((rec + spec) / 2).alias("balanced_accuracy"),
        sup.alias("support"))


def overall_metrics(scored: DataFrame, pred: str, actual: str = "category") -> DataFrame:
    """Accuracy, no-information rate (largest class share) and Cohen's kappa."""
    return _overall(pair_counts(scored, pred, actual))


def _overall(pc: DataFrame) -> DataFrame:
    rows = pc.groupBy(F.col("actual").alias("c")).agg(
        F.sum("n").alias("a"), F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0))
        .alias("tp"))
    cols = pc.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("p"))
    a, p, tp = (F.coalesce(x, F.lit(0)) for x in (F.col("a"), F.col("p"), F.col("tp")))
    j = rows.join(cols, "c", "full").agg(
        F.sum(a).alias("t"), F.sum(tp).alias("d"), F.sum(a * p).alias("ap"), F.max(a).alias("amax"))
    po = F.col("d") / F.col("t")
    pe = F.col("ap") / (F.col("t") * F.col("t"))
    return j.select(po.alias("accuracy"), (F.col("amax") / F.col("t")).alias("no_information_rate"),
                    ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"), F.col("t").alias("n"))


def model_comparison(results: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """One row per attempt: the rows it was measured on, accuracy in % to 1 dp."""
    out = None
    for name, acc, scope in results:
        row = acc.select(F.lit(name).alias("attempt"), F.lit(scope).alias("scope"),
                         F.round(F.col("accuracy") * 100, 1).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


def evaluate(scored: DataFrame, pred: str, labels: list[str], actual: str = "category") -> dict:
    """H9: the full evaluation of one scored frame (D18-D21) as named frames."""
    return evaluate_counts(materialize(pair_counts(scored, pred, actual)), labels)


def evaluate_counts(counts: DataFrame, labels: list[str]) -> dict:
    """H9 from counts of (predicted, actual), such as one attempt's :func:`stacked_counts`."""
    right = F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0))
    return {"confusion": _confusion(counts, labels), "accuracy": counts.agg((right / F.sum("n")).alias("accuracy")),
            "per_class": _per_class(counts, labels), "overall": _overall(counts)}
