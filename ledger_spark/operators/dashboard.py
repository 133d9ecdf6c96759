"""Dashboard panels for a selected month.

Every panel is a small aggregate of the fact table filtered by a date range
(pushed down to the Parquet scan). The per-category series panels work on
(category, month) totals, whose size is bounded by categories x months; the
"last n months" logic is a window over those totals, never over facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledger_spark.functions.dates import in_month, month_key, month_label, month_start, previous_month
from ledger_spark.functions.money import mean_money, round_money


def _with_names(df: DataFrame, categories: DataFrame, *extra: str, how: str = "inner") -> DataFrame:
    """Category name (and ``extra`` columns) by ``category_id``."""
    from ledger_spark.operators.joins import attach

    dim = categories.select("id", F.col("name").alias("category"), *extra)
    return attach(df, dim, "category_id", "id", ["category", *extra], how)


def period(t: DataFrame, categories: DataFrame, month: str | None) -> DataFrame:
    """The dashboard's base rows: fact (inner) categories, one month or all."""
    return _with_names(t.where(in_month(month)), categories)


def kpi_total_avg(t: DataFrame, categories: DataFrame, month: str | None,
                  include_uncategorized: bool = False) -> DataFrame:
    """Total (0 when empty) and mean amount (NULL when empty) of the period;
    rows without a known category count with ``include_uncategorized`` only."""
    per = (t.where(in_month(month)).groupBy("category_id")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s")))
    j = _with_names(per, categories, how="left" if include_uncategorized else "inner")
    g = j.agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return g.select(round_money(F.coalesce("s", F.lit(0))).alias("total_spent"),
                    mean_money("s", "n").alias("avg_amount"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_transactions"))


def kpi_avg_delta(t: DataFrame, categories: DataFrame, month: str,
                  include_uncategorized: bool = False) -> DataFrame:
    """% change of the period mean vs the previous calendar month's mean.

    The current mean uses categorised rows (as the KPI does; all rows with
    ``include_uncategorized``), the previous mean all rows. NULL change when there is no previous data or its mean is 0;
    direction ``up`` when the change is positive, otherwise ``down``.
    """
    prev = previous_month(month)
    # one scan of the two months, conditional sums (no join between them)
    both = (t.where(in_month(month) | in_month(prev))
            .transform(lambda x: _with_names(x, categories, how="left")))
    is_cur = in_month(month)
    if not include_uncategorized:
        is_cur = is_cur & F.col("category").isNotNull()
    g = both.agg(F.sum(F.when(is_cur, 1).otherwise(0)).alias("cn"),
                 F.sum(F.when(is_cur, F.col("amount"))).alias("cs"),
                 F.sum(F.when(in_month(prev), 1).otherwise(0)).alias("pn"),
                 F.sum(F.when(in_month(prev), F.col("amount"))).alias("ps"))
    cur_mean = F.col("cs") / F.nullif(F.col("cn").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    prev_mean = F.col("ps") / F.nullif(F.col("pn").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    change = (cur_mean - prev_mean) * 100 / F.nullif(prev_mean, F.lit(0))
    return g.select(F.lit(month).alias("month"), F.lit(prev).alias("previous_month"),
                    F.round(cur_mean, 2).cast("double").alias("avg_amount"),
                    F.round(prev_mean, 2).cast("double").alias("previous_avg"),
                    F.round(change, 1).cast("double").alias("pct_change"),
                    F.when(change.isNull(), F.lit(None)).when(change > 0, "up").otherwise("down")
                    .alias("direction"))


def category_totals(t: DataFrame, categories: DataFrame, month: str | None) -> DataFrame:
    """Total per category of the period (categorised rows)."""
    per = t.where(in_month(month)).groupBy("category_id").agg(F.sum("amount").alias("total"))
    return _with_names(per, categories).select("category", "total")


def kpi_top_category(t: DataFrame, categories: DataFrame, month: str | None) -> DataFrame:
    """Upper-cased name of the largest category (ties: name); ``None`` if empty."""
    ct = category_totals(t, categories, month)
    # smallest (-total, name) = largest total, ties alphabetical; a global
    # aggregate returns one row (NULL) on an empty period
    best = ct.agg(F.min_by("category", F.struct(-F.col("total"), F.col("category"))).alias("c"))
    return best.select(F.coalesce(F.upper("c"), F.lit("None")).alias("top_category"))


def top_categories(t: DataFrame, categories: DataFrame, month: str | None, n: int = 5) -> DataFrame:
    """the ``n`` largest categories of the period (ties by name)."""
    ct = category_totals(t, categories, month)
    return (ct.orderBy(F.col("total").desc(), "category").limit(n)
            .select("category", round_money("total").alias("total")))


def export_projection(t: DataFrame, categories: DataFrame) -> DataFrame:
    """Id, date text, description, amount, category for display."""
    return (_with_names(t, categories)
            .select("id", F.date_format("date", "yyyy-MM-dd").alias("date"), "description",
                    round_money("amount").alias("amount"), "category"))


def recent_transactions(t: DataFrame, categories: DataFrame, month: str | None,
                        n: int = 10) -> DataFrame:
    """newest ``n`` rows (date desc, id desc), optional month filter; top-n plan."""
    j = _with_names(t.where(in_month(month)), categories)
    return (j.orderBy(F.col("date").desc(), F.col("id").desc()).limit(n)
            .select("id", F.date_format("date", "yyyy-MM-dd").alias("date"), "description",
                    round_money("amount").alias("amount"), "category"))


def recent_months(t: DataFrame, n: int = 6) -> DataFrame:
    """the last ``n`` month totals (month start dates), ascending."""
    m = t.groupBy(month_start("date").alias("month")).agg(F.sum("amount").alias("total"))
    last = m.orderBy(F.col("month").desc()).limit(n)
    return last.orderBy("month").select("month", round_money("total").alias("total"))


def available_months(t: DataFrame) -> DataFrame:
    """distinct months newest first, with a ``MAR-2026`` style label."""
    m = t.select(month_start("date").alias("d")).distinct()
    return m.select(month_key("d").alias("month"), month_label("d").alias("label")).orderBy(
        F.col("month").desc())


def current_month_flag(monthly: DataFrame, month_col: str = "month") -> DataFrame:
    """``current`` for the newest month, ``past`` otherwise (monthly rows only)."""
    newest = monthly.agg(F.max(month_col)).scalar()  # scalar subquery, evaluated once
    return monthly.withColumn("period", F.when(F.col(month_col) == newest, "current").otherwise("past"))


def category_totals_all(t: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category including unused ones, total or 0.

    The fact is reduced to one row per category id first; the dimension is
    then left-joined to that small result.
    """
    per = t.groupBy("category_id").agg(F.sum("amount").alias("total"))
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    # both sides are small (dimension rows; one row per category id): AQE
    # picks the broadcast side from the materialised sizes at run time
    return (c.join(per, "category_id", "left")
            .select("category", round_money(F.coalesce("total", F.lit(0))).alias("total")))


def category_monthly(t: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, month, total): the series behind D16/D17 (exact totals)."""
    per = t.groupBy("category_id", month_key("date").alias("month")).agg(F.sum("amount").alias("total"))
    return _with_names(per, categories).select("category", "month", "total")


def _series_stats(cm: DataFrame, n_last: int) -> DataFrame:
    w = Window.partitionBy("category").orderBy(F.col("month").desc())
    ranked = cm.withColumn("_rn", F.row_number().over(w))
    recent = F.col("_rn") <= n_last
    return ranked.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total").alias("s"),
        F.min_by("total", "month").alias("first"), F.max_by("total", "month").alias("last"),
        F.sum(F.when(recent, F.col("total"))).alias("rs"),
        F.sum(F.when(recent, 1).otherwise(0)).alias("rn"))


def category_projection(cm: DataFrame, n_last: int = 3) -> DataFrame:
    """Per category mean, last, (last - first) / n and mean of the last
    ``n_last`` months (fewer when the series is shorter), by forecast desc."""
    st = _series_stats(cm, n_last)
    n = F.col("n").cast("decimal(20,0)")
    return st.select(
        "category", mean_money("s", "n").alias("avg_monthly"), round_money("last").alias("last_month"),
        F.round((F.col("last") - F.col("first")) / n, 2).cast("double").alias("trend"),
        mean_money("rs", "rn").alias("forecast")).orderBy(F.col("forecast").desc(), "category")


def category_outlook(cm: DataFrame, n_last: int = 2) -> DataFrame:
    """Mean vs mean of the last ``n_last`` months, % difference, and a
    direction (``up`` above +1 %, ``down`` below -1 %, else ``flat``)."""
    st = _series_stats(cm, n_last)
    avg = F.col("s") / F.col("n").cast("decimal(20,0)")
    pred = F.col("rs") / F.col("rn").cast("decimal(20,0)")
    diff = (pred - avg) * 100 / F.nullif(avg, F.lit(0))
    return st.select("category", F.round(avg, 2).cast("double").alias("avg_val"),
                     F.round(pred, 2).cast("double").alias("pred_val"),
                     F.round(diff, 1).cast("double").alias("pct"),
                     F.when(diff > 1, "up").when(diff < -1, "down").otherwise("flat").alias("direction"))


def distinct_labels(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column."""
    return df.select(col).distinct()


def panels(t: DataFrame, categories: DataFrame, month: str | None, n_top: int = 5) -> dict:
    """All dashboard panels for one selection (section 3.3 of the survey).

    The period's rows are filtered once (range predicate, pushed to the scan)
    and cached for the panels that share them; panels over all months read
    the table directly.
    """
    from ledger_spark.operators.forecast import forecast_panel, last_n_series, loess_trend, monthly_series

    sel = t.where(in_month(month)).cache()
    out = {
        "kpi_total_avg": kpi_total_avg(sel, categories, None),
        "kpi_top_category": kpi_top_category(sel, categories, None),
        "top_categories": top_categories(sel, categories, None, n_top),
        "recent_transactions": recent_transactions(sel, categories, None, 10),
        "category_totals_all": category_totals_all(t, categories),
        "category_outlook": category_outlook(category_monthly(t, categories), 2),
        "forecast_panel": forecast_panel(monthly_series(t)),
        "trend": current_month_flag(loess_trend(last_n_series(t, 6))),
    }
    if month not in (None, "all"):
        out["kpi_avg_delta"] = kpi_avg_delta(t, categories, month)
    return out
