"""The ten analytical reports (Q1-Q10) and the plain aggregates around them
(D1-D9, D13, E1, E2, F1, B10).

Scale notes
-----------
* Every report over the fact table is a hash aggregate with map-side partial
  aggregation, so a hot key (one month, one category, one description holding
  a third of the rows) is combined inside each task before the shuffle.
* Category names come from a join with the dimension *after*
  the fact has been reduced to one row per ``category_id``: the join runs on
  a handful of rows instead of the fact table.
* Grand totals for percentages are summed from the same per-category partial
  result, so each report scans the fact table once.
* The windowed reports (Q6, Q10) run on month/day totals whose row count is
  bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledger_spark.functions.dates import in_month, month_key
from ledger_spark.functions.money import mean_money, pct, round_money
from ledger_spark.functions.rules import budget_status, expense_type
from ledger_spark.schema import DEFAULT_MERCHANT_TERMS


def _with_names(df: DataFrame, categories: DataFrame, *extra: str, how: str = "inner") -> DataFrame:
    """Category name (and ``extra`` columns) by ``category_id``."""
    from ledger_spark.operators.joins import attach

    dim = categories.select("id", F.col("name").alias("category"), *extra)
    return attach(df, dim, "category_id", "id", ["category", *extra], how)


def monthly_summary(t: DataFrame) -> DataFrame:
    """Count, total, mean and largest amount per month."""
    agg = t.groupBy(month_key("date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"), F.max("amount").alias("mx"))
    return agg.select("month", F.col("n").cast("int").alias("num_transactions"),
                      round_money("s").alias("total_spent"),
                      mean_money("s", "n").alias("avg_transaction"),
                      round_money("mx").alias("largest_transaction")).orderBy("month")


def load_summary(t: DataFrame) -> DataFrame:
    """Month, transaction count and total after a load."""
    return (t.groupBy(month_key("date").alias("month"))
            .agg(F.count(F.lit(1)).cast("int").alias("transactions"),
                 round_money(F.sum("amount")).alias("total_spent")).orderBy("month"))


def _by_category_id(t: DataFrame) -> DataFrame:
    """Fact reduced to one row per category id (NULL ids kept for grand totals)."""
    return t.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"))


def by_category(t: DataFrame, categories: DataFrame) -> DataFrame:
    """D3 / Q2: per category count, total, mean and share of the grand total.

    The denominator covers all transactions, including rows whose category the
    inner join drops.
    """
    per = _by_category_id(t)
    grand = F.sum("s").over(Window.partitionBy())  # over <= #categories+1 rows
    per = per.withColumn("grand", grand)
    joined = _with_names(per, categories)
    return joined.select("category", F.col("n").cast("int").alias("transactions"),
                         round_money("s").alias("total_spent"),
                         mean_money("s", "n").alias("avg_per_transaction"),
                         pct("s", "grand").alias("pct_of_total")).orderBy(F.desc("total_spent"), "category")


def month_category(t: DataFrame, categories: DataFrame, rounded: bool = True) -> DataFrame:
    """Total per (month, category)."""
    agg = t.groupBy(month_key("date").alias("month"), "category_id").agg(F.sum("amount").alias("s"))
    out = _with_names(agg, categories)
    total = round_money("s") if rounded else F.col("s")
    return out.select("month", "category", total.alias("total_spent")).orderBy(
        "month", F.desc("total_spent"), "category")


def top_expenses(t: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """F1 / Q4: the ``n`` largest transactions with their category.

    Largest-first with ``id`` as the tie-break; planned as a per-partition
    top-n followed by a merge (TakeOrderedAndProject), never a full sort.
    """
    j = _with_names(t, categories)
    return (j.orderBy(F.col("amount").desc(), F.col("id").asc()).limit(n)
            .select("id", "date", "description", round_money("amount").alias("amount"), "category"))


def recurring(t: DataFrame, min_months: int = 3) -> DataFrame:
    """Descriptions seen in at least ``min_months`` distinct months.

    Two-level aggregation: (description, month) partials first, so the
    distinct-month count needs no per-row distinct set.
    """
    per_month = t.groupBy("description", month_key("date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"))
    per_desc = per_month.groupBy("description").agg(
        F.count(F.lit(1)).alias("months"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    return (per_desc.where(F.col("months") >= min_months)
            .select("description", F.col("months").cast("int").alias("months_seen"),
                    mean_money("s", "n").alias("avg_amount"), round_money("s").alias("total_paid"))
            .orderBy(F.desc("total_paid"), "description"))


def _fill(totals: DataFrame, keys, period, step: str, value: str) -> DataFrame:
    """Zero rows for the periods that a series skips between its first and last.
    ``period`` is a DATE column; the result has as many rows as the calendar."""
    span = totals.groupBy(*keys).agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    every = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL 1 {step}"))).alias(period))
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys] + [F.col(f"e.{period}") == F.col(f"t.{period}")]
    return every.alias("e").join(totals.alias("t"), on, "left").select(
        *[F.col(f"e.{k}").alias(k) for k in keys], F.col(f"e.{period}").alias(period),
        F.coalesce(f"t.{value}", F.lit(0)).cast(totals.schema[value].dataType).alias(value))


def monthly_totals(t: DataFrame, keys=(), fill_gaps: bool = False) -> DataFrame:
    """Exact total per month (``month`` text key), optionally per key;
    ``fill_gaps`` adds the months without spending as 0."""
    if not fill_gaps:
        return t.groupBy(*keys, month_key("date").alias("month")).agg(F.sum("amount").alias("total"))
    m = t.groupBy(*keys, F.trunc("date", "month").alias("_month")).agg(F.sum("amount").alias("total"))
    return _fill(m, keys, "_month", "MONTH", "total").select(*keys, month_key("_month").alias("month"), "total")


def month_over_month(t: DataFrame, keys=(), fill_gaps: bool = False) -> DataFrame:
    """Total, change and % change against the previous month present
    (with ``fill_gaps``: against the previous calendar month).

    ``lag`` is computed once. Without keys the window has one partition, but
    over month totals only (one row per calendar month).
    """
    m = monthly_totals(t, keys, fill_gaps)
    w = Window.partitionBy(*keys).orderBy("month")
    m = m.withColumn("prev", F.lag("total").over(w))
    return m.select(*keys, "month", round_money("total").alias("total_spent"),
                    round_money(F.col("total") - F.col("prev")).alias("mom_change"),
                    pct(F.col("total") - F.col("prev"), "prev").alias("mom_pct_change")).orderBy(*keys, "month")


def essential_split(t: DataFrame, categories: DataFrame) -> DataFrame:
    """Total and share per expense type (Essential/Discretionary)."""
    per = _by_category_id(t).withColumn("grand", F.sum("s").over(Window.partitionBy()))
    j = _with_names(per, categories, "is_essential")
    g = j.groupBy(expense_type("is_essential").alias("expense_type")).agg(
        F.sum("s").alias("s"), F.first("grand").alias("grand"))
    return g.select("expense_type", round_money("s").alias("total_spent"),
                    pct("s", "grand").alias("pct_of_total"))


def budget_vs_actual(budgets: DataFrame, categories: DataFrame, t: DataFrame, month: str,
                     no_spend: str = "over") -> DataFrame:
    """Budget, actual, variance and status per category for one month.

    The fact side is pruned to the month by a date range (pushed to the scan)
    and reduced to one row per category before the two-key left join.
    ``no_spend='under'`` treats a month without spend as 0 instead of NULL.
    """
    actual = (t.where(in_month(month)).groupBy("category_id")
              .agg(F.sum("amount").alias("actual")))
    b = _with_names(budgets.where(F.col("month") == month), categories)
    j = b.join(actual, "category_id", "left")
    act = F.coalesce("actual", F.lit(0)) if no_spend == "under" else F.col("actual")
    j = j.withColumn("act", act)
    out = j.select("category", round_money("budget_amt").alias("budgeted"),
                   round_money("act").alias("actual_spent"),
                   round_money(F.col("act") - F.col("budget_amt")).alias("variance"),
                   budget_status("act", "budget_amt").alias("status"))
    return out.orderBy(F.col("variance").desc_nulls_first(), "category")


def merchant_search(t: DataFrame, terms=DEFAULT_MERCHANT_TERMS) -> DataFrame:
    """Case-insensitive contains-any over descriptions, by date."""
    cond = None
    for term in terms:
        c = F.lower("description").contains(term.lower())
        cond = c if cond is None else cond | c
    return (t.where(cond).select("id", "date", "description", round_money("amount").alias("amount"))
            .orderBy("date", "id"))


def daily_totals(t: DataFrame, keys=()) -> DataFrame:
    """Exact total per date."""
    return t.groupBy(*keys, "date").agg(F.sum("amount").alias("amount"))


def rolling_average(t: DataFrame, n: int = 7, keys=(), fill_gaps: bool = False) -> DataFrame:
    """Mean of the current and ``n-1`` preceding daily totals, by
    date. Rows present count, so "7-day" means 7 spending days; with
    ``fill_gaps`` days without spending count as 0."""
    d = daily_totals(t, keys)
    if fill_gaps:
        d = _fill(d.withColumn("date", F.col("date").cast("date")), keys, "date", "DAY", "amount")
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(n - 1), 0)
    return d.select(*keys, "date", round_money("amount").alias("daily_spend"),
                    F.round(F.sum("amount").over(w) / F.count(F.lit(1)).over(w).cast("decimal(20,0)"), 2)
                    .cast("double").alias("rolling_7d_avg")).orderBy(*keys, "date")


def class_distribution(df: DataFrame, label: str = "category") -> DataFrame:
    """Row count per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
