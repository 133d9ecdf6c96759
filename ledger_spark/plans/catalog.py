"""Named queries over the test tables: ``queries()`` and their ``oracle_sql()``.

Every query reads the given tables (through the fixture adapter) and runs
over the whole tables; parameters (a month, search terms, n of a top-n) are
the feature of the operator, not a sample. Output columns are plain types
(dates as ISO text, money as doubles rounded exactly) so any engine's result
can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_spark.functions.dates import in_month, previous_month
from ledger_spark.operators import classify as CL
from ledger_spark.operators import clean as CLN
from ledger_spark.operators import dashboard as DB
from ledger_spark.operators import evaluate as EV
from ledger_spark.operators import features as FE
from ledger_spark.operators import forecast as FC
from ledger_spark.operators import reports as R
from ledger_spark.functions import text as TX_FN
from ledger_spark.operators import text as TX
from ledger_spark.plans import sql as S
from ledger_spark.schema import RECURRING_PATTERN, Z95
from ledger_spark.session import materialize
from ledger_spark.sources import maintenance as MT
from ledger_spark.sources import sinks as SK
from ledger_spark.sources import tables as TB
from ledger_spark.streaming import live as LV

# Parameters of the registered queries (fixture data spans 1995-01 .. 2001-08).
REPORT_MONTH = "1998-06"
SEARCH_TERMS = ["00012", "777"]


def portable(df: DataFrame) -> DataFrame:
    """Dates -> ISO text, decimals -> double (values are already rounded)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _tx(spark, d, cols=None, cats=None):
    return TB.transactions(spark, d, cols, cats)


def _cats(spark, d):
    return TB.categories(spark, d)


def _both(spark, d, cols=None):
    """Transactions and the one categories table that they were mapped with."""
    cats = _cats(spark, d)
    return _tx(spark, d, cols, cats), cats


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def q01_monthly_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.monthly_summary(_tx(spark, d, ["date", "amount"]))


def q02_by_category(spark, d):
    return R.by_category(*_both(spark, d, ["amount", "category_id"]))


def q03_month_category(spark, d):
    return R.month_category(*_both(spark, d, ["date", "amount", "category_id"]))


def q04_top_expenses(spark, d):
    t, cats = _both(spark, d, ["id", "date", "description", "amount", "category_id"])
    return portable(R.top_expenses(t, cats, 10))


def q05_recurring(spark, d):
    return R.recurring(_tx(spark, d, ["date", "description", "amount"]), 3)


def q06_month_over_month(spark, d):
    return R.month_over_month(_tx(spark, d, ["date", "amount"]))


def q07_essential_split(spark, d):
    return R.essential_split(*_both(spark, d, ["amount", "category_id"]))


def q08_budget_vs_actual(spark, d):
    t, cats = _both(spark, d, ["date", "amount", "category_id"])
    return R.budget_vs_actual(TB.budgets(spark, d, t, cats), cats, t, REPORT_MONTH)


def q09_merchant_search(spark, d):
    return portable(R.merchant_search(_tx(spark, d, ["id", "date", "description", "amount"]), SEARCH_TERMS))


def q10_rolling_average(spark, d):
    return portable(R.rolling_average(_tx(spark, d, ["date", "amount"]), 7))


def q06_fill_gaps(spark, d):
    """Q6 per category with the months that a category skips as 0."""
    t = _tx(spark, d, ["date", "amount", "category_id"])
    return R.month_over_month(t, ["category_id"], fill_gaps=True)


def q10_fill_gaps(spark, d):
    """Q10 over calendar days, for the orders of one customer segment at a time."""
    t = _tx(spark, d, ["date", "amount", "category_id"])
    return portable(R.rolling_average(t, 7, ["category_id"], fill_gaps=True))


def load_summary(spark, d):
    return R.load_summary(_tx(spark, d, ["date", "amount"]))


def daily_totals(spark, d):
    return portable(R.daily_totals(_tx(spark, d, ["date", "amount"]))
                    .select("date", F.col("amount").cast("double").alias("total")))


def clean_transactions(spark, d):
    return portable(_tx(spark, d))


def categories_fixture(spark, d):
    return _cats(spark, d)


SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _reg(fn, sql: str | None):
    SPARK[fn.__name__] = fn
    if sql is not None:
        SQL[fn.__name__] = S.with_adapter(sql)


M = S.MONTH

_reg(q01_monthly_summary, f"""
SELECT {M} AS month, CAST(count(*) AS INTEGER) AS num_transactions,
       {S.r2('sum(amount)')} AS total_spent, {S.mean2('sum(amount)', 'count(*)')} AS avg_transaction,
       {S.r2('max(amount)')} AS largest_transaction
FROM transactions GROUP BY 1""")

_reg(q02_by_category, f"""
SELECT c.name AS category, CAST(count(t.id) AS INTEGER) AS transactions,
       {S.r2('sum(t.amount)')} AS total_spent, {S.mean2('sum(t.amount)', 'count(t.id)')} AS avg_per_transaction,
       {S.pct1('sum(t.amount)', '(SELECT sum(amount) FROM transactions)')} AS pct_of_total
FROM transactions t JOIN categories c ON t.category_id = c.id GROUP BY c.name""")

_reg(q03_month_category, f"""
SELECT strftime(t.date, '%Y-%m') AS month, c.name AS category, {S.r2('sum(t.amount)')} AS total_spent
FROM transactions t JOIN categories c ON t.category_id = c.id GROUP BY 1, 2""")

_reg(q04_top_expenses, f"""
SELECT t.id, CAST(t.date AS VARCHAR) AS date, t.description, {S.r2('t.amount')} AS amount, c.name AS category
FROM transactions t JOIN categories c ON t.category_id = c.id
ORDER BY t.amount DESC, t.id LIMIT 10""")

_reg(q05_recurring, f"""
SELECT description, CAST(count(DISTINCT {M}) AS INTEGER) AS months_seen,
       {S.mean2('sum(amount)', 'count(*)')} AS avg_amount, {S.r2('sum(amount)')} AS total_paid
FROM transactions GROUP BY description HAVING count(DISTINCT {M}) >= 3""")

_reg(q06_month_over_month, f"""
SELECT month, {S.r2('total')} AS total_spent, {S.r2('total - prev')} AS mom_change,
       {S.pct1('total - prev', 'prev')} AS mom_pct_change
FROM (SELECT month, total, lag(total) OVER (ORDER BY month) AS prev
      FROM (SELECT {M} AS month, sum(amount) AS total FROM transactions GROUP BY 1))""")

_reg(q07_essential_split, f"""
SELECT CASE WHEN c.is_essential = 1 THEN 'Essential' ELSE 'Discretionary' END AS expense_type,
       {S.r2('sum(t.amount)')} AS total_spent,
       {S.pct1('sum(t.amount)', '(SELECT sum(amount) FROM transactions)')} AS pct_of_total
FROM transactions t JOIN categories c ON t.category_id = c.id GROUP BY 1""")

_reg(q08_budget_vs_actual, f"""
SELECT c.name AS category, {S.r2('b.budget_amt')} AS budgeted, {S.r2('sum(t.amount)')} AS actual_spent,
       {S.r2('sum(t.amount) - b.budget_amt')} AS variance,
       CASE WHEN sum(t.amount) <= b.budget_amt THEN {S.q(S.STATUS[0])} ELSE {S.q(S.STATUS[1])} END AS status
FROM budgets b JOIN categories c ON b.category_id = c.id
LEFT JOIN transactions t ON t.category_id = c.id AND {M.replace('date', 't.date')} = b.month
WHERE b.month = {S.q(REPORT_MONTH)}
GROUP BY c.name, b.budget_amt""")

_reg(q09_merchant_search, f"""
SELECT id, CAST(date AS VARCHAR) AS date, description, {S.r2('amount')} AS amount FROM transactions
WHERE {" OR ".join(f"description ILIKE {S.q('%' + t + '%')}" for t in SEARCH_TERMS)}""")

_reg(q10_rolling_average, f"""
SELECT CAST(date AS VARCHAR) AS date, {S.r2('amount')} AS daily_spend,
       {S.mean2('sum(amount) OVER w', 'count(*) OVER w')} AS rolling_7d_avg
FROM (SELECT date, sum(amount) AS amount FROM transactions GROUP BY date)
WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")

_reg(q06_fill_gaps, f"""
, m AS (SELECT category_id, date_trunc('month', date) AS m, sum(amount) AS total FROM transactions GROUP BY ALL),
e AS (SELECT category_id, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM m GROUP BY 1),
f AS (SELECT e.category_id, strftime(e.m, '%Y-%m') AS month, COALESCE(m.total, 0) AS total
      FROM e LEFT JOIN m ON e.category_id = m.category_id AND e.m = m.m),
g AS (SELECT *, lag(total) OVER (PARTITION BY category_id ORDER BY month) AS prev FROM f)
SELECT category_id, month, {S.r2('total')} AS total_spent, {S.r2('total - prev')} AS mom_change,
       {S.pct1('total - prev', 'prev')} AS mom_pct_change FROM g""")

_reg(q10_fill_gaps, f"""
, m AS (SELECT category_id, CAST(date AS TIMESTAMP) AS m, sum(amount) AS total FROM transactions GROUP BY ALL),
e AS (SELECT category_id, unnest(generate_series(min(m), max(m), INTERVAL 1 DAY)) AS m FROM m GROUP BY 1),
f AS (SELECT e.category_id, CAST(e.m AS DATE) AS date, COALESCE(m.total, 0) AS amount
      FROM e LEFT JOIN m ON e.category_id = m.category_id AND e.m = m.m)
SELECT category_id, CAST(date AS VARCHAR) AS date, {S.r2('amount')} AS daily_spend,
       {S.mean2('sum(amount) OVER w', 'count(*) OVER w')} AS rolling_7d_avg
FROM f WINDOW w AS (PARTITION BY category_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")

_reg(load_summary, f"""
SELECT {M} AS month, CAST(count(*) AS INTEGER) AS transactions, {S.r2('sum(amount)')} AS total_spent
FROM transactions GROUP BY 1""")

_reg(daily_totals, """
SELECT CAST(date AS VARCHAR) AS date, CAST(sum(amount) AS DOUBLE) AS total FROM transactions GROUP BY date""")

_reg(clean_transactions, """
SELECT id, CAST(date AS VARCHAR) AS date, description, CAST(amount AS DOUBLE) AS amount,
       category_id, category_raw, is_recurring FROM transactions""")

_reg(categories_fixture, """SELECT id, name, description, color_hex, is_essential FROM categories""")


# --------------------------------------------------------------------------
# Dashboard panels (month = REPORT_MONTH)
# --------------------------------------------------------------------------

PREV_MONTH = previous_month(REPORT_MONTH)


def kpi_total_avg(spark, d):
    return DB.kpi_total_avg(*_both(spark, d, ["date", "amount", "category_id"]), REPORT_MONTH)


UNCATEGORIZED_FIXTURE = "furniture"


def _partly_categorized(spark, d):
    """Transactions of which one segment's have no category."""
    t, cats = _both(spark, d, ["date", "amount", "category_id", "category_raw"])
    known = F.col("category_raw") != UNCATEGORIZED_FIXTURE
    return t.withColumn("category_id", F.when(known, F.col("category_id"))), cats


def kpi_uncategorized(spark, d):
    """D10 with and without the rows that have no category."""
    t, cats = _partly_categorized(spark, d)
    out = None
    for include in (False, True):
        one = DB.kpi_total_avg(t, cats, REPORT_MONTH, include).withColumn("included", F.lit(include))
        out = one if out is None else out.unionByName(one)
    return out


def kpi_delta_uncategorized(spark, d):
    """D11 with and without the rows that have no category."""
    t, cats = _partly_categorized(spark, d)
    out = None
    for include in (False, True):
        one = DB.kpi_avg_delta(t, cats, REPORT_MONTH, include).withColumn("included", F.lit(include))
        out = one if out is None else out.unionByName(one)
    return out


def distinct_labels(spark, d):
    """G2 over the classifier's input."""
    return DB.distinct_labels(_docs(spark, d), "category")


def kpi_avg_delta(spark, d):
    return DB.kpi_avg_delta(*_both(spark, d, ["date", "amount", "category_id"]), REPORT_MONTH)


def kpi_top_category(spark, d):
    return DB.kpi_top_category(*_both(spark, d, ["date", "amount", "category_id"]), REPORT_MONTH)


def top_categories(spark, d):
    return DB.top_categories(*_both(spark, d, ["date", "amount", "category_id"]), REPORT_MONTH, 5)


def recent_transactions(spark, d):
    t, cats = _both(spark, d, ["id", "date", "description", "amount", "category_id"])
    return DB.recent_transactions(t, cats, REPORT_MONTH, 10)


def recent_transactions_all(spark, d):
    t, cats = _both(spark, d, ["id", "date", "description", "amount", "category_id"])
    return DB.recent_transactions(t, cats, None, 10)


def recent_months(spark, d):
    return portable(DB.recent_months(_tx(spark, d, ["date", "amount"]), 6))


def available_months(spark, d):
    return DB.available_months(_tx(spark, d, ["date", "amount"]))


def current_month_flag(spark, d):
    m = R.monthly_totals(_tx(spark, d, ["date", "amount"]))
    return DB.current_month_flag(m.select("month", R.round_money("total").alias("total")))


def category_totals_all(spark, d):
    return DB.category_totals_all(*_both(spark, d, ["amount", "category_id"]))


def category_projection(spark, d):
    cm = DB.category_monthly(*_both(spark, d, ["date", "amount", "category_id"]))
    return DB.category_projection(cm, 3)


def category_outlook(spark, d):
    cm = DB.category_monthly(*_both(spark, d, ["date", "amount", "category_id"]))
    return DB.category_outlook(cm, 2)


def export_projection(spark, d):
    t, cats = _both(spark, d, ["id", "date", "description", "amount", "category_id"])
    return DB.export_projection(t, cats)


JOINED = "transactions t JOIN categories c ON t.category_id = c.id"
IN_M = f"strftime(t.date, '%Y-%m') = {S.q(REPORT_MONTH)}"

_reg(kpi_total_avg, f"""
SELECT CAST(ROUND(COALESCE(sum(t.amount), 0), 2) AS DOUBLE) AS total_spent,
       {S.mean2('sum(t.amount)', 'count(*)')} AS avg_amount, CAST(count(*) AS BIGINT) AS n_transactions
FROM {JOINED} WHERE {IN_M}""")

_reg(kpi_avg_delta, f"""
, cur AS (SELECT count(*) AS cn, sum(t.amount) AS cs FROM {JOINED} WHERE {IN_M}),
prev AS (SELECT count(*) AS pn, sum(amount) AS ps FROM transactions WHERE {M} = {S.q(PREV_MONTH)}),
x AS (SELECT *, ({S.cents('cs')} * pn - {S.cents('ps')} * cn) AS num, ({S.cents('ps')} * cn) AS den
      FROM cur, prev)
SELECT {S.q(REPORT_MONTH)} AS month, {S.q(PREV_MONTH)} AS previous_month,
       {S.mean2('cs', 'cn')} AS avg_amount, {S.mean2('ps', 'pn')} AS previous_avg,
       {S.ratio('num * 100', 'den', 1)} AS pct_change,
       CASE WHEN den IS NULL OR den = 0 OR num IS NULL THEN NULL WHEN num > 0 THEN 'up' ELSE 'down' END
         AS direction
FROM x""")

_reg(kpi_uncategorized, f"""
, x AS (SELECT *, category_raw <> {S.q(UNCATEGORIZED_FIXTURE)} AS known FROM transactions
        WHERE {M} = {S.q(REPORT_MONTH)}),
i(included) AS (VALUES (false), (true))
SELECT CAST(ROUND(COALESCE(sum(amount), 0), 2) AS DOUBLE) AS total_spent, {S.mean2('sum(amount)', 'count(*)')} AS avg_amount,
       CAST(count(*) AS BIGINT) AS n_transactions, included
FROM i JOIN x ON x.known OR i.included GROUP BY included""")

_reg(kpi_delta_uncategorized, f"""
, y AS (SELECT *, category_raw <> {S.q(UNCATEGORIZED_FIXTURE)} AS known FROM transactions),
i(included) AS (VALUES (false), (true)),
cur AS (SELECT included, count(*) AS cn, sum(amount) AS cs FROM i JOIN y ON y.known OR i.included
        WHERE {M} = {S.q(REPORT_MONTH)} GROUP BY included),
prev AS (SELECT count(*) AS pn, sum(amount) AS ps FROM transactions WHERE {M} = {S.q(PREV_MONTH)}),
x AS (SELECT *, ({S.cents('cs')} * pn - {S.cents('ps')} * cn) AS num, ({S.cents('ps')} * cn) AS den FROM cur, prev)
SELECT {S.q(REPORT_MONTH)} AS month, {S.q(PREV_MONTH)} AS previous_month,
       {S.mean2('cs', 'cn')} AS avg_amount, {S.mean2('ps', 'pn')} AS previous_avg,
       {S.ratio('num * 100', 'den', 1)} AS pct_change,
       CASE WHEN den IS NULL OR den = 0 OR num IS NULL THEN NULL WHEN num > 0 THEN 'up' ELSE 'down' END
         AS direction, included
FROM x""")

_reg(distinct_labels, "SELECT DISTINCT lang AS category FROM documents")

_reg(kpi_top_category, f"""
SELECT COALESCE(upper((SELECT c.name FROM {JOINED} WHERE {IN_M} GROUP BY c.name
                       ORDER BY sum(t.amount) DESC, c.name LIMIT 1)), 'None') AS top_category""")

_reg(top_categories, f"""
SELECT c.name AS category, {S.r2('sum(t.amount)')} AS total FROM {JOINED} WHERE {IN_M}
GROUP BY c.name ORDER BY sum(t.amount) DESC, c.name LIMIT 5""")

_RECENT = f"""
SELECT t.id, CAST(t.date AS VARCHAR) AS date, t.description, {S.r2('t.amount')} AS amount, c.name AS category
FROM {JOINED} {{where}} ORDER BY t.date DESC, t.id DESC LIMIT 10"""
_reg(recent_transactions, _RECENT.format(where=f"WHERE {IN_M}"))
_reg(recent_transactions_all, _RECENT.format(where=""))

_reg(recent_months, f"""
SELECT CAST(month AS VARCHAR) AS month, {S.r2('total')} AS total FROM (
  SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(amount) AS total FROM transactions
  GROUP BY 1 ORDER BY 1 DESC LIMIT 6)""")

_reg(available_months, f"""
SELECT DISTINCT {M} AS month, upper(strftime(date, '%b-%Y')) AS label FROM transactions""")

_reg(current_month_flag, f"""
SELECT month, {S.r2('total')} AS total,
       CASE WHEN month = max(month) OVER () THEN 'current' ELSE 'past' END AS period
FROM (SELECT {M} AS month, sum(amount) AS total FROM transactions GROUP BY 1)""")

_reg(category_totals_all, """
SELECT c.name AS category, CAST(ROUND(COALESCE(sum(t.amount), 0), 2) AS DOUBLE) AS total
FROM categories c LEFT JOIN transactions t ON t.category_id = c.id GROUP BY c.name""")

_CM = f"""
cm AS (SELECT c.name AS category, strftime(t.date, '%Y-%m') AS month, sum(t.amount) AS total
       FROM {JOINED} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY month DESC) AS rn FROM cm),
st AS (SELECT category, count(*) AS n, sum(total) AS s, arg_min(total, month) AS first,
              arg_max(total, month) AS last, sum(total) FILTER (WHERE rn <= {{k}}) AS rs,
              count(*) FILTER (WHERE rn <= {{k}}) AS rk
       FROM r GROUP BY category)"""

_reg(category_projection, "," + _CM.format(k=3) + f"""
SELECT category, {S.mean2('s', 'n')} AS avg_monthly, {S.r2('last')} AS last_month,
       {S.mean2('last - first', 'n')} AS trend, {S.mean2('rs', 'rk')} AS forecast FROM st""")

_reg(category_outlook, "," + _CM.format(k=2) + f"""
, x AS (SELECT *, ({S.cents('rs')} * n - {S.cents('s')} * rk) AS num, ({S.cents('s')} * rk) AS den FROM st)
SELECT category, {S.mean2('s', 'n')} AS avg_val, {S.mean2('rs', 'rk')} AS pred_val,
       {S.ratio('num * 100', 'den', 1)} AS pct,
       CASE WHEN num * 100 > den THEN 'up' WHEN num * 100 < -den THEN 'down' ELSE 'flat' END AS direction
FROM x""")

_reg(export_projection, f"""
SELECT t.id, CAST(t.date AS VARCHAR) AS date, t.description, {S.r2('t.amount')} AS amount, c.name AS category
FROM {JOINED}""")


# --------------------------------------------------------------------------
# Forecasts (I1-I9, G1): overall series and one series per category
# --------------------------------------------------------------------------


def _series(spark, d, keys=()):
    cols = ["date", "amount", *(["category_id"] if "category_id" in keys else [])]
    return FC.monthly_series(_tx(spark, d, cols), list(keys))


def _fc_cols(keys=()):
    r = lambda c: F.round(c, 2)
    return [*keys, "alpha", "beta", r(F.col("forecast")[0]).alias("f1"), r(F.col("forecast")[1]).alias("f2"),
            r(F.col("forecast")[2]).alias("f3"), r("lower95").alias("lower95"), r("upper95").alias("upper95")]


def holt_forecast(spark, d):
    return FC.holt_forecast(_series(spark, d), 3).select(*_fc_cols())


def holt_forecast_by_category(spark, d):
    return FC.holt_forecast(_series(spark, d, ["category_id"]), 3).select(*_fc_cols(["category_id"]))


def ensemble_forecast(spark, d):
    e = FC.ensemble_forecast(_series(spark, d))
    return e.select(F.round("next_hw", 2).alias("next_hw"), F.round("next_lm", 2).alias("next_lm"),
                    F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"),
                    F.round("ma", 2).alias("ma"), F.round("ensemble", 2).alias("ensemble"))


def actual_plus_forecast(spark, d):
    s = _series(spark, d)
    g = FC.actual_plus_forecast(s, FC.holt_forecast(s, 3))
    return g.select("month", F.round("actual", 2).alias("actual"), "type")


def future_months(spark, d):
    s = _series(spark, d)
    return s.select(F.explode(FC.future_months(F.col("last_month"), 3)).alias("m")).select(
        F.date_format("m", "yyyy-MM").alias("month"))


def seasonal_holt_winters(spark, d):
    hw = FC.holt_winters_seasonal(_series(spark, d, ["category_id"]), 3)
    return hw.select("category_id", "alpha", "beta", "gamma", *[F.round(F.col("forecast")[i], 2).alias(f"f{i + 1}")
                                                                for i in range(3)])


def holt_newton_by_category(spark, d):
    """I2 by Gauss-Newton steps, one series per category, and whether its sum of squares is no worse than the grid's."""
    return _newton(_series(spark, d, ["category_id"]), FC.holt_forecast, ["alpha", "beta"])


def seasonal_newton_by_category(spark, d):
    """I8 by Gauss-Newton steps, one series per category, and whether its sum of squares is no worse than the grid's."""
    return _newton(_series(spark, d, ["category_id"]), FC.holt_winters_seasonal, ["alpha", "beta", "gamma"])


def _newton(series, forecast, names):
    series = materialize(series)
    fits = forecast(series, 3, search="newton").join(
        forecast(series, 3).select("category_id", F.col("sse").alias("grid_sse")), "category_id")
    r = lambda c: F.round(c, 2)
    return fits.select("category_id", *[F.round(c, 3).alias(c) for c in names], *[r(F.col("forecast")[i]).alias(f"f{i + 1}") for i in range(3)],
                       r("lower95").alias("lower95"), r("upper95").alias("upper95"),
                       (F.col("sse") <= F.col("grid_sse") * (1 + 1e-9)).alias("no_worse"))


def forecast_panel(spark, d):
    return FC.forecast_panel(_series(spark, d))


def time_index(spark, d):
    """Every category's series with t = 1..n."""
    return FC.time_index(_series(spark, d, ["category_id"]), ["category_id"]).select(
        "category_id", "t", F.round("x", 2).alias("x"))


SHORT_SERIES_FROM = "2000-09-01"


def forecast_panel_short(spark, d):
    """I7 on a history of under 24 months, which takes the Holt branch."""
    t = _tx(spark, d, ["date", "amount"]).where(F.col("date") >= F.lit(SHORT_SERIES_FROM).cast("date"))
    return FC.forecast_panel(FC.monthly_series(t))


def linear_trend_by_category(spark, d):
    lt = FC.linear_trend(_series(spark, d, ["category_id"]))
    return lt.select("category_id", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"),
                     F.round("r2", 6).alias("r2"), F.round("next_lm", 2).alias("next_lm"))


def _ser_sql(key_expr: str, group: str, where: str = "true") -> str:
    return f""",
ms AS (SELECT {key_expr} AS k, CAST(date_trunc('month', date) AS DATE) AS m, CAST(sum(amount) AS DOUBLE) AS x
       FROM transactions WHERE {where} GROUP BY {group}),
ser AS (SELECT k, list(x ORDER BY m) AS xs, CAST(count(*) AS INTEGER) AS n, max(m) AS last_m, min(m) AS first_m
        FROM ms GROUP BY k)"""


_FC_SELECT = """SELECT {k}alpha, beta, ROUND(l + t, 2) AS f1, ROUND(l + 2 * t, 2) AS f2, ROUND(l + 3 * t, 2) AS f3,
       ROUND(l + t - {z} * sd, 2) AS lower95, ROUND(l + t + {z} * sd, 2) AS upper95
FROM ser LEFT JOIN hfit USING (k)"""



def _reg_rec(fn, sql):
    SPARK[fn.__name__] = fn
    SQL[fn.__name__] = S.with_adapter_recursive(sql)


_reg_rec(holt_forecast, _ser_sql("0", "2") + S.holt_ctes("ser") + "\n" + _FC_SELECT.format(k="", z=repr(Z95)))
_reg_rec(holt_forecast_by_category, _ser_sql("category_id", "1, 2") + S.holt_ctes("ser") + "\n"
         + _FC_SELECT.format(k="k AS category_id, ", z=repr(Z95)))

_NEWTON_SELECT = """
SELECT k AS category_id, {names}, {steps}, ROUND({first} - {z} * nfit.sd, 2) AS lower95, ROUND({first} + {z} * nfit.sd, 2) AS upper95,
       nfit.sse <= grid.sse * (1 + 1e-9) AS no_worse FROM nfit JOIN {grid} AS grid USING (k)"""
_HOLT_BASE = """,
hn AS (SELECT k, xs, n, xs[2] AS l0, xs[2] - xs[1] AS t0 FROM ser WHERE n >= 3)"""


def _newton_sql(start: str, base: str, grid: str, names: dict, season: str) -> str:
    """Both searches in SQL: the steps' result, and whether it is no worse than the grid's."""
    steps = [f"nfit.l + {h} * nfit.t{season.format(h=h)}" for h in (1, 2, 3)]
    return (_ser_sql("category_id", "1, 2") + start + S.newton_ctes(base, list(names)) + _NEWTON_SELECT.format(
        names=", ".join(f"ROUND(nfit.{k}, 3) AS {v}" for k, v in names.items()), z=repr(Z95), first=steps[0], grid=grid,
        steps=", ".join(f"ROUND({x}, 2) AS f{h}" for h, x in enumerate(steps, 1))))


_reg_rec(holt_newton_by_category, _newton_sql(_HOLT_BASE + S.holt_ctes("ser"), "hn", "hfit", {"a": "alpha", "b": "beta"}, ""))
_reg_rec(seasonal_newton_by_category, _newton_sql(S.hw_ctes("ser"), "ws", "wfit", {"a": "alpha", "b": "beta", "g": "gamma"},
                                                   " + nfit.q[{h}]"))

_LM = """,
lx AS (SELECT k, unnest(xs) AS x, generate_subscripts(xs, 1) AS t, n FROM ser),
lm AS (SELECT k, regr_slope(x, t) AS slope, regr_intercept(x, t) AS intercept, regr_r2(x, t) AS r2,
              regr_intercept(x, t) + regr_slope(x, t) * (max(n) + 1) AS next_lm FROM lx GROUP BY k)"""

_reg_rec(ensemble_forecast, _ser_sql("0", "2") + S.holt_ctes("ser") + _LM + """,
ma AS (SELECT k, (xs[n - 2] + xs[n - 1] + xs[n]) / 3 AS ma FROM ser)
SELECT ROUND(ROUND(l + t, 2), 2) AS next_hw, ROUND(next_lm, 2) AS next_lm, ROUND(slope, 4) AS slope,
       ROUND(r2, 6) AS r2, ROUND(ma, 2) AS ma, ROUND((ROUND(l + t, 2) + next_lm + ma) / 3, 2) AS ensemble
FROM hfit JOIN lm USING (k) JOIN ma USING (k)""")

_reg_rec(actual_plus_forecast, _ser_sql("0", "2") + S.holt_ctes("ser") + """
SELECT strftime(m, '%Y-%m') AS month, ROUND(x, 2) AS actual, 'Actual' AS type FROM ms
UNION ALL
SELECT strftime(CAST(s.last_m + INTERVAL (h.i) MONTH AS DATE), '%Y-%m'), ROUND(f.l + h.i * f.t, 2), 'Forecast'
FROM hfit f JOIN ser s USING (k), range(1, 4) h(i)""")

_reg(future_months, _ser_sql("0", "2") + """
SELECT strftime(CAST(last_m + INTERVAL (h.i) MONTH AS DATE), '%Y-%m') AS month FROM ser, range(1, 4) h(i)""")

_reg(linear_trend_by_category, _ser_sql("category_id", "1, 2") + _LM + """
SELECT k AS category_id, ROUND(slope, 4) AS slope, ROUND(intercept, 2) AS intercept, ROUND(r2, 6) AS r2,
       ROUND(next_lm, 2) AS next_lm FROM lm""")

_reg_rec(seasonal_holt_winters, _ser_sql("category_id", "1, 2") + S.hw_ctes("ser") + """
SELECT k AS category_id, alpha, beta, gamma, ROUND(l + t + q[1], 2) AS f1, ROUND(l + 2 * t + q[2], 2) AS f2,
       ROUND(l + 3 * t + q[3], 2) AS f3 FROM ser LEFT JOIN wfit USING (k)""")
_PANEL = f""" AS method, ROUND({{point}}, 0) AS point, ROUND({{point}} - {Z95!r} * sd, 0) AS lower,
              ROUND({{point}} + {Z95!r} * sd, 0) AS upper,
              strftime(CAST(s.last_m + INTERVAL 1 MONTH AS DATE), '%B %Y') AS next_month
       FROM {{fit}} JOIN ser s USING (k)),
tk AS (SELECT *, ROUND(lower * 0.8, -2) AS track_min, ROUND(upper * 1.2, -2) AS track_max FROM pv)
SELECT method, point, lower, upper, track_min, track_max,
       least(greatest((point - track_min) / nullif(track_max - track_min, 0) * 100, 0), 100) AS position,
       next_month FROM tk"""
_reg_rec(forecast_panel, _ser_sql("0", "2") + S.hw_ctes("ser") + """,
pv AS (SELECT 'holt_winters_seasonal'""" + _PANEL.format(point="l + t + q[1]", fit="wfit"))
_reg_rec(forecast_panel_short, _ser_sql("0", "2", f"date >= DATE '{SHORT_SERIES_FROM}'") + S.holt_ctes("ser") + """,
pv AS (SELECT 'holt'""" + _PANEL.format(point="l + t", fit="hfit"))
_reg(time_index, _ser_sql("category_id", "1, 2") + """
SELECT k AS category_id, CAST(row_number() OVER (PARTITION BY k ORDER BY m) AS INTEGER) AS t, ROUND(x, 2) AS x FROM ms""")


# --------------------------------------------------------------------------
# Text features, classifiers and evaluation (documents fixture)
# --------------------------------------------------------------------------


def _docs(spark, d):
    return TB.labelled_documents(spark, d)


def _vocab(docs):
    """Top-80 vocabulary over all documents (a fitted artefact, at most 80 words)."""
    return TX.vocabulary_list(TX.tokenize(docs))


def token_counts(spark, d):
    return TX.token_counts(TX.tokenize(_docs(spark, d)))


def vocabulary(spark, d):
    return TX.vocabulary(TX.tokenize(_docs(spark, d)))


def vocabulary_by_sketch(spark, d):
    """D14 in two passes: a frequent-items sketch names the candidates, which are counted."""
    return TX.frequent_words(TX.tokenize(_docs(spark, d)))


def document_terms(spark, d):
    """D15 in sparse long form: (id, word) for every vocabulary word present."""
    docs = _docs(spark, d)
    p = TX.present_words(docs, _vocab(docs))
    return p.select("id", F.explode("words").alias("word"))


def document_term_matrix(spark, d):
    """D15 in its wide form (a 0/1 column per word), read out as (id, word, present)."""
    docs = _docs(spark, d)
    vocab = _vocab(docs)
    wide = TX.document_term_matrix(docs, vocab)
    return wide.unpivot("id", vocab, "word", "present")


def keyword_classify_documents(spark, d):
    return CL.keyword_predictions(_docs(spark, d)).select("id", "category", "pred_keyword")


def keyword_accuracy(spark, d):
    return EV.accuracy(CL.keyword_predictions(_docs(spark, d)), "pred_keyword").select(
        F.round("accuracy", 6).alias("accuracy"))


def amount_features_documents(spark, d):
    f = FE.one_hot_bucket(FE.amount_features(_docs(spark, d)))
    return f.select("id", F.round("log_amount", 6).alias("log_amount"), "is_round", "is_large", "amount_bucket",
                    *FE.bucket_columns())


def stratified_split(spark, d):
    return FE.stratified_split(_docs(spark, d)).select("id", "category", "split")


def class_distribution(spark, d):
    return R.class_distribution(_docs(spark, d))


def _nb_frames(spark, d):
    """Split + compact per-document features, written once: the fit's two
    aggregates and the scoring read them instead of tokenising every text again."""
    docs = _docs(spark, d)
    f, cols = CL.nb_feature_frame(FE.stratified_split(docs), _vocab(docs))
    return materialize(f.select("id", "category", "split", "words", *CL.NUMERIC_FEATURES)), cols


def _gaussian_nb(spark, d):
    f, cols = _nb_frames(spark, d)
    return f, CL.gaussian_nb_fit(f.where(F.col("split") == "train"), cols)


def gaussian_nb_predictions(spark, d):
    f, model = _gaussian_nb(spark, d)
    return CL.gaussian_nb_predict(model, f.where(F.col("split") == "test")).select("id", "category", "pred_nb")


def gaussian_nb_evaluation(spark, d):
    f, model = _gaussian_nb(spark, d)
    scored = CL.gaussian_nb_predict(model, f.where(F.col("split") == "test"))
    m = EV.overall_metrics(scored, "pred_nb")
    return m.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "no_information_rate", "kappa")], "n")


def bernoulli_nb_predictions(spark, d):
    f, cols = _nb_frames(spark, d)
    words = [c for c in cols if c not in CL.NUMERIC_FEATURES]
    model = CL.bernoulli_nb_fit(f.where(F.col("split") == "train"), words)
    return CL.bernoulli_nb_predict(model, f.where(F.col("split") == "test")).select("id", "category", "pred_bnb")


def _lr_features(spark, d):
    """Vocabulary (over all rows, as in the original), split and the rows' compact
    vectors, written once: indexer, optimiser and scoring read these."""
    docs = _docs(spark, d)
    vocab = _vocab(docs)
    feats = FE.build_features(FE.stratified_split(docs), vocab, with_bucket=True)
    return materialize(feats.select("id", "category", "split", "features")), vocab


def _lr(spark, d):
    """(model, features, vocabulary): fitted on the training rows on every call."""
    feats, vocab = _lr_features(spark, d)
    return CL.logistic_regression_fit(feats.where(F.col("split") == "train")), feats, vocab


def logistic_regression_predictions(spark, d):
    model, feats, _ = _lr(spark, d)
    return CL.lr_predict(model, feats.where(F.col("split") == "test")).select("id", "category", "pred_lr")


def lr_probability_mass(spark, d):
    """H8, held against its optimum: without a penalty, the training rows'
    probabilities of each class sum to the class's count."""
    from pyspark.ml.functions import vector_to_array

    model, feats, _ = _lr(spark, d)
    names = CL.lr_labels(model)
    train = CL.lr_predict(model, feats.where(F.col("split") == "train"))
    p = vector_to_array("probability")
    sums = train.select("category", F.posexplode(p).alias("i", "p")).groupBy("i").agg(F.sum("p").alias("mass"))
    labels = spark.createDataFrame(list(enumerate(names)), "i int, category string")
    return sums.join(labels, "i").select("category", F.round("mass", 2).alias("mass"),
                                         F.lit(len(names)).alias("num_classes"))


def score_transactions(spark, d):
    model, feats, _ = _lr(spark, d)
    return CL.score_transactions(model, feats).select("id", "category", "predicted_category", "confidence",
                                                      "correct", "split")


def score_transactions_consistency(spark, d):
    """H11's facts per row: a known label, a confidence that a maximum of the
    classes' probabilities can have, a ``correct`` flag that says what it means."""
    model, feats, _ = _lr(spark, d)
    names = CL.lr_labels(model)
    s = CL.score_transactions(model, feats)
    return s.select("id", "category", "split", F.col("predicted_category").isin(names).alias("known_label"),
                    F.col("confidence").between(round(1 / len(names), 3) - 0.001, 1.0).alias("confidence_in_range"),
                    (F.col("correct") == (F.col("predicted_category") == F.col("category"))).alias("correct_agrees"))


def _attempts(spark, d):
    """H10's three attempts over one frame: vocabulary, split, tokenising and keyword
    rules once, the rows' small features written once, both models fitted on them.
    Returns the frame with all predictions and the attempts to compare."""
    docs = _docs(spark, d)
    vocab = _vocab(docs)
    f, cols = CL.nb_feature_frame(CL.keyword_predictions(FE.stratified_split(docs)), vocab)
    f = materialize(f.select("id", "category", "split", "amount", "words", *CL.NUMERIC_FEATURES, "pred_keyword"))
    train, test = F.col("split") == "train", F.col("split") == "test"
    scored = CL.gaussian_nb_predict(CL.gaussian_nb_fit(f.where(train), cols), f)
    attempts = [("Attempt 1: Keywords", "all rows", "pred_keyword", None), ("Attempt 2: Naive Bayes", "test rows", "pred_nb", test)]
    return f, vocab, scored, attempts, train, test


def model_comparison(spark, d):
    f, vocab, scored, attempts, train, test = _attempts(spark, d)
    vectors = materialize(FE.build_features(f.where(train), vocab, words_col="words").select("category", "features"))
    lr = CL.logistic_regression_fit(vectors)
    scored = CL.lr_predict(lr, FE.build_features(scored, vocab, words_col="words"))
    attempts = [*attempts, ("Attempt 3: Logistic Regression", "test rows", "pred_lr", test)]
    return EV.compare_attempts(EV.stacked_counts(scored, attempts))


def model_comparison_exact(spark, d):
    """The rows of the comparison that do not depend on an optimiser's path."""
    _, _, scored, attempts, *_ = _attempts(spark, d)
    return EV.compare_attempts(EV.stacked_counts(scored, attempts))


def attempts_overall(spark, d):
    """H9 per attempt from the one table of stacked counts: accuracy, no-information
    rate, kappa and rows of the keyword rules (all rows) and naive Bayes (test rows)."""
    _, _, scored, attempts, *_ = _attempts(spark, d)
    counts = materialize(EV.stacked_counts(scored, attempts))
    out = None
    for name, *_ in attempts:
        m = EV.evaluate_counts(counts.where(F.col("attempt") == name), [])["overall"]
        m = m.select(F.lit(name).alias("attempt"), *[F.round(c, 6).alias(c) for c in ("accuracy", "no_information_rate", "kappa")], "n")
        out = m if out is None else out.unionByName(m)
    return out


def lr_score_equations(spark, d):
    """H8 at its optimum: for every class and feature, the feature's sum over the
    class's training rows, and whether the model's expectation balances it."""
    model, feats, vocab = _lr(spark, d)
    e = CL.score_equations(model, feats.where(F.col("split") == "train"), FE.feature_names(vocab))
    return e.select("category", "feature", F.round("observed", 3).alias("observed"),
                    (F.abs("residual") <= BALANCE).alias("balanced"))


#: Greatest residual per training row at which a score equation counts as balanced.
BALANCE = 1e-4


def lr_per_class_metrics(spark, d):
    model, feats, _ = _lr(spark, d)
    scored = CL.lr_predict(model, feats.where(F.col("split") == "test"))
    return EV.per_class_metrics(scored, "pred_lr", CL.lr_labels(model))


def lr_per_class_support(spark, d):
    """What per-class metrics must add up to, whatever the predictions: support
    and prevalence per class, and detection rates that stay within them."""
    m = lr_per_class_metrics(spark, d)
    return m.select("class", "support", F.round("prevalence", 6).alias("prevalence"),
                    (F.col("detection_rate") <= F.least("prevalence", "detection_prevalence")).alias("rates_agree"))


def stored_model_suggestions(spark, d):
    """H12 and J3 with a stored model: fitted once, saved, loaded by a batch and by a
    stream. Row by row both give what the fitted model gives."""
    model, _, vocab = _lr(spark, d)
    path = LV.work_dir(spark, "model")
    CL.save_model(spark, path, model, vocab)
    loaded, words = CL.load_model(spark, path)
    docs = _docs(spark, d).select("id", "description", "amount")
    names = ["suggested", "suggested_category_id"]
    fitted = CL.suggest_category(model, docs, vocab, _cats(spark, d)).select("id", F.struct(*names).alias("fitted"))
    batch = CL.suggest_category(loaded, docs, words, _cats(spark, d)).select("id", F.struct(*names).alias("batch"))
    out = LV.work_dir(spark, "suggested")
    LV.drain(LV.run(LV.stream_suggest(_doc_stream(spark, d), loaded, words, _cats(spark, d)).select("id", *names), out, "append"))
    stream = LV.read_output(spark, out).select("id", F.struct(*names).alias("stream"))
    return fitted.join(batch, "id", "full").join(stream, "id", "full").select(
        "id", F.col("batch").eqNullSafe(F.col("fitted")).alias("batch_agrees"),
        F.col("stream").eqNullSafe(F.col("fitted")).alias("stream_agrees"))


def suggest_category(spark, d):
    model, _, vocab = _lr(spark, d)
    new = _docs(spark, d).select("id", "description", "amount")
    return CL.suggest_category(model, new, vocab, _cats(spark, d)).select("id", "suggested",
                                                                         "suggested_category_id")


_TOKENS = r"""list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'),
                      lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$'))"""
_VOCAB = f""",
dt AS (SELECT doc_id AS id, lang AS category, CAST(n_chars AS DECIMAL(12,2)) AS amount, text,
              {_TOKENS} AS toks FROM documents),
tc AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(toks) AS w FROM dt) GROUP BY w),
vocab AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS idx FROM tc
          ORDER BY n DESC, word LIMIT 80)"""
_SPLIT = """,
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY md5('42:' || CAST(id AS VARCHAR)), id)
                      <= (4 * count(*) OVER (PARTITION BY category) + 4) // 5 THEN 'train' ELSE 'test' END AS split
       FROM dt)"""

_reg(token_counts, _VOCAB + "\nSELECT word, n FROM tc")
_reg(vocabulary, _VOCAB + "\nSELECT word, n FROM vocab")
_reg(vocabulary_by_sketch, _VOCAB + "\nSELECT word, n FROM vocab")
_reg(document_terms, _VOCAB + """
SELECT DISTINCT dt.id, v.word FROM dt, vocab v WHERE list_contains(dt.toks, v.word)""")
_reg(keyword_classify_documents, f"""
SELECT doc_id AS id, lang AS category, {S.keyword_case('text')} AS pred_keyword FROM documents""")
_reg(keyword_accuracy, f"""
SELECT ROUND(avg(CASE WHEN {S.keyword_case('text')} = lang THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM documents""")
_BUCKET = ("CASE WHEN amount <= 10 THEN 'tiny' WHEN amount <= 25 THEN 'small' WHEN amount <= 50 THEN 'medium' "
           "WHEN amount <= 100 THEN 'large' WHEN amount <= 250 THEN 'xlarge' WHEN amount IS NOT NULL THEN 'huge' END")
_reg(amount_features_documents, f"""
SELECT id, ROUND(ln(1 + CAST(amount AS DOUBLE)), 6) AS log_amount, CAST(amount % 10 = 0 AS INTEGER) AS is_round,
       CAST(amount > 200 AS INTEGER) AS is_large, b AS amount_bucket,
       {", ".join(f"CAST(b = '{x}' AS INTEGER) AS amount_bucket{x}" for x in ("tiny", "small", "medium", "large", "xlarge", "huge"))}
FROM (SELECT doc_id AS id, CAST(n_chars AS DECIMAL(12,2)) AS amount, {_BUCKET} AS b FROM documents)""")
_reg(stratified_split, ", dt AS (SELECT doc_id AS id, lang AS category FROM documents)" + _SPLIT
     + "\nSELECT id, category, split FROM sp")
_reg(class_distribution, "SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")

_NB = _VOCAB + _SPLIT + f""",
feat AS (
  SELECT sp.id, sp.category, sp.split, v.idx AS f, CASE WHEN list_contains(sp.toks, v.word) THEN 1.0 ELSE 0.0 END AS x
  FROM sp, vocab v
  UNION ALL SELECT id, category, split, 80, ln(1 + CAST(amount AS DOUBLE)) FROM sp
  UNION ALL SELECT id, category, split, 81, CAST(amount % 10 = 0 AS DOUBLE) FROM sp
  UNION ALL SELECT id, category, split, 82, CAST(amount > 200 AS DOUBLE) FROM sp),
prior AS (SELECT category, count(*) AS n FROM sp WHERE split = 'train' GROUP BY category),
par AS (SELECT category, f, avg(x) AS m,
               CASE WHEN stddev_samp(x) IS NULL OR stddev_samp(x) <= 0 THEN 0.001 ELSE stddev_samp(x) END AS sd
        FROM feat WHERE split = 'train' GROUP BY category, f),
dens AS (SELECT t.id, t.category AS actual, p.category,
                exp(-0.5 * ((t.x - p.m) / p.sd) * ((t.x - p.m) / p.sd)) / (p.sd * sqrt(2 * pi())) AS dn
         FROM feat t JOIN par p ON t.f = p.f WHERE t.split = 'test'),
score AS (SELECT d.id, d.actual, d.category, ln(pr.n) + sum(ln(CASE WHEN dn <= 0 THEN 0.001 ELSE dn END)) AS s
          FROM dens d JOIN prior pr USING (category) GROUP BY d.id, d.actual, d.category, pr.n),
pred AS (SELECT id, actual AS category, arg_max(category, s) AS pred_nb FROM score GROUP BY id, actual)"""
_reg(gaussian_nb_predictions, _NB + "\nSELECT id, category, pred_nb FROM pred")
_reg(gaussian_nb_evaluation, _NB + """,
pc AS (SELECT pred_nb AS predicted, category AS actual, count(*) AS n FROM pred GROUP BY ALL),
ra AS (SELECT actual AS c, sum(n) AS a, sum(CASE WHEN predicted = actual THEN n ELSE 0 END) AS tp FROM pc GROUP BY 1),
ca AS (SELECT predicted AS c, sum(n) AS p FROM pc GROUP BY 1),
m AS (SELECT sum(coalesce(a, 0)) AS t, sum(coalesce(tp, 0)) AS d, sum(coalesce(a, 0) * coalesce(p, 0)) AS ap,
             max(coalesce(a, 0)) AS amax FROM ra FULL JOIN ca USING (c))
SELECT ROUND(d / t, 6) AS accuracy, ROUND(amax / t, 6) AS no_information_rate,
       ROUND((d / t - ap / (t * t)) / (1 - ap / (t * t)), 6) AS kappa, CAST(t AS BIGINT) AS n FROM m""")
_reg(bernoulli_nb_predictions, _VOCAB + _SPLIT + """,
bw AS (SELECT sp.id, sp.category, sp.split, v.word, CASE WHEN list_contains(sp.toks, v.word) THEN 1 ELSE 0 END AS x
       FROM sp, vocab v),
cls AS (SELECT category, count(*) AS n FROM sp WHERE split = 'train' GROUP BY category),
tot AS (SELECT sum(n) AS t FROM cls),
pw AS (SELECT b.category, b.word, (sum(b.x) + 1.0) / (c.n + 2.0) AS p
       FROM bw b JOIN cls c USING (category) WHERE b.split = 'train' GROUP BY b.category, b.word, c.n),
sc AS (SELECT t.id, t.category AS actual, p.category,
              ln(c.n / tot.t) + sum(CASE WHEN t.x = 1 THEN ln(p.p) ELSE ln(1 - p.p) END) AS s
       FROM bw t JOIN pw p ON t.word = p.word JOIN cls c ON c.category = p.category, tot
       WHERE t.split = 'test' GROUP BY t.id, t.category, p.category, c.n, tot.t)
SELECT id, actual AS category, arg_max(category, s) AS pred_bnb FROM sc GROUP BY id, actual""")
_reg(logistic_regression_predictions, None)
_reg(score_transactions, None)
_reg(model_comparison, None)
_reg(lr_per_class_metrics, None)
_reg(suggest_category, None)
_reg(document_term_matrix, _VOCAB + """
SELECT dt.id, v.word, CAST(list_contains(dt.toks, v.word) AS INTEGER) AS present FROM dt, vocab v""")
_DT = ", dt AS (SELECT doc_id AS id, lang AS category FROM documents)"
_reg(lr_probability_mass, _DT + _SPLIT + """
SELECT category, CAST(count(*) AS DOUBLE) AS mass,
       CAST((SELECT count(DISTINCT category) FROM sp) AS INTEGER) AS num_classes
FROM sp WHERE split = 'train' GROUP BY category""")
_reg(score_transactions_consistency, _DT + _SPLIT + """
SELECT id, category, split, true AS known_label, true AS confidence_in_range, true AS correct_agrees FROM sp""")
_reg(model_comparison_exact, _NB + f"""
SELECT 'Attempt 1: Keywords' AS attempt, 'all rows' AS scope,
       ROUND(100 * avg(CASE WHEN {S.keyword_case('text')} = lang THEN 1.0 ELSE 0.0 END), 1) AS accuracy FROM documents
UNION ALL
SELECT 'Attempt 2: Naive Bayes', 'test rows', ROUND(100 * avg(CASE WHEN pred_nb = category THEN 1.0 ELSE 0.0 END), 1)
FROM pred""")
_reg(attempts_overall, _NB + f""",
pc AS (SELECT 'Attempt 1: Keywords' AS attempt, {S.keyword_case('text')} AS predicted, category AS actual, count(*) AS n
       FROM dt GROUP BY ALL
       UNION ALL SELECT 'Attempt 2: Naive Bayes', pred_nb, category, count(*) FROM pred GROUP BY ALL),
ra AS (SELECT attempt, actual AS c, sum(n) AS a, sum(CASE WHEN predicted = actual THEN n ELSE 0 END) AS tp FROM pc GROUP BY 1, 2),
ca AS (SELECT attempt, predicted AS c, sum(n) AS p FROM pc GROUP BY 1, 2),
m AS (SELECT attempt, sum(coalesce(a, 0)) AS t, sum(coalesce(tp, 0)) AS d, sum(coalesce(a, 0) * coalesce(p, 0)) AS ap,
             max(coalesce(a, 0)) AS amax FROM ra FULL JOIN ca USING (attempt, c) GROUP BY attempt)
SELECT attempt, ROUND(d / t, 6) AS accuracy, ROUND(amax / t, 6) AS no_information_rate,
       ROUND((d / t - ap / (t * t)) / (1 - ap / (t * t)), 6) AS kappa, CAST(t AS BIGINT) AS n FROM m""")
_reg(lr_score_equations, _VOCAB + _SPLIT + f""",
one AS (
  SELECT sp.category, v.word AS feature, CASE WHEN list_contains(sp.toks, v.word) THEN 1.0 ELSE 0.0 END AS x FROM sp, vocab v WHERE split = 'train'
  UNION ALL SELECT category, 'log_amount', ln(1 + CAST(amount AS DOUBLE)) FROM sp WHERE split = 'train'
  UNION ALL SELECT category, 'is_round', CAST(amount % 10 = 0 AS DOUBLE) FROM sp WHERE split = 'train'
  UNION ALL SELECT category, 'is_large', CAST(amount > 200 AS DOUBLE) FROM sp WHERE split = 'train'
  UNION ALL SELECT category, 'amount_bucket' || b, CAST(coalesce({_BUCKET} = b, false) AS DOUBLE)
            FROM sp, (VALUES ('tiny'), ('small'), ('medium'), ('large'), ('xlarge'), ('huge')) bs(b) WHERE split = 'train'
  UNION ALL SELECT category, '(intercept)', 1.0 FROM sp WHERE split = 'train')
SELECT category, feature, ROUND(sum(x), 3) AS observed, true AS balanced FROM one GROUP BY 1, 2""")
_reg(stored_model_suggestions, """
SELECT doc_id AS id, true AS batch_agrees, true AS stream_agrees FROM documents WHERE length(text) >= 3""")
_reg(lr_per_class_support, _DT + _SPLIT + """,
te AS (SELECT * FROM sp WHERE split = 'test')
SELECT category AS class, count(*) AS support, ROUND(count(*) / (SELECT count(*) FROM te), 6) AS prevalence,
       true AS rates_agree FROM te GROUP BY category""")


# --------------------------------------------------------------------------
# LOESS trend line
# --------------------------------------------------------------------------

def loess_recent_months(spark, d):
    s = FC.last_n_series(_tx(spark, d, ["date", "amount"]), 6)
    return FC.loess_trend(s).select("month", F.round("total", 2).alias("total"),
                                    F.round("smooth", 2).alias("smooth"))


def loess_by_category(spark, d):
    s = _series(spark, d, ["category_id"])
    return FC.loess_trend(s).select("category_id", "month", F.round("total", 2).alias("total"),
                                    F.round("smooth", 2).alias("smooth"))


def _loess_sql(series_filter: str, key_out: str) -> str:
    return f""",
pts AS (SELECT k, m, x, row_number() OVER (PARTITION BY k ORDER BY m) - 1 AS i,
               count(*) OVER (PARTITION BY k) AS n FROM ms {series_filter}),
pairs AS (SELECT a.k, a.i, a.m, a.x AS total, a.n, CAST(b.i - a.i AS DOUBLE) AS u, b.x AS y,
                 CAST(abs(b.i - a.i) AS DOUBLE) AS dd
          FROM pts a JOIN pts b USING (k)),
hh AS (SELECT k, i, list_sort(list(dd))[greatest(CAST(floor(max(n) * 0.75) AS INTEGER), 1)] AS h
       FROM pairs GROUP BY k, i),
wts AS (SELECT p.*, CASE WHEN dd / h < 1 THEN pow(1 - pow(dd / h, 3), 3) ELSE 0 END AS w
        FROM pairs p JOIN hh USING (k, i)),
sm AS (SELECT k, i, m, total, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3,
              sum(w * u * u * u * u) AS s4, sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2
       FROM wts GROUP BY k, i, m, total),
sol AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det,
               t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2) AS num,
               s0 * s2 - s1 * s1 AS det_l FROM sm)
SELECT {key_out}strftime(m, '%Y-%m') AS month, ROUND(total, 2) AS total,
       ROUND(CASE WHEN abs(det) > 1e-9 * abs(s0 * s2 * s4) THEN num / det
                  WHEN abs(det_l) > 1e-9 * abs(s0 * s2) THEN (s2 * t0 - s1 * t1) / det_l
                  ELSE t0 / s0 END, 2) AS smooth
FROM sol"""


_reg(loess_recent_months, _ser_sql("0", "2") + _loess_sql(
    "WHERE m IN (SELECT m FROM ms ORDER BY m DESC LIMIT 6)", ""))
_reg(loess_by_category, _ser_sql("category_id", "1, 2") + _loess_sql("", "k AS category_id, "))


# --------------------------------------------------------------------------
# Structured Streaming (J1-J4): drained with availableNow, read back as batch
# --------------------------------------------------------------------------


def _raw_stream(spark, d):
    """The feed as a file stream of a few micro-batches, however many its files. Orders and
    customers are joined before the stream, where AQE splits a hot customer; a streaming
    join would not."""
    landed = LV.work_dir(spark, "feed")
    TB.raw_feed(spark, d).write.parquet(landed)
    feed = spark.read.parquet(landed)
    return LV.read_stream(spark, landed, feed.schema, max_files_per_trigger=LV.files_per_batch(len(feed.inputFiles())))


def stream_clean(spark, d):
    out = LV.work_dir(spark, "clean")
    s = LV.stream_clean(_raw_stream(spark, d), _cats(spark, d)).select(*TB.ALL_COLUMNS)
    LV.drain(LV.run(s, out, "append"))
    return portable(LV.read_output(spark, out).select(*TB.ALL_COLUMNS))


def stream_monthly_kpis(spark, d):
    out = LV.work_dir(spark, "kpis")
    cats = _cats(spark, d)
    s = LV.stream_monthly_kpis(LV.stream_clean(_raw_stream(spark, d), cats), cats)
    LV.drain(LV.run(s, out, "complete"))
    return _kpi_output(LV.read_output(spark, out, "complete"))


def stream_monthly_kpis_update(spark, d):
    """J2 in update mode: every batch writes the keys it changed, the latest counts."""
    out = LV.work_dir(spark, "kpis-update")
    cats = _cats(spark, d)
    s = LV.stream_monthly_kpis(LV.stream_clean(_raw_stream(spark, d), cats), cats)
    LV.drain(LV.run(s, out, "update"))
    return _kpi_output(LV.read_output(spark, out, "update", ["month", "category"]))


def _kpi_output(k):
    return k.select("month", "category", "n", R.round_money("total").alias("total"),
                    R.mean_money("total", "n").alias("avg_amount"))


def _doc_stream(spark, d):
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    return LV.read_stream(spark, f"{d}/documents.parquet", schema).select(
        F.col("doc_id").alias("id"), F.col("text").alias("description"),
        F.col("n_chars").cast("decimal(12,2)").alias("amount"))


def stream_suggest(spark, d):
    """The model is fitted and stored, the stream loads it."""
    fitted, _, words = _lr(spark, d)
    path = LV.work_dir(spark, "model")
    CL.save_model(spark, path, fitted, words)
    model, vocab = CL.load_model(spark, path)
    ds = _doc_stream(spark, d)
    out = LV.work_dir(spark, "suggest")
    LV.drain(LV.run(LV.stream_suggest(ds, model, vocab, _cats(spark, d))
                    .select("id", "suggested", "suggested_category_id"), out, "append"))
    return LV.read_output(spark, out).select("id", "suggested", "suggested_category_id")


DELETED_PRIORITY, MOVED_PRIORITY, LATE_PRIORITY = "5-LOW", "1-URGENT", "2-HIGH"


def change_batches(spark, d) -> list[DataFrame]:
    """A change log over orders, in the order in which its parts arrive:

    1. every order is inserted (seq 1);
    2. orders of the lowest priority are deleted by id alone (seq 4), urgent ones
       move to the next month and get a note, a column that is new (seq 3);
    3. late arrivals: older updates of the deleted and the moved orders (seq 2),
       which must change nothing, and an update of high-priority ones (seq 2), which
       also changes their category.
    """
    o = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), F.col("o_orderpriority").alias("p"),
        (F.col("o_custkey") % 13 + 1).alias("category_id"))
    none = F.lit(None)

    def change(rows, seq, op, date=F.col("date"), amount=F.col("amount"), note=none, category=F.col("category_id")):
        return rows.select("id", date.cast("date").alias("date"), amount.cast("decimal(12,2)").alias("amount"),
                           category.cast("long").alias("category_id"), note.cast("string").alias("note"),
                           F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"))

    low, urgent, high = (o.where(F.col("p") == x) for x in (DELETED_PRIORITY, MOVED_PRIORITY, LATE_PRIORITY))
    return [change(o, 1, "insert").drop("note"),
            change(low, 4, "delete", date=none, amount=none, category=none).unionByName(
                change(urgent, 3, "update", date=F.add_months("date", 1), note=F.lit("moved"))),
            change(low.unionByName(urgent), 2, "update", amount=F.lit(0.01)).unionByName(
                change(high, 2, "update", amount=F.col("amount") * 2, note=F.lit("late"), category=F.col("category_id") % 13 + 1))]


def _changed_table(spark, d, root: str) -> str:
    """The table that the change log leaves, applied part by part."""
    table = f"{root}/table"
    for i, part in enumerate(change_batches(spark, d)):  # a later part may have more columns
        part.write.parquet(f"{root}/in-{i}")
        LV.drain(LV.stream_change_log(LV.read_stream(spark, f"{root}/in-{i}", part.schema), table,
                                      checkpoint=f"{root}/checkpoint-{i}"))
    return table


def stream_kpis_after_changes(spark, d):
    """J2 behind J4: the KPIs follow the change log through its signed rows, batch by batch."""
    root = LV.work_dir(spark, "kpis-after")
    deltas = LV.stream_deltas(spark, _changed_table(spark, d, root), max_files_per_trigger=2)
    LV.drain(LV.run(LV.stream_monthly_kpis(deltas, MT.seed_categories(spark), "_sign"), f"{root}/kpis", "complete"))
    return _kpi_output(LV.live_kpis(LV.read_output(spark, f"{root}/kpis", "complete")))


def stream_change_log(spark, d):
    table = _changed_table(spark, d, LV.work_dir(spark, "changes"))
    return portable(LV.read_changes(spark, table).select("id", "date", F.col("amount").cast("double").alias("amount"),
                                                         "note"))


_reg(stream_clean, """
SELECT id, CAST(date AS VARCHAR) AS date, description, CAST(amount AS DOUBLE) AS amount,
       category_id, category_raw, is_recurring FROM transactions""")
_KPI_SQL = f"""
SELECT {M.replace('date', 't.date')} AS month, c.name AS category, count(*) AS n, {S.r2('sum(t.amount)')} AS total,
       {S.mean2('sum(t.amount)', 'count(*)')} AS avg_amount
FROM transactions t JOIN categories c ON t.category_id = c.id GROUP BY 1, 2"""
_reg(stream_monthly_kpis, _KPI_SQL)
_reg(stream_monthly_kpis_update, _KPI_SQL)
_reg(stream_suggest, None)
_CHANGES_SQL = f"""
, ch AS (
  SELECT o_orderkey AS id, o_orderdate AS date, CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
         o_custkey % 13 + 1 AS category_id, NULL AS note, 1 AS seq, 'insert' AS op, o_orderpriority AS p FROM orders
  UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, 4, 'delete', o_orderpriority FROM orders
            WHERE o_orderpriority = {S.q(DELETED_PRIORITY)}
  UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH, CAST(o_totalprice AS DECIMAL(12,2)), o_custkey % 13 + 1,
            'moved', 3, 'update', o_orderpriority FROM orders WHERE o_orderpriority = {S.q(MOVED_PRIORITY)}
  UNION ALL SELECT o_orderkey, o_orderdate, 0.01, o_custkey % 13 + 1, NULL, 2, 'update', o_orderpriority FROM orders
            WHERE o_orderpriority IN ({S.q(DELETED_PRIORITY)}, {S.q(MOVED_PRIORITY)})
  UNION ALL SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(12,2)) * 2, (o_custkey % 13 + 1) % 13 + 1, 'late', 2,
            'update', o_orderpriority FROM orders WHERE o_orderpriority = {S.q(LATE_PRIORITY)}),
lastop AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM ch),
after AS (SELECT * FROM lastop WHERE n = 1 AND op <> 'delete')"""
_reg(stream_change_log, _CHANGES_SQL + """
SELECT id, CAST(CAST(date AS DATE) AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount, note FROM after""")
_reg(stream_kpis_after_changes, _CHANGES_SQL + f"""
SELECT {M.replace('date', 't.date')} AS month, c.name AS category, count(*) AS n, {S.r2('sum(t.amount)')} AS total,
       {S.mean2('sum(t.amount)', 'count(*)')} AS avg_amount
FROM after t JOIN categories c ON t.category_id = c.id GROUP BY 1, 2""")


# --------------------------------------------------------------------------
# CSV ingest, validation, ids and load counts
# --------------------------------------------------------------------------

# Dirt rules of the CSV fixture (derived from the order/customer columns); every
# cleaning rule and every reject reason has rows:
# * descriptions arrive lower-cased with a leading tab and a trailing " *"; those
#   of priority '2-HIGH' name a recurring payment, those of status 'O' and
#   priority '1-URGENT' consist of symbols only;
# * orders of status 'P' carry an unparseable date, those of priority '5-LOW' a
#   negative amount, those of status 'F' and priority '4-NOT SPECIFIED' none;
# * categories are padded; BUILDING arrives as ' Food  Drink ', MACHINERY as an
#   unknown name, FURNITURE without a category;
# * urgent orders of status 'F' arrive twice, urgent ones of status 'P' without id.
DIRTY_DATE_STATUS = "P"
NEGATIVE_PRIORITY = "5-LOW"
RELABEL_SEGMENT = "BUILDING"
RECURRING_PRIORITY, RECURRING_TEXT = "2-HIGH", "netflix subscription "
UNKNOWN_SEGMENT, UNKNOWN_NAME = "MACHINERY", "Mystery Box"
NO_CATEGORY_SEGMENT = "FURNITURE"


def dirty_feed(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                         "o_totalprice", "o_orderdate", "o_orderpriority")
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    amount = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    status, priority, segment = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("c_mktsegment")
    urgent = priority == "1-URGENT"
    feed = j.select(
        F.when(~(urgent & (status == "P")), F.col("o_orderkey")).alias("Id"),
        F.when(status == DIRTY_DATE_STATUS, F.lit("not-a-date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Date"),
        F.when(urgent & (status == "O"), F.lit("\t***"))
        .when(priority == RECURRING_PRIORITY, F.concat(F.lit("\t" + RECURRING_TEXT), F.lower("c_name"), F.lit(" *")))
        .otherwise(F.concat(F.lit("\t"), F.lower("c_name"), F.lit(" *"))).alias("Description"),
        F.when(priority == NEGATIVE_PRIORITY, F.concat(F.lit("-"), amount))
        .when((priority == "4-NOT SPECIFIED") & (status == "F"), F.lit("n/a")).otherwise(amount).alias("Amount"),
        F.when(segment == RELABEL_SEGMENT, F.lit(" Food  Drink "))
        .when(segment == UNKNOWN_SEGMENT, F.lit(f"  {UNKNOWN_NAME} "))
        .when(segment != NO_CATEGORY_SEGMENT, F.concat(F.lit("  "), segment, F.lit(" "))).alias("Category"),
        (urgent & (status == "F")).alias("twice"))
    again = F.explode(F.when(F.col("twice"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return feed.withColumn("copy", again).drop("twice", "copy")


def _csv_feed(spark, d):
    path = LV.work_dir(spark, "csv")
    SK.write_csv(dirty_feed(spark, d), path)
    schema = T.StructType([T.StructField("Id", T.StringType())] + list(TB.RAW_FEED.fields))
    raw = TB.read_transactions_csv(spark, path, schema=schema)
    return TB.normalize_column_names(raw).withColumn("id", F.col("id").cast("long"))


def csv_ingest(spark, d):
    clean = CLN.clean_transactions(_csv_feed(spark, d), keep=["id"])
    return portable(CLN.map_categories(clean, _cats(spark, d)).select(*TB.ALL_COLUMNS))


def validation_summary(spark, d):
    """A8's rejects by reason. The feed's unknown category name becomes an id
    that no category has."""
    cats = _cats(spark, d)
    raw = _csv_feed(spark, d)
    typed = raw.select("id", F.try_to_date("date", "yyyy-MM-dd").alias("date"),
                       TX_FN.clean_description("description").alias("description"),
                       F.col("amount").try_cast("decimal(12,2)").alias("amount"),
                       TX_FN.normalize_category("category").alias("category_raw"))
    typed = CLN.category_id_by_name(typed, cats, "category_raw")
    typed = typed.withColumn("category_id", F.when(
        F.col("category_raw") == TX_FN.normalize_category(F.lit(UNKNOWN_NAME)), F.lit(-1)).otherwise(F.col("category_id")))
    _, rejects = MT.validate_transactions(typed, cats)
    return rejects.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))


def load_counts(spark, d):
    """A13 over a real load: rows read, valid, and found in the stored table."""
    cats = _cats(spark, d)
    return MT.load_counts(_csv_feed(spark, d).drop("id"), CLN.clean_transactions, LV.work_dir(spark, "load"),
                          lambda t: MT.fill_defaults(CLN.map_categories(t, cats)))


def keyword_suggestions(spark, d):
    """H12 without a model, on the feed: keyword rules, the guard of at least
    three characters (B18), and the suggestion's category id (B17)."""
    feed = _csv_feed(spark, d).where(F.col("id").isNotNull()).dropDuplicates(["id"]).select(
        "id", TX_FN.clean_description("description").alias("description"), "amount")
    return CL.suggest_category(None, feed, [], _cats(spark, d)).select("id", "suggested", "suggested_category_id")


def keyword_accuracy_feed(spark, d):
    """D19 of the keyword rules where they do find something: the recurring
    payments of the feed belong to the rules' subscription label."""
    feed = _csv_feed(spark, d).select(
        TX_FN.clean_description("description").alias("description"),
        F.when(F.col("description").contains(RECURRING_TEXT.strip()), "subscriptions")
        .otherwise(TX_FN.normalize_category("category")).alias("category"))
    return EV.accuracy(CL.keyword_predictions(feed), "pred_keyword").select(F.round("accuracy", 6).alias("accuracy"))


def assign_ids(spark, d):
    t = _tx(spark, d, ["id", "date"])
    return MT.assign_ids(t.withColumnRenamed("id", "old_id"), start=1000, order_cols=("date", "old_id"),
                         id_col="new_id").select("old_id", "new_id")


def category_colors(spark, d):
    totals = DB.category_totals_all(*_both(spark, d, ["amount", "category_id"]))
    return CLN.color_lookup(totals, _cats(spark, d), "category")



_DIRTY = f""",
once AS (
  SELECT CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'P' THEN NULL ELSE o.o_orderkey END AS id,
         CASE WHEN o.o_orderstatus = {S.q(DIRTY_DATE_STATUS)} THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS date,
         CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'O' THEN chr(9) || '***'
              WHEN o.o_orderpriority = {S.q(RECURRING_PRIORITY)} THEN chr(9) || {S.q(RECURRING_TEXT)} || lower(c.c_name) || ' *'
              ELSE chr(9) || lower(c.c_name) || ' *' END AS raw_description,
         CASE WHEN o.o_orderpriority = {S.q(NEGATIVE_PRIORITY)} THEN -CAST(o.o_totalprice AS DECIMAL(12,2))
              WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'F' THEN NULL
              ELSE CAST(o.o_totalprice AS DECIMAL(12,2)) END AS amount,
         CASE WHEN c.c_mktsegment = {S.q(RELABEL_SEGMENT)} THEN 'food_drink'
              WHEN c.c_mktsegment = {S.q(UNKNOWN_SEGMENT)} THEN {S.q(UNKNOWN_NAME.lower().replace(" ", "_"))}
              WHEN c.c_mktsegment <> {S.q(NO_CATEGORY_SEGMENT)} THEN {S.norm_cat('c.c_mktsegment')} END AS category_raw,
         CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F' THEN 2 ELSE 1 END AS copies
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
dirty AS (SELECT id, date, {S.clean_desc("raw_description")} AS description, raw_description, amount, category_raw
          FROM once, range(0, 2) k(i) WHERE k.i < copies)"""

_reg(csv_ingest, _DIRTY + f"""
SELECT d.id, CAST(d.date AS VARCHAR) AS date, d.description, CAST(d.amount AS DOUBLE) AS amount,
       COALESCE(cf.id, (SELECT min(id) FROM categories WHERE name = 'uncategorized')) AS category_id,
       d.category_raw,
       COALESCE(CAST(regexp_matches(d.description, {S.q(RECURRING_PATTERN)}) AS INTEGER), 0)
         AS is_recurring
FROM dirty d LEFT JOIN categories cf ON cf.name = d.category_raw
WHERE d.date IS NOT NULL AND d.amount > 0""")

_reg(validation_summary, _DIRTY + f""",
n AS (SELECT id, count(*) AS c FROM dirty WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
SELECT reason, count(*) AS n FROM (
  SELECT 'date is null' AS reason FROM dirty WHERE date IS NULL
  UNION ALL SELECT 'amount not positive' FROM dirty WHERE amount <= 0
  UNION ALL SELECT 'amount is null or out of range' FROM dirty WHERE amount IS NULL
  UNION ALL SELECT 'description is empty' FROM dirty WHERE description IS NULL OR description = ''
  UNION ALL SELECT 'id is null' FROM dirty WHERE id IS NULL
  UNION ALL SELECT 'duplicate id' FROM dirty WHERE id IN (SELECT id FROM n)
  UNION ALL SELECT 'unknown category' FROM dirty
            WHERE category_raw = {S.q(UNKNOWN_NAME.lower().replace(" ", "_"))}) GROUP BY reason""")

_reg(load_counts, _DIRTY + """
SELECT CAST(count(*) AS BIGINT) AS rows_read,
       CAST(count(*) FILTER (WHERE date IS NOT NULL AND amount > 0) AS BIGINT) AS rows_valid,
       CAST(count(*) FILTER (WHERE date IS NOT NULL AND amount > 0) AS BIGINT) AS rows_loaded FROM dirty""")

_reg(keyword_suggestions, _DIRTY + f""",
k AS (SELECT DISTINCT id, {S.keyword_case('description')} AS suggested FROM dirty
      WHERE id IS NOT NULL AND length(description) >= 3)
SELECT k.id, k.suggested, c.id AS suggested_category_id FROM k LEFT JOIN categories c ON c.name = k.suggested""")

_reg(keyword_accuracy_feed, _DIRTY + f"""
SELECT ROUND(avg(CASE WHEN {S.keyword_case('description')} =
                           CASE WHEN contains(raw_description, {S.q(RECURRING_TEXT.strip())}) THEN 'subscriptions'
                                ELSE category_raw END THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM dirty""")

_reg(assign_ids, """
SELECT id AS old_id, CAST(1000 + row_number() OVER (ORDER BY date, id) AS BIGINT) AS new_id FROM transactions""")

_reg(category_colors, """
SELECT c.name AS category, CAST(ROUND(COALESCE(sum(t.amount), 0), 2) AS DOUBLE) AS total, c.color_hex
FROM categories c LEFT JOIN transactions t ON t.category_id = c.id GROUP BY c.name, c.color_hex""")


# --------------------------------------------------------------------------
# Naive Bayes confusion matrix and per-class metrics (D18, D20) with oracles
# --------------------------------------------------------------------------

def _nb_scored(spark, d):
    f, model = _gaussian_nb(spark, d)
    return CL.gaussian_nb_predict(model, f.where(F.col("split") == "test")), [c[0] for c in model["classes"]]


def gaussian_nb_confusion(spark, d):
    scored, labels = _nb_scored(spark, d)
    return EV.confusion_matrix(scored, "pred_nb", sorted(labels))


CONFUSION_LABELS = ["de", "en", "es", "fr"]


def gaussian_nb_confusion_wide(spark, d):
    """D18 in its printed shape: a row per prediction, a column per true label."""
    scored, _ = _nb_scored(spark, d)
    return EV.confusion_matrix_wide(scored, "pred_nb", CONFUSION_LABELS)


def gaussian_nb_per_class(spark, d):
    scored, labels = _nb_scored(spark, d)
    m = EV.per_class_metrics(scored, "pred_nb", sorted(labels))
    return m.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "specificity",
                                                                 "balanced_accuracy")], "support")


_NB_LABELS = ",\nlabs AS (SELECT DISTINCT lang AS l FROM documents)"
_reg(gaussian_nb_confusion, _NB + _NB_LABELS + """
SELECT p.l AS predicted, a.l AS actual, CAST(count(pr.id) AS BIGINT) AS n
FROM labs p CROSS JOIN labs a LEFT JOIN pred pr ON pr.pred_nb = p.l AND pr.category = a.l
GROUP BY p.l, a.l""")
_reg(gaussian_nb_confusion_wide, _NB + f"""
SELECT pred_nb AS predicted,
       {", ".join(f"count(*) FILTER (WHERE category = '{x}') AS {x}" for x in CONFUSION_LABELS)} FROM pred GROUP BY 1""")
_reg(gaussian_nb_per_class, _NB + _NB_LABELS + """,
cm AS (SELECT p.l AS predicted, a.l AS actual, count(pr.id) AS n
       FROM labs p CROSS JOIN labs a LEFT JOIN pred pr ON pr.pred_nb = p.l AND pr.category = a.l GROUP BY 1, 2),
st AS (SELECT l AS class,
              (SELECT sum(n) FROM cm WHERE predicted = l AND actual = l) AS tp,
              (SELECT sum(n) FROM cm WHERE actual = l) AS sup,
              (SELECT sum(n) FROM cm WHERE predicted = l) AS pp,
              (SELECT sum(n) FROM cm) AS tot FROM labs),
m AS (SELECT class, tp / nullif(pp, 0) AS prec, tp / nullif(sup, 0) AS rec,
             (tot - tp - (pp - tp) - (sup - tp)) / nullif(tot - tp - (sup - tp), 0) AS spec, sup FROM st)
SELECT class, ROUND(prec, 6) AS precision, ROUND(rec, 6) AS recall,
       ROUND(2 * prec * rec / nullif(prec + rec, 0), 6) AS f1, ROUND(spec, 6) AS specificity,
       ROUND((rec + spec) / 2, 6) AS balanced_accuracy, CAST(sup AS BIGINT) AS support FROM m""")


# --------------------------------------------------------------------------
# Table maintenance round trip
# --------------------------------------------------------------------------

def table_round_trip(spark, d):
    """Reload the fixture table (A5 + A10), append the rows of one month again
    as new transactions with category names (A6: ids continue after the stored
    maximum, A9), delete exactly those ids from the store (A7), and read the table
    back: it must equal the original."""
    root = LV.work_dir(spark, "table")
    t, cats = _both(spark, d)
    MT.reload_transactions(MT.fill_defaults(t), root)
    again = t.where(in_month(REPORT_MONTH)).select("date", "description", "amount",
                                                   F.col("category_raw").alias("category"))
    written = MT.append_transactions(spark, root, again, cats)
    MT.delete_stored(spark, root, written.select("id"))
    return portable(MT.read_transactions(spark, root).select(*TB.ALL_COLUMNS))


def append_by_name(spark, d):
    """A6's rows per category: names became ids, ids follow the stored maximum
    without gaps."""
    root = LV.work_dir(spark, "append")
    t, cats = _both(spark, d)
    MT.reload_transactions(MT.fill_defaults(t), root)
    last = t.agg(F.max("id")).scalar()
    again = t.where(in_month(REPORT_MONTH)).select("date", "description", "amount",
                                                   F.col("category_raw").alias("category"))
    MT.append_transactions(spark, root, again, cats)
    new = MT.read_transactions(spark, root).where(F.col("id") > last)
    span = new.agg((F.max("id") - F.min("id") + 1).alias("ids"), (F.min("id") - F.first(last)).alias("step")).first()
    return new.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total")) \
        .withColumns({"ids": F.lit(span.ids), "step": F.lit(span.step)})


def stored_defaults(spark, d):
    """A10: what the table fills in, per category."""
    root = LV.work_dir(spark, "defaults")
    t = _tx(spark, d, ["id", "date", "description", "amount", "category_id"])
    MT.reload_transactions(MT.fill_defaults(t), root)
    s = MT.read_transactions(spark, root)
    return s.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("created_at").alias("stamped"), F.count("predicted_cat").alias("predicted"),
        F.count("confidence").alias("with_confidence"), F.sum("is_recurring").alias("recurring"))


def stored_predictions(spark, d):
    """H11's write-back: the keyword rules' labels for one month of the feed are
    stored with their confidence; every other row keeps NULL."""
    root = LV.work_dir(spark, "predicted")
    t = _tx(spark, d, ["id", "date", "description", "amount", "category_id"])
    MT.reload_transactions(MT.fill_defaults(t), root)
    scored = CL.keyword_predictions(t.where(in_month(REPORT_MONTH))).select(
        "id", F.col("pred_keyword").alias("predicted_cat"), F.lit(1.0).alias("confidence"))
    MT.store_predictions(spark, root, scored)
    return MT.read_transactions(spark, root).select("id", "predicted_cat", F.col("confidence").cast("double").alias("confidence"))


def export_csv(spark, d):
    """B19 + A11: the export written as CSV and read back."""
    path = LV.work_dir(spark, "export")
    t, cats = _both(spark, d, ["id", "date", "description", "amount", "category_id"])
    out = DB.export_projection(t, cats)
    SK.write_csv(out, path)
    return spark.read.schema(out.schema).option("header", True).csv(path)


def category_projection_csv(spark, d):
    """D16 + A11: the category forecasts written as CSV and read back."""
    path = LV.work_dir(spark, "projection")
    out = category_projection(spark, d)
    SK.write_csv(out, path)
    return spark.read.schema(out.schema).option("header", True).csv(path)


def summary_json(spark, d):
    """The model summary written as JSON and read back, one row per class."""
    path = LV.work_dir(spark, "summary")
    f, model = _gaussian_nb(spark, d)
    scored = materialize(CL.gaussian_nb_predict(model, f.where(F.col("split") == "test")).select("category", "pred_nb"))
    per_class = EV.per_class_metrics(scored, "pred_nb", [c[0] for c in model["classes"]])
    accuracy = EV.accuracy(scored, "pred_nb")
    comparison = EV.model_comparison([("Attempt 2: Naive Bayes", accuracy, "test rows")])
    SK.write_summary_json(SK.summary_document(comparison, per_class, "Naive Bayes", accuracy), path)
    back = spark.read.json(path).select("best_model", F.round("best_accuracy", 6).alias("best_accuracy"),
                                        F.col("model_comparison")[0]["accuracy"].alias("percent"),
                                        F.explode("per_class").alias("c"))
    return back.select("best_model", "best_accuracy", "percent", F.col("c.class").alias("class"),
                       F.round("c.Recall", 6).alias("recall"))


_reg(table_round_trip, """
SELECT id, CAST(date AS VARCHAR) AS date, description, CAST(amount AS DOUBLE) AS amount,
       category_id, category_raw, is_recurring FROM transactions""")
_reg(append_by_name, f"""
, m AS (SELECT * FROM transactions WHERE {M} = {S.q(REPORT_MONTH)})
SELECT category_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total,
       CAST((SELECT count(*) FROM m) AS BIGINT) AS ids, CAST(1 AS BIGINT) AS step FROM m GROUP BY category_id""")
_reg(stored_defaults, """
SELECT category_id, count(*) AS n, count(*) AS stamped, CAST(0 AS BIGINT) AS predicted,
       CAST(0 AS BIGINT) AS with_confidence, CAST(0 AS BIGINT) AS recurring FROM transactions GROUP BY category_id""")
_reg(stored_predictions, f"""
SELECT id, CASE WHEN {M} = {S.q(REPORT_MONTH)} THEN {S.keyword_case('description')} END AS predicted_cat,
       CASE WHEN {M} = {S.q(REPORT_MONTH)} THEN 1.0 END AS confidence FROM transactions""")
SPARK["export_csv"], SQL["export_csv"] = export_csv, SQL["export_projection"]
SPARK["category_projection_csv"], SQL["category_projection_csv"] = category_projection_csv, SQL["category_projection"]
_reg(summary_json, _NB + """,
t AS (SELECT avg(CASE WHEN pred_nb = category THEN 1.0 ELSE 0.0 END) AS a FROM pred)
SELECT 'Naive Bayes' AS best_model, ROUND((SELECT a FROM t), 6) AS best_accuracy,
       ROUND((SELECT a FROM t) * 100, 1) AS percent, category AS class,
       ROUND(avg(CASE WHEN pred_nb = category THEN 1.0 ELSE 0.0 END), 6) AS recall FROM pred GROUP BY category""")
