from pyspark.sql import functions as F

from ledger_spark.operators import dashboard as DB
from ledger_spark.operators import reports as R
from tests.conftest import tx


def test_month_over_month_uses_previous_present_month(spark):
    t = tx(spark, [(1, "2024-01-05", "A", "100.00", None), (2, "2024-03-05", "B", "150.00", None)])
    rows = R.month_over_month(t).orderBy("month").collect()
    assert rows[0].mom_change is None and rows[1].mom_change == 50.0 and rows[1].mom_pct_change == 50.0


def test_top_expenses_tie_break_by_id(spark, cats):
    rows = [(i, "2024-01-01", "RENT", "1500.00", "rent") for i in (5, 3, 9)]
    t = tx(spark, rows, cats)
    got = [r.id for r in R.top_expenses(t, cats, 2).collect()]
    assert got == [3, 5]


def test_mean_is_exact_half_up(spark):
    # 0.01 + 0.02 = 0.03 over 2 rows = 0.015 -> 0.02 (half up, no double rounding)
    t = tx(spark, [(1, "2024-01-01", "A", "0.01", None), (2, "2024-01-02", "B", "0.02", None)])
    assert R.monthly_summary(t).first().avg_transaction == 0.02


def test_percent_denominator_includes_uncategorised(spark, cats):
    t = tx(spark, [(1, "2024-01-01", "A", "75.00", "rent"), (2, "2024-01-02", "B", "25.00", None)], cats)
    rows = R.by_category(t, cats).collect()
    assert len(rows) == 1 and rows[0].pct_of_total == 75.0


def test_budget_without_spend_is_over_and_sorted_first(spark, cats):
    ids = {r.name: r.id for r in cats.collect()}
    b = spark.createDataFrame([(1, ids["rent"], "2024-06", 1000), (2, ids["health"], "2024-06", 50)],
                              "id long, category_id long, month string, budget_amt int") \
        .withColumn("budget_amt", F.col("budget_amt").cast("decimal(12,2)"))
    t = tx(spark, [(1, "2024-06-03", "X", "900.00", "rent")], cats)
    out = R.budget_vs_actual(b, cats, t, "2024-06").collect()
    assert out[0].category == "health" and out[0].variance is None and "Over" in out[0].status
    assert out[1].variance == -100.0 and "Under" in out[1].status
    under = R.budget_vs_actual(b, cats, t, "2024-06", no_spend="under").where("category = 'health'").first()
    assert under.actual_spent == 0.0 and "Under" in under.status


def test_rolling_average_counts_rows_present(spark):
    rows = [(i, f"2024-01-{d:02d}", "A", "10.00", None) for i, d in enumerate([1, 2, 10], 1)]
    rows.append((9, "2024-01-20", "B", "40.00", None))
    out = R.rolling_average(tx(spark, rows), 2).orderBy("date").collect()
    assert [r.rolling_7d_avg for r in out] == [10.0, 10.0, 10.0, 25.0]


def test_recurring_needs_three_months(spark):
    rows = [(1, "2024-01-01", "NETFLIX", "9.99", None), (2, "2024-02-01", "NETFLIX", "9.99", None),
            (3, "2024-03-01", "NETFLIX", "9.99", None), (4, "2024-01-01", "GYM", "30.00", None),
            (5, "2024-01-15", "GYM", "30.00", None)]
    out = R.recurring(tx(spark, rows)).collect()
    assert [(r.description, r.months_seen, r.total_paid) for r in out] == [("NETFLIX", 3, 29.97)]


def test_kpis_empty_month(spark, cats):
    t = tx(spark, [(1, "2024-01-05", "A", "10.00", "rent")], cats)
    k = DB.kpi_total_avg(t, cats, "2025-01").first()
    assert k.total_spent == 0.0 and k.avg_amount is None
    assert DB.kpi_top_category(t, cats, "2025-01").first().top_category == "None"
    d = DB.kpi_avg_delta(t, cats, "2024-02").first()
    assert d.pct_change is None and d.direction is None


def test_top_category_ties_alphabetical(spark, cats):
    t = tx(spark, [(1, "2024-01-05", "A", "10.00", "rent"), (2, "2024-01-06", "B", "10.00", "health")], cats)
    assert DB.kpi_top_category(t, cats, "2024-01").first().top_category == "HEALTH"


def test_category_projection_short_series(spark):
    cm = spark.createDataFrame([("a", "2024-01", 10.0), ("a", "2024-02", 20.0)],
                               "category string, month string, total double") \
        .withColumn("total", F.col("total").cast("decimal(22,2)"))
    r = DB.category_projection(cm, 3).first()
    assert (r.avg_monthly, r.last_month, r.trend, r.forecast) == (15.0, 20.0, 5.0, 15.0)
    o = DB.category_outlook(cm, 2).first()
    assert o.pct == 0.0 and o.direction == "flat"


def test_dashboard_panels_run(spark):
    from ledger_spark.sources import tables as TB
    from tests.conftest import SF_SMALL

    t = TB.transactions(spark, SF_SMALL)
    p = DB.panels(t, TB.categories(spark, SF_SMALL), "1998-06")
    assert set(p) >= {"kpi_total_avg", "kpi_avg_delta", "top_categories", "trend", "forecast_panel"}
    assert p["kpi_total_avg"].first().n_transactions > 0
    assert p["trend"].count() == 6 and p["forecast_panel"].count() == 1


def test_evaluate_wrapper(spark):
    from ledger_spark.operators.evaluate import evaluate

    scored = spark.createDataFrame([("a", "a"), ("b", "a")], "pred string, category string")
    ev = evaluate(scored, "pred", ["a", "b"])
    assert ev["accuracy"].first().accuracy == 0.5 and ev["confusion"].count() == 4


def test_kpi_delta_value_and_direction(spark, cats):
    t = tx(spark, [(1, "2024-01-05", "A", "100.00", "rent"), (2, "2024-01-06", "B", "200.00", "rent"),
                   (3, "2024-02-05", "C", "120.00", "rent"), (4, "2024-02-06", "D", "60.00", None)], cats)
    d = DB.kpi_avg_delta(t, cats, "2024-02").first()
    # current mean over categorised rows only (120), previous mean over all rows (150)
    assert d.avg_amount == 120.0 and d.previous_avg == 150.0 and d.pct_change == -20.0 and d.direction == "down"


def test_merchant_search_case_insensitive_and_ordered(spark):
    t = tx(spark, [(2, "2024-01-02", "Starbucks Lisboa", "4.50", None), (1, "2024-01-01", "CAFE CENTRAL", "2.00", None),
                   (3, "2024-01-03", "Rent", "900.00", None)])
    rows = R.merchant_search(t).collect()
    assert [r.id for r in rows] == [1, 2]


def test_color_lookup_unknown_is_null(spark, cats):
    from ledger_spark.operators.clean import color_lookup

    df = spark.createDataFrame([(" Rent ",), ("nope",)], "category string")
    got = {r.category: r.color_hex for r in color_lookup(df, cats).collect()}
    assert got == {" Rent ": "#EF4444", "nope": None}


def _spread(spark, cats):
    rows = [(i, f"2024-{1 + (i * 7) % 5:02d}-{1 + (i * 11) % 28:02d}", f"SHOP{i % 4}", f"{(i * 37) % 90 + 1}.00",
             ("rent", "health", "travel", "cash")[i % 4]) for i in range(80)]
    return tx(spark, rows, cats)


def test_reports_come_in_their_order(spark, cats):
    t = _spread(spark, cats)
    orders = {
        "monthly_summary": (R.monthly_summary(t), lambda r: r.month),
        "load_summary": (R.load_summary(t), lambda r: r.month),
        "by_category": (R.by_category(t, cats), lambda r: (-r.total_spent, r.category)),
        "month_category": (R.month_category(t, cats), lambda r: (r.month, -r.total_spent, r.category)),
        "top_expenses": (R.top_expenses(t, cats, 10), lambda r: -r.amount),
        "recurring": (R.recurring(t, 2), lambda r: (-r.total_paid, r.description)),
        "month_over_month": (R.month_over_month(t), lambda r: r.month),
        "merchant_search": (R.merchant_search(t, ["shop"]), lambda r: (r.date, r.id)),
        "rolling_average": (R.rolling_average(t), lambda r: r.date),
    }
    for name, (df, key) in orders.items():
        rows = [key(r) for r in df.collect()]
        assert len(rows) > 1 and rows == sorted(rows), name


def test_fill_gaps(spark):
    t = tx(spark, [(1, "2024-01-30", "A", "10.00", None), (2, "2024-04-02", "A", "30.00", None)])
    assert [(r.month, r.total_spent, r.mom_change) for r in R.month_over_month(t, fill_gaps=True).collect()] == [
        ("2024-01", 10.0, None), ("2024-02", 0.0, -10.0), ("2024-03", 0.0, 0.0), ("2024-04", 30.0, 30.0)]
    days = R.rolling_average(t, 2, fill_gaps=True).collect()
    assert len(days) == 64 and days[1].rolling_7d_avg == 5.0 and days[2].rolling_7d_avg == 0.0
