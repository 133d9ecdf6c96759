import math

import numpy as np
from pyspark.sql import functions as F

from ledger_spark.operators import forecast as FC

Y = [1882.99, 1846.89, 1842.09, 1855.69, 2008.99, 2381.60, 1896.49, 1965.20, 1852.69, 1780.79,
     1828.79, 1827.80, 2391.69, 1838.60, 1843.99, 1810.69, 1856.59, 2091.20, 1849.89, 1856.50, 1530.19]


def series(spark, ys, key="a"):
    return spark.createDataFrame([(key, [float(v) for v in ys], len(ys))], "k string, xs array<double>, n int") \
        .withColumn("first_month", F.to_date(F.lit("2024-07-01"))) \
        .withColumn("last_month", F.add_months("first_month", F.col("n") - 1)) \
        .withColumn("months", F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                                          lambda i: F.add_months("first_month", i)))


def holt_py(y, a, b):
    lvl, tr, sse, res = y[1], y[1] - y[0], 0.0, []
    for x in y[2:]:
        xhat = lvl + tr
        e = x - xhat
        new = a * x + (1 - a) * xhat
        tr = b * (new - lvl) + (1 - b) * tr
        lvl = new
        sse += e * e
        res.append(e)
    return lvl, tr, sse, res


def grid_py(y):
    best = min((holt_py(y, ja / 200, jb / 200)[2], ja, jb) for ja in range(0, 201, 10) for jb in range(0, 201, 10))
    _, ca, cb = best
    cand = [(holt_py(y, ja / 200, jb / 200)[2], ja, jb)
            for ja in range(ca - 10, ca + 11) for jb in range(cb - 10, cb + 11) if 0 <= ja <= 200 and 0 <= jb <= 200]
    return min(cand)


def test_holt_matches_python_loop(spark):
    r = FC.holt_forecast(series(spark, Y), 3).first()
    sse, ja, jb = grid_py(Y)
    lvl, tr, _, res = holt_py(Y, ja / 200, jb / 200)
    assert (r.alpha, r.beta) == (ja / 200, jb / 200)
    assert math.isclose(r.sse, sse, rel_tol=1e-12)
    assert np.allclose(r.forecast, [lvl + h * tr for h in (1, 2, 3)])
    assert math.isclose(r.resid_sd, float(np.std(res, ddof=1)), rel_tol=1e-9)


def test_holt_short_series_is_null(spark):
    r = FC.holt_forecast(series(spark, [1.0, 2.0]), 3).first()
    assert r.forecast is None and r.alpha is None


def test_linear_trend_matches_numpy(spark):
    r = FC.linear_trend(series(spark, Y)).first()
    slope, icpt = np.polyfit(np.arange(1, len(Y) + 1), Y, 1)
    assert math.isclose(r.slope, slope, rel_tol=1e-9) and math.isclose(r.intercept, icpt, rel_tol=1e-9)
    assert math.isclose(r.next_lm, icpt + slope * (len(Y) + 1), rel_tol=1e-9)
    assert math.isclose(r.r2, np.corrcoef(np.arange(len(Y)), Y)[0, 1] ** 2, rel_tol=1e-9)


def test_moving_average_and_short_tail(spark):
    assert math.isclose(FC.moving_average(series(spark, Y)).first().ma, sum(Y[-3:]) / 3)
    assert FC.moving_average(series(spark, [4.0, 6.0])).first().ma == 5.0


def test_ensemble_rounds_holt_first(spark):
    r = FC.ensemble_forecast(series(spark, Y)).first()
    assert math.isclose(r.ensemble, (round(r.forecast[0], 2) + r.next_lm + r.ma) / 3)


def test_loess_matches_numpy(spark):
    ys = Y
    got = [r.smooth for r in FC.loess_trend(series(spark, ys)).orderBy("month").collect()]
    n = len(ys)
    q = int(np.floor(n * 0.75))
    exp = []
    for i in range(n):
        d = np.abs(np.arange(n) - i).astype(float)
        h = np.sort(d)[q - 1]
        w = np.where(d / h < 1, (1 - (d / h) ** 3) ** 3, 0.0)
        u = np.arange(n) - i
        X = np.vstack([np.ones(n), u, u * u]).T
        exp.append(np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * ys))[0])
    assert np.allclose(got, exp, rtol=1e-9)


def test_loess_six_points_interpolates(spark):
    ys = Y[-6:]
    got = [r.smooth for r in FC.loess_trend(series(spark, ys)).orderBy("month").collect()]
    assert np.allclose(got, ys, rtol=1e-9)


def test_seasonal_needs_two_years(spark):
    short = FC.holt_winters_seasonal(series(spark, Y), 3).first()
    assert short.forecast is None
    ys = [100 + 10 * math.sin(2 * math.pi * i / 12) + i for i in range(36)]
    r = FC.holt_winters_seasonal(series(spark, ys), 3).first()
    assert r.forecast is not None and len(r.forecast) == 3
    # a clean seasonal series is tracked closely
    nxt = [100 + 10 * math.sin(2 * math.pi * i / 12) + i for i in range(36, 39)]
    assert np.allclose(r.forecast, nxt, atol=3.0)


def test_future_months_and_panel(spark):
    s = series(spark, Y)
    fm = s.select(F.explode(FC.future_months(F.col("last_month"), 3)).alias("m")).collect()
    assert [str(r.m) for r in fm] == ["2026-04-01", "2026-05-01", "2026-06-01"]
    p = FC.forecast_panel(s).first()
    assert p.method == "holt" and 0 <= p.position <= 100 and p.next_month == "April 2026"
    assert p.track_min % 100 == 0 and p.lower <= p.point <= p.upper


def hw_py(y):
    """Brute-force additive Holt-Winters: decomposition start, two grid passes."""
    trend = [(0.5 * y[i - 6] + sum(y[i - 5:i + 6]) + 0.5 * y[i + 6]) / 12 for i in range(6, 18)]
    fig = [(y[p + 12] - trend[p + 6]) if p < 6 else (y[p] - trend[p - 6]) for p in range(12)]
    fm = sum(fig) / 12
    s0 = [v - fm for v in fig]
    ty = sum(trend) / 12
    t0 = sum((i + 1 - 6.5) * (trend[i] - ty) for i in range(12)) / 143.0
    l0 = ty - t0 * 6.5

    def run(a, b, g, collect=False):
        lvl, tr, q, sse, res = l0, t0, list(s0), 0.0, []
        for x in y[12:]:
            xhat = lvl + tr + q[0]
            new = a * (x - q[0]) + (1 - a) * (lvl + tr)
            tr = b * (new - lvl) + (1 - b) * tr
            q = q[1:] + [g * (x - new) + (1 - g) * q[0]]
            lvl = new
            sse += (x - xhat) * (x - xhat)
            res.append(x - xhat)
        return sse, lvl, tr, q, res

    coarse = min((run(ja / 100, jb / 100, jg / 100)[0], ja, jb, jg)
                 for ja in range(0, 101, 10) for jb in range(0, 101, 10) for jg in range(0, 101, 10))
    _, ca, cb, cg = coarse
    best = min((run(ja / 100, jb / 100, jg / 100)[0], ja, jb, jg)
               for ja in range(ca - 5, ca + 6) for jb in range(cb - 5, cb + 6) for jg in range(cg - 5, cg + 6)
               if 0 <= ja <= 100 and 0 <= jb <= 100 and 0 <= jg <= 100)
    sse, ja, jb, jg = best
    _, lvl, tr, q, res = run(ja / 100, jb / 100, jg / 100)
    return ja / 100, jb / 100, jg / 100, sse, [lvl + h * tr + q[(h - 1) % 12] for h in (1, 2, 3)], res


def test_seasonal_matches_brute_force(spark):
    ys = [50 + 8 * math.sin(2 * math.pi * i / 12) + 0.7 * i + ((i * 37) % 11) for i in range(40)]
    r = FC.holt_winters_seasonal(series(spark, ys), 3).first()
    a, b, g, sse, fc, res = hw_py(ys)
    assert (r.alpha, r.beta, r.gamma) == (a, b, g)
    assert math.isclose(r.sse, sse, rel_tol=1e-9)
    assert np.allclose(r.forecast, fc, rtol=1e-9)
    assert math.isclose(r.resid_sd, float(np.std(res, ddof=1)), rel_tol=1e-9)


def _many(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(12):
        n, t = int(rng.integers(24, 60)), None
        t = np.arange(n)
        ys = 200 + np.cumsum(rng.normal(0, 2, n)) + 15 * np.sin(2 * np.pi * t / 12) * (i % 2) + rng.normal(0, 3, n)
        rows.append((f"s{i}", [float(v) for v in ys], n))
    rows += [("flat", [5.0] * 30, 30), ("line", [float(v) for v in range(30)], 30), ("short", [1.0, 2.0], 2)]
    return spark.createDataFrame(rows, "k string, xs array<double>, n int").withColumn("months", F.array().cast("array<date>"))


def test_newton_needs_few_folds_and_is_as_good_as_the_grid(spark):
    s = _many(spark).cache()
    for fit, names in ((FC.holt_forecast, ["alpha", "beta"]), (FC.holt_winters_seasonal, ["alpha", "beta", "gamma"])):
        grid = {r.k: r for r in fit(s, 3).collect()}
        newton = {r.k: r for r in fit(s, 3, search="newton").collect()}
        for k, g in grid.items():
            r = newton[k]
            if g.sse is None:
                assert r.sse is None and r.forecast is None
                continue
            # a season over less than three years has several minima, and another may win
            slack = 0.05 if "gamma" in names and g.n < 36 else 1e-9
            assert all(0 <= r[c] <= 1 for c in names) and r.sse <= g.sse * (1 + slack) + 1e-9, k
    for p in (2, 3):
        assert len(FC.STARTS[p][0]) ** p + 1 + FC.STEPS[p] + 1 <= 50


def test_newton_gradient_is_that_of_the_sum_of_squares(spark):
    """The fold's derivatives against differences, with and without a season."""
    s = _many(spark).where("k = 's1'")
    xs = s.first().xs
    for names, skip, start in ((["a", "b"], 2, "named_struct('l', xs[1], 't', xs[1] - xs[0])"),
                               (["a", "b", "g"], 12, "named_struct('l', 200D, 't', 0.1D, 'q', transform(sequence(1, 12), i -> i - 6.5D))")):
        parts = FC.newton_parts(names)

        def fold(**at):
            point = "named_struct(" + ", ".join(f"'{k}', {v!r}D" for k, v in at.items()) + ")"
            return s.select(F.expr(FC._newton_fold("xs", skip, point, start, parts, names)).alias("f")).first().f

        at = {x: 0.3 + 0.1 * i for i, x in enumerate(names)}
        here = fold(**at)
        for x in names:
            up, down = (fold(**{**at, x: at[x] + d}).sse for d in (1e-5, -1e-5))
            assert math.isclose((up - down) / 2e-5, 2 * here[f"g_{x}"], rel_tol=1e-4)
    assert len(xs) > 20
