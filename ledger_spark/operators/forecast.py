"""Forecasts over monthly series.

Data layout: one row per series key holding its ordered month totals as
``array<double>`` (I1). A series is bounded by the number of calendar months,
so folding it inside one row is safe at any data volume; the fact table is
reduced to (key, month) totals by a partial/final hash aggregate first.

Model fitting stays JVM-side: the smoothing recursions are ``aggregate``
folds over the series array, and the parameter search evaluates a grid of
parameters with ``transform`` inside the same row (no join, no explode),
picking the smallest SSE with ``array_min`` over (sse, alpha, beta, ...).

Parameter grids
---------------
Holt (level + trend): alpha, beta on multiples of 1/200. Coarse pass: every
10th value (0, .05, ..., 1); refine pass: +-10 steps of .005 around the best.
Holt-Winters (additive season of 12): alpha, beta, gamma on multiples of
1/100; coarse pass every 10th value, refine +-5 steps of .01 (wider steps,
three parameters).
Gauss-Newton (``search="newton"``)
----------------------------------
For many series: the fold carries the derivatives of level, trend and season by each
parameter, so one fold gives the sum of squares, its gradient and the Gauss-Newton
matrix. The best of a few start points is improved by damped steps inside [0, 1];
a step that doesn't lower the sum is taken back and damped harder.
Ties in SSE go to the smaller parameters. The original uses a gradient
optimiser from (0.3, 0.1); on a multi-modal SSE it may stop elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.dates import month_start
from ledger_spark.schema import Z95


# --------------------------------------------------------------------------
# series
# --------------------------------------------------------------------------

def monthly_series(t: DataFrame, keys=()) -> DataFrame:
    """Per key ``xs`` (month totals in month order, as double), first/last month, n."""
    m = t.groupBy(*keys, month_start("date").alias("m")).agg(F.sum("amount").alias("total"))
    s = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("m", "total"))).alias("pts"))
    return s.select(*keys,
                    F.transform("pts", lambda p: p["total"].cast("double")).alias("xs"),
                    F.transform("pts", lambda p: p["m"]).alias("months"),
                    F.col("pts")[0]["m"].alias("first_month"),
                    F.element_at("pts", -1)["m"].alias("last_month"),
                    F.size("pts").alias("n"))


# --------------------------------------------------------------------------
# Fold builders (Spark SQL text; lambda variables are unique per nesting level)
# --------------------------------------------------------------------------

def _d(j: str, scale: int) -> str:
    return f"(CAST({j} AS DOUBLE) / CAST({scale} AS DOUBLE))"


def _let(value: str, var: str, body: str) -> str:
    """Bind ``value`` to a lambda variable so it is evaluated once per row even
    when ``body`` uses it inside other lambdas."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def _x1(xs: str) -> str:
    return f"try_element_at({xs}, 1)"


def _x2(xs: str) -> str:
    return f"try_element_at({xs}, 2)"


def _holt_fold(xs: str, a: str, b: str, collect: bool = False) -> str:
    """Holt recursion from t=3 with level x2 and trend x2-x1.

    Returns struct(l, t, sse) or, with ``collect``, struct(l, t, e) holding the
    one-step residuals. ``a``/``b`` are carried in the accumulator so the
    parameters are evaluated once, not per step.
    """
    xhat = "(s.l + s.t)"
    lvl = f"(s.a * x + (1 - s.a) * {xhat})"
    acc0 = "'e', CAST(array() AS array<double>)" if collect else "'sse', CAST(0 AS DOUBLE)"
    step = f"'e', concat(s.e, array(x - {xhat}))" if collect else f"'sse', s.sse + (x - {xhat}) * (x - {xhat})"
    return (f"aggregate(slice({xs}, 3, greatest(size({xs}) - 2, 0)), "
            f"named_struct('a', {a}, 'b', {b}, 'l', {_x2(xs)}, 't', {_x2(xs)} - {_x1(xs)}, {acc0}), "
            f"(s, x) -> named_struct('a', s.a, 'b', s.b, 'l', {lvl}, "
            f"'t', s.b * ({lvl} - s.l) + (1 - s.b) * s.t, {step}))")


HOLT_SCALE = 200


def _holt_search(xs: str, center: str | None) -> str:
    """array_min over a 21x21 grid of (ja, jb) -> struct(sse, ja, jb)."""
    if center is None:
        grid = "transform(sequence(0, 440), g -> named_struct('ja', (g div 21) * 10, 'jb', (g % 21) * 10))"
    else:
        grid = (f"filter(transform(sequence(0, 440), g -> named_struct('ja', {center}.ja + g div 21 - 10, "
                f"'jb', {center}.jb + g % 21 - 10)), "
                f"p -> p.ja BETWEEN 0 AND {HOLT_SCALE} AND p.jb BETWEEN 0 AND {HOLT_SCALE})")
    fold = _holt_fold(xs, _d("q.ja", HOLT_SCALE), _d("q.jb", HOLT_SCALE))
    return f"array_min(transform({grid}, q -> named_struct('sse', {fold}.sse, 'ja', q.ja, 'jb', q.jb)))"


def holt_fit_expr(xs: str = "xs") -> str:
    """One struct per series: alpha, beta, sse, final level/trend and residuals."""
    a, b = _d("bst.ja", HOLT_SCALE), _d("bst.jb", HOLT_SCALE)
    final = _holt_fold(xs, a, b, collect=True)
    body = (f"named_struct('alpha', {a}, 'beta', {b}, 'sse', bst.sse, "
            f"'l', fin.l, 't', fin.t, 'e', fin.e)")
    return _let(_holt_search(xs, None), "crs",
                _let(_holt_search(xs, "crs"), "bst", _let(final, "fin", body)))


def _sample_sd(e):
    k = F.size(e)
    mean_e = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v) / k
    return F.sqrt(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + (v - mean_e) * (v - mean_e)) / (k - 1))


def holt_forecast(series: DataFrame, h: int = 3, search: str = "grid") -> DataFrame:
    """I2 + I3: fitted alpha/beta, SSE, h-step forecasts and the 95 % interval of
    the first step (residual sample sd x 1.96). Series shorter than 3 -> NULLs.
    ``search`` is "grid" (882 folds a series) or "newton" (50)."""
    ok = F.col("n") >= 3
    fit = {"grid": holt_fit_expr, "newton": holt_newton_expr}[search]
    s = series.withColumn("_f", F.when(ok, F.expr(fit("xs"))))
    f = F.col("_f")
    fc = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda i: f["l"] + i * f["t"])
    out = s.select(*[c for c in series.columns if c not in ("xs", "months")],
                   f["alpha"].alias("alpha"), f["beta"].alias("beta"), f["sse"].alias("sse"),
                   F.when(ok, fc).alias("forecast"), _sample_sd(f["e"]).alias("resid_sd"))
    return (out.withColumn("lower95", F.col("forecast")[0] - F.lit(Z95) * F.col("resid_sd"))
            .withColumn("upper95", F.col("forecast")[0] + F.lit(Z95) * F.col("resid_sd")))


# --------------------------------------------------------------------------
# I8: additive Holt-Winters with a 12-month season
# --------------------------------------------------------------------------

HW_SCALE = 100


def _hw_start(xs: str) -> str:
    """Start values from a classical decomposition of the first 24 points:
    centred 2x12 moving-average trend, seasonal figure from the detrended
    values (centred to mean 0), level/trend = OLS line through the 12 trend
    values (index 1..12, level at index 0)."""
    tr = (f"transform(sequence(6, 17), i -> (0.5D * {xs}[i - 6] + "
          f"aggregate(slice({xs}, i - 4, 11), 0D, (u, v) -> u + v) + 0.5D * {xs}[i + 6]) / 12D)")
    # detrended value per season position p (0..11): positions 0..5 come from
    # the second year (index p+12), positions 6..11 from the first (index p)
    fig = (f"transform(sequence(0, 11), p -> IF(p < 6, {xs}[p + 12] - _tr[p + 6], {xs}[p] - _tr[p - 6]))")
    return tr, fig


def _hw_fold(xs: str, a: str, b: str, g: str, start: str, collect: bool) -> str:
    """Additive seasonal recursion from t=13; ``start`` is a struct(l, t, q)
    with the start level, trend and the 12 seasonal values (oldest first)."""
    xhat = "(s.l + s.t + s.q[0])"
    lvl = f"(s.a * (x - s.q[0]) + (1 - s.a) * (s.l + s.t))"
    acc0 = "'e', CAST(array() AS array<double>)" if collect else "'sse', CAST(0 AS DOUBLE)"
    step = f"'e', concat(s.e, array(x - {xhat}))" if collect else f"'sse', s.sse + (x - {xhat}) * (x - {xhat})"
    return (f"aggregate(slice({xs}, 13, greatest(size({xs}) - 12, 0)), "
            f"named_struct('a', {a}, 'b', {b}, 'g', {g}, 'l', {start}.l, 't', {start}.t, 'q', {start}.q, {acc0}), "
            f"(s, x) -> named_struct('a', s.a, 'b', s.b, 'g', s.g, 'l', {lvl}, "
            f"'t', s.b * ({lvl} - s.l) + (1 - s.b) * s.t, "
            f"'q', concat(slice(s.q, 2, 11), array(s.g * (x - {lvl}) + (1 - s.g) * s.q[0])), {step}))")


def _hw_search(start: str, center: str | None) -> str:
    if center is None:
        grid = ("transform(sequence(0, 1330), w -> named_struct('ja', (w div 121) * 10, "
                "'jb', ((w div 11) % 11) * 10, 'jg', (w % 11) * 10))")
    else:
        grid = (f"filter(transform(sequence(0, 1330), w -> named_struct('ja', {center}.ja + w div 121 - 5, "
                f"'jb', {center}.jb + (w div 11) % 11 - 5, 'jg', {center}.jg + w % 11 - 5)), "
                f"p -> p.ja BETWEEN 0 AND {HW_SCALE} AND p.jb BETWEEN 0 AND {HW_SCALE} "
                f"AND p.jg BETWEEN 0 AND {HW_SCALE})")
    fold = _hw_fold("xs", _d("q.ja", HW_SCALE), _d("q.jb", HW_SCALE), _d("q.jg", HW_SCALE), start, False)
    return (f"array_min(transform({grid}, q -> named_struct('sse', {fold}.sse, "
            f"'ja', q.ja, 'jb', q.jb, 'jg', q.jg)))")


def hw_fit_expr(start: str = "_st") -> str:
    a, b, g = _d("bst.ja", HW_SCALE), _d("bst.jb", HW_SCALE), _d("bst.jg", HW_SCALE)
    final = _hw_fold("xs", a, b, g, "st0", True)
    body = (f"named_struct('alpha', {a}, 'beta', {b}, 'gamma', {g}, 'sse', bst.sse, "
            f"'l', fin.l, 't', fin.t, 'q', fin.q, 'e', fin.e)")
    return _let(start, "st0", _let(_hw_search("st0", None), "crs",
                                   _let(_hw_search("st0", "crs"), "bst", _let(final, "fin", body))))


def holt_winters_seasonal(series: DataFrame, h: int = 3, period: int = 12, search: str = "grid") -> DataFrame:
    """I8: additive seasonal Holt-Winters for series of at least two periods
    (shorter series -> NULL). Forecast h: level + h*trend + season of h.
    ``search`` is "grid" (2,662 folds a series) or "newton" (50)."""
    if period != 12:
        raise ValueError("only a 12-month season is supported")
    tr, fig = _hw_start("xs")
    ok = F.col("n") >= 24
    s = series.withColumn("_tr", F.when(ok, F.expr(tr)))
    s = s.withColumn("_fg", F.when(ok, F.expr(fig)))
    s = s.withColumn("_fm", F.aggregate("_fg", F.lit(0.0), lambda u, v: u + v) / 12)
    # OLS through (i, trend_i), i = 1..12: slope and the level at i = 0
    s = s.withColumn("_ty", F.aggregate("_tr", F.lit(0.0), lambda u, v: u + v) / 12)
    s = s.withColumn("_t0", F.aggregate(
        F.sequence(F.lit(0), F.lit(11)), F.lit(0.0),
        lambda u, i: u + (i + 1 - 6.5) * (F.col("_tr")[i] - F.col("_ty"))) / F.lit(143.0))
    s = s.withColumn("_st", F.when(ok, F.struct(
        (F.col("_ty") - F.col("_t0") * 6.5).alias("l"), F.col("_t0").alias("t"),
        F.transform("_fg", lambda v: v - F.col("_fm")).alias("q"))))
    fit = {"grid": hw_fit_expr, "newton": hw_newton_expr}[search]
    s = s.withColumn("_f", F.when(ok, F.expr(fit("_st"))))
    f = F.col("_f")
    fc = F.transform(F.sequence(F.lit(1), F.lit(h)),
                     lambda i: f["l"] + i * f["t"] + f["q"][(i - 1) % 12])
    out = s.select(*[c for c in series.columns if c not in ("xs", "months")],
                   f["alpha"].alias("alpha"), f["beta"].alias("beta"), f["gamma"].alias("gamma"),
                   f["sse"].alias("sse"), F.when(ok, fc).alias("forecast"), _sample_sd(f["e"]).alias("resid_sd"))
    return (out.withColumn("lower95", F.col("forecast")[0] - F.lit(Z95) * F.col("resid_sd"))
            .withColumn("upper95", F.col("forecast")[0] + F.lit(Z95) * F.col("resid_sd")))


# --------------------------------------------------------------------------
# Parameter search by Gauss-Newton steps
# --------------------------------------------------------------------------

#: Start values of each parameter; the best of all their combinations is improved.
STARTS = {2: ((0.1, 0.3, 0.5, 0.7, 0.9), (0.03, 0.15, 0.35, 0.6, 0.9)),
          3: ((0.1, 0.4, 0.8), (0.03, 0.2, 0.6), (0.05, 0.3, 0.7))}
#: Steps taken from there. Starts, steps, the start's own fold and the last one are 50 folds.
STEPS = {2: 23, 3: 21}
DAMPING, HARDER, EASIER = 0.01, 4.0, 0.25


def newton_parts(names: list[str]) -> dict[str, list[tuple[str, str]]]:
    """The search's arithmetic as (field, SQL) lists, the same text for every engine.

    Fields of ``{p}`` are the accepted point: parameters, damping, sum of squares, its
    gradient (``g_``) and Gauss-Newton matrix (``h_``); ``{s}`` is the running fold with
    the derivatives of level, trend and season by each parameter, ``{v}`` its one-step
    error and the error's derivatives.
    """
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i:]]
    season = "g" in names
    free = {x: f"(NOT (({{p}}.{x} <= 0 AND {{p}}.g_{x} > 0) OR ({{p}}.{x} >= 1 AND {{p}}.g_{x} < 0)))" for x in names}
    masked = [(f"m_{x}{y}", f"CASE WHEN {free[x]} THEN {{p}}.h_{x}{x} * (1 + {{p}}.damp) + 1e-300D ELSE 1D END" if x == y else
               f"CASE WHEN {free[x]} AND {free[y]} THEN {{p}}.h_{x}{y} ELSE 0D END") for x, y in pairs]
    masked += [(f"r_{x}", f"CASE WHEN {free[x]} THEN {{p}}.g_{x} ELSE 0D END") for x in names]
    m = lambda x, y: f"{{m}}.m_{x}{y}" if (x, y) in pairs else f"{{m}}.m_{y}{x}"
    r = lambda x: f"{{m}}.r_{x}"

    def minor(cols: list, i: int, j: int) -> str:
        """2 x 2 determinant of the columns' rows i and j."""
        return f"({cols[0](i)} * {cols[1](j)} - {cols[1](i)} * {cols[0](j)})"

    def det(cols: list) -> str:
        if len(cols) == 2:
            return minor(cols, 0, 1)
        rows = ((1, 2), (0, 2), (0, 1))
        return "(" + " ".join(f"{sign} {cols[0](k)} * {minor(cols[1:], *rows[k])}" for k, sign in enumerate("+-+")) + ")"

    columns = [lambda k, x=x: m(names[k], x) for x in names]
    right = lambda k: r(names[k])
    solved = [("det", det(columns))] + [(f"d_{x}", det([*columns[:i], right, *columns[i + 1:]])) for i, x in enumerate(names)]
    moved = [(x, f"least(1D, greatest(0D, {{p}}.{x} - CASE WHEN {{d}}.det > 0 THEN {{d}}.d_{x} / {{d}}.det ELSE 0D END))") for x in names]
    error = [("e", "{x} - ({s}.l + {s}.t" + (" + {q0})" if season else ")"))]
    error += [(f"e_{x}", f"-({{s}}.l_{x} + {{s}}.t_{x}" + (f" + {{q0_{x}}})" if season else ")")) for x in names]
    step = [("l", "{s}.l + {s}.t + {s}.a * {v}.e"), ("t", "{s}.t + {s}.a * {s}.b * {v}.e")]
    for x in names:
        own = {"a": " + {v}.e", "b": "", "g": ""}[x]
        trend = {"a": " + {s}.b * {v}.e", "b": " + {s}.a * {v}.e", "g": ""}[x]
        step += [(f"l_{x}", f"{{s}}.l_{x} + {{s}}.t_{x}{own} + {{s}}.a * {{v}}.e_{x}"),
                 (f"t_{x}", f"{{s}}.t_{x}{trend} + {{s}}.a * {{s}}.b * {{v}}.e_{x}")]
    step += [("sse", "{s}.sse + {v}.e * {v}.e")]
    step += [(f"g_{x}", f"{{s}}.g_{x} + {{v}}.e * {{v}}.e_{x}") for x in names]
    step += [(f"h_{x}{y}", f"{{s}}.h_{x}{y} + {{v}}.e_{x} * {{v}}.e_{y}") for x, y in pairs]
    fresh = []  # the season's new value, and its derivatives
    if season:
        fresh = [("q", "{q0} + {s}.g * (1 - {s}.a) * {v}.e"),
                 ("q_a", "{q0_a} + {s}.g * (1 - {s}.a) * {v}.e_a - {s}.g * {v}.e"),
                 ("q_b", "{q0_b} + {s}.g * (1 - {s}.a) * {v}.e_b"),
                 ("q_g", "{q0_g} + {s}.g * (1 - {s}.a) * {v}.e_g + (1 - {s}.a) * {v}.e")]
    zero = [f for f, _ in step[2:]]  # a fold's fields have one order: structs are compared by place
    kept = [*names, "sse", *[f"g_{x}" for x in names], *[f"h_{x}{y}" for x, y in pairs]]
    return {"masked": masked, "solved": solved, "moved": moved, "error": error, "step": step, "fresh": fresh,
            "zero": [(z, "0D") for z in zero], "kept": [(k, k) for k in kept]}


def _struct(fields, **names) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v.format(**names)}" for k, v in fields) + ")"


def _newton_fold(xs: str, skip: int, at: str, start: str, parts: dict, names: list[str]) -> str:
    """Fold of the series at the parameters of struct ``at``: sum of squares, gradient, matrix."""
    season = bool(parts["fresh"])
    first = [*[(x, f"{at}.{x}") for x in names], ("l", f"{start}.l"), ("t", f"{start}.t"), *parts["zero"]]
    old = {}
    if season:
        first += [("q", f"{start}.q"), *[(f"q_{x}", "array_repeat(0D, 12)") for x in names]]
        old = {"q0": "s.q[0]", **{f"q0_{x}": f"s.q_{x}[0]" for x in names}}
    step = [*[(x, f"s.{x}") for x in names], *parts["step"],
            *[(f, f"concat(slice(s.{f}, 2, 11), array({v}))") for f, v in parts["fresh"]]]
    body = _let(_struct(parts["error"], s="s", x="x", **old), "v", _struct(step, s="s", v="v", **old))
    return f"aggregate(slice({xs}, {skip + 1}, greatest(size({xs}) - {skip}, 0)), {_struct(first)}, (s, x) -> {body})"


def _newton_search(xs: str, skip: int, start: str, names: list[str], plain_fold) -> str:
    """struct(a, b, ..., sse, ...) of the best point found."""
    parts, p = newton_parts(names), len(names)
    k = len(STARTS[p][0])
    pick = [(x, f"array({', '.join(f'{v}D' for v in values)})[CAST(i div {k ** (p - 1 - j)} AS INT) % {k}]")
            for j, (x, values) in enumerate(zip(names, STARTS[p]))]
    first = _let(f"array_min(transform(transform(sequence(0, {k ** p - 1}), i -> {_struct(pick)}), "
                 f"c -> named_struct('sse', {plain_fold('c')}.sse, {', '.join(f'{chr(39)}{x}{chr(39)}, c.{x}' for x in names)})))",
                 "st1", _newton_fold(xs, skip, "st1", start, parts, names))
    accepted = lambda s, damp: _struct([*[(f, f"{s}.{f}") for f, _ in parts["kept"]], ("damp", damp)])
    trial = _let(_struct(parts["masked"], p="p"), "m", _let(_struct(parts["solved"], m="m"), "d", _struct(parts["moved"], p="p", d="d")))
    turn = _let(trial, "c", _let(_newton_fold(xs, skip, "c", start, parts, names), "f",
                                 f"CASE WHEN f.sse < p.sse THEN {accepted('f', f'p.damp * {EASIER}D')} "
                                 f"ELSE {accepted('p', f'p.damp * {HARDER}D')} END"))
    return _let(first, "f0", f"aggregate(sequence(1, {STEPS[p]}), {accepted('f0', f'{DAMPING}D')}, (p, n) -> {turn})")


def holt_newton_expr(xs: str = "xs") -> str:
    """As :func:`holt_fit_expr`, the parameters by Gauss-Newton steps."""
    start = f"named_struct('l', {_x2(xs)}, 't', {_x2(xs)} - {_x1(xs)})"
    final = _holt_fold(xs, "bst.a", "bst.b", collect=True)
    body = "named_struct('alpha', bst.a, 'beta', bst.b, 'sse', bst.sse, 'l', fin.l, 't', fin.t, 'e', fin.e)"
    search = _newton_search(xs, 2, "st0", ["a", "b"], lambda c: _holt_fold(xs, f"{c}.a", f"{c}.b"))
    return _let(start, "st0", _let(search, "bst", _let(final, "fin", body)))


def hw_newton_expr(start: str = "_st") -> str:
    """As :func:`hw_fit_expr`, the parameters by Gauss-Newton steps."""
    final = _hw_fold("xs", "bst.a", "bst.b", "bst.g", "st0", True)
    body = ("named_struct('alpha', bst.a, 'beta', bst.b, 'gamma', bst.g, 'sse', bst.sse, "
            "'l', fin.l, 't', fin.t, 'q', fin.q, 'e', fin.e)")
    search = _newton_search("xs", 12, "st0", ["a", "b", "g"],
                            lambda c: _hw_fold("xs", f"{c}.a", f"{c}.b", f"{c}.g", "st0", False))
    return _let(start, "st0", _let(search, "bst", _let(final, "fin", body)))


# --------------------------------------------------------------------------
# I4, I5, I6, E3, E5, E6
# --------------------------------------------------------------------------

def time_index(series: DataFrame, keys=()) -> DataFrame:
    """Long form (key, t, x) with t = 1..n along the months."""
    return series.select(*keys, F.posexplode("xs").alias("pos", "x")).select(
        *keys, (F.col("pos") + 1).alias("t"), "x")


def ols_on_index(xs):
    """OLS of ``xs`` on t = 1..n inside the row: (slope, intercept, r2, next)."""
    n = F.size(xs)
    tbar = (n + 1) / 2.0
    xbar = F.aggregate(xs, F.lit(0.0), lambda u, v: u + v) / n
    idx = F.sequence(F.lit(0), n - 1)
    stx = F.aggregate(idx, F.lit(0.0), lambda u, i: u + (i + 1 - tbar) * (xs[i] - xbar))
    sxx = F.aggregate(xs, F.lit(0.0), lambda u, v: u + (v - xbar) * (v - xbar))
    stt = n * (n * n - 1) / 12.0
    slope = stx / stt
    intercept = xbar - slope * tbar
    ok = n >= 2
    return (F.when(ok, slope), F.when(ok, intercept),
            F.when(ok & (sxx > 0), stx * stx / (stt * sxx)), F.when(ok, intercept + slope * (n + 1)))


def linear_trend(series: DataFrame) -> DataFrame:
    """I4: OLS of total on 1..n: slope, intercept, R^2 and the value at n+1,
    computed inside each series row (no explode, no shuffle)."""
    slope, intercept, r2, nxt = ols_on_index(F.col("xs"))
    return series.select("*", slope.alias("slope"), intercept.alias("intercept"), r2.alias("r2"),
                         nxt.alias("next_lm"))


def last_n_mean(xs, n: int = 3):
    """E5: mean of the last ``n`` points (fewer when the series is shorter)."""
    tail = F.slice(xs, F.greatest(F.size(xs) - n + 1, F.lit(1)), n)
    return F.aggregate(tail, F.lit(0.0), lambda u, v: u + v) / F.size(tail)


def moving_average(series: DataFrame, n: int = 3) -> DataFrame:
    """Mean of the last ``n`` month totals."""
    return series.withColumn("ma", last_n_mean(F.col("xs"), n))


def ensemble_forecast(series: DataFrame) -> DataFrame:
    """Mean of Holt (rounded to 2 dp first), linear trend and 3-month mean.

    All three models are columns of the same series row: no join between them.
    """
    s = linear_trend(moving_average(series, 3))
    hw = holt_forecast(s, 3)
    hw1 = F.round(F.col("forecast")[0], 2)
    return hw.withColumn("next_hw", hw1).withColumn("ensemble", (hw1 + F.col("next_lm") + F.col("ma")) / 3)


# --------------------------------------------------------------------------
# I9, G1, I7
# --------------------------------------------------------------------------

def future_months(last_month, h: int = 3):
    """The next ``h`` month starts after ``last_month`` (array<date>)."""
    return F.sequence(F.add_months(last_month, 1), F.add_months(last_month, h), F.expr("INTERVAL 1 MONTH"))


def actual_plus_forecast(series: DataFrame, holt: DataFrame, keys=(), h: int = 3) -> DataFrame:
    """G1: history rows (``Actual``) stacked on ``h`` future months (``Forecast``)."""
    hist = series.select(*keys, F.explode(F.arrays_zip("months", "xs")).alias("p")).select(
        *keys, F.date_format(F.col("p.months"), "yyyy-MM").alias("month"),
        F.col("p.xs").alias("actual"), F.lit("Actual").alias("type"))
    fut = holt.where(F.col("forecast").isNotNull()).select(
        *keys, F.posexplode("forecast").alias("i", "actual"), "last_month").select(
        *keys, F.date_format(F.add_months("last_month", F.col("i") + 1), "yyyy-MM").alias("month"),
        "actual", F.lit("Forecast").alias("type"))
    return hist.unionByName(fut)


def forecast_panel(series: DataFrame, keys=(), seasonal_from: int = 24) -> DataFrame:
    """Dashboard forecast card. Needs >= 3 months; uses the seasonal model
    from ``seasonal_from`` points on, else Holt. Point/lower/upper to whole
    units, bar limits round(0.8*lower, -2) and round(1.2*upper, -2), marker
    position clamped to 0..100, and the next month's label."""
    base = series.where(F.col("n") >= 3)
    hw = holt_forecast(base.where(F.col("n") < seasonal_from), 1).withColumn("method", F.lit("holt"))
    sw = holt_winters_seasonal(base.where(F.col("n") >= seasonal_from), 1).drop("gamma") \
        .withColumn("method", F.lit("holt_winters_seasonal"))
    f = hw.unionByName(sw)
    p = F.round(F.col("forecast")[0], 0)
    lo = F.round("lower95", 0)
    up = F.round("upper95", 0)
    f = f.select(*keys, "last_month", "method", p.alias("point"), lo.alias("lower"), up.alias("upper"))
    tmin = F.round(F.col("lower") * 0.8, -2)
    tmax = F.round(F.col("upper") * 1.2, -2)
    pos = (F.col("point") - tmin) / F.nullif(tmax - tmin, F.lit(0.0)) * 100
    return f.select(*keys, "method", "point", "lower", "upper", tmin.alias("track_min"),
                    tmax.alias("track_max"), F.least(F.greatest(pos, F.lit(0.0)), F.lit(100.0)).alias("position"),
                    F.date_format(F.add_months("last_month", 1), "MMMM yyyy").alias("next_month"))


# --------------------------------------------------------------------------
# LOESS trend line
# --------------------------------------------------------------------------

def _loess_solve(m):
    """Cramer's rule for the weighted quadratic; weighted line, then weighted
    mean, when the system is singular."""
    s0, s1, s2, s3, s4 = (m[c] for c in ("s0", "s1", "s2", "s3", "s4"))
    t0, t1, t2 = m["t0"], m["t1"], m["t2"]
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    num = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)
    det_l = s0 * s2 - s1 * s1
    lin = (s2 * t0 - s1 * t1) / det_l
    return (F.when(F.abs(det) > F.lit(1e-9) * F.abs(s0 * s2 * s4), num / det)
            .when(F.abs(det_l) > F.lit(1e-9) * F.abs(s0 * s2), lin)
            .otherwise(t0 / s0))


def loess_fit(xs, span: float = 0.75):
    """Locally weighted quadratic fit of ``xs`` against x = 1..n, evaluated
    at every observed x (direct computation, no interpolation surface).

    For each x0 the neighbourhood is the q = floor(n * span) nearest points,
    h = the q-th smallest distance, weights (1 - (d/h)^3)^3 for d < h; the
    weighted normal equations of a quadratic centred at x0 are solved by
    Cramer's rule (falls back to a weighted line, then the weighted mean,
    when the system is singular). Everything stays inside the series row: the
    n x n work is array arithmetic, no pairs are emitted as rows.
    """
    n = F.size(xs)
    q = F.greatest(F.floor(n * F.lit(span)).cast("int"), F.lit(1))
    idx = F.sequence(F.lit(0), n - 1)

    def at(i):
        dists = F.transform(idx, lambda j: F.abs(j - i).cast("double"))
        h_raw = F.element_at(F.array_sort(dists), F.least(q, n))
        # span >= 1: the whole series, bandwidth widened by the span
        h_expr = F.when(q >= n, (F.array_max(dists) + 1) * F.lit(max(span, 1.0))).otherwise(h_raw)

        def with_h(h):
            def w(j):
                r = F.abs(j - i).cast("double") / h
                return F.when(r < 1, F.pow(1 - F.pow(r, 3), 3)).otherwise(F.lit(0.0))

            zero = F.lit(0.0)
            init = F.struct(*[zero.alias(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")])

            def step(acc, j):
                u = (j - i).cast("double")
                wj = w(j)
                y = xs[j]
                return F.struct((acc["s0"] + wj).alias("s0"), (acc["s1"] + wj * u).alias("s1"),
                                (acc["s2"] + wj * u * u).alias("s2"), (acc["s3"] + wj * u * u * u).alias("s3"),
                                (acc["s4"] + wj * u * u * u * u).alias("s4"), (acc["t0"] + wj * y).alias("t0"),
                                (acc["t1"] + wj * u * y).alias("t1"), (acc["t2"] + wj * u * u * y).alias("t2"))

            return F.transform(F.array(F.aggregate(idx, init, step)), _loess_solve)[0]

        # bind the bandwidth once per evaluation point (not once per term)
        return F.transform(F.array(h_expr), with_h)[0]

    return F.transform(idx, at)


def loess_trend(series: DataFrame, span: float = 0.75) -> DataFrame:
    """E7 on I1 series: one row per (key..., month) with the observed total and
    the smoothed value."""
    s = series.withColumn("_fit", loess_fit(F.col("xs"), span))
    keys = [c for c in series.columns if c not in ("xs", "months", "first_month", "last_month", "n")]
    z = s.select(*keys, F.explode(F.arrays_zip("months", "xs", "_fit")).alias("p"))
    return z.select(*keys, F.date_format(F.col("p.months"), "yyyy-MM").alias("month"),
                    F.col("p.xs").alias("total"), F.col("p._fit").alias("smooth"))


def last_n_series(t: DataFrame, n: int = 6, keys=()) -> DataFrame:
    """Series of the last ``n`` month totals (the dashboard's trend panel)."""
    s = monthly_series(t, keys)
    start = F.greatest(F.col("n") - n + 1, F.lit(1))
    tail = F.slice("xs", start, n)
    months = F.slice("months", start, n)
    return s.select(*keys, tail.alias("xs"), months.alias("months"), months[0].alias("first_month"),
                    "last_month", F.size(tail).alias("n"))
