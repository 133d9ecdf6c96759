"""DuckDB oracle SQL for the registered queries.

The oracle rebuilds the fixture adapter (transactions, categories, budgets)
as CTEs over the raw test tables and states every report in plain SQL.
Money rules shared with the Spark side:

* sums stay exact decimals; rounding is half away from zero;
* means are computed from integer cents: ``(2*cents + n) // (2*n) / 100``;
* percentages from exact decimals with integer arithmetic, sign handled
  explicitly (DuckDB's ``//`` truncates toward zero).
"""

from __future__ import annotations

import re

from ledger_spark.schema import (KEYWORD_RULES, RECURRING_PATTERN, SEED_CATEGORIES,
                                 STATUS_OVER, STATUS_UNDER, DEFAULT_COLOR)
from ledger_spark.sources.tables import FIXTURE_ESSENTIAL, UNSPENT_BUDGET


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def r2(x: str, scale: int = 2) -> str:
    """exact half-up rounding of a decimal, emitted as double"""
    return f"CAST(ROUND({x}, {scale}) AS DOUBLE)"


def ratio(num: str, den: str, scale: int) -> str:
    """num/den for integer-valued expressions, rounded half away from zero to
    ``scale`` decimals, as double (NULL when den is 0 or NULL)."""
    k = 10 ** scale
    return (f"CASE WHEN ({den}) IS NULL OR ({den}) = 0 OR ({num}) IS NULL THEN NULL ELSE "
            f"sign({num}) * sign({den}) * CAST(((2 * {k} * abs({num}) + abs({den})) // (2 * abs({den}))) AS DOUBLE)"
            f" / {k} END")


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


def mean2(total: str, n: str) -> str:
    """half-up mean of a decimal total over n rows, 2 dp, as double"""
    return ratio(cents(total), f"(CAST({n} AS HUGEINT) * 100)", 2)


def pct1(part: str, whole: str) -> str:
    """part*100/whole rounded half away from zero to 1 dp, as double"""
    return ratio(f"({cents(part)} * 100)", cents(whole), 1)


def clean_desc(x: str) -> str:
    return f"regexp_replace(upper({strip(x)}), '[^A-Z0-9 ]', '', 'g')"


def norm_cat(x: str) -> str:
    return rf"regexp_replace(lower({strip(x)}), '\s+', '_', 'g')"


def keyword_case(x: str) -> str:
    arms = " ".join(f"WHEN regexp_matches(upper({x}), {q(p)}) THEN {q(label)}" for label, p in KEYWORD_RULES)
    return f"CASE {arms} ELSE 'uncategorized' END"


def _seed_values() -> str:
    rows = ", ".join(f"({i + 1}, {q(n)}, {q(d)}, {q(c)}, {e})" for i, (n, d, c, e) in enumerate(SEED_CATEGORIES))
    return rows


ADAPTER = f"""
seed(id, name, description, color_hex, is_essential) AS (VALUES {_seed_values()}),
segs AS (
  SELECT DISTINCT {norm_cat('c_mktsegment')} AS name FROM customer
),
categories AS (
  SELECT CAST(id AS BIGINT) AS id, name, description, color_hex, is_essential FROM seed
  UNION ALL
  SELECT CAST(13 + row_number() OVER (ORDER BY name) AS BIGINT), name, 'market segment', {q(DEFAULT_COLOR)},
         CASE WHEN name IN ({", ".join(q(n) for n in FIXTURE_ESSENTIAL)}) THEN 1 ELSE 0 END
  FROM segs WHERE name IS NOT NULL AND name <> '' AND name NOT IN (SELECT name FROM seed)
),
tx AS (
  SELECT o.o_orderkey AS id, CAST(o.o_orderdate AS DATE) AS date,
         {clean_desc('c.c_name')} AS description,
         TRY_CAST(o.o_totalprice AS DECIMAL(12,2)) AS amount,
         {norm_cat('c.c_mktsegment')} AS category_raw
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderdate IS NOT NULL AND TRY_CAST(o.o_totalprice AS DECIMAL(12,2)) > 0
),
transactions AS (
  SELECT tx.id, tx.date, tx.description, tx.amount, tx.category_raw,
         COALESCE(cf.id, (SELECT min(id) FROM categories WHERE name = 'uncategorized')) AS category_id,
         COALESCE(CAST(regexp_matches(tx.description, {q(RECURRING_PATTERN)}) AS INTEGER), 0) AS is_recurring
  FROM tx LEFT JOIN categories cf ON cf.name = tx.category_raw
),
budgets AS (
  SELECT category_id, strftime(CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE), '%Y-%m') AS month,
         sum(amount) AS budget_amt
  FROM transactions GROUP BY ALL
  UNION ALL
  SELECT DISTINCT (SELECT min(id) FROM categories WHERE name = {q(UNSPENT_BUDGET[0])}),
         strftime(CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE), '%Y-%m'), {UNSPENT_BUDGET[1]}
  FROM transactions
)
"""


def with_adapter(body: str) -> str:
    return f"WITH {ADAPTER.strip()}\n{body}"


MONTH = "strftime(date, '%Y-%m')"

STATUS = (STATUS_UNDER, STATUS_OVER)


def with_adapter_recursive(body: str) -> str:
    return f"WITH RECURSIVE {ADAPTER.strip()}\n{body}"


def holt_ctes(series: str, key: str = "k") -> str:
    """CTEs fitting Holt's linear smoothing on the same two-pass grid as the
    Spark side. ``series`` is a relation (key, xs list<double>, n).
    Produces ``hfit(k, alpha, beta, sse, l, t, e)``."""
    def fold(name, grid, collect=False):
        e0 = ", CAST([] AS DOUBLE[]) AS e" if collect else ""
        e1 = ", list_append(e, xs[i] - (l + t))" if collect else ""
        return f"""
{name} AS (
  SELECT {key}, ja, jb, CAST(ja AS DOUBLE) / CAST(200 AS DOUBLE) AS a, CAST(jb AS DOUBLE) / CAST(200 AS DOUBLE) AS b,
         3 AS i, xs[2] AS l, xs[2] - xs[1] AS t, CAST(0 AS DOUBLE) AS sse{e0}, xs, n
  FROM {grid}
  UNION ALL
  SELECT {key}, ja, jb, a, b, i + 1, a * xs[i] + (1 - a) * (l + t),
         b * ((a * xs[i] + (1 - a) * (l + t)) - l) + (1 - b) * t,
         sse + (xs[i] - (l + t)) * (xs[i] - (l + t)){e1}, xs, n
  FROM {name} WHERE i <= n
)"""
    return f""",
hs AS (SELECT * FROM {series} WHERE n >= 3),
hg1 AS (SELECT s.{key}, a.i * 10 AS ja, b.i * 10 AS jb, s.xs, s.n
        FROM hs s, range(0, 21) a(i), range(0, 21) b(i)),
{fold('hr1', 'hg1').strip()},
hb1 AS (SELECT {key}, arg_min(struct_pack(ja := ja, jb := jb), struct_pack(sse := sse, ja := ja, jb := jb)) AS p
        FROM hr1 WHERE i = n + 1 GROUP BY {key}),
hg2 AS (SELECT s.{key}, p.ja + a.i - 10 AS ja, p.jb + b.i - 10 AS jb, s.xs, s.n
        FROM hs s JOIN hb1 USING ({key}), range(0, 21) a(i), range(0, 21) b(i)
        WHERE p.ja + a.i - 10 BETWEEN 0 AND 200 AND p.jb + b.i - 10 BETWEEN 0 AND 200),
{fold('hr2', 'hg2').strip()},
hb2 AS (SELECT {key}, arg_min(struct_pack(ja := ja, jb := jb, sse := sse), struct_pack(sse := sse, ja := ja, jb := jb)) AS p
        FROM hr2 WHERE i = n + 1 GROUP BY {key}),
hg3 AS (SELECT s.{key}, p.ja AS ja, p.jb AS jb, p.sse AS best_sse, s.xs, s.n FROM hs s JOIN hb2 USING ({key})),
hr3 AS (
  SELECT {key}, ja, jb, CAST(ja AS DOUBLE) / CAST(200 AS DOUBLE) AS a, CAST(jb AS DOUBLE) / CAST(200 AS DOUBLE) AS b,
         3 AS i, xs[2] AS l, xs[2] - xs[1] AS t, CAST([] AS DOUBLE[]) AS e, xs, n, best_sse
  FROM hg3
  UNION ALL
  SELECT {key}, ja, jb, a, b, i + 1, a * xs[i] + (1 - a) * (l + t),
         b * ((a * xs[i] + (1 - a) * (l + t)) - l) + (1 - b) * t,
         list_append(e, xs[i] - (l + t)), xs, n, best_sse
  FROM hr3 WHERE i <= n
),
hfit AS (
  SELECT {key}, a AS alpha, b AS beta, best_sse AS sse, l, t, e,
         sqrt(list_sum(list_transform(e, lambda v: (v - list_sum(e) / len(e)) * (v - list_sum(e) / len(e))))
              / (len(e) - 1)) AS sd
  FROM hr3 WHERE i = n + 1
)"""


def hw_start_ctes(series: str, key: str = "k") -> str:
    """``ws(k, xs, n, l0, t0, s0)``: start level, trend and season of the series of two years or more."""
    def add(lst):
        return f"list_reduce({lst}, lambda u, w: u + w)"

    tr = ("list_transform(range(6, 18), lambda i: ((0.5 * xs[i - 5] + "
          + add("xs[i - 4:i + 6]") + ") + 0.5 * xs[i + 7]) / 12)")
    return f""",
w0 AS (SELECT {key}, xs, n, {tr} AS tr FROM {series} WHERE n >= 24),
w1 AS (SELECT *, list_transform(range(0, 12), lambda p: CASE WHEN p < 6 THEN xs[p + 13] - tr[p + 7]
                                                              ELSE xs[p + 1] - tr[p - 5] END) AS fg,
              {add('tr')} / 12 AS ty FROM w0),
w2 AS (SELECT *, {add('fg')} / 12 AS fm,
              {add("list_transform(range(0, 12), lambda i: (i + 1 - 6.5) * (tr[i + 1] - ty))")} / 143.0 AS t0
       FROM w1),
ws AS (SELECT {key}, xs, n, ty - t0 * 6.5 AS l0, t0, list_transform(fg, lambda v: v - fm) AS s0 FROM w2)"""


def hw_ctes(series: str, key: str = "k") -> str:
    """CTEs fitting additive seasonal Holt-Winters (period 12) on the same
    start values and two-pass grid as the Spark side. ``series`` is a
    relation (key, xs list<double>, n). Produces ``wfit(k, alpha, beta, gamma,
    sse, l, t, q, sd)``. Lists are 1-based here, 0-based in Spark SQL."""
    def add(lst):
        return f"list_reduce({lst}, lambda u, w: u + w)"

    def d100(j):
        return f"CAST({j} AS DOUBLE) / CAST(100 AS DOUBLE)"

    def fold(name, grid, extra_cols="", extra_init="", extra_step=""):
        return f"""
{name} AS (
  SELECT {key}, ja, jb, jg, {d100('ja')} AS a, {d100('jb')} AS b, {d100('jg')} AS g,
         13 AS i, l0 AS l, t0 AS t, s0 AS q, CAST(0 AS DOUBLE) AS sse{extra_init}, xs, n{extra_cols}
  FROM {grid}
  UNION ALL
  SELECT {key}, ja, jb, jg, a, b, g, i + 1,
         a * (xs[i] - q[1]) + (1 - a) * (l + t),
         b * ((a * (xs[i] - q[1]) + (1 - a) * (l + t)) - l) + (1 - b) * t,
         list_append(q[2:12], g * (xs[i] - (a * (xs[i] - q[1]) + (1 - a) * (l + t))) + (1 - g) * q[1]),
         sse + (xs[i] - ((l + t) + q[1])) * (xs[i] - ((l + t) + q[1])){extra_step}, xs, n{extra_cols}
  FROM {name} WHERE i <= n
)"""
    return f"""{hw_start_ctes(series, key)},
wg1 AS (SELECT s.*, a.i * 10 AS ja, b.i * 10 AS jb, c.i * 10 AS jg
        FROM ws s, range(0, 11) a(i), range(0, 11) b(i), range(0, 11) c(i)),
{fold('wr1', 'wg1').strip()},
wb1 AS (SELECT {key}, arg_min(struct_pack(ja := ja, jb := jb, jg := jg),
                              struct_pack(sse := sse, ja := ja, jb := jb, jg := jg)) AS p
        FROM wr1 WHERE i = n + 1 GROUP BY {key}),
wg2 AS (SELECT s.*, p.ja + a.i - 5 AS ja, p.jb + b.i - 5 AS jb, p.jg + c.i - 5 AS jg
        FROM ws s JOIN wb1 USING ({key}), range(0, 11) a(i), range(0, 11) b(i), range(0, 11) c(i)
        WHERE p.ja + a.i - 5 BETWEEN 0 AND 100 AND p.jb + b.i - 5 BETWEEN 0 AND 100
          AND p.jg + c.i - 5 BETWEEN 0 AND 100),
{fold('wr2', 'wg2').strip()},
wb2 AS (SELECT {key}, arg_min(struct_pack(ja := ja, jb := jb, jg := jg, sse := sse),
                              struct_pack(sse := sse, ja := ja, jb := jb, jg := jg)) AS p
        FROM wr2 WHERE i = n + 1 GROUP BY {key}),
wg3 AS (SELECT s.*, p.ja AS ja, p.jb AS jb, p.jg AS jg, p.sse AS best_sse FROM ws s JOIN wb2 USING ({key})),
{fold('wr3', 'wg3', ", best_sse", ", CAST([] AS DOUBLE[]) AS e",
      ", list_append(e, xs[i] - ((l + t) + q[1]))").strip()},
wfit AS (
  SELECT {key}, a AS alpha, b AS beta, g AS gamma, best_sse AS sse, l, t, q,
         sqrt({add("list_transform(e, lambda v: (v - " + add('e') + " / len(e)) * (v - " + add('e') + " / len(e)))")}
              / (len(e) - 1)) AS sd
  FROM wr3 WHERE i = n + 1
)"""


def newton_ctes(base: str, names: list[str], key: str = "k") -> str:
    """The Gauss-Newton search in SQL: one recursion over the points of the series, turn by
    turn, on the arithmetic that :func:`ledger_spark.operators.forecast.newton_parts` states.

    ``base`` is a relation (key, xs, n, l0, t0[, s0]). Produces ``nfit(k, a, b[, g], sse,
    l, t[, q], e)``.
    """
    from ledger_spark.operators import forecast as FC

    parts, p, season = FC.newton_parts(names), len(names), "g" in names
    first = 13 if season else 3
    plain = lambda text: re.sub(r"(?<=\d)D\b", "", text)

    def struct(fields, **at):
        return "struct_pack(" + ", ".join(f"{f} := {plain(v.format(**at))}" for f, v in fields) + ")"

    old = {"q0": "f.q[1]", **{f"q0_{x}": f"f.q_{x}[1]" for x in names}}
    zero = [(f, "CAST(0 AS DOUBLE)") for f, _ in parts["zero"]]
    begin = lambda at: struct([*[(x, f"{at}{x}") for x in names], ("l", "l0"), ("t", "t0"), *zero,
                               *([("q", "s0"), *[(f"q_{x}", "list_transform(s0, lambda z: CAST(0 AS DOUBLE))") for x in names]]
                                 if season else [])])
    step = struct([*[(x, f"f.{x}") for x in names], *parts["step"],
                   *[(f, f"list_append(f.{f}[2:12], {v})") for f, v in parts["fresh"]]], s="f", v="v", **old)
    taken = lambda at, damp: struct([*[(f, f"{at}.{f}") for f, _ in parts["kept"]], ("damp", damp)])
    values = ", ".join(f"(VALUES {', '.join(f'(CAST({v} AS DOUBLE))' for v in vs)}) AS s_{x}({x})"
                       for x, vs in zip(names, FC.STARTS[p]))
    listed = ", ".join(names)
    return f""",
na AS (SELECT b.*, {listed} FROM {base} b, {values}),
nr0 AS (
  SELECT {key}, xs, n, l0, t0, {'s0, ' if season else ''}{first} AS i, {begin('')} AS f FROM na
  UNION ALL
  SELECT {key}, xs, n, l0, t0, {'s0, ' if season else ''}i + 1, {step}
  FROM (SELECT *, {struct(parts['error'], s='f', x='xs[i]', **old)} AS v FROM nr0 WHERE i <= n)
),
ns AS (SELECT {key}, any_value(xs) AS xs, any_value(n) AS n, any_value(l0) AS l0, any_value(t0) AS t0,
              {'any_value(s0) AS s0, ' if season else ''}arg_min(f, struct_pack(sse := f.sse, {', '.join(f'{x} := f.{x}' for x in names)})) AS f
       FROM nr0 WHERE i = n + 1 GROUP BY {key}),
nr AS (
  SELECT {key}, xs, n, l0, t0, {'s0, ' if season else ''}0 AS turn, n + 1 AS i, {taken('f', f'CAST({FC.DAMPING} AS DOUBLE)')} AS p, f FROM ns
  UNION ALL
  SELECT {key}, xs, n, l0, t0, {'s0, ' if season else ''}CASE WHEN i > n THEN turn + 1 ELSE turn END, CASE WHEN i > n THEN {first} ELSE i + 1 END,
         p2, CASE WHEN i > n THEN {begin('c.')} ELSE {step} END
  FROM (SELECT *, {struct(parts['moved'], p='p2', d='d')} AS c
  FROM (SELECT *, {struct(parts['solved'], m='m')} AS d
  FROM (SELECT *, {struct(parts['masked'], p='p2')} AS m
  FROM (SELECT *, CASE WHEN i <= n OR turn = 0 THEN p WHEN f.sse < p.sse THEN {taken('f', f'p.damp * {FC.EASIER}')}
                       ELSE {taken('p', f'p.damp * {FC.HARDER}')} END AS p2,
               {struct(parts['error'], s='f', x='xs[i]', **old)} AS v
        FROM nr WHERE turn <= {FC.STEPS[p]}))))
),
nb AS (SELECT {key}, xs, n, l0, t0, {'s0, ' if season else ''}{', '.join(f'p.{x} AS {x}' for x in names)}, p.sse AS best_sse
       FROM nr WHERE turn = {FC.STEPS[p] + 1} AND i = {first}),
ne AS (
  SELECT *, {first} AS i, l0 AS l, t0 AS t{', s0 AS q' if season else ''}, CAST([] AS DOUBLE[]) AS e FROM nb
  UNION ALL
  SELECT * EXCLUDE (i, l, t{', q' if season else ''}, e, er), i + 1, l + t + a * er, t + a * b * er{', list_append(q[2:12], q[1] + g * (1 - a) * er)' if season else ''},
         list_append(e, er)
  FROM (SELECT *, xs[i] - (l + t{' + q[1]' if season else ''}) AS er FROM ne WHERE i <= n)
),
nfit AS (SELECT {key}, {listed}, best_sse AS sse, l, t, {'q, ' if season else ''}e,
                sqrt(list_sum(list_transform(e, lambda v: (v - list_sum(e) / len(e)) * (v - list_sum(e) / len(e)))) / (len(e) - 1)) AS sd
         FROM ne WHERE i = n + 1)"""
