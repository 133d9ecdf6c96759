"""Rule expressions: keyword classifier (B13), expense type (B11), budget
status (B12), amount features (B14) and buckets (B15)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledger_spark.schema import (BUCKET_EDGES, BUCKET_LABELS, KEYWORD_RULES, LARGE_AMOUNT,
                                 ROUND_MODULUS, STATUS_OVER, STATUS_UNDER, UNCATEGORIZED)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def keyword_classify(c, rules=KEYWORD_RULES, default: str = UNCATEGORIZED,
                     word_boundary: bool = False) -> Column:
    """First rule whose pattern occurs in ``upper(description)`` wins.

    Folded into one ``CASE WHEN`` chain: JVM-side, inside whole-stage codegen.
    ``word_boundary`` anchors every alternative at word edges (off by default:
    the original patterns are plain substrings, so ``BP`` matches inside words).
    """
    up = F.upper(_c(c))
    expr = None
    for label, pattern in rules:
        if word_boundary:
            cond = up.rlike(rf"\b(?:{pattern})\b")
        else:
            cond = matches_any(up, pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


_LITERAL = re.compile(r"^[A-Za-z0-9 ]+$")


def matches_any(col: Column, pattern: str) -> Column:
    """Unanchored regex test; an alternation of plain words is evaluated as
    substring tests (same result, no regex engine: several times faster on
    long texts)."""
    words = pattern.split("|")
    if all(_LITERAL.match(w) for w in words):
        cond = None
        for w in words:
            x = col.contains(w)
            cond = x if cond is None else cond | x
        return cond
    return col.rlike(pattern)


def expense_type(is_essential) -> Column:
    """1 -> Essential, anything else (NULL included) -> Discretionary."""
    return F.when(_c(is_essential) == 1, "Essential").otherwise("Discretionary")


def budget_status(actual, budget) -> Column:
    """Under when actual <= budget, else Over (NULL actual -> Over)."""
    return F.when(_c(actual) <= _c(budget), STATUS_UNDER).otherwise(STATUS_OVER)


def amount_bucket(c) -> Column:
    """Right-closed bins; values at or below the first edge are ``tiny``."""
    a = _c(c)
    expr = F.when(a <= BUCKET_EDGES[0], BUCKET_LABELS[0])
    for edge, label in zip(BUCKET_EDGES[1:], BUCKET_LABELS[1:-1]):
        expr = expr.when(a <= edge, label)
    return expr.when(a.isNotNull(), BUCKET_LABELS[-1])


def log_amount(c) -> Column:
    return F.log1p(_c(c).cast("double"))


def is_round(c) -> Column:
    """1 when the amount equals itself rounded to tens (R ``round(x, -1)``).

    R rounds halves to even; on amounts ``x == round(x, -1)`` only holds for
    exact multiples of ten, where the rounding mode does not matter.
    """
    return (_c(c) % ROUND_MODULUS == 0).cast("int")


def is_large(c) -> Column:
    return (_c(c) > LARGE_AMOUNT).cast("int")
