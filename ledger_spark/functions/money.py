"""Exact money arithmetic.

Amounts are ``decimal(12,2)``. Sums stay decimal; means are ``sum / count``
in decimal (``avg`` on decimals would round twice), and every rounding is
half-up (away from zero), which is what SQL ``ROUND(numeric, n)`` does.
Results are emitted as ``double`` *after* exact rounding so that any two
engines hand out the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def to_money(c) -> Column:
    """Cast to ``decimal(12,2)``; unparseable or out-of-range values become NULL."""
    return _c(c).try_cast("decimal(12,2)")


def dbl(c) -> Column:
    return _c(c).cast("double")


def round_money(c, scale: int = 2) -> Column:
    """Half-up rounding of an exact decimal, emitted as double."""
    return F.round(_c(c), scale).cast("double")


def mean_money(total, n, scale: int = 2) -> Column:
    """Exact mean ``total / n`` rounded half-up (NULL when ``n`` is 0)."""
    return F.round(_c(total) / F.nullif(_c(n).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")),
                   scale).cast("double")


def pct(part, whole, scale: int = 1) -> Column:
    """``part * 100 / whole`` exactly, rounded half-up; NULL when whole is 0/NULL."""
    return F.round(_c(part) * F.lit(100) / F.nullif(_c(whole), F.lit(0)), scale).cast("double")
