"""Date column expressions (B7, B8, B9, I9 helpers)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(c: Column | str = "date") -> Column:
    """Month as ``YYYY-MM`` text."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM")


def month_start(c: Column | str = "date") -> Column:
    """First day of the month, as DATE."""
    return F.trunc(F.col(c) if isinstance(c, str) else c, "month")


def month_bounds(month: str) -> tuple[_dt.date, _dt.date]:
    """First day of ``YYYY-MM`` and first day of the next month."""
    y, m = (int(p) for p in month.split("-"))
    first = _dt.date(y, m, 1)
    nxt = _dt.date(y + (m == 12), 1 if m == 12 else m + 1, 1)
    return first, nxt


def previous_month(month: str) -> str:
    y, m = (int(p) for p in month.split("-"))
    return f"{y - (m == 1):04d}-{12 if m == 1 else m - 1:02d}"


def in_month(month: str | None, c: Column | str = "date") -> Column:
    """B9 predicate: rows of one month, or everything for ``None``/``"all"``.

    Written as a range on the raw date column so Parquet min/max statistics and
    partition pruning apply (a ``date_format(...) = m`` test is not sargable).
    """
    col = F.col(c) if isinstance(c, str) else c
    if month is None or month == "all":
        return F.lit(True)
    first, nxt = month_bounds(month)
    return (col >= F.lit(first)) & (col < F.lit(nxt))


def month_label(c: Column | str = "date") -> Column:
    """F5 label such as ``MAR-2026``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.upper(F.date_format(col, "MMM-yyyy"))
