"""String column expressions: cleaning (B2, B4, B5) and tokens (H1)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledger_spark.schema import RECURRING_PATTERN


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim every kind of leading/trailing whitespace (tabs, newlines too)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def clean_description(c, fold_accents: bool = False, retrim: bool = False) -> Column:
    """B2: trim, upper-case, then drop everything outside ``[A-Z0-9 ]``.

    The order matters: trimming happens first, so a trailing space freed by
    symbol removal stays (``"CAFE *"`` -> ``"CAFE "``); accented letters are
    removed, not folded, unless ``fold_accents``.
    """
    x = F.upper(strip_ws(c))
    if fold_accents:
        # map accented capitals to their base letter before the filter
        x = F.translate(x, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "AAAAAACEEEEIIIINOOOOOUUUUY")
    x = F.regexp_replace(x, "[^A-Z0-9 ]", "")
    if retrim:
        x = strip_ws(x)
    return x


def normalize_category(c) -> Column:
    """Trim, lower-case, whitespace runs -> ``_``."""
    return F.regexp_replace(F.lower(strip_ws(c)), r"\s+", "_")


def recurring_flag(c, pattern: str = RECURRING_PATTERN) -> Column:
    """1 when the (cleaned) description contains one of the words."""
    from ledger_spark.functions.rules import matches_any

    return F.coalesce(matches_any(_c(c), pattern).cast("int"), F.lit(0))


# Token rule shared by training and serving: lower-case, split on anything
# that is neither a letter nor a digit, drop empty and all-digit tokens.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(c) -> Column:
    """H1 as an array column (no explode needed for presence features)."""
    # only what starts below ":", the character after "9", can be empty or all digits
    return F.filter(_parts(c), lambda t: (t >= ":") | ((t != F.lit("")) & ~t.rlike("^[0-9]+$")))


def tokens_among(c, words: list[str]) -> Column:
    """The tokens of :func:`tokens` that are one of ``words``, by one set look-up each."""
    held = [w for w in words if not re.fullmatch("[0-9]*", w)]
    return F.filter(_parts(c), lambda t: t.isin(held))


def _parts(c) -> Column:
    return F.split(F.lower(_c(c)), TOKEN_SPLIT)
