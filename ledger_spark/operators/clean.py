"""Cleaning and category mapping.

All of it is narrow: projections and filters in one stage, except the
category lookup, a join with the dimension that the planner broadcasts while
its size in bytes allows. No shuffle of the fact table then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_spark.functions.money import to_money
from ledger_spark.functions.text import clean_description, normalize_category, recurring_flag
from ledger_spark.schema import UNCATEGORIZED


def parse_date(df: DataFrame, col: str = "date") -> DataFrame:
    """B1: to DATE (strings must be ``yyyy-MM-dd``); rows that do not parse are dropped."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        parsed = F.try_to_date(F.col(col), "yyyy-MM-dd")
    elif isinstance(dtype, T.DateType):
        parsed = F.col(col)
    else:
        parsed = F.col(col).cast("date")
    return df.withColumn(col, parsed).where(F.col(col).isNotNull())


def parse_amount(df: DataFrame, col: str = "amount") -> DataFrame:
    """To ``decimal(12,2)``; keep non-NULL, strictly positive amounts.

    The cast comes first, so an amount that rounds to 0.00 is dropped here
    instead of failing a ``CHECK (amount > 0)`` later.
    """
    return df.withColumn(col, to_money(col)).where(F.col(col) > 0)


def clean_transactions(raw: DataFrame, keep=(), fold_accents: bool = False,
                       retrim: bool = False) -> DataFrame:
    """B1-B5 composed; output ``date, description, amount, category_raw, is_recurring``.

    Column names are lower-cased first (A3). ``description``/``category`` may be
    absent (a feed that only carries date and amount); their outputs are then
    left out too. ``keep`` lists extra columns (e.g. an id) to carry through.
    """
    from ledger_spark.sources.tables import normalize_column_names

    df = normalize_column_names(raw)
    df = parse_date(df, "date")
    cols = [*keep, "date"]
    if "description" in df.columns:
        df = df.withColumn("description", clean_description("description", fold_accents, retrim))
        cols.append("description")
    df = parse_amount(df, "amount")
    cols.append("amount")
    if "category" in df.columns:
        df = df.withColumn("category_raw", normalize_category("category"))
        cols.append("category_raw")
    if "description" in df.columns:
        df = df.withColumn("is_recurring", recurring_flag("description"))
        cols.append("is_recurring")
    return df.select(*cols)


def uncategorized_id(categories: DataFrame) -> DataFrame:
    """One-row frame holding the id of ``uncategorized`` (C6 style scalar)."""
    return categories.where(F.col("name") == UNCATEGORIZED).select(F.col("id").alias("_default_id"))


def map_categories(clean: DataFrame, categories: DataFrame) -> DataFrame:
    """Left lookup of ``category_raw`` by category name; misses get the id of
    ``uncategorized``. The default id is a scalar subquery."""
    lookup = categories.select(F.col("name").alias("category_raw"), F.col("id").alias("category_id"))
    # scalar subquery: evaluated once, then a constant inside the projection
    default = uncategorized_id(categories).select(F.min("_default_id")).scalar()
    return (clean.join(lookup, "category_raw", "left")
            .withColumn("category_id", F.coalesce("category_id", default)))


def color_lookup(df: DataFrame, categories: DataFrame, name_col: str = "category") -> DataFrame:
    """Colour by trimmed, lower-cased category name; unknown -> NULL."""
    colors = categories.select(F.lower(F.trim("name")).alias("_k"), "color_hex")
    return df.join(colors, F.lower(F.trim(df[name_col])) == colors["_k"], "left").drop("_k")


def category_id_by_name(df: DataFrame, categories: DataFrame, name_col: str = "category",
                        out_col: str = "category_id") -> DataFrame:
    """Case-insensitive name -> id (NULL when unknown)."""
    ids = categories.select(F.lower("name").alias("_k"), F.col("id").alias(out_col))
    return df.join(ids, F.lower(df[name_col]) == ids["_k"], "left").drop("_k")


def suggestable_input(df: DataFrame, col: str = "description", min_chars: int = 3) -> DataFrame:
    """Only descriptions of at least ``min_chars`` characters get a suggestion."""
    return df.where(F.length(col) >= min_chars)
