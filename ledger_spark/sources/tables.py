"""Readers (A1-A3) and the adapter that turns the given test tables into the
transaction model.

Adapter (decided once, used everywhere, mirrored by the oracle SQL):

* transactions  = orders LEFT JOIN customer:
  ``id`` = o_orderkey, ``date`` = o_orderdate, ``amount`` = o_totalprice,
  ``description`` = c_name, ``category`` = c_mktsegment, then the normal
  cleaning (B6) and category mapping (C1).
* categories    = the 13 seed rows plus every market segment not yet present
  (inserted by A4's insert-if-absent; new ids continue after the maximum in
  name order). Segments ``household`` and ``automobile`` are marked essential
  (fixture choice, mirroring groceries/transport).
* budgets       = each category's total of the previous month.
* labelled docs = documents: description = text, amount = n_chars, category = lang.

The adapter only joins ``customer`` when a query needs a customer-derived
column; reports over date and amount read ``orders`` alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.schema import RAW_FEED

ORDER_ONLY = {"id", "date", "amount"}
ALL_COLUMNS = ["id", "date", "description", "amount", "category_id", "category_raw", "is_recurring"]
FIXTURE_ESSENTIAL = ["household", "automobile"]


def read_table(spark: SparkSession, path_or_table: str, cols=None) -> DataFrame:
    """A2: a stored table (Parquet path or catalog name), optionally projected."""
    if "/" in path_or_table or path_or_table.endswith(".parquet"):
        df = spark.read.parquet(path_or_table)
    else:
        df = spark.table(path_or_table)
    return df.select(*cols) if cols else df


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """A2 for an external database through Spark's JDBC source; with a
    partition column the read is split into ``num_partitions`` range queries.
    Not registered as a query: it needs a database server."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def read_transactions_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A1: header CSV ``date, description, amount, category``; all columns read as
    text (casts happen in cleaning, so one bad cell cannot change a column's
    type); empty cells and ``NA`` are NULL."""
    return (spark.read.schema(schema or RAW_FEED).option("header", True).option("nullValue", "NA")
            .option("emptyValue", None).option("mode", "PERMISSIVE").csv(path))


def normalize_column_names(df: DataFrame) -> DataFrame:
    """A3: lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def _t(spark: SparkSession, sf_dir: str, name: str, cols):
    return read_table(spark, f"{sf_dir}/{name}.parquet", cols)


def raw_feed(spark: SparkSession, sf_dir: str, with_customer: bool = True) -> DataFrame:
    """The transaction feed as it arrives: id, date, amount (+ description, category)."""
    o = _t(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    feed = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"),
                    F.col("o_totalprice").alias("amount"), "o_custkey")
    if with_customer:
        c = _t(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"])
        # customer grows with the data: no broadcast hint; the planner picks
        # broadcast only under its size threshold, else sort-merge (AQE splits skew)
        feed = feed.join(c, feed.o_custkey == c.c_custkey, "left").select(
            "id", "date", "amount", F.col("c_name").alias("description"),
            F.col("c_mktsegment").alias("category"))
    return feed.drop("o_custkey")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category dimension of the fixture (see module doc), built from the
    tables on every call and written once, so that joins know its size."""
    from ledger_spark.session import materialize

    return materialize(_build_categories(spark, sf_dir).coalesce(1))  # a few short rows: one file


def _build_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledger_spark.functions.text import normalize_category
    from ledger_spark.sources.maintenance import insert_categories, seed_categories

    segs = (_t(spark, sf_dir, "customer", ["c_mktsegment"])
            .select(normalize_category("c_mktsegment").alias("name"))
            .where(F.col("name").isNotNull() & (F.col("name") != "")).distinct())
    new = segs.select("name", F.lit("market segment").alias("description"),
                      F.col("name").isin(FIXTURE_ESSENTIAL).cast("int").alias("is_essential"))
    return insert_categories(seed_categories(spark), new)


def transactions(spark: SparkSession, sf_dir: str, columns=None, cats: DataFrame | None = None) -> DataFrame:
    """The cleaned, category-mapped fact table of the fixture.

    ``cats`` is the dimension to map with, if the caller has it already.
    ``columns`` limits the output; when only order-level columns are asked
    for, the customer table is not read at all.
    """
    from ledger_spark.operators.clean import clean_transactions, map_categories

    columns = list(columns or ALL_COLUMNS)
    needs_customer = bool(set(columns) - ORDER_ONLY)
    clean = clean_transactions(raw_feed(spark, sf_dir, needs_customer), keep=["id"])
    if "category_id" in columns:
        clean = map_categories(clean, cats if cats is not None else categories(spark, sf_dir))
    return clean.select(*columns)


UNSPENT_BUDGET = ("rent", 100)


def budgets(spark: SparkSession, sf_dir: str, t: DataFrame | None = None, cats: DataFrame | None = None) -> DataFrame:
    """Fixture budgets: each (category, month) gets the category's total of the
    previous month (the month after the last one gets a budget with no spend),
    and ``UNSPENT_BUDGET``'s category, which no transaction has, its amount."""
    from ledger_spark.functions.dates import month_key

    cats = cats if cats is not None else categories(spark, sf_dir)
    t = t if t is not None else transactions(spark, sf_dir, ["date", "amount", "category_id"], cats)
    prev = (t.groupBy("category_id", month_key(F.add_months(F.trunc("date", "month"), 1)).alias("month"))
            .agg(F.sum("amount").alias("budget_amt")))
    name, amount = UNSPENT_BUDGET
    unspent_id = cats.where(F.col("name") == name).select(F.min("id")).scalar()
    unspent = prev.select(unspent_id.alias("category_id"), "month", F.lit(amount).cast("decimal(12,2)").alias("budget_amt"))
    prev = prev.unionByName(unspent.distinct())
    # a deterministic surrogate key: category id followed by yyyymm
    yyyymm = F.regexp_replace("month", "-", "").cast("long")
    return prev.select((F.col("category_id") * 1_000_000 + yyyymm).alias("id"),
                       "category_id", "month", "budget_amt")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier input: id, description, amount, category (= doc language)."""
    d = _t(spark, sf_dir, "documents", ["doc_id", "text", "n_chars", "lang"])
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("description"),
                    F.col("n_chars").cast("decimal(12,2)").alias("amount"),
                    F.col("lang").alias("category"))
