"""Table maintenance (A4-A10, A13): seeding, validation, ids, reload, append, delete.

``transactions`` is a stored table (:mod:`ledger_spark.sources.storage`),
partitioned by month, so that month filters prune whole folders, and by a hash
bucket of the id, so that a delete or update reads its ids' buckets and rewrites
only folders that hold one. Every change is one atomic commit.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledger_spark.functions.dates import month_key
from ledger_spark.schema import CATEGORIES, DEFAULT_COLOR, SEED_CATEGORIES, TRANSACTIONS
from ledger_spark.session import materialize
from ledger_spark.sources import storage


def seed_categories(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    """A4: the 13 default categories, inserted only where the name is absent.

    Idempotent: seeding a seeded table returns it unchanged. On an empty table
    the ids follow the seed order 1..13.
    """
    rows = [(i + 1, n, d, c, e) for i, (n, d, c, e) in enumerate(SEED_CATEGORIES)]
    seed = spark.createDataFrame(rows, CATEGORIES)
    if existing is None:
        return seed
    return insert_categories(existing, seed.withColumnRenamed("id", "_seq"), order_cols=None)


def insert_categories(existing: DataFrame, new: DataFrame, order_cols=("name",)) -> DataFrame:
    """Insert-if-absent by ``name``; new rows get ids after the current maximum.

    ``new`` needs ``name`` and may carry description/color_hex/is_essential
    (defaults: NULL, the default grey, 0). Without ``order_cols`` the new ids
    follow ``new``'s ``_seq`` column (used by A4 for the seed order).
    """
    for col, default in (("description", F.lit(None).cast("string")),
                         ("color_hex", F.lit(DEFAULT_COLOR)),
                         ("is_essential", F.lit(0))):
        if col not in new.columns:
            new = new.withColumn(col, default)
    if "_seq" not in new.columns:
        new = new.withColumn("_seq", F.lit(0))
    order_cols = order_cols or ("_seq", "name")
    new = new.where(F.col("name").isNotNull()).dropDuplicates(["name"])
    absent = new.join(existing.select("name"), "name", "left_anti")
    start = existing.select(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    # categories are a dimension: a single ordered window over the handful of
    # *new* names is fine (bounded by the distinct names, not by the facts)
    w = Window.orderBy(*order_cols)
    added = absent.select((start + F.row_number().over(w)).cast("long").alias("id"), "name",
                          "description", "color_hex", F.col("is_essential").cast("int"))
    return existing.select(*CATEGORIES.names).unionByName(added)


def assign_ids(df: DataFrame, start: int | DataFrame = 0, order_cols=("date",),
               id_col: str = "id") -> DataFrame:
    """Dense surrogate keys ``start+1, start+2, ...`` in ``order_cols`` order.

    Two passes instead of one global window (which would pull every row into
    one task): sort with range partitioning, write the sorted rows to the shared
    folder (so a lost executor cannot reshuffle them and change ids), count rows
    per partition, and add the running offset to each row's position inside its
    partition. The row's position in the input is the last sort key: rows that
    are equal in ``order_cols`` can then be split over partitions too.
    """
    # the position of a row in its input also breaks ties: a range sort cannot
    # split equal keys, and a third of the rows may share one date
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    sorted_df = materialize(tied.sort(*order_cols, "_tie").drop("_tie")
                            .withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", 33)
    counts = sorted_df.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = materialize(counts.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off")))
    base = start if isinstance(start, int) else start.scalar()
    pos = F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    # one row per partition in a file of known size: the planner may broadcast it
    out = (sorted_df.withColumn("_pid", pid).join(offsets, "_pid")
           .withColumn(id_col, (F.lit(base) + F.col("_off") + pos + 1).cast("long")))
    return out.drop("_mid", "_pid", "_off")


def fill_defaults(df: DataFrame) -> DataFrame:
    """A10: add the model and note columns as NULL, stamp ``created_at`` and put
    the columns in table order."""
    cols = []
    for f in TRANSACTIONS.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType))
        elif f.name == "created_at":
            cols.append(F.current_timestamp().alias("created_at"))
        elif f.name == "is_recurring":
            cols.append(F.lit(0).alias("is_recurring"))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def validate_transactions(df: DataFrame, categories: DataFrame | None = None):
    """Split rows into ``(good, rejects)``; rejects carry ``reasons`` (array).

    The rows are judged once: they are written with their verdict, partitioned by
    it, and each result reads its own part.

    Checks: NOT NULL id/date/description/amount, amount > 0 and within
    decimal(12,2), unique id, and (with ``categories``) a known category id.
    Uniqueness comes from a partially aggregated count per id joined back,
    so a heavily duplicated id never gathers its rows in one task.
    """
    out = df
    reasons = [
        F.when(F.col("date").isNull(), F.lit("date is null")),
        F.when(F.col("description").isNull() | (F.col("description") == ""), F.lit("description is empty")),
        F.when(F.col("amount").isNull(), F.lit("amount is null or out of range")),
        F.when(F.col("amount") <= 0, F.lit("amount not positive")),
    ]
    if "id" in df.columns:
        reasons.append(F.when(F.col("id").isNull(), F.lit("id is null")))
        # duplicated ids from a partially aggregated count (a hot id costs one
        # row per task), then flagged through a join on id (AQE splits skew)
        dups = (df.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("_c"))
                .where(F.col("_c") > 1).select("id", F.lit(True).alias("_dup")))
        out = out.join(dups, "id", "left")
        reasons.append(F.when(F.col("_dup"), F.lit("duplicate id")))
    if categories is not None and "category_id" in df.columns:
        known = categories.select(F.col("id").alias("category_id"), F.lit(True).alias("_known"))
        out = out.join(known, "category_id", "left")
        reasons.append(F.when(F.col("category_id").isNotNull() & F.col("_known").isNull(),
                              F.lit("unknown category")))
    out = out.withColumn("reasons", F.array_compact(F.array(*reasons)))
    judged = materialize(out.select(*df.columns, "reasons", (F.size("reasons") == 0).alias("_good")), by=("_good",))
    return judged.where("_good").select(*df.columns), judged.where("NOT _good").select(*df.columns, "reasons")


def validate_budgets(b: DataFrame):
    """A8 for budgets: (category_id, month) must be unique and month ``YYYY-MM``."""
    dups = (b.groupBy("category_id", "month").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1)
            .select("category_id", "month", F.lit(True).alias("_dup")))
    out = b.join(dups, ["category_id", "month"], "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("_dup"), F.lit("duplicate category/month")),
        F.when(~F.col("month").rlike(r"^\d{4}-\d{2}$"), F.lit("bad month")),
        F.when(F.col("budget_amt").isNull(), F.lit("budget is null"))))
    out = out.withColumn("reasons", reasons)
    return (out.where(F.size("reasons") == 0).select(*b.columns),
            out.where(F.size("reasons") > 0).select(*b.columns, "reasons"))


def leaf_order() -> tuple:
    """Order of a leaf's rows: by size of the amount, then by date."""
    return F.floor(F.log2(F.col("amount").cast("double"))), F.col("date")


def _placed(t: DataFrame, buckets: int) -> DataFrame:
    return (t.withColumn("month", F.coalesce(month_key("date"), F.lit("none")))
            .withColumn("bucket", storage.bucket(F.col("id"), buckets)))


def reload_transactions(t: DataFrame, path: str, buckets: int | None = None) -> None:
    """A5: replace all stored rows atomically: they are written beside the old
    ones, with every column of the table (A10), then the new state is committed.

    ``buckets`` is the number of id buckets per month; a table keeps its number, a
    new one gets it from its rows (:func:`storage.buckets_for`).
    """
    t = fill_defaults(t)
    spark = t.sparkSession
    if buckets is None:
        state = storage.current(spark, path)
        if state is None:
            size = t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(month_key("date")).alias("months")).first()
            buckets = storage.buckets_for(size.n, size.months)
        else:
            buckets = state.buckets
    storage.change(spark, path, lambda before: storage.State(
        schema=TRANSACTIONS, leaves=storage.write(_placed(t, buckets), path, sort=leaf_order()), buckets=buckets,
        notes=before.notes if before else {}))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored rows with their ``month``; None when the table does not exist. A
    table that exists but cannot be read raises."""
    state = storage.current(spark, path)
    return None if state is None else storage.read(spark, path, state).drop("v", "bucket")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    stored = _stored(spark, path)
    if stored is None:
        raise FileNotFoundError(f"no transactions table at {path}")
    return stored.drop("month")


def check_new_rows(new_rows: DataFrame, categories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows for A6 as ``(good, rejects)``: date defaults to today, a category
    name becomes its id (unknown names: ``uncategorized``, as in a load);
    rejects carry ``reasons``."""
    from ledger_spark.functions.money import to_money
    from ledger_spark.functions.text import clean_description, normalize_category, recurring_flag
    from ledger_spark.operators.clean import map_categories

    rows = new_rows
    for name, kind in (("date", "date"), ("category", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    date = F.col("date").try_cast("date")
    rows = (rows.withColumn("_bad_date", F.col("date").isNotNull() & date.isNull())
            .withColumn("date", F.coalesce(date, F.current_date()))
            .withColumn("description", clean_description("description"))
            .withColumn("_given", F.col("amount")).withColumn("amount", to_money("amount"))
            .withColumn("category_raw", normalize_category("category")))
    rows = rows.withColumn("is_recurring", recurring_flag("description"))
    if categories is not None:
        given = F.col("category_id") if "category_id" in rows.columns else F.lit(None).cast("long")
        rows = rows.withColumn("_category_id", given)
        rows = map_categories(rows.drop("category_id"), categories).withColumn(
            "category_id", F.when(F.col("category_raw").isNull(), F.coalesce("_category_id", "category_id"))
            .otherwise(F.col("category_id"))).drop("_category_id")
    reasons = F.array_compact(F.array(
        F.when(F.col("_bad_date"), F.lit("date is not a date")),
        F.when(F.col("description").isNull() | (F.trim("description") == ""), F.lit("description is empty")),
        F.when(F.col("amount").isNull(), F.lit("amount is null or out of range")),
        F.when(F.col("amount") <= 0, F.lit("amount not positive"))))
    rows = rows.withColumn("reasons", reasons)
    good = rows.where(F.size("reasons") == 0).drop("reasons", "_bad_date", "_given", "category")
    rejects = rows.where(F.size("reasons") > 0).select(
        *[F.col("_given").alias("amount") if c == "amount" else F.col(c) for c in new_rows.columns], "reasons")
    return good, rejects


#: Batches whose tokens a table remembers, the newest ones.
TOKENS_KEPT = 10_000


def append_transactions(spark: SparkSession, path: str, new_rows: DataFrame,
                        categories: DataFrame | None = None, token: str | None = None) -> DataFrame:
    """Insert the good rows of :func:`check_new_rows`; ids continue after
    the stored maximum. Returns the rows written.

    ``token`` names the batch. It is committed together with the rows, so a batch
    that is given again (after a failure whose outcome the caller doesn't know)
    leaves the table as it is and returns the rows that it wrote then and that are
    still stored. The newest ``TOKENS_KEPT`` tokens are remembered. Of two appenders
    at once, one takes the ids after the other's.
    """
    good, _ = check_new_rows(new_rows, categories)
    numbered: list[DataFrame] = []  # ids from 1, once and for all attempts
    first = 0
    known: list[int] | None = None

    def attempt(state: storage.State | None) -> storage.State | None:
        nonlocal first, known
        notes = state.notes if state else {}
        known = notes.get("tokens", {}).get(token)
        if known is not None:
            return None
        if not numbered:
            numbered.append(materialize(fill_defaults(assign_ids(good, order_cols=("date", "description")))))
        first = int((storage.read(spark, path, state).agg(F.max("id")).first()[0] if state else None) or 0)
        rows = numbered[0].withColumn("id", F.col("id") + first)
        buckets = state.buckets if state else 1
        leaves = storage.write(_placed(rows, buckets), path, sort=leaf_order())
        if token is not None:
            tokens = {**notes.get("tokens", {}), token: [first + 1, first + numbered[0].count()]}
            notes = {**notes, "tokens": dict(list(tokens.items())[-TOKENS_KEPT:])}
        return storage.State(schema=TRANSACTIONS, leaves=(state.leaves if state else ()) + leaves, buckets=buckets, notes=notes)

    storage.change(spark, path, attempt)
    if known is not None:
        return read_transactions(spark, path).where(F.col("id").between(*known))
    storage.compact(spark, path, leaf_order())
    return numbered[0].withColumn("id", F.col("id") + first)


def delete_transactions(t: DataFrame, ids: DataFrame) -> DataFrame:
    """A7 on a frame: drop rows whose id is listed (anti join; ids may be large)."""
    return t.join(ids.select("id").distinct(), "id", "left_anti")


def _rewrite(spark: SparkSession, path: str, ids: DataFrame, change) -> None:
    """Replace the leaves that hold any of ``ids`` by ``change(their rows)``. Only
    leaves of the ids' buckets are searched."""

    def attempt(state: storage.State | None) -> storage.State | None:
        if state is None:
            raise FileNotFoundError(f"no transactions table at {path}")
        held = storage.holding(spark, path, state, ids)
        if not held:
            return None
        rows = change(storage.read(spark, path, state, held).drop("v"))
        return replace(state, leaves=storage.without(state.leaves, held) + storage.write(rows, path, sort=leaf_order()))

    storage.change(spark, path, attempt)


def delete_stored(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """A7 on the stored table: the listed ids are gone for every later read;
    only the months and buckets that held them are rewritten."""
    _rewrite(spark, path, ids, lambda rows: delete_transactions(rows, ids))


def store_predictions(spark: SparkSession, path: str, predictions: DataFrame) -> None:
    """H11's write-back: ``predictions(id, predicted_cat, confidence)`` into the
    stored rows of these ids; other rows keep what they have."""
    new = predictions.select("id", F.col("predicted_cat").alias("_cat"), F.col("confidence").alias("_conf"),
                             F.lit(True).alias("_new"))

    def change(rows: DataFrame) -> DataFrame:
        j = rows.join(new, "id", "left")
        return j.select(*[F.when(F.col("_new"), F.col(n)).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c)
                          if (n := {"predicted_cat": "_cat", "confidence": "_conf"}.get(c)) else F.col(c)
                          for c in rows.columns])

    _rewrite(spark, path, predictions, change)


def load_counts(raw: DataFrame, clean_fn, path: str, prepare=lambda t: t):
    """Rows read / valid after cleaning / found in the store after the load.

    ``Observation`` counts the raw rows while the cleaned ones are written, and
    the last number counts the stored table itself.
    """
    obs = Observation("read")
    clean = materialize(clean_fn(raw.observe(obs, F.count(F.lit(1)).alias("rows_read"))))
    n_read = obs.get["rows_read"]
    reload_transactions(prepare(clean), path)
    spark = raw.sparkSession
    return spark.createDataFrame([(int(n_read), int(clean.count()), int(read_transactions(spark, path).count()))],
                                 "rows_read long, rows_valid long, rows_loaded long")
