"""Structured Streaming versions of the live paths.

* J1 ``stream_clean``: raw rows arrive as files; cleaning + the category lookup
  are stateless (stream-static join), output appended.
* J2 ``stream_monthly_kpis``: running count/total per (month, category). The
  state is one row per (month, category), bounded by the calendar and the
  dimension, so no watermark is needed and late rows are always counted. Over
  the signed rows of a change log it follows updates, moves and deletes.
* J3 ``stream_suggest``: the classifier applied to arriving rows (stateless).
* J4 ``stream_change_log``: inserts/updates/deletes keyed by id; the highest
  sequence number of an id wins, in whatever batch it arrives. The table
  (by month and id bucket) keeps the sequence number of every row and of every
  deleted id; a batch reads its ids' buckets, rewrites the leaves that lose a row
  and logs what it did as signed rows.

Every query writes through ``foreachBatch`` (idempotent per epoch) with its
checkpoint in the shared checkpoint folder, so a restarted query resumes
exactly where it stopped. ``trigger(availableNow=True)`` drains what is
there and stops (tests, backfills); a long-running job uses processingTime.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.functions.dates import month_key
from ledger_spark.operators.clean import clean_transactions, map_categories
from ledger_spark.session import checkpoint_dir, materialize, scratch_dir
from ledger_spark.sources import storage


#: Micro-batches in which a backlog of files is drained (see :func:`files_per_batch`).
BATCHES = 4


def stream_path(spark: SparkSession, path: str) -> str:
    """File stream sources need a directory or a glob; a single file is turned
    into an equivalent one-file glob."""
    if not any(c in path for c in "*?[{") and storage.is_file(spark, path):
        return f"{path[:-1]}[{path[-1]}]"
    return path


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, **options) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(stream_path(spark, path))


def files_per_batch(files: int, batches: int = BATCHES) -> int:
    """``max_files_per_trigger`` with which so many files drain in at most ``batches``
    micro-batches: each costs the start of a job and the commits of its state, whatever its
    size, so that a backlog in batches of a fixed size costs more than its rows."""
    return max(1, -(-files // batches))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one query's output and checkpoint, inside this
    application's scratch folder (see :func:`ledger_spark.session.clear_scratch`)."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stream_clean(raw_stream: DataFrame, categories: DataFrame, keep=("id",)) -> DataFrame:
    """Clean + map categories on arrival."""
    return map_categories(clean_transactions(raw_stream, keep=keep), categories)


def stream_monthly_kpis(stream: DataFrame, categories: DataFrame, sign: str | None = None) -> DataFrame:
    """Running count / total / mean per (month, category name).

    The category name is attached before the aggregation (stream-static
    join), so the aggregation is the last stateful step. With ``sign`` (a column of
    1 and -1, see :func:`stream_deltas`) a row is added or taken back, so that the
    state follows updates, moves and deletes; drop groups of no rows with
    :func:`live_kpis`.
    """
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    s = stream.join(names, "category_id", "inner")
    n, amount = F.count(F.lit(1)), F.col("amount")
    if sign is not None:
        n, amount = F.sum(F.col(sign).cast("long")), F.when(F.col(sign) < 0, -amount).otherwise(amount)
    return s.groupBy(month_key("date").alias("month"), "category").agg(n.alias("n"), F.sum(amount).alias("total"))


def live_kpis(kpis: DataFrame) -> DataFrame:
    """The groups of :func:`stream_monthly_kpis` that have rows left."""
    return kpis.where(F.col("n") > 0)


def stream_suggest(stream: DataFrame, model, vocab: list[str], categories: DataFrame | None = None) -> DataFrame:
    """Category suggestion for arriving rows (stateless)."""
    from ledger_spark.operators.classify import suggest_category

    return suggest_category(model, stream, vocab, categories)


def run(stream_df: DataFrame, out_path: str, mode: str = "append", trigger_once: bool = True,
        checkpoint: str | None = None, partition_by=()):
    """Start a query that writes micro-batches to ``out_path``; returns it.

    ``append`` and ``update`` write one folder per epoch, so a replayed epoch
    replaces its own files only; ``complete`` writes the whole (bounded) result
    beside the last one and commits it. Read with :func:`read_output`.
    """
    spark = stream_df.sparkSession
    checkpoint = checkpoint or out_path.rstrip("/") + "._checkpoint"

    def write(batch: DataFrame, epoch: int) -> None:
        if mode == "complete":
            storage.publish(batch, out_path)
        else:
            w = batch.write.partitionBy(*partition_by) if partition_by else batch.write
            w.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    writer = stream_df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_output(spark: SparkSession, out_path: str, mode: str = "append", keys=()) -> DataFrame:
    """What :func:`run` has written so far. In ``update`` mode a key may have
    been written by several epochs: its latest row counts."""
    if mode == "complete":
        out = storage.published(spark, out_path)
        if out is None:
            raise FileNotFoundError(f"no output at {out_path} yet")
        return out
    out = spark.read.parquet(out_path)
    if mode != "update":
        return out.drop("epoch")
    rest = [c for c in out.columns if c not in (*keys, "epoch")]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def drain(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:  # pragma: no cover - surfaced to caller
        raise query.exception()


# --------------------------------------------------------------------------
# Change log
# --------------------------------------------------------------------------

def latest_changes(changes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Last operation per key by sequence number (a partial/final max_by
    aggregate: a hot key costs one row per task before the shuffle)."""
    cols = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("_c"))
    return last.select(key, *[F.col(f"_c.{c}").alias(c) for c in cols])


#: Folder of a change-log table in which its signed row changes appear.
DELTAS, PENDING = "deltas", "_pending"


def _same(left: str, right: str, names) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _leaf_order(rows: DataFrame) -> tuple:
    return (F.col("date"),) if "date" in rows.columns else ()


def apply_changes(spark: SparkSession, batch: DataFrame, table_path: str, key: str = "id",
                  seq: str = "seq", op: str = "op", buckets: int | None = None) -> None:
    """Merge one batch of changes into the table at ``table_path``.

    A row keeps its ``seq``; a deleted id stays as a marked row in the month it
    was last in, so an older operation that arrives later changes nothing (see
    :func:`forget_deleted`). The stored rows of the batch's ids are found in the
    ids' hash buckets, whatever their month, so a delete may carry the id alone and
    an update may move a row to another month; only leaves that lose a row are
    rewritten, new rows come beside the others. New columns are added; stored rows
    have NULL there. Applying a batch again changes nothing.

    What the batch did to the live rows goes to the delta log as signed rows: the
    old one with ``_sign`` -1, the new one with 1. The log's files are written
    before the commit that counts them in and shown after it; a failure between is
    made good by the next batch (:func:`show_deltas`), so every change appears once.
    A change log has one writer at a time, its stream.

    ``buckets`` is the number of id buckets of a new table (by default from the
    first batch's size).
    """
    table_path = table_path.rstrip("/")
    incoming = materialize(latest_changes(batch.where(F.col(key).isNotNull()), key, seq)
                           .withColumn("_deleted", F.coalesce(F.col(op) == "delete", F.lit(False))).drop(op))
    show_deltas(spark, table_path)

    def attempt(state: storage.State | None) -> storage.State | None:
        known_table = state is not None
        if not known_table:
            size = incoming.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(month_key("date")).alias("m")).first()
            state = storage.State(schema=incoming.schema, buckets=buckets or storage.buckets_for(size.n, size.m))
        fresh = [f for f in incoming.schema.fields if f.name not in state.schema.names]
        state = replace(state, schema=type(state.schema)([*state.schema.fields, *fresh]))
        names = state.schema.names
        given = incoming.select(*[(F.col(f.name) if f.name in incoming.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                                  for f in state.schema.fields])
        stored = storage.in_buckets(spark, table_path, state, given, key)
        new, old = (F.struct(*names).alias(n) for n in ("new", "old"))
        known = stored.select(key, old, F.struct("v", "month", "bucket").alias("at"))
        both = given.select(key, new).join(known, key, "left")
        later = F.col("old").isNull() | (F.col(f"new.{seq}") >= F.col(f"old.{seq}"))
        changed = materialize(both.where(later & ~F.coalesce(F.col("old").isNotNull() & _same("new", "old", names), F.lit(False))))
        if known_table and not fresh and changed.isEmpty():
            return None
        gone = [f"v={r.v}/month={r.month}/bucket={r.bucket}"
                for r in changed.where("at IS NOT NULL").select("at.*").distinct().toLocalIterator()]  # some of the state's
        others = storage.read(spark, table_path, state, gone).join(changed.select(key), key, "left_anti").drop("v")
        month = F.when(F.col("new._deleted"), F.coalesce("at.month", month_key("new.date"))).otherwise(month_key("new.date"))
        placed = changed.select("new.*", F.coalesce(month, F.lit("none")).alias("month"),
                                storage.bucket(F.col(key), state.buckets).alias("bucket"))
        leaves = storage.write(others.unionByName(placed), table_path, sort=_leaf_order(placed))
        live = lambda side: changed.where(f"NOT {side}._deleted").select(f"{side}.*")
        signed = (live("old").withColumn("_sign", F.lit(-1))).unionByName(live("new").withColumn("_sign", F.lit(1)))
        name = uuid.uuid4().hex
        signed.drop("_deleted").write.parquet(f"{table_path}/{PENDING}/{name}")
        return replace(state, leaves=storage.without(state.leaves, gone) + leaves, notes={**state.notes, "deltas": name})

    storage.change(spark, table_path, attempt)
    show_deltas(spark, table_path)
    storage.compact(spark, table_path, _leaf_order(incoming))


def show_deltas(spark: SparkSession, table_path: str) -> None:
    """Move the deltas of the last commit to where streams look for them, if that
    has not happened, and remove what a failed batch left behind."""
    state = storage.current(spark, table_path)
    last = state.notes.get("deltas") if state else None
    for name in storage.children(spark, f"{table_path}/{PENDING}"):
        if name == last:
            storage.move(spark, f"{table_path}/{PENDING}/{name}", f"{table_path}/{DELTAS}/{name}")
        else:
            storage.delete(spark, f"{table_path}/{PENDING}/{name}")


def stream_deltas(spark: SparkSession, table_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The delta log of a change-log table as a stream of signed rows (``_sign``)."""
    state = storage.current(spark, table_path)
    if state is None:
        raise FileNotFoundError(f"no change-log table at {table_path}")
    rows = spark.createDataFrame([], state.schema).drop("_deleted").withColumn("_sign", F.lit(1))
    return read_stream(spark, f"{table_path.rstrip('/')}/{DELTAS}/*", rows.schema, max_files_per_trigger=max_files_per_trigger)


def read_changes(spark: SparkSession, table_path: str, seq: str = "seq") -> DataFrame:
    """The live rows of a change-log table."""
    state = storage.current(spark, table_path)
    if state is None:
        raise FileNotFoundError(f"no change-log table at {table_path}")
    return storage.read(spark, table_path, state).where(~F.col("_deleted")).drop("_deleted", "v", "month", "bucket", seq)


def forget_deleted(spark: SparkSession, table_path: str, before_seq: int, seq: str = "seq") -> None:
    """Drop the marks of ids that were deleted by an operation below ``before_seq``:
    the caller knows that no older operation can arrive any more."""

    def attempt(state: storage.State | None) -> storage.State | None:
        past = F.col("_deleted") & (F.col(seq) < before_seq)
        rows = storage.read(spark, table_path, state) if state else None
        held = [] if rows is None else [f"v={r.v}/month={r.month}/bucket={r.bucket}" for r in rows.where(past)
                                        .select("v", "month", "bucket").distinct().toLocalIterator()]
        if not held:
            return None
        rest = storage.read(spark, table_path, state, held).where(~past).drop("v")
        return replace(state, leaves=storage.without(state.leaves, held)
                       + storage.write(rest, table_path, sort=_leaf_order(rest)))

    storage.change(spark, table_path, attempt)


def stream_change_log(change_stream: DataFrame, table_path: str, checkpoint: str | None = None,
                      trigger_once: bool = True, buckets: int | None = None):
    """Start the query that applies a change stream (id, seq, op, date, ...)
    to ``table_path``; returns the running query."""
    spark = change_stream.sparkSession
    checkpoint_dir(spark)
    checkpoint = checkpoint or table_path.rstrip("/") + "._checkpoint"
    writer = (change_stream.writeStream.foreachBatch(lambda b, e: apply_changes(spark, b, table_path, buckets=buckets))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="10 seconds")
    return writer.start()
