"""Stored tables on a shared file system: Parquet folders and a list of those that count.

A table is a folder. Every write puts its files into a new data folder ``v=...``,
partitioned by month and by a hash bucket of the id, and nothing in a data folder
is ever changed. A *state* names the partition folders (leaves) that make up the
table, and its schema; it is a small numbered file below ``_states``. A commit
writes the next number, and fails if another writer has taken it: readers see all
of a change or nothing of it, and of two writers one has to begin again
(:class:`Conflict`).

Finding rows by id reads only the leaves of the ids' buckets (:func:`holding`); a
change rewrites only the leaves that hold such rows. Rows of a leaf are sorted by
size of amount, then date, so that page statistics skip data for bounds on either.

``spark.read`` plans, prunes and reads all of it; this module only lists folders.
It needs a file system whose rename is atomic, as streaming checkpoints do.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATES = "_states"
#: Rows of one file; a hot month becomes several files, not one huge one.
RECORDS_PER_FILE = 5_000_000
#: Bytes of a row group: small enough for its statistics to skip something.
ROW_GROUP = 16 << 20
#: Rows of a month that one bucket should hold when a table is laid out.
ROWS_PER_LEAF = 1_000_000
#: Leaves of one month and bucket beyond which they are merged.
MOST_LEAVES = 16


class Conflict(RuntimeError):
    """Another writer has committed since the state was read."""


@dataclass(frozen=True)
class State:
    """What makes up a table: its leaves, schema, number of buckets, and notes of its writers."""

    number: int = 0
    schema: T.StructType = field(default_factory=T.StructType)
    leaves: tuple[str, ...] = ()
    buckets: int = 1
    notes: dict = field(default_factory=dict)


def _open(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Existence only: any other failure to reach ``path`` raises."""
    p, fs = _open(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    p, fs = _open(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _open(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename; False when ``target`` is there already."""
    (p, fs), (q, _) = _open(spark, source), _open(spark, target)
    fs.mkdirs(q.getParent())
    options = getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(options, 1)
    none[0] = options.NONE
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(p), fs.makeQualified(q), none)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _open(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in children(spark, f"{root}/{STATES}") if n.endswith(".json") and n[:-5].isdigit()]


def _state(spark: SparkSession, root: str, number: int) -> State:
    kept = json.loads(_read_text(spark, f"{root}/{STATES}/{number:012d}.json"))
    return State(number, T.StructType.fromJson(kept["schema"]), tuple(kept["leaves"]), kept["buckets"], kept["notes"])


def current(spark: SparkSession, root: str) -> State | None:
    """The table's present state; None when nothing was committed yet."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    return _state(spark, root, max(numbers)) if numbers else None


def commit(spark: SparkSession, root: str, before: State | None, after: State) -> State:
    """Make ``after`` the successor of ``before``. The state before it stays for
    readers that are still on it; what only older ones name is removed."""
    root = root.rstrip("/")
    number = before.number + 1 if before else 1
    beside, fs = _open(spark, f"{root}/{STATES}/.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(bytearray(json.dumps({"schema": json.loads(after.schema.json()), "leaves": list(after.leaves),
                                       "buckets": after.buckets, "notes": after.notes}), "utf-8"))
    stream.close()
    if not move(spark, beside.toString(), f"{root}/{STATES}/{number:012d}.json"):
        delete(spark, beside.toString())
        raise Conflict(f"state {number} of {root} was committed by another writer")
    needed = {*after.leaves, *(before.leaves if before else ())}
    for old in sorted(_numbers(spark, root)):
        if old < number - 1:
            for leaf in _state(spark, root, old).leaves:
                if leaf not in needed:
                    delete(spark, f"{root}/{leaf}")
            delete(spark, f"{root}/{STATES}/{old:012d}.json")
    return replace(after, number=number)


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(rows: int, months: int) -> int:
    """Buckets (a power of two) that give a month's leaf about ``ROWS_PER_LEAF`` rows."""
    n = 1
    while n * ROWS_PER_LEAF * max(1, months) < rows:
        n *= 2
    return n


def write(df: DataFrame, root: str, by=("month", "bucket"), sort: Iterable[Column] = ()) -> tuple[str, ...]:
    """Write rows into a new data folder, partitioned by the columns ``by``; its leaves.

    ``REBALANCE`` brings a partition's rows together, a hot one into several
    tasks: the number of files follows the data, not tasks times partitions.
    """
    spark, folder = df.sparkSession, f"v={uuid.uuid4().hex}"
    target = f"{root.rstrip('/')}/{folder}"
    if not by:
        df.write.parquet(target)
        return (folder,)
    out = df.hint("rebalance", *by).sortWithinPartitions(*by, *sort)
    (out.write.option("maxRecordsPerFile", RECORDS_PER_FILE).option("parquet.block.size", ROW_GROUP)
     .partitionBy(*by).parquet(target))
    p, fs = _open(spark, "/".join([target, *(f"{c}=*" for c in by)]))
    return tuple("/".join([folder, *s.getPath().toString().rsplit("/", len(by))[1:]]) for s in fs.globStatus(p) or ())


def read(spark: SparkSession, root: str, state: State, leaves: Iterable[str] | None = None) -> DataFrame:
    """The rows of ``state`` (or of some of its leaves), with ``v``, ``month`` and ``bucket``.
    Columns that a leaf was written without are NULL."""
    parts = [T.StructField("v", T.StringType()), T.StructField("month", T.StringType()), T.StructField("bucket", T.IntegerType())]
    schema = T.StructType([*state.schema.fields, *parts])
    paths = [f"{root.rstrip('/')}/{leaf}" for leaf in (state.leaves if leaves is None else leaves)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root.rstrip("/")).parquet(*paths)


def _bucket_of(leaf: str) -> int:
    return int(leaf.rsplit("bucket=", 1)[1])


def in_buckets(spark: SparkSession, root: str, state: State, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the buckets that the ``ids`` fall into; other leaves are not read."""
    # at most as many rows as there are buckets
    wanted = {r[0] for r in ids.select(bucket(F.col(key), state.buckets)).distinct().collect()}
    rows = read(spark, root, state, [leaf for leaf in state.leaves if _bucket_of(leaf) in wanted])
    return rows.where(F.col("bucket").isin(sorted(wanted))) if wanted else rows


def holding(spark: SparkSession, root: str, state: State, ids: DataFrame, key: str = "id") -> tuple[str, ...]:
    """The leaves that hold any of ``ids``."""
    found = (in_buckets(spark, root, state, ids, key).select(key, "v", "month", "bucket")
             .join(ids.select(key).distinct(), key, "left_semi").select("v", "month", "bucket").distinct())
    return tuple(f"v={r.v}/month={r.month}/bucket={r.bucket}" for r in found.toLocalIterator())  # some of the state's


def without(leaves: Iterable[str], gone: Iterable[str]) -> tuple[str, ...]:
    gone = set(gone)
    return tuple(leaf for leaf in leaves if leaf not in gone)


def crowded(state: State, most: int = MOST_LEAVES) -> tuple[str, ...]:
    """The leaves of months and buckets that have more than ``most`` of them."""
    place = lambda leaf: leaf.split("/", 1)[1]
    n = Counter(map(place, state.leaves))
    return tuple(leaf for leaf in state.leaves if n[place(leaf)] > most)


def change(spark: SparkSession, root: str, attempt: Callable[[State | None], State | None]) -> State | None:
    """Commit what ``attempt`` makes of the present state, anew if another writer
    comes first; None from it leaves the table as it is."""
    while True:
        before = current(spark, root)
        after = attempt(before)
        if after is None:
            return before
        try:
            return commit(spark, root, before, after)
        except Conflict:
            for folder in {leaf.split("/", 1)[0] for leaf in without(after.leaves, before.leaves if before else ())}:
                delete(spark, f"{root.rstrip('/')}/{folder}")


def compact(spark: SparkSession, root: str, sort: Iterable[Column] = (), most: int = MOST_LEAVES) -> None:
    """Merge the leaves of every month and bucket that has more than ``most``."""

    def attempt(state: State | None) -> State | None:
        many = crowded(state, most) if state else ()
        if not many:
            return None
        merged = write(read(spark, root, state, many).drop("v"), root, sort=sort)
        return replace(state, leaves=without(state.leaves, many) + merged)

    change(spark, root, attempt)


def publish(df: DataFrame, root: str) -> State:
    """Replace all rows of an unpartitioned table by ``df``."""
    return change(df.sparkSession, root, lambda _: State(schema=df.schema, leaves=write(df, root, by=())))


def published(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the last :func:`publish`; None before the first."""
    state = current(spark, root)
    if state is None:
        return None
    return spark.read.schema(state.schema).parquet(*[f"{root.rstrip('/')}/{leaf}" for leaf in state.leaves])
