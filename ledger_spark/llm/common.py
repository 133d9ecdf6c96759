"""Helpers shared by the training-data operators.

Intermediate results that several later jobs read are written once, as Parquet,
to a new folder below ``spark.checkpoint.dir`` (:func:`written`): lineage is
cut, and a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledger_spark.session import scratch_dir

#: Rows of a batch that a Python worker turns into Python strings at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key's text modulo ``modulus``; NULL for a NULL key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """True where the fold is ``remainder``. A NULL key is not held out."""
    return F.coalesce(fold(key, modulus) == remainder, F.lit(False))


def may_learn(key: Column, modulus: int, remainder: int) -> Column:
    """True where labels may be learned from: the key is known and not held out."""
    return F.coalesce(fold(key, modulus) != remainder, F.lit(False))


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores before it as no column of ``taken`` has (in any case)."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the file."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest_by_hash(df: DataFrame, key: str, n: int, total: int | None = None) -> DataFrame:
    """At most ``n`` rows, those with the smallest key hash: a repeatable sample
    of a size that does not grow with the data.

    Told how many rows there are, rows far above the cut are dropped before the
    sort, so that not every task hands on ``n`` candidates.
    """
    order = F.xxhash64(F.col(key))
    if total is not None and total > 4 * n:
        df = df.filter(order < int(-(1 << 63) + (1 << 64) * 2 * n / total))
    return df.orderBy(order, F.col(key)).limit(n)


#: Bits of :func:`may_contain`'s filter: 4 MB, whatever the number of keys.
FILTER_BITS = 1 << 25


def may_contain(keys: DataFrame, key: str, probe: Column) -> Column:
    """False where ``probe`` is surely none of ``keys``; true for every key and,
    by chance, for some other values (a Bloom filter with one hash).

    It separates the rows that a decision may concern from those that can pass
    without being shuffled; what it lets through still needs the exact join. Its
    size is fixed, so it may be broadcast; the more keys, the less it separates.
    """
    spark = keys.sparkSession
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    found = (keys.select(place(F.col(key)).alias("at"))
             .groupBy(F.shiftright("at", 5).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 31 AS INT))")).alias("bits")).toArrow())
    table = np.zeros(FILTER_BITS >> 5, np.int64)  # at most as many rows
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(table.astype(np.uint32))

    @F.pandas_udf("boolean")
    def test(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    return test(place(probe))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
