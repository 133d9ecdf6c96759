"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a fixed pseudo-random order, are cut into blocks. Blocks
are scheduled one per slot: block k of a source of weight w is released at slot
``floor(k / w)`` and due by ``ceil((k + 1) / w)``; in every slot the released block
with the earliest deadline goes next. Weights are exact fractions that add up to 1:
then a released block is always there, every deadline is met, and after any number
of slots each source is less than one block away from its target share. Where a
source runs out of blocks, a new phase begins with the others, in the same
proportions to each other. No row is dropped or repeated.

The schedule is run on the driver, slot by slot, over blocks, not rows: blocks have
``BLOCK_ROWS`` rows, more if the table would have over ``MOST_BLOCKS`` of them, so
there are at most that many, plus one per source, at any size of the table. It
reaches the rows as a table of at most 32 bytes a block, which is broadcast.

Rows are written once with a number; its hash orders a source's rows and deals them
into buckets, so neither a NULL or repeated id nor equal rows gather in a task, and
a lost executor finds the same numbers again. A bucket has about ``BUCKET_ROWS`` rows,
more if the source would have over ``MOST_BUCKETS`` of them.

Nulls and ties: NULL is a source of its own. Equal deadlines go to the source that
sorts first. A source without a target weight gets one 1024th of the least target.
Targets are numbers above 0; a float counts as its decimal notation. Without targets
the weights follow the square root of the sources' sizes, to six places. Texts are not
looked at. Repeated rows are as many rows; an empty table gives an empty result.
Input columns called ``mix_position``, ``mix_slot``, ``mix_release`` and
``mix_deadline`` are replaced; all others are kept, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledger_spark.llm.common import free_name, written

BLOCK_ROWS = 16
MOST_BLOCKS = 1 << 20
BUCKET_ROWS = 1024
MOST_BUCKETS = 1 << 16
#: Blocks of a row of the broadcast table.
CHUNK = 1024
OUTPUT = ["mix_position", "mix_slot", "mix_release", "mix_deadline"]


def units_of(weights: Mapping[object, object]) -> dict[object, int]:
    """Weights as whole numbers in exactly the same proportions."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("target weights must be above 0")
    common = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    whole = {s: int(w * common) for s, w in exact.items()}
    shared = math.gcd(*whole.values()) or 1
    return {s: w // shared for s, w in whole.items()}


def schedule(units: Mapping[object, int], blocks: Mapping[object, int]) -> dict[object, np.ndarray]:
    """(slot, release, deadline) of each source's blocks, by earliest deadline first
    among released ones. Ties go by the order of ``blocks``."""
    out: dict[object, list[tuple[int, int, int]]] = {s: [] for s in blocks}
    left = {s: n for s, n in blocks.items() if n > 0}
    begin = 0
    while left:
        names, total = list(left), sum(units[s] for s in left)
        share = [units[s] for s in names]
        done = [0] * len(names)
        waiting = [(0, i) for i in range(len(names))]  # (release, source)
        ready: list[tuple[int, int, int]] = []         # (deadline, source, release)
        slot = 0
        while True:
            while waiting and waiting[0][0] <= slot:
                release, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(done[i] + 1) * total // share[i]), i, release))
            deadline, i, release = heapq.heappop(ready)
            out[names[i]].append((begin + slot, begin + release, begin + deadline))
            done[i] += 1
            slot += 1
            if done[i] == left[names[i]]:  # the phase ends with its last block
                break
            heapq.heappush(waiting, (done[i] * total // share[i], i))
        left = {s: n - d for (s, n), d in zip(left.items(), done) if n > d}
        begin += slot
    return {s: np.array(x, np.int64).reshape(-1, 3) for s, x in out.items()}


def _table(plan: Mapping[object, np.ndarray], rows: Mapping[object, int], block_rows: int) -> pa.Table:
    """(source, chunk, slots, releases, deadlines, starts): ``CHUNK`` blocks a row; a
    block starts where the blocks of the slots before it end."""
    slots = np.concatenate([x[:, 0] for x in plan.values()])
    sizes = np.concatenate([np.minimum(block_rows, rows[s] - np.arange(len(x)) * block_rows) for s, x in plan.items()])
    order = np.argsort(slots)
    starts = np.empty(len(slots), np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    sources, chunks, cuts, at = [], [], [0], 0
    for s, x in plan.items():
        for c in range(0, len(x), CHUNK):
            sources.append(s)
            chunks.append(c // CHUNK)
            cuts.append(at + min(c + CHUNK, len(x)))
        at += len(x)
    columns = [*np.concatenate(list(plan.values())).T, starts]
    lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.ascontiguousarray(x))) for x in columns]
    return pa.table([pa.array(sources), pa.array(chunks, pa.int64()), *lists],
                    ["source", "chunk", "slots", "releases", "deadlines", "starts"])


def mix(docs: DataFrame, targets: Mapping[object, object] | None = None, block_rows: int | None = None) -> DataFrame:
    """``docs`` with ``mix_position`` (from 0, without gaps), ``mix_slot`` (of the
    row's block), ``mix_release`` and ``mix_deadline`` (of the block, in slots).

    Needs ``source``.
    """
    spark = docs.sparkSession
    docs = docs.drop(*OUTPUT)
    names = [*docs.columns]
    own = {n: free_name(n, [*names, *OUTPUT]) for n in ("row", "order", "bucket", "before", "number", "rows", "buckets", "their",
                                                        "chunk", "slots", "releases", "deadlines", "starts", "at")}
    c = lambda n: F.col(own[n])
    numbered = written(docs.withColumn(own["row"], F.monotonically_increasing_id()), "mix-rows")
    found = numbered.groupBy("source").count().collect()  # a row per source
    rows = {r["source"]: r["count"] for r in sorted(found, key=lambda r: (r["source"] is None, r["source"]))}
    if not rows:
        return docs.select("*", *[F.lit(0).cast("long").alias(n) for n in OUTPUT])
    total = sum(rows.values())
    size = block_rows or max(BLOCK_ROWS, -(-total // MOST_BLOCKS))
    if targets is None:
        weights = {s: Fraction(math.isqrt(n * 10 ** 12), 10 ** 6) for s, n in rows.items()}
    else:
        given = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in targets.items()}
        least = min(given.values(), default=Fraction(1)) / 1024
        weights = {s: given.get(s, least) for s in rows}
    plan = schedule(units_of(weights), {s: -(-n // size) for s, n in rows.items()})
    kind = docs.schema["source"].dataType
    table = spark.createDataFrame(_table(plan, rows, size))
    table = table.select(F.col("source").cast(kind).alias(own["their"]), *[F.col(n).alias(own[n]) for n in table.columns[1:]])
    # at most 32 bytes a block, MOST_BLOCKS and one a source
    per_source = spark.createDataFrame(pa.table([pa.array(rows), pa.array([min(MOST_BUCKETS, -(-n // BUCKET_ROWS)) for n in rows.values()])],
                                                ["source", "buckets"]))
    per_source = per_source.select(F.col("source").cast(kind).alias(own["their"]), F.col("buckets").alias(own["buckets"]))
    same = F.col("source").eqNullSafe(F.col(own["their"]))
    dealt = (numbered.withColumn(own["order"], F.xxhash64(F.lit("mix"), c("row")))
             .join(F.broadcast(per_source), same).drop(own["their"])
             .withColumn(own["bucket"], F.pmod(F.shiftrightunsigned(own["order"], 8), c("buckets"))).drop(own["buckets"]))
    counts = written(dealt.groupBy("source", own["bucket"]).agg(F.count(F.lit(1)).alias(own["rows"])), "mix-sizes")
    # at most MOST_BUCKETS rows a source
    before = Window.partitionBy("source").orderBy(own["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias(own["their"]), c("bucket").alias(own["at"]),
                            F.coalesce(F.sum(own["rows"]).over(before), F.lit(0)).alias(own["before"]))
    inside = Window.partitionBy("source", own["bucket"]).orderBy(own["order"], own["row"])
    placed = (dealt.withColumn(own["number"], F.row_number().over(inside) - 1)
              .join(offsets, same & (c("bucket") == c("at"))).drop(own["their"], own["at"])
              .withColumn(own["number"], c("number") + c("before"))
              .withColumn(own["at"], F.floor(c("number") / size).cast("long"))
              .join(F.broadcast(table), same & (F.floor(c("at") / CHUNK).cast("long") == c("chunk"))))
    of = lambda n: F.get(c(n), (c("at") % CHUNK).cast("int"))
    return placed.select(*names, (of("starts") + c("number") % size).cast("long").alias("mix_position"),
                         of("slots").alias("mix_slot"), of("releases").alias("mix_release"), of("deadlines").alias("mix_deadline"))
