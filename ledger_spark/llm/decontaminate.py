"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are normalised (lower case, runs of anything but
letters and digits become one blank). A region of a text within ``e`` edits of an
item of ``m`` characters shares at least ``m - q + 1 - q * e`` of its q-grams, and
all of them lie on at most ``e + 1`` neighbouring diagonals (text position minus
item position). So the filter

1. finds the text's q-grams that the benchmark has,
2. counts, per item, the distinct item positions that are shared within bands of
   diagonals; the bands overlap by half, and are wide enough that every such
   region falls into one of them whole,
3. keeps the bands that reach the lemma's count, and
4. verifies them by banded alignment (semi-global edit distance of the whole item
   within the band), which decides.

``EDIT_RATE`` sets the edit budget ``e = floor(EDIT_RATE * m)``. Every text is read
whole, in pieces that overlap by more than the longest region. The benchmark goes
to the workers in chunks of at most about ``CHUNK_CHARS`` characters (a proven
bound for each broadcast); more chunks mean more passes.

Nulls and ties: a NULL or empty text holds nothing. An item that is NULL, or has
fewer than ``Q`` normalised characters, has no q-gram and is never found. Items
are found independently of each other; of several regions of one item in one text
the one with the fewest edits counts, of equal ones the first. Repeated rows (of
documents or benchmark) are reported once each. Empty tables give an empty result;
without items every document stays. :func:`matches` ignores extra columns,
:func:`drop_contaminated` keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledger_spark.llm.common import slices, table

Q = 8
EDIT_RATE = 0.08
CHUNK_CHARS = 4_000_000
#: Characters that are scanned together (several short texts, or a piece of a long one).
PIECE = 1 << 18
_FACTOR = 0x9E3779B97F4A7C15
_FILTER_BITS = 22
#: Cells, less one, in which shared q-grams are first counted.
_CELLS = (1 << 20) - 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code point, is a letter or digit) by code point."""
    lower = np.arange(0x110000, dtype=np.uint32)
    word = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            word[c] = x.isalnum()
            if x != (y := x.lower()) and len(y) == 1:
                lower[c] = ord(y)
    return lower, word


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(normalised code points, their positions in the text)."""
    lower, word = _tables()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    is_word = word[codes]
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]  # the first character after a word stands for the blank
    at = np.flatnonzero(keep)
    codes = np.where(is_word, lower[codes], 32)[at].astype(np.uint32)
    if len(codes) and codes[-1] == 32:
        codes, at = codes[:-1], at[:-1]
    return codes, at


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the q-gram that starts at each position (Q is a power of two)."""
    h, width, factor = codes.astype(np.uint64) + np.uint64(1), 1, _FACTOR
    while width < Q:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    return h ^ (h >> np.uint64(29))


def budget(length: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed to an item: the rate, as far as the lemma still asks for a shared q-gram."""
    return max(0, min(int(rate * length), (length - Q) // Q))


class Index:
    """The q-grams of a chunk of the benchmark."""

    def __init__(self, items: list[tuple[object, str]], rate: float = EDIT_RATE):
        kept = [(i, c) for i, t in items if len(c := normalise(t)[0]) >= Q]
        self.ids = [i for i, _ in kept]
        self.codes = [c for _, c in kept]
        size = np.array([len(c) for c in self.codes], np.int64)
        self.size = size
        self.edits = np.array([budget(n, rate) for n in size], np.int64)
        self.least = size - Q + 1 - Q * self.edits
        self.band = np.maximum(self.edits, 1)
        self.reach = int((size + 2 * self.edits).max()) + Q if len(kept) else 0
        every = [grams(c) for c in self.codes]
        h = np.concatenate(every) if every else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(kept)), [len(x) for x in every])
        at = np.concatenate([np.arange(len(x)) for x in every]) if every else item
        order = np.argsort(h, kind="stable")
        self.item, self.at = item[order], at[order]
        self.hash, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.hash >> np.uint64(64 - _FILTER_BITS)] = True

    def bands(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest, highest diagonal) of the bands that pass the lemma."""
        if len(codes) < Q or not len(self.hash):
            return []
        h = grams(codes)
        pos = np.flatnonzero(self.bits[h >> np.uint64(64 - _FILTER_BITS)])
        slot = np.minimum(np.searchsorted(self.hash, h[pos]), len(self.hash) - 1)
        hit = self.hash[slot] == h[pos]
        pos, slot = pos[hit], slot[hit]
        if not len(pos):
            return []
        many = self.last[slot] - self.first[slot]
        row = np.repeat(np.arange(len(pos)), many)
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + self.first[slot][row]
        item, at = self.item[entry], self.at[entry]
        diagonal = pos[row] - at + int(self.size.max())  # never negative
        width = self.band[item]
        step = diagonal // width
        # most grams are shared by chance: drop those whose bands cannot reach the
        # count even if every gram counted and bands that share a cell were one
        cell = (item * 0x9E3779B1 + step) & _CELLS
        held = np.bincount(cell, minlength=_CELLS + 1)
        beside = np.maximum(held[(cell + 1) & _CELLS], held[(cell - 1) & _CELLS])
        able = held[cell] + beside >= self.least[item]
        item, at, step = item[able], at[able], step[able]
        found = []
        for shift in (0, 1):  # bands [s, s + 2) * width: all even s, then all odd s
            s = (step + shift) // 2
            rows = np.lexsort((at, s, item))
            i, b, a = item[rows], s[rows], at[rows]
            new = np.ones(len(rows), bool)
            new[1:] = (i[1:] != i[:-1]) | (b[1:] != b[:-1])
            fresh = new.copy()
            fresh[1:] |= a[1:] != a[:-1]
            group = np.cumsum(new) - 1
            count = np.bincount(group, weights=fresh)
            for g in np.flatnonzero(count >= self.least[i[new]]).tolist():
                k, w = int(i[new][g]), int(self.band[i[new][g]])
                low = (2 * int(b[new][g]) - shift) * w - int(self.size.max())
                found.append((k, low, low + 2 * w - 1))
        merged: list[tuple[int, int, int]] = []
        for k, low, high in sorted(found):
            if merged and merged[-1][0] == k and low <= merged[-1][2] + 1:
                merged[-1] = (k, merged[-1][1], max(high, merged[-1][2]))
            else:
                merged.append((k, low, high))
        return merged

    def verify(self, codes: np.ndarray, item: int, low: int, high: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best alignment of the item inside the band
        (widened by the budget), or None beyond the budget."""
        e, n = int(self.edits[item]), int(self.size[item])
        first = max(0, low - e)
        same = codes[first:max(0, high + e) + n].tobytes().find(self.codes[item].tobytes())
        if same >= 0 and same % 4 == 0:  # nothing aligns better than a verbatim copy
            return 0, first + same // 4, first + same // 4 + n
        return banded(self.codes[item], codes, low - e, high + e, e)


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn ``item`` into a substring of ``text`` whose alignment
    stays on the diagonals ``low..high``: (edits, start, end), None above ``most``.

    Cell k of row i stands for text position i + low + k.
    """
    width, n = high - low + 1, len(text)
    k = np.arange(width)
    far = len(item) + width + n + 1
    at = low + k
    cost = np.where((at >= 0) & (at <= n), 0, far)
    start = np.clip(at, 0, n)
    for i in range(1, len(item) + 1):
        at = i + low + k  # text characters consumed
        ok = (at >= 0) & (at <= n)
        prior = np.clip(at - 1, 0, max(0, n - 1))
        same = (at >= 1) & ok & (text[prior] == item[i - 1]) if n else np.zeros(width, bool)
        step = np.where(at >= 1, cost + ~same, far)            # take a text character
        skip = np.append(cost[1:], far) + 1                    # the item's character is missing
        new = np.where(skip < step, skip, step)
        origin = np.where(skip < step, np.append(start[1:], 0), start)
        new = np.where(ok, new, far)
        run = new - k                                          # surplus text characters to the right
        best = np.minimum.accumulate(run)
        lead = np.maximum.accumulate(np.where(run == best, k, 0))
        cost = np.where(ok, best + k, far)
        start = origin[lead]
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    if cost[end] > most:
        return None
    return int(cost[end]), int(start[end]), len(item) + low + end


class Hit:
    """Best region of each item over the pieces of one text."""

    def __init__(self):
        self.best: dict[int, tuple[int, int, int]] = {}

    def add(self, item: int, found: tuple[int, int, int]) -> None:
        if item not in self.best or found[:2] < self.best[item][:2]:
            self.best[item] = found


def search(texts: list[str | None], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """Per text: (item, start, end, edits) in positions of the raw text."""
    hits = [Hit() for _ in texts]
    queue: list[tuple[int, np.ndarray, np.ndarray]] = []
    waiting = 0

    def scan() -> None:
        nonlocal queue, waiting
        # texts are scanned together; 0 stands between them and is in no item
        gap = np.zeros(Q, np.uint32)
        joined = np.concatenate([x for _, codes, _ in queue for x in (codes, gap)])
        starts = np.cumsum([0] + [len(codes) + Q for _, codes, _ in queue])
        for item, low, high in index.bands(joined):
            first = int(np.searchsorted(starts, max(0, low), side="right")) - 1
            last = int(np.searchsorted(starts, min(high + int(index.size[item]), len(joined) - 1), side="right")) - 1
            for j in range(first, min(last, len(queue) - 1) + 1):
                t, codes, at = queue[j]
                found = index.verify(codes, item, low - int(starts[j]), high - int(starts[j]))
                if found and found[2] > found[1]:
                    hits[t].add(item, (found[0], int(at[found[1]]), int(at[found[2] - 1]) + 1))
        queue, waiting = [], 0

    for t, text in enumerate(texts):
        if not text:
            continue
        codes, at = normalise(text)
        step = max(PIECE, 2 * index.reach)
        for begin in range(0, max(1, len(codes)), step):
            piece = slice(begin, begin + step + index.reach)
            queue.append((t, codes[piece], at[piece]))
            waiting += len(codes[piece])
            if waiting >= PIECE:
                scan()
    if queue:
        scan()
    return [[(i, s, e, c) for i, (c, s, e) in sorted(h.best.items())] for h in hits]


def chunks(benchmark: DataFrame, rate: float = EDIT_RATE, chunk_chars: int = CHUNK_CHARS) -> Iterator[Index]:
    """The benchmark as indexes of bounded size, one at a time."""
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(total / chunk_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for p in range(parts):
        rows = (items if parts == 1 else items.filter(part == p)).collect()  # about chunk_chars characters
        index = Index([(r.item_id, r.text) for r in rows], rate)
        if index.ids:
            yield index


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, start, end, edits) for every item found in a text of ``docs``."""
    spark, rows = docs.sparkSession, docs.select("doc_id", "text")
    doc, item = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = benchmark.select("item_id").schema
    names = ["doc_id", "item_id", "start", "end", "edits"]
    kind = f"doc_id {doc}, item_id {item}, start long, end long, edits int"
    found = None
    for index in chunks(benchmark, rate):
        shared = spark.sparkContext.broadcast(index)
        ids = pa.array(index.ids)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, ids=ids) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 128):
                got = [(r, *hit) for r, hits in enumerate(search(part.column(1).to_pylist(), shared.value)) for hit in hits]
                cols = list(zip(*got)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0], pa.int64())), ids.take(pa.array(cols[1], pa.int64())),
                     pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32())], names)

        one = rows.mapInArrow(run, kind)
        found = one if found is None else found.union(one)
    if found is None:
        return rows.filter(F.lit(False)).select("doc_id", F.lit(None).cast(item_type[0].dataType).alias("item_id"),
                                                F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"),
                                                F.lit(0).alias("edits"))
    return found


def drop_contaminated(docs: DataFrame, sf_dir: str, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    at, schema = docs.columns.index("text"), docs.schema
    for index in chunks(table(docs.sparkSession, sf_dir, "benchmark"), rate):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 128):
                clean = [not hits for hits in search(part.column(at).to_pylist(), shared.value)]
                yield part.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
