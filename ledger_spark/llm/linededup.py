"""Line de-duplication by pairwise alignment (patience diff).

The units are lines, cut further after about every sixth word, namely after each
word whose hash (of the last bytes before a blank) is the least of some
``UNIT_WINDOW`` consecutive ones. So no unit is longer than that, and a passage is
cut into the same units wherever it stands and however the lines around it break;
only its first and last unit may run into other text; a passage of 50 words always
holds ``BLOCK_WORDS`` words in whole units.

1. A *line* is a shortest run of units that holds ``BLOCK_WORDS`` words: from a unit
   on, or up to a unit. Every stretch of units with that many words is covered by its
   lines. Per document the lines' hashes are kept, in order, with their places.
2. A line is dropped if one document alone has it: what is left are the rare lines by
   which documents overlap. Of the documents that share a line the one with the
   smallest id is its owner and is never cut for it. Each later holder is linked to
   the owner: one link per line and place, never all pairs of the documents that
   share a line, however many they are.
3. A document is aligned with each of its owners by patience diff: every line's first
   place in the document that is still there against its first place in the owner;
   the longest chain of lines that increases on both sides is the alignment. Its
   lines' units are common blocks and are cut. As an alignment is increasing and one
   to one, it is repeated on what it leaves (lines no unit of which is cut), until
   no line is left: so passages in another order, and further copies, go as well.
4. The blocks of all owners are deleted from the document; all other text stays,
   character for character.

An alignment needs the places of shared lines only: neither texts nor hashes of whole
documents travel, and a document's links are as many as its lines, whatever the
number of its owners. They are grouped by document.

Nulls and ties: ids may have any type that can be ordered. A NULL, empty or blank text
has no units and stays. Rows that share a doc_id are versions of one document: not
compared with each other, each cut by its own alignment; the same holds for rows
without a doc_id, which come last. Repeated rows are cut alike. Lines that only one
document repeats stay. Very long texts are read whole; their links are one group, as
long as the text. An empty table gives an empty result. Columns of the input are
kept, whatever their names; the count of cut units takes a name that is free.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledger_spark.llm.common import free_name, may_contain, slices, written

#: Of so many consecutive words the one with the least hash ends a unit.
UNIT_WINDOW = 11
#: Words of a line; a line has at most as many units.
BLOCK_WORDS = 20
#: A line's place is its first unit and, in these many bits, its number of units.
SIZE_BITS = 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOOK_BACK = np.arange(-7, 1)
_LEAD = b"\n" * 8


def _sliding(pick: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``size`` consecutive values."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x, done = pick(x[:-step], x[step:]), done + step
    return x


def unit_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, words) of the units of a UTF-8 text."""
    text = np.frombuffer(_LEAD + raw + b"\n", np.uint8)
    blank = _BLANK[text]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begins, ends = edge[::2], edge[1::2]  # of words; the blanks around make them pairs
    if not len(begins):
        return begins, ends, begins
    tail = np.ascontiguousarray(text[ends[:, None] - 1 + _LOOK_BACK]).view("<u8")[:, 0]
    order = (tail * _FACTOR >> np.uint64(40)).astype(np.int32)
    stop = np.zeros(len(ends), bool)
    if len(ends) >= UNIT_WINDOW:  # the least of a window: its hash is the greatest minimum around it
        least = np.pad(_sliding(np.minimum, order, UNIT_WINDOW), UNIT_WINDOW - 1, constant_values=-1)
        stop = _sliding(np.maximum, least, UNIT_WINDOW) == order
    breaks = np.flatnonzero(text == 10)
    stop[:-1] |= breaks[np.searchsorted(breaks, ends[:-1])] < begins[1:]
    stop[-1] = True
    last = np.flatnonzero(stop)
    first = np.concatenate([[0], last[:-1] + 1])
    return begins[first] - len(_LEAD), ends[last] - len(_LEAD), last - first + 1


def units(text: str | None) -> tuple[list[str], list[int]]:
    """(pieces of a text, which joined are the text; their word counts)."""
    raw = (text or "").encode("utf-8")
    begin, _, words = unit_spans(raw)
    at = [0, *begin[1:].tolist(), len(raw)]
    return [raw[a:b].decode("utf-8") for a, b in zip(at, at[1:])] if len(words) else [], words.tolist()


def without(text: str, gone: set[int]) -> str:
    """The text without some of its units."""
    return "".join(p for i, p in enumerate(units(text)[0]) if i not in gone)


def unit_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, words) of each unit; white space around a unit does not count."""
    begin, end, words = unit_spans(raw)
    found = (xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist()))
    return np.fromiter(found, np.uint64, len(words)), words


def lines(hashes: np.ndarray, words: np.ndarray, least: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first unit, units, hash) of every line: the shortest runs of ``least`` words from
    a unit on, and those up to a unit that are not among them, in order."""
    before = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words, out=before[1:])
    end = np.searchsorted(before, before[:-1] + least)
    first = np.flatnonzero(end <= len(words))
    end = end[first]
    reached = np.zeros(len(words) + 1, bool)
    reached[end] = True
    more = np.flatnonzero((before >= least) & ~reached)  # ends that no shortest run from a unit on has
    first = np.concatenate([first, np.searchsorted(before, before[more] - least, side="right") - 1])
    end = np.concatenate([end, more])
    order = np.lexsort((end, first))
    first, end = first[order], end[order]
    # a run's hash is its polynomial in _FACTOR, by differences of prefix sums over its inverse
    power = np.cumprod(np.full(len(words), _FACTOR))
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(hashes * np.cumprod(np.full(len(words), _INVERSE)), out=prefix[1:])
    return first, end - first, power[end - 1] * (prefix[end] - prefix[first])


def _sequences(docs: DataFrame, block_words: int) -> DataFrame:
    """(id, version, lines, places) of each row that has a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for text in part.column(2).to_pylist():
                first, size, line = lines(*unit_hashes(text.encode("utf-8")), block_words)
                out[0].append(line.view(np.int64))
                out[1].append(first << SIZE_BITS | size)
            lists = [pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, x[1:]))], pa.int32()), pa.array(np.concatenate(x)))
                     for x in out]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["id", "version", "lines", "places"])

    rows = docs.filter("length(text) > 0").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, version long, lines array<long>, places array<long>")


def longest_increasing(values: np.ndarray) -> np.ndarray:
    """Places of a longest strictly increasing subsequence (patience sorting); of several
    the one that ends last, and so on backwards."""
    if (np.diff(values) > 0).all():
        return np.arange(len(values))
    tails: list[int] = []  # least last value of a chain, by length
    ends: list[int] = []   # its place
    before = np.full(len(values), -1)
    for p, v in enumerate(values.tolist()):
        at = bisect_left(tails, v)
        before[p] = ends[at - 1] if at else -1
        tails[at:at + 1] = [v]
        ends[at:at + 1] = [p]
    chain, p = [], ends[-1]
    while p >= 0:
        chain.append(p)
        p = before[p]
    return np.array(chain[::-1])


def aligned_blocks(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Units to cut: those of the aligned lines, alignment by alignment.

    ``mine`` are the places of the lines in the document, in order; ``theirs`` the
    first place of the same line in the owner.
    """
    first, size = mine >> SIZE_BITS, mine & ((1 << SIZE_BITS) - 1)
    base, last = int(first[0]), int((first + size).max())
    cut = np.zeros(last - base, bool)
    left = np.arange(len(mine))
    while len(left):
        here = left[np.sort(np.unique(theirs[left], return_index=True)[1])]
        chain = here[longest_increasing(theirs[here])]
        change = np.zeros(len(cut) + 1, np.int64)
        np.add.at(change, first[chain] - base, 1)
        np.add.at(change, first[chain] + size[chain] - base, -1)
        cut |= np.cumsum(change)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(cut)])
        left = left[before[first[left] + size[left] - base] == before[first[left] - base]]
    return np.flatnonzero(cut) + base


def _links(sequences: DataFrame) -> DataFrame:
    """(id, version, owner, mine, theirs): every line of a document that has an owner
    before it, with its place here and its first place there."""
    found = sequences.select("id", "version", F.explode(F.arrays_zip("lines", "places")).alias("l")).select(
        "id", "version", F.col("l.lines").alias("line"), F.col("l.places").alias("mine"))
    own = F.when(F.col("id").isNotNull(), F.struct("id", F.col("mine").alias("place")))
    shared = (found.groupBy("line").agg(F.min(own).alias("own"), F.max("id").alias("last"),
                                        F.max(F.col("id").isNull()).alias("nameless"))
              .filter("own.id < last OR own IS NOT NULL AND nameless")
              .select("line", F.col("own.id").alias("owner"), F.col("own.place").alias("theirs")))
    shared = written(shared, "lines-shared")
    return found.join(shared, "line").filter("owner < id OR id IS NULL").select("id", "version", "owner", "mine", "theirs")


def _links_by_number(sequences: DataFrame, bits: int) -> DataFrame:
    """:func:`_links` for whole ids, each of one row, that leave ``bits`` of a long free:
    id and place travel as one number, which orders by id, then place."""
    found = (sequences.select(F.col("id").cast("long").alias("id"), F.explode(F.arrays_zip("lines", "places")).alias("l"))
             .select(F.col("l.lines").alias("line"), F.shiftleft("id", bits).bitwiseOR(F.col("l.places")).alias("own")))
    shared = (found.groupBy("line").agg(F.min("own").alias("first"), F.max("own").alias("last"))
              .filter(F.shiftright("first", bits) < F.shiftright("last", bits)).select("line", "first"))
    id_of, place_of = (lambda c: F.shiftright(c, bits)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1)))
    return (found.join(written(shared, "lines-shared"), "line").filter(id_of("own") > id_of("first"))
            .select(id_of("own").alias("id"), F.lit(0).cast("long").alias("version"), id_of("first").alias("owner"),
                    place_of("own").alias("mine"), place_of("first").alias("theirs")))


def _cuts(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, bool]:
    """(id, version, cut): the unit positions to delete; and whether versions tell rows apart."""
    if block_words >= 1 << SIZE_BITS:
        raise ValueError(f"a line of {block_words} words may have too many units for its place")
    sequences = written(_sequences(docs, block_words), "lines-sequences")
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    size = sequences.agg(F.max(F.try_element_at("places", F.lit(-1))).alias("place"), F.min("id").alias("least"),
                         F.max("id").alias("most"), F.count_if(F.col("id").isNull()).alias("nameless")).first()
    bits = int(size.place or 1).bit_length()
    versions = not sequences.groupBy("id").count().filter("count > 1").isEmpty()
    if whole and not versions and not size.nameless and max(abs(size.least or 0), abs(size.most or 0)) < 1 << 62 - bits:
        links = _links_by_number(sequences, bits)
    else:
        if versions:
            sequences = written(sequences.dropDuplicates(["id", "version"]), "lines-distinct")
        versions, links = True, _links(sequences)
    # one document's links: as many as its lines
    grouped = links.groupBy("id", "version").agg(F.array_sort(F.collect_list(F.struct("owner", "mine", "theirs"))).alias("links"))
    grouped = grouped.select("id", "version", F.transform("links", lambda x: x["owner"]).alias("owner"),
                             F.transform("links", lambda x: x["mine"]).alias("mine"),
                             F.transform("links", lambda x: x["theirs"]).alias("theirs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            owner = part.column(2).values.dictionary_encode().indices.to_numpy()
            mine, theirs = (part.column(c).values.to_numpy() for c in (3, 4))
            at, cuts = part.column(2).offsets.to_numpy(), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                edges = [a, *(np.flatnonzero(np.diff(owner[a:b])) + a + 1).tolist(), b]
                cut = [aligned_blocks(mine[x:y], theirs[x:y]) for x, y in zip(edges, edges[1:])]
                cuts.append(cut[0] if len(cut) == 1 else np.unique(np.concatenate(cut)))
            lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, cuts))], pa.int32()),
                                             pa.array(np.concatenate(cuts or [np.zeros(0)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "version", "cut"])

    kind = grouped.schema["id"].dataType.simpleString()
    return written(grouped.mapInArrow(run, f"id {kind}, version long, cut array<int>"), "lines-cuts"), versions


def deduplicate(docs: DataFrame, block_words: int = BLOCK_WORDS, count: str | None = None) -> DataFrame:
    """``docs`` with the repeated blocks deleted from ``text``, and a last column: how
    many units of the row were deleted, named ``count`` or by a free name (``cut``)."""
    names = [*docs.columns]
    count = count or free_name("cut", names)
    own, version, gone = (free_name(n, [*names, count]) for n in ("cut_id", "cut_version", "cut_units"))
    cuts, versions = _cuts(docs.select("doc_id", "text"), block_words)
    cuts = cuts.select(F.col("id").alias(own), F.col("version").alias(version), F.col("cut").alias(gone))
    key = F.col("doc_id")
    here = key.eqNullSafe(F.col(own)) & (F.length("text") > 0)
    if versions:
        here = here & (F.xxhash64("text") == F.col(version))
    # rows of documents without a cut pass without a shuffle
    may = may_contain(cuts, own, key)
    joined = docs.filter(may).join(cuts, here, "left").select(*names, gone)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            positions, counts = part.column(len(names)), np.zeros(part.num_rows, np.int32)
            columns = list(part.columns[:-1])
            cut_rows = [r for r in range(part.num_rows) if positions[r].is_valid]
            if cut_rows:
                texts = columns[at].to_pylist()
                for r in cut_rows:
                    cut = set(positions[r].as_py())
                    texts[r] = without(texts[r], cut)
                    counts[r] = len(cut)
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], [*names, count])

    done = joined.mapInArrow(run, StructType([*docs.schema.fields, StructField(count, IntegerType())]))
    return docs.filter(~may).withColumn(count, F.lit(0)).union(done)


def drop_repeats(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` after de-duplication, with its columns. A row that was cut to
    nothing but white space has become a repeat as a whole and goes."""
    count = free_name("cut", docs.columns)
    done = deduplicate(docs, block_words, count)
    return done.filter((F.col(count) == 0) | (F.trim("text", F.lit(" \t\r\n")) != "")).select(*docs.columns)
