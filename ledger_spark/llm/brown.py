"""Language-model scoring with Brown classes.

Tokens are the words of a text (A-Z lower-cased, ASCII white space between) and
one end mark. The model is a class bigram:

    P(w | previous) = P(class(w) | class(previous)) * P(w | class(w))

* The ``CLUSTERED`` most frequent words are dealt into ``CLASSES`` classes by the
  exchange algorithm: each word moves to the class that raises the corpus
  likelihood of class transitions most, until none moves (``ROUNDS`` at most).
  Its input, the word-bigram table over these words, is counted over the whole
  training corpus and has at most ``(CLUSTERED + 13)**2`` cells. These words seed
  the classes. Twelve more classes start from the spelling of the other words
  (letters only, letters with closing punctuation, other; by length).
* Every other training word, however rare, then moves to the class of greatest gain:
  the classes before and after it are counted over the whole training corpus, grouped
  by word, and the gain of the same likelihood is taken to first order in these
  counts (:func:`gains`), against the seeds' classes and the others' spelling. Ties go
  to the class of the lower number.
* Class transitions are then counted over the whole training corpus and Witten-Bell
  smoothed with the class unigram, which is smoothed by adding one.
* Emissions are relative frequencies within a class. Words beyond the seeds leave
  Witten-Bell's share of their spelling (types of tokens and types) to words never
  seen, and each class has one token more for each spelling. All classes together
  emit a word never seen; after it, classes follow as after the words of its spelling.

The base score is the add-one unigram model of the same counts.

Nulls and ties: a NULL text is an empty text (its one token is the end mark). A
NULL doc_id is not held out and does not train. Repeated rows are counted, and
scored, once each. Equal word counts rank by the word. Without training rows N
and V are 0 and every class is equally likely. Texts are read whole, however long. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledger_spark.llm.common import held_out, may_learn, slices, written

HEAD = 100_000
CLUSTERED = 1000
CLASSES = 48
ROUNDS = 12
#: Distinct words that a worker counts before it hands them on.
FLUSH = 200_000
#: Pairs that a worker holds before it adds them to its table.
HELD = 2_000_000
#: Added to each class transition where a gain takes its logarithm.
SOFT = 0.5
#: Gains are whole multiples of this, so that their sums are exact in any order.
GRAIN = 2.0 ** -16
OPEN_LENGTHS = (4, 8, 12)
OPEN = 3 * (len(OPEN_LENGTHS) + 1)
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words as UTF-8; ``bytes`` methods touch ASCII only."""
    return (text or "").encode("utf-8").lower().split()


def open_class(word: bytes) -> int:
    """Spelling class of a word: kind (letters, letters and a mark, other) by length."""
    text = word.decode("utf-8")
    kind = 0 if text.isalpha() else 1 if text[:-1].isalpha() else 2
    return kind * (len(OPEN_LENGTHS) + 1) + sum(len(text) > n for n in OPEN_LENGTHS)


def _counts_out(counts: Counter) -> pa.RecordBatch:
    words = list(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array(words, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in words], pa.int64()),
         pa.array([open_class(w) if w else -1 for w in words], pa.int32())], ["word", "n", "open"])


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n, open) over all rows of ``texts(text)``; the end mark is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                counts.update(tokens(text))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield _counts_out(counts)
                    counts = Counter()
        if counts:
            yield _counts_out(counts)

    return (texts.mapInArrow(run, "word string, n long, open int")
            .groupBy("word", "open").agg(F.sum("n").alias("n")))


class Numbers(dict):
    """Numbers of known words; any other word gets ``first`` plus its open class.
    Some of those are remembered, as long as there are fewer than ``FLUSH``."""

    def __init__(self, known: dict[bytes, int], first: int):
        super().__init__(known)
        self.known, self.first = known, first

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.known) + FLUSH:
            self.clear()
            self.update(self.known)
        number = self[word] = self.first + open_class(word)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Lexicon:
    """The head: words numbered from 1, of which the first ``seeds`` are clustered by
    exchange, with counts and spelling; 0 is the end mark. Any other word has the
    number ``first`` plus its spelling class."""

    def __init__(self, words: list[tuple[bytes, int]], seeds: int, ends: int):
        self.words, self.seeds, self.first = [w for w, _ in words], seeds, 1 + len(words)
        self.count = np.array([ends, *(n for _, n in words)], float)
        self.open = np.array([-1, *map(open_class, self.words), *range(OPEN)], np.int64)

    def classes(self, seeds: np.ndarray, after: int) -> np.ndarray:
        """By number: ``seeds`` for the end mark and the seeds, ``after`` plus the spelling for others."""
        return np.concatenate([seeds, after + self.open[1 + self.seeds:]])


def packed(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers of texts (of text i, those between ``ends`` i and i + 1) as bytes, seven bits
    in each, the lowest first, and a top bit where more follow. Words of low number are
    frequent: most numbers take one byte, where an int takes four in a shuffle."""
    size = 1 + sum((numbers >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for i in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > i)
        out[at[has] + i] = numbers[has] >> 7 * i & 127 | (size[has] > i + 1) << 7
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(out)])


def unpacked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many are of each text) of :func:`packed` texts."""
    data, ends = _bytes(texts)
    last = data < 128
    stops = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], stops[:-1]])[:len(stops)]
    size, low = stops - starts, data & 127
    numbers = low[starts].astype(np.int64)
    for i in range(1, int(size.max(initial=0))):
        has = np.flatnonzero(size > i)
        numbers[has] |= low[starts[has] + i].astype(np.int64) << 7 * i
    return numbers, np.diff(np.concatenate([[0], np.cumsum(last)])[ends])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, ends: value i lies between the i-th and the next) of a binary column without nulls."""
    column = column.cast(pa.binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def coded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs(text, ...)`` with a number ``row``, the :func:`packed` numbers ``ids`` of the
    text's words, and ``rest``, those words, in order, that the head lacks."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.first))
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, first = shared.value
        numbers = Numbers({w: i + 1 for i, w in enumerate(head)}, first)
        for part in slices(batches):
            ids, ends, rest, rest_ends = [], [0], [], [0]
            for text in part.column(0).to_pylist():
                words = tokens(text)
                ids.append(numbers.of(words))
                ends.append(ends[-1] + len(words))
                rest += [words[i] for i in np.flatnonzero(ids[-1] >= first).tolist()]
                rest_ends.append(len(rest))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], packed(np.concatenate(ids), np.array(ends)),
                 pa.ListArray.from_arrays(pa.array(rest_ends, pa.int32()), pa.array(rest, pa.binary()).cast(pa.string()))],
                [*(f.name for f in kept), "row", "ids", "rest"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)
    return written(docs.select("text", *(f.name for f in kept), F.monotonically_increasing_id().alias("row"))
                   .mapInArrow(run, kinds + "row long, ids binary, rest array<string>"), "brown-coded")


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _neighbours(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, own) of each token of texts of these ``sizes``, the end marks (0) among them."""
    ends = np.cumsum(sizes)
    return np.insert(flat, ends - sizes, 0), np.insert(flat, ends, 0)


class Counts:
    """A table of counts, added to in blocks of at least ``HELD`` places."""

    def __init__(self, cells: int):
        self.table, self.held, self.waiting = np.zeros(cells, np.int64), [], 0

    def add(self, places: np.ndarray) -> None:
        self.held.append(places)
        self.waiting += len(places)
        if self.waiting >= HELD:
            self.close()

    def close(self) -> np.ndarray:
        if self.held:
            self.table += np.bincount(np.concatenate(self.held), minlength=len(self.table))
            self.held, self.waiting = [], 0
        return self.table


def transition_table(rows: DataFrame, classes: np.ndarray, first: int, k: int) -> np.ndarray:
    """Counts of (class, next class) over ``rows(ids)``, which may be :func:`placed`, the
    end mark (0) before and after each; ``classes`` by number."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)
    columns = [c for c in rows.columns if c in ("ids", *PLACED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(k * k)
        for part in slices(batches):
            _, sizes, cls, _, _ = _words(part, shared.value, first)
            before, own = _neighbours(cls, sizes)
            counts.add(before * k + own)
        table = counts.close()
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["pair", "n"])

    found = (rows.select(*columns).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
             .toArrow())  # at most k ** 2 rows
    table = np.zeros(k * k, np.int64)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(k, k)


def _words(part: pa.RecordBatch, classes: np.ndarray, first: int):
    """(numbers, sizes of texts, classes, places of words that are known but not in the
    head, their counts) of a batch with ``ids`` and, once placed, ``slots``, ``cls`` and ``counts``."""
    ids, sizes = unpacked(part.column(part.schema.get_field_index("ids")))
    cls = classes[ids]
    if "slots" not in part.schema.names:
        return ids, sizes, cls, np.zeros(0, np.int64), np.zeros(0, np.int64)
    rest = np.flatnonzero(ids >= first)
    before = np.searchsorted(rest, np.cumsum(sizes) - sizes)  # words of `rest` in earlier texts
    slots, c, n = (part.column(part.schema.get_field_index(name)) for name in PLACED)
    before = np.repeat(before, _sizes(slots))
    slots, c, n = (x.flatten().to_numpy(zero_copy_only=False) for x in (slots, c, n))
    places = rest[before + slots]
    cls[places] = c
    return ids, sizes, cls, places, n


def contexts(rows: DataFrame, lexicon: Lexicon, classes: np.ndarray, k: int) -> DataFrame:
    """(word, id, near) of the words beyond the seeds in ``rows(ids, rest)``: ``near`` holds
    numbers c + 2kn for n times class c before the word (c below k) or after it (k more),
    four bytes each. ``id`` is the word's number. A word has several rows."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicon, classes))
    width = 2 * k

    def out(words, ids, near, ends) -> pa.RecordBatch:
        near = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((4 * ends).astype(np.int32)),
                                                               pa.py_buffer(near.astype(np.int32))])
        return pa.RecordBatch.from_arrays([words, pa.array(ids, pa.int32()), near], ["word", "id", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, cls = shared.value
        start = 1 + lex.seeds
        counts = Counts((lex.first - start) * width)
        for part in slices(batches):
            ids, sizes, mine, _, _ = _words(part.select(["ids"]), cls, lex.first)
            before, _ = _neighbours(mine, sizes)
            _, own = _neighbours(ids, sizes)
            after = np.append(cls[own[1:]], 0)
            head = np.flatnonzero((own >= start) & (own < lex.first))
            counts.add(np.concatenate([(own[head] - start) * width + before[head], (own[head] - start) * width + k + after[head]]))
            rest = np.flatnonzero(own >= lex.first)
            near = np.stack([before[rest] + width, after[rest] + k + width], axis=1).ravel()
            yield out(part.column(part.schema.get_field_index("rest")).flatten(), own[rest], near,
                      2 * np.arange(len(rest) + 1))
        table = counts.close().reshape(-1, width)
        at = 0
        while at < len(table):
            block = np.minimum(table[at:at + 4096], (1 << 31) // width - 1)  # what one number holds
            word, c = np.nonzero(block)
            if not len(word):
                at += 4096
                continue
            table[at:at + 4096] -= block
            have, sizes = np.unique(word, return_counts=True)
            ids = start + at + have
            yield out(pa.array([lex.words[i - 1] for i in ids], pa.binary()).cast(pa.string()), ids,
                      block[word, c] * width + c, np.concatenate([[0], np.cumsum(sizes)]))

    return rows.select("ids", "rest").mapInArrow(run, "word string, id int, near binary")


def gains(table: np.ndarray) -> np.ndarray:
    """What a word gains in classes 1.. (columns) for each class before it, then for each
    class after it (rows): the derivative of :func:`likelihood`'s class transitions by
    their counts, without the parts that are the same for every class."""
    n = table + SOFT
    before = np.log(n) - np.log(n.sum(axis=0))
    after = np.log(n.T) - np.log(n.sum(axis=1))
    return np.round(np.concatenate([before, after])[:, 1:] / GRAIN)


def assigned(rows: DataFrame, lexicon: Lexicon, classes: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, id, n, open, cls) of every word beyond the seeds in ``rows(ids, rest)``: its
    number in the head (or -1), count, spelling and class of greatest gain."""
    k = len(table)
    width, gain, first, spelling = 2 * k, gains(table), lexicon.first, lexicon.open

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(words, ids, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [words, pa.array(np.where(ids < first, ids, -1), pa.int32()),
                 pa.array(counts[:, :k].sum(axis=1).astype(np.int64)), pa.array(spelling[ids], pa.int32()),
                 pa.array(1 + np.argmax(counts @ gain, axis=1), pa.int32())], ["word", "id", "n", "open", "cls"])

        last = None  # the last word of a batch may go on in the next one
        for part in slices(batches, 8192):
            words = part.column(0)
            new = np.flatnonzero(np.append(True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)))
            near, ends = _bytes(part.column(2))
            group = np.repeat(np.searchsorted(new, np.arange(len(words)), "right") - 1, np.diff(ends) // 4)
            near = np.frombuffer(near.tobytes(), np.int32)
            counts = np.bincount(group * width + near % width, near // width, len(new) * width).reshape(-1, width)
            firsts = words.take(pa.array(new)), part.column(1).to_numpy()[new]
            if last is not None:
                if last[0][0].as_py() == firsts[0][0].as_py():
                    counts[0] += last[2][0]
                else:
                    yield out(*last)
            yield out(*(x[:-1] for x in firsts), counts[:-1])
            last = (*(x[-1:] for x in firsts), counts[-1:])
        if last is not None:
            yield out(*last)

    near = contexts(rows, lexicon, classes, k).repartition("word").sortWithinPartitions("word")
    return written(near.mapInArrow(run, "word string, id int, n long, open int, cls int"), "brown-classes")


#: The columns that :func:`placed` adds, lists in the same order.
PLACED = ("slots", "cls", "counts")


def placed(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """:func:`coded` rows with ``slots``, ``cls`` and ``counts`` instead of ``rest``: the place
    in ``rest``, the class and the count of each word that the vocabulary holds."""
    rest = rows.select("row", F.posexplode("rest").alias("slot", "word"))
    beyond = vocab.filter("id < 0").select("word", "cls", F.col("n").alias("count"))
    # shuffled before anything is gathered: a task holds few words of a row, and lists of few
    # numbers are wider than the numbers; three lists take less than half the room of one of structs
    known = rest.join(beyond, "word").select("row", "slot", "cls", "count").repartition("row").groupBy("row").agg(
        *[F.collect_list(one).alias(name) for one, name in zip(("slot", "cls", "count"), PLACED)])
    return written(rows.drop("rest").join(known, "row", "left").drop("row"), "brown-rows")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray, classes: np.ndarray, k: int) -> float:
    """Class-transition part of the corpus log likelihood."""
    n = _class_table(table, classes, k)
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=1)).sum() - _xlogx(n.sum(axis=0)).sum())


def _class_table(table: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    hot = np.zeros((len(classes), k))
    hot[np.arange(len(classes)), classes] = 1
    return hot.T @ table @ hot


def exchange(table: np.ndarray, words: int, k: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each type. Types 1..words are clustered into classes 1..k; the end
    mark is class 0, and open class j is class k + 1 + j, both fixed."""
    types, total = len(table), 1 + k + len(table) - 1 - words
    classes = np.concatenate([[0], 1 + np.arange(words) % k, k + 1 + np.arange(types - 1 - words)])
    n = _class_table(table, classes, total)
    table = table.astype(float)
    hot = np.zeros((types, total))
    hot[np.arange(types), classes] = 1
    movable = np.arange(1, k + 1)
    for _ in range(rounds):
        moved = 0
        for w in range(1, words + 1):
            out, into, own = table[w] @ hot, table[:, w] @ hot, table[w, w]
            a = classes[w]
            out[a] -= own
            into[a] -= own
            n[a] -= out
            n[:, a] -= into
            n[a, a] -= own
            rows, cols = n[movable], n[:, movable]
            gain = (_xlogx(rows + out) - _xlogx(rows)).sum(axis=1) + (_xlogx(cols + into[:, None]) - _xlogx(cols)).sum(axis=0)
            same = n[movable, movable]
            o, i = out[movable], into[movable]
            gain += _xlogx(same + o + i + own) - _xlogx(same) - (_xlogx(same + o) - _xlogx(same)) - (_xlogx(same + i) - _xlogx(same))
            left, right = rows.sum(axis=1) + i, cols.sum(axis=0) + o  # w's neighbours count wherever it goes
            gain -= _xlogx(left + out.sum() + own) - _xlogx(left) + _xlogx(right + into.sum() + own) - _xlogx(right)
            b = int(movable[np.argmax(gain)])
            if gain[b - 1] <= gain[a - 1] + 1e-9:
                b = a
            n[b] += out
            n[:, b] += into
            n[b, b] += own
            if b != a:
                moved += 1
                hot[w, a], hot[w, b], classes[w] = 0, 1, b
        if not moved:
            break
    return classes


def transitions(counts: np.ndarray) -> np.ndarray:
    """log10 P(class | previous class), Witten-Bell smoothed."""
    k = len(counts)
    unigram = (counts.sum(axis=0) + 1) / (counts.sum() + k)
    n, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    mixed = (counts + kinds * unigram) / np.maximum(n + kinds, 1)
    return np.log10(np.where(n > 0, mixed, unigram))


class Model:
    """What workers need: class, emission and base score by number, transitions, and
    what the class and the spelling add to the count of a word that the head lacks.

    ``steps`` has a row and a column per class, then one per spelling for words never
    seen; their columns hold the emission as well."""

    def __init__(self, lexicon: Lexicon, classes: np.ndarray, table: np.ndarray, tail: np.ndarray,
                 open_n: np.ndarray, open_types: np.ndarray, total: int, types: int):
        k = len(table)
        self.lexicon, self.word, self.classes = lexicon, lexicon.words, classes
        self.total, self.types, self.k = total, types, k
        self.open_size = np.log10(np.maximum(open_n + open_types, 1))
        self.open_unseen = np.log10(np.maximum(open_types, 1))
        kept = open_n / np.maximum(open_n + open_types, 1)
        counts, first, seeds = lexicon.count, lexicon.first, 1 + lexicon.seeds
        sizes = np.bincount(classes[:seeds], counts[:seeds], k) + tail.sum(axis=1)
        sizes[1:] += OPEN
        unseen = (tail * (1 - kept) + 1) / sizes[:, None].clip(1)
        unseen[0] = 0  # an end mark is no word
        after = 10 ** transitions(table)
        spelled = tail.sum(axis=0)  # equals open_n
        mix = np.where(spelled > 0, tail / np.maximum(spelled, 1), (np.arange(k) > 0)[:, None] / (k - 1)).T
        rows = np.concatenate([after, mix @ after])
        self.steps = np.log10(np.concatenate([rows, rows @ unseen], axis=1))
        # emission of a word beyond the seeds, without its count
        self.share = np.log10(np.maximum(kept, 1e-300)) - np.log10(sizes.clip(1))[:, None]
        emit = np.log10(np.maximum(counts, 1))
        emit[:seeds] -= np.log10(sizes[classes[:seeds]].clip(1))
        emit[seeds:] += self.share[classes[seeds:first], lexicon.open[seeds:first]]
        self.emit = np.concatenate([emit, np.zeros(OPEN)])
        self.unseen_base = -math.log10(total + types + 1)
        self.base = np.concatenate([np.log10(counts + 1), np.zeros(OPEN)]) + self.unseen_base
        self.known = np.concatenate([counts > 0, np.zeros(OPEN, bool)])

    def score(self, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) per text of a batch of :func:`placed` rows."""
        ids, sizes, cls, places, n = _words(part, self.classes, self.lexicon.first)
        before, own = _neighbours(cls, sizes)
        ends = np.cumsum(sizes)
        starts = ends - sizes + np.arange(len(sizes))
        emit, base, known = self.emit[ids], self.base[ids], self.known[ids]
        emit[places] = np.log10(n) + self.share[cls[places], self.lexicon.open[ids[places]]]
        base[places] = np.log10(n + 1) + self.unseen_base
        known[places] = True
        each = ((known, self.known[0]), (base, self.base[0]), (emit, self.emit[0]))
        known, base, emit = (np.insert(x, ends, end) for x, end in each)
        return (sizes + 1, np.add.reduceat(known, starts, dtype=np.int64), np.add.reduceat(base, starts),
                np.add.reduceat(self.steps[before, own] + emit, starts))


def _lexicon(vocab: DataFrame, head: int, seeds: int, ends: int) -> Lexicon:
    plain = vocab.filter("open >= 0").select("word", "n")
    top = plain.orderBy(F.desc("n"), "word").limit(min(seeds, head)).collect()
    # the head goes down to the count from which on there are at most `head` words
    level = F.floor(F.log2("n") * 64).cast("int")
    least, held = None, 0
    for r in sorted(plain.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += r["count"]
        if held > head:
            break
        least = r["level"]
    more = [] if least is None else plain.filter(level >= least).collect()
    words = [(r.word.encode("utf-8"), r.n) for r in top]
    known = {w for w, _ in words}
    words += sorted(((w, r.n) for r in more if (w := r.word.encode("utf-8")) not in known), key=lambda x: (-x[1], x[0]))
    return Lexicon(words, len(top), ends)


def _fit(docs: DataFrame, head: int, clustered: int, k: int) -> tuple[Model, DataFrame, DataFrame]:
    """(model, vocabulary, :func:`placed` rows) of ``docs(text, learn, ...)``; those with ``learn`` train."""
    words = written(vocabulary(docs.filter("learn").select("text")), "brown-vocabulary")
    sums = words.groupBy("open").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    total, types = sum(r.n for r in sums), sum(r.types for r in sums)
    open_n, open_types = np.zeros(OPEN), np.zeros(OPEN)
    for r in sums:
        if r.open >= 0:
            open_n[r.open], open_types[r.open] = r.n, r.types
    lexicon = _lexicon(words, head, clustered, sum(r.n for r in sums if r.open < 0))
    seeds = lexicon.seeds
    for j, n in zip(lexicon.open[1:seeds + 1], lexicon.count[1:seeds + 1]):  # seeds leave their spelling class
        open_n[j] -= n
        open_types[j] -= 1
    rows = coded(docs, lexicon)
    learn = rows.filter("learn")
    first = lexicon.first
    table = transition_table(learn, lexicon.classes(np.arange(1 + seeds), 1 + seeds), first, 1 + seeds + OPEN)
    of_type = exchange(table, seeds, k)
    start = lexicon.classes(of_type[:1 + seeds], 1 + k)
    vocab = assigned(learn, lexicon, start, _class_table(table, of_type, 1 + k + OPEN))
    tail = np.zeros((1 + k + OPEN, OPEN))
    for r in vocab.groupBy("cls", "open").agg(F.sum("n").alias("n")).collect():  # a row per class and spelling
        tail[r.cls, r.open] = r.n
    classes = lexicon.classes(of_type[:1 + seeds], 1 + k + OPEN)  # words never seen come after the classes
    heads = vocab.filter("id >= 0").select("id", "cls").toArrow()  # at most `head` rows
    classes[heads.column("id").to_numpy()] = heads.column("cls").to_numpy()
    rows = placed(rows, vocab)
    table = transition_table(rows.filter("learn"), classes, first, 1 + k + OPEN)
    return Model(lexicon, classes, table, tail, open_n, open_types, total, types), vocab, rows


def fit(texts: DataFrame, head: int = HEAD, clustered: int = CLUSTERED, k: int = CLASSES) -> tuple[Model, DataFrame]:
    """(model, vocabulary table of the words beyond the seeds) of the training rows ``texts(text)``."""
    return _fit(texts.select("text", F.lit(True).alias("learn")), head, clustered, k)[:2]


def score(docs: DataFrame, model: Model, vocab: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs(doc_id, text)``."""
    return _scores(placed(coded(docs.select("doc_id", "text"), model.lexicon), vocab), model)


def _scores(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, shared.value.score(part))],
                                             ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return (rows.select("doc_id", "ids", *PLACED)
            .mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
            .select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"))


def score_held_out(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Scores of all documents by a model of those that are not held out; with the
    perplexity per token."""
    learn = may_learn(F.col("doc_id"), modulus, remainder).alias("learn")
    model, _, rows = _fit(docs.select("doc_id", "text", learn), HEAD, CLUSTERED, CLASSES)
    return (_scores(rows, model)
            .select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "n_tokens", "n_known",
                    "train_tokens", "base_score", "score",
                    F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")))
