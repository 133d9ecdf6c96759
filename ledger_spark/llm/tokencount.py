"""Token counts without token ids: pieces once per distinct pre-token.

A tokenizer cuts a text into pre-tokens and each pre-token into pieces, whatever
stands beside it. So the number of a text's tokens is a sum over its pre-tokens:

1. all texts are cut into pre-tokens, counted per task and summed by Spark: the
   vocabulary of distinct pre-tokens with their frequencies;
2. the pieces of every distinct pre-token are counted once, by the tokenizer's own
   model, and written beside it;
3. every text becomes its pre-token frequencies. Those joined with the vocabulary
   and summed are its count. No id of a text is ever made.

The join has two halves. Pre-tokens that make up at least one in ``HEAD`` of all
occurrences (at most ``HEAD`` by their definition, and of at most ``HEAD_BYTES``
bytes each: a proven bound) go to the workers and are joined where the text is
read; all others are joined by a shuffle, in which no key holds more than one in
``HEAD`` of the occurrences (or, if it is longer, of its own rows' bytes).

Pre-tokens are what the tokenizer's own normaliser and pre-tokenizer give. Where
the tokenizer drops white space (``Cutter`` asks it), texts are first cut at ASCII
white space and each distinct word is cut once while it is remembered, with the sum of
what the workers know of it; words of Latin letters and printable ASCII need no call if the tokenizer is seen to lower-case them and to
cut them into contractions, letters, digits and rest. Strings of special tokens are one token each, as the library's
default has it.

A NULL text is empty: 0 bytes, 0 tokens. Texts are read whole; a very long one
costs memory in proportion to itself. Repeated rows and repeated or NULL ids are
counted row by row. An empty table gives an empty result. Extra columns of the
input are ignored, and no internal name can clash with them.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledger_spark.llm.common import slices, written

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: A pre-token goes to every worker if it makes up at least one in so many occurrences.
HEAD = 1 << 20
HEAD_BYTES = 64
#: Distinct words that a task holds before it hands on what it counted.
HELD = 200_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Cutter:
    """Pre-tokens of a text, and the pieces of a pre-token, by a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special tokens that change the text beside them cannot be counted by pre-token")
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.by_word = self._own("Ab1  cd\t'e\n") == self._own("Ab1") + self._own("cd") + self._own("'e")
        # words of letters up to U+017F and other printable ASCII, if the tokenizer is seen to
        # lower-case them and to cut them into contractions, letters, digits and rest
        letters = [c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x180)])
                   if c.isalpha() and len(c.lower()) == 1 and self._own(c) == self._own(c.lower()) and len(self._own(c)) == 1]
        self.shown = {ord(c): self._own(c)[0] for c in letters}
        kinds = "".join(sorted({c.lower() for c in letters}))
        self.plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds}]+|[0-9]|[^{kinds}0-9]+")
        self.simple = re.compile(f"[!-~{''.join(letters)}]+")
        probes = ["Abc", "x1y22", "don't", "IT'S", "a_b-C", "''s", "'St", "we'll!", "((9))", "~'re'd", *map(chr, range(33, 127)),
                  *(f"b{c}d" for c in letters), *(f"1{c}'{c}s" for c in letters)]
        self.knows_simple = self.by_word and all(self._own(w) == list(self._simple(w)) for w in probes)
        # of ASCII letters, alone or before one other such character, if no special string is of that form
        self.knows_letters = (self.knows_simple and {*range(65, 91), *range(97, 123)} <= self.shown.keys()
                              and not any(re.fullmatch("[A-Za-z]*[!-~]?", s) for s in strings))
        self.words: dict[bytes, tuple[int, tuple[str, ...]]] = {}

    def _own(self, text: str) -> list[str]:
        t = self.tokenizer
        if t.normalizer is not None:
            text = t.normalizer.normalize_str(text)
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer is not None else [text]

    def _simple(self, word: str) -> tuple[str, ...]:
        low = word.lower()
        parts = (low,) if low.isalpha() else tuple(self.plain.findall(low))
        return parts if low.isascii() else tuple(p.translate(self.shown) for p in parts)

    def cut(self, text: str) -> tuple[int, list[str]]:
        """(special tokens, pre-tokens) of a text."""
        if self.special is None or not (n := len(self.special.findall(text))):
            return 0, self._own(text) if text else []
        return n, [p for part in self.special.split(text) if part for p in self._own(part)]

    def word(self, word: bytes) -> tuple[int, tuple[str, ...]]:
        """As :meth:`cut`, for a word without ASCII white space; remembered."""
        found = self.words.get(word)
        if found is None:
            found = self.cut_word(word)
            if len(self.words) >= HELD:
                self.words.clear()
            self.words[word] = found
        return found

    def cut_word(self, word: bytes) -> tuple[int, tuple[str, ...]]:
        """As :meth:`word`, not remembered."""
        if self.knows_letters:
            if word.isalpha():
                return 0, (word.lower().decode("ascii"),)
            if word[:-1].isalpha() and 32 < word[-1] < 127:
                low = word.lower().decode("ascii")
                return 0, (low[:-1], low[-1])
        text = word.decode("utf-8")
        if self.knows_simple and self.simple.fullmatch(text) and not (self.special and self.special.search(text)):
            return 0, self._simple(text)
        n, parts = self.cut(text)
        return n, tuple(parts)

    def frequencies(self, text: bytes) -> tuple[int, dict[str, int]]:
        """(special tokens, pre-token -> occurrences) of a UTF-8 text."""
        if not self.by_word:
            n, parts = self.cut(text.decode("utf-8"))
            return n, Counter(parts)
        n, out = 0, {}
        for word, times in Counter(text.split()).items():
            special, parts = self.word(word)
            n += special * times
            for p in parts:
                out[p] = out.get(p, 0) + times
        return n, out

    def pieces(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token))


class Sure(dict):
    """The tokens of words, by word, but for those of pre-tokens that ``of`` (pre-token ->
    pieces) lacks; ``rest`` has these pre-tokens, by word."""

    def __init__(self, own: Cutter, of: dict[str, int]):
        super().__init__()
        self.own, self.of, self.rest = own, of, {}

    def __missing__(self, word: bytes) -> int:
        n, parts = self.own.cut_word(word)
        rest = [p for p in parts if p not in self.of]
        if rest:
            self.rest[word] = rest
        self[word] = n = n + sum(self.of[p] for p in parts if p in self.of)
        return n

    def text(self, text: bytes) -> tuple[int, dict[str, int]]:
        """(tokens known, other pre-tokens -> occurrences) of a UTF-8 text."""
        if not self.own.by_word:
            n, parts = self.own.frequencies(text)
            return (n + sum(self.of[p] * times for p, times in parts.items() if p in self.of),
                    {p: times for p, times in parts.items() if p not in self.of})
        if len(self) >= HELD:
            self.clear()
            self.rest.clear()
        words = text.split()
        n, rest = sum(map(self.__getitem__, words)), {}
        for word in filter(self.rest.__contains__, words):
            for p in self.rest[word]:
                rest[p] = rest.get(p, 0) + 1
        return n, rest


@cache
def cutter(path: str | None) -> Cutter:
    """One per worker; ``None`` is the public tokenizer where this worker has it."""
    return Cutter(path or tokenizer_path())


def _utf8(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in column.cast(pa.binary()))


def vocabulary(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(piece string, n long): distinct pre-tokens of all texts and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cutter(path)
        words: Counter = Counter()
        parts: Counter = Counter()

        def counted() -> pa.RecordBatch:
            for word, times in words.items():
                for p in own.word(word)[1]:
                    parts[p] += times
            out = pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.string()), pa.array(parts.values(), pa.int64())],
                                             ["piece", "n"])
            words.clear()
            parts.clear()
            return out

        for part in slices(batches):
            for t in _utf8(part.column(0)):
                if t and own.by_word:
                    words.update(t.split())
                elif t:
                    parts.update(own.frequencies(t)[1])
            if len(words) + len(parts) >= HELD:
                yield counted()
        yield counted()

    rows = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_counts(vocab: DataFrame, path: str | None = None) -> DataFrame:
    """``vocab`` with ``pieces int``: how many tokens the model makes of each pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cutter(path)
        for part in slices(batches, 4096):
            pieces = [own.pieces(p) for p in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pieces, pa.int32())],
                                             ["piece", "n", "pieces"])

    return vocab.select("piece", "n").mapInArrow(run, "piece string, n long, pieces int")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
                 limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """(``key``, n_bytes, n_tokens, over_limit) per row of ``docs``.

    ``path`` names a ``tokenizers`` file that every worker can read (by default the
    public one); ``limit`` is the count that ``over_limit`` asks to be exceeded.
    """
    spark = docs.sparkSession
    vocab = written(piece_counts(vocabulary(docs, text, path), path), "tokens-vocabulary")
    total = vocab.agg(F.sum("n")).first()[0] or 0
    # n * head >= total holds for at most `head` pre-tokens
    often = (F.col("n") * head >= total) & (F.octet_length("piece") <= HEAD_BYTES)
    top = vocab.filter(often).select("piece", "pieces").toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(top.column("piece").to_pylist(), top.column("pieces").to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure = Sure(cutter(path), shared.value)
        for part in slices(batches):
            sizes, sums, rare, times, ends = [], [], [], [], [0]
            for t in _utf8(part.column(2)):
                n, others = sure.text(t) if t else (0, {})
                rare += others.keys()
                times += others.values()
                sizes.append(len(t) if t else 0)
                sums.append(n)
                ends.append(len(rare))
            rest = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int32())], ["piece", "times"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)], ["id", "row", "n_bytes", "sure", "rest"])

    kind = docs.schema[key].dataType.simpleString()
    rows = written(docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
                   .mapInArrow(run, f"id {kind}, row long, n_bytes long, sure long, rest array<struct<piece:string,times:int>>"),
                   "tokens-rows")
    rare = rows.select("row", F.explode("rest").alias("r")).select("row", "r.piece", "r.times")
    more = (rare.join(vocab.filter(~often).select("piece", "pieces"), "piece")
            .groupBy("row").agg(F.sum(F.col("pieces") * F.col("times").cast("long")).alias("more")))
    n = F.col("sure") + F.coalesce("more", F.lit(0))
    return (rows.drop("rest").join(more, "row", "left")
            .select(F.col("id").alias(key), "n_bytes", n.cast("long").alias("n_tokens"), (n > limit).alias("over_limit")))
