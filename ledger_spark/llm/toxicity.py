"""Toxicity: Levenshtein automata intersected with a lexicon trie.

Learning (from at most ``SAMPLE_PER_LABEL`` labelled rows of each label, those
with the smallest key hash):

1. a lexicon of words and stems (a stem ends in ``*`` and stands for every word
   that continues it) that toxic rows hold and clean rows hardly do, weighted by
   smoothed log odds;
2. a calibration of the context scores, by logistic regression on the labelled
   rows that the lexicon was not learned from, shifted to the label's true share.

Scoring walks each word of a text through the product of the lexicon trie and
the Levenshtein automaton. The product is determinised lazily, one state per set
of (trie node, edits), and shared by all words of a worker. It accepts an entry
itself and, from ``MIN_FUZZY`` letters on, words one edit away (substitution,
insertion, deletion, neighbouring swap); words that clean labelled rows use are
no misspellings, and entries that more than ``MAX_NEIGHBOURS`` of them surround
allow none. Every hit is weighted by its context: inside quotation marks, or
shortly after a word of mention (``QUOTING``), it counts ``QUOTED``-fold. The strongest
hit, the best window of ``WINDOW`` words, the total and the density make the score.

Nulls and ties: NULL, empty and wordless texts score as texts without a hit.
Repeated rows score alike. Without labelled rows of both kinds the lexicon is
empty, and every text gets the share of label 1 (0 without any label). An entry
reached in several ways counts once per word, with its greatest weight. Texts are read
whole, however long. An empty table gives an empty result. Columns of the input are
kept, but ``score`` and ``hits`` are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ledger_spark.llm.common import held_out, may_learn, slices, smallest_by_hash

SAMPLE_PER_LABEL = 6000
LEXICON_ENTRIES = 4000
#: Clean words that may surround an entry which still allows misspellings.
MAX_NEIGHBOURS = 4
THRESHOLD = 0.3
STEM_LETTERS = range(4, 9)
MIN_FUZZY = 5
FUZZY = 0.8
QUOTED = 0.25
WINDOW = 24
#: Words that a worker remembers the outcome of; a memory, not a limit on words.
REMEMBER = 400_000

#: Words that introduce a quotation or a mention (en, fr, de, es).
QUOTING = frozenset(
    "said says quote quoted quoting called calling word term wrote writes reported "
    "dit disait mot terme cite citation appelle "
    "sagte sagt wort begriff zitat nannte "
    "dijo dice palabra cita llama".split())
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…«»“”„‘’‹›¿¡"
_OPENING = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›"}
MENTION_REACH = 3


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Automaton:
    """Lazy product of a lexicon trie with the edit automaton (at most one edit).

    An item of a state is (trie node, edits, pending): ``pending`` is the
    character that a neighbouring swap still needs, or "".
    """

    def __init__(self, entries: dict[str, float], fuzzy: Iterable[str] = (), max_edits: int = 1):
        self.max_edits = max_edits
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.fuzzy: list[str] = [""]
        fuzzy = set(fuzzy)
        for entry, weight in entries.items():
            node = 0
            for c in entry.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.whole.append(0.0)
                    self.stem.append(0.0)
                    self.fuzzy.append("")
                node = self.children[node][c]
            kind = self.stem if entry.endswith("*") else self.whole
            kind[node] = max(weight, kind[node])
            if entry in fuzzy:
                self.fuzzy[node] = entry
        # edits are only worth following where a word that allows them lies below
        self.below = [False] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            self.below[node] = bool(self.fuzzy[node]) or any(self.below[x] for x in self.children[node].values())
        self.sets: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        #: per state: weight of a stem, of a whole word, of a word one edit away, and those words
        self.stem_at: list[float] = []
        self.whole_at: list[float] = []
        self.near_at: list[float] = []
        self.near_words: list[list[str]] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items: Iterable[tuple[int, int, str]]) -> int:
        todo, done = list(items), set()
        while todo:  # with every letter of the lexicon that may be missing from the word
            item = todo.pop()
            if item not in done:
                done.add(item)
                node, edits, pending = item
                if edits < self.max_edits and not pending:
                    todo.extend((x, edits + 1, "") for x in self.children[node].values() if self.below[x])
        closed = frozenset(done)
        if closed not in self.sets:
            self.sets[closed] = len(self.items)
            self.items.append(closed)
            self.next.append({})
            exact = [n for n, edits, pending in closed if not edits and not pending]
            near = {n for n, edits, pending in closed if edits and not pending and self.fuzzy[n]}
            self.stem_at.append(max((self.stem[n] for n in exact), default=0.0))
            self.whole_at.append(max((self.whole[n] for n in exact), default=0.0))
            self.near_at.append(max((self.whole[n] for n in near), default=0.0))
            self.near_words.append(sorted(self.fuzzy[n] for n in near))
        return self.sets[closed]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits, pending in self.items[state]:
            if pending:
                if c == pending:
                    out.add((node, edits, ""))
                continue
            below = self.children[node]
            if c in below:
                out.add((below[c], edits, ""))
            if edits < self.max_edits and self.below[node]:
                out.add((node, edits + 1, ""))  # c is surplus
                for x, child in below.items():
                    if self.below[child]:
                        out.add((child, edits + 1, ""))  # c stands for x
                        if c in self.children[child]:  # x and c are swapped
                            out.add((self.children[child][c], edits + 1, x))
        return self._state(out) if out else -1

    def match(self, word: str) -> tuple[float, float, list[str]]:
        """(weight of an exact or stem hit, weight of a one-edit hit, the entries
        one edit away); 0 for none."""
        state, stem = self.start, 0.0
        for c in word:
            nxt = self.next[state].get(c)
            if nxt is None:
                nxt = self.next[state][c] = self._step(state, c)
            if nxt < 0:
                return stem, 0.0, []
            state = nxt
            if self.stem_at[state] > stem:
                stem = self.stem_at[state]
        return max(stem, self.whole_at[state]), self.near_at[state], self.near_words[state]


def quoted_flags(words: list[str]) -> list[bool]:
    """Per word: does it stand inside quotation marks?"""
    out, closing, opened = [], None, 0
    for i, w in enumerate(words):
        inside = closing is not None
        if closing is None and w[0] in _OPENING:
            closing, opened, inside = _OPENING[w[0]], i, True
            if len(w) > 1 and closing in w[1:]:
                closing = None
        elif closing is not None and closing in w:
            closing = None
        out.append(inside)
    if closing is not None:  # a mark that nothing closes quotes nothing
        for i in range(opened, len(out)):
            out[i] = False
    return out


class Scorer:
    """Features of a text under a lexicon: its strongest hit, best window, total and density."""

    def __init__(self, entries: dict[str, float], fuzzy: frozenset[str], exempt: frozenset[str]):
        self.entries, self.fuzzy, self.exempt = entries, fuzzy, exempt
        self._ready: Automaton | None = None

    def __getstate__(self):
        return {"entries": self.entries, "fuzzy": self.fuzzy, "exempt": self.exempt, "_ready": None}

    @property
    def automaton(self) -> Automaton:
        if self._ready is None:
            self._ready, self._known = Automaton(self.entries, self.fuzzy), {}
        return self._ready

    def hit(self, token: str) -> float:
        """Weight of a raw token: its entry's, ``FUZZY`` of it for a misspelling."""
        word = token.strip(_EDGE)
        if not word:
            return 0.0
        exact, near, _ = self.automaton.match(word)
        return exact or (0.0 if word in self.exempt else FUZZY * near)

    def features(self, text: str | None) -> tuple[list[float], int]:
        """([strongest hit, log best window, log total, density], hits)."""
        words = words_of(text)
        _ = self.automaton
        known, hits = self._known, {}
        for token in set(words):
            found = known.get(token)
            if found is None:
                if len(known) >= REMEMBER:
                    known.clear()
                found = known[token] = self.hit(token)
            if found:
                hits[token] = found
        if not hits:
            return [0.0, 0.0, 0.0, 0.0], 0
        quoted = quoted_flags(words) if any(c in text for c in _OPENING) else None
        at, weight = [], []
        for i, token in enumerate(words):
            if token in hits:
                mention = any(w.strip(_EDGE) in QUOTING for w in words[max(0, i - MENTION_REACH):i])
                at.append(i)
                weight.append(hits[token] * (QUOTED if mention or (quoted and quoted[i]) else 1.0))
        at, weight = np.array(at), np.array(weight)
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        best = (sums[np.searchsorted(at, at + WINDOW)] - sums[:-1]).max()
        density = 100 * weight.sum() / (100 + len(words))
        return [weight.max(), math.log1p(best), math.log1p(weight.sum()), density], len(at)


class Model:
    def __init__(self, scorer: Scorer, weights: np.ndarray, prior: float):
        self.scorer, self.weights, self.prior = scorer, weights, prior

    def score(self, text: str | None) -> tuple[float, int]:
        x, hits = self.scorer.features(text)
        if not self.scorer.entries:
            return self.prior, hits
        z = float(self.weights[0] + np.dot(self.weights[1:], x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), hits


def _calibrate(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression (Newton, small ridge), each label weighted to its
    share of all labelled rows; evidence never speaks for cleanness."""
    x = np.hstack([np.ones((len(x), 1)), x])
    rows = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    free = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        part, ridge = x[:, free], np.diag([1e-6] + [0.05] * (len(free) - 1))
        v = np.zeros(len(free))
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(part @ v, -30, 30)))
            h = (part * (rows * p * (1 - p))[:, None]).T @ part + ridge
            step = np.linalg.solve(h, part.T @ (rows * (y - p)) - ridge @ v)
            v += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        w[free] = v
        bad = [i for i in free[1:] if w[i] < 0]
        if not bad:
            return w
        free = [i for i in free if i not in bad]


def _terms(text: str | None) -> set[str]:
    """The distinct words of a text, and the stems that they continue."""
    out = set()
    for token in set(words_of(text)):
        word = token.strip(_EDGE)
        if word:
            out.add(word)
            out.update(word[:k] + "*" for k in STEM_LETTERS if k < len(word))
    return out


def lexicon(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weighted entries from (term, toxic rows, clean rows): the smoothed log odds
    of terms that at least three toxic rows hold, ten times likelier there.

    A stem must stand for several words: where one word makes up most of its
    rows, the word is the entry. A term that a stem covers as well is left out.
    """
    weights, rows = {}, {}
    for term, a, b in counts:
        w = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if a >= 3 and w >= math.log(10):
            weights[term], rows[term] = w, a
    alone: dict[str, int] = {}
    for word in weights:
        if not word.endswith("*"):
            for k in STEM_LETTERS:
                if k < len(word):
                    alone[word[:k] + "*"] = max(rows[word], alone.get(word[:k] + "*", 0))
    out: dict[str, float] = {}
    for term in sorted(weights, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        stem = term.rstrip("*")
        if term.endswith("*") and alone.get(term, 0) >= 0.7 * rows[term]:
            continue
        above = max((out.get(stem[:k] + "*", 0.0) for k in STEM_LETTERS if k <= len(stem)), default=0.0)
        if weights[term] > above + 0.1:
            out[term] = weights[term]
    best = sorted(out, key=lambda t: (-out[t], t))[:LEXICON_ENTRIES]
    return {t: out[t] for t in best}


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, label: str = "toxic") -> Model:
    """Learn from the labelled rows that ``learnable`` (over doc_id) admits."""
    admitted = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if learnable is not None:
        admitted = admitted.filter(learnable)
    admitted = admitted.select(F.col("doc_id").alias("__key"), F.col(label).cast("int").alias("__label"))
    totals = {r["__label"]: r["count"] for r in admitted.groupBy("__label").count().collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return Model(Scorer({}, frozenset(), frozenset()), np.zeros(5), share)
    chosen = None
    for value in (0, 1):
        part = smallest_by_hash(admitted.filter(F.col("__label") == value), "__key", SAMPLE_PER_LABEL, totals[value])
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * SAMPLE_PER_LABEL rows; every third calibrates
    chosen = chosen.withColumn("__calibrates", F.pmod(F.xxhash64("__key", F.lit(3)), F.lit(3)) == 0)
    texts = docs.select(F.col("doc_id").alias("__key"), F.col("text").alias("__text"))
    sample = texts.join(F.broadcast(chosen), "__key").select("__text", "__label", "__calibrates")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for part in slices(batches):
            for text, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found[value].update(_terms(text))
        terms = list({**found[0], **found[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([found[1][t] for t in terms], pa.int64()),
             pa.array([found[0][t] for t in terms], pa.int64())], ["term", "a", "b"])

    teach = sample.filter("NOT __calibrates").select("__text", "__label")
    counts = (teach.mapInArrow(count, "term string, a long, b long").groupBy("term")
              .agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    sizes = {r["__label"]: r["count"] for r in chosen.filter("NOT __calibrates").groupBy("__label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    able = counts.filter((F.col("a") >= 3) & (odds >= math.log(10)))
    rows = able.orderBy(F.desc(odds), "term").limit(4 * LEXICON_ENTRIES).collect()
    entries = lexicon(((r.term, r.a, r.b) for r in rows), toxic, clean)
    # words of clean rows that lie one edit from an entry are no misspellings of
    # it, and an entry that many of them surround allows none
    able = frozenset(t for t in entries if not t.endswith("*") and len(t) >= MIN_FUZZY)
    near = docs.sparkSession.sparkContext.broadcast(Scorer(entries, able, frozenset()))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = {w.strip(_EDGE) for t in part.column(0).to_pylist() for w in words_of(t)} - near.value.entries.keys()
            found = [(w, e) for w in words if w for e in near.value.automaton.match(w)[2]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.string())], ["word", "entry"])

    met = teach.filter("__label = 0").select("__text").mapInArrow(close, "word string, entry string").distinct()
    crowds = {r.entry: r.words for r in met.groupBy("entry").agg(
        F.count("word").alias("words"), F.sort_array(F.collect_set("word")).alias("all"))
        .select("entry", F.when(F.col("words") <= MAX_NEIGHBOURS, F.col("all")).alias("words")).collect()}
    fuzzy = frozenset(e for e in able if crowds.get(e, []) is not None)
    exempt = frozenset(w for e in fuzzy for w in crowds.get(e, []))
    scorer = Scorer(entries, fuzzy, exempt)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [shared.value.features(t)[0] for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), part.column(1)], ["x", "y"])

    # where keys repeat in the documents there may be more rows than were chosen
    got = (sample.filter("__calibrates").select("__text", "__label").mapInArrow(measure, "x array<double>, y int")
           .orderBy(F.xxhash64("x", "y"), "y", "x").limit(2 * SAMPLE_PER_LABEL).collect())
    got.sort(key=lambda r: (r.y, r.x))
    x = np.array([r.x for r in got], float).reshape(len(got), 4)
    y = np.array([r.y for r in got], float)
    if len(set(y.tolist())) < 2 or not entries:
        return Model(Scorer({}, frozenset(), frozenset()), np.zeros(5), share)
    return Model(scorer, _calibrate(x, y, share), share)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``hits`` (input columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("score", "hits")
    at, names = rest.columns.index(text), [*rest.columns, "score", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [shared.value.score(t) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())],
                names)

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField("score", DoubleType()),
                                            StructField("hits", LongType())]))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2,
             threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, hits for every document."""
    model = fit(docs, labels, may_learn(F.col("doc_id"), modulus, remainder))
    return (score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"), "hits"))
