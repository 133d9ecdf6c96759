"""Language identification by hierarchical discrimination.

First the language family is predicted, then the language within it. Both levels
use linear support vector machines, one for each pair of classes
(one-versus-one), over hashed character n-grams of length 1 to 3 of the
lower-cased letters.

Fitting uses about ``SAMPLE_PER_LANGUAGE`` labelled rows of each of the
``MAX_LANGUAGES`` most frequent languages, those with the smallest key hash, and
never more than ``2 * SAMPLE_ROWS`` in all; the machines are solved by dual
coordinate descent on this bounded sample. Prediction covers all rows
and whole texts.

Nulls and ties: a NULL text, or one without a letter, is ``und`` with score 0;
so is everything when no language was learned. Equal votes go to the larger sum
of margins, then to the language first in alphabetical order. Repeated rows are
predicted alike. An empty table gives an empty result. Columns of the input are kept,
but ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ledger_spark.llm.common import held_out, may_learn, slices

SAMPLE_PER_LANGUAGE = 800
SAMPLE_ROWS = 6400
MAX_LANGUAGES = 256
GRAMS = 4096
#: Resolution of the hash cut that draws each language's sample.
CUTS = 1 << 62
UNKNOWN = "und"
EPOCHS = 15
#: Texts are read in pieces of this many characters, so memory stays bounded.
PIECE = 1 << 20

#: ISO 639-1 codes by language family (branch).
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "an ast ca es fr gl it la oc pt ro rm sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "indic": "as bn gu hi kn mr ne or pa sa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "uralic": "et fi hu se",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg mi ms su tl",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    """The family of a language value; one that is not listed is its own family."""
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


@cache
def _letters() -> np.ndarray:
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)])


def gram_counts(text: str) -> np.ndarray | None:
    """Hashed counts of 1- to 3-grams of letters; None without a letter."""
    counts, seen = np.zeros(GRAMS, np.int64), False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le"), np.uint32)
        letter = _letters()[codes]
        seen = seen or bool(letter.any())
        codes = np.where(letter, codes, 32)
        keep = np.ones(len(codes), bool)
        keep[1:] = letter[1:] | letter[:-1]  # runs of non-letters become one blank
        c = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
        one = c * np.uint32(2654435761)
        two = one[:-1] + c[1:] * np.uint32(2246822519)
        three = two[:-1] + c[2:] * np.uint32(3266489917)
        for gram in (one, two, three):
            counts += np.bincount(((gram ^ (gram >> 15)) % GRAMS).astype(np.int64), minlength=GRAMS)
    return counts if seen else None


def gram_vector(text: str | None) -> np.ndarray | None:
    """Unit-length square-rooted counts; None without a letter."""
    counts = gram_counts(text) if text else None
    if counts is None:
        return None
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def svm(rows: np.ndarray, sign: np.ndarray, cost: float = 4.0, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (bias last) of an L1-loss linear SVM, by dual coordinate descent."""
    x = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    square = (x * x).sum(axis=1)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            gradient = sign[i] * float(w @ x[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * sign[i]) * x[i]
                alpha[i] = new
    return w


class OneVersusOne:
    """A machine for each pair of classes; predict by votes, then margins."""

    def __init__(self, rows: np.ndarray, classes: np.ndarray):
        self.names = sorted(set(classes.tolist()))
        self.pairs = list(combinations(range(len(self.names)), 2))
        weights = [np.zeros(rows.shape[1] + 1, np.float32)]
        for a, b in self.pairs:
            mine = (classes == self.names[a]) | (classes == self.names[b])
            weights.append(svm(rows[mine], np.where(classes[mine] == self.names[a], 1.0, -1.0)))
        self.weights = np.stack(weights[1:] or weights)

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class number, score in [0, 1]) of each row."""
        n, k = len(rows), len(self.names)
        if k < 2:
            return np.zeros(n, int), np.ones(n)
        margins = rows @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, sums, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for j, (a, b) in enumerate(self.pairs):
            m = margins[:, j]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            for side, value in ((a, m), (b, -m)):
                sums[:, side] += value
                least[:, side] = np.minimum(least[:, side], value)
        best = np.lexsort((np.broadcast_to(-np.arange(k), (n, k)), sums, votes), axis=1)[:, -1]
        return best, 1 / (1 + np.exp(-2 * least[np.arange(n), best].clip(-30, 30)))


class Model:
    def __init__(self, rows: np.ndarray, langs: np.ndarray):
        families = np.array([family(x) for x in langs.tolist()])
        self.empty = not len(langs)
        if not self.empty:
            self.top = OneVersusOne(rows, families)
            self.inner = {f: OneVersusOne(rows[families == f], langs[families == f]) for f in self.top.names}

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        if self.empty:
            return [UNKNOWN] * len(rows), np.zeros(len(rows))
        group, score = self.top.predict(rows)
        names = np.full(len(rows), UNKNOWN, object)
        for g, f in enumerate(self.top.names):
            mine = np.flatnonzero(group == g)
            if len(mine):
                lang, inner = self.inner[f].predict(rows[mine])
                names[mine] = np.array(self.inner[f].names, object)[lang]
                score[mine] *= inner
        return names.tolist(), score


def fit(docs: DataFrame, learnable: Column, per_language: int = SAMPLE_PER_LANGUAGE,
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of the rows that ``learnable`` admits."""
    rows = docs.select(F.col("doc_id").alias("__key"), F.col("text").alias("__text"), F.col("lang").alias("__lang"),
                       learnable.alias("__may")).filter("__may AND __lang IS NOT NULL AND __text IS NOT NULL")
    counts = (rows.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").limit(MAX_LANGUAGES).collect())
    if not counts:
        return Model(np.zeros((0, GRAMS), np.float32), np.array([]))
    each = max(1, min(per_language, sample_rows // len(counts)))
    cut = F.create_map(*[F.lit(x) for r in counts for x in (r["__lang"], min(CUTS, CUTS * each // r["count"]))])
    near = F.pmod(F.xxhash64("__key"), F.lit(CUTS))
    parts = rows.filter(near < F.element_at(cut, F.col("__lang"))).orderBy(near, "__key").limit(2 * sample_rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            found = [gram_vector(t) for t in part.column(0).to_pylist()]
            keep = [i for i, v in enumerate(found) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([found[i].astype(np.float16).tobytes() for i in keep], pa.binary()),
                 part.column(1).take(pa.array(keep, pa.int64()))], ["grams", "lang"])

    got = parts.select("__text", "__lang").mapInArrow(vectors, "grams binary, lang string").collect()
    got.sort(key=lambda r: (r.lang, r.grams))
    x = np.array([np.frombuffer(r.grams, np.float16) for r in got], np.float32).reshape(len(got), GRAMS)
    return Model(x, np.array([r.lang for r in got], object))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (input columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score")
    at, names = rest.columns.index(text), [*rest.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [gram_vector(t) for t in part.column(at).to_pylist()]
            rows = [i for i, v in enumerate(found) if v is not None]
            langs, scores = [UNKNOWN] * len(found), np.zeros(len(found))
            if rows:
                named, scores[rows] = shared.value.predict(np.stack([found[i] for i in rows]))
                for i, lang in zip(rows, named):
                    langs[i] = lang
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(langs, pa.string()), pa.array(scores)], names)

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField("lang_pred", StringType()),
                                            StructField("score", DoubleType())]))


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document (needs doc_id, text, lang)."""
    model = fit(docs, may_learn(F.col("doc_id"), modulus, remainder))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "lang_pred", "score")
