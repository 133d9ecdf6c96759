"""Transaction classifiers (B13 wrapper, H6, H7, H8, H11, H12).

Naive Bayes is fitted with small grouped aggregates (per class: count and
numeric means/sds; per (class, word): a presence count). The fitted parameters
(classes x features) come to the driver like any MLlib model's coefficients.
For scoring they are one constant: an array with an entry per class, holding one
array of word weights. A row's words are vocabulary numbers, so each weight is an
array access. The plan has the same size for any number of classes, and rows are
neither joined with parameters nor shuffled.

Multinomial logistic regression uses MLlib (distributed L-BFGS) with a small ridge.
A fitted model can be stored, with its vocabulary, and loaded by batches and streams.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.rules import keyword_classify
from ledger_spark.operators.features import amount_features
from ledger_spark.operators.text import present_words, word_numbers
from ledger_spark.sources import storage

LOG_SQRT_2PI = 0.5 * math.log(2 * math.pi)
# Fixed values of the Gaussian naive Bayes scorer: standard deviations and
# densities at or below EPS are replaced by THRESHOLD.
NB_EPS = 0.0
NB_THRESHOLD = 0.001


def keyword_predictions(df: DataFrame, text_col: str = "description", out_col: str = "pred_keyword"):
    """B13 applied to a frame."""
    return df.withColumn(out_col, keyword_classify(text_col))


NUMERIC_FEATURES = ["log_amount", "is_round", "is_large"]


def nb_feature_frame(df: DataFrame, vocab: list[str], text_col: str = "description",
                     amount_col: str = "amount") -> tuple[DataFrame, list[str]]:
    """Row features for naive Bayes: ``words`` (the row's vocabulary words, an
    array of at most len(vocab) entries) + log_amount, is_round, is_large.
    Returns the frame and the feature names (vocabulary words, then numerics)."""
    p = present_words(df, vocab, text_col, "words")
    f = amount_features(p, amount_col).drop("amount_bucket")
    f = f.withColumns({c: F.col(c).cast("double") for c in NUMERIC_FEATURES})
    return f, list(vocab) + NUMERIC_FEATURES


def _word_counts(train: DataFrame, label: str) -> dict:
    """(class, word) -> number of training rows containing the word: explode of
    the small per-row word arrays + a partially aggregated count."""
    wc = (train.select(label, F.explode("words").alias("w")).groupBy(label, "w")
          .agg(F.count(F.lit(1)).alias("c")).collect())  # classes x vocabulary: the model
    return {(r[label], r["w"]): r["c"] for r in wc}


def gaussian_nb_fit(train: DataFrame, feature_cols: list[str], label: str = "category") -> dict:
    """H6 fit: class counts, per-class mean and sample sd of every feature.

    For the 0/1 word features mean and sd follow from the count c of rows with
    the word among n rows: mean c/n, sd sqrt(c (n-c) / (n (n-1))).
    """
    words = [c for c in feature_cols if c not in NUMERIC_FEATURES]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in NUMERIC_FEATURES:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    rows = train.groupBy(label).agg(*aggs).orderBy(label).collect()  # a row per class: the model
    wc = _word_counts(train, label)
    classes = []
    for r in rows:
        n, cls = r["_n"], r[label]
        params = []
        for w in words:
            c = wc.get((cls, w), 0)
            params.append((c / n, math.sqrt(c * (n - c) / (n * (n - 1))) if n > 1 else None))
        params += [(r[f"_m_{c}"], r[f"_s_{c}"]) for c in NUMERIC_FEATURES]
        classes.append((cls, n, params))
    return {"label": label, "features": feature_cols, "words": words, "classes": classes}


def _floor_sd(sd):
    return NB_THRESHOLD if sd is None or math.isnan(sd) or sd <= NB_EPS else sd


def _py_log_density(x: float, mean: float, sd: float | None) -> float:
    sd = _floor_sd(sd)
    z = (x - mean) / sd
    dens = math.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))
    return math.log(NB_THRESHOLD if dens <= NB_EPS else dens)


def _scored(df: DataFrame, words: list[str], classes: list[dict], out_col: str) -> DataFrame:
    """Label with the greatest base + word weights + numeric log densities; ties
    go to the first class.

    ``classes`` holds, per class, ``label``, ``base``, ``deltas`` (a weight per
    vocabulary word) and ``numeric`` (mean and floored sd per numeric feature).
    """
    if not classes:
        return df.withColumn(out_col, F.lit(None).cast("string"))
    kind = ("array<struct<label:string,base:double,deltas:array<double>,"
            "numeric:array<struct<mean:double,sd:double>>>>")
    model = F.from_json(F.lit(json.dumps(classes)), kind)  # folds to one constant

    def density(x, p):
        z = (x - p["mean"]) / p["sd"]
        dens = F.exp(-0.5 * z * z) / (p["sd"] * F.lit(math.sqrt(2 * math.pi)))
        return F.log(F.when(dens <= NB_EPS, F.lit(NB_THRESHOLD)).otherwise(dens))

    def total(c):
        s = F.aggregate("_numbers", c["base"], lambda acc, i: acc + F.get(c["deltas"], i))
        for k, name in enumerate(NUMERIC_FEATURES if classes[0]["numeric"] else []):
            s = s + density(F.col(name), F.get(c["numeric"], F.lit(k)))
        return s

    ranked = F.transform(model, lambda c, i: F.struct((-total(c)).alias("neg"), i.alias("ord"), c["label"].alias("cls")))
    return word_numbers(df, words).withColumn(out_col, F.array_min(ranked)["cls"]).drop("_numbers")


def gaussian_nb_predict(model: dict, df: DataFrame, out_col: str = "pred_nb") -> DataFrame:
    """H6 predict: argmax over classes of log(count) + sum of log densities;
    ties go to the first class in label order. Word features take only the
    values 0/1, so their log densities are constants per class: a base sum
    for 'absent' plus a correction for each present word."""
    words, classes = model["words"], []
    for cls, n, params in model["classes"]:
        wp, numeric = params[:len(words)], params[len(words):]
        absent = [_py_log_density(0.0, m, sd) for m, sd in wp]
        classes.append({"label": cls, "base": math.log(n) + sum(absent),
                        "deltas": [_py_log_density(1.0, m, sd) - a for (m, sd), a in zip(wp, absent)],
                        "numeric": [{"mean": m, "sd": _floor_sd(sd)} for m, sd in numeric]})
    return _scored(df, words, classes, out_col)


def bernoulli_nb_fit(train: DataFrame, words: list[str], label: str = "category",
                     laplace: float = 1.0) -> dict:
    """H7 fit: P(word | class) = (rows with word + laplace) / (rows + 2*laplace)."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    wc = _word_counts(train, label)
    classes = [(cls, n, [(wc.get((cls, w), 0) + laplace) / (n + 2 * laplace) for w in words])
               for cls, n in sorted(counts.items())]
    return {"label": label, "words": words, "classes": classes}


def bernoulli_nb_predict(model: dict, df: DataFrame, out_col: str = "pred_bnb") -> DataFrame:
    total = sum(n for _, n, _ in model["classes"])
    classes = [{"label": cls, "base": math.log(n / total) + sum(math.log(1 - p) for p in probs),
                "deltas": [math.log(p) - math.log(1 - p) for p in probs], "numeric": []}
               for cls, n, probs in model["classes"]]
    return _scored(df, model["words"], classes, out_col)


#: H8's ridge: half this times the squared coefficients is added to the mean loss of a
#: training row (intercepts are free). Without it separable classes have no finite
#: optimum; with it there is exactly one.
RIDGE = 1e-3
#: The optimiser stops when a step gains less than this share of the loss.
TOLERANCE = 1e-8
#: Training rows of a task: each of the optimiser's steps is a job over all of them, and
#: costs more to schedule than to compute where tasks hold few rows.
ROWS_PER_TASK = 20_000


def logistic_regression_fit(train: DataFrame, features_col: str = "features", label: str = "category",
                            max_iter: int = 1000, ridge: float = RIDGE):
    """H8: multinomial softmax regression (MLlib), one class per label, indexed in
    alphabetical order, at the optimum that :func:`score_equations` checks. Rows
    without a label do not train. ``ridge=0`` fits without a penalty."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer

    train = train.where(F.col(label).isNotNull())
    train = train.coalesce(max(1, -(-train.count() // ROWS_PER_TASK)))
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc",
                            handleInvalid="error").fit(train)
    lr = LogisticRegression(featuresCol=features_col, labelCol="_label", family="multinomial", regParam=ridge,
                            elasticNetParam=0.0, maxIter=max_iter, tol=TOLERANCE, standardization=False)
    back = IndexToString(inputCol="prediction", outputCol="pred_lr", labels=indexer.labels)
    return Pipeline(stages=[indexer, lr, back]).fit(train)


def score_equations(model, train: DataFrame, feature_names: list[str], features_col: str = "features",
                    label: str = "category", ridge: float = RIDGE) -> DataFrame:
    """The equations that hold at H8's optimum: per class and feature (and the
    intercept), ``observed`` (sum of the feature over the class's training rows),
    ``expected`` (its sum weighted by the class's probability, plus the ridge's pull)
    and ``residual``, their difference per training row.

    One pass with partial aggregation: two weighted sum vectors per class.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    spark, labels, lr = train.sparkSession, lr_labels(model), model.stages[1]
    rows = lr_predict(model, train.where(F.col(label).isNotNull())).withColumn("_p", vector_to_array("probability"))
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, name in enumerate(labels):
        is_k = (F.col(label) == name).cast("double")
        aggs += [F.sum(is_k).alias(f"n{k}"), F.sum(F.col("_p")[k]).alias(f"p{k}"),
                 Summarizer.sum(F.col(features_col), is_k).alias(f"seen{k}"),
                 Summarizer.sum(F.col(features_col), F.col("_p")[k]).alias(f"held{k}")]
    s = rows.agg(*aggs).first()  # classes x features numbers, as many as the model has
    out = []
    for k, name in enumerate(labels):
        pull = [s.n * ridge * float(b) for b in lr.coefficientMatrix.toArray()[k]] + [0.0]
        seen, held = [*map(float, s[f"seen{k}"].toArray()), s[f"n{k}"]], [*map(float, s[f"held{k}"].toArray()), s[f"p{k}"]]
        out += [(name, f, o, e + w, (o - e - w) / s.n) for f, o, e, w in zip([*feature_names, "(intercept)"], seen, held, pull)]
    return spark.createDataFrame(out, f"{label} string, feature string, observed double, expected double, residual double")


def save_model(spark, path: str, model, vocab: list[str]) -> None:
    """Store a fitted model with its vocabulary below ``path``. A model that is there
    already is replaced by one commit, and stays readable for those who hold it."""
    folder = f"model={uuid.uuid4().hex}"
    model.write().save(f"{path.rstrip('/')}/{folder}/pipeline")
    words = spark.createDataFrame(list(enumerate(vocab)), "place int, word string")
    words.coalesce(1).write.parquet(f"{path.rstrip('/')}/{folder}/vocabulary")
    storage.change(spark, path, lambda _: storage.State(leaves=(folder,)))


def load_model(spark, path: str):
    """(model, vocabulary) as last saved; both batch (:func:`suggest_category`) and stream
    (:func:`ledger_spark.streaming.live.stream_suggest`) take them."""
    from pyspark.ml import PipelineModel

    state = storage.current(spark, path)
    if state is None:
        raise FileNotFoundError(f"no model at {path}")
    folder = f"{path.rstrip('/')}/{state.leaves[0]}"
    words = spark.read.schema("place int, word string").parquet(f"{folder}/vocabulary").orderBy("place").collect()
    return PipelineModel.load(f"{folder}/pipeline"), [r.word for r in words]  # a vocabulary is bounded


def lr_labels(model) -> list[str]:
    return list(model.stages[0].labels)


def lr_predict(model, df: DataFrame) -> DataFrame:
    """``pred_lr``, ``probability`` for rows with ``features``: the regression and
    the label names only, so rows with unknown or no labels are scored too."""
    return model.stages[2].transform(model.stages[1].transform(df))


def score_transactions(model, df: DataFrame, label: str = "category") -> DataFrame:
    """Predicted category, top probability (3 dp) and the correct flag."""
    from pyspark.ml.functions import vector_to_array

    return lr_predict(model, df).withColumns({
        "predicted_category": F.col("pred_lr"),
        "confidence": F.round(F.array_max(vector_to_array("probability")), 3),
        "correct": F.col("pred_lr") == F.col(label)})


def predictions_to_store(scored: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows that :func:`ledger_spark.sources.maintenance.store_predictions` takes."""
    return scored.select(F.col(id_col).alias("id"), F.col("predicted_category").alias("predicted_cat"), "confidence")


def suggest_category(model, new_rows: DataFrame, vocab: list[str], categories: DataFrame | None = None,
                     text_col: str = "description", amount_col: str = "amount") -> DataFrame:
    """Suggestion for new (description, amount) rows of at least three
    characters (B18; shorter ones get no row). The keyword rules answer when
    there is no model or the text is blank; optional name -> id (B17)."""
    from ledger_spark.operators.clean import category_id_by_name, suggestable_input
    from ledger_spark.operators.features import build_features

    new_rows = suggestable_input(new_rows, text_col)
    kw = keyword_classify(text_col)
    if model is None:
        out = new_rows.withColumn("suggested", kw)
    else:
        scored = lr_predict(model, build_features(new_rows, vocab, True, text_col, amount_col))
        blank = F.length(F.trim(text_col)) == 0
        out = scored.withColumn("suggested", F.when(blank, kw).otherwise(F.coalesce("pred_lr", kw)))
        out = out.select(*new_rows.columns, "suggested")
    if categories is not None:
        out = category_id_by_name(out, categories, "suggested", "suggested_category_id")
    return out
