"""Quality classifier: regularised quadratic discriminant over document statistics.

``document_features`` turns a whole text into a dozen transformed statistics (logs of counts and
ratios) with built-in functions.  ``fit`` needs only per-class sums and sums of products, one
partial aggregate over the labelled rows (two rows reach the driver, whatever the input);
class covariances are shrunk towards the pooled covariance and its diagonal, and their Cholesky
factors are kept in the model.  ``score`` is the logistic of the difference of the two classes' log
densities, each a Mahalanobis distance through the inverse factor, written as arithmetic columns.

Scale: the texts are read once; the features (a hundred bytes a document) are staged and used by
both the fit and the scoring.  No Python runs in tasks and nothing is shuffled but label joins on
doc_id.

Defined results: null or empty text has all ratios zero and is scored like any other; a null
doc_id is never labelled; repeated documents or label rows count as often as they match; label
rows with null quality, or one other than 0 or 1, are ignored; with a class missing the score is the
smoothed share of label 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import staged, text_or_empty
from cadenza.llm.quality_rules import words_of
from cadenza.session import Stages

THRESHOLD = 0.7
SHRINK_CLASS = 0.1     # towards the pooled covariance
SHRINK_DIAGONAL = 0.05  # of the pooled covariance towards its diagonal
RIDGE = 1e-3
FIT_ROWS = 50_000      # labelled rows that the pipeline's model is fitted on

FEATURES = ["log_words", "word_length", "distinct", "repeated", "upper", "symbols", "bangs",
            "digits", "stops", "bars", "other", "dup_lines"]


def document_features(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id and the FEATURES, one row per row of ``docs``; ``row`` comes along as ``_row``."""
    row = F.lit(None).cast("int") if row is None else row

    def kept(pattern: str) -> Column:
        return F.length(F.regexp_replace("t", pattern, "")).cast("double")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"),
                       row.alias("_row"))
    rows = rows.select(
        "doc_id", "_row", F.length("t").cast("double").alias("chars"),
        words_of(F.lower("t")).alias("words"), F.split("t", "\n").alias("lines"),
        kept(r"[^\p{Lu}]+").alias("upper"),
        kept(r"[^#*$%&<>@=~^_\\/{}\[\]+]+").alias("symbols"), kept(r"[^!?]+").alias("bangs"),
        kept(r"[^\p{Nd}]+").alias("digits"), kept(r"[^.,;:]+").alias("stops"),
        kept(r"[^|]+").alias("bars"),
        kept(r"[\p{L}\p{Nd}\s.,;:!?|#*$%&<>@=~^_\\/{}\[\]+'\-]+").alias("other"))
    n = F.greatest(F.size("words"), F.lit(1)).cast("double")
    rows = rows.select(
        "*", n.alias("n"), F.size(F.array_distinct("words")).cast("double").alias("kinds"),
        F.size(F.filter(F.col("words"), lambda w, i: w == F.get(F.col("words"), i - 1)))
        .cast("double").alias("same"),
        F.length(F.array_join("words", "")).cast("double").alias("letters"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("double").alias("dups"),
        F.size("lines").cast("double").alias("n_lines"))

    def rate(name: str, of: str) -> Column:
        return F.log(F.col(name) / F.greatest(F.col(of), F.lit(1.0)) + F.lit(2e-3))

    return rows.select(
        "doc_id", "_row", F.log1p(F.size("words")).alias("log_words"),
        F.log1p(F.col("letters") / F.col("n")).alias("word_length"),
        # Heaps-like: distinct words against the square root of words
        (F.log(F.col("kinds") + 1) - 0.75 * F.log(F.col("n") + 1)).alias("distinct"),
        rate("same", "n").alias("repeated"), rate("upper", "chars").alias("upper"),
        rate("symbols", "chars").alias("symbols"), rate("bangs", "chars").alias("bangs"),
        rate("digits", "chars").alias("digits"), rate("stops", "chars").alias("stops"),
        rate("bars", "chars").alias("bars"), rate("other", "chars").alias("other"),
        rate("dups", "n_lines").alias("dup_lines"))


@dataclass
class Model:
    """Class means, inverse Cholesky factors of the covariances, log prior and determinant."""

    mean: list
    inverse: list
    constant: list
    share: float


def fit(features: DataFrame, labels: DataFrame, label: str = "quality",
        shrink_class: float = SHRINK_CLASS, shrink_diagonal: float = SHRINK_DIAGONAL) -> Model:
    """``labels``: doc_id and the 0/1 ``label``; training rows are the matching documents."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    rows = features.join(marks, "doc_id")
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    got = rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs],
    ).collect()  # two rows of sums
    by = {r["y"]: r for r in got}
    count = {y: by[y]["n"] if y in by else 0 for y in (0, 1)}
    share = (count[1] + 1) / (count[0] + count[1] + 2)
    if min(count.values()) < 2:
        return Model([], [], [], share)
    mean, cov = {}, {}
    for y in (0, 1):
        m = np.array([by[y][f"s{i}"] for i in range(d)]) / count[y]
        c = np.zeros((d, d))
        for i, j in pairs:
            c[i, j] = c[j, i] = by[y][f"p{i}_{j}"] / count[y] - m[i] * m[j]
        mean[y], cov[y] = m, c
    pooled = (count[0] * cov[0] + count[1] * cov[1]) / (count[0] + count[1])
    pooled = (1 - shrink_diagonal) * pooled + shrink_diagonal * np.diag(np.diag(pooled))
    model = Model([], [], [], share)
    for y in (0, 1):
        s = (1 - shrink_class) * cov[y] + shrink_class * pooled + RIDGE * np.eye(d)
        factor = np.linalg.cholesky(s)
        model.mean.append(mean[y].tolist())
        model.inverse.append(np.linalg.inv(factor).tolist())
        prior = share if y else 1 - share
        model.constant.append(float(np.log(prior) - np.log(np.diag(factor)).sum()))
    return model


def score(model: Model) -> Column:
    """Probability of label 1 over the FEATURES columns."""
    if not model.mean:
        return F.lit(float(model.share))
    logs = []
    for mean, inverse, constant in zip(model.mean, model.inverse, model.constant, strict=True):
        x = [F.col(f) - F.lit(m) for f, m in zip(FEATURES, mean, strict=True)]
        squares = F.lit(0.0)
        for i, row in enumerate(inverse):
            z = sum((x[j] * F.lit(row[j]) for j in range(1, i + 1)), x[0] * F.lit(row[0]))
            squares = squares + z * z
        logs.append(F.lit(constant) - squares / 2)
    gap = F.greatest(F.least(logs[1] - logs[0], F.lit(500.0)), F.lit(-500.0))
    return 1 / (1 + F.exp(-gap))


def held_out(fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; the model never sees labels of held-out rows."""
    features = staged(document_features(docs).drop("_row"), "features")
    model = fit(features, labels.filter(~held_out()))
    return features.select("doc_id", held_out().alias("held_out"), score(model).alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of at most ``rows`` labelled documents, those with the smallest hashes; features
    are computed for their texts only."""
    some = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality").orderBy(
        F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    some = staged(some, "fit")
    own = docs.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")  # by its bound
    return fit(staged(document_features(own).drop("_row"), "features"), some)


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` (all columns) that the classifier, fitted on their labels, accepts.

    Texts are not staged: the features of a row are computed while it passes."""
    names = docs.columns
    with Stages() as scratch:
        model = fit_documents(docs, labels.filter(~held_out()))
        scratch.release()
    rows = document_features(docs, F.struct(*[F.col(c) for c in names]))
    # a column that depends on the row's place keeps the filter above the features: pushed below
    # them it would compute each one many times
    here = F.when(F.monotonically_increasing_id() >= 0, score(model))
    return rows.select("_row", here.alias("_score")).filter(F.col("_score") >= threshold).select(
        *[F.col("_row")[c].alias(c) for c in names])
