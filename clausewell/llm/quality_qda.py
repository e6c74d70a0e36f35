"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Class means and covariances come from one aggregation over the labelled rows; the covariances are shrunk towards
their pooled form and a ridge, factored once by Cholesky, and the inverse factors are kept in the model. A score is
the logistic of the difference of the two log densities, whose Mahalanobis terms are plain column arithmetic.

Defined cases: a null or empty text has zero statistics and is scored like any other; null labels are ignored;
repeated rows count as often as they occur; with no labelled rows, or with one class alone, every score is the
smoothed share of label 1; an empty table gives an empty result; other columns of the input are never read and may
have any name that does not start with ``_cw_``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.llm.common import BLANKS, own

FEATURES = ("words", "word_chars", "symbols", "capitals", "digits", "stops", "distinct", "line_words", "bars", "exclaims", "echoes")


#: Everything but the characters that are counted one by one: a text's marks are a small part of it, and all counts are made there.
UNMARKED = r"[^#*$%&<>~^{}\\=\p{Lu}0-9.,;:?\n|!]+"


def _left(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


def _parts(text: Column) -> dict[str, Column]:
    """The words and the marks of whole texts: two passes of a pattern over each, and no more."""
    return {"_cw_words": F.filter(F.split(own(text), BLANKS), lambda w: w != ""), "_cw_marks": F.regexp_replace(own(text), UNMARKED, "")}


def statistics() -> list[Column]:
    """Log-transformed statistics of a whole text, in the order of FEATURES, from the columns of ``_parts``."""
    words, marks = F.col("_cw_words"), F.col("_cw_marks")
    echoes = F.filter(F.zip_with(words, F.slice(words, 2, F.size(words) + 1), lambda a, b: a == b), lambda same: same)
    n_words = F.size(words).cast("double")
    chars = F.length(F.array_join(words, "")).cast("double")
    ratio = lambda part, whole: F.log((part + 0.5) / (whole + 5.0))
    symbols = _left(marks, r"[^#*$%&<>~^{}\\=]+").cast("double")
    capitals = _left(marks, r"[^\p{Lu}]+").cast("double")
    digits = _left(marks, r"[^0-9]+").cast("double")
    stops = _left(marks, r"[^.,;:?]+").cast("double")
    lines = _left(marks, r"[^\n]+").cast("double") + 1
    return [
        F.log1p(n_words),
        F.log((chars + 5.0) / (n_words + 1.0)),
        ratio(symbols, chars),
        ratio(capitals, chars),
        ratio(digits, chars),
        ratio(stops, n_words),
        F.log((F.size(F.array_distinct(words)) + 1.0) / (n_words + 1.0)),
        F.log((n_words + 1.0) / lines),
        ratio(_left(marks, r"[^|]+").cast("double"), n_words),
        ratio(_left(marks, r"[^!]+").cast("double"), n_words),
        ratio(F.size(echoes).cast("double"), n_words),
    ]


def with_statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of ``docs`` and one double column per statistic of its text."""
    split = docs.select(*keys, *(c.alias(n) for n, c in _parts(F.col("text")).items()))
    return split.select(*keys, *(c.alias(n) for n, c in zip(FEATURES, statistics(), strict=True)))


@dataclass(frozen=True)
class QuadraticModel:
    """means[c], inverse Cholesky factor[c] and constant[c] of class c; ``share`` alone when a class is missing."""

    means: tuple | None
    factors: tuple | None
    constants: tuple | None
    share: float

    def score(self, prefix: str = "") -> Column:
        """Probability of label 1 over columns named as FEATURES, behind ``prefix``."""
        if self.means is None:
            return F.lit(float(self.share))
        density = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            square = F.lit(0.0)
            for i in range(len(FEATURES)):
                z = F.lit(0.0)
                for j in range(i + 1):
                    z = z + F.lit(float(factor[i][j])) * (F.col(prefix + FEATURES[j]) - F.lit(float(mean[j])))
                square = square + z * z
            density.append(F.lit(float(constant)) - square / 2)
        return 1.0 / (1.0 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), density[0] - density[1]))))


def fit(rows: DataFrame, label: str, shrink: float = 0.2, ridge: float = 1e-3) -> QuadraticModel:
    """Fit on statistics rows with a 0/1 column ``label``; one aggregation, of a fixed number of sums, reaches the driver."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = rows.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("c")).agg(
        F.count("*").alias("n"), *(F.sum(f).alias(f) for f in FEATURES),
        *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs)).collect()
    by = {int(r["c"]): r for r in sums}
    n = [by[c]["n"] if c in by else 0 for c in (0, 1)]
    share = (n[1] + 1) / (sum(n) + 2)
    if min(n) < 2:
        return QuadraticModel(None, None, None, share)
    means, scatters = [], []
    for c in (0, 1):
        mean = np.array([by[c][f] for f in FEATURES]) / n[c]
        second = np.zeros((len(FEATURES),) * 2)
        for i, j in pairs:
            second[i, j] = second[j, i] = by[c][f"p{i}_{j}"] / n[c]
        means.append(mean)
        scatters.append(second - np.outer(mean, mean))
    pooled = (n[0] * scatters[0] + n[1] * scatters[1]) / sum(n)
    factors, constants = [], []
    for c in (0, 1):
        covariance = (1 - shrink) * scatters[c] + shrink * pooled
        covariance = covariance + np.eye(len(FEATURES)) * (ridge + 0.05 * np.trace(pooled) / len(FEATURES))
        lower = np.linalg.cholesky(covariance)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n[c] / sum(n)) - np.log(np.diag(lower)).sum())
    return QuadraticModel(tuple(means), tuple(factors), tuple(constants), share)


def learnt_fold(doc_id: Column) -> Column:
    """True for the rows whose label may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def learnt_labels(labels: DataFrame, most_labelled: int) -> DataFrame:
    """_cw_id and _cw_quality of the learning folds, of at most ``most_labelled`` rows, those with the smallest hash: 16 bytes each, to be broadcast."""
    known = labels.filter(learnt_fold(F.col("doc_id")) & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_cw_id"), F.col("quality").alias("_cw_quality"))
    return F.broadcast(known.orderBy(F.xxhash64("_cw_id"), "_cw_id", "_cw_quality").limit(most_labelled))


def quality_scores(docs: DataFrame, labels: DataFrame, scratch=None, shrink: float = 0.2, most_labelled: int = 1_000_000, task_rows: int = 100_000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``. The statistics of all documents are computed once and
    kept on the executors' disks, where a lost part is computed again; they are scored by about ``task_rows`` rows a task, so
    that few files are made of the result: for each, Hadoop's local file system starts a process, which for a moment counts
    the executor's memory twice."""
    table = with_statistics(docs, ["doc_id"]).persist(StorageLevel.DISK_ONLY)
    rows = table.count()
    model = fit(table.join(learnt_labels(labels, most_labelled), F.col("doc_id") == F.col("_cw_id")), "_cw_quality", shrink)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = table.select("doc_id", held_out.alias("held_out"), model.score().alias("score"))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).coalesce(tasks)


def keep_quality(docs: DataFrame, labels: DataFrame, scratch=None, shrink: float = 0.2, most_labelled: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, unchanged. Texts are scored where they stand and never shuffled; the
    fit computes the statistics of labelled texts alone."""
    rows = docs.select("doc_id", "text").join(learnt_labels(labels, most_labelled), F.col("doc_id") == F.col("_cw_id"))
    model = fit(with_statistics(rows, ["_cw_quality"]), "_cw_quality", shrink)
    found = zip(FEATURES, statistics(), strict=True)
    # a generator of one row keeps the filter from being pushed below the statistics: the score names each of them some
    # twenty times, and the code generated for all these copies takes much memory to compile
    each = F.explode(F.array(F.struct(*(c.alias(f"_cw_{f}") for f, c in found)))).alias("_cw_found")
    wide = docs.withColumns(_parts(F.col("text"))).select("*", each).select(*[F.col(f"`{c}`") for c in docs.columns], "_cw_found.*")
    return wide.filter(model.score("_cw_") >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
