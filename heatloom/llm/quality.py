"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text becomes STATISTICS numbers, transformed so that they spread evenly. Spark sums them and their products over all
labelled rows of each class; from the sums come class means and covariances, the latter shrunk towards the diagonal of the
pooled covariance. The score compares the two log densities, each from the Mahalanobis length by a Cholesky factor that is
computed once and sent to the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import save

#: Byte classes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sentence marks, 6 further marks of prose, 7 non-ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
for _class, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\f\r", ".,", ";:'\"!?()-"), start=1):
    _CLASS[[ord(c) for c in _chars]] = _class
_CLASS[128:] = 7
_LINE = re.compile(r"\n+")
PART = 1 << 20

STATISTICS = ("words", "word_length", "word_spread", "distinct", "repeated", "upper", "digits", "commas", "marks", "symbols", "line_words", "repeated_lines", "packed")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; a text without words has zeros for what words give."""
    raw = (text or "").encode()
    counts, packed = np.zeros(8), 0
    for i in range(0, len(raw), PART):
        part = raw[i : i + PART]
        counts += np.bincount(_CLASS[np.frombuffer(part, dtype=np.uint8)], minlength=8)
        packed += len(zlib.compress(part, 1))
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    lines = [x for x in _LINE.split(text.strip())]
    size, letters = len(raw), counts[1] + counts[2] + counts[7]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    share = lambda x: float(np.log(x + 1e-3))
    return [
        float(np.log1p(n)),
        float(np.log(lengths.mean())),
        float(np.log1p(lengths.std())),
        float(np.log(len(set(words))) - 0.75 * np.log(n)),
        share(again),
        share(counts[2] / max(letters, 1)),
        share(counts[3] / size),
        share(counts[5] / size),
        share(counts[6] / size),
        share(counts[0] / size),
        float(np.log1p(n / len(lines))),
        share(1 - len(set(lines)) / len(lines)),
        float(np.log(packed / size) + 0.08 * np.log(size)),
    ]


def with_statistics(docs: DataFrame, name: str = "statistics") -> DataFrame:
    """docs (text, ...) with the statistics of each whole text; a null text counts as empty, repeated rows have equal ones.
    A column `name` of docs is replaced, all others are kept."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    return docs.withColumn(name, F.pandas_udf(run, "array<double>")(F.coalesce("text", F.lit(""))))


def fit(labelled: DataFrame, shrinkage: float = 0.15) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
    """For labels 0 and 1: log prior, mean, inverse Cholesky factor, half log determinant.

    labelled has y (0 or 1) and statistics. All its rows count; only the sums reach the driver. A class without rows takes
    the other's moments and a prior of one row, so the score stays defined.
    """
    d = len(STATISTICS)
    x = [F.get("statistics", F.lit(i)) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = labelled.groupBy("y").agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p")).collect()
    moments = {}
    for r in sums:
        n, mean = r["n"], np.array(r["s"]) / r["n"]
        products = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["p"], strict=True):
            products[i, j] = products[j, i] = v / n
        moments[int(r["y"])] = (n, mean, products - np.outer(mean, mean))
    total = sum(m[0] for m in moments.values())
    pooled = sum((m[0] * m[2] for m in moments.values()), np.zeros((d, d))) / max(total, 1)
    target = np.diag(np.maximum(np.diag(pooled), 1e-4))
    spare = next(iter(moments.values()), (1, np.zeros(d), np.eye(d)))
    model = []
    for y in (0, 1):
        n, mean, covariance = moments.get(y, (1, *spare[1:]))
        factor = np.linalg.cholesky((1 - shrinkage) * covariance + shrinkage * target)
        model.append((float(np.log(n / max(total, 1))), mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return model


def discriminant(statistics: np.ndarray, model: list) -> np.ndarray:
    """Log density with prior of label 1 less that of label 0, for each row."""
    sides = []
    for prior, mean, inverse, half_log_det in model:
        z = (statistics - mean) @ inverse.T
        sides.append(prior - half_log_det - 0.5 * (z * z).sum(axis=1))
    return sides[1] - sides[0]


def quality_scores(rows: DataFrame, model: list, statistics_name: str = "statistics", name: str = "score") -> DataFrame:
    """rows with column `name`, 0 to 1, higher for label 1; it replaces a column of that name. Repeated rows, and empty and
    null texts (whose statistics are zeros), are scored like any other."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            x = np.array(values.tolist()).reshape(len(values), len(STATISTICS))
            yield pd.Series(1 / (1 + np.exp(-np.clip(discriminant(x, model), -30, 30))))

    return rows.withColumn(name, F.pandas_udf(run, "double")(statistics_name))


def training_labels(labels: DataFrame, folds: int, held: int) -> DataFrame:
    """doc_id and y of usable labels outside fold `held`: 0 or 1, for a doc_id that is not null; of several the largest."""
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % folds
    return labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != held)).groupBy("doc_id").agg(F.max("quality").alias("y"))


def quality_model(rows: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, statistics_name: str = "statistics") -> list:
    """The model of all labelled rows of rows (doc_id, statistics) outside fold `held`."""
    rows = rows.select("doc_id", F.col(statistics_name).alias("statistics"))
    return fit(rows.join(training_labels(labels, folds, held), "doc_id"))


def quality_rows(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text); labels (doc_id, quality) of fold `held` are not used.

    Null texts and repeated rows are rows like others, further columns are ignored, and an empty table gives no rows.
    """
    rows = save(with_statistics(docs.select("doc_id", "text")).select("doc_id", "statistics"), "statistics")
    return quality_scores(rows, quality_model(rows, labels, folds, held)).select("doc_id", "score")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, by a model that never sees the labels of one in four. One row for each row of documents,
    null and empty texts and null doc_ids included (held_out is null for a null doc_id)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2
    return quality_rows(docs, labels).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
