"""Toxicity by subword bags: n-gram vectors, averaged over a text, into a linear softmax, trained jointly in numpy.

A word is a run of letters, digits and bytes of 128 or more, lower-cased and framed by marks; its subwords are its byte
n-grams, hashed to BUCKETS vectors, so a misspelling that training never saw shares most of its vectors with the word. A
passage is any PASSAGE neighbouring words (passages overlap); its bag is the mean of its subword vectors, and the softmax
over that mean gives its toxicity. A text is as toxic as its most toxic passage, so that a few words do not fade in a long
text; training picks that passage in each text by the current model (the text's label is known, the passage's is not).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import save

BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)
PASSAGE = 2
CHUNK = 1 << 18
DIMENSIONS = 8
_CLASS = np.zeros(256, dtype=np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _CLASS[_b] = _b
for _b in range(65, 91):
    _CLASS[_b] = _b + 32


def subwords(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and word number of each subword of raw, and the number of words."""
    b = np.zeros(len(raw) + 2, dtype=np.uint8)
    b[1:-1] = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    inside = b != 0
    word = np.cumsum(inside[1:] & ~inside[:-1])  # at i: the number of words begun up to b[i + 1]
    n_words = int(word[-1]) if len(word) else 0
    x = b.astype(np.uint32)
    buckets, owners = [], []
    h = x[:-1] * np.uint32(16777619) + x[1:]
    fit = inside[1:]
    for n in range(3, max(SIZES) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(16777619) + x[n - 1 :]
        fit = fit[: len(b) - n + 1] if n == 3 else fit[: len(b) - n + 1] & inside[n - 2 : len(b) - 1]
        if n in SIZES:
            at = np.flatnonzero(fit)
            g = h[at]
            g = (g ^ (g >> np.uint32(15))) * np.uint32(2246822519 + 2 * n)
            buckets.append((g ^ (g >> np.uint32(13))) & np.uint32(BUCKETS - 1))
            owners.append(word[at] - 1)
    if not buckets:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), n_words
    return np.concatenate(buckets), np.concatenate(owners), n_words


def chunks(text: str | None) -> Iterator[bytes]:
    """The text in UTF-8, in parts of about CHUNK bytes that end at word ends; each but the first begins with the last
    PASSAGE - 1 words of the one before, so the parts have the passages of the whole text, and no others."""
    raw, at = (text or "").encode(), 0
    if len(raw) > CHUNK:
        inside = np.pad(_CLASS[np.frombuffer(raw, dtype=np.uint8)] != 0, 1)
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        while len(raw) - at > CHUNK:
            i = int(np.searchsorted(ends, at + CHUNK))
            while i < len(ends) and starts[i - PASSAGE + 2] <= at:  # words longer than a part
                i += 1
            if i >= len(ends) - 1:
                break
            yield raw[at : ends[i]]
            at = int(starts[i - PASSAGE + 2])
    yield raw[at:]


def text_words(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each part of the text that has words: buckets, the word of each, number of words."""
    for raw in chunks(text):
        buckets, words, n = subwords(raw)
        if len(buckets):
            yield buckets, words, n


def passage_means(margin: np.ndarray, buckets: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """The mean margin of the subwords of every passage: PASSAGE neighbouring words, or all if there are fewer."""
    sums = np.concatenate([[0.0], np.bincount(words, weights=margin[buckets], minlength=n).cumsum()])
    times = np.concatenate([[0], np.bincount(words, minlength=n).cumsum()])
    length = min(PASSAGE, n)
    return (sums[length:] - sums[:-length]) / np.maximum(times[length:] - times[:-length], 1)


def _frequency_margin(texts: list[str], y: np.ndarray, smooth: float = 3.0) -> np.ndarray:
    """Log ratio of the shares of toxic and clean texts that have a bucket; it picks the passages of the first epoch."""
    held = np.full((2, BUCKETS), smooth, dtype=np.float32)
    for text, label in zip(texts, y.tolist(), strict=True):
        for buckets, _, _ in text_words(text):
            held[label, np.unique(buckets)] += 1
    totals = np.bincount(y, minlength=2) + 2 * smooth
    return np.log(held[1] / totals[1]) - np.log(held[0] / totals[0])


def train(texts: list[str], labels: list[int], epochs: int = 6, seed: int = 0) -> tuple[np.ndarray, float, float]:
    """Joint AdaGrad on vectors, softmax weights and biases; the trained model as one number per bucket, a bias, and the
    margin of a text without words: the mean of the worst passages of the clean texts.

    The softmax is linear in the mean of the vectors, so the difference of its two logits is the mean of each vector's own
    difference; scoring needs only that. Without texts of both labels the model is constant.
    """
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, dtype=np.float32), 9.0 if len(y) and y[0] else -9.0, 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.2, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.array([0.5, -0.5], dtype=np.float32)
    seen = np.full(BUCKETS, 1e-8, dtype=np.float32)
    seen_w, seen_b = np.full_like(weights, 1e-3), np.full_like(bias, 1e-3)
    margin = _frequency_margin(texts, y)
    for epoch in range(epochs):
        for turn, i in enumerate(rng.permutation(len(y))):
            if epoch and turn % 64 == 0:
                margin = vectors @ (weights[:, 1] - weights[:, 0])
            worst, bag, others = -np.inf, None, []
            for buckets, words, n in text_words(texts[i]):
                means = passage_means(margin, buckets, words, n)
                at = int(means.argmax())
                if means[at] > worst:
                    worst, bag = means[at], buckets[(words >= at) & (words < at + PASSAGE)]
                if not y[i]:  # any other passage of a clean text is clean too
                    at = int(rng.integers(len(means)))
                    others.append(buckets[(words >= at) & (words < at + PASSAGE)])
            other = others if len(others) < 2 else [others[int(rng.integers(len(others)))]]
            for bag in [b for b in (bag, *other) if b is not None and len(b)]:
                mean = vectors[bag].mean(axis=0)
                logits = mean @ weights + bias
                p = np.exp(logits - logits.max())
                error = p / p.sum()
                error[y[i]] -= 1
                used, times = np.unique(bag, return_counts=True)
                step = np.outer(times / len(bag), weights @ error).astype(np.float32)
                grad_w = np.outer(mean, error)
                seen[used] += (step**2).mean(axis=1)
                vectors[used] -= 0.15 * step / np.sqrt(seen[used])[:, None]
                seen_w += grad_w**2
                weights -= 0.05 * grad_w / np.sqrt(seen_w)
                seen_b += error**2
                bias -= (0.05 * error / np.sqrt(seen_b)).astype(np.float32)
    margin = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
    clean = [w for t, label in zip(texts, y.tolist(), strict=True) if not label and (w := worst_passage(t, margin)) > -np.inf]
    return margin, float(bias[1] - bias[0]), float(np.mean(clean)) if clean else 0.0


def worst_passage(text: str | None, margin: np.ndarray) -> float:
    return max((float(passage_means(margin, *part).max()) for part in text_words(text)), default=-np.inf)


def text_score(text: str | None, margin: np.ndarray, bias: float, without_words: float = 0.0) -> float:
    """Toxicity, 0 to 1, of a text's most toxic passage; a text without words has that of an average clean text."""
    worst = worst_passage(text, margin)
    worst = without_words if worst == -np.inf else worst
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, worst + bias)))))


def training_rows(docs: DataFrame, labels: DataFrame, name: str, folds: int, held: int, rows_per_class: int, bytes_per_class: int) -> tuple[list, list]:
    """Texts and labels of at most rows_per_class rows of each label outside the held-out fold.

    The rows are those with the smallest hashes of doc_id, so every run takes the same ones; in that order a class ends with
    the row that reaches bytes_per_class. Null texts count as empty; of several rows or labels of a doc_id one text (that of
    least hash) and the largest label count.
    """
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % folds
    known = labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull() & (fold != held)).select("doc_id", F.col(name).alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = docs.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))).alias("x"))
    known = save(known.join(sizes, "doc_id").select("doc_id", "y", "x.hash", "x.bytes"), "labelled")
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * rows_per_class rows, so they fit a window and can be broadcast
    earlier = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = chosen.withColumn("before", F.coalesce(F.sum("bytes").over(earlier), F.lit(0))).where(F.col("before") < bytes_per_class)
    chosen = chosen.select(F.col("doc_id").alias("id"), "y", "hash")
    found = docs.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("hash"))).dropDuplicates(["id"])
    found = found.select("id", F.coalesce("text", F.lit("")).alias("text"), "y").orderBy("id").collect()
    return [r["text"] for r in found], [r["y"] for r in found]


def toxicity_model(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1500, bytes_per_class: int = 32 << 20, folds: int = 5, held: int = 0) -> tuple[np.ndarray, float, float]:
    """The model of at most rows_per_class labelled rows, and about bytes_per_class of text, of each label outside fold `held`."""
    return train(*training_rows(docs.select("doc_id", "text"), labels, "toxic", folds, held, rows_per_class, bytes_per_class))


def toxicity_scores(docs: DataFrame, model: tuple[np.ndarray, float, float], name: str = "score") -> DataFrame:
    """docs with column `name`, computed from the whole text alone. Null and empty texts get the score of a text without
    words; repeated rows get equal scores; a column `name` of docs is replaced, all others are kept."""
    margin, bias, without_words = model
    shared = docs.sparkSession.sparkContext.broadcast(margin)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_score(t, shared.value, bias, without_words) for t in texts], dtype="float64")

    return docs.withColumn(name, F.pandas_udf(run, "double")(F.coalesce("text", F.lit(""))))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a model that never sees the labels of one in five. One row for each row of documents,
    null and empty texts and null doc_ids included (held_out is null for a null doc_id)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity_scores(docs, toxicity_model(docs, labels))
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
