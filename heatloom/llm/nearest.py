"""Nearest neighbours by score-aware quantisation.

The nearest vector by Euclidean distance is the one with the largest inner product less half its squared length, so search
is maximum inner product search with an exact length term. Vectors are cut into two-dimensional parts with 16 centroids
each (four bits). Codes and centroids minimise an anisotropic loss (Guo et al., 2020): the residual along the vector weighs
ETA times the residual across it, because only the former moves the inner products that matter. A query's products with
all centroids form a table for each part; scanning sums table entries by code. The scores and the stored length of each
vector's residual bound its distance from below; every vector whose bound reaches the nearest found so far is ranked again
by the exact distance, inside the task, so the result is exact however many vectors are nearly equal.

Equal vectors are one index entry with their smallest ids (more are never needed), so copies don't crowd out others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from heatloom.llm.common import save

CENTROIDS = 16
SAMPLE = 4096
#: Best scores of a first block that give the distances to start from.
RERANKED = 300
#: Pairs whose exact distance is taken at once.
CHUNK = 65536
#: Vectors of an index block and of a query block, at 64 dimensions; fewer at more.
BLOCK_ROWS = 8192
QUERY_BLOCK = 256
#: A task scans up to PLACE_BLOCKS index blocks for up to SPLIT_BLOCKS query blocks and keeps the best of each query.
PLACE_BLOCKS = 32
SPLIT_BLOCKS = 8


def eta(dimensions: int, threshold: float = 0.2) -> float:
    """How much more the parallel error weighs, for inner products above `threshold` of unit vectors."""
    return max(1.0, (dimensions - 1) * threshold**2 / (1 - threshold**2))


class Quantizer:
    """Centroids of two-dimensional parts under the anisotropic loss."""

    def __init__(self, dimensions: int):
        self.dimensions, self.parts = dimensions, (dimensions + 1) // 2
        self.extra = eta(dimensions) - 1
        self.centroids = np.zeros((self.parts, CENTROIDS, 2), dtype=np.float64)

    def split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), 2 * self.parts))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), self.parts, 2)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (rows, parts): each part in turn takes the centroid of least loss, the other parts held."""
        v = self.split(x)
        unit = v / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        errors = ((v[:, :, None, :] - self.centroids[None]) ** 2).sum(axis=3)
        along = np.einsum("npd,npcd->npc", unit, v[:, :, None, :] - self.centroids[None])
        codes = errors.argmin(axis=2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(rounds):
            for p in range(self.parts):
                rest = total - along[rows, p, codes[:, p]]
                codes[:, p] = (errors[:, p] + self.extra * (rest[:, None] + along[:, p]) ** 2).argmin(axis=1)
                total = rest + along[rows, p, codes[:, p]]
        return codes.astype(np.uint8)

    def fit(self, x: np.ndarray, rounds: int = 8, seed: int = 0) -> Quantizer:
        """Alternates codes and centroids; the centroid of a cell solves a 2 x 2 weighted least-squares problem."""
        rng = np.random.default_rng(seed)
        v = self.split(x)
        self.centroids = v[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)].transpose(1, 0, 2).copy()
        unit = v / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        for _ in range(rounds):
            codes = self.encode(x, rounds=1)
            for p in range(self.parts):
                coded = np.stack([self.centroids[q][codes[:, q]] for q in range(self.parts)], axis=1)
                rest = (unit * (v - coded)).sum(axis=(1, 2)) - (unit[:, p] * (v[:, p] - coded[:, p])).sum(axis=1)
                goal = rest + (unit[:, p] * v[:, p]).sum(axis=1)
                for c in range(CENTROIDS):
                    at = codes[:, p] == c
                    if at.any():
                        u = unit[at, p]
                        left = at.sum() * np.eye(2) + self.extra * u.T @ u
                        self.centroids[p, c] = np.linalg.solve(left, v[at, p].sum(axis=0) + self.extra * (goal[at, None] * u).sum(axis=0))
        return self

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, parts, CENTROIDS): inner products of each part with each centroid."""
        return np.einsum("qpd,pcd->qpc", self.split(queries), self.centroids).astype(np.float32)


def scan(tables: np.ndarray, packed: np.ndarray, half_squares: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, rows) of a block."""
    codes = np.empty((packed.shape[0], packed.shape[1] * 2), dtype=np.uint8)
    codes[:, ::2], codes[:, 1::2] = packed & 15, packed >> 4
    scores = np.repeat(-half_squares[None].astype(np.float32), len(tables), axis=0)
    for p in range(tables.shape[1]):
        scores += tables[:, p][:, codes[:, p]]
    return scores


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _sized(rows: int, dimensions: int) -> int:
    return max(16, rows * 64 // max(64, dimensions))


def _blocks(quantizer: Quantizer, kind: str):
    size = _sized(BLOCK_ROWS, quantizer.dimensions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), size):
                part = batch.iloc[i : i + size]
                x = np.stack(part["vector"].to_numpy()).astype(np.float64)
                codes = quantizer.encode(x)
                decoded = np.stack([quantizer.centroids[p][codes[:, p]] for p in range(quantizer.parts)], axis=1)
                residuals = np.sqrt(((quantizer.split(x) - decoded) ** 2).sum(axis=(1, 2)))
                squares = (decoded**2).sum(axis=(1, 2))
                if codes.shape[1] % 2:
                    codes = np.pad(codes, ((0, 0), (0, 1)))
                packed = codes[:, ::2] | codes[:, 1::2] << 4
                half = (0.5 * (x * x).sum(axis=1)).astype(np.float32)  # beyond float32: infinite, and the bound says nothing
                rep = part["rep"].to_numpy().astype("<i8")
                yield pd.DataFrame({"reps": [rep.tobytes()], "codes": [packed.tobytes()], "halves": [half.tobytes()], "rows": [len(part)], "vectors": [x.astype(kind).tobytes()], "squares": [squares.tobytes()], "residuals": [residuals.tobytes()]})

    return run


class _Best:
    """The nearest rows so far of each query of a block, by exact squared distance."""

    def __init__(self, quantizer: Quantizer, asked: np.ndarray, vectors: list, keep: int, reranked: int):
        self.asked, self.keep, self.reranked = asked, keep, reranked
        self.queries = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
        self.own = (self.queries**2).sum(axis=1)
        self.tables = quantizer.tables(self.queries)
        if self.tables.shape[1] % 2:
            self.tables = np.pad(self.tables, ((0, 0), (0, 1), (0, 0)))
        self.at, self.reps, self.found = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        self.worst = np.full(len(asked), np.inf)

    def add(self, reps: np.ndarray, packed: np.ndarray, halves: np.ndarray, vectors: np.ndarray, squares: np.ndarray, residuals: np.ndarray) -> None:
        scores = scan(self.tables, packed, halves)
        left = np.ones(scores.shape, dtype=bool)
        if np.isinf(self.worst).any() and self.reranked < scores.shape[1]:  # distances to start from
            top = np.argpartition(-scores, self.reranked - 1, axis=1)[:, : self.reranked]
            self._rank(np.repeat(np.arange(len(top)), top.shape[1]), top.ravel(), reps, vectors)
            np.put_along_axis(left, top, False, axis=1)
        lengths = 2.0 * halves
        for i in range(len(left)):
            rounding = 1e-5 * (self.own[i] + lengths)
            bound = np.sqrt(np.maximum(self.own[i] - 2.0 * scores[i] + squares - lengths - rounding, 0)) - residuals
            left[i] &= ~(bound > np.sqrt(self.worst[i]) * (1 + 1e-9))  # a bound that overflowed says nothing: rank the row
        self._rank(*np.nonzero(left), reps, vectors)

    def _rank(self, at: np.ndarray, rows: np.ndarray, reps: np.ndarray, vectors: np.ndarray) -> None:
        for i in range(0, len(at), CHUNK):
            q, r = at[i : i + CHUNK], rows[i : i + CHUNK]
            d = ((self.queries[q] - vectors[r].astype(np.float64)) ** 2).sum(axis=1)
            near = d <= self.worst[q]
            at_, reps_, found = np.concatenate([self.at, q[near]]), np.concatenate([self.reps, reps[r[near]]]), np.concatenate([self.found, d[near]])
            order = np.lexsort((reps_, found, at_))
            at_, reps_, found = at_[order], reps_[order], found[order]
            n = np.arange(len(at_)) - np.searchsorted(at_, at_)
            self.at, self.reps, self.found = at_[n < self.keep], reps_[n < self.keep], found[n < self.keep]
            full = n == self.keep - 1
            self.worst[at_[full]] = found[full]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query": self.asked[self.at], "rep": self.reps, "square": self.found})


def _scans(quantizer: Quantizer, keep: int, reranked: int, kind: str):
    def run(groups: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.empty(0, np.int64), "rep": np.empty(0, np.int64), "square": np.empty(0)})]
        for g in groups.itertuples():
            best = _Best(quantizer, np.asarray(g.query_reps, dtype=np.int64), g.query_vectors, keep, reranked)
            for r in blocks.itertuples():
                codes, vectors = np.frombuffer(r.codes, dtype=np.uint8).reshape(r.rows, -1), np.frombuffer(r.vectors, dtype=kind).reshape(r.rows, -1)
                best.add(np.frombuffer(r.reps, dtype="<i8"), codes, np.frombuffer(r.halves, dtype=np.float32), vectors, np.frombuffer(r.squares), np.frombuffer(r.residuals))
            out.append(best.rows())
        return pd.concat(out)

    return run


def distance(x: Column, y: Column) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def nearest(vectors: DataFrame, queries: Column, k: int = 10, reranked: int = RERANKED, sample: int = SAMPLE) -> DataFrame:
    """The k nearest rows of vectors (vec_id, embedding) to each row for which `queries` holds: query_id, rank, vec_id, score.

    Rows with a null vec_id, an unusable vector, or another number of components than most take no part. The quantizer is
    fitted on at most `sample` vectors (smallest hashes of vec_id); every usable vector is indexed and scanned. Queries go
    in blocks of QUERY_BLOCK, against groups of index blocks. Rows with equal vec_id and vector count once; ties
    in distance go to the smaller vec_id. Float and double columns are ranked in double precision; a distance that
    overflows is infinite. A vec_id with several vectors asks, and is found, with each of them.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda x: x + F.lit(0).cast("float")).alias("vector"), queries.alias("asked"))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], out)
    rows = rows.where(F.size("vector") == common["d"])
    equal = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.select("vec_id", "vector").dropDuplicates(["vec_id", "vector"]).withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1)
    index = save(few.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-index")
    asked = rows.where("asked").select(F.col("vec_id").alias("query_id"), "vector").distinct()
    asked = save(asked.join(index.select("vector", F.col("rep").alias("query")), "vector"), "ann-queries")

    chosen = index.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("vector").collect()
    kind = "<f4" if rows.schema["vector"].dataType.elementType == T.FloatType() else "<f8"  # blocks keep the column's precision
    quantizer = Quantizer(common["d"]).fit(np.array([r["vector"] for r in chosen], dtype=np.float64))
    blocks = index.select("rep", "vector").mapInPandas(_blocks(quantizer, kind), "reps binary, codes binary, halves binary, rows int, vectors binary, squares binary, residuals binary")
    distinct = asked.select("query", "vector").dropDuplicates(["query"])
    n_blocks = max(1, -(-distinct.count() // _sized(QUERY_BLOCK, common["d"])))
    places, splits = max(1, -(-index.count() // (PLACE_BLOCKS * _sized(BLOCK_ROWS, common["d"])))), -(-n_blocks // SPLIT_BLOCKS)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    groups = distinct.groupBy(F.pmod(F.xxhash64("query"), F.lit(n_blocks)).alias("block")).agg(F.collect_list("query").alias("query_reps"), F.collect_list("vector").alias("query_vectors"))
    groups = groups.withColumn("split", F.pmod("block", F.lit(splits))).withColumn("place", each(places)).drop("block")
    blocks = blocks.withColumn("place", F.pmod(F.xxhash64("reps"), F.lit(places))).withColumn("split", each(splits))
    # All blocks of a place meet a split's queries in one task, which keeps the k + 1 nearest (one may be the query).
    tasks, key = min(places * splits, 20_000), ["place", "split"]
    met = groups.repartition(tasks, *key).groupBy(*key).cogroup(blocks.repartition(tasks, *key).groupBy(*key))
    found = met.applyInPandas(_scans(quantizer, k + 1, reranked, kind), "query long, rep long, square double")
    best = Window.partitionBy("query").orderBy("square", "rep")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query", "rep")

    exact = found.join(index, "rep").join(distinct.withColumnRenamed("vector", "query_vector"), "query")
    exact = exact.select("query", "ids", distance(F.col("query_vector"), F.col("vector")).alias("score"))
    near = Window.partitionBy("query").orderBy("score", "vec_id")
    exact = exact.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    exact = asked.select("query_id", "query").join(exact.drop("n"), "query").where(F.col("query_id") != F.col("vec_id"))
    return exact.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors to every hundredth one; null, zero and odd vectors, ties and repeated rows are as in `nearest`, and
    an empty table gives no rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH u AS (
  SELECT DISTINCT vec_id, embedding AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT * FROM u WHERE len(e) = (SELECT len(e) FROM u GROUP BY len(e) ORDER BY count(*) DESC, len(e) LIMIT 1)),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (CAST(q.e[i] AS DOUBLE) - CAST(c.e[i] AS DOUBLE)) * (CAST(q.e[i] AS DOUBLE) - CAST(c.e[i] AS DOUBLE))), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""
