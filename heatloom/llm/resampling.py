"""Importance resampling towards a target: documents that look like the target are drawn more often.

A document's weight is the sum of an array of gains over the buckets of its features, and its score the weight plus Gumbel noise,
so that the highest scores are a draw without replacement. Scores are sorted into runs, one a partition; slices of the order
that hold the draw merge their pieces of all runs by a tournament tree and stop at the exact count.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import save, table, term_slices
from heatloom.tables import in_ranges, running

#: Longest run of words that is a feature.
LONGEST = 1
#: Buckets of features.
BUCKETS = 10_000
#: Per cent of the eligible documents that are drawn, and the least words of these.
SHARE = 10
LEAST = 20
SEED = "2024"
#: Rows of a slice of the order, about, and of a piece of a run.
SLICE = 1 << 17
PIECE = 1 << 10
#: One row of this many, by the hash of its key, is looked at for the bounds of slices.
SAMPLED = 1 << 9

ROWS = "doc_id long, words long, n_features long, weight long, score long, key long"
PIECES = "slice long, run long, score long, doc_id long, key long, rows array<struct<doc_id: bigint, words: bigint, n_features: bigint, weight: bigint, score: bigint, key: bigint>>"
NAMES = ["doc_id", "words", "n_features", "weight", "score", "key"]


def feature_buckets(text: bytes | None, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features) of a text in slices: all runs of 1 to `longest` words, joined by a space, repeats included."""
    carried: list[bytes] = []
    for words in term_slices(text):
        runs = list(words)
        for n in range(2, longest + 1):
            row = carried[-(n - 1) :] + words  # runs that end in this slice
            runs += [b" ".join(row[i : i + n]) for i in range(len(row) - n + 1)]
        carried = (carried + words)[-(longest - 1) :] if longest > 1 else []
        yield len(words), np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets


def _counts(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), longest, buckets):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket of all texts (text); `buckets` numbers, summed in tasks and then in Spark."""
    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_counts(longest, buckets), "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in target and source, rounded down."""
    s, t, buckets = int(source.sum()), int(target.sum()), len(source)
    ratio = (target + 1.0) * (s + float(buckets)) / ((source + 1.0) * (t + float(buckets)))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """docs (text, ...) with words, n_features and weight, the sum of the gains of its features; other columns are kept."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = np.zeros((len(texts), 3), np.int64)
        for row, text in zip(rows, texts, strict=True):
            for words, found in feature_buckets(text, longest, len(gain)):
                row += (words, len(found), gain[found].sum())
        return pd.DataFrame(rows, columns=["words", "n_features", "weight"])

    found = F.pandas_udf(run, "words long, n_features long, weight long")(F.col("text").cast("binary"))
    return docs.drop("words", "n_features", "weight").withColumn("__found", found).select("*", "__found.*").drop("__found")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel variable that the id and the seed decide, rounded down; null counts as an empty id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share)))


def _rank(score, doc_id, key) -> tuple:
    """Smallest first: highest score, then smallest id, null last, then key."""
    return -score, doc_id is None, doc_id or 0, key


def _order() -> list[Column]:
    return [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("key")]


def _pieces(bounds: list[tuple], piece: int):
    """Rows of a sorted run to pieces of at most `piece` rows, cut at the bounds of slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("score", "doc_id", "key")}
            ranks = list(map(_rank, *columns.values()))
            if not ranks:
                continue
            low, high = bisect_right(bounds, ranks[0]), bisect_right(bounds, ranks[-1])
            cuts = [0, *(bisect_left(ranks, b) for b in bounds[low:high]), len(ranks)]
            starts, slices = [], []
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                new = range(a, b, piece)
                starts += new
                slices += [low + i] * len(new)
            values = pa.StructArray.from_arrays([batch.column(c) for c in NAMES], names=NAMES)
            rows = pa.ListArray.from_arrays(pa.array([*starts, len(ranks)], pa.int32()), values)
            heads = [batch.column(c).take(pa.array(starts)) for c in ("score", "doc_id", "key")]
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), batch.column("run").take(pa.array(starts)), *heads, rows], names=["slice", "run", "score", "doc_id", "key", "rows"])

    return run


class Tournament:
    """A tree of matches between sorted runs: the smallest head wins, and who lost to it on its way up is next.

    Runs join at any time; the tree doubles when its leaves are full. A run without rows has no head and loses every match.
    """

    def __init__(self):
        self.heads: list = [None]
        self.winners = [0, 0]

    def _better(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        return b if x is None or (y is not None and y < x) else a

    def _play(self, node: int) -> None:
        self.winners[node] = self._better(self.winners[2 * node], self.winners[2 * node + 1])

    def enter(self, run: int, head) -> None:
        """Sets the head of a run (None: no rows) and plays its matches again."""
        if run >= len(self.heads):
            size = len(self.heads)
            while size <= run:
                size *= 2
            self.heads += [None] * (size - len(self.heads))
            self.heads[run] = head
            self.winners = [0] * size + list(range(size))
            for node in range(size - 1, 0, -1):
                self._play(node)
            return
        self.heads[run] = head
        node = (len(self.heads) + run) // 2
        while node:
            self._play(node)
            node //= 2

    def winner(self) -> int | None:
        run = self.winners[1]
        return None if self.heads[run] is None else run

    def second(self, run: int):
        """The smallest head that lost to the winner itself, or None."""
        node, best = len(self.heads) + run, None
        while node > 1:
            head = self.heads[self.winners[node ^ 1]]
            if head is not None and (best is None or head < best):
                best = head
            node //= 2
        return best


class _Merge:
    """The merge of one slice's pieces, which come in the order of their heads, so that a run's next piece is there in time."""

    def __init__(self, start: int, draw: int):
        self.rank, self.draw = start, draw
        self.tree, self.numbers, self.queues = Tournament(), {}, []

    def add(self, run, rows: list[dict]) -> None:
        number = self.numbers.setdefault(run, len(self.numbers))
        ranks = [_rank(r["score"], r["doc_id"], r["key"]) for r in rows]
        if number == len(self.queues):
            self.queues.append([])
        self.queues[number].append([0, ranks, rows])
        if len(self.queues[number]) == 1:
            self.tree.enter(number, ranks[0])

    def before(self, limit) -> Iterator[dict]:
        """The merged rows before a limit (None: all), until the draw is complete: as many at a time as the winner leads."""
        while self.rank < self.draw and (run := self.tree.winner()) is not None:
            at, ranks, rows = piece = self.queues[run][0]
            if limit is not None and ranks[at] >= limit:
                return
            ends = [bisect_left(ranks, x, at) for x in (self.tree.second(run), limit) if x is not None]
            end = min([*ends, len(ranks), at + self.draw - self.rank])
            for row in rows[at:end]:
                self.rank += 1
                yield row | {"rank": self.rank}
            piece[0] = end
            if end == len(ranks):
                self.queues[run].pop(0)
            following = self.queues[run][0] if self.queues[run] else None
            self.tree.enter(run, following and following[1][following[0]])


MERGED = pa.schema([(c, pa.int64()) for c in [*NAMES, "rank"]])


def _merge(draw: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, merge, out = None, None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("slice", "start", "run", "score", "doc_id", "key")], batch.column("rows"), strict=True):
                if row[0] != at:
                    if merge:
                        out += merge.before(None)
                    at, merge = row[0], _Merge(row[1], draw)
                if merge.rank < draw:
                    out += merge.before(_rank(*row[3:6]))
                    merge.add(row[2], row[6].as_py())
                if len(out) >= 1 << 14:
                    yield pa.RecordBatch.from_pylist(out, MERGED)
                    out = []
        if merge:
            out += merge.before(None)
        yield pa.RecordBatch.from_pylist(out, MERGED)

    return run


def slice_bounds(eligible: DataFrame, size: int, sampled: int) -> list[tuple]:
    """Every so many-th of the sampled rows in order: a bound for `size` rows, so few even for the largest tables (8 bytes a
    bound and column for 131,072 rows). Where they fall decides who merges what, never the result."""
    order = ["score", "doc_id", "key"]
    rows = eligible.where(F.pmod(F.xxhash64("key"), F.lit(sampled)) == 0).select(order)
    every = running(in_ranges(rows, *order), order, name="place").where(F.col("place") % (size // sampled) == size // sampled - 1)
    return sorted(_rank(*r) for r in every.select(order).collect())


def top_rows(scored: DataFrame, eligible: Column, share: int = SHARE, size: int = SLICE, sampled: int = SAMPLED, piece: int = PIECE) -> DataFrame:
    """scored (ROWS, saved, keys unique) with rank: floor(share x eligible rows / 100) of the eligible rows are drawn, those with
    the highest scores (ties: smaller doc_id, null last, then key), and ranked from 1; the rank of all others is null."""
    rows = scored.where(eligible)
    draw = share * rows.count() // 100
    none = F.lit(None).cast("long").alias("rank")
    if not draw:
        return scored.select(*NAMES, none)
    runs = rows.sortWithinPartitions(*_order()).select(*NAMES, F.spark_partition_id().cast("long").alias("run"))
    pieces = save(runs.mapInArrow(_pieces(slice_bounds(rows, size, sampled), piece), PIECES), "resampling-runs")
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("slice").agg(F.sum(F.size("rows")).alias("n"))  # one row for `size` rows
    starts = starts.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).where(F.col("start") < draw)
    # not by slice alone: Spark would leave that to the join's exchange, which a broadcast at run time turns into local reads
    drawn = pieces.join(starts, "slice").repartition("slice", "start").sortWithinPartitions("slice", *_order())
    drawn = save(drawn.select("slice", "start", "run", "score", "doc_id", "key", "rows").mapInArrow(_merge(draw), f"{ROWS}, rank long"), "resampling-drawn")
    last = drawn.where(F.col("rank") == draw).first()
    same, later = F.col("score") == last["score"], F.col("key") > last["key"]
    if last["doc_id"] is None:
        behind = F.col("doc_id").isNull() & later
    else:
        behind = F.col("doc_id").isNull() | (F.col("doc_id") > last["doc_id"]) | ((F.col("doc_id") == last["doc_id"]) & later)
    rest = scored.where(~eligible | (F.col("score") < last["score"]) | (same & behind))
    return drawn.select(*NAMES, "rank").unionByName(rest.select(*NAMES, none))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED, **slices: int) -> DataFrame:
    """docs (doc_id long, text) as (doc_id, n_features, weight, score, rank) after a draw towards target (text);
    `slices` are the sizes that `top_rows` takes.

    Null and empty texts have no features and weight 0; repeated rows are rows of their own, whose order among equals is that of
    the table; a null doc_id has the noise of an empty id and comes last among equal scores; other columns don't matter. With
    fewer than 100 / share eligible rows, an empty table too, nothing is drawn. An empty target leaves the smoothed shares.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = weighted(docs.select("doc_id", "text"), gain, longest)
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("key", F.monotonically_increasing_id())
    scored = save(rows.select(*NAMES), "resampling-scores")
    return top_rows(scored, F.col("words") >= least, share, **slices).select("doc_id", "n_features", "weight", "score", "rank")


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of a tenth towards benchmark; odd rows are as in `resample`."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(0 AS UBIGINT) FOR x IN range(8)]),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END)) AS steps),
dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
d AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM dw) GROUP BY r, word),
b AS (
  SELECT word, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark)
  GROUP BY word),
spelt AS (
  SELECT word, [CAST(('0x' || hex(encode(word))[2 * i - 1 : 2 * i]) AS UBIGINT) FOR i IN range(1, octet_length(encode(word)) + 1)] AS bytes
  FROM (SELECT word FROM d UNION SELECT word FROM b)),
coded AS (
  SELECT word, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), lambda c, x: xor(c // 256, steps[CAST(xor(c, x) % 256 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 10000 AS BIGINT) AS bucket
  FROM spelt, bits),
src AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM d JOIN coded USING (word) GROUP BY bucket),
tgt AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS t FROM b JOIN coded USING (word) GROUP BY bucket),
tot AS (SELECT CAST(coalesce((SELECT sum(s) FROM src), 0) AS DOUBLE) AS s, CAST(coalesce((SELECT sum(t) FROM tgt), 0) AS DOUBLE) AS t),
gain AS (
  SELECT src.bucket, CAST(floor(1000 * ln((CAST(coalesce(tgt.t, 0) AS DOUBLE) + 1.0) * (tot.s + 10000.0) / ((CAST(src.s AS DOUBLE) + 1.0) * (tot.t + 10000.0)))) AS BIGINT) AS gain
  FROM src LEFT JOIN tgt USING (bucket), tot),
w AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM d JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY r),
h AS (
  SELECT dw.r, dw.doc_id, coalesce(w.n_features, 0) AS n_features, coalesce(w.weight, 0) AS weight,
         coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || sha256('2024:' || coalesce(CAST(dw.doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM dw LEFT JOIN w USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, 10 * count(*) OVER () // 100 AS draw FROM h WHERE n_features >= 20)
SELECT h.doc_id, h.n_features, h.weight, h.score, CASE WHEN o.place <= o.draw THEN CAST(o.place AS BIGINT) END AS rank
FROM h LEFT JOIN o USING (r)
"""
