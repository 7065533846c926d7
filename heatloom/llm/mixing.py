"""Sources mixed to target weights along a curriculum.

Each source has a target of words and a weight schedule over the run, a piecewise linear curve. The curve's integral gives
the share of the target that is due by any time; inverting it turns a word's place in the source's stream into a time, and
documents are sorted by the time at which their first word is due.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import save, word_count
from heatloom.tables import in_ranges, running

WEIGHTS = (5, 2, 1)
CAP = 3
#: Relative weight at the start, the middle and the end of the run, for sources of each of WEIGHTS.
CURVES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
ROWS_PER_BUCKET = 4_000


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source of sizes (source, size): source, source_size, rows, place (rank from 0), target.

    Sources by code point, null last, take the weights in turn. All sizes are shared by weight; a target stops at cap times
    its source's size and the excess goes to the others by weight until no target is above its stop. In order of stop per
    weight the stopped sources come first, so running sums find the level (words per weight) of the rest. Ranks and running
    sums go by range partitions, so many sources don't meet in one task. No rows give no sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).withColumn("none", F.col("source").isNull())
    per = running(in_ranges(per, "none", "source"), ["none", "source"], name="place").drop("none")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("weight", weight.cast("long")).withColumn("share", F.col("source_size") / F.col("weight"))
    ranged = in_ranges(per, "share", "place")
    per = running(ranged, ["share", "place"], F.col("source_size"), "earlier_size").join(running(ranged, ["share", "place"], F.col("weight"), "earlier_weight").select("place", "earlier_weight"), "place")
    total, weights_sum = (x or 0 for x in ranged.agg(F.sum("source_size"), F.sum("weight")).first())
    per = per.withColumn("level", (F.lit(total) - F.col("earlier_size") * cap).cast("double") / (F.lit(weights_sum) - F.col("earlier_weight")).cast("double"))
    per = save(per.withColumn("free", F.col("source_size") * cap > F.col("weight") * F.col("level")), "mix-sources")
    level = per.where("free").agg(F.min(F.struct("share", "place", "level"))["level"]).first()[0] or 0.0
    stop = (F.col("source_size") * cap).cast("double")
    return per.select("source", "source_size", "rows", "place", F.least(stop, F.col("weight") * F.lit(level)).alias("target"))


def _curve(place: Column, curves: tuple) -> Column:
    return F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in curves]), F.pmod(place, F.lit(len(curves))).cast("int") + 1)


def due_time(share: Column, levels: Column) -> Column:
    """The time (0 to 1) by which a curve with these levels, at equal distances, has asked for a share of its integral."""
    parts = F.size(levels) - 1
    areas = F.transform(F.sequence(F.lit(1), parts), lambda i: (F.get(levels, i - 1) + F.get(levels, i)) / 2)
    goal = share * F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(True).alias("open"))

    def step(a: Column, x: Column) -> Column:
        passed = a["open"] & (a["sum"] + x <= goal) & (a["i"] + 1 < parts)
        return F.struct(F.when(passed, a["i"] + 1).otherwise(a["i"]).alias("i"), F.when(passed, a["sum"] + x).otherwise(a["sum"]).alias("sum"), passed.alias("open"))

    at = F.aggregate(areas, start, step)
    low, high = F.get(levels, at["i"]), F.get(levels, at["i"] + 1)
    rest = F.greatest(F.lit(0.0), goal - at["sum"])
    inside = F.when(rest == 0, F.lit(0.0)).otherwise(2 * rest / (low + F.sqrt(F.greatest(F.lit(0.0), low * low + 2 * (high - low) * rest))))
    return F.least(F.lit(1.0), (at["i"] + inside) / parts)


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, curves: tuple = CURVES) -> DataFrame:
    """docs (doc_id, source, size, ...) with source_size, target, taken and copies (array of words and time).

    A source's stream is its documents in the order of the MD5 of doc_id and size, repeated; the mix takes the first `target`
    words of it, so that a document is taken a whole number of times except the one at the end. The time of a copy, 0 to 1,
    is its training position: when the curve has asked for the words before it. Documents of size 0 are taken 0 times;
    repeated rows are rows of their own; null sources are one source; an empty table stays empty. Columns of docs named like
    the four new ones are replaced; all others are kept, whatever their names.
    """
    columns = [c for c in docs.columns if c not in ("source_size", "target", "taken", "copies")]
    targets = save(source_targets(docs.select("source", "size"), weights, cap), "mix-targets")
    known = targets.select(F.col("source").alias("of"), "source_size", "target", _curve(F.col("place"), curves).alias("levels"), F.ceil(F.col("rows") / ROWS_PER_BUCKET).alias("parts"))
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")).cast("binary"))
    rows = docs.select(F.struct(*columns).alias("row"), "source", "size", place.alias("order"))
    rows = rows.join(F.broadcast(known) if targets.count() <= 100_000 else known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("parts") / F.lit(2**32)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("before", F.col("before") + F.col("start"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round("target").cast("long") - whole * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    rows = rows.withColumn("taken", whole * F.col("size") + last)
    n = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    indices = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def copy(i: Column) -> Column:
        share = (i * F.col("source_size") + F.col("before")) / F.col("target")
        return F.struct(F.least(F.col("size"), F.col("taken") - i * F.col("size")).alias("words"), due_time(share, F.col("levels")).alias("time"))

    rows = rows.select("row", "source_size", "target", "taken", F.transform(indices, copy).alias("copies"))
    return rows.select(*[F.col("row")[c].alias(c) for c in columns], "source_size", "target", "taken", "copies")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, and the training position (0 to 1) of its first and last copy, sorted
    by the first. A document of which nothing is taken has null positions and comes first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = mixed(save(docs, "mix-sizes"))
    first, last = F.get("copies", F.lit(0))["time"], F.get("copies", F.size("copies") - 1)["time"]
    found = rows.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"), last.alias("last_position"))
    return found.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS VARCHAR)) AS o
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS total FROM p),
l AS (
  SELECT *, CAST(total - coalesce(sum(source_size * 3) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM w
  WINDOW b AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT coalesce((SELECT level FROM l WHERE source_size * 3 > weight * level ORDER BY source_size / weight, place LIMIT 1), 0.0) AS level),
t AS (SELECT l.source, l.source_size, l.place, least(CAST(l.source_size * 3 AS DOUBLE), l.weight * f.level) AS target FROM l, f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (
  SELECT *, CAST(whole * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - earlier)) AS BIGINT) AS taken,
         CASE place % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS l0, CASE place % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS l2
  FROM r),
c AS (SELECT *, CASE WHEN size > 0 THEN CAST(ceil(taken / size) AS BIGINT) ELSE 0 END AS n, (l0 + 1.0::DOUBLE) / 2 AS a0, (1.0::DOUBLE + l2) / 2 AS a1 FROM m),
g AS (
  SELECT *, (CAST(earlier AS DOUBLE) / target) * (a0 + a1) AS goal0, (CAST((n - 1) * source_size + earlier AS DOUBLE) / target) * (a0 + a1) AS goal1 FROM c WHERE n > 0),
p2 AS (
  SELECT *, CASE WHEN a0 <= goal0 THEN goal0 - a0 ELSE goal0 END AS rest0, CASE WHEN a0 <= goal1 THEN goal1 - a0 ELSE goal1 END AS rest1,
         CASE WHEN a0 <= goal0 THEN 1.0 ELSE l0 END::DOUBLE AS low0, CASE WHEN a0 <= goal0 THEN l2 ELSE 1.0 END::DOUBLE AS high0, CASE WHEN a0 <= goal0 THEN 1 ELSE 0 END AS i0,
         CASE WHEN a0 <= goal1 THEN 1.0 ELSE l0 END::DOUBLE AS low1, CASE WHEN a0 <= goal1 THEN l2 ELSE 1.0 END::DOUBLE AS high1, CASE WHEN a0 <= goal1 THEN 1 ELSE 0 END AS i1
  FROM g)
SELECT doc_id, size, source_size, target, taken,
       least(1.0::DOUBLE, (i0 + CASE WHEN rest0 = 0 THEN 0.0::DOUBLE ELSE 2 * rest0 / (low0 + sqrt(greatest(0.0::DOUBLE, low0 * low0 + 2 * (high0 - low0) * rest0))) END) / 2) AS position,
       least(1.0::DOUBLE, (i1 + CASE WHEN rest1 = 0 THEN 0.0::DOUBLE ELSE 2 * rest1 / (low1 + sqrt(greatest(0.0::DOUBLE, low1 * low1 + 2 * (high1 - low1) * rest1))) END) / 2) AS last_position
FROM p2
UNION ALL
SELECT doc_id, size, source_size, target, taken, NULL, NULL FROM c WHERE n = 0
"""
