"""Stored pixels of tiles: tracks are added and taken away without reading the points of any other.

A state is a folder of masks (`operators/masks.py`), one row for each track and tile that it hits, in a folder for each batch:
zooms in folders, files in the order of a Hilbert curve. The images of a tile follow from its masks alone, so after a batch only
the tiles that its tracks hit are drawn again, from their stored masks and the new ones.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.functions import geo
from heatloom.operators import masks, render, tracing
from heatloom.tables import new_folder, shuffle_partitions

KEY = ["z", "x", "y"]
STORED = masks.MASKS + ", place long, batch_id long"
#: Ranges of the Hilbert curve that a reader asks for, at most.
RANGES = 64


def track_masks(points: DataFrame, first: int, deepest: int) -> DataFrame:
    """masks.MASKS of all tracks of some points, whole tracks, in every tile of some zooms that they hit.

    Nothing is capped: which tracks a tile shows is decided when it is drawn, as later batches may change it.
    """
    return tracing.track_masks(points, tracing.hits(points, first, deepest))


def write_masks(points: DataFrame, state: str, batch_id: int, first: int = geo.MIN_ZOOM, deepest: int = geo.MAX_ZOOM) -> None:
    """Adds the tracks of a batch to a state; a batch that runs again replaces its own files."""
    place = geo.tile_place(F.col("z"), F.col("x"), F.col("y")).alias("place")
    hits = tracing.hits(points, first, deepest).select(*tracing.NAMES, place)
    # slim hits are dealt to ranges of the curve, and masks follow them: dealing masks would draw them once more for a sample
    hits = hits.repartitionByRange("z", "place", "track_id").withColumn("part", F.spark_partition_id())
    parts = shuffle_partitions(points.sparkSession)
    rows = tracing.track_masks(points, hits).repartitionById(parts, "part").sortWithinPartitions("z", "place", "track_id")
    rows.drop("part").write.mode("overwrite").partitionBy("z").parquet(f"{state}/masks/batch_id={batch_id}")


def curve_ranges(wanted: DataFrame, most: int = RANGES) -> list[tuple[int, int]]:
    """At most `most` ranges (first, last) of places that hold all wanted tiles (z, x, y).

    One pass counts the cells of the curve that wanted tiles touch, at every level; the finest level with at most `most` of
    them gives the ranges, and cells that touch become one. So few numbers reach the driver, whatever is wanted.
    """
    level = geo.MAX_ZOOM
    placed = wanted.select("z", geo.tile_place(F.col("z"), F.col("x"), F.col("y")).alias("place"))
    cell = lambda k: F.call_function("shiftright", "place", F.lit(2 * (level - k)))
    # a tile above level k spans several of its cells; its own zoom is as fine as it needs
    counted = placed.agg(*[F.approx_count_distinct(cell(k)).alias(str(k)) for k in range(level + 1)], F.min("z").alias("top")).first()
    if counted["top"] is None:
        return []
    finest = max([k for k in range(level + 1) if counted[str(k)] <= most // 2] or [0])
    span = F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (level - F.least(F.lit(finest), F.col("z")))).cast("int"))
    start = F.call_function("shiftleft", F.call_function("shiftright", "place", (2 * (level - F.least(F.lit(finest), F.col("z")))).cast("int")), (2 * (level - F.least(F.lit(finest), F.col("z")))).cast("int"))
    cells = sorted((r["a"], r["b"]) for r in placed.select(start.alias("a"), (start + span - 1).alias("b")).distinct().collect())
    joined: list[tuple[int, int]] = []
    for a, b in cells:
        if joined and a <= joined[-1][1] + 1:
            joined[-1] = joined[-1][0], max(b, joined[-1][1])
        else:
            joined.append((a, b))
    return joined


def in_ranges(ranges: list[tuple[int, int]], place: str = "place") -> Column:
    """Whether a place lies in one of the ranges; Parquet skips files and row groups by it."""
    return reduce(or_, [F.col(place).between(a, b) for a, b in ranges], F.lit(False))


def stored_masks(spark: SparkSession, state: str, wanted: DataFrame | None = None) -> DataFrame:
    """The masks of a state without those of removed tracks: all, or of wanted tiles, whose files alone are read."""
    try:
        rows = spark.read.schema(STORED).parquet(f"{state}/masks")
    except AnalysisException:  # nothing stored yet
        return spark.createDataFrame([], STORED)
    if wanted is not None:
        zooms = [r[0] for r in wanted.select("z").distinct().collect()]
        rows = rows.where(F.col("z").isin(zooms) & in_ranges(curve_ranges(wanted))).join(wanted.select(KEY).distinct(), KEY, "left_semi")
    try:
        removed = spark.read.schema("track_id long").parquet(f"{state}/removed")
    except AnalysisException:
        return rows
    return rows.join(removed, "track_id", "left_anti")


def add_tracks(points: DataFrame, state: str, batch_id: int, first: int = geo.MIN_ZOOM, deepest: int = geo.MAX_ZOOM, most: int = 10_000) -> DataFrame:
    """Adds new tracks (their points only) to a state; the images of every tile that they change, equal to those of a full
    drawing of all tracks."""
    spark = points.sparkSession
    write_masks(points, state, batch_id, first, deepest)
    changed = spark.read.schema(STORED).parquet(f"{state}/masks").where(F.col("batch_id") == batch_id).select(KEY).distinct()
    return render.images(stored_masks(spark, state, changed), most, data_only=True)


def remove_tracks(spark: SparkSession, track_ids: DataFrame, state: str, batch_id: int, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Takes tracks (track_id) out of a state. Returns the images of the tiles that this changes, and the changed tiles
    (z, x, y) that no longer have one. Rows of removed tracks stay in the files until `compact`."""
    track_ids.select("track_id").distinct().write.mode("overwrite").parquet(f"{state}/removed/batch_id={batch_id}")
    gone = spark.read.schema("track_id long").parquet(f"{state}/removed/batch_id={batch_id}")
    changed = spark.read.schema(STORED).parquet(f"{state}/masks").join(gone, "track_id", "left_semi").select(KEY).distinct()
    drawn = render.images(stored_masks(spark, state, changed), most, data_only=True)
    return drawn, changed.join(drawn.select(KEY).distinct(), KEY, "left_anti")


def compact(spark: SparkSession, state: str, into: str) -> None:
    """A state of one batch, without removed tracks, in a new folder."""
    rows = stored_masks(spark, state).drop("batch_id").repartitionByRange("z", "place", "track_id").sortWithinPartitions("z", "place", "track_id")
    rows.write.mode("overwrite").partitionBy("z").parquet(f"{into}/masks/batch_id=0")


def drawn_in_steps(points: DataFrame, first: int, deepest: int, later: Column) -> DataFrame:
    """style, z, x, y, tracks, data of all tiles: those of the other tracks first, then the tracks of `later` added to them."""
    spark, state = points.sparkSession, new_folder(points.sparkSession, "pixels")
    write_masks(points.where(~later), state, 0, first, deepest)
    before = render.images(stored_masks(spark, state), data_only=True)
    before.write.parquet(f"{state}/images/batch_id=0")
    add_tracks(points.where(later), state, 1, first, deepest).write.parquet(f"{state}/images/batch_id=1")
    drawn = spark.read.parquet(f"{state}/images")
    newer = drawn.where("batch_id = 1")
    return drawn.where("batch_id = 0").join(newer.select("style", *KEY), ["style", *KEY], "left_anti").unionByName(newer).drop("batch_id")
