"""The single-file archive's layout: order, offsets, header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions import geo
from heatloom.tables import in_ranges, running


def with_tile_id(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("tile_id", geo.tile_id(F.col("z"), F.col("x"), F.col("y")))


def archive_order(tiles: DataFrame) -> DataFrame:
    """Tiles in archive order: range partitions, sorted."""
    return with_tile_id(tiles).repartitionByRange("tile_id").sortWithinPartitions("tile_id")


def archive_offsets(blobs: DataFrame) -> DataFrame:
    """z, x, y, tile_id, length, offset of blobs (z, x, y, length) written in tile_id order, summed over range partitions."""
    rows = in_ranges(with_tile_id(blobs).select("z", "x", "y", "tile_id", "length"), "tile_id")
    return running(rows, ["tile_id"], F.col("length"), "offset").select("z", "x", "y", "tile_id", "length", "offset")


def archive_header(tiles: DataFrame, tracks: DataFrame, *by: str) -> DataFrame:
    """One row (of each group of tiles): zooms, bounds and centre in 1e-7 degrees (the whole world without tracks)."""
    zooms = tiles.groupBy(*by).agg(F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.count("*").alias("tile_count"))
    whole = {"min_lat": -90, "min_lon": -180, "max_lat": 90, "max_lon": 180}
    e7 = [F.coalesce((f(c) * 1e7).cast("long"), F.lit(whole[c] * 10_000_000)).alias(f"{c}_e7") for c, f in (("min_lat", F.min), ("min_lon", F.min), ("max_lat", F.max), ("max_lon", F.max))]
    half = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    head = zooms.join(F.broadcast(tracks.agg(*e7)))
    return head.withColumns({"center_lat_e7": half("min_lat_e7", "max_lat_e7"), "center_lon_e7": half("min_lon_e7", "max_lon_e7"), "center_zoom": half("min_zoom", "max_zoom")})


def export_archive(tiles: DataFrame) -> DataFrame:
    """Manifest of one style's tiles (z, x, y, data): tile_id, length, sha256 and offset; equal images share an offset."""
    rows = with_tile_id(tiles).withColumn("length", F.length("data").cast("long")).withColumn("sha256", F.sha2("data", 256)).drop("data")
    firsts = rows.groupBy("sha256").agg(F.min_by(F.struct("z", "x", "y", "length"), "tile_id").alias("t")).select("sha256", "t.*")
    placed = archive_offsets(firsts.select("z", "x", "y", "length")).select("z", "x", "y", "offset").join(firsts, ["z", "x", "y"])
    return rows.join(placed.select("sha256", "offset"), "sha256").select("z", "x", "y", "tile_id", "length", "sha256", "offset")


def shared_offsets(tiles: DataFrame) -> DataFrame:
    """The tiles of (style, z, x, y, tile_id, sha256, length) that are the first of their style with an image, with its offset.

    Images follow each other in the order of tile_id, with a byte between them, counted from each style's first.
    """
    firsts = tiles.groupBy("style", "sha256").agg(F.min_by(F.struct("z", "x", "y", "tile_id", "length"), "tile_id").alias("t")).select("style", "sha256", "t.*")
    summed = running(in_ranges(firsts, "style", "tile_id"), ["style", "tile_id"], F.col("length") + 1)
    starts = summed.groupBy("style").agg(F.min("before").alias("start"))
    return summed.join(starts, "style").withColumn("offset", F.col("before") - F.col("start")).drop("before", "start")


def directory(placed: DataFrame, leaf: int) -> DataFrame:
    """style, leaf, tile_id, run_length, offset, length: each run of tiles with consecutive ids and one offset, `leaf` to a leaf.

    placed: style, tile_id, offset, length. A run starts where no tile with the id before has the same offset; the starts are
    numbered over range partitions, so neither a long run nor an image that most tiles share meets in one task.
    """
    before = placed.select("style", (F.col("tile_id") + 1).alias("tile_id"), F.col("offset").alias("last"))
    rows = placed.join(before, ["style", "tile_id"], "left").withColumn("starts", (~F.col("offset").eqNullSafe(F.col("last"))).cast("int"))
    rows = in_ranges(rows.select("style", "tile_id", "offset", "length", "starts"), "style", "tile_id")
    rows = running(rows, ["style", "tile_id"], F.col("starts"), "number").withColumn("number", F.col("number") + F.col("starts"))
    runs = rows.groupBy("style", "number").agg(F.min("tile_id").alias("tile_id"), F.count("*").alias("run_length"), F.min("offset").alias("offset"), F.min("length").alias("length"))
    starts = runs.groupBy("style").agg(F.min("number").alias("first"))
    place = F.floor((F.col("number") - F.col("first")) / leaf).cast("long")
    return runs.join(starts, "style").select("style", place.alias("leaf"), "tile_id", "run_length", "offset", "length")
