"""Upkeep of the tile set: dirty, stale, missing, complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.operators import tiles as t
from heatloom.schemas import STYLES

KEY = ["z", "x", "y"]


def each_style(tiles: DataFrame) -> DataFrame:
    """Each tile in each style."""
    return tiles.select(F.explode(F.array(*[F.lit(s) for s in STYLES])).alias("style"), *KEY)


def mark_tiles_dirty(new_points: DataFrame, dirty: DataFrame) -> DataFrame:
    return t.data_tiles(new_points).select(KEY).unionByName(dirty.select(KEY)).distinct()


def mark_all_tiles_dirty(points: DataFrame, dirty: DataFrame, exact: bool = True) -> DataFrame:
    """Dirty tiles and those of all points, or of a sample of them."""
    return mark_tiles_dirty(points if exact else t.sample_points(points), dirty)


def clear_dirty(dirty: DataFrame, rendered: DataFrame) -> DataFrame:
    return dirty.join(rendered, KEY, "left_anti")


def stale_tiles(tiles: DataFrame, dirty: DataFrame) -> DataFrame:
    """Tiles of the set, in every style, that are to be drawn again."""
    return tiles.join(dirty, KEY, "left_semi")


def fresh_tiles(tiles: DataFrame, dirty: DataFrame) -> DataFrame:
    return tiles.join(dirty, KEY, "left_anti")


def clear_tiles(tiles: DataFrame, style: str | None = None) -> DataFrame:
    """What stays of a tile set when one style, or everything, is dropped."""
    return tiles.where(F.lit(False)) if style is None else tiles.where(F.col("style") != style)


def missing_tiles(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """style, z, x, y of data tiles that the set lacks."""
    return each_style(t.data_tiles(points)).join(tiles, ["style", *KEY], "left_anti")


def tiles_needing_queue(missing: DataFrame, dirty: DataFrame) -> DataFrame:
    return missing.select(KEY).unionByName(dirty.select(KEY)).distinct()


def check_tiles(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row: data tiles, missing files, tiles with a missing file, and files by the number of styles."""
    lacking = missing_tiles(points, tiles).groupBy(KEY).agg(F.count("*").alias("n"))
    every = t.data_tiles(points).join(lacking, KEY, "left")
    files = F.coalesce(F.sum("n"), F.lit(0))
    return every.agg(F.count("*").alias("total_tiles"), files.alias("missing_files"), F.count("n").alias("missing_tiles"), F.floor(files / len(STYLES)).alias("missing_average"))


def dirty_by_zoom(dirty: DataFrame) -> DataFrame:
    return dirty.groupBy("z").agg(F.count("*").alias("tiles"), (F.count("*") * len(STYLES)).alias("images"), F.count_if(F.col("z") <= 8).alias("heavy"))


def dirty_batch(dirty: DataFrame, n: int = 60) -> DataFrame:
    """The first n dirty tiles."""
    return dirty.orderBy(*KEY).limit(n)


def export_ready(dirty: DataFrame, missing: DataFrame) -> DataFrame:
    """style and status: ok, dirty_remaining or missing_tiles."""
    queued = dirty.agg(F.count("*").alias("queued")).select(F.explode(F.array(*[F.lit(s) for s in STYLES])).alias("style"), "queued")
    lacking = missing.groupBy("style").agg(F.count("*").alias("lacking"))
    status = F.when(F.col("queued") > 0, "dirty_remaining").when(F.col("lacking") > 0, "missing_tiles").otherwise("ok")
    return queued.join(lacking, "style", "left").select("style", status.alias("status"))
