"""Jobs that draw and keep tile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.operators import maintenance, render, tiles, tracks


def by_cell(points: DataFrame) -> DataFrame:
    """Points with their cell, in its order; a cell that holds a large part of all points lies in several partitions."""
    return tiles.with_cell(points).repartitionByRange("cell", "track_id").sortWithinPartitions("cell", "track_id", "seq")


def write_points(points: DataFrame, folder: str, batch_id: int = 0) -> None:
    """Points under <folder>/batch_id=n/cell=c for incremental drawing, which then reads the cells it needs."""
    by_cell(points).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/batch_id={batch_id}")


def laid_out(points: DataFrame) -> DataFrame:
    """Points as they are stored: a track's points in one partition, in order."""
    return points.repartition("track_id").sortWithinPartitions("track_id", "seq")


def write_tracks(points: DataFrame, folder: str, batch_id: int = 0) -> None:
    """Points under <folder>/trackpoints/batch_id=n, and each track's count and bounds under <folder>/tracks/batch_id=n.

    Points without a position are not stored, nor are tracks without any point; a batch that runs again replaces its own.
    """
    valid = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    laid_out(valid).write.mode("overwrite").parquet(f"{folder}/trackpoints/batch_id={batch_id}")
    kept = points.sparkSession.read.parquet(f"{folder}/trackpoints/batch_id={batch_id}")
    tracks.track_bounds(kept).write.mode("overwrite").parquet(f"{folder}/tracks/batch_id={batch_id}")


def write_tiles(images: DataFrame, folder: str, batch_id: int = 0) -> None:
    """Images under <folder>/batch_id=n/style=s/z=n; a batch that runs again replaces its own files."""
    images.write.mode("overwrite").partitionBy("style", "z").parquet(f"{folder}/batch_id={batch_id}")


def incremental(points: DataFrame, kept: DataFrame, dirty: DataFrame, first: int, deepest: int) -> DataFrame:
    """style, z, x, y, state of the tile set after the dirty tiles are drawn again: kept or drawn.

    points may be a table of `write_points`; then only files that the dirty tiles need are read.
    """
    wanted = dirty.where(F.col("z").between(first, deepest))
    drawn = render.render_tiles(points, wanted, first, deepest, prune=True).select("style", "z", "x", "y", F.lit("drawn").alias("state"))
    stay = maintenance.fresh_tiles(kept, wanted).select("style", "z", "x", "y", F.lit("kept").alias("state"))
    return stay.unionByName(drawn)


def full_render(points: DataFrame, folder: str, first: int, deepest: int) -> None:
    write_tiles(render.render_tiles(points, tiles.data_tiles(points, first, deepest), first, deepest), folder)
