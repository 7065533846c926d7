"""FIT: decoded records (file, seq, position_lat, position_long in semicircles, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEGREES = 180.0 / 2**31


def valid_positions(records: DataFrame) -> DataFrame:
    """Records with a position on the map, as lat and lon in degrees."""
    rows = records.withColumn("lat", F.col("position_lat") * DEGREES).withColumn("lon", F.col("position_long") * DEGREES)
    return rows.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).drop("position_lat", "position_long")


def records_to_points(records: DataFrame) -> DataFrame:
    """file, seq (from 1 without holes), lat, lon."""
    order = Window.partitionBy("file").orderBy("seq")
    return valid_positions(records).select("file", F.row_number().over(order).cast("long").alias("seq"), "lat", "lon")


def parsed_fit(records: DataFrame) -> DataFrame:
    """file, start_time, end_time (ISO, UTC), points of each file of decoded records; a file is one track, a row's worth of points."""
    rows = valid_positions(records)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "lat", "lon")))
    points = F.transform(ordered, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    iso = lambda c: F.replace(F.timestamp_add("SECOND", c, F.lit("1970-01-01").cast("timestamp_ntz")).cast("string"), F.lit(" "), F.lit("T"))
    at = F.when(F.col("ts").isNotNull(), F.col("seq"))
    found = rows.groupBy("file").agg(points.alias("points"), F.min_by("ts", at).alias("first"), F.max_by("ts", at).alias("last"))
    empty = records.select("file").distinct().join(found, "file", "left")
    return empty.select("file", iso(F.col("first")).alias("start_time"), iso(F.col("last")).alias("end_time"), F.coalesce("points", F.array()).alias("points"))


def first_last_time(records: DataFrame) -> DataFrame:
    """file, first_time, last_time: of the first and last valid record that has a time."""
    timed = valid_positions(records).where(F.col("ts").isNotNull())
    return timed.groupBy("file").agg(F.min_by("ts", "seq").alias("first_time"), F.max_by("ts", "seq").alias("last_time"))
