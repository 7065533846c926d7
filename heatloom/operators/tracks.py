"""Tracks: bounds, hashes, statistics, and which tracks of a batch to import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.functions import names
from heatloom.tables import in_ranges, running


def track_bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("track_id").agg(
        F.count("*").alias("num_points"), F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon")
    )


def points_hash(points):
    """SHA-256 of an array of (lat, lon), each as 'lat,lon' with six decimals and a newline."""
    return F.sha2(F.array_join(F.transform(points, lambda p: F.concat(F.format_string("%.6f,%.6f", p["lat"], p["lon"]), F.lit("\n"))), ""), 256)


def content_hashes(points: DataFrame) -> DataFrame:
    """track_id and the hash of its points in order. A track is one row's worth of points, so it fits a task."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "lat", "lon")))
    return points.groupBy("track_id").agg(points_hash(ordered).alias("content_hash"))


def stats(tracks: DataFrame) -> DataFrame:
    return tracks.agg(F.count("*").alias("total_tracks"), F.coalesce(F.sum("num_points"), F.lit(0)).alias("total_points"), F.countDistinct(names.source_hash(F.col("file_hash"))).alias("source_files"))


def source_file_count(tracks: DataFrame) -> DataFrame:
    return tracks.agg(F.countDistinct(names.source_hash(F.col("file_hash"))).alias("source_files"))


def date_range(tracks: DataFrame) -> DataFrame:
    """First start and last end (as text) of tracks that have a start; no row if none has."""
    timed = tracks.where(F.col("start_time").isNotNull())
    return timed.agg(F.min("start_time").alias("first_time"), F.max("end_time").alias("last_time")).where(F.col("first_time").isNotNull())


def global_bounds(tracks: DataFrame) -> DataFrame:
    return tracks.agg(F.min("min_lat").alias("min_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lat").alias("max_lat"), F.max("max_lon").alias("max_lon"))


def new_files(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a batch whose effective hash is not stored."""
    known = stored.select(F.col("file_hash").alias("effective_hash"))
    return batch.join(known, "effective_hash", "left_anti")


def content_duplicates(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a batch whose content is stored, with the first stored track's name."""
    first = stored.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min_by("filename", "track_id").alias("matched"))
    return batch.join(first, "content_hash").select(*batch.columns, "matched")


def dedup_import(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """batch with `status`, as if its rows were imported one by one in (path, track_index) order.

    batch: path, track_index, effective_hash, content_hash, num_points, error; stored: file_hash, content_hash. A winner is
    the first usable row of a content that is new in every way; a row is a duplicate if its hash is stored or is that of an
    earlier winner.
    """
    keys = stored.select(F.col("file_hash").alias("effective_hash")).distinct().withColumn("known_file", F.lit(True))
    contents = stored.select("content_hash").where(F.col("content_hash").isNotNull()).distinct().withColumn("known_content", F.lit(True))
    place = F.struct("path", F.coalesce("track_index", F.lit(-1)))
    rows = batch.withColumn("place", place).join(keys, "effective_hash", "left").join(contents, "content_hash", "left")
    usable = F.col("error").isNull() & (F.col("num_points") > 0)
    could = usable & F.col("known_file").isNull() & F.col("known_content").isNull()
    winners = rows.where(could).groupBy("content_hash").agg(F.min("place").alias("won"), F.min_by("effective_hash", "place").alias("winner_hash"))
    rows = rows.join(winners.select("content_hash", "won"), "content_hash", "left")
    earlier = winners.groupBy(F.col("winner_hash").alias("effective_hash")).agg(F.min("won").alias("first_won"))
    rows = rows.join(earlier, "effective_hash", "left")
    status = (
        F.when(F.col("known_file") | (F.col("first_won") < F.col("place")), "duplicate")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("num_points") <= 0, "no_gps_data")
        .when(F.col("known_content"), "content_duplicate")
        .when(could & (F.col("won") == F.col("place")), "imported")
        .otherwise("content_duplicate")
    )
    return rows.withColumn("status", status).select(*batch.columns, "status")


def with_track_ids(imported: DataFrame, last_id: int) -> DataFrame:
    """Imported rows with dense ids after last_id, in (path, track_index) order, numbered by range partitions of slim rows."""
    slim = in_ranges(imported.select(F.col("path").alias("_path"), F.col("track_index").alias("_index")), "_path", "_index")
    slim = running(slim, ["_path", "_index"]).select("_path", "_index", (F.col("before") + 1 + F.lit(last_id)).cast("long").alias("track_id"))
    same = F.col("path").eqNullSafe(F.col("_path")) & F.col("track_index").eqNullSafe(F.col("_index"))
    return imported.join(slim, same).select("track_id", *imported.columns)


def import_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("files"), F.sum(F.when(F.col("status") == "imported", F.col("num_points")).otherwise(0)).alias("points"))


def duplicates_blocked(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col("status") == "content_duplicate").alias("content_duplicates_blocked"))


def track_index(parsed: DataFrame) -> DataFrame:
    """parsed (path, chunk, ...) with the number from 0 of each usable track in its file."""
    return parsed.withColumn("track_index", F.row_number().over(Window.partitionBy("path").orderBy("chunk")) - 1)


def route_files(results: DataFrame, existing: DataFrame) -> DataFrame:
    """Where each file goes: errors if any of its tracks failed, else done; names that are taken get _1, _2, ...

    results: path, status; existing: folder, name. A file's number counts the files that take its name in this batch before
    it and the names of that form that exist.
    """
    per = results.groupBy("path").agg(F.max((F.col("status") == "error").cast("int")).alias("bad"))
    per = per.select("path", F.when(F.col("bad") == 1, "errors").otherwise("done").alias("folder"), F.substring_index("path", "/", -1).alias("name"))
    form = lambda c: F.regexp_replace(c, r"_\d+(\.[^.]*)?$", "$1")
    own = existing.groupBy("folder", "name").agg(F.count("*").alias("taken"))
    numbered = existing.where(F.col("name").rlike(r"_\d+(\.[^.]*)?$")).groupBy("folder", form(F.col("name")).alias("name")).agg(F.max(F.regexp_extract("name", r"_(\d+)(?:\.[^.]*)?$", 1).cast("long")).alias("last"))
    per = per.join(own, ["folder", "name"], "left").join(numbered, ["folder", "name"], "left")
    turn = F.row_number().over(Window.partitionBy("folder", "name").orderBy("path")) - 1
    taken = F.when(F.col("taken").isNull(), 0).otherwise(F.coalesce(F.col("last"), F.lit(0)) + 1)
    n = turn + taken
    stem, suffix = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    return per.select("path", F.concat("folder", F.lit("/"), F.when(n == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), n, suffix))).alias("target"))
