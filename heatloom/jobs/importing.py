"""Import: files to tracks, points, dirty tiles and a log, in one step for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom import schemas
from heatloom.functions import names
from heatloom.jobs import rendering, store
from heatloom.operators import tiles, tracks
from heatloom.sources import files, fit, gpx, tcx
from heatloom.tables import forget, save


NOT_DECODED = "no decoded records"


def parsed_tracks(spark: SparkSession, source: str | list[str], fit_records: DataFrame | None = None, most_bytes: int = files.LARGE_BYTES) -> DataFrame:
    """Every track of the GPX, TCX and FIT files below a folder (or of given files), and a row for each file that has none.

    Spark reads no FIT: fit_records has the decoded records of such files (file, seq, position_lat, position_long, ts), where
    `file` is the path below the folder. A FIT file without records there is an error, not a file without positions. Files above
    `most_bytes` are hashed, and TCX files parsed, in splits; the tracks are the same.
    """
    hashes = files.file_hashes(spark, source, most_bytes)
    found = gpx.parsed_gpx(gpx.read_gpx_tracks(spark, source))
    whole = tcx.parsed_tcx(files.file_contents(spark, source, tcx.FILES, most_bytes))
    if files.any_above(spark, source, most_bytes):
        whole = whole.unionByName(tcx.split_tcx(spark, source, most_bytes))
    if fit_records is not None:
        paths = hashes.where("ext = 'fit'").select("path", files.name_below(F.col("path"), source).alias("file"))
        whole = whole.unionByName(paths.join(_decoded(fit_records), "file").drop("file"))
    return _with_files(hashes, found, whole)


def parsed_fit_files(records: DataFrame) -> DataFrame:
    """The same of FIT files of which all is at hand: decoded records with the path and file_hash of their file."""
    hashes = records.select("path", F.lit("fit").alias("ext"), "file_hash").distinct()
    found = _decoded(records.withColumn("file", F.col("path"))).withColumnRenamed("file", "path")
    return _with_files(hashes, None, found)


def _decoded(records: DataFrame) -> DataFrame:
    return fit.parsed_fit(records).withColumn("error", F.lit(None).cast("string"))


def _with_files(hashes: DataFrame, gpx_tracks: DataFrame | None, whole_files: DataFrame) -> DataFrame:
    found = whole_files.select("path", F.lit(None).cast("int").alias("track_index"), F.lit(None).cast("string").alias("track_name"), "start_time", "end_time", "points", "error")
    if gpx_tracks is not None:
        found = gpx_tracks.withColumn("error", F.lit(None).cast("string")).unionByName(found)
    rows = hashes.join(found, "path", "left")
    undecoded = F.when((F.col("ext") == "fit") & F.col("points").isNull(), NOT_DECODED)
    error = F.coalesce("error", gpx.format_error(F.col("path")), undecoded)
    return rows.withColumn("error", error).withColumn("points", F.coalesce("points", F.array())).select("path", "file_hash", "track_index", "ext", "track_name", "start_time", "end_time", "points", "error")


#: Tables of a store, with their columns.
TABLES = {
    "tracks": schemas.TRACKS,
    "trackpoints": schemas.TRACKPOINTS,
    "cells": schemas.TRACKPOINTS + ", cell long",
    "dirty": schemas.TILES,
    "log": "path string, track_index int, filename string, status string, num_points long, error string",
}
#: What a run writes beside them, for itself.
WORK = "_parsed"


def stored(spark: SparkSession, folder: str, table: str, runs: dict[int, str] | None = None) -> DataFrame:
    """A table of a store as of its last version (or of given runs), with batch_id."""
    return store.read(spark, folder, table, TABLES[table], runs)


def import_batch(spark: SparkSession, parsed: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """Stores what is new of parsed tracks in the store `folder` and returns the batch's log.

    Tables tracks, trackpoints, cells (the points by place), dirty and log change in one step, for readers that use `stored`:
    the commit of a run. A batch that runs again takes the place of its earlier run, so a retry changes nothing; if another
    writer commits between, the batch is judged again by what that one stored.
    """

    def fill(runs: dict[int, str], run: str) -> DataFrame:
        before = stored(spark, folder, "tracks", runs)
        put = lambda rows, table, *by: store.write(rows, folder, table, batch_id, run, *by)
        judged = put(tracks.dedup_import(named, before), WORK)
        last = before.agg(F.coalesce(F.max("track_id"), F.lit(0))).first()[0]
        new = tracks.with_track_ids(judged.where("status = 'imported'"), last)
        lat, lon = F.transform("points", lambda p: p["lat"]), F.transform("points", lambda p: p["lon"])
        bounds = [f(a).alias(f"{n}_{c}") for n, f in (("min", F.array_min), ("max", F.array_max)) for c, a in (("lat", lat), ("lon", lon))]
        put(new.select("track_id", "filename", F.col("effective_hash").alias("file_hash"), "content_hash", "num_points", "start_time", "end_time", *bounds, F.current_timestamp().alias("imported_at")), "tracks")
        points = new.select("track_id", F.posexplode("points").alias("i", "p")).select("track_id", (F.col("i") + 1).cast("long").alias("seq"), "p.lat", "p.lon")
        kept = put(rendering.laid_out(points), "trackpoints")
        put(rendering.by_cell(kept), "cells", "cell")
        put(tiles.data_tiles(kept), "dirty")
        return put(judged.select("path", "track_index", "filename", "status", F.when(F.col("status") == "imported", F.col("num_points")).otherwise(0).alias("num_points"), "error"), "log")

    named = save(_named(parsed), "parsed")  # judging reads it several times; files are parsed once
    try:
        return store.put(spark, folder, batch_id, fill)
    finally:
        forget(named)


def _named(parsed: DataFrame) -> DataFrame:
    """parsed tracks with what they are compared by, and their names."""
    rows = parsed.withColumn("num_points", F.size("points").cast("long"))
    rows = rows.withColumn("effective_hash", names.effective_hash(F.col("file_hash"), F.col("track_index")))
    rows = rows.withColumn("content_hash", F.when(F.col("num_points") > 0, tracks.points_hash(F.col("points"))))
    base = names.file_name(F.col("path"))
    return rows.withColumn("filename", F.when(F.col("track_index").isNull(), base).otherwise(names.track_filename(F.col("path"), F.col("track_name"), F.col("track_index"))))


def import_job(spark: SparkSession, folder: str, into: str, batch_id: int = 0, fit_records: DataFrame | None = None) -> DataFrame:
    """One scan of a folder into a store."""
    return import_batch(spark, parsed_tracks(spark, folder, fit_records), into, batch_id)
