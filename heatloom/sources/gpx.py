"""GPX: files of any size as one row for each track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.functions import names
from heatloom.sources import files
from heatloom.sources.files import AWAY

FILES = "*.[gG][pP][xX]"
CLOSER = r"(?i)</(?:\w+:)?trk\s*>"
POINT = "array<struct<_lat:string,_lon:string,time:string>>"
TRACK = f"name string, trkseg array<struct<trkpt:{POINT}>>, trkpt {POINT}"


def format_error(path: Column) -> Column:
    """Null for a supported file, else what is wrong with it."""
    ext = names.extension(path)
    return F.when(~ext.isin(*names.EXTENSIONS), F.concat(F.lit("Unsupported format: ."), ext))


def track_elements(chunk: Column) -> Column:
    """The track element in a piece of text that ends where one closes (or breaks off); null if none begins there."""
    opened = F.regexp_extract(chunk, r"(?is)(<(?:\w+:)?trk(?=[\s>/]).*)$", 1)
    return F.when(opened != "", F.concat(names.without_prefixes(opened), F.lit("</trk>")))


def parsed_track(rows: DataFrame, xml: Column) -> DataFrame:
    """rows with track_name, points, start_time, end_time of a track element; points is null for malformed XML.

    Points with a latitude or longitude that is no number or out of range are left out; times are those of the first and
    last point that has one.
    """
    rows = rows.withColumn("_t", F.from_xml(names.sanitized_gpx(xml), TRACK, {"mode": "PERMISSIVE"}))
    inner = F.flatten(F.transform(F.coalesce("_t.trkseg", F.array()), lambda s: F.coalesce(s["trkpt"], F.array().cast(POINT))))
    every = F.concat(F.coalesce("_t.trkpt", F.array().cast(POINT)), inner)
    valued = F.transform(every, lambda p: F.struct(names.number(p["_lat"]).alias("lat"), names.number(p["_lon"]).alias("lon"), F.nullif(F.trim(p["time"]), F.lit("")).alias("time")))
    rows = rows.withColumn("_p", F.filter(valued, lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180)))
    timed = F.filter(F.transform("_p", lambda p: p["time"]), lambda t: t.isNotNull())
    good = F.col("_t").isNotNull() & F.coalesce("_t.name", F.when(F.size(F.coalesce("_t.trkseg", F.array())) + F.size(F.coalesce("_t.trkpt", F.array())) > 0, "")).isNotNull()
    points = F.transform("_p", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    rows = rows.withColumn("track_name", F.col("_t.name")).withColumn("points", F.when(good, points))
    return rows.withColumn("start_time", F.get(timed, F.lit(0))).withColumn("end_time", F.element_at(F.when(F.size(timed) > 0, timed), -1)).drop("_t", "_p")


def _closers(spark: SparkSession, folder: str | list[str]) -> list[tuple[str, str | list[str]]]:
    """Where tracks end, and the files to read by that: "</trk>", and for files above WHOLE_BYTES the closer that each has most.

    Only if a large file mostly has another spelling do names of files reach the driver.
    """
    if not files.any_above(spark, folder, files.WHOLE_BYTES):
        return [("</trk>", folder)]
    reader = spark.read.option("lineSep", ">").option("recursiveFileLookup", True).option("pathGlobFilter", FILES)
    tags = reader.text(folder).where(F.col("_metadata.file_size") > files.WHOLE_BYTES).select(F.col("_metadata.file_path").alias("path"), F.substring("value", -64, 64).alias("tag"))
    tags = tags.where(F.lower(F.col("tag")).rlike(r"trk\s*$") & ~F.col("path").rlike(AWAY))
    tags = tags.withColumn("tag", F.regexp_extract("tag", CLOSER.removesuffix(">") + "$", 0)).where("tag <> ''")
    most = tags.groupBy("path", "tag").count().groupBy("path").agg(F.max(F.struct("count", "tag"))["tag"].alias("tag"))
    plain = lambda rows: files.plain_path(rows["file"])
    odd: dict[str, list[str]] = {}
    for r in most.where("tag <> '</trk'").select("tag", names.decoded(F.col("path")).alias("file")).collect():
        odd.setdefault(r["tag"] + ">", []).append(plain(r))
    if not odd:
        return [("</trk>", folder)]
    apart = {path for paths in odd.values() for path in paths}
    rest = [p for p in map(plain, files.scan_activity_files(spark, folder).where("ext = 'gpx'").select(names.decoded(F.col("path")).alias("file")).collect()) if p not in apart]
    return [("</trk>", rest)] * bool(rest) + sorted(odd.items())


def read_gpx_tracks(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """path, chunk (order in the file) and xml of each track element below a folder, or of given files.

    Files are split at '</trk>' across partitions, or large files at the closer that they have most (`_closers`), so one file
    may be far larger than a task's memory. Pieces that hold closers of another spelling (with a prefix, in capitals, with
    spaces) are split again at these; what lies between two of the closers that a file is split at is one value. A last track that
    breaks off is closed. Several tracks on one line are all kept.
    """
    rows = None
    for closer, source in _closers(spark, folder):
        reader = spark.read.option("lineSep", closer).option("recursiveFileLookup", True).option("pathGlobFilter", FILES)
        found = reader.text(source).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
        found = found.withColumn("place", F.monotonically_increasing_id()).where(~F.col("path").rlike(AWAY))
        rows = found if rows is None else rows.unionByName(found)
    pieces = rows.select("path", "block", "place", F.posexplode(F.split("value", CLOSER)).alias("part", "piece"))
    pieces = pieces.select("path", F.struct("block", "place", "part").alias("chunk"), track_elements(F.col("piece")).alias("xml"))
    return pieces.where(F.col("xml").isNotNull())


def parsed_gpx(chunks: DataFrame) -> DataFrame:
    """path, track_index, track_name, start_time, end_time, points of usable tracks, numbered in file order.

    Malformed and empty tracks are dropped first. Numbers come from slim rows without points.
    """
    parsed = parsed_track(chunks, F.col("xml")).drop("xml").where(F.size(F.coalesce("points", F.array())) > 0)
    index = F.row_number().over(Window.partitionBy("path").orderBy("chunk")) - 1
    numbered = parsed.select("path", "chunk").withColumn("track_index", index)
    return parsed.join(numbered, ["path", "chunk"]).select("path", "track_index", "track_name", "start_time", "end_time", "points")
