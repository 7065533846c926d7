"""Tracks derived from the events table: a walk in whole micro-degrees for each user (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.functions import names
from heatloom.operators import tiles, tracks
from heatloom.schemas import STYLES
from heatloom.tables import new_folder, rename_parts, save


def trackpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, seq, lat, lon."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    track, event = F.col("user_id") + 1, F.col("event_id")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    walk = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    north = (event * 7919) % 2001 - 1000 + F.when(event % 97 == 0, 20_000).otherwise(0)
    east = (event * 104_729) % 2001 - 1000
    lat = 46_500_000 + ((track * 37) % 20) * 2000 + F.sum(north).over(walk)
    lon = -87_500_000 + ((track * 53) % 20) * 2000 + F.sum(east).over(walk)
    return events.select(track.alias("track_id"), F.row_number().over(order).cast("long").alias("seq"), (lat.cast("double") / 1e6).alias("lat"), (lon.cast("double") / 1e6).alias("lon"))


def stored_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks table of the derived points: bounds, hashes, times, names."""
    points = trackpoints(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    times = events.groupBy((F.col("user_id") + 1).alias("track_id")).agg(iso(F.min("ts")).alias("start_time"), iso(F.max("ts")).alias("end_time"))
    t = F.col("track_id")
    file_hash = F.sha2(((t - t % 3) / 3).cast("long").cast("string"), 256)
    return (
        tracks.track_bounds(points)
        .join(tracks.content_hashes(points), "track_id")
        .join(times, "track_id")
        .withColumn("start_time", F.when(t % 10 != 0, F.col("start_time")))
        .withColumn("end_time", F.when(t % 10 != 0, F.col("end_time")))
        .withColumn("file_hash", names.effective_hash(file_hash, F.when(t % 3 != 0, t % 3)))
        .withColumn("filename", F.concat(F.lit("ride "), t, F.lit(" [name].gpx")))
    )


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored tracks (the first half) and an import batch that has every status."""
    whole = save(stored_tracks(spark, sf_dir).select("track_id", "filename", "file_hash", "content_hash", "num_points"), "stored")
    half = F.floor(whole.select(F.max("track_id").alias("m")).first()["m"] / F.lit(2))
    stored, new = whole.where(F.col("track_id") <= half), whole.where(F.col("track_id") > half)
    t = F.col("track_id")
    path = lambda folder: F.format_string(f"{folder}/%06d.gpx", t)
    index, points = F.lit(None).cast("int"), F.when(t % 13 == 0, 0).otherwise(F.col("num_points"))
    error = F.when(t % 17 == 0, F.lit("not well-formed"))
    fresh = F.concat(F.lit("new-"), t)
    batch = (
        stored.where(t % 5 == 0).select(t, path("a").alias("path"), index.alias("track_index"), F.col("file_hash").alias("effective_hash"), "content_hash", "num_points", F.lit(None).cast("string").alias("error"))
        .unionByName(stored.where(t % 7 == 0).select(t, path("b").alias("path"), index.alias("track_index"), fresh.alias("effective_hash"), "content_hash", "num_points", F.lit(None).cast("string").alias("error")))
        .unionByName(new.select(t, path("c").alias("path"), index.alias("track_index"), F.col("file_hash").alias("effective_hash"), "content_hash", points.cast("long").alias("num_points"), error.alias("error")))
        .unionByName(new.where(t % 11 == 0).select(t, path("d").alias("path"), index.alias("track_index"), fresh.alias("effective_hash"), "content_hash", points.cast("long").alias("num_points"), error.alias("error")))
    )
    return stored, batch


def last_tracks(points: DataFrame, share: float = 0.9) -> Column:
    """Condition for the tracks after a share of the ids."""
    return F.col("track_id") > F.lit(points.agg(F.max("track_id")).first()[0] * share)


def dirty_tiles(points: DataFrame) -> DataFrame:
    """Tiles of the last tenth of the tracks."""
    return tiles.data_tiles(points.where(last_tracks(points)))


def tiles_on_disk(points: DataFrame) -> DataFrame:
    """style, z, x, y of a tile set with holes."""
    styles = points.sparkSession.sql("SELECT explode(array({})) AS style".format(", ".join(f"'{s}'" for s in STYLES)))
    x, y, style = F.col("x"), F.col("y"), F.col("style")
    hole = ((style == "warm") & ((x + y) % 7 == 0)) | ((style == "cool") & ((x * y) % 11 == 0))
    return tiles.data_tiles(points).join(F.broadcast(styles)).where(~hole).select("style", "z", "x", "y")


def tile_requests(points: DataFrame) -> DataFrame:
    """Addresses that ask for tiles in every way: known, of an unknown style, at a bad zoom, off the map."""
    base = tiles.data_tiles(points)
    kind = (F.col("x") + F.col("y")) % 5
    return base.select(
        F.when(kind == 1, "neon").otherwise("warm").alias("style"),
        F.when(kind == 2, -1).when((kind == 3) & (F.col("x") % 2 == 0), 21).otherwise(F.col("z")).alias("z"),
        F.when(kind == 4, F.pow(F.lit(2.0), F.col("z")).cast("long")).otherwise(F.col("x")).alias("x"),
        "y",
    )


def tile_blobs(points: DataFrame) -> DataFrame:
    """z, x, y, length: a made-up length for each tile's image."""
    return tiles.data_tiles(points).withColumn("length", F.col("x") % 97 * 13 + F.col("y") % 89 * 7 + 67)


def gpx_texts(points: DataFrame) -> DataFrame:
    """track_id and a GPX track element with its points."""
    point = F.concat(F.lit('<trkpt lat="'), F.format_string("%.6f", "lat"), F.lit('" lon="'), F.format_string("%.6f", "lon"), F.lit('"></trkpt>'))
    ordered = F.array_sort(F.collect_list(F.struct("seq", point.alias("p"))))
    inner = F.array_join(F.transform(ordered, lambda s: s["p"]), "")
    return points.groupBy("track_id").agg(F.concat(F.lit("<trk><name>ride "), F.first("track_id"), F.lit(" R&R</name><trkseg>"), inner, F.lit("</trkseg></trk>")).alias("xml"))


def fit_records(points: DataFrame) -> DataFrame:
    """file, seq, position_lat, position_long (semicircles), ts (epoch seconds); some rows without a position or off the map."""
    semi = lambda c: F.round(c * (2.0**31 / 180.0)).cast("long")
    t, s = F.col("track_id"), F.col("seq")
    return points.select(
        F.format_string("ride-%06d.fit", t).alias("file"),
        s.alias("seq"),
        F.when(s % 19 != 0, F.when(s % 23 == 0, semi(F.col("lat") + 60)).otherwise(semi(F.col("lat")))).alias("position_lat"),
        semi(F.col("lon")).alias("position_long"),
        F.when(s % 7 != 0, F.lit(1_700_000_000) + t * 1000 + s).alias("ts"),
    )


#: Activity files of each format that `activity_files` writes.
FILES = 8


def activity_files(points: DataFrame, *formats: str) -> tuple[str, DataFrame]:
    """A folder of activity files made of the points, and the decoded records of its FIT files.

    Track t goes to the format t % len(formats) (gpx, prefixed, tcx or fit) and, in it, to one of FILES files. A GPX file has
    a track for each, in the order of ids; TCX and FIT files are one track each. FIT files themselves hold no more than
    their name.
    """
    spark, t = points.sparkSession, F.col("track_id")
    kind = F.element_at(F.array(*[F.lit(f) for f in formats]), (t % len(formats) + 1).cast("int"))
    name = F.format_string("%s-%d", kind, F.floor(t / len(formats)) % FILES)
    spot = lambda point: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), point), "")
    six = lambda c: F.format_string("%.6f", c)
    gpx = spot(lambda p: F.concat(F.lit('<trkpt lat="'), six(p["lat"]), F.lit('" lon="'), six(p["lon"]), F.lit('"/>')))
    tcx = spot(lambda p: F.concat(F.lit("<Trackpoint><Position><LatitudeDegrees>"), six(p["lat"]), F.lit("</LatitudeDegrees><LongitudeDegrees>"), six(p["lon"]), F.lit("</LongitudeDegrees></Position></Trackpoint>")))
    texts = points.groupBy("track_id").agg(gpx.alias("g"), tcx.alias("x")).withColumn("kind", kind).withColumn("name", name)
    track = F.concat(F.lit("<trk><name>ride "), t, F.lit("</name><trkseg>"), F.col("g"), F.lit("</trkseg></trk>"))
    body = (
        F.when(F.col("kind") == "gpx", track)
        .when(F.col("kind") == "prefixed", F.regexp_replace(track, "<(/?)", "<$1g:"))
        .when(F.col("kind") == "tcx", F.concat(F.lit("<Lap><Track>"), F.col("x"), F.lit("</Track></Lap>")))
    )
    # lines go to their file one by one, so no task holds the text of a file
    first, last = {}, {}
    first["gpx"], last["gpx"] = first["prefixed"], last["prefixed"] = "<gpx>", "</gpx>"
    first["tcx"], last["tcx"] = "<TrainingCenterDatabase><Activities><Activity>", "</Activity></Activities></TrainingCenterDatabase>"
    around = lambda lines: F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in lines.items()])
    place = lambda n: F.lit(n).alias("place")
    each = texts.select("kind", "name").distinct()
    lines = texts.where(F.col("kind") != "fit").select("kind", "name", place(1), "track_id", body.alias("value"))
    for n, value in ((0, F.coalesce(around(first), F.col("name"))), (2, around(last))):
        lines = lines.unionByName(each.select("kind", "name", place(n), F.lit(None).cast("long").alias("track_id"), value.alias("value")).where("value IS NOT NULL"))
    folder = new_folder(spark, "activities")
    ending = F.when(F.col("kind") == "prefixed", "gpx").otherwise(F.col("kind"))
    lines = lines.withColumn("file", F.concat("name", F.lit("."), ending)).repartition("file").sortWithinPartitions("file", "place", "track_id")
    lines.select("value", "file").write.partitionBy("file").text(folder)
    rename_parts(spark, folder)
    fit = points.where(kind == "fit").select(F.concat(name, F.lit(".fit")).alias("file"), F.struct("track_id", "seq").alias("seq"), *[F.round(F.col(c) * (2.0**31 / 180.0)).cast("long").alias(f"position_{n}") for c, n in (("lat", "lat"), ("lon", "long"))], (F.lit(1_700_000_000) + t * 1000 + F.col("seq")).alias("ts"))
    return folder, fit
