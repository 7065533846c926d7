"""TCX: one track for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.functions import names
from heatloom.sources.files import AWAY
from heatloom.tables import in_ranges, running

POINT_FIELDS = "Time: string, Position: struct<LatitudeDegrees: string, LongitudeDegrees: string>"
POINT = f"struct<{POINT_FIELDS}>"
ACTIVITIES = f"Activities struct<Activity:array<struct<Lap:array<struct<Track:array<struct<Trackpoint:array<{POINT}>>>>>>>>"

NO_ACTIVITY = "No Activity elements"
FILES = "*.[tT][cC][xX]"
CLOSER = r"</(?:\w+:)?Trackpoint\s*>"
#: Elements around a track point, from the outside, and how often each is open there.
AROUND = (("Activities", 1), ("Activity", 1), ("Lap", 1), ("Track", 1), ("MultiSportSession", 0))


def _opener(element: str) -> str:
    """Pattern of an opening tag that is not closed in itself."""
    return rf"<{element}(?:\s[^<>]*)?(?<!/)>"


def parsed_tcx(files: DataFrame) -> DataFrame:
    """path, start_time, end_time, points, error of files (path, content): all track points of all activities in order."""
    text = names.without_prefixes(F.decode("content", "UTF-8"))
    text = F.regexp_replace(text, r"""\sxmlns(?::\w+)?\s*=\s*("[^"]*"|'[^']*')""", "")
    text = F.regexp_replace(text, r"""\s\w+:(\w+\s*=)""", " $1")
    rows = files.select("path", F.from_xml(text, ACTIVITIES, {"mode": "PERMISSIVE"}).alias("t"))
    laps = F.flatten(F.transform("t.Activities.Activity", lambda a: F.coalesce(a["Lap"], F.array())))
    tracks = F.flatten(F.transform(laps, lambda lap: F.coalesce(lap["Track"], F.array())))
    every = F.flatten(F.transform(tracks, lambda t: F.coalesce(t["Trackpoint"], F.array())))
    value = lambda p: F.struct(names.number(p["Position"]["LatitudeDegrees"]).alias("lat"), names.number(p["Position"]["LongitudeDegrees"]).alias("lon"), F.nullif(F.trim(p["Time"]), F.lit("")).alias("time"))
    rows = rows.withColumn("p", F.filter(F.transform(every, value), lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180)))
    timed = F.filter(F.transform("p", lambda p: p["time"]), lambda t: t.isNotNull())
    error = F.when(F.size(F.coalesce("t.Activities.Activity", F.array())) == 0, NO_ACTIVITY)
    points = F.transform(F.coalesce("p", F.array()), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return rows.select("path", F.get(timed, F.lit(0)).alias("start_time"), F.element_at(F.when(F.size(timed) > 0, timed), -1).alias("end_time"), points.alias("points"), error.alias("error"))


def _depths(text: Column) -> Column:
    """How many of each element AROUND a text opens, less those it closes, as digits of base 1,024 of one number."""
    found = F.lit(0).cast("long")
    for i, (element, _) in enumerate(AROUND):
        change = F.regexp_count(text, F.lit(_opener(element))) - F.regexp_count(text, F.lit(rf"</{element}\s*>"))
        found = found + change.cast("long") * F.lit(1024**i)
    return found


def split_tcx(spark: SparkSession, source: str | list[str], more_than: int = 0) -> DataFrame:
    """path, start_time, end_time, points, error of TCX files above `more_than` bytes, as `parsed_tcx` has them.

    Files are split at '</Trackpoint>' across partitions; pieces with closers of another spelling are split again. What a
    piece opens and closes before its point is summed over range partitions of all pieces, so each point knows whether it
    lies in a track of a lap of an activity without the text before it. A file whose tags don't match, or with a point that is
    no XML, has the error of a file without activities and no points, like one that is parsed as a whole. Tags inside comments count
    as tags. Only the points of a file, not its text, come together in one task.
    """
    reader = spark.read.option("lineSep", "</Trackpoint>").option("recursiveFileLookup", True).option("pathGlobFilter", FILES)
    rows = reader.text(source).where(F.col("_metadata.file_size") > more_than)
    rows = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.withColumn("place", F.monotonically_increasing_id()).where(~F.col("path").rlike(AWAY))
    pieces = rows.select("path", "block", "place", F.posexplode(F.split("value", CLOSER)).alias("part", "piece")).withColumn("piece", names.without_prefixes(F.col("piece")))
    two = rf"(?s)^(.*)({_opener('Trackpoint')}.*)$"
    point = F.regexp_extract("piece", two, 2)
    pieces = pieces.withColumn("head", F.when(point != "", F.regexp_extract("piece", two, 1)).otherwise(F.col("piece"))).withColumn("point", F.when(point != "", F.concat(point, F.lit("</Trackpoint>"))))
    # Attributes with prefixes of their own are no concern of a point.
    point = F.regexp_replace(F.regexp_replace("point", r"""\sxmlns(?::\w+)?\s*=\s*("[^"]*"|'[^']*')""", ""), r"""\s\w+:(\w+\s*=)""", " $1")
    pieces = pieces.withColumn("p", F.from_xml(point, f"struct<{POINT_FIELDS}, __broken: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}))
    sports = F.regexp_count("head", F.lit(r"<(?:First|Next)Sport[\s>]"))  # each has an activity that is none of the file's own
    position = F.col("p.Position")
    slim = pieces.select(
        "path", "block", "place", "part", _depths(F.col("head")).alias("change"), (F.regexp_count("head", F.lit(r"<Activity[\s/>]")) - sports).alias("activities"),
        F.col("point").isNotNull().alias("is_point"), (F.col("point").isNotNull() & (F.col("p").isNull() | F.col("p.__broken").isNotNull())).alias("is_broken"),
        names.number(position["LatitudeDegrees"]).alias("lat"), names.number(position["LongitudeDegrees"]).alias("lon"), F.nullif(F.trim("p.Time"), F.lit("")).alias("time"),
    )
    place = ["block", "place", "part"]
    summed = running(in_ranges(slim, "path", *place), ["path", *place], F.col("change"))
    whole = summed.groupBy("path").agg(
        F.min_by("before", F.struct(*place)).alias("start"), F.sum("change").alias("open"), F.sum("activities").alias("n"), F.max("is_broken").alias("broken"), (F.count_if("is_point") != F.count("*") - 1).alias("torn")
    )
    good = ~F.col("broken") & ~F.col("torn") & (F.col("open") == 0) & (F.col("n") > 0)
    whole = whole.select("path", "start", F.when(~good, NO_ACTIVITY).alias("error"))
    inside = F.lit(sum(times * 1024**i for i, (_, times) in enumerate(AROUND)))
    held = summed.where(F.col("is_point") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).join(whole.where("error IS NULL"), "path")
    held = held.where(F.col("before") - F.col("start") + F.col("change") == inside)
    timed = F.when(F.col("time").isNotNull(), F.struct(*place))
    ordered = F.array_sort(F.collect_list(F.struct(*place, "lat", "lon")))
    found = held.groupBy("path").agg(F.min_by("time", timed).alias("start_time"), F.max_by("time", timed).alias("end_time"), F.transform(ordered, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))
    empty = F.array().cast("array<struct<lat:double,lon:double>>")
    return whole.join(found, "path", "left").select("path", "start_time", "end_time", F.coalesce("points", empty).alias("points"), "error")
