"""Segments between consecutive points, and their tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.functions import geo
from heatloom.operators import tiles

LONGEST_KM = 1.0
MOST_TRACKS = 200_000


def segments(points: DataFrame, whole: bool = True) -> DataFrame:
    """track_id, seq, lat0, lon0, lat1, lon1 of each point and the next of its track.

    Where points are only a part of the tracks (not `whole`), a segment's ends must have consecutive seqs.
    """
    order = Window.partitionBy("track_id").orderBy("seq")
    pairs = points.select("track_id", "seq", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.lead("lat").over(order).alias("lat1"), F.lead("lon").over(order).alias("lon1"), F.lead("seq").over(order).alias("next"))
    joined = F.lit(True) if whole else F.col("next") == F.col("seq") + 1
    return pairs.where(F.col("lat1").isNotNull() & joined).drop("next")


def with_gap(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("km", geo.gap_km(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")))


def drop_gaps(pairs: DataFrame, longest: float = LONGEST_KM) -> DataFrame:
    """Segments of at most `longest` km."""
    return with_gap(pairs).where(F.col("km") <= longest).drop("km")


def cap_tracks(hits: DataFrame, most: int = 10_000) -> DataFrame:
    """The first tracks of each tile, as many as its zoom draws.

    Ranks come from hits, one slim row for each tile and track; only tiles that hold more than their cap are ranked, and
    Spark keeps just the leading rows of a tile in each task before the shuffle.
    """
    cap = F.least(geo.segment_cap(F.col("z"), most), F.lit(MOST_TRACKS))
    rank = F.row_number().over(Window.partitionBy("z", "x", "y").orderBy("track_id"))
    return hits.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("rank") <= cap)).drop("rank")


def tile_segments(points: DataFrame, wanted: DataFrame, first: int, deepest: int, most: int = 10_000, whole: bool = True) -> DataFrame:
    """z, x, y, track_id, seq, lat0, lon0, lat1, lon1: what is drawn in each wanted tile (z, x, y).

    Hits are capped before segments meet them (`segments_of_hits`).
    """
    hits = tiles.track_tile_hits(points, first, deepest).join(wanted.select("z", "x", "y"), ["z", "x", "y"], "left_semi")
    return segments_of_hits(points, cap_tracks(hits, most), whole)


def segments_of_hits(points: DataFrame, hits: DataFrame, whole: bool = True) -> DataFrame:
    """z, x, y, track_id, seq, lat0, lon0, lat1, lon1: what tracks draw in the tiles that they hit.

    A track is in a tile if a point of it is in the padded box; then all its segments from one before the first such point
    to one after the last count, if their box in pixels comes near the tile and they are no gap. A track's segments are
    copied only to zooms at which it has a hit, within the seqs of its hits there, and from there to the tiles that their
    margin touches, where they meet the hits on (z, x, y, track_id), an equi-join.
    """
    spans = hits.groupBy("track_id", "z").agg(F.min("first_seq").alias("from"), F.max("last_seq").alias("upto"))
    spans = spans.groupBy("track_id").agg(F.collect_list(F.struct("z", "from", "upto")).alias("zooms"))
    short = drop_gaps(segments(points, whole)).join(spans, "track_id")
    meets = F.filter("zooms", lambda s: (F.col("seq") >= s["from"] - 1) & (F.col("seq") <= s["upto"]))
    short = short.withColumn("z", F.explode(F.transform(meets, lambda s: s["z"]))).drop("zooms")
    z = F.col("z")
    ends = {n: geo.global_pixel(f(F.col(c)), z) for n, f, c in (("gx0", geo.mercator_x, "lon0"), ("gx1", geo.mercator_x, "lon1"), ("gy0", geo.mercator_y, "lat0"), ("gy1", geo.mercator_y, "lat1"))}
    short = short.withColumns(ends)
    margin = geo.TILE / 2

    def touched(a: str, b: str):
        low = F.floor((F.least(a, b) - margin) / geo.TILE)
        high = F.floor((F.greatest(a, b) + margin) / geo.TILE)
        return F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, geo.side(z).cast("long") - 1)))

    short = short.withColumn("x", touched("gx0", "gx1")).withColumn("y", touched("gy0", "gy1")).drop("gx0", "gx1", "gy0", "gy1")
    met = short.join(hits, ["z", "x", "y", "track_id"])
    met = met.where((F.col("seq") >= F.col("first_seq") - 1) & (F.col("seq") <= F.col("last_seq")))
    return met.select("z", "x", "y", "track_id", "seq", "lat0", "lon0", "lat1", "lon1")
