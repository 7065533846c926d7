"""Pixels covered by segments, their intensity and colour, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.functions import geo
from heatloom.operators.segments import drop_gaps, segments

# Colour ramps of the three styles, each (share of full intensity, red, green, blue).
RAMPS = {
    "warm": [(0.0, 0, 0, 0), (0.05, 40, 5, 0), (0.15, 80, 15, 0), (0.3, 160, 30, 0), (0.5, 220, 70, 5), (0.75, 255, 120, 20), (1.0, 200, 60, 5)],
    "cool": [(0.0, 0, 0, 0), (0.05, 0, 5, 40), (0.15, 0, 15, 80), (0.3, 0, 40, 160), (0.5, 10, 80, 220), (0.75, 30, 140, 255), (1.0, 10, 60, 200)],
    "top10": [(0.0, 0, 0, 0), (0.89, 0, 0, 0), (0.90, 0, 200, 80), (0.95, 0, 255, 136), (1.0, 68, 255, 170)],
}


def covered_pixels(pairs: DataFrame, z: int, width: int) -> DataFrame:
    """track_id, px, py (global pixels): a segment of N = ceil(longer side) steps, each step widened along the shorter side."""
    zoom = F.lit(z)
    g = pairs.select(
        "track_id",
        geo.global_pixel(geo.mercator_x(F.col("lon0")), zoom).alias("x0"),
        geo.global_pixel(geo.mercator_y(F.col("lat0")), zoom).alias("y0"),
        geo.global_pixel(geo.mercator_x(F.col("lon1")), zoom).alias("x1"),
        geo.global_pixel(geo.mercator_y(F.col("lat1")), zoom).alias("y1"),
    )
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    g = g.withColumn("n", F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy))))).withColumn("flat", F.abs(dx) >= F.abs(dy))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    at = lambda a, d: F.floor(F.col(a) + d * F.col("i") / F.col("n"))
    g = g.select("track_id", at("x0", dx).alias("px"), at("y0", dy).alias("py"), "flat").distinct() if width == 1 else g.select("track_id", at("x0", dx).alias("px"), at("y0", dy).alias("py"), "flat")
    g = g.withColumn("o", F.explode(F.sequence(F.lit(-((width - 1) // 2)), F.lit(width // 2))))
    return g.select("track_id", (F.col("px") + F.when(F.col("flat"), 0).otherwise(F.col("o"))).alias("px"), (F.col("py") + F.when(F.col("flat"), F.col("o")).otherwise(0)).alias("py"))


WIDTHS = {**dict.fromkeys(range(9), 1), **dict.fromkeys(range(9, 12), 2), 12: 3, 13: 3}


def pixel_intensity(points: DataFrame, z: int) -> DataFrame:
    """z, px, py and the number of distinct tracks over each global pixel.

    (track, pixel) pairs are made distinct first, with a partial step in each task, and then counted.
    """
    cover = covered_pixels(drop_gaps(segments(points)), z, WIDTHS.get(z, 4)).distinct()
    return cover.groupBy("px", "py").agg(F.count("*").alias("tracks")).select(F.lit(z).alias("z"), "px", "py", "tracks")


def with_index(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("idx", geo.intensity_index(F.col("tracks"), F.col("z")))


def ramp_table(spark: SparkSession) -> DataFrame:
    """One row for each stretch of a ramp."""
    rows = [(s, i, *map(float, a), *map(float, b)) for s, ramp in RAMPS.items() for i, (a, b) in enumerate(zip(ramp, ramp[1:], strict=False))]
    return spark.createDataFrame(rows, "style string, part int, t0 double, r0 double, g0 double, b0 double, t1 double, r1 double, g1 double, b1 double")


def color_lut(spark: SparkSession) -> DataFrame:
    """style, idx, r, g, b, a: 256 colours for each style; index 0 and black are transparent."""
    stretches = ramp_table(spark)
    steps = spark.range(256).select(F.col("id").cast("int").alias("idx"), (F.col("id") / 255.0).alias("t"))
    inside = (F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1"))
    first = steps.join(F.broadcast(stretches), inside).groupBy("style", "idx", "t").agg(F.min_by(F.struct("t0", "r0", "g0", "b0", "t1", "r1", "g1", "b1"), "part").alias("s"))
    share = (F.col("t") - F.col("s.t0")) / (F.col("s.t1") - F.col("s.t0"))
    shade = lambda c: (F.col(f"s.{c}0") + (F.col(f"s.{c}1") - F.col(f"s.{c}0")) * share).cast("int")
    lut = first.select("style", "idx", "t", *[F.when(F.col("idx") == 0, 0).otherwise(shade(c)).alias(c) for c in "rgb"])
    dark = (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)
    alpha = F.when(dark | (F.col("idx") == 0), 0).otherwise(F.least(F.lit(255.0), F.col("t") * 3 * 255).cast("int"))
    return lut.select("style", "idx", "r", "g", "b", alpha.alias("a"))


def colorize(pixels: DataFrame) -> DataFrame:
    """Pixels with an index, in each style's colour."""
    return with_index(pixels).join(F.broadcast(color_lut(pixels.sparkSession)), "idx").select("style", "z", "px", "py", "r", "g", "b", "a")


def top_tracks_layer(pixels: DataFrame) -> DataFrame:
    """Pixels that the top10 style shows."""
    return colorize(pixels).where((F.col("style") == "top10") & (F.col("a") > 0)).drop("style")
