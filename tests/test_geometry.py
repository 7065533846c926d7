import math

import pytest
from pyspark.sql import functions as F

from heatloom.functions import geo
from heatloom.operators import raster, render, segments, tiles
from heatloom.schemas import TRACKPOINTS


def scalar(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("lat, lon, z, want", [(90.0, 0.0, 3, (4, 0)), (-90.0, 0.0, 3, (4, 7)), (0.0, 180.0, 2, (3, 2)), (0.0, -180.0, 2, (0, 2)), (85.06, 180.0, 18, (2**18 - 1, 0))])
def test_edges_of_the_map(spark, lat, lon, z, want):
    x = scalar(spark, geo.tile_of(geo.mercator_x(F.lit(lon)), F.lit(z)))
    y = scalar(spark, geo.tile_of(geo.mercator_y(F.lit(lat)), F.lit(z)))
    assert (x, y) == want


@pytest.mark.parametrize("z, x, y, want", [(0, 0, 0, 0), (1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 1, 3), (1, 1, 0, 4), (12, 3423, 1763, 19078479)])
def test_tile_id(spark, z, x, y, want):
    assert scalar(spark, geo.tile_id(F.lit(z), F.lit(x), F.lit(y))) == want


def test_tile_ids_are_a_curve(spark):
    """All 256 tiles of zoom 4 have different ids without holes, and neighbours in id are neighbours on the map."""
    side = spark.range(16)
    rows = side.select(F.col("id").alias("x")).crossJoin(side.select(F.col("id").alias("y"))).withColumn("z", F.lit(4))
    found = sorted((r["t"], r["x"], r["y"]) for r in rows.withColumn("t", geo.tile_id(F.col("z"), F.col("x"), F.col("y"))).collect())
    assert [t for t, _, _ in found] == list(range(85, 341))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(found, found[1:], strict=False))


def test_gap_of_one_km_is_kept(spark):
    one_km = math.degrees(1 / 6371)
    pairs = spark.createDataFrame([(1, 1, 0.0, 0.0, one_km * 0.999999, 0.0), (1, 2, 0.0, 0.0, one_km * 1.0001, 0.0)], "track_id long, seq long, lat0 double, lon0 double, lat1 double, lon1 double")
    assert [r["seq"] for r in segments.drop_gaps(pairs).collect()] == [1]


def points(spark, rows):
    return spark.createDataFrame(rows, TRACKPOINTS)


def test_parents_of_data_tiles(spark):
    p = points(spark, [(t, s, 46.5 + 0.01 * s, -87.5 + 0.003 * t * s) for t in range(4) for s in range(1, 9)])
    found = {(r["z"], r["x"], r["y"]) for r in tiles.data_tiles(p).collect()}
    assert {(z - 1, x // 2, y // 2) for z, x, y in found if z > 2} == {t for t in found if t[0] < 18}


def test_one_point_and_empty_tracks(spark):
    p = points(spark, [(1, 1, 10.0, 10.0)])
    assert segments.segments(p).count() == 0
    assert tiles.data_tiles(p).count() == 17
    assert tiles.data_tiles(points(spark, [])).count() == 0
    assert render.render_tiles(p, tiles.data_tiles(p, 14, 14), 14, 14).count() == 0


def test_padded_membership_is_wider(spark):
    """A point just outside a tile is a hit of it but makes it no data tile."""
    west = -180 + 360 / 2**14 * 5000
    p = points(spark, [(1, 1, 46.5, west - 360 / 2**14 * 0.05), (1, 2, 46.5, west - 360 / 2**14 * 0.06)])
    hits = {r["x"] for r in tiles.track_tile_hits(p, 14, 14).collect()}
    data = {r["x"] for r in tiles.data_tiles(p, 14, 14).collect()}
    assert hits == {4999, 5000} and data == {4999}


@pytest.mark.parametrize("z", [8, 11, 14])
def test_drawn_pixels_equal_sql_pixels(spark, z):
    """The rasteriser and the SQL path count the same tracks in every pixel of tiles whose tracks all hit them."""
    p = points(spark, [(t, s, 46.5 + 0.0007 * s + 0.0001 * t, -87.5 + 0.0009 * s * (t % 3 - 1)) for t in range(6) for s in range(1, 40)])
    wanted = tiles.data_tiles(p, z, z)
    drawn = segments.tile_segments(p, wanted, z, z)
    zoom = F.lit(z)
    ends = drawn.select("x", "y", "track_id", *[geo.global_pixel(f(F.col(c)), zoom).alias(n) for n, f, c in (("x0", geo.mercator_x, "lon0"), ("y0", geo.mercator_y, "lat0"), ("x1", geo.mercator_x, "lon1"), ("y1", geo.mercator_y, "lat1"))]).toPandas()
    found = {}
    for (x, y), part in ends.groupby(["x", "y"]):
        counts = render.tile_counts(part["track_id"].to_numpy(), part[["x0", "y0", "x1", "y1"]].to_numpy(), int(x), int(y), z)
        for py, px in zip(*counts.nonzero(), strict=True):
            found[(x * 256 + px, y * 256 + py)] = int(counts[py, px])
    want = {(r["px"], r["py"]): r["tracks"] for r in raster.pixel_intensity(p, z).collect()}
    data = {(r["x"], r["y"]) for r in wanted.collect()}
    want = {k: v for k, v in want.items() if (k[0] // 256, k[1] // 256) in data}
    assert found == want


def test_lut_of_renderer_and_sql(spark):
    for r in raster.color_lut(spark).collect():
        assert render.lut_array(r["style"])[r["idx"]].tolist() == [r["r"], r["g"], r["b"], r["a"]]


def test_top_layer_thresholds(spark):
    """From 4 tracks at z8 and below, 11 at z9 to 11, 8 at z12 to 14."""
    rows = [(z, k, 0, k) for z in (8, 11, 14, 15) for k in range(1, 17)]
    shown = raster.top_tracks_layer(spark.createDataFrame(rows, "z int, px long, py long, tracks long")).groupBy("z").agg(F.min("px").alias("k")).collect()
    assert {r["z"]: r["k"] for r in shown} == {8: 4, 11: 11, 14: 8, 15: 4}


def test_png_round_trip():
    import struct
    import zlib

    import numpy as np

    image = np.arange(256 * 256 * 4, dtype=np.uint32).astype(np.uint8).reshape(256, 256, 4)
    data = render.png(image)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (256, 256)
    size = struct.unpack(">I", data[33:37])[0]
    rows = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(256, 1025)
    assert (rows[:, 1:].reshape(256, 256, 4) == image).all()
