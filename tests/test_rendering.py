import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.functions import geo
from heatloom.jobs import rendering
from heatloom.operators import raster, render, segments, tiles
from heatloom.schemas import TRACKPOINTS


def walk(spark, tracks, n, lat=46.5, lon=-87.5, first=1):
    rows = [(first + t, s, lat + 0.0007 * s + 0.0001 * t, lon + 0.0009 * s * (t % 3 - 1)) for t in range(tracks) for s in range(1, n)]
    return spark.createDataFrame(rows, TRACKPOINTS)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tracks at three places far from each other, laid out by cell."""
    points = walk(spark, 6, 40).unionByName(walk(spark, 6, 40, 10.0, 20.0, 100)).unionByName(walk(spark, 6, 40, -33.0, 151.0, 200))
    folder = str(tmp_path_factory.mktemp("cells"))
    rendering.write_points(points, folder)
    return points, spark.read.parquet(folder).drop("batch_id")


def test_one_dirty_tile_reads_its_cells(spark, stored):
    """The plan filters partitions, and only the cells around the tile hold files that are read."""
    points, table = stored
    wanted = tiles.data_tiles(points.where("track_id = 1"), 14, 14).orderBy("x", "y").limit(1)
    near = tiles.points_near(table, wanted, 14)
    plan = near._sc._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*cell", plan)
    assert 0 < near.count() <= points.where("track_id < 100").count()
    assert {r["track_id"] for r in near.select("track_id").distinct().collect()} <= set(range(1, 100))
    z = 14
    whole = segments.tile_segments(points, wanted, z, z).collect()
    assert sorted(map(tuple, segments.tile_segments(near, wanted, z, z, whole=False).collect())) == sorted(map(tuple, whole)) and whole


@pytest.mark.parametrize("place", [(46.5, -87.5), (84.0, 20.0), (0.0, 179.999)])
def test_pruned_drawing_equals_full(spark, place):
    """All zooms, near a pole and at the edge of the map, where a cell is narrow or has no neighbour."""
    points = walk(spark, 4, 30, *place).unionByName(walk(spark, 4, 30, 10.0, 20.0, 50)).where(F.col("lon") <= 180)
    wanted = tiles.data_tiles(points.where("track_id = 2"))
    draw = lambda prune: {(r["style"], r["z"], r["x"], r["y"]): bytes(r["data"]) for r in render.render_tiles(tiles.with_cell(points), wanted, 2, 18, prune=prune).collect()}
    assert draw(True) == draw(False)


@pytest.mark.parametrize("lat", [46.5, 84.5])
def test_long_segments_into_a_deep_tile(spark, lat):
    """Segments of 0.9 km reach tiles of zoom 18 from points that lie many such tiles away."""
    east = float(0.9 / 111.19 / np.cos(np.radians(lat)))
    points = spark.createDataFrame([(t, s, lat + 0.002 * t, 10.0 + east * (s + 0.3 * t)) for t in range(3) for s in range(1, 9)], TRACKPOINTS)
    wanted = tiles.data_tiles(points.where("track_id = 1 AND seq = 4"), 18, 18)
    draw = lambda prune: sorted(map(tuple, render.drawn_segments(tiles.with_cell(points), wanted, 18, 18, prune=prune).collect()))
    assert draw(True) == draw(False) and len(draw(True)) >= 2


def test_overviews_have_a_row_for_each_track_and_pixel(spark):
    """Thousands of points within a pixel come to the tile as one row for each track."""
    rows = [(t, s, 46.5 + 0.00001 * (s % 50), -87.5 + 0.00001 * (s % 70)) for t in range(3) for s in range(1, 1500)]
    points = spark.createDataFrame(rows, TRACKPOINTS)
    drawn = render.drawn_segments(points, tiles.data_tiles(points, 2, 8), 2, 8)
    assert drawn.groupBy("z", "x", "y").count().agg(F.max("count")).first()[0] <= 3 * 4


def cover(ends, width):
    """(segment, px, py) of whole segments, step by step."""
    for i, (x0, y0, x1, y1) in enumerate(ends):
        dx, dy = x1 - x0, y1 - y0
        n = max(1, math.ceil(max(abs(dx), abs(dy))))
        for k in range(n + 1):
            px, py = math.floor(x0 + dx * k / n), math.floor(y0 + dy * k / n)
            for o in range(-((width - 1) // 2), width // 2 + 1):
                yield (i, px, py + o) if abs(dx) >= abs(dy) else (i, px + o, py)


def tile_counts(tracks, ends, x, y, z):
    """Distinct tracks over each pixel of a tile, from all its segments at once."""
    met = {(tracks[i], px - x * 256, py - y * 256) for i, px, py in cover(ends, raster.WIDTHS.get(z, 4))}
    counts = np.zeros((256, 256), int)
    for _, px, py in met:
        if 0 <= px < 256 and 0 <= py < 256:
            counts[py, px] += 1
    return counts


@pytest.mark.parametrize("z", [3, 6, 8, 10])
def test_images_equal_sql_pixels(spark, z):
    points = walk(spark, 6, 60)
    found = {}
    for r in render.drawn_segments(points, tiles.data_tiles(points, z, z), z, z).groupBy("x", "y").agg(F.collect_list(F.struct("track_id", "x0", "y0", "x1", "y1")).alias("s")).collect():
        ends = np.array([[s["x0"], s["y0"], s["x1"], s["y1"]] for s in r["s"]])
        counts = tile_counts(np.array([s["track_id"] for s in r["s"]]), ends, r["x"], r["y"], z)
        found |= {(r["x"] * 256 + px, r["y"] * 256 + py): int(counts[py, px]) for py, px in zip(*counts.nonzero(), strict=True)}
    data = {(r["x"], r["y"]) for r in tiles.data_tiles(points, z, z).collect()}
    want = {(r["px"], r["py"]): r["tracks"] for r in raster.pixel_intensity(points, z).collect()}
    assert found == {k: v for k, v in want.items() if (k[0] // 256, k[1] // 256) in data}


def test_caps_below_the_limits_of_overviews(spark):
    for most, want in ((100, [100, 100, 100]), (1000, [500, 1000, 1000]), (10_000, [500, 2000, 10_000])):
        row = spark.range(1).select(*[geo.segment_cap(F.lit(z), most).alias(str(z)) for z in (4, 8, 9)]).first()
        assert list(row) == want
    points = walk(spark, 6, 5)
    hits = segments.cap_tracks(tiles.track_tile_hits(points, 3, 3), 2)
    assert hits.groupBy("z", "x", "y").count().agg(F.max("count")).first()[0] == 2


@pytest.mark.parametrize("sigma", [0.4, 0.6])
def test_blur_around_colours_equals_the_whole(sigma):
    rng = np.random.default_rng(0)
    for spots in ([], [(0, 0)], [(255, 3), (100, 255)], [(120, 130), (121, 133)]):
        rgba = np.zeros((256, 256, 4), np.uint8)
        for y, x in spots:
            rgba[y, x] = rng.integers(1, 255, 4)
        reach = max(1, int(np.ceil(3 * sigma)))
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        kernel /= kernel.sum()
        out = np.pad(rgba.astype(float), ((reach, reach), (reach, reach), (0, 0)), mode="edge")
        out = sum(k * out[i : i + 256] for i, k in enumerate(kernel))
        out = sum(k * out[:, i : i + 256] for i, k in enumerate(kernel))
        assert (render.blurred(rgba, sigma) == np.rint(out).astype(np.uint8)).all()


def test_empty_tracks_are_not_stored(spark, tmp_path):
    rows = [(1, 1, 1.0, 2.0), (1, 2, 1.5, None), (2, 1, None, None)]
    rendering.write_tracks(spark.createDataFrame(rows, TRACKPOINTS), str(tmp_path))
    assert [(r["track_id"], r["num_points"], r["max_lon"]) for r in spark.read.parquet(f"{tmp_path}/tracks").collect()] == [(1, 1, 2.0)]
