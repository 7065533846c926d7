"""Masks of tracks in tiles, and states that are made of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_rendering import tile_counts

from heatloom.functions import geo
from heatloom.jobs import pixels
from heatloom.operators import masks, raster, render, tiles
from heatloom.schemas import TRACKPOINTS

SEGMENTS = "z int, x long, y long, track_id long, x0 double, y0 double, x1 double, y1 double"


def wander(spark, tracks, n, seed=0, lat=46.5, lon=-87.5, first=1):
    """Tracks of random steps, a few of them long enough to be gaps."""
    rng, rows = random.Random(seed), []
    for t in range(first, first + tracks):
        a, b = lat + rng.uniform(-0.02, 0.02), lon + rng.uniform(-0.02, 0.02)
        for s in range(1, n + 1):
            far = 20 if rng.random() < 0.03 else 1
            a, b = a + far * rng.uniform(-0.002, 0.002), b + far * rng.uniform(-0.002, 0.002)
            rows.append((t, s, a, b))
    return spark.createDataFrame(rows, TRACKPOINTS)


def counts_of(rows, most=10_000, **kw):
    """(z, x, y) to the counts of a tile, by `each_tile`."""
    pick = masks.each_tile(rows, lambda z, x, y, tracks, counts: [(z, x, y, tracks, counts.astype(np.int32).tobytes())], "z int, x long, y long, tracks long, data binary", most, **kw)
    return {(r["z"], r["x"], r["y"]): (r["tracks"], np.frombuffer(bytes(r["data"]), np.int32).reshape(256, 256)) for r in pick.collect()}


@pytest.mark.parametrize("z", [8, 11, 13, 18])
def test_masks_equal_whole_tiles(spark, monkeypatch, z):
    """Segments inside, across, along and beyond the edges of a tile, in one row or many."""
    rng = np.random.default_rng(z)
    ends = np.concatenate([rng.uniform(-300, 560, (60, 4)), rng.integers(-4, 260, (30, 4)).astype(float), rng.uniform(100, 104, (20, 4)), np.repeat(rng.uniform(0, 256, (10, 2)), 2, axis=1)[:, [0, 2, 1, 3]]])
    ends = np.concatenate([ends, np.stack([ends[:9, 0], ends[:9, 1], ends[:9, 0], ends[:9, 3]], axis=1), np.stack([ends[:9, 0], ends[:9, 1], ends[:9, 2], ends[:9, 1]], axis=1)])
    tracks = rng.integers(1, 7, len(ends))
    x, y = 5, 9
    moved = ends + np.array([x, y, x, y]) * 256
    rows = [(z, x, y, int(t), *map(float, e)) for t, e in zip(tracks, moved, strict=True)]
    want = tile_counts(tracks, moved, x, y, z)
    for parts in (1, 7):
        found = counts_of(masks.masks(spark.createDataFrame(rows, SEGMENTS).repartition(parts)).withColumn("inside", F.lit(True)))
        assert list(found) == [(z, x, y)] and (found[z, x, y][1] == want).all()


def test_runs_are_cut_at_tiles_and_united():
    assert masks.runs_of(np.array([3, 4, 5, 9, 65535, 65536, 65537])).tolist() == [[3, 2], [9, 0], [65535, 0], [65536, 1]]
    assert masks.runs_of(np.array([], np.int64)).tolist() == []
    a, b = np.array([[0, 3], [65535, 0]], np.uint16), np.array([[2, 5], [9, 0]], np.uint16)
    assert masks.united([a, b]).tolist() == [[0, 7], [9, 0], [65535, 0]]


def test_a_busy_tile_in_parts_equals_the_whole(spark):
    """3,000 tracks through one tile of zoom 10, with bounded counts, and its first 700 alone."""
    rng = np.random.default_rng(1)
    starts = rng.uniform(0, 256, (3000, 2))
    ends = np.concatenate([starts, starts + rng.uniform(-40, 40, (3000, 2))], axis=1) + np.array([7, 8, 7, 8]) * 256
    rows = [(10, 7, 8, i, *map(float, e)) for i, e in enumerate(ends)]
    made = masks.masks(spark.createDataFrame(rows, SEGMENTS).repartition(16))
    for most in (10_000, 700):
        tracks, counts = counts_of(made, most)[10, 7, 8]
        kept = min(most, 3000)
        assert tracks == kept and (counts == tile_counts(range(kept), ends[:kept], 7, 8, 10)).all()


def test_hits_without_segments_take_a_place_below_the_cap(spark):
    rows = [(10, 1, 1, 1, True, False, b"")] + [(10, 1, 1, t, False, True, np.array([t, 0], np.uint16).tobytes()) for t in (2, 3)]
    (tracks, counts), = counts_of(spark.createDataFrame(rows, masks.MASKS), 2, data_only=True).values()
    assert tracks == 1 and counts.sum() == 1 and counts[0, 2] == 1
    assert counts_of(spark.createDataFrame(rows, masks.MASKS).where("track_id > 1"), data_only=True) == {}
    assert counts_of(spark.createDataFrame([], masks.MASKS)) == {}


def drawn(images):
    return {(r["style"], r["z"], r["x"], r["y"]): (r["tracks"], bytes(r["data"])) for r in images.collect()}


def full(points, first, deepest):
    return drawn(render.render_tiles(points, tiles.data_tiles(points, first, deepest), first, deepest))


def test_added_tracks_equal_a_full_drawing(spark, tmp_path):
    """Three batches, of which one runs twice, all zooms; then tracks go, among them the only one of some tiles."""
    points = wander(spark, 9, 25).unionByName(wander(spark, 1, 25, 5, 10.0, 20.0, 50)).cache()
    state, shown = str(tmp_path / "state"), {}
    for batch, ids in enumerate([(1, 2, 9), (3, 4, 5), (3, 4, 5), (6, 7, 8, 50)]):
        new = points.where(F.col("track_id").isin(*ids))
        shown |= drawn(pixels.add_tracks(new, state, min(batch, 2) if batch < 3 else 3))
        if batch == 1:  # again as another batch of the same tracks: a copy of a mask changes nothing
            before = dict(shown)
    assert {k: v for k, v in before.items() if k not in shown} == {}
    assert shown == full(points, 2, 18)
    images, gone = pixels.remove_tracks(spark, spark.createDataFrame([(50,), (4,)], "track_id long"), state, 4)
    shown |= drawn(images)
    for r in gone.collect():
        for style in raster.RAMPS:
            shown.pop((style, r["z"], r["x"], r["y"]), None)
    left = points.where(~F.col("track_id").isin(50, 4))
    assert shown == full(left, 2, 18)
    pixels.compact(spark, state, str(tmp_path / "compact"))
    assert drawn(render.images(pixels.stored_masks(spark, str(tmp_path / "compact")), data_only=True)) == shown


def test_caps_are_applied_when_a_tile_is_drawn(spark, tmp_path):
    """A track beyond the cap comes in when one before it goes."""
    points, state = wander(spark, 5, 12).cache(), str(tmp_path)
    assert drawn(pixels.add_tracks(points, state, 0, 9, 12, most=2)) == drawn(render.render_tiles(points, tiles.data_tiles(points, 9, 12), 9, 12, most=2))
    images, _ = pixels.remove_tracks(spark, spark.createDataFrame([(1,)], "track_id long"), state, 1, most=2)
    left = points.where("track_id > 1")
    want = drawn(render.render_tiles(left, tiles.data_tiles(left, 9, 12), 9, 12, most=2))
    found = drawn(images)
    assert found and all(want[k] == v for k, v in found.items())


def places(spark, rows):
    return spark.createDataFrame(rows, "z int, x long, y long")


def test_ranges_of_the_curve_hold_what_is_wanted(spark):
    rng = random.Random(2)
    for n in (1, 5, 300):
        rows = [(z, rng.randrange(1 << z), rng.randrange(1 << z)) for z in (rng.randint(2, 18) for _ in range(n))]
        rows += [(18, 70000 + i, 90000) for i in range(n)]
        ranges = pixels.curve_ranges(places(spark, rows))
        assert 0 < len(ranges) <= pixels.RANGES and all(a <= b for a, b in ranges)
        placed = places(spark, rows).select(geo.tile_place(F.col("z"), F.col("x"), F.col("y")).alias("place"))
        assert placed.where(~pixels.in_ranges(ranges)).count() == 0
    assert pixels.curve_ranges(places(spark, [])) == []


def test_a_tile_holds_the_places_of_the_tiles_inside_it(spark):
    rows = [(z, (70123 >> (18 - z)), (90321 >> (18 - z))) for z in range(2, 19)]
    place = {r["z"]: r["p"] for r in places(spark, rows).select("z", geo.tile_place(F.col("z"), F.col("x"), F.col("y")).alias("p")).collect()}
    assert all(place[z] <= place[18] < place[z] + 4 ** (18 - z) for z in range(2, 19))


@pytest.mark.parametrize("z", [5, 18])
def test_one_tile_reads_few_files(spark, tmp_path, z):
    """Of a state of places all over the world in many files, a tile reads those of its zoom and range."""
    spread = [wander(spark, 1, 20, i, -60 + 13 * i, -170 + 34 * i, 1 + i) for i in range(10)]
    points = spread[0]
    for p in spread[1:]:
        points = points.unionByName(p)
    state = str(tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        pixels.write_masks(points, state, 0, 5, 18)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    wanted = tiles.data_tiles(points.where("track_id = 4"), z, z).limit(1)
    found = pixels.stored_masks(spark, state, wanted)
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(place" in plan
    key = wanted.first()
    assert found.count() == pixels.stored_masks(spark, state).where((F.col("z") == z) & (F.col("x") == key["x"]) & (F.col("y") == key["y"])).count() > 0
    every = spark.read.schema(pixels.STORED).parquet(f"{state}/masks")
    files, rows = read_by(every.where((F.col("z") == z) & pixels.in_ranges(pixels.curve_ranges(wanted))))
    assert 0 < files < len(every.inputFiles()) / 3 and 0 < rows < every.count() / 10


def read_by(rows):
    """Files and rows that a scan reads, after skipping."""
    query = rows._jdf.queryExecution()
    query.toRdd().count()
    metrics = query.executedPlan().collectLeaves().head().metrics()
    return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()
