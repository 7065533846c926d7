"""Hits and masks made track by track, against the rows of SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pixels import counts_of, wander

from heatloom.jobs import pixels
from heatloom.operators import masks, render, segments, tiles, tracing
from heatloom.schemas import TRACKPOINTS


def odd(spark):
    """Tracks near a pole, at the edges of the map and on the spot, with gaps in seq and points without a usable place."""
    rows = [(60, s, 84.95 + 0.0004 * s, 179.99 + 0.0005 * s) for s in range(1, 25)] + [(61, 1, 46.5, -87.5)]
    rows += [(62, s, 46.5, -87.5) for s in range(1, 9)] + [(63, 3 * s, 46.5 + 0.001 * s, -87.5) for s in range(1, 20)]
    rows += [(64, s, None if s == 4 else 46.51 + 0.001 * s, float("nan") if s == 9 else None if s == 12 else -87.49) for s in range(1, 20)]
    rows += [(65, s, 89.0 + 0.001 * s, -180.0) for s in range(1, 5)] + [(66, s, -85.06, 0.0005 * s) for s in range(5)] + [(67, -s, 46.5, -87.5 + 0.001 * s) for s in range(9)]
    return wander(spark, 6, 40).unionByName(spark.createDataFrame(rows, TRACKPOINTS))


def pixels_of(rows):
    """(z, x, y, track_id) to the pixels of drawn masks."""
    found = {}
    for r in rows.where("drawn").collect():
        runs = np.frombuffer(r["runs"], np.uint16).reshape(-1, 2)
        found.setdefault((r["z"], r["x"], r["y"], r["track_id"]), set()).update(p for a, n in runs.tolist() for p in range(a, a + n + 1))
    return found


def test_hits_equal_sql(spark):
    points = odd(spark).repartition(3).cache()
    rows = lambda df: sorted(map(tuple, df.select(*tracing.NAMES).collect()))
    want = rows(tiles.track_tile_hits(points, 2, 18, inside=True))
    assert rows(tracing.hits(points, 2, 18)) == want and want


@pytest.mark.parametrize("bits", [3, 14])
@pytest.mark.parametrize("whole", [True, False])
def test_masks_equal_segments_of_hits(spark, monkeypatch, whole, bits):
    """Whole tracks, parts of tracks, and tracks in parts of 8 segments."""
    monkeypatch.setattr(tracing, "CHUNK_BITS", bits)
    points = odd(spark).where(F.lit(whole) | (F.col("seq") % 7 != 0)).cache()
    for low, high in ((2, 8), (9, 13), (14, 18)):
        hits = tracing.hits(points, low, high)
        want = pixels_of(masks.masks(render.in_pixels(segments.segments_of_hits(points, hits.drop("inside"), whole), high)))
        assert pixels_of(tracing.track_masks(points, hits, whole)) == want and want


def test_drawing_makes_no_row_for_a_segment_in_a_tile(spark, tmp_path, monkeypatch):
    """These rows were what drawing and stored pixels joined and shuffled: some 70 for each point."""
    monkeypatch.setattr(segments, "segments_of_hits", None)
    points = wander(spark, 3, 10)
    assert render.render_tiles(points, tiles.data_tiles(points, 2, 18), 2, 18).count() > 0
    assert pixels.add_tracks(points, str(tmp_path), 0).count() > 0


def test_a_long_segment_in_many_tiles_comes_in_parts(monkeypatch):
    """Little room for candidates and spans changes nothing."""
    rng = np.random.default_rng(3)
    ends = rng.uniform(0.500, 0.502, (40, 4))
    lines = np.arange(40)
    tile = np.unique((ends.reshape(-1, 2) * 2**13).astype(np.int64), axis=0)
    hits = np.concatenate([tile, np.zeros((len(tile), 1), int), np.full((len(tile), 1), 99)], axis=1).astype(float)
    every = np.concatenate([ends, hits])
    group, seq, own = np.zeros(len(every), int), np.arange(len(every)), np.arange(40, len(every))
    draw = lambda: [a.tolist() for a in tracing._zoom(13, lines, group, seq, every, own, tile[:, 0], tile[:, 1])]
    whole = draw()
    for name, module in (("CANDIDATES", tracing), ("SPANS", tracing), ("STEPS", masks)):
        monkeypatch.setattr(module, name, 64)
    assert draw() == whole and len(whole[1]) > 100


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_masks_of_a_track_in_several_rows_and_batches(spark, size):
    rng, rows, want = np.random.default_rng(size), [], {}
    for t in sorted(rng.integers(1, 30, 70).tolist()):
        covered = np.unique(rng.integers(0, 40, rng.integers(0, 9)))
        rows.append((10, 1, 1, t, True, bool(t % 5), masks.packed(*masks.united_spans(covered << 8), 1)[0].as_py() if t % 5 else b""))
        if t % 5:
            want.setdefault(t, set()).update(covered.tolist())
    kept = [t for t in sorted({r[3] for r in rows})[:20] if t % 5]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        (tracks, counts), = counts_of(spark.createDataFrame(rows, masks.MASKS), 20).values()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert tracks == len(kept)
    assert counts.ravel()[:40].tolist() == [sum(p in want[t] for t in kept) for p in range(40)] and counts.ravel()[40:].sum() == 0
