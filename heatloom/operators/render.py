"""Tile images: the one step that needs arrays, so it runs as numpy inside Spark tasks, on masks of tracks in tiles."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions import geo
from heatloom.operators import masks, raster, segments, tiles, tracing

TILE = geo.TILE
SCHEMA = "style string, z int, x long, y long, tracks long, data binary"


def png(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA image of (height, width, 4) as PNG."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = rgba.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + chunk(b"IEND", b"")


def blurred(rgba: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur of each channel, edges repeated; only what lies around coloured pixels is computed."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    shown = rgba.any(axis=2)
    if not shown.any():
        return rgba
    rows, columns = np.flatnonzero(shown.any(axis=1)), np.flatnonzero(shown.any(axis=0))
    top, bottom = max(0, rows[0] - 2 * reach), min(TILE, rows[-1] + 2 * reach + 1)
    left, right = max(0, columns[0] - 2 * reach), min(TILE, columns[-1] + 2 * reach + 1)
    out = np.pad(rgba[top:bottom, left:right].astype(np.float64), ((reach, reach), (reach, reach), (0, 0)), mode="edge")
    out = sum(k * out[i : i + bottom - top] for i, k in enumerate(kernel))
    out = sum(k * out[:, i : i + right - left] for i, k in enumerate(kernel))
    whole = np.zeros_like(rgba)
    whole[top:bottom, left:right] = np.rint(out).astype(np.uint8)
    return whole


@lru_cache
def lut_array(style: str) -> np.ndarray:
    """raster.color_lut of one style as a (256, 4) array."""
    t = np.arange(256) / 255.0
    ramp = raster.RAMPS[style]
    out = np.zeros((256, 4), dtype=np.uint8)
    for i in range(1, 256):
        a, b = next((a, b) for a, b in zip(ramp, ramp[1:], strict=False) if a[0] <= t[i] <= b[0])
        share = (t[i] - a[0]) / (b[0] - a[0])
        shade = [int(a[c] + (b[c] - a[c]) * share) for c in (1, 2, 3)]
        out[i] = [*shade, int(min(255.0, t[i] * 3 * 255)) if any(shade) else 0]
    return out


def _images(z: int, x: int, y: int, tracks: int, counts: np.ndarray) -> list[tuple]:
    """The three images of a tile."""
    cap = 5 if z <= 8 else 15 if z <= 11 else 10 if z <= 14 else 5
    index = (np.minimum(1.0, np.log1p(np.arange(counts.max() + 1)) / np.log1p(cap)) * 255).astype(np.int64)
    sigma = 0.6 if z <= 8 else 0.4 if z <= 11 else 0.0
    found = []
    for style in raster.RAMPS:
        rgba = lut_array(style)[index].view(np.uint32).ravel()[counts].view(np.uint8).reshape(TILE, TILE, 4)
        found.append((style, z, x, y, tracks, png(blurred(rgba, sigma) if sigma else rgba)))
    return found


def images(rows: DataFrame, most: int = 10_000, data_only: bool = False) -> DataFrame:
    """style, z, x, y, tracks, data (PNG) of the tiles of `masks.MASKS` rows."""
    return masks.each_tile(rows, _images, SCHEMA, most, data_only)


#: Zooms that are drawn from one reading of the points. The first has lines of one pixel.
BANDS = ((0, 8), (9, 13), (14, 22))


def in_pixels(found: DataFrame, high: int) -> DataFrame:
    """z, x, y, track_id and the ends (x0, y0, x1, y1, in global pixels) of segments of tiles up to zoom `high`.

    Where lines are one pixel wide, a segment within a pixel is moved to the pixel's centre and each track has it once, so an
    overview tile has no more such rows than its tracks have pixels, however many points lie in it.
    """
    z = F.col("z")
    drawn = found.select("z", "x", "y", "track_id", *[geo.global_pixel(f(F.col(c)), z).alias(n) for n, f, c in (("x0", geo.mercator_x, "lon0"), ("y0", geo.mercator_y, "lat0"), ("x1", geo.mercator_x, "lon1"), ("y1", geo.mercator_y, "lat1"))])
    if high <= BANDS[0][1]:
        one = (F.floor("x0") == F.floor("x1")) & (F.floor("y0") == F.floor("y1"))
        drawn = drawn.withColumn("one", one)
        drawn = drawn.select("z", "x", "y", "track_id", *[F.when(F.col("one"), F.floor(c) + 0.5).otherwise(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")]).distinct()
    return drawn


def bands(first: int, deepest: int) -> list[tuple[int, int]]:
    """The parts of BANDS that lie in some zooms."""
    return [(max(low, first), min(high, deepest)) for low, high in BANDS if max(low, first) <= min(high, deepest)]


def drawn_segments(points: DataFrame, wanted: DataFrame, first: int, deepest: int, most: int = 10_000, prune: bool = False) -> DataFrame:
    """What is drawn in each wanted tile, as `in_pixels`, in bands of zooms; with `prune` each band reads only the points that
    its wanted tiles need (`tiles.points_near`)."""
    found = None
    for low, high in bands(first, deepest):
        own = wanted.where(F.col("z").between(low, high))
        near = tiles.points_near(points, own, low) if prune else points.drop("cell")
        drawn = in_pixels(segments.tile_segments(near, own, low, high, most, whole=not prune), high)
        found = drawn if found is None else found.unionByName(drawn)
    return found


def drawn_masks(points: DataFrame, wanted: DataFrame, first: int, deepest: int, most: int = 10_000, prune: bool = False) -> DataFrame:
    """masks.MASKS of what `drawn_segments` are; with `prune` in bands of zooms, else all at once."""
    found = None
    for low, high in bands(first, deepest) if prune else [(first, deepest)]:
        own = wanted.where(F.col("z").between(low, high)).select("z", "x", "y")
        near = tiles.points_near(points, own, low) if prune else points.drop("cell")
        hits = tracing.hits(near, low, high).join(own, ["z", "x", "y"], "left_semi")
        rows = tracing.track_masks(near, segments.cap_tracks(hits, most), whole=not prune).where("drawn")
        found = rows if found is None else found.unionByName(rows)
    return found


def render_tiles(points: DataFrame, wanted: DataFrame, first: int, deepest: int, most: int = 10_000, prune: bool = False) -> DataFrame:
    """style, z, x, y, tracks, data (PNG) of each wanted tile (z, x, y) with something to draw.

    A tile is drawn by several tasks: hits are capped before segments meet them, segments become masks of one track each where
    they meet, and what is shuffled to the tile are masks. `prune` pays where few tiles are wanted.
    """
    return images(drawn_masks(points, wanted, first, deepest, most, prune), most)


def pixels_of(data: bytes) -> np.ndarray:
    """(height, width, 4) of an image that `png` wrote."""
    width, height = struct.unpack(">II", data[16:24])
    size = struct.unpack(">I", data[33:37])[0]
    rows = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(height, 1 + 4 * width)
    return rows[:, 1:].reshape(height, width, 4)


def with_sums(images: DataFrame) -> DataFrame:
    """style, z, x, y, tracks of images, with the number of visible pixels and the sums of their four channels."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for images in batches:
            sums = [[int((p[..., 3] > 0).sum()), *p[p[..., 3] > 0].sum(axis=0, dtype=np.int64).tolist()] for p in map(pixels_of, images)]
            yield pd.DataFrame(sums, columns=["shown", "r", "g", "b", "a"], dtype="int64")

    sums = F.pandas_udf(run, "shown long, r long, g long, b long, a long")("data")
    return images.withColumn("sums", sums).select("style", "z", "x", "y", "tracks", "sums.*")


#: A transparent tile.
EMPTY_PNG = png(np.zeros((TILE, TILE, 4), dtype=np.uint8))


def empty_tiles(requests: DataFrame, images: DataFrame) -> DataFrame:
    """Requested addresses (style, z, x, y) with their image, or the transparent one."""
    return requests.join(images.select("style", "z", "x", "y", "data"), ["style", "z", "x", "y"], "left").withColumn("data", F.coalesce("data", F.lit(EMPTY_PNG)))
