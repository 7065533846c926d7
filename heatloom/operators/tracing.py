"""What tracks draw in tiles, track by track: which tiles they hit, and the masks of these hits.

`segments.tile_segments` has a row for each segment and tile. Here numpy meets a track's segments with its hits inside a task, so
only slim hits (a row for each tile and track) and masks are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions import geo
from heatloom.functions.geo import PADDING, TILE
from heatloom.operators import masks, raster, segments
from heatloom.tables import shuffle_partitions

HITS = "z int, x long, y long, track_id long, first_seq long, last_seq long, inside boolean"
NAMES = [f.split()[0] for f in HITS.split(", ")]
#: Seqs of a track that are drawn together; a longer track comes in parts, with the hits that reach into each.
CHUNK_BITS = 14
#: Rows that are worked on at once, about, if groups allow it; candidates for a segment's tiles; spans that wait to be united.
ROWS, CANDIDATES, SPANS = 1 << 13, 1 << 16, 1 << 21


def _north(y: np.ndarray, side: float) -> np.ndarray:
    """geo.tile_lat of rows, each different one computed once."""
    low, high = int(y.min()), int(y.max())
    rows, back = (np.arange(low, high + 1), y - low) if high - low <= len(y) else np.unique(y, return_inverse=True)
    return np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * rows / side))))[back]


def _near(z: int, lat: np.ndarray, lon: np.ndarray, mx: np.ndarray, my: np.ndarray, padding: float) -> tuple[np.ndarray, ...]:
    """(point, x, y, own) of the tiles that hold points, grown by padding: a point's own tile and those of its eight neighbours."""
    side = 2.0**z
    hx, hy = (np.nan_to_num(np.clip(np.floor(m * side), 0, side - 1)).astype(np.int64) for m in (mx, my))
    xs, ys = [], []
    for d in (-1, 0, 1):
        x, y = hx + d, hy + d
        west, east = x / side * 360.0 - 180.0, (x + 1) / side * 360.0 - 180.0
        north, south = _north(y, side), _north(y + 1, side)
        dlon, dlat = (east - west) * padding, (north - south) * padding
        xs.append((lon >= west - dlon) & (lon <= east + dlon) & (x >= 0) & (x < side))
        ys.append((lat >= south - dlat) & (lat <= north + dlat) & (y >= 0) & (y < side))
    met = [(np.flatnonzero(xs[a + 1] & ys[b + 1]), a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    point = np.concatenate([i for i, _, _ in met])
    x, y = (np.concatenate([h[m[0]] + m[k] for m in met]) for k, h in ((1, hx), (2, hy)))
    return point, x, y, np.repeat([a == 0 and b == 0 for _, a, b in met], [len(i) for i, _, _ in met])


def hits(points: DataFrame, first: int, deepest: int, padding: float = PADDING) -> DataFrame:
    """HITS: the rows of tiles.track_tile_hits (with `inside`), which batches of points sum up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            track, seq, lat, lon, mx, my = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            tracks, own = np.unique(track, return_inverse=True)
            for z in range(first, deepest + 1):
                point, x, y, home = _near(z, lat, lon, mx, my, padding)
                if not len(point):
                    continue
                order = np.lexsort((y, x, own[point])) if 2 * z + len(tracks).bit_length() > 62 else np.argsort((own[point] << 2 * z) | (x << z) | y)
                point, x, y, home = point[order], x[order], y[order], home[order]
                t, s = own[point], seq[point]
                start = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
                columns = [np.full(len(start), z, np.int32), x[start], y[start], tracks[t[start]], np.minimum.reduceat(s, start), np.maximum.reduceat(s, start), np.logical_or.reduceat(home, start)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=NAMES)

    placed = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    placed = placed.select("track_id", "seq", "lat", "lon", geo.mercator_x(F.col("lon")).alias("mx"), geo.mercator_y(F.col("lat")).alias("my"))
    return placed.mapInArrow(run, HITS).groupBy("z", "x", "y", "track_id").agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.max("inside").alias("inside"))


def track_masks(points: DataFrame, found: DataFrame, whole: bool = True) -> DataFrame:
    """masks.MASKS of hits (HITS; whatever other columns follow are kept): what tracks draw in the tiles that they hit.

    The rule is that of segments.segments_of_hits. Every hit has a row, drawn or not, for each part of its track. A track's
    segments and hits meet in one task, in groups of at most 2^CHUNK_BITS segments.
    """
    pairs = segments.drop_gaps(segments.segments(points, whole))
    ends = [f(F.col(c)).alias(n) for n, f, c in (("a", geo.mercator_x, "lon0"), ("b", geo.mercator_y, "lat0"), ("c", geo.mercator_x, "lon1"), ("d", geo.mercator_y, "lat1"))]
    part = lambda seq: F.call_function("shiftright", seq, F.lit(CHUNK_BITS))
    extra = [f for f in found.schema.fields if f.name not in NAMES]
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in extra]
    drawn = pairs.select("track_id", part(F.col("seq")).alias("chunk"), F.lit(-1).alias("z"), "seq", *ends, *more)
    chunks = F.explode(F.sequence(part(F.col("first_seq") - 1), part(F.col("last_seq")))).alias("chunk")
    # a hit has its tile and seqs where a segment has its ends, and `inside` in place of a seq; all are exact as doubles
    slim = found.select("track_id", chunks, "z", F.col("inside").cast("long").alias("seq"), *[F.col(c).cast("double").alias(n) for n, c in zip("abcd", ("x", "y", "first_seq", "last_seq"), strict=True)], *[f.name for f in extra])
    # by number: few bytes of segments are much work, and Spark would put small partitions together
    rows = drawn.unionByName(slim).repartition(shuffle_partitions(points.sparkSession), "track_id", "chunk").sortWithinPartitions("track_id", "chunk", "z")
    schema = masks.MASKS + "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra)
    return rows.mapInArrow(lambda batches: _drawn(batches, [f.name for f in extra]), schema)


def _drawn(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[pa.RecordBatch]:
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            table = pa.Table.from_batches(waiting)
            track, chunk = (table.column(c).to_numpy() for c in ("track_id", "chunk"))
            ends = np.flatnonzero((track[1:] != track[:-1]) | (chunk[1:] != chunk[:-1]))
            if len(ends):
                yield from _groups(table.slice(0, ends[-1] + 1), extra)
                table = table.slice(ends[-1] + 1)
            waiting, rows = table.to_batches(), table.num_rows
    if rows:
        yield from _groups(pa.Table.from_batches(waiting), extra)


def _groups(table: pa.Table, extra: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups (track_id, chunk) of segments (z -1) and hits."""
    track, chunk, zoom, seq = (table.column(c).to_numpy() for c in ("track_id", "chunk", "z", "seq"))
    ends = np.stack([table.column(c).to_numpy() for c in "abcd"], axis=1)
    group = np.cumsum(np.concatenate([[0], (track[1:] != track[:-1]) | (chunk[1:] != chunk[:-1])]))
    lines = np.flatnonzero(zoom < 0)
    for z in np.unique(zoom[zoom >= 0]).tolist():
        own = np.flatnonzero(zoom == z)
        x, y = ends[own, 0].astype(np.int64), ends[own, 1].astype(np.int64)
        order = np.lexsort((y, x, group[own]))
        own, x, y = own[order], x[order], y[order]
        has = np.zeros(group[-1] + 1, bool)
        has[group[own]] = True
        drawn, begins, lasts = _zoom(z, lines[has[group[lines]]], group, seq, ends, own, x, y)
        columns = [pa.array(np.full(len(own), z, np.int32)), pa.array(x), pa.array(y), pa.array(track[own]), pa.array(seq[own] != 0), pa.array(drawn), masks.packed(begins, lasts, len(own))]
        more = [table.column(c).combine_chunks().take(pa.array(own)) for c in extra]
        yield pa.RecordBatch.from_arrays(columns + more, names=masks.NAMES + extra)


def _zoom(z: int, lines: np.ndarray, group: np.ndarray, seq: np.ndarray, ends: np.ndarray, own: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each hit (sorted by group, x, y) has a segment near it, and the runs of pixels of all, coded as in masks.united_spans."""
    drawn, waiting, spans = np.zeros(len(own), bool), [], 0
    pixels = ends[lines] * 2.0**z * TILE
    low = np.maximum(np.floor((np.minimum(pixels[:, :2], pixels[:, 2:]) - TILE / 2) / TILE), 0).astype(np.int64)
    high = np.minimum(np.floor((np.maximum(pixels[:, :2], pixels[:, 2:]) + TILE / 2) / TILE), 2.0**z - 1).astype(np.int64)
    wide, tall = np.maximum(high - low + 1, 0).T
    # groups and tiles as one number: columns and rows are counted from the first that a hit has
    left, top = x.min(initial=1 << 62), y.min(initial=1 << 62)
    columns, rows = int(x.max(initial=0)) - left + 1, int(y.max(initial=0)) - top + 1
    keys = (group[own] * columns + x - left) * rows + y - top
    first, last = ends[own, 2], ends[own, 3]
    for some in np.split(np.arange(len(lines)), np.flatnonzero(np.diff(np.cumsum(wide * tall) // CANDIDATES)) + 1):
        count = wide[some] * tall[some]
        which = np.repeat(some, count)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        across, down = np.divmod(turn, tall[which])
        across, down = across + low[which, 0] - left, down + low[which, 1] - top
        inside = (across >= 0) & (across < columns) & (down >= 0) & (down < rows)
        which, line = which[inside], lines[which[inside]]
        code = (group[line] * columns + across[inside]) * rows + down[inside]
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        met = np.flatnonzero((keys[at] == code) & (seq[line] >= first[at] - 1) & (seq[line] <= last[at]))
        which, at = which[met], at[met]
        drawn[at] = True
        steps = np.maximum(np.abs(pixels[which, 2] - pixels[which, 0]), np.abs(pixels[which, 3] - pixels[which, 1])).clip(1, 2 * TILE)
        for p in np.split(np.arange(len(which)), np.flatnonzero(np.diff(np.cumsum(steps) // masks.STEPS)) + 1):
            found = masks.spans(pixels[which[p]], x[at[p]] * TILE, y[at[p]] * TILE, raster.WIDTHS.get(z, 4), at[p])
            waiting.append(found)
            spans += len(found)
            if spans > SPANS and len(waiting) > 1:  # the union so far waits as spans again
                waiting = [masks.as_spans(*masks.united_spans(np.concatenate(waiting)))]
                spans = len(waiting[0])
    return drawn, *masks.united_spans(np.concatenate(waiting) if waiting else np.zeros(0, np.int64))
