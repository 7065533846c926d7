"""Which pixels of a tile each track covers, as rows that are made anywhere, united later, and stored.

A mask is the runs of pixels (row by row, 65,536 in a tile) that one track covers in one tile. Tracks don't depend on each
other, so a tile is drawn from masks that many tasks made, one row at a time; adding or taking away a track touches its masks
only. A track's mask may come in several rows, whose union counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions import geo
from heatloom.operators import raster

TILE = geo.TILE
#: `inside`: a point of the track lies in the tile itself, not in its padding alone; `drawn`: a segment comes near the tile.
#: `runs` are pairs of unsigned 16-bit numbers: a first pixel, and how many follow.
MASKS = "z int, x long, y long, track_id long, inside boolean, drawn boolean, runs binary"
NAMES = ["z", "x", "y", "track_id", "inside", "drawn", "runs"]
#: Steps of segments that are taken at once, about: few enough for the arrays to stay in a cache.
STEPS = 1 << 17


def spans(ends: np.ndarray, left: np.ndarray, top: np.ndarray, width: int, own: np.ndarray) -> np.ndarray:
    """Spans of pixels along rows that segments cover, each in the tile whose first pixel is (left, top), as one number:
    ((own * 256 + row) * 256 + first column) * 256 + how many follow. Spans may overlap (see united_spans).

    The rule is that of raster.covered_pixels; steps that are surely outside the tile are left out before they are taken.
    """
    x0, y0, x1, y1 = ends.T
    dx, dy = x1 - x0, y1 - y0
    n = np.maximum(1, np.ceil(np.maximum(np.abs(dx), np.abs(dy))))
    low, high = np.zeros(len(n)), np.ones(len(n))
    for start, d, first in ((x0, dx, left), (y0, dy, top)):
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (first - width - start) / d, (first + TILE + width - start) / d
        level, out = d == 0, (start < first - width) | (start > first + TILE + width)
        low = np.maximum(low, np.where(level, np.where(out, 2.0, 0.0), np.minimum(a, b)))
        high = np.minimum(high, np.where(level, 1.0, np.maximum(a, b)))
    begin = np.maximum(0, np.floor(low * n) - 1)
    count = np.where(low <= high, np.minimum(n, np.ceil(high * n) + 1) - begin + 1, 0).astype(np.int64)
    flat, back, ahead = np.abs(dx) >= np.abs(dy), (width - 1) // 2, width // 2
    found = []
    for rows in (np.flatnonzero(flat & (count > 0)), np.flatnonzero(~flat & (count > 0))):
        if not len(rows):
            continue
        c = count[rows]
        which = np.repeat(np.arange(len(rows)), c)
        i = np.arange(len(which)) - np.repeat(np.cumsum(c) - c - begin[rows], c)
        size = n[rows][which]
        px = np.floor(x0[rows][which] + dx[rows][which] * i / size) - left[rows][which]
        py = np.floor(y0[rows][which] + dy[rows][which] * i / size) - top[rows][which]
        if flat[rows[0]]:  # steps in one row of pixels are a span, which each row of the width has
            edge = np.flatnonzero((which[1:] != which[:-1]) | (py[1:] != py[:-1])) + 1
            one, other = px[np.concatenate([[0], edge])], px[np.concatenate([edge, [len(px)]]) - 1]
            which, py = which[np.concatenate([[0], edge])], py[np.concatenate([[0], edge])]
            lines = [(np.minimum(one, other), np.maximum(one, other), py + o) for o in range(-back, ahead + 1)]
        else:
            lines = [(px - back, px + ahead, py)]
        tile = own[rows].astype(np.float64)[which]
        for a, b, row in lines:
            a, b = np.maximum(a, 0), np.minimum(b, TILE - 1)
            inside = np.flatnonzero((a <= b) & (row >= 0) & (row < TILE))
            a, b = a[inside], b[inside]
            found.append((((tile[inside] * TILE + row[inside]) * TILE + a) * TILE + (b - a)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def united_spans(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of pixels (own * 65,536 + pixel) that spans cover; no run crosses a multiple of 65,536."""
    if not len(coded):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = np.sort(coded)
    first = coded >> 8
    last = np.maximum.accumulate(first + (coded & 255))
    edge = np.flatnonzero((first[1:] > last[:-1] + 1) | (first[1:] >> 16 != first[:-1] >> 16)) + 1
    return first[np.concatenate([[0], edge])], last[np.concatenate([edge, [len(last)]]) - 1]


def as_spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Runs as spans again, in pieces along rows."""
    count = (last >> 8) - (first >> 8) + 1
    which = np.repeat(np.arange(len(first)), count)
    row = (first >> 8)[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    a, b = np.maximum(first[which], row << 8), np.minimum(last[which], (row << 8) + 255)
    return (a << 8) | (b - a)


def packed(first: np.ndarray, last: np.ndarray, n: int) -> pa.Array:
    """The runs of n masks as MASKS keeps them."""
    offsets = np.searchsorted(first, np.arange(n + 1) * TILE * TILE).astype(np.int32) * 4
    pairs = np.stack([first % (TILE * TILE), last - first], axis=1).astype(np.uint16)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])


def runs_of(codes: np.ndarray) -> np.ndarray:
    """(first, how many follow) of sorted distinct numbers; no run crosses a multiple of 65,536."""
    starts = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
    starts = np.union1d(starts, np.flatnonzero(codes % (TILE * TILE) == 0))
    return np.stack([codes[starts], np.diff(starts, append=len(codes)) - 1], axis=1)


def united(masks: list[np.ndarray]) -> np.ndarray:
    """The union of several masks of (first, how many follow)."""
    change = np.zeros(TILE * TILE + 1, np.int32)
    for mask in masks:
        change[mask[:, 0]] += 1
        change[mask[:, 0].astype(np.int64) + mask[:, 1] + 1] -= 1
    return runs_of(np.flatnonzero(np.cumsum(change[:-1])))


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of tiles (z, x, y, track_id, x0, y0, x1, y1 in global pixels) to MASKS, a row for each tile and track of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in NAMES[:4]], axis=1)
        ends = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], axis=1)
        groups, own = np.unique(keys, axis=0, return_inverse=True)
        own = own.ravel()
        steps = np.maximum(np.abs(ends[:, 2] - ends[:, 0]), np.abs(ends[:, 3] - ends[:, 1])).clip(1, 2 * TILE)
        found = []
        for z in np.unique(keys[:, 0]).tolist():
            rows = np.flatnonzero(keys[:, 0] == z)
            for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(steps[rows]) // STEPS)) + 1):
                found.append(spans(ends[part], keys[part, 1] * TILE, keys[part, 2] * TILE, raster.WIDTHS.get(z, 4), own[part]))
        binary = packed(*united_spans(np.concatenate(found)), len(groups))
        yes = pa.array(np.ones(len(groups), bool))
        columns = [pa.array(groups[:, 0].astype(np.int32)), *(pa.array(groups[:, i]) for i in (1, 2, 3)), pa.array(np.zeros(len(groups), bool)), yes, binary]
        yield pa.RecordBatch.from_arrays(columns, names=NAMES)


def masks(drawn: DataFrame) -> DataFrame:
    """MASKS of what is drawn (z, x, y, track_id, x0, y0, x1, y1); made where the segments are, in parts if need be."""
    return drawn.select(*NAMES[:4], "x0", "y0", "x1", "y1").mapInArrow(_masks, MASKS)


def hits_as_masks(hits: DataFrame) -> DataFrame:
    """Hits (z, x, y, track_id, inside) as rows of MASKS without pixels."""
    return hits.select("z", "x", "y", "track_id", "inside", F.lit(False).alias("drawn"), F.lit(b"").alias("runs"))


class TileSum:
    """Distinct tracks over each pixel of a tile, from its masks by rising track_id: 512 KiB however many tracks there are."""

    def __init__(self, z: int, most: int):
        self.cap = min(most, 500 if z <= 4 else 2000 if z <= 8 else most)
        self.change, self.waiting = np.zeros(TILE * TILE + 1, np.int64), []
        self.last, self.met, self.own = None, 0, False
        self.inside, self.tracks = False, 0

    def add(self, track_id: np.ndarray, inside: np.ndarray, drawn: np.ndarray, runs: np.ndarray, offsets: np.ndarray) -> None:
        """Masks of one row or more; mask i has the pairs offsets[i] to offsets[i + 1] of `runs`. The last track waits, as more
        of its rows may follow."""
        self.inside |= bool(inside.any())
        fresh = np.concatenate([[self.met == 0 or track_id[0] != self.last], track_id[1:] != track_id[:-1]])
        rank = self.met + np.cumsum(fresh)
        kept = drawn & (rank <= self.cap)
        starts = np.flatnonzero(fresh)
        ends = np.concatenate([starts[1:], [len(track_id)]])
        self._wait(kept, runs, offsets, 0, starts[0] if len(starts) else len(track_id))
        if not len(starts):
            return
        self._settle()
        self.last, self.met = track_id[-1], int(rank[-1])
        single = np.zeros(len(track_id), bool)
        single[starts[:-1][ends[:-1] - starts[:-1] == 1]] = True
        several = np.flatnonzero(ends[:-1] - starts[:-1] > 1)
        single &= kept
        self.tracks += int(single.sum())
        if single.any():
            lengths = np.diff(offsets)
            some = runs[offsets[0] : offsets[-1]]
            self._count(some if (single | (lengths == 0)).all() else some[np.repeat(single, lengths)])
        for k in several:
            self._wait(kept, runs, offsets, starts[k], ends[k])
            self._settle()
        self._wait(kept, runs, offsets, starts[-1], len(track_id))

    def _wait(self, kept: np.ndarray, runs: np.ndarray, offsets: np.ndarray, start: int, end: int) -> None:
        for i in range(start, end):
            if kept[i]:
                self.own = True
                if offsets[i + 1] > offsets[i]:
                    self.waiting.append(runs[offsets[i] : offsets[i + 1]].copy())

    def _count(self, mask: np.ndarray) -> None:
        first, beyond = mask[:, 0].astype(np.int64), mask.sum(axis=1, dtype=np.int64) + 1
        if len(mask) < 1 << 13:
            np.add.at(self.change, first, 1)
            np.subtract.at(self.change, beyond, 1)
        else:
            self.change += np.bincount(first, minlength=TILE * TILE + 1)
            self.change -= np.bincount(beyond, minlength=TILE * TILE + 1)

    def _settle(self) -> None:
        self.tracks += self.own
        if self.waiting:
            self._count(self.waiting[0] if len(self.waiting) == 1 else united(self.waiting))
        self.waiting, self.own = [], False

    def counts(self) -> np.ndarray:
        self._settle()
        return np.cumsum(self.change[:-1]).reshape(TILE, TILE)


def each_tile(rows: DataFrame, finish: Callable, schema: str, most: int = 10_000, data_only: bool = False) -> DataFrame:
    """finish(z, x, y, tracks, counts), a list of tuples of `schema`, for each tile of MASKS rows with a covered pixel.

    Rows go to tiles sorted by track and are taken one at a time, so a task holds the counts of one tile. Only a tile's first
    tracks count, as many as its zoom draws. With `data_only`, tiles without a point inside make no row.
    """
    fields = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if tile and (tile.inside or not data_only) and (counts := tile.counts()).any() and (found := finish(*at, tile.tracks, counts)):
                yield pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in found], shape)

        for batch in batches:
            if not batch.num_rows:
                continue
            z, x, y, track, inside, drawn = (batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES[:6])
            runs = batch.column(NAMES[6])
            _, places, data = runs.buffers()
            places = np.frombuffer(places, np.int32)[runs.offset : runs.offset + len(runs) + 1] // 4
            pairs = np.frombuffer(data or b"", np.uint16)[: places[-1] * 2].reshape(-1, 2)
            edge = np.flatnonzero((z[1:] != z[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(z)], strict=True):
                if (key := (int(z[a]), int(x[a]), int(y[a]))) != at:
                    yield from done()
                    at, tile = key, TileSum(key[0], most)
                tile.add(track[a:b], inside[a:b], drawn[a:b], pairs, places[a : b + 1])
        yield from done()

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    shape = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(","))])
    # by a hash, which no join deals by: else Spark leaves it to a join's exchange, which a broadcast may turn into local reads
    return rows.select(*NAMES).repartition(F.xxhash64("z", "x", "y")).sortWithinPartitions("z", "x", "y", "track_id").mapInArrow(run, schema)


def _sums(z: int, x: int, y: int, tracks: int, counts: np.ndarray) -> list[tuple]:
    return [(z, x, y, tracks, int((counts > 0).sum()), int(counts.sum()), int(counts.max()))]


def tile_sums(rows: DataFrame, most: int = 10_000, data_only: bool = False) -> DataFrame:
    """z, x, y, tracks of each tile's MASKS rows, with its covered pixels, the sum and the largest of their track counts."""
    return each_tile(rows, _sums, "z int, x long, y long, tracks long, pixels long, total long, largest long", most, data_only)
