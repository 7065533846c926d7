"""Tiles that points fall into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.functions import geo
from heatloom.functions.geo import MAX_ZOOM, MIN_ZOOM, PADDING
from heatloom.tables import in_ranges, running


def with_tile(points: DataFrame, z: int) -> DataFrame:
    """points with x and y of their tile at one zoom."""
    zoom = F.lit(z)
    return points.withColumn("x", geo.tile_of(geo.mercator_x(F.col("lon")), zoom)).withColumn("y", geo.tile_of(geo.mercator_y(F.col("lat")), zoom))


def zoom_explode(tiles: DataFrame, deepest: int = MAX_ZOOM, first: int = MIN_ZOOM) -> DataFrame:
    """Rows with x and y at the deepest zoom, once for each zoom from `first`; a tile's parent is at half its numbers."""
    shift = lambda c: F.call_function("shiftright", F.col(c), F.lit(deepest) - F.col("z"))
    rest = [c for c in tiles.columns if c not in ("x", "y")]
    rows = tiles.withColumn("z", F.explode(F.sequence(F.lit(first), F.lit(deepest))))
    return rows.select("z", shift("x").alias("x"), shift("y").alias("y"), *rest)


def data_tiles(points: DataFrame, first: int = MIN_ZOOM, deepest: int = MAX_ZOOM) -> DataFrame:
    """All distinct tiles (z, x, y) with a point in them: distinct at the deepest zoom, then its parents."""
    deep = with_tile(points, deepest).select("x", "y").distinct()
    return zoom_explode(deep, deepest, first).distinct()


def tile_density(points: DataFrame, first: int = MIN_ZOOM, deepest: int = MAX_ZOOM) -> DataFrame:
    """Points and distinct tracks in each data tile, rolled up from (tile, track) counts at the deepest zoom."""
    deep = with_tile(points, deepest).groupBy("x", "y", "track_id").agg(F.count("*").alias("points"))
    each = zoom_explode(deep, deepest, first).groupBy("z", "x", "y", "track_id").agg(F.sum("points").alias("points"))
    return each.groupBy("z", "x", "y").agg(F.sum("points").alias("points"), F.count("*").alias("tracks"))


def with_bounds(tiles: DataFrame, padding: float = 0.0) -> DataFrame:
    box = geo.tile_box(F.col("x"), F.col("y"), F.col("z"), padding)
    return tiles.select("z", "x", "y", *[F.round(c, 6).alias(n) for n, c in box.items()])


#: Zoom of the cells by which stored points are laid out: at most 4^8 cells, so a list of them is bounded.
CELL_ZOOM = 8
#: The deepest zoom whose cells are wider than a segment (1 km) up to the map's last latitude, where they measure 1.7 km.
NEAR_ZOOM = 11


def cell_of(x: Column, y: Column, z: Column | int, zoom: int = CELL_ZOOM) -> Column:
    """Number of the cell at `zoom` that holds a tile of zoom z (not below `zoom`)."""
    up = (F.lit(z) if isinstance(z, int) else z) - zoom
    return F.call_function("shiftright", x.cast("long"), up.cast("int")) * (1 << zoom) + F.call_function("shiftright", y.cast("long"), up.cast("int"))


def with_cell(points: DataFrame) -> DataFrame:
    rows = with_tile(points, CELL_ZOOM)
    return rows.withColumn("cell", cell_of(F.col("x"), F.col("y"), CELL_ZOOM)).drop("x", "y")


def points_near(points: DataFrame, wanted: DataFrame, first: int) -> DataFrame:
    """The points that drawing wanted tiles of zoom `first` and deeper can need.

    These lie in the wanted tiles' ancestors three zooms above `first` (at NEAR_ZOOM for deep zooms) or in the eight cells
    around one: the padded box of a tile, its margin and a segment of 1 km beyond are all smaller than such a cell. If points have a column `cell` (that of
    `with_cell`, the folders of a stored table), only these cells' files are read; the list of them is bounded by 4^CELL_ZOOM.
    """
    zoom = min(first - 3, NEAR_ZOOM)
    if zoom < 2:
        return points.drop("cell")
    up = F.col("z") - zoom
    own = wanted.where(F.col("z") >= first).select(F.call_function("shiftright", "x", up).alias("x"), F.call_function("shiftright", "y", up).alias("y")).distinct()
    around = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - 1, F.lit(0)), F.least(F.col(c) + 1, F.lit((1 << zoom) - 1))))
    cells = own.withColumn("x", around("x")).withColumn("y", around("y")).distinct()
    if "cell" in points.columns:
        coarse = min(zoom, CELL_ZOOM)
        listed = [r[0] for r in cells.select(cell_of(F.col("x"), F.col("y"), zoom, coarse).alias("c")).distinct().collect()]
        side = F.lit(1 << CELL_ZOOM)
        points = points.where(cell_of(F.floor(F.col("cell") / side), F.col("cell") % side, CELL_ZOOM, coarse).isin(listed))
    kept = [c for c in points.columns if c != "cell"]
    return with_tile(points, zoom).join(cells, ["x", "y"], "left_semi").select(*kept)


def track_tile_hits(points: DataFrame, first: int = MIN_ZOOM, deepest: int = MAX_ZOOM, padding: float = PADDING, inside: bool = False) -> DataFrame:
    """First and last seq of each track inside each tile grown by `padding`; with `inside`, also whether a point of it lies in
    the tile itself.

    Padding is below one tile, so a point can only be in its own tile and its eight neighbours; which of these hold it is
    decided before the explode, so that most points make one row for each zoom.
    """
    rows = points.withColumn("z", F.explode(F.sequence(F.lit(first), F.lit(deepest))))
    mx, my, z = geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat")), F.col("z")
    rows = rows.withColumn("hx", geo.tile_of(mx, z)).withColumn("hy", geo.tile_of(my, z)).withColumn("last", geo.side(z).cast("long") - 1)

    def near(home: str) -> Column:
        return F.filter(F.array(F.col(home) - 1, F.col(home), F.col(home) + 1), lambda t: (t >= 0) & (t <= F.col("last")))

    def holds_x(x: Column) -> Column:
        box = geo.tile_box(x, F.lit(0), z, padding)
        return F.col("lon").between(box["min_lon"], box["max_lon"])

    def holds_y(y: Column) -> Column:
        box = geo.tile_box(F.lit(0), y, z, padding)
        return F.col("lat").between(box["min_lat"], box["max_lat"])

    rows = rows.withColumn("x", F.explode(F.filter(near("hx"), holds_x))).withColumn("y", F.explode(F.filter(near("hy"), holds_y)))
    own = [F.max((F.col("x") == F.col("hx")) & (F.col("y") == F.col("hy"))).alias("inside")] if inside else []
    return rows.groupBy("z", "x", "y", "track_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), *own)


def sample_points(points: DataFrame, target: int = 5000, deepest: int = MAX_ZOOM) -> DataFrame:
    """Every n-th point in (track_id, seq) order, n such that about target * 2^(deepest - 14) remain (an option of the full
    rebuild). A point's place is its seq plus the points of earlier tracks, summed over range partitions of tracks."""
    sizes = in_ranges(points.groupBy("track_id").agg(F.max("seq").alias("n")), "track_id")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    step = max(1, total // (target * 2 ** max(0, deepest - 14)))
    starts = running(sizes, ["track_id"], F.col("n")).select("track_id", "before")
    return points.join(starts, "track_id").where((F.col("before") + F.col("seq")) % step == 0).select(*points.columns)
