"""Web-Mercator columns: tiles, pixels, bounds, distances, tile ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 256
MIN_ZOOM, MAX_ZOOM = 2, 18
PADDING = 0.1
EARTH_KM = 6371.0
#: Latitudes beyond this fall on the first or last row of tiles at every zoom.
LAST_LAT = 85.06


def side(z: Column) -> Column:
    """Tiles along one side of the map at a zoom."""
    return F.pow(F.lit(2.0), z)


def mercator_x(lon: Column) -> Column:
    """0 at 180 W to 1 at 180 E."""
    return (lon + 180.0) / 360.0


def mercator_y(lat: Column) -> Column:
    """0 in the north to 1 in the south; latitudes are held within the square map, so the poles are defined."""
    phi = F.radians(F.least(F.greatest(lat, F.lit(-LAST_LAT)), F.lit(LAST_LAT)))
    return (1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / F.pi()) / 2.0


def tile_of(mercator: Column, z: Column) -> Column:
    """Tile number along an axis, held to the map."""
    return F.least(F.greatest(F.floor(mercator * side(z)), F.lit(0)), side(z).cast("long") - 1)


def global_pixel(mercator: Column, z: Column) -> Column:
    return mercator * side(z) * TILE


def tile_lat(y: Column, z: Column) -> Column:
    """Latitude of the northern edge of row y."""
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / side(z)))))


def tile_lon(x: Column, z: Column) -> Column:
    """Longitude of the western edge of column x."""
    return x / side(z) * 360.0 - 180.0


def tile_box(x: Column, y: Column, z: Column, padding: float = 0.0) -> dict[str, Column]:
    """min_lat, max_lat, min_lon, max_lon of a tile, grown on each side by a share of its height and width."""
    north, south, west, east = tile_lat(y, z), tile_lat(y + 1, z), tile_lon(x, z), tile_lon(x + 1, z)
    dlat, dlon = (north - south) * padding, (east - west) * padding
    return {"min_lat": south - dlat, "max_lat": north + dlat, "min_lon": west - dlon, "max_lon": east + dlon}


def gap_km(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Equirectangular distance with the cosine of the mean latitude."""
    north = F.radians(lat1 - lat0)
    east = F.radians(lon1 - lon0) * F.cos(F.radians((lat0 + lat1) / 2))
    return EARTH_KM * F.sqrt(north * north + east * east)


def line_width(z: Column, width: float = 2.0) -> Column:
    """Pixels of a line: thin on overviews, wider close up."""
    scaled = F.when(z <= 4, 1.0).when(z <= 8, max(1.0, width / 2)).when(z <= 11, width).when(z <= 13, width * 1.5).otherwise(width * 2)
    return F.greatest(F.lit(1), scaled.cast("int"))


def segment_cap(z: Column, most: int = 10_000) -> Column:
    """Tracks drawn in a tile at most: `most`, and on overviews no more than 500 and 2,000."""
    return F.when(z <= 4, min(most, 500)).when(z <= 8, min(most, 2000)).otherwise(most)


def intensity_cap(z: Column) -> Column:
    """Tracks in a pixel at which its colour is at the end of the ramp."""
    return F.when(z <= 8, 5).when(z <= 11, 15).when(z <= 14, 10).otherwise(5)


def intensity_index(tracks: Column, z: Column) -> Column:
    """0 to 255."""
    return (F.least(F.log1p(tracks) / F.log1p(intensity_cap(z)), F.lit(1.0)) * 255).cast("int")


def in_margin(px0: Column, py0: Column, px1: Column, py1: Column, margin: float = TILE / 2) -> Column:
    """Whether a segment's box, in tile pixels, overlaps the tile grown by a margin."""
    x = (F.greatest(px0, px1) >= -margin) & (F.least(px0, px1) <= TILE + margin)
    return x & (F.greatest(py0, py1) >= -margin) & (F.least(py0, py1) <= TILE + margin)


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Place of a tile in the archive: zooms in turn, along a Hilbert curve within each."""

    def step(state: Column, k: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        rx, ry = F.when(state.x.bitwiseAND(s) > 0, 1).otherwise(0), F.when(state.y.bitwiseAND(s) > 0, 1).otherwise(0)
        lx, ly = state.x.bitwiseAND(s - 1), state.y.bitwiseAND(s - 1)
        fx, fy = F.when(rx == 1, s - 1 - lx).otherwise(lx), F.when(rx == 1, s - 1 - ly).otherwise(ly)
        d = state.d + s * s * (rx * 3).bitwiseXOR(ry)
        return F.struct(d.alias("d"), F.when(ry == 0, fy).otherwise(lx).alias("x"), F.when(ry == 0, fx).otherwise(ly).alias("y"))

    zooms = F.when(z > 0, F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    before = ((F.pow(F.lit(4.0), z) - 1) / 3).cast("long")
    return before + F.aggregate(zooms, start, step)["d"]


def tile_place(z: Column, x: Column, y: Column, deepest: int = MAX_ZOOM) -> Column:
    """Where a tile begins on the Hilbert curve of zoom `deepest`: tiles near each other on the map, of whatever zoom up to
    it, mostly have places near each other, and all tiles inside a tile lie in one range that begins at its place."""
    along = tile_id(z, x, y) - ((F.pow(F.lit(4.0), z) - 1) / 3).cast("long")
    return F.call_function("shiftleft", along, (2 * (deepest - z)).cast("int"))


def tile_status(style: Column, z: Column, x: Column, y: Column, styles: tuple[str, ...]) -> Column:
    """ok, unknown_style, bad_zoom, or empty for an address outside the map."""
    inside = (x >= 0) & (y >= 0) & (x < side(z)) & (y < side(z))
    return F.when(~F.coalesce(style.isin(*styles), F.lit(False)), "unknown_style").when((z < 0) | (z > 20), "bad_zoom").when(~inside, "empty").otherwise("ok")
