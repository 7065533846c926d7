"""All queries of the library, by name. Each takes (spark, sf_dir) and reads the tables there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions import geo, names
from heatloom.jobs import export, importing, pixels, rendering
from heatloom.operators import archive, maintenance, masks, raster, render, segments, tiles, tracks
from heatloom.oracles import oracle_sql
from heatloom.schemas import STYLES
from heatloom.sources import events as ev
from heatloom.sources import files, fit, gpx, tcx
from heatloom.streaming import imports
from heatloom.tables import new_folder, save

__all__ = ["oracle_sql", "queries"]


def _points(f: Callable[[DataFrame], DataFrame]):
    """A query on the derived track points."""
    return lambda spark, sf_dir: f(ev.trackpoints(spark, sf_dir))


def _tracks(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: f(ev.stored_tracks(spark, sf_dir))


def _batch(f: Callable[[DataFrame, DataFrame], DataFrame]):
    """A query on an import batch and the stored tracks."""

    def run(spark, sf_dir: str) -> DataFrame:
        stored, batch = ev.candidates(spark, sf_dir)
        return f(batch, stored)

    return run


def _log(f: Callable[[DataFrame], DataFrame]):
    return _batch(lambda batch, stored: f(tracks.dedup_import(batch, stored)))


def _pixel_place(points: DataFrame) -> DataFrame:
    rows = tiles.with_tile(points, 14)
    z = F.lit(14)
    px = geo.global_pixel(geo.mercator_x(F.col("lon")), z) - F.col("x") * geo.TILE
    py = geo.global_pixel(geo.mercator_y(F.col("lat")), z) - F.col("y") * geo.TILE
    return rows.select("track_id", "seq", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


def _in_margin(points: DataFrame) -> DataFrame:
    rows, z = segments.segments(points), F.lit(14)
    home = tiles.with_tile(rows.withColumnsRenamed({"lon0": "lon", "lat0": "lat"}), 14)
    x = lambda c: geo.global_pixel(geo.mercator_x(F.col(c)), z) - F.col("x") * geo.TILE
    y = lambda c: geo.global_pixel(geo.mercator_y(F.col(c)), z) - F.col("y") * geo.TILE
    return home.select("track_id", "seq", geo.in_margin(x("lon"), y("lat"), x("lon1"), y("lat1")).alias("inside"))


def _zoom_rules(points: DataFrame) -> DataFrame:
    z = F.col("z")
    return tiles.data_tiles(points).select("z", geo.line_width(z).alias("width"), geo.segment_cap(z).alias("cap")).distinct()


def _spans(points: DataFrame) -> DataFrame:
    return tiles.track_tile_hits(points).groupBy("z", "x", "y").agg(F.sum(F.col("last_seq") - F.col("first_seq") + 1).alias("span"), F.count("*").alias("tracks"))


def _filenames(rows: DataFrame) -> DataFrame:
    t = F.col("track_id")
    name = F.when(t % 4 == 0, "").otherwise(F.concat(F.lit("name "), t))
    return rows.select(t, names.track_filename(F.concat(F.lit("in/ride."), t, F.lit(".gpx")), name, t).alias("filename"))


def _index(batch: DataFrame, stored: DataFrame) -> DataFrame:
    usable = batch.where(F.col("error").isNull() & (F.col("num_points") > 0))
    return tracks.track_index(usable.select(F.concat(F.lit("file "), F.col("track_id") % 7).alias("path"), F.col("track_id").alias("chunk")))


def _routes(log: DataFrame) -> DataFrame:
    there = log.where(F.col("path").startswith("a/")).select(F.lit("done").alias("folder"), F.substring_index("path", "/", -1).alias("name"))
    return tracks.route_files(log, there)


def _formats(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    endings = F.array(*[F.lit(x) for x in (".GPX", ".fit", ".tcx", ".kml", ".html")])
    path = F.concat(F.lit("in/"), F.col("page_id"), F.get(endings, F.col("page_id") % 5))
    return pages.select("page_id", gpx.format_error(path).alias("error"))


def _exports(points: DataFrame) -> DataFrame:
    """With holes, with a queue, and complete."""
    disk, dirty = ev.tiles_on_disk(points), ev.dirty_tiles(points)
    missing = maintenance.missing_tiles(points, disk)
    cases = (("holes", dirty.limit(0), missing), ("queue", dirty, missing), ("whole", dirty.limit(0), missing.limit(0)))
    found = [maintenance.export_ready(queue, lacking).withColumn("case", F.lit(name)) for name, queue, lacking in cases]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _known(points: DataFrame) -> DataFrame:
    blobs = ev.tiles_on_disk(points).withColumn("data", F.lit(b"image"))
    found = render.empty_tiles(ev.tile_requests(points), blobs)
    return found.select("style", "z", "x", "y", (F.col("data") == F.lit(b"image")).alias("known"))


def _parsed(points: DataFrame) -> DataFrame:
    parsed = gpx.parsed_track(ev.gpx_texts(points), F.col("xml"))
    return parsed.select("track_id", "track_name", F.posexplode("points").alias("n", "p")).select("track_id", (F.col("n") + 1).cast("long").alias("seq"), "p.lat", "p.lon", "track_name")


def _fit_points(points: DataFrame) -> DataFrame:
    found = fit.records_to_points(ev.fit_records(points))
    return found.select("file", "seq", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _drawn(points: DataFrame) -> DataFrame:
    """Every tile's image, as sums over its pixels where no blur applies (zoom 12 and deeper)."""
    found = render.with_sums(render.render_tiles(points, tiles.data_tiles(points), geo.MIN_ZOOM, geo.MAX_ZOOM))
    sums = {c: F.when(F.col("z") >= 12, F.col(c)) for c in ("shown", "r", "g", "b", "a")}
    return found.withColumns(sums)


def _tile_pixels(points: DataFrame) -> DataFrame:
    """Every tile's pixels before colour and blur, at all zooms."""
    return masks.tile_sums(render.drawn_masks(points, tiles.data_tiles(points), geo.MIN_ZOOM, geo.MAX_ZOOM))


def _pixel_state(points: DataFrame) -> DataFrame:
    """Every tile's pixels from a stored state to which a part of the tracks was added, and from which one of these was removed."""
    spark, state = points.sparkSession, new_folder(points.sparkSession, "pixels")
    part, gone = F.col("track_id") % 10 == 3, F.col("track_id") % 20 == 13
    pixels.write_masks(points.where(~part), state, 0)
    pixels.write_masks(points.where(part), state, 1)
    pixels.remove_tracks(spark, points.where(gone).select("track_id").distinct(), state, 2)
    return masks.tile_sums(pixels.stored_masks(spark, state), data_only=True)


def _overviews(points: DataFrame) -> DataFrame:
    """Zooms 2 to 8, where a tile may hold every track."""
    return render.render_tiles(points, tiles.data_tiles(points, 2, 8), 2, 8).select("style", "z", "x", "y", "tracks")


def _added(points: DataFrame) -> DataFrame:
    """Every tile's image after tracks were added to a state, as sums over its pixels where no blur applies."""
    found = render.with_sums(pixels.drawn_in_steps(points, geo.MIN_ZOOM, geo.MAX_ZOOM, F.col("track_id") % 10 == 3))
    return found.withColumns({c: F.when(F.col("z") >= 12, F.col(c)) for c in ("shown", "r", "g", "b", "a")})


def _export(points: DataFrame) -> DataFrame:
    """Each style's archive: tiles, whether offsets are gapless in the order of tile ids, whether equal images share one."""
    images = save(render.render_tiles(points, tiles.data_tiles(points), geo.MIN_ZOOM, geo.MAX_ZOOM), "images")
    found = None
    for style in STYLES:
        manifest = archive.export_archive(images.where(F.col("style") == style))
        blobs = manifest.groupBy("offset").agg(F.max("length").alias("length"), F.countDistinct("sha256").alias("images"), F.min("tile_id").alias("first"))
        one = blobs.agg(F.sum("length").alias("bytes"), F.max(F.col("offset") + F.col("length")).alias("end"), F.max("images").alias("images"), F.count("*").alias("blobs"))
        whole = manifest.agg(F.count("*").alias("tiles"), F.countDistinct("sha256").alias("distinct"), F.min("tile_id").alias("first_id"), F.max("tile_id").alias("last_id"))
        row = whole.join(one).select(F.lit(style).alias("style"), "tiles", "first_id", "last_id", (F.col("bytes") == F.col("end")).alias("gapless"), ((F.col("blobs") == F.col("distinct")) & (F.col("images") == 1)).alias("shared"))
        found = row if found is None else found.unionByName(row)
    return found


def _blobs(points: DataFrame) -> DataFrame:
    """Every tile of every style with a short image that its neighbours share."""
    which = F.pmod(F.shiftright("x", 1) + F.shiftright("y", 1), F.lit(5)).cast("string")
    image = F.concat(F.lit("image "), "style", F.lit(" "), F.repeat(which, F.pmod(F.col("x"), F.lit(4)).cast("int")))
    styles = F.explode(F.array(*[F.lit(s) for s in STYLES])).alias("style")
    return tiles.data_tiles(points).select("z", "x", "y", styles).withColumn("data", F.encode(image, "UTF-8"))


def _archived(f: Callable):
    """A query on written archives of such images, in small leaves and files."""

    def run(spark, sf_dir: str) -> DataFrame:
        folder, points = new_folder(spark, "archive"), ev.trackpoints(spark, sf_dir)
        export.write_archives(save(_blobs(points), "images"), ev.stored_tracks(spark, sf_dir), folder, leaf=100, part_bytes=4096)
        return f(spark, folder)

    return run


def _incremental(points: DataFrame) -> DataFrame:
    folder = new_folder(points.sparkSession, "cells")
    rendering.write_points(points, folder)
    stored = points.sparkSession.read.parquet(folder).drop("batch_id")
    return rendering.incremental(stored, ev.tiles_on_disk(points), ev.dirty_tiles(points), geo.MIN_ZOOM, geo.MAX_ZOOM)


def _stored_tracks(points: DataFrame) -> DataFrame:
    folder = new_folder(points.sparkSession, "tracks")
    rendering.write_tracks(points, folder)
    read = points.sparkSession.read
    counts = read.parquet(f"{folder}/trackpoints").groupBy("track_id").agg(F.count("*").alias("stored_points"), F.max("seq").alias("last_seq"))
    return read.parquet(f"{folder}/tracks").drop("batch_id").join(counts, "track_id")


def _stored_tiles(points: DataFrame) -> DataFrame:
    folder = new_folder(points.sparkSession, "tiles")
    images = ev.tiles_on_disk(points).withColumn("data", F.lit(b"image"))
    rendering.write_tiles(images, folder)
    return points.sparkSession.read.parquet(folder).select("style", "z", "x", "y", F.length("data").cast("long").alias("bytes"))


def _tile_paths(points: DataFrame) -> DataFrame:
    """Paths of a tile folder with other files among them."""
    disk, style = ev.tiles_on_disk(points), F.col("style")
    path = F.concat(F.lit("out/"), F.concat_ws("/", "style", "z", "x", "y"), F.when(style == "cool", ".txt").otherwise(".png"))
    return files.tile_addresses(disk.select(F.when(style == "top10", F.replace(path, F.lit("top10/"), F.lit("top10/z"))).otherwise(path).alias("path")))


def _colours(points: DataFrame) -> DataFrame:
    """Each style's colours, with the pixels of zoom 11 that have them."""
    pixels = raster.with_index(raster.pixel_intensity(points, 11)).groupBy("idx").agg(F.count("*").alias("pixels"))
    return raster.color_lut(points.sparkSession).join(pixels, "idx", "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)))


def _base(path: str = "path"):
    return names.file_name(F.col(path)).alias("file")


def _scan(points: DataFrame) -> DataFrame:
    folder, _ = ev.activity_files(points, "gpx", "prefixed", "tcx", "fit")
    return files.scan_activity_files(points.sparkSession, folder).select(_base(), "ext")


def _gpx_files(points: DataFrame) -> DataFrame:
    folder, _ = ev.activity_files(points, "gpx", "prefixed", "tcx", "fit")
    found = gpx.parsed_gpx(gpx.read_gpx_tracks(points.sparkSession, folder))
    return found.select(_base(), "track_index", "track_name", F.size("points").cast("long").alias("num_points"), tracks.points_hash(F.col("points")).alias("content_hash"))


def _tcx_files(points: DataFrame) -> DataFrame:
    folder, _ = ev.activity_files(points, "gpx", "prefixed", "tcx", "fit")
    found = tcx.parsed_tcx(files.file_contents(points.sparkSession, folder, "*.[tT][cC][xX]"))
    return found.select(_base(), F.size("points").cast("long").alias("num_points"), tracks.points_hash(F.col("points")).alias("content_hash"), "error")


def _tcx_splits(points: DataFrame) -> DataFrame:
    """The same files, read in splits."""
    folder, _ = ev.activity_files(points, "gpx", "prefixed", "tcx", "fit")
    found = tcx.split_tcx(points.sparkSession, folder)
    return found.select(_base(), F.size("points").cast("long").alias("num_points"), tracks.points_hash(F.col("points")).alias("content_hash"), "error")


def _import(points: DataFrame) -> DataFrame:
    """A folder of all formats, imported; and again as another batch."""
    folder, records = ev.activity_files(points, "gpx", "prefixed", "tcx", "fit")
    spark, store = points.sparkSession, new_folder(points.sparkSession, "store")
    first = importing.import_job(spark, folder, store, 0, records).select(F.lit(0).alias("batch"), _base(), "track_index", "status", "num_points")
    again = importing.import_job(spark, folder, store, 1, records).select(F.lit(1).alias("batch"), _base(), "track_index", "status", "num_points")
    return first.unionByName(again)


def _streamed(points: DataFrame) -> tuple[str, str]:
    """A store that a stream imported from two folders with the same tracks, and the folder of its checkpoints."""
    spark, store, work = points.sparkSession, new_folder(points.sparkSession, "store"), new_folder(points.sparkSession, "work")
    for turn, kind in enumerate(("gpx", "prefixed")):
        folder, _ = ev.activity_files(points, kind)
        imports.stream_import(spark, folder, store, f"{work}/import-{turn}", first_batch=turn * 1000).awaitTermination()
    return store, work


def _stream_import(points: DataFrame) -> DataFrame:
    """The stored tracks, by their contents."""
    store, _ = _streamed(points)
    stored = importing.stored(points.sparkSession, store, "trackpoints")
    return stored.groupBy("track_id").agg(F.count("*").alias("num_points"), F.max("seq").alias("last_seq")).join(importing.stored(points.sparkSession, store, "tracks").select("track_id", "content_hash"), "track_id").drop("track_id")


def _stream_fit(points: DataFrame) -> DataFrame:
    """FIT files whose decoded records arrive after them."""
    folder, records = ev.activity_files(points, "gpx", "prefixed", "tcx", "fit")
    spark, store, work = points.sparkSession, new_folder(points.sparkSession, "store"), new_folder(points.sparkSession, "work")
    run = lambda: imports.stream_fit(spark, folder, f"{work}/decoded", store, f"{work}/c").awaitTermination()
    flat = records.withColumn("seq", F.col("seq.track_id") * 1_000_000 + F.col("seq.seq"))
    flat.limit(0).write.parquet(f"{work}/decoded")
    run()
    flat.repartition("file").write.mode("append").parquet(f"{work}/decoded")
    run()
    return importing.stored(spark, store, "log").select(_base(), "status", "num_points")


def _stream_dedup(points: DataFrame) -> DataFrame:
    store, _ = _streamed(points)
    log = importing.stored(points.sparkSession, store, "log")
    return log.groupBy(F.regexp_extract("filename", "^[a-z]+", 0).alias("kind"), "status").agg(F.count("*").alias("tracks"))


def _stream_dirty(points: DataFrame) -> DataFrame:
    store, work = _streamed(points)
    imports.stream_dirty_tiles(points.sparkSession, store, f"{work}/dirty", f"{work}/c").awaitTermination()
    return points.sparkSession.read.parquet(f"{work}/dirty").select("z", "x", "y").distinct()


def _stream_render(points: DataFrame) -> DataFrame:
    store, work = _streamed(points)
    spark = points.sparkSession
    imports.stream_dirty_tiles(spark, store, f"{work}/dirty", f"{work}/c").awaitTermination()
    imports.stream_render(spark, store, f"{work}/dirty", f"{work}/tiles", f"{work}/d", geo.MIN_ZOOM, geo.MAX_ZOOM).awaitTermination()
    return imports.latest_tiles(spark, f"{work}/tiles").select("style", "z", "x", "y")


def queries() -> dict[str, Callable]:
    shifted = lambda d: d.where((F.col("x") + F.col("y")) % 3 == 0)
    found = {
        "data_tiles": _points(tiles.data_tiles),
        "tile_density": _points(tiles.tile_density),
        "lonlat_to_tile": _points(lambda p: tiles.with_tile(p, 14).select("track_id", "seq", "x", "y")),
        "zoom_explode": _points(lambda p: tiles.zoom_explode(tiles.with_tile(p, 18).select("x", "y").distinct())),
        "tile_bounds": _points(lambda p: tiles.with_bounds(tiles.data_tiles(p))),
        "tile_bounds_padded": _points(lambda p: tiles.with_bounds(tiles.data_tiles(p), geo.PADDING)),
        "lonlat_to_pixel": _points(_pixel_place),
        "track_tile_hits": _points(tiles.track_tile_hits),
        "track_bounds": _points(tracks.track_bounds),
        "content_hash": _points(tracks.content_hashes),
        "segments": _points(segments.segments),
        "gap_km": _points(lambda p: segments.with_gap(segments.segments(p)).select("track_id", "seq", F.round("km", 6).alias("km"))),
        "drop_gaps": _points(lambda p: segments.drop_gaps(segments.segments(p))),
        "segment_in_margin": _points(_in_margin),
        "zoom_rules": _points(_zoom_rules),
        "cap_segments": _points(lambda p: segments.cap_tracks(tiles.track_tile_hits(p), 10)),
        "points_in_tiles": _points(_spans),
        "tile_segments": _points(lambda p: segments.tile_segments(p, tiles.data_tiles(p), geo.MIN_ZOOM, geo.MAX_ZOOM)),
        "color_lut": _points(_colours),
        "normalize_intensity": _points(lambda p: raster.with_index(raster.pixel_intensity(p, 11))),
        "colorize": _points(lambda p: raster.colorize(raster.pixel_intensity(p, 11))),
        "top_tracks_layer": _points(lambda p: raster.top_tracks_layer(raster.pixel_intensity(p, 8))),
        "stats": _tracks(tracks.stats),
        "source_file_count": _tracks(tracks.source_file_count),
        "effective_hash": _tracks(lambda t: t.select("track_id", F.col("file_hash").alias("effective_hash"), names.source_hash(F.col("file_hash")).alias("source_hash"))),
        "track_filename": _tracks(_filenames),
        "date_range": _tracks(tracks.date_range),
        "global_bounds": _tracks(tracks.global_bounds),
        "new_files": _batch(lambda b, s: tracks.new_files(b, s).select("path")),
        "content_duplicates": _batch(lambda b, s: tracks.content_duplicates(b, s).select("path", "matched")),
        "dedup_import": _log(lambda log: log.select("path", "status")),
        "import_summary": _log(tracks.import_summary),
        "duplicates_blocked": _log(tracks.duplicates_blocked),
        "track_index": _batch(_index),
        "route_files": _log(_routes),
        "mark_tiles_dirty": _points(lambda p: maintenance.mark_tiles_dirty(p, tiles.data_tiles(p).withColumn("x", F.col("x") + 1))),
        "mark_all_tiles_dirty": _points(lambda p: maintenance.mark_all_tiles_dirty(p, ev.dirty_tiles(p))),
        "sample_points": _points(lambda p: tiles.sample_points(p, target=500, deepest=14)),
        "clear_dirty": _points(lambda p: maintenance.clear_dirty(d := ev.dirty_tiles(p), shifted(d))),
        "clear_tiles": _points(lambda p: maintenance.clear_tiles(ev.tiles_on_disk(p), "warm")),
        "stale_tiles": _points(lambda p: maintenance.stale_tiles(ev.tiles_on_disk(p), ev.dirty_tiles(p)).select("style", "z", "x", "y")),
        "missing_tiles": _points(lambda p: maintenance.missing_tiles(p, ev.tiles_on_disk(p))),
        "tiles_needing_queue": _points(lambda p: maintenance.tiles_needing_queue(maintenance.missing_tiles(p, ev.tiles_on_disk(p)), ev.dirty_tiles(p))),
        "check_tiles": _points(lambda p: maintenance.check_tiles(p, ev.tiles_on_disk(p))),
        "dirty_by_zoom": _points(lambda p: maintenance.dirty_by_zoom(ev.dirty_tiles(p))),
        "dirty_batch": _points(lambda p: maintenance.dirty_batch(ev.dirty_tiles(p))),
        "export_ready": _points(_exports),
        "valid_tile_address": _points(lambda p: ev.tile_requests(p).withColumn("status", geo.tile_status(F.col("style"), F.col("z"), F.col("x"), F.col("y"), STYLES))),
        "tile_id": _points(lambda p: archive.with_tile_id(tiles.data_tiles(p))),
        "archive_order": _points(lambda p: archive.archive_order(tiles.data_tiles(p))),
        "archive_offsets": _points(lambda p: archive.archive_offsets(ev.tile_blobs(p))),
        "archive_header": lambda spark, sf_dir: archive.archive_header(tiles.data_tiles(ev.trackpoints(spark, sf_dir)), ev.stored_tracks(spark, sf_dir)),
        "sanitize_gpx_text": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", names.escaped_text(F.col("text")).alias("text")),
        "strip_namespace": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", names.without_prefixes(F.col("html")).alias("html")),
        "parse_trkpts": _points(_parsed),
        "fit_records_to_points": _points(_fit_points),
        "first_last_time": _points(lambda p: fit.first_last_time(ev.fit_records(p))),
        "write_tracks": _points(_stored_tracks),
        "write_tiles": _points(_stored_tiles),
        "list_tiles_on_disk": _points(_tile_paths),
        "scan_activity_files": _points(_scan),
        "read_gpx_tracks": _points(_gpx_files),
        "read_tcx_tracks": _points(_tcx_files),
        "import_job": _points(_import),
        "stream_import": _points(_stream_import),
        "stream_fit": _points(_stream_fit),
        "read_tcx_splits": _points(_tcx_splits),
        "stream_dedup": _points(_stream_dedup),
        "stream_dirty_tiles": _points(_stream_dirty),
        "stream_render": _points(_stream_render),
        "unsupported_format": _formats,
        "empty_tiles": _points(_known),
        "render_tiles": _points(_drawn),
        "render_overviews": _points(_overviews),
        "tile_pixels": _points(_tile_pixels),
        "pixel_state": _points(_pixel_state),
        "add_tracks": _points(_added),
        "export_archive": _points(_export),
        "archive_tiles": _archived(lambda spark, folder: export.archive_tiles(spark, folder).withColumn("data", F.decode("data", "UTF-8"))),
        "archive_directory": _archived(lambda spark, folder: spark.read.parquet(f"{folder}/leaves")),
        "archive_metadata": _archived(lambda spark, folder: spark.read.parquet(f"{folder}/metadata").select("style", "min_zoom", "max_zoom", "tile_count", "name", "format", "type")),
        "incremental_render": _points(_incremental),
    }
    for z in (8, 11, 14):
        found[f"pixel_intensity_z{z}"] = _points(lambda p, z=z: raster.pixel_intensity(p, z))
    return found
