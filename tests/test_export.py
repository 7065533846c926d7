import random

from heatloom.jobs import export
from heatloom.operators import archive

IMAGES = "style string, z int, x long, y long, data binary"
TRACKS = "min_lat double, min_lon double, max_lat double, max_lon double"


def images(seed=1):
    """Tiles of two styles with random bytes, newlines and bytes that are no UTF-8 among them; many share an image."""
    rng = random.Random(seed)
    blank, kinds = b"\n\n", [bytes(rng.randrange(256) for _ in range(rng.randrange(60))) for _ in range(30)]
    rows = [(s, z, x, y, bytearray(blank if rng.random() < 0.4 else rng.choice(kinds))) for s in ("warm", "top 10%") for z in (0, 3, 5) for x in range(2**z) for y in range(2**z) if rng.random() < 0.8]
    return rows + [("warm", 6, 1, 1, None)]


def test_every_tile_comes_back(spark, tmp_path):
    rows, folder = images(), str(tmp_path / "a")
    table = spark.createDataFrame(rows + rows[:5], IMAGES)
    head = export.write_archives(table, spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], TRACKS), folder, leaf=16, part_bytes=400)
    want = {}
    for (style, z, x, y, data), r in zip(rows, archive.with_tile_id(spark.createDataFrame(rows, IMAGES)).collect()):
        if data is not None:
            want[style, r["tile_id"]] = bytes(data)
    found = export.archive_tiles(spark, folder).collect()
    assert len(found) == len(want) and {(r["style"], r["tile_id"]): bytes(r["data"]) for r in found} == want
    assert {r["style"]: (r["tile_count"], r["min_zoom"], r["max_zoom"], r["min_lat_e7"], r["name"]) for r in head.collect()} == {
        s: (sum(k[0] == s for k in want), min(r[1] for r in rows if r[0] == s), 5, 10_000_000, f"Heatmap ({s})") for s in ("warm", "top 10%")
    }
    # The files in their order are the bytes that the manifest says, a byte between two images.
    manifest = [r for r in spark.read.parquet(f"{folder}/manifest").where("style = 'warm'").collect()]
    files = spark.read.parquet(f"{folder}/parts").where("style = 'warm'").orderBy("start").collect()
    whole = b"".join(open(r["file"].removeprefix("file:"), "rb").read() for r in files)
    ends = {r["offset"]: r["offset"] + r["length"] + 1 for r in manifest}
    assert len(files) > 1 and sorted(ends) == [0, *sorted(ends.values())[:-1]] and max(ends.values()) == len(whole)
    assert all(whole[r["offset"] : r["offset"] + r["length"]] == want["warm", r["tile_id"]] for r in manifest)
    # Runs and leaves.
    leaves = spark.read.parquet(f"{folder}/leaves").where("style = 'warm'").orderBy("tile_id").collect()
    assert len(leaves) < len(manifest) and [r["leaf"] for r in leaves] == [i // 16 for i in range(len(leaves))]
    for style, z, x, y, data in rows[:2] + rows[-3:]:
        assert export.read_tile(spark, folder, style, z, x, y) == (None if data is None else bytes(data))
    assert export.read_tile(spark, folder, "cool", 0, 0, 0) is None


def test_nothing_to_export(spark, tmp_path):
    folder = str(tmp_path / "a")
    head = export.write_archives(spark.createDataFrame([], IMAGES), spark.createDataFrame([], TRACKS), folder)
    assert head.isEmpty() and export.read_tile(spark, folder, "warm", 0, 0, 0) is None
