"""Archives of tile images: blobs as plain files, a run-length directory with leaves, a row of metadata; one for each style.

<folder>/blobs/style=s/part-*    the images, each followed by a newline; in the order of names the files are one long text of bytes
<folder>/manifest                style, z, x, y, tile_id, length, sha256, offset of every tile; equal images of a style share an offset
<folder>/leaves                  style, leaf, tile_id, run_length, offset, length: runs of tiles with one image, LEAF to a leaf
<folder>/roots                   style, leaf, tile_id, entries: the first tile of each leaf
<folder>/parts                   style, file, start, bytes: which offsets a blob file has
<folder>/metadata                style, header and description; written last, so an archive without it is not complete
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.functions import geo, names
from heatloom.operators import archive
from heatloom.tables import save

#: Entries of a leaf of the directory.
LEAF = 4096
#: About the bytes of a blob file.
PART_BYTES = 128 << 20


def write_archives(images: DataFrame, tracks: DataFrame, folder: str, leaf: int = LEAF, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes the archives of all styles of a stored table of images (style, z, x, y, data) and returns the metadata.

    The images are read twice, whatever the number of styles: for hashes and lengths, and to write each different one once.
    Tiles without data are left out. Of repeated tiles the image with the smallest hash counts. Other columns are ignored.
    Without any image the tables are empty, and so is the metadata.
    """
    hashed = images.where(F.col("data").isNotNull()).select("style", "z", "x", "y", F.sha2("data", 256).alias("sha256"), "data")
    slim = hashed.groupBy("style", "z", "x", "y").agg(F.min(F.struct("sha256", F.length("data").cast("long").alias("length"))).alias("i"))
    slim = save(archive.with_tile_id(slim.select("style", "z", "x", "y", "i.*")), "archive-tiles")
    firsts = save(archive.shared_offsets(slim), "archive-firsts")
    manifest = slim.join(firsts.select("style", "sha256", "offset"), ["style", "sha256"])
    manifest.select("style", "z", "x", "y", "tile_id", "length", "sha256", "offset").write.mode("overwrite").parquet(f"{folder}/manifest")
    spark = images.sparkSession
    manifest = spark.read.parquet(f"{folder}/manifest")

    parts = 1 + (firsts.agg(F.sum(F.col("length") + 1)).first()[0] or 0) // part_bytes
    blobs = hashed.join(firsts.select("style", "z", "x", "y", "sha256", "tile_id"), ["style", "z", "x", "y", "sha256"])
    blobs = blobs.dropDuplicates(["style", "tile_id"]).repartitionByRange(parts, "style", "tile_id").sortWithinPartitions("style", "tile_id")
    blobs.select("style", F.col("data").cast("string").alias("value")).write.mode("overwrite").partitionBy("style").option("lineSep", "\n").text(f"{folder}/blobs")
    _written(spark, f"{folder}/blobs").write.mode("overwrite").parquet(f"{folder}/parts")

    entries = archive.directory(manifest, leaf)
    entries.repartitionByRange("style", "tile_id").sortWithinPartitions("style", "tile_id").write.mode("overwrite").parquet(f"{folder}/leaves")
    leaves = spark.read.parquet(f"{folder}/leaves")
    leaves.groupBy("style", "leaf").agg(F.min("tile_id").alias("tile_id"), F.count("*").alias("entries")).write.mode("overwrite").parquet(f"{folder}/roots")

    head = archive.archive_header(manifest, tracks, "style")
    head = head.withColumns({"name": F.concat(F.lit("Heatmap ("), "style", F.lit(")")), "format": F.lit("png"), "type": F.lit("overlay")})
    head.write.mode("overwrite").parquet(f"{folder}/metadata")
    return spark.read.parquet(f"{folder}/metadata")


PARTS = "style string, file string, start long, bytes long"


def _written(spark: SparkSession, blobs: str) -> DataFrame:
    """The blob files with the offsets at which they start; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(blobs).where("length > 0")
    path = F.col("path")
    rows = listed.select(names.decoded(F.regexp_extract(path, r"/style=([^/]*)/", 1)).alias("style"), path.alias("file"), F.col("length").cast("long").alias("bytes"))
    number = F.regexp_extract("file", r"/part-(\d+)", 1).cast("long")
    before = Window.partitionBy("style").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return rows.select("style", "file", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("long").alias("start"), "bytes")


def archive_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """style, tile_id, offset, length, data of every tile, by the directory and the blob files alone."""
    entries = spark.read.parquet(f"{folder}/leaves")
    parts = spark.read.parquet(f"{folder}/parts")
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{folder}/blobs").select(F.col("path").alias("file"), "content")
    # An offset meets the files of its stretch; as long as files are on average, so a file lies in few stretches and a stretch has few files.
    stretch = int(parts.agg(F.avg("bytes")).first()[0] or 0) + 1
    end = F.col("start") + F.col("bytes")
    lying = parts.select("style", "file", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / stretch), F.floor((end - 1) / stretch))).alias("stretch"))
    places = entries.select("style", "offset", "length").distinct().withColumn("stretch", F.floor(F.col("offset") / stretch))
    held = places.join(lying, ["style", "stretch"]).where((F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("end")))
    cut = F.substring("content", (F.col("offset") - F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    found = held.join(contents, "file").select("style", "offset", cut.alias("data"))
    every = entries.select("style", "offset", "length", F.explode(F.sequence("tile_id", F.col("tile_id") + F.col("run_length") - 1)).alias("tile_id"))
    return every.join(found, ["style", "offset"]).select("style", "tile_id", "offset", "length", "data")


def read_tile(spark: SparkSession, folder: str, style: str, z: int, x: int, y: int) -> bytes | None:
    """One tile's image: a root, a leaf, an entry, and the bytes at its offset; null if the archive has no such tile."""
    wanted = spark.range(1).select(geo.tile_id(F.lit(z), F.lit(x).cast("long"), F.lit(y).cast("long"))).first()[0]
    below = (F.col("style") == style) & (F.col("tile_id") <= wanted)
    leaf = spark.read.parquet(f"{folder}/roots").where(below).agg(F.max_by("leaf", "tile_id")).first()[0]
    if leaf is None:
        return None
    entry = spark.read.parquet(f"{folder}/leaves").where(below & (F.col("leaf") == leaf)).agg(F.max_by(F.struct("tile_id", "run_length", "offset", "length"), "tile_id")).first()[0]
    if wanted >= entry["tile_id"] + entry["run_length"]:
        return None
    part = spark.read.parquet(f"{folder}/parts").where((F.col("style") == style) & (F.col("start") <= entry["offset"])).agg(F.max_by(F.struct("file", "start"), "start")).first()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(part["file"])
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(entry["offset"] - part["start"])
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, entry["length"]))
    finally:
        stream.close()
