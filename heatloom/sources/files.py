"""Activity files in a folder, and the tile files of a tile folder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.functions import names
from heatloom.tables import in_ranges, running

AWAY = r"/(done|errors)/[^/]*$"
#: Activity files by extension, in any case.
ACTIVITIES = "*.{[fF][iI][tT],[gG][pP][xX],[tT][cC][xX]}"
#: Files above this are not read as one value.
LARGE_BYTES = 1 << 30
#: Files up to this are hashed as one value; larger ones piece by piece, which gives the same hash.
WHOLE_BYTES = 16 << 20
#: Files of each format, and where their records end.
RECORDS = (("*.[gG][pP][xX]", "</trk>"), ("*.[tT][cC][xX]", "</Trackpoint>"), ("*.[fF][iI][tT]", "\n"))


def _listed(spark: SparkSession, folder: str | list[str], glob: str = "*") -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    rows = reader.load(folder).withColumn("path", F.col("_metadata.file_path")).withColumn("ext", names.extension(F.col("path")))
    return rows.where(~F.col("path").rlike(AWAY))


def scan_activity_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and ext of activity files below a folder, sorted by path; folders done and errors are left out."""
    return _listed(spark, folder).where(F.col("ext").isin(*names.EXTENSIONS)).select("path", "ext").orderBy("path")


def name_below(path: Column, folder: str) -> Column:
    """The part of a path that follows its folder."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return F.substring(plain(names.decoded(path)), F.length(plain(F.lit(folder.rstrip("/")))) + 2, F.lit(1 << 20))


def file_contents(spark: SparkSession, folder: str | list[str], glob: str = ACTIVITIES, most_bytes: int = LARGE_BYTES) -> DataFrame:
    """path, ext, content and file_hash of activity files of at most `most_bytes`; others' contents are not read."""
    rows = _listed(spark, folder, glob).where(F.col("length") <= most_bytes)
    return rows.select("path", "ext", "content", F.sha2("content", 256).alias("file_hash"))


def plain_path(path: str) -> str:
    """A path as a pattern that only matches itself."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


PIECES = "path string, ext string, size long, block long, place long, value binary"
#: What ends the pieces in which files are read to be hashed.
END = ">"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECES that follow each other in a file, with what is between them, as one; `place` counts them within a block of a file."""
    last, place = None, 0
    for batch in batches:
        rows = zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True)
        for key, found in groupby(rows, lambda r: r[:4]):
            last, place = key, place + 1 if key == last else 0
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "ext", "size", "block", "place", "value"), (*key, place, END.encode().join(r[4] for r in found)), strict=True))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, ext, file_hash of files from their sorted PIECES. Readers drop a byte order mark and the last END; the size tells."""
    end, mark, last = END.encode(), b"\xef\xbb\xbf", None

    def done() -> Iterator[pa.RecordBatch]:
        if last:
            left = last[2] - read
            for h in (plain, marked):
                h.update(end * (left in (len(end), len(end + mark))))
            found = (marked if left >= len(mark) else plain).hexdigest()
            yield pa.RecordBatch.from_pylist([{"path": last[0], "ext": last[1], "file_hash": found}])

    for batch in batches:
        for *key, value in zip(*[batch.column(c) for c in ("path", "ext", "size", "value")], strict=True):
            key, value = [k.as_py() for k in key], value.as_buffer()
            if key != last:
                yield from done()
                last, read, plain, marked = key, 0, hashlib.sha256(), hashlib.sha256(mark)
            else:
                read += len(end)
                plain.update(end)
                marked.update(end)
            read += value.size
            plain.update(value)
            marked.update(value)
    yield from done()


def _hashed_in_pieces(spark: SparkSession, folder: str | list[str], most_bytes: int) -> DataFrame:
    """path, ext, file_hash (SHA-256) of activity files above WHOLE_BYTES, up to most_bytes; no task holds a file."""
    size = F.col("_metadata.file_size")
    reader = spark.read.option("lineSep", END).option("recursiveFileLookup", True).option("pathGlobFilter", ACTIVITIES)
    rows = reader.text(folder).where((size > WHOLE_BYTES) & (size <= most_bytes))
    path = F.col("_metadata.file_path")
    rows = rows.where(~path.rlike(AWAY)).select(path.alias("path"), names.extension(path).alias("ext"), size.alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    pieces = rows.mapInArrow(_joined, PIECES).repartition("path").sortWithinPartitions("path", "block", "place")
    return pieces.mapInArrow(_digests, "path string, ext string, file_hash string")


def any_above(spark: SparkSession, source: str | list[str], most_bytes: int) -> bool:
    """Whether an activity file is larger than `most_bytes`. Contents are not read."""
    return not _listed(spark, source, ACTIVITIES).where(F.col("length") > most_bytes).select("path").isEmpty()


def file_hashes(spark: SparkSession, folder: str | list[str], most_bytes: int = LARGE_BYTES) -> DataFrame:
    """path, ext, file_hash of every file below a folder, or of given files.

    The hash is the SHA-256 of the contents. Of files of other formats no contents are read, and the hash is that of the
    path. Files above `most_bytes` are read as records in splits; theirs is the SHA-256 of their length and of sums over the
    hashes of all records with their numbers in the file, so it depends on the order of the records but not on the splits.
    """
    whole = file_contents(spark, folder, most_bytes=min(most_bytes, WHOLE_BYTES)).select("path", "ext", "file_hash")
    if most_bytes > WHOLE_BYTES and any_above(spark, folder, WHOLE_BYTES):
        whole = whole.unionByName(_hashed_in_pieces(spark, folder, most_bytes))
    other = _listed(spark, folder).where(~F.col("ext").isin(*names.EXTENSIONS)).select("path", "ext", F.sha2("path", 256).alias("file_hash"))
    if not any_above(spark, folder, most_bytes):
        return whole.unionByName(other)
    size, place, records = F.col("_metadata.file_size"), ["block", "place"], None
    for glob, closer in RECORDS:
        reader = spark.read.option("lineSep", closer).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        rows = reader.text(folder).where(size > most_bytes).select("value", F.col("_metadata.file_path").alias("path"), size.alias("size"), F.col("_metadata.file_block_start").alias("block"))
        rows = rows.withColumn("place", F.monotonically_increasing_id()).where(~F.col("path").rlike(AWAY))
        rows = rows.select("path", "size", *place, F.xxhash64("value").alias("first"), F.xxhash64(F.lit(1), "value").alias("second"))
        records = rows if records is None else records.unionByName(rows)
    numbered = running(in_ranges(records, "path", *place), ["path", *place])
    starts = numbered.groupBy("path").agg(F.min("before").alias("start"))
    number = F.col("before") - F.col("start")
    first, second = F.xxhash64("first", number), F.xxhash64("second", number)
    sums = numbered.join(starts, "path").groupBy("path", "size").agg(F.count("*").alias("n"), F.bit_xor(first).alias("x"), F.sum(first.cast("decimal(38,0)")).alias("s"), F.bit_xor(second).alias("y"))
    large = sums.select("path", names.extension(F.col("path")).alias("ext"), F.sha2(F.concat_ws(":", "size", "n", "x", "s", "y"), 256).alias("file_hash"))
    return whole.unionByName(other).unionByName(large)


def list_tiles_on_disk(spark: SparkSession, folder: str) -> DataFrame:
    """style, z, x, y of the tile files below a folder. Contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(folder)
    return tile_addresses(listed.select(F.col("_metadata.file_path").alias("path")))


def tile_addresses(paths: DataFrame) -> DataFrame:
    """style, z, x, y of paths ...<style>/<z>/<x>/<y>.png; other names are ignored."""
    part = lambda i: F.regexp_extract("path", r"([^/]+)/(\d+)/(\d+)/(\d+)\.png$", i)
    found = paths.where(part(1) != "")
    return found.select(part(1).alias("style"), part(2).cast("int").alias("z"), part(3).cast("long").alias("x"), part(4).cast("long").alias("y"))
