"""A store whose tables change together: a log of versions names the files that count.

Every import of a batch writes its tables into folders of its own, <store>/<table>/batch_id=n/run=r, which nobody reads yet.
The last step adds one file to <store>/_versions, by a rename that fails if the version exists: from then on the run counts,
instead of any earlier run of the same batch. A job that dies before leaves readers where they were. A writer whose version was
taken in the meantime judged its batch by an old state; it has to start again (`Conflict`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = "version long, batch_id long, run string"
LOG = "_versions"


class Conflict(Exception):
    """Another writer committed first."""


def _paths(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    found = jvm.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, store: str) -> DataFrame:
    """version, batch_id, run of every commit."""
    folder, files = _paths(spark, f"{store}/{LOG}")
    if not files.exists(folder):
        return spark.createDataFrame([], VERSIONS)
    return spark.read.schema(VERSIONS).option("pathGlobFilter", "*.json").json(f"{store}/{LOG}")


def state(spark: SparkSession, store: str) -> tuple[int, dict[int, str]]:
    """The last version (0: none), and the run that counts of each batch: one short entry for each batch that was imported."""
    rows = versions(spark, store).groupBy("batch_id").agg(F.max_by("run", "version").alias("run"), F.max("version").alias("version")).collect()
    return max([r["version"] for r in rows], default=0), {r["batch_id"]: r["run"] for r in rows}


def commit(spark: SparkSession, store: str, version: int, batch_id: int, run: str) -> None:
    """Makes a run count as `version`; raises Conflict if that version exists."""
    jvm = spark._jvm
    folder, files = _paths(spark, f"{store}/{LOG}")
    files.mkdirs(folder)
    target = jvm.org.apache.hadoop.fs.Path(folder, f"{version:012d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".{run}.draft")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps({"version": version, "batch_id": batch_id, "run": run}).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = jvm.java.lang.Enum.valueOf(rename, "NONE")
    try:
        context.rename(draft, target, options)
    except Py4JJavaError as failed:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(failed.java_exception):
            raise Conflict(f"version {version} of {store} exists") from None
        raise


def write(rows: DataFrame, store: str, table: str, batch_id: int, run: str, *partitions: str) -> DataFrame:
    """rows as a table's part of a run, read again; it counts once the run is committed."""
    path = f"{store}/{table}/batch_id={batch_id}/run={run}"
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read(spark: SparkSession, store: str, table: str, schema: str, runs: dict[int, str] | None = None) -> DataFrame:
    """A table as of the last version, or of given runs, with batch_id; empty if there is none."""
    runs = state(spark, store)[1] if runs is None else runs
    schema = f"{schema}, batch_id long"
    if not runs:
        return spark.createDataFrame([], schema)
    paths = [f"{store}/{table}/batch_id={b}/run={r}" for b, r in sorted(runs.items())]
    return spark.read.schema(schema).option("basePath", f"{store}/{table}").parquet(*paths).drop("run")


def put(spark: SparkSession, store: str, batch_id: int, fill: Callable[[dict[int, str], str], DataFrame], attempts: int = 5) -> DataFrame:
    """Runs fill(runs, run), which judges the batch by the runs of the other batches and writes its tables, and commits the run.

    If another writer was faster, all is judged again by what that one stored. Returns what fill returned.
    """
    for _ in range(attempts):
        last, runs = state(spark, store)
        run = uuid.uuid4().hex[:12]
        found = fill({b: r for b, r in runs.items() if b != batch_id}, run)
        try:
            commit(spark, store, last + 1, batch_id, run)
        except Conflict:
            continue
        return found
    raise Conflict(f"{attempts} attempts to store batch {batch_id} in {store} met other writers")


def vacuum(spark: SparkSession, store: str, tables: list[str]) -> int:
    """Deletes the folders of runs that don't count, and returns how many; for times when no reader is older than the last
    version and no writer is at work."""
    _, runs = state(spark, store)
    gone = 0
    for table in tables:
        folder, files = _paths(spark, f"{store}/{table}/batch_id=*/run=*")
        for found in files.globStatus(folder) or []:
            path = found.getPath()
            batch, run = int(path.getParent().getName().split("=")[1]), path.getName().split("=")[1]
            if runs.get(batch) != run:
                gone += bool(files.delete(path, True))
    return gone


def followed(spark: SparkSession, store: str) -> DataFrame:
    """The log as a stream of (version, batch_id, run)."""
    folder, files = _paths(spark, f"{store}/{LOG}")
    files.mkdirs(folder)
    return spark.readStream.schema(VERSIONS).option("pathGlobFilter", "*.json").json(f"{store}/{LOG}")


def committed(spark: SparkSession, store: str, entries: DataFrame, table: str, schema: str) -> DataFrame:
    """The rows of a table that some entries of the log (batch_id, run) brought; for streams over the log."""
    runs = {r["batch_id"]: r["run"] for r in entries.orderBy("version").collect()}
    try:
        return read(spark, store, table, schema, runs)
    except AnalysisException:  # a later run of the batch took its place, and its files were vacuumed
        return spark.createDataFrame([], f"{schema}, batch_id long")
