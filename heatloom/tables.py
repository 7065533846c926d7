"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a temporary one; on a cluster a folder of one machine would lose the
    tables, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="heatloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/heatloom-{uuid.uuid4().hex[:12]}-{name}"
    folder, store = _folder(spark, path)
    store.deleteOnExit(folder)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared folder and read again: cuts lineage, survives lost executors.

    The files go when the application ends, or before by `forget`.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    saved.saved_path = path
    return saved


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def forget(*saved: DataFrame) -> None:
    """Deletes the files of saved tables that nothing will read again."""
    for df in saved:
        folder, store = _folder(df.sparkSession, df.saved_path)
        store.delete(folder, True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end there."""
    folder, store = _folder(spark, path)
    return store.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))


def rename_parts(spark: SparkSession, folder: str) -> None:
    """Turns the single part file of each folder <folder>/<key>=<name> into the file <folder>/<name>; for few such folders."""
    path, store = _folder(spark, folder)
    for found in store.listStatus(path):
        if found.isDirectory():
            part = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(found.getPath(), "part-*"))[0].getPath()
            name = found.getPath().getName().split("=", 1)[1]
            store.rename(part, spark._jvm.org.apache.hadoop.fs.Path(path, name))
            store.delete(found.getPath(), True)


def shuffle_partitions(spark: SparkSession) -> int:
    """As many partitions as a shuffle has before Spark puts small ones together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """df as a saved table of sorted range partitions, with `__part`, which never falls as the keys rise.

    Rows that are equal in all keys may lie in several parts, so no value of a key fills one task.
    """
    ranged = df.withColumn("__any", F.rand(7)).repartitionByRange(*keys, "__any").withColumn("__part", F.spark_partition_id())
    return save(ranged.sortWithinPartitions(*keys, "__any").drop("__any"), "ranges")


def running(ranged: DataFrame, order: list[str], value=None, name: str = "before") -> DataFrame:
    """`in_ranges` rows with `name`: the sum of `value` (default 1: the number) of all rows before each, in the order of `order`.

    A window runs in each part; a table of one row for each part (as many as shuffle partitions) has what comes before it.
    """
    value = F.lit(1) if value is None else value
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__part").agg(F.sum(value).alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, "__part")
    return rows.withColumn(name, (F.col(name) + F.col("__start")).cast("long")).drop("__part", "__start")
