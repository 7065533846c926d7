import pytest
from pyspark.sql import functions as F

from heatloom import tables


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("k"), (F.col("id") % 5).alias("v"))
    rows = tables.running(tables.in_ranges(df, "g", "k"), ["g", "k"], F.col("v"), "sum").collect()
    before = 0
    for r in sorted(rows, key=lambda r: (r["g"], r["k"])):
        assert r["sum"] == before
        before += r["v"]
    assert len(rows) == 1000 and tables.running(tables.in_ranges(df.limit(0), "g"), ["g"]).count() == 0


def test_one_key_does_not_fill_one_part(spark):
    """All rows are equal in the key, and still lie in several parts with gapless numbers."""
    df = spark.range(2000).select(F.lit(None).cast("long").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would merge parts this small
    try:
        ranged = tables.in_ranges(df, "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranged.groupBy("__part").count().agg(F.max("count")).first()[0] < 1500
    assert sorted(r["before"] for r in tables.running(ranged, ["k"]).collect()) == list(range(2000))


def test_no_machine_local_folder_on_a_cluster(spark):
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Cluster)
