import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heatloom.llm import kd_shards, sketches
from heatloom.llm.common import range_buckets, save

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, bucket string"
ODD = [
    (1, None, None, None, None, "x", "b"),
    (2, "", "en", "a", 0, "x", "b"),
    (2, "", "en", "a", 0, "x", "b"),
    (3, "one two", "en", "b", 7, "x", "b"),
    (None, "w " * 30_000, "de", "b", 60_000, None, None),
    (5, "äöü 漢字   x", "de", None, 12, "x", "b"),
]


def table(tmp_path, spark, rows, schema=DOC, name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_shards_are_even_and_whole(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = kd_shards.op5_sharding(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    bytes_of, homes, slots = Counter(), {}, {}
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        bytes_of[r["shard"]] += r["size"]
        homes.setdefault(text, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(bytes_of) == set(range(8)) and max(bytes_of.values()) < 1.05 * min(bytes_of.values())
    assert all(len(s) == 1 for s in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_group_of_a_third_is_dealt(spark):
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * 20, "en", f"s{i % 5}") for i in range(900)]
    found = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(found) == 8 and max(r["b"] for r in found) < 1.15 * min(r["b"] for r in found)


def test_shards_of_odd_rows(spark, tmp_path):
    folder = table(tmp_path, spark, ODD)
    assert kd_shards.op5_sharding(spark, folder).count() == len(ODD)
    empty = table(tmp_path / "e", spark, [])
    assert kd_shards.op5_sharding(spark, empty).count() == 0
    assert kd_shards.kd_shards(spark.read.parquet(f"{folder}/documents.parquet"), target_bytes=40_000).agg(F.countDistinct("shard")).first()[0] == 2


def tree_of(spark, rows, shards):
    """The groups of rows in the tree's leaves: dicts with the coordinates and `shard`."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    text = F.col("text")
    parts = df.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.length(text).alias("chars"), "source", "lang", F.lit(0).cast("long").alias("part"))
    groups = save(kd_shards._text_groups(parts), "groups")
    leaves = save(kd_shards.kd_tree(groups.drop("rows"), shards), "leaves")
    found = groups.withColumn("tie", kd_shards._tie()).join(leaves.select("key", "shard"), "key").collect()
    assert len(found) == groups.count()
    return [r.asDict() for r in found]


@pytest.mark.parametrize("shards", [5, 8])
def test_every_split_is_a_weighted_median_of_the_widest_dimension(spark, shards):
    """Recomputes each node: the side of every group that is not heavy follows from its bin and tie along the node's widest
    coordinate, and both sides have bytes in proportion to their shards."""
    rows = [(i, f"text {i} " * (1 + i * i % 37), ("en", "de")[i % 2], f"s{i * i % 7}") for i in range(700)]
    groups = tree_of(spark, rows, shards)
    spread = {d: (max(g[d] for g in groups) - min(g[d] for g in groups)) or 1.0 for d in kd_shards.DIMS}

    def check(inside, lo, hi):
        assert {g["shard"] for g in inside} <= set(range(lo, hi)) and inside
        if hi - lo == 1:
            return
        mid, total = (lo + hi) // 2, sum(g["bytes"] for g in inside)
        bounds = {d: (min(g[d] for g in inside), max(g[d] for g in inside)) for d in kd_shards.DIMS}
        dim = max(kd_shards.DIMS, key=lambda d: (bounds[d][1] - bounds[d][0]) / spread[d])
        low, high = bounds[dim]
        width = (high - low) / kd_shards.BINS if high > low else 1.0
        place = lambda g: (max(0, min(kd_shards.BINS - 1, int((g[dim] - low) // width))), g["tie"])
        light = [g for g in inside if g["bytes"] < total / kd_shards.HEAVY]
        left, right = [g for g in inside if g["shard"] < mid], [g for g in inside if g["shard"] >= mid]
        assert max((place(g) for g in light if g["shard"] < mid), default=(-1, 0)) < min((place(g) for g in light if g["shard"] >= mid), default=(1 << 30, 0))
        goal = total * (mid - lo) / (hi - lo)
        assert abs(sum(g["bytes"] for g in left) - goal) <= total / kd_shards.HEAVY
        check(left, lo, mid)
        check(right, mid, hi)

    check(groups, 0, shards)


def test_small_tables_go_through_the_tree(spark, sf_dir):
    """Every group that fits half a shard is placed by the tree, however few there are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    leaves = {g["key"]: g["shard"] for g in tree_of(spark, rows, 8)}
    found = kd_shards.kd_shards(docs).join(docs.select("doc_id", F.xxhash64("text").alias("key")), "doc_id").collect()
    assert len(found) == len(rows) and all(leaves[r["key"]] == r["shard"] for r in found)


def test_many_shards_by_bytes(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("t"), F.col("id")), 3).alias("text"), F.lit("en").alias("lang"), (F.col("id") % 3).cast("string").alias("source"))
    sizes = kd_shards.kd_shards(docs, target_bytes=400).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(sizes) >= 90 and max(r["b"] for r in sizes) < 800


def test_copies_without_ids_are_dealt(spark):
    rows = [(None, "same text " * 20, "en", "s")] * 400 + [(i, f"text {i} " * 20, "en", "s") for i in range(400)]
    found = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("last"), F.count("*").alias("n")).collect()
    assert len(found) == 8 and max(r["b"] for r in found) < 1.15 * min(r["b"] for r in found) and all(r["last"] == r["n"] - 1 for r in found)


def buckets(df, parts=50):
    rows = range_buckets(df.withColumn("t", F.xxhash64("v")), "k", "t", parts).orderBy("k", "t").collect()
    assert [r["bucket"] for r in rows] == sorted(r["bucket"] for r in rows)
    return max(Counter(r["bucket"] for r in rows).values())


def test_buckets_follow_the_counts(spark):
    """One far key, one key for all rows, and few keys each fill no bucket by themselves."""
    df = save(spark.range(4000).select(F.col("id").alias("v")), "t")
    assert buckets(df.withColumn("k", F.when(F.col("v") == 7, F.lit(1 << 62)).otherwise(F.col("v")))) < 200
    assert buckets(df.withColumn("k", F.lit(-(2**63)))) < 200
    assert buckets(df.withColumn("k", F.col("v") % 3)) < 300
    assert buckets(df.withColumn("k", F.when(F.col("v") % 3 == 0, 5).otherwise(F.col("v")))) < 300
    assert buckets(df.withColumn("k", F.col("v")), parts=1) == 4000 and range_buckets(df.limit(0).withColumn("t", F.lit(0)), "v", "t", 9).count() == 0


def shingles(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_fingerprints_against_brute_force(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in sketches.op6_fingerprints(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    off = []
    for i, (doc_id, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = rows[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = shingles(text), shingles(other)
            want = len(a & b) / len(a | b) if a | b else 1.0
            off.append(abs(want - near))
            if len(a | b) <= sketches.K:
                assert near == pytest.approx(want)
    assert sum(off) / len(off) < 0.05 and max(off) < 0.3
    same = {}
    for doc_id, text in docs:
        same.setdefault(text, set()).add(rows[doc_id]["fingerprint"])
    assert all(len(f) == 1 for f in same.values())


def test_next_over_many_buckets(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    size, sketches.BUCKET_BYTES = sketches.BUCKET_BYTES, 30
    try:
        rows = sketches.with_next(df, ["text"]).collect()
        same = sketches.with_next(df.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("bucket"), F.lit(2).alias("next_text")), ["text"]).collect()
    finally:
        sketches.BUCKET_BYTES = size
    assert {r["doc_id"]: r["next_text"] for r in rows} == {i: f"t{(i + 1) % 500}" for i in range(500)}
    assert len(same) == 500 and sorted(r["next_text"] for r in same) == sorted(r["text"] for r in same)
    assert all((r["doc_id"], r["bucket"]) == (None, 1) and r["next_text"] != r["text"] for r in same)


def test_fingerprints_of_odd_rows(spark, tmp_path):
    rows = sketches.op6_fingerprints(spark, table(tmp_path, spark, ODD)).collect()
    assert len(rows) == len(ODD)
    blank = [r for r in rows if r["n_chars"] == 0]
    assert len(blank) == 3 and {r["fingerprint"] for r in blank} == {""}
    assert sketches.op6_fingerprints(spark, table(tmp_path / "e", spark, [])).count() == 0
    one = sketches.op6_fingerprints(spark, table(tmp_path / "o", spark, ODD[3:4])).collect()
    assert one[0]["near_next"] == 1.0


def test_merge_containment_and_count(spark):
    a, b = " ".join(f"w{i}" for i in range(600)), " ".join(f"w{i}" for i in range(300, 1200))
    df = sketches.with_sketch(sketches.with_sketch(spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string"), "a", "sa", 256), "b", "sb", 256)
    s = lambda n: F.col(n)
    r = df.select(sketches.resemblance(s("sa"), s("sb"), 256).alias("j"), sketches.containment(s("sa"), s("sb"), 256).alias("c"), sketches.distinct_count(s("sa"), 256).alias("n"), sketches.distinct_count(sketches.merged(s("sa"), s("sb"), 256), 256).alias("u")).first()
    assert r["j"] == pytest.approx(0.247, abs=0.1) and r["c"] == pytest.approx(0.5, abs=0.15)
    assert r["n"] == pytest.approx(596, rel=0.2) and r["u"] == pytest.approx(1196, rel=0.2)
