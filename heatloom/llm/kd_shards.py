"""Shards by a k-d tree over the metadata of texts, cut at weighted medians.

The unit is a group of equal texts. Its point has four coordinates: code points, source, language and smallest doc_id.
A node that holds several shards is cut across its widest coordinate (spread relative to the whole table's) where the
bytes on the left match the shards on the left. The cut comes from two histograms (the coordinate, then the text's hash
for ties), so no task sorts a node. Nodes, bounds and cuts are tables; none passes the driver.

Every group goes through the tree. At a cut, groups of at least 1/HEAVY of the node's bytes (at most HEAVY of them) go to
the side on which more of them lies; the cut of all smaller groups is then moved along the same coordinate until both sides
match, so that no large group unbalances a node. Where these are too few for that, one large group changes sides, or two
change places. Only a group of more than half a shard can't stay whole beside equal shares; its rows are dealt evenly to
parts of about 1/PARTS of a shard, and each part goes through the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import save
from heatloom.tables import forget, in_ranges, running

HEAVY = 64
PARTS = 32
#: A node whose sides are off by less than this share of its bytes is even.
EVEN = 0.004
BINS = 1024
TIE_BITS = 12
DIMS = ("chars", "origin", "tongue", "first_id")
GROUP = ["key", "text_crc32", "size"]


def _code(column: str):
    """A number that follows a string's order by its first six bytes; null is lowest."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def _text_groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP, "part").agg(
        F.sum("size").alias("bytes"),
        F.count("*").alias("rows"),
        F.min("chars").cast("double").alias("chars"),
        F.min(_code("source")).alias("origin"),
        F.min(_code("lang")).alias("tongue"),
        F.coalesce(F.min("doc_id").cast("double"), F.lit(-1.0)).alias("first_id"),
    )


def _tie():
    """The hash bin of a group, from 0."""
    return F.shiftrightunsigned(F.xxhash64("key", "part"), 64 - TIE_BITS)


def _first_reaching(counts: DataFrame, at: str, weight: str, goal: str) -> DataFrame:
    """For each node the first `at` by which the running sum of `weight` reaches `goal`: lo, at, before (the sum before it), w."""
    run = counts.withColumn("upto", F.sum(weight).over(Window.partitionBy("lo").orderBy(at)))
    found = run.where((F.col("upto") >= F.col(goal)) & (F.col(weight) > 0))
    return found.groupBy("lo").agg(F.min(F.struct(F.col(at).alias("at"), (F.col("upto") - F.col(weight)).alias("before"), F.col(weight).alias("w"))).alias("x")).select("lo", "x.*")


def _evened(heavy: DataFrame, light_left: DataFrame, nodes: DataFrame) -> DataFrame:
    """The heavy groups (lo, ..., heavy_left) of all nodes; in those that are not even, the one change of sides or of places
    that brings the left side nearest to its goal is made. A node has at most HEAVY of them."""
    name = F.struct(*GROUP, "part").alias("name")
    sums = light_left.select("lo", "bytes").unionByName(heavy.where("heavy_left").select("lo", "bytes")).groupBy("lo").agg(F.sum("bytes").alias("left"))
    off = nodes.join(sums, "lo", "left").select("lo", (F.col("goal") - F.coalesce("left", F.lit(0))).alias("off"), (F.col("least") * HEAVY * EVEN).alias("least_off"))
    off = off.where(F.abs("off") > F.col("least_off")).select("lo", "off")
    sides = heavy.join(off, "lo").select("lo", "off", name, "bytes", "heavy_left")
    ones = sides.select("lo", "off", F.when(F.col("heavy_left"), -F.col("bytes")).otherwise(F.col("bytes")).alias("gain"), F.array("name").alias("names"))
    left = sides.where("heavy_left").select("lo", "off", F.col("name").alias("from"), F.col("bytes").alias("less"))
    right = sides.where(~F.col("heavy_left")).select("lo", F.col("name").alias("to"), F.col("bytes").alias("more"))
    twos = left.join(right, "lo").select("lo", "off", (F.col("more") - F.col("less")).alias("gain"), F.array("from", "to").alias("names"))
    best = ones.unionByName(twos).withColumn("rest", F.abs(F.col("off") - F.col("gain"))).where(F.col("rest") < F.abs("off"))
    best = best.groupBy("lo").agg(F.min(F.struct("rest", F.size("names"), "names"))["names"].alias("names"))
    moved = heavy.withColumn("name", F.struct(*GROUP, "part")).join(best, "lo", "left")
    changed = F.coalesce(F.array_contains("names", F.col("name")), F.lit(False))
    return save(moved.select("lo", *GROUP, "part", (F.col("heavy_left") != changed).alias("heavy_left")), "kd-evened")


def _split(rows: DataFrame, ranges: dict[str, float]) -> DataFrame:
    """rows (groups in nodes of shards lo to hi - 1) with the nodes that hold several shards cut in two."""
    open_ = rows.where("hi - lo > 1")
    bounds = open_.groupBy("lo").agg(F.max("hi").alias("hi"), F.sum("bytes").alias("total"), *[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("min", F.min), ("max", F.max))])
    spreads = F.array(*[(F.col(f"max_{d}") - F.col(f"min_{d}")) / ranges[d] for d in DIMS])
    dim = F.array_position(spreads, F.array_max(spreads)).cast("int")
    low, high = (F.element_at(F.array(*[F.col(f"{n}_{d}") for d in DIMS]), F.col("dim")) for n in ("min", "max"))
    mid = F.floor((F.col("lo") + F.col("hi")) / 2)
    bounds = bounds.withColumn("dim", dim).withColumn("mid", mid)
    width = F.when(high > low, (high - low) / BINS).otherwise(F.lit(1.0))
    nodes = bounds.select("lo", "dim", "mid", low.alias("low"), width.alias("width"), (F.col("total") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("goal"), (F.col("total") / HEAVY).alias("least"))
    nodes = save(nodes, "kd-nodes")
    value = F.element_at(F.array(*DIMS), F.col("dim"))
    bin_ = F.greatest(F.lit(0), F.least(F.floor((value - F.col("low")) / F.col("width")), F.lit(BINS - 1)))
    binned = rows.join(nodes.drop("goal"), "lo", "left").withColumn("bin", bin_).withColumn("tie", _tie()).withColumn("heavy", F.col("bytes") >= F.col("least")).drop("dim", "low", "width", "least")
    binned = save(binned, "kd-binned")
    split = binned.where(F.col("mid").isNotNull())

    light = F.when(F.col("heavy"), 0).otherwise(F.col("bytes"))
    bins = save(split.groupBy("lo", "bin").agg(F.sum("bytes").alias("all"), F.sum(light).alias("light")).join(nodes.select("lo", "goal"), "lo"), "kd-bins")
    first = _first_reaching(bins, "bin", "all", "goal").join(nodes.select("lo", "goal"), "lo")
    heavy = split.where("heavy").join(first, "lo")
    at_cut = F.when(F.col("bin") == F.col("at"), F.col("bytes")).otherwise(0)
    earlier = F.coalesce(F.sum(at_cut).over(Window.partitionBy("lo").orderBy("bin", "tie", *GROUP, "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # HEAVY rows at most
    goes_left = (F.col("bin") < F.col("at")) | ((F.col("bin") == F.col("at")) & (F.col("before") + earlier + F.col("bytes") / 2 <= F.col("goal")))
    heavy = save(heavy.select("lo", *GROUP, "part", "bytes", goes_left.alias("heavy_left")), "kd-heavy")
    on_left = heavy.where("heavy_left").groupBy("lo").agg(F.sum("bytes").alias("heavy_bytes"))
    counts = bins.join(on_left, "lo", "left").withColumn("rest", F.col("goal") - F.coalesce("heavy_bytes", F.lit(0)))
    cut = _first_reaching(counts, "bin", "light", "rest").join(counts.select("lo", "rest").distinct(), "lo", "right")
    cut = save(cut.select("lo", F.when(F.col("rest") <= 0, -1).otherwise(F.coalesce("at", F.lit(BINS))).alias("cut_bin"), (F.col("rest") - F.col("before")).alias("rest")), "kd-cuts")
    fine = split.where(~F.col("heavy")).join(cut, "lo").where(F.col("bin") == F.col("cut_bin"))
    fine = _first_reaching(fine.groupBy("lo", "tie").agg(F.sum("bytes").alias("w"), F.first("rest").alias("rest")), "tie", "w", "rest")
    fine = fine.join(cut, "lo").select("lo", (F.col("at") + F.when(F.col("rest") - F.col("before") >= F.col("w") / 2, 1).otherwise(0)).alias("cut_tie"))
    cut = save(cut.select("lo", "cut_bin").join(fine, "lo", "left"), "kd-ties")

    light_left = (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("tie") < F.col("cut_tie")))
    evened = _evened(heavy, split.where(~F.col("heavy")).join(cut, "lo").where(light_left), nodes)
    placed = binned.join(cut, "lo", "left").join(evened, ["lo", *GROUP, "part"], "left")
    left = F.coalesce("heavy_left", light_left)
    lo, hi = (F.when(F.col("mid").isNull(), F.col(c)).when(left, a).otherwise(b) for c, a, b in (("lo", F.col("lo"), F.col("mid")), ("hi", F.col("mid"), F.col("hi"))))
    kept = [*GROUP, "part", "bytes", *DIMS]
    out = save(placed.select(*kept, lo.alias("lo"), hi.alias("hi")), "kd-level")
    forget(nodes, binned, bins, heavy, cut, evened)
    return out


def kd_tree(groups: DataFrame, shards: int) -> DataFrame:
    """groups (those of `_text_groups`) with the shard of each, through a tree of about log2(shards) levels."""
    bounds = groups.agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("min", F.min), ("max", F.max))]).first()
    ranges = {d: ((bounds[f"max_{d}"] or 0.0) - (bounds[f"min_{d}"] or 0.0)) or 1.0 for d in DIMS}
    rows = groups.withColumn("lo", F.lit(0).cast("long")).withColumn("hi", F.lit(shards).cast("long"))
    for level in range((shards - 1).bit_length()):
        before, rows = rows, _split(rows, ranges)
        if level:
            forget(before)
    return rows.select(*GROUP, "part", "bytes", F.col("lo").cast("int").alias("shard"))


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """Every row of docs with its shard: doc_id, size, text_crc32, shard, slot.

    docs has doc_id, text, source and lang; further columns are ignored. size is the text's UTF-8 bytes plus 1, a null text
    counts as empty. Equal texts share a shard unless they fill over half of one. Give `shards`, or `target_bytes` for as
    many shards of about that size as the table needs. Repeated rows are kept, each with a slot of its own; slots run
    from 0 in each shard. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = save(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.length(text).alias("chars"),
            "source",
            "lang",
            F.lit(0).cast("long").alias("part"),
        ),
        "kd-rows",
    )
    groups = save(_text_groups(rows), "kd-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    leaf = total / shards
    large = groups.where((F.col("bytes") > leaf / 2) & (F.col("rows") > 1) & F.lit(shards > 1))  # fewer than 2 * shards groups
    large = save(large.select(*GROUP, F.least(F.col("rows"), F.ceil(F.col("bytes") * PARTS / F.lit(leaf or 1.0))).alias("parts")), "kd-large")
    if not large.isEmpty():
        dealt = running(in_ranges(rows.join(large, GROUP), *GROUP, "doc_id"), [*GROUP, "doc_id"])
        dealt = save(dealt.withColumn("part", F.pmod("before", F.col("parts"))).select(rows.columns), "kd-dealt")
        rows = rows.join(large, GROUP, "left_anti").unionByName(dealt)
        groups = save(groups.join(large, GROUP, "left_anti").unionByName(_text_groups(dealt)), "kd-groups")
    homes = save(kd_tree(groups.drop("rows"), shards).select(*GROUP, "part", "shard"), "kd-homes")
    assigned = running(in_ranges(rows.join(homes, [*GROUP, "part"]).select("doc_id", *GROUP, "shard"), "shard", "doc_id", "key"), ["shard", "doc_id", "key"])
    assigned = save(assigned, "kd-assigned")
    starts = assigned.groupBy("shard").agg(F.min("before").alias("start"))
    return assigned.join(starts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("before") - F.col("start")).alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes; null and empty texts and repeated rows as in `kd_shards`."""
    found = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
