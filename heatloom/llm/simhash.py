"""SimHash near-duplicates by anchor-point covering.

Each 64-bit word of a fingerprint has two blocks of 31 bits (0 to 30 and 32 to 62). The anchors of a block are the code
words of the [31, 26] Hamming code, a perfect code of covering radius 1: every block has exactly one anchor within 1, its
home, and 16 within 2 (only itself, if the block is an anchor). Blocks that differ in at most one bit therefore meet if one
goes to its home and the other visits every anchor within radius 1 + 1; blocks that agree meet at home alone.

op7: 64 bits, 3 differing bits, so one of two blocks differs in at most one: every link is found.
near_duplicates: texts at Jaccard similarity 0.8 of five-word shingles differ in up to 15 % of the bits of a SimHash over all
shingles. A block of 31 bits meets at home then with probability 0.014, so recall 0.999 would take about 490 blocks. Instead a
fingerprint has WORDS SimHashes of 64 bits, each over SAMPLED shingles chosen by least hash, as MinHash chooses them. The anchors
of a word are the code words of the [63, 57] Hamming code, perfect and of covering radius 1 too, over its bits 0 to 62. A word is
at one home and visits the 32 anchors within radius 1 + 1 (only itself, if it is one), so words that differ in at most one of
these bits always meet. Texts at similarity J have an equal word with probability 1 - (1 - J**SAMPLED)**WORDS: 0.9995 at 0.8,
0.007 at 0.3; words that differ come on top. An anchor has 57 bits, so hardly any words meet by chance, and a shorter one, as op7
has, would bring 2**31 times as many. Meeting texts are then compared by the exact similarity of the same shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import forget, save, words
from heatloom.llm.graph import components

SEED = 42
CHUNK = 4096
#: 64-bit words of a near-duplicate fingerprint, and shingles sampled for each: 1 - (1 - 0.8**7)**32 = 0.9995.
WORDS = 32
SAMPLED = 7
#: Bits of a word that the longer code covers, and words whose visits are shuffled at once.
PLACES = 63
ROUND = 4
#: Texts that are compared with each other at once.
BLOCK = 400
#: Copies of each text, on average, that the blocks of a word's group may take before its texts meet by prefix keys.
COPIES = 4
#: Buckets of shingle hashes whose texts are counted, to order shingles by how rare they are.
SEEN = 1 << 20
#: Smallest sizes of the classes of sets of like size, each about 1.04 times the one before.
CLASS_STARTS = np.unique(np.ceil(1.04 ** np.arange(560)).astype(np.int64))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Of (n, longs) hashes, the words whose bits are set in over half of the n; zero without hashes."""
    n, longs = hashes.shape
    votes = np.zeros(64 * longs, dtype=np.int64)
    for i in range(0, n, CHUNK):
        part = np.ascontiguousarray(hashes[i : i + CHUNK]).view(np.uint8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * votes > n, bitorder="little").view(np.int64)


def shingle_fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash, signed, over all shingles of a text, repeats included; 0 without words."""
    found = (text or "").encode().lower().split()
    runs = zip(*(found[i:] for i in range(shingle)), strict=False) if len(found) >= shingle else [found] * bool(found)
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in runs], dtype=np.uint64)
    return int(_bits(hashes.reshape(-1, 1))[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One odd factor for each sampled shingle of each word of a fingerprint.
FACTORS = _mixed(np.arange(1, WORDS * SAMPLED + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sampled_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WORDS 64-bit SimHashes of a set of shingle hashes, each over SAMPLED of them: those that are least under its own hashes.

    Sets of Jaccard similarity J agree in a sample with probability J, so in a word with J**SAMPLED, whatever their sizes.
    """
    least = np.full(len(FACTORS), 2**64 - 1, dtype=np.uint64)
    own = np.asarray(shingles, dtype=np.int64).view(np.uint64)
    for i in range(0, len(own), 256):
        x = FACTORS[:, None] * own[None, i : i + 256]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=1), out=least)
    votes = np.unpackbits(_mixed(least ^ FACTORS).reshape(WORDS, SAMPLED, 1).view(np.uint8), axis=2, bitorder="little").sum(axis=1, dtype=np.uint8)
    return np.packbits(2 * votes > SAMPLED, axis=1, bitorder="little").view(np.int64).ravel()


def _shingle_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingle_fingerprint(t) for t in batch], dtype="int64")


def _sampled_batches(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in sets:
        yield pd.Series([sampled_fingerprint(x) for x in batch], dtype=object)


def _masks(places: int) -> list[int]:
    """The bits whose parities make up the syndrome of a block in the Hamming code of that length."""
    return [sum(1 << p for p in range(places) if (p + 1) >> k & 1) for k in range(places.bit_length())]


def _syndrome(block: str, places: int = 31) -> str:
    return " | ".join(f"shiftleft(bit_count({block} & {m}L) & 1, {k})" for k, m in enumerate(_masks(places)))


def blocks(fingerprint: Column, longs: int) -> Column:
    """Array of (block number, 31 bits, syndrome)."""
    halves = [(2 * i + h, F.shiftrightunsigned(F.get(fingerprint, F.lit(i)), 32 * h).bitwiseAND(F.lit(0x7FFFFFFF))) for i in range(longs) for h in (0, 1)]
    return F.array(*[F.struct(F.lit(n).cast("long").alias("n"), b.cast("long").alias("x")) for n, b in halves])


def _with_block(nodes: DataFrame, longs: int) -> DataFrame:
    return nodes.withColumn("b", F.explode(blocks(F.col("fp"), longs))).withColumn("s", F.expr(_syndrome("b.x"))).drop("fp")


HOME = "shiftleft(b.n, 31) | (b.x ^ IF(s = 0, 0L, shiftleft(1L, s - 1)))"
FAR = "shiftleft(b.n, 31) | (b.x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))"
VISITED = f"concat(array({HOME}), transform(filter(IF(s = 0, array(), sequence(1, 31)), i -> i < (i ^ s)), i -> {FAR}))"


def at_home(nodes: DataFrame, longs: int) -> DataFrame:
    """(id, anchor) of nodes (id, fp array<long>): one row per block."""
    return _with_block(nodes, longs).select("id", F.expr(HOME).alias("anchor"))


def visiting(nodes: DataFrame, longs: int) -> DataFrame:
    """(id, anchor) for every anchor within covering radius 1 plus threshold 1 of each block."""
    return _with_block(nodes, longs).select("id", F.explode(F.expr(VISITED)).alias("anchor"))


def close_fingerprints(nodes: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between the distinct 64-bit fingerprints of nodes (id long) at 3 or fewer differing bits."""
    nodes = nodes.withColumn("fp", F.array("id"))
    homes = at_home(nodes, 1).withColumnRenamed("id", "a")
    visits = visiting(nodes, 1).withColumnRenamed("id", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)
    return homes.join(visits, "anchor").where(near).select("a", "b").distinct()


def word_home(word: str) -> Column:
    """The one anchor of the [63, 57] code within 1 of a word's bits 0 to 62."""
    s = _syndrome(word, PLACES)
    return F.expr(f"({word} & {2**PLACES - 1}L) ^ IF(({s}) = 0, 0L, shiftleft(1L, ({s}) - 1))")


#: Row s: flips of two bits that lead from a word of syndrome s to the anchors at distance 2 (none for 0).
FLIPS = np.array([[1 << i - 1 ^ 1 << (i ^ s) - 1 for i in range(1, PLACES + 1) if i < i ^ s] if s else [0] * 31 for s in range(PLACES + 1)], dtype=np.int64)


def visited_anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in words, anchor): the anchors besides home within covering radius 1 plus threshold 1 of each word's bits 0 to 62."""
    words = np.asarray(words, dtype=np.int64) & np.int64(2**PLACES - 1)
    s = np.zeros(len(words), dtype=np.int64)
    for k, m in enumerate(_masks(PLACES)):
        s |= (np.bitwise_count(words & np.int64(m)).astype(np.int64) & 1) << k
    away = np.flatnonzero(s)  # an anchor's next ones are at distance 3
    return np.repeat(away, FLIPS.shape[1]), (words[away, None] ^ FLIPS[s[away]]).ravel()


def _visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = batch["word"].to_numpy()
        place, anchors = visited_anchors(words)
        yield pd.DataFrame({"word": words[place], "anchor": anchors})


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64-bit SimHash of three-word shingles) and component_id for every row of docs (doc_id, text).

    Fingerprints at 3 or fewer differing bits are linked; component_id is the smallest doc_id that links reach. Equal
    fingerprints are one node, so a large group of copies is one row until the last join, in which Spark may split it.
    Null and blank texts have fingerprint 0 and link like others; null doc_ids are kept and never become a component_id
    unless a component has no other.
    """
    rows = save(docs.select("doc_id", F.pandas_udf(_shingle_batches, "long")(F.coalesce("text", F.lit(""))).alias("fp")), "simhash")
    nodes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(close_fingerprints(nodes.select(F.col("fp").alias("id"))))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = save(placed.join(smallest, "root").select("fp", "component_id"), "simhash-roots")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_shingles(df: DataFrame, shingle: int) -> DataFrame:
    """df (id, text) with the sorted distinct hashes of its five-word shingles (or of all words, if fewer)."""
    df = df.withColumn("_w", words(F.lower("text")))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    many = F.transform(F.sequence(F.lit(0), F.size("_h") - shingle), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(shingle)]))
    one = F.array(F.xxhash64(F.array_join("_w", " ")))
    return df.select("id", F.array_distinct(F.when(F.size("_h") >= shingle, many).otherwise(one)).alias("shingles"))


def _spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges among (i, j) rows that connect what all of them connect: at most n - 1."""
    root, kept = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def alike(sets: list[np.ndarray], similarity: float, columns: int = 4096) -> np.ndarray:
    """All (i, j), i < j, of sets (arrays of distinct values) whose Jaccard similarity is at least `similarity`."""
    sizes = np.array([len(x) for x in sets], dtype=np.float32)
    rows = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, value = rows[times[value] > 1], value[times[value] > 1]  # what only one set has is shared by none
    order = np.argsort(value, kind="stable")
    rows, value = rows[order], np.unique(value[order], return_inverse=True)[1]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(value[-1]) + 1 if len(value) else 0, columns):
        at = slice(*np.searchsorted(value, (low, low + columns)))
        part = np.zeros((len(sets), columns), dtype=np.float32)
        part[rows[at], value[at] - low] = 1
        shared += part @ part.T
    near = shared >= similarity * (sizes[:, None] + sizes[None] - shared)
    return np.argwhere(np.triu(near, 1))


def _links_across(similarity: float):
    """Exact links between texts of different components that share a part of a group; at most those that connect."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in rows.groupby(["key", "i", "j"], sort=False):
            ids, roots = group["id"].to_numpy(), group["root"].to_numpy()
            if (roots == roots[0]).all():
                continue
            pairs = alike([np.asarray(x, dtype=np.int64) for x in group["shingles"]], similarity)
            found += [(ids[i], ids[j]) for i, j in pairs if roots[i] != roots[j]]
        found = np.array(found, dtype=np.int64).reshape(-1, 2)
        ids, place = np.unique(found, return_inverse=True)
        kept = _spanning(place.reshape(-1, 2), len(ids))
        return pd.DataFrame({"a": [ids[i] for i, _ in kept], "b": [ids[j] for _, j in kept]}, dtype="int64")

    return run


def _similar(a: Column, b: Column, similarity: float) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared >= similarity * (F.size(a) + F.size(b) - shared)


def _size_class(n: float) -> int:
    return int(np.searchsorted(CLASS_STARTS, n, "right")) - 1


def prefix_keys(shingles: np.ndarray, seen: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a set of shingle hashes: any two sets whose Jaccard similarity is at least `similarity` have one in
    common, and it is a key of the home of the smaller one.

    Shingles are ordered by how often their bucket was `seen` (texts for each bucket of hashes), rare ones first. Sets of a
    and b shingles have to share s = similarity / (1 + similarity) * (a + b), so the first shared one is among the first
    a - s + 1 of the one and b - s + 1 of the other. A set has such a prefix for each size class that its smaller partners
    may have, and for its own class, its home; a key is a hash of shingle and class whose lowest bit tells a home. What all texts
    share comes last in the order, so texts that share a passage and are not near have no key of a home in common. Buckets seen
    once are left out: no other set has them.
    """
    own = np.asarray(shingles, dtype=np.int64)
    count = seen[own % len(seen)]
    order = np.lexsort((own, count))
    own, seen_once = own[order].view(np.uint64), count[order] < 2
    n, keys = len(own), [np.zeros(0, dtype=np.uint64)]
    home = _size_class(n)
    for c in range(_size_class(np.ceil(similarity * n - 1e-9)), home + 1 if n else 0):
        partner = max(CLASS_STARTS[c], similarity * n)
        first = n - int(np.ceil(similarity / (1 + similarity) * (n + partner) - 1e-9)) + 1
        hashes = _mixed(own[:first][~seen_once[:first]] + np.uint64(c * int(FACTORS[0]) % 2**64))
        keys.append(hashes >> np.uint64(1) << np.uint64(1) | np.uint64(c == home))
    return np.concatenate(keys).view(np.int64)


def _with_prefix_keys(texts: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(key, home, id, root) of texts (id, root), a row for each of their prefix keys. SEEN counts pass the driver."""
    sets = save(texts.join(shingles, "id"), "near-wide")
    counts = sets.select(F.explode("shingles").alias("x")).select(F.pmod("x", F.lit(SEEN)).alias("bucket")).groupBy("bucket").count().toPandas()
    seen = np.zeros(SEEN, dtype=np.uint32)
    seen[counts["bucket"]] = np.minimum(counts["count"], 2**32 - 1)

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([prefix_keys(x, seen, similarity) for x in batch], dtype=object)

    rows = sets.select(F.explode(keys("shingles")).alias("x"), "id", "root")
    return rows.select(F.col("x").bitwiseAND(F.lit(-2).cast("long")).alias("key"), F.col("x").bitwiseAND(F.lit(1).cast("long")).alias("home"), "id", "root")


def _mixed_groups(rows: DataFrame) -> DataFrame:
    """The rows (key, home, id, root) of keys with a text at home and with several roots; of keys of the same texts, one stays."""
    same = [F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("ids")]
    groups = rows.groupBy("key").agg(*same, F.max("home").alias("home"), (F.min("root") < F.max("root")).alias("mixed"))
    groups = groups.where("mixed AND home = 1")
    return rows.join(groups.groupBy("n", "low", "high", "ids").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _parts(rows: DataFrame) -> DataFrame:
    """For each key of mixed groups (key, id, root): the largest component `most`, parts of it (inner) and of the others (outer).

    The largest component's texts need no comparison with each other, so parts of up to BLOCK / 2 texts are formed of it and of
    the others; each part of the others meets every part. Groups of up to BLOCK texts are one part. `wide` groups take more than
    COPIES copies of a text.
    """
    sides = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    sides = sides.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    few = F.col("n") <= BLOCK
    inner, outer = F.ceil(F.col("most.n") * 2 / BLOCK), F.ceil((F.col("n") - F.col("most.n")) * 2 / BLOCK)
    sides = sides.select("key", "n", "most", F.when(few, 0).otherwise(inner).alias("inner"), F.when(few, 1).otherwise(outer).alias("outer"))
    copies = F.col("most.n") * F.col("outer") + (F.col("n") - F.col("most.n")) * (F.col("inner") + F.col("outer"))
    return sides.select("key", F.col("most.root").alias("most"), "inner", "outer", (copies > COPIES * F.col("n")).alias("wide"))


def _dealt_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with `part`, and `others`: the text meets the parts from 0 to this one."""
    rows = rows.join(parts, "key")
    is_inner = (F.col("inner") > 0) & (F.col("root") == F.col("most"))
    place = F.pmod(F.xxhash64("id"), F.when(is_inner, F.col("inner")).otherwise(F.col("outer")))
    part = F.when(is_inner, F.col("outer") + place).otherwise(place)
    others = F.when(is_inner, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    return rows.select("key", "id", "root", part.alias("part"), others.cast("long").alias("others"))


def _blocks_across(met: DataFrame, links: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(key, id, root, part, others): groups whose texts `links` don't connect, in parts that have to meet.

    An anchor's group that is not wide is compared as it is. The texts of wide groups, which boilerplate brings together, meet by
    prefix keys instead, so what is not near is hardly ever copied.
    """
    roots = save(components(links), "near-roots")
    rows = met.where("n > 2").join(roots, met["id"] == roots["node"], "left").select("key", "home", "id", F.coalesce("root", "id").alias("root"))
    rows = save(_mixed_groups(rows), "near-mixed")
    parts = save(_parts(rows), "near-parts")
    dealt = _dealt_parts(rows, parts.where("NOT wide"))
    wide = parts.where("wide")
    if not wide.isEmpty():
        texts = rows.join(wide, "key", "left_semi").select("id", "root").distinct()
        finer = save(_mixed_groups(save(_with_prefix_keys(texts, shingles, similarity), "near-keys")), "near-finer")
        dealt = dealt.unionByName(_dealt_parts(finer, save(_parts(finer), "near-finer-parts")))
    return save(dealt, "near-across")


def _across_components(met: DataFrame, links: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between texts that meet at an anchor but that `links` don't connect."""
    rows = _blocks_across(met, links, shingles, similarity)
    n = rows.agg(F.sum(F.col("others") + 1)).first()[0]  # rows of all blocks
    if not n:
        return links.limit(0)
    blocks = rows.join(shingles, "id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others"))))
    blocks = blocks.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "root", "shingles")
    dealt = blocks.withColumn("deal", F.pmod(F.xxhash64("key", "i", "j"), F.lit(1 + n // BLOCK)))  # a block or two each
    return dealt.groupBy("deal").applyInPandas(_links_across(similarity), "a long, b long").distinct()


def _save_lean(df: DataFrame, name: str) -> DataFrame:
    """`save` that deletes its shuffle files when it is done; else they stay until the driver collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return save(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def meeting(nodes: DataFrame) -> DataFrame:
    """(id, key, home, n, hub) of nodes (id, fp array<long>): texts that meet at an anchor (key) of a word of their fingerprints.

    Every text is at the home of each of its words and visits all anchors within covering radius 1 plus threshold 1; an anchor
    counts if it is someone's home and two meet there. home is 1 for those at home; hub is the smallest id of these, and n
    counts them and the different words that visit. Equal words are one node until the last join, so an anchor has at most 64
    words at home and 1,953 visiting ones, however many texts have them. Visits are shuffled in rounds of ROUND words.
    """
    at = nodes.select("id", F.posexplode("fp").alias("slot", "word"))
    kinds = _save_lean(at.groupBy("slot", "word").agg(F.count("*").alias("n"), F.min("id").alias("hub")), "near-words")
    homes = kinds.select("slot", "word", word_home("word").alias("anchor"), "n", "hub", F.lit(1).alias("home"))
    visits = []
    for low in range(0, WORDS, ROUND):
        now = F.col("slot").between(low, low + ROUND - 1)
        known = homes.where(now).select("anchor").distinct().hint("shuffle_hash")
        visits.append(_save_lean(kinds.where(now).select("word").mapInPandas(_visits, "word long, anchor long").join(known, "anchor", "left_semi"), "near-visits"))
    guests = reduce(DataFrame.unionByName, visits).select("word", "anchor", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("hub"), F.lit(0).alias("home"))
    here = Window.partitionBy("anchor")
    groups = homes.drop("slot").unionByName(guests).withColumn("n", F.sum("n").over(here)).withColumn("hub", F.min("hub").over(here)).where("n > 1")
    groups = _save_lean(groups.select("word", F.col("anchor").alias("key"), "home", "n", "hub"), "near-shared")
    met = _save_lean(at.join(groups, "word").select("id", "key", "home", "n", "hub"), "near-met")
    forget(kinds, groups, *visits)
    return met


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(id, group) for the distinct texts of docs (doc_id, text) that have a near neighbour: linked texts share a group.

    id is `text_key`. Texts with words of their fingerprints that differ in at most one of 63 bits meet at anchors (`meeting`).
    Each is first compared with the smallest id at home there, which most anchors of a group of near copies have in common, so
    that few pairs are left. What these links connect needs no further comparison. Where an anchor's texts are still of several
    components, its pairs across components are compared inside tasks; where that would copy each text many times, as with a
    passage that many different texts share, those pairs alone that have a prefix key in common, as all near ones have. All
    comparisons are exact, and no near pair that meets goes uncompared unless links connect it already.
    """
    every = docs.select(text_key().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    prints = _with_shingles(every, shingle).select("id", F.pandas_udf(_sampled_batches, "array<long>")("shingles").alias("fp"))
    nodes = _save_lean(prints.dropDuplicates(["id"]), "near-nodes")
    met = meeting(nodes)
    forget(nodes)
    texts = every.join(met.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    shingles = _save_lean(_with_shingles(texts, shingle), "near-shingles")
    pairs = met.where(F.col("id") != F.col("hub")).select("id", "hub").distinct()
    both = pairs.join(shingles, "id").join(shingles.select(F.col("id").alias("hub"), F.col("shingles").alias("of_hub")), "hub")
    links = _save_lean(both.where(_similar(F.col("shingles"), F.col("of_hub"), similarity)).select(F.col("id").alias("a"), F.col("hub").alias("b")), "near-links")
    more = save(_across_components(met, links, shingles, similarity), "near-more")
    return components(links.unionByName(more)).select(F.col("node").alias("id"), F.col("root").alias("group"))


def text_key() -> Column:
    """64-bit key of the column `text`; a null text counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group of linked texts, the row with the smallest doc_id stays.

    Texts with the same words are linked too. Repeated rows leave one. A null doc_id stays only where its group has no
    other. All columns are kept, and an empty table stays empty.
    """
    groups = near_duplicates(docs.select("doc_id", "text"), similarity)
    keyed = docs.select("doc_id", text_key().alias("id"))
    found = keyed.join(groups, "id", "left").select("doc_id", "id", F.coalesce("group", "id").alias("group"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "id")
    stay = save(found.groupBy("group").agg(F.min(order).alias("k")).select("k.doc_id", "k.id"), "near-stay")
    left = docs.withColumn("__text_key", text_key())
    same = left["doc_id"].eqNullSafe(stay["doc_id"]) & (left["__text_key"] == stay["id"])
    return left.join(stay, same, "left_semi").dropDuplicates(["doc_id", "__text_key"]).drop("__text_key")
