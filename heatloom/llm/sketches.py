"""Bottom-k sketches of word shingles.

A sketch is the sorted array of the k smallest distinct 64-bit shingle hashes. Sketches merge by union, and two of them
estimate resemblance (Jaccard), containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import range_buckets, save, words

K = 64
SHINGLE = 5


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """df with the sketch of a text column.

    A text of fewer words than a shingle is one shingle of all its words; a null or blank text has an empty sketch. Repeated
    rows have equal sketches; a column `name` of df is replaced.
    """
    df = df.withColumn("__words", words(F.col(text)))
    df = df.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    at = lambda i, j: F.get(F.col("__hashes"), i + j)
    many = F.transform(F.sequence(F.lit(0), F.size("__hashes") - shingle), lambda i: F.xxhash64(*[at(i, j) for j in range(shingle)]))
    one = F.array(F.xxhash64(F.array_join("__words", " ")))
    none = F.array().cast("array<bigint>")
    hashes = F.when(F.size("__hashes") >= shingle, many).when(F.size("__hashes") > 0, one).otherwise(none)
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop("__words", "__hashes")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest hashes of the union that both have; 1 for two empty sketches. Exact below k shingles."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles: exact below k, else from the k-th smallest hash's place in the hash range."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    j = resemblance(a, b, k)
    x, y = distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (x + y) / x))


def sketch_text(a: Column) -> Column:
    """16 lowercase hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


#: Bytes of text in a bucket of neighbouring ids, about.
BUCKET_BYTES = 16 << 20


def with_next(docs: DataFrame, carried: list[str], sketch: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with next_<column> of the next row by doc_id (ties: by text hash); the last gets the first.

    With the name of a `sketch`, rows also get a column of that name, the sketch of their text, and that of the next row.
    Null ids come first; of repeated rows each has another as its next. Columns of docs named next_<column> are replaced;
    all others are kept, whatever their names. Rows go to buckets of neighbouring (id, hash), and each bucket also gets the
    first row of the next one, so that one window over buckets is enough and no task orders the whole table.
    """
    replaced = [f"next_{c}" for c in carried] + ([sketch, f"next_{sketch}"] if sketch else [])
    row = F.struct(*[F.col(c) for c in docs.columns if c not in replaced]).alias("row")
    keyed = docs.select(row, F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes"))
    size = keyed.agg(F.sum("bytes")).first()[0] or 0
    keyed = range_buckets(keyed.drop("bytes"), "key", "hash", -(-size // BUCKET_BYTES))
    firsts = save(keyed.groupBy("bucket").agg(F.min(F.struct("key", "hash")).alias("first")), "sketch-heads")
    back = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))  # BOUNDS rows at most
    firsts = firsts.select("bucket", "first.key", "first.hash", back.alias("back"))
    guests = keyed.join(firsts, ["bucket", "key", "hash"]).dropDuplicates(["bucket"])
    guests = guests.select("row", "key", "hash", F.col("back").alias("bucket"), F.lit(1).alias("guest"))
    rows = keyed.select("row", "key", "hash", "bucket", F.lit(0).alias("guest")).unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("guest", "key", "hash")
    own = []
    if sketch:  # once for each row: what came before needed ids only
        rows, own = with_sketch(rows, "row.text", "sketch"), [F.col("sketch").alias(sketch), F.lead("sketch").over(order).alias(f"next_{sketch}")]
    rows = rows.select("row", "guest", *[F.lead(f"row.{c}").over(order).alias(f"next_{c}") for c in carried], *own)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in replaced]
    return rows.where(F.col("guest") == 0).select(*kept, *replaced)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text (last quarter from the next document), with their likeness.

    A null text counts as empty; a single document is its own next; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, ["text"], "sketch")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut)))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        sketch_text(F.col("sketch")).alias("fingerprint"),
        sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
