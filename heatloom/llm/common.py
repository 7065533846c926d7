"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatloom.tables import forget, new_folder, save, shared_dir

__all__ = ["forget", "new_folder", "save", "shared_dir", "small_table", "table", "term_slices", "words", "word_count", "range_buckets"]

#: White space that separates words.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the maximal runs without SPACES; empty for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


#: Bytes of a term as they are, capitals in lower case, a space for every other byte.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_slices(text: bytes | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in order, in lists of about `size` bytes of text: maximal runs of ASCII digits and letters and
    of characters beyond ASCII, only A-Z in lower case. A list ends between terms; null has none."""
    plain, at = (text or b"").translate(_TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, T._parse_datatype_string(schema))


#: Bounds of buckets that pass the driver, at most.
BOUNDS = 1 << 16


def range_buckets(df: DataFrame, key: str, tie: str, parts: int) -> DataFrame:
    """df with `bucket` (long), which never falls as (key, tie) rises, in about `parts` buckets (BOUNDS at most) of like counts.

    key and tie are longs that are not null; tie is a hash. The bounds are approximate quantiles of key, so a few far values
    don't matter, and a key that takes up several of them is split by tie.
    """
    parts = max(1, min(parts, BOUNDS))
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, shares, 20 * parts)).first()[0] if shares else None
    if not found:
        return df.withColumn("bucket", F.lit(0).cast("long"))
    bounds = F.array(*[F.lit(x) for x in found]) if len(found) < 100 else F.from_json(F.lit(str(found)), "array<bigint>")
    steps = [1 << i for i in reversed(range(len(found).bit_length()))]

    def passed(test) -> Column:
        """How many of the sorted bounds pass, by halving."""
        at = lambda n, step: F.when((n + step <= len(found)) & test(F.get(bounds, n + step - 1)), n + step).otherwise(n)
        return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), at)

    below, upto = passed(lambda b: b < F.col(key)), passed(lambda b: b <= F.col(key))
    share = (F.col(tie).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return df.withColumn("bucket", (below + F.least(F.floor(share * (upto - below + 1)), upto - below)).cast("long"))
