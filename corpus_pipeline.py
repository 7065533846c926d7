"""The corpus pipeline: toxicity, quality, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of docs, whatever these
are beside doc_id, text and source. Null texts count as empty, repeated rows as rows (until near-duplicates leave one of
them), and an empty table stays empty.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.llm import mixing, packing, quality, simhash, toxicity
from heatloom.llm.common import save, word_count


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not toxic (score below 0.5)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.toxicity_model(docs.select("doc_id", "text"), labels)
    return toxicity.toxicity_scores(docs, model, "__toxicity").where(F.col("__toxicity") < 0.5).drop("__toxicity")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is of good quality (score of 0.7 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = save(quality.with_statistics(docs, "__statistics"), "quality-statistics")
    model = quality.quality_model(rows, labels, statistics_name="__statistics")
    scored = quality.quality_scores(rows, model, "__statistics", "__quality")
    return scored.where(F.col("__quality") >= 0.7).drop("__statistics", "__quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in training order; a copy that the target cuts is kept if half of it is due."""
    columns = docs.columns
    slim = docs.select(F.struct(*columns).alias("__row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = mixing.mixed(slim).select("__row", "doc_id", "size", F.explode("copies").alias("copy"))
    rows = rows.where(F.col("copy.words") * 2 >= F.col("size"))
    rows = rows.repartitionByRange("copy.time", "doc_id").sortWithinPartitions("copy.time", "doc_id")
    return rows.select(*[F.col("__row")[c].alias(c) for c in columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, in the order of docs: that of its files' part numbers and rows, as the stage before wrote them.

    A DataFrame that is not read from files has no such order; it is packed by doc_id, with a warning.
    """
    try:
        part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
        ordered = docs.select("doc_id", "text", part.alias("__part"), F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__place"))
        ordered = ordered.withColumn("__part", F.when(F.col("__part") != "", F.col("__part")).cast("long"))
        order = ("__part", "__file", "__place")
    except AnalysisException:
        warnings.warn("pack_sequences: docs is not a table of files; its order is not known, so doc_id gives one", stacklevel=2)
        ordered, order = docs, ("doc_id",)
    return packing.pack(ordered, *packing.tokenizer_files(), order=order)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express none of the models; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
