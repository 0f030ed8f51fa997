"""The corpus pipeline: quality, near-dedup, decontamination, mixing, sharding, each over what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import quality_cnn
from lexiloom.llm.common import Scratch, bound_batches
from lexiloom.llm.decontam import drop_contaminated
from lexiloom.llm.mixing import mix_sources
from lexiloom.llm.near_dup import drop_near_duplicates
from lexiloom.llm.sharding import shard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on the labelled ones of these, scores below its threshold.

    Missing and empty texts get a score like any other. Repeated rows are judged alike, and each stays or goes; a missing
    doc_id has no label but is judged.
    """
    bound_batches(spark)
    model = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_cnn.scores(F.col("text"), model) >= quality_cnn.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id in each group of near copies (five-word shingles, similarity 0.8).

    Texts without words are no copies of each other and stay, and so do rows without doc_id. Rows that repeat each other,
    id and text, stay or go together; a group's least doc_id may stand for several such rows.
    """
    return drop_near_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, whole or nearly. Missing and empty texts hold none; each row is judged for itself."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw sources to their target weights; a document that is taken several times comes as several rows.

    Rows without source are a source of their own, the last one. Texts without words have no size: they are drawn by
    their keys and count for nothing. Ties in keys go by doc_id, then size, then row, so as many of rows that repeat each
    other are taken as are needed.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    inner = docs.withColumnsRenamed({c: f"_other_{i}" for i, c in enumerate(others)})  # so that no name clashes
    mixed = mix_sources(inner).where("times > 0")
    rows = mixed.select(*inner.columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_time")).drop("_time")
    return rows.withColumnsRenamed({f"_other_{i}": c for i, c in enumerate(others)}).select(*[f"`{c}`" for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every row into one of eight shards of near equal size; all other columns come along, but those named as results.

    Equal texts share a shard, missing ones form a group of their own. Within a shard rows stand by their text's digest
    and then doc_id, missing ones first; rows that repeat each other get neighbouring slots.
    """
    own = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    return shard(docs, shards=8, carry=tuple(c for c in docs.columns if c not in own))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixture", mixture), ("sharding", sharding)]

#: The classifier's fitted scores are not expressible in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's result is written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
