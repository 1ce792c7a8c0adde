"""The corpus pipeline (part of the subpackage llm): documents pass the stages one after another.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again before the next stage begins, so a
stage begins by deleting the scratch tables of the one before (of the same thread: a thread works on one pipeline at a time).  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import checked, clear_stage, cut, delete, shared_dir, stage
from sitegauge.llm.host_rules import keep_by_host_rules
from sitegauge.llm.importance import keep_resampled
from sitegauge.llm.minmax_dedup import near_duplicates
from sitegauge.llm.mixing import mix_sources
from sitegauge.llm.packing import pack

#: Standard errors of the estimated share of good documents that the classifier keeps beyond it, so that the estimate's error
#: doesn't cost clean documents.
ERRORS = 2.0


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or a rule for which their host is bad, go.  Null and empty texts fail; a null source is a host."""
    return keep_by_host_rules(docs)


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling doesn't draw go; the labels of the documents that are left set how many.  Null and empty
    texts score least; rows without id draw by their texts; without labels all stay."""
    return keep_resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), errors=ERRORS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (linked from a similarity of 0.8 on) stays.  Rows of one id are one document:
    all its texts stay or go, and of rows that agree in id and text the one that is least in its other columns stays.  Rows without
    id, and texts without words, are linked with nothing."""
    found = near_duplicates(docs, percent=80)
    gone = cut(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    stay = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    again = cut(docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select(F.col("doc_id").alias("_again")), "again")
    if not again.limit(1).count():
        return stay
    again = checked(again)
    single = stay.join(again, F.col("doc_id") == F.col("_again"), "left_anti")
    several = stay.join(again, F.col("doc_id") == F.col("_again"), "left_semi")
    least = several.groupBy("doc_id", F.col("text").isNull().alias("_null"), F.md5(F.coalesce("text", F.lit(""))).alias("_text")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return single.unionByName(least.select("_row.*"))


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat at random at the rate that brings their source to its target weight.  A null source is a source; a null text
    is of one byte."""
    return mix_sources(docs).select(*docs.columns)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.  Null and empty texts are the end id alone; a null source is a source."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Tokenizing, hashing and sampling can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from the shared folder; what the stages before wrote is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, apply in STAGES:
        out = apply(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        clear_stage(spark)
        if before:
            delete(spark, f"{base}/{before}")
        docs, before = spark.read.schema(out.schema).parquet(f"{base}/{name}"), name
    return docs
