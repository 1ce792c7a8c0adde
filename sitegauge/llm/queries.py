"""The queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import fingerprints
from .host_rules import RULES, apply_host_rules, rules_sql
from .importance import resample
from .language_id import identify
from .lattice_lm import score
from .minmax_dedup import near_duplicates
from .mixing import MIX_SQL, mix_sources
from .packing import pack
from .periodic_runs import digest, periodic_runs, planted
from .sharding import shard
from .simhash_dedup import near_duplicates as simhash_duplicates
from .spelling_variants import TYPOS, spelling_variants
from .token_counts import length_histogram


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir), percent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(_docs(spark, sf_dir))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _host_rules(_docs(spark, sf_dir))


#: Hosts of the query host_verdicts, as both engines read it: a language's short texts, those with many symbols, and the others.
_HOST = "concat(coalesce(lang, ''), '-', CASE WHEN length(text) < 60 THEN 'short' WHEN 100 * (length(text) - length(translate(text, '#*$%&|<>', ''))) > length(text) THEN 'symbols' ELSE 'plain' END)"


def _host_rules(docs: DataFrame) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_documents"]
    return apply_host_rules(docs).select(*columns, *(F.round(f"{r}_rate", 9).alias(f"{r}_rate") for r in RULES))


def host_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's rules over hosts that do fail, so that their documents go."""
    return _host_rules(_docs(spark, sf_dir).withColumn("source", F.expr(_HOST)))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_docs(spark, sf_dir))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_docs(spark, sf_dir))  # whole documents are shuffled; their texts are digested behind it
    return mixed.select("doc_id", "source", "copy", "copies", F.round("rate", 9).alias("rate"), "shuffle_key", F.md5("text").alias("text_md5"))


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_docs(spark, sf_dir))


def op9_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_docs(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_docs(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_docs(spark, sf_dir), typos=TYPOS)


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(_docs(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return digest(periodic_runs(docs.select("doc_id", planted(docs["doc_id"], docs["text"]).alias("text"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minmax_dedup": op1_minmax_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_host_rules": op3_host_rules,
        "host_verdicts": host_verdicts,
        "op4_mixture_packing": op4_mixture_packing,
        "op5_fingerprints": op5_fingerprints,
        "op6_importance_resampling": op6_importance_resampling,
        "op7_poisson_mixing": op7_poisson_mixing,
        "op8_lattice_lm": op8_lattice_lm,
        "op9_label_sharding": op9_label_sharding,
        "op10_language_id": op10_language_id,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_simhash_dedup": op12_simhash_dedup,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_host_rules": rules_sql(), "host_verdicts": rules_sql(f"(SELECT * REPLACE ({_HOST} AS source) FROM documents)"), "op7_poisson_mixing": MIX_SQL}
