"""Tiers of retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stored
from .competitors import keep_latest
from .snapshots import period_start

# Ages in days from which a run's results are compressed, emptied, deleted; and those of other tables.
TIERS = [(365, "delete"), (90, "clear"), (30, "compress")]
MAIL_DAYS, SIGNAL_DAYS, COMPETITOR_ROWS = 365, 90, 10


def tier(at: Column, as_of: dt.datetime) -> Column:
    """keep, compress, clear or delete by age in days; a lower bound belongs to its tier (K1)."""
    age = F.date_diff(F.lit(as_of).cast("timestamp_ntz"), at)
    out = F.lit("keep")
    for days, name in reversed(TIERS):
        out = F.when(age >= days, F.lit(name)).otherwise(out)
    return out


def apply_tiers(results: DataFrame, as_of: dt.datetime, at: str = "created_at", payload: str = "raw_data") -> DataFrame:
    """Results with their tier, deleted ones left out and cleared ones without payload; compression is the writer's (zstd) (K1)."""
    rows = results.withColumn("tier", tier(F.col(at), as_of)).where("tier <> 'delete'")
    return rows.withColumn(payload, F.when(F.col("tier") != "clear", F.col(payload)))


def store_results(results: DataFrame, path: str, key: list[str], at: str = "created_at") -> None:
    """Add results, one for each key, to the table at ``path``, in partitions of the day they are from, in tier keep."""
    stored.upsert(results.withColumns({"tier": F.lit("keep"), "day": F.to_date(at)}), path, [*key, "day"], "day")


def archive(spark: SparkSession, path: str, as_of: dt.datetime, payload: str = "raw_data") -> DataFrame:
    """Bring a table of ``store_results`` to the tiers of a day (K1), and return the days that changed: day, tier, was.

    A day's results are of one age, so a day has one tier.  Only days whose tier is another by now are written: from compress on with
    zstd, from clear on without payload; days to delete go.  A run that broke off is finished by the next; a second run of a day finds
    nothing to do.
    """
    stored.finish(spark, path, "day")
    rows = spark.read.parquet(path)
    now = F.coalesce(tier(F.col("day"), as_of), F.lit("keep"))
    moved = [(r.day, r.tier, r.was) for r in rows.select("day", F.col("tier").alias("was"), now.alias("tier")).where("tier <> was").distinct().collect()]  # days
    kept = [d for d, t, _ in moved if t != "delete"]
    if kept:
        some = rows.where(F.col("day").isin(kept)).withColumn("tier", now)
        stored.overwrite(some.withColumn(payload, F.when(F.col("tier") != "clear", F.col(payload))), path, "day")
    stored.drop_partitions(spark, path, "day", [d for d, t, _ in moved if t == "delete"])
    return spark.createDataFrame(sorted(moved), "day date, tier string, was string")


def tier_counts(results: DataFrame, as_of: dt.datetime, at: str = "created_at") -> DataFrame:
    """Results by tier, as a dry run (K2)."""
    return results.groupBy(tier(F.col(at), as_of).alias("tier")).agg(F.count("*").alias("n"))


def old_snapshots(snaps: DataFrame, as_of: dt.datetime, periods: int) -> DataFrame:
    """Snapshots that are more than so many periods old (K3)."""
    now = period_start(F.lit(as_of).cast("timestamp_ntz"), F.col("period_type"))
    p = F.col("period_type")
    limit = F.when(p == "day", F.date_sub(now, periods)).when(p == "month", F.add_months(now, -periods)).otherwise(F.date_sub(now, 7 * periods))
    return snaps.where(F.col("period_start") < limit)


def cleanup_counts(logs: DataFrame, signals: DataFrame, snaps: DataFrame, as_of: dt.datetime) -> DataFrame:
    """What a cleanup removes from each target: old mail logs, long expired signals, competitor rows beyond the newest (K4)."""
    mails = logs.where(F.col("created_at") < F.lit(as_of - dt.timedelta(days=MAIL_DAYS))).agg(F.lit("email_logs").alias("target"), F.count("*").alias("n"))
    late = signals.where((F.col("status") == "expired") & (F.col("deadline") < F.lit(as_of - dt.timedelta(days=SIGNAL_DAYS)))).agg(F.lit("demand_signals").alias("target"), F.count("*").alias("n"))
    kept = keep_latest(snaps, COMPETITOR_ROWS).agg((-F.count("*")).alias("n"))
    beyond = snaps.agg(F.count("*").alias("n")).unionByName(kept).agg(F.lit("competitor_snapshots").alias("target"), F.sum("n").alias("n"))
    return mails.unionByName(late).unionByName(beyond)


