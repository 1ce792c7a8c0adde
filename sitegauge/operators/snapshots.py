"""Snapshots by period, and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Periods by industry, and how many periods a trend shows.
PERIOD_BY_INDUSTRY = {"eshop": "day", "webdesign": "week", "real_estate": "week", "automobile": "week", "restaurant": "week", "medical": "month", "legal": "month", "finance": "week", "education": "month", "other": "week"}
TREND_PERIODS = {"day": 12, "week": 52, "month": 12}


def period_start(at: Column, period: Column | str) -> Column:
    """The day, the week's Monday or the month's first."""
    p = F.lit(period) if isinstance(period, str) else period
    return F.when(p == "day", F.date_trunc("DAY", at)).when(p == "month", F.date_trunc("MONTH", at)).otherwise(F.date_trunc("WEEK", at)).cast("date")


def effective_period(own: Column, industry: Column) -> Column:
    """The lead's own period, else its industry's, else week."""
    default = F.lit("week")
    for name, period in PERIOD_BY_INDUSTRY.items():
        default = F.when(industry == name, F.lit(period)).otherwise(default)
    return F.coalesce(own, default)


def previous_start(start: Column, period: Column) -> Column:
    return F.when(period == "day", F.date_sub(start, 1)).when(period == "month", F.add_months(start, -1)).otherwise(F.date_sub(start, 7))


def snapshots(runs: DataFrame, leads: DataFrame, at: str = "completed_at", run: str = "analysis_id") -> DataFrame:
    """One row for each lead and period: its last run, with five codes and the run's industry, else the lead's."""
    own = leads.select("lead_id", F.col("industry").alias("_industry"), F.col("snapshot_period").alias("_own"))
    rows = runs.join(own, "lead_id", "left").withColumn("industry", F.coalesce("industry", "_industry"))
    rows = rows.withColumn("period_type", effective_period(F.col("_own"), F.col("industry"))).withColumn("period_start", period_start(F.col(at), F.col("period_type")))
    w = Window.partitionBy("lead_id", "period_type", "period_start").orderBy(F.desc(at), F.desc(run))
    last = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return last.select("lead_id", run, "period_type", "period_start", "total_score", "issue_count", "critical_issue_count", F.slice("codes", 1, 5).alias("top_issues"), "industry")


def upsert(stored: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Stored rows with those of the new table in their place where the key is the same."""
    return stored.join(new, list(key), "left_anti").unionByName(new)


def with_delta(snaps: DataFrame) -> DataFrame:
    """Score difference to the period right before; null where that one has no snapshot (T4)."""
    before = snaps.select("lead_id", "period_type", F.col("period_start").alias("_start"), F.col("total_score").alias("_score"))
    keyed = snaps.withColumn("_start", previous_start(F.col("period_start"), F.col("period_type")))
    return keyed.join(before, ["lead_id", "period_type", "_start"], "left").withColumn("score_delta", F.col("total_score") - F.col("_score")).drop("_start", "_score")


def lead_trend(snaps: DataFrame, periods: int | None = None) -> DataFrame:
    """The last periods of each lead, by default as many as its period type shows (T5)."""
    most = F.lit(periods)
    if periods is None:
        for p, n in TREND_PERIODS.items():
            most = F.when(F.col("period_type") == p, F.lit(n)).otherwise(most)
    w = Window.partitionBy("lead_id", "period_type").orderBy(F.desc("period_start"))
    return snaps.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def industry_trend(snaps: DataFrame) -> DataFrame:
    """Average score and count by industry and period."""
    return snaps.groupBy("industry", "period_type", "period_start").agg(F.avg("total_score").alias("avg_score"), F.count("*").alias("n"))


def snapshot_stats(snaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by period type, and counts and averages by industry."""
    return snaps.groupBy("period_type").agg(F.count("*").alias("n")), snaps.groupBy("industry").agg(F.count("*").alias("n"), F.avg("total_score").alias("avg_score"))


def latest(snaps: DataFrame) -> DataFrame:
    """The newest snapshot of each lead and period type."""
    w = Window.partitionBy("lead_id", "period_type").orderBy(F.desc("period_start"))
    return snaps.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def of_period(snaps: DataFrame, industry: str, period: str, start: str) -> DataFrame:
    """Snapshots of an industry in one period."""
    return snaps.where((F.col("industry") == industry) & (F.col("period_type") == period) & (F.col("period_start") == F.lit(start).cast("date")))
