"""Benchmarks of industries: averages, percentiles, top issues, ranks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles

SAMPLE, TOP = 1000, 20
POINTS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def sample(runs: DataFrame, most: int | None = SAMPLE, by: str = "industry", at: str = "completed_at", run: str = "analysis_id") -> DataFrame:
    """The newest completed runs of each industry, at most ``most``; None takes all (B1)."""
    if most is None:
        return runs
    w = Window.partitionBy(by).orderBy(F.desc(at), F.desc(run))
    return runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def statistics(runs: DataFrame, by: str = "industry", score: str = "total_score", whole: bool = False) -> DataFrame:
    """Averages, exact median and percentiles (linear between ranks), sample size.

    A sample's scores are few, and sorted in one buffer for each industry.  With ``whole`` (all runs of all time) the
    percentiles are found in rounds of counting instead, with the same results.
    """
    counted = [F.avg(c).alias(f"avg_{c}") for c in ("issue_count", "critical_issue_count") if c in runs.columns]
    means = [F.avg(score).alias("avg_score"), F.count("*").alias("sample_size"), *counted]
    if whole:
        q = quantiles(runs, by, score, [*POINTS.values(), 0.5]).select(F.col(by).alias("_of"), F.slice("q", 1, len(POINTS)).alias("_p"), F.element_at("q", -1).alias("median_score"))
        out = runs.groupBy(by).agg(*means)
        out = out.join(q, F.col(by).eqNullSafe(F.col("_of")), "left").drop("_of")
    else:
        points = F.percentile(F.col(score).cast("double"), F.array(*(F.lit(p) for p in POINTS.values())))
        out = runs.groupBy(by).agg(*means, F.median(score).alias("median_score"), points.alias("_p"))
    columns = [by, "avg_score", "median_score", "_p", "sample_size", *(c for c in out.columns if c.startswith("avg_") and c != "avg_score")]
    return out.select(*columns, F.struct(*(F.round(F.col("_p")[i], 4).alias(n) for i, n in enumerate(POINTS))).alias("percentiles")).drop("_p")


def category_averages(runs: DataFrame, by: str = "industry", scores: str = "category_scores") -> DataFrame:
    """Map of category to the average over the runs that have it, two digits."""
    flat = runs.select(by, F.explode(scores).alias("category", "score"))
    means = flat.groupBy(by, "category").agg(F.round(F.avg("score"), 2).alias("mean"))
    return means.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "mean")))).alias("avg_category_scores"))


def top_issues(runs: DataFrame, by: str = "industry", codes: str = "codes", most: int = TOP) -> DataFrame:
    """The most frequent codes by runs that have them, with their percentage (one digit); ties by code."""
    sizes = runs.groupBy(by).agg(F.count("*").alias("sample_size"))
    counted = runs.select(by, F.explode(F.array_distinct(codes)).alias("code")).groupBy(by, "code").agg(F.count("*").alias("n")).join(sizes, by)
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "code"))).where(F.col("rank") <= most)
    return ranked.select(by, "rank", "code", "n", F.round(F.col("n") / F.col("sample_size") * 100, 1).alias("percentage"))


def calculate(runs: DataFrame, period: dt.date, by: str = "industry", most: int | None = SAMPLE) -> DataFrame:
    """Benchmarks of all industries for the period that begins on a day; runs need codes and category_scores."""
    chosen = sample(runs, most, by)
    top = top_issues(chosen, by).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "n", "percentage"))), lambda x: F.struct(x["code"].alias("code"), x["n"].alias("count"), x["percentage"].alias("percentage"))).alias("top_issues"))
    out = statistics(chosen, by, whole=most is None).join(top, by, "left").join(category_averages(chosen, by), by, "left")
    return out.withColumn("period_start", F.lit(period))


def upsert(stored: DataFrame, new: DataFrame, by: str = "industry") -> DataFrame:
    """What becomes of each benchmark: created, updated (the new in the old's place) or kept."""
    key = [by, "period_start"]
    old = stored.select(*key).withColumn("_old", F.lit(True))
    fresh = new.join(old, key, "left").withColumn("outcome", F.when(F.col("_old"), "updated").otherwise("created")).drop("_old")
    return fresh.unionByName(stored.join(new.select(*key), key, "left_anti").withColumn("outcome", F.lit("kept")), allowMissingColumns=True)


def rank(score: Column, points: Column) -> Column:
    """Label by percentiles."""
    labels = F.when(score >= points["p90"], "top10").when(score >= points["p75"], "top25").when(score >= points["p50"], "above_average").when(score >= points["p25"], "below_average").otherwise("bottom25")
    return F.when(points.isNull() | score.isNull(), "unknown").otherwise(labels)


def percentile_estimate(score: Column, points: Column) -> Column:
    """Percentile by straight lines between the points; gaps count as 1 at least."""
    part = lambda low, high, start, width: start + (score - points[low]) / F.greatest(F.lit(1.0), points[high] - points[low]) * width
    top = F.least(90 + (score - points["p90"]) / F.greatest(F.lit(1.0), 100 - points["p90"]) * 10, F.lit(100.0))
    low = score / F.greatest(F.lit(1.0), points["p10"]) * 10
    return (
        F.when(score >= points["p90"], top).when(score >= points["p75"], part("p75", "p90", 75, 15)).when(score >= points["p50"], part("p50", "p75", 50, 25))
        .when(score >= points["p25"], part("p25", "p50", 25, 25)).when(score >= points["p10"], part("p10", "p25", 10, 15)).otherwise(low)
    )


def latest(benchmarks: DataFrame, by: str = "industry", n: int = 1) -> DataFrame:
    """The newest n benchmarks of each industry."""
    w = Window.partitionBy(by).orderBy(F.desc("period_start"))
    return benchmarks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def all_industries(industries: DataFrame, benchmarks: DataFrame, by: str = "industry") -> DataFrame:
    """Every industry with its newest benchmark, or null."""
    return industries.join(latest(benchmarks, by), by, "left")


def numbered_values(values: DataFrame, by: str, score: str) -> DataFrame:
    """exact_percent_rank of each score of an industry (_by, _of) out of how often it occurs (_n): only distinct scores are sorted."""
    below = Window.partitionBy(by).orderBy(F.col(score).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    every = F.sum("_n").over(Window.partitionBy(by))
    place = F.coalesce(F.sum("_n").over(below), F.lit(0)) / F.greatest(every - 1, F.lit(1))
    return values.select(F.col(by).alias("_by"), F.col(score).alias("_of"), place.alias("exact_percent_rank"))


def compare(runs: DataFrame, benchmarks: DataFrame, by: str = "industry", score: str = "total_score", exact: bool = False) -> DataFrame:
    """Runs against the newest benchmark of their industry: rank, percentile, differences (B10), and with ``exact`` the percent_rank
    among the runs."""
    b = latest(benchmarks, by).select(by, F.col("avg_score").alias("_avg"), F.col("percentiles").alias("_p"), *([F.col("avg_issue_count").alias("_issues")] if "avg_issue_count" in benchmarks.columns else []))
    joined = runs.join(b, by, "left")
    s = F.col(score)
    label = F.when(F.col(by).isNull(), "unknown").when(F.col("_avg").isNull(), "no_benchmark").otherwise(rank(s, F.col("_p")))
    joined = joined.withColumn("ranking", label).withColumn("percentile", F.when(F.col("_avg").isNotNull(), F.round(percentile_estimate(s, F.col("_p")), 1))).withColumn("diff_from_avg", s - F.col("_avg"))
    if exact:
        values = joined.groupBy(by, score).agg(F.count("*").alias("_n"))
        ranks = numbered_values(values, by, score)
        joined = joined.join(ranks, F.col(by).eqNullSafe(F.col("_by")) & F.col(score).eqNullSafe(F.col("_of"))).drop("_by", "_of")
    if "avg_issue_count" in benchmarks.columns and "issue_count" in runs.columns:
        joined = joined.withColumn("issues_vs_avg", F.col("issue_count") - F.col("_issues")).drop("_issues")
    return joined.drop("_avg", "_p", "_issues")
