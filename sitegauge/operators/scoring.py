"""Scores, status, and differences from run to run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import CATEGORIES, registry

# Limits of the total score for a lead's status, without a critical issue.
STATUS_LIMITS = [(-50, "very_bad"), (-20, "bad"), (-5, "middle"), (0, "quality_good")]


def category_scores(issues: DataFrame, key: str = "analysis_id", runs: DataFrame | None = None) -> DataFrame:
    """A column for each category (0 without issues), the total, and counts; ``runs`` adds those without any issue (R2)."""
    sums = issues.groupBy(key).pivot("category", CATEGORIES).agg(F.sum("weight"))
    counts = issues.groupBy(key).agg(F.sum("weight").alias("total_score"), F.count("*").alias("issue_count"), F.count_if(F.col("severity") == "critical").alias("critical_issue_count"))
    out = counts.join(sums, key)
    if runs is not None:
        out = runs.select(key).distinct().join(out, key, "left")
    return out.fillna(0)


def lead_status(total: Column, critical: Column) -> Column:
    """Status of a lead by its total score and whether an issue is critical."""
    out = F.lit("super")
    for limit, name in reversed(STATUS_LIMITS):
        out = F.when(total < limit, F.lit(name)).otherwise(out)
    return F.when(critical, F.when(total < -50, "very_bad").otherwise("bad")).otherwise(out)


def analysis_totals(results: DataFrame) -> DataFrame:
    """Results (analysis_id, category, status, score, issues[struct(code, evidence)]) to a row for each run: total of completed
    results, counts, and failed only if all failed (R3, R5)."""
    critical = [r.code for r in registry(results.sparkSession, severity="critical").collect()]
    done = F.col("status") == "completed"
    n = F.when(F.col("issues").isNull(), 0).otherwise(F.size("issues"))
    bad = F.size(F.filter(F.coalesce("issues", F.array().cast(results.schema["issues"].dataType)), lambda i: i["code"].isin(critical)))
    return results.groupBy("analysis_id").agg(
        F.coalesce(F.sum(F.when(done, F.col("score"))), F.lit(0)).alias("total_score"), F.coalesce(F.sum(n), F.lit(0)).alias("issue_count"), F.coalesce(F.sum(bad), F.lit(0)).alias("critical_issue_count"),
        F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.when(F.bool_and(F.col("status") == "failed"), "failed").otherwise("completed").alias("status"),
    )


def issue_codes(results: DataFrame) -> DataFrame:
    """Distinct codes of each run, by category order, then place in the category's list."""
    order = F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("category"))
    lists = F.array_sort(F.collect_list(F.struct(order.alias("o"), "category", F.transform("issues", lambda i: i["code"]).alias("codes"))))
    return results.where("issues is not null").groupBy("analysis_id").agg(F.array_distinct(F.flatten(F.transform(lists, lambda x: x["codes"]))).alias("codes"))


def sequence(runs: DataFrame, lead: str = "lead_id", at: str = "created_at", run: str = "analysis_id") -> DataFrame:
    """Runs with sequence number and the previous run of the lead; equal times go by the run's id."""
    w = Window.partitionBy(lead).orderBy(at, run)
    return runs.withColumn("sequence_number", F.row_number().over(w)).withColumn("previous_id", F.lag(run).over(w))


def deltas(runs: DataFrame, lead: str = "lead_id", at: str = "created_at", run: str = "analysis_id", score: str = "total_score", codes: str = "codes") -> DataFrame:
    """Runs with score_delta, is_improved, and codes added, removed and kept against the previous run; null on a first run.
    has_new_code says that a code was added, has_new_critical that a critical one was (R9)."""
    w = Window.partitionBy(lead).orderBy(at, run)
    critical = F.array(*(F.lit(r.code) for r in registry(runs.sparkSession, severity="critical").collect()))
    before = runs.withColumn("_s", F.lag(score).over(w)).withColumn("_c", F.lag(codes).over(w)).withColumn("sequence_number", F.row_number().over(w))
    out = before.withColumn("score_delta", F.col(score) - F.col("_s")).withColumn("is_improved", F.col("score_delta") > 0)
    first = F.col("sequence_number") == 1
    unless = lambda c: F.when(~first, c)
    now, then = F.col(codes), F.col("_c")
    out = out.withColumn("added", unless(F.array_except(now, then))).withColumn("removed", unless(F.array_except(then, now))).withColumn("unchanged_count", unless(F.size(F.array_intersect(now, then))))
    return out.withColumn("has_new_code", F.size("added") > 0).withColumn("has_new_critical", F.arrays_overlap("added", critical)).drop("_s", "_c")


def delta_stats(runs: DataFrame, since: dt.datetime, at: str = "created_at") -> DataFrame:
    """Improved, worsened and unchanged runs since a time; unchanged only counts runs with a previous one."""
    return runs.where(F.col(at) >= F.lit(since)).agg(F.count_if(F.col("score_delta") > 0).alias("improved"), F.count_if(F.col("score_delta") < 0).alias("worsened"), F.count_if(F.col("score_delta") == 0).alias("unchanged"))


def averages(rows: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """Average score and count by columns: category, status, industry, or all."""
    return rows.groupBy(*by).agg(F.avg(score).alias("avg_score"), F.count("*").alias("n"))


def history(runs: DataFrame, n: int, lead: str = "lead_id", at: str = "created_at", run: str = "analysis_id") -> DataFrame:
    """The newest n runs of each lead; n = 1 is the latest."""
    w = Window.partitionBy(lead).orderBy(F.desc(at), F.desc(run))
    return runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
