"""Exact quantiles of groups of any size, by selection in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

#: Buckets of a range in one round.
BUCKETS = 1024
#: Ranges that are broadcast, at most; more are joined by their group.
BROADCAST = 20_000


def quantiles(rows: DataFrame, by: str, value: str, points: list[float]) -> DataFrame:
    """Table (by, n, q): the number of a group's values that aren't null or NaN, and their quantiles at ``points``, each linear between
    its two ranks.  Groups without values have no row; a null group is one.

    A rank lies in a range of values.  Each round counts the values of every such range in buckets of equal width, and the
    bucket that holds the rank, cut to its least and greatest value, is the range of the next, until these agree.  So a round moves
    counts of buckets alone, and no task holds a group.
    """
    given = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    sizes = given.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.transform(F.array(*(F.lit(p) for p in points)), lambda p: p * (F.col("n") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(place, lambda x: F.array(F.floor(x), F.ceil(x)))))
    sizes = cut(sizes, "sizes")
    # rank (from 0), and how many values are below its range
    found = cut(sizes.select("g", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi"), "ranks")
    while True:
        open_ = found.where("lo < hi")
        ranges = cut(open_.select("g", "lo", "hi", "below").distinct(), "ranges")
        n = ranges.limit(BROADCAST + 1).count()
        if not n:
            break
        named = ranges.select(F.col("g").alias("_g"), "lo", "hi", "below")
        inside = given.join(F.broadcast(named) if n <= BROADCAST else named, F.col("g").eqNullSafe(F.col("_g")) & F.col("v").between(F.col("lo"), F.col("hi")))
        # halves first, as the width of a range may be greater than any number
        width = F.col("hi") / 2 - F.col("lo") / 2
        bucket = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * BUCKETS), F.lit(BUCKETS - 1))
        counted = inside.groupBy("g", "lo", "hi", "below", bucket.alias("b")).agg(F.count("*").alias("k"), F.min("v").alias("v0"), F.max("v").alias("v1"))
        before = Window.partitionBy("g", "lo", "hi", "below").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows
        counted = counted.withColumn("start", F.col("below") + F.coalesce(F.sum("k").over(before), F.lit(0)))
        counted = counted.select(F.col("g").alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "start", "k", "v0", "v1")
        same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
        step = open_.join(counted, same).where("rank >= start AND rank < start + k")
        step = step.select("g", "rank", F.col("start").alias("below"), F.col("v0").alias("lo"), F.col("v1").alias("hi"))
        found = cut(found.where("lo = hi").unionByName(step), "ranks")
    values = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))  # two entries a point
    values = values.select(F.col("g").alias("_g"), "at")
    out = sizes.join(values, F.col("g").eqNullSafe(F.col("_g")))

    def between(x: Column) -> Column:
        low, high = F.floor(x), F.ceil(x)
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(low == high, a).otherwise((high - x) * a + (x - low) * b)

    return out.select(F.col("g").alias(by), "n", F.transform(place, between).alias("q"))
