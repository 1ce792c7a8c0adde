"""Places within groups that may be few and large, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, when: Column | None = None) -> DataFrame:
    """``rows`` with ``name``: the place (1, 2, ...) in the group by ascending ``order``; with ``when`` the number of rows up to this
    one for which it holds.

    Rows are dealt out by ranges of group and order, as many as there are shuffle partitions and of about equal counts, and
    written so; they are placed within their range, and ranges by their counts.  A group of any size, and of any values, is spread
    over ranges.
    """
    counted = F.coalesce(when.cast("int"), F.lit(0)) if when is not None else F.lit(1)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_counts", counted).repartitionByRange(n, *by, *order).withColumn("_block", F.spark_partition_id())
    dealt = cut(dealt, "ranges")  # so that all that follows sees the same ranges
    inside = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    sizes = dealt.groupBy(*by, "_block").agg(F.sum("_counts").alias("_n"))
    bases = sizes.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_block").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = F.col("_block") == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    placed = dealt.withColumn("_inside", F.sum("_counts").over(inside)).join(bases, same)
    return placed.withColumn(name, F.col("_base") + F.col("_inside")).select(*rows.columns, name)
