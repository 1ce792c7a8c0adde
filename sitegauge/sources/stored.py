"""Stored Parquet tables in partitions, changed by rewriting the partitions that a change touches and no others.

A change is written beside the table first and then over its partitions.  If it breaks off before that copy is whole, nothing has
happened; if it breaks off later, the next change finishes it from the copy.  All changes are by key, so one that is made twice leaves
what it leaves once.  One writer works on a table at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions that one change may touch, at most: their names come to the driver.
MOST = 10_000


def _at(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def bucket(*key: str, n: int = 64) -> Column:
    """A partition for tables whose key has no other: the bucket of its hash."""
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def finish(spark: SparkSession, path: str, partition: str, compression: str = "zstd") -> None:
    """Finish a change that broke off: what was staged whole goes over its partitions, what was not is taken away."""
    staged = f"{path.rstrip('/')}.staged"
    if exists(spark, f"{staged}/_SUCCESS"):
        rows = spark.read.parquet(staged)
        if rows.columns:
            (
                rows.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression)
                .partitionBy(partition).parquet(path)
            )
    _delete(spark, staged)


def overwrite(rows: DataFrame, path: str, partition: str, compression: str = "zstd") -> None:
    """Put ``rows`` in the place of the partitions that they fall in; ``rows`` may be read from the table itself."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}.staged")
    finish(rows.sparkSession, path, partition, compression)


def _touched(rows: DataFrame, partition: str) -> list:
    found = [r[0] for r in rows.select(partition).distinct().limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise ValueError(f"the change touches more than {MOST} partitions")
    return found


def _among(partition: str, values: list) -> Column:
    some = F.col(partition).isin([v for v in values if v is not None])
    return some | F.col(partition).isNull() if None in values else some


def upsert(new: DataFrame, path: str, key: list[str], partition: str, keep: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
    """Put rows of ``new``, one for each key, in the place of those with their keys, or add them.

    The partition follows from the key (it is a part of it, or its ``bucket``), so a key stays where it is.  ``keep`` may make the
    rows out of the old and new ones of the touched partitions itself, for rows that are merged and not replaced.
    """
    spark = new.sparkSession
    finish(spark, path, partition)
    touched = _touched(new, partition)
    if not touched:
        return
    if not exists(spark, path):
        overwrite(new, path, partition)
        return
    old = spark.read.schema(new.schema).parquet(path).where(_among(partition, touched))
    if keep is None:
        keys = new.select(*(F.col(c).alias(f"_{c}") for c in key))
        same = F.lit(True)
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        rows = old.join(keys, same, "left_anti").unionByName(new)
    else:
        rows = keep(old, new)
    overwrite(rows, path, partition)


def update(spark: SparkSession, path: str, partition: str, change: Callable[[DataFrame], DataFrame], where: Column) -> None:
    """Change rows that a condition holds for; only partitions that have such rows are written (M8).  ``change`` takes rows of the
    touched partitions and gives all of them back, those changed for which ``where`` held."""
    finish(spark, path, partition)
    rows = spark.read.parquet(path)
    touched = _touched(rows.where(where), partition)
    if touched:
        overwrite(change(rows.where(_among(partition, touched))), path, partition)


def drop_partitions(spark: SparkSession, path: str, partition: str, values: list) -> None:
    """Take whole partitions away."""
    finish(spark, path, partition)
    for v in values:
        _delete(spark, f"{path.rstrip('/')}/{partition}={v if v is not None else '__HIVE_DEFAULT_PARTITION__'}")
