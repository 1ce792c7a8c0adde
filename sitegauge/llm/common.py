"""Shared helpers: scratch tables, Arrow batch sizes, words and hashes.

A word is a run of characters other than space and U+0009..U+000D.  Lower-casing concerns A-Z only.
Both are what ``bytes.split()`` and ``bytes.lower()`` do on UTF-8, so tasks work on the bytes of Arrow
columns without decoding them.
"""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits a text into words; pieces that are empty are no words.
BLANKS = r"[\x20\x09-\x0D]+"
#: Longest table that is broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 20_000
#: Tables that the stage of a thread has written; a thread works on one pipeline at a time.
_thread = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local session without one gets a temporary folder."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    if getattr(_thread, "in_stage", False):
        _thread.tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_stage(spark: SparkSession) -> None:
    """Delete the tables that this thread's last stage wrote by ``cut``; its result must be written by then."""
    for path in getattr(_thread, "tables", []):
        delete(spark, path)
    _thread.tables = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage of a pipeline that writes each stage's result before it begins the next: the tables that ``cut`` wrote for the
    stage before, in the same thread, are deleted when this one begins."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear_stage(spark)
        _thread.in_stage = True
        try:
            return f(spark, docs, sf_dir)
        finally:
            _thread.in_stage = False

    return run


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of one Arrow batch, as documents may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it is short enough by count; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_: Column, mod: int, rest: int = 2) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``rest``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def words(text: Column) -> Column:
    """The array of words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), lambda x: x != "")


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, known: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a lower-cased text; a shorter text is one shingle, one without words has none."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for j in range(min(size, len(h))):
        out += mix(h[j : j + n] + _ODD[j % 5] * np.uint64(j // 5 + 1)) * _ODD[(j + 1) % 5]
    return np.unique(mix(out))
