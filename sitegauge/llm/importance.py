"""Quality classification by importance resampling.

Two generative models of hashed n-grams are counted, one of target text (documents labelled good) and one of all text.  A
document's score is the log ratio of its probability under the two.  Resampling without replacement draws k documents by
Gumbel top-k: each score gets Gumbel noise that hashes from the id, and the k largest stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WordHashes, cut, mix, small_batches, utf8

#: Buckets of hashed n-grams; the models are tables of so many rows, whatever the corpus.
BUCKETS = 1 << 15
#: Labelled rows that the target model is fitted on, at most: those whose ids hash lowest.
TARGET_ROWS = 20_000
#: A count that every bucket has in advance, in each model.
PRIOR = 1.0
#: Score of a document without any n-gram: less than that of any text, since 2**32 n-grams of the least ratio, -45, are more.
NO_SCORE = -1e12

# letters and digits (all bytes beyond ASCII count as letters), or a run of other characters that are not blank
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")


def buckets(text: bytes | None, known: WordHashes, dims: int = BUCKETS) -> np.ndarray:
    """Buckets of a lower-cased text's unigrams and bigrams."""
    found = _TOKEN.findall((text or b"").lower())
    if not found:
        return np.empty(0, np.int64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate([h, pairs]) % np.uint64(dims)).astype(np.int64)


def gumbel(id_: int | None, seed: int, text: bytes | None = None) -> float:
    """Gumbel noise out of the id; a row without id draws by its text."""
    u = (xxhash.xxh64_intdigest(str(id_).encode() if id_ is not None else b"text " + (text or b""), seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", dims: int = BUCKETS, rows: int = TARGET_ROWS) -> np.ndarray:
    """Log ratios of the buckets: the target model's over the model of all ``docs``.  Counts of all text cover every document."""
    small_batches(docs.sparkSession)
    chosen = labels.where(good).select(F.col(id_col).cast("long").alias("_t")).where("_t is not null").distinct()
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("_t"), "_t").limit(rows))  # bounded by the parameter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = WordHashes(), np.zeros((2, dims), np.int64)
        for batch in batches:
            for text, target in zip(utf8(batch, "text"), batch.column(1).to_pylist(), strict=True):
                if len(b := buckets(text, known, dims)):
                    own = np.bincount(b, minlength=dims)
                    counts[0] += own
                    if target:
                        counts[1] += own
        full = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[0][full]), pa.array(counts[1][full])], ["bucket", "every", "target"])

    picked = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("_d")).join(chosen, F.col("_d") == F.col("_t"), "left")
    partial = picked.select("text", F.col("_t").isNotNull().alias("target")).mapInArrow(run, "bucket int, every long, target long")
    table = partial.groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("target").alias("target")).toPandas()  # a row for each bucket at most
    counts = np.zeros((2, dims))
    counts[0][table.bucket], counts[1][table.bucket] = table.every, table.target
    if not counts[1].sum():
        return np.zeros(dims)
    p = (counts + PRIOR) / (counts + PRIOR).sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def _scores(texts: list[bytes | None], ids: list[int | None], ratio: np.ndarray, known: WordHashes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores, and Gumbel keys as integers of the same order."""
    score = np.array([float(ratio[b].sum()) if len(b := buckets(t, known, len(ratio))) else NO_SCORE for t in texts], np.float64)
    bits = (score + np.array([gumbel(i, seed, t) for i, t in zip(ids, texts, strict=True)], np.float64)).view(np.int64)
    return score, np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def score(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """Table (doc_id, score, draw): draw orders like score plus Gumbel noise."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            s, draw = _scores(utf8(batch, "text"), batch.column(0).to_pylist(), ratio, known, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(draw)], ["doc_id", "score", "draw"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, draw long")


def kth_largest(scored: DataFrame, k: int) -> int:
    """The k-th largest ``draw`` of a written table, exactly, by four histograms of 16 bits each; ties stay together."""
    low, rest = None, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("draw", shift)
        part = scored if low is None else scored.where(F.shiftright("draw", shift + 16) == F.lit(low))
        for value, n in part.groupBy(digit.alias("digit")).count().orderBy(F.desc("digit")).collect():  # 65,536 rows at most
            low = value
            if rest <= n:
                break
            rest -= n
    return low if low is not None else 0


def good_share(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", good: str = "quality = 1", errors: float = 0.0) -> float:
    """The part of the labelled documents among ``docs`` that are labelled good, plus so many standard errors of that estimate; 1
    without labels."""
    ids = docs.select(F.col(id_col).cast("long").alias("_d")).distinct()
    found = labels.select(F.col(id_col).cast("long").alias("_d"), F.expr(good).alias("good")).join(ids, "_d", "left_semi")
    n, ok = found.agg(F.count("good"), F.sum(F.col("good").cast("long"))).head()
    return min(1.0, ok / n + errors * (ok / n * (1 - ok / n) / n) ** 0.5) if n else 1.0


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", share: float | None = None, seed: int = 11, errors: float = 0.0) -> DataFrame:
    """Score all documents and draw round(share * rows) of them (default: the share of good ones among labelled documents, plus
    ``errors`` standard errors of it, for those who would rather keep too many than too few).

    A row for each document: doc_id, score (log ratio), kept.  Null, empty and blank texts score NO_SCORE.  Ties at the last place
    are all kept.  Rows without id draw by their texts; repeated rows repeat.  Without good labels every score is 0; an empty
    table gives no rows.  Other columns are ignored.
    """
    scored = cut(score(docs, fit(docs, labels, id_col, text_col, good), id_col, text_col, seed), "scores")
    k = round((good_share(docs, labels, id_col, good, errors) if share is None else share) * scored.count())
    limit = kth_largest(scored, k)
    return scored.select("doc_id", "score", (F.lit(k > 0) & (F.col("draw") >= F.lit(limit))).alias("kept"))


def keep_resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", share: float | None = None, seed: int = 11, errors: float = 0.0) -> DataFrame:
    """The documents that ``resample`` keeps, with their own columns; they are written once with their draws, so that no text is
    scored twice or shuffled."""
    ratio = fit(docs, labels, id_col, text_col, good)
    own = [f"_own{i}" for i in range(len(docs.columns))]
    text, id_ = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            draw = _scores(utf8(batch, own[text]), batch.column(id_).to_pylist(), ratio, known, seed)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(draw)], [*own, "draw"])

    safe = docs.toDF(*own)
    scored = cut(safe.mapInArrow(run, StructType([*safe.schema, StructField("draw", LongType())])), "scored")
    k = round((good_share(docs, labels, id_col, good, errors) if share is None else share) * scored.count())
    limit = kth_largest(scored.select("draw"), k)
    return scored.where(F.lit(k > 0) & (F.col("draw") >= F.lit(limit))).select(*own).toDF(*docs.columns)
