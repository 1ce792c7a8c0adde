"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the bytes over its share in the corpus: the mean times one of its documents is to be
repeated.  A hash of the document's id is the uniform number that inverts the Poisson distribution of that mean, so the count
needs no state and stays the same in a task that runs again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, cut

#: Target weights without a mapping: the sources' sizes to this power.
TEMPERATURE = 0.7


def uniform(*key: Column | str) -> Column:
    """A number from 0 (inclusive) to 1 (exclusive) out of the md5 of the joined key, in steps of 2**-52."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, text_col: str = "text", source_col: str = "source", targets: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """Table (source, rate, first, cdf): cdf[i] is the probability of first + i repetitions at most, up to where it is 1 in doubles."""
    sized = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("double").alias("bytes"))
    sized = cut(sized, "sources")
    weight = F.pow("bytes", F.lit(temperature))
    if targets is not None:
        weight = F.lit(0.0)
        for s, w in targets.items():
            weight = F.when(F.col("source") == s, F.lit(float(w))).otherwise(weight)
    weighed = sized.withColumn("weight", weight)
    all_bytes, all_weight = weighed.agg(F.sum("bytes"), F.sum("weight")).head()
    rated = weighed.withColumn("rate", F.col("weight") / F.lit(all_weight or 1.0) * F.lit(all_bytes or 0.0) / F.col("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [poisson_cdf(r) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f for f, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.float64()))], ["source", "rate", "first", "cdf"])

    return rated.select("source", "rate").mapInArrow(run, "source string, rate double, first long, cdf array<double>")  # a row for each source


def poisson_cdf(rate: float) -> tuple[int, np.ndarray]:
    """(first, cdf): cdf[i] is the probability of first + i repetitions at most, in doubles.  Twelve standard deviations and 30 about
    the mean are all that doubles tell apart, so the table grows as the square root of the rate."""
    if rate <= 0:
        return 0, np.ones(1)
    width = 12 * math.sqrt(rate) + 30
    first, last = max(0, math.floor(rate - width)), math.ceil(rate + width)
    return first, np.cumsum([math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(first, last + 1)])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """Repeat each document as often as its hash says under its source's rate, and order the copies globally by another hash.

    Returns the columns ``keep`` (default: all) and, where no such column is there, copy (0, 1, ...), copies, rate, shuffle_key.
    ``targets``: weights by source (not named: 0); else sizes to the power ``temperature``.  A null source is a source; null texts
    are of one byte, like empty ones; null ids hash as an empty string; repeated rows get equal counts.  Rows of count 0 go: that
    is the method, not a cap.  An empty table gives no rows.
    """
    table = cut(rates(docs, text_col, source_col, targets, temperature), "rates").toDF("_mix_source", "_mix_rate", "_mix_first", "_mix_cdf")
    keep = docs.columns if keep is None else keep
    u = uniform(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    drawn = docs.withColumn("_mix_u", u).join(checked(table), F.col(source_col).eqNullSafe(F.col("_mix_source")))
    drawn = drawn.withColumn("_mix_copies", (F.col("_mix_first") + F.size(F.filter("_mix_cdf", lambda c: c <= F.col("_mix_u")))).cast("int")).where("_mix_copies > 0")
    drawn = drawn.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1)))
    drawn = drawn.withColumn("_mix_key", F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("_mix_copy"))))
    extra = {"copy": "_mix_copy", "copies": "_mix_copies", "rate": "_mix_rate", "shuffle_key": "_mix_key"}
    ordered = drawn.repartitionByRange("_mix_key").sortWithinPartitions("_mix_key")
    return ordered.select(*keep, *(F.col(v).alias(k) for k, v in extra.items() if k not in keep))


#: DuckDB SQL for the query: temperature weights, counts and order keys.
MIX_SQL = f"""
WITH s AS (SELECT source, CAST(SUM(octet_length(encode(coalesce(text, ''))) + 1) AS DOUBLE) AS bytes FROM documents GROUP BY source),
r AS (SELECT source, pow(bytes, {TEMPERATURE}) / SUM(pow(bytes, {TEMPERATURE})) OVER () * SUM(bytes) OVER () / bytes AS rate FROM s),
q AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM q),
c AS (SELECT source, rate, k, SUM(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT doc_id, source, md5(text) AS text_md5, CAST('0x' || substr(md5('mix|' || doc_id), 1, 13) AS BIGINT) / pow(2, 52) AS u FROM documents),
n AS (SELECT doc_id, d.source, text_md5, rate, count(*) FILTER (cdf <= u) AS copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, text_md5, CAST(copy AS INTEGER) AS copy, CAST(copies AS INTEGER) AS copies, round(rate, 9) AS rate, md5('mix-order|' || doc_id || '|' || copy) AS shuffle_key
FROM n, LATERAL (SELECT unnest(range(0, copies)) AS copy)
"""
