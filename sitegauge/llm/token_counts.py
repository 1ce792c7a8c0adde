"""Token counts by exact histogram of encoded lengths.

Documents are counted by their length in tokens; sums over the lengths from a limit on answer, for every context limit, how
many documents and tokens there are, how many exceed it, and how many tokens are left when each document is cut at it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Lengths that one block of the histogram spans.
SPAN = 1024
_encoders: dict = {}


def encoder(name: str):  # noqa: ANN201
    """The worker's tiktoken encoding of a file, or of a name among the public tokenizers."""
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        path = name if os.path.exists(name) else str(public_tokenizers.path(name))
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding(os.path.basename(name), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def lengths(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Table (n_tokens, n_docs): documents by encoded length of the whole text; null texts have no token."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each length that occurs, as context limit: n_tokens, n_docs of that length, docs_from and tokens_from (of documents
    at least so long), docs_total, tokens_total, quantile (part of documents at most so long) and truncated_total (tokens left
    when every document is cut at this length).  Between lengths that occur, truncated_total grows by docs_from of the next.

    Null and empty texts are of length 0; an empty table gives no rows.  Other columns are ignored.
    """
    table = cut(lengths(docs, text_col, tokenizer), "lengths").withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    tokens = F.col("n_tokens") * F.col("n_docs")
    spans = table.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))  # one row for each 1024 lengths
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"))
    within = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    docs_total, tokens_total = table.agg(F.sum("n_docs"), F.sum(tokens)).head()
    out = table.withColumn("a", F.sum("n_docs").over(within)).withColumn("b", F.sum(tokens).over(within)).join(spans, "span")
    out = out.select("n_tokens", "n_docs", (F.col("a") + F.col("d")).alias("docs_from"), (F.col("b") + F.col("t")).alias("tokens_from"), F.lit(docs_total).cast("long").alias("docs_total"), F.lit(tokens_total).cast("long").alias("tokens_total"))
    shorter = F.col("docs_total") - F.col("docs_from")
    return out.withColumn("quantile", (shorter + F.col("n_docs")) / F.col("docs_total")).withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any context limits out of ``length_histogram``: context_limit, docs_over (longer than the limit), tokens_over (in
    them), truncated_total (tokens left when every document is cut at the limit), docs_total, tokens_total.

    A limit between lengths that occur is answered by the suffix sums of the next longer one.  An empty histogram gives zeros.
    """
    asked = sorted(set(map(int, limits)))
    if not asked:
        raise ValueError("no limit")
    every = F.array(*(F.lit(x).cast("long") for x in asked))
    below = histogram.withColumn("below", F.size(F.filter(every, lambda x: x < F.col("n_tokens"))))  # limits that the length exceeds
    sums = below.groupBy("below").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"), F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total"))
    sums = {r.below: r for r in sums.collect()}  # a row for each limit and one more, at most
    totals = next(((r.docs_total, r.tokens_total) for r in sums.values()), (0, 0))
    rows = []
    for i, limit in enumerate(asked):
        docs_over, tokens_over = (sum(r[k] for n, r in sums.items() if n > i) for k in ("d", "t"))
        rows.append((limit, docs_over, tokens_over, totals[1] - tokens_over + docs_over * limit, *totals))
    return histogram.sparkSession.createDataFrame(rows, "context_limit long, docs_over long, tokens_over long, truncated_total long, docs_total long, tokens_total long")
