"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Every shingle is hashed once; the hash's upper bits choose a bin and each bin keeps its least hash.  An empty bin borrows from a
full one that a hash of both bins' numbers chooses (optimal densification: each full bin is as likely as another, and the
choice is the same in all documents).  A fingerprint packs the low 8 bits of each bin; the chance agreement of those bits is
taken out of the likeness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

#: Bins as a power of two, and bits kept of each.
BIN_BITS, LOW_BITS = 7, 8
#: Bytes of text in a range of ids, about; beyond so many ranges they grow instead (their windows sort on disk), as the driver names them.
RANGE_BYTES, MOST_RANGES = 2 << 20, 100_000
_REST = (1 << 64 - BIN_BITS) - 1


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def fingerprint(ws: Column, shingle: int = 5) -> Column:
    """Hex fingerprint of an array of words; empty without words.  Fewer words than a shingle has are one shingle."""
    hashes = _bound(ws, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(shingle)))))
    # the greatest hash of each bin is added, so that every bin has an entry; a bin with no other is empty
    ends = F.transform(F.sequence(F.lit(0), F.lit((1 << BIN_BITS) - 1)), lambda b: F.shiftleft(b.cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(_REST)))
    empty = lambda x: x.bitwiseAND(F.lit(_REST)) == F.lit(_REST)
    mask, top = F.lit((1 << LOW_BITS) - 1), F.lit(-1 << LOW_BITS)
    least = _bound(F.array_sort(F.concat(hashes, ends)), lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))

    def packed(bins: Column) -> Column:
        borrow = lambda x, full: F.array_min(F.transform(full, lambda y: F.xxhash64(_bin(x), _bin(y)).bitwiseAND(top).bitwiseOR(y.bitwiseAND(mask))))
        value = lambda x, full: F.when(empty(x), borrow(x, full)).otherwise(x).bitwiseAND(mask)
        digits = lambda full: F.transform(bins, lambda x: F.substring(F.hex(value(x, full) + F.lit(1 << LOW_BITS)), 2, 2))
        return _bound(F.filter(bins, lambda x: ~empty(x)), lambda full: F.lower(F.array_join(digits(full), "")))

    return F.when(F.size(ws) > 0, _bound(least, packed)).otherwise("")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints, 0 to 1: the agreeing bins' part m, less chance: (m - c) / (1 - c), c = 2**-8.
    Two empty ones are alike, an empty and another are not."""
    n, chance = 1 << BIN_BITS, 2.0**-LOW_BITS
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(a, i * 2 + 1, F.lit(2)) == F.substring(b, i * 2 + 1, F.lit(2))))
    estimate = F.greatest((same / F.lit(n) - F.lit(chance)) / F.lit(1 - chance), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(estimate)


def _at_most(bounds: Column, size: int, x: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``x``, by halving."""
    steps = F.sequence(F.lit(1), F.lit(max(1, size.bit_length())))
    first = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & (F.get(bounds, mid) <= x)
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, first, halve)["lo"]


def with_next(rows: DataFrame, id_col: str, text_col: str, columns: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``rows`` with next_<column>: the columns of the next row in ascending order of the id (null first), after the last the first.
    Rows of one id are in the order of a hash of their texts.  ``derive`` adds columns to the rows and to those that two ranges have.

    Rows are dealt out by ranges of about ``range_bytes``; their bounds are quantiles of all ids.  An id that is several bounds (that
    of a hot group) has several ranges, by the hash.  Each range also gets the first row of the one that follows, so a window in
    each range suffices.
    """
    spark, id_ = rows.sparkSession, F.coalesce(F.col(id_col), F.lit(-(2**63)))
    size = rows.agg(F.sum(F.octet_length(text_col))).head()[0] or 0
    n = max(1, min(-(-size // range_bytes), MOST_RANGES))
    bounds = rows.agg(F.percentile_approx(id_, [i / n for i in range(1, n)] or [0.5], max(10_000, min(20 * n, 1_000_000)))).head()[0] or []
    # sorted, and repeated where an id is several bounds
    bounds, many = F.lit(bounds) if bounds else F.array().cast("array<long>"), len(bounds)
    below = _at_most(bounds, many, id_ - F.when(id_ > -(2**63), 1).otherwise(0))
    upto = _at_most(bounds, many, id_)
    hashed = rows.withColumn("_hash", F.xxhash64(text_col))
    lowest = F.when(id_ > -(2**63), below).otherwise(0)
    part = F.floor(F.shiftrightunsigned("_hash", 12) / F.lit(2.0**52) * (upto - lowest + 1))  # by the hash as unsigned number
    dealt = hashed.withColumn("_range", (lowest + F.when(upto > lowest, part).otherwise(0)).cast("int"))
    order = [F.col(id_col).asc_nulls_first(), F.shiftrightunsigned("_hash", 1), "_hash"]
    key = F.struct(F.col(id_col).isNotNull().alias("k"), F.col(id_col).alias("id"), F.shiftrightunsigned("_hash", 1).alias("u"), F.col("_hash").alias("h"))
    firsts = sorted(dealt.groupBy("_range").agg(F.min(key).alias("m")).select("_range", "m.id", "m.h").collect())  # one for each range
    edges = [(r.id, r.h, firsts[k - 1]["_range"], r["_range"]) for k, r in enumerate(firsts)]  # a range's first row also ends the range before
    table = F.broadcast(spark.createDataFrame(edges, "_first long, _first_hash long, _before int, _of int"))
    copies = dealt.join(table, F.col(id_col).eqNullSafe(F.col("_first")) & (F.col("_hash") == F.col("_first_hash")) & (F.col("_range") == F.col("_of")))
    copies = copies.withColumn("_range", F.col("_before")).select(dealt.columns)
    both = derive(dealt.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))).repartition(n, "_range")
    led = both.select("*", *(F.lead(c).over(Window.partitionBy("_range").orderBy("_copy", *order)).alias(f"next_{c}") for c in columns))
    return led.where("not _copy").drop("_copy", "_range", "_hash")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document in ascending order of ids, after the last the first.  Rows of one id follow each other in the order of
    a hash of their texts; rows without id come first.  A null text is an empty one, whose fingerprint is empty.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    printed = lambda df: df.withColumn("ws", words(F.col("text"))).withColumn("fingerprint", fingerprint(F.col("ws"))).drop("ws")
    both = with_next(rows, "doc_id", "text", ["text", "fingerprint"], printed)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint").withColumn("ws", words(F.col("edited")))
    out = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("ws")).alias("edited_fingerprint"), "next_fingerprint")
    near = out.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint")))
    return near.drop("next_fingerprint")
