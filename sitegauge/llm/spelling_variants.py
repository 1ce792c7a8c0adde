"""Spelling variants of words: words one edit apart, grouped under the form that is ten times as frequent.

Words are compared by asymmetric chunks.  One of two words is cut into two disjoint chunks, the other gives its positional grams
of the chunks' lengths.  One edit spares one chunk, and moves it by one place at most, so the words meet on a key of chunk and place
and are verified there.  The shorter word (or the first of two of one length) is the one that is cut, hence a chunk before the edit
stays in place and one behind it moves by the difference in length: no gram at another place is sent.  Where many words
share a chunk, what it leaves of them is cut in chunks again.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, utf8

#: Letters of a run; code points and occurrences of a word, at least; how much more frequent its form must be.
RUN, LEAST_LENGTH, LEAST_COUNT, TIMES = "[A-Za-zÀ-ÿ]+", 7, 2, 10
#: Every so many-th run of a document (by hash) loses a letter in the query.
TYPOS = 31
#: Cut words of one key that meet all its grams; different words that a task counts before it passes them on.
HELD, KNOWN = 64, 200_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typos: int | None = None, length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """Table (word, n): lower-cased (A-Z) runs of letters of at least ``length`` code points and ``least`` occurrences over all texts.

    With ``typos`` a run whose crc32 of ``<id>:<run>`` this number divides loses one letter first (rows without an id lose none).
    """
    small_batches(docs.sparkSession)
    runs = re.compile(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())], ["word", "n"])
            known.clear()
            return batch

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), utf8(batch, "text"), strict=True):
                found = Counter(w for w in runs.findall((text or b"").lower().decode("utf-8", "replace")) if len(w) >= length)
                start = zlib.crc32(b"%d:" % id_) if typos and id_ is not None else None
                for w, n in found.items():
                    if start is not None and (h := zlib.crc32(w.encode(), start)) % typos == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < length:
                            continue
                    known[w] += n
            if len(known) > KNOWN:
                yield out()
        if known:
            yield out()

    counted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keys(items: DataFrame) -> DataFrame:
    """Key ``items`` (g, gram, word, n, lo, hi: words that agree in group g on all but the letters [lo, hi)) by chunks and grams of these letters.

    ``l`` is the length of the cut word's open letters; the other word's are as many or one more.  The first chunk is the first half,
    and leaves what is behind it open; the second is the rest, stands at its end in either word, and leaves what is before it.
    """
    lengths = F.expr("CASE WHEN gram THEN filter(array(hi - lo, hi - lo - 1), x -> x > 0) ELSE array(hi - lo) END")
    cuts = items.withColumn("l", F.explode(lengths)).withColumn("q", F.expr("int(l / 2)")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    place = F.expr("CASE WHEN k = 0 THEN lo ELSE hi - l + q END")
    cuts = cuts.withColumn("place", place).withColumn("piece", F.expr("substring(word, place + 1, CASE WHEN k = 0 THEN q ELSE l - q END)"))
    return cuts.select(
        F.xxhash64("g", "l", "k", "piece").alias("g"), "gram", "word", "n", F.expr("CASE WHEN k = 0 THEN lo + q ELSE lo END").alias("lo"),
        F.expr("CASE WHEN k = 0 THEN hi ELSE place END").alias("hi"), F.expr("CASE WHEN k = 0 THEN l - q ELSE q END").alias("open"),
    )


def near_words(words: DataFrame, held: int = HELD) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of the distinct ``words`` (word, n) that differ by one inserted, deleted or replaced code point, each once."""
    items = words.select(F.lit(0).cast("long").alias("g"), F.explode(F.array(F.lit(False), F.lit(True))).alias("gram"), "word", "n", F.lit(0).alias("lo"), F.char_length("word").alias("hi"))
    found = None
    while True:
        keyed = _keys(items).repartition("g")
        h = F.xxhash64("word")
        sizes = keyed.groupBy("g").agg(F.count_if(~F.col("gram")).alias("cut"), F.count_if("gram").alias("grams"), F.min(h).alias("h0"), F.max(h).alias("h1"))
        met = cut(keyed.join(sizes.where("cut > 0 AND grams > 0 AND h0 <> h1").select("g", "cut"), "g"), "chunks")
        large = (F.col("cut") > held) & (F.col("open") > 2)
        small = met.where(~large)
        chunks = small.where("NOT gram").select("g", F.col("word").alias("a"), F.col("n").alias("n_a"))
        grams = small.where("gram").select("g", F.col("word").alias("b"), F.col("n").alias("n_b"))
        once = (F.char_length("b") > F.char_length("a")) | (F.col("a") < F.col("b"))
        pairs = cut(chunks.join(grams, "g").where(once & (F.levenshtein("a", "b", 1) == 1)).drop("g"), "pairs")
        found = pairs if found is None else found.union(pairs)
        items = met.where(large).select("g", "gram", "word", "n", "lo", "hi")
        if not items.limit(1).count():
            return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """The end of each word's chain of forms (word, to), by pointer jumping; each form is more frequent than its word, so chains end."""
    step = cut(forms, "forms")
    while True:
        nxt = step.select(F.col("word").alias("to"), F.col("to").alias("far"))
        jumped = cut(step.join(nxt, "to", "left").select("word", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "jump")
        step = jumped.select("word", "to")
        if not jumped.where("moved").limit(1).count():
            return step


def variants(counts: DataFrame, times: int = TIMES, held: int = HELD) -> DataFrame:
    """Words (word, n; each once) with the number of near words, their form and its count, and the root that the forms lead to.

    A word's form is its most frequent near word (ties: the smallest in code-point order), if that is ``times`` as frequent or more.
    """
    counts = cut(counts.select("word", "n"), "words")
    pairs = cut(near_words(counts, held), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    out = counts.join(best, "word", "left").withColumn("formed", -F.col("best.less") >= times * F.col("n"))
    out = cut(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("formed"), F.col("best.other")).alias("form"), F.when(F.col("formed"), -F.col("best.less")).alias("form_n")), "formed")
    ends = _roots(out.where("form is not null").select("word", F.col("form").alias("to")))
    return out.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typos: int | None = None, times: int = TIMES, held: int = HELD) -> DataFrame:
    """Words of all texts with their forms and roots: word, n, n_near, form, form_n, root.

    Null, empty and letterless texts have no words, as has an empty table.  Repeated rows count as often as they stand there; rows
    without id count too.  Very long words are words; ties go to the smaller word; columns beside id and text are ignored.
    """
    return variants(word_counts(docs, id_col, text_col, typos), times, held)
