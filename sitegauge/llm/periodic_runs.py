"""Periodic runs of words in texts: stretches that repeat a group of words three times or more, one after the other.

In a run every word occurs three times at least.  So a word that is rarer in its text can stand in no run, and splits the text; what
is rare within a piece splits that again, until nothing more splits.  The pieces that are left, few and short in prose, are
scanned lag by lag.  A document is worked on by itself, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8, words

#: Words of a run at least, and repetitions.
LEAST, TIMES = 24, 3
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Words that lags of this length and more are tried by at once; a shorter lag is compared in full.
_GRAM = LEAST // TIMES


def segments(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches [a, b) of LEAST words or more in which every word occurs TIMES or more; every run lies in one of them."""
    todo = [(0, len(ids))]
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        _, at, counts = np.unique(ids[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[at] < TIMES)
        if not len(rare):
            yield a, b
            continue
        ends = np.concatenate(([-1], rare, [b - a])) + a
        long = np.flatnonzero(np.diff(ends) > LEAST)
        todo += zip((ends[long] + 1).tolist(), ends[long + 1].tolist())


def _stretch(s: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The longest [x, y) about ``i`` in which s[k] == s[k + q]; looked for in steps that double."""
    y, step = i, 64
    while y < len(s) - q:
        e = min(y + step, len(s) - q)
        differ = np.flatnonzero(s[y:e] != s[y + q : e + q])
        if len(differ):
            y += int(differ[0])
            break
        y, step = e, 2 * step
    x, step = i, 64
    while x > 0:
        e = max(x - step, 0)
        differ = np.flatnonzero(s[e:x] != s[e + q : x + q])
        if len(differ):
            x = e + int(differ[-1]) + 1
            break
        x, step = e, 2 * step
    return x, y


def scan(s: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of ``s``: the period is the smallest, the length LEAST or more and TIMES the period or more.

    Lags go up, so a run that a multiple of its period meets again is known.  For a lag q of _GRAM or more a run has 2 q places
    whose word returns after q; hence a multiple of q is among them at which _GRAM words do, and only multiples are tried.
    """
    m, found, known = len(s), [], set()

    def take(x: int, y: int, q: int) -> None:
        if y - x + q >= max(LEAST, TIMES * q) and (x, y + q) not in known:
            known.add((x, y + q))
            found.append((x, y - x + q, q))

    for q in range(1, min(_GRAM - 1, m // TIMES) + 1):
        ends = np.concatenate(([-1], np.flatnonzero(s[:-q] != s[q:]), [m - q]))
        for k in np.flatnonzero(np.diff(ends) > LEAST - q).tolist():
            take(int(ends[k]) + 1, int(ends[k + 1]), q)
    if m < TIMES * _GRAM:
        return found
    gram = np.zeros(m - _GRAM + 1, np.uint64)
    for j in range(_GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + s[j : m - _GRAM + 1 + j].astype(np.uint64) + np.uint64(1)
    if len(np.unique(gram)) == len(gram):
        return found
    for q in range(_GRAM, m // TIMES + 1):
        some = gram[::q]
        hits = np.flatnonzero(some[1:] == some[:-1]) * q
        while len(hits):
            i = int(hits[0])
            # within a run of a period that divides q all is known
            done = [a + n - q for a, n, p in found if q % p == 0 and a <= i and i + q <= a + n] if found else []
            if done:
                hits = hits[hits > max(done)]
                continue
            x, y = _stretch(s, i, q)
            if y > x:
                take(x, y, q)
            hits = hits[hits >= max(y, i + 1)]
    return found


def runs_of(found: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a list of words, by start and period."""
    if len(found) < LEAST:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    return sorted(((a + x, n, q) for a, b in segments(ids) for x, n, q in scan(ids[a:b])), key=lambda r: (r[0], r[2]))


def collapse(found: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run behind its first period."""
    if not runs:
        return found
    gone = np.zeros(len(found) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [found[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, runs (array of start, length, period, by start and period) and collapsed, the text
    with each run cut to its first period, words joined by one space.

    A run is a stretch of words with smallest period q, of 24 words and 3 q or more, that no neighbour extends; runs may overlap.
    Null, empty and blank texts have no words, no runs and an empty collapsed text.  Null ids and repeated rows come back as they
    are; an empty table gives no rows; columns beside id and text are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts = [], [], []
            for text in utf8(batch, "text"):
                found = (text or b"").split()
                some = runs_of(found)
                sizes.append(len(found))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in some])
                texts.append(b" ".join(collapse(found, some)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(id_: Column, text: Column) -> Column:
    """The query's texts: each tenth (by crc32 of the id) repeats a part of itself to its end."""
    h = F.crc32(id_.cast("string").cast("binary"))

    def repeat(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a.cast("int")), tail), " ")).otherwise("")

    return F.when(h % 10 == 0, F.transform(F.array(words(text)), repeat)[0]).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's: the number of runs, the one of greatest exponent, and digests of runs and text."""
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best_of = found.withColumn("best", best)
    return best_of.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
