"""Near-duplicate detection by SimHash fingerprints and multi-index hashing.

A fingerprint's bit is the majority of that bit over the hashes of a text's shingles.  Fingerprints that differ in at most three
bits agree in one of two halves but for one bit at most.  So each fingerprint stands in a table under each half, and asks both
tables under every key of the small Hamming ball about its half; what meets there is verified on all bits.  A bucket too large
for a task is indexed again by the halves of the bits that it leaves open, so no bucket is compared in all its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, utf8
from .components import components

#: Bits in which linked fingerprints differ at most; the tables hold for up to three.
DISTANCE = 3
#: Fingerprints of one bucket that a task holds, and askers that meet them in one task.
HELD, ASKED = 512, 4096
_SEED = 42


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """64 bits: the majority (over half) of each bit over the XXH64 of the ``size``-word shingles, repeats included; a shorter text
    is one shingle, one without words is zero."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    parts = map(b" ".join, zip(*(found[i:] for i in range(size)))) if len(found) >= size else iter([b" ".join(found)])
    counts, n = np.zeros(64, np.int64), 0
    while block := list(itertools.islice(parts, 65_536)):
        h = np.fromiter((xxhash.xxh64_intdigest(s, _SEED) for s in block), ">u8", len(block))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(block)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Table (doc_id, fp) of all rows; fp is the fingerprint as signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, size) for t in utf8(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _keys(items: DataFrame) -> DataFrame:
    """Index ``items`` (g, lo, width, asks, fp), which agree in group g on all but the bits [lo, lo + width), by both halves of these.

    A row that is held stands under its half itself, and asks under those with one more bit; of two that are one bit apart one does.
    A row that only asks does so under the whole ball.  The open bits of the new groups are the other half.
    """
    halves = items.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).withColumn("half", F.expr("int(width / 2)"))
    seg = F.expr("shiftrightunsigned(fp, lo + s * half) & (shiftleft(1L, half) - 1)")
    balls = halves.withColumn("seg", seg).withColumn("bit", F.explode(F.expr("sequence(-1, half - 1)")))
    balls = balls.where("bit < 0 OR asks OR shiftrightunsigned(seg, bit) & 1 = 0")
    key = F.expr("xxhash64(g, s, CASE WHEN bit < 0 THEN seg ELSE seg ^ shiftleft(1L, bit) END)")
    return balls.select(key.alias("g"), F.expr("lo + (1 - s) * half").alias("lo"), F.col("half").alias("width"), F.expr("asks OR bit >= 0").alias("asks"), "fp")


class _Bucket:
    """Fingerprints held together, and which of them are linked by now."""

    def __init__(self, held: np.ndarray, distance: int):
        self.held, self.distance, self.label = held, distance, np.arange(len(held))

    def near(self, fps: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[:, None] ^ self.held[None, :]) <= self.distance

    def among(self) -> list[tuple[int, int]]:
        """Link the held ones, and give an edge from each to the first of its kind."""
        near, k = self.near(self.held), len(self.held)
        while True:
            least = np.where(near, self.label[None, :], k).min(axis=1)
            least = least[least]
            if (least == self.label).all():
                return [(i, j) for i, j in enumerate(self.label.tolist()) if i != j]
            self.label = least

    def ask(self, fps: np.ndarray) -> list[tuple[int, int]]:
        """Edges (asker, held) that link each asker with all it is near to, one for each kind."""
        near, out = self.near(fps), []
        first = near.argmax(axis=1)
        hit = np.flatnonzero(near.any(axis=1))
        out += zip(hit.tolist(), first[hit].tolist())
        several = hit[(near[hit] & (self.label[None, :] != self.label[first[hit]][:, None])).any(axis=1)]
        for i in several.tolist():
            mine = self.label[first[i]]
            for j in np.flatnonzero(near[i]).tolist():
                if self.label[j] != mine:
                    out.append((i, j))
                    self.label[self.label == self.label[j]] = mine
        return out


def _verify(groups: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that link what the groups (g, part, asks, fp) hold and ask, as a forest: one kind may have more pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, bucket = None, [], None
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def add(left: np.ndarray, right: np.ndarray, pairs: list[tuple[int, int]]) -> None:
            if pairs:
                at = np.array(pairs)
                a.append(left[at[:, 0]])
                b.append(right[at[:, 1]])

        def filled() -> _Bucket:
            out = _Bucket(np.concatenate(held) if held else np.empty(0, np.uint64), distance)
            if group[1] == 0 and len(out.held) > 1:
                add(out.held, out.held, out.among())
            return out

        for batch in batches:
            g, part, asks, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fp = fp.view(np.uint64)
            change = np.flatnonzero((g[1:] != g[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in itertools.pairwise([0, *change.tolist(), len(g)]):
                if lo == hi:
                    continue
                if (g[lo], part[lo]) != group:
                    if group is not None and bucket is None:
                        filled()
                    group, held, bucket = (g[lo], part[lo]), [], None
                if not asks[lo]:
                    held.append(fp[lo:hi])
                    continue
                if bucket is None:
                    bucket = filled()
                for i in range(lo, hi, 1024):
                    some = fp[i : min(i + 1024, hi)]
                    if len(bucket.held):
                        add(some, bucket.held, bucket.ask(some))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])
                a.clear()
                b.clear()
        if group is not None and bucket is None:
            filled()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    rows = groups.select("g", "part", "asks", "fp").repartition("g", "part").sortWithinPartitions("g", "part", "asks")
    return rows.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE, held: int = HELD, asked: int = ASKED) -> DataFrame:
    """Edges (a, b) whose components are those of the distinct fingerprints ``fps`` (fp) under links of ``distance`` bits or fewer (three at most)."""
    if not 0 <= distance <= 3:
        raise ValueError("the tables find fingerprints that differ in three bits at most")
    items = fps.select(F.lit(0).cast("long").alias("g"), F.lit(0).alias("lo"), F.lit(64).alias("width"), F.lit(False).alias("asks"), "fp")
    found = None
    while True:
        keyed = _keys(items).repartition("g")
        sizes = keyed.groupBy("g").agg(F.count_if(~F.col("asks")).alias("n_held"), F.count_if("asks").alias("n_asks")).where("n_held > 0 AND n_held + n_asks > 1")
        met = cut(keyed.join(sizes, "g"), "buckets")
        large = (F.col("n_held") > held) & (F.col("width") >= 4)
        parts = F.greatest(F.ceil(F.col("n_asks") / asked), F.lit(1)).cast("int")
        small = met.where(~large).withColumn("parts", parts)
        part = F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        edges = cut(_verify(small.withColumn("part", F.explode(part)), distance), "links")
        found = edges if found is None else found.union(edges)
        items = met.where(large).select("g", "lo", "width", "asks", "fp")
        if not items.limit(1).count():
            return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = DISTANCE, held: int = HELD) -> DataFrame:
    """Link documents whose fingerprints differ in ``distance`` bits or fewer; a row for each document: doc_id, fingerprint (16 hex
    digits), component_id (the smallest doc_id reachable over links, its own included).

    Null, empty and blank texts have fingerprint zero and are linked like any other; equal fingerprints are linked.  Rows that repeat
    a doc_id are one document, all its fingerprints linked.  Rows without doc_id link too; their component_id is null if nothing with
    an id is reached.  Every row comes back, none for an empty table; columns beside id and text are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    edges = links(classes.select("fp"), distance, held)
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select(F.col("doc_id").alias("_id"), "a")
    several = rows.join(several, F.col("doc_id") == F.col("_id")).where("fp <> a").select("a", F.col("fp").alias("b"))
    labels = components(edges.union(several)).toDF("node", "component")
    named = cut(classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    out = rows.join(named, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
