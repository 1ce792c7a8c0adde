"""Near-duplicate detection by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a signature takes half
the hash evaluations.  Bands of such values name buckets.  In every bucket the member that shares most buckets with others
is the hub; hub and members are compared on their full sets, which costs as many comparisons as there are members.
What stays apart from its hub is then compared with the whole bucket, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, mix, shingles, small_batches, utf8
from .components import components

#: Bands, and permutations of each band; a band has twice as many values.  At a similarity of 0.85 a pair misses all bands
#: with a probability of (1 - 0.85**8)**64, about 1.4e-9, at 0.8 with about 8e-6; at 0.5 it meets in a given band with 0.004.
BANDS, PERMUTATIONS = 64, 4
#: Members of a bucket that one block holds, and members of a star that one salt holds.
BLOCK = 512

_SETS = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>"


def band_keys(sets: list[np.ndarray], bands: int = BANDS, permutations: int = PERMUTATIONS, seed: int = 1) -> np.ndarray:
    """One key for each set (none empty) and band: the mixed minima and maxima of the band's permutations."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**64, bands * permutations, np.uint64) | np.uint64(1)
    keys = np.empty((len(sets), bands), np.uint64)
    first = 0
    while first < len(sets):  # in blocks that stay in the CPU's cache
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 16_384):
            size += len(sets[last])
            last += 1
        h = np.concatenate(sets[first:last])
        at = np.cumsum([0, *(len(s) for s in sets[first : last - 1])])
        x = np.empty_like(h)
        for b in range(bands):
            key = np.full(last - first, b, np.uint64)
            for p in range(permutations):
                np.multiply(h, odd[b * permutations + p], out=x)
                key = mix(key + np.minimum.reduceat(x, at))
                key = mix(key ^ np.maximum.reduceat(x, at))
            keys[first:last, b] = key
        first = last
    return keys


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """A row for each document: size and 128-bit hash of its shingle set, and its band keys (null for an empty set)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingles(t, known, shingle) for t in utf8(batch, "text")]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys([sets[i] for i in full], bands, permutations).view(np.int64)
            listed: list = [None] * len(sets)
            for i, k in zip(full, keys, strict=True):
                listed[i] = k
            digest = lambda f: np.array([f(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digest(lambda s: np.add.reduce(mix(s), dtype=np.uint64))), pa.array(digest(lambda s: np.bitwise_xor.reduce(mix(s + np.uint64(77))))),
                pa.array(listed, pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "set_hi", "set_lo", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SETS)


def verify(groups: DataFrame, texts: DataFrame, percent: int, shingle: int = 5) -> DataFrame:
    """Edges (a, b) with 100 * intersection >= percent * union.

    ``groups`` (g, part, role, id, label): rows of one (g, part) with role 0 are held together, at most a block of them; those
    with role 1 pass by and are compared with each of them that has another label.  ``texts``: (id, text).
    """
    small_batches(groups.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        group, ids, labels, sizes, held = None, [], [], [], []
        index: tuple | None = None
        for batch in batches:
            a, b = [], []
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for g, part, role, id_, label, text in zip(*cols, utf8(batch, "text"), strict=True):
                if (g, part) != group:
                    group, ids, labels, held, index = (g, part), [], [], [], None
                s = shingles(text, known, shingle)
                if role == 0:
                    ids.append(id_)
                    labels.append(label)
                    held.append(s)
                    continue
                if index is None:
                    sizes = np.array([len(x) for x in held])
                    flat = np.concatenate(held) if held else np.empty(0, np.uint64)
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], np.repeat(np.arange(len(held)), sizes)[order]
                lo, hi = np.searchsorted(index[0], s), np.searchsorted(index[0], s, "right")
                n = hi - lo
                where = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                inter = np.bincount(index[1][where], minlength=len(ids))
                for i in np.flatnonzero(100 * inter >= percent * (sizes + len(s) - inter)):
                    if ids[i] != id_ and labels[i] != label:
                        a.append(min(ids[i], id_))
                        b.append(max(ids[i], id_))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = groups.hint("merge").join(texts, "id").select("g", "part", "role", "id", "label", "text")
    return rows.repartition("g", "part").sortWithinPartitions("g", "part", "role").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union, and return a row for each document:
    doc_id, n_shingles, component_id (the smallest doc_id reachable over links, its own included), kept (doc_id is component_id).

    Null, empty and blank texts have no shingles and are linked with nothing.  Equal sets are linked.  Rows that repeat a doc_id
    count as one document: each comes back, with one component for all.  A row without doc_id has no component and is kept.
    No row is dropped; columns beside id and text are ignored.
    """
    rows = cut(signatures(docs, id_col, text_col, shingle), "sets")
    sets = ["n_shingles", "set_hi", "set_lo"]
    full = rows.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    classes = cut(classes, "classes")
    # buckets of two representatives or more, with the one that shares most buckets with others as hub
    keyed = classes.select("rep", F.explode("bands").alias("g")).repartition("g")
    shared = keyed.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    buckets = cut(keyed.join(shared, "g"), "buckets")
    popular = cut(buckets.groupBy("rep").agg(F.sum("size").alias("met")), "popular")
    ranked = buckets.join(popular, "rep")
    hubs = ranked.groupBy("g").agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("hub"))
    buckets = cut(buckets.join(hubs, "g"), "buckets")
    size = classes.groupBy("rep").agg(F.min("n_shingles").alias("n_min"), F.max("n_shingles").alias("n_max"))
    stars = buckets.where("rep <> hub").select("hub", "rep").distinct()
    stars = stars.join(size, "rep").join(size.toDF("hub", "h_min", "h_max"), "hub")
    stars = cut(stars.where(f"100 * n_max >= {percent} * h_min and 100 * h_max >= {percent} * n_min").select("hub", "rep"), "stars")
    salts = stars.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    heads = salts.select(F.col("hub").alias("g"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("hub").alias("id"))
    tails = stars.join(salts, "hub").select(F.col("hub").alias("g"), F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("rep").alias("id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    texts = cut(texts.join(popular.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi"), "texts")
    edges = cut(verify(heads.union(tails).withColumn("label", F.col("id")), texts, percent, shingle), "links")
    labels = components(edges)
    # buckets of which something stays apart from its hub and has others to meet;
    named = buckets.where("size > 2").join(labels.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = named.join(labels.toDF("hub", "hub_label"), "hub", "left").withColumn("apart", F.col("label") != F.coalesce("hub_label", "hub"))
    # one of those that have the same members: near copies share many bands
    members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("m1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("m2")]
    open_ = named.groupBy("g").agg(F.max("apart").alias("open"), *members).where("open").groupBy("n", "m1", "m2").agg(F.min("g").alias("g")).select("g")
    named = cut(named.join(open_, "g").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "apart")
    held = named.select("g", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("part"), F.lit(0).alias("role"), F.col("rep").alias("id"), "label")
    asked = named.where("apart").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("role"), F.col("rep").alias("id"), "label")
    more = cut(verify(held.union(asked), texts, percent, shingle), "links")
    # rows get the representative of their set; one id with several sets makes those representatives one
    # (many rows of one set are a skewed left side, which adaptive execution splits; rows without a set or an id match nothing
    # and are dealt out by a salt)
    single = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("doc_id", "n_shingles", F.monotonically_increasing_id()), F.lit(1024)))
    named_sets = classes.select(*sets, "rep", F.lit(0).cast("long").alias("salt"))
    rows = rows.withColumn("salt", single.cast("long")).join(named_sets, [*sets, "salt"], "left").select("doc_id", "n_shingles", "rep")
    pairs = rows.where("rep is not null").select("doc_id", "rep").distinct()
    several = pairs.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select(F.col("doc_id").alias("of"), "a")
    more = cut(more.union(pairs.join(several, F.col("doc_id") == F.col("of")).where("rep <> a").select("a", F.col("rep").alias("b"))), "links")
    if more.limit(1).count():
        labels = components(edges.union(more))
    out = rows.join(labels.toDF("rep", "component_id"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
