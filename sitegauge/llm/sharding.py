"""Sharding by balanced label propagation, in DataFrame functions alone.

Documents of equal text are linked; a group of n such documents is a clique that one hub stands for, so no pair is made.  Labels
(shards) begin as a hash of the id.  In each round the documents of a group that have one label look at the labels of their
neighbours and ask to move to the most frequent one; as many moves are granted as the shard has room for under its quota.  In
the end every shard keeps as many documents as it is to have, linked ones first, and passes the rest on to shards with room.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

SHARDS = 16
ROUNDS = 6


def _granted(flow: dict[tuple[int, int], int], room: list[int]) -> list[float]:
    """The part of the moves into each shard that its quota grants, given that as many of the moves out of it take place: the
    greatest solution, from above."""
    part = [1.0] * len(room)
    into = [sum(n for (_, t), n in flow.items() if t == s) for s in range(len(room))]
    for _ in range(60):
        leave = [sum(n * part[t] for (f, t), n in flow.items() if f == s) for s in range(len(room))]
        part = [min(part[s], max(0.0, room[s] + leave[s]) / into[s]) if into[s] else 1.0 for s in range(len(room))]
    return part


def _cells(rows: DataFrame, shards: int, rounds: int, quota: int) -> DataFrame:
    """Table (grp, init, n, members, label): for the documents of each group that began in one shard, how many and where they end.

    A group that needs k shards gathers in the k that have most of it; a small one looks first at shards that aren't overfull.  Large groups (over a quarter of a quota) take a shard's
    room before small ones, which may be passed on as wholes.
    """
    cells = rows.groupBy("grp", "init").agg(F.count("*").alias("n"))
    cells = cells.withColumn("members", F.sum("n").over(Window.partitionBy("grp"))).where("members > 1")
    cells = cut(cells.select("grp", "init", "n", "members", F.col("init").alias("label")), "cells")
    large = F.col("members") * 4 > quota
    for r in range(rounds):
        votes = cells.groupBy("grp", "label").agg(F.sum("n").alias("votes"), F.first("members").alias("members"))
        held = {x.label: x.n for x in cells.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
        full = F.get(F.array(*(F.lit(held.get(s, 0) > quota) for s in range(shards))), F.col("label"))
        order = Window.partitionBy("grp").orderBy(F.when(large, False).otherwise(full), F.desc("votes"), F.xxhash64("grp", "label"))
        ranked = votes.withColumn("k", F.ceil(F.col("members") / max(1, quota)).cast("int")).withColumn("rank", F.row_number().over(order)).where("rank <= k")
        best = ranked.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("best"))
        turn = F.get("best", F.pmod(F.xxhash64("init", F.lit(r)), F.size("best")).cast("int"))
        asked = cells.join(best, "grp").withColumn("want", F.when(F.array_contains("best", F.col("label")), F.col("label")).otherwise(turn))
        asked = cut(asked.select("grp", "init", "n", "members", "label", "want", large.alias("large")), "asked")
        flows = asked.groupBy("label", "want", "large").agg(F.sum("n").alias("n")).collect()  # a row for two shards and size at most
        move = lambda big: {(x.label, x.want): x.n for x in flows if x.label != x.want and x.large == big}
        load = lambda big: [sum(x.n for x in flows if x.label == s and x.large == big) for s in range(shards)]
        if not any(x.label != x.want for x in flows):
            break
        first = _granted(move(True), [quota - n for n in load(True)])
        after = [load(True)[s] + sum(n * (first[t] if t == s else 0) - n * (first[t] if f == s else 0) for (f, t), n in move(True).items()) for s in range(shards)]
        second = _granted(move(False), [quota - n - m for n, m in zip(after, load(False), strict=True)])
        part = lambda xs: F.get(F.array(*(F.lit(float(x)) for x in xs)), F.col("want"))
        # cells of a small group are granted together, those of a large one each by itself
        own = F.when(F.col("large"), F.xxhash64("grp", "init", F.lit(r))).otherwise(F.xxhash64("grp", F.lit(r)))
        granted = F.pmod(own, F.lit(1_000_000)) < F.when(F.col("large"), part(first)).otherwise(part(second)) * 1_000_000
        cells = cut(asked.select("grp", "init", "n", "members", F.when(granted, F.col("want")).otherwise(F.col("label")).alias("label")), "cells")
    return cells


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Put every row into a shard, with numbers of rows at most one apart (law "rows") and few links cut.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (0, 1, ... in each shard) and grown_shard (null under
    this law).  Null texts count as empty and are equal to them.  Repeated rows are linked like equal texts; null ids are allowed.
    The slots of rows that agree in id and text are interchangeable.  An empty table gives no rows.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp"))
    rows = cut(rows.withColumn("init", F.pmod(F.xxhash64("doc_id", "grp"), F.lit(shards)).cast("int")), "rows")
    total = rows.count()
    cells = _cells(rows, shards, rounds, total // shards)
    named = rows.join(cells.select("grp", "init", "label", "n", "members"), ["grp", "init"], "left").withColumn("shard", F.coalesce("label", "init"))
    # order in a shard: large groups first, then small ones, by buckets of groups, a large cell over several buckets; then the others
    n = partitions(docs.sparkSession)
    limit = max(1, total // (shards * n))
    alone = F.col("label").isNull()
    bucket = F.when(alone, F.pmod(F.xxhash64("doc_id", "grp"), F.lit(n))).otherwise(F.pmod(F.xxhash64("grp"), F.lit(n)))
    sub = F.when(alone | (F.col("n") <= limit), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / limit)))
    place = F.when(alone, 2).when(F.col("members") * 4 > total // shards, 0).otherwise(1)
    named = named.select("doc_id", "size", "text_crc32", "grp", "shard", place.alias("place"), bucket.cast("int").alias("bucket"), sub.cast("int").alias("sub"))
    named = cut(named, "labels")
    key = ["shard", "place", "bucket", "sub"]
    before = Window.partitionBy("shard").orderBy("place", "bucket", "sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(named.groupBy(*key).agg(F.count("*").alias("n")), "buckets")  # some multiple of shards and partitions
    bases = counts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key).orderBy("grp", "doc_id")
    ranked = named.withColumn("rank", F.row_number().over(inside) - 1).join(bases, key).withColumn("rank", F.col("rank") + F.col("base"))
    have = {x["shard"]: x.n for x in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    have = [have.get(s, 0) for s in range(shards)]
    want = [total // shards + (s < total % shards) for s in range(shards)]
    over = [max(0, h - w) for h, w in zip(have, want, strict=True)]
    free = [max(0, w - h) for h, w in zip(have, want, strict=True)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    passed = F.element_at(longs([sum(over[:s]) - want[s] for s in range(shards)]), F.col("shard") + 1) + F.col("rank")  # place among all that pass on
    upto = longs([sum(free[: s + 1]) for s in range(shards)])
    target = F.size(F.filter(upto, lambda u: u <= F.col("passed")))
    ranked = ranked.withColumn("passed", passed).withColumn("stays", F.col("rank") < F.element_at(longs(want), F.col("shard") + 1)).withColumn("target", target)
    at = F.least(F.col("target") + 1, F.lit(shards))
    slot = F.element_at(longs([have[s] - sum(free[:s]) for s in range(shards)]), at) + F.col("passed")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.when(F.col("stays"), F.col("shard")).otherwise(F.col("target")).cast("int").alias("shard"),
        F.when(F.col("stays"), F.col("rank")).otherwise(slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
