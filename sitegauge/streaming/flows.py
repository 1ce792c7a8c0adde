"""The operators over streams.  All take streaming DataFrames; the same functions serve batches where state is not needed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import audit
from ..operators.outreach import mail_domain
from ..operators.scoring import lead_status
from ..operators.signals import match, with_external_id
from ..sources.tables import mail_events, mail_rejects
from .stateful import CHANGE_OUTPUT, KINDS, MAIL_OUTPUT, MailStates, SnapshotChain, rocksdb


def mail_feed(raw: DataFrame, path: str, value: str = "value") -> Callable:
    """Start taking in mail notifications, JSON in column ``value`` (S5); returns the writer, to be started.  Events go to ``path``/events,
    records that are none to ``path``/rejected with the reason; each batch is a partition of its own, which it replaces if it runs again."""

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            mail_events(batch, value).write.mode("overwrite").parquet(f"{path}/events/batch={number}")
            mail_rejects(batch, value).write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        finally:
            batch.unpersist()

    return raw.select(value).writeStream.foreachBatch(take)


def mail_states(events: DataFrame, delay: str = "7 days", days: int = 30) -> DataFrame:
    """The state of each message after each batch that touches it (ST1).  Events may come ``delay`` late; a message's state is
    forgotten ``days`` after its last event, so states don't grow with the stream's age."""
    rocksdb(events.sparkSession)
    timed = events.select("message_id", "event_time", F.unix_micros("event_time").alias("at"), "type", "bounce_type").withWatermark("event_time", delay)
    said = timed.groupBy("message_id").transformWithState(MailStates(days), MAIL_OUTPUT, "Update", "EventTime")
    return said.withColumns({c: F.timestamp_micros(c) for c in ("sent_at", "delivered_at", "opened_at", "clicked_at", "bounced_at", "last_event_at")})


def funnel(events: DataFrame, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts of each user's events by kind in windows that do not overlap (ST2)."""
    w = events.withWatermark("event_time", delay).groupBy("user_id", F.window("event_time", length).alias("w"))
    return w.agg(*(F.count_if(F.col("type") == k).alias(k) for k in KINDS)).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *KINDS)


def send_rate(events: DataFrame, by_domain: bool = False, length: str = "1 hour", slide: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Sends of each user, or user and recipient domain, in sliding windows (ST3)."""
    sends = events.where("type = 'send'").withWatermark("event_time", delay)
    keys = ["user_id"] + ([mail_domain(F.col("email")).alias("domain")] if by_domain else [])
    return sends.groupBy(*keys, F.window("event_time", length, slide).alias("w")).agg(F.count("*").alias("sends")).select("user_id", *(["domain"] if by_domain else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "sends")


ENTRIES = "email string, user_id long, type string, event_time timestamp, bucket int, feed string, batch long"


def suppression_feed(events: DataFrame, path: str, name: str = "main", delay: str = "30 days", buckets: int = 64) -> Callable:
    """Start adding new suppression entries to the table at ``path`` (ST4); returns the writer, to be started.

    Within ``delay`` the stream itself lets an address pass once, and forgets it then.  The table lies in ``buckets`` of the address's
    hash; each batch reads the buckets that its addresses fall in, for what other feeds or earlier days have brought, and adds what
    they lack as a partition of its own (bucket, feed, batch).  A batch that runs again first takes away what it left.  Feeds may take
    turns on a table; a ``name`` goes with one stream's checkpoint.  Batches of two feeds that run at one moment can't see each
    other's entries: ``stored_entries`` reads each entry once.
    """
    kind = F.when((F.col("type") == "bounce") & (F.col("bounce_type") == "Permanent"), "hard_bounce").when(F.col("type").isin("complaint", "unsubscribe"), F.col("type"))
    rows = events.select(F.lower(F.trim("email")).alias("email"), F.when(kind == "unsubscribe", F.col("user_id")).cast("long").alias("user_id"), kind.alias("type"), "event_time")
    first = rows.where("type is not null and email is not null").withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["email", "user_id"])
    first = first.withColumn("bucket", F.pmod(F.xxhash64("email"), F.lit(buckets)).cast("int"))

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        mine = spark._jvm.org.apache.hadoop.fs.Path(path, f"bucket=*/feed={name}/batch={number}")
        for left in fs.globStatus(mine) or [] if fs.exists(p) else []:
            fs.delete(left.getPath(), True)
        batch = batch.persist()
        try:
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # numbers of buckets
            new = batch
            if touched and fs.exists(p):
                old = spark.read.schema(ENTRIES).parquet(path).where(F.col("bucket").isin(touched)).select(F.col("email").alias("_e"), F.col("user_id").alias("_u"))
                new = batch.join(old, (F.col("email") == F.col("_e")) & F.col("user_id").eqNullSafe(F.col("_u")), "left_anti")
            if touched:
                rows = new.withColumns({"feed": F.lit(name), "batch": F.lit(number).cast("long")}).repartition("bucket")
                rows.write.mode("append").partitionBy("bucket", "feed", "batch").parquet(path)
        finally:
            batch.unpersist()

    return first.writeStream.foreachBatch(add)


def stored_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries (email, user_id, type, event_time) of a table that feeds fill, each once: the earliest, by time and feed."""
    rows = spark.read.schema(ENTRIES).parquet(path)
    kept = rows.groupBy("email", "user_id").agg(F.min(F.struct("event_time", "feed", "batch", "type")).alias("r"))
    return kept.select("email", "user_id", "r.type", "r.event_time")


def signal_matches(signals: DataFrame, filters: DataFrame, delay: str = "1 day") -> DataFrame:
    """Arriving signals, once for each (source, external_id), with the stored filters that accept them (ST5)."""
    once = with_external_id(signals).withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["source", "external_id"])
    return match(once, filters)


def page_audits(pages: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Issues of arriving pages; stateless (ST6)."""
    return audit(pages, as_of)


def page_scores(pages: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Total and status of each batch's pages, for foreachBatch (ST6)."""
    scored = audit(pages, as_of).groupBy("page_id").agg(F.sum("weight").alias("total_score"), F.max(F.col("severity") == "critical").alias("critical"))
    return scored.select("page_id", "total_score", lead_status(F.col("total_score"), F.col("critical")).alias("status"))


def snapshot_changes(snaps: DataFrame, late: dt.timedelta = dt.timedelta(days=7), forget: dt.timedelta | None = None) -> DataFrame:
    """Arriving snapshots (domain, snapshot_type, taken_at, snapshot_id, content_hash) with the content hash before theirs (ST7).

    Equal times go by the id.  A snapshot that comes late, but within ``late`` of the newest, finds its place, and the one behind it is
    said again; the last word on an id counts.  Later ones are left out.  A site's state is its snapshots of that time, then its
    newest alone; a site without news for ``forget`` begins anew (None: never).
    """
    rocksdb(snaps.sparkSession)
    timed = snaps.select("domain", "snapshot_type", "taken_at", F.unix_micros("taken_at").alias("at"), "snapshot_id", "content_hash").withWatermark("taken_at", f"{int(late.total_seconds())} seconds")
    said = timed.groupBy("domain", "snapshot_type").transformWithState(SnapshotChain(late, forget), CHANGE_OUTPUT, "Update", "EventTime")
    return said.withColumn("taken_at", F.timestamp_micros("taken_at"))
