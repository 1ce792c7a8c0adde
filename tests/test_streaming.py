import datetime as dt
import os
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import competitors, outreach
from sitegauge.streaming import flows

SCHEMA = "message_id string, user_id long, email string, type string, bounce_type string, event_time timestamp"


def events(n=120):
    kinds = ["send", "delivery", "open", "click", "bounce", "complaint"]
    start = dt.datetime(2024, 1, 1)
    return [(f"m{i % 17}", i % 3, f"u{i % 5}@d{i % 2}.cz", kinds[(i * 7) % 6], "Permanent" if i % 4 else "Transient", start + dt.timedelta(minutes=(i * 37) % 500)) for i in range(n)]


def feed(spark, tmp_path, rows, schema, parts=3):
    path = str(tmp_path / uuid.uuid4().hex)
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, mode):
    name = f"t{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q, name


def in_batches(spark, tmp_path, batches, schema):
    """A stream of one file a batch, in this order."""
    path = str(tmp_path / uuid.uuid4().hex)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_mail_states_equal_batch(spark, tmp_path):
    rows = events()
    _, name = run(flows.mail_states(feed(spark, tmp_path, rows, SCHEMA)), "update")
    newest = {}
    for r in spark.table(name).collect():  # states only grow: the fullest is the last
        key = (len([x for x in r if x is not None]), r.last_event_at, outreach.MAIL_ORDER.index(r.status))
        if r.message_id not in newest or key >= newest[r.message_id][0]:
            newest[r.message_id] = (key, r)
    batch = {r.message_id: r.asDict() for r in outreach.fold_mail(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {m: r.asDict() for m, (_, r) in newest.items()} == batch


def test_mail_states_are_forgotten(spark, tmp_path):
    """Late events find their message within the delay, later ones are left out, and a message's state ends 30 days after its last event."""
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    mail = lambda m, kind, at: (m, 1, "a@b.cz", kind, None, at)
    batches = [
        [mail(f"m{i}", "send", day(0, i % 20)) for i in range(40)],
        [mail("m0", "open", day(6)), mail("m1", "delivery", day(1))],  # one of them late
        [mail("x", "send", day(20))],
        [mail("m2", "open", day(2))],  # too late: the watermark is at day 13
        [mail("y", "send", day(60))],
        [mail("z", "send", day(61))], [mail("z", "open", day(62))],
    ]
    q, name = run(flows.mail_states(in_batches(spark, tmp_path, batches, SCHEMA)), "update")
    said = spark.table(name).collect()
    last = {}
    for r in said:
        if r.message_id not in last or (r.last_event_at, r.status != "sent") > (last[r.message_id].last_event_at, last[r.message_id].status != "sent"):
            last[r.message_id] = r
    kept = [e for b in batches for e in b if e[0] != "m2" or e[3] != "open"]
    batch = {r.message_id: r.asDict() for r in outreach.fold_mail(spark.createDataFrame(kept, SCHEMA)).collect()}
    assert {m: r.asDict() for m, r in last.items()} == batch
    sizes = state_rows(q)
    assert max(sizes) >= 40 and sizes[-1] <= 9  # of messages x, y, z: a value and timers each


def test_windows(spark, tmp_path):
    rows = events()
    _, name = run(flows.funnel(feed(spark, tmp_path, rows, SCHEMA, 1)), "update")
    assert spark.table(name).agg(F.sum("send")).head()[0] == sum(r[3] == "send" for r in rows)
    _, name = run(flows.send_rate(feed(spark, tmp_path, rows, SCHEMA, 1), True), "update")
    assert spark.table(name).agg(F.sum("sends")).head()[0] == 12 * sum(r[3] == "send" for r in rows)


def test_suppression_feed(spark, tmp_path):
    path = str(tmp_path / "entries")
    q = flows.suppression_feed(feed(spark, tmp_path, events(), SCHEMA), path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.email, r.user_id) for r in spark.read.parquet(path).collect()]
    want = outreach.suppression_entries(spark.createDataFrame(events(), SCHEMA), spark.createDataFrame([], "email string, user_id long"))
    assert sorted(got, key=str) == sorted(((r.email, r.user_id) for r in want.collect()), key=str)


def test_suppression_feeds_share_a_table(spark, tmp_path):
    """A second feed brings what the first hasn't."""
    path, rows = str(tmp_path / "entries"), events()
    for name, part in (("a", rows[:60]), ("b", rows)):
        q = flows.suppression_feed(feed(spark, tmp_path, part, SCHEMA), path, name).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = [(r.email, r.user_id) for r in spark.read.parquet(path).collect()]
    want = outreach.suppression_entries(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "email string, user_id long"))
    assert sorted(got, key=str) == sorted(((r.email, r.user_id) for r in want.collect()), key=str)


def test_suppression_feeds_take_turns(spark, tmp_path):
    """Two feeds of the same addresses go on by turns, one of them breaks off and repeats a batch: no entry stands twice."""
    path, rows = str(tmp_path / "entries"), events(240)
    folders = {name: str(tmp_path / name) for name in "ab"}

    def turn(name, part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folders[name])
        stream = spark.readStream.schema(SCHEMA).parquet(folders[name])
        q = flows.suppression_feed(stream, path, name).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for k in range(4):
        turn("a", rows[k * 60 : k * 60 + 40])
        turn("b", rows[k * 60 + 20 : k * 60 + 60])
    entries = spark.read.schema(flows.ENTRIES).parquet(path)
    got = sorted(((r.email, r.user_id) for r in entries.collect()), key=str)
    want = sorted(((r.email, r.user_id) for r in outreach.suppression_entries(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "email string, user_id long")).collect()), key=str)
    assert got == want and {r.feed for r in entries.select("feed").collect()} == {"a", "b"}
    # a batch whose commit was lost runs again
    newest = max(os.listdir(tmp_path / "cb" / "commits"), key=lambda f: f.isdigit() and int(f))
    for f in (newest, f".{newest}.crc"):
        if (tmp_path / "cb" / "commits" / f).exists():
            (tmp_path / "cb" / "commits" / f).unlink()
    turn("b", rows[:1])
    assert sorted(((r.email, r.user_id) for r in spark.read.schema(flows.ENTRIES).parquet(path).collect()), key=str) == want
    assert sorted(((r.email, r.user_id) for r in flows.stored_entries(spark, path).collect()), key=str) == want


@pytest.mark.parametrize("parts", [1, 4])
def test_changes_equal_batch(spark, tmp_path, parts):
    """Snapshots in any order over several batches, ties included: the last word on each is what a batch says."""
    start, rng = dt.datetime(2024, 1, 1), random.Random(parts)
    rows = [(f"d{i % 3}", "pricing", start + dt.timedelta(hours=i // 2), i, f"h{i // 4 % 3}") for i in range(60)]
    schema = "domain string, snapshot_type string, taken_at timestamp, snapshot_id long, content_hash string"
    batch = competitors.with_previous(spark.createDataFrame(rows, schema), "content_hash", tie="snapshot_id").collect()
    rng.shuffle(rows)
    _, name = run(flows.snapshot_changes(feed(spark, tmp_path, rows, schema, parts)), "update")
    said = {}
    for r in spark.table(name).collect():
        said.setdefault(r.snapshot_id, set()).add((r.previous_hash, r.has_changes))
    for r in batch:
        assert (r.previous_content_hash, r.has_changes) in said[r.snapshot_id] and len(said[r.snapshot_id]) <= 1 + 3 * (parts > 1)


def test_too_late_changes(spark, tmp_path):
    rows = [("d", "pricing", dt.datetime(2024, 1, day), day, f"h{day}") for day in (20, 21, 22)]
    schema = "domain string, snapshot_type string, taken_at timestamp, snapshot_id long, content_hash string"
    path = str(tmp_path / "late")
    for part in (rows, [("d", "pricing", dt.datetime(2024, 1, 2), 2, "h2"), ("d", "pricing", dt.datetime(2024, 1, 21, 12), 99, "h99")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    _, name = run(flows.snapshot_changes(stream, dt.timedelta(hours=20)), "update")
    said = [(r.snapshot_id, r.previous_hash) for r in spark.table(name).collect()]
    assert sorted(said, key=str) == sorted([(20, None), (21, "h20"), (22, "h21"), (99, "h21"), (22, "h99")], key=str)


def test_sites_are_let_go(spark, tmp_path):
    """A site's state is the snapshots of the last days, then its newest alone, then nothing."""
    schema = "domain string, snapshot_type string, taken_at timestamp, snapshot_id long, content_hash string"
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    batches = [
        [("a", "pricing", day(0, h), h, f"h{h % 3}") for h in range(24)], [("b", "pricing", day(4), 100, "x")], [("b", "pricing", day(5), 101, "x")],
        [("a", "pricing", day(6), 200, "h2")], [("b", "pricing", day(60), 102, "y")], [("b", "pricing", day(61), 103, "y")], [("a", "pricing", day(62), 201, "h2")],
    ]
    q, name = run(flows.snapshot_changes(in_batches(spark, tmp_path, batches, schema), dt.timedelta(days=2), dt.timedelta(days=30)), "update")
    said = {r.snapshot_id: (r.previous_hash, r.has_changes) for r in spark.table(name).collect()}
    assert said[200] == ("h2", False) and said[100] == (None, False) and said[101] == ("x", False)
    assert said[102] == ("x", True) and said[103] == ("y", False)  # the value is there until a timer after day 35 has passed
    assert said[201] == (None, False)  # a was let go
    sizes = state_rows(q)
    assert max(sizes) >= 24 and sizes[-1] < 12


def test_signals_and_pages(spark, tmp_path):
    schema = "signal_id long, source string, external_id string, signal_type string, industry string, region string, title string, description string, value double, published_at timestamp"
    rows = [(i, "s", f"e{i % 4}", "rfp_web", None, None, "web", None, None, dt.datetime(2024, 1, 1)) for i in range(8)]
    f = spark.createDataFrame([(1, 1, None, True, [], [], ["web"], [], None, None)], "filter_id long, user_id long, user_industry string, active boolean, regions array<string>, signal_types array<string>, keywords array<string>, exclude_keywords array<string>, min_value double, max_value double")
    _, name = run(flows.signal_matches(feed(spark, tmp_path, rows, schema, 1), f), "append")
    assert spark.table(name).count() == 4
    pages = feed(spark, tmp_path, [(1, "http://a.cz", "<h1>x</h1>")], "page_id long, url string, html string", 1)
    _, name = run(flows.page_audits(pages, dt.datetime(2024, 6, 1)), "append")
    assert spark.table(name).where("code = 'ssl_not_https'").count() == 1
