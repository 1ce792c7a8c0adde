import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sitegauge.operators import benchmark, competitors, discovery, outreach, retention, scoring, signals, snapshots
from sitegauge.sources import tables

NOW = dt.datetime(2024, 6, 1, 12, 30)


def day(n):
    return NOW - dt.timedelta(days=n)


@pytest.mark.parametrize(("total", "critical", "status"), [(-51, False, "very_bad"), (-50, False, "bad"), (-21, False, "bad"), (-20, False, "middle"), (-6, False, "middle"), (-5, False, "quality_good"), (-1, False, "quality_good"), (0, False, "super"), (10, True, "bad"), (-49, True, "bad"), (-51, True, "very_bad")])
def test_status(spark, total, critical, status):
    assert spark.range(1).select(scoring.lead_status(F.lit(total), F.lit(critical)).alias("s")).head().s == status


def test_totals_and_deltas(spark):
    results = spark.createDataFrame([
        Row(analysis_id=1, category="seo", status="completed", score=-13, issues=[Row(code="seo_missing_title", evidence="")]),
        Row(analysis_id=1, category="http", status="failed", score=-99, issues=None),
        Row(analysis_id=2, category="http", status="failed", score=0, issues=None),
    ], "analysis_id long, category string, status string, score int, issues array<struct<code:string,evidence:string>>")
    rows = {r.analysis_id: r for r in scoring.analysis_totals(results).collect()}
    assert (rows[1].total_score, rows[1].critical_issue_count, rows[1].status, rows[2].status) == (-13, 1, "completed", "failed")
    runs = spark.createDataFrame([(1, 1, day(2), 40, ["a", "b"]), (2, 1, day(1), 60, ["b", "seo_missing_title"]), (3, 2, day(1), 70, [])], "analysis_id long, lead_id long, created_at timestamp_ntz, total_score int, codes array<string>")
    d = {r.analysis_id: r for r in scoring.deltas(runs).collect()}
    assert (d[2].score_delta, d[2].is_improved, d[2].added, d[2].removed, d[2].unchanged_count, d[2].has_new_critical) == (20, True, ["seo_missing_title"], ["a"], 1, True)
    assert d[1].score_delta is None and d[1].added is None


def test_periods(spark):
    snaps = spark.createDataFrame([(1, "month", dt.date(2024, 1, 1), 5), (1, "month", dt.date(2024, 2, 1), 7), (1, "month", dt.date(2024, 4, 1), 9)], "lead_id long, period_type string, period_start date, total_score int")
    assert {r.period_start.month: r.score_delta for r in snapshots.with_delta(snaps).collect()} == {1: None, 2: 2, 4: None}
    start = lambda p: spark.range(1).select(snapshots.period_start(F.lit(dt.datetime(2024, 1, 7, 5)), p).alias("d")).head().d
    assert [start(p) for p in ("day", "week", "month")] == [dt.date(2024, 1, 7), dt.date(2024, 1, 1), dt.date(2024, 1, 1)]


def test_benchmarks(spark):
    runs = spark.createDataFrame([(i, "a", float(i), ["x", "y"] if i % 2 else ["x"], {"seo": -1.0 * i}, i) for i in range(1, 11)], "analysis_id long, industry string, total_score double, codes array<string>, category_scores map<string,double>, issue_count int").withColumn("completed_at", F.lit(NOW))
    b = benchmark.calculate(runs, dt.date(2024, 5, 27))
    row = b.head()
    assert (row.percentiles.p10, row.percentiles.p50, row.percentiles.p90, row.median_score, row.avg_category_scores) == (1.9, 5.5, 9.1, 5.5, {"seo": -5.5})
    assert [(t.code, t["count"], t.percentage) for t in row.top_issues] == [("x", 10, 100.0), ("y", 5, 50.0)]
    points = F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("p10", "p25", "p50", "p75", "p90"), (-50, -30, -15, -5, 0), strict=True)))
    ranks = [spark.range(1).select(benchmark.rank(F.lit(s), points).alias("r")).head().r for s in (0, -5, -15, -30, -40)]
    assert ranks == ["top10", "top25", "above_average", "below_average", "bottom25"]
    other = runs.limit(1).withColumn("industry", F.lit("none"))
    assert benchmark.compare(other, b).head().ranking == "no_benchmark"
    assert {r.outcome for r in benchmark.upsert(b, b).collect()} == {"updated"} and {r.outcome for r in benchmark.upsert(b.limit(0), b).collect()} == {"created"}


def test_discovery(spark):
    c = spark.createDataFrame([(1, "a.cz/1", False, 1), (1, "https://a.cz/2", False, 2), (1, "b.firmy.cz", False, 3), (1, "k.cz", False, 4), (1, "c.cz", False, 5), (1, "d.cz", False, 6)], "user_id long, url string, is_catalogue boolean, position long")
    leads = spark.createDataFrame([(1, "k.cz")], "user_id long, domain string")
    patterns = discovery.catalogue_patterns(spark.createDataFrame([("firmy_cz",)], "source string"))
    out = {r.position: r.outcome for r in discovery.outcomes(c, leads, patterns, 2).collect()}
    assert out == {1: "saved", 2: "duplicate", 3: "excluded", 4: "known", 5: "saved", 6: "over_limit"}


def test_references(spark):
    rows = [(1, "https://agency.cz/", '<a href="/reference">r</a><a href="https://x.com/z">x</a>'), (2, "https://agency.cz/reference", '<a href="https://client.cz/">c</a><a href="https://facebook.com/a">f</a><a href="https://b.cz/a.pdf">p</a>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = discovery.client_references(pages, spark.createDataFrame([("agency.cz",)], "domain string")).collect()
    assert [(r.domain, r.agency_domain, r.found_on) for r in found] == [("client.cz", "agency.cz", "https://agency.cz/reference")]
    assert {r.target_domain for r in discovery.link_graph(pages).collect()} >= {"client.cz"}


def test_import(spark):
    raw = spark.createDataFrame([("a.cz",), ("www.a.cz",), ("known.cz",), ("not a url",), (None,)], "url string")
    leads = spark.createDataFrame([(1, "known.cz"), (2, "a.cz")], "user_id long, domain string")
    out = sorted((r.url or "", r.outcome) for r in discovery.import_urls(raw, leads, 1).collect())
    assert out == [("", "errors"), ("a.cz", "imported"), ("known.cz", "skipped"), ("not a url", "errors"), ("www.a.cz", "skipped")]


def test_signal_match(spark):
    s = spark.createDataFrame([(1, "rfp_web", "eshop", "Praha", "Nový WEB", None, 100.0), (2, "rfp_it", None, None, "Server", "web", None)], "signal_id long, signal_type string, industry string, region string, title string, description string, value double")
    f = spark.createDataFrame([
        (1, 1, None, True, ["praha"], ["rfp_web"], ["web"], [], None, None), (2, 2, "eshop", True, [], [], [], ["server"], 50.0, 200.0), (3, 3, "legal", True, [], [], [], [], None, None),
        (4, 4, None, False, [], [], [], [], None, None), (5, 5, "eshop", True, [], [], [], [], 150.0, None),
    ], "filter_id long, user_id long, user_industry string, active boolean, regions array<string>, signal_types array<string>, keywords array<string>, exclude_keywords array<string>, min_value double, max_value double")
    assert {(r.signal_id, r.filter_id) for r in signals.match(s, f).collect()} == {(1, 1), (1, 2), (2, 3), (2, 5)}


def test_significance(spark):
    of = lambda c: spark.range(1).select(c.alias("s")).head().s
    assert [of(competitors.numeric_significance(F.lit(100), F.lit(x))) for x in (150, 130, 89, 95)] == ["critical", "high", "medium", "low"]
    assert of(competitors.numeric_significance(F.lit(0), F.lit(1))) == "critical"
    arr = lambda *x: F.array(*(F.lit(i) for i in x))
    assert of(competitors.array_significance(arr(*"abcdefghij"), arr(*"abcdefghi"))) == "low" and of(competitors.array_significance(arr("a"), arr("b"))) == "high"
    assert of(competitors.string_significance(F.lit("ceník"), F.lit("cenik"))) == "medium"


def test_competitor_changes(spark):
    facts = spark.createDataFrame([("a", 1, "tiered", [("S", 100.0), ("M", 200.0)]), ("a", 2, "tiered", [("S", 115.0), ("M", 200.0), ("L", 300.0)])], "domain string, taken_at int, pricing_type string, packages array<struct<name:string,price:double>>")
    assert {(r.field, r.significance) for r in competitors.pricing_changes(facts).collect()} == {("price_min", "medium"), ("packages_count", "medium"), ("package_price_S", "medium")}
    p = spark.createDataFrame([("a", 1, 10, ["x"], ["k"]), ("a", 2, 10, ["x", "y", "z", "w"], ["k"])], "domain string, taken_at int, total_count int, clients array<string>, categories array<string>")
    assert [(r.field, r.significance) for r in competitors.portfolio_changes(p).collect()] == [("clients_added", "high")]


def test_mail_fold(spark):
    e = spark.createDataFrame([("m1", "click", None, day(1)), ("m1", "send", None, day(3)), ("m2", "bounce", "Permanent", day(2)), ("m2", "delivery", None, day(1)), ("m3", "bounce", "Transient", day(1)), ("m4", "complaint", None, day(1))], "message_id string, type string, bounce_type string, event_time timestamp")
    rows = {r.message_id: r for r in outreach.fold_mail(e).collect()}
    assert rows["m1"].status == "clicked" and rows["m1"].opened_at == rows["m1"].clicked_at
    assert (rows["m2"].status, rows["m2"].bounce_type, rows["m3"].bounce_type, rows["m4"].status) == ("bounced", "hard", "soft", "complained")


def test_suppression(spark):
    e = spark.createDataFrame([("A@x.cz", 1, "bounce", "Permanent", day(2)), ("a@x.cz", 2, "bounce", "Permanent", day(1)), ("b@x.cz", 1, "bounce", "Transient", day(1)), ("c@x.cz", 1, "unsubscribe", None, day(1))], "email string, user_id long, type string, bounce_type string, event_time timestamp")
    entries = outreach.suppression_entries(e, spark.createDataFrame([], "email string, user_id long"))
    assert {(r.email, r.user_id, r.type) for r in entries.collect()} == {("a@x.cz", None, "hard_bounce"), ("c@x.cz", 1, "unsubscribe")}
    assert outreach.suppression_entries(e, entries).count() == 0
    mails = spark.createDataFrame([("A@X.cz", 9), ("c@x.cz", 1), ("c@x.cz", 2)], "email string, user_id long")
    assert [tuple(r) for r in outreach.suppressed(mails, entries).collect()] == [("c@x.cz", 2)]
    assert outreach.suppressed(mails, entries, keep=True).count() == 2


def test_limits_and_queue(spark):
    sends = spark.createDataFrame([(1, f"u{i}@a.cz", NOW - dt.timedelta(minutes=i)) for i in range(12)] + [(2, f"u{i}@b.cz", NOW - dt.timedelta(hours=3)) for i in range(3)], "user_id long, to_email string, sent_at timestamp_ntz")
    by_user, by_domain = outreach.usage(sends, NOW)
    asked = spark.createDataFrame([(1, "x@c.cz"), (2, "x@b.cz"), (2, "x@c.cz")], "user_id long, to_email string")
    rows = {(r.user_id, r.to_email): r for r in outreach.decide(asked, by_user, by_domain, None, NOW).collect()}
    assert (rows[1, "x@c.cz"].failed_limit, rows[1, "x@c.cz"].retry_after, rows[2, "x@b.cz"].failed_limit, rows[2, "x@c.cz"].allowed) == ("hour", 1800, "domain_day", True)
    offers = spark.createDataFrame([(i, 2, "approved", f"p{i}@d{i % 2}.cz", day(i)) for i in range(9)], "offer_id long, user_id long, status string, recipient_email string, created_at timestamp_ntz")
    queue = outreach.send_queue(offers, spark.createDataFrame([("p8@d0.cz", None)], "email string, user_id long"), by_user, by_domain, None, NOW).collect()
    assert [r.offer_id for r in queue] == [7, 6, 5, 4, 3, 2]


def test_templates(spark):
    asked = spark.createDataFrame([(1, 1, "hi", "eshop"), (2, 2, "hi", "eshop"), (3, 2, "no", "legal"), (4, 1, "no", "eshop")], "request_id long, user_id long, name string, industry string")
    own = spark.createDataFrame([(1, "hi", False, True, 10), (1, "base", True, True, 11)], "user_id long, name string, is_default boolean, is_active boolean, template_id long")
    every = spark.createDataFrame([("hi", "eshop", False, 20), ("hi", None, False, 21), ("d", None, True, 22), ("e", "eshop", True, 23)], "name string, industry string, is_default boolean, template_id long")
    assert {r.request_id: r.template_id for r in outreach.choose_template(asked, own, every).collect()} == {1: 10, 2: 20, 3: 22, 4: 11}


def test_retention(spark):
    rows = spark.createDataFrame([(n, day(n), "p") for n in (29, 30, 89, 90, 364, 365)], "id long, created_at timestamp_ntz, raw_data string")
    out = {r.id: (r.tier, r.raw_data) for r in retention.apply_tiers(rows, NOW).collect()}
    assert out == {29: ("keep", "p"), 30: ("compress", "p"), 89: ("compress", "p"), 90: ("clear", None), 364: ("clear", None)}


def test_feed_and_registry(spark, tmp_path):
    inner = {"notificationType": "Bounce", "mail": {"messageId": "m", "destination": ["A@x.cz"], "timestamp": "2024-01-01T00:00:00Z"}, "bounce": {"bounceType": "Permanent", "bounceSubType": "General"}}
    raw = spark.createDataFrame([(json.dumps({"Type": "Notification", "Message": json.dumps(inner)}),), (json.dumps({"Type": "Notification", "Message": "no json"}),), ("{}",)], "value string")
    row = tables.mail_events(raw, "value").collect()
    assert len(row) == 1 and (row[0].type, row[0].email, row[0].bounce_type) == ("bounce", "a@x.cz", "Permanent")
    answer = {"ico": "25596641", "obchodniJmeno": "Acme", "pravniForma": {"nazev": "s.r.o."}, "stavSubjektu": "AKTIVNI", "sidlo": {"nazevUlice": "Dlouhá", "cisloDomovni": 1, "cisloOrientacni": 2, "nazevObce": "Praha", "nazevCastiObce": "Josefov", "psc": 11000}}
    c = tables.companies(spark.createDataFrame([(json.dumps(answer),)], "response string")).head()
    assert (c.legal_form, c.full_address, c.business_status, c.is_active) == ("s.r.o.", "Dlouhá 1/2, Josefov, 11000 Praha", "Aktivní", True)
    tables.write_table(spark.range(3).withColumn("k", F.col("id") % 2), str(tmp_path / "t"), ["k"])
    assert tables.read_table(spark, str(tmp_path / "t")).count() == 3


def test_many_filters_match_by_keys(spark):
    """Filters looked up by words and by threes of letters find the same pairs, whatever a filter or a signal lacks."""
    rng = random.Random(3)
    words = ["web", "Eshop", "reklama", "it", "a", "škola", "Dům"]
    pick = lambda xs: rng.choice([None, [], [rng.choice(xs)], [rng.choice(xs), rng.choice(xs)]])
    signals_ = [(i, rng.choice(["rfp_web", "hiring_it", None]), rng.choice([None, "a", "b"]), rng.choice([None, "Praha", "Brno"]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(4))]), rng.choice([None, "web it"]), rng.choice([None, 5.0, 50.0])) for i in range(150)]
    filters = [(i, i % 7, rng.choice([None, "a", "b"]), rng.random() < 0.9, pick(["praha", "BRNO"]), pick(["rfp_web", "hiring_it"]), pick(words), pick(words), rng.choice([None, 10.0]), rng.choice([None, 40.0])) for i in range(60)]
    d = spark.createDataFrame(signals_, "signal_id long, signal_type string, industry string, region string, title string, description string, value double")
    f = spark.createDataFrame(filters, "filter_id long, user_id long, user_industry string, active boolean, regions array<string>, signal_types array<string>, keywords array<string>, exclude_keywords array<string>, min_value double, max_value double")
    a, b = (sorted(map(tuple, signals.match(d, f, salts=3, by_terms=n).collect())) for n in (True, False))
    assert a == b and len(a) > 100
