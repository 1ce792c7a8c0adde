"""Operators whose keys may be hot or whose lists may be long: equal to the plain form, and by plans without joins of all pairs."""

import datetime as dt
import fnmatch
import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitegauge.functions import distance, terms
from sitegauge.functions import urls as U
from sitegauge.operators import benchmark, competitors, outreach, quantiles, ranks, retention, signals
from sitegauge.sources import stored

PAIRWISE = ("BroadcastNestedLoopJoin", "CartesianProduct")


def plan(df):
    return df._jdf.queryExecution().toString()


# terms


def test_terms_in_one_pass(spark):
    """All terms that stand in a text, overlapping ones and parts of each other included; null and empty texts have none."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abč ") for _ in range(rng.randint(1, 5))) for _ in range(400)})
    texts = [None, ""] + ["".join(rng.choice("abč d") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.f for r in df.select("i", terms.finder(spark, words)(F.col("t")).alias("f")).collect()}
    assert got == {i: [w for w in words if t and w in t] for i, t in enumerate(texts)}
    assert df.select(terms.finder(spark, [])(F.col("t")).alias("f")).distinct().collect()[0].f == []
    with pytest.raises(ValueError):
        terms.finder(spark, ["x" * 2_000_000])


def test_vocabularies(spark):
    lists = {"a": {"ci/cd": "CI/CD", "go": "Go", "rust": "Rust"}, "b": {"rust": "Metal", "ci/cd": "Build", "ci": "Build"}}
    pages = spark.createDataFrame([(1, "Rust and CI/CD"), (2, None), (3, "gopher")], "id int, html string")
    got = {r.id: (r.a, r.b) for r in competitors.name_terms(pages, lists).collect()}
    assert got == {1: (["CI/CD", "Rust"], ["Metal", "Build"]), 2: ([], []), 3: (["Go"], [])}


@pytest.mark.parametrize("n", [20, 10_000])
def test_many_terms_cost_about_one_pass(spark, n):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 12))) for _ in range(n)})
    text = " ".join(rng.choice(words) for _ in range(30_000))
    began = time.process_time()
    found = terms._places([text], f"test{n}", words)[0]
    assert found == [i for i, w in enumerate(words) if w in text] and time.process_time() - began < 20


# signals and filters


SIGNAL = "signal_id long, source string, external_id string, signal_type string, industry string, region string, title string, description string, value double, published_at timestamp"
FILTER = "filter_id long, user_id long, user_industry string, active boolean, regions array<string>, signal_types array<string>, keywords array<string>, exclude_keywords array<string>, min_value double, max_value double"


def some_signals(rng, n):
    words = ["web", "shop", "app", "logo", "design", "seo", "x", "Praha", "škola"]
    pick = lambda xs: rng.choice([None, *xs])
    return [(i, "s", f"e{i}", pick(["rfp_web", "rfp_app", "hiring_it"]), pick(["eshop", "legal"]), pick(["Praha 1", "Brno"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), pick(["a WEB page", "shopping"]), rng.choice([None, 5.0, 50.0, 500.0]), dt.datetime(2024, 1, 1)) for i in range(n)]


def some_filters(rng, n, words=("web", "WEB", "shop", "app", "o", "", "ško", "missing")):
    lists = lambda xs: rng.choice([None, [], [rng.choice(xs)], [rng.choice(xs), rng.choice(xs)]])
    return [(i, i % 7, rng.choice([None, "eshop", "legal", "other"]), rng.random() < 0.9, lists(["praha", "brno", "x"]), lists(["rfp_web", "rfp_app", "other"]), lists([*words, None]), lists([*words[:4], "x", None]), rng.choice([None, 10.0]), rng.choice([None, 100.0])) for i in range(n)]


def accepts(f, s):
    """A filter's conditions, one by one; None is neither true nor false."""
    _, _, industry, active, regions, types, words, bad, least, most = f
    _, _, _, kind, own, region, title, description, value, _ = s
    text = " ".join(x for x in (title, description) if x is not None).lower()

    def some(xs, test):
        found = [None if x is None else test(x) for x in xs]
        return True if True in found else None if None in found else False

    tests = [
        active, own is None or industry is None or own == industry,
        not regions or region is None or some(regions, lambda r: r.lower() in region.lower()),
        not types or (None if kind is None else some(types, lambda t: t == kind)),
        value is None or ((least is None or value >= least) and (most is None or value <= most)),
        not words or some(words, lambda w: w.lower() in text),
        not bad or {True: False, False: True, None: None}[some(bad, lambda w: w.lower() in text)],
    ]
    return all(t is True for t in tests)


@pytest.mark.parametrize("by_terms", [True, False])
def test_match_is_every_pair_that_agrees(spark, by_terms):
    rng = random.Random(6)
    s, f = some_signals(rng, 120), some_filters(rng, 150)
    got = signals.match(spark.createDataFrame(s, SIGNAL), spark.createDataFrame(f, FILTER), salts=3, by_terms=by_terms).collect()
    want = sorted((x[0], y[0], y[1]) for x in s for y in f if accepts(y, x))
    assert sorted(map(tuple, got)) == want and len(want) > 500


def test_many_filters_over_a_stream(spark, tmp_path):
    """20,000 filters meet a stream by equality of keys, without state."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(9_000)]
    filters = [(i, i % 50, None, True, [], [], [rng.choice(words), rng.choice(words)], [], None, None) for i in range(19_900)] + [(30_000 + i, i, "legal", True, [], ["rfp_web"] if i % 2 else [], [], [], 10.0, None) for i in range(100)]
    s = [(i, "s", f"e{i}", "rfp_web", "legal" if i % 2 else "eshop", None, " ".join(rng.choice(words) for _ in range(8)), None, 50.0, dt.datetime(2024, 1, 1)) for i in range(60)]
    path, table = str(tmp_path / "signals"), str(tmp_path / "filters")
    spark.createDataFrame(filters, FILTER).write.parquet(table)
    spark.createDataFrame(s, SIGNAL).coalesce(1).write.parquet(path)
    stream = signals.match(spark.readStream.schema(SIGNAL).parquet(path), spark.read.parquet(table))
    q = stream.writeStream.format("memory").queryName("many_filters").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    assert all(not p["stateOperators"] for p in q.recentProgress)
    explained = q._jsq.explainInternal(True)
    assert not any(x in explained for x in PAIRWISE)
    by_word = {}
    for f in filters[:19_900]:
        for w in set(f[6]):
            by_word.setdefault(w, set()).add(f[0])
    want = {(x[0], i) for x in s for w in by_word if w in x[6] for i in by_word[w]} | {(x[0], f[0]) for x in s for f in filters[19_900:] if x[4] == "legal"}
    got = [(r.signal_id, r.filter_id) for r in spark.table("many_filters").collect()]
    assert len(got) == len(set(got)) and set(got) == want


# globs


def globbed(pattern, domain):
    return any(fnmatch.fnmatchcase(d, pattern) for d in (domain, f"www.{domain}"))


def test_globs_against_fnmatch(spark):
    rng = random.Random(4)
    letters = "abc.-1"
    domains = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(3, 12))) for _ in range(300)} - {""})
    domains = [d for d in domains if not d.startswith("www.")]
    pieces = ["*", "?", "[ab]", "[!c]", "ab", "b.c", "abca", "1", "a"]
    patterns = ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 5))) for _ in range(60)] + ["?????", "zzzz*z", "w*.a?c*"]
    patterns = [p for p in patterns if any(x in p for x in "*?[") and not (p.startswith("*.") and not any(x in p[2:] for x in "*?["))]
    got = U.exclude_domains(spark.createDataFrame([(d,) for d in domains], "domain string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert not any(x in plan(got) for x in PAIRWISE)
    assert {r.domain for r in got.collect()} == {d for d in domains if not any(globbed(p, d) for p in patterns)}


def test_many_globs(spark):
    """50,000 globs, joined by equality alone."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7))
    words = [word() for _ in range(60_000)]
    globs = [rng.choice(["*{}*", "{}-*.cz", "shop?{}.*", "*-{}[0-9].com"]).format(w) for w in words[:50_000]]
    names = [rng.choice(["{}.cz", "{}-eshop.cz", "shop-{}.sk", "my-{}7.com", "a{}b.eu"]).format(rng.choice(words)) for _ in range(2_000)]
    got = U.exclude_domains(spark.createDataFrame([(d,) for d in names], "domain string"), spark.createDataFrame([(p,) for p in globs], "pattern string"))
    assert not any(x in plan(got) for x in PAIRWISE)
    kept = {r.domain for r in got.collect()}
    patterns = {}
    for p in globs:
        patterns.setdefault(next(w for w in p.replace("-", " ").replace("*", " ").replace("?", " ").replace("[", " ").replace(".", " ").split() if len(w) == 7), []).append(p)
    grams = lambda d: {d[i : i + 7] for i in range(len(d) - 6)}
    want = {d for d in names if not any(globbed(p, d) for g in grams(d) for p in patterns.get(g, []))}
    assert kept == want
    assert 100 < len(kept) < len(set(names))


# quantiles


@pytest.mark.parametrize("kind", ["few", "spread", "huge"])
def test_quantiles_equal_percentile(spark, kind, monkeypatch):
    rng = random.Random(kind)
    draw = {"few": lambda: float(rng.randint(-3, 3)), "spread": lambda: rng.gauss(0, 1) * 10 ** rng.randint(-8, 8), "huge": lambda: rng.choice([-1, 1]) * rng.random() * 1.7e308}[kind]
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), draw()) for _ in range(3000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None), ("nan", float("nan")), ("hot", None)]
    df = spark.createDataFrame(rows, "industry string, v double")
    monkeypatch.setattr(quantiles, "BUCKETS", 16)  # more rounds
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.industry: (r.n, r.q) for r in quantiles.quantiles(df, "industry", "v", points).collect()}
    clean = df.where("v is not null and not isnan(v)")
    want = {r.industry: (r.n, r.q) for r in clean.groupBy("industry").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, points))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-12) for k in want)


def test_whole_statistics_equal_sampled(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), float(rng.randint(-80, 20)), rng.randint(0, 9)) for i in range(500)]
    runs = spark.createDataFrame(rows, "analysis_id long, industry string, total_score double, issue_count int")
    a, b = (benchmark.statistics(runs, whole=w) for w in (False, True))
    assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_counts_of_matches_without_pairs(spark):
    """Bounds that values equal, that are missing or crossed, values that are missing, copies of texts: as many as there are pairs."""
    rng = random.Random(5)
    some = lambda xs: rng.choice(xs)
    s = spark.createDataFrame([(i, some(["rfp_web", "tender_it", None]), some(["eshop", "legal", None]), some(["Praha", None]), some(["new web", "Web shop", "logo", None]), some(["of steel", "", None]), some([None, 0.0, 1.0, 2.5, 2.5, 7.0])) for i in range(400)], "signal_id long, signal_type string, industry string, region string, title string, description string, value double")
    f = spark.createDataFrame([(i, i % 3, some(["eshop", "legal", None]), rng.random() > 0.1, some([[], ["praha"], None]), some([[], ["rfp_web"]]), some([[], ["web"], ["shop", "logo"], None]), some([[], ["steel"], ["of", "new"]]), some([None, 0.0, 2.5, 3.0]), some([None, 0.0, 2.5, 7.0])) for i in range(200)], "filter_id long, user_id long, user_industry string, active boolean, regions array<string>, signal_types array<string>, keywords array<string>, exclude_keywords array<string>, min_value double, max_value double")
    want = sorted(map(tuple, signals.counts(signals.match(s, f), "filter_id", "user_id").collect()))
    assert want and sorted(map(tuple, signals.match_counts(s, f).collect())) == want


def test_counts_of_matches_grow_with_the_rows(spark):
    """30,000 signals of one text and 3,000 filters that take a third of them: 30 million pairs, which no step makes."""
    s = spark.range(30_000).select(F.col("id").alias("signal_id"), F.lit("rfp_web").alias("signal_type"), F.lit("eshop").alias("industry"), F.lit(None).cast("string").alias("region"), F.lit("web").alias("title"), F.lit("x").alias("description"), F.col("id").cast("double").alias("value"))
    none = F.array().cast("array<string>")
    f = spark.range(3000).select(F.col("id").alias("filter_id"), F.lit(1).alias("user_id"), F.lit(None).cast("string").alias("user_industry"), F.lit(True).alias("active"), none.alias("regions"), none.alias("signal_types"), none.alias("keywords"), none.alias("exclude_keywords"), (F.col("id") * 5).cast("double").alias("min_value"), (F.col("id") * 5 + 9_999).cast("double").alias("max_value"))
    got = signals.match_counts(s, f)
    assert got.agg(F.count("*").alias("n"), F.min("n").alias("low"), F.max("n").alias("high")).head()[:] == (3000, 10_000, 10_000)


# rolling sends


def test_rolling_sends_of_a_hot_user(spark):
    """One user has nearly all sends: the numbers are those of one window over all, and no task holds the user."""
    rng = random.Random(12)
    start = dt.datetime(2024, 3, 1)
    rows = [(i, rng.choice([1] * 30 + [2, None]), rng.choice([None] + [start + dt.timedelta(seconds=rng.choice([60, 900, 3600]) * rng.randint(0, 400))] * 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, user_id long, sent_at timestamp")
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("sent_at")).rangeBetween(-3_600_000_000, 0)
    want = df.withColumn("n", F.count("*").over(w)).select("i", "n").collect()
    got = outreach.rolling_sends(df)
    assert got.columns == [*df.columns, "in_last_hour"] and sorted(map(tuple, got.select("i", "in_last_hour").collect())) == sorted(map(tuple, want))
    day = spark.range(40_000).select(F.lit(1).alias("user_id"), (F.lit(start) + F.expr("make_dt_interval(0, 0, 0, id)")).cast("timestamp").alias("sent_at"))
    assert outreach.rolling_sends(day).agg(F.max("in_last_hour")).head()[0] == 3601


def test_rolling_sends_are_not_summed_window_by_window(spark):
    """Half a million sends within two hours: a sum over each window would look at some 10^11 rows."""
    day = spark.range(500_000).select("id", F.lit(1).alias("user_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 14_400).alias("sent_at"))
    got = outreach.rolling_sends(day)
    assert "-3600000000" not in plan(got) and "unboundedpreceding" in plan(got)
    top = got.agg(F.max("in_last_hour").alias("most"), F.count("*").alias("n"), F.count_if(F.col("in_last_hour") == F.least(F.col("id"), F.lit(250_000)) + 1).alias("right")).head()
    assert (top.most, top.n, top.right) == (250_001, 500_000, 500_000)


def test_templates_of_one_name(spark):
    """3,000 requests for one name that 3,000 templates have: each meets one of a kind."""
    every = spark.range(3000).select(F.lit("hi").alias("name"), F.when(F.col("id") % 2 == 0, "eshop").alias("industry"), (F.col("id") % 3 == 0).alias("is_default"), (F.col("id") + 10).alias("template_id"))
    own = spark.createDataFrame([(7, "hi", False, True, 5), (8, "x", True, True, 4), (9, "hi", True, False, 3), (None, "free", False, True, 2)], "user_id long, name string, is_default boolean, is_active boolean, template_id long")
    asked = spark.range(3000).select(F.col("id").alias("request_id"), F.col("id").alias("user_id"), F.when(F.col("id") == 8, "no").when(F.col("id") == 11, "free").otherwise("hi").alias("name"), F.when(F.col("id") % 5 == 0, "eshop").otherwise("legal").alias("industry"))
    got = outreach.choose_template(asked, own, every)
    rows = {r.request_id: (r.template_id, r["rank"]) for r in got.collect()}
    want = {i: (10, 2) if i % 5 == 0 else (11, 3) for i in range(3000)} | {7: (5, 1), 8: (4, 4), 11: (2, 3)}
    assert rows == want
    assert plan(got).count("min(template_id") >= 6  # before the joins


# distance


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abč", max_size=14), st.text("abč", max_size=14))
def test_distance_within_a_bound(a, b):
    d = slow_distance(a, b)
    assert [distance.within(a, b, k) for k in range(-1, 16)] == [d <= k for k in range(-1, 16)]
    x, y = sorted((a, b), key=len)
    assert distance._by_anchors(x, y, 3) >= d and distance._in_place(x, y) >= d


def edited(rng, a, share):
    return "".join("" if (r := rng.random()) < share / 3 else rng.choice("xyz") + c if r < share * 2 / 3 else rng.choice("xyz") if r < share else c for c in a)


def test_distance_of_longer_texts():
    rng = random.Random(5)
    for k in range(14):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randint(600, 1300)))
        b = edited(rng, a, k / 12)
        d = slow_distance(a, b)
        assert [distance.within(a, b, x) for x in (d - 30, d - 1, d, d + 1, d + 30, d // 2, 2 * d)] == [x >= d for x in (d - 30, d - 1, d, d + 1, d + 30, d // 2, 2 * d)]


def test_significance_of_long_texts(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(100_000))
    pairs = [("low", base, base[:50_000] + "new words here " + base[50_100:]), ("high", base, "".join(rng.choice("qrstuvwxyz") for _ in range(90_000))), ("high", base, base[:40_000]), ("medium", base, base[:70_000]), ("low", base, edited(rng, base, 0.05)), ("low", None, "x"), ("medium", "ceník", "cenik"), ("low", "", "")]
    df = spark.createDataFrame(pairs, "want string, a string, b string").repartition(1)
    began = time.time()
    assert all(r.want == r.got for r in df.select("want", competitors.string_significance(F.col("a"), F.col("b")).alias("got")).collect())
    assert time.time() - began < 30


# stored tables


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


ROW = "industry string, period_start date, avg_score double"
MONTH = [dt.date(2024, m, 1) for m in range(1, 5)]


def read(spark, path):
    names = ["industry", "period_start", "avg_score"]
    return sorted(map(tuple, spark.read.schema(ROW).parquet(path).select(*names).collect()), key=str)


def test_upsert_touches_its_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "benchmarks")
    first = [(i, m, 1.0) for i in "abc" for m in MONTH[:3]]
    stored.upsert(spark.createDataFrame(first, ROW), path, ["industry", "period_start"], "period_start")
    assert read(spark, path) == sorted(first, key=str)
    before = files(path)
    new = spark.createDataFrame([("a", MONTH[2], 2.0), ("d", MONTH[2], 3.0), ("a", MONTH[3], 4.0), (None, MONTH[3], 5.0)], ROW)
    want = sorted([r for r in first if r[:2] != ("a", MONTH[2])] + [tuple(r) for r in new.collect()], key=str)
    for _ in range(2):
        stored.upsert(new, path, ["industry", "period_start"], "period_start")
        assert read(spark, path) == want
    after = files(path)
    untouched = {f for f in before if "2024-03" not in f}
    assert len(untouched) and all(after[f] == before[f] for f in untouched)
    stored.update(spark, path, "period_start", lambda rows: rows.withColumn("avg_score", F.when(F.col("industry") == "b", 9.0).otherwise(F.col("avg_score"))), F.expr("industry = 'b' and period_start < '2024-02-01'"))
    assert spark.read.schema(ROW).parquet(path).where("industry = 'b'").orderBy("period_start").head().avg_score == 9.0
    assert all(files(path)[f] == t for f, t in after.items() if "2024-01" not in f)


@pytest.mark.parametrize("when", ["staging", "between", "half"])
def test_upsert_that_breaks_off(spark, tmp_path, when, monkeypatch):
    """Broken off while it is staged, after that, or with a partition gone: the next upsert leaves one result."""
    path = str(tmp_path / "t")
    first = [(i, m, 1.0) for i in "ab" for m in MONTH[:3]]
    key = ["industry", "period_start"]
    stored.upsert(spark.createDataFrame(first, ROW), path, key, "period_start")
    new = spark.createDataFrame([("a", m, 2.0) for m in MONTH[1:]], ROW)
    with monkeypatch.context() as m:
        m.setattr(stored, "finish", lambda *a: None)
        if when == "staging":
            new.write.parquet(f"{path}.staged")
            os.remove(f"{path}.staged/_SUCCESS")
        else:
            stored.upsert(new, path, key, "period_start")
            if when == "half":
                stored._delete(spark, f"{path}/period_start=2024-02-01")
    if when != "staging":
        other = spark.createDataFrame([("z", MONTH[0], 7.0)], ROW)
        stored.upsert(other, path, key, "period_start")
        assert read(spark, path) == sorted([("a", MONTH[0], 1.0), ("z", MONTH[0], 7.0)] + [("b", m, 1.0) for m in MONTH[:3]] + [("a", m, 2.0) for m in MONTH[1:]], key=str)
    stored.upsert(new, path, key, "period_start")
    got = read(spark, path)
    assert [r for r in got if r[0] != "z"] == sorted([("a", MONTH[0], 1.0)] + [("b", m, 1.0) for m in MONTH[:3]] + [("a", m, 2.0) for m in MONTH[1:]], key=str)
    assert not os.path.exists(f"{path}.staged")


def test_archive_by_days(spark, tmp_path):
    path, as_of = str(tmp_path / "results"), dt.datetime(2024, 6, 1, 12)
    rows = [(i, as_of - dt.timedelta(days=i * 25), f"raw{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "result_id long, created_at timestamp_ntz, raw_data string")
    retention.store_results(df, path, ["result_id"])
    retention.store_results(df.limit(3), path, ["result_id"])  # again
    want = {r.result_id: (r.tier, r.raw_data) for r in retention.apply_tiers(df, as_of).collect()}
    moved = retention.archive(spark, path, as_of)
    assert {(r.tier, r.was) for r in moved.collect()} == {("compress", "keep"), ("clear", "keep"), ("delete", "keep")}
    got = {r.result_id: (r.tier, r.raw_data) for r in spark.read.parquet(path).collect()}
    assert got == want and spark.read.parquet(path).count() == len(want)
    before = files(path)
    assert retention.archive(spark, path, as_of).count() == 0 and files(path) == before
    later = as_of + dt.timedelta(days=10)
    retention.archive(spark, path, later)
    assert {r.result_id: (r.tier, r.raw_data) for r in spark.read.parquet(path).collect()} == {r.result_id: (r.tier, r.raw_data) for r in retention.apply_tiers(df, later).collect()}


# places in groups


@pytest.mark.parametrize("kind", ["one day", "one beginning"])
def test_places_of_a_hot_group(spark, kind):
    """Places of rows that all have one day, or names that all begin alike, are those of one sort; ranges are of about equal size."""
    rng = random.Random(kind)
    at = dt.datetime(2024, 5, 1)
    rows = [(rng.choice(["hot"] * 20 + ["a", None]), f"wwwwww{rng.randrange(10**6):06}" if kind != "one day" else "x", at + dt.timedelta(milliseconds=rng.randrange(10**7)), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, name string, at timestamp, i long")
    order = ["at" if kind == "one day" else "name", "i"]
    w = Window.partitionBy("g").orderBy(*order)
    for when in (None, F.col("i") % 3 == 0):
        got = ranks.numbered(df, ["g"], order, "n", when)
        want = df.withColumn("n", F.sum(F.lit(1) if when is None else when.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
