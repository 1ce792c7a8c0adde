"""Registered queries over operators that work by index, in rounds, in blocks, or on stored tables and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import czech_date
from ..operators import audit, benchmark, outreach, registry, retention, signals
from ..scratch import folder
from ..sources import stored, tables
from ..streaming import flows
from .queries import query, read_stream, rounded, table


@query("""WITH r AS (SELECT l_returnflag || l_linestatus AS industry, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem)
 SELECT industry, round(avg(v) + 1e-7, 4) AS avg_score, round(quantile_cont(v, 0.5), 4) AS median_score, count(*) AS sample_size, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.9), 4) AS p90 FROM r GROUP BY industry""")
def whole_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of few large groups, found in rounds of counting."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("industry"), F.col("l_extendedprice").cast("double").alias("total_score"))
    out = benchmark.statistics(rows, whole=True)
    return out.select("industry", rounded("avg_score").alias("avg_score"), F.round("median_score", 4).alias("median_score"), "sample_size", "percentiles.*")


@query("SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_last_hour FROM events")
def rolling_sends_of_one_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events are one user's: blocks of an hour."""
    e = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("user_id"), F.col("ts").alias("sent_at"))
    return outreach.rolling_sends(e).select("event_id", "in_last_hour")


_DOMAIN = "CASE c_custkey % 4 WHEN 0 THEN 'firma' || c_custkey || '.cz' WHEN 1 THEN 'shop-' || c_custkey || '7.sk' WHEN 2 THEN 'www.a' || c_custkey || 'b.com' ELSE lower(c_mktsegment) || c_custkey || '.eu' END"
_GLOB = "CASE p_partkey % 5 WHEN 0 THEN '?irma' || p_partkey || '.c*' WHEN 1 THEN '*-' || p_partkey || '[0-9].s?' WHEN 2 THEN 'www.a' || p_partkey || '[!0-9].*' WHEN 3 THEN '*g' || p_partkey || '.*' ELSE '*[!a-z]' || p_partkey || '*.org' END"


@query(f"WITH d AS (SELECT c_custkey, {_DOMAIN} AS domain, regexp_replace({_DOMAIN}, '^www[.]', '') AS bare FROM customer), g AS (SELECT {_GLOB} AS form FROM part) SELECT c_custkey, domain FROM d WHERE NOT EXISTS (SELECT 1 FROM g WHERE bare GLOB form OR ('www.' || bare) GLOB form)")
def many_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glob for each part, none of which has a key of its own: domains meet them on the rarest letters."""
    domains = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_DOMAIN).alias("domain"))
    return U.exclude_domains(domains, table(spark, sf_dir, "part").select(F.expr(_GLOB).alias("pattern")))


@query("""WITH s AS (SELECT o_orderkey, o_totalprice AS value, o_orderpriority AS industry, 'looking for a ' || p_name || ' of ' || p_type AS t FROM orders JOIN part ON p_partkey = o_custkey),
 f AS (SELECT p_partkey AS filter_id, p_size AS user_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE ['1-URGENT', '2-HIGH', '5-LOW'][p_partkey % 3 + 1] END AS user_industry, CASE WHEN p_size <= 45 THEN p_name END AS word, lower(p_type) AS bad, p_retailprice * p_size * 4 AS least FROM part)
 SELECT filter_id, user_id, count(*) AS n FROM s JOIN f ON (user_industry IS NULL OR user_industry = industry) AND value >= least AND (word IS NULL OR contains(lower(t), word)) AND NOT contains(lower(t), bad) GROUP BY ALL""")
def many_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter for each part, with words or without, and a signal for each order of a known part (M4)."""
    p = table(spark, sf_dir, "part")
    o = table(spark, sf_dir, "orders").join(p.select("p_partkey", "p_name", "p_type"), F.col("p_partkey") == F.col("o_custkey"))
    none = F.lit(None).cast("string")
    s = o.select(F.col("o_orderkey").alias("signal_id"), F.lit("rfp_web").alias("signal_type"), F.col("o_orderpriority").alias("industry"), none.alias("region"), F.expr("'looking for a ' || p_name").alias("title"), F.expr("'of ' || p_type").alias("description"), F.col("o_totalprice").cast("double").alias("value"))
    lists = F.array().cast("array<string>")
    f = p.select(
        F.col("p_partkey").alias("filter_id"), F.col("p_size").alias("user_id"), F.expr("CASE WHEN p_size % 3 = 0 THEN NULL ELSE element_at(array('1-URGENT', '2-HIGH', '5-LOW'), int(p_partkey % 3 + 1)) END").alias("user_industry"), F.lit(True).alias("active"), lists.alias("regions"), lists.alias("signal_types"),
        F.when(F.col("p_size") <= 45, F.array("p_name")).alias("keywords"), F.array("p_type").alias("exclude_keywords"), (F.col("p_retailprice") * F.col("p_size") * 4).cast("double").alias("min_value"), F.lit(None).cast("double").alias("max_value"),
    )
    return signals.match_counts(s, f)


@query("""WITH b AS (SELECT event_type AS industry, CAST(ts AS DATE) AS period_start, min(value) AS low, max(value) AS high FROM events GROUP BY ALL)
 SELECT industry, period_start, CASE WHEN period_start >= DATE '2024-01-20' THEN high ELSE low END AS score FROM b UNION ALL SELECT industry, period_start, 0.5 FROM (SELECT DISTINCT industry FROM b), (SELECT DATE '2024-02-01' AS period_start)""")
def stored_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back after two upserts, the second made twice: days from the 20th on are replaced, one is new, the others stay."""
    path = folder(spark, "benchmarks")
    days = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("industry"), F.to_date("ts").alias("period_start")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    key = ["industry", "period_start"]
    stored.upsert(days.select(*key, F.col("low").alias("score")), path, key, "period_start")
    later = days.where("period_start >= '2024-01-20'").select(*key, F.col("high").alias("score"))
    added = days.select("industry").distinct().select("industry", F.lit(dt.date(2024, 2, 1)).alias("period_start"), F.lit(0.5).alias("score"))
    for _ in range(2):
        stored.upsert(later.unionByName(added), path, key, "period_start")
    return spark.read.parquet(path).select(*key, "score")


_CREATED = "ts - to_days(CAST(user_id % 6 * 80 AS INT))"


@query(f"WITH r AS (SELECT event_id, {_CREATED} AS created_at, event_type FROM events), a AS (SELECT *, date_diff('day', CAST(created_at AS DATE), DATE '2024-02-20') AS age FROM r) SELECT event_id, created_at, CASE WHEN age >= 90 THEN NULL ELSE event_type END AS raw_data, CASE WHEN age >= 90 THEN 'clear' WHEN age >= 30 THEN 'compress' ELSE 'keep' END AS tier FROM a WHERE age < 365")
def archived_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table brought to the tiers of one day and then of a later one; whole days change their tier, or go (K1)."""
    path = folder(spark, "results")
    r = table(spark, sf_dir, "events").select("event_id", F.expr("ts - make_dt_interval(int(user_id % 6 * 80))").alias("created_at"), F.col("event_type").alias("raw_data"))
    retention.store_results(r, path, ["event_id"])
    for as_of in (dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 20)):
        retention.archive(spark, path, as_of)
    return spark.read.parquet(path).select("event_id", "created_at", "raw_data", "tier")


@query("SELECT o_orderkey AS signal_id, CAST(o_totalprice AS DOUBLE) AS value FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice >= 200000")
def high_value_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open signals from a value on (M6)."""
    return signals.high_value(_signals(spark, sf_dir), 200_000).select("signal_id", "value")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "F", "qualified").otherwise("expired")
    return o.select(F.col("o_orderkey").alias("signal_id"), status.alias("status"), F.col("o_totalprice").cast("double").alias("value"), F.when(F.col("o_orderpriority") != "5-LOW", F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ)")).alias("deadline"))


@query("""WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND (o_orderpriority = '5-LOW' OR o_orderdate > DATE '1996-06-01'))
 SELECT l_orderkey AS signal_id, l_linenumber AS user_id, CASE l_returnflag WHEN 'N' THEN 'new' ELSE 'reviewed' END AS status FROM lineitem WHERE l_returnflag IN ('N', 'R') AND l_orderkey IN (SELECT o_orderkey FROM s)""")
def actionable_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and reviewed subscriptions of active signals, with a deadline to come or none (M7)."""
    status = F.when(F.col("l_returnflag") == "N", "new").when(F.col("l_returnflag") == "R", "reviewed").otherwise("dismissed")
    subs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("signal_id"), F.col("l_linenumber").alias("user_id"), status.alias("status"))
    return signals.actionable(subs, _signals(spark, sf_dir), dt.datetime(1996, 6, 1))


@query("SELECT c_custkey AS company_id FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3")
def tagged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with one of their tags."""
    tags = F.array(F.when(F.col("c_nationkey") == 3, "BUILDING").otherwise("other"), F.col("c_mktsegment"))
    return outreach.notes_by_tag(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), tags.alias("tags")), "BUILDING").select("company_id")


_SITE = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site FROM pages), f AS (SELECT DISTINCT site, length(site) % 2 = 0 AS sitemap, length(site) % 3 = 0 AS robots FROM p)
 SELECT page_id, sitemap AS has_sitemap, robots AS has_robots FROM p JOIN f USING (site)""")
def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages, with sitemap.xml and robots.txt of some of their sites among them (A3)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    sites = pages.select(F.expr(_SITE).alias("site")).distinct()
    files = [sites.where(f"length(site) % {k} = 0").select(F.lit(-k).cast("long").alias("page_id"), F.concat("site", F.lit(name)).alias("url")) for k, name in ((2, "/sitemap.xml"), (3, "/robots.txt"))]
    found = audit.with_site_files(pages.unionByName(files[0]).unionByName(files[1]))
    return found.where("page_id >= 0").select("page_id", "has_sitemap", "has_robots")


@query("""SELECT code, CASE WHEN n_regionkey IS NULL THEN 'no texts' ELSE n_name END AS description FROM (SELECT 'c' || (c_nationkey * 2) AS code, c_nationkey * 2 AS k FROM customer) LEFT JOIN nation ON n_nationkey = k""")
def described_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with the texts of a table of one's own; codes that it lacks have none (A0)."""
    n = table(spark, sf_dir, "nation")
    texts = n.select(F.expr("'c' || n_nationkey").alias("code"), F.col("n_name").alias("title"), F.col("n_name").alias("description"), F.lit("").alias("impact"))
    found = registry.with_texts(table(spark, sf_dir, "customer").select(F.expr("'c' || (c_nationkey * 2)").alias("code")), texts)
    return found.select("code", F.coalesce("description", F.lit("no texts")).alias("description"))


_RAW = """CASE event_id % 7 WHEN 0 THEN 'no json' WHEN 1 THEN '{"Type":"SubscriptionConfirmation","Message":"x"}' WHEN 2 THEN '{"Type":"Notification","Message":"{broken"}' WHEN 3 THEN '{"Type":"Notification","Message":"{\\\\"mail\\\\":{\\\\"messageId\\\\":\\\\"m1\\\\"}}"}'
 WHEN 4 THEN '{"Type":"Notification","Message":"{\\\\"eventType\\\\":\\\\"Open\\\\",\\\\"mail\\\\":{}}"}' ELSE concat('{"Type":"Notification","Message":"{\\\\"eventType\\\\":\\\\"Click\\\\",\\\\"mail\\\\":{\\\\"messageId\\\\":\\\\"m', event_id, '\\\\"}}"}') END"""


@query("""SELECT CASE event_id % 7 WHEN 0 THEN 'envelope' WHEN 1 THEN 'type' WHEN 2 THEN 'message' WHEN 3 THEN 'kind' WHEN 4 THEN 'id' ELSE 'click' END AS outcome, CASE WHEN event_id % 7 > 4 THEN 'm' || event_id END AS message_id, count(*) AS n FROM events GROUP BY ALL""")
def stream_mail_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications as they arrive, and what is none with the reason."""
    path = folder(spark, "feed")
    raw = read_stream(spark, sf_dir, "events").select(F.expr(_RAW).alias("value"))
    flows.mail_feed(raw, path).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    taken = spark.read.parquet(f"{path}/events").select(F.col("type").alias("outcome"), "message_id")
    left = spark.read.parquet(f"{path}/rejected").select(F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("message_id"))
    return signals.counts(taken.unionByName(left), "outcome", "message_id")


@query("SELECT event_id, CASE event_id % 8 WHEN 7 THEN NULL WHEN 1 THEN date_trunc('minute', ts) WHEN 4 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 6 THEN date_trunc('second', ts) ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS at FROM events")
def dates_of_all_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the seven formats, and texts that fit none."""
    forms = ["dd.MM.yyyy", "dd.MM.yyyy HH:mm", "dd.MM.yyyy HH:mm:ss", "d.M.yyyy", "d.M.yyyy HH:mm", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"]
    text = F.lit("1st of May")
    for i, f in enumerate(forms):
        text = F.when(F.col("event_id") % 8 == i, F.date_format(F.col("ts").cast("timestamp_ntz"), f)).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", czech_date(F.concat(F.lit(" "), text)).alias("at"))
