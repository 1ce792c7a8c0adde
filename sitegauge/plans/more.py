"""Further registered queries: each reaches an operator with rows for which it decides one way, and rows for which it decides the other.

The rows are derived from the given tables, mostly by remainders of their keys; the SQL derives the same rows by itself.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import audit, benchmark, competitors, discovery, outreach, retention, scoring, snapshots
from ..operators.registry import CATEGORIES
from ..operators.rules import measured
from ..sources import tables
from ..streaming import flows, settle
from .queries import AS_OF, read_stream, query, table


def listed(items: dict[str, str]) -> str:
    """SQL for DuckDB: the list of the names whose conditions hold."""
    return "list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{name}' END" for name, when in items.items()) + "], lambda x: x IS NOT NULL)"


def array_of(items: dict[str, str]) -> F.Column:
    """The same for Spark."""
    return F.filter(F.array(*(F.when(F.expr(when), F.lit(name)) for name, when in items.items())), lambda x: x.isNotNull())


# --- functions ---------------------------------------------------------------------------------------------------------------

_URLS = """CASE page_id % 8 WHEN 0 THEN '  www.firma' || page_id || '.cz/a' WHEN 1 THEN 'https://localhost/x' WHEN 2 THEN 'http://192.168.0.1/x' WHEN 3 THEN 'https://m.facebook.com/p' WHEN 4 THEN 'https://firma.cz/obr.JPG'
 WHEN 5 THEN 'HTTP://WWW.Firma.cz/' || repeat('a', 600) || '?q=1#f' WHEN 6 THEN 'https://firma.cz/a?' || repeat('b', 600) || '#f' ELSE 'https://firma.cz/a#' || repeat('c', 600) END"""


@query(f"""WITH u AS (SELECT page_id, {_URLS} AS url FROM pages) SELECT page_id, CASE WHEN page_id % 8 = 0 THEN 'https://www.firma' || page_id || '.cz/a' ELSE url END AS normalised,
 CASE page_id % 8 WHEN 0 THEN 'firma' || page_id || '.cz' WHEN 1 THEN 'localhost' WHEN 2 THEN '192.168.0.1' WHEN 3 THEN 'm.facebook.com' ELSE 'firma.cz' END AS domain,
 CASE page_id % 8 WHEN 0 THEN 'https://www.firma' || page_id || '.cz/a' WHEN 5 THEN 'HTTP://WWW.Firma.cz' WHEN 6 THEN 'https://firma.cz/a' WHEN 7 THEN 'https://firma.cz/a' ELSE url END AS short,
 page_id % 8 IN (0, 3, 5, 6, 7) AS is_page, page_id % 8 = 3 AS skipped FROM u""")
def odd_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without scheme, local, by address, of skipped sites, of files, and too long in path, query or fragment."""
    u = table(spark, sf_dir, "pages").select("page_id", U.normalise_url(F.expr(_URLS)).alias("url"))
    name = U.domain(F.col("url"))
    return u.select("page_id", F.col("url").alias("normalised"), name.alias("domain"), U.truncate_url(F.col("url")).alias("short"), U.is_page_url(F.col("url")).alias("is_page"), U.is_skipped(name).alias("skipped"))


@query("""WITH d AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'alfa' WHEN 1 THEN 'www.beta' WHEN 2 THEN 'x1' WHEN 3 THEN 'nx12' WHEN 4 THEN 'zeta' ELSE 'm.shop' END || CASE WHEN c_custkey % 5 = 0 THEN '.net' ELSE '.cz' END AS domain FROM customer),
 b AS (SELECT *, regexp_replace(domain, '^www\\.', '') AS bare FROM d)
 SELECT c_custkey, domain FROM b WHERE NOT regexp_matches(bare, '^[ab].*\\.net$') AND NOT regexp_matches(bare, '^x[0-9]\\.cz$') AND NOT regexp_matches(bare, '^[^a-m]eta\\.cz$') AND bare <> 'm.shop.cz' AND bare NOT LIKE '%.shop.net'""")
def excluded_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs with classes, ranges and negated classes, a question mark's kin, plain names and tails."""
    name = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'alfa' WHEN 1 THEN 'www.beta' WHEN 2 THEN 'x1' WHEN 3 THEN 'nx12' WHEN 4 THEN 'zeta' ELSE 'm.shop' END || CASE WHEN c_custkey % 5 = 0 THEN '.net' ELSE '.cz' END")
    patterns = spark.createDataFrame([("[ab]*.net",), ("x[0-9].cz",), ("[!a-m]eta.cz",), ("M.Shop.cz",), ("*.shop.net",), ("",), ("q?.cz",)], "pattern string")
    return U.exclude_domains(table(spark, sf_dir, "customer").select("c_custkey", name.alias("domain")), patterns).select("c_custkey", "domain")


_SALARY = "CASE p_partkey % 3 WHEN 0 THEN p_size || ' 000 - ' || (p_size + 5) || ' 500 Kč' WHEN 1 THEN p_size || ' 000,50 Kč' ELSE 'dohodou' END"


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 1000 + 0.5 END AS low, CASE WHEN p_partkey % 3 = 0 THEN (p_size + 5) * 1000 + 500.0 END AS high FROM part WHERE p_size > 0")
def salary_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range, one amount, none."""
    p = table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", T.salary_range(F.expr(_SALARY)).alias("r"))
    return p.select("p_partkey", "r.low", "r.high")


@query("SELECT c_custkey, c_name || 'x' || chr(9) || 'y' AS name FROM customer")
def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters go, a tab stays."""
    dirty = table(spark, sf_dir, "customer").select("c_custkey", F.expr("c_name || chr(1) || 'x' || chr(9) || chr(12) || 'y' || chr(31)").alias("name"))
    return tables.cleaned(dirty, "name")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def written_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by partitions and read again."""
    path = settle.folder(spark)
    tables.write_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    back = tables.read_table(spark, path, "o_orderkey long, o_totalprice double, o_orderstatus string")
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_ISSUES = "i AS (SELECT user_id AS analysis_id, event_type AS category, 'c' || event_id AS code, CASE WHEN value > 60 THEN 'critical' WHEN value > 20 THEN 'recommended' ELSE 'optimization' END AS severity, CASE WHEN value > 60 THEN -10 WHEN value > 20 THEN -3 ELSE -1 END AS weight, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id END AS evidence FROM events)"
_LISTED = "l AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END, category, code) AS position FROM i)"


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    severity = F.expr("CASE WHEN value > 60 THEN 'critical' WHEN value > 20 THEN 'recommended' ELSE 'optimization' END")
    i = e.select(F.col("user_id").alias("analysis_id"), F.col("event_type").alias("category"), F.expr("'c' || event_id").alias("code"), severity.alias("severity"), F.expr("CASE WHEN value > 60 THEN -10 WHEN value > 20 THEN -3 ELSE -1 END").alias("weight"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'e' || event_id END").alias("evidence"))
    runs = e.select(F.col("user_id").alias("analysis_id")).distinct().withColumn("status", F.when(F.col("analysis_id") % 2 == 0, "completed").otherwise("failed"))
    return tables.report(i, runs)[1]


@query(f"WITH {_ISSUES}, {_LISTED} SELECT analysis_id, position, category, code, severity, weight, evidence, CASE WHEN analysis_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS status FROM l")
def report_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's issues from severe to mild."""
    return _report(spark, sf_dir).select("analysis_id", "position", "category", "code", "severity", "weight", "evidence", "status")


@query(f"WITH {_ISSUES}, {_LISTED} SELECT analysis_id, '# Audit ' || analysis_id || chr(10) || string_agg('- **' || severity || '** ' || code || coalesce(': ' || evidence, ''), chr(10) ORDER BY position) AS report FROM l GROUP BY analysis_id")
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as Markdown."""
    return tables.report_markdown(_report(spark, sf_dir))


# --- runs ---------------------------------------------------------------------------------------------------------------------

_FOUND = {"ssl_not_https": "event_id % 2 = 0", "seo_short_title": "event_id % 3 = 0"}  # a critical and a recommended code


@query("""WITH r AS (SELECT event_id // 4 AS analysis_id, event_type <> 'error' AS done, event_id % 10 AS score, event_id % 7 > 0 AS listed, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b FROM events)
 SELECT analysis_id, CAST(coalesce(sum(score) FILTER (done), 0) AS BIGINT) AS total_score, CAST(sum(CASE WHEN listed THEN CAST(a AS INT) + CAST(b AS INT) ELSE 0 END) AS BIGINT) AS issue_count, count(*) FILTER (listed AND a) AS critical_issue_count,
  count(*) FILTER (done) AS completed, count(*) FILTER (NOT done) AS failed, CASE WHEN bool_or(done) THEN 'completed' ELSE 'failed' END AS status FROM r GROUP BY analysis_id""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose results are completed, failed, or without a list; a run fails if all of it has failed."""
    codes = F.transform(array_of(_FOUND), lambda c: F.struct(c.alias("code"), F.lit(None).cast("string").alias("evidence")))
    r = table(spark, sf_dir, "events").select(
        F.expr("event_id div 4").alias("analysis_id"), F.col("event_type").alias("category"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        (F.col("event_id") % 10).alias("score"), F.when(F.col("event_id") % 7 > 0, codes).alias("issues"),
    )
    return scoring.analysis_totals(r)


@query("""WITH c AS (SELECT event_id // 4 AS analysis_id, 'c' || event_id % 3 AS code, event_id % 4 * 2 AS pos FROM events WHERE event_id % 11 > 0 UNION ALL SELECT event_id // 4, 'd' || event_id % 2, event_id % 4 * 2 + 1 FROM events WHERE event_id % 11 > 0),
 f AS (SELECT analysis_id, code, min(pos) AS pos FROM c GROUP BY ALL) SELECT analysis_id, string_agg(code, ',' ORDER BY pos) AS codes FROM f GROUP BY analysis_id""")
def run_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct codes by order of categories, then place."""
    codes = F.array(F.expr("'c' || event_id % 3"), F.expr("'d' || event_id % 2"))
    issues = F.when(F.col("event_id") % 11 > 0, F.transform(codes, lambda c: F.struct(c.alias("code"))))
    r = table(spark, sf_dir, "events").select(F.expr("event_id div 4").alias("analysis_id"), F.get(F.array(*(F.lit(c) for c in CATEGORIES[:4])), F.col("event_id") % 4).alias("category"), issues.alias("issues"))
    return scoring.issue_codes(r).select("analysis_id", F.array_join("codes", ",").alias("codes"))


@query("""WITH r AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) SELECT event_id, CASE WHEN old IS NOT NULL THEN event_id % 2 = 0 AND old % 2 <> 0 END AS has_new_critical,
 CASE WHEN old IS NOT NULL THEN (event_id % 2 = 0 AND old % 2 <> 0) OR (event_id % 3 = 0 AND old % 3 <> 0) END AS has_new_code FROM r""")
def new_criticals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that have a code, or a critical one, which the run before hadn't."""
    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("analysis_id"), F.col("user_id").alias("lead_id"), F.col("ts").alias("created_at"), F.col("value").alias("total_score"), array_of({k: v for k, v in _FOUND.items()}).alias("codes"))
    return scoring.deltas(r).select(F.col("analysis_id").alias("event_id"), "has_new_critical", "has_new_code")


# --- benchmarks ---------------------------------------------------------------------------------------------------------------

_BY_STATUS = "SELECT o_orderpriority AS industry, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start, count(*) AS sample_size FROM orders WHERE o_orderstatus = '{}' AND o_orderkey % 3 > {} GROUP BY ALL"


@query(f"""WITH o AS ({_BY_STATUS.format('O', 0)}), n AS ({_BY_STATUS.format('F', 1)}) SELECT industry, period_start, coalesce(n.sample_size, o.sample_size) AS sample_size,
 CASE WHEN n.sample_size IS NULL THEN 'kept' WHEN o.sample_size IS NULL THEN 'created' ELSE 'updated' END AS outcome FROM n FULL JOIN o USING (industry, period_start)""")
def upserted_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that both, one or the other of stored and new benchmarks have."""
    o = table(spark, sf_dir, "orders")
    of = lambda s, least: o.where(f"o_orderstatus = '{s}' and o_orderkey % 3 > {least}").groupBy(F.col("o_orderpriority").alias("industry"), F.trunc("o_orderdate", "month").alias("period_start")).agg(F.count("*").alias("sample_size"))
    return benchmark.upsert(of("O", 0), of("F", 1)).select("industry", "period_start", "sample_size", "outcome")


@query("""WITH b AS (SELECT o_custkey AS industry, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY period_start DESC) AS r FROM b)
 SELECT c_custkey AS industry, period_start, n FROM customer LEFT JOIN (SELECT * FROM l WHERE r = 1) ON industry = c_custkey""")
def benchmarks_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest benchmark of every industry, or none."""
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("industry"), F.trunc("o_orderdate", "month").alias("period_start")).agg(F.count("*").alias("n"))
    return benchmark.all_industries(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("industry")), b).select("industry", "period_start", "n")


# --- discovery ----------------------------------------------------------------------------------------------------------------

@query("""WITH c AS (SELECT c_custkey, c_nationkey AS user_id, c_custkey % 300 AS d FROM customer), l AS (SELECT s_nationkey AS user_id, s_suppkey * 3 % 300 AS d FROM supplier)
 SELECT c_custkey, 'user' AS known_to FROM c SEMI JOIN l USING (user_id, d) UNION ALL SELECT c_custkey, 'anyone' FROM c SEMI JOIN l USING (d) UNION ALL SELECT c_custkey, 'nobody' FROM c ANTI JOIN l USING (d)""")
def known_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose domain the user, anyone, nobody has."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("user_id"), F.expr("'d' || c_custkey % 300 || '.cz'").alias("domain"))
    leads = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("user_id"), F.expr("'d' || s_suppkey * 3 % 300 || '.cz'").alias("domain"))
    some = lambda name, **how: discovery.known(c, leads, **how).select("c_custkey", F.lit(name).alias("known_to"))
    return some("user").unionByName(some("anyone", per_user=False)).unionByName(some("nobody", per_user=False, negate=True))


_CATALOGUE = "CASE c_custkey % 5 WHEN 0 THEN 'firmy.cz' WHEN 1 THEN 'sub.firmy.cz' WHEN 2 THEN 'notfirmy.cz' WHEN 3 THEN 'www.ekatalog.cz' ELSE 'd' || c_custkey || '.cz' END"


@query(f"SELECT c_custkey, {_CATALOGUE} AS domain FROM customer WHERE c_custkey % 5 > 1")
def outside_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogues of the sources in use are excluded with all below them; another's isn't (D3)."""
    c = table(spark, sf_dir, "customer")
    sources = c.select(F.expr("CASE c_custkey % 4 WHEN 0 THEN 'firmy_cz' WHEN 1 THEN 'google' ELSE 'crawler' END").alias("source"))
    return U.exclude_domains(c.select("c_custkey", F.expr(_CATALOGUE).alias("domain")), discovery.catalogue_patterns(sources)).select("c_custkey", "domain")


_SOURCE = "CASE c_custkey % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'firmy_cz' WHEN 2 THEN 'reference_crawler' WHEN 3 THEN 'seznam_skol' ELSE 'manual' END"


@query(f"""WITH c AS (SELECT c_custkey, {_SOURCE} AS source, c_custkey % 2 = 0 AS agency FROM customer), f(source, catalogue_domain, query_based, category_based) AS (VALUES ('google', NULL, TRUE, FALSE), ('firmy_cz', 'firmy.cz', TRUE, FALSE), ('reference_crawler', NULL, FALSE, FALSE), ('seznam_skol', 'seznamskol.cz', FALSE, TRUE), ('manual', NULL, FALSE, FALSE))
 SELECT c_custkey, source, catalogue_domain, query_based, category_based FROM c JOIN f USING (source) WHERE agency OR source <> 'reference_crawler'""")
def usable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their flags; client references are for web designers only."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_SOURCE).alias("source"))
    agencies = c.where("c_custkey % 2 = 0").join(F.broadcast(discovery.sources_for(spark, "webdesign")), "source")
    others = c.where("c_custkey % 2 <> 0").join(F.broadcast(discovery.sources_for(spark, "eshop")), "source")
    return agencies.unionByName(others).select("c_custkey", "source", "catalogue_domain", "query_based", "category_based")


@query("""WITH p AS (SELECT c_custkey AS page_id, c_custkey % 200 AS s, c_custkey * 7 % 250 AS a, c_custkey * 3 % 260 AS b FROM customer WHERE c_custkey % 200 % 2 = 0),
 e AS (SELECT page_id, s, a AS t, 1 AS place, 'https://d' || a || '.cz/a' AS url FROM p UNION ALL SELECT page_id, s, b, 3, 'https://www.d' || b || '.cz/' FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY page_id, place, url) AS n FROM e WHERE s <> t)
 SELECT 'd' || t || '.cz' AS target_domain, url, 'd' || s || '.cz' AS source_domain, page_id AS found_on FROM r WHERE n = 1""")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of done leads to other domains, neither their own nor skipped ones, each with its first source."""
    c = table(spark, sf_dir, "customer")
    html = "'<a href=\"/own\">x</a><a href=\"https://d' || c_custkey * 7 % 250 || '.cz/a\">x</a><a href=\"https://www.facebook.com/x\">x</a><a href=\"https://www.d' || c_custkey * 3 % 260 || '.cz/\">x</a>'"
    pages = c.select(F.col("c_custkey").alias("page_id"), F.expr("'https://www.d' || c_custkey % 200 || '.cz/p'").alias("url"), F.expr(html).alias("html"))
    leads = c.select(F.expr("'d' || c_custkey % 200 || '.cz'").alias("domain"), F.when(F.col("c_custkey") % 200 % 2 == 0, "done").otherwise("new").alias("status")).distinct()
    return discovery.link_graph(pages, leads)


@query("""WITH h AS (SELECT c_custkey AS i FROM customer WHERE c_custkey % 5 > 0) SELECT 'client' || i || '.cz' AS domain, 'https://client' || i || '.cz/' AS url, 'a' || i || '.cz' AS agency_domain FROM h WHERE i % 3 > 0""")
def agency_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference pages by path, by the words of a link and by the class of its tag; other links and pages of no agency lead to none.

    A site has its home page (number 2i) and one further page, to which the home page links; both link to clients.
    """
    c = table(spark, sf_dir, "customer").withColumn("i", F.col("c_custkey"))
    site = "'https://www.a' || i || '.cz/'"
    # of the three kinds of sites one has neither path, words nor class of a reference page
    link = "CASE i % 3 WHEN 0 THEN '<a href=\"/x\">Kontakt</a>' WHEN 1 THEN CASE WHEN i % 2 = 0 THEN '<a href=\"/x\">Naše <b>Reference</b></a>' ELSE '<a class=\"nav-portfolio\" href=\"/x\">Kdo</a>' END ELSE '<a href=\"/nase-prace-2024\">x</a>' END"
    target = "CASE i % 3 WHEN 2 THEN 'nase-prace-2024' ELSE 'x' END"
    home = c.select((2 * F.col("i")).alias("page_id"), F.expr(site).alias("url"), F.concat(F.expr(link), F.lit('<a href="https://www.other.cz/">x</a>')).alias("html"))
    inner = c.select((2 * F.col("i") + 1).alias("page_id"), F.concat(F.expr(site), F.expr(target)).alias("url"), F.expr("'<a href=\"https://client' || i || '.cz/\">x</a><a href=\"https://www.facebook.com/a\">x</a><a href=\"/y\">x</a>'").alias("html"))
    agencies = c.where("i % 5 > 0").select(F.expr("'a' || i || '.cz'").alias("domain"))
    return discovery.client_references(home.unionByName(inner), agencies).select("domain", "url", "agency_domain")


_LIMITED = "CASE WHEN n > 1 THEN 'duplicate' WHEN k.d IS NOT NULL THEN 'known' ELSE 'saved' END"


@query(f"""WITH c AS (SELECT o_orderkey, o_custkey % 30 AS user_id, o_orderkey % 700 AS d FROM orders), k AS (SELECT DISTINCT s_suppkey % 30 AS user_id, s_suppkey * 5 % 700 AS d FROM supplier), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY o_orderkey) AS n FROM c),
 o AS (SELECT f.user_id, o_orderkey, {_LIMITED} AS outcome FROM f LEFT JOIN k ON k.user_id = f.user_id AND k.d = f.d), l AS (SELECT *, sum(CAST(outcome = 'saved' AS INT)) OVER (PARTITION BY user_id ORDER BY o_orderkey) AS place FROM o)
 SELECT o_orderkey AS position, user_id, CASE WHEN outcome = 'saved' AND place > 20 THEN 'over_limit' ELSE outcome END AS outcome FROM l""")
def limited_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are known, repeated, saved, or beyond the user's limit."""
    c = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("user_id"), F.expr("'https://d' || o_orderkey % 700 || '.cz/'").alias("url"), F.lit("google").alias("source"), F.lit(False).alias("is_catalogue"), F.col("o_orderkey").alias("position"))
    leads = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 30).alias("user_id"), F.expr("'d' || s_suppkey * 5 % 700 || '.cz'").alias("domain"))
    return discovery.outcomes(c, leads, spark.createDataFrame([("nothing.here",)], "pattern string"), 20).select("position", "user_id", "outcome")


# --- competitors --------------------------------------------------------------------------------------------------------------

@query("""SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || ',"m":[{"key":"a","value":"' || p_name || '"},{"key":"b","value":"' || p_type || '"}]}') AS content_hash FROM part""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash doesn't depend on the order in which a map was filled."""
    m = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("a"), "p_name", F.lit("b"), "p_type")).otherwise(F.create_map(F.lit("b"), "p_type", F.lit("a"), "p_name"))
    return table(spark, sf_dir, "part").withColumn("m", m).select("p_partkey", competitors.content_hash("p_brand", "p_size", maps=["m"]).alias("content_hash"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey & 63 AS b, o_orderkey >> 6 & 63 AS a FROM orders), y AS (SELECT o_orderkey, bit_count(xor(a, b)) AS n, bit_count(xor(a, b)) * 100.0 / greatest(bit_count(a), bit_count(b), 1) AS p FROM x)
 SELECT o_orderkey, CASE WHEN p >= 50 OR n >= 5 THEN 'high' WHEN p >= 20 OR n >= 3 THEN 'medium' ELSE 'low' END AS significance FROM y""")
def array_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of six items by the key's bits, with a repeated item (C4)."""
    items = lambda shift: F.concat(*(F.when(F.expr(f"shiftright(o_orderkey, {shift + i}) & 1 = 1"), F.array(F.lit(f"i{i}"), F.lit(f"i{i}"))).otherwise(F.array().cast("array<string>")) for i in range(6)))
    return table(spark, sf_dir, "orders").select("o_orderkey", competitors.array_significance(items(0), items(6)).alias("significance"))


_PAIRS = "w AS (SELECT o_custkey AS domain, o_orderkey AS i, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS j FROM orders)"
_SIZE = "CASE WHEN p >= 50 THEN 'critical' WHEN p >= 25 THEN 'high' WHEN p >= 10 THEN 'medium' ELSE 'low' END"


def _added(field: str, names: list[str], high: int | None) -> str:
    """SQL: rows of what is added and removed, the items being names with remainders."""
    items = lambda k: "[" + ", ".join(f"'{n}' || {k} % {m}" for n, m in names) + "]"
    weight = f"CASE WHEN len(x) >= {high} THEN 'high' ELSE 'medium' END" if high else "'medium'"
    one = "SELECT domain, i AS taken_at, '{0}' AS field, {1} AS before, {2} AS after, {3} AS significance FROM (SELECT *, list_filter({4}, lambda v: NOT list_contains({5}, v)) AS x FROM w WHERE j IS NOT NULL) WHERE len(x) > 0"
    out = one.format(f"{field}_added", "NULL", "array_to_string(x, ', ')", weight, items("i"), items("j"))
    return out if not high else f"{out} UNION ALL {one.format(f'{field}_removed', 'array_to_string(x, chr(44) || chr(32))', 'NULL', weight, items('j'), items('i'))}"


def _facts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("domain"), F.col("o_orderkey").alias("taken_at"), *(F.expr(e).alias(c) for c, e in columns.items()))


@query(f"""WITH {_PAIRS} SELECT domain, i AS taken_at, 'total_count' AS field, CAST(j % 5 AS VARCHAR) AS before, CAST(i % 5 AS VARCHAR) AS after, {_SIZE} AS significance FROM (SELECT *, CASE WHEN j % 5 > 0 THEN abs(i % 5 - j % 5) * 100.0 / (j % 5) ELSE 100 END AS p FROM w WHERE j IS NOT NULL) WHERE i % 5 <> j % 5
 UNION ALL {_added('clients', [('c', 4), ('d', 3), ('e', 5)], 3)} UNION ALL SELECT domain, i, 'categories', 'k' || j % 2, 'k' || i % 2, 'medium' FROM w WHERE i % 2 <> j % 2""")
def portfolio_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, clients and categories that change, and such that don't."""
    f = _facts(spark, sf_dir, total_count="o_orderkey % 5", clients="array('c' || o_orderkey % 4, 'd' || o_orderkey % 3, 'e' || o_orderkey % 5)", categories="array('k' || o_orderkey % 2)")
    return competitors.portfolio_changes(f)


@query(f"WITH {_PAIRS} {_added('services', [('s', 4), ('t', 3), ('u', 2)], 3)} UNION ALL {_added('technologies', [('v', 7)], 3)} UNION ALL {_added('certifications', [('z', 3)], None)}")
def service_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services, technologies and certifications added and removed."""
    f = _facts(spark, sf_dir, services="array('s' || o_orderkey % 4, 't' || o_orderkey % 3, 'u' || o_orderkey % 2)", technologies="array('v' || o_orderkey % 7)", certifications="array('z' || o_orderkey % 3)")
    return competitors.service_changes(f)


_PRICES = "CASE p_partkey % 4 WHEN 0 THEN '<div class=\"pricing\">x</div>' WHEN 1 THEN '<p>za hodinu</p>' WHEN 2 THEN '<p>projekt</p>' ELSE '' END || '<b>' || (p_size + 1) || ' 500 Kč</b>' || CASE WHEN p_partkey % 3 = 0 THEN '<b>' || (p_size + 40) || ' €</b>' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '<p>na míru</p>' ELSE '' END"


@query("""WITH p AS (SELECT p_partkey AS page_id, (p_size + 1) * 1000.0 + 500 AS a, CASE WHEN p_partkey % 3 = 0 THEN p_size + 40.0 END AS b FROM part) SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'tiered' WHEN 1 THEN 'hourly' WHEN 2 THEN 'project' ELSE 'fixed' END AS pricing_type,
 page_id % 5 = 0 AS has_custom_quote, CASE WHEN b IS NULL THEN 'CZK' ELSE 'EUR' END AS currency, CAST(CASE WHEN b IS NULL THEN 1 ELSE 2 END AS INT) AS n, least(a, coalesce(b, a)) AS price_min, greatest(a, coalesce(b, a)) AS price_max FROM p""")
def price_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiered, hourly, project and fixed prices in two currencies, with and without individual quotes."""
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.expr(_PRICES).alias("html"))
    return competitors.price_facts(pages).select("page_id", "pricing_type", "has_custom_quote", "currency", F.size("prices").alias("n"), "price_min", "price_max")


@query("""SELECT p_partkey AS domain, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS INT) AS clients_count, CAST(1 + p_partkey % 2 AS INT) AS packages_count, CASE WHEN p_partkey % 2 = 1 THEN least(p_size, 25) ELSE p_size END AS price_min, CASE WHEN p_partkey % 2 = 1 THEN greatest(p_size, 25) ELSE p_size END AS price_max FROM part""")
def fact_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lists, one of them missing at times, and ends of prices (C11)."""
    one, two = F.expr("named_struct('name', p_name, 'price', p_size)"), F.expr("named_struct('name', p_type, 'price', 25)")
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("domain"), F.when(F.col("p_partkey") % 3 > 0, F.array("p_name", "p_type")).alias("clients"), F.when(F.col("p_partkey") % 2 == 1, F.array(one, two)).otherwise(F.array(one)).alias("packages"))
    return competitors.metrics(f.withColumn("clients", F.coalesce("clients", F.array().cast("array<string>"))))


@query("""WITH c AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS significance FROM events) SELECT event_id, significance FROM c WHERE significance IN ('critical', 'high') AND ts >= TIMESTAMP '2024-01-10'""")
def severe_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from high on, since a time (C14)."""
    c = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("taken_at"), F.expr("CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END").alias("significance"))
    return competitors.changes_at_least(c, "high", dt.datetime(2024, 1, 10)).select("event_id", "significance")


def _terms_text(terms: list[str], stems: bool = False) -> str:
    return "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(t, '{k.lower()}') THEN '{v}' END" for k, v in (terms.items() if stems else ((x, x) for x in dict.fromkeys(terms)))) + "], lambda x: x IS NOT NULL)))"


@query("WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, " + ", ".join(f"array_to_string({_terms_text(terms, stems)}, ';') AS {name}" for name, terms, stems in (
    ("technologies", competitors.TECHNOLOGIES, False), ("methodologies", competitors.METHODOLOGIES, False), ("industries", competitors.INDUSTRY_STEMS, True), ("certifications", competitors.CERTIFICATIONS, False))) + " FROM d")
def vocabulary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms themselves."""
    facts = competitors.vocabulary_facts(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("html")), "doc_id")
    return facts.select("doc_id", *(F.array_join(F.array_sort(c), ";").alias(c) for c in ("technologies", "methodologies", "industries", "certifications")))


# --- outreach -----------------------------------------------------------------------------------------------------------------

@query("""WITH o AS (SELECT o_orderkey AS offer_id, CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'P' THEN 'opened' ELSE 'draft' END AS status, CASE WHEN o_orderstatus IN ('F', 'P') THEN TIMESTAMP '2024-01-01' END AS sent_at, CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2024-01-20' END AS opened_at FROM orders),
 h AS (SELECT event_id % 3000 AS t, min(ts) FILTER (event_type IN ('view', 'click')) AS o, min(ts) FILTER (event_type = 'click') AS c FROM events GROUP BY 1), j AS (SELECT offer_id, status, sent_at, CASE WHEN sent_at IS NULL THEN opened_at ELSE least(opened_at, o) END AS opened_at, CASE WHEN sent_at IS NOT NULL THEN c END AS clicked_at FROM o LEFT JOIN h ON t = offer_id)
 SELECT offer_id, CASE WHEN status IN ('sent', 'opened') AND clicked_at IS NOT NULL THEN 'clicked' WHEN status = 'sent' AND opened_at IS NOT NULL THEN 'opened' ELSE status END AS status, opened_at, clicked_at FROM j""")
def folded_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on offers that were sent, opened, never sent; offers without a hit; hits without an offer (E5)."""
    at = lambda when, day: F.when(F.expr(when), F.lit(dt.datetime(2024, 1, day)))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("offer_id"), F.expr("'t' || o_orderkey").alias("tracking_token"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'P' THEN 'opened' ELSE 'draft' END").alias("status"),
        at("o_orderstatus in ('F', 'P')", 1).cast("timestamp_ntz").alias("sent_at"), at("o_orderstatus = 'P'", 20).cast("timestamp_ntz").alias("opened_at"), F.lit(None).cast("timestamp_ntz").alias("clicked_at"),
    )
    hits = table(spark, sf_dir, "events").select(F.expr("'t' || event_id % 3000").alias("token"), F.expr("CASE event_type WHEN 'view' THEN 'open' ELSE event_type END").alias("type"), F.col("ts").cast("timestamp_ntz").alias("event_time"))
    return outreach.fold_offers(o, hits).select("offer_id", "status", "opened_at", "clicked_at")


_ENTRIES = "b AS (SELECT 'u' || o_orderkey AS email, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS user_id, CASE o_orderstatus WHEN 'F' THEN 'hard_bounce' WHEN 'P' THEN 'complaint' ELSE 'unsubscribe' END AS type FROM orders)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.expr("'u' || o_orderkey").alias("email"), F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END").alias("user_id"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'hard_bounce' WHEN 'P' THEN 'complaint' ELSE 'unsubscribe' END").alias("type"), F.col("o_orderdate").alias("created_at"))


@query(f"WITH {_ENTRIES} SELECT email, 'all' AS of FROM b WHERE user_id IS NULL AND type IN ('hard_bounce', 'complaint') UNION ALL SELECT email, 'user' FROM b WHERE user_id = 7")
def suppression_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global entries of some types, and those of one user."""
    b = _entries(spark, sf_dir)
    return outreach.suppression_list(b, None, ["hard_bounce", "complaint"]).select("email", F.lit("all").alias("of")).unionByName(outreach.suppression_list(b, 7).select("email", F.lit("user").alias("of")))


@query(f"WITH {_ENTRIES} SELECT type, user_id IS NULL AS is_global, count(*) AS n FROM b GROUP BY ALL")
def suppression_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outreach.suppression_counts(_entries(spark, sf_dir))


@query("""WITH l AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS i FROM orders GROUP BY o_custkey) SELECT c_nationkey AS user_id, string_agg((i % 60 - 5) || ':d' || o_custkey || '.cz', ',' ORDER BY i % 60 - 5, 'd' || o_custkey || '.cz') AS certificates
 FROM l JOIN customer ON c_custkey = o_custkey WHERE i % 2 = 0 AND i % 60 - 5 BETWEEN 1 AND 30 GROUP BY c_nationkey""")
def expiring_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates of the latest runs that have expired, soon will, or won't; runs without one."""
    o = table(spark, sf_dir, "orders")
    results = o.select(F.col("o_orderkey").alias("analysis_id"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'http' ELSE 'seo' END").alias("category"), F.expr("'{\"ssl\":{\"expiresDays\":' || (o_orderkey % 60 - 5) || '}}'").alias("raw_data"))
    runs = o.select(F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("lead_id"), F.col("o_orderdate").alias("created_at"))
    leads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lead_id"), F.col("c_nationkey").alias("user_id"), F.expr("'d' || c_custkey || '.cz'").alias("domain"))
    found = outreach.expiring_certificates(results, runs, leads)
    return found.select("user_id", F.array_join(F.transform("certificates", lambda c: F.concat_ws(":", c["days"].cast("string"), c["domain"])), ",").alias("certificates"))


@query("""WITH o AS (SELECT o_orderkey AS offer_id, o_custkey % 25 AS user_id, o_orderkey % 500 AS u, o_orderkey % 9 AS d, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 500 >= 50),
 k AS (SELECT n_nationkey AS user_id, n_regionkey * 3 AS h, n_regionkey * 12 AS y FROM nation), m AS (SELECT n_nationkey AS user_id, n_nationkey % 9 AS d, n_regionkey AS m FROM nation),
 r AS (SELECT o.*, coalesce(h, 0) AS h, coalesce(y, 0) AS y, coalesce(m, 0) AS m FROM o LEFT JOIN k USING (user_id) LEFT JOIN m USING (user_id, d)), a AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY created_at, offer_id) AS i FROM r WHERE h < 10 AND y < 50 AND m < 3),
 p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, offer_id) AS position FROM a WHERE i <= 3 - m) SELECT offer_id, user_id, position FROM p WHERE position <= least(10 - h, 50 - y)""")
def send_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved offers in turn, without suppressed recipients, within what is left of each limit."""
    n = table(spark, sf_dir, "nation")
    offers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("offer_id"), (F.col("o_custkey") % 25).alias("user_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft").alias("status"), F.expr("'u' || o_orderkey % 500 || '@d' || o_orderkey % 9 || '.cz'").alias("recipient_email"), F.col("o_orderdate").alias("created_at"))
    black = offers.where("offer_id % 500 < 50").select(F.upper("recipient_email").alias("email"), F.lit(None).cast("long").alias("user_id")).distinct()
    by_user = n.select(F.col("n_nationkey").alias("user_id"), (F.col("n_regionkey") * 3).alias("per_hour"), (F.col("n_regionkey") * 12).alias("per_day"))
    by_domain = n.select(F.col("n_nationkey").alias("user_id"), F.expr("'d' || n_nationkey % 9 || '.cz'").alias("domain"), F.col("n_regionkey").alias("per_domain_day"))
    return outreach.send_queue(offers, black, by_user, by_domain, None, AS_OF).select("offer_id", "user_id", "position")


@query("""SELECT o_orderkey, CASE WHEN d >= 90 THEN 'clear' WHEN d >= 30 THEN 'compress' ELSE 'keep' END AS tier, CASE WHEN d < 90 THEN o_orderpriority END AS raw_data FROM (SELECT *, date_diff('day', o_orderdate, TIMESTAMP '1998-06-01') AS d FROM orders) WHERE d < 365""")
def applied_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old results go, less old ones lose their payload (K1)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("raw_data"))
    return retention.apply_tiers(o, dt.datetime(1998, 6, 1)).select("o_orderkey", "tier", "raw_data")


# --- measurements and rule configuration ----------------------------------------------------------------------------------------

@query("""WITH f AS (SELECT o_custkey AS page_id, CASE o_orderkey % 5 WHEN 0 THEN 'color-contrast' WHEN 1 THEN 'image-alt' WHEN 2 THEN 'label' WHEN 3 THEN 'my-rule' ELSE 'other-rule' END AS rule_id, o_orderkey % 4 AS impact, o_orderkey % 7 + 1 AS nodes FROM orders)
 SELECT page_id, 'a11y_' || replace(rule_id, '-', '_') AS code, CASE WHEN rule_id LIKE '%-rule' THEN CASE WHEN impact < 2 THEN 'critical' WHEN impact = 2 THEN 'recommended' ELSE 'optimization' END END AS severity, nodes || ' nodes' AS evidence FROM f""")
def accessibility_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the registry has, and others, which go by impact."""
    return measured.accessibility_issues(_findings(spark, sf_dir)).select("page_id", "code", "severity", "evidence")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = "CASE o_orderkey % 5 WHEN 0 THEN 'color-contrast' WHEN 1 THEN 'image-alt' WHEN 2 THEN 'label' WHEN 3 THEN 'my-rule' ELSE 'other-rule' END"
    impact = F.get(F.array(*(F.lit(x) for x in ("critical", "serious", "moderate", "minor"))), F.col("o_orderkey") % 4)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.expr(rule).alias("rule_id"), impact.alias("impact"), (F.col("o_orderkey") % 7 + 1).alias("nodes"))


@query("SELECT o_custkey AS page_id, " + ", ".join(f"count(*) FILTER (o_orderkey % 4 = {i}) AS {n}" for i, n in enumerate(("critical", "serious", "moderate", "minor"))) + " FROM orders GROUP BY o_custkey")
def accessibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured.accessibility_counts(_findings(spark, sf_dir))


_STYLE = {
    "grid": "p_partkey % 2", "flex": "p_partkey % 3", "float": "p_size", "table_display": "p_partkey % 9", "css_variables": "p_partkey % 2", "gradients": "p_partkey % 5", "transitions": "p_partkey % 2", "animations": "p_partkey % 3", "box_shadow": "p_partkey % 4",
    "border_radius": "p_partkey % 7", "important": "p_size", "modernity_score": "p_size % 16", "padding_values": "p_size % 15", "font_families": "p_size % 7", "font_sizes": "p_size % 12", "upscaled_images": "p_partkey % 2", "small_targets_mobile": "p_partkey % 4", "small_targets_tablet": "p_partkey % 6",
}


@query("WITH m AS (SELECT p_partkey AS page_id, " + ", ".join(f'{e} AS "{c}"' for c, e in _STYLE.items()) + """ FROM part) SELECT page_id, unnest(""" + listed({
    "design_no_modern_layout": "grid = 0 AND flex = 0", "design_float_layout": 'float > 10 AND grid = 0 AND flex = 0', "design_table_display": "table_display > 5", "design_no_css_variables": "css_variables = 0 AND modernity_score < 10",
    "design_no_gradients": "gradients = 0 AND modernity_score < 10", "design_no_animations": "transitions = 0 AND animations = 0 AND modernity_score < 10", "design_no_visual_effects": "box_shadow = 0 AND border_radius < 3 AND modernity_score < 10",
    "design_excessive_important": "important > 20", "resp_horizontal_overflow_mobile": "page_id % 2 = 0", "resp_horizontal_overflow_tablet": "page_id % 3 = 0", "resp_small_touch_targets_mobile": "small_targets_mobile > 0", "resp_small_touch_targets_tablet": "small_targets_tablet > 0",
    "visual_inconsistent_padding": "padding_values > 10", "visual_many_fonts": "font_families > 4", "visual_inconsistent_typography": "font_sizes > 8", "visual_upscaled_images": "upscaled_images > 0", "design_very_outdated": "modernity_score < 3", "design_outdated": "modernity_score >= 3 AND modernity_score < 5",
    "resp_missing_viewport_meta": "page_id % 3 <> 0",
}).replace("float >", '"float" >') + ") AS code FROM m")
def style_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style features, views and design bands on both sides of their limits."""
    m = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"), *(F.expr(e).alias(c) for c, e in _STYLE.items()), (F.col("p_partkey") % 2 == 0).alias("overflow_mobile"), (F.col("p_partkey") % 3 == 0).alias("overflow_tablet"), *(F.lit(None).cast("double").alias(v) for v in measured.VITALS),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN '<head><META content=\"width=device-width\" name=''viewport''></head>' WHEN 1 THEN '<meta name=\"view-port\">' ELSE '<head></head>' END").alias("html"),
    )
    return audit.measured_issues(m, measured.design_rules() + measured.metric_rules() + measured.viewport_rules(F.col("html"))).select("page_id", "code")


_FOUR = "[" + ", ".join(f"'{c}'" for c in CATEGORIES[:4]) + "]"


@query(f"""WITH f AS (SELECT o_orderkey AS page_id, o_custkey % 10 AS profile_id, {_FOUR}[o_orderkey % 4 + 1] AS category, 'c' || o_orderkey % 6 AS code FROM orders), p AS (SELECT n_nationkey % 10 AS profile_id, {_FOUR}[n_nationkey // 10 + 1] AS category, n_nationkey % 3 <> 0 AS enabled, 'c' || n_nationkey % 6 AS ignored FROM nation)
 SELECT page_id, category, code FROM f LEFT JOIN p USING (profile_id, category) WHERE coalesce(enabled, TRUE) AND coalesce(code <> ignored, TRUE)""")
def selected_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that disable a category, ignore a code, or say nothing."""
    four = F.array(*(F.lit(c) for c in CATEGORIES[:4]))
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_custkey") % 10).alias("profile_id"), F.get(four, F.col("o_orderkey") % 4).alias("category"), F.expr("'c' || o_orderkey % 6").alias("code"))
    p = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 10).alias("profile_id"), F.get(four, F.expr("n_nationkey div 10")).alias("category"), (F.col("n_nationkey") % 3 != 0).alias("enabled"), F.array(F.expr("'c' || n_nationkey % 6")).alias("ignored_codes"))
    return audit.select_issues(f, p).select("page_id", "category", "code")


@query("WITH d(i, category) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES)) + f""") SELECT c_custkey AS profile_id, category, CASE WHEN own THEN c_custkey % 2 = 0 ELSE TRUE END AS enabled, coalesce(CASE WHEN own AND c_custkey % 3 > 0 THEN c_custkey % 10 END, i % 7) AS priority,
 CASE WHEN own AND c_custkey % 5 = 0 THEN CAST(c_custkey AS DOUBLE) ELSE 2500.0 + i END AS lcp, CASE WHEN own AND c_custkey % 5 = 1 THEN 0.5 END AS cls, CASE WHEN own THEN 'x' || c_custkey ELSE '' END AS ignored FROM (SELECT *, c_custkey % {len(CATEGORIES)} = i AS own FROM customer, d)""")
def rule_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults with each profile's own priority, thresholds, switches and ignored codes over them."""
    defaults = spark.createDataFrame([(c, i % 7, {"lcp": 2500.0 + i}) for i, c in enumerate(CATEGORIES)], "category string, priority int, thresholds map<string,double>")
    category = F.get(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("c_custkey") % len(CATEGORIES))
    own = F.when(F.col("c_custkey") % 5 == 0, F.create_map(F.lit("lcp"), F.col("c_custkey").cast("double"))).when(F.col("c_custkey") % 5 == 1, F.create_map(F.lit("cls"), F.lit(0.5)))
    overrides = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("profile_id"), category.alias("category"), (F.col("c_custkey") % 2 == 0).alias("enabled"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 10).cast("int").alias("priority"), own.alias("thresholds"), F.array(F.expr("'x' || c_custkey")).alias("ignored_codes"),
    )
    at = lambda k: F.try_element_at("thresholds", F.lit(k)).alias(k)
    return audit.configured(defaults, overrides).select("profile_id", "category", "enabled", "priority", at("lcp"), at("cls"), F.array_join("ignored_codes", ",").alias("ignored"))


# --- streams ------------------------------------------------------------------------------------------------------------------

_KIND = "CASE event_type WHEN 'error' THEN 'bounce' WHEN 'click' THEN 'complaint' WHEN 'view' THEN 'unsubscribe' ELSE event_type END"


@query(f"""WITH m AS (SELECT lower('U' || event_id % 97) AS email, user_id % 9 AS user_id, {_KIND} AS type, value > 20 AS hard FROM events), e AS (SELECT email, CASE WHEN type = 'unsubscribe' THEN user_id END AS user_id FROM m WHERE (type = 'bounce' AND hard) OR type IN ('complaint', 'unsubscribe'))
 SELECT DISTINCT email, user_id FROM e""")
def stream_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries as they arrive: for all by hard bounces and complaints, for a user by unsubscriptions, none twice (ST4)."""
    raw = read_stream(spark, sf_dir, "events")
    events = raw.select(F.expr("'U' || event_id % 97").alias("email"), (F.col("user_id") % 9).cast("long").alias("user_id"), F.expr(_KIND).alias("type"), F.when(F.col("value") > 20, "Permanent").otherwise("Transient").alias("bounce_type"), F.col("ts").cast("timestamp").alias("event_time"))
    path = settle.folder(spark)
    halves = {"a": events.where("hash(event_time) % 2 = 0"), "b": events}  # a second feed finds what the first has brought
    for name, part in halves.items():
        flows.suppression_feed(part, f"{path}/entries", name).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flows.ENTRIES).parquet(f"{path}/entries").select("email", "user_id")


@query("""WITH s AS (SELECT doc_id AS signal_id, lang AS industry, n_chars AS value, lower(text) AS t FROM documents), f AS (SELECT n_nationkey AS filter_id, n_regionkey AS user_id, CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END AS user_industry, n_nationkey * 100 AS least, lower(n_name[1:3]) AS keyword FROM nation)
 SELECT signal_id, filter_id, user_id FROM s JOIN f ON (user_industry IS NULL OR industry IS NULL OR user_industry = industry) AND (value IS NULL OR value >= least) AND contains(t, keyword)""")
def stream_signal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that arrive twice are matched once (ST5)."""
    def signals() -> DataFrame:
        d = read_stream(spark, sf_dir, "documents")
        return d.select(
            F.col("doc_id").alias("signal_id"), F.lit("rfp_web").alias("signal_type"), F.col("lang").alias("industry"), F.col("source").alias("region"), F.col("text").alias("title"), F.lit(None).cast("string").alias("description"), F.col("n_chars").cast("double").alias("value"),
            F.lit("web").alias("source"), F.col("doc_id").cast("string").alias("external_id"), F.lit(dt.datetime(2024, 1, 1)).alias("published_at"),
        )

    n = table(spark, sf_dir, "nation")
    filters = n.select(
        F.col("n_nationkey").alias("filter_id"), F.col("n_regionkey").alias("user_id"), F.expr("CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END").alias("user_industry"), F.lit(True).alias("active"), F.array().cast("array<string>").alias("regions"), F.array().cast("array<string>").alias("signal_types"),
        F.array(F.substring("n_name", 1, 3)).alias("keywords"), F.array().cast("array<string>").alias("exclude_keywords"), (F.col("n_nationkey") * 100).cast("double").alias("min_value"), F.lit(None).cast("double").alias("max_value"),
    )
    found = flows.signal_matches(signals().unionByName(signals()), filters)
    return settle.settled(found, ["signal_id", "filter_id"], "append").select("signal_id", "filter_id", "user_id")


@query("""WITH d AS (SELECT DISTINCT user_id AS lead_id, CAST(date_trunc('month', ts) AS DATE) AS m FROM events) SELECT lead_id, m AS period_start, 'month' AS period_type FROM d""")
def month_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots by month, for leads whose user says so."""
    e = table(spark, sf_dir, "events")
    r = e.select(F.col("event_id").alias("analysis_id"), F.col("user_id").alias("lead_id"), F.col("event_type").alias("industry"), F.col("ts").alias("created_at"), F.col("ts").alias("completed_at"), F.col("value").alias("total_score"), F.array("event_type").alias("codes"), F.lit(1).alias("issue_count"), F.lit(0).alias("critical_issue_count"))
    leads = r.select("lead_id").distinct().select("lead_id", F.lit(None).cast("string").alias("industry"), F.lit("month").alias("snapshot_period"))
    return snapshots.snapshots(r, leads).select("lead_id", "period_start", "period_type")
