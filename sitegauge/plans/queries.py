"""Registered queries: operators over the driver's tables, each with the same question in SQL.

``events`` stand for runs and mails: a user is a lead or tenant, a value a score, signup, view, click, purchase and error are a
send, an open, a click, a delivery and a bounce.  Customers stand for companies, orders for proposals, documents for signals.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import audit, benchmark, competitors, discovery, extract, outreach, retention, scoring, signals, snapshots
from ..operators.filters import apply_filters
from ..operators.registry import ISSUES, WEIGHTS
from ..operators.rules import measured
from ..sources import tables
from ..streaming import flows, settle

AS_OF = dt.datetime(2024, 6, 1)
NOW = dt.datetime(2024, 1, 20, 12, 30)
CATEGORIES = ["http", "security", "seo", "typography"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: str) -> Column:
    """Four digits; ties, which engines round differently, are pushed up before."""
    return F.round(F.col(column) + 1e-7, 4)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("analysis_id"), F.col("user_id").alias("lead_id"), F.col("event_type").alias("industry"), F.col("ts").alias("created_at"), F.col("ts").alias("completed_at"), F.col("value").alias("total_score"))


RUNS = "runs AS (SELECT event_id AS analysis_id, user_id AS lead_id, event_type AS industry, ts AS created_at, value AS total_score FROM events)"


def as_mails(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "send").when(F.col("event_type") == "purchase", "delivery").when(F.col("event_type") == "view", "open").when(F.col("event_type") == "error", "bounce").otherwise(F.col("event_type"))
    return e.select(
        "event_id", "user_id", kind.alias("type"), F.col("ts").alias("event_time"), F.concat_ws("-", "user_id", F.date_trunc("DAY", "ts").cast("date").cast("string")).alias("message_id"),
        F.when(F.col("value") > 20, "Permanent").otherwise("Transient").alias("bounce_type"), F.concat(F.lit("u"), F.pmod("event_id", F.lit(97)).cast("string"), F.lit("@d"), F.pmod("user_id", F.lit(9)).cast("string"), F.lit(".cz")).alias("email"),
    )


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_mails(table(spark, sf_dir, "events"))


MAILS = """mails AS (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'send' WHEN 'purchase' THEN 'delivery' WHEN 'view' THEN 'open' WHEN 'error' THEN 'bounce' ELSE event_type END AS type, ts AS event_time,
 user_id || '-' || CAST(ts AS DATE) AS message_id, CASE WHEN value > 20 THEN 'Permanent' ELSE 'Transient' END AS bounce_type, 'u' || (event_id % 97) || '@d' || (user_id % 9) || '.cz' AS email FROM events)"""
STATES = """states AS (SELECT message_id, min(event_time) FILTER (type = 'send') AS sent_at, min(event_time) FILTER (type = 'delivery') AS delivered_at, min(event_time) FILTER (type IN ('open', 'click')) AS opened_at,
 min(event_time) FILTER (type = 'click') AS clicked_at, min(event_time) FILTER (type = 'bounce') AS bounced_at,
 CASE WHEN bool_or(type = 'bounce' AND bounce_type = 'Permanent') THEN 'hard' WHEN bool_or(type = 'bounce') THEN 'soft' END AS bounce_type, max(event_time) AS last_event_at,
 CASE WHEN bool_or(type = 'bounce') THEN 'bounced' WHEN bool_or(type = 'click') THEN 'clicked' WHEN bool_or(type = 'open') THEN 'opened' WHEN bool_or(type = 'delivery') THEN 'delivered' WHEN bool_or(type = 'send') THEN 'sent' END AS status
 FROM mails GROUP BY message_id)"""

# --- pages ---------------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, lower(regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www\\.', '')) AS domain, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base,
 regexp_replace(url, '\\?utm_[^&#]*', '') AS stripped, url[:500] AS short, TRUE AS is_page, FALSE AS skipped FROM pages""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    p = table(spark, sf_dir, "pages")
    name = U.domain(U.normalise_url(url))
    return p.select("page_id", name.alias("domain"), U.base_url(url).alias("base"), U.strip_tracking(url).alias("stripped"), U.truncate_url(url).alias("short"), U.is_page_url(url).alias("is_page"), U.is_skipped(name).alias("skipped"))


_TEXT = "replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>', '', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&copy;', '©'), '&amp;', '&')"
_PAGE_ISSUES = f"""h AS (SELECT page_id, url, html, {_TEXT} AS text, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)) AS title,
  list_transform(regexp_extract_all(html, '(?i)<h([1-6])[^>]*>', 1), lambda x: CAST(x AS INT)) AS levels FROM pages),
m AS (SELECT *, len(regexp_extract_all(html, '(?i)<h1[^>]*>([^<]*)</h1>')) AS h1, len(regexp_extract_all(html, '(?i)<h1[^>]*>')) AS open_h1, len(regexp_extract_all(text, '\\s-\\s')) AS dashes, len(regexp_extract_all(text, '  +')) AS spaces,
  len(regexp_extract_all(text, '["''][A-Za-zÁČĎÉĚÍŇÓŘŠŤÚŮÝŽáčďéěíňóřšťúůýž]')) AS quotes, len(regexp_extract_all(html, '(?i)<br\\s*/?>')) AS breaks, len(regexp_extract_all(html, '&nbsp;')) AS nbsp, len(regexp_extract_all(html, '(?i)<table')) AS tables FROM h),
c AS (SELECT page_id, unnest(list_concat(
  ['security_missing_content_security_policy', 'security_missing_x_frame_options', 'security_missing_x_content_type_options', 'security_missing_strict_transport_security', 'security_missing_referrer_policy', 'security_missing_permissions_policy', 'seo_missing_description', 'seo_missing_og_tags', 'seo_missing_viewport'],
  list_filter([CASE WHEN url NOT ILIKE 'https://%' THEN 'ssl_not_https' END, CASE WHEN title IN ('', '0') THEN 'seo_missing_title' END, CASE WHEN title NOT IN ('', '0') AND length(title) < 10 THEN 'seo_short_title' END, CASE WHEN length(title) > 70 THEN 'seo_long_title' END,
   CASE WHEN h1 = 0 THEN 'seo_missing_h1' END, CASE WHEN h1 > 1 THEN 'seo_multiple_h1' END, CASE WHEN open_h1 > 1 THEN 'heading_multiple_h1' END, CASE WHEN open_h1 = 0 THEN 'heading_no_h1' END,
   CASE WHEN len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] > levels[i - 1] + 1)) > 0 THEN 'heading_skipped_levels' END,
   CASE WHEN dashes > 3 THEN 'typography_wrong_dashes' END, CASE WHEN spaces > 5 THEN 'typography_multiple_spaces' END, CASE WHEN quotes > 10 THEN 'typography_wrong_quotes' END,
   CASE WHEN breaks > 20 THEN 'design_excessive_br_tags' END, CASE WHEN nbsp > 30 THEN 'design_excessive_nbsp' END, CASE WHEN tables > 3 THEN 'design_table_layout' END], lambda x: x IS NOT NULL))) AS code FROM m)"""
_REGISTRY = "reg(code, category, severity, weight) AS (VALUES " + ", ".join(f"('{c}', '{k}', '{s}', {WEIGHTS[s]})" for c, k, s in ISSUES if k in CATEGORIES) + ")"


def page_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.spread(table(spark, sf_dir, "pages")), AS_OF, categories=CATEGORIES)


@query(f"WITH {_PAGE_ISSUES}, {_REGISTRY} SELECT page_id, code, category, severity, weight FROM c JOIN reg USING (code)")
def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_audits(spark, sf_dir).select("page_id", "code", "category", "severity", "weight")


_SCORES = "s AS (SELECT page_id, CAST(sum(weight) AS BIGINT) AS total_score, count(*) AS issue_count, count(*) FILTER (severity = 'critical') AS critical_issue_count, {0} FROM c JOIN reg USING (code) GROUP BY page_id)".format(
    ", ".join(f"CAST(coalesce(sum(weight) FILTER (category = '{c}'), 0) AS BIGINT) AS {c}" for c in CATEGORIES)
)
_STATUS = "CASE WHEN critical_issue_count > 0 THEN CASE WHEN total_score < -50 THEN 'very_bad' ELSE 'bad' END WHEN total_score < -50 THEN 'very_bad' WHEN total_score < -20 THEN 'bad' WHEN total_score < -5 THEN 'middle' WHEN total_score < 0 THEN 'quality_good' ELSE 'super' END"


@query(f"WITH {_PAGE_ISSUES}, {_REGISTRY}, {_SCORES} SELECT *, {_STATUS} AS status FROM s")
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.category_scores(page_audits(spark, sf_dir), "page_id")
    return s.select("page_id", "total_score", "issue_count", "critical_issue_count", *CATEGORIES, scoring.lead_status(F.col("total_score"), F.col("critical_issue_count") > 0).alias("status"))


@query(f"WITH {_PAGE_ISSUES}, {_REGISTRY}, {_SCORES} SELECT regexp_extract(url, '\\.(com|net|org)[/:?#]', 1) AS tld, {_STATUS} AS status, count(*) AS n, round(avg(total_score) + 1e-7, 4) AS avg_score FROM s JOIN pages USING (page_id) GROUP BY ALL")
def site_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    tld = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\.(com|net|org)[/:?#]", 1).alias("tld"))
    s = page_scores(spark, sf_dir).join(tld, "page_id")
    return scoring.averages(s, "tld", "status", score="total_score").withColumn("avg_score", rounded("avg_score"))


@query(f"""WITH {_PAGE_ISSUES}, d AS (SELECT page_id, regexp_extract(url, '\\.(com|net|org)[/:?#]', 1) AS industry FROM pages), z AS (SELECT industry, count(*) AS size FROM d GROUP BY industry),
 n AS (SELECT industry, code, count(DISTINCT page_id) AS n FROM c JOIN d USING (page_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY n DESC, code) AS rank FROM n)
 SELECT industry, CAST(rank AS INT) AS rank, code, n, round(n / size * 100, 1) AS percentage FROM r JOIN z USING (industry) WHERE rank <= 20""")
def top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = page_audits(spark, sf_dir).groupBy("page_id").agg(F.collect_set("code").alias("codes"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\.(com|net|org)[/:?#]", 1).alias("industry"))
    return benchmark.top_issues(codes.join(pages, "page_id"))


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1)) AS href FROM pages),
 t AS (SELECT page_id, CASE WHEN href ILIKE 'http%' THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || href END AS target FROM l WHERE NOT regexp_matches(trim(href), '(?i)^(#|javascript:|mailto:|tel:)'))
 SELECT DISTINCT page_id, target FROM t WHERE regexp_matches(target, '(?i)^https?://[a-z0-9]')""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links(table(spark, sf_dir, "pages")).select("page_id", "target")


@query(None)
def page_audit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All universal categories; some rules look ahead, which the SQL engine's expressions can't."""
    return audit.audit(audit.spread(table(spark, sf_dir, "pages")), AS_OF)


@query(None)
def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_profiles(audit.spread(table(spark, sf_dir, "pages"))).withColumn("social", F.to_json("social"))


@query(None)
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = audit.spread(table(spark, sf_dir, "pages"))
    found = audit.issues(pages, AS_OF, categories=["cms_quality", "content_quality", "branding", "navigation_ux", "conversion", "legal_compliance"])
    return audit.quality_scores(found, pages).join(audit.outdated_scores(pages, AS_OF), "page_id")


@query("""WITH p AS (SELECT page_id, url, lower(regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www\\.', '')) AS domain FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id, url) AS n FROM p)
 SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN domain LIKE '%.example.org' OR regexp_matches(domain, '^m\\..*\\.net$') THEN 'excluded' WHEN domain IN (SELECT domain FROM p WHERE page_id % 7 = 3) THEN 'known' ELSE 'saved' END AS outcome FROM f) GROUP BY outcome""")
def discovery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.lit(1).alias("user_id"), "url", F.lit("crawler").alias("source"), F.lit(False).alias("is_catalogue"), F.col("page_id").alias("position"))
    patterns = spark.createDataFrame([("*.example.org",), ("m.*.net",)], "pattern string")
    leads = p.where("position % 7 = 3").select("user_id", U.domain(F.col("url")).alias("domain"))
    return discovery.outcome_counts(discovery.outcomes(p, leads, patterns)).select("outcome", "n")


@query("""WITH p AS (SELECT page_id, lower(regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www\\.', '')) AS domain, url FROM pages), k AS (SELECT DISTINCT domain FROM p WHERE page_id % 5 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY url) AS n FROM p) SELECT CASE WHEN k.domain IS NOT NULL OR n > 1 THEN 'skipped' ELSE 'imported' END AS outcome, count(*) AS n FROM r LEFT JOIN k USING (domain) GROUP BY ALL""")
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    leads = p.where("page_id % 5 = 0").select(F.lit(1).alias("user_id"), U.domain(F.col("url")).alias("domain"))
    return discovery.import_urls(p.select("url"), leads, 1).groupBy("outcome").agg(F.count("*").alias("n"))


# --- documents and conversations ---------------------------------------------------------------------------------------------

@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}')) AS raw FROM documents), c AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(raw, '[.,;:!?)]+$', ''))) AS email FROM m)
 SELECT doc_id, email, CAST(CASE WHEN regexp_matches(email, '^(info|kontakt|contact|objednavky|obchod|office|podpora|support|recepce)') THEN 0 WHEN regexp_matches(email, '^(sales|marketing|fakturace|uctarna|hr|jobs|career|servis|service)') THEN 1 ELSE 2 END AS INT) AS priority
 FROM c WHERE regexp_matches(email, '^[a-z0-9_%+\\-]+(\\.[a-z0-9_%+\\-]+)*@([a-z0-9]([a-z0-9\\-]*[a-z0-9])?\\.)+[a-z]{2,}$') AND split_part(email, '@', 1) NOT IN ('your', 'email', 'name', 'user', 'xxx', 'test', 'sample', 'demo')""")
def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.emails(F.coalesce("text", F.lit("")), [])).alias("email"))
    return d.withColumn("priority", extract.mail_priority(F.col("email")))


def _words_sql(column: str, names: dict[str, str], last: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in names.items()) + f" ELSE '{last}' END"


@query(f"""WITH t AS (SELECT lower(text) AS t FROM conversations) SELECT {_words_sql('t', {n: '|'.join(w) for n, w in signals.INDUSTRY_WORDS.items()}, 'other')} AS industry,
 {_words_sql('t', {f'rfp_{n}': p for n, p in signals.TYPE_PATTERNS['rfp']}, 'rfp_other')} AS rfp, {_words_sql('t', {f'hiring_{n}': p for n, p in signals.TYPE_PATTERNS['hiring']}, 'hiring_other')} AS hiring, {_words_sql('t', {f'tender_{n}': p for n, p in signals.TYPE_PATTERNS['tender']}, 'tender_other')} AS tender, count(*) AS n FROM t GROUP BY ALL""")
def signal_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    text = F.col("text")
    return signals.counts(t.select(signals.industry_of(text).alias("industry"), *(signals.signal_type_of(text, k).alias(k) for k in ("rfp", "hiring", "tender"))), "industry", "rfp", "hiring", "tender")


@query("""WITH s AS (SELECT doc_id, lang AS industry, source AS region, n_chars AS value, lower(text) AS t FROM documents),
 f AS (SELECT n_nationkey AS filter_id, n_regionkey AS user_id, CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END AS user_industry, 'src1' AS region, CAST(n_nationkey * 100 AS DOUBLE) AS min_value, lower(n_name[1:3]) AS keyword, lower(n_name[2:5]) AS excluded FROM nation)
 SELECT filter_id, user_id, count(*) AS n FROM s JOIN f ON (user_industry IS NULL OR industry IS NULL OR user_industry = industry) AND (s.region IS NULL OR contains(lower(s.region), f.region)) AND (value IS NULL OR value >= min_value) AND contains(t, keyword) AND NOT contains(t, excluded) GROUP BY ALL""")
def signal_filter_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("signal_id"), F.lit("rfp_web").alias("signal_type"), F.col("lang").alias("industry"), F.col("source").alias("region"), F.col("text").alias("title"), F.lit(None).cast("string").alias("description"), F.col("n_chars").cast("double").alias("value"))
    n, key = table(spark, sf_dir, "nation"), F.col("n_regionkey")
    f = n.select(
        F.col("n_nationkey").alias("filter_id"), key.alias("user_id"), F.when(key == 0, "en").when(key == 1, "de").when(key == 2, "fr").alias("user_industry"), F.lit(True).alias("active"), F.array(F.lit("SRC1")).alias("regions"),
        F.array().cast("array<string>").alias("signal_types"), F.array(F.substring("n_name", 1, 3)).alias("keywords"), F.array(F.substring("n_name", 2, 4)).alias("exclude_keywords"), (F.col("n_nationkey") * 100).cast("double").alias("min_value"), F.lit(None).cast("double").alias("max_value"),
    )
    return signals.counts(signals.match(d, f), "filter_id", "user_id")


_STEMS = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(t, '{s}') THEN '{n}' END" for s, n in competitors.INDUSTRY_STEMS.items()) + "], lambda x: x IS NOT NULL))"


def _terms_sql(terms: list[str]) -> str:
    return "len(list_filter([" + ", ".join(f"'{t.lower()}'" for t in dict.fromkeys(terms)) + "], lambda x: contains(t, x)))"


@query(f"WITH d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, CAST({_terms_sql(competitors.TECHNOLOGIES)} AS INT) AS technologies, CAST({_terms_sql(competitors.METHODOLOGIES)} AS INT) AS methodologies, CAST(len({_STEMS}) AS INT) AS industries, CAST({_terms_sql(competitors.CERTIFICATIONS)} AS INT) AS certifications FROM d")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = audit.spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("html"))
    facts = competitors.vocabulary_facts(d, "doc_id")
    return facts.select("doc_id", *(F.size(c).alias(c) for c in ("technologies", "methodologies", "industries", "certifications")))


# --- events as runs ---------------------------------------------------------------------------------------------------------

@query(f"WITH {RUNS} SELECT analysis_id, lead_id, row_number() OVER w AS sequence_number, lag(analysis_id) OVER w AS previous_id, round(total_score - lag(total_score) OVER w, 6) AS score_delta, total_score > lag(total_score) OVER w AS is_improved FROM runs WINDOW w AS (PARTITION BY lead_id ORDER BY created_at, analysis_id)")
def run_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scoring.sequence(runs(spark, sf_dir)).withColumn("codes", F.array().cast("array<string>"))
    d = scoring.deltas(r.drop("sequence_number"))
    return d.select("analysis_id", "lead_id", "sequence_number", "previous_id", F.round("score_delta", 6).alias("score_delta"), "is_improved")


_CODES = "codes AS (SELECT event_id, user_id, ts, list_distinct([event_type, 'k' || (event_id % 3), 'm' || (event_id % 2)]) AS codes, lag(list_distinct([event_type, 'k' || (event_id % 3), 'm' || (event_id % 2)])) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)"


@query(f"WITH {_CODES} SELECT event_id, CASE WHEN old IS NOT NULL THEN array_to_string(list_sort(list_filter(codes, lambda x: NOT list_contains(old, x))), ',') END AS added, CASE WHEN old IS NOT NULL THEN array_to_string(list_sort(list_filter(old, lambda x: NOT list_contains(codes, x))), ',') END AS removed, CASE WHEN old IS NOT NULL THEN CAST(len(list_filter(codes, lambda x: list_contains(old, x))) AS INT) END AS unchanged_count FROM codes")
def issue_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runs(spark, sf_dir)
    codes = F.array_distinct(F.array("industry", F.concat(F.lit("k"), (F.col("analysis_id") % 3).cast("string")), F.concat(F.lit("m"), (F.col("analysis_id") % 2).cast("string"))))
    d = scoring.deltas(e.withColumn("codes", codes))
    return d.select(F.col("analysis_id").alias("event_id"), F.array_join(F.array_sort("added"), ",").alias("added"), F.array_join(F.array_sort("removed"), ",").alias("removed"), "unchanged_count")


@query(f"WITH {RUNS}, d AS (SELECT created_at, total_score - lag(total_score) OVER (PARTITION BY lead_id ORDER BY created_at, analysis_id) AS score_delta FROM runs) SELECT count(*) FILTER (score_delta > 0) AS improved, count(*) FILTER (score_delta < 0) AS worsened, count(*) FILTER (score_delta = 0) AS unchanged FROM d WHERE created_at >= TIMESTAMP '2024-01-10'")
def delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("codes", F.array().cast("array<string>"))
    return scoring.delta_stats(scoring.deltas(r), dt.datetime(2024, 1, 10))


@query(f"WITH {RUNS} SELECT analysis_id, lead_id, total_score FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, analysis_id DESC) AS n FROM runs) WHERE n <= 3")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.history(runs(spark, sf_dir), 3).select("analysis_id", "lead_id", "total_score")


_SNAPS = f"""{RUNS}, p AS (SELECT *, CASE WHEN lead_id % 3 = 0 THEN 'day' ELSE 'week' END AS period_type FROM runs), q AS (SELECT *, CAST(CASE period_type WHEN 'day' THEN date_trunc('day', created_at) ELSE date_trunc('week', created_at) END AS DATE) AS period_start FROM p),
 snaps AS (SELECT lead_id, analysis_id, period_type, period_start, total_score, industry FROM (SELECT *, row_number() OVER (PARTITION BY lead_id, period_type, period_start ORDER BY created_at DESC, analysis_id DESC) AS n FROM q) WHERE n = 1)"""


def _snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("codes", F.array("industry")).withColumn("issue_count", F.lit(1)).withColumn("critical_issue_count", F.lit(0))
    leads = r.select("lead_id").distinct().select("lead_id", F.lit(None).cast("string").alias("industry"), F.when(F.col("lead_id") % 3 == 0, "day").otherwise("week").alias("snapshot_period"))
    return snapshots.snapshots(r, leads)


@query(f"WITH {_SNAPS} SELECT s.lead_id, s.period_type, s.period_start, s.total_score, s.industry, round(s.total_score - o.total_score, 6) AS score_delta FROM snaps s LEFT JOIN snaps o ON o.lead_id = s.lead_id AND o.period_type = s.period_type AND o.period_start = s.period_start - CASE s.period_type WHEN 'day' THEN 1 ELSE 7 END")
def snapshot_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.with_delta(_snaps(spark, sf_dir)).select("lead_id", "period_type", "period_start", "total_score", "industry", F.round("score_delta", 6).alias("score_delta"))


@query(f"WITH {_SNAPS} SELECT industry, period_type, period_start, round(avg(total_score) + 1e-7, 4) AS avg_score, count(*) AS n FROM snaps GROUP BY ALL")
def industry_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.industry_trend(_snaps(spark, sf_dir)).withColumn("avg_score", rounded("avg_score"))


@query(f"WITH {_SNAPS} SELECT lead_id, period_type, period_start, total_score FROM (SELECT *, row_number() OVER (PARTITION BY lead_id, period_type ORDER BY period_start DESC) AS n FROM snaps) WHERE n <= 4")
def lead_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.lead_trend(_snaps(spark, sf_dir), 4).select("lead_id", "period_type", "period_start", "total_score")


_BENCH = f"""{RUNS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY created_at DESC, analysis_id DESC) AS n FROM runs) WHERE n <= 1000),
 bench AS (SELECT industry, avg(total_score) AS avg_score, median(total_score) AS median_score, count(*) AS sample_size, round(quantile_cont(total_score, 0.1), 4) AS p10, round(quantile_cont(total_score, 0.25), 4) AS p25, round(quantile_cont(total_score, 0.5), 4) AS p50, round(quantile_cont(total_score, 0.75), 4) AS p75, round(quantile_cont(total_score, 0.9), 4) AS p90 FROM b GROUP BY industry)"""


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.statistics(benchmark.sample(runs(spark, sf_dir))).withColumn("period_start", F.lit(dt.date(2024, 1, 29)))


@query(f"WITH {_BENCH} SELECT industry, round(avg_score + 1e-7, 4) AS avg_score, round(median_score, 4) AS median_score, sample_size, p10, p25, p50, p75, p90 FROM bench")
def benchmark_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench(spark, sf_dir).select("industry", rounded("avg_score").alias("avg_score"), F.round("median_score", 4).alias("median_score"), "sample_size", "percentiles.*")


@query(f"""WITH {_BENCH} SELECT analysis_id, CASE WHEN total_score >= p90 THEN 'top10' WHEN total_score >= p75 THEN 'top25' WHEN total_score >= p50 THEN 'above_average' WHEN total_score >= p25 THEN 'below_average' ELSE 'bottom25' END AS ranking,
 round(CASE WHEN total_score >= p90 THEN least(90 + (total_score - p90) / greatest(1.0, 100 - p90) * 10, 100.0) WHEN total_score >= p75 THEN 75 + (total_score - p75) / greatest(1.0, p90 - p75) * 15 WHEN total_score >= p50 THEN 50 + (total_score - p50) / greatest(1.0, p75 - p50) * 25
  WHEN total_score >= p25 THEN 25 + (total_score - p25) / greatest(1.0, p50 - p25) * 25 WHEN total_score >= p10 THEN 10 + (total_score - p10) / greatest(1.0, p25 - p10) * 15 ELSE total_score / greatest(1.0, p10) * 10 END, 1) AS percentile, round(total_score - avg_score + 1e-7, 4) AS diff_from_avg FROM runs JOIN bench USING (industry)""")
def benchmark_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.compare(runs(spark, sf_dir), _bench(spark, sf_dir)).select("analysis_id", "ranking", "percentile", rounded("diff_from_avg").alias("diff_from_avg"))


# --- events as mails --------------------------------------------------------------------------------------------------------

@query(f"WITH {MAILS}, {STATES} SELECT * FROM states")
def mail_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outreach.fold_mail(mails(spark, sf_dir))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_states(spark, sf_dir).withColumn("user_id", F.substring_index("message_id", "-", 1).cast("long")).withColumn("created_at", F.col("last_event_at"))


_R = "CASE WHEN sent > 0 THEN round({0} / sent * 100, 2) ELSE 0 END AS {1}"


@query(f"WITH {MAILS}, {STATES}, g AS (SELECT CAST(split_part(message_id, '-', 1) AS BIGINT) AS user_id, count(*) AS total, count(*) FILTER (status IN ('sent', 'delivered', 'opened', 'clicked')) AS sent, count(*) FILTER (status = 'delivered') AS delivered, count(*) FILTER (status = 'opened') AS opened, count(*) FILTER (status = 'clicked') AS clicked, count(*) FILTER (status = 'bounced') AS bounced FROM states GROUP BY 1) SELECT *, {_R.format('delivered', 'delivery_rate')}, {_R.format('opened', 'open_rate')}, {_R.format('clicked', 'click_rate')}, {_R.format('bounced', 'bounce_rate')} FROM g")
def mail_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outreach.mail_stats(_logs(spark, sf_dir)).drop("complained", "failed", "opened_ever", "clicked_ever")


@query(f"WITH {MAILS}, {STATES}, g AS (SELECT CAST(split_part(message_id, '-', 1) AS BIGINT) AS user_id, count(*) AS total, count(*) FILTER (status IN ('sent', 'opened', 'clicked')) AS sent, count(opened_at) AS opened, count(clicked_at) AS clicked, count(delivered_at) AS responded, count(bounced_at) AS converted FROM states GROUP BY 1) SELECT *, {_R.format('opened', 'open_rate')}, {_R.format('clicked', 'click_rate')}, {_R.format('responded', 'response_rate')}, {_R.format('converted', 'conversion_rate')} FROM g")
def offer_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outreach.offer_funnel(_logs(spark, sf_dir).withColumn("responded_at", F.col("delivered_at")).withColumn("converted_at", F.col("bounced_at")))


@query(f"WITH {MAILS} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_last_hour FROM mails")
def rolling_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outreach.rolling_sends(mails(spark, sf_dir), "event_time").select("event_id", "in_last_hour")


@query(f"""WITH {MAILS}, u AS (SELECT user_id, count(*) FILTER (event_time >= TIMESTAMP '2024-01-20 11:30:00') AS per_hour, count(*) FILTER (event_time >= TIMESTAMP '2024-01-20') AS per_day FROM mails WHERE event_time BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-20 12:30:00' GROUP BY user_id),
 d AS (SELECT user_id, split_part(email, '@', 2) AS domain, count(*) AS per_domain FROM mails WHERE event_time BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-20 12:30:00' GROUP BY ALL), q AS (SELECT DISTINCT user_id, split_part(email, '@', 2) AS domain FROM mails),
 j AS (SELECT user_id, domain, coalesce(per_hour, 0) AS h, coalesce(per_day, 0) AS y, coalesce(per_domain, 0) AS m FROM q LEFT JOIN u USING (user_id) LEFT JOIN d USING (user_id, domain))
 SELECT user_id, 'x@' || domain AS to_email, NOT (h >= 10 OR y >= 50 OR m >= 3) AS allowed, CASE WHEN h >= 10 THEN 'hour' WHEN y >= 50 THEN 'day' WHEN m >= 3 THEN 'domain_day' END AS failed_limit, CASE WHEN h >= 10 THEN 1800 WHEN y >= 50 OR m >= 3 THEN 41400 END AS retry_after, greatest(0, 10 - h) AS left_hour, greatest(0, 50 - y) AS left_day, greatest(0, 3 - m) AS left_domain_day FROM j""")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mails(spark, sf_dir).withColumn("sent_at", F.col("event_time")).withColumn("to_email", F.col("email"))
    by_user, by_domain = outreach.usage(m, NOW)
    asked = m.select("user_id", F.concat(F.lit("x@"), outreach.mail_domain(F.col("email"))).alias("to_email")).distinct()
    return outreach.decide(asked, by_user, by_domain, None, NOW)


_ENTRIES = "entries AS (SELECT email, event_time, row_number() OVER (PARTITION BY email ORDER BY event_time) AS n FROM mails WHERE type = 'bounce' AND bounce_type = 'Permanent' AND event_time < TIMESTAMP '2024-01-05')"


def _blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries as they stood on 5 January."""
    m = mails(spark, sf_dir)
    stored = m.limit(0).select("email", "user_id")
    return outreach.suppression_entries(m.where(F.col("event_time") < F.lit(dt.datetime(2024, 1, 5))), stored)


@query(f"""WITH {MAILS}, e AS (SELECT email, event_time, row_number() OVER (PARTITION BY email ORDER BY event_time) AS n FROM mails WHERE type = 'bounce' AND bounce_type = 'Permanent')
 SELECT email, event_time FROM e WHERE n = 1 AND email NOT IN (SELECT email FROM mails WHERE type = 'click' AND event_time < TIMESTAMP '2024-01-03')""")
def suppression_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries of all mails, beside those that are stored already."""
    m = mails(spark, sf_dir)
    stored = m.where((F.col("type") == "click") & (F.col("event_time") < F.lit(dt.datetime(2024, 1, 3)))).select(F.upper("email").alias("email"), F.lit(None).cast("long").alias("user_id")).distinct()
    return outreach.suppression_entries(m, stored).select("email", "event_time")


@query(f"WITH {MAILS}, {_ENTRIES} SELECT user_id, count(*) AS n FROM mails WHERE email NOT IN (SELECT email FROM entries) GROUP BY user_id")
def unsuppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outreach.suppressed(mails(spark, sf_dir), _blacklist(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("n"))


# --- events as snapshots of competitors; retention -----------------------------------------------------------------------------

def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id"), F.col("user_id").alias("domain"), F.col("event_type").alias("snapshot_type"), F.col("ts").alias("taken_at"), F.col("value"))


_SIGNIFICANCE = "CASE WHEN p >= 50 THEN 'critical' WHEN p >= 25 THEN 'high' WHEN p >= 10 THEN 'medium' ELSE 'low' END"


@query(f"WITH l AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM events), q AS (SELECT *, CASE WHEN old > 0 THEN abs(value - old) / old * 100 ELSE 100 END AS p FROM l) SELECT event_id, old AS previous_value, coalesce(value <> old, false) AS has_changes, CASE WHEN old IS NOT NULL THEN {_SIGNIFICANCE} END AS significance FROM q")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = competitors.with_previous(_facts(spark, sf_dir), "value", tie="event_id")
    return s.select("event_id", "previous_value", "has_changes", F.when(F.col("previous_value").isNotNull(), competitors.numeric_significance(F.col("previous_value"), F.col("value"))).alias("significance"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return competitors.keep_latest(_facts(spark, sf_dir), tie="event_id").select("event_id")


@query("SELECT DISTINCT user_id AS domain FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND value > 60 AND ts >= TIMESTAMP '2024-01-13 12:30:00')")
def due_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    snaps = f.where("snapshot_type = 'view' and value > 60").withColumn("snapshot_type", F.lit("portfolio"))
    return competitors.due_for_snapshot(f.select("domain", F.lit(True).alias("active")).distinct(), snaps, "portfolio", NOW).select("domain")


@query("SELECT p_partkey, CASE WHEN p >= 50 THEN 'high' WHEN p >= 20 THEN 'medium' ELSE 'low' END AS significance FROM (SELECT p_partkey, levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type), 1) * 100 AS p FROM part)")
def string_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", competitors.string_significance(F.col("p_name"), F.col("p_type")).alias("significance"))


@query("""WITH k AS (SELECT p_brand AS domain, p_type AS name, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS taken_at, max(round(p_retailprice)) AS price FROM part GROUP BY ALL), o AS (SELECT * FROM k WHERE taken_at = 1), w AS (SELECT * FROM k WHERE taken_at = 2)
 SELECT w.domain, w.name, o.price AS b, w.price AS a, CASE WHEN p >= 20 THEN 'high' WHEN p >= 10 THEN 'medium' ELSE 'low' END AS significance FROM (SELECT *, 0 FROM w) w JOIN o USING (domain, name), LATERAL (SELECT abs(w.price - o.price) / o.price * 100 AS p) WHERE w.price <> o.price""")
def package_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = p.groupBy(F.col("p_brand").alias("domain"), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(2).alias("taken_at"), F.col("p_type").alias("name")).agg(F.max(F.round("p_retailprice")).alias("price"))
    facts = k.groupBy("domain", "taken_at").agg(F.collect_list(F.struct("name", "price")).alias("packages")).withColumn("pricing_type", F.lit("tiered"))
    c = competitors.pricing_changes(facts).where(F.col("field").startswith("package_price_"))
    return c.select("domain", F.regexp_replace("field", "^package_price_", "").alias("name"), F.col("before").cast("double").alias("b"), F.col("after").cast("double").alias("a"), "significance")


@query("SELECT CASE WHEN d >= 365 THEN 'delete' WHEN d >= 90 THEN 'clear' WHEN d >= 30 THEN 'compress' ELSE 'keep' END AS tier, count(*) AS n FROM (SELECT date_diff('day', o_orderdate, TIMESTAMP '1998-06-01') AS d FROM orders) GROUP BY tier")
def retention_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.tier_counts(table(spark, sf_dir, "orders"), dt.datetime(1998, 6, 1), "o_orderdate")


# --- customers and orders ------------------------------------------------------------------------------------------------------

@query("SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS with_registry_data, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS with_leads FROM customer")
def company_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ico"), F.when(F.col("c_acctbal") > 0, F.lit(NOW)).alias("ares_updated_at"))
    return discovery.company_stats(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id")))


@query("WITH o AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) SELECT c_custkey AS ico FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE last IS NULL OR last < TIMESTAMP '1998-05-02'")
def companies_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ico")).agg(F.max("o_orderdate").alias("ares_updated_at"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ico")).join(last, "ico", "left")
    return discovery.companies_due(c, dt.datetime(1998, 6, 1)).select("ico")


@query("SELECT o_orderkey AS lead_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 100")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lead_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"))
    return discovery.work_queue(o, "O", 100).select("lead_id")


@query("""WITH f AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT c_custkey AS request_id, p AS industry, row_number() OVER (PARTITION BY p ORDER BY c_custkey) AS n FROM (SELECT c_custkey, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][c_custkey % 5 + 1] AS p FROM customer))
 SELECT request_id, industry, o_orderkey AS proposal_id FROM r LEFT JOIN f ON o_orderpriority = industry AND f.n = r.n""")
def proposal_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = o.select(F.col("o_orderkey").alias("proposal_id"), F.col("o_orderpriority").alias("industry"), F.lit("mail").alias("type"), F.when(F.col("o_orderstatus") == "F", "rejected").alias("status"), F.lit(True).alias("is_ai_generated"), F.lit(False).alias("is_customized"), F.lit(True).alias("recyclable"), F.col("o_orderdate").alias("created_at"))
    names = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("industry"), F.lit("mail").alias("type"))
    return outreach.reuse_proposals(asked, p).select("request_id", "industry", "proposal_id")


@query("SELECT c_custkey, 'Dear ' || c_name || ' of ' || c_mktsegment AS rendered FROM customer")
def rendered_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit("Dear {{name}} of {{segment}}").alias("template"), F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("variables"))
    return outreach.render(c).select("c_custkey", "rendered")


@query("""WITH d AS (SELECT c_custkey, lpad(CAST(c_custkey * 9973 % 100000000 AS VARCHAR), 8, '0') AS ico FROM customer), s AS (SELECT *, (CAST(ico[1] AS INT) * 8 + CAST(ico[2] AS INT) * 7 + CAST(ico[3] AS INT) * 6 + CAST(ico[4] AS INT) * 5 + CAST(ico[5] AS INT) * 4 + CAST(ico[6] AS INT) * 3 + CAST(ico[7] AS INT) * 2) % 11 AS r FROM d)
 SELECT c_custkey, ico, CAST(ico[8] AS INT) = CASE r WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 11 - r END AS valid FROM s""")
def company_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ico = F.lpad((F.col("c_custkey") * 9973 % 100000000).cast("string"), 8, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", ico.alias("ico")).withColumn("valid", T.valid_company_id(F.col("ico")))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN round(o_totalprice, 2) END AS price, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS at FROM orders")
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    written = F.concat(F.replace(F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" Kč"))
    return o.select("o_orderkey", T.price(written).alias("price"), T.czech_date(F.date_format("o_orderdate", "d.M.yyyy")).alias("at"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '00') AND c_acctbal >= 100 AND c_acctbal <= 5000")
def filtered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_filters(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING"}, {"c_name": "00"}, {"c_acctbal": (100, 5000)}).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    visible = discovery.visible_users(n.select(F.col("n_nationkey").alias("user_id"), (F.col("n_regionkey") + 1000).alias("admin_id")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("user_id"))
    return discovery.scope(rows, visible, 1001).select("c_custkey")


# --- further operators -----------------------------------------------------------------------------------------------------------

@query("""WITH w AS (SELECT o_orderkey AS lead_id, o_custkey AS ico, CASE WHEN o_orderkey % 3 = 0 THEN 'own' END AS company_name FROM orders UNION ALL SELECT -p_partkey, p_partkey, p_name FROM part), k AS (SELECT c_custkey AS ico, c_name AS name FROM customer),
 m AS (SELECT ico, min(company_name) AS name FROM w WHERE ico NOT IN (SELECT ico FROM k) GROUP BY ico), e AS (SELECT * FROM k UNION ALL SELECT * FROM m) SELECT lead_id, ico AS company_id, coalesce(company_name, name) AS company_name FROM w JOIN e USING (ico)""")
def linked_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies are missing where parts have keys beyond those of customers."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    leads = o.select(F.col("o_orderkey").cast("long").alias("lead_id"), F.col("o_custkey").cast("long").alias("ico"), F.when(F.col("o_orderkey") % 3 == 0, "own").alias("company_name"))
    leads = leads.unionByName(p.select((-F.col("p_partkey")).cast("long").alias("lead_id"), F.col("p_partkey").cast("long").alias("ico"), F.col("p_name").alias("company_name")))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("ico"), F.col("c_name").alias("name"))
    return discovery.link_companies(leads.withColumn("company_id", F.lit(None).cast("long")), c)[0].select("lead_id", "company_id", "company_name")


@query("SELECT coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'unknown') AS status, count(*) AS n FROM customer GROUP BY 1")
def companies_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return discovery.companies_by_status(c.select(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("business_status")))


@query("SELECT c_custkey AS profile_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def leads_per_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("lead_id"))
    return discovery.leads_per_profile(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id")), o)


@query("""SELECT c_custkey AS profile_id, CASE WHEN n_regionkey = 0 THEN 'inactive_user' WHEN c_acctbal < 0 THEN 'disabled' WHEN c_custkey % 7 = 0 THEN 'no_queries' END AS skip_reason FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    profiles = c.select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").alias("user_id"), (F.col("c_acctbal") >= 0).alias("discovery_enabled"), F.lit("google").alias("source"), F.when(F.col("c_custkey") % 7 != 0, F.array("c_name")).alias("queries"), F.lit(1).alias("priority"), F.col("c_name").alias("name"))
    return discovery.batch_plan(profiles, n.select(F.col("n_nationkey").alias("user_id"), (F.col("n_regionkey") != 0).alias("active"))).select("profile_id", "skip_reason")


@query("SELECT o_orderkey AS lead_id FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000 ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 50 OFFSET 20")
def audit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lead_id"), F.when(F.col("o_orderstatus") == "P", "dismissed").otherwise("new").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), (F.col("o_totalprice") > 100000).alias("has_website"))
    return discovery.audit_candidates(o, True, 50, 20).select("lead_id")


@query("SELECT o_custkey AS user_id, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outreach.status_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status")))


@query("SELECT o_orderkey AS proposal_id, CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' AND o_orderstatus NOT IN ('F') THEN 'expired' WHEN o_orderstatus = 'F' THEN 'used' ELSE 'draft' END AS status FROM orders")
def expired_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("proposal_id"), F.when(F.col("o_orderstatus") == "F", "used").otherwise("draft").alias("status"), F.col("o_orderdate").alias("expires_at"))
    return outreach.expire_proposals(o, dt.datetime(1995, 6, 1)).select("proposal_id", "status")


_ASKED = "CASE WHEN c_custkey % 3 = 0 THEN 'Nope' ELSE 'Brand#' || (c_nationkey % 5 + 1) || (c_custkey % 5 + 1) END"


@query(f"""WITH g AS (SELECT NULL AS tu, p_brand AS tn, CASE WHEN p_size < 25 THEN p_type END AS ti, p_partkey % 100 = 7 AS d, p_partkey AS template_id FROM part), o AS (SELECT c_custkey AS tu, CASE WHEN c_custkey % 4 = 0 THEN {_ASKED} ELSE 'mine' END AS tn, NULL AS ti, c_custkey % 4 = 1 AS d, 1000000 + c_custkey AS template_id FROM customer WHERE c_custkey % 4 < 2 AND c_custkey % 8 > 0),
 r AS (SELECT c_custkey AS request_id, {_ASKED} AS name, CASE WHEN c_custkey % 2 = 0 THEN (SELECT min(p_type) FROM part) ELSE 'none' END AS industry FROM customer),
 j AS (SELECT request_id, template_id, CASE WHEN tn = name THEN 1 WHEN d THEN 4 END AS p FROM r JOIN o ON tu = request_id UNION ALL SELECT request_id, template_id, CASE WHEN tn = name AND ti = industry THEN 2 WHEN tn = name AND ti IS NULL THEN 3 WHEN d AND ti = industry THEN 5 WHEN d AND ti IS NULL THEN 6 END FROM r JOIN g ON tn = name OR d),
 b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p, template_id) AS n FROM j WHERE p IS NOT NULL) SELECT request_id, template_id, p AS rank FROM r LEFT JOIN (SELECT * FROM b WHERE n = 1) USING (request_id)""")
def chosen_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own of the name, the global one of name and industry or of the name, the user's default, the industry's, the global one."""
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    first = p.agg(F.min("p_type")).head()[0]
    every = p.select(F.col("p_brand").alias("name"), F.when(F.col("p_size") < 25, F.col("p_type")).alias("industry"), (F.col("p_partkey") % 100 == 7).alias("is_default"), F.col("p_partkey").alias("template_id"))
    own = c.where("c_custkey % 4 < 2").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 4 == 0, F.expr(_ASKED)).otherwise("mine").alias("name"), (F.col("c_custkey") % 4 == 1).alias("is_default"), (F.col("c_custkey") % 8 > 0).alias("is_active"), (1_000_000 + F.col("c_custkey")).alias("template_id"))
    asked = c.select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("user_id"), F.expr(_ASKED).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.lit(first)).otherwise("none").alias("industry"))
    return outreach.choose_template(asked, own, every).select("request_id", "template_id", "rank")


@query("SELECT c_custkey AS lead_id FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def ready_for_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lead_id"), F.lit(NOW).alias("analyzed_at"), F.when(F.col("c_acctbal") > 0, "new").otherwise("dismissed").alias("status"), F.lit("manual").alias("source"), F.lit(None).cast("string").alias("email"), F.col("c_acctbal").alias("score"))
    return outreach.ready_for_proposal(c, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("lead_id")), 100).select("lead_id")


@query("SELECT c_custkey AS lead_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def ready_for_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lead_id"), F.lit(1).alias("user_id"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lead_id"), F.lit(1).alias("user_id"), F.col("c_name").alias("email"))
    return outreach.ready_for_offer(c, o, o.where("o_totalprice > 300000")).select("lead_id")


@query("SELECT c_custkey AS company_id, c_nationkey AS user_id FROM customer WHERE (c_nationkey, c_custkey) NOT IN (SELECT s_nationkey, s_suppkey FROM supplier)")
def without_blacklisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_nationkey").alias("user_id"))
    notes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_nationkey").alias("user_id"), F.lit("blacklisted").alias("relationship_status"))
    return outreach.without_blacklisted(c, notes)


_SIGNALS = "sig AS (SELECT o_orderkey AS signal_id, CASE WHEN o_orderstatus = 'O' THEN 'new' WHEN o_orderstatus = 'P' THEN 'qualified' ELSE 'rejected' END AS status, o_orderdate AS deadline, o_totalprice AS value FROM orders)"
SIGNALS_AT = dt.datetime(1996, 6, 1)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "P", "qualified").otherwise("rejected")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("signal_id"), status.alias("status"), F.col("o_orderdate").alias("deadline"), F.col("o_totalprice").alias("value"))


@query(f"WITH {_SIGNALS} SELECT signal_id FROM sig WHERE status IN ('new', 'qualified') AND (deadline IS NULL OR deadline > TIMESTAMP '1996-06-01')")
def active_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.active_signals(_signals(spark, sf_dir), SIGNALS_AT).select("signal_id")


@query(f"WITH {_SIGNALS} SELECT signal_id, deadline FROM sig WHERE status IN ('new', 'qualified') AND deadline BETWEEN TIMESTAMP '1996-06-01' AND TIMESTAMP '1996-07-31'")
def upcoming_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.upcoming(_signals(spark, sf_dir), SIGNALS_AT, 60).select("signal_id", "deadline")


@query(f"WITH {_SIGNALS} SELECT status, count(*) AS n FROM (SELECT CASE WHEN status IN ('new', 'qualified') AND deadline < TIMESTAMP '1996-06-01' THEN 'expired' ELSE status END AS status FROM sig) GROUP BY status")
def expired_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.counts(signals.expire(_signals(spark, sf_dir), SIGNALS_AT), "status")


@query("SELECT l_suppkey AS user_id, l_orderkey AS signal_id FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag <> 'R') WHERE (l_suppkey, l_orderkey) NOT IN (SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def new_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("signal_id"), "l_returnflag")
    return signals.subscriptions(pairs.where("l_returnflag <> 'R'"), pairs.where("l_returnflag = 'R'"))


@query("WITH n AS (SELECT event_id, event_type AS source, 'k' || (event_id // 7) AS external_id FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY event_id) AS r FROM n) SELECT source, external_id, event_id AS signal_id FROM f WHERE r = 1 AND (source, external_id) NOT IN (SELECT source, external_id FROM n WHERE event_id % 10 = 0)")
def ingested_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("signal_id"), F.col("event_type").alias("source"), F.concat(F.lit("k"), F.floor(F.col("event_id") / 7).cast("string")).alias("external_id"), F.lit("t").alias("title"), F.col("ts").alias("published_at"))
    return signals.ingest(e, e.where("signal_id % 10 = 0")).select("source", "external_id", "signal_id")


@query("WITH l AS (SELECT event_id, user_id, event_type, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM events), q AS (SELECT event_id, user_id, CASE WHEN old > 0 THEN abs(value - old) / old * 100 ELSE 100 END AS p FROM l WHERE old IS NOT NULL), s AS (SELECT s_suppkey AS user, s_nationkey AS n FROM supplier)"
       " SELECT event_id, s.user AS user_id FROM q JOIN s ON q.user_id = s.n + 1 WHERE CASE WHEN p >= 50 THEN 100 WHEN p >= 25 THEN 75 WHEN p >= 10 THEN 50 ELSE 25 END >= CASE s.user % 3 WHEN 0 THEN 100 WHEN 1 THEN 75 ELSE 50 END")
def alert_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = snapshot_changes(spark, sf_dir).where("significance is not null").join(_facts(spark, sf_dir).select("event_id", "domain"), "event_id")
    s = table(spark, sf_dir, "supplier")
    least = F.when(F.col("s_suppkey") % 3 == 0, "critical").when(F.col("s_suppkey") % 3 == 1, "high").otherwise("medium")
    subs = s.select(F.col("s_suppkey").alias("user_id"), (F.col("s_nationkey") + 1).cast("long").alias("domain"), F.lit(True).alias("alert_on_change"), F.lit(None).cast("array<string>").alias("snapshot_types"), least.alias("min_significance"))
    return competitors.fan_out(c, subs).select("event_id", "user_id")


@query("WITH d AS (SELECT user_id AS domain, max(ts) AS last, CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 14 ELSE 30 END AS days FROM events GROUP BY user_id) SELECT domain FROM d WHERE date_diff('day', last, TIMESTAMP '2024-02-08') >= days AND domain IN (SELECT s_nationkey FROM supplier)")
def due_for_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in ("daily", "weekly", "biweekly", "monthly")))
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("domain")).agg(F.max("ts").alias("last_crawled_at")).withColumn("active", F.lit(True)).withColumn("crawl_frequency", F.element_at(names, (F.col("domain") % 4 + 1).cast("int")))
    return competitors.due_for_crawl(d, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("domain")), dt.datetime(2024, 2, 8)).select("domain")


@query(f"WITH {RUNS} SELECT industry, category, round(avg(total_score) + 1e-7, 2) AS mean FROM (SELECT industry, 'c' || (analysis_id % 4) AS category, total_score FROM runs) GROUP BY ALL")
def category_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("category_scores", F.create_map(F.concat(F.lit("c"), (F.col("analysis_id") % 4).cast("string")), F.col("total_score") + 1e-7))
    return benchmark.category_averages(r).select("industry", F.explode("avg_category_scores").alias("category", "mean"))


@query(f"WITH {_SNAPS} SELECT period_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lead_id, period_type ORDER BY period_start DESC) AS r FROM snaps) WHERE r = 1 GROUP BY period_type")
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_stats(snapshots.latest(_snaps(spark, sf_dir)))[0]


@query(f"WITH {_SNAPS} SELECT lead_id, period_type, period_start FROM snaps WHERE period_start < CASE period_type WHEN 'day' THEN DATE '2024-01-15' ELSE DATE '2023-12-25' + 7 END")
def old_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.old_snapshots(_snaps(spark, sf_dir), dt.datetime(2024, 1, 25), 10).where("period_type = 'day'").unionByName(retention.old_snapshots(_snaps(spark, sf_dir), dt.datetime(2024, 1, 25), 3).where("period_type = 'week'")).select("lead_id", "period_type", "period_start")


@query("""WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
 SELECT 'email_logs' AS target, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-06-01' - INTERVAL 365 DAY) AS n UNION ALL SELECT 'demand_signals', (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '2024-06-01' - INTERVAL 90 DAY) UNION ALL SELECT 'competitor_snapshots', (SELECT count(*) FROM r WHERE n > 10)""")
def cleanup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").select(F.col("ts").alias("created_at"))
    late = table(spark, sf_dir, "orders").select(F.lit("expired").alias("status"), F.col("o_orderdate").alias("deadline"))
    return retention.cleanup_counts(logs, late, _facts(spark, sf_dir), AS_OF)


@query("WITH m AS (SELECT event_id, value * 50 AS lcp, value * 30 AS fcp, value / 500 AS cls, value * 20 AS ttfb FROM events) SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN lcp > 4000 THEN 'perf_lcp_poor' WHEN lcp > 2500 THEN 'perf_lcp_needs_improvement' END, CASE WHEN fcp > 3000 THEN 'perf_fcp_poor' WHEN fcp > 1800 THEN 'perf_fcp_needs_improvement' END, CASE WHEN cls > 0.25 THEN 'perf_cls_poor' WHEN cls > 0.1 THEN 'perf_cls_needs_improvement' END, CASE WHEN ttfb > 1800 THEN 'perf_ttfb_poor' WHEN ttfb > 800 THEN 'perf_ttfb_needs_improvement' END], lambda x: x IS NOT NULL)) AS code FROM m) GROUP BY code")
def metric_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rest = {"overflow_mobile": "boolean", "overflow_tablet": "boolean", "small_targets_mobile": "int", "small_targets_tablet": "int", "padding_values": "int", "font_families": "int", "font_sizes": "int", "upscaled_images": "int", "modernity_score": "int"}
    m = table(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), (v * 50).alias("lcp"), (v * 30).alias("fcp"), (v / 500).alias("cls"), (v * 20).alias("ttfb"), *(F.lit(None).cast(t).alias(c) for c, t in rest.items()))
    return signals.counts(audit.measured_issues(m, measured.metric_rules()), "code")


@query(f"WITH {_PAGE_ISSUES}, {_REGISTRY} SELECT page_id, category, count(*) AS issues, count(*) FILTER (severity = 'critical') AS critical, CAST(sum(weight) AS BIGINT) AS score FROM c JOIN reg USING (code) GROUP BY ALL")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_audits(spark, sf_dir).withColumnRenamed("page_id", "analysis_id")
    summary, _ = tables.report(found, found.select("analysis_id", F.lit("bad").alias("status")).distinct())
    return summary.withColumnRenamed("analysis_id", "page_id")


@query("SELECT message_id, type, email, bounce_type FROM (SELECT 'm' || event_id AS message_id, CASE event_type WHEN 'error' THEN 'bounce' WHEN 'click' THEN 'click' END AS type, 'u' || user_id || '@x.cz' AS email, CASE event_type WHEN 'error' THEN 'Permanent' END AS bounce_type FROM events) WHERE type IS NOT NULL")
def mail_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.struct(F.concat(F.lit("m"), "event_id").alias("messageId"), F.array(F.concat(F.lit("U"), "user_id", F.lit("@x.cz"))).alias("destination"))
    bounce = F.when(F.col("event_type") == "error", F.struct(F.lit("Permanent").alias("bounceType")))
    message = F.to_json(F.struct(F.when(F.col("event_type") == "error", "Bounce").alias("notificationType"), F.when(F.col("event_type") == "click", "Click").alias("eventType"), mail.alias("mail"), bounce.alias("bounce")))
    raw = table(spark, sf_dir, "events").select(F.lit("Notification").alias("Type"), message.alias("Message"))
    return tables.mail_events(raw).select("message_id", "type", "email", "bounce_type")


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS ico, c_name AS name, 'Street' || CASE WHEN c_nationkey > 0 THEN ' ' || c_nationkey || CASE WHEN c_custkey % 9 > 0 THEN '/' || c_custkey % 9 ELSE '' END ELSE '' END || ', ' || c_mktsegment AS full_address, CASE WHEN c_acctbal > 0 THEN 'Aktivní' ELSE 'OTHER' END AS business_status FROM customer")
def registry_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Houses with and without a second number; no house."""
    c = table(spark, sf_dir, "customer")
    seat = F.struct(F.lit("Street").alias("nazevUlice"), F.col("c_nationkey").alias("cisloDomovni"), (F.col("c_custkey") % 9).alias("cisloOrientacni"), F.col("c_mktsegment").alias("nazevObce"))
    response = F.to_json(F.struct(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("ico"), F.col("c_name").alias("obchodniJmeno"), seat.alias("sidlo"), F.when(F.col("c_acctbal") > 0, "AKTIVNI").otherwise("OTHER").alias("stavSubjektu")))
    return tables.companies(c.select(response.alias("response"))).select("ico", "name", "full_address", "business_status")


@query("""WITH r AS (SELECT o_custkey, count(*) FILTER (r <= 10) AS n, round(sum(o_totalprice) FILTER (r <= 10), 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) GROUP BY o_custkey),
 m AS (SELECT o_custkey, least(count(DISTINCT date_trunc('month', o_orderdate)), 20) AS n_snapshots, CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS newest FROM orders GROUP BY o_custkey) SELECT c_custkey AS lead_id, c_name AS company, n, total, n_snapshots, newest FROM customer LEFT JOIN r ON r.o_custkey = c_custkey LEFT JOIN m ON m.o_custkey = c_custkey""")
def lead_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leads with company, runs and snapshots; leads without runs have neither."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("lead_id"), F.col("o_orderkey").alias("analysis_id"), F.col("o_orderdate").alias("created_at"), "o_totalprice")
    snaps = r.select("lead_id", F.trunc("created_at", "month").alias("period_start")).distinct()
    leads = c.select(F.col("c_custkey").alias("lead_id"), F.col("c_custkey").alias("company_id"))
    b = discovery.lead_bundle(leads, r, snaps, c.select(F.col("c_custkey").alias("ico"), F.col("c_name").alias("name")))
    has = lambda c, value: F.when(F.col(c).isNotNull(), value)
    total = F.round(F.aggregate("runs", F.lit(0.0), lambda a, x: a + x["o_totalprice"]), 2)
    return b.select("lead_id", F.col("company.name").alias("company"), has("runs", F.size("runs")).cast("long").alias("n"), has("runs", total).alias("total"), has("snapshots", F.size("snapshots")).cast("long").alias("n_snapshots"), F.get("snapshots", F.lit(0))["period_start"].alias("newest"))


# --- streams: the source's files pass in micro-batches; what was said last is compared -----------------------------------------------

def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the name is a pattern, since a stream's plain path must be a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _mail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_mails(read_stream(spark, sf_dir, "events")).withColumn("event_time", F.col("event_time").cast("timestamp"))


@query(f"WITH {MAILS}, {STATES} SELECT message_id, sent_at, delivered_at, opened_at, clicked_at, bounced_at, bounce_type, status, last_event_at FROM states")
def stream_mail_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.settled(flows.mail_states(_mail_stream(spark, sf_dir)), ["message_id"])


@query(f"WITH {MAILS} SELECT user_id, date_trunc('hour', event_time) AS start, " + ", ".join(f"count(*) FILTER (type = '{k}') AS {k}" for k in ("send", "delivery", "open", "click", "bounce", "complaint")) + " FROM mails GROUP BY ALL")
def stream_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.settled(flows.funnel(_mail_stream(spark, sf_dir)), ["user_id", "start"]).drop("end")


@query(f"WITH {MAILS} SELECT user_id, split_part(email, '@', 2) AS domain, start, count(*) AS sends FROM (SELECT *, unnest(generate_series(date_trunc('minute', event_time) - to_minutes(CAST(minute(event_time) % 5 AS INT)) - INTERVAL 55 MINUTE, date_trunc('minute', event_time) - to_minutes(CAST(minute(event_time) % 5 AS INT)), INTERVAL 5 MINUTE)) AS start FROM mails WHERE type = 'send') GROUP BY ALL")
def stream_send_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.settled(flows.send_rate(_mail_stream(spark, sf_dir), True), ["user_id", "domain", "start"]).drop("end")


@query("SELECT user_id AS domain, event_type AS snapshot_type, ts AS taken_at, event_id AS id, lag(event_id % 5) OVER w AS previous_hash, coalesce(event_id % 5 <> lag(event_id % 5) OVER w, false) AS has_changes FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def stream_snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_stream(spark, sf_dir, "events")
    snaps = raw.select(F.col("user_id").cast("string").alias("domain"), F.col("event_type").alias("snapshot_type"), F.col("ts").cast("timestamp").alias("taken_at"), F.col("event_id").alias("snapshot_id"), (F.col("event_id") % 5).cast("string").alias("content_hash"))
    said = settle.settled(flows.snapshot_changes(snaps), ["domain", "snapshot_type", "snapshot_id"])
    return said.select(F.col("domain").cast("long").alias("domain"), "snapshot_type", F.col("taken_at").cast("timestamp_ntz").alias("taken_at"), F.col("snapshot_id").alias("id"), F.col("previous_hash").cast("long").alias("previous_hash"), "has_changes")


@query(f"WITH {_PAGE_ISSUES}, {_REGISTRY}, {_SCORES} SELECT page_id, total_score, {_STATUS} AS status FROM s")
def stream_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_stream(spark, sf_dir, "pages")
    found = audit.audit(pages, AS_OF, categories=CATEGORIES).groupBy("page_id").agg(F.sum("weight").alias("total_score"), F.max(F.col("severity") == "critical").alias("critical"))
    return settle.settled(found, ["page_id"]).select("page_id", "total_score", scoring.lead_status(F.col("total_score"), F.col("critical")).alias("status"))

from . import built_pages, more, page_sql, spellings, whole  # noqa: E402, F401  they register further queries, by the helpers above
