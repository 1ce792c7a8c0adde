"""Discovery as table work: candidates, link graph, companies, queues."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_tags
from ..functions.urls import CLIENT_SKIP_DOMAINS, domain, exclude_domains, is_page_url, is_skipped, normalise_url, resolve, strip_tracking
from .extract import links
from .ranks import numbered

# Catalogues by source, words of reference pages and of links to them.
CATALOGUES = {
    "firmy_cz": "firmy.cz", "ekatalog": "ekatalog.cz", "atlas_skolstvi": "atlasskolstvi.cz", "brno_katalog_skol": "brno.cz", "seznam_skol_eu": "seznamskol.eu", "seznam_skol": "seznamskol.cz",
    "jmk_katalog_skol": "skoly.jmk.cz", "seznam": "firmy.seznam.cz", "zive_firmy": "zivefirmy.cz", "najisto": "najisto.centrum.cz", "zlatestranky": "zlatestranky.cz",
}
REFERENCE_PATHS = ["reference", "portfolio", "nase-prace", "our-work", "klienti", "clients", "projects", "projekty", "case-study", "pripadove-studie", "realizace", "showcases", "work", "prace"]
REFERENCE_WORDS = ["reference", "portfolio", "práce", "prace", "klient", "realizac", "projekt", "case", "showcase"]


def source_flags(spark) -> DataFrame:  # noqa: ANN001
    """Sources with catalogue domain and whether they search by query or walk categories."""
    by_query = {"google", "seznam", "firmy_cz", "ekatalog", "zive_firmy", "najisto", "zlatestranky"}
    by_category = {"atlas_skolstvi", "brno_katalog_skol", "seznam_skol_eu", "seznam_skol", "jmk_katalog_skol"}
    names = sorted(by_query | by_category | {"crawler", "reference_crawler", "manual"})
    return spark.createDataFrame([(n, CATALOGUES.get(n), n in by_query, n in by_category) for n in names], "source string, catalogue_domain string, query_based boolean, category_based boolean")


def sources_for(spark, industry: str | None) -> DataFrame:  # noqa: ANN001
    """Sources that an industry may use: mining of client references is for web designers only."""
    return source_flags(spark).where((F.col("source") != "reference_crawler") | F.lit(industry == "webdesign"))


def catalogue_patterns(sources: DataFrame, source_col: str = "source") -> DataFrame:
    """Patterns that exclude the catalogue of each source used: the domain and all below it (D3)."""
    table = F.broadcast(source_flags(sources.sparkSession).where("catalogue_domain is not null").select("source", "catalogue_domain"))
    used = sources.select(F.col(source_col).alias("source")).distinct().join(table, "source")
    return used.select(F.explode(F.array("catalogue_domain", F.concat(F.lit("*."), F.col("catalogue_domain")))).alias("pattern")).distinct()


def known(candidates: DataFrame, leads: DataFrame, per_user: bool = True, negate: bool = False) -> DataFrame:
    """Candidates whose domain is known, to the user or to anyone (D2); ``negate`` keeps the others."""
    keys = ["user_id", "domain"] if per_user else ["domain"]
    return candidates.join(leads.select(*keys).distinct(), keys, "left_anti" if negate else "left_semi")


def outcomes(candidates: DataFrame, leads: DataFrame, patterns: DataFrame, most: int | None = None, order: str = "position") -> DataFrame:
    """Every candidate (user_id, url, source, is_catalogue, position) with domain and outcome: duplicate, excluded, known, over_limit
    or saved (D1).  A catalogue row is its URL, another its domain; the first of a key wins; the limit counts by user, in order."""
    rows = candidates.withColumn("url", normalise_url(F.col("url"))).withColumn("domain", domain(F.col("url")))
    key = F.when(F.coalesce("is_catalogue", F.lit(False)), F.col("url")).otherwise(F.col("domain"))
    rows = rows.withColumn("_key", key)
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy("user_id", "_key").orderBy(order, "url")) == 1)
    allowed = exclude_domains(rows.select("domain").distinct(), patterns).withColumn("_ok", F.lit(True))
    rows = rows.join(allowed, "domain", "left").join(leads.select("user_id", "domain").distinct().withColumn("_known", F.lit(True)), ["user_id", "domain"], "left")
    reason = F.when(~F.col("_first"), "duplicate").when(F.col("_ok").isNull(), "excluded").when(F.col("_known"), "known").otherwise("saved")
    rows = rows.withColumn("outcome", reason).drop("_key", "_first", "_ok", "_known")
    if most is not None:
        rows = numbered(rows, ["user_id"], [order, "url"], "_place", F.col("outcome") == "saved")
        rows = rows.withColumn("outcome", F.when((F.col("outcome") == "saved") & (F.col("_place") > most), "over_limit").otherwise(F.col("outcome"))).drop("_place")
    return rows


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "outcome").agg(F.count("*").alias("n"))


def link_graph(pages: DataFrame, leads: DataFrame | None = None) -> DataFrame:
    """Domains that pages of done leads link to, other than their own and those never taken, each with its first source."""
    edges = links(pages).withColumn("source_domain", domain(F.col("url"))).withColumn("target_domain", domain(F.col("target")))
    if leads is not None:
        edges = edges.join(leads.where(F.col("status") == "done").select(F.col("domain").alias("source_domain")).distinct(), "source_domain", "left_semi")
    edges = edges.where((F.col("source_domain") != F.col("target_domain")) & ~is_skipped(F.col("target_domain")))
    w = Window.partitionBy("target_domain").orderBy("page_id", "place", "target")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("target_domain", F.col("target").alias("url"), "source_domain", F.col("page_id").alias("found_on"))


def reference_links(pages: DataFrame) -> DataFrame:
    """Links (page_id, url, place, target) to reference pages of a page's own site: by their path, or by the words of the whole tag,
    its text and attributes (D5)."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?is)(<a[^>]+href=["\'][^"\']+["\'][^>]*>.*?</a>)'), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(tags).alias("place", "tag"))
    rows = rows.withColumn("href", F.trim(F.regexp_extract("tag", r'(?is)^<a[^>]+href=["\']([^"\']+)["\']', 1))).where(~F.col("href").rlike("^(#|javascript:|$)"))
    rows = rows.withColumn("target", resolve(F.col("href"), F.col("url")))
    path, said = F.lower(F.coalesce(F.try_parse_url("target", F.lit("PATH")), F.lit(""))), F.lower(F.concat_ws(" ", strip_tags(F.col("tag")), "tag"))
    refers = path.rlike("|".join(REFERENCE_PATHS)) | said.rlike("|".join(REFERENCE_WORDS))
    return rows.where((domain(F.col("target")) == domain(F.col("url"))) & refers).select("page_id", "url", "place", "target")


def client_references(pages: DataFrame, agencies: DataFrame, most_pages: int = 5) -> DataFrame:
    """Clients of agencies: external links of up to ``most_pages`` reference pages of each agency, one row for each client."""
    own = pages.withColumn("agency_domain", domain(F.col("url"))).join(agencies.select(F.col("domain").alias("agency_domain")).distinct(), "agency_domain", "left_semi")
    inner = reference_links(own).groupBy(domain(F.col("url")).alias("agency_domain"), "target").agg(F.min(F.struct("page_id", "place")).alias("o"))
    w = Window.partitionBy("agency_domain").orderBy("o", "target")
    chosen = inner.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most_pages).select("agency_domain", F.col("target").alias("found_on"))
    referring = pages.join(chosen.select(F.col("found_on").alias("url")).distinct(), "url", "left_semi")
    targets = links(referring).select(F.col("url").alias("found_on"), F.col("target").alias("url"), "place").join(chosen, "found_on").withColumn("domain", domain(F.col("url")))
    real = targets.where((F.col("domain") != F.col("agency_domain")) & ~is_skipped(F.col("domain"), CLIENT_SKIP_DOMAINS, True) & is_page_url(F.col("url")))
    best = Window.partitionBy("domain").orderBy("agency_domain", "found_on", "place")
    return real.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("domain", "url", "agency_domain", "found_on")


def batch_plan(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Profiles with a reason to be skipped or null, in order of processing."""
    joined = profiles.join(users.select("user_id", F.col("active").alias("_active")), "user_id", "left")
    reason = (
        F.when(~F.coalesce("_active", F.lit(False)), "inactive_user").when(~F.coalesce("discovery_enabled", F.lit(False)), "disabled").when(F.col("source").isNull(), "no_source")
        .when(F.coalesce(F.size("queries"), F.lit(0)) <= 0, "no_queries")
    )
    return joined.withColumn("skip_reason", reason).drop("_active").orderBy(F.desc("priority"), "name")


def link_companies(leads: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leads with their company by id where they have an id and no company, and the companies with the missing ones added."""
    wanted = leads.where("ico is not null and company_id is null")
    missing = wanted.groupBy("ico").agg(F.min("company_name").alias("name")).join(companies.select("ico"), "ico", "left_anti")
    every = companies.unionByName(missing, allowMissingColumns=True)
    named = every.select("ico", F.col("name").alias("_name"))
    joined = leads.join(named, "ico", "left")
    linked = joined.withColumn("company_id", F.coalesce("company_id", F.when(F.col("_name").isNotNull() | F.col("ico").isNotNull(), F.col("ico")))).withColumn("company_name", F.coalesce("company_name", "_name"))
    return linked.select(*leads.columns), every


def companies_due(companies: DataFrame, as_of: dt.datetime, days: int = 30, most: int | None = None) -> DataFrame:
    """Never refreshed, or longer ago than ``days``; those never refreshed first."""
    due = companies.where(F.col("ares_updated_at").isNull() | (F.col("ares_updated_at") < F.lit(as_of - dt.timedelta(days=days)))).orderBy(F.asc_nulls_first("ares_updated_at"), "ico")
    return due if most is None else due.limit(most)


def company_stats(companies: DataFrame, leads: DataFrame) -> DataFrame:
    """Total, with registry data, with a lead."""
    linked = leads.where("company_id is not null").select(F.col("company_id").alias("ico")).distinct().withColumn("_l", F.lit(1))
    return companies.join(linked, "ico", "left").agg(F.count("*").alias("total"), F.count("ares_updated_at").alias("with_registry_data"), F.count("_l").alias("with_leads"))


def companies_by_status(companies: DataFrame) -> DataFrame:
    return companies.groupBy(F.coalesce("business_status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def work_queue(leads: DataFrame, status: str | None = "new", most: int | None = None, offset: int = 0) -> DataFrame:
    """Leads of a status by priority, then age."""
    rows = (leads if status is None else leads.where(F.col("status") == status)).orderBy(F.desc("priority"), "created_at", "lead_id")
    return (rows.offset(offset) if offset else rows) if most is None else rows.offset(offset).limit(most)


def audit_candidates(leads: DataFrame, again: bool = False, most: int | None = None, offset: int = 0) -> DataFrame:
    """New leads, or with ``again`` all that are not dismissed and have a website."""
    chosen = leads.where((F.col("status") != "dismissed") & F.col("has_website")) if again else leads.where(F.col("status") == "new")
    return work_queue(chosen, None, most, offset)


def lead_bundle(leads: DataFrame, runs: DataFrame, snaps: DataFrame, companies: DataFrame, most_runs: int = 10, most_snaps: int = 20) -> DataFrame:
    """Leads with company, newest runs and newest snapshots as lists."""

    def newest(rows: DataFrame, order: list[Column], most: int, name: str) -> DataFrame:
        top = rows.withColumn("_n", F.row_number().over(Window.partitionBy("lead_id").orderBy(*order))).where(F.col("_n") <= most)
        fields = [c for c in rows.columns if c != "lead_id"]
        return top.groupBy("lead_id").agg(F.array_sort(F.collect_list(F.struct("_n", *fields))).alias(name))

    out = leads.join(companies.select(F.col("ico").alias("company_id"), F.struct("*").alias("company")), "company_id", "left")
    out = out.join(newest(runs, [F.desc("created_at"), F.desc("analysis_id")], most_runs, "runs"), "lead_id", "left")
    return out.join(newest(snaps, [F.desc("period_start")], most_snaps, "snapshots"), "lead_id", "left").withColumn("latest_run", F.get("runs", F.lit(0)))


def leads_per_profile(profiles: DataFrame, leads: DataFrame) -> DataFrame:
    """Counts by profile, zeros kept."""
    return profiles.select("profile_id").join(leads.groupBy("profile_id").agg(F.count("lead_id").alias("n")), "profile_id", "left").fillna(0, ["n"])


def visible_users(users: DataFrame) -> DataFrame:
    """Pairs (viewer, user_id): an admin sees own and sub-accounts' rows, others their own."""
    own = users.select(F.col("user_id").alias("viewer"), "user_id")
    subs = users.where("admin_id is not null").select(F.col("admin_id").alias("viewer"), "user_id")
    return own.union(subs).distinct()


def scope(rows: DataFrame, visible: DataFrame, viewer: object, owner: str = "user_id", through: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """Rows that a viewer may see, by owner, or through a table (its owner and the joining column) without repeats."""
    seen = visible.where(F.col("viewer") == F.lit(viewer)).select(F.col("user_id").alias(owner))
    if through is None:
        return rows.join(seen, owner, "left_semi")
    return rows.join(through.join(seen, owner, "left_semi").select(on).distinct(), on, "left_semi")


def import_urls(raw: DataFrame, leads: DataFrame, user_id: object, per_user: bool = True, url_col: str = "url") -> DataFrame:
    """Rows of an import with url, domain and outcome imported, skipped (known domain or repeated) or errors (no URL)."""
    url = strip_tracking(normalise_url(F.col(url_col)))
    rows = raw.withColumn("_url", url).withColumn("_domain", domain(F.col("_url")))
    bad = F.col(url_col).isNull() | (F.trim(url_col) == "") | F.try_parse_url("_url", F.lit("HOST")).isNull() | ~F.col("_domain").rlike(r"^[^\s.]+(\.[^\s.]+)+$")
    mine = leads.where(F.col("user_id") == F.lit(user_id)) if per_user else leads
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_domain").orderBy("_url")))
    rows = rows.join(mine.select(F.col("domain").alias("_domain"), F.lit(True).alias("_known")).distinct(), "_domain", "left")
    outcome = F.when(bad, "errors").when(F.col("_known") | (F.col("_n") > 1), "skipped").otherwise("imported")
    reason = F.when(bad, "invalid_url").when(F.col("_known") | (F.col("_n") > 1), "domain_exists")
    return rows.select(*raw.columns, F.col("_url").alias("normalised_url"), F.col("_domain").alias("domain"), outcome.alias("outcome"), reason.alias("reason"))
