"""The audit: pages to issues.  One select computes all rules of a page; no shuffle."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import visible_text
from ..functions.urls import base_url
from .extract import detect_cms
from .registry import CATEGORIES, with_registry
from .rules import Markup, Rule, content, industries, markup, technical

UNIVERSAL: dict[str, Callable[[dict[str, Column]], list[Rule]]] = {
    "http": technical.http, "security": technical.security, "seo": technical.seo, "libraries": technical.libraries, "outdated_code": technical.outdated_code,
    "cms_quality": content.cms_quality, "content_quality": content.content_quality, "branding": content.branding, "navigation_ux": content.navigation_ux,
    "conversion": content.conversion, "legal_compliance": content.legal_compliance, "typography": technical.typography,
}
BY_INDUSTRY = {
    "eshop": industries.eshop, "webdesign": industries.webdesign, "real_estate": industries.real_estate, "automobile": industries.automobile,
    "restaurant": industries.restaurant, "medical": industries.medical,
}
#: Columns that a page may lack, with their types; they count as null.
OPTIONAL = {"status": "int", "headers": "map<string,string>", "industry": "string", "error": "string", "ttfb_s": "double", "cert_days": "int", "ssl_error": "string", "soft_404_status": "int", "has_sitemap": "boolean", "has_robots": "boolean"}

#: Columns of a prepared page that rules read.
PREPARED = [*OPTIONAL, "page_id", "url", "html", "low", "text", "cms", "as_of", "_years", *technical.OUTDATED_FACTS]


def spread(pages: DataFrame, rows: int = 2000) -> DataFrame:
    """A table just read, dealt out anew unless it has as many partitions as there are cores, and one for each so many ``rows``: one
    small file would be one long task, and tasks must not grow with the table."""
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // rows))
    return pages.repartition(parts) if pages.rdd.getNumPartitions() < parts else pages


def prepare(pages: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Pages with all columns that rules read: missing ones null, header names in lower case, the visible text and the CMS (S3)."""
    for name, kind in OPTIONAL.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    html = F.coalesce(F.col("html"), F.lit(""))
    headers = F.coalesce(F.transform_keys("headers", lambda k, _: F.lower(k)), F.create_map().cast("map<string,string>"))
    pages = pages.withColumn("html", html).withColumn("headers", headers).withColumn("low", F.lower("html"))
    pages = pages.withColumn("text", visible_text(F.col("html"))).withColumn("cms", detect_cms(F.col("html"), F.col("headers"))).withColumn("as_of", F.lit(as_of).cast("timestamp_ntz"))
    # what several rules ask for, found once
    return pages.withColumns(_facts(pages.sparkSession.sparkContext.applicationId))


@functools.lru_cache(maxsize=16)
def _facts(application: str) -> dict[str, Column]:
    """They are columns by name, so a session builds them once, like the rules."""
    p = {c: F.col(c) for c in ("html", "low", "headers", "as_of")}
    return {"_years": technical.copyright_years(markup(p), F.year("as_of"))} | technical.outdated_facts(p)


def with_site_files(pages: DataFrame) -> DataFrame:
    """Whether the pages table has sitemap.xml and robots.txt of each page's site (A3)."""
    files = pages.select(base_url(F.col("url")).alias("_site"), F.regexp_extract("url", r"^[^?#]*?/(sitemap\.xml|robots\.txt)$", 1).alias("f")).where("f <> ''")
    known = files.groupBy("_site").agg(F.max(F.col("f") == "sitemap.xml").alias("_s"), F.max(F.col("f") == "robots.txt").alias("_r"))
    joined = pages.withColumn("_site", base_url(F.col("url"))).join(known, "_site", "left")
    return joined.withColumn("has_sitemap", F.coalesce("_s", F.lit(False))).withColumn("has_robots", F.coalesce("_r", F.lit(False))).drop("_site", "_s", "_r")


def _struct(r: Rule) -> Column:
    return F.when(r.when, F.struct(F.lit(r.category).alias("category"), F.lit(r.code).alias("code"), (F.lit(None) if r.evidence is None else r.evidence).cast("string").alias("evidence")))


def _listed(rules: list[Rule]) -> Column:
    return F.array(*map(_struct, rules))


@functools.lru_cache(maxsize=256)
def _built(application: str, name: str) -> tuple[Column, ...]:
    """The structs of a category's rules over a prepared page.  They are columns by name, so a session builds them once; making them
    takes longer than auditing some pages."""
    p = {c: F.col(c) for c in PREPARED}
    return tuple(map(_struct, BY_INDUSTRY[name](p) if name in BY_INDUSTRY else UNIVERSAL[name](p)))


def issues(pages: DataFrame, as_of: dt.datetime, categories: list[str] | None = None, extra: Callable[[dict[str, Column]], list[Rule]] | None = None, id_col: str = "page_id") -> DataFrame:
    """Issues (page_id, category, code, evidence) of the universal categories and, for pages of an industry, of that industry.

    ``categories`` restricts the universal ones; ``extra`` adds rules of one's own.  Industry rules run only on rows of theirs.
    """
    page = prepare(pages, as_of)
    session = page.sparkSession.sparkContext.applicationId
    chosen = [c for name in UNIVERSAL if categories is None or name in categories for c in _built(session, name)]
    chosen += map(_struct, extra({c: F.col(c) for c in page.columns}) if extra else [])
    lists = [F.array(*chosen)] if chosen else []
    none = F.array().cast("array<struct<category:string,code:string,evidence:string>>")
    by_industry = none
    for name in BY_INDUSTRY:
        if categories is None or f"industry_{name}" in categories:
            by_industry = F.when(F.col("industry") == name, F.array(*_built(session, name))).otherwise(by_industry)
    every = F.concat(*lists, by_industry)
    return _exploded(page, every, id_col)


def _exploded(pages: DataFrame, every: Column, id_col: str) -> DataFrame:
    """The structs of ``every`` that are there, a row each.  The array is a column first, where what several rules ask for is computed
    once.  Outer: else Spark puts a filter on the array's size below all else, and computes every rule there once more, in full."""
    listed = pages.select(id_col, every.alias("every"))
    return listed.select(id_col, F.explode_outer("every").alias("i")).where("i is not null").select(id_col, "i.*")


def measured_issues(metrics: DataFrame, rules: list[Rule], id_col: str = "page_id") -> DataFrame:
    """Issues of rules over a table of measurements."""
    return _exploded(metrics, _listed(rules), id_col)


def select_issues(found: DataFrame, profile: DataFrame, key: str = "profile_id") -> DataFrame:
    """Drop issues of categories that a profile disables and codes it ignores; both come with the profile (key, category, enabled,
    ignored_codes) (A23)."""
    p = profile.select(key, "category", F.col("enabled").alias("_on"), F.col("ignored_codes").alias("_ignored"))
    joined = found.join(p, [key, "category"], "left")
    return joined.where(F.coalesce("_on", F.lit(True)) & ~F.coalesce(F.array_contains("_ignored", F.col("code")), F.lit(False))).drop("_on", "_ignored")


def configured(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rule configuration: defaults (category, priority, thresholds) with a profile's overrides (profile_id, category, enabled,
    priority, thresholds, ignored_codes) over them; universal categories first, then by priority (A24)."""
    names = [r.category for r in defaults.select("category").collect()]  # 24 at most
    profiles = overrides.select("profile_id").distinct().withColumn("category", F.explode(F.array(*(F.lit(n) for n in names))))
    own = overrides.select("profile_id", "category", "enabled", F.col("priority").alias("_p"), F.col("thresholds").alias("_t"), "ignored_codes")
    joined = profiles.join(F.broadcast(defaults), "category").join(own, ["profile_id", "category"], "left")
    empty = F.create_map().cast("map<string,double>")
    merged = F.map_zip_with(F.coalesce("thresholds", empty), F.coalesce("_t", empty), lambda _, a, b: F.coalesce(b, a))
    return joined.select(
        "profile_id", "category", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("_p", "priority", F.lit(5)).alias("priority"), merged.alias("thresholds"),
        F.coalesce("ignored_codes", F.array().cast("array<string>")).alias("ignored_codes"), F.col("category").startswith("industry_").alias("industry_only"),
    ).orderBy("profile_id", "industry_only", "priority", "category")


def categories_for(industry: str | None) -> list[str]:
    """Universal categories, and the one of the industry."""
    return [c for c in CATEGORIES if not c.startswith("industry_") or c == f"industry_{industry}"]


def shop_pages(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Shop score, platform and confidence of each page."""
    h = Markup(F.coalesce(F.col("html"), F.lit("")), F.lower(F.coalesce(F.col("html"), F.lit(""))))
    scored = pages.select(id_col, content.shop_platform(h).alias("platform"), content.shop_score(h).alias("score"))
    return scored.select("*", (F.col("score") >= 3).alias("is_eshop"), content.shop_confidence(F.col("score")).alias("confidence"))


def quality_scores(found: DataFrame, pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The own 0-to-100 scores of the categories that have one, with their level; pages without issues have 100."""
    flat = [(code, category, n) for category, codes in content.PENALTIES.items() for code, n in codes.items()]
    table = F.broadcast(found.sparkSession.createDataFrame(flat, "code string, category string, penalty int"))
    totals = found.join(table, ["code", "category"]).groupBy(id_col).pivot("category", list(content.PENALTIES)).agg(F.sum("penalty"))
    out = pages.select(id_col).join(totals, id_col, "left")
    for c in content.PENALTIES:
        score = F.greatest(F.lit(100) - F.coalesce(F.col(c), F.lit(0)), F.lit(0))
        a, b, m, z = content.LEVELS[c]
        out = out.withColumn(f"{c}_score", score).withColumn(f"{c}_level", F.when(score >= 90, a).when(score >= 70, b).when(score >= 50, m).otherwise(z)).drop(c)
    return out.withColumn("needs_redesign", F.col("cms_quality_score") < 70)


def outdated_scores(pages: DataFrame, as_of: dt.datetime, id_col: str = "page_id") -> DataFrame:
    """The weighted outdated score of each page and its level (A5)."""
    page = prepare(pages, as_of)
    scored = page.select(id_col, technical.outdated_score({c: F.col(c) for c in page.columns}).alias("outdated_score"))
    return scored.select("*", (F.col("outdated_score") >= 5).alias("is_outdated"), technical.level(F.col("outdated_score"), technical.OUTDATED_LEVELS, "low").alias("outdated_level"))


def audit(pages: DataFrame, as_of: dt.datetime, **options: object) -> DataFrame:
    """Issues with category, severity and weight of the registry."""
    return with_registry(issues(pages, as_of, **options))
