"""Changes of competitors' sites between snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance_grade
from ..functions.terms import namer
from ..functions.text import price

# Fixed values.
WEIGHTS = {"critical": 100, "high": 75, "medium": 50, "low": 25}
SNAPSHOT_DAYS = {"portfolio": 7, "pricing": 14, "services": 14, "team": 30, "technology": 30, "content": 7}
CRAWL_DAYS = {"daily": 1, "weekly": 7, "biweekly": 14, "monthly": 30}
TECHNOLOGIES = ["React", "Vue", "Angular", "Svelte", "Next.js", "Nuxt", "JavaScript", "TypeScript", "jQuery", "PHP", "Laravel", "Symfony", "Node.js", "Python", "Django", "Ruby on Rails", "Java", "Spring", ".NET", "C#", "Go", "Rust", "WordPress", "Drupal", "Joomla", "Strapi", "Contentful", "WooCommerce", "Shopify", "Magento", "PrestaShop", "Shoptet", "MySQL", "PostgreSQL", "MongoDB", "Redis", "AWS", "Azure", "Google Cloud", "DigitalOcean", "Docker", "Kubernetes", "CI/CD", "Jenkins", "GitHub Actions", "Figma", "Sketch", "Adobe XD", "Photoshop", "Illustrator"]
METHODOLOGIES = ["Agile", "Scrum", "Kanban", "Waterfall", "Design Thinking", "Lean", "DevOps", "Test-Driven", "TDD", "BDD", "CI/CD", "Continuous Integration"]
INDUSTRY_STEMS = {"e-commerce": "E-commerce", "e-shop": "E-commerce", "eshop": "E-commerce", "finan": "Finance", "bank": "Finance", "zdravot": "Healthcare", "medical": "Healthcare", "nemovit": "Real Estate", "reality": "Real Estate", "vzdělá": "Education", "škol": "Education", "právn": "Legal", "advokát": "Legal", "restaur": "Restaurant", "gastro": "Restaurant", "auto": "Automotive"}
CERTIFICATIONS = ["Google Partner", "Google Ads", "Google Analytics", "Meta Partner", "Facebook Partner", "Shopify Partner", "Shopify Plus", "ISO 27001", "ISO 9001", "Microsoft Partner", "AWS Partner", "HubSpot Partner", "Salesforce Partner"]


def content_hash(*fields: Column | str, maps: list[str] | None = None) -> Column:
    """sha256 of the fields' JSON in a fixed order; maps as entries sorted by key."""
    sorted_maps = [F.array_sort(F.map_entries(m)).alias(m) for m in maps or []]
    return F.sha2(F.to_json(F.struct(*fields, *sorted_maps)), 256)


def with_previous(snaps: DataFrame, value: str, by: tuple[str, ...] = ("domain", "snapshot_type"), at: str = "taken_at", tie: str | None = None) -> DataFrame:
    """Snapshots with the previous value of the same domain and type, and whether there is a change; a first one has none."""
    w = Window.partitionBy(*by).orderBy(at, *([tie] if tie else []))
    out = snaps.withColumn(f"previous_{value}", F.lag(value).over(w))
    return out.withColumn("has_changes", F.coalesce(F.col(value) != F.col(f"previous_{value}"), F.lit(False)))


def numeric_significance(before: Column, after: Column) -> Column:
    """By percent of change; from nothing it is 100."""
    percent = F.when(before > 0, F.abs(after - before) / before * 100).otherwise(100.0)
    return F.when(percent >= 50, "critical").when(percent >= 25, "high").when(percent >= 10, "medium").otherwise("low")


def array_significance(before: Column, after: Column) -> Column:
    """By items added and removed; repeated items count once (C4)."""
    b, a = F.array_distinct(before), F.array_distinct(after)
    n = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    percent = n / F.greatest(F.size(b), F.size(a), F.lit(1)) * 100
    return F.when((percent >= 50) | (n >= 5), "high").when((percent >= 20) | (n >= 3), "medium").otherwise("low")


def string_significance(before: Column, after: Column) -> Column:
    """By edit distance in characters against the longer length (C5).  Only whether it reaches the limits counts, so long texts are
    tried against these, and no whole distance is computed."""
    reached = distance_grade(before, after, [20, 50])
    return F.when(reached == 2, "high").when(reached == 1, "medium").otherwise("low")


def _step(before: Column, after: Column) -> Column:
    percent = F.abs(after - before) / F.nullif(before, F.lit(0.0)) * 100
    return F.when(percent >= 20, "high").when(percent >= 10, "medium").when(before == 0, "high").otherwise("low")


def _change(field: Column | str, before: Column, after: Column, significance: Column | str, when: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(lit(field).alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"), lit(significance).alias("significance")))


def _changes(pairs: DataFrame, changes: list[Column], keep: list[str]) -> DataFrame:
    return pairs.select(*keep, F.explode(F.filter(F.array(*changes), lambda c: c.isNotNull())).alias("c")).select(*keep, "c.*")


def _pairs(facts: DataFrame, columns: list[str], at: str) -> DataFrame:
    w = Window.partitionBy("domain").orderBy(at)
    out = facts
    for c in columns:
        out = out.withColumn(f"_{c}", F.lag(c).over(w))
    return out.withColumn("_n", F.row_number().over(w)).where("_n > 1")


def pricing_changes(facts: DataFrame, at: str = "taken_at") -> DataFrame:
    """Facts (domain, taken_at, pricing_type, packages[struct(name, price)]) to changes between successive ones."""
    p = _pairs(facts.withColumn("price_min", F.array_min(F.transform("packages", lambda x: x["price"]))).withColumn("n", F.size("packages")), ["pricing_type", "packages", "price_min"], at)
    before, now, n = F.col("_price_min"), F.col("price_min"), F.col("n")
    keep = ["domain", at]
    before_n = F.size("_packages")
    whole = _changes(p, [
        _change("pricing_type", F.col("_pricing_type"), F.col("pricing_type"), "high", F.col("_pricing_type") != F.col("pricing_type")),
        _change("price_min", before, now, _step(before, now), before != now),
        _change("packages_count", before_n, n, F.when(F.abs(n - before_n) >= 2, "high").otherwise("medium"), n != before_n),
    ], keep)
    old = p.select(*keep, F.explode("_packages").alias("x")).select(*keep, F.col("x.name").alias("name"), F.col("x.price").alias("b")).groupBy(*keep, "name").agg(F.max("b").alias("b"))
    new = p.select(*keep, F.explode("packages").alias("x")).select(*keep, F.col("x.name").alias("name"), F.col("x.price").alias("a"))
    each = new.join(old, [*keep, "name"]).where("a <> b")
    return whole.unionByName(each.select(*keep, F.concat(F.lit("package_price_"), "name").alias("field"), F.col("b").cast("string").alias("before"), F.col("a").cast("string").alias("after"), _step(F.col("b"), F.col("a")).alias("significance")))


def _lists(name: str, high: int | None) -> list[Column]:
    now, then = F.array_distinct(F.coalesce(F.col(name), F.array().cast("array<string>"))), F.array_distinct(F.coalesce(F.col(f"_{name}"), F.array().cast("array<string>")))
    added, removed = F.array_except(now, then), F.array_except(then, now)
    weight = lambda xs: F.when(F.size(xs) >= high, "high").otherwise("medium") if high else F.lit("medium")
    return [
        _change(f"{name}_added", F.lit(None), F.array_join(added, ", "), weight(added), F.size(added) > 0),
        _change(f"{name}_removed", F.array_join(removed, ", "), F.lit(None), weight(removed), F.size(removed) > 0),
    ]


def portfolio_changes(facts: DataFrame, at: str = "taken_at") -> DataFrame:
    """Facts (domain, taken_at, total_count, clients[], categories[]) to changes."""
    p = _pairs(facts, ["total_count", "clients", "categories"], at)
    before, now = F.coalesce("_total_count", F.lit(0)), F.coalesce("total_count", F.lit(0))
    other = ~F.col("categories").eqNullSafe(F.col("_categories"))
    return _changes(p, [
        _change("total_count", before, now, numeric_significance(before, now), before != now), *_lists("clients", 3),
        _change("categories", F.array_join("_categories", ", "), F.array_join("categories", ", "), "medium", other),
    ], ["domain", at])


def service_changes(facts: DataFrame, at: str = "taken_at") -> DataFrame:
    """Facts (domain, taken_at, services[], technologies[], certifications[]) to changes."""
    p = _pairs(facts, ["services", "technologies", "certifications"], at)
    return _changes(p, [*_lists("services", 3), *_lists("technologies", 3), _lists("certifications", None)[0]], ["domain", at])


def name_terms(pages: DataFrame, lists: dict[str, dict[str, str]], text: str = "html") -> DataFrame:
    """``pages`` with an array for each list (lower-cased term -> name): the names whose terms stand in the lower-cased text, each
    once, in the list's order (C9).  One pass over the text looks for the terms of all lists."""
    find = namer(pages.sparkSession, lists)
    found = pages.withColumn("_named", find(F.lower(F.coalesce(F.col(text), F.lit("")))))
    return found.select(*pages.columns, *(F.col("_named")[c].alias(c) for c in lists))


def vocabulary_facts(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Technologies, methodologies, industries and certifications that a page names."""
    own = {"technologies": TECHNOLOGIES, "methodologies": METHODOLOGIES, "certifications": CERTIFICATIONS}
    lists = {column: {t.lower(): t for t in terms} for column, terms in own.items()} | {"industries": INDUSTRY_STEMS}
    return name_terms(pages.select(id_col, F.col("html").alias("_html")), lists, "_html").select(id_col, "technologies", "methodologies", "industries", "certifications")


def price_facts(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Amounts with currency, pricing type, whether quotes are individual, lowest and highest amount, currency."""
    h = F.coalesce(F.col("html"), F.lit(""))
    amounts = F.filter(F.transform(F.regexp_extract_all(h, F.lit(r"(?iu)(\d[\d\s]*)\s*(Kč|CZK|€|EUR)"), F.lit(1)), price), lambda x: x.isNotNull())
    kind = F.when(h.rlike(r'class\s*=\s*["\'][^"\']*pricing'), "tiered").when(h.rlike(r"(?i)\bhod\b|\bhodinu?\b|/h\b|hour"), "hourly").when(h.rlike(r"(?i)od\s+\d|from\s+\d|projekt|project"), "project").otherwise("fixed")
    rows = pages.select(id_col, amounts.alias("prices"), kind.alias("pricing_type"), F.lower(h).rlike("na míru|individuální|custom").alias("has_custom_quote"), F.when(h.rlike("€|EUR"), "EUR").otherwise("CZK").alias("currency"))
    return rows.select("*", F.array_min("prices").alias("price_min"), F.array_max("prices").alias("price_max"))


def metrics(facts: DataFrame) -> DataFrame:
    """Counts and ends of each snapshot's facts (C11)."""
    lists = [c for c, t in facts.dtypes if t.startswith("array") and c != "packages"]
    out = [F.coalesce(F.size(c), F.lit(0)).alias(f"{c}_count") for c in lists]
    if "packages" in facts.columns:
        prices = F.transform("packages", lambda x: x["price"])
        out += [F.size("packages").alias("packages_count"), F.array_min(prices).alias("price_min"), F.array_max(prices).alias("price_max")]
    keep = [c for c in ("domain", "snapshot_type", "taken_at", "pricing_type", "total_count") if c in facts.columns]
    return facts.select(*keep, *out)


def weight(significance: Column) -> Column:
    out = F.lit(0)
    for s, w in WEIGHTS.items():
        out = F.when(significance == s, F.lit(w)).otherwise(out)
    return out


def snapshot_significance(changes: DataFrame, *key: str) -> DataFrame:
    """The greatest significance of each snapshot's changes."""
    return changes.groupBy(*key).agg(F.max_by("significance", weight(F.col("significance"))).alias("significance"), F.count("*").alias("changes"))


def due_for_snapshot(domains: DataFrame, snaps: DataFrame, snapshot_type: str, as_of: dt.datetime) -> DataFrame:
    """Active domains without a snapshot of the type within its days."""
    recent = snaps.where((F.col("snapshot_type") == snapshot_type) & (F.col("taken_at") >= F.lit(as_of - dt.timedelta(days=SNAPSHOT_DAYS[snapshot_type]))))
    return domains.where("active").join(recent.select("domain"), "domain", "left_anti")


def due_for_crawl(domains: DataFrame, subscriptions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Active domains with a subscriber that were never crawled, or longer ago than their frequency."""
    days = F.lit(7)
    for name, n in CRAWL_DAYS.items():
        days = F.when(F.col("crawl_frequency") == name, F.lit(n)).otherwise(days)
    late = F.col("last_crawled_at").isNull() | (F.date_diff(F.lit(as_of).cast("timestamp_ntz"), F.col("last_crawled_at")) >= days)
    return domains.where(F.col("active") & late).join(subscriptions.select("domain").distinct(), "domain", "left_semi")


def changes_at_least(changes: DataFrame, least: str, since: dt.datetime | None = None, at: str = "taken_at") -> DataFrame:
    """Changes of a significance or more, since a time (C14); alerts are those from high on."""
    out = changes.where(weight(F.col("significance")) >= WEIGHTS[least])
    return out if since is None else out.where(F.col(at) >= F.lit(since))


def fan_out(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Changes for each subscriber with alerts on whose least significance they reach."""
    own = subscriptions.where("alert_on_change").select("user_id", "domain", F.col("snapshot_types").alias("_types"), F.col("min_significance").alias("_least"))
    joined = changes.join(own, "domain").where(weight(F.col("significance")) >= weight(F.col("_least")))
    if "snapshot_type" in changes.columns:
        joined = joined.where((F.coalesce(F.size("_types"), F.lit(0)) <= 0) | F.array_contains("_types", F.col("snapshot_type")))
    return joined.drop("_types", "_least")


def keep_latest(snaps: DataFrame, n: int = 10, by: tuple[str, ...] = ("domain", "snapshot_type"), at: str = "taken_at", tie: str | None = None) -> DataFrame:
    """The newest n snapshots of each domain and type."""
    w = Window.partitionBy(*by).orderBy(F.desc(at), *([F.desc(tie)] if tie else []))
    return snaps.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
