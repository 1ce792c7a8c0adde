"""URL and domain columns.  All take and return columns; a null stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sites that are never leads, extensions that are never pages, tracking parameters.
SKIP_DOMAINS = [
    "google.com", "google.cz", "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com",
    "wikipedia.org", "seznam.cz", "firmy.cz", "ekatalog.cz", "atlasskolstvi.cz", "seznamskol.cz", "zivefirmy.cz",
    "najisto.centrum.cz", "zlatestranky.cz", "skoly-online.cz", "stredniskoly.cz", "bing.com", "yahoo.com", "github.com",
    "stackoverflow.com",
]
CLIENT_SKIP_DOMAINS = [
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com",
    "vimeo.com", "reddit.com", "redditinc.com", "reddithelp.com", "google.com", "google.cz", "seznam.cz", "bing.com", "yahoo.com",
    "unsplash.com", "pexels.com", "shutterstock.com", "istockphoto.com", "pixabay.com", "gettyimages.com", "adobe.com",
    "wordpress.org", "wordpress.com", "laravel.com", "symfony.com", "drupal.org", "joomla.org", "wix.com", "squarespace.com",
    "shopify.com", "webnode.com", "webnode.cz", "webnode.page", "cloudflare.com", "jsdelivr.net", "cdnjs.com", "bootstrapcdn.com",
    "googleapis.com", "gstatic.com", "fontawesome.com", "fonts.google.com", "google-analytics.com", "hotjar.com", "mouseflow.com",
    "github.com", "gitlab.com", "bitbucket.org", "stackoverflow.com", "firmy.cz", "zivefirmy.cz", "najisto.centrum.cz",
    "zlatestranky.cz", "wikipedia.org", "mapy.cz", "maps.google.com", "trustpilot.com", "recenze.cz", "heureka.cz", "jobs.cz",
    "prace.cz", "profesia.cz", "accessiway.com", "userway.org",
]
ASSET_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "svg", "webp", "pdf", "zip", "exe", "dmg"]
TRACKING_PREFIXES = ["utm_", "gclid", "fbclid", "msclkid"]


def normalise_url(url: Column) -> Column:
    """Trimmed, with https:// in front where the scheme is missing."""
    trimmed = F.trim(url)
    return F.when(trimmed.rlike(r"(?i)^https?://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def domain(url: Column) -> Column:
    """Lower-cased host without one leading www.; the whole string where there is no host."""
    return F.lower(F.regexp_replace(F.coalesce(host(url), url), r"(?i)^www\.", ""))


def base_url(url: Column) -> Column:
    """Scheme, host and port."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """The URL before its query, the query and the fragment, the last two with their marks or empty."""
    pattern = r"^([^?#]*)(\?[^#]*)?(#.*)?$"
    return F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2), F.regexp_extract(url, pattern, 3)


def strip_tracking(url: Column) -> Column:
    """Without the query parameters whose names begin like tracking ones, in any case."""
    front, query, fragment = _parts(url)
    tracked = r"(?i)^(" + "|".join(TRACKING_PREFIXES) + ")"
    kept = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: (p != "") & ~p.rlike(tracked))
    rest = F.array_join(kept, "&")
    return F.when(query == "", url).otherwise(F.concat(front, F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest)), fragment))


def truncate_url(url: Column, most: int = 500) -> Column:
    """At most ``most`` characters: first the fragment goes, then the query, then the path (U4)."""
    front, query, _ = _parts(url)
    fits = lambda c: F.length(c) <= most
    return F.when(fits(url), url).when(fits(F.concat(front, query)), F.concat(front, query)).when(fits(front), front).otherwise(F.substring(base_url(url), 1, most))


def resolve(href: Column, page_url: Column) -> Column:
    """A link's target as absolute URL."""
    base = base_url(page_url)
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    h = F.trim(href)
    return (
        F.when(h.rlike(r"(?i)^https?://"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(base, h))
        .otherwise(F.concat(base, F.lit("/"), h))
    )


def same_host(url: Column, page_url: Column) -> Column:
    return domain(url) == domain(page_url)


def _suffix(domains: list[str], label: bool) -> str:
    body = "|".join(d.replace(".", r"\.") for d in domains)
    return rf"(?:^|\.)(?:{body})$" if label else rf"(?:{body})$"


def is_skipped(name: Column, domains: list[str] = SKIP_DOMAINS, whole_labels: bool = False) -> Column:
    """The domain ends with one of the list (U8); with ``whole_labels`` only at a label's border."""
    return name.rlike(_suffix(domains, whole_labels))


def is_page_url(url: Column) -> Column:
    """A URL that may be a web page: has a host that is neither localhost nor an IP address, and no asset extension."""
    h = F.coalesce(host(url), F.lit(""))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return (h != "") & (h != "localhost") & ~h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|:") & ~F.lower(path).rlike(r"\.(" + "|".join(ASSET_EXTENSIONS) + ")$")


def domain_suffixes(name: Column) -> Column:
    """All suffixes of a domain at label borders, the domain itself first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _tokens(pattern: Column) -> Column:
    return F.regexp_extract_all(pattern, F.lit(r"(\[[!^]?\]?[^\]]*\]|(?s:.))"), F.lit(1))


def glob_regex(pattern: Column) -> Column:
    """A case-insensitive regular expression that matches what the glob does as a whole: ``*``, ``?`` and classes like ``[a-z]`` or
    ``[!0-9]``; a bracket that isn't closed stands for itself."""

    def one(t: Column) -> Column:
        inside = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, r"(?s)^\[[!^]?(.*)\]$", 1), r"([\\\[\]&~])", r"\\$1"), r"^\^", r"\\^")
        class_ = F.concat(F.lit("["), F.when(t.rlike(r"^\[[!^]"), "^").otherwise(""), inside, F.lit("]"))
        quoted = F.when(t.rlike(r"^[.\\+^$(){}|\[\]]$"), F.concat(F.lit("\\"), t)).otherwise(t)
        return F.when(F.length(t) > 1, class_).when(t == "*", ".*").when(t == "?", ".").otherwise(quoted)

    return F.concat(F.lit("(?is)^"), F.array_join(F.transform(_tokens(pattern), one), ""), F.lit("$"))


#: Letters of the grams that domains and globs meet on; a glob without two letters in a row has a gram of one, or none.
GRAMS = (4, 2, 1)


def _grams(text: Column, size: int) -> Column:
    """The distinct substrings of a length, none of a shorter text."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))


def _glob_matches(domains: DataFrame, globs: DataFrame, salts: int = 32) -> DataFrame:
    """The domains (_bare) that a glob (_p) matches, bare or with www.

    A domain that a glob matches has all grams of the glob's literal pieces.  Globs are looked up by the one of these that fewest
    domains have (one that no domain has drops the glob), grams being as long as the longest piece allows; those that have no letter of
    their own meet all domains, as alternatives of a few expressions, under salts.  Pairs that meet are tried.
    """
    pieces = F.split(F.array_join(F.transform(_tokens(F.col("_p")), lambda t: F.when(t.isin("*", "?") | (F.length(t) > 1), F.lit("\0")).otherwise(t)), ""), "\0")
    globs = globs.withColumn("_pieces", pieces).withColumn("_longest", F.array_max(F.transform("_pieces", F.length))).withColumn("_re", glob_regex(F.col("_p")))
    size = F.when(F.col("_longest") >= GRAMS[0], GRAMS[0]).when(F.col("_longest") >= GRAMS[1], GRAMS[1]).otherwise(F.col("_longest"))
    globs = globs.withColumn("_size", size.cast("int")).drop("_longest")
    sizes = sorted(r[0] for r in globs.select("_size").distinct().collect())  # of 0, 1, 2, 4
    own = lambda text: F.concat(*(_grams(text, n) for n in sizes if n)) if any(sizes) else F.array().cast("array<string>")
    domains = domains.withColumn("_name", F.concat(F.lit("www."), F.col("_bare")))
    in_domains = domains.select("_bare", F.explode(own(F.col("_name"))).alias("_gram"))

    def of_pieces(size: int) -> Column:
        return F.array_distinct(F.flatten(F.transform("_pieces", lambda x: _grams(x, size))))

    wanted = F.lit(None).cast("array<string>")
    for n in sizes:
        wanted = F.when(F.col("_size") == n, of_pieces(n)).otherwise(wanted) if n else wanted
    in_globs = globs.where("_size > 0").select("_p", "_re", F.explode(wanted).alias("_gram"))
    # of a glob's grams the rarest, counted over the domains; grams that no glob has aren't counted
    counts = in_domains.join(in_globs.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    rated = in_globs.join(counts, "_gram", "left").groupBy("_p").agg(F.first("_re").alias("_re"), F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_least"))
    keyed = rated.where("_least.n > 0").select("_re", F.col("_least.gram").alias("_gram"))
    matched = F.expr("_bare rlike _re or concat('www.', _bare) rlike _re")
    hits = in_domains.join(keyed, "_gram").where(matched).select("_bare")
    if 0 in sizes:
        blank = globs.where("_size = 0").select("_re")
        blocks = F.ceil(F.lit(blank.count()) / 100)
        blank = blank.groupBy(F.pmod(F.xxhash64("_re"), blocks).alias("_b")).agg(F.concat_ws("|", F.collect_list("_re")).alias("_re"))  # about a hundred each
        blank = blank.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = domains.withColumn("_salt", F.pmod(F.xxhash64("_bare"), F.lit(salts)).cast("int"))
        hits = hits.union(salted.join(blank, "_salt").where(matched).select("_bare"))
    return hits.distinct()


def exclude_domains(rows: DataFrame, patterns: DataFrame, domain_col: str = "domain", pattern_col: str = "pattern") -> DataFrame:
    """Rows whose domain matches no pattern, bare or with www. (U7).  An empty pattern matches nothing.

    Patterns without a glob, or with one leading ``*.``, are looked up by equality over the domain's suffixes, the other globs by
    a gram of their letters; all joins are by equality, whatever the number of patterns.
    """
    p = patterns.select(F.lower(F.trim(pattern_col)).alias("_p")).where("_p <> ''").distinct()
    plain = p.where(~F.col("_p").rlike(r"[*?\[]")).select(F.regexp_replace("_p", r"^www\.", "").alias("_key"), F.lit(True).alias("_own"))
    tails = p.where(F.col("_p").rlike(r"^\*\.[^*?\[]+$")).select(F.regexp_replace("_p", r"^\*\.", "").alias("_key"), F.lit(False).alias("_own"))
    keyed = plain.unionByName(tails).distinct()
    bare = F.lower(F.regexp_replace(domain_col, r"(?i)^www\.", ""))
    named = rows.withColumn("_bare", bare)
    domains = named.select("_bare").where("_bare is not null").distinct()
    hits = (
        domains.select("_bare", F.explode(domain_suffixes(F.concat(F.lit("www."), F.col("_bare")))).alias("_key")).join(keyed, "_key")
        .where((~F.col("_own") & (F.col("_key") != F.concat(F.lit("www."), F.col("_bare")))) | (F.col("_key") == F.col("_bare"))).select("_bare")
    )
    globs = p.where(F.col("_p").rlike(r"[*?\[]") & ~F.col("_p").rlike(r"^\*\.[^*?\[]+$"))
    return named.join(hits.union(_glob_matches(domains, globs)).distinct(), "_bare", "left_anti").drop("_bare")
