"""Rules of the categories http, security, seo, libraries, outdated_code, typography.

The patterns and limits in the rules are fixed values, like the lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import Markup, Rule, Text, bound, count, every, first, has, markup, said, trimmed

# Fixed values.
SECURITY_HEADERS = ["content-security-policy", "x-frame-options", "x-content-type-options", "strict-transport-security", "referrer-policy", "permissions-policy"]
OG_TAGS = ["og:title", "og:description", "og:image", "og:url"]
DEPRECATED_TAGS = ["font", "center", "marquee", "blink", "frame", "frameset", "noframes", "applet", "basefont", "big", "strike", "tt", "acronym"]
SEMANTIC_TAGS = ["header", "footer", "main", "nav", "section", "article", "aside"]
LIBRARIES = {
    "jquery": ([r"jquery[.-]?(\d+\.\d+\.\d+)?(?:\.min)?\.js", r"jquery\.com/jquery", r"code\.jquery\.com", r"jQuery\s*(?:JavaScript\s*Library)?\s*v?(\d+\.\d+\.\d+)"], r"jquery[.-]?(\d+\.\d+\.\d+)", "3.5.0"),
    "bootstrap": ([r"bootstrap[.-]?(\d+\.\d+\.\d+)?(?:\.min)?\.(?:js|css)", r"getbootstrap\.com", r"Bootstrap\s*v?(\d+\.\d+\.\d+)"], r"bootstrap[.-]?(\d+\.\d+\.\d+)", "5.0.0"),
    "tailwind": ([r"tailwindcss", r"tailwind[.-]?(?:\d+\.\d+\.\d+)?(?:\.min)?\.css", r"cdn\.tailwindcss\.com"], r"tailwind[.-]?(\d+\.\d+\.\d+)", None),
    "react": ([r"react[.-]?(?:dom)?[.-]?(?:\d+\.\d+\.\d+)?(?:\.(?:development|production))?(?:\.min)?\.js", r"unpkg\.com/react", r"cdnjs\..*/react", r"__REACT_DEVTOOLS_GLOBAL_HOOK__", r"reactjs\.org"], r"react[.-]?(\d+\.\d+\.\d+)", None),
    "vue": ([r"vue[.-]?(?:\d+\.\d+\.\d+)?(?:\.(?:global|esm-browser))?(?:\.(?:prod|dev))?(?:\.min)?\.js", r"unpkg\.com/vue", r"cdn\.jsdelivr\.net/npm/vue", r"__VUE__", r"vuejs\.org"], r"vue[.-]?(\d+\.\d+\.\d+)", None),
    "angular": ([r"angular[.-]?(?:core|common|router)?[.-]?(?:\d+\.\d+\.\d+)?(?:\.min)?\.js", r"ng-version", r"angular\.(?:io|dev)"], r"angular[.-]?(\d+\.\d+\.\d+)", None),
    "wordpress": ([r"wp-content/", r"wp-includes/", r"wordpress", r"wp-json/"], r"WordPress\s*(\d+\.\d+(?:\.\d+)?)", None),
    "woocommerce": ([r"woocommerce", r"wc-blocks"], r"woocommerce.*?(\d+\.\d+\.\d+)", None),
}
LETTERS = "A-Za-zÁČĎÉĚÍŇÓŘŠŤÚŮÝŽáčďéěíňóřšťúůýž"
#: Weights of the outdated score.
OUTDATED_LEVELS = [(15, "critical"), (10, "high"), (5, "medium")]


def http(p: dict[str, Column]) -> list[Rule]:
    """Needs, beside the page, what a fetch has logged: error, ttfb_s, cert_days, ssl_error, soft_404_status (null: not known) (A2)."""
    h, https = markup(p), F.coalesce(p["url"].rlike("(?i)^https://"), F.lit(False))
    mixed = F.array_distinct(F.concat(*(every(h, rf'<{t}[^>]+{a}=["\']http://[^"\']+["\'][^>]*>', 0) for t, a in (("img", "src"), ("script", "src"), ("link", "href"), ("iframe", "src")))))
    days = p["cert_days"]
    rule = lambda code, when, evidence=None: Rule("http", code, when, evidence)
    return [
        rule("ssl_not_https", ~https, p["url"]),
        rule("ssl_connection_failed", https & p["ssl_error"].isNotNull(), p["ssl_error"]),
        rule("ssl_expired", https & (days < 0), said(days, "days")),
        rule("ssl_expiring_soon", https & (days >= 0) & (days < 30), said(days, "days")),
        rule("http_connection_failed", p["error"].isNotNull(), p["error"]),
        rule("http_slow_ttfb", p["ttfb_s"] > 1.5, said(F.round(p["ttfb_s"], 2), "s")),
        rule("http_mixed_content", https & (F.size(mixed) > 0), said(F.size(mixed), "resources")),
        rule("http_soft_404", p["soft_404_status"] == 200, F.lit("200")),
    ]


def security(p: dict[str, Column]) -> list[Rule]:
    """Headers (a map with lower-cased names) and forms (A1)."""
    header = lambda name: F.coalesce(F.try_element_at(p["headers"], F.lit(name)), F.lit(""))
    out = [Rule("security", "security_missing_" + n.replace("-", "_"), header(n).isin("", "0"), F.lit(n)) for n in SECURITY_HEADERS]
    out.append(Rule("security", "security_server_version_disclosure", header("server").rlike(r"\d+\.\d+"), header("server")))
    out.append(Rule("security", "security_x_powered_by", ~header("x-powered-by").isin("", "0"), header("x-powered-by")))
    out.append(Rule("security", "security_insecure_form", has(markup(p), r'<form[^>]+action=["\']http://[^"\']+["\'][^>]*>')))
    return out


def _meta(h: Markup, attribute: str, name: str) -> Column:
    one = rf'<meta[^>]+{attribute}=["\']{name}["\'][^>]+content=["\']([^"\']*)["\'][^>]*>'
    two = rf'<meta[^>]+content=["\']([^"\']*)["\'][^>]+{attribute}=["\']{name}["\'][^>]*>'
    hit = F.when(has(h, one), F.regexp_extract(h.html, f"(?iu){one}", 1)).when(has(h, two), F.regexp_extract(h.html, f"(?iu){two}", 1))
    return F.trim(F.coalesce(hit, F.lit("")))


def _between(code: str, text: Column, low: int, high: int) -> list[Rule]:
    n = F.length(text)
    empty = text.isin("", "0")
    return [
        Rule("seo", f"seo_missing_{code}", empty),
        Rule("seo", f"seo_short_{code}", ~empty & (n < low), said(n, "characters")),
        Rule("seo", f"seo_long_{code}", ~empty & (n > high), said(n, "characters")),
    ]


def title_of(h: Column) -> Column:
    return F.trim(F.regexp_extract(h, r"(?iu)<title[^>]*>([^<]*)</title>", 1))


def seo(p: dict[str, Column]) -> list[Rule]:
    """Title, description, tags, headings, images; has_sitemap and has_robots come with the page (null: not known) (A3)."""
    h = markup(p)
    missing = F.filter(F.array(*(F.when(_meta(h, "property", t) == "", F.lit(t)) for t in OG_TAGS)), lambda x: x.isNotNull())
    h1 = count(h, r"<h1[^>]*>([^<]*)</h1>")
    images = every(h, r"<img[^>]*>", 0)
    bare = F.size(F.filter(images, lambda i: ~i.rlike(r'\salt=["\'][^"\']+["\']')))
    return [
        *_between("title", title_of(p["html"]), 10, 70),
        *_between("description", _meta(h, "name", "description"), 50, 160),
        Rule("seo", "seo_missing_og_tags", F.size(missing) > 0, F.array_join(missing, ", ")),
        Rule("seo", "seo_missing_viewport", _meta(h, "name", "viewport").isin("", "0")),
        Rule("seo", "seo_missing_h1", h1 == 0),
        Rule("seo", "seo_multiple_h1", h1 > 1, said(h1, "h1")),
        Rule("seo", "seo_missing_sitemap", p["has_sitemap"] == F.lit(False)),
        Rule("seo", "seo_missing_robots", p["has_robots"] == F.lit(False)),
        Rule("seo", "seo_images_missing_alt", bare > 0, F.concat_ws(" of ", bare.cast("string"), F.size(images).cast("string"))),
    ]


def _version(h: Text, patterns: list[str], own: str) -> Column:
    by_pattern = [first(h, p) for p in patterns if "(\\d" in p]
    return F.coalesce(*by_pattern, first(h, own))


def version_below(version: Column, limit: str) -> Column:
    """Numerical comparison of dotted versions, part by part."""
    parts = F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
    return parts < F.array(*(F.lit(int(x)) for x in limit.split(".")))


def libraries(p: dict[str, Column]) -> list[Rule]:
    """Libraries with outdated versions, and mixtures of frameworks (A4)."""
    h, out, there = markup(p), [], {}
    for name, (patterns, own, limit) in LIBRARIES.items():
        there[name] = has(h, *patterns)
        if limit:
            version = _version(h, patterns, own)
            out.append(Rule("libraries", f"lib_outdated_{name}", there[name] & F.coalesce(version_below(version, limit), F.lit(False)), version))
    modern = sum((there[n].cast("int") for n in ("react", "vue", "angular")), F.lit(0))
    out.append(Rule("libraries", "lib_jquery_with_modern_framework", there["jquery"] & (modern > 0)))
    out.append(Rule("libraries", "lib_multiple_frameworks", modern > 1, said(modern, "frameworks")))
    return out


def detected_libraries(h: Text) -> Column:
    """Array of struct(name, version) of the libraries found."""
    hits = [F.when(has(h, *patterns), F.struct(F.lit(n).alias("name"), _version(h, patterns, own).alias("version"))) for n, (patterns, own, _) in LIBRARIES.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def _footer(h: Text) -> Column:
    """The footer, in lower case."""
    h = h.lower() if isinstance(h, Markup) else F.lower(h)
    # without a group around it all, which would be entered at every letter of the page; back from a tag's end, class and id are
    # looked for at an = only (in a tag <class= or <id=, which isn't markup, they must stand a second time)
    tag = first(h, r"<footer[^>]*>.*?</footer>", 0, flags="s")
    part = first(h, r'<(?:(?!class=|id=)[^>]+=(?<=class=|id=)|(?=class=|id=)[^>]+(?:class|id)=)["\'][^"\']*(?:footer|copyright|bottom)[^"\']*["\'][^>]*>.*?</[^>]+>', 0, flags="s")
    return F.coalesce(tag, part, h.low if isinstance(h, Markup) else h)


def copyright_years(h: Text, year: Column) -> Column:
    """struct(start, end, since): the years of a copyright mark in the footer, else the year of a 'since' note (A5)."""
    # ©, &copy;, (c) or copyright; a class comes first, as that is quicker than alternatives at every letter
    pattern = r"[©&(c](?:(?<=©)|(?<=&)copy;|(?<=\()c\)|(?<=c)opyright)\s*(\d{4}(?:\s*[-–—]\s*\d{4})?)"
    number = lambda x: F.when(x != "", x.try_cast("int"))  # noqa: E731  (a cast of no text would throw and catch an error for each page)

    def noted(f: Column, mark: Column) -> Column:
        start, end = number(F.left(mark, F.lit(4))), number(F.right(mark, F.lit(4)))
        marked = F.coalesce((start >= 1990) & (start <= year) & (end <= year), F.lit(False))
        since = F.when(~marked, first(Markup(f, f), r"(?:since|od roku|založeno|established)\s*(\d{4})", flags="").try_cast("int"))
        return bound(since, lambda s: F.struct(F.when(marked, start).alias("start"), F.when(marked, end).alias("end"), F.when((s >= 1990) & (s <= year), s).alias("since")))

    return bound(_footer(h), lambda f: bound(F.regexp_extract(f, pattern, 1), lambda mark: noted(f, mark)))


#: Names of what ``outdated_facts`` finds.
OUTDATED_FACTS = ["_any_type", "_tags", "_styles", "_attributes", "_nested", "_plain", "_spacer", "_cells", "_fixed", "_blocking", "_modified_years"]


def _opened(tags: list[str]) -> str:
    return rf"<(?=[{''.join(sorted({t[0] for t in tags}))}])({'|'.join(tags)})[\s>]"


def _modified(p: dict[str, Column]) -> Column:
    dated = F.regexp_extract(F.try_element_at(p["headers"], F.lit("last-modified")), r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.when(dated != "", F.try_to_timestamp(dated, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz"))  # without the day's name, which has no pattern


def outdated_facts(p: dict[str, Column]) -> dict[str, Column]:
    """What a rule of outdated code asks for beside its evidence, its score or another rule, each found once, as columns of a prepared
    page.  What is only counted is looked for in the lower-cased page (A5)."""
    h, low = markup(p), markup(p).lower()
    tags = every(low, _opened(DEPRECATED_TAGS), flags="")
    wide = lambda xs: F.size(F.filter(xs, lambda x: x.try_cast("int") > 500))
    by_style = wide(every(low, r'style\s*=\s*["\'][^"\']*width\s*:\s*(\d{3,})px', flags=""))
    by_attribute = F.when(p["low"].rlike(r"\swidth\s*="), wide(every(low, r'<(?=[a-z])(?!img|video|canvas|svg)[a-z][^>]*\swidth\s*=\s*["\']?(\d{3,})["\']?', flags=""))).otherwise(0)
    scripts = every(F.coalesce(first(low, r"<head[^>]*>(.*?)</head>", flags="s"), F.lit("")), r'<script[^>]+src=["\'][^"\']+["\'][^>]*>', 0, flags="")
    waited = lambda s: ~s.rlike(r"\b(async|defer)\b") & ~F.regexp_extract(s, r'src=["\']([^"\']+)', 1).rlike(r"google-analytics|gtag|gtm|analytics|pixel|tracking")
    found = [
        has(h, r"<!DOCTYPE[^>]*>"),
        F.array_distinct(tags),
        count(h, r'\sstyle\s*=\s*["\'][^"\']+["\']'),
        count(h, r'<table[^>]*(?:width|cellpadding|cellspacing|border)\s*=\s*["\']?\d+'),
        has(h, r"<table[^>]*>.*<table[^>]*>", flags="isu"),
        count(h, r"<table(?![^>]*role\s*=)") > 2,
        has(h, r"(?:spacer|blank|1x1|pixel)\.gif"),
        p["low"].contains("<td") & (count(h, r'<td[^>]*width\s*=\s*["\']?\d+%') > 5),
        by_style + by_attribute,
        F.size(F.filter(scripts, waited)),
        F.months_between(p["as_of"], _modified(p)) / 12,
    ]
    return dict(zip(OUTDATED_FACTS, found, strict=True))


def _outdated(p: dict[str, Column]) -> list[tuple[Rule, Column]]:
    """The rules with what each adds to the outdated score."""
    h, year = markup(p), F.year(p["as_of"])
    any_type, tags, styles, attributes, nested, plain, spacer, cells, fixed, blocking, modified_years = (p[f] for f in OUTDATED_FACTS)
    html5 = has(h, r"<!DOCTYPE\s+html\s*>")
    points = attributes + F.when(nested, 3).otherwise(0) + plain.cast("int") + F.when(spacer, 5).otherwise(0) + cells.cast("int")
    some = (attributes > 0) | nested | plain | spacer | cells
    layout = (points >= 3) | (some & (count(h, r"<table[\s>]") > 3))
    flash = has(h, r'\.swf["\'\s>?]', r"application/x-shockwave-flash", r"<embed[^>]*flash", r"<object[^>]*flash")
    applet = has(h, r"<applet[\s>]", r"application/x-java-applet", r'\.class["\'\s>?]', r'\.jar["\'\s>?]')
    jquery = has(h, r"jquery[.-]?\d+\.\d+(?:\.\d+)?(?:\.min)?\.js", r"jquery\.min\.js", r"code\.jquery\.com", r"cdnjs\.cloudflare\.com/ajax/libs/jquery", r"ajax\.googleapis\.com/ajax/libs/jquery")
    jquery = has(h, "jquery") & (jquery | has(h, r'\bjQuery\s*\(', r'\$\s*\(\s*["\']', r"\.ready\s*\("))
    years = p["_years"]
    start, end, since = years["start"], years["end"], years["since"]
    age, old = year - start, year - since
    r = lambda code, when, score, evidence=None: (Rule("outdated_code", code, when, evidence), score)
    one = F.lit(1)
    stale = ((age >= 2) & (age < 5) & (end < year)) | ((age < 2) & (end < year - 1))
    return [
        r("outdated_missing_doctype", ~any_type, one * 2),
        r("outdated_old_doctype", any_type & ~html5, one * 2, first(h, r"(<!DOCTYPE[^>]*>)")),
        r("outdated_deprecated_tags", F.size(tags) > 0, F.size(tags) * 2, F.array_join(F.array_intersect(F.array(*map(F.lit, DEPRECATED_TAGS)), tags), ", ")),
        r("outdated_no_semantic_html", ~p["low"].rlike(_opened(SEMANTIC_TAGS)), one * 3),
        r("outdated_excessive_inline_styles", styles > 10, one, said(styles, "styles")),
        r("outdated_table_layout", layout, one * 5, said(points, "points")),
        r("outdated_flash_content", flash, one * 10),
        r("outdated_java_applet", applet, one * 10),
        r("outdated_fixed_width", fixed > 5, one * 2, said(fixed, "elements")),
        r("outdated_jquery", jquery, one * 2),
        r("outdated_blocking_scripts", blocking > 0, blocking, said(blocking, "scripts")),
        r("outdated_ancient_copyright", (age >= 10) | (old >= 10), F.when(age >= 10, 10).otherwise(8), F.coalesce(start, since).cast("string")),
        r("outdated_old_copyright", ((age >= 5) & (age < 10)) | ((old >= 5) & (old < 10)), F.when(age >= 5, 5).otherwise(4), F.coalesce(start, since).cast("string")),
        r("outdated_stale_copyright", stale, F.when(age >= 2, 2).otherwise(1), F.concat_ws("-", start.cast("string"), end.cast("string"))),
        r("outdated_last_modified_old", modified_years >= 3, F.least(F.floor(modified_years / 2).cast("int"), F.lit(5)), _modified(p).cast("string")),
    ]


def outdated_code(p: dict[str, Column]) -> list[Rule]:
    return [rule for rule, _ in _outdated(p)]


def outdated_score(p: dict[str, Column]) -> Column:
    return sum((F.when(rule.when, score).otherwise(0) for rule, score in _outdated(p)), F.lit(0))


def level(score: Column, levels: list[tuple[int, str]], last: str) -> Column:
    out = F.lit(last)
    for low, name in reversed(levels):
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out


def skipped_levels(h: Text) -> Column:
    """Heading levels that a following heading skips, like 2 where an h3 follows an h1."""
    order = F.transform(every(h, r"<h([1-6])[^>]*>"), lambda x: x.cast("int"))
    return bound(order, lambda o: F.array_distinct(F.filter(F.transform(o, lambda x, i: F.when((i > 0) & (x > F.get(o, i - 1) + 1), F.get(o, i - 1) + 1)), lambda x: x.isNotNull())))


def typography(p: dict[str, Column]) -> list[Rule]:
    """Text marks, headings, fonts, colours, spacing, image texts, old elements."""
    h, text = markup(p), p["text"]
    dashes, spaces, quotes = count(text, r"\s-\s", ""), count(text, "  +", ""), count(text, rf"[\"'](?=[{LETTERS}])", "u")
    h1, skipped = count(h, r"<h1[^>]*>"), skipped_levels(h)
    fonts = F.array_distinct(trimmed(every(h, r"font-family\s*:\s*([^;\"']+)")))
    sizes = F.array_distinct(every(h, r"font-size\s*:\s*(\d+(?:px|em|rem|pt|%)?)"))
    styles = count(h, r'style\s*=\s*["\'][^"\']+["\']', "u")
    colours = F.concat(*(every(h, c, 0, "u") for c in (r"#(?:[0-9a-fA-F]{3}){1,2}\b", r"rgb\s*\(\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\)", r"rgba\s*\(\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*[\d.]+\s*\)")))
    colours = F.array_distinct(F.transform(colours, F.lower))
    breaks, nbsp, tables = count(h, r"<br\s*/?>"), count(h, "&nbsp;", "u"), count(h, "<table")
    images = every(h, r"<img[^>]*>", 0)
    bad = lambda i: (
        (~has(i, r"alt\s*=")).cast("int")
        + (has(i, r'alt\s*=\s*["\']?\s*["\']?') & ~has(i, r'alt\s*=\s*["\'][^"\']+["\']')).cast("int")
        + has(i, r'alt\s*=\s*["\'](?:image|obrázek|foto|picture|img|banner|\d+)["\']?').cast("int")
    )
    poor = F.aggregate(images, F.lit(0), lambda a, i: a + bad(i))
    r = lambda code, when, evidence=None: Rule("typography", code, when, evidence)
    return [
        r("typography_wrong_dashes", dashes > 3, said(dashes, "dashes")),
        r("typography_multiple_spaces", spaces > 5, said(spaces, "runs")),
        r("typography_wrong_quotes", quotes > 10, said(quotes, "quotes")),
        r("heading_multiple_h1", h1 > 1, said(h1, "h1")),
        r("heading_no_h1", h1 == 0),
        r("heading_skipped_levels", F.size(skipped) > 0, F.array_join(F.transform(skipped, lambda x: F.concat(F.lit("H"), x.cast("string"))), ", ")),
        r("design_too_many_fonts", F.size(fonts) > 4, said(F.size(fonts), "fonts")),
        r("design_inconsistent_font_sizes", F.size(sizes) > 10, said(F.size(sizes), "sizes")),
        r("design_excessive_inline_styles", styles > 50, said(styles, "styles")),
        r("design_too_many_colors", F.size(colours) > 12, said(F.size(colours), "colours")),
        r("design_excessive_br_tags", breaks > 20, said(breaks, "br")),
        r("design_excessive_nbsp", nbsp > 30, said(nbsp, "nbsp")),
        r("design_poor_image_alts", (F.size(images) > 0) & (poor > F.size(images) * 0.3), said(poor, "alts")),
        r("design_deprecated_elements", has(h, "<marquee", "<blink")),
        r("design_table_layout", tables > 3, said(tables, "tables")),
        r("design_autoplay_media", has(h, r"<(?:video|audio)[^>]*autoplay")),
    ]
