"""Registered queries over pages that are built from ``orders``.

The given pages lack most of the markup that the rules look for.  Here each order stands for a page; the bits of its number (b0, b1,
...) say which pieces of markup the page has.  The SQL beside a query says in bits, and without any pattern, which issues or values
follow, so each rule is seen where it holds and where it doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, extract
from ..operators.rules import technical
from .queries import AS_OF, query, table

Pieces = list[tuple[str, str]]  # condition over the bits (SQL), markup


def _bits(n: int, div: str) -> list[str]:
    return [f"o_orderkey {div} {1 << i} % 2 = 1 AS b{i}" for i in range(n)]


def built(spark: SparkSession, sf_dir: str, pieces: Pieces, n: int, url: str = "'https://www.firma.cz/'") -> DataFrame:
    """Pages (page_id, url, html, the bits) with the pieces whose conditions hold, one after another."""
    rows = audit.spread(table(spark, sf_dir, "orders").select("o_orderkey"), 50_000).selectExpr("o_orderkey AS page_id", *_bits(n, "div"))
    html = F.concat(*(F.when(F.expr(when), F.lit(markup)).otherwise("") for when, markup in pieces))
    return rows.withColumn("url", F.expr(url)).withColumn("html", html)


def bits_sql(n: int) -> str:
    return f"b AS (SELECT o_orderkey AS page_id, {', '.join(_bits(n, '//'))} FROM orders)"


def codes_sql(n: int, codes: dict[str, str]) -> str:
    each = ", ".join(f"CASE WHEN {when} THEN '{code}' END" for code, when in codes.items())
    return f"WITH {bits_sql(n)} SELECT page_id, code FROM (SELECT page_id, unnest([{each}]) AS code FROM b) WHERE code IS NOT NULL"


def found(pages: DataFrame, category: str) -> DataFrame:
    return audit.issues(pages, AS_OF, categories=[category]).select("page_id", "code")


# --- libraries and outdated code (A4, A5) -----------------------------------------------------------------------------------

LIBRARIES = [
    ("b0", '<script src="/js/jquery-1.8.3.min.js"></script>'), ("b1", '<script src="/js/jquery-3.6.0.min.js"></script>'), ("b2", '<link href="/css/bootstrap-4.6.2.min.css">'),
    ("b3", '<link href="/css/bootstrap-5.3.0.min.css">'), ("b4", '<script src="/js/vue.min.js"></script>'), ("b5", '<script src="https://unpkg.com/react@18/umd/app"></script>'), ("b6", '<app-root ng-version="17"></app-root>'),
]


@query(codes_sql(7, {
    "lib_outdated_jquery": "b0", "lib_outdated_bootstrap": "b2", "lib_jquery_with_modern_framework": "(b0 OR b1) AND (b4 OR b5 OR b6)",
    "lib_multiple_frameworks": "(b4 AND b5) OR (b5 AND b6) OR (b4 AND b6)",
}))
def built_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(built(spark, sf_dir, LIBRARIES, 7), "libraries")


@query(f"""WITH {bits_sql(7)} SELECT page_id, array_to_string(list_filter([CASE WHEN b0 THEN 'jquery 1.8.3' WHEN b1 THEN 'jquery 3.6.0' END, CASE WHEN b2 THEN 'bootstrap 4.6.2' WHEN b3 THEN 'bootstrap 5.3.0' END,
 CASE WHEN b5 THEN 'react' END, CASE WHEN b4 THEN 'vue' END, CASE WHEN b6 THEN 'angular' END], lambda x: x IS NOT NULL), ', ') AS libraries FROM b""")
def built_library_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform(technical.detected_libraries(F.col("html")), lambda x: F.concat_ws(" ", x["name"], x["version"]))
    return built(spark, sf_dir, LIBRARIES, 7).select("page_id", F.array_join(names, ", ").alias("libraries"))


OUTDATED = [
    ("b0", "<!DOCTYPE html>"), ("b1 AND NOT b0", '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN">'), ("b10", '<head><script src="/a.js"></script></head>'), ("NOT b10", '<head><script async src="/a.js"></script></head>'),
    ("b2", "<font color=red>x</font><center>y</center>"), ("b3", "<main>x</main>"), ("b4", '<i style="color: red">x</i>' * 11), ("b5", '<table width="100" border="0"><tr></tr></table>' * 3), ("b6", '<embed src="intro.swf">'),
    ("b7", '<applet code="A.class"></applet>'), ("b8", '<div style="width: 800px">x</div>' * 6), ("b9", '<script src="/jquery.min.js"></script>'),
    *((f"page_id % 5 = {i}", f'<div class="copyright">© {year} Firma</div>') for i, year in enumerate((2024, 2010, 2017, 2021))),
]
_OLD = {
    "outdated_missing_doctype": ("NOT b0 AND NOT b1", "2"), "outdated_old_doctype": ("b1 AND NOT b0", "2"), "outdated_deprecated_tags": ("b2 OR b7", "CASE WHEN b2 THEN 4 ELSE 0 END + CASE WHEN b7 THEN 2 ELSE 0 END"),
    "outdated_no_semantic_html": ("NOT b3", "3"), "outdated_excessive_inline_styles": ("b4", "1"), "outdated_table_layout": ("b5", "5"), "outdated_flash_content": ("b6", "10"), "outdated_java_applet": ("b7", "10"),
    "outdated_fixed_width": ("b8", "2"), "outdated_jquery": ("b9", "2"), "outdated_blocking_scripts": ("b10", "1"), "outdated_ancient_copyright": ("page_id % 5 = 1", "10"), "outdated_old_copyright": ("page_id % 5 = 2", "5"),
    "outdated_stale_copyright": ("page_id % 5 = 3", "2"), "outdated_last_modified_old": ("page_id % 3 = 0", "2"),
}


def _outdated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.when(F.col("page_id") % 3 == 0, "Mon, 06 Jan 2020 10:00:00 GMT").otherwise("Mon, 01 Jan 2024 10:00:00 GMT")
    return built(spark, sf_dir, OUTDATED, 11).withColumn("headers", F.create_map(F.lit("Last-Modified"), when))


@query(codes_sql(11, {code: when for code, (when, _) in _OLD.items()}))
def built_outdated_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(_outdated_pages(spark, sf_dir), "outdated_code")


@query(f"""WITH {bits_sql(11)}, s AS (SELECT page_id, {' + '.join(f"CASE WHEN {when} THEN {n} ELSE 0 END" for when, n in _OLD.values())} AS outdated_score FROM b)
 SELECT page_id, outdated_score, outdated_score >= 5 AS is_outdated, CASE WHEN outdated_score >= 15 THEN 'critical' WHEN outdated_score >= 10 THEN 'high' WHEN outdated_score >= 5 THEN 'medium' ELSE 'low' END AS outdated_level FROM s""")
def built_outdated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.outdated_scores(_outdated_pages(spark, sf_dir), AS_OF)


# --- headers, forms and fetches (A1, A2, S3) ----------------------------------------------------------------------------------

_HEADERS = {"Content-Security-Policy": "b0", "X-Frame-Options": "b1", "X-Content-Type-Options": "b2", "Strict-Transport-Security": "b3", "Referrer-Policy": "b4", "Permissions-Policy": "b5"}


@query(codes_sql(9, {f"security_missing_{h.lower().replace('-', '_')}": f"NOT {b}" for h, b in _HEADERS.items()} | {
    "security_server_version_disclosure": "b6", "security_x_powered_by": "b7", "security_insecure_form": "b8",
}))
def built_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header names in any case; an empty or 0 value is no header."""
    pages = built(spark, sf_dir, [("b8", '<form method="post" action="http://www.firma.cz/send"></form>'), ("NOT b8", '<form action="https://www.firma.cz/send"></form>')], 9)
    entries = [F.struct(F.lit(h if i % 2 else h.upper()), F.when(F.expr(b), "on").otherwise("" if i % 2 else "0")) for i, (h, b) in enumerate(_HEADERS.items())]
    entries += [F.struct(F.lit("Server"), F.expr("CASE WHEN b6 THEN 'nginx/1.18' ELSE 'nginx' END")), F.struct(F.lit("X-Powered-By"), F.expr("CASE WHEN b7 THEN 'PHP/8' ELSE '' END"))]
    return found(pages.withColumn("headers", F.map_from_entries(F.array(*entries))), "security")


@query(codes_sql(8, {
    "ssl_not_https": "NOT b0", "ssl_connection_failed": "b0 AND b1", "ssl_expired": "b0 AND b2", "ssl_expiring_soon": "b0 AND NOT b2 AND b3", "http_connection_failed": "b4", "http_slow_ttfb": "b5",
    "http_mixed_content": "b0 AND b6", "http_soft_404": "b7",
}))
def built_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = built(spark, sf_dir, [("b6", '<img src="http://www.firma.cz/a.png">'), ("NOT b6", '<img src="https://www.firma.cz/a.png">')], 8, "CASE WHEN b0 THEN 'https://www.firma.cz/' ELSE 'http://www.firma.cz/' END")
    log = {
        "ssl_error": "CASE WHEN b1 THEN 'handshake' END", "cert_days": "CASE WHEN b2 THEN -3 WHEN b3 THEN 12 ELSE 90 END", "error": "CASE WHEN b4 THEN 'timeout' END",
        "ttfb_s": "CASE WHEN b5 THEN 1.75D ELSE 0.4D END", "soft_404_status": "CASE WHEN b7 THEN 200 ELSE 404 END",
    }
    return found(pages.withColumns({name: F.expr(e) for name, e in log.items()}), "http")


@query(codes_sql(9, {
    "seo_missing_title": "NOT b0", "seo_short_title": "b0 AND b1", "seo_missing_description": "NOT b2", "seo_short_description": "b2 AND b3", "seo_long_description": "b2 AND NOT b3 AND b4",
    "seo_missing_og_tags": "NOT b5", "seo_missing_viewport": "NOT b6", "seo_missing_h1": "TRUE", "seo_missing_sitemap": "NOT b7", "seo_missing_robots": "b7", "seo_images_missing_alt": "NOT b8",
}))
def built_seo(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "a description of middling length, "
    pages = built(spark, sf_dir, [
        ("b0 AND b1", "<title>Short</title>"), ("b0 AND NOT b1", "<title>A title of good length</title>"), ("b2 AND b3", '<meta name="description" content="brief">'), ("b2 AND NOT b3 AND b4", f'<meta name="description" content="{text * 6}">'),
        ("b2 AND NOT b3 AND NOT b4", f'<meta content="{text * 2}" name="description">'), ("b5", "".join(f'<meta property="{t}" content="x">' for t in technical.OG_TAGS)), ("NOT b5", '<meta property="og:title" content="x">'),
        ("b6", '<meta name="viewport" content="width=device-width">'), ("b8", '<img src="/a.png" alt="a">'), ("NOT b8", '<img src="/a.png" alt="">'),
    ], 9)
    return found(pages.withColumn("has_sitemap", F.col("b7")).withColumn("has_robots", ~F.col("b7")), "seo")


# --- content categories (A6 to A12) --------------------------------------------------------------------------------------------

@query(f"""WITH {bits_sql(6)}, s AS (SELECT page_id, CASE WHEN b0 THEN 'woocommerce' WHEN b1 THEN 'shopify' END AS platform, CASE WHEN b0 OR b1 THEN 5 ELSE 0 END + CASE WHEN b2 THEN 2 ELSE 0 END + CASE WHEN b3 THEN 1 ELSE 0 END + CASE WHEN b4 THEN 3 ELSE 0 END + CASE WHEN b5 THEN 1 ELSE 0 END AS score FROM b)
 SELECT page_id, platform, score, score >= 3 AS is_eshop, CASE WHEN score >= 10 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM s""")
def built_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.shop_pages(built(spark, sf_dir, [
        ("b0", '<meta name="generator" content="woocommerce">'), ("b1", '<div class="shopify-section"></div>'), ("b2", "<a>košík</a>"), ("b3", "<b>1 234 Kč</b>"), ("b4", '<i>"@type": "Product"</i>'), ("b5", "<i>visa</i>"),
    ], 6))


CMS_QUALITY = [("b0", '<img src="https://cdn.webnode.com/a.png">'), ("b1", '<link href="/wp-content/themes/twentytwenty/style.css">'), ("b2", "<p>Powered by Webnode</p>"), ("b3", '<img src="https://static1.squarespace.com/a.png">')]


@query(codes_sql(5, {
    "cms_subdomain_hosting": "b4", "cms_free_platform": "b0", "cms_builder_limitations": "b0 OR (b3 AND NOT b1)", "cms_wordpress_default_theme": "b1 AND NOT b0", "cms_platform_ads": "b2",
}))
def built_cms_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(built(spark, sf_dir, CMS_QUALITY, 5, "CASE WHEN b4 THEN 'https://firma.webnode.cz/' ELSE 'https://www.firma.cz/' END"), "cms_quality")


CONTENT = [
    ("b0", "<p>Lorem ipsum dolor</p>"), ("b1", '<img src="/a.png" width="100" height="100" alt="x">' * 3), ("b2", '<img src="" alt="y">'), ("b3", '<section class="s"></section>'), ("b4", '<img src="/shutterstock-1.jpg" alt="handshake">'),
    ("page_id % 3 = 0", "<p>© 2019</p>"), ("page_id % 3 = 1", "<p>© 2024</p>"),
]


@query(codes_sql(5, {
    "content_placeholder_text": "b0", "content_small_images": "b1", "content_broken_images": "b2", "content_empty_sections": "b3", "content_generic_stock_photos": "b4", "content_outdated_copyright": "page_id % 3 = 0",
}))
def built_content_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(built(spark, sf_dir, CONTENT, 5), "content_quality")


BRANDING = [
    ("b0", '<link rel="icon" href="/fav.ico">'), ("b1 AND NOT b0", '<link rel="icon" href="https://wix.com/favicon.ico">'), ("b2", '<img class="logo" src="/l.png" width="200" height="60">'), ("b3 AND NOT b2", '<img class="logo" src="/l.png" width="50" height="20">'),
    ("b4", "".join(f'<i style="color:#11223{i}">x</i>' for i in range(9))), ("NOT b4", '<i style="color:#abc">x</i><i style="color:rgb(170, 187, 204)">x</i>'), ("b5", '<meta name="theme-color" content="#ffffff">'),
]


@query(codes_sql(6, {
    "branding_no_favicon": "NOT b0 AND NOT b1", "branding_default_favicon": "b1 AND NOT b0", "branding_no_logo": "NOT b2 AND NOT b3", "branding_low_quality_logo": "b3 AND NOT b2", "branding_inconsistent_colors": "b4",
    "branding_no_brand_identity": "NOT b5",
}))
def built_branding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(built(spark, sf_dir, BRANDING, 6), "branding")


NAVIGATION = [
    ("b0", '<nav class="main">' + "".join(f'<a href="/a{i}">A{i}</a>' for i in range(8)) + "</nav>"), ("NOT b0", '<nav class="main"><a href="/a">A</a><a href="/b">B</a></nav>'), ("b1", '<ul class="submenu"></ul>' * 21), ("b2", '<input type="search">'),
    ("b3", '<ol class="breadcrumb"></ol>'), ("b4", '<button class="hamburger">x</button>'), ("b5", '<a href="#">x</a>' * 6),
]


@query(codes_sql(6, {"nav_too_many_items": "b0", "nav_deep_hierarchy": "b1", "nav_no_search": "NOT b2", "nav_no_breadcrumbs": "NOT b3", "nav_no_mobile_menu": "NOT b4", "nav_broken_links": "b5"}))
def built_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(built(spark, sf_dir, NAVIGATION, 6), "navigation_ux")


CONVERSION = [
    ("b0", "<button>Get started</button>"), ("b1", "<button>Submit</button>"), ("b2", '<form class="contact"><textarea name="dotaz"></textarea></form>'), ("b3", "<p>tel: +420 777 123 456</p>"), ("b4", '<a href="mailto:info@firma.cz">mail</a>'),
    ("b5", "<p>záruka</p>"), ("b6", "<p>recenze</p>"),
]


@query(codes_sql(7, {
    "conversion_no_cta": "NOT b0 AND NOT b1", "conversion_weak_cta": "b1 AND NOT b0", "conversion_no_contact_form": "NOT b2", "conversion_no_phone": "NOT b3", "conversion_no_email": "NOT b4", "conversion_hidden_contact": "NOT b2 AND NOT b3 AND NOT b4",
    "conversion_no_trust_signals": "NOT b5", "conversion_no_social_proof": "NOT b6",
}))
def built_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(built(spark, sf_dir, CONVERSION, 7), "conversion")


LEGAL = [
    ("b2", '<head><script>gtag("config", "X")</script></head>'), ("b0", '<div class="cookie-banner"></div>'), ("b1", '<script src="https://www.google-analytics.com/analytics.js"></script>'), ("b3", '<a href="/privacy">x</a>'), ("b4", '<a href="/obchodni-podminky">x</a>'),
    ("b5", "<p>košík</p><p>doprava</p>"), ("b6", "<p>IČO: 12345678</p>"), ("b7", "<p>reklamace a odstoupení od smlouvy</p>"),
]
_LEGAL = {
    "legal_no_cookie_consent": "NOT b0 AND (b1 OR b2)", "legal_cookies_before_consent": "b2", "legal_no_privacy_policy": "NOT b3", "legal_no_terms": "b5 AND NOT b4", "legal_no_company_info": "NOT b6", "legal_no_withdrawal_info": "b5 AND NOT b7",
}


@query(codes_sql(8, _LEGAL))
def built_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(built(spark, sf_dir, LEGAL, 8), "legal_compliance")


@query(f"""WITH {bits_sql(8)}, s AS (SELECT page_id, greatest(0, 100 - {' - '.join(f"CASE WHEN {_LEGAL[c]} THEN {n} ELSE 0 END" for c, n in (("legal_no_cookie_consent", 30), ("legal_cookies_before_consent", 15), ("legal_no_privacy_policy", 25), ("legal_no_terms", 20), ("legal_no_company_info", 20), ("legal_no_withdrawal_info", 10)))}) AS score FROM b)
 SELECT page_id, score AS legal_compliance_score, CASE WHEN score >= 90 THEN 'compliant' WHEN score >= 70 THEN 'mostly_compliant' WHEN score >= 50 THEN 'partially_compliant' ELSE 'non_compliant' END AS legal_compliance_level, 100 AS branding_score, FALSE AS needs_redesign FROM s""")
def built_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own scores of the categories, here of legal compliance; categories without issues have 100."""
    pages = built(spark, sf_dir, LEGAL, 8)
    scores = audit.quality_scores(audit.issues(pages, AS_OF, categories=["legal_compliance"]), pages)
    return scores.select("page_id", "legal_compliance_score", "legal_compliance_level", "branding_score", "needs_redesign")


TYPOGRAPHY = [
    ("b0", "".join(f'<i style="font-family: f{i}">x</i>' for i in range(5))), ("b1", "".join(f'<i style="font-size: {i}px">x</i>' for i in range(1, 12))), ("b2", '<i style="margin: 0">x</i>' * 51), ("b3", "".join(f"<!-- #0000{i:02x} -->" for i in range(13))),
    ("b4", '<img src="/a.png">'), ("b5", "<marquee>x</marquee>"), ("b6", "<video autoplay></video>"), ("b7", "<h1>a</h1><h3>b</h3>"), ("NOT b7", "<h1>a</h1><h2>b</h2>"),
]


@query(codes_sql(8, {
    "design_too_many_fonts": "b0", "design_inconsistent_font_sizes": "b1", "design_excessive_inline_styles": "b2", "design_too_many_colors": "b3", "design_poor_image_alts": "b4", "design_deprecated_elements": "b5", "design_autoplay_media": "b6",
    "heading_skipped_levels": "b7",
}))
def built_typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(built(spark, sf_dir, TYPOGRAPHY, 8), "typography")


# --- industries (A14 to A19) ---------------------------------------------------------------------------------------------------

def _industry(spark: SparkSession, sf_dir: str, name: str, words: list[str] | Pieces) -> DataFrame:
    pieces = [(f"b{i}", f"<p>{w}</p>") if isinstance(w, str) else w for i, w in enumerate(words)]
    return found(built(spark, sf_dir, pieces, len(pieces)).withColumn("industry", F.lit(name)), f"industry_{name}")


@query(codes_sql(14, {
    "eshop_no_product_pages": "NOT b0 AND NOT b1", "eshop_no_product_schema": "b1 AND NOT b0", "eshop_no_cart": "NOT b1 AND NOT b2", "eshop_cart_ux_issues": "(b1 OR b2) AND NOT b3", "eshop_no_payment_methods": "NOT b4 AND NOT b5",
    "eshop_limited_payment_methods": "b5 AND NOT b4", "eshop_no_shipping_info": "NOT b6 AND NOT b7", "eshop_no_free_shipping_threshold": "b6 AND NOT b7", "eshop_no_ssl_seal": "NOT b8", "eshop_no_reviews": "NOT b9",
    "eshop_no_trust_badges": "NOT b10 AND NOT (b8 AND b9)", "eshop_no_search": "NOT b11", "eshop_no_contact_info": "NOT b12", "eshop_no_return_policy": "NOT b13",
}))
def built_eshops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _industry(spark, sf_dir, "eshop", [
        '"@type": "Product"', "přidat do košíku 500 Kč", '<a href="/cart">x</a>', "celkem", "paypal, gopay, dobírka", "visa", "doprava", "free shipping", '<img src="/ssl-seal.png">', "recenze", "heureka", '<input type="search">', "info@firma.cz", "reklamace",
    ])


@query(codes_sql(11, {
    "webdesign_no_portfolio": "NOT b0 AND NOT b2", "webdesign_few_portfolio_items": "(b0 OR b2) AND b1", "webdesign_no_case_studies": "NOT b2", "webdesign_no_services": "NOT b3", "webdesign_no_pricing": "NOT b4", "webdesign_no_testimonials": "NOT b5",
    "webdesign_no_team": "NOT b6", "webdesign_no_cta": "NOT b7", "webdesign_no_contact_form": "NOT b8", "webdesign_no_blog": "NOT b9", "webdesign_no_social_proof": "NOT b10",
}))
def built_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _industry(spark, sf_dir, "webdesign", [
        "portfolio", '<div class="project"></div>' * 3, "case study", "webdesign, seo", "<b>ceník</b>", "testimonial", "náš tým", "zavolejte", '<form class="contact"></form>', "blog", "ocenění",
    ])


@query(codes_sql(3, {"realestate_no_listings": "NOT b0", "realestate_no_search_filters": "NOT b1", "realestate_no_contact_agent": "NOT b2"}))
def built_real_estate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _industry(spark, sf_dir, "real_estate", ["byt 2+1", "lokalita", "makléř"])


@query(codes_sql(3, {"automobile_no_inventory": "NOT b0", "automobile_no_financing": "NOT b1", "automobile_no_test_drive": "NOT b2"}))
def built_automobiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _industry(spark, sf_dir, "automobile", ["vozidla", "leasing", "test drive"])


@query(codes_sql(3, {"restaurant_no_menu": "NOT b0 AND NOT b1", "restaurant_menu_pdf_only": "b0 AND NOT b1", "restaurant_no_reservation": "NOT b2"}))
def built_restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _industry(spark, sf_dir, "restaurant", ['<a href="/menu.pdf">menu</a>', "polévka 55 Kč", "rezervace"])


@query(codes_sql(4, {"medical_no_appointment": "NOT b0", "medical_no_services": "NOT b1 AND NOT b3", "medical_no_doctor_profiles": "NOT b2"}))
def built_medical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _industry(spark, sf_dir, "medical", ["objednávka", "služby", "lékař", "zubní, rehabilitace"])


# --- extraction (X1, X4 to X12) ------------------------------------------------------------------------------------------------

_NUMBER = "(777000000 + (page_id % 100000))"  # a phone number of a page

CONTACTS = [("b0", "<p>tel. +420 PHONE</p>"), ("b1", '<a href="tel:00420608111222">x</a>'), ("b2", "<p>IČO: 27082440</p>"), ("b3", "<p>IČO: 12345678</p>"), ("b4", '<a href="mailto:Obchod@Firma.cz?subject=x">x</a>'), ("b5", '<i data-mail="sales" data-domain="firma.cz"></i>'),
            ("b6", "<p>jan.novak@firma.cz, a@example.com, logo@2x.png</p>"), ("b7", '<img src="x@hidden.cz"><script>"y@hidden.cz"</script>')]


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = built(spark, sf_dir, CONTACTS, 8, "'https://www.d' || page_id || '.cz/'")
    return p.withColumn("html", F.replace("html", F.lit("PHONE"), F.regexp_replace(F.expr(f"CAST({_NUMBER} AS STRING)"), r"^(\d{3})(\d{3})(\d{3})$", "$1 $2 $3")))


_CONTACTS_SQL = f"""c AS (SELECT page_id, list_filter([CASE WHEN b0 THEN '+420' || {_NUMBER} END, CASE WHEN b1 THEN '+420608111222' END], lambda x: x IS NOT NULL) AS phones, CASE WHEN b2 THEN '27082440' END AS company_id,
 list_filter([CASE WHEN b4 THEN 'obchod@firma.cz' END, CASE WHEN b5 THEN 'sales@firma.cz' END, CASE WHEN b6 THEN 'jan.novak@firma.cz' END], lambda x: x IS NOT NULL) AS emails FROM b)"""


@query(f"WITH {bits_sql(8)}, {_CONTACTS_SQL} SELECT page_id, array_to_string(phones, ',') AS phones, company_id, array_to_string(emails, ',') AS emails, phones[1] AS phone, emails[1] AS email, len(phones) + len(emails) > 0 AS has_contact_data FROM c")
def built_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones in several forms, ids with a right and a wrong check digit, mail links, split attributes, texts, images and scripts."""
    p = extract.page_profiles(_contacts(spark, sf_dir))
    return p.select("page_id", F.array_join("phones", ",").alias("phones"), "company_id", F.array_join("emails", ",").alias("emails"), "phone", "email", "has_contact_data")


MARKS = [
    ("b0", '<link href="/wp-content/a.css">'), ("b1", '<img src="https://cdn.myshoptet.com/a.png">'), ("b2", '<meta name="generator" content="Joomla">'), ("b3", '<script src="/jquery.min.js"></script>'), ("b4", "<script>gtag('js')</script>"),
    ("b5", '<link href="https://fonts.googleapis.com/css">'), ("b6", "<div ng-app></div>"), ("b7", '<link href="/swiper.css">'),
]


@query(f"""WITH {bits_sql(9)} SELECT page_id, CASE WHEN b1 THEN 'shoptet' WHEN b0 THEN 'wordpress' WHEN b2 THEN 'joomla' WHEN b8 THEN 'drupal' END AS cms,
 array_to_string(list_filter([CASE WHEN b3 THEN 'jquery' END, CASE WHEN b6 THEN 'angular' END, CASE WHEN b4 THEN 'google_analytics' END, CASE WHEN b5 THEN 'google_fonts' END, CASE WHEN b7 THEN 'swiper' END], lambda x: x IS NOT NULL), ',') AS technologies FROM b""")
def built_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems by marks in the page, a generator tag and a header; the first of the list wins."""
    p = built(spark, sf_dir, MARKS, 9).withColumn("headers", F.when(F.col("b8"), F.create_map(F.lit("X-Drupal-Cache"), F.lit("HIT"))).otherwise(F.create_map(F.lit("server"), F.lit("x"))))
    return p.select("page_id", extract.detect_cms(F.col("html"), F.col("headers")).alias("cms"), F.array_join(extract.technologies(F.col("html")), ",").alias("technologies"))


PROFILES = [
    ("b0", '<a href="https://www.facebook.com/sharer.php?u=x">x</a>'), ("b1", '<a href="http://facebook.com/firma/">x</a>'), ("b2", '<a href="https://www.instagram.com/explore">x</a>'), ("b3", '<a href="https://www.instagram.com/firma.cz/">x</a>'), ("b4", '<a href="https://x.com/firma">x</a>'),
    ("b5", '<a href="https://www.linkedin.com/company/firma-cz">x</a>'), ("b6", '<a href="https://www.youtube.com/watch?v=1">x</a>'), ("b7", '<a href="https://www.youtube.com/c/firma">x</a>'), ("b8", '<a href="https://www.tiktok.com/@f">x</a>'),
]


@query(f"""WITH {bits_sql(9)} SELECT page_id, CASE WHEN b1 THEN 'https://facebook.com/firma' END AS facebook, CASE WHEN b3 THEN 'https://www.instagram.com/firma.cz' END AS instagram, CASE WHEN b4 THEN 'https://x.com/firma' END AS twitter,
 CASE WHEN b5 THEN 'https://www.linkedin.com/company/firma-cz' END AS linkedin, CASE WHEN b7 THEN 'https://www.youtube.com/c/firma' END AS youtube, NULL::VARCHAR AS tiktok FROM b""")
def built_social_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles among share links, system pages and names of one letter."""
    p = extract.page_profiles(built(spark, sf_dir, PROFILES, 9)).select("page_id", "social")
    return p.select("page_id", *(F.try_element_at("social", F.lit(n)).alias(n) for n in ("facebook", "instagram", "twitter", "linkedin", "youtube", "tiktok")))


NAMES = [
    ("b0", '<script type="application/ld+json">{"@type": "Organization", "name": "Alfa"}</script>'), ("b1", '<meta property="og:site_name" content="Beta">'), ("b2", "<p>Gamma Servis s.r.o.</p>\n"), ("b3", "<p>© 2024 Delta.</p>\n"), ("b4", "<title>Epsilon | Kontakt</title>"),
]


@query(f"""WITH {bits_sql(5)} SELECT page_id, array_to_string(list_filter([CASE WHEN b0 THEN 'Alfa' END, CASE WHEN b1 THEN 'Beta' END, CASE WHEN b2 THEN 'Gamma Servis, s.r.o.' END, CASE WHEN b3 THEN 'Delta' END, CASE WHEN b4 THEN 'Epsilon' END], lambda x: x IS NOT NULL), ';') AS names FROM b""")
def built_company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, NAMES, 5).select("page_id", F.array_join(extract.company_names(F.col("html")), ";").alias("names"))


@query(f"""WITH {bits_sql(8)}, {_CONTACTS_SQL}, h AS (SELECT page_id, phones, emails FROM c WHERE page_id % 4 = 0), s AS (SELECT page_id // 4 * 4 AS home, phones, emails, page_id % 4 AS n FROM c WHERE page_id % 4 > 0)
 SELECT h.page_id, CASE WHEN len(h.emails) > 0 THEN h.emails[1] ELSE coalesce(a.emails[1], b.emails[1], d.emails[1]) END AS email,
  CASE WHEN len(h.phones) > 0 THEN h.phones[1] WHEN len(h.emails) > 0 THEN NULL WHEN len(a.phones) > 0 THEN a.phones[1] WHEN len(a.emails) > 0 THEN NULL WHEN len(b.phones) > 0 THEN b.phones[1] WHEN len(b.emails) > 0 THEN NULL ELSE d.phones[1] END AS phone
 FROM h LEFT JOIN s a ON a.home = h.page_id AND a.n = 1 LEFT JOIN s b ON b.home = h.page_id AND b.n = 2 LEFT JOIN s d ON d.home = h.page_id AND d.n = 3""")
def built_site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of four pages: a home page that links to three contact pages, which count up to the first with an e-mail."""
    p = _contacts(spark, sf_dir)
    site, n = F.concat(F.lit("https://www.d"), F.floor(F.col("page_id") / 4).cast("string"), F.lit(".cz/")), F.col("page_id") % 4
    links = F.concat(*(F.lit(f'<a href="/kontakt{i}">x</a>') for i in (1, 2, 3)))
    p = p.withColumn("url", F.when(n == 0, site).otherwise(F.concat(site, F.lit("kontakt"), n.cast("string")))).withColumn("html", F.when(n == 0, F.concat("html", links)).otherwise(F.col("html")))
    return extract.site_contacts(p).where(F.col("page_id") % 4 == 0).select("page_id", "email", "phone")


@query(f"""WITH {bits_sql(8)}, {_CONTACTS_SQL} SELECT o_orderkey AS lead_id, CASE WHEN o_orderkey % 3 = 0 THEN 'old@firma.cz' ELSE emails[1] END AS email, coalesce(phones[1], CASE WHEN o_orderkey % 2 = 0 THEN '+420000' END) AS forced_phone FROM orders JOIN c ON page_id = o_orderkey""")
def built_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found values where a lead has none; and with force wherever something was found."""
    leads = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS lead_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'old@firma.cz' END AS email", "CASE WHEN o_orderkey % 2 = 0 THEN '+420000' END AS phone")
    profiles = extract.page_profiles(_contacts(spark, sf_dir)).withColumnRenamed("page_id", "lead_id")
    kept = extract.write_back(leads, profiles, "lead_id", ["email"])
    return kept.join(extract.write_back(leads, profiles, "lead_id", ["phone"], force=True).select("lead_id", F.col("phone").alias("forced_phone")), "lead_id").select("lead_id", "email", "forced_phone")
