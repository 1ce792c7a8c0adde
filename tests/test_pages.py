import datetime as dt
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sitegauge.operators import audit, extract
from sitegauge.operators import rules as R
from sitegauge.operators.registry import ISSUES, registry, with_registry
from sitegauge.operators.rules import Rule, content, measured, technical

AS_OF = dt.datetime(2024, 6, 1)


def page(spark, html, url="https://acme.cz/", **more):
    names = {"headers": "map<string,string>", "industry": "string", "cert_days": "int", "ttfb_s": "double", "soft_404_status": "int", "error": "string", "ssl_error": "string"}
    schema = "page_id long, url string, html string" + "".join(f", {k} {names[k]}" for k in more)
    return spark.createDataFrame([(1, url, html, *more.values())], schema)


def codes(df):
    return {r.code for r in df.select("code").collect()}


def test_registry(spark):
    assert registry(spark).count() == 183 == len({c for c, _, _ in ISSUES})
    assert [registry(spark, severity=s).count() for s in ("critical", "recommended", "optimization")] == [50, 78, 55]
    odd = spark.createDataFrame([("unknown_code",)], "code string")
    assert with_registry(odd).head().asDict() == {"code": "unknown_code", "category": "http", "severity": "optimization", "weight": -1}


@pytest.mark.parametrize("label", ["IČO: ", "IČ: ", "ICO: ", "IC: ", "IČO ", "Identifikační číslo: ", "Company ID: "])
def test_company_ids(spark, label):
    assert extract.page_profiles(page(spark, f"<p>{label}25596641</p>")).head().company_id == "25596641"


def test_mails(spark):
    bad = ["test@example.com", "auto@wixpress.com", "errors@sentry.io", "admin@localhost", "logo@2x.png", "user@acme.cz", "a@b.css", "x@sub.example.org"]
    assert extract.page_profiles(page(spark, " ".join(bad))).head().emails == []
    html = '<a href="mailto:Jan@acme.cz?subject=x">x</a><i data-domain="acme.cz" data-mail="hr"></i><script>s@acme.cz</script> jan@acme.cz. (info@acme.cz)'
    assert extract.page_profiles(page(spark, html)).head().emails == ["info@acme.cz", "hr@acme.cz", "jan@acme.cz"]


def test_phones_and_profiles(spark):
    html = 'tel: 777 123 456, +420 602-123-456, 00420603123456, 111111111, 123456789, 812345678, <a href="http://www.facebook.com/sharer/"></a><a href="http://facebook.com/acme/">f</a> https://x.com/home https://x.com/acme'
    row = extract.page_profiles(page(spark, html)).head()
    assert row.phones == ["+420602123456", "+420603123456", "+420777123456"]
    assert row.social == {"facebook": "https://facebook.com/acme", "twitter": "https://x.com/acme"}


def test_names_and_technology(spark):
    html = '<title>Acme s.r.o. | Home</title><meta property="og:site_name" content="Acme"><script type="application/ld+json">{"@graph":[{"@type":["Organization"],"name":"Acme Group"}]}</script><script src="/wp-content/jquery-3.1.0.js"></script>'
    row = extract.page_profiles(page(spark, html)).head()
    assert row.company_names[:2] == ["Acme Group", "Acme"] and row.cms == "wordpress" and row.technologies == ["jquery"]
    assert extract.page_profiles(page(spark, "", headers={"X-Magento-Tags": "1"})).head().cms == "magento"


def test_site_contacts(spark):
    rows = [(1, "https://a.cz/", '<a href="/kontakt">k</a><a href="/o-nas">o</a> 777123456'), (2, "https://a.cz/kontakt", "602123456"), (3, "https://a.cz/o-nas", "info@a.cz"), (4, "https://b.cz/", "x@b.cz")]
    out = {r.page_id: r for r in extract.site_contacts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].emails == ["info@a.cz"] and out[1].phones == ["+420777123456", "+420602123456"] and out[4].emails == ["x@b.cz"]


def test_write_back(spark):
    leads = spark.createDataFrame([(1, None, "a"), (2, "old", None)], "lead_id long, email string, phone string")
    found = spark.createDataFrame([(1, "n", "m"), (2, "n", None)], "lead_id long, email string, phone string")
    assert {tuple(r) for r in extract.write_back(leads, found, "lead_id", ["email", "phone"]).collect()} == {(1, "n", "a"), (2, "old", None)}
    assert {tuple(r) for r in extract.write_back(leads, found, "lead_id", ["email", "phone"], True).collect()} == {(1, "n", "m"), (2, "n", None)}


def test_http_and_security(spark):
    html = '<img src="http://x.cz/a.png"><form action="http://x.cz/">'
    p = page(spark, html, headers={"Server": "nginx/1.18.0", "X-Powered-By": "PHP", "X-Frame-Options": "DENY"}, cert_days=5, ttfb_s=2.0, soft_404_status=200)
    found = codes(audit.issues(p, AS_OF, categories=["http", "security"]))
    assert {"http_mixed_content", "ssl_expiring_soon", "http_slow_ttfb", "http_soft_404", "security_server_version_disclosure", "security_x_powered_by", "security_insecure_form"} <= found
    assert "security_missing_x_frame_options" not in found and "security_missing_content_security_policy" in found
    assert "ssl_not_https" in codes(audit.issues(page(spark, html, "http://a.cz"), AS_OF, categories=["http"]))


def test_old_code(spark):
    html = '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0"><head><script src="/jquery-1.9.1.min.js"></script><script async src="b.js"></script></head><font><center><embed src="a.swf" ><footer>© 2010-2012</footer>'
    found = codes(audit.issues(page(spark, html), AS_OF, categories=["outdated_code", "libraries"]))
    assert found == {"outdated_old_doctype", "outdated_deprecated_tags", "outdated_flash_content", "outdated_jquery", "outdated_blocking_scripts", "outdated_ancient_copyright", "lib_outdated_jquery"}
    row = audit.outdated_scores(page(spark, html), AS_OF).head()
    assert (row.outdated_score, row.outdated_level) == (2 + 4 + 10 + 2 + 1 + 10, "critical")


def test_outdated_scores_look_once(spark):
    """What a rule and its score, or several rules, ask for is a column, so each pattern is in the plan once (footer and head were there
    up to a dozen times)."""
    plan = audit.outdated_scores(page(spark, ""), AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    patterns = [r"|(?<=c)opyright)", "od roku|", "<head[^>]*>", "|marquee|", "|cellpadding|", r"</footer>, 0", "d MMM yyyy", r"\swidth\s*=\s*"]
    assert {p: plan.count(p) for p in patterns} == dict.fromkeys(patterns, 1)


@pytest.mark.parametrize(("html", "years"), [
    ("<p>© 1999</p><div class=x ID='Page-FOOTER'>Copyright 2001 – 2003</div>", (2001, 2003, None)), ("<footer>(C)2012</footer>©1995", (2012, 2012, None)), ("&COPY; 2010 - 20155", (2010, 2015, None)),
    ("<footer>© 2030, since 1998</footer>", (None, None, 1998)), ("Od Roku 1990 © 1980", (None, None, 1990)), ("ZALOŽENO 2005", (None, None, 2005)), ("since 1980", (None, None, None)), ("", (None, None, None)),
    ("<a <class='footer'>© 2011</a>© 2012", (2011, 2011, None)), ("<class='footer'>© 2011</a>© 2012", (2011, 2011, None)), ("<class='x' id='bottom'>© 2013</a>", (2013, 2013, None)), ("© 2011 <i data-id='bottom'>2010</i>", (None, None, None)),
])
def test_copyright_years(spark, html, years):
    read = technical.copyright_years(R.markup({c: F.col(c) for c in ("html", "low")}), F.lit(2024))
    assert tuple(page(spark, html).withColumn("low", F.lower("html")).select(read.alias("y")).head().y) == years


def test_outdated_counts(spark):
    wide = "".join(f'<{t} WIDTH="{n}"></{t}>' for t, n in (("td", 501), ("img", 900), ("td", 500), ("h1", 9999999999), ("Td", 600), ("x", 700)))
    html = f"<!doctype html><MAIN>{wide}" + '<p STYLE="max-width: 900px; Width:800px">' * 3 + "<Frameset><ACRONYM\n><center>"
    found = {r.code: r.evidence for r in audit.issues(page(spark, html, headers={"LAST-MODIFIED": "Mon, 6 Jan 2020 10:00:00 GMT"}), AS_OF, categories=["outdated_code"]).collect()}
    assert found == {"outdated_deprecated_tags": "center, frameset, acronym", "outdated_fixed_width": "6 elements", "outdated_last_modified_old": "2020-01-06 10:00:00"}
    assert audit.outdated_scores(page(spark, html), AS_OF).head().outdated_score == 6 + 2


def test_versions(spark):
    below = lambda v, limit: spark.createDataFrame([(v,)], "v string").select(technical.version_below(F.col("v"), limit).alias("b")).head().b
    assert below("3.4.9", "3.5.0") and not below("3.10.0", "3.5.0") and not below("3.5.0", "3.5.0")


def test_content_rules(spark):
    html = '<title>x</title><img src="logo.png" width="50"><button>Odeslat</button><p>Lorem ipsum</p><section></section><a href="#">1</a> gtag( košík doprava platba'
    found = codes(audit.issues(page(spark, html), AS_OF, categories=["content_quality", "branding", "conversion", "legal_compliance", "navigation_ux"]))
    assert {"content_placeholder_text", "content_empty_sections", "branding_low_quality_logo", "conversion_weak_cta", "legal_no_cookie_consent", "legal_no_terms", "nav_no_search"} <= found
    assert not {"branding_no_logo", "conversion_no_cta"} & found


@pytest.mark.parametrize(("industry", "code"), [("eshop", "eshop_no_cart"), ("webdesign", "webdesign_no_portfolio"), ("real_estate", "realestate_no_listings"), ("automobile", "automobile_no_financing"), ("restaurant", "restaurant_no_menu"), ("medical", "medical_no_appointment")])
def test_industries(spark, industry, code):
    found = codes(audit.issues(page(spark, "<p>nic</p>", industry=industry), AS_OF, categories=[f"industry_{industry}"]))
    assert code in found
    assert not codes(audit.issues(page(spark, "<p>nic</p>", industry="legal"), AS_OF, categories=[f"industry_{industry}"]))


def test_own_rules_and_selection(spark):
    extra = lambda p: [Rule("seo", "own_code", p["html"].contains("x"))]
    found = audit.issues(page(spark, "x"), AS_OF, categories=["seo"], extra=extra)
    assert "own_code" in codes(found)
    profile = spark.createDataFrame([(1, "seo", True, ["seo_missing_h1"])], "profile_id long, category string, enabled boolean, ignored_codes array<string>")
    chosen = codes(audit.select_issues(found.withColumn("profile_id", F.lit(1)), profile))
    assert "seo_missing_h1" not in chosen and "seo_missing_title" in chosen


def test_configuration(spark):
    defaults = spark.createDataFrame([("seo", 5, {"title": 70.0, "h1": 1.0}), ("industry_eshop", 1, None)], "category string, priority int, thresholds map<string,double>")
    own = spark.createDataFrame([(1, "seo", False, None, {"title": 60.0}, None)], "profile_id long, category string, enabled boolean, priority int, thresholds map<string,double>, ignored_codes array<string>")
    rows = audit.configured(defaults, own).collect()
    assert [r.category for r in rows] == ["seo", "industry_eshop"] and rows[0].thresholds == {"title": 60.0, "h1": 1.0} and not rows[0].enabled and rows[1].enabled


def test_null_pages(spark):
    assert audit.issues(page(spark, None, None), AS_OF).count() > 10
    assert extract.page_profiles(page(spark, None, None)).count() == 1


def test_metrics(spark):
    m = spark.createDataFrame([(1, 5000.0, 1900.0, 0.1, None, True, False, 2, 0, 11, 5, 9, 0, 4)], "page_id long, lcp double, fcp double, cls double, ttfb double, overflow_mobile boolean, overflow_tablet boolean, small_targets_mobile int, small_targets_tablet int, padding_values int, font_families int, font_sizes int, upscaled_images int, modernity_score int")
    assert codes(audit.measured_issues(m, measured.metric_rules())) == {"perf_lcp_poor", "perf_fcp_needs_improvement", "resp_horizontal_overflow_mobile", "resp_small_touch_targets_mobile", "visual_inconsistent_padding", "visual_many_fonts", "visual_inconsistent_typography", "design_outdated"}
    f = spark.createDataFrame([(1, "image-alt", "critical", 3), (1, "odd-rule", "moderate", 1)], "page_id long, rule_id string, impact string, nodes int")
    rows = {r.code: r for r in with_registry(measured.accessibility_issues(f)).collect()}
    assert rows["a11y_image_alt"].severity == "critical" and rows["a11y_odd_rule"].category == "accessibility" and rows["a11y_odd_rule"].weight == -3
    assert measured.accessibility_counts(f).head().critical == 1


def test_site_files_and_shops(spark):
    rows = [(1, "https://a.cz/x", ""), (2, "https://a.cz/robots.txt", ""), (3, "https://b.cz/", 'woocommerce add-to-cart <b class="price">5 Kč</b>')]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in audit.with_site_files(p).collect()}
    assert out[1].has_robots and not out[1].has_sitemap and not out[3].has_robots
    shops = {r.page_id: r for r in audit.shop_pages(p).collect()}
    assert shops[3].platform == "woocommerce" and shops[3].confidence == "high" and not shops[1].is_eshop


def test_needed_text_is_in_every_match():
    """A pattern's needed text is found by the rules' own patterns in what they match; alternatives stand for the whole."""
    assert R.alternatives(r"a(b|c)d|[|]x|e\|f") == ("a(b|c)d", "[|]x", r"e\|f")
    cases = {
        r"lorem\s+ipsum": "lorem", r'class\s*=\s*["\'][^"\']*breadcrumb': "breadcrumb", r"x{0,2}abc": "abc", r"abcd?e": "abc", r"(?:abcdef)?xyz": "xyz", r"[^\]]+abc": "abc", r"[]x]abc": "abc", r"ab+c": None, r"abcd|efgh": None,
        r"abc+?d": "abc", r"\bppl\b": "ppl", r"a\.bc": "a.bc", r"[abc]{3}": None,
    }
    assert {p: R.needed(p) for p in cases} == cases
    for p, word in cases.items():
        for text in ("lorem ipsum", 'class="my-breadcrumb"', "abc", "xxabc", "abcde", "abce", "xyz", "zabc", "]abc", "abbc", "abcd", "efgh", "ppl", "a.bc", "cab"):
            assert word is None or not re.search(p, text) or word in text


def test_all_that_a_pattern_needs():
    """Lists of texts for groups: one alternative of each is in whatever matches; groups that may be missing or look around say nothing."""
    cases = {
        r"<a[^>]*>.*?(?:terms|všeobecné\s*podmínky|vop).*?</a>": (("</a>",), ("terms", "všeobecné", "vop")), r"\b(cart|košík)\b": (("cart", "košík"),), r"(?:abc|d)e": (), r"x(?:abc|def)?y": (), r"(?!abc|def)ghi": (("ghi",),),
        r"(?<!abc)ghi(?=jkl)": (("ghi",),), r"(?s:<form.*(?:mail|phone))": (("<form",),), r"(abc|def)+": (("abc", "def"),), r"(?:abc(?:def|ghi)|jkl)": (("abc", "jkl"),), r"free.*website.*site": (("website",), ("free",)),
    }
    assert {p: R.needs(p) for p in cases} == cases
    lists = [v for v in vars(content).values() if isinstance(v, list) and v and all(isinstance(x, str) for x in v)]
    patterns = sorted({p for v in lists for x in v for p in R.alternatives(R.lowered(x))})
    rng = random.Random(1)
    words = sorted({w for p in patterns for some in R.needs(p) for w in some})
    texts = [" ".join(rng.choice(words) + rng.choice(["", "=\"x\"", ">1 2", "</a>"]) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    texts += [r.html.lower() for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pandas().itertuples() if r.html]
    hits = 0
    for p in patterns:
        for t in texts:
            if re.search(p, t):
                hits += 1
                assert all(any(w in t for w in some) for some in R.needs(p)), p
    assert len(patterns) > 100 and hits > 300


def test_lowered_patterns_find_what_case_free_ones_do(spark):
    texts = ["<IMG SRC='x'>", "Košík 12 KČ", "PŘIDAT DO KOŠÍKU", "no", "Class = \"Price-Box\"", "©2024", "ΣΑΣ", "É"]
    df = spark.createDataFrame([(i, t, t.lower()) for i, t in enumerate(texts)], "i int, html string, low string")
    page = R.Markup(F.col("html"), F.col("low"))
    for patterns in ([r"<img[^>]+src"], [r"košík|cart", r"\d+\s*kč"], [r'class\s*=\s*["\'][^"\']*PRICE'], [r"©\s*\d{4}"], [r"É", "zz+"], [r"\S{9,}"]):
        got = df.select(R.has(page, *patterns).alias("a"), R.has(F.col("html"), *patterns).alias("b"), R.found(page, patterns).alias("c"), R.found(F.col("html"), patterns).alias("d"), R.count(page, patterns[0]).alias("e"), R.count(F.col("html"), patterns[0]).alias("f")).collect()
        assert all(r.a == r.b and r.c == r.d and r.e == r.f for r in got)


def test_rules_are_computed_once_below_the_rows(spark):
    """No filter on the list of issues goes below the list: it would compute all rules twice, and before pages are dealt out."""
    pages = spark.range(40).repartition(2).select(F.col("id").alias("page_id"), F.lit("https://a.cz/").alias("url"), F.concat(F.lit('<i style="color:#1122'), F.col("id") + 10, F.lit('">x</i>')).alias("html"))
    found = audit.issues(pages, dt.datetime(2024, 6, 1), categories=["branding"])
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Filter ") == 1 and "Filter (size(" not in text
    assert {r.code for r in found.collect()} == {"branding_no_favicon", "branding_no_logo", "branding_no_brand_identity"}


def test_tasks_do_not_grow_with_the_pages(spark):
    few, many = spark.range(10).coalesce(1), spark.range(10_000).coalesce(1)
    assert [audit.spread(p, 500).rdd.getNumPartitions() for p in (few, many)] == [4, 20]
