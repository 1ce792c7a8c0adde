import datetime as dt

from pyspark.sql import functions as F

from sitegauge.functions import text as T
from sitegauge.functions import urls as U


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).head().y


def test_urls(spark):
    assert one(spark, " acme.cz/a ", U.normalise_url) == "https://acme.cz/a"
    assert one(spark, "HTTP://acme.cz", U.normalise_url) == "HTTP://acme.cz"
    assert one(spark, "https://WWW.Acme.cz:80/x", U.domain) == "acme.cz"
    assert one(spark, "Acme.cz", U.domain) == "acme.cz"
    assert one(spark, "https://a.cz:81/p?q=1", U.base_url) == "https://a.cz:81"
    assert one(spark, "https://a.cz/p?utm_source=1&b=2&GCLID=3#f", U.strip_tracking) == "https://a.cz/p?b=2#f"
    assert one(spark, "https://a.cz/p?fbclid=3", U.strip_tracking) == "https://a.cz/p"
    long = "https://a.cz/" + "p" * 400 + "?" + "q" * 80 + "#" + "f" * 80
    assert one(spark, long, U.truncate_url) == long.split("#")[0]
    assert one(spark, "https://a.cz/" + "p" * 600, U.truncate_url) == "https://a.cz"
    for href, target in (("/x", "https://a.cz/x"), ("//b.cz/x", "https://b.cz/x"), ("http://c.cz", "http://c.cz"), ("x.html", "https://a.cz/x.html")):
        assert one(spark, href, lambda c: U.resolve(c, F.lit("https://a.cz/d/"))) == target
    assert one(spark, "maps.google.com", U.is_skipped) and not one(spark, "acme.cz", U.is_skipped)
    assert one(spark, "notx.com", lambda c: U.is_skipped(c, ["x.com"])) and not one(spark, "notx.com", lambda c: U.is_skipped(c, ["x.com"], True))
    assert [one(spark, u, U.is_page_url) for u in ("https://a.cz/b.PDF", "http://127.0.0.1/", "http://localhost/", "https://a.cz/b", "none")] == [False, False, False, True, False]


def test_excluded_domains(spark):
    names = ["firmy.cz", "www.firmy.cz", "profil.firmy.cz", "restaurace-u-kocoura.cz", "www.kvetinarstvi-jana.cz", "a1.test.cz", "exact.cz", "sub.exact.cz"]
    rows = spark.createDataFrame([(n,) for n in names], "domain string")
    patterns = spark.createDataFrame([("firmy.cz",), ("*.FIRMY.cz",), ("a?.test.*",), ("exact.cz",), ("",)], "pattern string")
    assert {r.domain for r in U.exclude_domains(rows, patterns).collect()} == {"restaurace-u-kocoura.cz", "www.kvetinarstvi-jana.cz", "sub.exact.cz"}


def test_texts(spark):
    assert one(spark, "a\x00b\tc\x0b\n", T.clean_control) == "ab\tc\n"
    assert one(spark, "&lt;a&gt; &amp;copy; &copy;", T.decode_entities) == "<a> &copy; ©"
    assert one(spark, "<p>a</p><script>x<b></script><style>y</style>b", T.visible_text) == "ab"
    assert one(spark, "1 234,50 Kč", T.price) == 1234.5
    assert one(spark, "-5", T.price) is None and one(spark, "zdarma", T.price) is None and one(spark, None, T.price) is None
    assert tuple(one(spark, "30 000 - 45 000 Kč", T.salary_range)) == (30000.0, 45000.0)
    assert tuple(one(spark, "30 000 Kč", T.salary_range)) == (30000.0, None)
    for text, value in (("1.2.2024", dt.datetime(2024, 2, 1)), ("01.02.2024 10:30", dt.datetime(2024, 2, 1, 10, 30)), ("2024-02-01", dt.datetime(2024, 2, 1)), ("soon", None)):
        assert one(spark, text, T.czech_date) == value
    assert [one(spark, x, T.valid_company_id) for x in ("25596641", "25596642", "2559664", None)] == [True, False, False, False]
