"""Registered queries over all spellings that some operators know: each order holds one of them, every second one in capitals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from .queries import query, table

#: Technologies, each with texts that name it and no other.
TECHNOLOGIES = {
    "jquery": ["jquery-3", "jquery.min.js"], "bootstrap": ["bootstrap-5", "bootstrap.min.css"], "react": ["react.production", "react-development", "react.min.js", "reactDOM"], "vue": ["vue-2", "vue.min.js", "vue.runtime"],
    "angular": ["angular.min.js", "ng-app"], "tailwind": ["tailwindcss"], "google_analytics": ["gtag(", "google-analytics.com", "/ga.js", "analytics.js"], "google_tag_manager": ["googletagmanager.com/gtm"],
    "facebook_pixel": ["fbevents.js", "fbq("], "hotjar": ["static.hotjar.com"], "matomo": ["matomo.js", "piwik.js"], "recaptcha": ["google.com/recaptcha", "grecaptcha"], "cloudflare": ["cdnjs.cloudflare.com"], "font_awesome": ["fontawesome", "font-awesome"],
    "google_fonts": ["fonts.googleapis.com", "fonts.gstatic.com"], "modernizr": ["modernizr"], "lodash": ["lodash"], "moment": ["moment.js", "moment.min.js"], "axios": ["axios"], "webpack": ["webpack"], "vite": ["vite"], "next": ["/_next/"], "nuxt": ["/_nuxt/"],
    "gatsby": ["gatsby"], "laravel": ["laravel", "app.js?csrf"], "symfony": ["/bundles/x.js", "sf2"], "swiper": ["swiper"], "slick": ["slick"], "lightbox": ["lightbox"], "fancybox": ["fancybox"], "owl_carousel": ["owl.carousel"],
    "aos": ["aos.js", "aos.css"], "gsap": ["gsap"], "three_js": ["three.js", "three.min.js"], "leaflet": ["leaflet"], "mapbox": ["mapbox"],
}
#: Systems with their marks; a generator tag has more words beside the name.
SYSTEMS = {
    "vismo": ["vismo.cz", "redakční systém vismo", "cms vismo", "generator: Vismo 5"], "shoptet": ["/user/documents/", "shoptet.cz", "cdn.myshoptet.com", "generator: Shoptet"], "eshop-rychle": ["cdn.eshop-rychle.cz"], "webareal": ["webareal.cz", "webareal.com"],
    "webgarden": ["webgarden.cz"], "estranky": ["estranky.cz", "estranky.sk"], "webzdarma": ["webzdarma.cz"], "webnode": ["webnode.cz", "webnode.com", "webnode.page"], "wordpress": ["/wp-content/", "/wp-includes/", "/wp-json/", "wp-emoji", "generator: WordPress 6.1"],
    "wix": ["static.wixstatic.com", "_wix_", "wixsite.com", "wixpress.com", "generator: Wix.com"], "squarespace": ["squarespace.com", "sqsp.net", "generator: Squarespace"], "shopify": ["cdn.shopify.com", "myshopify.com", "generator: Shopify"],
    "joomla": ["/media/jui/", "/media/system/js/", "generator: Joomla!"], "drupal": ["/sites/default/files/", "/sites/all/modules/", "drupal.js", "drupal.settings", "generator: Drupal 9"], "magento": ["/static/frontend/", "mage/cookies.js", "magento_"],
    "opencart": ["catalog/view/javascript/common.js", "index.php?route=product"], "prestashop": ["/modules/ps_", "/themes/classic/", "prestashop", "generator: PrestaShop"],
}


def _pairs(known: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(text, name) for name, texts in known.items() for text in texts]


def _names(known: dict[str, list[str]]) -> str:
    pairs = _pairs(known)
    return "[" + ", ".join(f"'{n}'" for _, n in pairs) + f"][o_orderkey % {len(pairs)} + 1]"


def _texts(known: dict[str, list[str]]) -> F.Column:
    pairs = _pairs(known)
    text = F.get(F.array(*(F.lit(t) for t, _ in pairs)), (F.col("o_orderkey") % len(pairs)).cast("int"))
    return F.concat(F.lit("<p "), F.when(F.col("o_orderkey") % 2 == 0, F.upper(text)).otherwise(text), F.lit(">"))


@query(f"SELECT o_orderkey AS page_id, {_names(SYSTEMS)} AS cms, {_names(TECHNOLOGIES)} AS technologies FROM orders")
def all_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All systems and technologies by all their marks, in both cases."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("page_id"), extract.detect_cms(_texts(SYSTEMS)).alias("cms"), F.array_join(extract.technologies(_texts(TECHNOLOGIES)), ",").alias("technologies"))


_DIGITS = "CAST(o_orderkey % 6 + 2 AS VARCHAR) || lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0')"


@query(f"""WITH n AS (SELECT o_orderkey AS page_id, {_DIGITS} AS d FROM orders) SELECT page_id, CASE WHEN page_id % 11 < 8 THEN '+420' || d ELSE '' END AS phones FROM n""")
def phones_of_all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """International and local numbers with blanks, points, dashes and without, links, and numbers that are none."""
    d = F.expr("concat(string(o_orderkey % 6 + 2), lpad(string(o_orderkey % 100000000), 8, '0'))")
    a, b, c = (F.substring(d, i, 3) for i in (1, 4, 7))
    forms = [
        F.concat(F.lit("+420 "), F.concat_ws(" ", a, b, c)), F.concat(F.lit("+420"), d), F.concat(F.lit("00420 "), F.concat_ws("-", a, b, c)), F.concat_ws(".", a, b, c), F.concat_ws("&nbsp;", a, b, c), d,
        F.concat(F.lit('<a href="tel: +420-'), F.concat_ws("-", a, b, c), F.lit('">x</a>')), F.concat(F.lit('<a href="TEL:'), F.concat_ws(" ", a, b, c), F.lit('">x</a>')),
        F.concat(F.lit("1"), F.substring(d, 2, 8)), F.concat(d, F.lit("5")), F.lit("777 777 777, 123456789"),
    ]
    text = F.lit("")
    for i, f in enumerate(forms):
        text = F.when(F.col("o_orderkey") % 11 == i, f).otherwise(text)
    html = F.concat(F.lit("<p>tel "), text, F.lit("</p>"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.array_join(extract.phones(html), ",").alias("phones"))
