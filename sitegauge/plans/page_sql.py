"""Page rules over the given pages, beside SQL that asks for the same marks with another engine's patterns.

Left out are the codes whose rules look ahead, which that engine's patterns can't, or whose built pages show both sides already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.rules import content, technical
from .queries import AS_OF, query, table

YEAR = AS_OF.year


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(patterns: list[str], column: str = "html", flags: str = "i") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_text(f'(?{flags}){p}' if flags else p)})" for p in patterns) + ")"


def _found(patterns: list[str], column: str = "html") -> str:
    return "(" + " + ".join(f"CAST({_has([p], column)} AS INT)" for p in patterns) + ")"


def _count(*patterns: str, flags: str = "i") -> str:
    return "(" + " + ".join(f"len(regexp_extract_all(html, {_text(f'(?{flags}){p}' if flags else p)}))" for p in patterns) + ")"


def _first(pattern: str, flags: str = "i") -> str:
    return f"nullif(regexp_extract(html, {_text(f'(?{flags}){pattern}' if flags else pattern)}, 1), '')"


_HEAD = "regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1)"
_MARK = "coalesce(" + ", ".join(f"CASE WHEN TRY_CAST({_first(p)} AS INT) BETWEEN 2000 AND {YEAR} THEN TRY_CAST({_first(p)} AS INT) END" for p in (r"(?:©|&copy;|copyright)\s*(\d{4})", r"(\d{4})\s*(?:©|&copy;)", r"all\s+rights\s+reserved\s*(\d{4})")) + ")"
_DEPTHS = [_count(p) for p in (r'<li[^>]*class\s*=\s*["\'][^"\']*has-?(?:sub|children|dropdown)[^"\']*["\']', r'<ul[^>]*class\s*=\s*["\'][^"\']*dropdown[^"\']*["\']', r'<ul[^>]*class\s*=\s*["\'][^"\']*sub-?menu[^"\']*["\']')]
_MAIL = ["nullif(regexp_extract(html, 'href\\s*=\\s*[\"'']mailto:([^\"''?]+)[\"'']', 1), '')", "nullif(regexp_extract(html, '([\\w.-]+@[\\w.-]+\\.\\w{2,})', 1), '')"]
_REAL_MAIL = " OR ".join(f"coalesce(NOT regexp_matches({m}, '(?i)example\\.com|test\\.com|email\\.com|your-?email'), FALSE)" for m in _MAIL)
_LOGO = [
    r'<img[^>]+(?:class|id)\s*=\s*["\'][^"\']*logo[^"\']*["\'][^>]+src\s*=\s*["\'][^"\']+["\'][^>]*>', r'<img[^>]+src\s*=\s*["\'][^"\']+["\'][^>]+(?:class|id)\s*=\s*["\'][^"\']*logo[^"\']*["\'][^>]*>',
    r'<img[^>]+src\s*=\s*["\'][^"\']*logo[^"\']+["\'][^>]*>', r'<img[^>]+alt\s*=\s*["\'][^"\']*logo[^"\']*["\'][^>]+src\s*=\s*["\'][^"\']+["\'][^>]*>', r'(?s:<a[^>]+class\s*=\s*["\'][^"\']*logo[^"\']*["\'][^>]*>.*?<img[^>]+src\s*=\s*["\'][^"\']+["\'][^>]*>)',
]
_LINK = r'href\s*=\s*["\'][^"\']*(?:{})[^"\']*["\']'
_PRIVACY = f"({_has([_LINK.format('privacy|gdpr|soukrom|osobni-?udaje|ochrana-?(?:soukromi|udaju)')], flags='')} OR {_has([r'<a[^>]*>.*?(?:zásady\s*(?:ochrany\s*)?soukromí|privacy\s*policy|ochrana\s*(?:osobních\s*)?údajů|gdpr).*?</a>'], flags='is')})"
_TERMS = f"({_has([_LINK.format('terms|conditions|obchodni-?podminky|vop|vseobecne-?podminky')], flags='')} OR {_has([r'<a[^>]*>.*?(?:obchodní\s*podmínky|terms|všeobecné\s*podmínky|vop).*?</a>'], flags='is')})"
_COMPANY = [r"(?:IČO?|IČ|IC)\s*:?\s*\d{8}", r"(?:DIČ|DIC)\s*:?\s*CZ\d{8,10}", r"(?:provozovatel|společnost|firma)\s*:?\s*[^<,\n]{5,50}(?:s\.r\.o\.|a\.s\.|spol\.)", r"(?:sídlo|adresa)\s*:?\s*[^<\n]{10,100}"]
_SHOP = f"{_found(content.SHOP_LOOKS)} >= 2"
CONDITIONS = {
    "content_placeholder_text": _has(content.PLACEHOLDERS, "regexp_replace(html, '<[^>]*>', '', 'g')"),
    "content_broken_images": f"{_count(r'src\s*=\s*["\'](?:about:blank|javascript:|data:,)["\']', r'src\s*=\s*["\']["\']', r'src\s*=\s*["\'].*(?:no-?image|placeholder|default)[^"\']*["\']', flags='')} + {_count(r'<img[^>]+alt\s*=\s*["\'](?:image|obrázek|img|photo|placeholder)["\'][^>]*>')} > 0",
    "content_empty_sections": _count(r"<section[^>]*>\s*</section>", r'<div[^>]*class\s*=\s*["\'][^"\']*(?:section|content|wrapper)[^"\']*["\'][^>]*>\s*</div>', r"<article[^>]*>\s*</article>") + " > 0",
    "content_outdated_copyright": f"{_MARK} < {YEAR - 1}",
    "content_generic_stock_photos": "(" + " + ".join(f"CAST(contains(lower(html), '{s}') AS INT)" for s in content.STOCK_SOURCES) + f") + {_found([rf'alt\s*=\s*["\'][^"\']*{a}[^"\']*["\']' for a in content.STOCK_ALTS])} >= 2",
    "branding_no_favicon": "NOT " + _has([r'<link[^>]+rel\s*=\s*["\'](?:icon|shortcut icon)["\'][^>]+href\s*=\s*["\'][^"\']+["\']', r'<link[^>]+href\s*=\s*["\'][^"\']+["\'][^>]+rel\s*=\s*["\'](?:icon|shortcut icon)["\']']),
    "branding_no_logo": "NOT " + _has(_LOGO),
    "branding_no_brand_identity": "NOT " + _has([r'<meta[^>]+property\s*=\s*["\']og:image["\']', r'<link[^>]+rel\s*=\s*["\']apple-touch-icon["\']', r'<meta[^>]+name\s*=\s*["\']theme-color["\']']),
    "nav_deep_hierarchy": f"CASE WHEN {_DEPTHS[0]} > 0 THEN {_DEPTHS[0]} WHEN {_DEPTHS[1]} > 0 THEN {_DEPTHS[1]} ELSE {_DEPTHS[2]} END > 20",
    "nav_no_search": "NOT " + _has(content.SEARCH),
    "nav_no_breadcrumbs": "NOT " + _has(content.BREADCRUMBS),
    "nav_no_mobile_menu": "NOT " + _has(content.MOBILE_MENU),
    "nav_broken_links": f"{_count(*content.DEAD_LINKS)} > 5",
    "conversion_no_contact_form": "NOT " + _has([*content.CONTACT_FORMS, r'(?s:<form[^>]*>.*?<input[^>]+type\s*=\s*["\']email["\'].*?</form>)']),
    "conversion_no_phone": "NOT " + _has(content.PHONES),
    "conversion_no_email": f"NOT ({_REAL_MAIL})",
    "conversion_no_trust_signals": "NOT " + _has(content.TRUST),
    "conversion_no_social_proof": "NOT " + _has(content.SOCIAL_PROOF),
    "legal_no_cookie_consent": f"NOT {_has(content.COOKIE_CONSENT)} AND {_has(content.TRACKING)}",
    "legal_cookies_before_consent": f"{_has(content.EARLY_SCRIPTS, _HEAD)} AND NOT {_has(content.CONSENT_WRAPPERS, _HEAD)}",
    "legal_no_privacy_policy": f"NOT {_PRIVACY}",
    "legal_no_terms": f"NOT {_TERMS} AND {_SHOP}",
    "legal_no_company_info": "NOT " + _has(_COMPANY),
    "legal_no_withdrawal_info": f"{_SHOP} AND {_found(content.WITHDRAWAL)} < 2",
    "cms_platform_ads": _has(content.PLATFORM_ADS),
    "cms_subdomain_hosting": _has(content.SUBDOMAINS, "coalesce(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '')"),
    "outdated_missing_doctype": "NOT " + _has([r"<!DOCTYPE[^>]*>"]),
    "outdated_old_doctype": f"{_has([r'<!DOCTYPE[^>]*>'])} AND NOT {_has([r'<!DOCTYPE\s+html\s*>'])}",
    "outdated_deprecated_tags": _has([rf"<{t}[\s>]" for t in technical.DEPRECATED_TAGS]),
    "outdated_no_semantic_html": "NOT " + _has([rf"<(?:{'|'.join(technical.SEMANTIC_TAGS)})[\s>]"]),
    "outdated_excessive_inline_styles": _count(r'\sstyle\s*=\s*["\'][^"\']+["\']') + " > 10",
    "outdated_flash_content": _has([r'\.swf["\'\s>?]', r"application/x-shockwave-flash", r"<embed[^>]*flash", r"<object[^>]*flash"]),
    "outdated_java_applet": _has([r"<applet[\s>]", r"application/x-java-applet", r'\.(class|jar)["\'\s>?]']),
}
_CATEGORIES = ["cms_quality", "content_quality", "branding", "navigation_ux", "conversion", "legal_compliance", "outdated_code"]


@query("SELECT page_id, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{code}' END" for code, c in CONDITIONS.items()) + "], lambda x: x IS NOT NULL)) AS code FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages)")
def page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the given pages in content, branding, navigation, conversion, law, hosting and age: the codes that SQL can say."""
    found = audit.issues(audit.spread(table(spark, sf_dir, "pages")), AS_OF, categories=_CATEGORIES)
    return found.where(F.col("code").isin(list(CONDITIONS))).select("page_id", "code")
