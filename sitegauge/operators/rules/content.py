"""Rules of the categories eshop_detection, cms_quality, content_quality, branding, navigation_ux, conversion, legal_compliance.

The patterns and limits in the rules are fixed values, like the lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.text import strip_tags
from ...functions.urls import host
from . import Markup, Rule, Text, count, every, first, found, has, markup, said, trimmed

# Fixed values.
SHOP_PLATFORMS = {
    "woocommerce": {"meta": "woocommerce", "class": "woocommerce|wc-|add_to_cart", "script": "wc-add-to-cart|woocommerce"},
    "shopify": {"meta": "shopify", "script": r"cdn\.shopify\.com|shopify\.com", "class": "shopify-|product-form"},
    "prestashop": {"meta": "prestashop", "class": "prestashop|blockcart", "script": "prestashop"},
    "magento": {"meta": "magento", "class": "magento-|mage-|catalog-product", "script": "mage/|magento"},
    "opencart": {"meta": "opencart", "class": "opencart", "script": "opencart"},
    "shoptet": {"meta": "shoptet", "class": "shoptet", "script": r"shoptet\.cz"},
    "upgates": {"script": r"upgates\.cz"},
}
CART = [r"\b(košík|cart|basket|warenkorb|panier)\b", "add[_-]?to[_-]?cart", "do[_-]?košíku", "přidat[_-]?do[_-]?košíku", "buy[_-]?now", "checkout", "pokladna"]
PRICES = [r"\d+[\s,.]?\d*\s*(Kč|CZK|EUR|€|\$|USD|PLN|zł)", r"(cena|price|preis|prix)[\s:]*\d", r'class=["\'][^"\']*price[^"\']*["\']', r'itemprop=["\']price["\']']
SCHEMAS = [r'"@type"\s*:\s*"Product"', r'itemtype=["\']https?://schema\.org/Product["\']', r'"@type"\s*:\s*"Offer"', r'itemtype=["\']https?://schema\.org/Offer["\']']
SHOP_SIGNS = ["product-detail|product-page|product-view", "category-products|product-list|product-grid", "shopping-cart|mini-cart|cart-icon", "payment-methods|payment-icons", "shipping-info|delivery-info", "(visa|mastercard|paypal|gopay|comgate)"]
FREE_PLATFORMS = ["webzdarma", "estranky", "webgarden", "webnode", "wix", "weebly"]
SUBDOMAINS = [r"\.webnode\.(cz|com|sk)", r"\.wix\.com", r"\.wixsite\.com", r"\.squarespace\.com", r"\.weebly\.com", r"\.webzdarma\.cz", r"\.estranky\.(cz|sk)", r"\.webgarden\.cz", r"\.wordpress\.com", r"\.blogspot\.com", r"\.blogger\.com", r"\.jimdo\.com", r"\.site123\.me", r"\.mozello\.com", r"\.ucoz\.(cz|com|ru)"]
BUILDERS = ["wix", "squarespace", "webnode", "weebly", "jimdo"]
DEFAULT_THEMES = ["twentytwentyfour", "twentytwentythree", "twentytwentytwo", "twentytwentyone", "twentytwenty", "twentynineteen", "twentyseventeen", "twentysixteen", "twentyfifteen"]
PLATFORM_ADS = ["vytvořeno.*webnode", r"powered\s+by\s+webnode", r"powered\s+by\s+wix", r"wix\.com.*create", r"made\s+with\s+squarespace", r"powered\s+by\s+squarespace", r"webzdarma\.cz.*reklama", r"estranky\.cz.*banner", "create.*free.*website", "vytvořte.*web.*zdarma", "wix-ads?", "squarespace-branding", "webnode-banner", "webnode-footer-branding"]
PLACEHOLDERS = [r"lorem\s+ipsum", r"dolor\s+sit\s+amet", r"consectetur\s+adipiscing", r"váš\s+text\s*(zde|tady)", r"your\s+text\s*here", r"vložte\s+(svůj\s+)?text", r"insert\s+(your\s+)?text", r"sample\s+text", "placeholder", r"coming\s+soon", r"under\s+construction", r"ve\s+výstavbě", "připravujeme", r"\[text\]", r"\[název\]", r"\[popis\]"]
STOCK_SOURCES = ["shutterstock", "istockphoto", "gettyimages", "unsplash", "pexels", "pixabay", "dreamstime", "depositphotos", "fotolia"]
STOCK_ALTS = ["business meeting", "handshake", "team work", "happy customer", "office", "success", "growth", "professional"]
DEFAULT_FAVICONS = ["/wp-includes/images/w-logo-blue", "wix.com/favicon", "squarespace.com/favicon", "webnode.com/favicon", "joomla", "drupal"]
SEARCH = [r'<input[^>]+type\s*=\s*["\']search["\']', r'<form[^>]+(?:action|class|id)\s*=\s*["\'][^"\']*search[^"\']*["\']', r'<input[^>]+(?:name|id|class|placeholder)\s*=\s*["\'][^"\']*search[^"\']*["\']', r'class\s*=\s*["\'][^"\']*search-?(?:box|form|field|input)[^"\']*["\']', r"(?s:<button[^>]*>.*?(?:hled|search|vyhled).*?</button>)"]
BREADCRUMBS = [r'class\s*=\s*["\'][^"\']*breadcrumb[^"\']*["\']', r'<nav[^>]+aria-label\s*=\s*["\']breadcrumb["\']', r'itemtype\s*=\s*["\'][^"\']*BreadcrumbList["\']', r'<ol[^>]*class\s*=\s*["\'][^"\']*(?:breadcrumb|crumbs)[^"\']*["\']']
MOBILE_MENU = [r'class\s*=\s*["\'][^"\']*(?:hamburger|mobile-menu|burger|nav-toggle|menu-toggle)[^"\']*["\']', r'class\s*=\s*["\'][^"\']*(?:navbar-toggler|menu-btn|mobile-nav)[^"\']*["\']', r'<button[^>]*aria-label\s*=\s*["\'][^"\']*(?:menu|navigation|toggle)[^"\']*["\']', r'data-toggle\s*=\s*["\'](?:collapse|nav|menu)["\']', r'class\s*=\s*["\'][^"\']*(?:offcanvas|sidebar-menu|slide-menu)[^"\']*["\']']
DEAD_LINKS = [r'href\s*=\s*["\']#["\']', r'href\s*=\s*["\']javascript:\s*(?:void\s*\(\s*0\s*\)|;)["\']', r'href\s*=\s*["\']javascript:["\']']
WEAK_CTAS = ["odeslat", "send", "submit", "klikněte zde", "click here", "více", "more", "zde", "here", "ok", "potvrdit", "confirm"]
STRONG_CTAS = ["získ(?:at|ejte)", "objedn(?:at|ejte)", "koupit", "kontaktujte", "zavolej", "napište", "stáhn(?:ěte|out)", "vyzkoušet", "registr", "přihlásit", "rezerv", "začít", "get started", "buy now", "order", "contact us", "free trial", "sign up"]
CTAS = [r"<button[^>]*>([^<]+)</button>", r'<a[^>]+class\s*=\s*["\'][^"\']*(?:btn|button|cta)[^"\']*["\'][^>]*>([^<]+)</a>', r'<input[^>]+type\s*=\s*["\']submit["\'][^>]+value\s*=\s*["\']([^"\']+)["\']', r'<a[^>]+href\s*=\s*["\'][^"\']*(?:kontakt|contact|objednat|order)[^"\']*["\'][^>]*>([^<]+)</a>']
CONTACT_FORMS = [r'<form[^>]*(?:id|class|action)\s*=\s*["\'][^"\']*(?:contact|kontakt|poptav|inquiry)[^"\']*["\']', r"(?s:<form[^>]*>.*?(?:email|e-mail|telefon|phone|zpráva|message).*?</form>)", r'class\s*=\s*["\'][^"\']*(?:contact-form|inquiry-form|poptavka)[^"\']*["\']', r'<textarea[^>]*(?:name|id)\s*=\s*["\'][^"\']*(?:message|zprava|dotaz)[^"\']*["\']']
PHONES = [r"(?:tel|phone|telefon)[:\s]*[+]?420[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3}", r'href\s*=\s*["\']tel:[+]?\d[\d\s-]{8,}["\']', r"[+]420[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3}", r"\d{3}[\s-]\d{3}[\s-]\d{3}"]
TRUST = [r"ssl|secure|zabezpečen|šifrovan", r"certifik|certificate|iso\s*\d", "garanci|guarantee|záruk", "ocenění|award|vítěz|winner", "partner|member|člen", "heureka", r"zbozi\.cz|zboží\.cz", "shoptet", r"google\s*(?:partner|reviews)", r"facebook\s*(?:reviews|rating)", "trustpilot"]
SOCIAL_PROOF = ["recenz|review|hodnocen", "testimoni|reference|doporuč", r"(?:spokojených|satisfied)\s*(?:zákazník|klient|customer)", r"\d+\s*[+]?\s*(?:klient|zákazník|projekt|realizac)", r"case\s*stud|případov", r'class\s*=\s*["\'][^"\']*(?:client-logo|partner-logo|trust-logo)[^"\']*["\']', "spolupracujeme|our clients|naši klienti"]
COOKIE_CONSENT = [r'class\s*=\s*["\'][^"\']*(?:cookie-?(?:consent|banner|notice|bar|popup)|gdpr-?banner|cc-?banner)[^"\']*["\']', r'id\s*=\s*["\'][^"\']*(?:cookie-?(?:consent|banner|notice|bar)|gdpr|cc_div)[^"\']*["\']', "cookie(?:bot|consent|yes|info|script)|tarteaucitron|osano|onetrust|cookiepro", "data-(?:cookie|gdpr|consent)", r"souhlas(?:ím)?\s*s\s*cookies|accept\s*cookies|přijmout\s*cookies", r"nastavení\s*cookies|cookie\s*settings|upravit\s*cookies"]
TRACKING = [r"google-?analytics|gtag|ga\.js|analytics\.js", r"googletagmanager|gtm\.js", r"facebook\.net.*fbevents|fbq\(", r"hotjar\.com", r"linkedin\.com.*insight", r"connect\.facebook\.net", "pixel"]
EARLY_SCRIPTS = [r'gtag\s*\(\s*[\'"]config[\'"]', "GoogleAnalyticsObject", r'fbq\s*\(\s*[\'"]init[\'"]', r"hotjar\.com", "_linkedin_partner_id"]
CONSENT_WRAPPERS = [r"if\s*\([^)]*(?:consent|cookie|gdpr)", r"addEventListener\s*\([^)]*(?:consent|cookie)"]
SHOP_LOOKS = ["košík|cart|nákupní", "(?:produkt|product).*(?:cena|price)", "objednat|order|koupit|buy", "doprava|shipping|doručení", "platba|payment", r'class\s*=\s*["\'][^"\']*(?:add-to-cart|buy-button|product-price)[^"\']*["\']']
WITHDRAWAL = ["odstoupen|withdrawal|vrácen|return", r"14\s*(?:dní|dnů|den|days)", r"právo\s*(?:na\s*)?(?:vrácení|odstoupení)", "reklamace|complaint"]


def shop_platform(h: Text) -> Column:
    """The first shop platform with two marks (a meta mark counts twice); null without one."""
    out = F.lit(None).cast("string")
    for name, marks in reversed(SHOP_PLATFORMS.items()):
        points = sum((has(h, p).cast("int") * (2 if kind == "meta" else 1) for kind, p in marks.items()), F.lit(0))
        out = F.when(points >= 2, F.lit(name)).otherwise(out)
    return out


def shop_score(h: Text) -> Column:
    """Points for a shop: platform 5, cart signs 2 each, prices 1, schemas 3, other signs 1."""
    return F.when(shop_platform(h).isNotNull(), 5).otherwise(0) + found(h, CART) * 2 + found(h, PRICES) + found(h, SCHEMAS) * 3 + found(h, SHOP_SIGNS)


def shop_confidence(score: Column) -> Column:
    return F.when(score >= 10, "high").when(score >= 3, "medium").otherwise("low")


def cms_quality(p: dict[str, Column]) -> list[Rule]:
    """Free platforms, builders and their adverts, by the CMS found in the page."""
    h, cms = markup(p), F.lower(p["cms"])
    r = lambda code, when, evidence=None: Rule("cms_quality", code, when, evidence)
    theme = [rf"themes/{t}" for t in DEFAULT_THEMES] + [rf'class="[^"]*theme-{t}' for t in DEFAULT_THEMES]
    return [
        r("cms_subdomain_hosting", has(F.coalesce(host(p["url"]), F.lit("")), *SUBDOMAINS), host(p["url"])),
        r("cms_free_platform", cms.isin(FREE_PLATFORMS), cms),
        r("cms_builder_limitations", cms.isin(BUILDERS), cms),
        r("cms_wordpress_default_theme", (cms == "wordpress") & has(h, *theme), first(h, f"({'|'.join(DEFAULT_THEMES)})")),
        r("cms_platform_ads", has(h, *PLATFORM_ADS)),
    ]


def content_quality(p: dict[str, Column]) -> list[Rule]:
    """Placeholder texts, small and broken images, empty sections, old copyright, stock photos."""
    h, year = markup(p), F.year(p["as_of"])
    plain = Markup(strip_tags(h.html), strip_tags(h.low))

    def size(img: Column, name: str) -> Column:
        by_style = first(img, rf'style\s*=\s*["\'][^"\']*{name}\s*:\s*(\d+)px')
        return F.coalesce(by_style, first(img, rf'{name}\s*=\s*["\']?(\d+)')).try_cast("long")

    small = F.size(F.filter(every(h, "<img[^>]+>", 0), lambda i: F.coalesce(size(i, "width") < 200, F.lit(False)) | F.coalesce(size(i, "height") < 150, F.lit(False))))
    broken = (
        count(h, r'src\s*=\s*["\'](?:about:blank|javascript:|data:,)["\']', "u") + count(h, r'src\s*=\s*["\']["\']', "u")
        + count(h, r'<img[^>]+alt\s*=\s*["\'](?:image|obrázek|img|photo|placeholder)["\'][^>]*>') + count(h, r'src\s*=\s*["\'].*(?:no-?image|placeholder|default)[^"\']*["\']', "u")
    )
    empty = count(h, r"<section[^>]*>\s*</section>") + count(h, r'<div[^>]*class\s*=\s*["\'][^"\']*(?:section|content|wrapper)[^"\']*["\'][^>]*>\s*</div>') + count(h, r"<article[^>]*>\s*</article>")
    years = [first(h, q).cast("int") for q in (r"(?:©|&copy;|copyright)\s*(\d{4})", r"(\d{4})\s*(?:©|&copy;)", r"all\s+rights\s+reserved\s*(\d{4})")]
    mark = F.coalesce(*(F.when((y >= 2000) & (y <= year), y) for y in years))
    stock = sum((h.low.contains(s).cast("int") for s in STOCK_SOURCES), F.lit(0)) + found(h, [rf'alt\s*=\s*["\'][^"\']*{a}[^"\']*["\']' for a in STOCK_ALTS])
    r = lambda code, when, evidence=None: Rule("content_quality", code, when, evidence)
    return [
        r("content_placeholder_text", has(plain, *PLACEHOLDERS), first(plain, f"({'|'.join(PLACEHOLDERS)})")),
        r("content_small_images", small >= 3, said(small, "images")),
        r("content_broken_images", broken > 0, said(broken, "images")),
        r("content_empty_sections", empty > 0, said(empty, "sections")),
        r("content_outdated_copyright", mark < year - 1, mark.cast("string")),
        r("content_generic_stock_photos", stock >= 2, said(stock, "signs")),
    ]


def brand_colours(h: Text) -> Column:
    """Distinct colours of inline styles as six hex digits; black and white don't count."""
    raw = F.concat(every(h, r"(?:color|background-color|border-color)\s*:\s*(#[0-9a-fA-F]{3,6})"), every(h, r"(?:color|background-color|border-color)\s*:\s*(rgb\([^)]+\))"))
    byte = lambda c, g: F.lpad(F.hex(F.regexp_extract(c, r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", g).try_cast("int")), 2, "0")

    def whole(c: Column) -> Column:
        rgb = F.lower(F.concat(F.lit("#"), byte(c, 1), byte(c, 2), byte(c, 3)))
        short = c.startswith("#") & (F.length(c) == 4)
        return F.when(short, F.regexp_replace(c, "([0-9a-f])", "$1$1")).when(c.startswith("rgb"), F.coalesce(rgb, c)).otherwise(c)

    return F.array_distinct(F.filter(F.transform(F.array_distinct(raw), lambda c: whole(F.lower(F.trim(c)))), lambda c: ~c.isin("#000000", "#ffffff")))


def branding(p: dict[str, Column]) -> list[Rule]:
    """Favicon, logo, colours, marks of identity."""
    h = markup(p)
    icon = F.coalesce(first(h, r'<link[^>]+rel\s*=\s*["\'](?:icon|shortcut icon)["\'][^>]+href\s*=\s*["\']([^"\']+)["\']'), first(h, r'<link[^>]+href\s*=\s*["\']([^"\']+)["\'][^>]+rel\s*=\s*["\'](?:icon|shortcut icon)["\']'))
    default = reduce(Column.__or__, (F.lower(icon).contains(d) for d in DEFAULT_FAVICONS))
    logo = F.coalesce(
        first(h, r'(<img[^>]+(?:class|id)\s*=\s*["\'][^"\']*logo[^"\']*["\'][^>]+src\s*=\s*["\'][^"\']+["\'][^>]*>)'),
        first(h, r'(<img[^>]+src\s*=\s*["\'][^"\']+["\'][^>]+(?:class|id)\s*=\s*["\'][^"\']*logo[^"\']*["\'][^>]*>)'),
        first(h, r'(<img[^>]+src\s*=\s*["\'][^"\']*logo[^"\']+["\'][^>]*>)'),
        first(h, r'(<img[^>]+alt\s*=\s*["\'][^"\']*logo[^"\']*["\'][^>]+src\s*=\s*["\'][^"\']+["\'][^>]*>)'),
        first(h, r'<a[^>]+class\s*=\s*["\'][^"\']*logo[^"\']*["\'][^>]*>.*?(<img[^>]+src\s*=\s*["\'][^"\']+["\'][^>]*>)', flags="isu"),
    )
    width, height = first(logo, r'width\s*=\s*["\']?(\d+)').try_cast("long"), first(logo, r'height\s*=\s*["\']?(\d+)').try_cast("long")
    low = F.coalesce(width < 100, F.lit(False)) | F.coalesce(height < 30, F.lit(False))
    colours = F.size(brand_colours(h))
    r = lambda code, when, evidence=None: Rule("branding", code, when, evidence)
    return [
        r("branding_no_favicon", icon.isNull()),
        r("branding_default_favicon", icon.isNotNull() & default, icon),
        r("branding_no_logo", logo.isNull()),
        r("branding_low_quality_logo", logo.isNotNull() & low, F.concat_ws("x", width.cast("string"), height.cast("string"))),
        r("branding_inconsistent_colors", colours > 8, said(colours, "colours")),
        r("branding_no_brand_identity", ~has(h, r'<meta[^>]+property\s*=\s*["\']og:image["\']', r'<link[^>]+rel\s*=\s*["\']apple-touch-icon["\']', r'<meta[^>]+name\s*=\s*["\']theme-color["\']')),
    ]


def menu_labels(h: Text) -> Column:
    """Distinct link texts of the main menu, out of its first 15."""
    nav = F.coalesce(
        first(h, r'<nav[^>]*(?:id|class)\s*=\s*["\'][^"\']*(?:main|primary|header)[^"\']*["\'][^>]*>(.*?)</nav>', flags="isu"),
        first(h, r'<(?:ul|div)[^>]*(?:id|class)\s*=\s*["\'][^"\']*(?:main-menu|primary-menu|nav-menu|navbar)[^"\']*["\'][^>]*>(.*?)</(?:ul|div)>', flags="isu"),
        first(h, r"<header[^>]*>(.*?)</header>", flags="isu"),
        first(h, r"<nav[^>]*>(.*?)</nav>", flags="isu"),
        F.lit(""),
    )
    labels = F.filter(trimmed(every(nav, r"<a[^>]*>([^<]+)</a>")), lambda x: (x != "") & (F.length(x) < 50))
    return F.array_distinct(F.slice(labels, 1, 15))


def navigation_ux(p: dict[str, Column]) -> list[Rule]:
    """Menu length and depth, search, breadcrumbs, mobile menu, dead links (A10)."""
    h = markup(p)
    items = F.size(menu_labels(h))
    depths = [count(h, q) for q in (r'<ul[^>]*class\s*=\s*["\'][^"\']*sub-?menu[^"\']*["\']', r'<ul[^>]*class\s*=\s*["\'][^"\']*dropdown[^"\']*["\']', r'<li[^>]*class\s*=\s*["\'][^"\']*has-?(?:sub|children|dropdown)[^"\']*["\']')]
    last = F.lit(1)
    for n in depths:  # the last kind that occurs decides
        last = F.when(n > 20, 4).when(n > 10, 3).when(n > 0, 2).otherwise(last)
    dead = sum((count(h, q) for q in DEAD_LINKS), F.lit(0))
    r = lambda code, when, evidence=None: Rule("navigation_ux", code, when, evidence)
    return [
        r("nav_too_many_items", items > 7, said(items, "items")),
        r("nav_deep_hierarchy", last > 3, said(last, "levels")),
        r("nav_no_search", ~has(h, *SEARCH)),
        r("nav_no_breadcrumbs", ~has(h, *BREADCRUMBS)),
        r("nav_no_mobile_menu", ~has(h, *MOBILE_MENU)),
        r("nav_broken_links", dead > 5, said(dead, "links")),
    ]


def calls_to_action(h: Text) -> Column:
    texts = trimmed(F.concat(*(every(h, q) for q in CTAS)))
    return F.filter(texts, lambda t: (t != "") & (F.octet_length(t) <= 50))


def conversion(p: dict[str, Column]) -> list[Rule]:
    """Calls to action, contact, trust, proof."""
    h = markup(p)
    ctas = calls_to_action(h)
    strong, weak = F.exists(ctas, lambda t: has(t, *STRONG_CTAS)), F.exists(ctas, lambda t: F.lower(t).isin(WEAK_CTAS))
    form = has(h, *CONTACT_FORMS, r'(?s:<form[^>]*>.*?<input[^>]+type\s*=\s*["\']email["\'].*?</form>)')
    phone = has(h, *PHONES)
    mails = [first(h, q, 1, "u") for q in (r'href\s*=\s*["\']mailto:([^"\'?]+)["\']', r"([\w.-]+@[\w.-]+\.\w{2,})")]
    mail = sum((F.coalesce(~has(m, r"example\.com|test\.com|email\.com|your-?email"), F.lit(False)).cast("int") for m in mails), F.lit(0)) > 0
    r = lambda code, when, evidence=None: Rule("conversion", code, when, evidence)
    return [
        r("conversion_no_cta", F.size(ctas) == 0),
        r("conversion_weak_cta", (F.size(ctas) > 0) & weak & ~strong, F.array_join(F.slice(F.array_distinct(ctas), 1, 3), ", ")),
        r("conversion_no_contact_form", ~form),
        r("conversion_no_phone", ~phone),
        r("conversion_no_email", ~mail),
        r("conversion_hidden_contact", ~phone & ~mail & ~form),
        r("conversion_no_trust_signals", ~has(h, *TRUST)),
        r("conversion_no_social_proof", ~has(h, *SOCIAL_PROOF)),
    ]


def legal_compliance(p: dict[str, Column]) -> list[Rule]:
    """Cookie consent, privacy, terms, company details, withdrawal."""
    h = markup(p)
    head = F.coalesce(first(h, r"<head[^>]*>(.*?)</head>", flags="isu"), F.lit(""))
    shop = found(h, SHOP_LOOKS) >= 2
    privacy = has(h, r'href\s*=\s*["\'][^"\']*(?:privacy|gdpr|soukrom|osobni-?udaje|ochrana-?(?:soukromi|udaju))[^"\']*["\']', flags="u")
    privacy = privacy | has(h, r"<a[^>]*>.*?(?:zásady\s*(?:ochrany\s*)?soukromí|privacy\s*policy|ochrana\s*(?:osobních\s*)?údajů|gdpr).*?</a>", flags="isu")
    terms = has(h, r'href\s*=\s*["\'][^"\']*(?:terms|conditions|obchodni-?podminky|vop|vseobecne-?podminky)[^"\']*["\']', flags="u")
    terms = terms | has(h, r"<a[^>]*>.*?(?:obchodní\s*podmínky|terms|všeobecné\s*podmínky|vop).*?</a>", flags="isu")
    company = has(h, r"(?:IČO?|IČ|IC)\s*:?\s*\d{8}", r"(?:DIČ|DIC)\s*:?\s*CZ\d{8,10}", r"(?:provozovatel|společnost|firma)\s*:?\s*[^<,\n]{5,50}(?:s\.r\.o\.|a\.s\.|spol\.)", r"(?:sídlo|adresa)\s*:?\s*[^<\n]{10,100}")
    r = lambda code, when, evidence=None: Rule("legal_compliance", code, when, evidence)
    return [
        r("legal_no_cookie_consent", ~has(h, *COOKIE_CONSENT) & has(h, *TRACKING)),
        r("legal_cookies_before_consent", has(head, *EARLY_SCRIPTS) & ~has(head, *CONSENT_WRAPPERS)),
        r("legal_no_privacy_policy", ~privacy),
        r("legal_no_terms", ~terms & shop),
        r("legal_no_company_info", ~company),
        r("legal_no_withdrawal_info", shop & (found(h, WITHDRAWAL) < 2)),
    ]


#: What a code takes off the category's own score of 100, and the levels of such scores.
PENALTIES = {
    "cms_quality": {"cms_subdomain_hosting": 40, "cms_free_platform": 30, "cms_builder_limitations": 15, "cms_wordpress_default_theme": 20, "cms_platform_ads": 25},
    "content_quality": {"content_placeholder_text": 30, "content_small_images": 15, "content_broken_images": 25, "content_empty_sections": 10, "content_outdated_copyright": 5, "content_generic_stock_photos": 5},
    "branding": {"branding_no_favicon": 20, "branding_default_favicon": 15, "branding_no_logo": 15, "branding_low_quality_logo": 10, "branding_inconsistent_colors": 10, "branding_no_brand_identity": 10},
    "navigation_ux": {"nav_too_many_items": 15, "nav_deep_hierarchy": 10, "nav_no_search": 5, "nav_no_breadcrumbs": 5, "nav_no_mobile_menu": 20, "nav_broken_links": 10},
    "conversion": {"conversion_no_cta": 30, "conversion_weak_cta": 10, "conversion_no_contact_form": 25, "conversion_no_phone": 10, "conversion_no_email": 10, "conversion_no_trust_signals": 10, "conversion_no_social_proof": 5},
    "legal_compliance": {"legal_no_cookie_consent": 30, "legal_cookies_before_consent": 15, "legal_no_privacy_policy": 25, "legal_no_terms": 20, "legal_no_company_info": 20, "legal_no_withdrawal_info": 10},
}
LEVELS = {
    "cms_quality": ["excellent", "good", "fair", "poor"], "content_quality": ["excellent", "good", "fair", "poor"], "branding": ["excellent", "good", "fair", "poor"],
    "navigation_ux": ["excellent", "good", "fair", "poor"], "conversion": ["excellent", "good", "fair", "poor"],
    "legal_compliance": ["compliant", "mostly_compliant", "partially_compliant", "non_compliant"],
}
