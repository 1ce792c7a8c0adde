"""Contacts and technology out of pages: e-mails, phones, company ids, CMS, technologies, profiles, names, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decode_entities, strip_tags, valid_company_id
from ..functions.urls import domain, resolve
from .rules import bound

# Fixed values.
IGNORED_MAIL_DOMAINS = ["example.com", "example.org", "example.net", "domain.tld", "domain.com", "yourdomain.com", "email.com", "wixpress.com", "sentry.io", "sentry-next.wixpress.com", "placeholder.com", "test.com", "localhost"]
ASSET_TLDS = ["png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp", "tiff", "avif", "css", "js", "map", "woff", "woff2", "ttf", "eot", "otf"]
FAKE_LOCAL_PARTS = ["your", "email", "name", "user", "xxx", "test", "sample", "demo"]
MAIL_PREFIXES = [
    ["info", "kontakt", "contact", "objednavky", "obchod", "office", "podpora", "support", "recepce"],
    ["sales", "marketing", "fakturace", "uctarna", "hr", "jobs", "career", "servis", "service"],
]
MAIL = r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"
VALID_MAIL = r"^[a-z0-9!#$%&'*+/=?^_`{|}~\-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~\-]+)*@([a-z0-9]([a-z0-9\-]*[a-z0-9])?\.)+[a-z0-9\-]*[a-z0-9]$"
NOT_CONTENT = r'(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>|<img\b[^>]*>|\bsrcset\s*=\s*["\'][^"\']*["\']|background(?:-image)?\s*:\s*url\([^)]+\)|\bdata-(?:src|background|image|srcset)\s*=\s*["\'][^"\']*["\']'
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
PHONES = [r"\+420[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}", r"00420[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}", r"(?<![0-9+])\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}(?![0-9])", r"(?i)tel:\s*\+?[0-9\s.\-]+"]
COMPANY_IDS = [r"I[ČC]O?\s*[:\s]\s*(\d{8})", r"I[ČC]\s+(\d{8})", r"identifika[čc]n[ií]\s+[čc][ií]slo\s*[:\s]\s*(\d{8})", r"company\s*id\s*[:\s]\s*(\d{8})", r"registra[čc]n[ií]\s+[čc][ií]slo\s*[:\s]\s*(\d{8})"]
CMS = {
    "vismo": (["vismo.cz", "redakční systém vismo", "redakcni system vismo", "cms vismo"], "Vismo", None),
    "shoptet": (["/user/documents/", "shoptet.cz", "cdn.myshoptet.com"], "Shoptet", None),
    "eshop-rychle": (["eshop-rychle.cz", "cdn.eshop-rychle.cz"], None, None),
    "webareal": (["webareal.cz", "webareal.com"], None, None),
    "webgarden": (["webgarden.cz"], None, None),
    "estranky": (["estranky.cz", "estranky.sk"], None, None),
    "webzdarma": (["webzdarma.cz"], None, None),
    "webnode": (["webnode.cz", "webnode.com", "webnode.page"], None, None),
    "wordpress": (["/wp-content/", "/wp-includes/", "/wp-json/", "wp-emoji"], "WordPress", None),
    "wix": (["static.wixstatic.com", "_wix_", "wixsite.com", "wixpress.com"], "Wix", None),
    "squarespace": (["squarespace.com", "sqsp.net", "static1.squarespace.com"], "Squarespace", None),
    "shopify": (["cdn.shopify.com", "myshopify.com", "shopify.com"], "Shopify", None),
    "joomla": (["/media/jui/", "/media/system/js/"], "Joomla", None),
    "drupal": (["/sites/default/files/", "/sites/all/modules/", "drupal.js", "drupal.settings"], "Drupal", "x-drupal-cache"),
    "magento": (["/static/frontend/", "mage/cookies.js", "magento_"], None, "x-magento-"),
    "opencart": (["catalog/view/javascript/common.js", "index.php?route=product"], None, None),
    "prestashop": (["/modules/ps_", "/themes/classic/", "prestashop.com", "prestashop"], "PrestaShop", None),
}
TECHNOLOGIES = {
    "jquery": r"jquery[\-.]?\d|jquery\.min\.js", "bootstrap": r"bootstrap[\-.]?\d|bootstrap\.min\.(js|css)", "react": r"react[\-.]production|react[\-.]development|react\.min\.js|reactDOM",
    "vue": r"vue[\-.]?\d|vue\.min\.js|vue\.runtime", "angular": r"angular[\-.]?\d|angular\.min\.js|ng-app", "tailwind": "tailwind|tailwindcss",
    "google_analytics": r"gtag\(|google-analytics\.com|ga\.js|analytics\.js|googletagmanager\.com/gtag", "google_tag_manager": r"googletagmanager\.com/gtm",
    "facebook_pixel": r"fbevents\.js|facebook\.net/.*/fbevents|fbq\(", "hotjar": r"hotjar\.com|static\.hotjar\.com", "matomo": r"matomo\.js|piwik\.js",
    "recaptcha": r"google\.com/recaptcha|grecaptcha", "cloudflare": r"cdnjs\.cloudflare\.com|cloudflare\.com", "font_awesome": "font-?awesome",
    "google_fonts": r"fonts\.googleapis\.com|fonts\.gstatic\.com", "modernizr": "modernizr", "lodash": "lodash", "moment": r"moment\.js|moment\.min\.js",
    "axios": r"axios\.min\.js|axios", "webpack": "webpack", "vite": "vite", "next": "_next/", "nuxt": "_nuxt/", "gatsby": "gatsby", "laravel": r"laravel|app\.js.*csrf",
    "symfony": r"bundles/.*\.js|sf2", "swiper": "swiper", "slick": "slick", "lightbox": "lightbox", "fancybox": "fancybox", "owl_carousel": r"owl\.carousel",
    "aos": r"aos\.js|aos\.css", "gsap": "gsap", "three_js": r"three\.js|three\.min\.js", "leaflet": "leaflet", "mapbox": "mapbox",
}
PROFILES = {
    "facebook": (r"(https?://(?:www\.)?facebook\.com/(?!sharer|share|dialog|plugins)([a-zA-Z0-9._\-]+)/?)", ["sharer.php", "share", "dialog", "plugins", "home.php", "pages", "groups", "events", "watch", "marketplace", "gaming"]),
    "instagram": (r"(https?://(?:www\.)?instagram\.com/([a-zA-Z0-9._]+)/?)", ["explore", "p", "reel", "stories", "tv", "accounts"]),
    "linkedin": (r"(https?://(?:www\.)?linkedin\.com/(?:company|in)/([a-zA-Z0-9\-_]+)/?)", ["sharearticle", "feed", "jobs", "messaging", "notifications"]),
    "twitter": (r"(https?://(?:www\.)?(?:twitter|x)\.com/([a-zA-Z0-9_]+)/?)", ["intent", "share", "home", "search", "explore", "i", "hashtag"]),
    "youtube": (r"(https?://(?:www\.)?youtube\.com/(?:channel|c|@|user)/([a-zA-Z0-9\-_]+)/?)", ["watch", "results", "feed", "playlist", "shorts"]),
    "tiktok": (r"(https?://(?:www\.)?tiktok\.com/@([a-zA-Z0-9._]+)/?)", []),
    "pinterest": (r"(https?://(?:www\.)?pinterest\.[a-z]+/([a-zA-Z0-9_]+)/?)", []),
}
LEGAL_FORMS = [r"s\.\s*r\.\s*o\.?", r"spol\.\s*s\s*r\.\s*o\.?", r"a\.\s*s\.?", r"v\.\s*o\.\s*s\.?", r"k\.\s*s\.?", r"z\.\s*s\.?", r"s\.\s*p\.?", r"o\.\s*p\.\s*s\.?", r"z\.\s*ú\.?", r"n\.\s*o\.?"]
LEGAL_WORDS = ["SE", "SRO", "AS"]
CAPITALS, LETTERS = "A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ", "A-Za-záčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
NO_NAMES = [r"^(home|úvod|kontakt|o nás|about|contact|services|služby)$", "^(hlavní strana|hlavní stránka|domů)$", "^(menu|navigation|footer|header)$", r"^\d+$", "^https?://", r"^meta\s", "charset", "^(utf|iso|windows)", "^(div|span|class|style|script|link|img)", r"^all\s+rights\s+reserved", "^copyright"]
ORGANISATIONS = ["Organization", "LocalBusiness", "Corporation", "Company", "Store", "Restaurant", "Hotel"]
CONTACT_PAGES = r"(?i)kontakt|contact|about|o-nas|onas|impressum|napiste|napište"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _trim(x: Column) -> Column:
    return F.trim(x)  # F.trim itself would take the place that a transform passes second for the characters to trim


def valid_mail(mail: Column, ignored: list[str] = IGNORED_MAIL_DOMAINS) -> Column:
    """Of valid form, not of an ignored domain or below it, not a file name, not a made-up local part."""
    name, at = F.substring_index(mail, "@", 1), F.substring_index(mail, "@", -1)
    out = mail.rlike(VALID_MAIL) & ~F.substring_index(at, ".", -1).isin(ASSET_TLDS) & ~at.rlike(r"^\d+\.\w+$|^[\dx]+\.\d+\.\w+$") & ~name.isin(FAKE_LOCAL_PARTS)
    if ignored:
        out = out & ~at.rlike(r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in ignored) + ")$")
    return out


def mail_priority(mail: Column) -> Column:
    """0 for general addresses, 1 for departments, 2 for others."""
    out = F.lit(len(MAIL_PREFIXES))
    for i, prefixes in reversed(list(enumerate(MAIL_PREFIXES))):
        out = F.when(mail.rlike("^(?:" + "|".join(prefixes) + ")"), F.lit(i)).otherwise(out)
    return out


def emails(html: Column, ignored: list[str] = IGNORED_MAIL_DOMAINS) -> Column:
    """Addresses of a page by priority, then place: mailto links, split data attributes, then the text."""
    clean = lambda x: F.lower(F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(decode_entities(x)), x), r"[.,;:!?)]+$", "")))
    q = r"[\"']"
    one = _all(html, rf"(?i)(data-mail={q}[^\"']+{q}[^>]*data-domain={q}[^\"']+{q})", 1)
    two = _all(html, rf"(?i)(data-domain={q}[^\"']+{q}[^>]*data-mail={q}[^\"']+{q})", 1)
    part = lambda x, name: F.trim(F.regexp_extract(x, rf"(?i)data-{name}={q}([^\"']+){q}", 1))
    split = F.transform(F.concat(one, two), lambda x: F.lower(F.concat(part(x, "mail"), F.lit("@"), part(x, "domain"))))
    linked = F.transform(_all(html, r"(?i)mailto:([^\"'>\s?]+)", 1), clean)
    written = F.transform(_all(F.regexp_replace(html, NOT_CONTENT, ""), MAIL), clean)
    found = F.array_distinct(F.filter(F.concat(linked, split, written), lambda m: valid_mail(m, ignored)))
    ranked = F.array_sort(F.transform(found, lambda m, i: F.struct(mail_priority(m).alias("p"), i.alias("i"), m.alias("m"))))
    return F.transform(ranked, lambda x: x["m"])


def _plain_blanks(text: Column) -> Column:
    """Blanks of all widths, such as the one that doesn't break, as plain ones: patterns' blanks mean them too."""
    return F.translate(text, BLANKS, " " * len(BLANKS))


def phones(html: Column) -> Column:
    """Czech numbers as +420 and nine digits, in order of patterns and places."""

    def normal(x: Column) -> Column:
        digits = F.regexp_replace(x, "[^0-9+]", "")
        digits = F.regexp_replace(digits, "^00420", "+420")
        return F.when(F.length(digits) == 9, F.concat(F.lit("+420"), digits)).otherwise(digits)

    found = bound(_plain_blanks(decode_entities(html)), lambda text: F.concat(*(_all(text, p) for p in PHONES)))
    valid = lambda x: x.rlike(r"^\+420[2-7]\d{8}$") & ~x.rlike(r"^\+420(\d)\1{8}$") & (x != "+420123456789")
    return F.array_distinct(F.filter(F.transform(found, normal), valid))


def company_id(html: Column) -> Column:
    """The first id with a right check digit, pattern by pattern."""
    first = lambda text, p: F.get(F.filter(_all(text, f"(?iu){p}", 1), valid_company_id), 0)
    return bound(_plain_blanks(decode_entities(html)), lambda text: F.coalesce(*(first(text, p) for p in COMPANY_IDS)))


def detect_cms(html: Column, headers: Column | None = None) -> Column:
    """The first system of the list with a mark in the page, its generator tag or a header."""
    out = F.lit(None).cast("string")
    for name, (marks, generator, header) in reversed(CMS.items()):
        quoted = ["".join(f"\\{c}" if c in ".?+()[]" else c for c in m) for m in marks]
        hit = html.rlike("(?iu)" + "|".join(quoted + ([f"generator.*{generator}"] if generator else [])))
        if header and headers is not None:
            hit = hit | F.coalesce(F.exists(F.map_keys(headers), lambda k: F.lower(k).startswith(header)), F.lit(False))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def technologies(html: Column) -> Column:
    """Names of the technologies with a mark in the page, in order of the list."""
    return F.filter(F.array(*(F.when(html.rlike(f"(?i){p}"), F.lit(n)) for n, p in TECHNOLOGIES.items())), lambda x: x.isNotNull())


def social_profiles(html: Column) -> Column:
    """Map of platform to the first profile that is no ignored path and has two characters or more."""

    def entry(name: str) -> Column:
        pattern, ignored = PROFILES[name]
        both = F.arrays_zip(_all(html, f"(?i){pattern}", 1).alias("url"), _all(html, f"(?i){pattern}", 2).alias("profile"))
        good = F.filter(both, lambda x: ~F.lower(x["profile"]).isin(ignored or [""]) & (F.length(x["profile"]) >= 2))
        url = F.regexp_replace(F.regexp_replace(F.get(good, 0)["url"], "/+$", ""), "(?i)^http://", "https://")
        return F.when(url.isNotNull(), F.struct(F.lit(name).alias("key"), url.alias("value")))

    return F.map_from_entries(F.filter(F.array(*(entry(n) for n in PROFILES)), lambda x: x.isNotNull()))


def valid_name(name: Column) -> Column:
    return F.length(name).between(2, 200) & name.rlike(r"\p{L}") & ~name.rlike("(?iu)" + "|".join(NO_NAMES))


def company_names(html: Column) -> Column:
    """Candidate names, best first: organisation markup, site name, legal form, copyright, title (X9).  The page without
    scripts and its text are each computed once."""
    scripts = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
    return bound(decode_entities(html), lambda d: bound(F.regexp_replace(d, scripts, ""), lambda bare: bound(strip_tags(bare), lambda text: _names(html, bare, text))))


def _names(html: Column, bare: Column, text: Column) -> Column:
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[\s,;:\-–—|]+|[\s,;:\-–—|]+$", ""), r",\s*,", ","))
    blocks = _all(html, r'(?is)<script[^>]+type=["\']application/ld\+json["\'][^>]*>(.*?)</script>', 1)
    shape = "struct<`@type`:string,name:string>"
    items = F.flatten(F.transform(blocks, lambda b: F.concat(F.array(F.from_json(F.trim(b), shape)), F.coalesce(F.from_json(F.trim(b), f"struct<`@graph`:array<{shape}>>")["@graph"], F.array().cast(f"array<{shape}>")))))
    kinds = "|".join(ORGANISATIONS)
    schema = F.transform(F.filter(items, lambda x: x["@type"].rlike(rf'^(?:{kinds})$|"(?:{kinds})"')), lambda x: F.coalesce(F.get_json_object(x["name"], "$[0]"), x["name"]))
    micro = _all(bare, r'(?is)<[^>]+itemtype=["\'][^"\']*(?:Organization|LocalBusiness)[^"\']*["\'][^>]*>.*?<[^>]+itemprop=["\']name["\'][^>]*>([^<]+)<', 1)
    site = F.concat(
        _all(bare, r'(?i)<meta[^>]+(?:property|name)=["\']og:site_name["\'][^>]+content=["\']([^"\']+)["\']', 1),
        _all(bare, r'(?i)<meta[^>]+content=["\']([^"\']+)["\'][^>]+(?:property|name)=["\']og:site_name["\']', 1),
    )

    def form(forms: list[str], flags: str) -> Column:
        """Names before a legal form; looked for only where the text has such a form, and from the beginnings of words on."""
        any_form = "|".join(forms)
        begin = rf"(?<![{LETTERS}])" if "i" in flags else ""
        found = _all(text, rf"(?{flags}){begin}([{CAPITALS}][{LETTERS}0-9\s\-&]+\s*,?\s*(?:{any_form}))(?:\s|$|[,.])", 1)
        named = F.transform(found, lambda x: tidy(F.regexp_replace(x, rf"(?{flags})\s*,?\s*({any_form})$", ", $1")))
        return F.when(text.rlike(rf"(?{flags})(?:{any_form})(?:\s|$|[,.])"), named).otherwise(F.array().cast("array<string>"))

    marked = F.transform(_all(text, r"(?iu)©\s*(?:\d{4}\s*[-–]\s*)?\d{4}\s+([^\n\r|]+?)(?:\s*[|,.\-]|$)", 1), tidy)
    title = F.transform(F.split(F.trim(F.regexp_extract(bare, r"(?i)<title[^>]*>([^<]+)</title>", 1)), r"\s*[|\-–—]\s*"), _trim)
    like_name = lambda x: x.rlike(rf"(?iu)(?:{'|'.join(LEGAL_FORMS)})") | x.rlike(rf"\b(?:{'|'.join(LEGAL_WORDS)})$") | (x.rlike(f"^[{CAPITALS}]") & (F.length(x) <= 50))
    of = lambda names, priority: F.transform(names, lambda n: F.struct(F.lit(-priority).alias("p"), n.alias("name")))
    every = F.concat(of(schema, 100), of(F.transform(micro, _trim), 100), of(F.transform(F.slice(site, 1, 1), _trim), 90), of(form(LEGAL_FORMS, "iu"), 80), of(form(LEGAL_WORDS, "u"), 80), of(marked, 70), of(F.filter(title, like_name), 50))
    good = F.filter(every, lambda x: valid_name(x["name"]))
    placed = F.array_sort(F.transform(good, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["name"].alias("name"))))
    first = lambda xs: F.filter(xs, lambda x, i: F.size(F.filter(F.slice(xs, F.lit(1), i), lambda y: F.lower(y["name"]) == F.lower(x["name"]))) == 0)
    return F.transform(F.transform(F.array(placed), first)[0], lambda x: x["name"])


def page_profiles(pages: DataFrame, ignored: list[str] = IGNORED_MAIL_DOMAINS) -> DataFrame:
    """One row for each page with all that can be extracted; the first of each list is primary."""
    h = F.coalesce(F.col("html"), F.lit(""))
    headers = F.col("headers") if "headers" in pages.columns else None
    rows = pages.select(
        "page_id", "url", emails(h, ignored).alias("emails"), phones(h).alias("phones"), company_id(h).alias("company_id"), detect_cms(h, headers).alias("cms"),
        technologies(h).alias("technologies"), social_profiles(h).alias("social"), company_names(h).alias("company_names"),
    )
    return rows.select(
        "*", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"), F.get("company_names", F.lit(0)).alias("company_name"),
        ((F.size("emails") > 0) | (F.size("phones") > 0)).alias("has_contact_data"),
    )


def links(pages: DataFrame) -> DataFrame:
    """Distinct links (page_id, url, place, href, target) that lead to pages: no anchors, scripts, mail or phone links."""
    hrefs = pages.select("page_id", "url", F.posexplode(_all(F.coalesce(F.col("html"), F.lit("")), r'(?i)href\s*=\s*["\']([^"\']+)["\']', 1)).alias("place", "href"))
    real = hrefs.where(~F.trim("href").rlike(r"(?i)^(#|javascript:|mailto:|tel:)")).withColumn("target", resolve(F.col("href"), F.col("url")))
    return real.where(F.col("target").rlike(r"(?i)^https?://[a-z0-9]")).groupBy("page_id", "url", "target").agg(F.min("place").alias("place"), F.min_by("href", "place").alias("href"))


def site_contacts(pages: DataFrame, most: int = 3, ignored: list[str] = IGNORED_MAIL_DOMAINS) -> DataFrame:
    """Profiles of home pages; one without e-mail takes in the contacts of up to ``most`` contact pages that it links to, in order,
    up to the first that has an e-mail (X11)."""
    homes = page_profiles(pages, ignored)
    bare = homes.where(F.size("emails") == 0).select("page_id")
    wanted = links(pages.join(bare, "page_id", "left_semi")).where(F.col("href").rlike(CONTACT_PAGES) & (domain(F.col("target")) == domain(F.col("url"))))
    ranked = wanted.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("place", "target"))).where(F.col("n") <= most)
    contacts = homes.select(F.col("url").alias("target"), F.col("emails").alias("e"), F.col("phones").alias("p"))
    seen = ranked.select("page_id", "n", "target").join(contacts, "target")
    stop = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    used = seen.withColumn("before", F.coalesce(F.max(F.size("e") > 0).over(stop), F.lit(False))).where("not before")
    lists = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c]))
    more = used.groupBy("page_id").agg(lists("e").alias("more_e"), lists("p").alias("more_p"))
    joined = homes.join(more, "page_id", "left")
    none = F.array().cast("array<string>")
    joined = joined.withColumn("emails", F.array_union("emails", F.coalesce("more_e", none))).withColumn("phones", F.array_union("phones", F.coalesce("more_p", none)))
    return joined.withColumn("email", F.get("emails", F.lit(0))).withColumn("phone", F.get("phones", F.lit(0))).drop("more_e", "more_p")


def write_back(leads: DataFrame, found: DataFrame, key: str, columns: list[str], force: bool = False) -> DataFrame:
    """Leads with the found values where theirs are null, or wherever there is one if ``force``."""
    new = found.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = leads.join(new, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c) if force else F.coalesce(c, f"_new_{c}"))
    return joined.select(*leads.columns)
