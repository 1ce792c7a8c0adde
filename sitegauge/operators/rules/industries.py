"""Rules for pages of one industry.  The patterns in the rules are fixed values, like the lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import Rule, count, found, has, markup, said

# Fixed values.
PAYMENTS = [r"platební\s*karta|credit\s*card|debit\s*card|visa|mastercard|maestro|kartou", r"bankovní\s*převod|bank\s*transfer|převodem", r"dobírka|cash\s*on\s*delivery|cod\b", "paypal", "gopay", "comgate", "stripe", r"apple\s*pay", r"google\s*pay"]
CARRIERS = [r"\bppl\b", r"\bdpd\b", r"\bgls\b", r"česká\s*pošta|ceska\s*posta", "zásilkovna|zasilkovna|packeta", r"osobní\s*odběr|vyzvednutí|pickup", "doručení|doprava|shipping|delivery"]
TRUST = ["heureka", r"zbozi\.cz|zboží\.cz", r"česk[ýá]\s*(?:produkt|výrob)", "záruka|garance|guarantee", r"bezpečná\s*platba|secure\s*payment|ssl", "ověřen[oý]|verified"]
SERVICES = [r"webdesign|web\s*design|tvorba\s*web", r"vývoj\s*web|web\s*development|programování", r"e-?shop|internetov[ýá]\s*obchod", r"\bseo\b", "marketing|ppc|reklama|advertising", "branding|brand|značka|logo|identity", r"ux|ui|user\s*experience|user\s*interface", r"mobilní\s*aplikace|mobile\s*app", r"správa\s*web|údržba|maintenance|hosting"]
PORTFOLIO = [r"portfolio|naše\s*práce|our\s*work|projekty|realizace", r"case\s*stud|případov[áé]\s*studi", "reference|klienti|clients|zákazníci"]
CALLS = [r"kontaktujte\s*nás|contact\s*us|napište\s*nám", r"nezávazná\s*nabídka|poptávka|get\s*(?:a\s*)?quote|cenová\s*nabídka", r"konzultace|consultation|schůzka|meeting", r"zavolejte|call\s*us|volejte"]
TESTIMONIALS = [r"testimonial|reference|co\s*říkají|what\s*.*\s*say|recenze\s*klient", r"spokojený\s*klient|satisfied\s*customer|happy\s*client", r"hodnocení\s*klient|client\s*review"]
TREATMENTS = ["prevence|preventivní|prohlídka", "zubn[íý]|stomatolog|dental", r"laboratorní|odběr\s*krve|rozbor", "chirurgie|operace|zákrok", "terapie|rehabilitace|fyzioterapie", "diagnos|vyšetření|ultrazvuk|rtg|ct|mri"]


def eshop(p: dict[str, Column]) -> list[Rule]:
    """A14."""
    h = markup(p)
    schema = has(h, r'"@type"\s*:\s*"Product"', r'itemtype=["\']https?://schema\.org/Product["\']')
    structure = found(h, [r"přidat\s*do\s*košíku|add\s*to\s*cart|koupit|buy\s*now", r"(?:\d+[\s,.]?\d*)\s*(?:Kč|CZK|€|\$|EUR)", "product[_-]?image|gallery|carousel", r"skladem|dostupn[ýáé]|in\s*stock|available"]) >= 2
    cart = has(h, r'href=["\'][^"\']*(?:kosik|cart|basket)["\']', r"košík|nákupní\s*košík|shopping\s*cart|cart\b", "cart[_-]?icon|shopping[_-]?cart|basket[_-]?icon|fa-shopping")
    methods, section = found(h, PAYMENTS), has(h, r"způsob\s*platby|platební\s*metod|payment\s*method")
    shipping = has(h, r"způsob\s*doprav|doprava\s*a\s*platba|shipping|delivery") | (found(h, CARRIERS) > 0)
    reviews, seal = has(h, "hodnocení|recenze|reviews?|rating|stars?|hvězd"), has(h, "ssl[_-]?seal|secure[_-]?badge|thawte|comodo|digicert|lets[_-]?encrypt")
    signals = found(h, TRUST) + reviews.cast("int") + seal.cast("int")
    search = has(h, "<form[^>]*(?:search|hledat|vyhled)", r'type=["\']search["\']|name=["\'](?:q|query|search|hledat)["\']') | (has(h, "search[_-]?icon|fa-search|icon-search|lupa") & has(h, "hledat|vyhled|search"))
    contact = has(h, r"(?:\+420\s*)?(?:\d{3}\s*){3}|\+420[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3}", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r'href=["\'][^"\']*(?:kontakt|contact)["\']|>kontakt<|>contact<')
    r = lambda code, when, evidence=None: Rule("industry_eshop", code, when, evidence)
    return [
        r("eshop_no_product_pages", ~schema & ~structure),
        r("eshop_no_product_schema", ~schema & structure),
        r("eshop_no_cart", ~cart),
        r("eshop_cart_ux_issues", cart & ~has(h, "cart[_-]?count|item[_-]?count|badge", "celkem|total|suma|subtotal")),
        r("eshop_no_payment_methods", (methods == 0) & ~section),
        r("eshop_limited_payment_methods", (methods <= 2) & ~((methods == 0) & ~section), said(methods, "methods")),
        r("eshop_no_shipping_info", ~shipping),
        r("eshop_no_free_shipping_threshold", shipping & ~has(h, r"doprava\s*zdarma|free\s*shipping")),
        r("eshop_no_ssl_seal", ~seal),
        r("eshop_no_reviews", ~reviews),
        r("eshop_no_trust_badges", ~has(h, "heureka", r"zbozi\.cz|zboží\.cz") & (signals < 3), said(signals, "signals")),
        r("eshop_no_search", ~search),
        r("eshop_no_contact_info", ~contact),
        r("eshop_no_return_policy", ~has(h, r"vrácení\s*zboží|reklamace|vrátit\s*zboží|return\s*policy|odstoupení\s*od\s*smlouvy")),
    ]


def webdesign(p: dict[str, Column]) -> list[Rule]:
    """A15."""
    h = markup(p)
    link = lambda *names: rf'href=["\'][^"\']*(?:{"|".join(names)})["\']'
    portfolio = has(h, *PORTFOLIO, link("portfolio", "prace", "work", "projekty", "realizace"))
    items = count(h, r'<(?:article|div)[^>]*class=["\'][^"\']*(?:project|portfolio[_-]?item|work[_-]?item)["\'][^>]*>')
    services = found(h, SERVICES)
    calls = has(h, *CALLS, r'<(?:a|button)[^>]*class=["\'][^"\']*(?:btn|button|cta)["\'][^>]*>(?:kontakt|poptávka|nabídka|contact|quote)')
    form = has(h, "<form[^>]*(?:contact|kontakt|poptavka)") | (has(h, r'type=["\']email["\']|name=["\']email["\']') & has(h, "<textarea")) | has(h, link("kontakt", "contact"), ">kontakt<", ">contact<")
    r = lambda code, when, evidence=None: Rule("industry_webdesign", code, when, evidence)
    return [
        r("webdesign_no_portfolio", ~portfolio),
        r("webdesign_few_portfolio_items", portfolio & (items > 0) & (items < 5), said(items, "items")),
        r("webdesign_no_case_studies", ~has(h, r"case\s*stud|případov[áé]\s*studi|podrobn[ýá]\s*popis|jak\s*jsme", r'href=["\'][^"\']*(?:case[_-]?stud|pripadov)')),
        r("webdesign_no_services", (services < 2) & ~has(h, link("sluzby", "services", "nabidka"), ">služby<", ">services<"), said(services, "services")),
        r("webdesign_no_pricing", ~has(h, link("cen[iy]k", "pricing", "ceny"), ">ceník<", ">ceny<", ">pricing<", r"cena|price|od\s*\d|from\s*\d|kč|czk|€|\$")),
        r("webdesign_no_testimonials", ~has(h, *TESTIMONIALS, r'<(?:section|div)[^>]*(?:class|id)=["\'][^"\']*testimonial')),
        r("webdesign_no_team", ~has(h, r"náš\s*tým|our\s*team|o\s*nás|about\s*us|kdo\s*jsme|who\s*we\s*are", link("tym", "team", "o-nas", "about"), ">tým<")),
        r("webdesign_no_cta", ~calls),
        r("webdesign_no_contact_form", ~form),
        r("webdesign_no_blog", ~has(h, "blog|novinky|aktuality|news|články|articles", link("clanky"))),
        r("webdesign_no_social_proof", ~has(h, "klienti|clients|spolupracujeme|partneři|partners|loga", r"\d+\+?\s*(?:projekt|client|klient|let|years|rok|web|spokojených)", r"ocenění|award|certifik|partner\s*google|google\s*partner")),
    ]


def real_estate(p: dict[str, Column]) -> list[Rule]:
    """A16."""
    h = markup(p)
    r = lambda code, when: Rule("industry_real_estate", code, when)
    return [
        r("realestate_no_listings", ~has(h, "nabídka|nemovitost|byt|dům|house|apartment|property|listing|prodej|pronájem|rent|sale")),
        r("realestate_no_search_filters", ~has(h, "hledat|vyhled|search|filtr", "lokalita|location|město|city|okres|region", r"cena\s*(?:od|do)|price\s*(?:from|to)|rozpočet|budget")),
        r("realestate_no_contact_agent", ~has(h, r"makléř|realitní\s*agent|agent|realtor|broker", r"kontaktovat\s*makléře|contact\s*agent|napsat\s*makléři|sjednat\s*prohlídku", r"(?:\+420\s*)?(?:\d{3}\s*){3}")),
    ]


def automobile(p: dict[str, Column]) -> list[Rule]:
    """A17."""
    h = markup(p)
    r = lambda code, when: Rule("industry_automobile", code, when)
    return [
        r("automobile_no_inventory", ~has(h, r"vozidla|automobil|auto|car|vehicle|nabídka\s*voz|skladem|inventory")),
        r("automobile_no_financing", ~has(h, r"financování|financing|úvěr|credit|splátky|monthly\s*payment", r"leasing|operativní\s*leasing")),
        r("automobile_no_test_drive", ~has(h, r"testovací\s*jízda|zkušební\s*jízda|test\s*drive|vyzkoušet", r"objednat\s*(?:zkušební|testovací)|book\s*(?:a\s*)?test|rezervovat\s*jízdu")),
    ]


def restaurant(p: dict[str, Column]) -> list[Rule]:
    """A18."""
    h = markup(p)
    pdf = has(h, r'href=["\'][^"\']*\.pdf["\'].*menu|menu.*\.pdf|stáhnout\s*menu')
    written = has(h, r"\d+\s*(?:,-|Kč|kč|CZK)", flags="u") & has(h, r"polévka|soup|předkrm|starter|hlavní\s*jídlo|main|dezert|dessert")
    form = has(h, "<form[^>]*(?:rezervace|reservation|booking)") | (has(h, r'type=["\']date["\']|name=["\'](?:datum|date)["\']') & has(h, r'type=["\']time["\']|name=["\'](?:cas|time)["\']'))
    none = ~has(h, r"jídelní\s*lístek|menu|nabídka\s*jídel|speciály|denní\s*menu") & ~pdf & ~written
    r = lambda code, when: Rule("industry_restaurant", code, when)
    return [
        r("restaurant_no_menu", none),
        r("restaurant_menu_pdf_only", ~none & pdf & ~written),
        r("restaurant_no_reservation", ~has(h, r"rezervace|reservation|book\s*(?:a\s*)?table|objednat\s*stůl", r"restu|thefork|opentable|bookatable|online\s*rezervace") & ~form),
    ]


def medical(p: dict[str, Column]) -> list[Rule]:
    """A19."""
    h = markup(p)
    r = lambda code, when: Rule("industry_medical", code, when)
    return [
        r("medical_no_appointment", ~has(h, r"objednat\s*se|objednávka|termín|appointment|book\s*(?:an\s*)?appointment", r"online\s*objednání|online\s*rezervace|objednat\s*online", r"reservio|calendly|docplanner|urosvdba|objednejte|samobslužná\s*objednávka", "<form[^>]*(?:objedn|appointment|booking)")),
        r("medical_no_services", ~has(h, r"služby|nabídka|services|co\s*nabízíme|naše\s*služby") & (found(h, TREATMENTS) < 2)),
        r("medical_no_doctor_profiles", ~has(h, r"lékař|doktor|mudr|mvdr|doctor|physician|náš\s*tým", r"náši\s*lékaři|our\s*doctors|tým\s*lékařů|personál|naši\s*specialisté")),
    ]
