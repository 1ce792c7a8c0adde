"""Text columns: cleaning, entities, dates, prices, ids."""

from __future__ import annotations

import html as _html

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities of everyday pages; numeric ones follow a rule.
ENTITIES = ["&quot;", "&apos;", "&#39;", "&#039;", "&lt;", "&gt;", "&nbsp;", "&copy;", "&reg;", "&ndash;", "&mdash;", "&hellip;", "&commat;", "&#64;", "&period;", "&#46;"]
CZECH_DATE_FORMATS = ["d.M.yyyy", "d.M.yyyy H:mm", "d.M.yyyy H:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"]


def clean_control(text: Column) -> Column:
    """Without NUL and other control characters; tab, line feed and carriage return stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def decode_entities(text: Column) -> Column:
    """The common entities of HTML decoded; &amp; last."""
    for e in ENTITIES:
        text = F.replace(text, F.lit(e), F.lit(_html.unescape(e)))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags, entities decoded."""
    return decode_entities(strip_tags(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")))


def first_of(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def czech_date(text: Column) -> Column:
    """A timestamp (without zone) from the first of the date formats that fits; null if none does."""
    t = F.trim(text)
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in CZECH_DATE_FORMATS))


def price(text: Column) -> Column:
    """A positive number from a price like '1 234,50 Kč'; null otherwise (U11).  Of several points the first is the decimal one."""
    digits = F.replace(F.regexp_replace(text, r"[^0-9,.\-]", ""), F.lit(","), F.lit("."))
    value = F.regexp_extract(digits, r"^(-?\d*\.?\d*)", 1).try_cast("double")
    return F.when(value > 0, value)


def salary_range(text: Column) -> Column:
    """struct(low, high): the ends of a range, or one amount and null."""
    pattern = r"(\d[\d\s]*)\s*[-–]\s*(\d[\d\s]*)"
    ranged = text.rlike(pattern)
    low = F.when(ranged, price(F.regexp_extract(text, pattern, 1))).otherwise(price(text))
    return F.struct(low.alias("low"), F.when(ranged, price(F.regexp_extract(text, pattern, 2))).alias("high"))


def valid_company_id(ico: Column) -> Column:
    """Eight digits whose last is the check digit of the others: weights 8 to 2, modulo 11."""
    digit = lambda i: F.substring(ico, i + 1, 1).try_cast("int")
    rest = sum((digit(i) * (8 - i) for i in range(7)), F.lit(0)) % 11
    check = F.when(rest == 0, 1).when(rest == 1, 0).otherwise(11 - rest)
    return F.coalesce(ico.rlike(r"^\d{8}$") & (digit(7) == check), F.lit(False))
