"""Page rules: lists of ``Rule`` by category.  A user's own rules are more objects of this class."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """An issue ``code`` of a ``category`` that a page has where ``when`` is true, with ``evidence`` beside it."""

    category: str
    code: str
    when: Column
    evidence: Column | None = None


@dataclass(frozen=True)
class Markup:
    """A page's markup and the same in lower case, in which patterns that ignore case are looked for: that is several times faster
    than a pattern that ignores case."""

    html: Column
    low: Column
    #: Whether these are the columns html and low, so that tests on them can be written as one SQL text.
    plain: bool = False

    def lower(self) -> Markup:
        """The lower-cased markup alone: for values in which the case of letters doesn't matter."""
        return Markup(self.low, self.low)


Text = Column | Markup


def markup(p: dict[str, Column]) -> Markup:
    """The markup of a prepared page, its columns html and low."""
    return Markup(p["html"], p["low"], True)


def lowered(pattern: str) -> str:
    """A pattern for lower-cased text; classes like \\S stay."""
    return re.sub(r"\\[pP]\{\w+\}|\\.|[^\\]+", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)


def _prefix(flags: str) -> str:
    return f"(?{flags})" if flags else ""


def _where(text: Text, flags: str) -> tuple[Column, str, Callable[[str], str]]:
    """The column in which to look, with what prefix and for which pattern."""
    if isinstance(text, Markup):
        text, flags, change = (text.low, flags.replace("i", "").replace("u", ""), lowered) if "i" in flags else (text.html, flags, str)
    else:
        change = str
    return text, _prefix(flags), change


def _atom(p: str, i: int) -> tuple[str | None, int]:
    """The pattern's atom at i: the letter that it stands for, or None for a class, a group or a place; and where it ends."""
    if p[i] == "\\":
        return (None if p[i + 1].isalnum() else p[i + 1]), i + 2
    if p[i] == "[":
        j = i + 1 + (p[i + 1] == "^")
        j += p[j] == "]"  # in the first place it is a letter
        while p[j] != "]":
            j += 2 if p[j] == "\\" else 1
        return None, j + 1
    if p[i] == "(":
        depth, j = 1, i + 1
        while depth:
            depth += (p[j] == "(") - (p[j] == ")")
            j = _atom(p, j)[1] if p[j] in "\\[" else j + 1
        return None, j
    return (None if p[i] in ".^$" else p[i]), i + 1


@functools.cache
def alternatives(pattern: str) -> tuple[str, ...]:
    """The parts of a pattern between bars outside of groups."""
    out, begin, i = [], 0, 0
    while i < len(pattern):
        if pattern[i] == "|":
            out.append(pattern[begin:i])
            begin = i = i + 1
        else:
            i = _atom(pattern, i)[1]
    return (*out, pattern[begin:])


@functools.cache
def needs(pattern: str) -> tuple[tuple[str, ...], ...]:
    """What whatever matches a pattern (without bars outside of groups) has: of each of these lists one plain text, of three letters or
    more.  First come the texts outside of groups, the longest first, each by itself; then a list for each group that can't be left out,
    with one text for each alternative."""
    runs, run, groups, i = [], "", [], 0
    while i < len(pattern):
        begin = i
        letter, i = _atom(pattern, i)
        atom = pattern[begin:i]
        times = re.match(r"[?*+]|\{\d+(,\d*)?\}", pattern[i:])
        i += len(times[0]) if times else 0
        i += bool(times) and pattern[i : i + 1] in ("?", "+")  # lazy or possessive
        optional = bool(times) and times[0][0] in "?*{"
        if letter is not None and not optional:
            run += letter
        if letter is None or times:
            runs.append(run)
            run = ""
        if atom[0] == "(" and not optional and (inner := re.match(r"\((\?[a-z]*:)?(?!\?)", atom)):
            each = [needs(x) for x in alternatives(atom[inner.end() : -1])]
            single = [next((n[0] for n in found if len(n) == 1), None) for found in each]
            if None not in single and len(single) <= MOST_ALTERNATIVES:
                groups.append(tuple(dict.fromkeys(single)))
    texts = sorted(dict.fromkeys(r for r in (*runs, run) if len(r) >= 3), key=len, reverse=True)
    texts = texts[:1] + [r for i, r in enumerate(texts) if i and len(r) >= 4 and not any(r in longer for longer in texts[:i])]
    return (*((r,) for r in texts), *groups)


#: Alternatives of a group that are looked for beforehand.
MOST_ALTERNATIVES = 12


def needed(pattern: str) -> str | None:
    """The longest plain text, of three letters or more, that whatever matches the pattern has; None without one."""
    found = needs(pattern) if len(alternatives(pattern)) == 1 else ()
    return found[0][0] if found and len(found[0]) == 1 else None


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@functools.cache
def _sql(column: str, prefix: str, patterns: tuple[str, ...]) -> str:
    """The test of ``has`` on a column as SQL: one text, where a Column of each part would be many calls."""
    tests, rest = [], []
    for p in (a for p in patterns for a in alternatives(p)):
        if not (found := needs(p)):
            rest.append(p)
        elif found[0] == (p,) and column == "low":
            tests.append(f"contains(low, {_quoted(p)})")
        else:
            guards = [" OR ".join(f"contains({column}, {_quoted(w)})" for w in some) for some in found]
            tests.append("(" + " AND ".join([*(f"({g})" for g in guards), f"{column} RLIKE {_quoted(prefix + p)}"]) + ")")
    if rest:
        tests.append(f"{column} RLIKE {_quoted(prefix + '|'.join(f'(?:{p})' for p in rest))}")
    return " OR ".join(tests)


def _holds(guard: Column, found: tuple[tuple[str, ...], ...]) -> Column:
    return functools.reduce(Column.__and__, (functools.reduce(Column.__or__, (guard.contains(w) for w in some)) for some in found))


def has(text: Text, *patterns: str, flags: str = "iu") -> Column:
    """One of the patterns is found.  In lower-cased markup each pattern is tried only where the plain text is that it needs."""
    column, prefix, change = _where(text, flags)
    if not isinstance(text, Markup):
        return column.rlike(prefix + "|".join(f"(?:{p})" for p in patterns))
    if text.plain:
        return F.expr(_sql("low" if "i" in flags else "html", prefix, tuple(change(p) for p in patterns)))
    guard, tests, rest = text.low if "i" in flags else column, [], []
    for p in (a for p in patterns for a in alternatives(change(p))):
        if not (found := needs(p)):
            rest.append(p)
        else:
            tests.append(guard.contains(p) if found[0] == (p,) and guard is column else _holds(guard, found) & column.rlike(prefix + p))
    return functools.reduce(Column.__or__, tests + ([column.rlike(prefix + "|".join(f"(?:{p})" for p in rest))] if rest else []))


def found(text: Text, patterns: Iterable[str], flags: str = "iu") -> Column:
    """How many of the patterns are found."""
    return sum((has(text, p, flags=flags).cast("int") for p in patterns), F.lit(0))


def _guarded(text: Text, pattern: str, flags: str, value: Column, otherwise: Column | None) -> Column:
    """``value`` where the page has the plain texts that the pattern needs."""
    pattern = lowered(pattern)
    found = needs(pattern) if isinstance(text, Markup) and len(alternatives(pattern)) == 1 else ()
    if not found:
        return value
    here = F.when(_holds(text.low, found), value)
    return here if otherwise is None else here.otherwise(otherwise)


def count(text: Text, pattern: str, flags: str = "iu") -> Column:
    column, prefix, change = _where(text, flags)
    return _guarded(text, pattern, flags, F.regexp_count(column, F.lit(prefix + change(pattern))), F.lit(0))


def every(text: Text, pattern: str, group: int = 1, flags: str = "iu") -> Column:
    column = text.html if isinstance(text, Markup) else text
    return _guarded(text, pattern, flags, F.regexp_extract_all(column, F.lit(_prefix(flags) + pattern), F.lit(group)), F.array().cast("array<string>"))


def first(text: Text, pattern: str, group: int = 1, flags: str = "iu") -> Column:
    """The first match's group; null where it is missing or empty."""
    column = text.html if isinstance(text, Markup) else text
    return _guarded(text, pattern, flags, bound(F.regexp_extract(column, _prefix(flags) + pattern, group), lambda x: F.nullif(x, F.lit(""))), None)


def trimmed(texts: Column) -> Column:
    """An array's texts without blanks around them; F.trim alone would take the index for the characters to trim."""
    return F.transform(texts, lambda x: F.trim(x))


def said(number: Column, what: str) -> Column:
    return F.concat(number.cast("string"), F.lit(f" {what}"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]
