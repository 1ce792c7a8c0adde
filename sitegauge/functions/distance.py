"""Edit distance against a bound, for long texts."""

from __future__ import annotations

import bisect
import itertools
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of fewer characters, both, are compared by the built-in function.
SHORT = 512


def within(a: str, b: str, bound: int) -> bool:
    """Whether the edit distance of two texts is ``bound`` at most.

    Common ends are cut off; then the length left, and the places that two alignments leave apart, bound it from above, the difference
    in length and in letters from below.  What these leave open is computed with a column of the table as the bits of a whole
    number, within the band that the bound allows, and ends as soon as no way under the bound is left.
    """
    if bound < 0:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > bound:
        return False
    if a == b or len(b) <= bound:
        return True
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    a, b = a[k:], b[k:]
    k = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), len(a))
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(b) <= bound:
        return True
    letters = Counter(b)
    letters.subtract(a)
    if max(sum(n for n in letters.values() if n > 0), -sum(n for n in letters.values() if n < 0)) > bound:
        return False
    if _in_place(a, b) <= bound or _by_anchors(a, b) <= bound:
        return True
    return _banded(a, b, bound)


def _codes(a: str) -> np.ndarray:
    return np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)


def _in_place(a: str, b: str) -> int:
    """A bound from above: characters that differ at their place."""
    return int(np.count_nonzero(_codes(a) != _codes(b)[: len(a)])) + len(b) - len(a)


def _by_anchors(a: str, b: str, size: int = 12) -> int:
    """A bound from above: stretches of ``size`` characters that either text has once are held in place, as far as they stand in one
    order; what lies between them is replaced."""
    if len(a) < size:
        return len(b)
    places: dict[str, int] = {}
    for i in range(len(a) - size + 1):
        g = a[i : i + size]
        places[g] = -1 if g in places else i
    met: dict[str, int] = {}
    for j in range(len(b) - size + 1):
        g = b[j : j + size]
        if places.get(g, -1) >= 0:
            met[g] = -1 if g in met else j
    pairs = sorted((j, places[g]) for g, j in met.items() if j >= 0)
    # the longest chain that ascends in both
    tails: list[int] = []
    ends: list[int] = []
    last = [-1] * len(pairs)
    for x, (_, i) in enumerate(pairs):
        k = bisect.bisect_left(tails, i)
        last[x] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [i], [x]
    chain, x = [], ends[-1] if ends else -1
    while x >= 0:
        chain.append(pairs[x])
        x = last[x]
    cost, i, j = 0, 0, 0  # up to here both are aligned
    for q, p in reversed(chain):
        if p - i == q - j < 0:  # goes on from the anchor before
            i, j = p + size, q + size
        elif p >= i and q >= j:
            cost += max(p - i, q - j)
            i, j = p + size, q + size
    return cost + max(len(a) - i, len(b) - j)


def _banded(a: str, b: str, bound: int) -> bool:
    """Whether the distance is ``bound`` at most, for 0 < len(b) - len(a) or equal lengths; ``a`` runs down, ``b`` across.

    Bit i of a column stands for the row ``top + i``: ``up`` says that the entry is one more than the one above, ``down`` that it is one
    less.  The band holds the rows from which the corner can be met under the bound, and moves down by a row in each column.
    """
    m, n = len(a), len(b)
    slack = (bound - (n - m)) // 2
    above, below = n - m + slack, slack  # rows of the band about the diagonal
    height = min(above + below + 1, m)
    rows: dict[str, int] = {}
    for c, places in itertools.groupby(sorted(range(m), key=a.__getitem__), key=a.__getitem__):
        bits = bytearray(m // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        rows[c] = int.from_bytes(bits, "little")
    top, mask = 0, (1 << height) - 1
    up, down = mask, 0
    # the value of the lowest row in the band, followed along the columns
    low, value = height, height
    for j, c in enumerate(b):
        if j % 512 == 511:
            # the band's entries from its lowest row upwards; the way from any of them to the corner costs the difference at least
            bits = [np.unpackbits(np.frombuffer(x.to_bytes(height // 8 + 1, "little"), np.uint8), bitorder="little")[:height].astype(np.int64) for x in (up, down)]
            entries = value - np.concatenate(([0], np.cumsum((bits[0] - bits[1])[::-1])))
            rest = np.abs((m - low + np.arange(height + 1)) - (n - j))
            if (entries + rest).min() > bound:
                return False
        match = rows.get(c, 0) >> top & mask
        d = ((match & up) + up ^ up) | match | down
        right, left = down | ~(d | up) & mask, up & d
        value += (right >> height - 1 & 1) - (left >> height - 1 & 1)
        right, left = (right << 1 | 1) & mask, left << 1 & mask
        up, down = left | ~(d | right) & mask, right & d
        if j + 1 > above and top + height < m:  # the band goes down a row: the new one is one more than the one above at most
            top += 1
            up, down = up >> 1 | 1 << height - 1, down >> 1
            value += 1
            low += 1
        if low == m and value - (n - 1 - j) > bound:
            return False
    return value <= bound


def _grade(before: pd.Series, after: pd.Series, percents: list[int]) -> pd.Series:
    def one(a: str | None, b: str | None) -> int | None:
        if a is None or b is None:
            return None
        longest = max(len(a), len(b), 1)
        # distance * 100 / longest >= percent
        return sum(not within(a, b, (p * longest + 99) // 100 - 1) for p in percents)

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)], dtype="Int32")


def distance_grade(before: Column, after: Column, percents: list[int]) -> Column:
    """How many of the ascending ``percents`` of the longer length the edit distance in characters reaches; null if a text is null."""
    short = (F.length(before) < SHORT) & (F.length(after) < SHORT)
    percent = F.levenshtein(before, after) * 100 / F.greatest(F.length(before), F.length(after), F.lit(1))
    exact = sum((F.when(percent >= p, 1).otherwise(0) for p in percents[1:]), F.when(percent >= percents[0], 1).otherwise(0))

    @F.pandas_udf("int")
    def graded(a: pd.Series, b: pd.Series) -> pd.Series:
        return _grade(a, b, percents)

    long = graded(F.when(~short, before), F.when(~short, after))  # the pairs that are short aren't passed
    return F.when(before.isNull() | after.isNull(), None).when(short, exact).otherwise(long)
