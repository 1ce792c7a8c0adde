"""Many terms looked for in one pass over a text.

The terms become one automaton, which a task builds once from a broadcast list; its cost hardly depends on how many there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Terms and letters of one automaton, at most (about 100 MB in a task); who has more looks them up by another key.
MOST_TERMS, MOST_LETTERS = 100_000, 1_500_000
#: The automaton that this worker has used last, by its finder's name.
_built: dict[str, ahocorasick.Automaton] = {}


def fits(terms: Sequence[str]) -> bool:
    return len(terms) <= MOST_TERMS and sum(map(len, terms)) <= MOST_LETTERS


def _places(texts: pd.Series, name: str, terms: Sequence[str]) -> list[list[int]]:
    """Places in ``terms`` of those that stand in each text, ascending."""
    if name not in _built:
        _built.clear()
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(term, i)
        automaton.make_automaton()
        _built[name] = automaton
    find = _built[name].iter
    return [sorted({i for _, i in find(t)}) if t else [] for t in texts]


def finder(spark: SparkSession, terms: Sequence[str]) -> Callable[[Column], Column]:
    """A function of a text column: the array of those ``terms`` that stand in the text, in their order; null texts have none.
    Terms are distinct and not empty; case counts."""
    if not fits(terms):
        raise ValueError(f"{len(terms)} terms are too many for one automaton")
    if not terms:
        return lambda text: F.array().cast("array<string>")
    shared, name = spark.sparkContext.broadcast(list(terms)), uuid.uuid4().hex  # MOST_LETTERS at most

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([[known[i] for i in some] for some in _places(texts, name, known)])

    return found


def namer(spark: SparkSession, lists: dict[str, dict[str, str]]) -> Callable[[Column], Column]:
    """A function of a text column: a struct with an array for each list (term -> name) of the names whose terms stand in the text, each
    once, in the list's order.  All lists take one pass."""
    terms = list(dict.fromkeys(t for named in lists.values() for t in named))
    if not fits(terms):
        raise ValueError(f"{len(terms)} terms are too many for one automaton")
    at = {t: i for i, t in enumerate(terms)}
    names = {column: {at[t]: (k, n) for k, (t, n) in enumerate(named.items())} for column, named in lists.items()}
    shared, name = spark.sparkContext.broadcast((terms, names)), uuid.uuid4().hex  # MOST_LETTERS, and a name each

    @F.pandas_udf(", ".join(f"`{column}` array<string>" for column in lists))
    def named(texts: pd.Series) -> pd.DataFrame:
        terms, names = shared.value
        places = _places(texts, name, terms)
        return pd.DataFrame({c: [list(dict.fromkeys(n for _, n in sorted(own[i] for i in some if i in own))) for some in places] for c, own in names.items()})

    return named
