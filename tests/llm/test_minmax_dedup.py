import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegauge.llm import minmax_dedup as M
from sitegauge.llm.common import WordHashes, shingles
from sitegauge.llm.components import components


def sets_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=80):
    """Component of each row by comparing all pairs; rows of one id are one document, an empty row stands alone."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, sets_of(t)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and (i == j or 100 * len(s & t) >= percent * len(s | t)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i) if i is not None and s else i) for i, s in sets]


def check(spark, rows, **options):
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, **options), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    return got


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_odd_rows(spark, odd_rows):
    check(spark, [(r[0], r[1]) for r in odd_rows])


def test_clusters_about_a_base(spark):
    """Copies that are linked with their base and hardly with each other, chains, and a passage that many share."""
    rng = random.Random(7)
    rows, n = [], 1000
    for size in (40, 12, 3):
        base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(n - i, edited(rng, base, rng.choice([1, 2, 2, 3]))) for i in range(size)] + [(n - size, " ".join(base))]
        n += 1000
    chain = [f"c{rng.randrange(10**6)}" for _ in range(300)]
    for i in range(12):
        rows.append((n + i, " ".join(chain)))
        chain = chain[8:] + [f"c{rng.randrange(10**6)}" for _ in range(8)]
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    rows += [(n + 100 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(4, 60)))) for i in range(60)]
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows, percent=85)


def test_other_similarity(spark):
    rng = random.Random(9)
    base = [f"b{rng.randrange(10**6)}" for _ in range(100)]
    check(spark, [(i, edited(rng, base, i % 3)) for i in range(20)], percent=80)


def test_blocks_split_and_agree(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    test_clusters_about_a_base(spark)


def test_repeated_ids_with_several_texts(spark):
    a, b = " ".join("abcdefghij"), " ".join("klmnopqrst")
    check(spark, [(5, a), (5, b), (2, b), (9, a), (7, ""), (7, a)])


def test_empty_and_clashing(none, clashing, odd):
    assert M.near_duplicates(none).count() == 0
    assert sorted(map(str, M.near_duplicates(clashing).collect())) == sorted(map(str, M.near_duplicates(odd).collect()))


def test_banding_estimates_similarity():
    """The part of equal minima and maxima follows the similarity, so a band's agreement follows its power."""
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.unique(pool[:270]), np.unique(pool[30:])
    keys = M.band_keys([a, b], bands=400, permutations=1)
    assert abs((keys[0] == keys[1]).mean() - (240 / 300) ** 2) < 0.08


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "Ž", "\n", " ", "c d"]), max_size=14))
def test_shingle_counts(parts):
    text = " ".join(parts)
    assert len(shingles(text.encode(), WordHashes())) == len(sets_of(text))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    seen = defaultdict(set)
    for a, b in edges:
        if a != b:
            seen[a].add(b)
            seen[b].add(a)
    for node in seen:
        reach, todo = {node}, [node]
        while todo:
            todo += [x for x in seen[todo.pop()] if x not in reach and not reach.add(x)]
        assert got[node] == min(reach)
    assert got.keys() == seen.keys()
