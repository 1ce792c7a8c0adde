import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegauge.llm import periodic_runs as P
from sitegauge.llm import queries as Q
from sitegauge.llm import simhash_dedup as S
from sitegauge.llm import spelling_variants as V
from sitegauge.llm.components import components as joined

SF = "/root/testdata/sf0.001"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# SimHash


def slow_fingerprint(text):
    w = words_of(low(text))
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, distance=3):
    """rows (id, fp): the smallest id reachable, by comparing all pairs of different fingerprints."""
    fps = sorted({f for _, f in rows})
    at = {f: i for i, f in enumerate(fps)}
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= distance).tolist():
            label[find(i)] = find(j)
    first = {}
    for id_, f in rows:
        if id_ is not None:
            if id_ in first:
                label[find(at[f])] = find(at[first[id_]])
            first.setdefault(id_, f)
    least = {}
    for id_, f in rows:
        if id_ is not None:
            r = find(at[f])
            least[r] = min(least.get(r, id_), id_)
    return [least.get(find(at[f])) for _, f in rows]


def test_simhash_rows(spark, odd, odd_rows, none, clashing):
    want = [(r[0], slow_fingerprint(r[1])) for r in odd_rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(want, components(want), strict=True)), key=str)
    for docs in (odd, clashing):
        got = S.near_duplicates(docs)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert S.near_duplicates(none).count() == 0
    assert S.near_duplicates(odd.where("doc_id is null")).where("component_id is not null").count() == 0


def clustered(rng, n, spread):
    """Fingerprints about a few centres, chains of single bits, and some at random."""
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(n // 4):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, spread)):
                f ^= 1 << b
            out.append(f)
    chain = rng.getrandbits(64)
    for b in rng.sample(range(64), 40):
        chain ^= 1 << b
        out.append(chain)
    return sorted({f - (f >> 63 << 64) for f in out})


def test_links_of_large_buckets(spark):
    """The same components whether buckets are held whole or split down to a few bits."""
    for seed, held, asked in ((1, 512, 4096), (2, 4, 8), (3, 1, 3)):
        fps = clustered(random.Random(seed), 400, 4 if seed % 2 else 9)
        edges = S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), held=held, asked=asked)
        got = dict(map(tuple, joined(edges).collect()))
        rows = [(i, f % 2**64) for i, f in enumerate(fps)]
        want = components(rows)
        assert [want[i] for i in range(len(fps))] == [fps.index(min(g for g in fps if got.get(g, g) == got.get(f, f))) for f in fps]
        for distance in (0, 2) if seed == 2 else ():
            edges = S.links(spark.createDataFrame([(f,) for f in fps[:150]], "fp long"), distance, held=held)
            got = dict(map(tuple, joined(edges).collect()))
            assert [got.get(f, f) for f in fps[:150]] == [fps[i] for i in components(rows[:150], distance)]


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, slow_fingerprint(r.text)) for r in docs]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op12_simhash_dedup(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(want, components(want), strict=True)}
    assert len({c for _, c in got.values()}) < len(got)


# Spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows, typos=31):
    counts = Counter()
    for id_, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{id_}:{w}".encode())
            if typos and id_ is not None and h % typos == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return slow_forms({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def slow_forms(n):
    others = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, vs in others.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = Q.op11_spelling_variants(spark, SF).select(*COLUMNS).collect()
    want = slow_variants([(r.doc_id, r.text) for r in docs])
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert any(r.form for r in got)


def test_spelling_rows(spark, odd, odd_rows, none, clashing):
    rows = [(r[0], r[1]) for r in odd_rows] + [(50, "Wörterbuch WÖRTERBUCH wörterbuch wörterbuchs wörterbuchs Ünïcödé×÷ünïcödé " * 9 + "wörtrbuch wörtrbuch " + "a" * 5000 + " " + "a" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = V.spelling_variants(docs, typos=2).select(*COLUMNS).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == slow_variants(rows, 2)
    assert V.spelling_variants(none).count() == 0
    assert V.spelling_variants(clashing).count() == V.spelling_variants(odd).count()


def test_words_that_share_chunks(spark):
    """Words of a small alphabet and of common beginnings and ends: keys are split again and again, and no near pair is lost."""
    rng = random.Random(11)
    for held in (2, 64):
        words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(150)}
        words |= {"international" + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(120)}
        words |= {"".join(rng.choice("xyz") for _ in range(3)) + "lichkeiten" for _ in range(30)}
        n = {w: rng.choice([2, 5, 30, 300, 4000]) for w in sorted(words)}
        got = V.variants(spark.createDataFrame(list(n.items()), "word string, n long"), held=held).select(*COLUMNS).collect()
        assert len(got) == len(n) and set(map(tuple, got)) == slow_forms(n)


# Periodic runs


def slow_runs(w):
    """All runs by trying every start and period."""
    out, n = set(), len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def check_runs(w):
    w = [x.encode() for x in w]
    got = P.runs_of(w)
    assert got == slow_runs(w)
    dropped = {k for a, n, q in got for k in range(a + q, a + n)}
    assert P.collapse(w, got) == [x for k, x in enumerate(w) if k not in dropped]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=14), st.integers(1, 12)), max_size=6), st.text("abc", max_size=9))
def test_runs_of_repeated_pieces(parts, tail):
    check_runs(list("".join(p * k for p, k in parts) + tail))


def test_runs_against_all_lags():
    rng = random.Random(5)
    for size in (2, 3, 6, 40):
        for _ in range(25):
            piece = [f"w{rng.randrange(size)}" for _ in range(rng.randint(1, 60))]
            text = [f"w{rng.randrange(size)}" for _ in range(rng.randint(0, 50))] + piece * rng.randint(2, 6) + piece[: rng.randrange(len(piece))] + [f"w{rng.randrange(size)}" for _ in range(20)]
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = "odd"
            check_runs(text)
    check_runs(["spam"] * 300 + ["ham"] + ["spam"] * 30)
    check_runs((["a", "b"] * 15 + ["c"]) * 4)
    assert P.runs_of([b"x"] * 60_000) == [(0, 60_000, 1)]
    period = [b"%d" % i for i in range(9_000)]
    assert P.runs_of(period * 3 + period[:5]) == [(0, 27_005, 9_000)]


def slow_digest(id_, text):
    w = words_of(text)
    n = len(w)
    if id_ is not None:
        h = zlib.crc32(str(id_).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = P.runs_of([x.encode() for x in w])
    if n < 1500:
        assert runs == slow_runs(w)
    gone = {k for a, m, q in runs for k in range(a + q, a + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    ends = sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    return (id_, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *ends)


def test_runs_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = Q.op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(slow_digest(r.doc_id, r.text) for r in docs)
    assert any(r[1] for r in rows)


def test_runs_rows(spark, odd, odd_rows, none, clashing):
    rows = [(r[0], r[1]) for r in odd_rows] + [(200 + i, "well then so it goes on é " * i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = P.digest(P.periodic_runs(docs.select("doc_id", P.planted(F.col("doc_id"), F.col("text")).alias("text"))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((slow_digest(*r) for r in rows), key=str)
    assert P.periodic_runs(none).count() == 0
    assert P.periodic_runs(clashing).count() == odd.count()
    full = {r.doc_id: r for r in P.periodic_runs(docs).collect()}
    assert full[1].collapsed == "" and full[1].n_words == 0 and full[239].collapsed == "well then so it goes on é"
