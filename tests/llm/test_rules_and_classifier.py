import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.llm import host_rules as H
from sitegauge.llm import importance as I
from sitegauge.llm.common import WordHashes


def measured(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def verdicts(rows):
    found = [(r[0], r[3], *measured(r[1]), len([x for x in (r[1] or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)])) for r in rows]
    flags = [(n < 10 or 100 * rep > 20 * n, 10 * sym > n, 10 * dup > 3 * lines) for _, _, n, _, sym, dup, rep, lines in found]
    hosts = defaultdict(list)
    for f, marks in zip(found, flags, strict=True):
        hosts[f[1]].append(marks)
    total, rates = len(found), {}
    for k in range(3):
        m = sum(f[k] for f in flags) / total
        v = sum(len(x) * (sum(y[k] for y in x) / len(x) - m) ** 2 for x in hosts.values())
        room = total - (len(hosts) - 1) - sum(len(x) ** 2 for x in hosts.values()) / total
        share = (v / (m * (1 - m)) - (len(hosts) - 1)) / room if 0 < m < 1 and room > 0 else 0
        w = min(max(1 / share - 1, 1.0), 1e6) if share > 0 else 1e6
        rates |= {(h, k): (sum(y[k] for y in x) + w * m) / (len(x) + w) for h, x in hosts.items()}
    limits = [0.5, 0.25, 0.25]
    for f, marks in zip(found, flags, strict=True):
        bad = marks[0] or rates[f[1], 0] > limits[0] or any(marks[k] and rates[f[1], k] > limits[k] for k in (1, 2))
        yield (f[0], *f[2:7], marks[0], not bad)


def texts(rng, n):
    out = []
    for i in range(n):
        w = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(rng.randint(3, 60)))
        kind = rng.random()
        w = w + "\n" + w if kind < 0.1 else w.replace(" ", " # ") if kind < 0.2 else "x y\nx y\nx y\n" + w if kind < 0.3 else w
        out.append((i, w, None, rng.choice(["good", "bad", None]), None))
    return out + [(n + i, "too short", None, "bad", None) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_against_brute_force(spark, odd_rows, seed):
    rows = odd_rows + texts(random.Random(seed), 80)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = H.apply_host_rules(df).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got), key=key)
    want = sorted(verdicts(rows), key=key)
    assert have == want
    kept = H.keep_by_host_rules(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[-1])


def test_hosts_decide(spark):
    """Documents that pass the base rule go with their host: all of a host that fails it often, and marked ones where marks abound."""
    fresh = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, "too short" if i % 10 < 7 else fresh(i, 30), None, "junk", None) for i in range(100)]
    rows += [(100 + i, fresh(i, 30) + (" # # # #" if i % 10 < 6 else ""), None, "symbols", None) for i in range(100)]
    rows += [(200 + i, fresh(i, 30) + (" # # # #" if i == 0 else ""), None, "good", None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r for r in H.apply_host_rules(df).collect()}
    assert {i: r.kept for i, r in got.items()} == {w[0]: w[-1] for w in verdicts(rows)}
    assert not any(got[i].kept for i in range(100)) and sum(not got[i].base_failed for i in range(100)) == 30
    assert [got[i].kept for i in range(100, 200)] == [i % 10 >= 6 for i in range(100, 200)] and all(got[i].kept for i in range(200, 300))
    assert sorted(r.doc_id for r in H.keep_by_host_rules(df).collect()) == sorted(i for i, r in got.items() if r.kept)
    duckdb.register("documents", df.toPandas())
    try:
        found = duckdb.sql(H.rules_sql())
        sql = {r[0]: dict(zip(found.columns, r, strict=True)) for r in found.fetchall()}
    finally:
        duckdb.unregister("documents")
    for i, r in got.items():
        assert (r.kept, r.base_failed, r.n_words, r.host_documents) == tuple(sql[i][k] for k in ("kept", "base_failed", "n_words", "host_documents"))
        assert all(abs(r[f"{x}_rate"] - sql[i][f"{x}_rate"]) < 1e-8 for x in H.RULES)


def test_prior_leaves_out_what_drawing_spreads(spark):
    """Hosts of one document each say nothing about hosts: the rate of all holds for each, and nothing goes."""
    fresh = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    rows = [(i, fresh(i) + (" # # #" if i % 5 == 0 else ""), None, f"host{i}", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = H.apply_host_rules(df).agg(F.count_if("kept").alias("kept"), F.max("many_symbols_rate").alias("rate"), F.sum(F.expr("int(10 * n_symbols > n_words)")).alias("marked")).head()
    assert (got.kept, got.marked) == (3000, 600) and abs(got.rate - 0.2) < 1e-3


def test_prior_finds_the_planted_beta(spark):
    rng = np.random.default_rng(8)
    a, b, rows = 2.0, 6.0, []
    for h, p in enumerate(rng.beta(a, b, 4000)):
        n = int(rng.integers(1, 60))
        rows.append((f"h{h}", n, int(rng.binomial(n, p))))
    hosts = spark.createDataFrame(rows, "host string, n int, f int")
    marked = hosts.select("host", F.explode(F.sequence(F.lit(1), "n")).alias("i"), "f").select("host", (F.col("i") <= F.col("f")).alias("mark"))
    got = {r.host: r.mark_rate for r in H.host_rates(marked, "host", {"mark": ("", 0.5)}).collect()}
    m = sum(f for _, _, f in rows) / sum(n for _, n, _ in rows)
    # rate = (f + w m) / (n + w), hence w
    weights = [(f - got[h] * n) / (got[h] - m) for h, n, f in rows if abs(got[h] - m) > 0.05]
    assert max(weights) - min(weights) < 1e-6
    assert abs(weights[0] * m / a - 1) < 0.1 and abs(weights[0] * (1 - m) / b - 1) < 0.1


def test_rules_on_empty_and_clashing(none, odd, clashing):
    assert H.apply_host_rules(none).count() == 0 and H.keep_by_host_rules(none).count() == 0
    assert H.apply_host_rules(clashing).where("kept").count() == H.apply_host_rules(odd).where("kept").count()
    assert H.keep_by_host_rules(clashing).columns == clashing.columns


def corpus(n=400):
    rng = random.Random(4)
    good, bad = ["red", "blue", "green", "tree", "house", "river"], ["win", "cash", "$$$", "click", "!!", "now"]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(rng.randint(4, 40))), "en", "a", 1) for i in range(n)]
    return rows, [(i, int(i % 5 > 0), 0) for i in range(0, n, 3)]


@pytest.mark.parametrize("errors", [0.0, 2.0])
def test_resampling_against_numpy(spark, errors):
    rows, labels = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in I.resample(df, table, errors=errors).collect()}
    known, counts = WordHashes(), np.zeros((2, I.BUCKETS))
    good = {i for i, q, _ in labels if q}
    lists = {r[0]: I.buckets(r[1].encode(), known) for r in rows}
    for i, b in lists.items():
        np.add.at(counts[0], b, 1)
        if i in good:
            np.add.at(counts[1], b, 1)
    p = (counts + I.PRIOR) / (counts + I.PRIOR).sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])
    drawn = {i: ratio[b].sum() + I.gumbel(i, 11) for i, b in lists.items()}
    share = len(good) / len(labels)
    k = round(min(1, share + errors * (share * (1 - share) / len(labels)) ** 0.5) * len(rows))
    want = set(sorted(drawn, key=drawn.get)[-k:])
    assert {i for i, r in got.items() if r.kept} == want
    assert all(abs(got[i].score - ratio[b].sum()) < 1e-6 for i, b in lists.items())
    clean = [i for i in lists if i % 5]
    kept_clean = sum(got[i].kept for i in clean)  # without spare places the noise lets a few others in
    assert kept_clean == len(clean) if errors else kept_clean >= 0.98 * min(k, len(clean))
    kept = I.keep_resampled(df, table, errors=errors)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want


def test_rows_without_id_draw_by_text(spark):
    rows = [(None, f"red tree number {i} by the river", "en", "a", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = I.resample(df, spark.createDataFrame([], "doc_id long, quality int"), share=0.5).where("kept").count()
    assert kept == 100


def test_resampling_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (None, 1, 0), (6, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    out = I.resample(odd, labels).collect()
    assert len(out) == odd.count() and all(r.score == I.NO_SCORE for r in out if r.doc_id in (1, 2, 3))
    assert I.resample(none, labels).count() == 0 and I.keep_resampled(none, labels).count() == 0
    assert {r.score for r in I.resample(odd, labels.limit(0)).collect()} == {0.0, I.NO_SCORE}
    assert I.keep_resampled(clashing, labels).columns == clashing.columns


def test_kth_largest(spark):
    rng = random.Random(8)
    values = [rng.choice([rng.randrange(-(2**63), 2**63), rng.randrange(-5, 5)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "draw long")
    for k in (1, 2, 17, 250, 500):
        assert I.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_long_bad_text_is_before_an_empty_one():
    """Scores are sums, so a text of very many bad words scores very little, but more than one without words."""
    score, draw = I._scores([b"bad word " * 300_000, b"", b"\n", b"bad"], [1, 2, 3, 4], np.full(I.BUCKETS, -8.0), WordHashes(), 11)
    assert score[0] < -4e6 and score[1] == score[2] == I.NO_SCORE and draw[3] > draw[0] > max(draw[1], draw[2]) and draw[1] != draw[2]
