import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitegauge.llm import packing as P
from sitegauge.llm import token_counts as C


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_words_encode_like_whole_texts(encode):
    rng = random.Random(1)
    letters = "abcXYZéÉß中0129'’.,;:!?#$%&*<|>endoftext  ́ \n\t-_ǅʰ١²ª\u0130\u0131\u212a\u212b\u00a0\u0085\u200b\u200d\ufeffΣςﬁ가각ẞ\u0307i\u0307"
    known = P.encoder(P.TOKENIZER)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "", "<|endoftext|>", "a<|startoftext|>.b", "<|EndOfText|> É", "TBMMİ, İ İ;"])
        assert np.frombuffer(known.texts([text.encode()])[0], "<u4").tolist() == encode(text)[:-1].tolist(), text


def rejoined(rows, window):
    """Each sequence's ids in turn, gapless; and the pieces of each source row rejoined."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for k, pieces in by.items():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
            at += r.length
        assert at == window or k == max(by) and 0 < at <= window
    assert sorted(by) == list(range(len(by)))
    texts = Counter()
    starts = sorted((r for r in rows), key=lambda r: (str(r.doc_id), r.sequence_id, r.offset))
    for r in starts:
        texts[r.doc_id] += r.length
    return texts


@pytest.mark.parametrize("targets", [None, {"a": 3.0, "b": 1.0, "c": 0.5}])
def test_packs_everything_once(odd, odd_rows, encode, targets):
    rows = P.pack(odd, window=64, keep_ids=True, targets=targets).collect()
    got = rejoined(rows, 64)
    want = Counter()
    for r in odd_rows:
        want[r[0]] += len(encode(r[1]))
    assert got == want
    single = [r for r in odd_rows if r[0] is not None and sum(x[0] == r[0] for x in odd_rows) == 1]
    for doc in single:
        own = sorted((r for r in rows if r.doc_id == doc[0]), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == encode(doc[1]).tobytes()
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and {r.doc_tokens for r in own} == {len(encode(doc[1]))}


def test_windows_hold_the_corpus_proportions(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))), "en", "abbccc"[i % 6], 1) for i in range(300)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4), window=256).collect()
    total = Counter()
    for r in out:
        total[r.source] += r.length
    last = max(r.sequence_id for r in out)
    for k in range(last):
        own = Counter()
        for r in out:
            if r.sequence_id == k:
                own[r.source] += r.length
        assert all(abs(own[s] - 256 * n / sum(total.values())) < 2 for s, n in total.items())


@pytest.mark.parametrize("sources, window", [(100, 4096), (100, 64), (300, 512)])
def test_windows_hold_the_proportions_of_small_sources(spark, encode, sources, window):
    """No source has 1/64 of the tokens (or 4 ids a window); after every window each has had its part, but for a few ids of deficit."""
    rng = random.Random(sources)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(40, 100))), "en", f"s{i % sources}", 1) for i in range(4 * sources)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), window=window, keep_ids=True).collect()
    assert rejoined(out, window) == Counter({r[0]: len(encode(r[1])) for r in rows})
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for doc in rows:
        own = sorted(by[doc[0]], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == encode(doc[1]).tobytes()
        assert [(r.sequence_id, r.offset) for r in own] == sorted((r.sequence_id, r.offset) for r in own)
    total = Counter()
    for r in out:
        total[r.source] += r.length
    every, served, windows = sum(total.values()), Counter(), {}
    for r in out:
        windows.setdefault(r.sequence_id, Counter())[r.source] += r.length
    for k in range(max(windows)):
        served += windows[k]
        assert all(abs(served[s] - window * (k + 1) * n / every) < 8 for s, n in total.items())


def test_targets_hold_until_a_source_ends(spark):
    rows = [(i, "a b c d e f g h " * 4, "en", "xy"[i % 2], 1) for i in range(200)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), window=128, targets={"x": 3.0, "y": 1.0}).collect()
    first = sum(r.length for r in out if r.sequence_id == 3 and r.source == "x")
    assert abs(first - 96) <= 2


def test_target_0_comes_last_and_small_targets_hold(spark):
    rows = [(i, "a b c d e f g h " * 4, "en", ["x", "y", f"s{i % 40}"][i % 3], 1) for i in range(1200)]
    targets = {"x": 1.0, "y": 0.0} | {f"s{i}": 0.01 for i in range(20)}
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), window=128, targets=targets).collect()
    size = Counter()
    for r in out:
        size[r.source] += r.length
    x_ends = max(r.sequence_id * 128 + r.offset + r.length for r in out if r.source == "x")
    assert min(r.sequence_id * 128 + r.offset for r in out if r.source == "y" or r.source[0] == "s" and r.source not in targets) >= max(r.sequence_id * 128 + r.offset + r.length for r in out if targets.get(r.source))
    for s in ("s3", "s7"):
        got = sum(r.length for r in out if r.source == s and r.sequence_id * 128 < x_ends - 128)
        assert abs(got - min(size[s], 0.01 * size["x"])) <= 3
    assert sorted(r.sequence_id * 128 + r.offset for r in out)[-1] < sum(size.values()) == 1200 * 33


def test_pieces_tile_every_queue():
    rng = random.Random(2)
    for _ in range(200):
        every = [rng.choice([0, 1, rng.randrange(1, 400), rng.randrange(1, 4000)]) for _ in range(rng.randint(1, 6))]
        lengths = [*every, 0]
        plan = P.phases(lengths, None if rng.random() < 0.5 else [rng.choice([0.0, 1e-6, rng.random()]) for _ in lengths])
        taken = []
        for q, n in enumerate(lengths):
            at = 0
            while at < n:
                size = min(rng.randint(1, 50), n - at)
                parts = list(P.pieces(P.turns(q, plan), [], at, size, 32))
                assert sum(p[1] for p in parts) == size and [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist()
                taken += [x + i for _, length, x in parts for i in range(length)]
                assert all(x // 32 == (x + length - 1) // 32 for _, length, x in parts)
                at += size
        assert sorted(taken) == list(range(sum(lengths)))


def test_empty_and_clashing(none, odd, clashing):
    assert P.pack(none).count() == 0 and C.length_histogram(none).count() == 0
    assert [tuple(r) for r in C.at_limits(C.length_histogram(none), [5]).collect()] == [(5, 0, 0, 0, 0, 0)]
    assert sorted(r.length for r in P.pack(clashing).collect()) == sorted(r.length for r in P.pack(odd).collect())


def test_histogram(odd, odd_rows):
    encode = C.encoder(C.TOKENIZER).encode_ordinary
    sizes = [len(encode(r[1])) if r[1] else 0 for r in odd_rows]
    rows = C.length_histogram(odd).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(sizes)
    limits = [0, 1, 7, 100, 1023, 1024, 5000, 10**6]
    for r in C.at_limits(C.length_histogram(odd), limits).collect():
        n = r.context_limit
        assert (r.docs_over, r.tokens_over, r.docs_total, r.tokens_total) == (sum(s > n for s in sizes), sum(s for s in sizes if s > n), len(sizes), sum(sizes))
        assert r.truncated_total == sum(min(s, n) for s in sizes) and limits.remove(n) is None
    assert not limits
    for r in rows:
        n = r.n_tokens
        assert (r.docs_from, r.tokens_from) == (sum(s >= n for s in sizes), sum(s for s in sizes if s >= n))
        assert r.truncated_total == sum(min(s, n) for s in sizes) and r.quantile == sum(s <= n for s in sizes) / len(sizes)
        assert (r.docs_total, r.tokens_total) == (len(sizes), sum(sizes))
