import os
import shutil
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from sitegauge.llm import importance
from sitegauge.llm.common import shared_dir
from sitegauge.llm.host_rules import apply_host_rules

from .test_minmax_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages_decide_as_their_operators(spark, tmp_path):
    """Each stage against the operator's own verdicts on the stage's input, or brute force; run() gives what the stages give."""
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name == "quality_rules":
            want = {r.doc_id for r in apply_host_rules(docs).where("kept").collect()}
        elif name == "quality_classifier":
            want = {r.doc_id for r in importance.resample(docs, spark.read.parquet(f"{SF}/labels.parquet"), errors=C.ERRORS).where("kept").collect()}
        elif name == "near_dedup":
            want = {i for i, _, c in brute([(r.doc_id, r.text) for r in rows], percent=80) if i == c}
        if name in ("quality_rules", "quality_classifier", "near_dedup"):
            assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == want and after.count() == len(want) < len(rows)
            assert sorted(map(str, after.collect())) == sorted(str(r) for r in rows if r.doc_id in want)
        if name == "source_mixing":
            assert after.columns == docs.columns and {r.doc_id for r in after.collect()} <= {r.doc_id for r in rows}
        if name == "packing":
            tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
            size = Counter()
            for r in rows:
                size[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
            got = Counter()
            for r in after.collect():
                got[r.doc_id] += r.length
            assert got == size
        docs = after
        kept.append(docs.count())
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    ran = C.run(spark, SF)
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert len(left) == 1 and os.listdir(f"{shared_dir(spark).removeprefix('file:')}/{left.pop()}") == ["packing"]  # the result alone
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in ran.collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.collect()) or ran.count() == docs.count()
    shutil.rmtree(tmp_path)


def test_stages_on_odd_rows(spark, odd, none, clashing, tmp_path):
    for given in (odd, none, clashing):
        docs = given
        for k, (_, stage) in enumerate(C.STAGES):
            path = str(tmp_path / f"{id(given)}-{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert k == len(C.STAGES) - 1 or docs.columns == given.columns
        assert (docs.count() > 0) == (given is not none)


def test_near_dedup_keeps_every_text_of_an_id(spark):
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    rows = [(1, text("a"), "en", "s", 1), (1, text("b"), "en", "s", 1), (1, text("b"), None, "s", 1), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, text("a"), "en", "s", 1), (3, text("c"), "en", "s", 1), (3, text("c"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = dict(C.STAGES)["near_dedup"](spark, docs, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[2], rows[3], rows[4], rows[6]], key=str)


def test_near_dedup_links_from_080(spark):
    """Two copies of 0.82 and 0.80 of a base go, one of 0.79 stays; brute force at 80 says the same."""
    base = [f"b{i}" for i in range(204)]  # 200 shingles
    part = lambda n, tag: " ".join(base[: n + 4] + [f"{tag}{i}" for i in range(200 - n)])  # noqa: E731  n of 200 shingles in common
    texts = [" ".join(base), part(181, "x"), part(178, "y"), part(176, "z")]
    rows = [(i + 1, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    want = sorted(i for i, _, c in brute([r[:2] for r in rows], percent=80) if i == c)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in dict(C.STAGES)["near_dedup"](spark, docs, SF).collect()) == want == [1, 4]


def test_near_dedup_against_brute_force_at_80(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(i for i, _, c in brute([(r.doc_id, r.text) for r in docs.collect()], percent=80) if i == c)
    assert sorted(r.doc_id for r in dict(C.STAGES)["near_dedup"](spark, docs, SF).collect()) == want
