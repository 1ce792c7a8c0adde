"""Language identification in two steps: the family first, then linear support vector machines, one against one, in the family.

Features are counts of hashed byte n-grams of whole lower-cased texts, as square roots of relative frequencies.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, small_batches, utf8

#: Families by language code; a language that isn't named is a family by itself.
FAMILIES = {
    "de": "germanic", "en": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "cs": "slavic", "sk": "slavic", "pl": "slavic", "ru": "slavic", "uk": "slavic", "hr": "slavic",
}
#: Hashed features as a power of two; labelled rows that the machines are fitted on, of each language and of all, at most (so
#: the driver holds 64 MB of features); passes over them; languages that are learned, at most (so there are 2,016 machines, 66 MB).
BITS, ROWS, ALL_ROWS, PASSES, LANGS = 13, 500, 4000, 12, 64
DIMS = 1 << BITS
UNKNOWN = "und"


def features(text: bytes | None) -> np.ndarray:
    """Hashed 1- to 3-gram counts of the text's bytes (lower-cased; blanks as one), as unit vector of square roots."""
    b = np.frombuffer(b" " + b" ".join((text or b"").lower().split()) + b" ", np.uint8).astype(np.uint32)
    grams = [b[1:-1]] + [(b[:-1] << 8 | b[1:]) + np.uint32(1 << 24)] + ([(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) + np.uint32(1 << 25)] if len(b) > 2 else [])
    h = np.concatenate(grams) * np.uint32(0x9E3779B1)
    counts = np.bincount((h >> np.uint32(32 - BITS)).astype(np.int64), minlength=DIMS)
    out = np.sqrt(counts, dtype=np.float32)
    return out / max(float(np.sqrt(counts.sum())), 1.0)


def machine(x: np.ndarray, y: np.ndarray, passes: int = PASSES, c: float = 10.0, seed: int = 5) -> np.ndarray:
    """Weights of a linear support vector machine for y of -1 and 1 (the last one is the bias), by dual coordinate descent."""
    w, bias, alpha, norm = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(x)), np.einsum("ij,ij->i", x, x) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (float(x[i] @ w) + bias) - 1) / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * x[i]
                bias += step
                alpha[i] = new
    return np.append(w, np.float32(bias))


class Model:
    """Machines between families, one against one, and between the languages of each family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str]):
        family = np.array([families.get(v, v) for v in langs])
        lang = np.array(langs)
        self.levels = {"": sorted(set(family))} | {f: sorted(set(lang[family == f])) for f in set(family)}
        self.names, weights = [], []
        for level, names in self.levels.items():
            of = family if level == "" else lang
            for a, b in itertools.combinations(names, 2):
                rows = ((of == a) | (of == b)) & ((family == level) | (level == ""))
                self.names.append((level, a, b))
                weights.append(machine(x[rows].astype(np.float32), np.where(of[rows] == a, 1.0, -1.0)))
        self.weights = np.array(weights, np.float32).reshape(-1, DIMS + 1)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """The language, and the mean over both steps of the winner's margins as logistic numbers."""
        if not self.levels[""]:
            return UNKNOWN, 0.0
        margins = dict(zip(self.names, (self.weights[:, :-1] @ features(text) + self.weights[:, -1]).tolist(), strict=True))
        level, score = "", 1.0
        while True:
            names = self.levels[level]
            total = dict.fromkeys(names, 0.0)
            for a, b in itertools.combinations(names, 2):
                m = 1 / (1 + np.exp(-4 * margins[level, a, b]))
                total[a] += m
                total[b] += 1 - m
            best = max(names, key=lambda v: (total[v], v))
            score *= total[best] / (len(names) - 1) if len(names) > 1 else 1.0
            if level:
                return best, float(min(max(score, 0.0), 1.0))
            level = best


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, rest: int = 2, rows: int = ROWS, langs: int = LANGS) -> DataFrame:
    """The rows (lang, h, text) to learn from: of the ``langs`` languages with most labelled rows (ties: the smaller name), ``rows`` each
    at most, and ALL_ROWS in all, or one of each.  Rows are chosen by a hash h of id and text, the smallest first; rows that agree in
    language, id and text are one, so neither missing nor repeated ids make more of them.
    """
    seen = docs.where(~held_out(F.col(id_col), mod, rest) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    seen = seen.select(F.col(lang_col).alias("lang"), F.expr("xxhash64({}, {}) & (shiftleft(1L, 62) - 1)".format(*(f"`{c}`" for c in (id_col, text_col)))).alias("h"), F.col(text_col).alias("text"))
    known = seen.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("d")).orderBy(F.desc("n"), "lang").limit(langs).collect()
    quota = max(1, min(rows, ALL_ROWS // max(1, len(known))))
    # the hashes below a limit are twice as many as wanted, or all; those are ranked
    limits = [(r.lang, int(min(1.0, (2 * quota + 64) / max(1, r.d)) * 2**62)) for r in known]
    limits = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, most long"))
    some = seen.join(limits, "lang").where("h < most").groupBy("lang", "h").agg(F.min("text").alias("text"))
    return some.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("_n") <= quota).drop("_n")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, rest: int = 2, families: dict[str, str] = FAMILIES, rows: int = ROWS, langs: int = LANGS) -> Model:
    """Fit the machines on ``training_rows``; a language beyond the ``langs`` most frequent ones is not learned."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).astype(np.float16).tobytes() for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["lang", "h", "x"])

    picked = training_rows(docs, id_col, text_col, lang_col, mod, rest, rows, langs)
    found = sorted(picked.mapInArrow(run, "lang string, h long, x binary").collect(), key=lambda r: (r.lang, r.h))  # ALL_ROWS at most
    x = np.frombuffer(b"".join(bytes(r.x) for r in found), np.float16).reshape(-1, DIMS)
    return Model(x, [r.lang for r in found], families)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, rest: int = 2, families: dict[str, str] = FAMILIES, rows: int = ROWS, langs: int = LANGS) -> DataFrame:
    """Predict the language of every text: doc_id, held_out (crc32(id as text) mod ``mod`` is ``rest``), lang_pred, score (0 to 1).

    A text that is null or has no letter gets "und" and 0, as has every text if no row is labelled.  Null labels don't train, nor do
    languages beyond the ``langs`` most frequent; ties go to the later name.  Repeated rows and null ids come back as they are; an empty table gives no rows.  Other columns are
    ignored, and the prediction sees the text alone.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, mod, rest, families, rows, langs))  # machines times DIMS, 66 MB at most for LANGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.value.predict(t) if t and any(map(str.isalpha, t.decode("utf-8", "replace"))) else (UNKNOWN, 0.0) for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), mod, rest).alias("held_out"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
