"""Language-model scores by the lattice of subwords.

The vocabulary of an existing subword tokenizer weights the pieces: each piece's prior follows from the vocabulary's own score
(its rank), and counts over the training documents' distinct words sharpen it.  The lattice of a word has all its segmentations
into pieces.  The sum over all of them, by forward recursion in log space, is the word's marginal probability; a text's is the
product over its words and one end (``lattice_score``).

Pieces alone know little of which words there are, so ``score`` is of a mixture: a word met in training has one more edge over the
whole of it.  Witten-Bell gives these edges c / (n + v), by the word's count c among n tokens, v of them distinct, and leaves v / (n + v)
to the lattice; the two add up to 1.

Words repeat, so the work is by distinct word: documents are parsed once in blocks, each with a dictionary of its own words;
the dictionaries are joined with the counts and the words' probabilities, and go back to their blocks.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, partitions, small_batches, utf8

#: Sentencepiece vocabulary, the weight (in pieces) of its prior, and the bytes of text that a block holds before it is closed.
VOCABULARY, PRIOR_WEIGHT, BLOCK_BYTES = "piece_bpe_32k.model", 1000.0, 16 << 20


class Chars(dict):
    """log10 of the probability of a character as a piece of its own or as bytes; known ones up to a bound."""

    def __init__(self, pieces: dict[str, float], bytes_: list[float]):
        super().__init__()
        self.pieces, self.bytes = pieces, bytes_

    def __missing__(self, c: str) -> float:
        if len(self) > 100_000:
            self.clear()
        spelled, piece = math.fsum(self.bytes[b] for b in c.encode("utf-8", "replace")), self.pieces.get(c, -math.inf)
        top = max(spelled, piece)
        self[c] = out = top + math.log10(10.0 ** (spelled - top) + 10.0 ** (piece - top))
        return out


class Pieces:
    """Pieces of the vocabulary with their scores; bytes stand for characters that no piece has."""

    def __init__(self, name: str):
        import sentencepiece

        path = name
        if not os.path.exists(name):
            import public_tokenizers

            path = str(public_tokenizers.path(name))
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.names = [self.model.id_to_piece(i) for i in range(n)]
        self.usable = np.array([not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)) for i in range(n)])
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.names) if self.model.is_byte(i)}
        self.index = {p: i for i, p in enumerate(self.names) if self.usable[i] and not self.model.is_byte(i)}
        self.longest = max(map(len, self.index), default=1)
        # lengths of the pieces that end in these two characters; a piece of one character has length 1
        ends: dict[str, set[int]] = {}
        for piece in self.index:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
        self.ends = {k: tuple(sorted(v)) for k, v in ends.items()}
        # the scores of a merge vocabulary are ranks, from 0 down; by rank, pieces of running text follow a power law
        rank = np.array([-self.model.get_score(i) if not self.model.is_byte(i) else n for i in range(n)])
        self.prior = np.where(self.usable, 1.0 / (10.0 + np.minimum(np.maximum(rank, 0), n)), 0.0)

    def weights(self, counts: np.ndarray, words: int) -> tuple[list[float], list[float], float]:
        """log10 probabilities of the pieces, of the 256 bytes, and of a word's end, out of counts over so many words.  A byte that
        the vocabulary has no piece for is worth one count in all, as are all such bytes together."""
        p = counts + PRIOR_WEIGHT * self.prior / self.prior.sum()
        missing = 256 - len(self.bytes)
        total = p.sum() + words + 1 + (missing > 0)
        with np.errstate(divide="ignore"):
            logs = np.log10(p / total).tolist()
        return logs, [logs[self.bytes[b]] if b in self.bytes else -math.log10(missing * total) for b in range(256)], math.log10((words + 1) / total)

    def chars(self, logs: list[float], bytes_: list[float]) -> Chars:
        return Chars({c: logs[i] for c, i in self.index.items() if len(c) == 1}, bytes_)

    def word(self, word: str, logs: list[float], chars: Chars) -> float:
        """log10 of the sum over all segmentations of a word, its mark of a word's beginning included."""
        s, index, ends = "▁" + word, self.index.get, self.ends.get
        f, before = [0.0], ""
        for end, c in enumerate(s, 1):
            total, terms = f[-1] + chars[c], None
            for n in ends(before + c, ()):
                if n > end:
                    break
                if (i := index(s[end - n : end])) is not None:
                    if terms is None:
                        terms = [total]
                    terms.append(f[end - n] + logs[i])
            if terms is not None:
                top = max(terms)
                total = top + math.log10(sum([10.0 ** (t - top) for t in terms]))
            f.append(total)
            before = c
        return f[-1]


_loaded: dict[str, Pieces] = {}


def pieces(name: str) -> Pieces:
    if name not in _loaded:
        _loaded[name] = Pieces(name)
    return _loaded[name]


def blocks(docs: DataFrame, id_col: str, text_col: str, mod: int, rest: int, block_bytes: int) -> DataFrame:
    """Rows of two kinds.  Documents (block, doc_id, held_out, words: numbers of its words in the block's dictionary, as 32-bit
    integers), and entries of the dictionaries (block, number, word, train: occurrences in the block's training documents)."""
    small_batches(docs.sparkSession)
    fields = [("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("words", pa.binary()), ("number", pa.int32()), ("word", pa.binary()), ("train", pa.int64())]

    def rows(block: int, **cols: list) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array([block] * n if k == "block" else cols.get(k, [None] * n), t) for k, t in fields], [k for k, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, number, train = TaskContext.get().partitionId() << 32, 0, {}, Counter()

        def dictionary() -> Iterator[pa.RecordBatch]:
            listed = list(number)
            for i in range(0, len(listed), 50_000):
                part = listed[i : i + 50_000]
                yield rows(block, number=list(range(i, i + len(part))), word=part, train=[train[j] for j in range(i, i + len(part))])

        for batch in batches:
            ids, held, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for text, out in zip(utf8(batch, "text"), held, strict=True):
                found = (text or b"").lower().split()
                size += len(text or b"")
                for w in found:
                    if w not in number:
                        number[w] = len(number)
                own = [number[w] for w in found]
                if not out:
                    train.update(own)
                packed.append(np.array(own, "<i4").tobytes())
            yield rows(block, doc_id=ids, held_out=held, words=packed)
            if size >= block_bytes:
                yield from dictionary()
                block, size, number, train = block + 1, 0, {}, Counter()
        yield from dictionary()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), mod, rest).alias("held_out"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "block long, doc_id long, held_out boolean, words binary, number int, word binary, train long")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, mod: int = 7, rest: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score every document; learn from those whose crc32(id as text) mod ``mod`` is not ``rest`` (a null id trains).

    A row for each: doc_id, held_out, n_tokens (words and the end), n_known (tokens met in training), train_tokens, base_score
    (add-one unigrams, log10), score (log10 of the mixture's probability) and lattice_score (of the lattice's alone).  Null and
    empty texts are one end.  Repeated rows count and return as often as they come; an empty table gives no rows, and without
    training rows the lattice has the vocabulary's prior alone.  Other columns are ignored.
    """
    spark = docs.sparkSession
    table = cut(blocks(docs, id_col, text_col, mod, rest, block_bytes), "blocks")
    texts, entries = table.where("word is null").select("block", "doc_id", "held_out", "words"), table.where("word is not null")
    vocab = cut(entries.groupBy("word").agg(F.sum("train").alias("c")), "words")
    ends = texts.where("not held_out").count()
    words_total, distinct = vocab.where("c > 0").agg(F.sum("c"), F.count("*")).head()
    n, v = (words_total or 0) + ends, distinct + (ends > 0)
    table_size = pieces(vocabulary).model.get_piece_size()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = pieces(vocabulary), np.zeros(table_size, np.int64)
        for batch in batches:
            listed = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            for ids in model.model.encode(listed, num_threads=1):
                np.add.at(total, ids, 1)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full])], ["piece", "n"])

    found = vocab.where("c > 0").mapInArrow(count, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece at most
    counts = np.zeros(table_size)
    for r in found:
        counts[r.piece] = r.n
    weights, byte_weights, word_end = pieces(vocabulary).weights(counts, distinct)
    log_known = lambda c: math.log10(c / (n + v)) if c else -math.inf
    log_new = math.log10(v / (n + v)) if v else 0.0
    end_alone = math.log10((ends + 1) / (n + 2))  # in the lattice's model every token is an end with this probability, else a word
    word_alone = math.log10(max(n + 1 - ends, 1) / (n + 2)) + word_end
    end_log = log_known(ends) if ends else log_new + end_alone
    log_new += word_end

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary)
        chars = model.chars(weights, byte_weights)
        for batch in batches:
            mixed, alone = [], []
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spelled = model.word(w.decode("utf-8", "replace"), weights, chars)
                alone.append(word_alone + spelled)
                if c:
                    new, whole = log_new + spelled, log_known(c)
                    top = max(new, whole)
                    mixed.append(top + math.log10(10.0 ** (new - top) + 10.0 ** (whole - top)))
                else:
                    mixed.append(log_new + spelled)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mixed, pa.float64()), pa.array(alone, pa.float64())], ["word", "c", "log", "alone"])

    spread = vocab.repartition(max(partitions(spark), spark.sparkContext.defaultParallelism), "word")  # a number that is kept: words are dear
    scored = cut(spread.mapInArrow(likelihood, "word binary, c long, log double, alone double"), "likelihoods")
    known = entries.select("block", "number", "word").join(scored.hint("merge"), "word").select(F.col("block").alias("of"), "number", "c", "log", "alone")

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        c, log, alone = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        order = right.column("number").to_numpy()
        c[order], log[order], alone[order] = (right.column(k).to_numpy() for k in ("c", "log", "alone"))
        base = np.log10((c + 1) / (n + v + 1))
        base_end = math.log10((ends + 1) / (n + v + 1))
        tokens, met, base_score, total, lattice = [], [], [], [], []
        for packed in left.column("words").to_pylist():
            own = np.frombuffer(packed, "<i4")
            tokens.append(len(own) + 1)
            met.append(int((c[own] > 0).sum()) + (ends > 0))
            base_score.append(math.fsum(base[own]) + base_end)
            total.append(math.fsum(log[own]) + end_log)
            lattice.append(math.fsum(alone[own]) + end_alone)
        k = left.num_rows
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(met, pa.int64()),
            "train_tokens": pa.array([n] * k, pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(total, pa.float64()),
            "lattice_score": pa.array(lattice, pa.float64()),
        })

    grouped = texts.groupBy("block").cogroup(known.groupBy("of"))
    return grouped.applyInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double")
