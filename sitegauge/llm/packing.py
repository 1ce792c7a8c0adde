"""Mixture-controlled packing of token streams into sequences.

Every source is a queue.  Deficit round-robin serves the queues window by window: a window gives each queue its share of the
window's tokens, and what rounding withholds is carried as the queue's deficit to the next window.  As documents may be cut
anywhere, deficits have a closed form.  The queues are the leaves of a binary tree: of a node's first r tokens the left child is
given floor(r * a / n) and the right one the others, with a the left child's tokens and n the node's.  Both counts only grow, so a
queue with less than one token a window has its turn in every so many windows, and a deficit stays under one token a level.  Each
document thus finds its windows from its place in its queue alone; deficits pass windows and partitions without any window being
laid out by one task.

Sources under 1/64 of all tokens (or without a target weight) share one queue, which is parted by a tree of its own: its paths are
computed by joins and may be as many as there are sources.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, cut, small_batches, utf8

#: Without target weights, a source under this part of all tokens is a leaf in the tree of the last queue: 64 sources at most have a
#: queue of their own.
LEAST_SHARE = 1 / 64
WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"


class WordIds:
    """Words (ASCII letters lower-cased, without blanks) and their ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space, never joins what it parts and lower-cases, so a text's ids are those of its words in turn.
    Runs of letters are the bulk of the words; they are encoded many at once.  Every other word is encoded by itself.
    """

    MOST = 1_500_000
    #: Characters behind a word that are a run of their own.
    MARKS = b".,;:!?#$%&*"
    #: Words that are encoded at once.
    WORDS = 200

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}
        #: Words of letters of which the tokenizer makes more than one run of letters.
        self.odd: set[bytes] = set()
        #: Strings of one id, which the tokenizer looks for before it lower-cases.
        self.special = sorted({t.content.encode() for t in self.encoder.get_added_tokens_decoder().values()})
        size = self.encoder.get_vocab_size()
        #: Ids that end a run of letters, a digit or a run of other characters.
        self.ends = np.array([(self.encoder.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def alone(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, text: str, n: int) -> bool:
        """Whether the tokenizer's own normalisation leaves n words of letters of the text (U+0130, say, becomes a letter and a mark)."""
        if text.isascii():
            return True
        left = self.encoder.normalizer.normalize_str(text).split(" ") if self.encoder.normalizer else text.split(" ")
        return len(left) == n and all(map(str.isalpha, left))

    def _learn(self, new: set[bytes]) -> None:
        """Each word of letters leaves one run at least, so as many runs as words are one for each."""
        known, other, marked = self.known, [], []
        ascii_ = set(filter(bytes.isalpha, new))  # of bytes: ASCII letters
        rest = list(new.difference(ascii_))
        for w, core in zip(rest, map(bytes.rstrip, rest, repeat(self.MARKS)), strict=True):
            if core.isalpha():
                marked.append((w, core))
                ascii_.add(core)
            elif core.isascii():
                known[w] = self.alone(w.decode())
            elif not core.decode("utf-8", "replace").isalpha():
                known[w] = self.alone(w.decode("utf-8", "replace"))
            else:
                other.append(core)
                if len(core) != len(w):
                    marked.append((w, core))
        ascii_ = ascii_.difference(known)  # difference_update would walk through all that is known
        for words in (list(ascii_), [w for w in dict.fromkeys(other) if w not in known]):
            for i in range(0, len(words), self.WORDS):
                part = words[i : i + self.WORDS]
                text = b" ".join(part).decode("utf-8", "replace")
                ids = np.array(self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
                if len(stops) == len(part) and self._letters(text, len(part)):
                    packed, stops = ids.tobytes(), stops.tolist()
                    known.update(zip(part, map(packed.__getitem__, map(slice, [0, *stops], stops)), strict=False))
                    continue
                for w in part:
                    known[w] = self.alone(w.decode("utf-8", "replace"))
                    if not self._letters(w.decode("utf-8", "replace"), 1) or sum(self.ends[np.frombuffer(known[w], "<u4")]) != 1:
                        self.odd.add(w)
        for w, core in marked:
            if core in self.odd:
                known[w] = self.alone(w.decode("utf-8", "replace"))
                continue
            tail = w[len(core) :]
            if tail not in self.tails:
                self.tails[tail] = self.alone(tail.decode())
            known[w] = known[core] + self.tails[tail]

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        lower = [(t or b"").lower() for t in texts]
        # a text whose lower case has a special string that the text itself hasn't is encoded as a whole
        whole = {i: self.alone(texts[i].decode("utf-8", "replace")) for i, t in enumerate(lower) if any(x in t and t.count(x) != texts[i].count(x) for x in self.special)}
        split = [[] if i in whole else t.split() for i, t in enumerate(lower)]
        every = set().union(*split)
        new = every.difference(self.known)
        if len(self.known) + len(new) > self.MOST:
            self.known.clear()
            self.odd.clear()
            new = every
        self._learn(new)
        get = self.known.__getitem__
        return [whole[i] if i in whole else b"".join(map(get, ws)) for i, ws in enumerate(split)]


_encoders: dict[str, WordIds] = {}


def encoder(name: str) -> WordIds:
    """The worker's encoder for a file, or for a name among the public tokenizers; kept from task to task."""
    if name not in _encoders:
        path = name
        if not os.path.exists(name):
            import public_tokenizers

            path = str(public_tokenizers.path(name))
        _encoders[name] = WordIds(path)
    return _encoders[name]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Token ids of every document with the end id behind: doc_id, source, part (the task), before (ids of the same source in the
    same task before it), n, ids (little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, end = TaskContext.get().partitionId(), encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        so_far: dict[str | None, int] = defaultdict(int)
        for batch in batches:
            ids = [x + end for x in known.texts(utf8(batch, "text"))]
            before = []
            for source, x in zip(batch.column(1).to_pylist(), ids, strict=True):
                before.append(so_far[source])
                so_far[source] += len(x) // 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "source", "part", "before", "n", "ids"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, source string, part int, before long, n long, ids binary")


def phases(lengths: list[int], weights: list[float] | None = None) -> list[tuple[int, list[int], list[int]]]:
    """Phases (x, first, length): from place x on, queue i gives ``length[i]`` ids from its ``first[i]``-th.  Without weights one
    phase in the proportions of the queues.  With weights a phase ends when a queue is used up, and the others go on in theirs;
    queues of weight 0 come last, in proportion to their lengths."""
    if weights is None:
        return [(0, [0] * len(lengths), list(lengths))] if sum(lengths) else []
    out, x, done = [], 0, [0] * len(lengths)
    while sum(left := [n - d for n, d in zip(lengths, done, strict=True)]):
        w = [v if n else 0.0 for v, n in zip(weights, left, strict=True)]
        w = w if any(w) else [float(n) for n in left]
        time = min(n / v for n, v in zip(left, w, strict=True) if v)
        take = [0 if not v else n if n / v <= time * (1 + 1e-12) else min(n, int(v * time)) for n, v in zip(left, w, strict=True)]
        out.append((x, list(done), take))
        x += sum(take)
        done = [d + t for d, t in zip(done, take, strict=True)]
    return out


Path = list[tuple[bool, int, int]]  # from the root on: whether the leaf is on the right, the left child's tokens, the node's


def leaf_path(lengths: list[int], queue: int) -> Path:
    """The path to a queue in the tree of queues of these lengths; nodes with one child are left out."""
    lo, hi, path = 0, len(lengths), []
    while hi - lo > 1:
        mid = (lo + hi) // 2
        a, size = sum(lengths[lo:mid]), sum(lengths[lo:hi])
        if 0 < a < size:
            path.append((queue >= mid, a, size))
        lo, hi = (mid, hi) if queue >= mid else (lo, mid)
    return path


def turns(queue: int, plan: list[tuple[int, list[int], list[int]]]) -> list[tuple[int, int, int, int, Path]]:
    """A queue's part of each phase: the phase's first place and length, the queue's first id and number of ids, its path."""
    return [(x0, sum(length), first[queue], length[queue], leaf_path(length, queue)) for x0, first, length in plan if length[queue]]


def _up(path: Path, q: int) -> int:
    """The place in the root's tokens of a leaf's q-th."""
    for right, a, size in reversed(path):
        q = q * size // (size - a) if right else -(-(q + 1) * size // a) - 1
    return q


def _down(path: Path, x: int, begin: int, stop: int) -> tuple[int, int, int]:
    """What a leaf has of its root's tokens from ``begin`` to ``stop``, and the place ``x`` of its first one, leaves following one another."""
    for right, a, size in path:
        left = begin * a // size, stop * a // size
        if right:
            x += left[1] - left[0]
            begin, stop = begin - left[0], stop - left[1]
        else:
            begin, stop = left
    return x, begin, stop


def pieces(own: list[tuple[int, int, int, int, Path]], path: Path, place: int, n: int, window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(start, length, x) of the pieces of ids ``place`` to ``place + n`` of a leaf of a queue (``path``: in the queue's own tree):
    x is the piece's place among all ids.  A leaf has one piece of every window at most."""
    at, end = place, place + n
    while at < end:
        q = _up(path, at)
        x0, total, lo, _, steps = next(t for t in own if q < t[2] + t[3])
        k = (x0 + _up(steps, q - lo)) // window
        ra, rb = max(k * window - x0, 0), min((k + 1) * window - x0, total)
        x, begin, stop = _down(steps, x0 + ra, ra, rb)
        x, begin, stop = _down(path, x, lo + begin, lo + stop)
        take = min(end, stop) - at
        yield at - place, take, x + at - begin
        at += take


def paths(pool: DataFrame) -> DataFrame:
    """(leaf, path) as ``pieces`` takes them out of (leaf, n), leaves being hashes: their bits, from the highest on, lead through the
    tree, and nodes with one child are left out."""
    nodes = pool.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(64)))).withColumn("right", F.expr("shiftrightunsigned(leaf, 64 - level) & 1 = 1"))
    nodes = nodes.withColumn("node", F.expr("shiftrightunsigned(shiftrightunsigned(leaf, 64 - level), 1)"))
    split = nodes.groupBy("level", "node").agg(F.sum(F.when(~F.col("right"), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("size")).where("a > 0 and a < size")
    steps = nodes.join(split, ["level", "node"]).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("level", "right", "a", "size"))).alias("steps"))
    return steps.select("leaf", F.transform("steps", lambda s: F.struct(s["right"].alias("right"), s["a"].alias("a"), s["size"].alias("size"))).alias("path"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW, targets: dict[str, float] | None = None, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of ``window`` ids; only the last may be shorter.  A row for each piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, source, and with ``keep_ids`` the piece's ids.

    ``targets``: token proportions by source.  A source whose target isn't 0 has a queue of its own; when it is used up, the others
    go on in their proportions.  Sources with target 0 or none come last, in proportion to their tokens.  Without ``targets`` every
    window has the corpus's proportions.  Null and empty texts are the end id alone.  Null sources are a source.  Repeated rows
    and ids are packed as often as they come; a null id stays null.  An empty table gives no rows.  Other columns are ignored.
    """
    rows = cut(encode(docs, id_col, text_col, source_col, tokenizer, end_id), "tokens")
    runs = cut(rows.groupBy("part", "source").agg(F.sum("n").alias("n")), "runs")
    by_source = runs.groupBy("source").agg(F.sum("n").alias("n"))
    total = runs.agg(F.sum("n")).head()[0] or 0
    if targets is None:
        apart = F.col("n") >= F.lit(total * LEAST_SHARE)  # 64 at most
    else:
        apart = F.coalesce(F.col("source").isin([s for s, w in targets.items() if w > 0 and s is not None]), F.lit(targets.get(None, 0.0) > 0))  # as many as are named
    own = [(r.source, r.n) for r in by_source.where(apart).orderBy(F.col("source").asc_nulls_first()).collect()]
    names = [s for s, _ in own]
    lengths = [n for _, n in own] + [total - sum(n for _, n in own)]
    plan = phases(lengths, None if targets is None else [targets[s] for s in names] + [0.0])
    numbered = docs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(names)], "s string, i int")
    runs = runs.join(F.broadcast(numbered), F.col("source").eqNullSafe(F.col("s")), "left").select("part", "source", "n", F.coalesce("i", F.lit(len(names))).alias("queue"))
    runs = runs.withColumn("leaf", F.when(F.col("queue") == len(names), F.xxhash64("source")).otherwise(0))
    # a leaf's order: by task, within it by source (of one hash), within it as the task met them
    inner = Window.partitionBy("queue", "leaf", "part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("queue", "leaf").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = runs.groupBy("queue", "leaf", "part").agg(F.sum("n").alias("n")).select("queue", "leaf", "part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"))
    places = runs.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(tasks, ["queue", "leaf", "part"])
    if lengths[-1]:
        small = paths(runs.where(F.col("queue") == len(names)).groupBy("leaf").agg(F.sum("n").alias("n")))
        places = places.join(small.withColumn("queue", F.lit(len(names))), ["queue", "leaf"], "left")
    else:
        places = places.withColumn("path", F.lit(None).cast("array<struct<right:boolean,a:bigint,size:bigint>>"))
    places = checked(cut(places.select(F.col("part").alias("p"), F.col("source").alias("s"), "queue", "path", (F.col("base") + F.col("inner")).alias("base")), "places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for batch in batches:
            out: list[tuple] = []
            for id_, source, q, path, place, ids in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                view, n = memoryview(ids), len(ids) // 4
                if q not in own:
                    own[q] = turns(q, plan)
                for start, length, x in pieces(own[q], [(s["right"], s["a"], s["size"]) for s in path or []], place, n, window):
                    piece = view[4 * start : 4 * (start + length)]
                    out.append((id_, start, length, zlib.crc32(piece), n, x // window, x % window, source, bytes(piece) if keep_ids else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"])

    placed = rows.join(places, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select("doc_id", "source", "queue", "path", (F.col("base") + F.col("before")).alias("place"), "ids")
    out = placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary")
    return out if keep_ids else out.drop("ids")
