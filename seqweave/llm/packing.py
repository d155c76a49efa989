"""Packing token sequences into windows by non-negative least squares over a length histogram.

Each document is cut into whole windows and one remainder. Remainders fall into
length classes of ``GRAIN`` tokens, whose histogram has a fixed number of bins;
combinations of at most three classes that fill a window are enumerated, their
repeat counts solved for by non-negative least squares and rounded down, and the
residual histogram is packed greedily, largest class first. What fills no window
exactly is laid end to end and cut at window borders.

Documents find their slots by arithmetic: a rank within the task (given while
tokenising), the counts of earlier tasks, and the patterns' running totals; no
list of documents is ever gathered. Only documents that are cut at a border are
tokenised again, for the checksums of their two parts.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.llm.common import slices, words_of
from seqweave.session import cut_lineage

#: Tokens of a window, tokens of a length class, id that ends a document.
WINDOW, GRAIN, END = 2048, 8, 1


#: What the tokenizer takes as pieces of a word (its fixed pattern).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: Where a word may be cut without changing its ids: before these marks, behind a letter or digit of ASCII. The pattern cuts there
#: itself, and so do the tokenizer's lower case and NFC not care; with both, far fewer different words are met.
CUT = re.compile(rb"(?<=[0-9a-z])(?=[.,;:!?])")


def folded(text: bytes) -> bytes:
    """A text with the same ids and fewer different words; one that may hold a special token stays as it is."""
    return text if b"<|" in text else CUT.sub(b" ", text.lower())


def tokenizer_file(path: str | None = None) -> str:
    """Content of a tokenizer's file, read on the driver and sent along (a fixed few MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Numbered(dict):
    """Numbers of words, given in the order of first sight; ``words`` lists them."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.words = words

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number


class WordTokens:
    """Ids of the words last met. The tokenizer drops white space, so a text's ids are those of its words in turn."""

    def __init__(self, content: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(content)
        self.encode = coder.encode_batch_fast
        suffix = json.loads(content)["model"]["end_of_word_suffix"]
        self.ends = np.zeros(coder.get_vocab_size(), bool)
        self.ends[[k for w, k in coder.get_vocab().items() if w.endswith(suffix)]] = True
        self.limit = limit
        self.known = Numbered([b""])  # the end mark: no word is empty
        self.begin, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.array([END], np.uint32)
        self.last = np.zeros(1, np.int64)

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has.

        Words are sent joined by spaces, which is much cheaper than one by one. Each piece of a word ends in one id
        with the suffix, so the pieces of each word tell where its ids end; if the counts don't add up, or a word
        may hold a special token, they are sent one by one.
        """
        pieces = np.array([1 if w.isalpha() else len(PIECE.findall(unicodedata.normalize("NFC", w).lower())) for w in words])
        if not any("<|" in w for w in words):
            ids = np.array(self.encode([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == pieces.sum() and (pieces > 0).all():
                return ids, np.diff(last[np.cumsum(pieces) - 1] + 1, prepend=0)
        each = [e.ids for e in self.encode(words, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(each), np.uint32), np.array([len(c) for c in each], np.int64)

    def shrink(self):
        """Forget all but the words of the last texts."""
        kept = np.union1d([0], self.last)
        self.known = Numbered([self.known.words[k] for k in kept])
        begin, self.size = self.begin[kept], self.size[kept]
        self.begin = np.cumsum(self.size) - self.size
        self.ids = self.ids[np.repeat(begin - self.begin, self.size) + np.arange(int(self.size.sum()))]

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end mark, in one array, and each text's number of ids."""
        if len(self.known) > self.limit:
            self.shrink()
        words = [[*words_of(folded(t)), b""] if t else [b""] for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        held = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(counts.sum()))
        fresh = self.known.words[held:]
        if fresh:
            text = [w.decode("utf-8", "replace") for w in fresh]
            parts = [self.coded(text[k : k + 1000]) for k in range(0, len(text), 1000)]
            sizes = np.concatenate([s for _, s in parts])
            begin = len(self.ids) + np.cumsum(sizes) - sizes
            self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, sizes])
            self.ids = np.concatenate([self.ids, *(i for i, _ in parts)])
        self.last = np.unique(at)
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        where = np.repeat(self.begin[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        last = np.cumsum(counts) - 1
        total = np.diff(np.r_[0, ends[last]]) if len(texts) else np.zeros(0, np.int64)
        return self.ids[where].astype("<u4"), total


_HELD: dict[int, WordTokens] = {}


def held_tokens(content: str) -> WordTokens:
    """The tokenizer of this worker with the words it has met, for all tasks that Spark gives it one after the other.

    What it remembers is bounded, and ids don't depend on it, so a new worker only starts anew.
    """
    key = hash(content)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = WordTokens(content)
    return _HELD[key]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids).data)


PIECES = "doc_id bigint, text_hash bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, " \
         "block int, bin int, rank bigint"


def pieces(docs: DataFrame, content: str, window: int, grain: int) -> DataFrame:
    """Whole windows and remainders of all documents, numbered per task and length class (class 0: whole windows)."""

    def work(batches):
        tokens, block, ranks = held_tokens(content), TaskContext.get().partitionId(), {}
        for batch in slices(batches, "text", 2 << 20):
            ids, sizes = tokens.of(batch.column("text").to_pylist())
            out, base = [], 0
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), strict=True)
            for (doc, text), size in zip(keys, sizes.tolist(), strict=True):
                for start in range(0, size, window):
                    length = min(window, size - start)
                    kind = 0 if length == window else -(-length // grain)
                    rank = ranks[kind] = ranks.get(kind, -1) + 1
                    crc = checksum(ids[base + start : base + start + length])
                    out.append((doc, text, start, length, crc, size, block, kind, rank))
                base += size
            columns = list(zip(*out, strict=True)) or [[] for _ in range(9)]
            kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=[p.split()[0] for p in PIECES.split(", ")])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                       F.col("text").cast("binary").alias("text")).mapInArrow(work, PIECES)


def combinations(bins: int) -> np.ndarray:
    """All ways to fill ``bins`` with one, two or three classes: a row of three class numbers each, 0 for none."""
    out = [(bins, 0, 0)]
    for a in range(1, bins):
        for b in range(1, min(a, bins - a) + 1):
            c = bins - a - b
            if c <= b:
                out.append((a, b, c))
    return np.array(out)


def nnls(matrix: np.ndarray, target: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Non-negative x that makes |matrix x - target| least, by the active-set method of Lawson and Hanson.

    The passive columns' normal equations are solved in each step; a step count of four times the rows and columns
    bounds it, for a plan only needs a good start and is made whole afterwards.
    """
    columns = matrix.shape[1]
    x, passive = np.zeros(columns), np.zeros(columns, bool)
    aim = matrix.T @ target
    scale = tolerance * max(1.0, float(np.abs(target).max(initial=0.0))) * matrix.max(initial=1.0)

    def solved(which):
        part = matrix[:, which]
        try:
            return np.linalg.solve(part.T @ part, aim[which])
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(part, target, rcond=None)[0]

    for _ in range(4 * (matrix.shape[0] + columns)):
        slope = aim - matrix.T @ (matrix @ x)
        slope[passive] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= scale:
            break
        passive[best] = True
        while passive.any():
            trial = np.zeros(columns)
            trial[passive] = solved(passive)
            low = passive & (trial <= 0)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = np.where(passive, x + step * (trial - x), 0.0)
            passive &= ~(low & (x <= scale * 1e-3))
        else:
            x = np.zeros(columns)
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns that fill a window and their repeat counts, never using more of a class than there is.

    ``histogram``: the number of remainders of class 1, 2, ... (the last fills a window alone).
    """
    bins = len(histogram)
    held = np.r_[0, histogram].astype(np.int64)
    found = combinations(bins)
    found = found[(held[found] > 0).all(1, where=found > 0)]
    out: list[tuple[tuple[int, ...], int]] = []
    if len(found):
        matrix = np.zeros((bins + 1, len(found)))
        for j in range(3):
            np.add.at(matrix, (found[:, j], np.arange(len(found))), found[:, j] > 0)
        scale = held.max()
        solved = np.floor(nnls(matrix[1:], held[1:] / scale) * scale + 1e-6).astype(np.int64)
        for k in np.argsort(-solved, kind="stable"):
            use = matrix[:, k].astype(np.int64)
            most = min(int(solved[k]), *(int(held[b] // use[b]) for b in np.flatnonzero(use)))
            if most > 0:
                out.append((tuple(int(b) for b in found[k] if b), most))
                held -= most * use
    tried = held.copy()  # the greedy rest: largest class first, then the largest that still fits
    while tried.any():
        use, room, left = [], bins, tried.copy()
        while room and left[1 : room + 1].any():
            b = int(np.flatnonzero(left[: room + 1])[-1])
            use.append(b)
            left[b] -= 1
            room -= b
        each = np.bincount(use, minlength=bins + 1)
        times = int(min(tried[b] // each[b] for b in np.flatnonzero(each)))
        tried -= times * each
        if room == 0:
            out.append((tuple(use), times))
    return out


def pack(docs: DataFrame, content: str | None = None, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's (null: none) and the end id; each lies in one
    piece, and pieces of a sequence lie side by side from offset 0. Sequences are
    whole windows, patterns of remainders (up to ``grain`` - 1 tokens short a
    piece), and one run of rests without a gap, whose last sequence alone can be
    short. Repeated rows are packed as often as they stand. Other columns are not read.
    """
    content = content or tokenizer_file()
    spark = docs.sparkSession
    made = cut_lineage(pieces(docs, content, window, grain))
    counts = cut_lineage(made.groupBy("bin", "block").agg(F.max("rank").alias("last")))
    before = F.coalesce(
        F.sum(F.col("last") + 1).over(Window.partitionBy("bin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    offsets = counts.select("bin", "block", before.alias("before"))
    totals = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum(F.col("last") + 1).alias("n")).collect()}
    bins = -(-window // grain)
    patterns = plan(np.array([totals.get(b, 0) for b in range(1, bins + 1)]))
    ranked = made.join(offsets, ["bin", "block"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")

    whole = ranked.where("bin = 0").select("*", F.col("rank").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    base, taken, spans = totals.get(0, 0), dict.fromkeys(range(1, bins + 1), 0), []
    for use, times in patterns:
        for slot, b in enumerate(use):
            spans.append((b, taken[b], taken[b] + times, base - taken[b], slot))
            taken[b] += times
        base += times
    by_bin: dict[int, list] = {}
    for b, first, end, shift, slot in spans:
        by_bin.setdefault(b, []).append((first, end, shift, slot))
    table = {b: tuple(np.array(c) for c in zip(*rows, strict=True)) for b, rows in by_bin.items()}

    def place(batches):
        for batch in batches:
            kind, rank = batch.column("bin").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.full(len(kind), -1), np.zeros(len(kind), np.int64)
            for b in np.unique(kind):
                if b in table:
                    first, end, shift, slots = table[b]
                    at = np.flatnonzero((kind == b) & (rank < end[-1]))
                    k = np.searchsorted(first, rank[at], "right") - 1
                    sequence[at], slot[at] = rank[at] + shift[k], slots[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64()), pa.array(slot, pa.int64())],
                                             names=[*batch.schema.names, "sequence_id", "slot"])

    rests = ranked.where("bin > 0").select(*made.columns)
    placed = cut_lineage(rests.mapInArrow(place, PIECES + ", sequence_id bigint, slot bigint"))
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    filled = placed.where("sequence_id >= 0").withColumn(
        "offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))
    )

    pool = placed.where("sequence_id < 0").drop("sequence_id", "slot")
    sums = pool.groupBy("block").agg(F.sum("length").alias("length"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    sums = sums.select("block", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("before"))
    inner = Window.partitionBy("block").orderBy("bin", "rank").rowsBetween(Window.unboundedPreceding, -1)
    laid = pool.withColumn("at", F.coalesce(F.sum("length").over(inner), F.lit(0))).join(sums, "block")
    laid = laid.withColumn("at", F.col("at") + F.col("before"))
    last = F.floor((F.col("at") + F.col("length") - 1) / window).cast("bigint")
    laid = laid.withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / window).cast("bigint"), last)))
    begin, end = F.greatest("at", F.col("k") * window), F.least(F.col("at") + F.col("length"), (F.col("k") + 1) * window)
    laid = cut_lineage(laid.select(
        "doc_id", "text_hash", (F.col("start") + begin - F.col("at")).alias("start"), (end - begin).alias("size"),
        "length", "ids_crc32", "doc_tokens", (F.col("k") + base).alias("sequence_id"),
        (begin - F.col("k") * window).alias("offset"),
    ))
    cut = laid.where("size < length")
    uncut = laid.where("size = length")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = [whole.select(*names), filled.select(*names), uncut.select(*names)]
    if not cut.isEmpty():
        out.append(_again(docs, cut, content).select(*names))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def _again(docs: DataFrame, cut: DataFrame, content: str) -> DataFrame:
    """The parts of cut remainders with their own checksums, from their texts."""
    keys = cut.groupBy("text_hash").agg(F.count("*").alias("n")).select("text_hash")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(keys, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    met = cut.join(texts, "text_hash").select("doc_id", "start", "size", "doc_tokens", "sequence_id", "offset", "text")

    def work(batches):
        tokens = held_tokens(content)
        for batch in slices(batches, "text", 2 << 20):
            ids, sizes = tokens.of(batch.column("text").to_pylist())
            base = np.cumsum(sizes) - sizes + batch.column("start").to_numpy()
            crcs = [checksum(ids[b : b + n]) for b, n in zip(base, batch.column("size").to_pylist(), strict=True)]
            columns = {c: batch.column(c) for c in ("doc_id", "start", "doc_tokens", "sequence_id", "offset")}
            yield pa.RecordBatch.from_pydict(columns | {"length": batch.column("size"),
                                                        "ids_crc32": pa.array(crcs, pa.int64())})

    form = "doc_id bigint, start bigint, doc_tokens bigint, sequence_id bigint, offset bigint, length bigint, " \
           "ids_crc32 bigint"
    return met.mapInArrow(work, form)
