"""Phrases that occur together more often than their parts let expect, by Rabin-Karp fingerprints.

Prefix polynomials over the bytes of a batch give the fingerprint of every word n-gram by one subtraction. A task
counts its fingerprints; the shuffle adds the counts of a fingerprint and keeps two pointers to it, those that are
smallest and largest by a second fingerprint. Only frequent fingerprints are read from the texts again, at both
pointers. Where the two texts differ the fingerprint has collided, and its n-grams are counted anew by both
fingerprints. Lengths are counted one after the other: an n-gram whose first or last n - 1 words are infrequent is
infrequent itself, which a bit table of fixed size can tell for most; a wrongly set bit only costs work.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.llm.common import mixed, slices
from seqweave.session import cut_lineage

#: Address bits of the table of frequent fingerprints: 2^26 bits are 8 MB at every size of the corpus.
TABLE_BITS = 26
#: Bytes hashed at once, and counted n-grams a task gathers before it sends them on.
BLOCK, GATHERED = 1 << 19, 1_200_000
#: Parts in which the phrases of a language are ranked before they are ranked together.
PARTS = 64

LATIN_UPPER, LATIN_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Space and tab separate words, the others pieces.
_CLASS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b" \t" else c for c in range(256))
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_PAIRS = mixed(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))

COUNTED = pa.schema([("fp", pa.int64()), ("pointer", pa.int64()), ("n", pa.int64())])
FOUND = pa.schema([("fp", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("phrase", pa.string()), ("pointer", pa.int64())])


@functools.lru_cache(maxsize=2)
def _powers_held(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(base, n)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^n, or more, and the inverses of these modulo 2^64; those of ordinary blocks are kept."""
    return _powers_held(base, 2 * BLOCK) if n <= 2 * BLOCK else _powers_of(base, n)


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


class Words:
    """The words of some texts as places in one array of bytes, in which one space separates the words of a piece."""

    def __init__(self, texts: list[bytes | None], langs: list[str | None]):
        parts = [(t or b"").lower().translate(_CLASS) for t in texts]
        data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
        line = data == 10
        gap = (data == 32) | line
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.first, self.last = edges[::2], edges[1::2]
        ends = np.cumsum([len(p) + 1 for p in parts])
        self.doc = np.repeat(np.arange(len(parts)), np.diff(np.searchsorted(self.first, ends, "right"), prepend=0))
        self.piece = np.searchsorted(np.flatnonzero(line), self.first)
        data = np.where(line, np.uint8(32), data)
        if ((self.first[1:] - self.last[:-1] > 1) & (self.piece[1:] == self.piece[:-1])).any():
            length = self.last - self.first + 1
            moved = np.cumsum(length) - length + 1
            at = np.repeat(self.first - moved, length) + np.arange(1, int(length.sum()) + 1)
            data = np.concatenate([np.full(1, 32, np.uint8), data[at]])
            self.first, self.last = moved, moved + length - 1
            data[self.last] = 32
        self.data = data
        known = {x: _lang_hash(x) for x in set(langs)}
        self.lang = np.array([known[x] for x in langs], np.uint64)
        self.langs = langs
        self._sums: dict[int, np.ndarray] = {}

    def grams(self, n: int) -> np.ndarray:
        """Places of the words at which an n-gram within one piece starts."""
        count = len(self.first)
        if n == 0 or count < n:
            return np.arange(count if n == 0 else 0)
        return np.flatnonzero(self.piece[: count - n + 1] == self.piece[n - 1 :])

    def _prefix(self, low: int, high: int, which: int) -> np.ndarray:
        """Prefix sums of byte values times powers of the base, over the bytes from ``low`` (a word's first) to ``high``."""
        part = self.data[low:high]
        if which == 0:
            value = _VALUES[part]
        else:
            value = _PAIRS[(self.data[low - 1 : high - 1].astype(np.uint16) << 8) | part]
        value *= _powers(_BASES[which], high - low)[0][: high - low]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        return sums

    def fingerprints(self, at: np.ndarray, n: int, which: int) -> np.ndarray:
        """Fingerprints of the n-grams that start at the words ``at`` (rising), told apart by language.

        The first polynomial runs over bytes, the second over pairs of neighbouring bytes of a word.
        """
        if n == 0:
            return mixed(self.lang[self.doc[at]] + np.uint64(which + 1))
        out = np.zeros(len(at), np.uint64)
        begin, end = self.first[at], self.last[at + n - 1]
        if len(self.data) <= 2 * BLOCK:
            if which not in self._sums:
                self._sums[which] = self._prefix(1, len(self.data), which)
            sums = self._sums[which]
            down = _powers(_BASES[which], len(self.data))[1]
            out = (sums[end - 1] - sums[begin - 1]) * down[begin - 1]
        else:  # a very long text, in blocks of words
            done = 0
            while done < len(at):
                stop = max(done + 1, int(np.searchsorted(end, begin[done] + BLOCK)))
                low, high = int(begin[done]), int(end[stop - 1])
                sums = self._prefix(low, high, which)
                down = _powers(_BASES[which], high - low)[1]
                b, e = begin[done:stop] - low, end[done:stop] - low
                out[done:stop] = (sums[e] - sums[b]) * down[b]
                done = stop
        return mixed(mixed(out + np.uint64(n)) ^ self.lang[self.doc[at]])

    def text(self, at: int, n: int) -> bytes:
        return self.data[self.first[at] : self.last[at + n - 1]].tobytes() if n else b""


def _lang_hash(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(("und" if lang is None else lang).encode(), digest_size=8).digest(), "little")


def _held(table: np.ndarray | None, fps: np.ndarray) -> np.ndarray:
    """Which fingerprints have their bit set; all without a table."""
    if table is None:
        return np.ones(len(fps), bool)
    place = fps >> np.uint64(64 - TABLE_BITS)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _frequent_at(words: Words, n: int, table: np.ndarray | None, mask: np.uint64) -> np.ndarray:
    """Places of the n-grams whose first and last n - 1 words may be frequent."""
    at = words.grams(n)
    if table is None or not len(at):
        return at
    shorter = words.grams(n - 1)
    good = np.zeros(len(words.first) + 1, bool)
    good[shorter[_held(table, words.fingerprints(shorter, n - 1, 0) & mask)]] = True
    return at[good[at] & good[at + 1]]


def _rows(docs: DataFrame) -> DataFrame:
    """text (bytes), lang and key, 31 bits by which pointers name a document; documents that share a key are all read."""
    key = F.pmod(F.xxhash64("doc_id", "text", "lang"), F.lit(1 << 31))
    return docs.select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), key.alias("key"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray]]:
    for batch in slices(batches, "text", BLOCK):
        yield Words(batch.column("text").to_pylist(), batch.column("lang").to_pylist()), batch.column("key").to_numpy()


def _distinct(fps: np.ndarray, pointers: np.ndarray, counts: np.ndarray, apart: bool) -> list[np.ndarray]:
    """One row for each fingerprint (and second one if ``apart``) with its smallest pointer, one more for a larger pointer."""
    if not len(fps):
        return [fps, pointers, counts]
    order = np.lexsort((pointers, fps)) if apart else np.argsort(fps)
    fps, pointers, counts = fps[order], pointers[order], counts[order]
    new = fps[1:] != fps[:-1]
    if apart:
        new |= (pointers[1:] >> 32) != (pointers[:-1] >> 32)
    start = np.concatenate([[0], np.flatnonzero(new) + 1])
    low, high = np.minimum.reduceat(pointers, start), np.maximum.reduceat(pointers, start)
    more = low != high
    return [np.concatenate([fps[start], fps[start[more]]]), np.concatenate([low, high[more]]),
            np.concatenate([np.add.reduceat(counts, start), np.zeros(int(more.sum()), np.int64)])]


def _check(words: Words, at: np.ndarray, n: int) -> np.ndarray:
    return (words.fingerprints(at, n, 1) >> np.uint64(32)).view(np.int64) - (1 << 31)


def counts(rows: DataFrame, lengths: tuple[int, ...], least: int, table=None, mask: int = (1 << 64) - 1, among: DataFrame | None = None) -> DataFrame:
    """fp, low, high, n: fingerprints of n-grams that occur ``least`` times or more, with two pointers, written.

    ``table`` is a broadcast bit table of the frequent fingerprints that are one word shorter. With ``among`` (a
    column fp) only these fingerprints are counted, apart by their second one.
    """
    apart, keep = among is not None, np.uint64(mask)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else np.frombuffer(table.value, np.uint64)
        held, size = [], 0

        def flush():
            f, p, c = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)), apart)
            for i in range(0, len(f), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (f, p, c)], schema=COUNTED)

        for words, keys in _batches(batches):
            for n in lengths:
                at = _frequent_at(words, n, bits, keep)
                fps = (words.fingerprints(at, n, 0) & keep).view(np.int64)
                pointers = (_check(words, at, n) << 32) | keys[words.doc[at]]
                held.append(_distinct(fps, pointers, np.ones(len(at), np.int64), apart))
                size += len(held[-1][0])
            if size > GATHERED:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    out = rows.mapInArrow(count, "fp bigint, pointer bigint, n bigint")
    if apart:
        out = out.join(among, "fp", "left_semi").withColumn("check", F.shiftright("pointer", 32))
    by = ["fp", "check"] if apart else ["fp"]
    # Rows are distinct in their task already, so they are added up behind the shuffle only.
    out = out.repartition(*by).groupBy(*by).agg(F.sum("n").alias("n"), F.min("pointer").alias("low"), F.max("pointer").alias("high"))
    return cut_lineage(out.where(F.col("n") >= least).select("fp", "low", "high", "n"))


def bit_table(frequent: DataFrame):
    """A broadcast table of 2^TABLE_BITS bits, set where ``fp`` points to."""
    place = F.shiftrightunsigned("fp", 64 - TABLE_BITS)
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    told = frequent.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[told.column("cell").to_numpy()] = told.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(table.tobytes())


def texts(rows: DataFrame, frequent: DataFrame, lengths: tuple[int, ...], mask: int = (1 << 64) - 1) -> DataFrame:
    """fp, lang, words, phrase, pointer of frequent n-grams, read from the documents at both pointers."""
    keep = np.uint64(mask)
    wanted = frequent.select("fp", F.explode(F.array_distinct(F.array("low", "high"))).alias("pointer"))
    wanted = wanted.withColumn("key", F.expr("pointer & 2147483647")).groupBy("key").agg(F.collect_set(F.struct("fp", "pointer")).alias("wanted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            words = Words(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
            lists = batch.column("wanted")
            asked = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            fp, pointer = (asked.field(k).to_numpy() for k in ("fp", "pointer"))
            names = mixed(fp.view(np.uint64) ^ mixed(owner.astype(np.uint64) + np.uint64(1)))
            order = np.argsort(names)
            names, owner, fp, pointer = names[order], owner[order], fp[order], pointer[order]
            for n in lengths:
                at = words.grams(n)
                own = words.fingerprints(at, n, 0) & keep
                name = mixed(own ^ mixed(words.doc[at].astype(np.uint64) + np.uint64(1)))
                place = np.minimum(np.searchsorted(names, name), len(names) - 1)
                some = names[place] == name
                at, own, place = at[some], own[some].view(np.int64), place[some]
                check = _check(words, at, n)
                # Of one name there are few: the pointers to a document that its collided fingerprints have.
                found = {}
                while len(at):
                    same = (fp[place] == own) & (owner[place] == words.doc[at]) & ((pointer[place] >> 32) == check)
                    for p, i in zip(place[same].tolist(), at[same].tolist(), strict=True):
                        found.setdefault(p, i)
                    place = place + 1
                    more = place < len(names)
                    more[more] = names[place[more]] == names[place[more] - 1]
                    at, own, place, check = at[more], own[more], place[more], check[more]
                hit, where = np.array(list(found), np.int64), list(found.values())
                langs = [words.langs[d] for d in words.doc[where].tolist()] if where else []
                yield pa.RecordBatch.from_arrays([
                    pa.array(fp[hit]), pa.array(["und" if x is None else x for x in langs], pa.string()), pa.array(np.full(len(hit), n, np.int64)),
                    pa.array([words.text(i, n) for i in where], pa.binary()).cast(pa.string()), pa.array(pointer[hit]),
                ], schema=FOUND)

    met = rows.join(wanted, "key").select("text", "lang", "wanted")
    return met.mapInArrow(read, "fp bigint, lang string, words bigint, phrase string, pointer bigint").distinct()


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, fingerprint_bits: int = 64) -> DataFrame:
    """lang, words, phrase, f of all phrases of up to ``longest`` words that occur ``least`` times or more in a language.

    A row with words = 0 and an empty phrase counts all words of its language. Fewer ``fingerprint_bits`` only make
    collisions more frequent (for tests); the result stays the same.
    """
    rows = _rows(docs)
    mask = ((1 << fingerprint_bits) - 1) << (64 - fingerprint_bits)
    steps = [(0, 1), *((n,) for n in range(2, longest + 1))]
    frequent, tables = [], [None]
    for lengths in steps:
        frequent.append(counts(rows, lengths, least, tables[-1], mask))
        if lengths[-1] < longest:
            tables.append(bit_table(frequent[-1]))
    every = functools.reduce(DataFrame.unionByName, [f.withColumn("step", F.lit(i)) for i, f in enumerate(frequent)])
    lengths = tuple(range(longest + 1))
    found = cut_lineage(texts(rows, every, lengths, mask))
    # A fingerprint is told apart by the lengths it was counted with; what was read there must be one phrase.
    step = F.when(F.col("words") < 2, 0).otherwise(F.col("words") - 1).cast("int")
    phrase = F.struct("lang", "words", "phrase")
    one = found.groupBy("fp", step.alias("step")).agg(F.min(phrase).alias("a"), F.max(phrase).alias("b"))
    out = one.where("a = b").join(every, ["fp", "step"]).select("a.lang", "a.words", "a.phrase", F.col("n").alias("f"))
    collided = cut_lineage(one.where("a <> b").select("fp", "step"))
    for i in [r[0] for r in collided.select("step").distinct().collect()]:  # as many as lengths
        anew = counts(rows, steps[i], least, tables[i], mask, collided.where(F.col("step") == i).select("fp"))
        told = texts(rows, anew, steps[i], mask).join(anew.withColumnRenamed("n", "f").withColumnRenamed("low", "pointer"), ["fp", "pointer"])
        out = out.unionByName(told.select("lang", "words", "phrase", "f"))
    return out


def mine(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``longest`` words of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at spaces and tabs; null is
    empty, lang null is ``und``. A phrase that occurs ``least`` times or more scores floor(10^6 a^2 / (l r)), a being
    its count, l and r those of its parts at the lowest-scoring cut (ties: the earliest). It is dropped if it lies
    in a longer one with at least ``cover`` percent of its count. Equal scores go by count and then by bytes; repeated rows count each; an
    empty table, or one without frequent phrases, gives no rows. Other columns are not read.
    """
    phrases = cut_lineage(frequent_phrases(docs, longest, least))
    parts = phrases.where("words > 0").select("lang", "phrase", "f")
    many = phrases.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substr(phrase, length(head) + 2)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    big = "cast({} as decimal(19, 0))"
    score = F.expr(f"({big.format('a')} * {big.format('a')} * 1000000bd) div ({big.format('l')} * {big.format('r')})")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("words", "a", "l", "r", "score"), F.struct("score", "k")).alias("b"))
    best = best.select("lang", "phrase", "b.*")
    inner = [F.expr("substring_index(phrase, ' ', cast(words as int) - 1)"), F.expr("substr(phrase, instr(phrase, ' ') + 1)")]
    inside = many.where("words > 2").select("lang", F.explode(F.array(*inner)).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {cover} * a")
    # A language's phrases are ranked in parts first, so that one task gets the best of the parts only.
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
        left = left.withColumn("rank", rank).where(f"rank <= {top}")
    left = left.withColumn("rank", F.col("rank").cast("bigint"))
    total = phrases.where("words = 0").select("lang", F.col("f").alias("n"))
    return left.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine_sql(least: int = 10, cover: int = 50, top: int = 2000) -> str:
    """The same for phrases of up to three words as one DuckDB statement over ``documents``."""
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{LATIN_UPPER}', '{LATIN_LOWER}') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
        w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
            SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        o AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {least}),
        c AS MATERIALIZED (SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM o)),
        s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut,
            ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f)) AS score
            FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        i AS (SELECT lang, phrase, max(a) AS longer FROM (
            SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM o WHERE k = 3) GROUP BY ALL)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
            score::BIGINT AS score
        FROM b LEFT JOIN i USING (lang, phrase) JOIN n ON n.lang = b.lang
        WHERE longer IS NULL OR 100 * longer < {cover} * a
        QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) <= {top}"""
