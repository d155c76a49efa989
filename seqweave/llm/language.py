"""Language identification of mixed-language text: scripts, word scores and a Viterbi path.

Training adds up, per language, hashed letter trigrams of whole words and the
letters of each script; both tables have a fixed size per language, are made per
task and summed piece by piece. A word is scored only for the languages whose
training text uses its script; its scores are log likelihoods below the best
candidate's, cut off at ``FLOOR``. The labels of a text's words are the path of
highest total score, each change of language costing ``PENALTY``.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import slices, whole_row, with_text, words_of
from seqweave.session import cut_lineage

#: Hashed trigrams of a language, in pieces; most languages that a model may have.
BUCKETS, PIECES, LANGUAGES = 1 << 16, 16, 256
#: Bytes of text that a task labels at once, different words whose counts it holds, and words it takes apart at once.
TAKEN, HELD, WORDS = 1 << 20, 300_000, 32_768
#: Added to each count; lowest score of a word; price of a change of language.
ALPHA, FLOOR, PENALTY = 0.1, -4.0, 8.0
#: Share of a language's letters that a script needs for the language to be a candidate of its words.
SCRIPT_SHARE = 0.005
#: First code points of script ranges (fixed values): after each comes its script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"),
    (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
STARTS = np.array([at for at, _ in SCRIPTS])
KINDS = np.array([NAMES.index(name) for _, name in SCRIPTS])


def letters_of(words: list[bytes]) -> list[str]:
    """The lower-cased letters of each word."""
    out = []
    for word in words:
        text = word.decode("utf-8", "replace")
        text = text if text.isalpha() else "".join(filter(str.isalpha, text))
        out.append(text.lower() if text else text)
    return out


def features(letters: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams and scripts of words: word index and bucket of every trigram, number of letters and script of every word.

    A word's script is that of most of its letters; -1 for a word without letters.
    """
    joined = "".join(f"\x02{w}\x03" for w in letters)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in letters], np.int64)
    ends = np.cumsum(sizes + 2)
    where = np.repeat(np.arange(len(letters)), sizes)
    middle = np.arange(len(where)) + 2 * where + 1
    code = points[middle - 1] * 0x1F1F1F1F + points[middle] * 0x2545F491 + points[middle + 1] * 0x5BD1E995
    bucket = ((code ^ (code >> 17)) * 0x9E3779B1 >> 13) & (BUCKETS - 1)
    kind = KINDS[np.searchsorted(STARTS, points[middle], "right") - 1]
    script = np.full(len(letters), -1)
    votes = np.bincount(where * len(NAMES) + kind, minlength=len(letters) * len(NAMES)).reshape(-1, len(NAMES))
    script[sizes > 0] = votes[sizes > 0].argmax(1)
    assert not len(ends) or ends[-1] == len(points)
    return where, bucket, sizes, script


class Model:
    """Languages in order, their trigram log probabilities, and which of them are candidates of each script."""

    def __init__(self, languages: list[str], logs: np.ndarray, candidates: np.ndarray):
        self.languages, self.logs, self.candidates = languages, logs, candidates

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (0 at best, ``FLOOR`` at worst) of the words for each language, and their numbers of letters."""
        if len(words) > WORDS:
            parts = [self.scores(words[at : at + WORDS]) for at in range(0, len(words), WORDS)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        where, bucket, sizes, script = features(letters_of(words))
        out = np.zeros((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(where, self.logs[k][bucket], minlength=len(words))
        allowed = self.candidates[script]
        out[~allowed] = -np.inf
        best = out.max(1, keepdims=True, initial=-np.inf)
        out = np.maximum(out - np.where(np.isfinite(best), best, 0.0), FLOOR)
        out[(script < 0) | ~allowed.any(1)] = 0.0
        return out, sizes


def train(docs: DataFrame) -> Model:
    """Model of the texts (binary ``text``) by ``lang``; rows with either null teach nothing.

    Needs ``BUCKETS`` counters a language; more than ``LANGUAGES`` languages are refused.
    """

    def work(batches):
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def settle():
            for lang, seen in words.items():
                each = iter(seen.items())
                while some := list(islice(each, WORDS)):
                    where, bucket, sizes, script = features(letters_of([w for w, _ in some]))
                    times = np.array([n for _, n in some], np.int64)
                    table = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    table += np.bincount(bucket, times[where], minlength=BUCKETS).astype(np.int64)
                    table = scripts.setdefault(lang, np.zeros(BUCKETS // PIECES, np.int64))
                    known = script >= 0
                    table += np.bincount(script[known], (times * sizes)[known], minlength=len(table)).astype(np.int64)
                if not seen:  # a language whose texts have no words is known all the same
                    counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    scripts.setdefault(lang, np.zeros(BUCKETS // PIECES, np.int64))
            words.clear()

        held = 0
        for batch in slices(batches, "text", TAKEN):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = words.setdefault(lang, Counter())
                held -= len(seen)
                seen.update(words_of(text))
                held += len(seen)
                if held > HELD:
                    settle()
                    held = 0
        settle()
        for lang, table in counts.items():
            parts = [*np.split(table, PIECES), scripts[lang]]
            yield pa.RecordBatch.from_pydict({
                "lang": [lang] * len(parts), "piece": pa.array(range(len(parts)), pa.int32()),
                "counts": [p.tobytes() for p in parts],
            })

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for lang, piece, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums[lang, piece] = np.frombuffer(counts, np.int64) + sums.get((lang, piece), 0)
        for (lang, piece), v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "piece": pa.array([piece], pa.int32()),
                                              "counts": [v.tobytes()]})

    form = "lang string, piece int, counts binary"
    made = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(work, form)
    summed = cut_lineage(made.repartition("lang", "piece").mapInArrow(add, form))
    languages = sorted(r["lang"] for r in summed.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    at = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((len(languages), PIECES + 1, BUCKETS // PIECES))
    for r in summed.toLocalIterator():  # at most LANGUAGES tables of fixed size
        counts[at[r["lang"]], r["piece"]] = np.frombuffer(r["counts"], np.int64)
    scripts = counts[:, PIECES, : len(NAMES)]
    counts = counts[:, :PIECES].reshape(len(languages), BUCKETS) + ALPHA
    logs = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    candidates = (share >= SCRIPT_SHARE).T.copy()
    return Model(languages, logs, np.vstack([candidates, np.ones(len(languages), bool)]))


def path(scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Label of every word: the path of highest score in each text, changes of label costing ``penalty``.

    A text keeps its best single label when no other label gains more than one
    penalty over any stretch of words, and no two more than one together over a
    beginning and an end. A path of k changes has such a beginning, such an end
    and k - 1 stretches between, so it can't pay. Only the others go step by step,
    all texts of the batch at once. Ties stay with the label held.
    """
    labels = np.zeros(len(scores), np.int64)
    if not len(scores) or scores.shape[1] < 2:
        return labels
    text = np.repeat(np.arange(len(sizes)), sizes)
    totals = np.add.reduceat(scores, begins)
    own = totals.argmax(1)
    labels[:] = own[text]
    gain = scores - np.take_along_axis(scores, labels[:, None], 1)
    room = 4.0 * (abs(gain).max() + 1.0) * (sizes.max() + 1)  # lowers each text below all before it
    so_far = np.cumsum(gain, 0)
    so_far -= (so_far[begins] - gain[begins])[text]
    whole = so_far[begins + sizes - 1]
    start = np.maximum.reduceat(so_far.max(1), begins)
    end = np.maximum.reduceat((whole[text] - so_far + gain).max(1), begins)
    so_far -= room * text[:, None]
    best = np.maximum.reduceat((so_far - np.minimum.accumulate(so_far - gain, 0)).max(1), begins)
    mixed = np.flatnonzero((best > penalty) | (np.maximum(start, 0) + np.maximum(end, 0) > penalty))
    if not len(mixed):
        return labels
    mixed = mixed[np.argsort(-sizes[mixed], kind="stable")]
    start, size = begins[mixed], sizes[mixed]
    kinds = np.arange(scores.shape[1])
    back = np.zeros(scores.shape, np.int16)
    value = scores[start].copy()
    longer = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts with more than t words
    for t in range(1, size[0]):
        k = longer[t]
        held, at = value[:k], start[:k] + t
        top = held.argmax(1)
        jump = held[np.arange(k), top] - penalty
        moves = jump[:, None] > held
        back[at] = np.where(moves, top[:, None], kinds)
        value[:k] = np.where(moves, jump[:, None], held) + scores[at]
    now = value.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        k = longer[t]
        at = start[:k] + t
        labels[at] = now[:k]
        now[:k] = back[at, now[:k]]
    return labels


def predict(docs: DataFrame, model: Model, spans: bool = False, penalty: float = PENALTY) -> DataFrame:
    """``docs`` columns but the binary ``text``, with lang_pred, score and (on request) spans.

    Without a column ``text`` it is read from the struct ``row``, so that it travels once and comes back in its row.
    lang_pred is the language of most letters on the path, ties to the smaller name, and score its share of the
    letters; ``und`` with score 0 for null text and text without letters. spans: first and last word and language.
    """
    names = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs, model.candidates))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
    apart = "text" in docs.columns

    def work(batches):
        mine = Model(*shared.value)
        known: dict[bytes, int] = {}
        table, letters = np.zeros((0, len(mine.languages))), np.zeros(0, np.int64)
        for batch in slices(batches if apart else with_text(batches), "text", TAKEN):
            texts = [words_of(t) if t else [] for t in batch.column("text").to_pylist()]
            if len(known) > 400_000:
                known, table, letters = {}, table[:0], letters[:0]
            fresh = list({w for words in texts for w in words if w not in known})
            if fresh:
                known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                more, sizes = mine.scores(fresh)
                table, letters = np.concatenate([table, more]), np.concatenate([letters, sizes])
            every = [w for words in texts for w in words]
            ids = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
            lengths = np.array([len(w) for w in texts], np.int64)
            full = np.flatnonzero(lengths)
            sizes = lengths[full]
            begins = np.cumsum(sizes) - sizes
            labels = path(table[ids], begins, sizes, penalty) if mine.languages else np.zeros(len(ids), np.int64)
            width = max(1, len(mine.languages))
            text = np.repeat(full, sizes)
            share = np.bincount(text * width + labels, letters[ids], minlength=len(texts) * width)
            share = share.reshape(len(texts), width)
            total, top = share.sum(1), share.argmax(1)
            said = total > 0 if mine.languages else np.zeros(len(texts), bool)
            named = [mine.languages[k] if ok else "und" for k, ok in zip(top, said, strict=True)]
            score = np.where(said, share.max(1) / np.maximum(total, 1), 0.0)
            columns = [*(batch.column(c) for c in names), pa.array(named, pa.string()), pa.array(score)]
            if spans:
                parts: list[list] = [[] for _ in texts]
                for i, b, n in zip(full, begins, sizes, strict=True):
                    if not said[i]:
                        continue
                    run = labels[b : b + n]
                    cut = np.r_[0, np.flatnonzero(run[1:] != run[:-1]) + 1, n]
                    parts[i] = [{"first": int(x), "last": int(y) - 1, "lang": mine.languages[run[x]]}
                                for x, y in zip(cut[:-1], cut[1:], strict=True)]
                columns.append(pa.array(parts, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", *["spans"] * spans])

    form = f"{kinds}{', ' if kinds else ''}lang_pred string, score double"
    form += ", spans array<struct<first: bigint, last: bigint, lang: string>>" if spans else ""
    return docs.select(*names, *["text"] * apart).mapInArrow(work, form)


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, spans: bool = False, penalty: float = PENALTY) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (spans on request).

    Learns from the text and lang of documents that are not held out (a null
    doc_id is neither held out nor learned from) and predicts from texts alone.
    Repeated rows give repeated results; other columns are not read. Without
    anything to learn from every document is ``und``.
    """
    text = F.col("text").cast("binary").alias("text")
    taught = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(text, "lang")
    model = train(taught)
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text)
    return predict(asked, model, spans, penalty)


def kept_rows(docs: DataFrame, least: float = 0.5, penalty: float = PENALTY) -> DataFrame:
    """Rows of ``docs`` with a language that holds at least ``least`` of the letters, columns as they are."""
    text = F.col("text").cast("binary")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(text.alias("text"), "lang"))
    told = predict(docs.select(whole_row(docs)), model, penalty=penalty)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
