"""Exact duplicates, collocations and lexical search against brute force, and their edge cases."""

import hashlib
import math
import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_edges import LONG, PROSE, ROWS, WORDS

from seqweave.llm import collocations, exact_dedup, lexical_search

CLASHING = ("digest", "place", "term", "cell", "fp", "key", "q", "score", "rank", "phrase", "lang_", "best", "kept", "_row", "_sha", "n", "f", "a")
MORE = [(100 + i, " ".join(WORDS[(i * j + j * j) % len(WORDS)] for j in range(40)) + ("." if i % 3 else "; the river"), ("en", "fr", None)[i % 3], "s") for i in range(60)]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS + MORE, "doc_id long, text string, lang string, source string")
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).repartition(5)


# --- exact duplicates -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 3, 1023])
def test_exact_dedup(spark, docs, most):
    copies = spark.range(2000, 2400).select(F.col("id").alias("doc_id"), F.lit("The same HOT text").alias("text"))
    rows = docs.select("doc_id", "text").unionByName(copies).repartition(7)
    got = exact_dedup.judge(rows, most).collect()
    groups = defaultdict(list)
    for r in rows.collect():
        groups[hashlib.sha256(lowered(r.text).encode()).hexdigest()].append(r.doc_id)
    assert len(got) == sum(map(len, groups.values()))
    low = lambda d: -1 if d is None else d
    for sha, ids in groups.items():
        mine = [r for r in got if r.text_sha256 == sha]
        best = max(ids, key=low)
        assert sorted(low(r.doc_id) for r in mine) == sorted(map(low, ids))
        assert {(r.keep_id, r.group_size) for r in mine} == {(best, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [best]
    heavy = {bytes(r.digest).hex() for r in exact_dedup.heavy(exact_dedup.digests(rows), most).collect()}
    total = sum(map(len, groups.values()))
    assert len(heavy) <= most and heavy >= {s for s, ids in groups.items() if len(ids) * (most + 1) > 2 * total}


def test_exact_dedup_keeps_whole_rows(docs):
    kept = exact_dedup.kept_rows(docs).collect()
    assert exact_dedup.kept_rows(docs).columns == docs.columns
    assert len(kept) == len({lowered(r.text) for r in docs.collect()})
    assert exact_dedup.judge(docs.limit(0)).collect() == [] and exact_dedup.kept_rows(docs.limit(0)).collect() == []


def test_summaries_fall_short_by_a_share_at_most():
    values = [x for x in "abcdefgh" for _ in range(ord(x) - 90)] + ["z"] * 50
    counters = {}
    for i in range(0, len(values), 7):
        counters = exact_dedup.summarise(counters, Counter(values[i : i + 7]), 4)
        assert len(counters) <= 4
    true = Counter(values)
    assert all(true[k] - len(values) / 5 <= counters.get(k, 0) <= true[k] for k in true)


# --- collocations -----------------------------------------------------------------------------------------------------


def phrases(rows, longest):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return f, n


def mined(rows, longest=3, least=10, cover=50, top=2000):
    f, n = phrases(rows, longest)
    many = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    longer = defaultdict(int)
    for (lang, w), v in many.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], v)
    out = defaultdict(list)
    for (lang, w), a in many.items():
        if 100 * longer[lang, w] >= cover * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


@pytest.mark.parametrize("longest, cover, top", [(3, 50, 2000), (4, 70, 15)])
def test_collocations(docs, longest, cover, top):
    got = {tuple(r) for r in collocations.mine(docs, longest, 3, cover, top).collect()}
    assert got == mined(ROWS + MORE, longest, 3, cover, top) and got


@pytest.mark.parametrize("bits", [2, 7])
def test_colliding_fingerprints_are_told_apart(docs, bits):
    got = {(r.lang, r.phrase): r.f for r in collocations.frequent_phrases(docs, 3, 4, bits).where("words > 0").collect()}
    f, _ = phrases(ROWS + MORE, 3)
    assert got == {(lang, " ".join(w)): v for (lang, w), v in f.items() if v >= 4}


def test_collocations_without_phrases(spark, docs):
    assert collocations.mine(docs.limit(0)).collect() == []
    assert collocations.mine(docs.where("doc_id in (3, 4, 5, 9)")).collect() == []
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.mine(docs.limit(0)).columns == names


def test_fingerprints_of_blocks_and_batches(monkeypatch):
    texts = [b"One  two\tthree. one two", None, b"", ("x" * 300 + " one two three").encode(), LONG[:5000].encode()]
    whole = collocations.Words(texts, ["en"] * 5)
    parts = [collocations.Words([t], ["en"]) for t in texts]
    for n in range(4):
        for which in (0, 1):
            want = [p.fingerprints(p.grams(n), n, which) for p in parts]
            got = whole.fingerprints(whole.grams(n), n, which)
            assert (got == np.concatenate(want)).all()
            with monkeypatch.context() as m:
                m.setattr(collocations, "BLOCK", 64)
                assert (whole.fingerprints(whole.grams(n), n, which) == got).all()
    at = whole.grams(3)
    said = [whole.text(i, 3) for i in at.tolist()]
    fps = whole.fingerprints(at, 3, 0).tolist()
    assert len(set(said)) == len(set(fps)) == len(set(zip(said, fps, strict=True)))
    assert (whole.fingerprints(at, 3, 0) != collocations.Words(texts, ["fr"] * 5).fingerprints(at, 3, 0)).all()


# --- lexical search ---------------------------------------------------------------------------------------------------


def ranked(rows, items, k=10):
    term = re.compile(lexical_search.TERM)
    bags = [(d, Counter(term.findall(lowered(t)))) for d, t, *_ in rows]
    held = [b for _, b in bags if b]
    n_docs, total = len(held), sum(sum(b.values()) for b in held)
    df = Counter(t for b in held for t in b)
    out = []
    for item, text in items:
        terms = set(term.findall(lowered(text)))
        scored = []
        for d, bag in bags:
            n = sum(bag.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * (10 + 90 * n * n_docs // total)))
                        for t in terms if bag[t])
            if score > 0:
                scored.append((-score, d is not None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


ITEMS = [(1, PROSE), (1, PROSE), (2, "River HOUSE, green!"), (3, None), (4, "  "), (5, "nowhere-to-be-found zzzz"), (None, "the"), (6, "中文"),
         (7, " ".join(WORDS) * 2), (8, LONG[:3000])]


@pytest.mark.parametrize("group", [500, 2])
def test_lexical_search(spark, docs, monkeypatch, group):
    monkeypatch.setattr(lexical_search, "QUERIES", group)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("q", F.lit("own")).withColumn("terms", F.lit(1))
    got = lexical_search.rank_documents(docs, items).collect()
    assert sorted([tuple(r) for r in got], key=str) == ranked(ROWS + MORE, ITEMS)


def test_lexical_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = lexical_search.rank_documents(docs.limit(0), items)
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.rank_documents(docs, items.limit(0)).collect() == []
    assert lexical_search.rank_documents(docs.where("text is null"), items).collect() == []


def test_blocks_are_skipped_by_exact_bounds(spark):
    rows = [(i, " ".join(f"w{i % 40}x{(i * j) % 9}" for j in range(30))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    n_docs, total = lexical_search.corpus_size(docs)
    cells = lexical_search.index(docs).toArrow().to_batches()
    group = lexical_search.Group(spark.createDataFrame([(1, [f"w3x{k}" for k in range(9)])], "item_id long, terms array<string>").collect())
    group.weight[:] = 1000
    search = lexical_search.Search(group, 10)
    for batch in cells:
        for a in range(0, batch.num_rows, lexical_search.STEP):
            search.look(batch.slice(a, lexical_search.STEP))
    assert search.scored < search.pairs and len(search.best[0]) == 10
    held = {c: [x for b in cells for row in b.column(c).to_pylist() for x in row] for c in ("ids", "docs", "tops", "impacts")}
    assert sorted(held["ids"]) == list(range(2000)) and sum(held["docs"]) == len(held["impacts"])
    at = 0
    for n, top in zip(held["docs"], held["tops"], strict=True):
        assert max(held["impacts"][at : at + n]) == top
        at += n


def test_search_holds_few_cells(spark, docs, monkeypatch):
    """Parquet's reader holds as few rows of the index as Arrow, and both are as before afterwards."""
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    read, seen, searched = lambda: [spark.conf.get(n) for n in names], [], lexical_search._searched
    monkeypatch.setattr(lexical_search, "_searched", lambda *a: seen.append(read()) or searched(*a))
    before = read()
    assert lexical_search.rank_documents(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count()
    assert seen == [[str(lexical_search.CELLS)] * 2] and read() == before and lexical_search.CELLS <= 16


# --- language paths ---------------------------------------------------------------------------------------------------


def test_language_path_of_half_and_half_texts():
    from seqweave.llm import language

    rng = np.random.default_rng(0)
    texts, penalty = [], 8.0
    first = np.tile([0.0, -2.0, -1.0], (7, 1))
    first[0, 2] = -0.9
    texts.append(np.vstack([first, np.tile([-2.0, 0.0, -1.0], (7, 1))]))
    for _ in range(400):
        n = rng.integers(10, 31)
        a, b = rng.choice(3, 2, replace=False)
        s = rng.normal(size=(n, 3)) * 0.4
        s[: n // 2, a] += rng.uniform(0, 1.5)
        s[n // 2 :, b] += rng.uniform(0, 1.5)
        s[:, 3 - a - b] += rng.uniform(0, 1.0)
        texts.append(s)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    labels = language.path(np.vstack(texts), begins, sizes, penalty)
    for s, b, n in zip(texts, begins.tolist(), sizes.tolist(), strict=True):
        value = s[0].copy()
        for row in s[1:]:
            value = np.maximum(value, value.max() - penalty) + row
        path = labels[b : b + n]
        assert s[np.arange(n), path].sum() - penalty * (path[1:] != path[:-1]).sum() == pytest.approx(value.max())
