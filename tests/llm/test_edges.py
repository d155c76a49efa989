"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute

import corpus_pipeline
from seqweave.llm import (
    embedding_join,
    language,
    mixing,
    ngram_jaccard,
    packing,
    perplexity,
    quality_rules,
    sharding,
    url_filter,
    warc,
)

WORDS = "the of and to in house river stone water light window paper green seven morning".split()
LONG = " ".join(WORDS[(i * i + i // 7) % len(WORDS)] + str(i % 997) for i in range(60_000))
PROSE = " ".join(WORDS[(3 * i + i // 5) % len(WORDS)] for i in range(120)) + "."
ROWS = [
    (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE + " end", "en", None), (3, None, "en", "a"), (4, "", None, "b"),
    (5, " \t\n ", "fr", "b"), (6, LONG, "en", "c"), (None, "where is the river", None, None), (None, None, None, None),
    (7, "1 2 3 4 5 6", "en", "c"), (8, "\u4e2d\u6587 <|endoftext|> \U0001f600", "zh", "c"), (9, "one", "en", "a"),
    (9, "two words", "fr", "a"), (10, PROSE.upper(), "en", "b"),
]
CLASHING = ("node", "component", "score", "lang_pred", "text_hash", "bytes", "row", "id", "size", "_id", "chance", "bin", "h")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return frame.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (6, 1, 0), (None, 1, None), (7, None, None), (3, 1, 0), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def key(r):
    return str(r)


def test_language(docs):
    got = language.identify(docs, spans=True).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(3, "und"), (4, "und"), (5, "und"), (7, "und")} <= by
    assert all(r.score == 0 and r.spans == [] for r in got if r.lang_pred == "und")
    empty = language.identify(docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "lang_pred", "score"]
    untaught = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r.size for r in got)
    sizes = {}
    for _, text, _, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    want = brute.targets(sizes)
    told = {(r.source_size, round(r.target, 6)) for r in got}
    assert told == {(sizes[s], round(want[s], 6)) for s in sizes}
    assert mixing.mix(docs.limit(0)).collect() == []
    blank = mixing.mix(docs.where("doc_id in (3, 4, 5)")).collect()
    assert [r.taken for r in blank] == [0, 0, 0] and [r.target for r in blank] == [0.0] * 3


def test_quality_rules(docs):
    got = quality_rules.judge(docs).collect()
    want = sorted((i, *brute.measures(t)) for i, t, _, _ in ROWS if i is not None)
    assert sorted(tuple(r)[:6] for r in got if r.doc_id is not None) == want
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_perplexity(docs, labels):
    got = perplexity.judge(docs, labels).collect()
    assert len(got) == len(ROWS)
    assert all((r.perplexity is None) == (not r.bytes) and not (r.kept and not r.bytes) for r in got)
    assert sum(r.bytes is None for r in got) == 3
    assert all(r.kept for r in got if r.doc_id == 1)
    assert perplexity.judge(docs.limit(0), labels).collect() == []
    untrusted = perplexity.judge(docs, labels.limit(0)).collect()
    assert len(untrusted) == len(ROWS)


def test_packing(docs):
    got = packing.pack(docs).collect()
    tokens = {}
    for r in got:
        tokens.setdefault(r.doc_id, []).append(r)
    assert {r.doc_tokens for r in tokens[3] + tokens[4] + tokens[5]} == {1}
    for doc, times in ((1, 2), (6, 1), (3, 1)):
        assert sum(r.length for r in tokens[doc]) == times * tokens[doc][0].doc_tokens
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in spans.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(docs.limit(0)).collect() == []


def test_ids_of_words_are_ids_of_texts():
    from tokenizers import Tokenizer

    content = packing.tokenizer_file()
    coder = Tokenizer.from_str(content)
    texts = [t for _, t, _, _ in ROWS if t and len(t) < 5000]
    texts += ["it's  we'll\u00a0\u2003x\x1cy", "A\u0301 e\u0301\u0301", "<|startoftext|>a <|endoftext|><|endoftext|>", "\u0130\u03a3 \u03a3"]
    ids, sizes = packing.WordTokens(content).of([t.encode() for t in texts])
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        assert ids[at : at + n].tolist() == [*coder.encode(text, add_special_tokens=False).ids, packing.END]
        at += n


def test_jaccard(docs):
    rows = [(i, t) for i, t, _, _ in ROWS]
    want = []
    for (i, t), got in zip(rows, brute.jaccard(rows), strict=True):
        want.append((got[0], got[1], i if not brute.words(t) else got[2]))
    got = ngram_jaccard.link_documents(docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert ngram_jaccard.link_documents(docs.limit(0)).collect() == []
    kept = ngram_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None)
    assert [i for i, _ in texts] == [1, 3, 4, 5, 6, 7, 8, 9, 9]
    assert {r.node for r in kept.collect()} == {"own node"}


def test_pages(spark):
    rows = [(1, None, None), (None, "http://a.net/x?y", None), (2, "http://A.net", "<a href='http://b.org'>"), (2, "http://A.net", "<a href='http://b.org'>"),
            (3, "", ""), (4, "x://", "http://" * 5000), (5, "http://b.org/fr/", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("own") for c in ("host", "path", "rule", "verdict", "value", "digest", "payload", "original")})
    got = sorted(url_filter.judge(pages).collect(), key=key)
    assert len(got) == len(rows)
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {
        (1, "", "", None, "allow"), (None, "a.net", "/x", "net/", "block"), (2, "a.net", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "", "", None, "allow"), (5, "b.org", "/fr/", "org/fr/", "allow")}
    assert url_filter.judge(pages.limit(0)).collect() == []
    read = warc.round_trip(pages).collect()
    assert sorted((r.page_id or 0, r.payload_bytes) for r in read) == sorted((i or 0, len((h or "").encode())) for i, _, h in rows)
    assert {r.record_type for r in read} == {"response"}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_join.link_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, None), (2, [0.0, 0.0], 1), (3, [1.0, 1.0], None), (3, [1.0, 1.0], None), (None, [2.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, schema).withColumns({c: F.lit("own") for c in ("node", "times", "vector", "size")})
    got = sorted(map(tuple, embedding_join.link_vectors(frame).collect()), key=key)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False)], key=key)


def test_sharding(docs):
    got = sharding.shards_of(docs, 500).collect()
    assert len(got) == len(ROWS)
    assert sharding.shards_of(docs.limit(0)).collect() == []


def test_stages_keep_columns_and_rows_whole(spark, docs, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) <= given, name
        if name != "source_mixing":
            assert len(rows) <= len(ROWS)
        assert stage(spark, docs.limit(0), folder).collect() == []
    assert corpus_pipeline.run(spark, folder).count() > 0


FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.exists(f"{FOLDER}/documents.parquet"), reason="no test tables")
def test_pipeline_stage_by_stage(spark):
    """Each stage's decisions against plain versions on what the one before kept."""
    from seqweave.session import cut_lineage

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    told = {r.doc_id: r.kept for r in perplexity.judge(docs, labels).collect()}
    first = cut_lineage(corpus_pipeline.quality_classifier(spark, docs, FOLDER))
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i, kept in told.items() if kept)
    second = cut_lineage(corpus_pipeline.language_id(spark, first, FOLDER))
    good = {r.doc_id for r in language.identify(first).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in second.collect()} == good
    third = cut_lineage(corpus_pipeline.ngram_jaccard_join(spark, second, FOLDER))
    groups = brute.jaccard([(r.doc_id, r.text) for r in second.collect()])
    assert sorted(r.doc_id for r in third.collect()) == sorted(i for i, n, c in groups if n == 0 or i == c)
    fourth = cut_lineage(corpus_pipeline.source_mixing(spark, third, FOLDER))
    sizes, taken, largest = {}, {}, {}
    for r in third.collect():
        n = len(brute.words(r.text))
        sizes[r.source] = sizes.get(r.source, 0) + n
        largest[r.source] = max(largest.get(r.source, 0), n)
    for r in fourth.collect():
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    for source, want in brute.targets(sizes).items():
        assert abs(taken.get(source, 0) - want) <= 2 * largest[source]
    total = {}
    for r in corpus_pipeline.window_packing(spark, fourth, FOLDER).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    times = {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    from tokenizers import Tokenizer

    coder = Tokenizer.from_str(packing.tokenizer_file())
    texts = {r.doc_id: r.text for r in fourth.collect()}
    assert total == {i: times[i] * (1 + len(coder.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
