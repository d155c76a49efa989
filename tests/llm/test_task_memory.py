"""What a task of the language and perplexity stages holds at once doesn't grow with its Arrow batches."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqweave.llm import language, ngram_jaccard, perplexity
from seqweave.llm.common import whole_row


class Task:
    """Stands for a frame and keeps the function that ``mapInArrow`` is given."""

    def __init__(self, **columns):
        self.columns = list(columns)
        self.schema = [SimpleNamespace(name=n, dataType=SimpleNamespace(simpleString=lambda k=k: k)) for n, k in columns.items()]
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def select(self, *_):
        return self

    where = groupBy = agg = select

    def mapInArrow(self, work, form):
        self.work = work
        return self

    def repartition(self, *_):
        raise InterruptedError


def batch(n, **more):
    rng = np.random.default_rng(3)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (150_000, 7))])
    texts = [" ".join(rng.choice(words, 500)).encode() for _ in range(n)]
    return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary()), **{k: [v] * n for k, v in more.items()}})


def peak_mb(work, rows):
    tracemalloc.start()
    for _ in work(iter([rows])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def model(languages=4):
    logs = np.random.default_rng(1).normal(-8, 1, (languages, language.BUCKETS)).astype(np.float32)
    return language.Model([f"l{k}" for k in range(languages)], logs, np.ones((len(language.NAMES) + 1, languages), bool))


def test_labelling_holds_little():
    docs = Task(doc_id="bigint", text="binary")
    language.predict(docs, model())
    assert peak_mb(docs.work, batch(1500, doc_id=1).select(["doc_id", "text"])) < 130


def test_training_holds_little():
    docs = Task(text="binary", lang="string")
    with pytest.raises(InterruptedError):
        language.train(docs)
    assert peak_mb(docs.work, batch(1500, lang="x")) < 90


def test_counting_bytes_holds_little(monkeypatch):
    monkeypatch.setattr(perplexity, "F", SimpleNamespace(sum=lambda c: SimpleNamespace(alias=lambda n: c)))
    docs = Task(text="binary")
    perplexity.ngram_counts(docs, 3)
    assert peak_mb(docs.work, batch(1500)) < 90


def test_labels_are_the_same_from_a_row(spark):
    rows = spark.createDataFrame([(1, "the cat"), (2, None), (3, ""), (4, "le chat"), (4, "le chat")], "doc_id long, text string")
    told = model()
    apart = language.predict(rows.select("doc_id", F.col("text").cast("binary").alias("text")), told)
    within = language.predict(rows.select(whole_row(rows)), told)
    names = ["doc_id", "lang_pred", "score"]
    assert sorted(apart.select(names).collect()) == sorted(within.select("row.doc_id", *names[1:]).collect())
    assert sorted(str(r) for r in within.select("row.*").collect()) == sorted(str(r) for r in rows.collect())


class Column:
    def __getattr__(self, _):
        return lambda *a, **k: Column()


def test_cutting_into_shingles_holds_little(monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "F", Column())

    def first(_):
        raise InterruptedError

    monkeypatch.setattr(ngram_jaccard, "cut_lineage", first)
    docs = Task(doc_id="bigint", text="binary")
    with pytest.raises(InterruptedError):
        ngram_jaccard.classes(docs, 5)
    assert peak_mb(docs.work, batch(1500, doc_id=1)) < 120
    docs = Task(text="binary")
    ngram_jaccard.postings(docs, np.ones(ngram_jaccard.BUCKETS, np.int64), 5, 80)
    assert peak_mb(docs.work, batch(1500).select(["text"])) < 120


def test_one_of_each_keeps_rows_as_they_are(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(2, text, "a"), (1, text.upper(), "b"), (1, text.upper(), "b"), (3, None, "c"), (4, " ", None), (5, "other words", "d")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    kept = ngram_jaccard.one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect())) == [(1, text.upper(), "b"), (3, None, "c"), (4, " ", None), (5, "other words", "d")]
