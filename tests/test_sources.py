"""Readers, writers and the shard stream on small files."""

import json

from pyspark.sql import functions as F

from seqweave.operators.graph import edges
from seqweave.sources import readers as R
from seqweave.sources import writers as W
from seqweave.streaming import shards

RECORD = """LOCUS       {acc}  100 bp DNA circular
SOURCE      x
  ORGANISM  Escherichia coli K-12
FEATURES             Location/Qualifiers
     gene            5..40
                     /gene="dnaN"
     CDS             complement(join(50..70,80..90))
                     /gene="dnaN"
                     /product="sliding
                     clamp"
                     /translation="MKF
                     TV"
     CDS             5..40
                     /product="no protein"
     CDS             10..40
                     /gene="dnaA"
                     /translation="MSL"
ORIGIN
        1 acgt
//
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gbk").write_text(RECORD.format(acc="A1") + RECORD.format(acc="B2"))
    rows = sorted(tuple(r) for r in R.read_genbank(spark, str(tmp_path)).select(
        "acc", "idx", "start", "end", "strand", "gene", "product", "protein", "organism").collect())
    org = "Escherichia coli K-12"
    want = [(a, *r, org) for a in ("A1", "B2") for r in (
        (0, 10, 40, "+", "dnaA", "", "MSL"), (1, 50, 90, "-", "dnaN", "sliding clamp", "MKFTV"))]
    assert rows == want


def test_map_features_and_lines(spark, tmp_path):
    doc = {"cgview": {"features": [{"name": "r1", "type": "RGP", "start": 3, "stop": 9, "strand": 1}, {"name": "g", "type": "gene", "start": 1, "stop": 2, "strand": -1}]}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    rows = R.read_map_features(spark, str(tmp_path / "m.json")).where("type = 'RGP'").collect()
    assert [(r.name, r.start, r.stop) for r in rows] == [("r1", 3, 9)]
    (tmp_path / "p.txt").write_text("".join(f"P{i}\n" for i in range(1000)))
    lines = R.read_numbered_lines(spark, str(tmp_path / "p.txt"))
    assert lines.where(F.concat(F.lit("P"), F.col("id").cast("string")) != F.col("line")).count() == 0
    assert lines.count() == 1000


def test_shards_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i) for i in range(9)], "shard int, v bigint")
    out = str(tmp_path / "t")
    W.write_missing(df.where("shard < 2"), out, "shard")
    changed = df.withColumn("v", F.col("v") + 100)
    assert {r.shard for r in W.missing_shards(changed, out, "shard").collect()} == {2}
    W.write_missing(changed, out, "shard")
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [0, 1, 3, 4, 6, 7, 102, 105, 108]


def test_documents_and_csv(spark, tmp_path):
    nodes = spark.createDataFrame([("w", "b", 2, None), ("w", "a", 1, "x")], "window string, id string, n bigint, label string")
    edge = spark.createDataFrame([("w", "a", "b", 1)], "window string, s string, t string, n bigint")
    doc = json.loads(W.graph_documents(nodes, edge).first().document)
    assert doc == {"nodes": [{"id": "a", "n": 1, "label": "x"}, {"id": "b", "n": 2}], "edges": [{"s": "a", "t": "b", "n": 1}]}
    W.write_ranked_csv(nodes.select("n", "id"), str(tmp_path / "c"), "n")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == [("1", "a"), ("2", "b")]


def test_stream_of_shards_equals_one_batch(spark, tmp_path):
    rows = [(g, p, "abc"[(g * p + p) % 3]) for g in range(6) for p in range(5)]
    df = spark.createDataFrame(rows, shards.GENES)
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    df.where("genome < 3").coalesce(1).write.parquet(src)
    shards.stream_edges(spark, src, out, ck).awaitTermination(60)
    df.where("genome >= 3").coalesce(1).write.mode("append").parquet(src)
    shards.stream_edges(spark, src, out, ck).awaitTermination(60)
    take = lambda d: sorted((r.prev, r.family, r.n, r.genomes) for r in d.collect())
    assert take(shards.current_edges(spark, out)) == take(edges(df))


def test_request_counts(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:30' + make_interval(0,0,0,0,0,i,0) AS ts, 'c' AS client FROM (SELECT explode(sequence(0, 4)) AS i)")
    rows = shards.request_counts(df, "2 minutes", "1 minute").collect()
    assert sorted(r.requests for r in rows) == [1, 1, 2, 2, 2, 2]
