"""Tiled operators give the same result for every tile size, also with one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from seqweave.operators import tiling as T


def skewed(spark):
    """One genome holds most rows; values repeat and some are null."""
    rnd = random.Random(7)
    rows = []
    for genome, n in ((1, 400), (2, 30), (3, 1), (4, 11)):
        for pos in range(n):
            rows.append((genome, pos, n, rnd.choice("abc"), rnd.randrange(5), rnd.random() < 0.2))
    return rows, spark.createDataFrame(rows, "genome bigint, pos bigint, length bigint, family string, v bigint, flag boolean")


@pytest.mark.parametrize("size", [1, 3, 17, 65536])
def test_neighbours_and_sums(spark, size):
    rows, df = skewed(spark)
    out = T.over_tiles(
        df, ["genome"], lambda w: {"p": F.lag("family", 2).over(w), "n": F.lead("family").over(w)}, before=2, after=1, size=size
    )
    out = T.running_sum(out, ["genome"], F.col("v"), "cum", size=size)
    out = T.carry_last(out, ["genome"], F.when(F.col("flag"), F.col("pos")), "seen", size=size)
    out = T.carry_last(out, ["genome"], F.when(F.col("flag"), F.col("pos")), "next_seen", size=size, reverse=True)
    got = {(r.genome, r.pos): (r.p, r.n, r.cum, r.seen, r.next_seen) for r in out.collect()}
    by = {}
    for g, pos, _, fam, v, flag in rows:
        by.setdefault(g, []).append((fam, v, flag))
    assert len(got) == len(rows)
    for g, seq in by.items():
        cum, seen = 0, None
        for i, (fam, v, flag) in enumerate(seq):
            cum += v
            seen = i if flag else seen
            ahead = next((j for j in range(i, len(seq)) if seq[j][2]), None)
            want = (seq[i - 2][0] if i > 1 else None, seq[i + 1][0] if i + 1 < len(seq) else None, cum, seen, ahead)
            assert got[(g, i)] == want


@pytest.mark.parametrize("pieces", [1, 7, 700])
def test_numbering_in_pieces(spark, pieces):
    rows, df = skewed(spark)
    shuffled = df.withColumn("t", F.col("pos") * 3 + 1).repartition(5, F.rand(1)).drop("length")
    out = T.number_rows(shuffled, ["genome"], ["t"], F.floor(F.col("t") / (2000 // pieces)), "k", "length").collect()
    assert len(out) == len(rows)
    assert all(r.k == r.pos for r in out)
    assert {(r.genome, r.length) for r in out} == {(1, 400), (2, 30), (3, 1), (4, 11)}


def test_islands_cover_all_rows(spark):
    rows, df = skewed(spark)
    starts = lambda w: ~F.col("family").eqNullSafe(F.lag("family").over(w))
    small = {(r.genome, r.pos, r.island) for r in T.islands(df, ["genome"], starts, size=4).collect()}
    large = {(r.genome, r.pos, r.island) for r in T.islands(df, ["genome"], starts).collect()}
    assert small == large and len(small) == len(rows)


def test_unroll_gives_full_surroundings(spark):
    df = spark.createDataFrame([(g, p, n) for g, n in ((1, 3), (2, 10)) for p in range(n)], "genome bigint, pos bigint, length bigint")
    out = T.unroll_circular(df, before=5, after=4).groupBy("genome").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("d")
    )
    assert {(r.genome, r.lo, r.hi, r.n, r.d) for r in out.collect()} == {(1, -5, 6, 12, 12), (2, -5, 13, 19, 19)}


def test_grouped_quantile_is_exact(spark):
    import numpy as np

    rnd = random.Random(3)
    data = {k: [round(rnd.gauss(0, 5), 2) for _ in range(n)] for k, n in (("a", 301), ("b", 2), ("c", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    bounds = T.value_bounds(df, "v", 16)
    for q in (0.0, 0.25, 0.5, 0.999, 1.0):
        got = {r.k: r.x for r in T.grouped_quantile(df, ["k"], "v", q, "x", bounds).collect()}
        for k, vs in data.items():
            assert got[k] == pytest.approx(np.quantile(vs, q), abs=1e-9)
