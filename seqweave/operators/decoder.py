"""Sequence-model calls read through a learned cluster-to-family table.

A call is a short list of (cluster, probability). ``mass`` collects, per family
actually present, the probability put on each cluster; dividing by the cluster's
total gives P(family | cluster).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.operators.graph import top_k


def call_rows(calls: DataFrame, *keep: str) -> DataFrame:
    """One row per (call, cluster)."""
    return calls.select(*keep, F.explode("top").alias("_t")).select(
        *keep, F.col("_t.cluster").alias("cluster"), F.col("_t.p").alias("p")
    )


def decoder(calls: DataFrame, *by: str) -> DataFrame:
    """by..., cluster, family, mass and weight = P(family | cluster)."""
    mass = (
        call_rows(calls, *by, "family")
        .groupBy(*by, "cluster", "family")
        .agg(F.sum("p").alias("mass"))
    )
    total = mass.groupBy(*by, "cluster").agg(F.sum("mass").alias("total"))
    return mass.join(total, [*by, "cluster"]).withColumn(
        "weight", F.col("mass") / F.greatest("total", F.lit(1e-12))
    )


def readings(table: DataFrame, min_mass: float = 1.0) -> DataFrame:
    """The family a cluster reads as, for clusters with at least ``min_mass``."""
    best = F.min(F.struct((-F.round("mass", 9)).alias("m"), F.col("family").alias("f")))
    return (
        table.where(F.col("total") >= min_mass)
        .groupBy("cluster")
        .agg(best["f"].alias("read"), (F.max("mass") / F.max("total")).alias("clarity"))
    )


def family_weights(
    table: DataFrame, min_mass: float = 0.5, min_share: float = 0.05, k: int = 12
) -> DataFrame:
    """Per family the clusters that read as it, strongest first."""
    kept = table.where((F.col("mass") >= min_mass) & (F.col("weight") >= min_share))
    return top_k(kept, ["family"], [F.desc(F.round("weight", 9)), F.col("cluster")], k)


def decode(calls: DataFrame, half_decoder: DataFrame) -> DataFrame:
    """Read every call with the table learned on the other half of the genomes.

    genome, pos, half, best (family of the highest summed probability), hit and
    p_true (what the reading gives the family actually there; 0 = unread).

    Calls with the same list are read once: two 64-bit hashes of the list are the
    join key back, so a frequent context costs one row, not one per gene, and no
    row of a cluster or a family carries the list.
    """
    key = ["half", "_a", "_b"]
    keyed = calls.withColumns({"_a": F.xxhash64("top"), "_b": F.xxhash64(F.lit(1), "top")})
    other = half_decoder.select(
        (1 - F.col("half")).alias("half"), "cluster", F.col("family").alias("read"), "weight"
    )
    scores = (
        call_rows(keyed.select(*key, "top").distinct(), *key)
        .join(other, ["half", "cluster"])
        .groupBy(*key, "read")
        .agg(F.sum(F.col("p") * F.col("weight")).alias("score"))
    )
    # a list reads as at most the families of its few clusters, so they fit one row
    read = scores.groupBy(*key).agg(
        F.min(F.struct((-F.round("score", 9)).alias("s"), F.col("read").alias("f")))["f"].alias("best"),
        F.map_from_entries(F.collect_list(F.struct("read", "score"))).alias("_reads"),
    )
    rest = [c for c in calls.columns if c not in ("half", "top")]
    return (
        keyed.join(read, key, "left")
        .select("half", "top", *rest, "best", "_reads")
        .withColumn("p_read", F.element_at("_reads", F.col("family")))
        .drop("_reads")
        .withColumn("hit", F.coalesce(F.col("best") == F.col("family"), F.lit(False)))
        .withColumn("p_read", F.coalesce("p_read", F.lit(0.0)))
    )


def perplexity(p_read: Column, p_last: Column) -> Column:
    """2 ** mean(-log2 p); an unread call counts at the last listed probability."""
    p = F.greatest(F.when(p_read > 0, p_read).otherwise(p_last), F.lit(1e-12))
    return F.pow(F.lit(2.0), F.avg(-F.log2(p)))


def call_summary() -> list[Column]:
    """Columns of the per-locus / per-class tables, over decoded calls."""
    last = F.element_at("top", -1)["p"]
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("rank_true") == 1).cast("double")).alias("top1"),
        F.avg(F.col("hit").cast("double")).alias("top1_dec"),
        F.percentile("rank_true", F.lit(0.5)).alias("med_rank"),
        F.avg("entropy").alias("entropy"),
        perplexity(F.col("p_read"), last).alias("ppl"),
        F.avg((F.col("p_read") == 0).cast("double")).alias("unread"),
    ]


def mean_calls(calls_after: DataFrame, k: int = 8) -> DataFrame:
    """Mean call after each family over its carriers: ``prev``, cluster, p; the ``k`` best."""
    n = calls_after.groupBy("prev").agg(F.count(F.lit(1)).alias("n"))
    total = call_rows(calls_after, "prev").groupBy("prev", "cluster").agg(F.sum("p").alias("s"))
    mean = total.join(n, "prev").select("prev", "cluster", (F.col("s") / F.col("n")).alias("p"))
    return top_k(mean, ["prev"], [F.desc(F.round("p", 9)), F.col("cluster")], k)
