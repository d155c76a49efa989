"""Variation graph: nodes are families at a column, edges are weighted adjacencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators.tiling import TILE, over_tiles


def adjacencies(genes: DataFrame, size: int = TILE) -> DataFrame:
    """Each gene with the family before it (``prev``) and after it (``next``)."""
    return over_tiles(
        genes,
        ["genome"],
        lambda w: {"prev": F.lag("family").over(w), "next": F.lead("family").over(w)},
        before=1,
        after=1,
        size=size,
    )


def edges(genes: DataFrame) -> DataFrame:
    """prev, family, adjacencies ``n`` and the number of genomes holding one."""
    per_genome = (
        adjacencies(genes)
        .where(F.col("prev").isNotNull())
        .groupBy("prev", "family", "genome")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_genome.groupBy("prev", "family").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("genomes")
    )


def mode_by(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent ``value`` per ``key``; the smallest of the tied ones."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best["v"].alias(out))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first ``k`` rows per key. The rank is the only window, so each task keeps
    at most ``k`` rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(place, F.row_number().over(window)).where(F.col(place) <= k)


def top_successors(edge_table: DataFrame, k: int = 5) -> DataFrame:
    """Per family its ``k`` most frequent successors as one ``next`` list."""
    ranked = top_k(
        edge_table.select(F.col("prev").alias("family"), F.col("family").alias("next"), "n"),
        ["family"],
        [F.desc("n"), F.col("next")],
        k,
    )
    listed = F.array_sort(F.collect_list(F.struct("place", "next", "n")))
    return ranked.groupBy("family").agg(
        F.array_join(
            F.transform(listed, lambda x: F.concat_ws(":", x["next"], x["n"].cast("string"))), ","
        ).alias("next")
    )


def cross_half_successor_calls(genes: DataFrame, min_share: float = 0.05) -> DataFrame:
    """Predict each gene by the most frequent successor, in the other half of the
    genomes, of the family before it.

    Everything after the adjacency count works on (half, prev, family) totals, so
    the only pass over the genes is the one that counts. A family is a fork when
    at least two successors each hold ``min_share`` of its adjacencies.
    """
    half = F.pmod(F.col("genome"), F.lit(2)).alias("half")
    counts = (
        adjacencies(genes)
        .groupBy(half, "prev", "family")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    seen = counts.where(F.col("prev").isNotNull())
    best = seen.groupBy("half", "prev").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("family").alias("f")))["f"].alias("best")
    )
    overall = seen.groupBy("prev", "family").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("prev"))
    forks = (
        overall.select("prev", share.alias("share"))
        .groupBy("prev")
        .agg((F.count_if(F.col("share") >= min_share) >= 2).alias("fork"))
    )
    other = best.select((1 - F.col("half")).alias("half"), "prev", "best")
    return (
        counts.join(other, ["half", "prev"], "left")
        .join(forks, "prev", "left")
        .groupBy("prev", F.coalesce("fork", F.lit(False)).alias("fork"))
        .agg(
            F.sum("n").alias("calls"),
            F.sum(F.when(F.col("best") == F.col("family"), F.col("n")).otherwise(0)).alias("hits"),
        )
    )


def nodes(genes: DataFrame, column: str = "pos", examples: int = 10) -> DataFrame:
    """One row per family: carriers, modal column, share inside plastic regions,
    modal allele, label (most frequent name) and the first example genomes."""
    base = genes.groupBy("family").agg(
        F.count(F.lit(1)).alias("genes"),
        F.avg(F.col("in_rgp").cast("double")).alias("rgp"),
    )
    per_genome = genes.select("family", "genome").distinct()
    carriers = per_genome.groupBy("family").agg(F.count(F.lit(1)).alias("carriers"))
    shown = top_k(per_genome, ["family"], [F.col("genome")], examples)
    shown = shown.groupBy("family").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("genome")), lambda x: x.cast("string")), ","
        ).alias("examples")
    )
    return (
        base.join(carriers, "family")
        .join(mode_by(genes, "family", column, "locus"), "family")
        .join(mode_by(genes, "family", "allele", "allele"), "family")
        .join(mode_by(genes, "family", "name", "label"), "family", "left")
        .join(shown, "family")
        .withColumn("label", F.coalesce("label", "family"))
    )


def expected_unobserved(
    node_table: DataFrame, edge_table: DataFrame, mean_calls: DataFrame, reads: DataFrame, k: int = 2
) -> DataFrame:
    """Per column, what the calls expect after its best-carried family but no genome has there.

    ``mean_calls``: family, cluster, p (mean call after the family);
    ``reads``: cluster, read (the family a cluster reads as).
    """
    source = node_table.groupBy("locus").agg(
        F.min(F.struct((-F.col("carriers")).alias("c"), F.col("family").alias("f")))["f"].alias("family")
    )
    seen = edge_table.select(F.col("prev").alias("family"), F.col("family").alias("read"))
    expected = (
        source.join(mean_calls, "family")
        .join(reads, "cluster", "left")
        .join(seen, ["family", "read"], "left_anti")
    )
    ranked = top_k(expected, ["family"], [F.desc("p"), F.col("cluster")], k)
    return ranked.select(
        "family", (F.col("locus") + 1).alias("locus"), "cluster", "p", "read", "place"
    )
