"""Fork rules: families followed by several others, and the sites where one is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators.graph import adjacencies, top_k
from seqweave.operators.tiling import over_tiles


def successor_stats(genes: DataFrame, first_copy: bool = False) -> DataFrame:
    """fork, branch, n, genomes and the fork's total; optionally first copies only."""
    rows = adjacencies(genes).where(F.col("next").isNotNull())
    if first_copy:
        # the next family travels with the position, so the first copy is an aggregate
        rows = rows.groupBy("genome", "family").agg(
            F.min(F.struct("pos", "next"))["next"].alias("next")
        )
    per = rows.groupBy(F.col("family").alias("fork"), F.col("next").alias("branch"), "genome").agg(
        F.count(F.lit(1)).alias("n")
    )
    stats = per.groupBy("fork", "branch").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("genomes")
    )
    return stats.withColumn("total", F.sum("n").over(Window.partitionBy("fork")))


def fork_branches(
    stats: DataFrame,
    top: int | None = None,
    min_n: int = 1,
    min_share: float = 0.0,
    min_genomes: int = 1,
    min_total: int = 0,
) -> DataFrame:
    """Branches kept by a fork rule, for forks left with at least two: fork, branch, n.

    The rule takes the ``top`` successors first, then applies its thresholds.
    """
    ranked = stats
    if top:
        ranked = top_k(stats, ["fork"], [F.desc("n"), F.col("branch")], top)
    kept = ranked.where(
        (F.col("n") >= min_n)
        & (F.col("n") >= min_share * F.col("total"))
        & (F.col("genomes") >= min_genomes)
        & (F.col("total") >= min_total)
    )
    per = Window.partitionBy("fork")
    return (
        kept.withColumn("branches", F.count(F.lit(1)).over(per))
        .where(F.col("branches") >= 2)
        .select("fork", "branch", "n")
    )


def forks_by_sites(
    genes: DataFrame, top: int, min_n: int = 1, min_share: float = 0.0, min_genomes: int = 1, min_sites: int = 0,
    min_total: int = 0, min_plastic: float = 0.0, first_copy: bool = False,
) -> DataFrame:
    """Branches of a fork rule that also asks for sites: fork, branch, n, sites, plastic.

    ``genes``: genome, pos, family, in_rgp. Of the ``top`` successors those with ``min_n`` adjacencies, the share
    ``min_share`` of the fork's and ``min_genomes`` genomes are branches; a fork needs two of them, ``min_sites``
    adjacencies on them, ``min_total`` in all, and the share ``min_plastic`` of them leading into a plastic region.
    """
    rows = over_tiles(genes, ["genome"], lambda w: {"next": F.lead("family").over(w), "plastic": F.lead("in_rgp").over(w)}, after=1)
    rows = rows.where(F.col("next").isNotNull())
    if first_copy:
        rows = rows.groupBy("genome", "family").agg(F.min(F.struct("pos", "next", "plastic")).alias("m")).select("genome", "family", "m.next", "m.plastic")
    per = rows.groupBy(F.col("family").alias("fork"), F.col("next").alias("branch"), "genome").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("plastic").alias("p"))
    stats = per.groupBy("fork", "branch").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("genomes"), F.sum("p").alias("p"))
    fork = Window.partitionBy("fork")
    stats = stats.withColumn("total", F.sum("n").over(fork)).withColumn("plastic", F.sum("p").over(fork) / F.col("total"))
    ranked = top_k(stats, ["fork"], [F.desc("n"), F.col("branch")], top)
    kept = ranked.where((F.col("n") >= min_n) & (F.col("n") >= min_share * F.col("total")) & (F.col("genomes") >= min_genomes))
    kept = kept.withColumn("branches", F.count(F.lit(1)).over(fork)).withColumn("sites", F.sum("n").over(fork))
    good = (F.col("branches") >= 2) & (F.col("sites") >= min_sites) & (F.col("total") >= min_total) & (F.col("plastic") >= min_plastic)
    return kept.where(good).select("fork", "branch", "n", "sites", "plastic")


def fork_sites(genes_with_prev: DataFrame, branches: DataFrame) -> DataFrame:
    """Genes that take a kept branch of a fork."""
    return (
        genes_with_prev.where(F.col("prev").isNotNull())
        .withColumnRenamed("prev", "fork")
        .withColumnRenamed("family", "branch")
        .join(branches.select("fork", "branch"), ["fork", "branch"])
    )
