"""Exchanging alleles between sites that share a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators.tiling import number_rows
from seqweave.session import cut_lineage


def swap_partners(sites: DataFrame, piece: int = 64) -> DataFrame:
    """For every site and every other branch of its group, a donor with that branch and one with its own, of other genomes.

    ``sites``: group, genome (a whole number), pos, branch, allele. Returns group, genome, pos, branch, other, allele,
    cross (allele of a site with branch ``other``) and same (allele of a site with the site's own branch). The site
    at place i of its branch asks place i, modulo its size, of the other branch, and the place after its own genome in
    its own; where that place holds a site of its genome, the one after that genome's sites is taken instead. So no pairs of sites
    are formed, and only sites without a donor of another genome are missing. Branches of a group are few.
    """
    keys = ["group", "branch"]
    placed = number_rows(sites, keys, ["genome", "pos"], F.floor(F.col("genome") / piece), "place", "size")
    runs = placed.groupBy(*keys, "genome").agg((F.max("place") + 1).alias("after"), F.min("place").alias("from"))
    placed = cut_lineage(placed.join(runs, [*keys, "genome"]))
    at = placed.select("group", F.col("branch").alias("_b"), F.col("place").alias("_p"), F.col("genome").alias("_g"),
                       F.col("after").alias("_after"), F.col("allele").alias("_allele"))
    groups = placed.groupBy(*keys).agg(F.max("size").alias("_n"))
    several = Window.partitionBy("group")
    groups = groups.withColumn("_k", F.count(F.lit(1)).over(several)).where(F.col("_k") > 1).drop("_k")
    others = groups.select("group", F.col("branch").alias("other"), "_n")
    # own branch: the first site after the own genome's, in a circle; it is another genome's unless there is none
    next_own = F.pmod(F.col("after"), F.col("size"))
    base = placed.where(~((F.col("from") == 0) & (F.col("after") == F.col("size"))))
    base = base.withColumn("_p", next_own).withColumn("_b", F.col("branch")).join(at, ["group", "_b", "_p"]).select(
        "group", "genome", "pos", "branch", "allele", "place", F.col("_allele").alias("same"))
    asked = base.join(others, "group").where(F.col("other") != F.col("branch"))
    first = asked.withColumn("_p", F.pmod(F.col("place"), F.col("_n"))).withColumn("_b", F.col("other")).join(at, ["group", "_b", "_p"])
    keep = ["group", "genome", "pos", "branch", "other", "allele", "same"]
    apart = first.where(F.col("_g") != F.col("genome")).select(*keep, F.col("_allele").alias("cross"))
    again = first.where(F.col("_g") == F.col("genome")).select(*keep, F.pmod(F.col("_after"), F.col("_n")).alias("_p"), F.col("other").alias("_b"))
    again = again.join(at, ["group", "_b", "_p"]).where(F.col("_g") != F.col("genome")).select(*keep, F.col("_allele").alias("cross"))
    return apart.unionByName(again).select("group", "genome", "pos", "branch", "other", "allele", "cross", "same")


def swap_effects(partners: DataFrame, chances: DataFrame) -> DataFrame:
    """What the swapped allele does to the chance of the other branch: fork, n, own, same, cross, flip_same, flip_cross.

    ``partners`` with fork; ``chances``: fork, allele, branch, q and ``best`` (the allele's most likely branch). The
    last two are the shares of swaps after which the other branch is the most likely one.
    """
    def read(df, allele, out):
        told = chances.select("fork", F.col("allele").alias(allele), F.col("branch").alias("other"), F.col("q").alias(out), F.col("best").alias(f"best_{out}"))
        return df.join(told, ["fork", allele, "other"])

    met = read(read(read(partners, "allele", "q_own"), "same", "q_same"), "cross", "q_cross")
    share = lambda c: F.avg((F.col(c) == F.col("other")).cast("double"))
    return met.groupBy("fork").agg(
        F.count(F.lit(1)).alias("n"), F.avg("q_own").alias("own"), F.avg("q_same").alias("same"), F.avg("q_cross").alias("cross"),
        share("best_q_same").alias("flip_same"), share("best_q_cross").alias("flip_cross"))
