"""Predictors of the branch taken at a fork, and their scores in bits.

Leave-one-genome-out counts are differences of two totals, so a site never meets
the other sites of its fork: everything works on (fork, path, genome, branch)
totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators.decoder import call_rows
from seqweave.operators.graph import top_k


def branch_probabilities(
    calls: DataFrame, branches: DataFrame, half_decoder: DataFrame, eps: float = 1e-3
) -> DataFrame:
    """Probability of every branch after each family, per half: half, prev, branch, q.

    Calls are read with the table of the other half, restricted to the branches,
    floored at ``eps`` of their total and normalised. ``calls`` with the same
    list are read once.
    """
    lists = calls.select("half", "prev", "top").distinct()
    weights = half_decoder.select(
        (1 - F.col("half")).alias("half"), "cluster", F.col("family").alias("branch"), "weight"
    )
    wanted = lists.join(branches, "prev")
    q = (
        call_rows(wanted, "half", "prev", "top", "branch")
        .join(weights, ["half", "cluster", "branch"], "left")
        .groupBy("half", "prev", "top", "branch")
        .agg(F.coalesce(F.sum(F.col("p") * F.col("weight")), F.lit(0.0)).alias("q"))
    )
    fork = Window.partitionBy("half", "prev", "top")
    floored = q.withColumn("q", F.col("q") + eps * F.greatest(F.sum("q").over(fork), F.lit(1e-12)))
    return floored.select(
        "half", "prev", "branch", (F.col("q") / F.sum("q").over(fork)).alias("q")
    )


def leave_one_out_frequency(sites: DataFrame) -> DataFrame:
    """Branch frequencies at the fork without the genome scored, (count + .5) smoothed.

    ``sites``: fork, genome, branch (one row per site). One row per
    (fork, genome, branch) with ``n`` sites and ``freq``.
    """
    own = sites.groupBy("fork", "genome", "branch").agg(F.count(F.lit(1)).alias("n"))
    branch = own.groupBy("fork", "branch").agg(F.sum("n").alias("branch_n"))
    fork = branch.groupBy("fork").agg(
        F.sum("branch_n").alias("fork_n"), F.count(F.lit(1)).alias("branches")
    )
    mine = own.groupBy("fork", "genome").agg(F.sum("n").alias("own_n"))
    return (
        own.join(mine, ["fork", "genome"])
        .join(branch.join(fork, "fork"), ["fork", "branch"])
        .withColumn(
            "freq",
            (F.col("branch_n") - F.col("n") + 0.5)
            / (F.col("fork_n") - F.col("own_n") + 0.5 * F.col("branches")),
        )
        .select("fork", "genome", "branch", "n", "freq")
    )


def path_counts(sites: DataFrame, path: str) -> DataFrame:
    """Per (fork, path, genome, branch): ``same`` sites of other genomes on that path
    taking the branch, and ``others`` on that path at all."""
    own = sites.groupBy("fork", path, "genome", "branch").agg(F.count(F.lit(1)).alias("n"))
    mine = own.groupBy("fork", path, "genome").agg(F.sum("n").alias("own_n"))
    branch = own.groupBy("fork", path, "branch").agg(F.sum("n").alias("branch_n"))
    total = branch.groupBy("fork", path).agg(F.sum("branch_n").alias("path_n"))
    return (
        own.join(mine, ["fork", path, "genome"])
        .join(branch.join(total, ["fork", path]), ["fork", path, "branch"])
        .select(
            "fork",
            path,
            "genome",
            "branch",
            "n",
            (F.col("branch_n") - F.col("n")).alias("same"),
            (F.col("path_n") - F.col("own_n")).alias("others"),
        )
    )


def path_predictor(sites: DataFrame, path: str, freq: DataFrame) -> DataFrame:
    """Shrunk path predictor q = (same + freq) / (others + 1) of the branch taken."""
    counts = path_counts(sites, path)
    return counts.join(freq.drop("n"), ["fork", "genome", "branch"]).withColumn(
        "q", (F.col("same") + F.col("freq")) / (F.col("others") + 1)
    )


def backoff_counts(sites: DataFrame, paths: Sequence[str], min_others: int = 3) -> DataFrame:
    """Counts on the longest path shared with at least ``min_others`` sites of other genomes.

    ``paths``: columns from the longest path to the shortest; each shorter path is
    a suffix of the longer ones.
    """
    keys = ["fork", "genome", "branch", *paths]
    folded = sites.groupBy(*keys).agg(F.count(F.lit(1)).alias("sites"))
    same, others = F.lit(0), F.lit(0)
    for path in reversed(paths):
        counts = path_counts(sites, path).select(
            "fork", path, "genome", "branch", F.col("same").alias(f"_s_{path}"), F.col("others").alias(f"_o_{path}")
        )
        folded = folded.join(counts, ["fork", path, "genome", "branch"])
        enough = F.col(f"_o_{path}") >= min_others
        same = F.when(enough, F.col(f"_s_{path}")).otherwise(same)
        others = F.when(enough, F.col(f"_o_{path}")).otherwise(others)
    return folded.select(*keys, "sites", same.alias("same"), others.alias("others"))


def fit_smoothing(scored: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Choose the pseudo-count on one half of the genomes and score the other with it.

    ``scored``: half, n, same, others, freq. q = (same + a freq) / (others + a).
    Returns half (the one scored), a, bits per site and sites.
    """
    q = (F.col("same") + F.col("a") * F.col("freq")) / (F.col("others") + F.col("a"))
    costs = (
        scored.withColumn("a", F.explode(F.array(*[F.lit(float(a)) for a in grid])))
        .groupBy("half", "a")
        .agg(F.sum(F.col("n") * -F.log2(q)).alias("bits"), F.sum("n").alias("sites"))
    )
    fitted = costs.groupBy("half").agg(
        F.min(F.struct(F.round("bits", 6).alias("b"), F.col("a").alias("a")))["a"].alias("a")
    )
    return (
        fitted.select((1 - F.col("half")).alias("half"), "a")
        .join(costs, ["half", "a"])
        .select("half", "a", (F.col("bits") / F.col("sites")).alias("bits"), "sites")
    )


def fit_mixture(scored: DataFrame, grid: Sequence[float], floor: float = 1e-12) -> DataFrame:
    """Choose the share of the branch frequency mixed into a model on one half of the genomes and score the other with it.

    ``scored``: half, n, q (the model's chance of the branch taken), freq. The mixture is (1 - l) q + l freq.
    Returns half (the one scored), l, bits per site and sites.
    """
    q = F.greatest((1 - F.col("l")) * F.col("q") + F.col("l") * F.col("freq"), F.lit(floor))
    costs = (
        scored.withColumn("l", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
        .groupBy("half", "l").agg(F.sum(F.col("n") * -F.log2(q)).alias("bits"), F.sum("n").alias("sites"))
    )
    best = F.min(F.struct(F.round("bits", 6).alias("b"), F.col("l").alias("l")))["l"].alias("l")
    fitted = costs.groupBy("half").agg(best).select((1 - F.col("half")).alias("half"), "l")
    return fitted.join(costs, ["half", "l"]).select("half", "l", (F.col("bits") / F.col("sites")).alias("bits"), "sites")


def neighbour_predictor(sites: DataFrame, nearest: DataFrame, freq: DataFrame) -> DataFrame:
    """Shrunk vote of the nearest genomes at the fork: q = (same + freq) / (others + 1).

    ``nearest``: fork, genome, other.
    """
    votes = sites.groupBy("fork", F.col("genome").alias("other"), "branch").agg(F.count(F.lit(1)).alias("v"))
    counted = nearest.join(votes, ["fork", "other"]).groupBy("fork", "genome", "branch").agg(
        F.sum("v").alias("same")
    )
    others = counted.groupBy("fork", "genome").agg(F.sum("same").alias("others"))
    return (
        freq.join(others, ["fork", "genome"])
        .join(counted, ["fork", "genome", "branch"], "left")
        .withColumn("same", F.coalesce("same", F.lit(0)))
        .select(
            "fork", "genome", "branch", "n", "same", "others",
            ((F.col("same") + F.col("freq")) / (F.col("others") + 1)).alias("q"),
        )
    )


def similar_allele_predictor(sites: DataFrame, near: DataFrame, freq: DataFrame) -> DataFrame:
    """Vote of the sites whose allele is most similar, other genomes only.

    ``sites``: fork, genome, allele, branch; ``near``: fork, allele, other. One row
    per (fork, genome, allele, branch): n, same, others, q.
    """
    own = sites.groupBy("fork", "genome", "allele", "branch").agg(F.count(F.lit(1)).alias("n"))
    votes = own.select("fork", F.col("allele").alias("other"), "genome", "branch", F.col("n").alias("v"))
    heard = (
        near.join(votes, ["fork", "other"])
        .groupBy("fork", "allele", "genome", "branch")
        .agg(F.sum("v").alias("v"))
    )
    total = heard.groupBy("fork", "allele", "branch").agg(F.sum("v").alias("branch_v"))
    every = total.groupBy("fork", "allele").agg(F.sum("branch_v").alias("all_v"))
    mine = heard.groupBy("fork", "allele", "genome").agg(F.sum("v").alias("mine_v"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        own.join(total, ["fork", "allele", "branch"], "left")
        .join(every, ["fork", "allele"], "left")
        .join(heard.withColumnRenamed("v", "own_v"), ["fork", "allele", "genome", "branch"], "left")
        .join(mine, ["fork", "allele", "genome"], "left")
        .join(freq.select("fork", "genome", "branch", "freq"), ["fork", "genome", "branch"])
        .withColumn("same", zero("branch_v") - zero("own_v"))
        .withColumn("others", zero("all_v") - zero("mine_v"))
        .select(
            "fork", "genome", "allele", "branch", "n", "same", "others",
            ((F.col("same") + F.col("freq")) / (F.col("others") + 1)).alias("q"),
        )
    )


def ablation_effects(variants: DataFrame, least: int = 10, k: int = 6) -> DataFrame:
    """What removing a family upstream costs the true branch: fork, family, n, mean drop in
    bits, share of sites whose best branch changes; the ``k`` largest drops per fork among
    families removed at ``least`` sites. ``variants``: fork, family, q0, q1, flipped."""
    effects = (
        variants.groupBy("fork", "family")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.log2("q0") - F.log2("q1")).alias("drop"),
            F.avg(F.col("flipped").cast("double")).alias("flip_rate"),
        )
        .where(F.col("n") >= least)
    )
    return top_k(effects, ["fork"], [F.desc(F.round("drop", 9)), F.col("family")], k)
