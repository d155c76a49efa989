"""Association over pairs of genomes, stratified by how related the two are.

Whether two genomes agree in an allele is set against whether they agree in a
branch, for all pairs of genomes. Genomes are cut into blocks; one task gets two
blocks, forms their pairs as small matrices and returns sums per (bin, trait,
outcome). No pair of genomes leaves a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions.columns import cmh_terms
from seqweave.operators.distance import agreement_sums
from seqweave.operators.tiling import grouped_quantile, value_bounds
from seqweave.session import cut_lineage

GENOMES_PER_BLOCK = 256


def _tile(group: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({k: [] for k in ("bin", "trait", "outcome", "a", "r", "c", "n")})
    bins = group[group["kind"] == "bin"]
    if not len(bins):
        return empty
    first, second = bins["genome"].to_numpy(), bins["other"].to_numpy()
    which = bins["value"].to_numpy().astype(np.int64)

    def agreement(kind):
        rows = group[group["kind"] == kind]
        names, code = np.unique(rows["name"].to_numpy(), return_inverse=True)
        genomes, at = np.unique(rows["genome"].to_numpy(), return_inverse=True)
        values, coded = np.unique(rows["value"].to_numpy(), return_inverse=True)
        table = np.full((len(names), len(genomes) + 1), -1)
        table[code, at] = coded

        def look(ids):
            if not len(genomes):
                return np.zeros(len(ids), dtype=int)
            k = np.clip(np.searchsorted(genomes, ids), 0, len(genomes) - 1)
            return np.where(genomes[k] == ids, k, len(genomes))

        x, y = table[:, look(first)], table[:, look(second)]
        known = (x >= 0) & (y >= 0)
        return names, known, known & (x == y)

    traits, _, same_trait = agreement("trait")
    outcomes, known, same_outcome = agreement("outcome")
    if not len(outcomes):
        return empty
    parts = []
    for b in np.unique(which):
        m = which == b
        s, o, k = same_trait[:, m].astype(float), same_outcome[:, m].astype(float), known[:, m].astype(float)
        t, f = np.meshgrid(traits, outcomes, indexing="ij")
        parts.append(pd.DataFrame({
            "bin": b, "trait": t.ravel(), "outcome": f.ravel(), "a": (s @ o.T).ravel(), "r": (s @ k.T).ravel(),
            "c": 0.0, "n": 0.0,
        }))
        # the outcome's own margins hold for every trait, also for one these genomes lack
        parts.append(pd.DataFrame({
            "bin": b, "trait": None, "outcome": outcomes, "a": 0.0, "r": 0.0, "c": o.sum(1), "n": k.sum(1),
        }))
    return pd.concat(parts)


def agreement_cmh(traits: DataFrame, outcomes: DataFrame, binned: DataFrame) -> DataFrame:
    """Signed Z per (trait, outcome) over the bins of relatedness: trait, outcome, z.

    ``traits``/``outcomes``: genome, name, value (text; one per genome and name);
    ``binned``: g1, g2, bin, each pair of genomes once.
    """
    total = traits.select("genome").unionByName(outcomes.select("genome")).agg(
        F.approx_count_distinct("genome")
    ).first()[0]
    blocks = max(1, -(-int(total) // GENOMES_PER_BLOCK))
    block = lambda g: F.pmod(F.xxhash64(g), F.lit(blocks)).cast("int")
    pairs = binned.select(
        F.least(block("g1"), block("g2")).alias("bi"), F.greatest(block("g1"), block("g2")).alias("bj"),
        F.lit("bin").alias("kind"), F.col("g1").alias("genome"), F.col("g2").alias("other"),
        F.lit("").alias("name"), F.col("bin").cast("string").alias("value"),
    )

    def spread(df, kind):
        others = F.explode(F.array(*[F.lit(i) for i in range(blocks)]))
        return df.withColumn("_b", block("genome")).withColumn("_o", others).select(
            F.least("_b", "_o").alias("bi"), F.greatest("_b", "_o").alias("bj"), F.lit(kind).alias("kind"), "genome",
            F.lit(-1).cast("bigint").alias("other"), "name", F.col("value").cast("string").alias("value"),
        )

    rows = pairs.unionByName(spread(traits, "trait")).unionByName(spread(outcomes, "outcome"))
    return _signed_z(rows.groupBy("bi", "bj").applyInPandas(
        _tile, "bin bigint, trait string, outcome string, a double, r double, c double, n double"
    ))


def agreement_by_distance(traits: DataFrame, outcomes: DataFrame, loci: DataFrame, edges: list[float]) -> DataFrame:
    """``agreement_cmh`` over all pairs of genomes with a locus typed in both, in classes of their allele distance.

    ``loci``: genome, locus, allele; a distance on one of ``edges`` belongs to the class above. The classes are found
    in the tasks that form the pairs, so no pair is shuffled or written. Traits of genomes without pairs agree nowhere.
    """
    return _signed_z(agreement_sums(traits, outcomes, loci, edges), traits.select(F.col("name").alias("trait")).distinct())


def _signed_z(tiles: DataFrame, names: DataFrame | None = None) -> DataFrame:
    sums = cut_lineage(tiles.groupBy("bin", "trait", "outcome").agg(*[F.sum(x).alias(x) for x in "arcn"]))
    margins = sums.where(F.col("trait").isNull() & (F.col("n") > 1)).select("bin", "outcome", "c", "n")
    cells = sums.where(F.col("trait").isNotNull()).select("bin", "trait", "outcome", "a", "r")
    if names is not None:
        every = margins.select("bin", "outcome").crossJoin(names)
        cells = every.join(cells, ["bin", "trait", "outcome"], "left").fillna(0.0, ["a", "r"])
    over, var = cmh_terms(F.col("a"), F.col("r"), F.col("c"), F.col("n"))
    return (
        cells.join(margins, ["bin", "outcome"])
        .groupBy("trait", "outcome")
        .agg(F.round(F.sum(over) / F.sqrt(F.greatest(F.sum(var), F.lit(1e-9))), 9).alias("z"))
    )


def quantile_bins(distance: DataFrame, bins: int, weight: str | None = None) -> DataFrame:
    """``distance`` (a row for one pair, or for ``weight`` pairs) with ``bin``: 0 .. bins - 1, between the quantiles of d that cut all pairs into equal shares.

    A distance on a border belongs to the bin above it, the largest one to the last bin. The borders are exact and,
    as many as bins, become literals of the plan.
    """
    bounds = value_bounds(distance, "d")
    edges = [grouped_quantile(distance, [], "d", i / bins, "e", bounds, weight=weight).first()[0] for i in range(1, bins)]
    above = sum((F.col("d") >= F.lit(e)).cast("int") for e in edges) if edges else F.lit(0)
    return distance.withColumn("bin", above)


def decay_table(tests: DataFrame, band: Column, level: float = 4.0) -> DataFrame:
    """Per distance class: tests, share beyond ``level`` in all, in each half, in both, and
    the share expected if the halves were independent. ``tests``: z, z_a, z_b."""
    beyond = lambda c: F.avg((F.col(c) > level).cast("double"))
    both = F.avg(((F.col("z_a") > level) & (F.col("z_b") > level)).cast("double"))
    rows = tests.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("tests"), beyond("z").alias("beyond"), beyond("z_a").alias("in_a"),
        beyond("z_b").alias("in_b"), both.alias("in_both"),
    )
    return rows.withColumn("expected", F.col("in_a") * F.col("in_b"))
