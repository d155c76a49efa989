"""Matched controls for deletions, and what a deletion does to its surroundings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators.sequence import containing_interval
from seqweave.session import cut_lineage
from seqweave.operators.stats import array_median, median_and_mad, robust_z

# (least and greatest size relative to the unit, tolerance of the distance)
NARROW = (0.5, 2.0, 0.35)
WIDE = (1 / 3, 3.0, 0.60)


def matched_controls(
    units: DataFrame, pool: DataFrame, enough: int = 3, log_factor: float | None = None, bin_size: int = 64
) -> DataFrame:
    """Controls of comparable size and distance for every unit.

    ``units``: genome, unit, start, end, size, dist, row; ``pool``: genome, control,
    c_start, c_end, c_size, c_delta. The narrow tier is used when it holds
    ``enough`` controls, else the wide one, else (with ``log_factor``) the one
    matched on the logarithm of the distance; the last tier stands whatever it
    holds. Controls overlapping the unit are left out. Returns unit, control,
    c_delta, tier.

    Units look controls up by (genome, size octave, position bin), covering the
    widest tier, so only controls near in both meet a unit. The joins are merges:
    the compressed size of a written table says little of what a broadcast of it
    would take on the driver.
    """
    lo, hi, tol = WIDE
    reach = max(1 + tol, log_factor or 0)
    nearest = min(1 - tol, 1 / log_factor if log_factor else 1)
    octave = lambda c: F.floor(F.log2(c))
    first = F.floor((F.col("row") - F.col("dist") * reach) / bin_size)
    last = F.floor((F.col("row") - F.col("dist") * nearest) / bin_size)
    wanted = units.withColumn(
        "_oct", F.explode(F.sequence(octave(F.col("size") * lo - 1e-9), octave(F.col("size") * hi + 1e-9)))
    ).withColumn("_bin", F.explode(F.sequence(first, last)))
    offered = pool.withColumn("_oct", octave(F.col("c_size"))).withColumn(
        "_bin", F.floor(F.col("c_end") / bin_size)
    )
    apart = (F.col("c_start") > F.col("end")) | (F.col("c_end") < F.col("start"))
    d = F.col("row") - F.col("c_end")

    def tier(lo, hi, near):
        size_ok = (F.col("c_size") >= lo * F.col("size")) & (F.col("c_size") <= hi * F.col("size"))
        return size_ok & near

    def around(tol):
        return F.abs(d - F.col("dist")) <= tol * F.col("dist")

    met = (
        wanted.join(offered.hint("merge"), ["genome", "_oct", "_bin"])
        .where(apart & (F.col("c_end") < F.col("row")))
        .withColumn("t1", tier(*NARROW[:2], around(NARROW[2])))
        .withColumn("t2", tier(lo, hi, around(tol)))
    )
    if log_factor:
        near = F.abs(F.log(F.greatest(d, F.lit(1)) / F.col("dist"))) <= math.log(log_factor)
        met = met.withColumn("t3", tier(lo, hi, near))
    else:
        met = met.withColumn("t3", F.col("t2"))
    held = lambda t: F.count(F.when(F.col(t), 1)).over(Window.partitionBy("unit"))  # a unit's window bounds its rows
    tiers = F.when(held("t1") >= enough, 1).when((held("t2") >= enough) | F.lit(not log_factor), 2).otherwise(3)
    keep = F.when(F.col("tier") == 1, F.col("t1")).when(F.col("tier") == 2, F.col("t2")).otherwise(F.col("t3"))
    return met.withColumn("tier", tiers).where(keep).select("unit", "control", "c_delta", "tier")


def unit_scores(units: DataFrame, controls: DataFrame, enough: int = 3) -> DataFrame:
    """Robust z of each unit among its controls and its rank percentile (ties half):
    unit, n_ctrl, z (null below ``enough`` controls), rank_pct.

    A unit's controls end at different genes within its distance window, so their
    number is bounded by that window and they are gathered as one array.
    """
    gathered = controls.groupBy("unit").agg(F.collect_list("c_delta").alias("c"))
    scored = units.select("unit", "delta").join(gathered.hint("merge"), "unit").withColumn("median", array_median(F.col("c")))
    mad = array_median(F.transform("c", lambda x: F.abs(x - F.col("median"))))
    place = lambda x: F.when(x < F.col("delta"), 1.0).when(x == F.col("delta"), 0.5).otherwise(0.0)
    n = F.size("c").cast("bigint")
    z = robust_z(F.col("delta"), F.col("median"), mad)
    rank = F.aggregate(F.transform("c", place), F.lit(0.0), lambda s, x: s + x) / n
    return scored.select("unit", n.alias("n_ctrl"), F.when(n >= enough, z).alias("z"), rank.alias("rank_pct"))


def stand_in_scores(units: DataFrame, controls: DataFrame, pool: DataFrame, enough: int = 3) -> DataFrame:
    """Each control in turn in the unit's place, scored against its own matched controls:
    unit, control, z. The spread of these is the unit's own null."""
    stand = (
        controls.select("unit", "control")
        .join(units.select("unit", "genome", "row").hint("merge"), "unit")
        .join(pool.hint("merge"), ["genome", "control"])
        .select(
            F.struct("unit", "control").alias("unit"),
            "genome",
            "row",
            F.col("c_start").alias("start"),
            F.col("c_end").alias("end"),
            F.col("c_size").alias("size"),
            (F.col("row") - F.col("c_end")).alias("dist"),
            F.col("c_delta").alias("delta"),
        )
    )
    stand = cut_lineage(stand)
    own = matched_controls(stand, pool, enough)
    scores = unit_scores(stand, own, enough).where(F.col("z").isNotNull())
    return scores.select("unit.unit", "unit.control", "z")


def downstream_profile(
    passes: DataFrame, readouts: DataFrame, reach: int, bin_width: int, subset: str
) -> DataFrame:
    """Mean, mean absolute and subset mean of the readouts after each deletion, in
    bins of distance: pass, bin, n, mean, mean_abs, subset_mean.

    ``passes``: genome, pass, end; ``readouts``: genome, pos, v and the subset flag.
    """
    spans = passes.select(
        "genome", "pass", F.col("end").alias("_e"), (F.col("end") + 1).alias("start"), (F.col("end") + reach).alias("end")
    )
    seen = containing_interval(readouts, spans)
    return seen.groupBy("pass", F.floor((F.col("pos") - F.col("_e") - 1) / bin_width).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("v").alias("mean"),
        F.avg(F.abs("v")).alias("mean_abs"),
        F.avg(F.when(F.col(subset), F.col("v"))).alias("subset_mean"),
    )


def influence_radius(profile: DataFrame, bins: int, level: float = 2.0) -> DataFrame:
    """How far each deletion is felt, its bins judged against the same bin of all others:
    pass, radius (last bin beyond ``level``), contiguous (leading bins beyond it), broad (share of bins)."""
    profile = cut_lineage(profile)
    spread = median_and_mad(profile, ["bin"], "mean").drop("n")
    z = robust_z(F.col("mean"), F.col("median"), F.col("mad"))
    judged = profile.join(spread, "bin").withColumn("beyond", F.abs(z) > level)
    first_quiet = F.min(F.when(~F.col("beyond"), F.col("bin")))
    return judged.groupBy("pass").agg(
        F.coalesce(F.max(F.when(F.col("beyond"), F.col("bin"))) + 1, F.lit(0)).alias("radius"),
        F.coalesce(first_quiet, F.lit(bins)).alias("contiguous"),
        F.avg(F.col("beyond").cast("double")).alias("broad"),
    )
