"""Tests of links: deletions read at their target and beside it, calibrated by stand-ins.

A link is a set of units; a unit is one deletion in one genome, read at a row downstream. Each of its matched controls
can stand in for it. Draws replace every unit by one of its stand-ins; they are made by arithmetic on (seed, draw,
unit), travel as vectors of a block of draws, and all draws of a block are ranked in one step, so a task holds the
lineages of a link times one block, however many units or draws there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators.matching import NARROW, WIDE, matched_controls
from seqweave.operators.stats import array_median, robust_z
from seqweave.session import cut_lineage

#: Values are counted in units of this, as whole numbers, so that sums don't depend on their order.
STEP = 1e-4
PRIME = 2**31 - 1


def _bins(low: Column, high: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def off_targets(units: DataFrame, entries: DataFrame, tolerance: float = NARROW[2], most: int = 12, bin_size: int = 64) -> DataFrame:
    """Other places to read a unit's deletion at: the ``most`` entries nearest to its own row, at a comparable distance.

    ``units``: genome, unit, start, end, dist, row; ``entries``: genome, entry (a position). Returns genome, unit,
    entry. Entries at the unit's row or inside the unit are not among them. A unit meets the entries of the position
    bins its window covers, so the join grows with the units.
    """
    low, high = F.col("end") + (1 - tolerance) * F.col("dist"), F.col("end") + (1 + tolerance) * F.col("dist")
    wanted = units.withColumn("_bin", _bins(low, high, bin_size))
    offered = entries.select("genome", "entry").distinct().withColumn("_bin", F.floor(F.col("entry") / bin_size))
    inside = F.col("entry").between(low, high) & (F.col("entry") != F.col("row")) & ~F.col("entry").between(F.col("start"), F.col("end"))
    met = wanted.join(offered, ["genome", "_bin"]).where(inside)
    near = Window.partitionBy("unit").orderBy(F.abs(F.col("entry") - F.col("row")), "entry")
    return met.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= most).select("genome", "unit", "entry")


def _scored(units: DataFrame, controls: DataFrame, enough: int) -> DataFrame:
    """unit, n_ctrl, z and excess (over the controls' median) of units with ``enough`` controls, whose number a distance window bounds."""
    gathered = controls.groupBy("unit").agg(F.collect_list("c_delta").alias("c")).where(F.size("c") >= enough)
    rows = units.select("unit", "delta").join(gathered.hint("merge"), "unit").withColumn("median", array_median(F.col("c")))
    mad = array_median(F.transform("c", lambda x: F.abs(x - F.col("median"))))
    return rows.select(
        "unit", F.size("c").alias("n_ctrl"), robust_z(F.col("delta"), F.col("median"), mad).alias("z"),
        (F.col("delta") - F.col("median")).alias("excess"),
    )


def stand_ins(reads: DataFrame, pool: DataFrame, enough: int = 3, log_factor: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of reads, and of every matched control put in the read's place.

    ``reads``: genome, unit (any key of the read), start, end, size, dist, row, delta; ``pool`` as for
    ``matched_controls``. The first frame has unit, n_ctrl, z, excess, the second unit, control, z, excess, each control
    being scored by the other controls that match it at the same row.
    """
    controls = cut_lineage(matched_controls(reads, pool, enough, log_factor))
    stand = (
        controls.select("unit", "control").join(reads.select("unit", "genome", "row").hint("merge"), "unit").join(pool.hint("merge"), ["genome", "control"])
        .select(
            F.struct("unit", "control").alias("unit"), "genome", "row", F.col("c_start").alias("start"), F.col("c_end").alias("end"),
            F.col("c_size").alias("size"), (F.col("row") - F.col("c_end")).alias("dist"), F.col("c_delta").alias("delta"),
        )
    )
    stand = cut_lineage(stand)
    own = _scored(stand, matched_controls(stand, pool, enough), enough)
    return _scored(reads, controls, enough), own.select("unit.unit", "unit.control", "z", "excess")


def beside(scores: DataFrame, keys: list[str], value: str, **more: str) -> DataFrame:
    """keys, ``on`` (value at the unit's own row) and ``off`` (mean at the other rows, null without one).

    ``scores``: keys, own (whether the read is at the unit's own row) and value. ``more``: further values by what
    stands before the names of their two columns, taken in the same pass.
    """
    pick = lambda own, v: F.avg(F.when(F.col("own") == F.lit(own), F.col(v)))
    values = {"": value, **more}
    return scores.groupBy(*keys).agg(*[pick(own, v).alias(p + name) for p, v in values.items() for own, name in ((True, "on"), (False, "off"))])


def steps(value: Column) -> Column:
    return F.round(value / STEP).cast("bigint")


def _signed_rank(means: np.ndarray, least: int) -> np.ndarray:
    """Normal score of the signed-rank sum of each column, NaN below ``least`` finite values."""
    out = np.full(means.shape[1], math.nan)
    for j in range(means.shape[1]):
        x = means[:, j]
        x = x[np.isfinite(x)]
        if len(x) < least:
            continue
        x = x[x != 0]
        n = len(x)
        size = np.sort(np.abs(x))
        value, first, count = np.unique(size, return_index=True, return_counts=True)
        rank = first + (count + 1) / 2
        w = rank[np.searchsorted(value, x[x > 0])].sum()
        spread = n * (n + 1) * (2 * n + 1) / 24 - (count.astype(float) ** 3 - count).sum() / 48
        out[j] = round((w - n * (n + 1) / 4) / math.sqrt(spread), 9) if spread > 0 else 0.0
    return out


def calibrated(units: DataFrame, draws: int = 2000, block: int = 50, seed: int = 0, least: int = 5) -> DataFrame:
    """Signed-rank test of a link's lineage means, calibrated by its units' stand-ins.

    ``units``: link, lineage, unit (a whole number), x (the unit's value in ``STEP``), stand (its stand-ins' values,
    in the order of their names, null where one has none). Units without value or stand-ins take no part. In draw d
    each unit takes one stand-in. Returns link, lineages, z, draws (with ``least`` lineages or more), p_up and
    p_down: (1 + draws at least as extreme) / (1 + draws), null where z is; a link with fewer lineages has none.
    """
    used = units.where(F.col("x").isNotNull() & (F.size("stand") > 0)).select(
        "link", "lineage", F.pmod("unit", F.lit(PRIME)).alias("unit"), "x", "stand"
    )
    blocks = -(-draws // block)

    def pick(unit: np.ndarray, draw: np.ndarray, k: np.ndarray) -> np.ndarray:
        x = (unit[:, None] + draw[None, :] * 7_368_787 + seed * 15_485_863) % PRIME
        for add in (12_345, 67_891):
            x = (x * x + add) % PRIME
        return x * k[:, None] // PRIME

    def spread(batches):
        for batch in batches:
            link, lineage = (batch.column(c).to_pylist() for c in ("link", "lineage"))
            groups: dict = {}
            code = np.array([groups.setdefault(pair, len(groups)) for pair in zip(link, lineage, strict=True)], int)
            stand = batch.column("stand")
            sizes = stand.value_lengths().to_numpy()
            flat = stand.flatten()
            missing = flat.is_null().to_numpy(zero_copy_only=False)
            value = flat.fill_null(0).to_numpy()
            begin = np.cumsum(sizes) - sizes
            unit, x = batch.column("unit").to_numpy(), batch.column("x").to_numpy()
            for b in range(-1, blocks):
                if b < 0:
                    v, n = x[:, None], np.ones((len(x), 1), np.int64)
                else:
                    draw = np.arange(b * block, min(draws, (b + 1) * block), dtype=np.int64)
                    at = begin[:, None] + pick(unit, draw, sizes)
                    v, n = value[at], (~missing[at]).astype(np.int64)
                total = np.zeros((len(groups), v.shape[1]), np.int64)
                count = np.zeros_like(total)
                np.add.at(total, code, v * n)
                np.add.at(count, code, n)
                yield pa.RecordBatch.from_pydict({
                    "link": [g[0] for g in groups], "lineage": [g[1] for g in groups], "block": np.full(len(groups), b),
                    "total": list(total), "count": list(count),
                })

    def rank(key, table):
        lineage = table.column("lineage").to_pylist()
        places: dict = {}
        code = np.array([places.setdefault(x, len(places)) for x in lineage], int)
        total, count = (np.array(table.column(c).to_pylist(), np.int64) for c in ("total", "count"))
        sums, n = np.zeros((len(places), total.shape[1]), np.int64), np.zeros((len(places), total.shape[1]), np.int64)
        np.add.at(sums, code, total)
        np.add.at(n, code, count)
        with np.errstate(divide="ignore", invalid="ignore"):
            means = np.where(n > 0, sums / n, math.nan)
        z = _signed_rank(means, least)
        z = z[np.isfinite(z)]
        return pa.table({"link": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()),
                         "lineages": pa.array([len(places)], pa.int64()), "z": pa.array([z.tolist()], pa.list_(pa.float64()))})

    sums = used.mapInArrow(spread, "link string, lineage string, block bigint, total array<bigint>, count array<bigint>")
    ranked = cut_lineage(sums.groupBy("link", "block").applyInArrow(rank, "link string, block bigint, lineages bigint, z array<double>"))
    seen = ranked.where("block < 0").select("link", "lineages", F.get("z", F.lit(0)).alias("real"))
    null = ranked.where("block >= 0").join(seen.select("link", "real"), "link").groupBy("link").agg(
        F.sum(F.size("z")).alias("draws"),
        F.sum(F.size(F.filter("z", lambda v: v >= F.col("real")))).alias("_up"),
        F.sum(F.size(F.filter("z", lambda v: v <= F.col("real")))).alias("_down"),
    )
    share = lambda c: F.when(F.col("real").isNotNull(), (1 + F.col(c)) / (1 + F.col("draws")))
    return seen.join(null, "link").select("link", "lineages", F.col("real").alias("z"), "draws", share("_up").alias("p_up"), share("_down").alias("p_down"))


def specificity(reads: DataFrame, reach: int = 300, enough: int = 3, floor: float = 1e-5) -> DataFrame:
    """How far each entry of a deletion stands out of the others at a comparable distance in the same pass.

    ``reads``: pass, dist (of the entry from the deletion, 1 or more, one value each) and delta. The others are those
    within 35 % of the entry's distance, or within 60 % where fewer than ``enough`` are; entries with fewer than
    that have no row. Returns pass, dist, excess over their median, z, n_ref. A pass meets itself on logarithmic
    buckets of the distance as wide as the wider band, and both bands are counted by one aggregate.
    """
    wide = WIDE[2]
    width = math.log(1 + wide)
    behind = math.ceil(-math.log(1 - wide) / width)
    bucket = F.floor(F.log("dist") / width)
    rows = reads.where(F.col("dist").between(1, reach) & F.col("delta").isNotNull()).select("pass", "dist", "delta")
    others = rows.select("pass", F.col("dist").alias("_d"), F.col("delta").alias("_v"), bucket.alias("_bucket"))
    asked = rows.withColumn("_bucket", F.explode(F.sequence(bucket - behind, bucket + 1)))
    gap = F.abs(F.col("_d") - F.col("dist"))
    met = asked.join(others, ["pass", "_bucket"]).where((gap > 0) & (gap <= wide * F.col("dist")))
    near = gap <= NARROW[2] * F.col("dist")
    found = met.groupBy("pass", "dist").agg(
        F.first("delta").alias("delta"), F.collect_list("_v").alias("_wide"), F.collect_list(F.when(near, F.col("_v"))).alias("_near")
    )
    ref = F.when(F.size("_near") >= enough, F.col("_near")).otherwise(F.col("_wide"))
    found = found.withColumn("_ref", ref).where(F.size("_ref") >= enough).withColumn("_m", array_median(F.col("_ref")))
    mad = array_median(F.transform("_ref", lambda v: F.abs(v - F.col("_m"))))
    return found.select(
        "pass", "dist", (F.col("delta") - F.col("_m")).alias("excess"), robust_z(F.col("delta"), F.col("_m"), mad, floor).alias("z"),
        F.size("_ref").cast("bigint").alias("n_ref"),
    )
