"""Controls of an influence profile, each held against the others, and panels of control deletions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.session import cut_lineage


def _without(ordered: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Median of a sorted array without the element at each rank."""
    n = len(ordered)
    low, high = (n - 2) // 2, (n - 1) // 2
    at = lambda k: ordered[np.minimum(np.where(k < rank, k, k + 1), n - 1)]
    return (at(low) + at(high)) / 2


def leave_one_out(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and median absolute deviation of the others, for each of two or more values.

    The values are sorted once. Without one of them the median is one of three middle points; the deviations from
    each of these are sorted once more, so no value regroups the others.
    """
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), int)
    rank[order] = np.arange(len(values))
    median = _without(values[order], rank)
    spread = np.empty(len(values))
    for m in np.unique(median):
        gap = np.abs(values - m)
        by = np.argsort(gap, kind="stable")
        place = np.empty(len(values), int)
        place[by] = np.arange(len(values))
        mine = median == m
        spread[mine] = _without(gap[by], place[mine])
    return median, spread


def influence_null(profile: DataFrame, controls: DataFrame, most: int = 8, enough: int = 3, level: float = 3.0, floor: float = 1e-6) -> DataFrame:
    """How far each deletion is felt beyond its controls, and how often one of these is felt as far beyond the others.

    ``profile``: pass, bin, mean_abs; ``controls``: unit, control (both passes) and gap, the ``most`` with the least gap
    (then name) being used. A bin's z is robust against the controls' values there, for a control against the other
    controls', where ``enough`` are. Returns unit, controls, radius (last bin beyond ``level``, plus one), contiguous
    (leading bins beyond it), beyond (their number), broad (median ratio to the controls' median), and p_radius,
    p_contiguous, p_beyond, p_broad = (1 + controls at least as high) / (1 + controls). Only bins that the unit has count.
    """
    near = Window.partitionBy("unit").orderBy("gap", "control")
    chosen = cut_lineage(controls.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= most).select("unit", "control"))
    own = profile.select(F.col("pass").alias("unit"), "bin", F.col("mean_abs").alias("own"))
    theirs = profile.select(F.col("pass").alias("control"), "bin", F.col("mean_abs").alias("v"))
    listed = chosen.join(theirs.hint("merge"), "control").groupBy("unit", "bin").agg(F.array_sort(F.collect_list(F.struct("control", "v"))).alias("c"))
    rows = own.join(chosen.select("unit").distinct().hint("merge"), "unit", "left_semi").join(listed.hint("merge"), ["unit", "bin"], "left")

    def score(batches):
        for batch in batches:
            out = {k: [] for k in ("unit", "who", "bin", "z", "ratio")}
            for unit, bin_, x, c in zip(*(batch.column(k).to_pylist() for k in ("unit", "bin", "own", "c")), strict=True):
                c = c or []
                v = np.array([e["v"] for e in c], float)
                med = float(np.median(v)) if len(v) else math.nan
                mad = float(np.median(np.abs(v - med))) if len(v) else math.nan
                lines = [(None, x, med, mad, len(v))]
                if len(v):
                    medians, mads = leave_one_out(v) if len(v) > 1 else (np.full(1, math.nan), np.full(1, math.nan))
                    lines += [(e["control"], y, m, d, len(v) - 1) for e, y, m, d in zip(c, v.tolist(), medians.tolist(), mads.tolist(), strict=True)]
                for who, y, m, d, n in lines:
                    for k, value in zip(out, (unit, who, bin_, (y - m) / max(1.4826 * d, floor) if n >= enough else None,
                                              y / m if n and m > 0 else None), strict=True):
                        out[k].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("unit", pa.int64()), ("who", pa.int64()), ("bin", pa.int64()), ("z", pa.float64()), ("ratio", pa.float64())]))

    scored = cut_lineage(rows.mapInArrow(score, "unit bigint, who bigint, bin bigint, z double, ratio double"))
    far = F.coalesce(F.round("z", 9) >= level, F.lit(False))
    bins = scored.groupBy("unit", "who").agg(
        F.coalesce(F.max(F.when(far, F.col("bin"))) + 1, F.lit(0)).alias("radius"),
        F.coalesce(F.min(F.when(~far, F.col("bin"))), F.max("bin") + 1).alias("contiguous"),
        F.count_if(far).alias("beyond"), F.round(F.percentile("ratio", F.lit(0.5)), 9).alias("broad"),
    )
    names = ("radius", "contiguous", "beyond", "broad")
    real = bins.where("who is null").drop("who")
    null = bins.where("who is not null").select("unit", *[F.col(n).alias(f"_{n}") for n in names])
    met = real.join(null.hint("merge"), "unit", "left")
    share = lambda n: (1 + F.count_if(F.col(f"_{n}") >= F.col(n))) / (1 + F.count(f"_{n}"))
    return met.groupBy("unit", *names).agg(F.count("_radius").alias("controls"), *[share(n).alias(f"p_{n}") for n in names])


def control_panel(elements: DataFrame, targets: DataFrame) -> DataFrame:
    """Control deletions of given sizes in every genome, spread over elements and along the genome.

    ``elements``: genome, element, start, end (whole runs of genes); ``targets``: genome, step (0, 1, ...), size, the
    larger sizes first. Each step takes a free stretch of its size from one element: of the elements that have one,
    those with the fewest uses; of these the one farthest from all stretches taken so far; ties by an md5. Which free
    stretch of it is fixed by arithmetic. Returns genome, step, element, first, last, size; steps without room
    have no row.

    All genomes take their step together: one aggregate finds each genome's element, one join marks the stretch,
    so a genome's elements are never gathered. There are as many rounds as steps.
    """
    state = cut_lineage(elements.select(
        "genome", "element", "start", "end", F.lit(0).alias("uses"), F.lit(None).cast("double").alias("near"),
        F.array_repeat(F.lit(True), (F.col("end") - F.col("start") + 1).cast("int")).alias("free"),
    ))
    targets = cut_lineage(targets.select("genome", "step", F.col("size").cast("int").alias("size")))
    last = targets.agg(F.max("step")).first()[0]
    taken = []
    for step in range(0 if last is None else last + 1):
        now = state.join(targets.where(F.col("step") == step), "genome")
        # size >= 1, so the range is empty where the element is too short
        places = F.when(F.size("free") >= F.col("size"), F.sequence(F.lit(0), F.size("free") - F.col("size"))).otherwise(F.array().cast("array<int>"))
        room = F.filter(places, lambda s: F.forall(F.slice("free", s + 1, F.col("size")), lambda x: x))
        options = now.withColumn("room", room).where(F.size("room") > 0)
        middle = (F.col("start") + F.col("end")) / 2
        tie = F.md5(F.concat_ws("|", F.col("genome").cast("string"), F.lit(str(step)), F.col("element").cast("string")))
        turn = F.pmod(F.col("genome") * 31 + step * 17 + F.col("element"), F.size("room").cast("bigint")).cast("int")
        first = F.col("start") + F.element_at("room", turn + 1)
        best = F.min_by(F.struct("element", first.alias("first"), "size"), F.struct("uses", F.coalesce(-F.col("near"), F.lit(0.0)).alias("far"), tie.alias("tie")))
        picked = cut_lineage(options.groupBy("genome").agg(best.alias("p")).select("genome", F.lit(step).alias("step"), "p.element", "p.first", "p.size"))
        taken.append(picked)
        told = picked.select("genome", F.col("element").alias("_e"), F.col("first").alias("_f"), F.col("size").alias("_s"))
        met = state.join(told, "genome", "left")
        mine = F.coalesce(F.col("element") == F.col("_e"), F.lit(False))
        gap = F.abs(F.col("_f") + (F.col("_s") - 1) / 2 - middle)
        inside = lambda x, i: x & ~((i >= F.col("_f") - F.col("start")) & (i < F.col("_f") - F.col("start") + F.col("_s")))
        state = cut_lineage(met.select(
            "genome", "element", "start", "end", (F.col("uses") + mine.cast("int")).alias("uses"), F.least("near", gap).alias("near"),
            F.when(mine, F.transform("free", inside)).otherwise(F.col("free")).alias("free")))
    out = None
    for picked in taken:
        out = picked if out is None else out.unionByName(picked)
    if out is None:
        return elements.select("genome", F.lit(0).alias("step"), "element", F.col("start").alias("first"), F.lit(0).alias("size")).limit(0).select(
            "genome", "step", "element", "first", F.col("first").alias("last"), "size")
    return out.select("genome", "step", "element", "first", (F.col("first") + F.col("size") - 1).alias("last"), "size")
