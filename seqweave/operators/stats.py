"""Tests and corrections over tables of values.

Ranks, medians and running minima go through the two-level operators of
``tiling``, so one set of tests or one link may hold any number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqweave.session import cut_lineage
from seqweave.operators.tiling import grouped_quantile, running_count_by_value, value_bounds, value_chunk


def benjamini_hochberg(tests: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., p and its adjusted value ``q``, one row per distinct p; undefined p are left out.

    q(p) = min over p' >= p of p' m / (tests with p at most p').
    """
    finite = tests.where(F.col(p).isNotNull() & ~F.isnan(p))
    bounds = value_bounds(finite, p)
    ranked = running_count_by_value(finite, by, p, bounds).withColumn(
        "_raw", F.col(p) * F.col("total") / (F.col("below") + F.col("n"))
    )
    ranked = ranked.withColumn("_chunk", value_chunk(p, bounds))
    ahead = Window.partitionBy(*by).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    later = ranked.groupBy(*by, "_chunk").agg(F.min("_raw").alias("_m")).select(
        *by, "_chunk", F.min("_m").over(ahead).alias("_later")
    )
    inside = Window.partitionBy(*by, "_chunk").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.withColumn("_own", F.min("_raw").over(inside))
        .join(later, [*by, "_chunk"])
        .select(*by, p, F.least("_own", "_later", F.lit(1.0)).alias("q"))
    )


def robust_z(value: Column, median: Column, mad: Column, floor: float = 1e-6) -> Column:
    """(value - median) / (1.4826 MAD), the scale never below ``floor``."""
    return (value - median) / F.greatest(1.4826 * mad, F.lit(floor))


def median_and_mad(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, median and median absolute deviation of ``value``, for groups of any size."""
    keys = list(keys)
    known = cut_lineage(rows.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()))
    medians = grouped_quantile(known, keys, value, 0.5, "median", value_bounds(known, value))
    gaps = cut_lineage(
        known.join(medians, keys).select(*keys, "median", F.abs(F.col(value) - F.col("median")).alias("_gap"))
    )
    mads = grouped_quantile(gaps, keys, "_gap", 0.5, "mad", value_bounds(gaps, "_gap"))
    counts = gaps.groupBy(*keys).agg(F.max("median").alias("median"), F.count(F.lit(1)).alias("n"))
    return counts.join(mads, keys)


def array_median(values: Column) -> Column:
    """Median of an array."""
    n = F.size(values)
    ordered = F.array_sort(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.ceil((n - 1) / 2).cast("int")
    return (F.get(ordered, low) + F.get(ordered, high)) / 2


def signed_rank(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Wilcoxon signed-rank sums: keys, n (non-zero values), w (ranks of the positive
    ones, ties averaged), tied (whether any were) and the normal score z."""
    used = rows.where((F.col(value) != 0) & F.col(value).isNotNull() & ~F.isnan(value)).withColumn(
        "_a", F.abs(F.round(value, 12))
    )
    used = cut_lineage(used)
    ranked = running_count_by_value(used, keys, "_a", value_bounds(used, "_a"))
    positive = used.groupBy(*keys, "_a").agg(F.count_if(F.col(value) > 0).alias("_p"))
    t = F.col("n").cast("double")
    sums = (
        ranked.join(positive, [*keys, "_a"])
        .groupBy(*keys)
        .agg(
            F.max("total").alias("n"),
            F.sum(F.col("_p") * (F.col("below") + (t + 1) / 2)).alias("w"),
            F.sum(t * t * t - t).alias("_ties"),
        )
    )
    n = F.col("n").cast("double")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    return sums.select(
        *keys, "n", "w", (F.col("_ties") > 0).alias("tied"),
        F.when(var > 0, (F.col("w") - mean) / F.sqrt(var)).alias("z"),
    )


def _rank_sum_tail(n: int) -> np.ndarray:
    """P(W >= w) of the signed-rank sum without ties, for w = 0..n(n+1)/2."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        shifted = np.zeros_like(ways)
        shifted[rank:] = ways[: len(ways) - rank]
        ways = (ways + shifted) / 2
    return ways[::-1].cumsum()[::-1]


def rank_sum_p(method: str = "auto", least: int = 5):
    """One-sided p of signed-rank sums (values above zero) as a function of the columns n, w, tied and z.

    ``method``: "exact" counts all signs of n untied ranks (null for tied values), "normal" reads the tail of z,
    "auto" is exact up to 50 untied values and normal otherwise. Below ``least`` values it is NaN.
    """
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"no method {method}")

    @F.pandas_udf(T.DoubleType())
    def p(n: pd.Series, w: pd.Series, tied: pd.Series, z: pd.Series) -> pd.Series:
        tails = {}

        def one(n_, w_, tied_, z_):
            if not n_ or n_ < least:
                return math.nan
            if method == "exact" and tied_:
                return None
            if method == "exact" or (method == "auto" and n_ <= 50 and not tied_):
                if n_ not in tails:
                    tails[n_] = _rank_sum_tail(int(n_))
                return float(tails[n_][int(math.ceil(w_))])
            return 0.5 * math.erfc(z_ / math.sqrt(2))

        return pd.Series([one(*x) for x in zip(n, w, tied, z)], dtype=float)

    return p


signed_rank_p = rank_sum_p()


@F.pandas_udf(T.DoubleType())
def sign_test_p(positive: pd.Series, n: pd.Series) -> pd.Series:
    """P(at least ``positive`` of ``n`` fair signs are positive); one table of tails for each distinct n."""
    out = np.full(len(n), math.nan)
    total, hits = n.to_numpy(), positive.to_numpy()
    for m in np.unique(total[total > 0]).astype(int):
        i = np.arange(1, m + 1)
        logs = np.concatenate([[0.0], np.cumsum(np.log((m - i + 1) / i))]) - m * math.log(2)
        tails = np.append(np.minimum(1.0, np.exp(logs)[::-1].cumsum()[::-1]), 0.0)
        at = total == m
        out[at] = tails[np.clip(hits[at].astype(int), 0, m + 1)]
    return pd.Series(out)


#: Fixed values of the polynomial for the upper tail of the normal distribution, right to 7.5e-8.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def upper_tail(z: Column) -> Column:
    """One-sided p of a normal score, null for null."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = sum((F.lit(c) * F.pow(t, F.lit(i + 1)) for i, c in enumerate(TAIL)), F.lit(0.0))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def detectable_shift(mad: Column, n: Column, tests: int = 1, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Smallest shift a one-sided signed-rank test finds with the given power; Bonferroni over ``tests``."""
    normal = NormalDist()
    factor = (normal.inv_cdf(1 - alpha / max(1, tests)) + normal.inv_cdf(power)) * math.sqrt(math.pi / 3)
    scale = 1.4826 * mad
    return F.when((n >= 2) & (scale > 0), F.lit(factor) * scale / F.sqrt(n.cast("double")))


def verdict(level: float = 0.05) -> Column:
    """Decision table over one row per link.

    Uses tested, q_effect, p_sign, q_opposite, half0, half1 (medians), q_specific,
    q_specific_raw and their ``_opp`` mirrors.
    """
    low = lambda c: F.coalesce(F.col(c) < level, F.lit(False))
    up = (F.col("half0") > 0) & (F.col("half1") > 0)
    down = (F.col("half0") < 0) & (F.col("half1") < 0)
    own = low("q_effect") & low("p_sign") & F.coalesce(up, F.lit(False))
    opposite = low("q_opposite") & F.coalesce(down, F.lit(False))
    return (
        F.when(~F.col("tested"), "nt")
        .when(own & low("q_specific") & low("q_specific_raw"), "knows")
        .when(own, "not specific")
        .when(opposite & low("q_specific_opp") & low("q_specific_raw_opp"), "opposite")
        .when(opposite, "not specific (opposite)")
        .otherwise("none")
    )
