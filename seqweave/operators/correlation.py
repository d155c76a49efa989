"""Linear and rank correlation of items over units, from sparse values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.operators.pairs import pair_products
from seqweave.operators.tiling import running_count_by_value, value_bounds


def average_ranks(values: DataFrame, units: int) -> DataFrame:
    """item, unit, value and ``rank`` above that of the absent units, ties averaged.

    Units without a row hold 0, which ranks as one group of ties with its number known; values must be above 0. Rank
    numbers come from counts of distinct values in pieces, so an item may hold any number of units.
    """
    ranked = running_count_by_value(values, ["item"], "value", value_bounds(values, "value"))
    absent = F.lit(units) - F.col("total")
    rank = absent + F.col("below") + (F.col("n") + 1) / 2
    zero = (absent + 1) / 2
    above = ranked.select("item", "value", F.when(absent > 0, rank - zero).otherwise(rank).alias("rank"))
    return values.join(above.hint("merge"), ["item", "value"])


def rank_correlation(values: DataFrame, units: int) -> DataFrame:
    """a, b, shared, pearson, spearman of all pairs of items that have a unit in common.

    ``values``: item, unit, value (above 0, one row each); the other of ``units`` hold 0. Ranks are shifted so that
    an absent unit counts 0, which leaves the correlation as it is, so both are sums over common units - one blocked
    product - and sums over each item's own. Null where an item is constant.
    """
    rows = average_ranks(values.select("item", "unit", F.col("value").cast("double").alias("value")), units)
    sums = rows.groupBy("item").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"),
        F.sum("rank").alias("rs"), F.sum(F.col("rank") * F.col("rank")).alias("rq"))
    both = pair_products(rows.withColumn("one", F.lit(1.0)), "item", "unit", ["value", "rank", "one"])
    side = lambda name: sums.select(F.col("item").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("s", "q", "rs", "rq")])
    met = both.join(side("a"), "a").join(side("b"), "b")

    def correlation(product, s, q):
        over = units * F.col(product) - F.col(f"a_{s}") * F.col(f"b_{s}")
        spread = lambda x: units * F.col(f"{x}_{q}") - F.col(f"{x}_{s}") * F.col(f"{x}_{s}")
        return F.when((spread("a") > 1e-9) & (spread("b") > 1e-9), over / F.sqrt(spread("a") * spread("b")))

    return met.select("a", "b", F.col("one").cast("bigint").alias("shared"), correlation("value", "s", "q").alias("pearson"),
                      correlation("rank", "rs", "rq").alias("spearman"))
