"""Sums over shared features for all pairs of items, as a blocked matrix product.

Rows (item, feature, values) are cut into blocks of items and chunks of features;
Spark ships each block pair of a chunk to one task, which multiplies two small
matrices and returns only summed pairs. Pairs are never emitted per shared
feature, and no task holds more than two blocks of one chunk, however many rows a
group or a feature has. A block paired with itself is shipped once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS_PER_BLOCK = 1024
#: Rows of one block that a task holds, about.
ROWS_PER_CHUNK = 150_000


def _product(values: Sequence[str], by: Sequence[str], symmetric: bool, slice_width: int = 4096):
    values, by = list(values), list(by)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        same_block = symmetric and group["_bi"].iloc[0] == group["_bj"].iloc[0]
        left, right = (group, group) if same_block else (group[group["_side"] == 0], group[group["_side"] == 1])
        items_a, code_a = np.unique(left["item"].to_numpy(), return_inverse=True)
        items_b, code_b = np.unique(right["item"].to_numpy(), return_inverse=True)
        shared, inverse = np.unique(
            np.concatenate([left["feature"].to_numpy(), right["feature"].to_numpy()]), return_inverse=True
        )
        fa, fb = inverse[: len(left)], inverse[len(left):]
        sums = [np.zeros((len(items_a), len(items_b))) for _ in values]
        for start in range(0, len(shared), slice_width):
            stop = start + slice_width
            ma, mb = (fa >= start) & (fa < stop), (fb >= start) & (fb < stop)
            for s, value in zip(sums, values):
                x = np.zeros((len(items_a), min(stop, len(shared)) - start))
                y = np.zeros((len(items_b), min(stop, len(shared)) - start))
                np.add.at(x, (code_a[ma], fa[ma] - start), left[value].to_numpy()[ma])
                np.add.at(y, (code_b[mb], fb[mb] - start), right[value].to_numpy()[mb])
                s += x @ y.T
        keep = np.zeros((len(items_a), len(items_b)), bool)
        for s in sums:
            keep |= s != 0
        if same_block:
            keep &= items_a[:, None] < items_b[None, :]
        i, j = np.nonzero(keep)
        a, b = items_a[i], items_b[j]
        if symmetric:
            swap = a > b
            a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = {k: group[k].iloc[0] for k in by}
        frame = pd.DataFrame({"a": a, "b": b, **{v: s[i, j] for v, s in zip(values, sums)}})
        for k, v in out.items():
            frame[k] = v
        return frame[[*by, "a", "b", *values]]

    return run


def pair_products(
    left: DataFrame,
    item: str,
    feature: str,
    values: Sequence[str] = (),
    by: Sequence[str] = (),
    right: DataFrame | None = None,
) -> DataFrame:
    """by..., a, b and, per value column, the sum over shared features of value_a * value_b.

    Without ``values`` the number of shared features comes back as ``shared``.
    With ``right`` the pairs are (left item, right item); otherwise each
    unordered pair of ``left`` items with a < b. Items and features must be
    unique pairs within ``by``. Pairs whose sums are all zero are left out.
    """
    symmetric = right is None
    names = list(values) or ["shared"]

    def shaped(df):
        cols = [F.col(v).cast("double").alias(v) for v in values] or [F.lit(1.0).alias("shared")]
        return df.select(*by, F.col(item).alias("item"), F.col(feature).alias("feature"), *cols)

    a = shaped(left)
    b = a if symmetric else shaped(right)
    size = a.agg(F.approx_count_distinct("item").alias("i"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(1, -(-int(size["i"] or 0) // ITEMS_PER_BLOCK))
    chunks = max(1, -(-int(size["n"] or 0) // (ROWS_PER_CHUNK * blocks)))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    all_blocks = F.array(*[F.lit(i) for i in range(blocks)])

    def spread(df, side):
        mine, other = ("_bi", "_bj") if side == 0 else ("_bj", "_bi")
        tagged = df.withColumn(mine, block).withColumn("_side", F.lit(side))
        tagged = tagged.withColumn(other, F.explode(all_blocks))
        if symmetric:
            tagged = tagged.where(F.col("_bi") <= F.col("_bj") if side == 0 else F.col("_bi") < F.col("_bj"))
        return tagged

    rows = spread(a, 0).unionByName(spread(b, 1)).withColumn(
        "_chunk", F.pmod(F.xxhash64("feature"), F.lit(chunks))
    )
    schema = T.StructType(
        [rows.schema[k] for k in by]
        + [T.StructField(n, rows.schema["item"].dataType) for n in ("a", "b")]
        + [T.StructField(v, T.DoubleType()) for v in names]
    )
    partial = rows.groupBy(*by, "_chunk", "_bi", "_bj").applyInPandas(
        _product(names, by, symmetric), schema
    )
    return partial.groupBy(*by, "a", "b").agg(*[F.sum(v).alias(v) for v in names])
