"""Cuts and layout of a merge tree, and halves that keep lineages whole.

A tree is its list of merges (kept, dropped, height, size), one row for each cluster that another took in. Chains of
such steps are followed by doubling: every round joins the table with itself, so a chain of n steps takes log n rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators.tiling import number_rows, running_count_by_value, value_bounds
from seqweave.session import cut_lineage


def cut_height(merges: DataFrame, leaves: int, most: int) -> float | None:
    """The least height at which ``leaves`` fall into at most ``most`` clusters, None if they do without a merge."""
    needed = leaves - most
    if needed <= 0:
        return None
    ranked = running_count_by_value(merges, [], "height", value_bounds(merges, "height"))
    row = ranked.where((F.col("below") < needed) & (F.col("below") + F.col("n") >= needed)).select("height").first()
    if row is None:
        raise ValueError(f"the tree has fewer than {needed} merges, so {most} clusters can't be had")
    return row[0]


def _followed(steps: DataFrame) -> DataFrame:
    """node, root and way for steps node -> parent with a length: where each node's chain ends, and how long it is."""
    state = cut_lineage(steps.select("node", F.col("parent").alias("root"), F.col("length").cast("bigint").alias("way")))
    while True:
        ahead = state.select(F.col("node").alias("root"), F.col("root").alias("_r"), F.col("way").alias("_w"))
        nxt = cut_lineage(state.join(ahead, "root", "left").select(
            "node", F.coalesce("_r", "root").alias("root"), (F.col("way") + F.coalesce("_w", F.lit(0))).alias("way"),
            F.col("_r").isNotNull().alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.drop("moved")
        state = nxt.drop("moved")


def _steps(merges: DataFrame) -> DataFrame:
    """node, parent and length, the leaves that the parent drew before it: its size ahead of the merge."""
    earlier = Window.partitionBy("kept").orderBy("size")
    before = F.coalesce(F.lag("size").over(earlier), F.lit(1))
    return merges.select(F.col("dropped").alias("node"), F.col("kept").alias("parent"), before.alias("length"))


def flat_clusters(leaves: DataFrame, merges: DataFrame, most: int) -> DataFrame:
    """leaf, cluster: the tree cut so that at most ``most`` clusters remain.

    All merges up to the least sufficient height are made, equal ones together. A cluster is named by its first leaf.
    """
    height = cut_height(merges, leaves.count(), most)
    if height is None:
        return leaves.select("leaf", F.col("leaf").alias("cluster"))
    ends = _followed(_steps(merges.where(F.col("height") <= height))).select(F.col("node").alias("leaf"), "root")
    return leaves.select("leaf").join(ends, "leaf", "left").select("leaf", F.coalesce("root", "leaf").alias("cluster"))


def leaf_order(leaves: DataFrame, merges: DataFrame) -> DataFrame:
    """leaf, tree (its root) and place: the order of the leaves when the tree is drawn, a kept cluster before the one it took in.

    A leaf's place is the sum of the sizes that stood before it along its chain of merges.
    """
    ends = _followed(_steps(merges)).select(F.col("node").alias("leaf"), "root", "way")
    return leaves.select("leaf").join(ends, "leaf", "left").select(
        "leaf", F.coalesce("root", "leaf").alias("tree"), F.coalesce("way", F.lit(0)).cast("bigint").alias("place"))


def greedy_halves(sizes: DataFrame, chunk: Column | None = None) -> DataFrame:
    """lineage, n, side: lineages to two sides, the largest first, each to the lighter side (to 0 if both weigh the same).

    ``sizes``: lineage, n (at least 1), one row each; equal sizes go by name. Lineages of one size are dealt
    together: some go to the lighter side until it is the heavier, the rest alternate. So only distinct sizes pass
    one after the other, of which N genomes have less than sqrt(2 N). ``chunk`` cuts the order of names into pieces
    (default: their first two characters).
    """
    names = number_rows(sizes, ["n"], ["lineage"], F.substring(F.col("lineage").cast("string"), 1, 2) if chunk is None else chunk, "_r")
    listed = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "m")))).alias("s"))

    def deal(batches):
        for batch in batches:
            for row in batch.column("s").to_pylist():
                load, out = [0, 0], []
                for x in row:
                    n, m, gap = x["n"], x["m"], load[1] - load[0]
                    lead = 0 if gap >= 0 else 1
                    first = min(m, gap // n + 1 if gap >= 0 else -(gap // n))
                    rest = m - first
                    load[lead] += n * (first + rest // 2)
                    load[1 - lead] += n * (rest - rest // 2)
                    out.append((n, lead, first))
                yield pa.RecordBatch.from_pydict({k: [o[i] for o in out] for i, k in enumerate(("n", "lead", "first"))})

    dealt = listed.mapInArrow(deal, "n bigint, lead bigint, first bigint")
    lead, past = F.col("lead"), F.col("_r") - F.col("first")
    side = F.when(past < 0, lead).when(past % 2 == 0, 1 - lead).otherwise(lead)
    return names.withColumn("n", F.col("n").cast("bigint")).join(dealt, "n").select("lineage", "n", side.cast("bigint").alias("side"))


def hashed_halves(lineages: DataFrame) -> DataFrame:
    """lineage, side: the side by the parity of the CRC-32 of the name."""
    return lineages.select("lineage", (F.crc32(F.col("lineage").cast("string")) % 2).cast("bigint").alias("side")).distinct()


def largest_against_rest(sizes: DataFrame) -> DataFrame:
    """lineage, n, side: the largest lineage (the first by name of equal ones) on side 1, all others on side 0."""
    top = sizes.agg(F.min(F.struct((-F.col("n")).alias("n"), "lineage")).alias("t")).select(F.col("t.lineage").alias("_top"))
    # one row
    return sizes.join(F.broadcast(top)).select("lineage", "n", (F.col("lineage") == F.col("_top")).cast("bigint").alias("side"))
