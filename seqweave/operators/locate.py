"""Finding the window that shows a family, and moving from window to window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.operators.tiling import carry_last, over_tiles
from seqweave.session import cut_lineage

REACH = 72
LEAD = 12


class NotFound(LookupError):
    """A name or position that is not there."""


class BadRequest(ValueError):
    """A request that cannot be read."""


def next_windows(anchors: DataFrame, step: float) -> DataFrame:
    """rank and ``next``: the last anchor within ``step`` of each, at least the following
    one, null for the last. ``anchors``: rank (dense), median."""
    probes = anchors.select(
        F.col("rank").alias("from"), F.lit(None).cast("bigint").alias("rank"), (F.col("median") + step + 0.25).alias("at")
    )
    # anchors at one position stand for the last of them
    points = anchors.groupBy(F.col("median").alias("at")).agg(F.max("rank").cast("bigint").alias("rank")).select(
        F.lit(None).cast("bigint").alias("from"), "rank", "at"
    )
    seen = carry_last(points.unionByName(probes), [], F.col("rank"), "last", pos="at")
    last = anchors.agg(F.max("rank")).scalar()
    return (
        seen.where(F.col("from").isNotNull())
        .select(F.col("from").alias("rank"), F.greatest("last", F.col("from") + 1).alias("next"))
        .withColumn("next", F.when(F.col("rank") < last, F.least("next", last)))
    )


def window_chain(following: DataFrame) -> DataFrame:
    """The windows met by moving on from the first: rank, step.

    Each round doubles the stretch walked: what is known is carried over the jump
    table, then the jump table is joined with itself.
    """
    jump = cut_lineage(following.where(F.col("next").isNotNull()).select("rank", F.col("next").cast("bigint").alias("next")))
    first = following.agg(F.min("rank").cast("bigint").alias("rank"))
    chain = cut_lineage(first.select("rank", F.lit(0).cast("bigint").alias("step")))
    reach = 1
    while True:
        onward = chain.join(jump, "rank").select(F.col("next").alias("rank"), (F.col("step") + reach).alias("step"))
        if onward.isEmpty():
            return chain
        chain = cut_lineage(chain.unionByName(onward))
        hop = jump.select(F.col("rank").alias("next"), F.col("next").alias("then"))
        jump = cut_lineage(jump.join(hop, "next").select("rank", F.col("then").alias("next")))
        reach *= 2


def previous_windows(anchors: DataFrame, following: DataFrame, chain: DataFrame, step: float) -> DataFrame:
    """rank and ``previous``: the window before in the chain; elsewhere the nearest one
    whose next is this; else the first anchor at most ``step`` before."""
    ordered = over_tiles(
        chain, [], lambda w: {"chain_prev": F.lag("rank").over(w)}, before=1, pos="step"
    ).where(F.col("step") > 0).select("rank", "chain_prev")
    inverse = following.groupBy(F.col("next").alias("rank")).agg(F.max("rank").alias("inverse"))
    probes = anchors.select(
        F.col("rank").alias("from"), F.lit(None).cast("bigint").alias("rank"), (F.col("median") - step - 0.25).alias("at")
    )
    # anchors at one position stand for the first of them
    points = anchors.groupBy(F.col("median").alias("at")).agg(F.min("rank").cast("bigint").alias("rank")).select(
        F.lit(None).cast("bigint").alias("from"), "rank", "at"
    )
    far = carry_last(points.unionByName(probes), [], F.col("rank"), "far", pos="at", reverse=True)
    far = far.where(F.col("from").isNotNull()).select(F.col("from").alias("rank"), "far")
    return (
        anchors.select("rank")
        .join(ordered, "rank", "left")
        .join(inverse, "rank", "left")
        .join(far, "rank")
        .select(
            "rank",
            F.when(
                F.col("rank") > 0,
                F.coalesce("chain_prev", "inverse", F.least("far", F.col("rank") - 1)),
            ).alias("previous"),
        )
    )


def anchor_offsets(genes: DataFrame, anchors: DataFrame, family: str) -> DataFrame:
    """Per anchor and genome holding it once: genes from the anchor to the next copy of
    ``family`` on the circle. ``anchors``: family, rank."""
    is_target = F.col("family") == family
    tagged = genes.join(anchors.select("family", "rank"), "family", "left").where(F.col("rank").isNotNull() | is_target)
    ahead = carry_last(tagged, ["genome"], F.when(is_target, F.col("pos")), "ahead", reverse=True)
    first = genes.where(is_target).groupBy("genome").agg(F.min("pos").alias("first"))
    per = ahead.where(F.col("rank").isNotNull()).join(first, "genome")
    offset = F.coalesce(F.col("ahead"), F.col("first") + F.col("length")) - F.col("pos")
    return (
        per.groupBy("rank", "genome")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(offset).alias("offset"))
        .where(F.col("copies") == 1)
        .drop("copies")
    )


def best_anchor(offsets: DataFrame, reach: int = REACH, lead: int = LEAD) -> DataFrame:
    """The anchor showing the family within ``reach`` genes in most genomes; ties to the
    median offset nearest ``lead``, then to the lower anchor. One row: rank, carriers, column."""
    shown = offsets.where(F.col("offset") <= reach).groupBy("rank").agg(
        F.count(F.lit(1)).alias("carriers"), F.percentile("offset", F.lit(0.5)).alias("column")
    )
    best = F.min(F.struct((-F.col("carriers")).alias("c"), F.abs(F.col("column") - lead).alias("o"), "rank", "column"))
    return shown.agg(best.alias("b")).select(
        F.col("b.rank").alias("rank"), (-F.col("b.c")).alias("carriers"), F.col("b.column").alias("column")
    )


def other_places(offsets: DataFrame, start: int, width: int, reach: int = REACH, most: int = 3, share: float = 0.02):
    """Anchors showing the family in the genomes the window of ``start`` misses, most
    genomes first, greedily: a list of (rank, carriers, column).

    Each step is one aggregate over the genomes still missed; only its best row
    comes to the driver.
    """
    carriers = offsets.select("genome").distinct()
    total = carriers.count()
    shows = lambda rank: offsets.where((F.col("rank") == rank) & (F.col("offset") <= width - 1)).select("genome")
    left = cut_lineage(carriers.join(shows(start), "genome", "left_anti"))
    found = []
    while len(found) < most:
        gain = offsets.where(F.col("offset") <= reach).join(left, "genome", "left_semi").groupBy("rank").agg(
            F.count(F.lit(1)).alias("n"), F.percentile("offset", F.lit(0.5)).alias("column")
        )
        best = gain.orderBy(F.desc("n"), "rank").first()
        if best is None or best["n"] < max(2, share * total):
            break
        found.append((best["rank"], best["n"], best["column"]))
        left = cut_lineage(left.join(shows(best["rank"]), "genome", "left_anti"))
    return found
