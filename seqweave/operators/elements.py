"""Where an element sits in each genome, and where an absent one would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.operators.graph import mode_by
from seqweave.operators.sequence import backbone_flanks, circular_blocks
from seqweave.operators.tiling import median_position
from seqweave.session import cut_lineage

KEY = ["region", "genome"]


def region_presence(genes: DataFrame, members: DataFrame, carry: float = 0.5) -> DataFrame:
    """region, genome, share of the region's families held, present (share at least ``carry``)."""
    size = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
    held = genes.select("genome", "family").distinct().join(members, "family")
    return (
        held.groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("held"))
        .join(size, "region")
        .select(*KEY, (F.col("held") / F.col("size")).alias("share"), (F.col("held") / F.col("size") >= carry).alias("present"))
    )


def _nearest_block(blocks: DataFrame, ref: Column) -> DataFrame:
    """The block whose middle is nearest ``ref``, larger ones first."""
    middle = (F.col("start") + F.col("end")) / 2
    best = F.min(F.struct(F.abs(middle - ref).alias("d"), (-F.col("genes")).alias("g"), "start", "end"))
    return blocks.groupBy(*KEY).agg(best.alias("b")).select(
        *KEY, F.col("b.start").alias("start"), F.col("b.end").alias("end"), (-F.col("b.g")).alias("genes")
    )


def locate_elements(
    genes: DataFrame,
    members: DataFrame,
    regions: DataFrame,
    carry: float = 0.5,
    gap: int = 30,
    slack: int = 5,
    near: int = 200,
    reach: int = 500,
) -> DataFrame:
    """Place of every region in every genome that has one for it.

    ``genes``: genome, pos, length, family, spot, bb (backbone family);
    ``members``: region, family; ``regions``: region, spot.

    In a genome with genes of the region's spot, the element is its largest block
    there (``slack`` genes around); otherwise the block nearest the point between
    the backbone families that flank the region in its carriers, at most ``near``
    genes away. Returns region, genome, ins (insertion point), how, start, end,
    genes; start is null where only the point is known.
    """
    own = cut_lineage(genes.join(members, "family").select(*KEY, "pos", "length"))
    spots = genes.where(F.col("spot").isNotNull()).groupBy("genome", "spot").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    at_spot = cut_lineage(regions.where(F.col("spot").isNotNull()).join(spots, "spot").select(*KEY, "lo", "hi"))
    inside = own.join(at_spot, KEY).where(
        F.col("pos").between(F.col("lo") - slack, F.col("hi") + slack)
    )
    lo = inside.groupBy(*KEY).agg(F.min("lo").alias("lo"))
    largest = F.min(F.struct((-F.col("genes")).alias("g"), F.abs(F.col("start") - F.col("lo")).alias("d"), "start", "end"))
    spot_blocks = (
        circular_blocks(inside.select(*KEY, "pos", "length"), KEY, gap)
        .join(lo, KEY)
        .groupBy(*KEY)
        .agg(largest.alias("b"))
        .select(*KEY, F.col("b.start").alias("start"), F.col("b.end").alias("end"), (-F.col("b.g")).alias("genes"))
    )
    by_spot = at_spot.join(spot_blocks, KEY, "left").select(
        *KEY, F.col("lo").alias("ins"), F.lit("spot").alias("how"), "start", "end", "genes"
    )

    blocks = cut_lineage(circular_blocks(own, KEY, gap))
    flank = flank_families(genes, own, blocks, at_spot, region_presence(genes, members, carry), reach)
    once = genes.groupBy("genome", "family").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")).where(F.col("n") == 1)
    side = lambda c: once.select("genome", F.col("family").alias(c), F.col("pos").alias(f"{c}_pos"))
    lefts = flank.join(side("left"), "left").select(*KEY, "left_pos")
    rights = flank.join(side("right"), "right").select(*KEY, "right_pos")
    points = (
        lefts.join(rights, KEY, "full")
        .select(*KEY, F.coalesce(F.col("left_pos") + 1, F.col("right_pos")).alias("ins"))
        .join(at_spot, KEY, "left_anti")
    )
    chosen = _nearest_block(blocks.join(points, KEY), F.col("ins"))
    placed = points.join(chosen, KEY, "left").withColumn(
        "ok", F.coalesce(F.abs(F.col("start") - F.col("ins")) <= near, F.lit(False))
    )
    keep = lambda c: F.when(F.col("ok"), F.col(c)).alias(c)
    by_flanks = placed.select(*KEY, "ins", F.lit("flanks").alias("how"), keep("start"), keep("end"), keep("genes"))
    return by_spot.unionByName(by_flanks)


def flank_families(
    genes: DataFrame, own: DataFrame, blocks: DataFrame, at_spot: DataFrame, presence: DataFrame, reach: int
) -> DataFrame:
    """Most frequent backbone families before and after the region in its carriers: region, left, right."""
    copies = genes.groupBy("genome", "family").agg(F.count(F.lit(1)).alias("_copies"))
    single = genes.join(copies, ["genome", "family"])
    around = backbone_flanks(single, F.col("bb") & (F.col("_copies") == 1), reach).select("genome", "pos", "left", "right")
    center = median_position(own, ["region"], "pos", "center")
    carriers = presence.where("present").select(*KEY)
    aimed = blocks.join(carriers, KEY).join(at_spot.select(*KEY, "lo"), KEY, "left").join(center, "region")
    best = cut_lineage(_nearest_block(aimed, F.coalesce(F.col("lo").cast("double"), F.col("center"))))
    tips = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("pos")) for s, c in (("left", "start"), ("right", "end"))])
    tips = best.select(*KEY, F.explode(tips).alias("t")).select(*KEY, "t.*")
    met = cut_lineage(tips.join(around, ["genome", "pos"]).select("region", "side", "left", "right"))  # neighbours are read once
    side = lambda s: mode_by(met.where(F.col("side") == s), "region", s, s)
    return side("left").join(side("right"), "region", "full")


def insertion_rules(
    genes: DataFrame, elements: DataFrame, presence: DataFrame, share: float = 0.6, valid: float = 0.5, window: int = 40
) -> DataFrame:
    """How the place of an absent element is read: region, side (pred or succ), family, share, valid.

    The family just before the element's first gene (or just after its last) must be
    the same in ``share`` of the carriers, and taking its copy nearest the insertion
    point, within ``window`` genes, must give the element's real place in ``valid`` of them.
    """
    carriers = elements.where(F.col("start").isNotNull()).join(presence.where("present").select(*KEY), KEY)
    length = genes.groupBy("genome").agg(F.max("length").alias("length"))
    ends = cut_lineage(carriers.join(length, "genome"))
    rules = []
    for side, place, shift in (
        ("pred", F.pmod(F.col("start") - 1, F.col("length")), 1),
        ("succ", F.pmod(F.col("end") + 1, F.col("length")), 0),
    ):
        beside = ends.withColumn("pos", place).join(genes.select("genome", "pos", "family"), ["genome", "pos"])
        counts = beside.groupBy("region", "family").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("region").agg(
            F.min(F.struct((-F.col("n")).alias("n"), F.col("family").alias("f"))).alias("b"), F.sum("n").alias("total")
        ).select("region", F.col("b.f").alias("family"), (-F.col("b.n") / F.col("total")).alias("share"))
        want = F.col("start") if shift else F.pmod(F.col("end") + 1, F.col("length"))
        copies = genes.select("genome", "family", F.col("pos").alias("copy"))
        near = (
            ends.withColumn("want", want).join(best, "region").join(copies, ["genome", "family"])
            .where(F.abs(F.col("copy") - F.col("ins")) <= window)
            .groupBy(*KEY, "want")
            .agg(F.min(F.struct(F.abs(F.col("copy") - F.col("ins")).alias("d"), "copy"))["copy"].alias("copy"))
        )
        hits = near.groupBy("region").agg(F.count_if(F.col("copy") + shift == F.col("want")).alias("hits"))
        total = ends.groupBy("region").agg(F.count(F.lit(1)).alias("carriers"))
        rules.append(
            best.join(total, "region").join(hits, "region", "left").select(
                "region", F.lit(side).alias("side"), "family", "share",
                (F.coalesce("hits", F.lit(0)) / F.col("carriers")).alias("valid"),
            )
        )
    both = rules[0].unionByName(rules[1])
    return both.withColumn("usable", (F.col("share") >= share) & (F.col("valid") >= valid))


def absent_places(genes: DataFrame, elements: DataFrame, rules: DataFrame, presence: DataFrame, window: int = 40) -> DataFrame:
    """Row an absent element would take in each genome without it: region, genome, row, side."""
    order = F.when(F.col("side") == "pred", 0).otherwise(1)
    copies = genes.select("genome", "family", F.col("pos").alias("copy"), "length")
    found = (
        elements.join(presence.where("present").select(*KEY), KEY, "left_anti")
        .join(rules.where("usable"), "region")
        .join(copies, ["genome", "family"])
        .where(F.abs(F.col("copy") - F.col("ins")) <= window)
        .withColumn("row", F.col("copy") + F.when(F.col("side") == "pred", 1).otherwise(0))
    )
    nearest = found.groupBy(*KEY, "side").agg(
        F.min(F.struct(F.abs(F.col("copy") - F.col("ins")).alias("d"), "copy", "row", "length")).alias("m")
    ).where(F.col("m.row") < F.col("m.length"))
    best = F.min(F.struct(order.alias("o"), F.col("m.row").alias("row"), "side"))
    return nearest.groupBy(*KEY).agg(best.alias("b")).select(*KEY, F.col("b.row").alias("row"), F.col("b.side").alias("side"))
