"""Anchoring, orienting, windowing and segmenting circular sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators.tiling import (
    TILE,
    carry_last,
    islands,
    median_position,
    number_rows,
    over_tiles,
    running_sum,
    unroll_circular,
)
from seqweave.session import cut_lineage


def anchor_families(genes: DataFrame, names: list[str]) -> DataFrame:
    """The most frequent family among the genes of each name; ``priority`` is the
    place of the name in ``names``. At most one row per name."""
    counts = (
        genes.where(F.col("name").isin(names)).groupBy("name", "family").agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("name").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("family").alias("f")))["f"].alias("family")
    )
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")) - 1
    return best.select("name", "family", place.alias("priority"))


def anchor_genes(genes: DataFrame, families: DataFrame) -> DataFrame:
    """One anchor per genome: the first family in priority, then the longest contig.

    One aggregate, so a genome with many candidates is folded before the shuffle.
    genome, contig, start (0 primary, 1 fallback), anchor_idx, anchor_strand.
    """
    # ``families`` has one row per anchor name
    candidates = genes.join(F.broadcast(families.select("family", "priority")), "family")
    best = F.min(
        F.struct(
            "priority",
            (-F.col("length")).alias("neg_length"),
            "contig",
            "idx",
            "strand",
        )
    )
    return candidates.groupBy("genome").agg(best.alias("a")).select(
        "genome",
        F.col("a.contig").alias("contig"),
        F.col("a.priority").alias("start"),
        F.col("a.idx").alias("anchor_idx"),
        F.col("a.strand").alias("anchor_strand"),
    )


def longest_contig(genes: DataFrame) -> DataFrame:
    contigs = genes.groupBy("genome", "contig").agg(F.count(F.lit(1)).alias("length"))
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("contig").alias("c")))
    return contigs.groupBy("genome").agg(best["c"].alias("contig"), (-best["l"]).alias("length"))


def rotate(genes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Position from the anchor, read in the anchor's direction, on its contig.

    Column arithmetic after one join. ``offset`` is the signed distance before
    wrapping, ``pos`` the position on the circle.
    """
    d = F.when(F.col("anchor_strand") == "-", F.lit(-1)).otherwise(F.lit(1))
    return (
        genes.join(anchors, ["genome", "contig"])
        .withColumn("offset", d * (F.col("idx") - F.col("anchor_idx")))
        .withColumn("pos", F.pmod(F.col("offset"), F.col("length")))
    )


def window_walk(rotated: DataFrame, width: int) -> DataFrame:
    """The first ``width`` columns; a linear contig stops at its end."""
    inside = F.col("pos") < F.lit(width) - F.col("start")
    reachable = F.col("circular") | (F.col("offset") >= 0)
    return rotated.where(inside & reachable).withColumn("column", F.col("pos") + F.col("start"))


def region_window(genes: DataFrame, family: str, width: int) -> DataFrame:
    """Window of ``width`` columns from a family in every genome holding it once."""
    anchor = (
        genes.where(F.col("family") == family)
        .groupBy("genome")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("anchor_pos"))
        .where(F.col("n") == 1)
        .drop("n")
    )
    column = F.pmod(F.col("pos") - F.col("anchor_pos"), F.col("length"))
    return genes.join(anchor, "genome").withColumn("column", column).where(F.col("column") < width)


def upstream_paths(
    genes: DataFrame, depths: list[int], value: str = "family", full: bool = True, size: int = TILE
) -> DataFrame:
    """The last L values before each gene as one key ``path_L`` per depth.

    With ``full`` a gene with fewer than L genes before it has no key.
    """
    deepest = max(depths)
    rows = over_tiles(
        genes,
        ["genome"],
        lambda w: {"_up": F.collect_list(F.col(value).cast("string")).over(w.rowsBetween(-deepest, -1))},
        before=deepest,
        size=size,
    )
    for depth in depths:
        tail = F.slice("_up", -F.least(F.lit(depth), F.size("_up")), F.lit(depth))
        key = F.when(F.size("_up") > 0, F.array_join(tail, ">")).otherwise(F.lit(""))
        if full:
            key = F.when(F.size("_up") >= depth, key)
        rows = rows.withColumn(f"path_{depth}", key)
    return rows.drop("_up")


def nearest_upstream(genes: DataFrame, sites: Column, reach: int, size: int = TILE) -> DataFrame:
    """For each site, the nearest earlier copy of every family within ``reach`` genes."""
    seen = over_tiles(
        genes.withColumn("_site", sites),
        ["genome"],
        lambda w: {
            "_up": F.collect_list(F.struct("pos", "family", "allele")).over(w.rowsBetween(-reach, -1))
        },
        before=reach,
        size=size,
    ).where("_site")
    rows = seen.select("genome", F.col("pos").alias("site"), F.explode("_up").alias("u"))
    nearest = F.max(F.struct("u.pos", "u.allele"))
    return rows.groupBy("genome", "site", F.col("u.family").alias("family")).agg(nearest.alias("m")).select(
        "genome", "site", "family", F.col("m.pos").alias("pos"), F.col("m.allele").alias("allele")
    )


def genome_count(genes: DataFrame) -> Column:
    """Number of genomes, as a scalar subquery."""
    return genes.groupBy("genome").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("n")).scalar()


def backbone(genes: DataFrame, share: float = 0.95) -> DataFrame:
    """Families held exactly once by at least ``share`` of the genomes: family,
    single (genomes), median position of those copies and rank along it."""
    copies = genes.groupBy("genome", "family").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")
    )
    once = copies.where(F.col("n") == 1)
    single = (
        once.groupBy("family")
        .agg(F.count(F.lit(1)).alias("single"))
        .where(F.col("single") >= F.lit(share) * genome_count(genes))
    )
    placed = single.join(median_position(once, ["family"], "pos", "median"), "family")
    return number_rows(cut_lineage(placed), [], ["median", "family"], F.floor(F.col("median") / 256), "rank")


def plastic_runs(genes: DataFrame, size: int = TILE) -> DataFrame:
    """Maximal runs of consecutive plastic genes of one spot: genome, spot, start, end, genes."""
    plastic = F.col("in_rgp")
    rows = islands(
        genes.withColumn("_kind", F.when(plastic, F.coalesce(F.col("spot"), F.lit(-1)))),
        ["genome"],
        lambda w: ~F.col("_kind").eqNullSafe(F.lag("_kind").over(w)) | F.lag("pos").over(w).isNull(),
        "run",
        size=size,
    )
    return (
        rows.where(plastic)
        .groupBy("genome", "run")
        .agg(
            F.first("spot").alias("spot"),
            F.min("pos").alias("start"),
            F.max("pos").alias("end"),
            F.count(F.lit(1)).alias("genes"),
        )
        .drop("run")
    )


def circular_blocks(members: DataFrame, keys: list[str], gap: int = 30, size: int = TILE) -> DataFrame:
    """Cut a set of positions on a circle wherever the next one is more than ``gap`` away.

    ``members``: keys, pos, length. keys, block, start, end, genes; a block over
    the origin ends at a smaller position than it starts.
    """
    seen = over_tiles(
        unroll_circular(members, before=gap, after=0),
        keys,
        lambda w: {"_near": F.count(F.lit(1)).over(w.rangeBetween(-gap, -1))},
        before=gap,
        size=size,
    ).where(F.col("_turn") == 0)
    # positions are read once: each tile folds its own into parts of blocks, only those are numbered
    tiled = seen.withColumn("_tile", F.floor(F.col("pos") / size)).withColumn("_start", F.col("_near") == 0)
    inside = Window.partitionBy(*keys, "_tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = cut_lineage(
        tiled.withColumn("_local", F.sum(F.col("_start").cast("bigint")).over(inside))
        .groupBy(*keys, "_tile", "_local")
        .agg(
            F.min(F.when(F.col("_start"), F.col("pos"))).alias("_head"),
            F.min("pos").alias("_low"),
            F.max("pos").alias("_high"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    totals = parts.groupBy(*keys, "_tile").agg(F.count("_head").alias("_t"))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_tile", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"), F.sum("_t").over(per_key).alias("_cuts")
    )
    block = F.col("_local") + F.col("_offset")
    rows = parts.join(offsets, [*keys, "_tile"]).withColumn("_wrapped", block == 0).withColumn(
        "block", F.when(F.col("_wrapped"), F.col("_cuts")).otherwise(block)
    )
    return rows.groupBy(*keys, "block").agg(
        F.min(F.when(F.col("_cuts") == 0, F.col("_low")).otherwise(F.col("_head"))).alias("start"),
        F.coalesce(F.max(F.when(F.col("_wrapped"), F.col("_high"))), F.max("_high")).alias("end"),
        F.sum("_n").alias("genes"),
    )


def single_linkage(points: DataFrame, position: str, tie: str, gap: float) -> DataFrame:
    """Group points of a line whose neighbours are at most ``gap`` apart (``group``)."""
    numbered = number_rows(points, [], [position, tie], F.floor(F.col(position) / 256), "_idx")
    return islands(
        numbered,
        [],
        lambda w: F.coalesce(F.col(position) - F.lag(position).over(w) > gap, F.lit(True)),
        "group",
        pos="_idx",
    ).drop("_idx")


def backbone_flanks(genes: DataFrame, is_backbone: Column, reach: int = 200, size: int = TILE) -> DataFrame:
    """Nearest backbone family before (``left``) and after (``right``) every gene, at
    most ``reach`` steps away on the circle."""
    marked = unroll_circular(genes.withColumn("_bb", is_backbone), reach, reach)
    tagged = F.when(F.col("_bb"), F.struct("pos", "family"))

    def around(w):
        ahead = Window.partitionBy("genome", "_tile").orderBy(F.desc("pos"))
        return {
            "_l": F.last(tagged, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_r": F.last(tagged, ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, -1)),
        }

    rows = over_tiles(marked, ["genome"], around, before=reach, after=reach, size=size)
    near = lambda side: F.when(F.abs(F.col(f"{side}.pos") - F.col("pos")) <= reach, F.col(f"{side}.family"))
    return (
        rows.where(F.col("_turn") == 0)
        .withColumn("left", near("_l"))
        .withColumn("right", near("_r"))
        .drop("_l", "_r", "_bb", "_turn")
    )


def consensus(rows: DataFrame, key: str, value: str, share: float = 0.5) -> DataFrame:
    """Most frequent ``value`` per ``key`` when at least ``share`` of the rows have it, else null."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    best = counts.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b")
    )
    return total.join(best, key, "left").select(
        key, F.when(-F.col("b.n") >= share * F.col("total"), F.col("b.v")).alias(value), "total"
    )


def edit(genes: DataFrame, edits: DataFrame, size: int = TILE) -> DataFrame:
    """Apply deletions, substitutions and insertions, and renumber.

    ``edits``: genome, pos, op ('delete' | 'substitute' | 'insert' before pos) and
    family; at most one of each op per position.
    """
    ops = edits.groupBy("genome", "pos").agg(
        F.max(F.col("op") == "delete").alias("_del"),
        F.max(F.when(F.col("op") == "substitute", F.col("family"))).alias("_sub"),
        F.max(F.when(F.col("op") == "insert", F.col("family"))).alias("_ins"),
    )
    rows = genes.select("genome", "pos", "family").join(ops, ["genome", "pos"], "left")
    shift = F.col("_ins").isNotNull().cast("int") - F.coalesce(F.col("_del"), F.lit(False)).cast("int")
    moved = running_sum(rows, ["genome"], shift, "_shift", size=size)
    deleted = F.coalesce(F.col("_del"), F.lit(False))
    at = F.col("pos") + F.col("_shift")
    kept = F.when(~deleted, F.struct(at.alias("pos"), F.coalesce("_sub", "family").alias("family")))
    # a deletion moves everything from its own position on; the inserted gene stands just before
    inserted = F.when(
        F.col("_ins").isNotNull(),
        F.struct((at - 1 + deleted.cast("int")).alias("pos"), F.col("_ins").alias("family")),
    )
    return moved.select("genome", F.explode(F.array_compact(F.array(inserted, kept))).alias("g")).select(
        "genome", "g.pos", "g.family"
    )


def reading_window(width: int, step: int) -> Column:
    """Start of the window a gene's call is read from: windows of ``width`` every
    ``step`` genes and one flush with the end; the first window gives all its
    genes, a later one the genes with at least ``step`` genes before them."""
    pos, length = F.col("pos"), F.col("length")
    k = F.floor((pos - width) / step) + 1
    regular = k * step
    return F.when(pos < width, F.lit(0)).when(regular <= length - width, regular).otherwise(length - width)


def token_layout(genes: DataFrame) -> DataFrame:
    """Model input order: a start token, the contigs in order each followed by a
    separator, an end token after the last. genome, token, kind, type (contig number)."""
    contigs = genes.groupBy("genome", "contig").agg(F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy("genome")
    placed = contigs.select(
        "genome",
        "contig",
        "n",
        (F.row_number().over(per.orderBy("contig")) - 1).alias("type"),
        F.coalesce(
            F.sum("n").over(per.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
        F.count(F.lit(1)).over(per).alias("contigs"),
    )
    body = genes.join(placed.drop("n"), ["genome", "contig"]).select(
        "genome", (1 + F.col("before") + F.col("type") + F.col("idx")).alias("token"), F.lit("gene").alias("kind"), "type"
    )
    last = F.col("type") == F.col("contigs") - 1
    ends = placed.select(
        "genome",
        (1 + F.col("before") + F.col("type") + F.col("n")).alias("token"),
        F.when(last, F.lit("end")).otherwise(F.lit("sep")).alias("kind"),
        "type",
    )
    starts = placed.where(F.col("type") == 0).select(
        "genome", F.lit(0).cast("bigint").alias("token"), F.lit("start").alias("kind"), "type"
    )
    return body.unionByName(ends).unionByName(starts)


def pair_geometry(genes: DataFrame, pairs: DataFrame, is_backbone: Column, size: int = TILE) -> DataFrame:
    """Where two families sit in each genome holding both: pair, genome, nearest copy
    distance and the fewest backbone genes between two copies, the short way round.

    ``pairs``: pair, a, b. Each copy is compared with the copy of the other family
    just before and just after it (and across the origin): an arc that holds
    another copy is never the shortest, so no other pair of copies matters.
    """
    counted = running_sum(
        genes.withColumn("_bb", is_backbone.cast("int")), ["genome"], F.col("_bb"), "cum", size=size
    )
    totals = genes.groupBy("genome").agg(F.sum(is_backbone.cast("int")).alias("bb_total"))
    sides = pairs.select("pair", F.col("a").alias("family"), F.lit("a").alias("side")).unionByName(
        pairs.select("pair", F.col("b").alias("family"), F.lit("b").alias("side"))
    )
    copies = (
        counted.select("genome", "pos", "length", "family", "cum", "_bb")
        .join(sides, "family")
        .withColumn("at", F.struct("pos", "cum", "_bb"))
    )
    copies = cut_lineage(copies)
    key = ["pair", "genome"]
    ends = copies.where(F.col("side") == "b").groupBy(*key).agg(
        F.min("at").alias("b_first"), F.max("at").alias("b_last")
    )
    is_b = F.when(F.col("side") == "b", F.col("at"))
    rows = carry_last(copies, key, is_b, "b_before", size=size)
    rows = carry_last(rows, key, is_b, "b_after", size=size, reverse=True)
    rows = rows.where(F.col("side") == "a").join(ends, key).join(totals, "genome")
    options = F.array_compact(F.array("b_before", "b_after", "b_first", "b_last"))

    def arc(b):
        span = F.abs(b["pos"] - F.col("pos"))
        low_first = F.col("pos") <= b["pos"]
        hi_c, hi_b = F.when(low_first, b["cum"]).otherwise(F.col("cum")), F.when(low_first, b["_bb"]).otherwise(F.col("_bb"))
        lo_c, lo_b = F.when(low_first, F.col("cum")).otherwise(b["cum"]), F.when(low_first, F.col("_bb")).otherwise(b["_bb"])
        inner = hi_c - hi_b - lo_c
        outer = F.col("bb_total") - hi_c + lo_c - lo_b
        d = F.least(span, F.col("length") - span)
        between = F.when(span <= F.col("length") - span, inner).otherwise(outer)
        return F.struct(d.alias("d"), F.greatest(between, F.lit(0)).alias("sep"))

    arcs = F.transform(options, arc)
    return rows.groupBy(*key).agg(
        F.min(F.array_min(F.transform(arcs, lambda x: x["d"]))).alias("distance"),
        F.min(F.array_min(F.transform(arcs, lambda x: x["sep"]))).alias("sep"),
    )


def containing_interval(genes: DataFrame, intervals: DataFrame, bin_size: int = 64) -> DataFrame:
    """Genes inside an interval of their genome: an equi-join on (genome, bin) of the
    position line, then the exact comparison. ``intervals``: genome, start, end."""
    spread = intervals.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size)))
    )
    return (
        genes.withColumn("_bin", F.floor(F.col("pos") / bin_size))
        .join(spread, ["genome", "_bin"])
        .where(F.col("pos").between(F.col("start"), F.col("end")))
        .drop("_bin")
    )


def tolerance_match(left: DataFrame, right: DataFrame, keys: list[str], offsets: list[int]) -> DataFrame:
    """The row of ``right`` at the first offset, in order of preference, that has one.

    left: keys, pos, id; right: keys, pos, ref. Each left row is looked up at every
    offset by equality, never by a range.
    """
    tried = left.select(
        *keys, "id", "pos", F.posexplode(F.array(*[F.lit(o) for o in offsets])).alias("choice", "offset")
    ).withColumn("pos", F.col("pos") + F.col("offset"))
    hits = tried.join(right, [*keys, "pos"])
    return hits.groupBy(*keys, "id").agg(
        F.min(F.struct("choice", "offset", "ref")).alias("m")
    ).select(*keys, "id", F.col("m.offset").alias("offset"), F.col("m.ref").alias("ref"))
