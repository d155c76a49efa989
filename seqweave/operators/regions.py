"""Elements, links between them and the flags that qualify a link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.operators.tiling import median_position
from seqweave.session import cut_lineage


def carriers_alone(genes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Genomes holding one family of a pair and not the other: pair, alone_a, alone_b."""
    held = genes.select("genome", "family").distinct()
    sides = pairs.select("pair", F.col("a").alias("family"), F.lit(1).alias("side")).unionByName(
        pairs.select("pair", F.col("b").alias("family"), F.lit(2).alias("side"))
    )
    per_genome = held.join(sides, "family").groupBy("pair", "genome").agg(F.sum("side").alias("s"))
    return per_genome.groupBy("pair").agg(
        F.count_if(F.col("s") == 1).alias("alone_a"), F.count_if(F.col("s") == 2).alias("alone_b")
    )


def link_flags(
    genes: DataFrame,
    pairs: DataFrame,
    geometry: DataFrame,
    near: tuple[int, ...] = (10, 50, 100, 500),
    sep: int = 3,
    tract: int = 100,
    min_carriers: int = 10,
    min_alone: int = 3,
) -> DataFrame:
    """Per pair: genomes with both, shares within each distance, share with ``sep``
    backbone genes between, and whether the two are one tract or separate."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    summary = geometry.groupBy("pair").agg(
        F.count(F.lit(1)).alias("carriers"),
        *[share(F.col("distance") <= t).alias(f"near{t}") for t in near],
        share(F.col("sep") >= sep).alias("sep_share"),
    ).join(median_position(geometry, ["pair"], "distance", "median_distance"), "pair")
    enough = F.col("carriers") >= min_carriers
    return (
        summary.join(carriers_alone(genes, pairs), "pair")
        .withColumn("tract", enough & (F.col("median_distance") < tract))
        .withColumn(
            "separate",
            enough & (F.col("sep_share") >= 0.5) & (F.least("alone_a", "alone_b") >= min_alone),
        )
    )


def family_places(genes: DataFrame, families: DataFrame) -> DataFrame:
    """Per family: majority spot (null counts as a value), median position, share inside plastic regions."""
    wanted = genes.join(families.select("family").distinct(), "family", "left_semi")
    spots = wanted.groupBy("family", "spot").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.coalesce("spot", F.lit(-1)).alias("s")))
    major = spots.groupBy("family").agg(F.nullif(best["s"], F.lit(-1)).alias("spot"))
    share = wanted.groupBy("family").agg(F.avg(F.col("in_rgp").cast("double")).alias("rgp"))
    return major.join(median_position(wanted, ["family"], "pos", "median"), "family").join(share, "family")


def assign_regions(places: DataFrame, gap: float = 10) -> DataFrame:
    """family, region: the families of one spot, and the others grouped by position."""
    from seqweave.operators.sequence import single_linkage

    spotted = places.where(F.col("spot").isNotNull()).select(
        "family", F.concat(F.lit("s"), F.col("spot").cast("string")).alias("region")
    )
    loose = single_linkage(places.where(F.col("spot").isNull()).select("family", "median"), "median", "family", gap)
    return spotted.unionByName(
        loose.select("family", F.concat(F.lit("p"), F.col("group").cast("string")).alias("region"))
    )


def region_links(hits: DataFrame, regions: DataFrame) -> DataFrame:
    """Family pairs gathered into links between regions: a, b, pairs, pos, neg, sign and
    the strongest z. ``hits``: a, b (families), z."""
    side = lambda name: regions.select(F.col("family").alias(name), F.col("region").alias(f"r_{name}"))
    placed = hits.join(side("a"), "a").join(side("b"), "b").where(F.col("r_a") != F.col("r_b"))
    strongest = F.min(F.struct((-F.round(F.abs("z"), 9)).alias("m"), F.col("z").alias("z")))
    return (
        placed.groupBy(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b"))
        .agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("z") > 0).alias("pos"), strongest["z"].alias("z"))
        .withColumn("neg", F.col("pairs") - F.col("pos"))
        .withColumn("sign", F.when(F.col("pos") * 2 >= F.col("pairs"), 1).otherwise(-1))
    )


def shared_products(members: DataFrame, links: DataFrame) -> DataFrame:
    """Products found in both regions of a link: a, b, shared (sorted list as text).

    ``members``: region, product; meets on the product, so only shared ones join.
    """
    named = members.where(F.col("product").isNotNull()).select("region", "product").distinct()
    left = named.select(F.col("region").alias("a"), "product")
    right = named.select(F.col("region").alias("b"), "product")
    found = links.select("a", "b").join(left, "a").join(right, ["b", "product"])
    return found.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("product")), ",").alias("shared"))


def hops(edges: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Nodes within ``k`` steps of each source: source, node, step (fewest).

    ``edges``: a, b (directed); ``sources``: source. Each step joins only the nodes
    reached in the step before.
    """
    reached = cut_lineage(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("step")))
    front = reached
    for step in range(1, k + 1):
        out = front.join(edges.select(F.col("a").alias("node"), "b"), "node").select("source", F.col("b").alias("node")).distinct()
        front = cut_lineage(
            out.join(reached.select("source", "node"), ["source", "node"], "left_anti").withColumn("step", F.lit(step))
        )
        reached = cut_lineage(reached.unionByName(front))
    return reached


def projected_hops(edges: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Labels within ``k`` steps of each label in a graph whose nodes carry labels: source, label, step (fewest).

    ``edges``: a, b (directed); ``labels``: node, label, at most one label a node. A label starts at all its nodes
    at once, which are no neighbours of it; nodes without a label are walked through.
    """
    start = labels.select(F.col("label").alias("source"), "node").distinct()
    reached = cut_lineage(start.withColumn("step", F.lit(0)))
    front = reached
    for step in range(1, k + 1):
        out = front.join(edges.select(F.col("a").alias("node"), "b"), "node").select("source", F.col("b").alias("node")).distinct()
        front = cut_lineage(out.join(reached.select("source", "node"), ["source", "node"], "left_anti").withColumn("step", F.lit(step)))
        reached = cut_lineage(reached.unionByName(front))
    met = reached.where(F.col("step") > 0).join(labels.select("node", "label"), "node")
    return met.groupBy("source", "label").agg(F.min("step").alias("step"))


def edge_support(predicted: DataFrame, reached: DataFrame) -> DataFrame:
    """How many predicted (a, b) are reached in the graph, against their expectation when
    the source is swapped for any other predicted source (target-matched) and when the
    target is (source-matched). Expectations are exact, from in- and out-counts.

    One row: n, supported, target_null, source_null, enrichment.
    """
    pairs = predicted.select("a", "b").distinct()
    hit = reached.select(F.col("source").alias("a"), F.col("node").alias("b")).where(F.col("a") != F.col("b")).distinct()
    sources, targets = pairs.select("a").distinct(), pairs.select("b").distinct()
    inner = hit.join(sources, "a", "left_semi").join(targets, "b", "left_semi")
    into = inner.groupBy("b").agg(F.count(F.lit(1)).alias("into"))
    out = inner.groupBy("a").agg(F.count(F.lit(1)).alias("out"))
    n_a = sources.agg(F.count(F.lit(1))).scalar()
    n_b = targets.agg(F.count(F.lit(1))).scalar()
    rows = (
        pairs.join(hit.withColumn("hit", F.lit(1)), ["a", "b"], "left")
        .join(into, "b", "left").join(out, "a", "left").fillna(0, ["hit", "into", "out"])
        .withColumn("t", F.try_divide(F.col("into") - F.col("hit"), n_a - 1))
        .withColumn("s", F.try_divide(F.col("out") - F.col("hit"), n_b - 1))
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("hit").cast("double")).alias("supported"),
        F.avg("t").alias("target_null"),
        F.avg("s").alias("source_null"),
    ).withColumn("enrichment", F.col("supported") / F.greatest("target_null", F.lit(1e-9)))
