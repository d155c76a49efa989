"""Association between features over strata, its nulls and its replication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators.pairs import pair_products
from seqweave.operators.tiling import number_rows


def frequency_band(presence: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Families held by a share of the genomes within the band: family, genomes, freq."""
    held = presence.select("family", "genome").distinct()
    counts = held.groupBy("family").agg(F.count(F.lit(1)).alias("genomes"))
    total = presence.select("genome").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("freq", F.col("genomes") / total).where(F.col("freq").between(low, high))


def content_tertiles(presence: DataFrame) -> DataFrame:
    """genome, lineage, content and tertile of content within the lineage (ties go up)."""
    content = presence.groupBy("lineage", "genome").agg(F.count(F.lit(1)).alias("content"))
    cuts = content.groupBy("lineage").agg(
        F.percentile("content", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")
    )
    above = lambda i: (F.col("content") >= F.col("q")[i]).cast("int")
    return content.join(cuts, "lineage").select(
        "genome", "lineage", "content", (above(0) + above(1)).alias("tertile")
    )


def strata_margins(presence: DataFrame, min_genomes: int = 2) -> DataFrame:
    """stratum, family, held (genomes of the stratum holding it) and n (its genomes)."""
    sizes = (
        presence.select("stratum", "genome").distinct().groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    ).where(F.col("n") >= min_genomes)
    held = presence.groupBy("stratum", "family").agg(F.count(F.lit(1)).alias("held"))
    return held.join(sizes, "stratum")


def cmh_matrix(
    presence: DataFrame, margins: DataFrame, permuted: DataFrame | None = None, draws: int = 0
) -> DataFrame:
    """Cochran-Mantel-Haenszel Z of every pair of families over strata: a, b, z, var.

    ``presence``: stratum, genome, family, distinct.
    Observed, expected and variance are three blocked products: over genomes, and
    over strata with the margins as weights. A pair never seen together in a
    stratum still gets its expected value there. ``permuted`` (with ``draw``)
    replaces one side: genomes relabelled within strata, one Z per draw 0..draws-1.
    """
    n, held = F.col("n").cast("double"), F.col("held").cast("double")
    # strata too small to have margins carry no information
    kept = margins.select("stratum").distinct()
    presence = presence.join(kept, "stratum", "left_semi")
    if permuted is not None:
        permuted = permuted.join(kept, "stratum", "left_semi")
    weighted = margins.select(
        "stratum",
        "family",
        (held / F.sqrt(n)).alias("expected"),
        (held * (n - held) / (n * F.sqrt(n - 1))).alias("var"),
    )
    if permuted is None:
        observed = pair_products(presence, "family", "genome")
        margin = pair_products(weighted, "family", "stratum", ["expected", "var"])
        keys = ["a", "b"]
        both = margin.join(observed, keys, "left")
    else:
        each = F.explode(F.array(*[F.lit(d) for d in range(draws)]))
        left = presence.withColumn("draw", each)
        observed = pair_products(left, "family", "genome", by=["draw"], right=permuted)
        margin = pair_products(weighted, "family", "stratum", ["expected", "var"])
        keys = ["draw", "a", "b"]
        both = margin.withColumn("draw", each).join(observed, keys, "left")
    shared = F.coalesce("shared", F.lit(0.0))
    # nine digits, so that equal tables give equal statistics whatever the order of their sums
    z = F.round((shared - F.col("expected")) / F.sqrt(F.greatest("var", F.lit(1e-9))), 9)
    return both.select(*keys, shared.alias("both"), z.alias("z"), "var")


def permute_within(
    units: DataFrame, keys: Sequence[str], unit: str, draws: int, seed: str = "perm", start: int = 0
) -> DataFrame:
    """For each draw, a relabelling of the units inside each group: draw, keys, unit, other.

    The order of md5(seed|draw|unit) is matched with the order of the unit; both
    orders are numbered in hash- or value-sized pieces, so a huge group is fine.
    """
    numbers = F.explode(F.array(*[F.lit(d) for d in range(start, start + draws)]))
    base = units.select(*keys, unit).distinct().withColumn("draw", numbers)
    hashed = base.withColumn(
        "_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col(unit).cast("string")))
    )
    group = ["draw", *keys]
    by_hash = number_rows(hashed, group, ["_h", unit], F.substring("_h", 1, 4), "_r")
    by_unit = number_rows(hashed, group, [unit], F.floor(F.col(unit) / 4096), "_r")
    left = by_unit.select(*group, "_r", unit)
    right = by_hash.select(*group, "_r", F.col(unit).alias("other"))
    return left.join(right, [*group, "_r"]).drop("_r")


def mantel_haenszel(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Odds ratio and stratum-weighted risk difference.

    ``cells``: by..., stratum, exposed, outcome (0/1), n. Strata holding only one
    exposure class carry no information.
    """
    cell = lambda e, o: F.sum(
        F.when((F.col("exposed") == e) & (F.col("outcome") == o), F.col("n")).otherwise(0)
    ).cast("double")
    tables = cells.groupBy(*by, "stratum").agg(
        cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d")
    )
    x, y = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    usable = tables.where((x > 0) & (y > 0))
    n, w = x + y, x * y / (x + y)
    return usable.groupBy(*by).agg(
        F.count(F.lit(1)).alias("strata"),
        (F.sum(F.col("a") * F.col("d") / n) / F.greatest(F.sum(F.col("b") * F.col("c") / n), F.lit(1e-9))).alias(
            "odds_ratio"
        ),
        (F.sum(w * (F.col("a") / x - F.col("c") / y)) / F.sum(w)).alias("gap"),
    )


def permutation_test(units: DataFrame, draws: int, seed: str = "mh") -> DataFrame:
    """Risk difference against relabelled exposures within strata: observed, null mean,
    null sd and p = (1 + draws at least as high) / (1 + draws).

    ``units``: stratum, unit, exposed, outcome.
    """
    relabelled = permute_within(units, ["stratum"], "unit", draws, seed)
    exposure = units.select("stratum", F.col("unit").alias("other"), "exposed")
    outcome = units.select("stratum", "unit", "outcome")
    cells = (
        relabelled.join(exposure, ["stratum", "other"])
        .join(outcome, ["stratum", "unit"])
        .groupBy("draw", "stratum", "exposed", "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    null = mantel_haenszel(cells, ["draw"]).select("gap")
    real = units.groupBy("stratum", "exposed", "outcome").agg(F.count(F.lit(1)).alias("n"))
    observed = mantel_haenszel(real).select(F.col("gap").alias("observed"))
    # the observed side is one row
    return null.join(F.broadcast(observed)).groupBy("observed").agg(
        F.avg("gap").alias("null_mean"),
        F.stddev_pop("gap").alias("null_sd"),
        ((1 + F.count_if(F.round("gap", 12) >= F.round("observed", 12))) / (1 + F.count(F.lit(1)))).alias("p"),
    )


def pair_agreement(sites: DataFrame) -> DataFrame:
    """Pairs of sites of one stratum and different genomes, by same allele (exposed) and
    same branch (outcome): stratum, exposed, outcome, n.

    Counted from group sizes, n(n-1)/2 less the pairs within a genome, so no pair
    is ever formed however large a stratum is.
    """
    folded = sites.groupBy("stratum", "allele", "branch", "genome").agg(
        F.count(F.lit(1)).cast("double").alias("k")
    )

    def pairs(keys, out):
        per_genome = folded.groupBy("stratum", *keys, "genome").agg(F.sum("k").alias("g"))
        square = per_genome.groupBy("stratum", *keys).agg(
            ((F.pow(F.sum("g"), F.lit(2)) - F.sum(F.col("g") * F.col("g"))) / 2).alias("p")
        )
        return square.groupBy("stratum").agg(F.sum("p").alias(out))

    table = (
        pairs([], "all")
        .join(pairs(["allele"], "same_allele"), "stratum")
        .join(pairs(["branch"], "same_branch"), "stratum")
        .join(pairs(["allele", "branch"], "both"), "stratum")
    )
    a = F.col("both")
    b = F.col("same_allele") - a
    c = F.col("same_branch") - a
    d = F.col("all") - F.col("same_allele") - c
    cell = lambda e, o, n: F.struct(F.lit(e).alias("exposed"), F.lit(o).alias("outcome"), n.alias("n"))
    return table.select(
        "stratum", F.explode(F.array(cell(1, 1, a), cell(1, 0, b), cell(0, 1, c), cell(0, 0, d))).alias("x")
    ).select("stratum", "x.exposed", "x.outcome", "x.n")


def presence_similarity(presence: DataFrame) -> DataFrame:
    """Jaccard distance and phi of the presence of every pair of families seen together."""
    held = presence.select("family", "genome").distinct()
    counts = held.groupBy("family").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = presence.select("genome").distinct().agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    both = pair_products(held, "family", "genome")
    rows = both.join(counts.select(F.col("family").alias("a"), F.col("n").alias("na")), "a").join(
        counts.select(F.col("family").alias("b"), F.col("n").alias("nb")), "b"
    ).withColumn("g", total)
    s, na, nb, g = F.col("shared"), F.col("na"), F.col("nb"), F.col("g")
    spread = F.sqrt(na * (g - na) * nb * (g - nb))
    return rows.select(
        "a", "b", s.alias("both"), (1 - s / (na + nb - s)).alias("jaccard"),
        F.when(spread > 0, (g * s - na * nb) / spread).alias("phi"),
    )


def banded_table(stats: DataFrame, band: Column, threshold: Column, expected: Column) -> DataFrame:
    """Per band: pairs, pairs beyond the null threshold, their share and its ratio to the null."""
    beyond = F.avg((F.abs(F.col("z")) > threshold).cast("double"))
    return (
        stats.groupBy(band.alias("band"))
        .agg(F.count(F.lit(1)).alias("pairs"), beyond.alias("beyond"))
        .withColumn("expected", expected)
        .withColumn("ratio", F.col("beyond") / F.greatest("expected", F.lit(1e-12)))
    )
