"""Strong pairs and histograms of all pairs, from block products that keep neither."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import association as A
from seqweave.operators import hits as H
from seqweave.plans import corpus as C
from seqweave.plans.association_queries import CMH, PERM, presence
from seqweave.plans.tree_queries import FAMILIES
from seqweave.sources.tables import typed

QUERIES = {}
ORACLES = {}

DRAWS, SHARE = 2, 0.9


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: typed(fn(spark, folder))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


STEPS = """hs AS (SELECT draw, floor(abs(z) / 0.001)::BIGINT AS step, count(*) AS pairs FROM nz GROUP BY 1, 2),
th AS (SELECT (min(step) + 1) * 0.001::DOUBLE AS t FROM (SELECT step, sum(sum(pairs)) OVER (ORDER BY step) AS seen, (SELECT sum(pairs) FROM hs) AS total
  FROM hs GROUP BY step) WHERE seen >= """ + f"{SHARE}" + """ * total)"""


def _null(held, margins):
    relabel = A.permute_within(held, ["stratum"], "genome", DRAWS)
    permuted = relabel.join(held.select("stratum", F.col("genome").alias("other"), "family"), ["stratum", "other"]).select("draw", "stratum", "genome", "family")
    items = H.numbered(held.select(F.col("family").alias("item")))
    return items, H.cmh_histogram(held, margins, items, permuted, DRAWS, least_var=-1.0)


@query(f"WITH {CMH}, {PERM}, {STEPS} SELECT draw::BIGINT AS draw, step, pairs FROM hs")
def null_histogram(spark, folder):
    """How many pairs of families reach which |z| when genomes are relabelled within their strata."""
    held = presence(spark, folder)
    return _null(held, A.strata_margins(held))[1]


@query(f'WITH {CMH}, {PERM}, {STEPS} SELECT a, b, "both", round(z, 6) AS z, round(var, 6) AS var FROM z, th WHERE abs(z) >= t')
def cmh_hits(spark, folder):
    """Associations beyond the level that a share of the pairs of the null stays below."""
    held = presence(spark, folder)
    margins = A.strata_margins(held)
    items, null = _null(held, margins)
    found = H.cmh_hits(held, margins, items, H.histogram_quantile(null, SHARE), least_var=-1.0)
    return found.withColumn("z", F.round("z", 6)).withColumn("var", F.round("var", 6))


@query(f'WITH {C.EV}, {FAMILIES} SELECT d.a, d.b, s AS "both", round(d, 6) AS jaccard FROM dist d JOIN bo ON bo.a = d.a AND bo.b = d.b WHERE round(d, 12) <= 0.3')
def similar_families(spark, folder):
    """Families that most of their genomes share."""
    rows = C.genes(spark, folder).select("family", "genome").distinct()
    items = H.numbered(rows.select(F.col("family").alias("item")))
    return H.similar_pairs(rows, items, 0.3).withColumn("jaccard", F.round("jaccard", 6))
