"""Further forms of earlier operators: mixtures, quantile bins, nearest quantiles, projected neighbours, fork rules by sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from seqweave.operators import exports as E
from seqweave.operators import forks as K
from seqweave.operators import graph as G
from seqweave.operators import predictors as P
from seqweave.operators import regions as R
from seqweave.operators import relatedness as B
from seqweave.operators import stats as X
from seqweave.operators import tiling as T
from seqweave.operators.distance import distance_counts
from seqweave.plans import corpus as C
from seqweave.plans.association_queries import LOCI, SITES, _lo, loci, sites
from seqweave.plans.knockout_queries import LINKS, RUNS, elements, lineage_means
from seqweave.session import cut_lineage
from seqweave.sources.tables import typed

QUERIES = {}
ORACLES = {}

SHARES = [0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: typed(fn(spark, folder))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(
    f"""WITH {SITES}, q AS (SELECT *, ({_lo('path_3')[0]} + freq) / ({_lo('path_3')[1]} + 1) AS q FROM fr),
co AS (SELECT half, l, sum(-log2(greatest((1 - l) * q + l * freq, 1e-12))) AS bits, count(*) AS sites FROM q, (SELECT unnest({SHARES}::DOUBLE[]) AS l) GROUP BY 1, 2),
ft AS (SELECT half, l FROM co QUALIFY row_number() OVER (PARTITION BY half ORDER BY round(bits, 6), l) = 1)
SELECT co.half, co.l, round(bits / sites, 6) AS bits, sites FROM co JOIN ft ON ft.half = 1 - co.half AND ft.l = co.l"""
)
def fitted_mixture(spark, folder):
    """The share of the branch frequency to mix into the path predictor, fitted on one half and scored on the other."""
    rows = sites(spark, folder)
    model = P.path_predictor(rows, "path_3", P.leave_one_out_frequency(rows))
    out = P.fit_mixture(model.withColumn("half", F.pmod("genome", F.lit(2))), SHARES)
    return out.withColumn("bits", F.round("bits", 6))


@query(
    f"""WITH {C.EV}, {LOCI}, e AS (SELECT quantile_cont(d, [0.25, 0.5, 0.75]) AS e FROM dist)
SELECT (d >= e[1])::BIGINT + (d >= e[2])::BIGINT + (d >= e[3])::BIGINT AS bin, count(*) AS pairs, round(min(d), 6) AS low, round(max(d), 6) AS high FROM dist, e GROUP BY 1"""
)
def distance_classes(spark, folder):
    """Pairs of genomes in four classes of distance that hold equal shares of them."""
    bins = B.quantile_bins(cut_lineage(distance_counts(loci(C.genes(spark, folder)))), 4, weight="n")
    return bins.groupBy("bin").agg(F.sum("n").alias("pairs"), F.round(F.min("d"), 6).alias("low"), F.round(F.max("d"), 6).alias("high"))


TARGETS = [(k + 0.5) / 8 for k in range(8)]


@query(
    f"""WITH {RUNS}, o AS (SELECT link, size, row_number() OVER (PARTITION BY link ORDER BY size) - 1 AS r, count(*) OVER (PARTITION BY link) AS n FROM el)
SELECT link, share, size FROM o JOIN (SELECT unnest({TARGETS}::DOUBLE[]) AS share) ON r = round_even(share * (n - 1), 0)"""
)
def target_sizes(spark, folder):
    """Sizes of runs at even shares of all of a class, each a size that occurs."""
    return T.nearest_quantiles(cut_lineage(elements(spark, folder)), ["link"], "size", TARGETS, chunk=F.floor(F.col("size") / 4))


@query(
    f"""WITH {C.TR}, e AS (SELECT prev AS a, family AS b FROM tr WHERE prev IS NOT NULL AND pos < 8 GROUP BY 1, 2 HAVING count(DISTINCT genome) >= 2),
l AS (SELECT DISTINCT family AS node, CASE WHEN split_part(family, '#', 2) <> '7' THEN split_part(family, '#', 2) END AS label FROM ev),
s AS (SELECT label AS source, node FROM l WHERE label IS NOT NULL),
r1 AS (SELECT DISTINCT source, b AS node FROM s JOIN e ON a = node WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.source = s.source AND x.node = b)),
r2 AS (SELECT DISTINCT source, b AS node FROM r1 JOIN e ON a = node WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.source = r1.source AND x.node = b)
  AND NOT EXISTS (SELECT 1 FROM r1 x WHERE x.source = r1.source AND x.node = b))
SELECT source, label, min(step)::BIGINT AS step FROM (SELECT source, node, 1 AS step FROM r1 UNION ALL SELECT source, node, 2 FROM r2) JOIN l USING (node)
WHERE label IS NOT NULL GROUP BY 1, 2"""
)
def projected_neighbours(spark, folder):
    """Which alleles' classes are near one another in the graph of families at the start of genomes."""
    window = C.genes(spark, folder).where(F.col("pos") < 8)
    edges = cut_lineage(G.edges(window).where(F.col("genomes") >= 2).select(F.col("prev").alias("a"), F.col("family").alias("b")))
    label = F.substring_index("family", "#", -1)
    labels = C.genes(spark, folder).select(F.col("family").alias("node"), label.alias("label")).distinct().where(F.col("label") != "7")
    return R.projected_hops(edges, cut_lineage(labels), 2)


RULES = {
    "balanced": dict(top=8, min_n=20, min_share=0.10, min_sites=30),
    "contingent": dict(top=8, min_genomes=10, min_sites=20),
    "plastic": dict(top=8, min_share=0.15, min_total=30, min_plastic=0.38, first_copy=True),
}


def _rule_sql(name: str, top=8, min_n=1, min_share=0.0, min_genomes=1, min_sites=0, min_total=0, min_plastic=0.0, first_copy=False) -> str:
    return f"""SELECT '{name}' AS rule, fork, branch, n, sites, round(plastic, 6) AS plastic FROM (
  SELECT *, count(*) OVER (PARTITION BY fork) AS branches, sum(n) OVER (PARTITION BY fork)::BIGINT AS sites FROM (
    SELECT *, row_number() OVER (PARTITION BY fork ORDER BY n DESC, branch) AS r FROM {'sf' if first_copy else 'sa'})
  WHERE r <= {top} AND n >= {min_n} AND n >= {min_share} * total AND genomes >= {min_genomes})
WHERE branches >= 2 AND sites >= {min_sites} AND total >= {min_total} AND plastic >= {min_plastic}"""


def _stats_sql(source: str) -> str:
    return f"""SELECT fork, branch, count(*) AS n, count(DISTINCT genome) AS genomes, sum(count(*)) OVER (PARTITION BY fork) AS total,
  sum(count(*) FILTER (WHERE p)) OVER (PARTITION BY fork) / (sum(count(*)) OVER (PARTITION BY fork))::DOUBLE AS plastic FROM {source} GROUP BY 1, 2"""


@query(
    f"""WITH {C.EV}, nx AS (SELECT genome, pos, family AS fork, lead(family) OVER w AS branch, lead(in_rgp) OVER w AS p FROM ev WINDOW w AS (PARTITION BY genome ORDER BY pos)),
al AS (SELECT * FROM nx WHERE branch IS NOT NULL), fc AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY genome, fork ORDER BY pos) = 1),
sa AS ({_stats_sql('al')}), sf AS ({_stats_sql('fc')}) {' UNION ALL '.join(_rule_sql(k, **v) for k, v in RULES.items())}"""
)
def fork_rules_by_sites(spark, folder):
    """Fork rules that ask for a number of sites or for plastic surroundings."""
    rows = cut_lineage(C.genes(spark, folder).select("genome", "pos", "family", "in_rgp"))
    out = [K.forks_by_sites(rows, **rule).withColumn("rule", F.lit(name)) for name, rule in RULES.items()]
    return reduce(lambda a, b: a.unionByName(b), out).withColumn("plastic", F.round("plastic", 6))


@query(
    f"""WITH {C.CALLS}, k AS (SELECT row_number() OVER (ORDER BY r) - 1 AS knot, r FROM (SELECT unnest({E.rank_knots(25, 9)}) AS r))
SELECT prev, place AS rank, knot, round(least(greatest(-ln(p), 0), 16) / 16 * 65535)::BIGINT AS q FROM model JOIN k ON r = place"""
)
def quantised_knots(spark, folder):
    """Each family's list of chances at a few ranks, as 16-bit numbers."""
    model = C.count_model(C.with_prev(C.genes(spark, folder)))
    kept = E.at_knots(model, "place", 25, 9)
    return kept.select("prev", F.col("place").alias("rank"), "knot", E.quantise_log(F.col("p")).alias("q"))


@query(
    f"""WITH RECURSIVE {LINKS}, ways(n, s, w) AS (SELECT 0, 0, 1.0::DOUBLE UNION ALL SELECT n + 1, s, sum(w) / 2 FROM (
  SELECT n, s, w FROM ways WHERE n < 24 UNION ALL SELECT n, s + n + 1, w FROM ways WHERE n < 24) GROUP BY 1, 2),
pe AS (SELECT link, sum(ways.w) AS p FROM zl JOIN ways ON ways.n = zl.n AND s >= zl.w GROUP BY 1)
SELECT link, n, CASE WHEN n >= 5 AND NOT tied THEN round(p, 9) END AS exact FROM zl JOIN pe USING (link)"""
)
def signed_rank_exact(spark, folder):
    """Exact one-sided p of each link's lineage means."""
    sums = X.signed_rank(lineage_means(spark, folder), ["link"], "x")
    p = F.round(F.nanvl(X.rank_sum_p("exact")("n", "w", "tied", "z"), F.lit(None)), 9)
    return sums.select("link", "n", p.alias("exact"))
