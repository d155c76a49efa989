"""Merge trees of families and genomes: linkage, cuts, layout, halves by lineage and replication between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import association as A
from seqweave.operators import clustering as L
from seqweave.operators import trees as R
from seqweave.plans import corpus as C
from seqweave.session import cut_lineage
from seqweave.sources.tables import typed

QUERIES = {}
ORACLES = {}

CLADES = 7


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: typed(fn(spark, folder))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def linked(cut_sql: str) -> str:
    """Average linkage of ``dist`` (a, b, d of all pairs a < b) merging one pair at a time, up to ``cut_sql``: table mg."""
    return f"""lk AS (SELECT 0 AS step, false AS merge, a, b, d AS s, 1 AS na, 1 AS nb, 0::DOUBLE AS h FROM dist
  UNION ALL SELECT t.step + 1, t.merge, t.a, t.b, t.s, t.na, t.nb, t.h FROM (
    SELECT any_value(step) AS step, merge, a, b, sum(s) AS s, any_value(na) AS na, any_value(nb) AS nb, any_value(h) AS h FROM (
      SELECT step, merge, CASE WHEN merge THEN a ELSE least(x, y) END AS a, CASE WHEN merge THEN b ELSE greatest(x, y) END AS b, s,
        CASE WHEN merge OR x < y THEN nx ELSE ny END AS na, CASE WHEN merge OR x < y THEN ny ELSE nx END AS nb, h FROM (
        SELECT step, (a = m.ma AND b = m.mb) AS merge, a, b, s, m.md AS h,
          CASE WHEN a = m.mb AND b <> m.ma THEN m.ma ELSE a END AS x, CASE WHEN b = m.mb AND a <> m.ma THEN m.ma ELSE b END AS y,
          CASE WHEN a IN (m.ma, m.mb) AND NOT (a = m.ma AND b = m.mb) THEN m.mn ELSE na END AS nx,
          CASE WHEN b IN (m.ma, m.mb) AND NOT (a = m.ma AND b = m.mb) THEN m.mn ELSE nb END AS ny
        FROM (SELECT *, first_value({{'md': round(s / (na * nb), 12), 'ma': a, 'mb': b, 'mn': na + nb}}) OVER (ORDER BY round(s / (na * nb), 12), a, b) AS m
          FROM lk WHERE NOT merge) WHERE m.md <= {cut_sql}))
    GROUP BY merge, a, b) t),
mg AS MATERIALIZED (SELECT a AS kept, b AS dropped, h AS height, na + nb AS size, na AS kept_n FROM (
  SELECT a, b, h, na, nb FROM lk WHERE merge))"""


FAMILIES = """pr AS (SELECT DISTINCT family, genome FROM ev), pn AS (SELECT family, count(*) AS n FROM pr GROUP BY 1),
bo AS (SELECT x.family AS a, y.family AS b, count(*)::DOUBLE AS s FROM pr x JOIN pr y ON y.genome = x.genome AND x.family < y.family GROUP BY 1, 2),
dist AS MATERIALIZED (SELECT p.family AS a, q.family AS b, 1 - coalesce(s, 0) / (p.n + q.n - coalesce(s, 0)) AS d FROM pn p JOIN pn q ON p.family < q.family
  LEFT JOIN bo ON bo.a = p.family AND bo.b = q.family)"""

#: Where each leaf's chain of merges ends: walk(leaf, node, way).
WALK = """walk(leaf, node, way) AS (SELECT family, family, 0::BIGINT FROM pn
  UNION ALL SELECT leaf, kept, way + kept_n FROM walk JOIN ct ON dropped = node),
ends AS (SELECT leaf, arg_max(node, way) AS node, max(way) AS way FROM walk GROUP BY leaf)"""


def family_tree(spark, folder, cut=None):
    """Leaves and merges of the families by the Jaccard distance of their genomes."""
    rows = C.genes(spark, folder).select("family", "genome").distinct()
    similar = cut_lineage(A.presence_similarity(rows)).select("a", "b", F.col("jaccard").alias("d"))
    leaves = cut_lineage(rows.select(F.col("family").alias("leaf")).distinct())
    return leaves, *L.average_linkage(similar, leaves, cut=cut)


@query(f"WITH RECURSIVE {C.EV}, {FAMILIES}, {linked('0.5')}, ct AS (SELECT * FROM mg), {WALK} SELECT leaf, node AS cluster, way AS place FROM ends")
def element_clusters(spark, folder):
    """Families whose presence agrees, by average linkage on Jaccard distance."""
    return family_tree(spark, folder, 0.5)[1]


CUT = f"""WITH RECURSIVE {C.EV}, {FAMILIES}, {linked('1')}, cn AS (SELECT count(*) - {CLADES} AS k FROM pn),
ct AS (SELECT * FROM mg WHERE height <= (SELECT max(height) FROM (SELECT height, row_number() OVER (ORDER BY height) AS r FROM mg) WHERE r <= (SELECT k FROM cn))), {WALK}"""


@query(f"{CUT} SELECT leaf, node AS cluster FROM ends")
def clade_clusters(spark, folder):
    """The tree of families cut into clades, as many as are asked for at most."""
    leaves, _, merges = family_tree(spark, folder)
    return R.flat_clusters(leaves, cut_lineage(merges), CLADES)


@query(f"WITH RECURSIVE {C.EV}, {FAMILIES}, {linked('1')}, ct AS (SELECT * FROM mg), {WALK} SELECT leaf, node AS tree, way AS place FROM ends")
def leaf_order(spark, folder):
    """The order in which the tree of families is drawn."""
    leaves, _, merges = family_tree(spark, folder)
    return R.leaf_order(leaves, cut_lineage(merges))


#: Lineages of very unequal size, dealt one after the other.
LINEAGES = """ln AS (SELECT DISTINCT genome, (sqrt(genome % 97)::BIGINT)::VARCHAR AS lineage FROM ev),
lz AS (SELECT lineage, count(*) AS n FROM ln GROUP BY 1),
lo AS (SELECT lineage, n, row_number() OVER (ORDER BY n DESC, lineage) AS r FROM lz),
hv(r, lineage, n, side, w0, w1) AS (SELECT r, lineage, n, 0::BIGINT, n, 0::BIGINT FROM lo WHERE r = 1
  UNION ALL SELECT lo.r, lo.lineage, lo.n, (w0 > w1)::BIGINT, w0 + CASE WHEN w0 <= w1 THEN lo.n ELSE 0 END, w1 + CASE WHEN w0 > w1 THEN lo.n ELSE 0 END
  FROM hv JOIN lo ON lo.r = hv.r + 1)"""


def lineages(spark, folder):
    rows = C.genes(spark, folder).select("genome").distinct()
    return rows.withColumn("lineage", F.round(F.sqrt(F.col("genome") % 97)).cast("bigint").cast("string"))


def halves_of(rows):
    return R.greedy_halves(rows.groupBy("lineage").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH RECURSIVE {C.EV}, {LINEAGES} SELECT hv.lineage, hv.n, side, (hv.r = 1)::BIGINT AS largest FROM hv")
def halves(spark, folder):
    """Lineages dealt to two sides of nearly equal numbers of genomes, and whether each is the largest."""
    sizes = cut_lineage(lineages(spark, folder).groupBy("lineage").agg(F.count(F.lit(1)).alias("n")))
    top = R.largest_against_rest(sizes).select("lineage", F.col("side").alias("largest"))
    return R.greedy_halves(sizes).join(top, "lineage")


CLADE_HALVES = f"""{CUT}, sz AS (SELECT node AS lineage, count(*) AS n FROM ends GROUP BY 1),
lo AS (SELECT lineage, n, row_number() OVER (ORDER BY n DESC, lineage) AS r FROM sz),
hv(r, lineage, n, side, w0, w1) AS (SELECT r, lineage, n, 0::BIGINT, n, 0::BIGINT FROM lo WHERE r = 1
  UNION ALL SELECT lo.r, lo.lineage, lo.n, (w0 > w1)::BIGINT, w0 + CASE WHEN w0 <= w1 THEN lo.n ELSE 0 END, w1 + CASE WHEN w0 > w1 THEN lo.n ELSE 0 END
  FROM hv JOIN lo ON lo.r = hv.r + 1)"""


@query(f"{CLADE_HALVES} SELECT leaf, node AS cluster, side FROM ends JOIN hv ON hv.lineage = node")
def balanced_clades(spark, folder):
    """Halves that keep the clades of the tree whole."""
    leaves, _, merges = family_tree(spark, folder)
    clades = cut_lineage(R.flat_clusters(leaves, cut_lineage(merges), CLADES))
    sides = R.greedy_halves(clades.groupBy(F.col("cluster").alias("lineage")).agg(F.count(F.lit(1)).alias("n")))
    return clades.join(sides.select(F.col("lineage").alias("cluster"), "side"), "cluster")


STRATA = """st AS (SELECT DISTINCT e.genome, e.family, lineage || '|' || (e.genome % 2) AS stratum, side FROM ev e JOIN ln USING (genome) JOIN hv USING (lineage)),
sz AS (SELECT side, stratum, count(DISTINCT genome)::DOUBLE AS n FROM st GROUP BY 1, 2 HAVING count(DISTINCT genome) >= 2),
hd AS (SELECT side, stratum, family, count(*)::DOUBLE AS h, any_value(n) AS n FROM st JOIN sz USING (side, stratum) GROUP BY 1, 2, 3),
ex AS (SELECT a.side, a.family AS a, b.family AS b, sum(a.h * b.h / a.n) AS e, sum(a.h * (a.n - a.h) * b.h * (a.n - b.h) / (a.n * a.n * (a.n - 1))) AS v
  FROM hd a JOIN hd b ON b.side = a.side AND b.stratum = a.stratum AND a.family < b.family GROUP BY 1, 2, 3),
ob AS (SELECT x.side, x.family AS a, y.family AS b, count(*) AS o FROM st x JOIN st y ON y.genome = x.genome AND x.family < y.family JOIN sz ON sz.side = x.side AND sz.stratum = x.stratum GROUP BY 1, 2, 3),
zz AS (SELECT ex.side, ex.a, ex.b, round((coalesce(o, 0) - e) / sqrt(greatest(v, 1e-9)), 9) AS z FROM ex LEFT JOIN ob USING (side, a, b))"""


@query(
    f"""WITH RECURSIVE {C.EV}, {LINEAGES}, {STRATA} SELECT x.a, x.b, round(x.z, 6) AS z_a, round(y.z, 6) AS z_b,
  sign(x.z) = sign(y.z) AND abs(x.z) > 1 AND abs(y.z) > 1 AS replicated FROM zz x JOIN zz y ON y.a = x.a AND y.b = x.b WHERE x.side = 0 AND y.side = 1"""
)
def lineage_replication(spark, folder):
    """Associations in two halves that share no lineage, and whether sign and size hold in both."""
    rows = cut_lineage(lineages(spark, folder))
    sides = halves_of(rows).select("lineage", "side")
    held = C.genes(spark, folder).select("genome", "family").distinct().join(rows.join(sides, "lineage"), "genome")
    held = cut_lineage(held.select("genome", "family", "side", F.concat_ws("|", "lineage", (F.col("genome") % 2).cast("string")).alias("stratum")))
    both = None
    for side, name in ((0, "z_a"), (1, "z_b")):
        part = held.where(F.col("side") == side).drop("side")
        z = A.cmh_matrix(part, A.strata_margins(part)).select("a", "b", F.col("z").alias(name))
        both = z if both is None else both.join(z, ["a", "b"])
    za, zb = F.col("z_a"), F.col("z_b")
    ok = (F.signum(za) == F.signum(zb)) & (F.abs(za) > 1) & (F.abs(zb) > 1)
    return both.select("a", "b", F.round("z_a", 6).alias("z_a"), F.round("z_b", 6).alias("z_b"), ok.alias("replicated"))
