"""Region, clustering, navigation and graph-support queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import association as A
from seqweave.operators import clustering as L
from seqweave.operators import decoder as D
from seqweave.operators import graph as G
from seqweave.operators import locate as W
from seqweave.operators import regions as R
from seqweave.operators import sequence as S
from seqweave.plans import association_queries as AQ
from seqweave.plans import corpus as C
from seqweave.plans.sequence_queries import BB
from seqweave.session import cut_lineage
from seqweave.sources.tables import typed

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: typed(fn(spark, folder))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _round(df, *names, digits=6):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


PLACES = """ms AS (SELECT family, spot FROM (SELECT family, spot, row_number() OVER (
  PARTITION BY family ORDER BY count(*) DESC, coalesce(spot, -1)) AS r FROM ev WHERE family IN (SELECT family FROM band) GROUP BY 1, 2) WHERE r = 1),
pl AS (SELECT e.family, any_value(ms.spot) AS spot, quantile_cont(pos, 0.5)::DOUBLE AS median, avg(in_rgp::INT) AS rgp
  FROM ev e JOIN ms USING (family) GROUP BY 1),
sl AS (SELECT *, CASE WHEN median - lag(median) OVER (ORDER BY median, family) <= 0.5 THEN 0 ELSE 1 END AS st FROM pl WHERE spot IS NULL),
rg AS (SELECT family, 's' || spot AS region FROM pl WHERE spot IS NOT NULL
  UNION ALL SELECT family, 'p' || sum(st) OVER (ORDER BY median, family) FROM sl)"""


def _places(spark, folder):
    rows = C.genes(spark, folder)
    return R.family_places(rows, A.frequency_band(rows))


@query(f"WITH {AQ.PRES}, {PLACES} SELECT family, spot, median, round(rgp, 6) AS rgp FROM pl")
def family_places(spark, folder):
    return _round(_places(spark, folder), "rgp")


@query(f"WITH {AQ.PRES}, {PLACES} SELECT family, region FROM rg")
def assign_regions(spark, folder):
    return R.assign_regions(cut_lineage(_places(spark, folder)), 0.5)


LINKS = f"""{AQ.CMH}, {PLACES},
hi AS (SELECT a, b, z FROM z WHERE abs(z) > 1),
lk AS (SELECT least(x.region, y.region) AS a, greatest(x.region, y.region) AS b, z
  FROM hi JOIN rg x ON x.family = hi.a JOIN rg y ON y.family = hi.b WHERE x.region <> y.region),
li AS (SELECT a, b, count(*) AS pairs, count(*) FILTER (WHERE z > 0) AS pos, count(*) FILTER (WHERE z <= 0) AS neg,
  first(z ORDER BY round(abs(z), 9) DESC, z) AS z, CASE WHEN count(*) FILTER (WHERE z > 0) * 2 >= count(*) THEN 1 ELSE -1 END AS sign FROM lk GROUP BY 1, 2)"""


def _links(spark, folder):
    held = AQ.presence(spark, folder)
    z = A.cmh_matrix(held, A.strata_margins(held)).where(F.abs("z") > 1).select("a", "b", "z")
    regions = cut_lineage(R.assign_regions(cut_lineage(_places(spark, folder)), 0.5))
    return regions, cut_lineage(R.region_links(z, regions))


@query(f"WITH {LINKS} SELECT a, b, pairs, pos, neg, round(z, 6) AS z, sign::BIGINT AS sign FROM li")
def region_links(spark, folder):
    return _round(_links(spark, folder)[1], "z")


@query(
    f"""WITH {LINKS}, pd AS (SELECT DISTINCT region, split_part(family, '#', 1) AS product FROM rg)
SELECT a, b, string_agg(x.product, ',' ORDER BY x.product) AS shared FROM li JOIN pd x ON x.region = a JOIN pd y ON y.region = b AND y.product = x.product GROUP BY 1, 2"""
)
def shared_products(spark, folder):
    regions, links = _links(spark, folder)
    members = regions.select("region", F.substring_index("family", "#", 1).alias("product"))
    return R.shared_products(members, links)


@query()
def region_sets(spark, folder):
    """Communities of families over their positive associations."""
    held = AQ.presence(spark, folder)
    z = A.cmh_matrix(held, A.strata_margins(held)).where(F.col("z") > 1)
    return L.communities(cut_lineage(z.select("a", "b", F.col("z").alias("w"))))


ANCHORS = BB + """,
an AS (SELECT family, median, row_number() OVER (ORDER BY median, family) - 1 AS rank FROM bb),
nx AS (SELECT a.rank, CASE WHEN a.rank < (SELECT max(rank) FROM an) THEN
  greatest((SELECT max(rank) FROM an b WHERE b.median <= a.median + 1.5), a.rank + 1) END AS next FROM an a)"""


def _anchors(rows):
    return cut_lineage(S.backbone(rows, 0.3).select("family", "median", F.col("rank").cast("bigint").alias("rank")))


@query(f"WITH {C.EV}, {ANCHORS} SELECT rank, next FROM nx")
def next_window(spark, folder):
    return W.next_windows(_anchors(C.genes(spark, folder)), 1.5)


CHAIN = BB + """,
an AS MATERIALIZED (SELECT family, median, row_number() OVER (ORDER BY median, family) - 1 AS rank FROM bb),
nx AS MATERIALIZED (SELECT rank, CASE WHEN rank < max(rank) OVER () THEN greatest(rank + 1, max(rank) OVER (
  ORDER BY median RANGE BETWEEN CURRENT ROW AND 1.5 FOLLOWING)) END AS next FROM an)"""


@query(
    f"""WITH RECURSIVE {C.EV}, {CHAIN},
ch(rank, step) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT nx.next, ch.step + 1 FROM ch JOIN nx ON nx.rank = ch.rank WHERE nx.next IS NOT NULL)
SELECT rank, step FROM ch"""
)
def window_chain(spark, folder):
    return W.window_chain(W.next_windows(_anchors(C.genes(spark, folder)), 1.5))


@query(
    f"""WITH RECURSIVE {C.EV}, {CHAIN},
ch(rank, step) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT nx.next, ch.step + 1 FROM ch JOIN nx ON nx.rank = ch.rank WHERE nx.next IS NOT NULL)
SELECT a.rank, CASE WHEN a.rank > 0 THEN coalesce((SELECT p.rank FROM ch p JOIN ch c ON c.step = p.step + 1 WHERE c.rank = a.rank),
  (SELECT max(n.rank) FROM nx n WHERE n.next = a.rank),
  least((SELECT min(b.rank) FROM an b WHERE b.median >= a.median - 1.5), a.rank - 1)) END AS previous FROM an a"""
)
def previous_window(spark, folder):
    anchors = _anchors(C.genes(spark, folder))
    following = cut_lineage(W.next_windows(anchors, 1.5))
    return W.previous_windows(anchors, following, W.window_chain(following), 1.5)


OFFSETS = f"""{C.EV}, {ANCHORS},
oa AS (SELECT genome, rank, min(pos) AS ap, min(length) AS length FROM ev JOIN an USING (family) GROUP BY 1, 2 HAVING count(*) = 1),
of AS (SELECT rank, oa.genome, min((((t.pos - ap) % t.length) + t.length) % t.length) AS "offset"
  FROM oa JOIN ev t ON t.genome = oa.genome AND t.family = 'purchase#4' GROUP BY 1, 2)"""


def _offsets(spark, folder):
    rows = C.genes(spark, folder)
    return W.anchor_offsets(rows, _anchors(rows), "purchase#4")


@query(f'WITH {OFFSETS} SELECT rank, genome, "offset" FROM of')
def anchor_offsets(spark, folder):
    return _offsets(spark, folder)


@query(
    f"""WITH {OFFSETS}, s AS (SELECT rank, count(*) AS carriers, quantile_cont("offset", 0.5)::DOUBLE AS "column" FROM of WHERE "offset" <= 15 GROUP BY 1)
SELECT rank, carriers, "column" FROM s ORDER BY carriers DESC, abs("column" - 5), rank LIMIT 1"""
)
def locate_family(spark, folder):
    return W.best_anchor(_offsets(spark, folder), reach=15, lead=5)


def _greedy_sql(steps: int = 3) -> str:
    """Places one after the other: each is a best row of what the earlier ones leave."""
    parts, left = [], """l0 AS (SELECT DISTINCT genome FROM of WHERE genome NOT IN (SELECT genome FROM of WHERE rank = (SELECT rank FROM st) AND "offset" <= 19)),
p0 AS (SELECT 1 AS rank)"""
    for i in range(1, steps + 1):
        parts.append(f"""p{i} AS (SELECT rank, count(*) AS carriers, quantile_cont("offset", 0.5)::DOUBLE AS "column" FROM of
  WHERE "offset" <= 15 AND genome IN (SELECT genome FROM l{i - 1}) AND EXISTS (SELECT 1 FROM p{i - 1}) GROUP BY 1
  HAVING count(*) >= greatest(2, 0.02 * (SELECT count(DISTINCT genome) FROM of)) ORDER BY carriers DESC, rank LIMIT 1),
l{i} AS (SELECT genome FROM l{i - 1} WHERE genome NOT IN (SELECT genome FROM of WHERE rank IN (SELECT rank FROM p{i}) AND "offset" <= 19))""")
    return left + ", " + ", ".join(parts) + " " + " UNION ALL ".join(f'SELECT rank, carriers, "column" FROM p{i}' for i in range(1, steps + 1))


@query(
    f"""WITH {OFFSETS}, s AS (SELECT rank, count(*) AS carriers, quantile_cont("offset", 0.5)::DOUBLE AS "column" FROM of WHERE "offset" <= 15 GROUP BY 1),
st AS (SELECT rank FROM s ORDER BY carriers DESC, abs("column" - 5), rank LIMIT 1), {_greedy_sql()}"""
)
def other_places(spark, folder):
    """The best anchor and the other places of a family, greedily."""
    offsets = cut_lineage(_offsets(spark, folder))
    best = W.best_anchor(offsets, reach=15, lead=5).first()
    places = W.other_places(offsets, best["rank"], 20, reach=15)
    return spark.createDataFrame(places, "rank bigint, carriers bigint, column double")


@query(
    f"""WITH {C.TR}, e AS (SELECT DISTINCT prev AS a, family AS b FROM tr WHERE prev IS NOT NULL),
r1 AS (SELECT DISTINCT a AS source, b AS node FROM e WHERE a <> b),
r2 AS (SELECT DISTINCT r1.source, e.b AS node FROM r1 JOIN e ON e.a = r1.node)
SELECT source, node, min(step)::BIGINT AS step FROM (SELECT DISTINCT a AS source, a AS node, 0 AS step FROM e
  UNION ALL SELECT source, node, 1 FROM r1 UNION ALL SELECT source, node, 2 FROM r2) GROUP BY 1, 2"""
)
def neighbourhood(spark, folder):
    table = G.edges(C.genes(spark, folder)).select(F.col("prev").alias("a"), F.col("family").alias("b"))
    table = cut_lineage(table)
    return R.hops(table, table.select(F.col("a").alias("source")).distinct(), 2)


@query(
    f"""WITH {C.TR}, c AS (SELECT prev AS a, family AS b, count(*) FILTER (WHERE genome % 2 = 0) AS n0, count(*) FILTER (WHERE genome % 2 = 1) AS n1
  FROM tr WHERE prev IS NOT NULL GROUP BY 1, 2),
p AS (SELECT a, b FROM c WHERE n0 >= 5), h AS (SELECT a, b FROM c WHERE n1 >= 4 AND a <> b),
na AS (SELECT count(DISTINCT a) AS k FROM p), nb AS (SELECT count(DISTINCT b) AS k FROM p),
i AS (SELECT * FROM h WHERE a IN (SELECT a FROM p) AND b IN (SELECT b FROM p)),
r AS (SELECT p.a, p.b, (h.a IS NOT NULL)::INT AS hit, coalesce(ib.n, 0) AS inn, coalesce(ia.n, 0) AS outn FROM p LEFT JOIN h ON h.a = p.a AND h.b = p.b
  LEFT JOIN (SELECT b, count(*) AS n FROM i GROUP BY 1) ib ON ib.b = p.b LEFT JOIN (SELECT a, count(*) AS n FROM i GROUP BY 1) ia ON ia.a = p.a)
SELECT count(*) AS n, round(avg(hit), 6) AS supported, round(avg((inn - hit) / nullif(na.k - 1, 0)), 6) AS target_null,
  round(avg((outn - hit) / nullif(nb.k - 1, 0)), 6) AS source_null, round(avg(hit) / greatest(avg((inn - hit) / nullif(na.k - 1, 0)), 1e-9), 6) AS enrichment FROM r, na, nb"""
)
def edge_support(spark, folder):
    """Edges seen in one half of the genomes, looked up in the other half."""
    half = F.pmod("genome", F.lit(2))
    adj = G.adjacencies(C.genes(spark, folder)).where(F.col("prev").isNotNull())
    counts = cut_lineage(
        adj.groupBy(F.col("prev").alias("a"), F.col("family").alias("b")).agg(
            F.count_if(half == 0).alias("n0"), F.count_if(half == 1).alias("n1")
        )
    )
    reached = counts.where(F.col("n1") >= 4).select(F.col("a").alias("source"), F.col("b").alias("node"))
    out = R.edge_support(counts.where(F.col("n0") >= 5), reached)
    return _round(out, "supported", "target_null", "source_null", "enrichment")


@query(
    f"""WITH {C.EV}, h AS (SELECT DISTINCT family, genome FROM ev), n AS (SELECT count(DISTINCT genome)::DOUBLE AS k FROM ev),
f AS (SELECT family, count(*) / any_value(k) AS share FROM h, n GROUP BY 1)
SELECT family, round(share, 6) AS share, CASE WHEN share >= 0.9 THEN 'core' WHEN share >= 0.8 THEN 'shell' ELSE 'cloud' END AS part FROM f"""
)
def partitions(spark, folder):
    """Core, shell and cloud families by the share of genomes holding them."""
    rows = C.genes(spark, folder)
    freq = A.frequency_band(rows, 0.0, 1.0)
    part = F.when(F.col("freq") >= 0.9, "core").when(F.col("freq") >= 0.8, "shell").otherwise("cloud")
    return freq.select("family", F.round("freq", 6).alias("share"), part.alias("part"))


def _blocks_sql(src, name, gap):
    """Circular blocks of the positions in ``src`` (region, genome, pos, length)."""
    return f"""{name}_m AS (SELECT region, genome, pos, length, (((pos - coalesce(lag(pos) OVER w, last_value(pos) OVER (PARTITION BY region, genome
    ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) % length) + length) % length AS gap
  FROM {src} WINDOW w AS (PARTITION BY region, genome ORDER BY pos)),
{name}_s AS (SELECT *, CASE WHEN gap > {gap} OR gap = 0 THEN 1 ELSE 0 END AS st FROM {name}_m),
{name}_r AS (SELECT *, sum(st) OVER (PARTITION BY region, genome ORDER BY pos) AS rs, sum(st) OVER (PARTITION BY region, genome) AS cuts FROM {name}_s),
{name} AS (SELECT region, genome, min(CASE WHEN cuts = 0 OR st = 1 THEN pos END) AS start,
  coalesce(max(CASE WHEN rs = 0 THEN pos END), max(pos)) AS "end", count(*) AS genes FROM {name}_r
  GROUP BY region, genome, CASE WHEN rs = 0 THEN cuts ELSE rs END)"""


ELEMENTS = f"""{C.EV}, {BB},
own AS (SELECT name || '/' || (allele % 8 // 4) AS region, genome, pos, length, family FROM ev),
regs AS (SELECT DISTINCT region, CASE WHEN region LIKE '%/0' AND region NOT LIKE 'view%' THEN CASE WHEN region < 'f' THEN 0 ELSE 1 END END AS spot FROM own),
prs AS (SELECT region, genome, count(DISTINCT family) / 4.0::DOUBLE AS share, count(DISTINCT family) >= 2 AS present FROM own GROUP BY 1, 2),
ats AS (SELECT region, genome, min(pos) AS lo, max(pos) AS hi FROM regs JOIN ev ON ev.spot = regs.spot GROUP BY 1, 2),
ins AS (SELECT own.* FROM own JOIN ats USING (region, genome) WHERE pos BETWEEN lo - 5 AND hi + 5),
{_blocks_sql('ins', 'sb', 3)},
sbest AS (SELECT region, genome, start, "end", genes FROM sb JOIN ats USING (region, genome)
  QUALIFY row_number() OVER (PARTITION BY region, genome ORDER BY genes DESC, abs(start - lo), start) = 1),
{_blocks_sql('own', 'ab', 3)},
cen AS (SELECT region, quantile_cont(pos, 0.5)::DOUBLE AS center FROM own GROUP BY 1),
cb AS (SELECT ab.region, ab.genome, start, "end", genes FROM ab JOIN prs USING (region, genome) LEFT JOIN ats USING (region, genome) JOIN cen USING (region)
  WHERE present QUALIFY row_number() OVER (PARTITION BY ab.region, ab.genome ORDER BY abs((start + "end") / 2.0::DOUBLE - coalesce(lo, center)), genes DESC, start) = 1),
one AS (SELECT genome, family, min(pos) AS pos, any_value(length) AS length FROM ev GROUP BY 1, 2 HAVING count(*) = 1),
ub AS (SELECT genome, family, pos + t * length AS pos FROM one, (VALUES (-1), (0), (1)) AS v(t) WHERE family IN (SELECT family FROM bb)),
lf AS (SELECT region, genome, (SELECT arg_max(u.family, u.pos) FROM ub u WHERE u.genome = cb.genome AND u.pos BETWEEN start - 10 AND start - 1) AS f FROM cb),
rf AS (SELECT region, genome, (SELECT arg_min(u.family, u.pos) FROM ub u WHERE u.genome = cb.genome AND u.pos BETWEEN "end" + 1 AND "end" + 10) AS f FROM cb),
lm AS (SELECT region, f FROM lf WHERE f IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, f) = 1),
rm AS (SELECT region, f FROM rf WHERE f IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, f) = 1),
pts AS (SELECT r.region, g.genome, coalesce(l.pos + 1, rr.pos) AS pt FROM regs r CROSS JOIN (SELECT DISTINCT genome FROM ev) g
  LEFT JOIN lm ON lm.region = r.region LEFT JOIN one l ON l.genome = g.genome AND l.family = lm.f
  LEFT JOIN rm ON rm.region = r.region LEFT JOIN one rr ON rr.genome = g.genome AND rr.family = rm.f
  WHERE coalesce(l.pos + 1, rr.pos) IS NOT NULL AND (r.region, g.genome) NOT IN (SELECT (region, genome) FROM ats)),
fb AS (SELECT p.region, p.genome, pt, start, "end", genes FROM pts p LEFT JOIN ab USING (region, genome)
  QUALIFY row_number() OVER (PARTITION BY p.region, p.genome ORDER BY abs((start + "end") / 2.0::DOUBLE - pt), genes DESC, start) = 1),
elem AS (SELECT a.region, a.genome, lo AS ins, 'spot' AS how, start, "end", genes FROM ats a LEFT JOIN sbest USING (region, genome)
  UNION ALL SELECT region, genome, pt, 'flanks', CASE WHEN abs(start - pt) <= 10 THEN start END, CASE WHEN abs(start - pt) <= 10 THEN "end" END,
  CASE WHEN abs(start - pt) <= 10 THEN genes END FROM fb)"""


def _elements(spark, folder):
    from seqweave.operators import elements as E

    rows = cut_lineage(C.genes(spark, folder).select("genome", "pos", "length", "family", "name", "allele", "spot"))
    flags = S.backbone(rows, 0.3).select("family", F.lit(True).alias("bb"))
    rows = cut_lineage(
        rows.join(flags, "family", "left").select(
            "genome", "pos", "length", "family", "name", "allele", "spot", F.coalesce("bb", F.lit(False)).alias("bb")
        )
    )
    region = F.concat_ws("/", "name", F.floor(F.col("allele") % 8 / 4).cast("string"))
    members = cut_lineage(rows.select(region.alias("region"), "family").distinct())
    spot = F.when(
        F.col("region").endswith("/0") & ~F.col("region").startswith("view"), F.when(F.col("region") < "f", 0).otherwise(1)
    )
    regions = members.select("region").distinct().withColumn("spot", spot.cast("bigint"))
    presence = cut_lineage(E.region_presence(rows, members))
    found = cut_lineage(E.locate_elements(rows, members, regions, gap=3, near=10, reach=10))
    return rows, found, presence


@query(f'WITH {ELEMENTS} SELECT region, genome, ins, how, start, "end", genes FROM elem')
def element_places(spark, folder):
    return _elements(spark, folder)[1]


RULES = ELEMENTS + """,
ec AS (SELECT e.*, length FROM elem e JOIN prs USING (region, genome) JOIN (SELECT DISTINCT genome, length FROM ev) USING (genome)
  WHERE present AND start IS NOT NULL),
be AS (SELECT ec.region, ec.genome, side, v.family FROM ec CROSS JOIN (VALUES ('pred'), ('succ')) AS s(side)
  JOIN ev v ON v.genome = ec.genome AND v.pos = CASE side WHEN 'pred' THEN (start - 1 + ec.length) % ec.length ELSE ("end" + 1) % ec.length END),
bm AS (SELECT region, side, family, n / sum(n) OVER (PARTITION BY region, side) AS share FROM (SELECT region, side, family, count(*) AS n FROM be GROUP BY 1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY region, side ORDER BY n DESC, family) = 1),
nc AS (SELECT ec.region, ec.genome, side, CASE side WHEN 'pred' THEN start ELSE ("end" + 1) % ec.length END AS want, v.pos + CASE side WHEN 'pred' THEN 1 ELSE 0 END AS row
  FROM ec JOIN bm USING (region) JOIN ev v ON v.genome = ec.genome AND v.family = bm.family AND abs(v.pos - ins) <= 40
  QUALIFY row_number() OVER (PARTITION BY ec.region, ec.genome, side ORDER BY abs(v.pos - ins), v.pos) = 1),
rules AS (SELECT bm.region, bm.side, bm.family, share, coalesce(h, 0) / k AS valid FROM bm
  JOIN (SELECT region, count(*)::DOUBLE AS k FROM ec GROUP BY 1) USING (region)
  LEFT JOIN (SELECT region, side, count(*) FILTER (WHERE row = want) AS h FROM nc GROUP BY 1, 2) USING (region, side))"""


@query(
    f"""WITH {RULES} SELECT region, side, family, round(share, 6) AS share, round(valid, 6) AS valid, share >= 0.05 AND valid >= 0.05 AS usable FROM rules"""
)
def insertion_rules(spark, folder):
    from seqweave.operators import elements as E

    return _round(E.insertion_rules(*_elements(spark, folder), share=0.05, valid=0.05), "share", "valid")


@query(
    f"""WITH {RULES} SELECT region, genome, row, side FROM (SELECT e.region, e.genome, side, v.pos + CASE side WHEN 'pred' THEN 1 ELSE 0 END AS row, length, v.pos, ins
  FROM elem e JOIN rules r USING (region) JOIN ev v ON v.genome = e.genome AND v.family = r.family AND abs(v.pos - ins) <= 40
  WHERE share >= 0.05 AND valid >= 0.05 AND (e.region, e.genome) NOT IN (SELECT (region, genome) FROM prs WHERE present)
  QUALIFY row_number() OVER (PARTITION BY e.region, e.genome, side ORDER BY abs(v.pos - ins), v.pos) = 1)
WHERE row < length QUALIFY row_number() OVER (PARTITION BY region, genome ORDER BY side) = 1"""
)
def absent_places(spark, folder):
    from seqweave.operators import elements as E

    rows, found, presence = _elements(spark, folder)
    rules = cut_lineage(E.insertion_rules(rows, found, presence, share=0.05, valid=0.05))
    return E.absent_places(rows, found, rules, presence)
