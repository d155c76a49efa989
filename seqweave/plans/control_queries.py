"""Influence of deletions against their controls, control panels, and correlations of families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqweave.operators import controls as O
from seqweave.operators import correlation as K
from seqweave.operators import matching as M
from seqweave.plans import corpus as C
from seqweave.plans.knockout_queries import MATCH, PROFILE, RUNS, _profile, _units, elements
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


@query(
    f"""WITH {MATCH}, {PROFILE.removeprefix(RUNS).lstrip(",").strip()},
nc AS MATERIALIZED (SELECT unit, control FROM (SELECT c.unit, c.control, row_number() OVER (PARTITION BY c.unit ORDER BY abs(p.c_end - u."end"), c.control) AS r
  FROM ct c JOIN un u ON u.unit = c.unit JOIN pool p ON p.control = c.control) WHERE r <= 8),
cv AS MATERIALIZED (SELECT nc.unit, o.bin, nc.control, c.mean_abs AS v FROM nc JOIN pf c ON c.pass = nc.control JOIN pf o ON o.pass = nc.unit AND o.bin = c.bin),
me AS (SELECT unit, NULL::BIGINT AS who, bin, o.mean_abs AS x, v FROM pf o JOIN (SELECT DISTINCT unit FROM nc) k ON k.unit = o.pass LEFT JOIN cv USING (unit, bin)
  UNION ALL SELECT a.unit, a.control, a.bin, a.v, b.v FROM cv a LEFT JOIN cv b ON b.unit = a.unit AND b.bin = a.bin AND b.control <> a.control),
m1 AS (SELECT *, quantile_cont(v, 0.5) OVER w AS med, count(v) OVER w AS n FROM me WINDOW w AS (PARTITION BY unit, who, bin)),
m2 AS (SELECT unit, who, bin, any_value(x) AS x, any_value(med) AS med, any_value(n) AS n, quantile_cont(abs(v - med), 0.5) AS mad FROM m1 GROUP BY ALL),
zb AS (SELECT unit, who, bin, coalesce(n >= 3 AND round((x - med) / greatest(1.4826 * mad, 1e-6), 9) >= 3, false) AS far, CASE WHEN n > 0 AND med > 0 THEN x / med END AS ratio FROM m2),
sm AS (SELECT unit, who, coalesce(max(bin) FILTER (WHERE far) + 1, 0) AS radius, coalesce(min(bin) FILTER (WHERE NOT far), max(bin) + 1) AS contiguous,
  count(*) FILTER (WHERE far) AS beyond, round(quantile_cont(ratio, 0.5), 9) AS broad FROM zb GROUP BY ALL),
rl AS (SELECT * FROM sm WHERE who IS NULL)
SELECT r.unit, r.radius, r.contiguous, r.beyond, round(r.broad, 6) AS broad, count(s.radius) AS controls,
  round((1 + count(*) FILTER (WHERE s.radius >= r.radius)) / (1 + count(s.radius))::DOUBLE, 6) AS p_radius,
  round((1 + count(*) FILTER (WHERE s.contiguous >= r.contiguous)) / (1 + count(s.contiguous))::DOUBLE, 6) AS p_contiguous,
  round((1 + count(*) FILTER (WHERE s.beyond >= r.beyond)) / (1 + count(s.beyond))::DOUBLE, 6) AS p_beyond,
  round((1 + count(*) FILTER (WHERE s.broad >= r.broad)) / (1 + count(s.broad))::DOUBLE, 6) AS p_broad
FROM rl r LEFT JOIN (SELECT * FROM sm WHERE who IS NOT NULL) s ON s.unit = r.unit GROUP BY ALL"""
)
def influence_null(spark, folder):
    """Radius and breadth of every deletion, and the share of its controls felt as far beyond the other controls."""
    units, pool = _units(spark, folder)
    matched = M.matched_controls(units, pool, log_factor=4.0).select("unit", "control")
    ends = units.select("unit", "end").join(matched.hint("merge"), "unit").join(pool.select("control", "c_end").hint("merge"), "control")
    controls = cut_lineage(ends.select("unit", "control", F.abs(F.col("c_end") - F.col("end")).alias("gap")))
    out = O.influence_null(cut_lineage(_profile(spark, folder)), controls)
    for c in ("broad", "p_radius", "p_contiguous", "p_beyond", "p_broad"):
        out = out.withColumn(c, F.round(c, 6))
    return out


STEPS = 4


@query(
    f"""WITH RECURSIVE {RUNS},
tg AS (SELECT genome, size, row_number() OVER (PARTITION BY genome ORDER BY size DESC, start) - 1 AS step FROM el QUALIFY step < {STEPS}),
pn(step, genome, element, s0, e0, uses, near, free, picked, first, size) AS (
  SELECT -1::BIGINT, genome, start, start, "end", 0, NULL::DOUBLE, list_transform(range(start, "end" + 1), lambda i: true), false, NULL::BIGINT, NULL::BIGINT FROM el
  UNION ALL SELECT step, genome, element, s0, e0, uses + mine::INT, least(near, abs(pf + (pz - 1) / 2.0::DOUBLE - (s0 + e0) / 2.0::DOUBLE)),
    CASE WHEN mine THEN list_transform(free, lambda x, i: x AND NOT (i - 1 >= pf - s0 AND i - 1 < pf - s0 + pz)) ELSE free END, mine, CASE WHEN mine THEN pf END, CASE WHEN mine THEN pz END
  FROM (SELECT *, coalesce(element = p.element, false) AS mine, p.first AS pf, p.size AS pz FROM (
    SELECT *, first_value(CASE WHEN len(room) > 0 THEN {{'element': element, 'size': tsize, 'first': s0 + room[1 + (genome * 31 + step * 17 + element) % len(room)]}} END)
      OVER (PARTITION BY genome ORDER BY coalesce(len(room), 0) = 0, uses, coalesce(-near, 0), md5(genome || '|' || step || '|' || element)) AS p FROM (
      SELECT q.step + 1 AS step, q.genome, q.element, s0, e0, uses, near, free, t.size AS tsize,
        list_filter(range(0, len(free) - t.size + 1), lambda s: list_bool_and(free[s + 1:s + t.size])) AS room
      FROM pn q LEFT JOIN tg t ON t.genome = q.genome AND t.step = q.step + 1 WHERE q.step + 1 < {STEPS}))))
SELECT genome, step, element, first, first + size - 1 AS last, size FROM pn WHERE picked"""
)
def control_panel(spark, folder):
    """Control deletions as large as a genome's largest runs, spread over its runs."""
    found = cut_lineage(elements(spark, folder))
    order = Window.partitionBy("genome").orderBy(F.desc("size"), "start")
    targets = found.withColumn("step", F.row_number().over(order) - 1).where(F.col("step") < STEPS).select("genome", "step", "size")
    return O.control_panel(found.select("genome", F.col("start").alias("element"), "start", "end"), targets)


@query(
    f"""WITH {C.EV}, c AS (SELECT family AS item, genome AS unit, count(*)::DOUBLE AS v FROM ev GROUP BY 1, 2),
gd AS MATERIALIZED (SELECT i.item, u.unit, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT item FROM c) i, (SELECT DISTINCT unit FROM c) u LEFT JOIN c ON c.item = i.item AND c.unit = u.unit),
rk AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY item ORDER BY v) - (count(*) OVER (PARTITION BY item, v) - 1) / 2.0::DOUBLE AS r FROM gd)
SELECT x.item AS a, y.item AS b, count(*) FILTER (WHERE x.v > 0 AND y.v > 0) AS shared, round(corr(x.v, y.v), 6) AS pearson, round(corr(x.r, y.r), 6) AS spearman
FROM rk x JOIN rk y ON y.unit = x.unit AND x.item < y.item GROUP BY 1, 2 HAVING shared > 0"""
)
def rank_correlation(spark, folder):
    """Pearson and Spearman correlation of the copy numbers of families over genomes."""
    rows = C.genes(spark, folder)
    counts = cut_lineage(rows.groupBy(F.col("family").alias("item"), F.col("genome").alias("unit")).agg(F.count(F.lit(1)).alias("value")))
    units = counts.select("unit").distinct().count()
    out = K.rank_correlation(counts, units)
    return out.withColumn("pearson", F.round("pearson", 6)).withColumn("spearman", F.round("spearman", 6))
