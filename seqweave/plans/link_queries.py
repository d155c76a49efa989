"""Calibrated tests of links, specificity and the decision table.

A unit is a plastic run deleted. Its link leads to the next gene of its own class 8 to 40 places behind it, where it is
read, as it is at the starts of other runs near there. Its effect is the mean value of its genes, higher where the gene
read is of its class (lower for the class ``view``); raw effects also grow a little with the value of the gene read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import links as L
from seqweave.operators import stats as X
from seqweave.plans import corpus as C
from seqweave.plans.knockout_queries import POSITIONS, RUNS, elements
from seqweave.session import cut_lineage
from seqweave.sources.tables import typed

QUERIES = {}
ORACLES = {}

DRAWS, LEVEL = 200, 0.3
#: Places behind a deletion between which its target is looked for, and what a gene of its class adds there.
NEAR, FAR, OWN = 8, 40, 12.0


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: typed(fn(spark, folder))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# --- units, their reads and what each test takes from them ----------------------------------------------------------


def _genes(spark, folder):
    """The genes as these queries read them, numbered and written once."""
    return cut_lineage(C.genes(spark, folder).select("genome", "pos", "name", "value", "in_rgp"))


def _units(spark, folder, genes):
    found = cut_lineage(elements(spark, folder, genes).withColumn("unit", F.col("genome") * POSITIONS + F.col("start")))
    link = F.concat_ws("#", "link", F.least("size", F.lit(3)).cast("string"))
    units = found.withColumns({"name": F.col("link"), "link": link})
    rows = genes.select("genome", "name", "pos").withColumn("_bin", F.floor(F.col("pos") / FAR))
    bins = F.explode(F.sequence(F.floor((F.col("end") + NEAR) / FAR), F.floor((F.col("end") + FAR) / FAR)))
    met = units.select("genome", "name", "unit", "end").withColumn("_bin", bins).join(rows, ["genome", "name", "_bin"])
    met = met.where(F.col("pos").between(F.col("end") + NEAR, F.col("end") + FAR)).groupBy("unit").agg(F.min("pos").alias("row"))
    units = cut_lineage(units.join(met, "unit").withColumn("dist", F.col("row") - F.col("end")))
    pool = found.select(
        "genome", F.col("unit").alias("control"), F.col("start").alias("c_start"),
        F.col("end").alias("c_end"), F.col("size").alias("c_size"), F.col("delta").alias("c_delta"),
    )
    return found, units, pool


def tested(spark, folder):
    """link, lineage, unit and for the tests effect, spec and raw the unit's value and its stand-ins' values."""
    genes = _genes(spark, folder)
    found, units, pool = _units(spark, folder, genes)
    off = L.off_targets(units, found.select("genome", F.col("start").alias("entry")))
    reads = units.select("genome", "unit", F.col("row").alias("at"), F.lit(True).alias("own")).unionByName(
        off.select("genome", "unit", F.col("entry").alias("at"), F.lit(False).alias("own")))
    values = genes.select("genome", F.col("pos").alias("at"), F.col("value").alias("v"), F.col("name").alias("there"))
    reads = reads.join(values, ["genome", "at"]).join(units.select("unit", "start", "end", "size", "delta", "name"), "unit")
    more = F.when(F.col("there") != F.col("name"), 0.0).when(F.col("name") == "view", -OWN).otherwise(OWN)
    reads = reads.withColumn("delta", F.col("delta") + more)
    reads = cut_lineage(reads.select(
        "genome", F.struct("unit", "at").alias("unit"), "own", "v", "start", "end", "size", "delta", F.col("at").alias("row"),
        (F.col("at") - F.col("end")).alias("dist")))
    scores, stand = L.stand_ins(reads, pool, log_factor=4.0)
    told, scale = reads.select("unit", "own", "v", "delta"), 1 + F.col("v") / 2000
    scores = scores.join(told, "unit").select("unit.unit", "own", "z", (F.col("delta") * scale).alias("raw"))
    stand = stand.join(told, "unit").select("unit.unit", "control", "own", "z", (F.col("excess") * scale).alias("raw"))
    both = lambda df, keys: L.beside(df, keys, "z", r_="raw").where(F.col("on").isNotNull()).select(
        *keys, L.steps(F.col("on")).alias("effect"), L.steps(F.col("on") - F.col("off")).alias("spec"),
        L.steps(F.col("r_on") - F.col("r_off")).alias("raw"))
    mine = both(scores, ["unit"])
    theirs = both(stand, ["unit", "control"]).groupBy("unit").agg(
        F.array_sort(F.collect_list(F.struct("control", "effect", "spec", "raw"))).alias("stand"))
    lineage = F.pmod("genome", F.lit(24)).cast("string").alias("lineage")
    return cut_lineage(mine.join(theirs, "unit").join(units.select("unit", "link", lineage), "unit"))


def one_test(rows, name, draws=DRAWS):
    stand = F.transform("stand", lambda s: s[name])
    return L.calibrated(rows.select("link", "lineage", "unit", F.col(name).alias("x"), stand.alias("stand")), draws)


TESTED = RUNS.replace("arg_min(name, pos) AS link", "arg_min(name, pos) AS nm, arg_min(name, pos) || '#' || least(count(*), 3) AS link").replace(
    """un AS (SELECT *, genome * 4294967296 + start AS unit, 10 AS dist, "end" + 10 AS "row" FROM el)""",
    f"""u0 AS (SELECT el.genome, start, "end", size, delta, nm, link, genome * 4294967296 + start AS unit FROM el),
ur AS (SELECT unit, min(pos) AS "row" FROM u0 JOIN ev ON ev.genome = u0.genome AND ev.name = nm AND pos BETWEEN "end" + {NEAR} AND "end" + {FAR} GROUP BY 1),
un AS (SELECT u0.*, "row", "row" - "end" AS dist FROM u0 JOIN ur USING (unit))""") + """,
of0 AS (SELECT u.genome, u.unit, e.start AS entry, row_number() OVER (PARTITION BY u.unit ORDER BY abs(e.start - u."row"), e.start) AS r
  FROM un u JOIN el e ON e.genome = u.genome AND e.start BETWEEN u."end" + (1 - 0.35::DOUBLE) * u.dist AND u."end" + (1 + 0.35::DOUBLE) * u.dist
  AND e.start <> u."row" AND NOT e.start BETWEEN u.start AND u."end"),
rd0 AS (SELECT genome, unit, "row" AS rx, true AS own FROM un UNION ALL SELECT genome, unit, entry, false FROM of0 WHERE r <= 12),
rd AS MATERIALIZED (SELECT r.genome, r.unit, r.rx, r.own, u.start, u."end", u.size, u.delta + CASE WHEN ev.name <> nm THEN 0 WHEN nm = 'view' THEN -12 ELSE 12 END AS delta, r.rx - u."end" AS dist, ev.value AS v
  FROM rd0 r JOIN un u ON u.unit = r.unit JOIN ev ON ev.genome = r.genome AND ev.pos = r.rx),
m1 AS MATERIALIZED (SELECT unit, rx, r.genome, control, c_start, c_end, c_size, c_delta,
  c_size >= 0.5 * size AND c_size <= 2 * size AND abs(rx - c_end - dist) <= 0.35 * dist AS t1,
  c_size >= (1.0::DOUBLE / 3) * size AND c_size <= 3 * size AND abs(rx - c_end - dist) <= 0.6 * dist AS t2,
  c_size >= (1.0::DOUBLE / 3) * size AND c_size <= 3 * size AND abs(ln(greatest(rx - c_end, 1) / dist::DOUBLE)) <= ln(4) AS t3
  FROM rd r JOIN pool p ON p.genome = r.genome AND (c_start > r."end" OR c_end < r.start) AND c_end < rx),
n1 AS (SELECT unit, rx, CASE WHEN count(*) FILTER (WHERE t1) >= 3 THEN 1 WHEN count(*) FILTER (WHERE t2) >= 3 THEN 2 ELSE 3 END AS tier FROM m1 GROUP BY ALL),
c1 AS MATERIALIZED (SELECT m1.* FROM m1 JOIN n1 USING (unit, rx) WHERE CASE tier WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END),
d1 AS (SELECT unit, rx, quantile_cont(c_delta, 0.5) AS med FROM c1 GROUP BY ALL HAVING count(*) >= 3),
s1 AS (SELECT c1.unit, c1.rx, any_value(med) AS med, quantile_cont(abs(c_delta - med), 0.5) AS mad FROM c1 JOIN d1 USING (unit, rx) GROUP BY ALL),
zs AS (SELECT rd.unit, own, v, delta, (delta - med) / greatest(1.4826 * mad, 1e-6) AS z, delta * (1 + v / 2000) AS raw FROM s1 JOIN rd USING (unit, rx)),
m2 AS MATERIALIZED (SELECT s.unit, s.rx, s.control AS c0, s.c_delta AS delta, p.c_delta,
  p.c_size >= 0.5 * s.c_size AND p.c_size <= 2 * s.c_size AND abs(rx - p.c_end - (rx - s.c_end)) <= 0.35 * (rx - s.c_end) AS t1,
  p.c_size >= (1.0::DOUBLE / 3) * s.c_size AND p.c_size <= 3 * s.c_size AND abs(rx - p.c_end - (rx - s.c_end)) <= 0.6 * (rx - s.c_end) AS t2
  FROM c1 s JOIN pool p ON p.genome = s.genome AND (p.c_start > s.c_end OR p.c_end < s.c_start) AND p.c_end < rx),
g2 AS (SELECT *, count(*) FILTER (WHERE t1) OVER (PARTITION BY unit, rx, c0) >= 3 AS narrow FROM m2 WHERE t1 OR t2),
c2 AS MATERIALIZED (SELECT * FROM g2 WHERE CASE WHEN narrow THEN t1 ELSE t2 END),
d2 AS (SELECT unit, rx, c0, quantile_cont(c_delta, 0.5) AS med FROM c2 GROUP BY ALL HAVING count(*) >= 3),
s2 AS (SELECT c2.unit, c2.rx, c0, any_value(delta) AS delta, any_value(med) AS med, quantile_cont(abs(c_delta - med), 0.5) AS mad FROM c2 JOIN d2 USING (unit, rx, c0) GROUP BY ALL),
ps AS (SELECT rd.unit, c0, own, (s2.delta - med) / greatest(1.4826 * mad, 1e-6) AS z, (s2.delta - med) * (1 + v / 2000) AS raw FROM s2 JOIN rd USING (unit, rx)),
mine AS (SELECT unit, round(avg(z) FILTER (WHERE own) / 0.0001)::BIGINT AS effect,
  round((avg(z) FILTER (WHERE own) - avg(z) FILTER (WHERE NOT own)) / 0.0001)::BIGINT AS spec,
  round((avg(raw) FILTER (WHERE own) - avg(raw) FILTER (WHERE NOT own)) / 0.0001)::BIGINT AS raw FROM zs GROUP BY unit),
thr AS (SELECT unit, c0, round(avg(z) FILTER (WHERE own) / 0.0001)::BIGINT AS effect,
  round((avg(z) FILTER (WHERE own) - avg(z) FILTER (WHERE NOT own)) / 0.0001)::BIGINT AS spec,
  round((avg(raw) FILTER (WHERE own) - avg(raw) FILTER (WHERE NOT own)) / 0.0001)::BIGINT AS raw FROM ps GROUP BY unit, c0),
their AS (SELECT unit, list({'effect': effect, 'spec': spec, 'raw': raw} ORDER BY c0) AS stand FROM thr WHERE effect IS NOT NULL GROUP BY unit),
td AS MATERIALIZED (SELECT unit, link, genome % 24 AS lineage, effect, spec, raw, stand FROM mine JOIN their USING (unit) JOIN un USING (unit) WHERE effect IS NOT NULL)"""


def one_test_sql(name: str, draws: int = DRAWS) -> str:
    """The test of one value as statements over ``td``; the table of its result is named t_<name>."""
    return f"""u_{name} AS MATERIALIZED (SELECT link, lineage, unit % 2147483647 AS u, {name} AS x, list_transform(stand, lambda s: s.{name}) AS stand FROM td
  WHERE {name} IS NOT NULL),
x1_{name} AS (SELECT link, lineage, x, stand, d, (u + d * 7368787) % 2147483647 AS h FROM u_{name}, range(-1, {draws}) r(d)),
x2_{name} AS (SELECT link, lineage, d, x, stand, ((h * h + 12345) % 2147483647) AS h FROM x1_{name}),
x3_{name} AS (SELECT link, lineage, d, CASE WHEN d < 0 THEN x ELSE stand[1 + ((h * h + 67891) % 2147483647) * len(stand) // 2147483647] END AS v FROM x2_{name}),
ml_{name} AS MATERIALIZED (SELECT link, lineage, d, sum(v) / count(v)::DOUBLE AS m FROM x3_{name} GROUP BY ALL),
fn_{name} AS (SELECT link, d, count(m) AS finite FROM ml_{name} GROUP BY ALL),
rk_{name} AS (SELECT link, d, m, count(*) OVER (PARTITION BY link, d ORDER BY abs(m)) - count(*) OVER (PARTITION BY link, d, abs(m)) AS below,
  count(*) OVER (PARTITION BY link, d, abs(m)) AS t, count(*) OVER (PARTITION BY link, d) AS n FROM ml_{name} WHERE m <> 0),
w_{name} AS (SELECT link, d, any_value(n)::DOUBLE AS n, sum(CASE WHEN m > 0 THEN below + (t + 1) / 2.0::DOUBLE ELSE 0 END) AS w, sum(t * t - 1)::DOUBLE AS ties
  FROM rk_{name} GROUP BY ALL),
z_{name} AS (SELECT f.link, f.d, CASE WHEN n IS NULL OR n * (n + 1) * (2 * n + 1) / 24 - ties / 48 <= 0 THEN 0
  ELSE round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 9) END AS z
  FROM fn_{name} f LEFT JOIN (SELECT * FROM w_{name}) USING (link, d) WHERE f.finite >= 5),
o_{name} AS (SELECT link, count(DISTINCT lineage) AS lineages FROM u_{name} GROUP BY link),
t_{name} AS MATERIALIZED (SELECT o.link, any_value(lineages) AS lineages, any_value(r.z) AS z, count(q.z) AS draws,
  CASE WHEN any_value(r.z) IS NOT NULL THEN (1 + count(*) FILTER (WHERE q.z >= r.z)) / (1 + count(q.z))::DOUBLE END AS p_up,
  CASE WHEN any_value(r.z) IS NOT NULL THEN (1 + count(*) FILTER (WHERE q.z <= r.z)) / (1 + count(q.z))::DOUBLE END AS p_down
  FROM o_{name} o LEFT JOIN (SELECT * FROM z_{name} WHERE d < 0) r ON r.link = o.link LEFT JOIN (SELECT * FROM z_{name} WHERE d >= 0) q ON q.link = o.link GROUP BY o.link)"""


@query(f"WITH {TESTED}, {one_test_sql('effect')} SELECT link, lineages, round(z, 6) AS z, draws, round(p_up, 6) AS p_up, round(p_down, 6) AS p_down FROM t_effect")
def calibrated_links(spark, folder):
    """Signed-rank test of every link, its p the share of draws of stand-ins that are at least as extreme."""
    out = one_test(tested(spark, folder), "effect")
    for c in ("z", "p_up", "p_down"):
        out = out.withColumn(c, F.round(c, 6))
    return out


TAIL = "CASE WHEN z IS NULL THEN NULL WHEN z >= 0 THEN {0} ELSE 1 - {0} END".format(
    "exp(-z * z / 2) / sqrt(2 * pi()) * (0.319381530::DOUBLE / (1 + 0.2316419::DOUBLE * abs(z)) - 0.356563782::DOUBLE / pow(1 + 0.2316419::DOUBLE * abs(z), 2)"
    " + 1.781477937::DOUBLE / pow(1 + 0.2316419::DOUBLE * abs(z), 3) - 1.821255978::DOUBLE / pow(1 + 0.2316419::DOUBLE * abs(z), 4)"
    " + 1.330274429::DOUBLE / pow(1 + 0.2316419::DOUBLE * abs(z), 5))"
)

VERDICT = f"""WITH {TESTED}, {one_test_sql('effect')}, {one_test_sql('spec')}, {one_test_sql('raw')},
rt AS (SELECT link, p_up, p_down, {TAIL} AS tail FROM t_raw),
pv AS (SELECT e.link, e.lineages, round(e.p_up, 9) AS effect, round(e.p_down, 9) AS opposite, round(s.p_up, 9) AS specific, round(s.p_down, 9) AS specific_opp,
  round(greatest(r.p_up, r.tail), 9) AS specific_raw, round(greatest(r.p_down, 1 - r.tail), 9) AS specific_raw_opp
  FROM t_effect e LEFT JOIN t_spec s USING (link) LEFT JOIN rt r USING (link) WHERE e.p_up IS NOT NULL),
lg AS (UNPIVOT pv ON effect, opposite, specific, specific_opp, specific_raw, specific_raw_opp INTO NAME kind VALUE p),
rw AS (SELECT kind, p, p * count(*) OVER (PARTITION BY kind) / count(*) OVER (PARTITION BY kind ORDER BY p) AS raw FROM lg),
qv AS (SELECT DISTINCT kind, p, least(min(raw) OVER (PARTITION BY kind ORDER BY p DESC), 1) AS q FROM rw),
qs AS (SELECT link, max(q) FILTER (WHERE kind = 'effect') AS q_effect, max(q) FILTER (WHERE kind = 'opposite') AS q_opposite,
  max(q) FILTER (WHERE kind = 'specific') AS q_specific, max(q) FILTER (WHERE kind = 'specific_opp') AS q_specific_opp,
  max(q) FILTER (WHERE kind = 'specific_raw') AS q_specific_raw, max(q) FILTER (WHERE kind = 'specific_raw_opp') AS q_specific_raw_opp
  FROM lg JOIN qv USING (kind, p) GROUP BY link),
mn AS (SELECT link, lineage, sum(effect) / count(*)::DOUBLE AS m FROM td GROUP BY ALL),
sg AS (SELECT link, count(*) FILTER (WHERE m > 0) AS k, count(*) FILTER (WHERE m <> 0) AS n, quantile_cont(m, 0.5) FILTER (WHERE lineage % 2 = 0) AS half0,
  quantile_cont(m, 0.5) FILTER (WHERE lineage % 2 = 1) AS half1 FROM mn GROUP BY link),
sp AS (SELECT *, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) AS p_sign FROM sg),
fv AS (SELECT sp.link, half0, half1, q_effect IS NOT NULL AS tested, coalesce(q_effect < {LEVEL} AND p_sign < {LEVEL} AND half0 > 0 AND half1 > 0, false) AS own,
  coalesce(q_opposite < {LEVEL} AND half0 < 0 AND half1 < 0, false) AS opp, coalesce(q_specific < {LEVEL} AND q_specific_raw < {LEVEL}, false) AS spec,
  coalesce(q_specific_opp < {LEVEL} AND q_specific_raw_opp < {LEVEL}, false) AS spec_opp, q_effect, q_specific FROM sp LEFT JOIN qs USING (link))
SELECT link, round(half0, 4) AS half0, round(half1, 4) AS half1, round(q_effect, 6) AS q_effect, round(q_specific, 6) AS q_specific,
  CASE WHEN NOT tested THEN 'nt' WHEN own AND spec THEN 'knows' WHEN own THEN 'not specific' WHEN opp AND spec_opp THEN 'opposite'
  WHEN opp THEN 'not specific (opposite)' ELSE 'none' END AS verdict FROM fv"""


@query(VERDICT)
def link_verdicts(spark, folder):
    """The decision table over calibrated tests of the effect, of its excess over other rows, and of that in raw units."""
    rows = tested(spark, folder)
    effect, spec, raw = (cut_lineage(one_test(rows, name)) for name in ("effect", "spec", "raw"))
    tail = X.upper_tail(F.col("z"))
    names = lambda df, up, down: df.select("link", up.alias("_up"), down.alias("_down"))
    parts = [
        ("effect", "opposite", names(effect.where("p_up is not null"), F.col("p_up"), F.col("p_down"))),
        ("specific", "specific_opp", names(spec, F.col("p_up"), F.col("p_down"))),
        ("specific_raw", "specific_raw_opp", names(raw, F.greatest("p_up", tail), F.greatest("p_down", 1 - tail))),
    ]
    known = effect.where("p_up is not null").select("link")
    long = None
    for up, down, frame in parts:
        both = frame.join(known, "link", "left_semi").select("link", F.explode(F.create_map(F.lit(up), "_up", F.lit(down), "_down")).alias("kind", "p"))
        long = both if long is None else long.unionByName(both)
    long = cut_lineage(long.where("p is not null").withColumn("p", F.round("p", 9)))
    adjusted = X.benjamini_hochberg(long, "p", ["kind"])
    q = long.join(adjusted, ["kind", "p"]).groupBy("link").pivot("kind", [x for p in parts for x in p[:2]]).agg(F.max("q"))
    q = q.select("link", *[F.col(x).alias(f"q_{x}") for p in parts for x in p[:2]])
    means = cut_lineage(rows.groupBy("link", "lineage").agg((F.sum("effect") / F.count(F.lit(1))).alias("m")))
    side = lambda h: F.percentile(F.when(F.pmod(F.col("lineage").cast("int"), F.lit(2)) == h, F.col("m")), F.lit(0.5))
    halves = means.groupBy("link").agg(
        F.count_if(F.col("m") > 0).alias("positive"), F.count_if(F.col("m") != 0).alias("n"), side(0).alias("half0"), side(1).alias("half1"))
    table = halves.withColumn("p_sign", X.sign_test_p("positive", "n")).join(q, "link", "left").withColumn("tested", F.col("q_effect").isNotNull())
    out = table.select("link", "half0", "half1", "q_effect", "q_specific", X.verdict(LEVEL).alias("verdict"))
    for c, d in (("half0", 4), ("half1", 4), ("q_effect", 6), ("q_specific", 6)):
        out = out.withColumn(c, F.round(c, d))
    return out


@query(
    f"""WITH {RUNS}, rp AS (SELECT u.unit AS pass, e.start - u."end" AS dist, u.delta * ev.value / 100 AS delta
  FROM un u JOIN el e ON e.genome = u.genome AND e.start > u."end" AND e.start <= u."end" + 60 JOIN ev ON ev.genome = u.genome AND ev.pos = e.start),
mt AS (SELECT a.pass, a.dist, a.delta, b.delta AS v, abs(b.dist - a.dist) <= 0.35 * a.dist AS near FROM rp a JOIN rp b
  ON b.pass = a.pass AND b.dist <> a.dist AND abs(b.dist - a.dist) <= 0.6 * a.dist),
nn AS (SELECT *, count(*) FILTER (WHERE near) OVER (PARTITION BY pass, dist) AS k FROM mt),
rf AS (SELECT * FROM nn WHERE near OR k < 3),
md AS (SELECT pass, dist, any_value(delta) AS delta, quantile_cont(v, 0.5) AS med, count(*) AS n_ref FROM rf GROUP BY ALL HAVING count(*) >= 3),
sd AS (SELECT pass, dist, quantile_cont(abs(v - med), 0.5) AS mad FROM rf JOIN md USING (pass, dist) GROUP BY ALL)
SELECT pass, dist, round(delta - med + 1e-9, 6) AS excess, round((delta - med) / greatest(1.4826 * mad, 1e-5), 5) AS z, n_ref FROM md JOIN sd USING (pass, dist)"""
)
def specificity(spark, folder):
    """Each run entered within 60 genes behind a deletion against the others entered at a comparable distance."""
    genes = _genes(spark, folder)
    found = _units(spark, folder, genes)[0]
    entries = found.select("genome", F.col("start").alias("entry"))
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / 64), F.floor(high / 64)))
    wanted = found.select("genome", "unit", "end", "delta").withColumn("_bin", bins(F.col("end") + 1, F.col("end") + 60))
    met = wanted.join(entries.withColumn("_bin", F.floor(F.col("entry") / 64)), ["genome", "_bin"]).where(F.col("entry").between(F.col("end") + 1, F.col("end") + 60))
    values = genes.select("genome", F.col("pos").alias("entry"), "value")
    reads = met.join(values, ["genome", "entry"]).select(
        F.col("unit").alias("pass"), (F.col("entry") - F.col("end")).alias("dist"), (F.col("delta") * F.col("value") / 100).alias("delta"))
    out = L.specificity(cut_lineage(reads), 60)
    return out.withColumn("excess", F.round(F.col("excess") + 1e-9, 6)).withColumn("z", F.round("z", 5))
