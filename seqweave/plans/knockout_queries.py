"""Matched-control, calibration and decision queries.

An element is a maximal plastic run; deleting it is read at the gene ten places
after its end, and its effect is the mean value of its genes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import matching as M
from seqweave.operators import stats as X
from seqweave.operators import tiling as T
from seqweave.plans import corpus as C
from seqweave.session import cut_lineage
from seqweave.sources.tables import typed

#: More than the positions of any genome, so that genome and start make one number.
POSITIONS = 2**32

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


RUNS = C.EV + """,
fl AS (SELECT *, CASE WHEN in_rgp AND coalesce(lag(in_rgp) OVER (PARTITION BY genome ORDER BY pos), false) THEN 0 ELSE 1 END AS st FROM ev),
rn AS (SELECT *, sum(st) OVER (PARTITION BY genome ORDER BY pos) AS run FROM fl),
el AS (SELECT genome, min(pos) AS start, max(pos) AS "end", count(*) AS size, round(avg(value), 6) AS delta,
  arg_min(name, pos) AS link FROM rn WHERE in_rgp GROUP BY genome, run),
un AS (SELECT *, genome * 4294967296 + start AS unit, 10 AS dist, "end" + 10 AS "row" FROM el),
pool AS (SELECT genome, genome * 4294967296 + start AS control, start AS c_start, "end" AS c_end, size AS c_size, delta AS c_delta FROM el)"""

MATCH = RUNS + """,
met AS (SELECT unit, control, c_delta, u.delta,
  c_size >= 0.5 * size AND c_size <= 2 * size AND abs("row" - c_end - dist) <= 0.35 * dist AS t1,
  c_size >= (1.0::DOUBLE / 3) * size AND c_size <= 3 * size AND abs("row" - c_end - dist) <= 0.6 * dist AS t2,
  c_size >= (1.0::DOUBLE / 3) * size AND c_size <= 3 * size AND abs(ln(greatest("row" - c_end, 1) / dist::DOUBLE)) <= ln(4) AS t3
  FROM un u JOIN pool p ON p.genome = u.genome AND (c_start > u."end" OR c_end < u.start) AND c_end < "row"),
ti AS (SELECT unit, CASE WHEN count(*) FILTER (WHERE t1) >= 3 THEN 1 WHEN count(*) FILTER (WHERE t2) >= 3 THEN 2 ELSE 3 END AS tier
  FROM met GROUP BY 1),
ct AS (SELECT met.*, tier FROM met JOIN ti USING (unit) WHERE CASE tier WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END),
md AS (SELECT unit, quantile_cont(c_delta, 0.5) AS med, count(*) AS n FROM ct GROUP BY 1),
sc AS (SELECT ct.unit, any_value(n) AS n_ctrl,
  CASE WHEN any_value(n) >= 3 THEN (any_value(delta) - any_value(med)) / greatest(1.4826 * quantile_cont(abs(c_delta - med), 0.5), 1e-6) END AS z,
  avg(CASE WHEN c_delta < delta THEN 1.0::DOUBLE WHEN c_delta = delta THEN 0.5 ELSE 0 END) AS rank_pct
  FROM ct JOIN md USING (unit) GROUP BY 1)"""


def elements(spark, folder, genes=None):
    """genome, start, end, size, delta and the class of the first gene, one row per plastic run."""
    rows = T.islands(
        C.genes(spark, folder) if genes is None else genes,
        ["genome"],
        lambda w: ~(F.col("in_rgp") & F.coalesce(F.lag("in_rgp").over(w), F.lit(False))),
        "run",
    ).where("in_rgp")
    return (
        rows.groupBy("genome", "run")
        .agg(
            F.min("pos").alias("start"),
            F.max("pos").alias("end"),
            F.count(F.lit(1)).alias("size"),
            F.round(F.avg("value"), 6).alias("delta"),
            F.min(F.struct("pos", "name"))["name"].alias("link"),
        )
        .drop("run")
    )


def _units(spark, folder):
    found = cut_lineage(elements(spark, folder)).withColumn("unit", F.col("genome") * POSITIONS + F.col("start"))
    units = found.withColumn("dist", F.lit(10)).withColumn("row", F.col("end") + 10)
    pool = found.select(
        "genome", F.col("unit").alias("control"), F.col("start").alias("c_start"),
        F.col("end").alias("c_end"), F.col("size").alias("c_size"), F.col("delta").alias("c_delta"),
    )
    return units, pool


@query(f'WITH {RUNS} SELECT genome, start, "end", size, delta, link FROM el')
def elements_found(spark, folder):
    return elements(spark, folder)


@query(f"WITH {MATCH} SELECT unit, control, c_delta, tier::BIGINT AS tier FROM ct")
def matched_controls(spark, folder):
    units, pool = _units(spark, folder)
    return M.matched_controls(units, pool, log_factor=4.0)


def _scored(spark, folder):
    units, pool = _units(spark, folder)
    controls = cut_lineage(M.matched_controls(units, pool, log_factor=4.0))
    return units, M.unit_scores(units, controls)


@query(f"WITH {MATCH} SELECT unit, n_ctrl, round(z, 5) AS z, round(rank_pct, 6) AS rank_pct FROM sc")
def robust_unit_scores(spark, folder):
    return _round(_round(_scored(spark, folder)[1], "z", digits=5), "rank_pct")


STAND = MATCH + """,
sd AS (SELECT ct.unit AS u0, ct.control AS c0, u."row", u.genome, p.c_start AS start, p.c_end AS "end", p.c_size AS size, p.c_delta AS delta,
  u."row" - p.c_end AS dist FROM ct JOIN un u USING (unit) JOIN pool p ON p.control = ct.control),
m2 AS (SELECT u0, c0, p.control, p.c_delta, u.delta,
  c_size >= 0.5 * size AND c_size <= 2 * size AND abs("row" - c_end - dist) <= 0.35 * dist AS t1,
  c_size >= (1.0::DOUBLE / 3) * size AND c_size <= 3 * size AND abs("row" - c_end - dist) <= 0.6 * dist AS t2
  FROM sd u JOIN pool p ON p.genome = u.genome AND (c_start > u."end" OR c_end < u.start) AND c_end < "row"),
g2 AS (SELECT *, count(*) FILTER (WHERE t1) OVER (PARTITION BY u0, c0) >= 3 AS narrow FROM m2),
c2 AS (SELECT * FROM g2 WHERE CASE WHEN narrow THEN t1 ELSE t2 END),
d2 AS (SELECT u0, c0, quantile_cont(c_delta, 0.5) AS med, count(*) AS n FROM c2 GROUP BY 1, 2),
ps AS (SELECT c2.u0 AS unit, c2.c0 AS control,
  (any_value(delta) - any_value(med)) / greatest(1.4826 * quantile_cont(abs(c_delta - med), 0.5), 1e-6) AS z
  FROM c2 JOIN d2 USING (u0, c0) WHERE n >= 3 GROUP BY 1, 2)"""


@query(
    f"""WITH {STAND} SELECT sc.unit, count(*) AS stand_ins,
  round((1 + count(*) FILTER (WHERE round(ps.z, 9) >= round(sc.z, 9))) / (1 + count(*))::DOUBLE, 6) AS p_cal
FROM ps JOIN sc USING (unit) WHERE sc.z IS NOT NULL GROUP BY 1"""
)
def calibrated_units(spark, folder):
    """Share of a unit's stand-ins that score at least as high as it does."""
    units, pool = _units(spark, folder)
    controls = cut_lineage(M.matched_controls(units, pool, log_factor=4.0))
    scored = M.unit_scores(units, controls).select("unit", F.col("z").alias("real")).where(F.col("real").isNotNull())
    null = M.stand_in_scores(units, controls, pool)
    high = F.count_if(F.round("z", 9) >= F.round("real", 9))
    return null.join(scored.hint("merge"), "unit").groupBy("unit").agg(
        F.count(F.lit(1)).alias("stand_ins"),
        F.round((1 + high) / (1 + F.count(F.lit(1))), 6).alias("p_cal"),
    )


LINKS = MATCH + """,
lm AS (SELECT link, genome % 24 AS lineage, round(avg(z), 9) AS x FROM sc JOIN un USING (unit) WHERE z IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT link, x, count(*) OVER (PARTITION BY link ORDER BY abs(x)) - count(*) OVER (PARTITION BY link, abs(x)) AS below,
  count(*) OVER (PARTITION BY link, abs(x)) AS t, count(*) OVER (PARTITION BY link) AS n FROM lm WHERE x <> 0),
wl AS (SELECT link, any_value(n) AS n, sum(CASE WHEN x > 0 THEN below + (t + 1) / 2.0::DOUBLE ELSE 0 END) AS w,
  sum(t * t - 1)::DOUBLE AS ties FROM rk GROUP BY 1),
zl AS (SELECT link, n, w, ties > 0 AS tied, (w - n * (n + 1) / 4.0::DOUBLE)
  / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48) AS z FROM wl)"""


def lineage_means(spark, folder):
    units, scores = _scored(spark, folder)
    return cut_lineage(
        scores.where(F.col("z").isNotNull())
        .join(units.select("unit", "link", "genome").hint("merge"), "unit")
        .groupBy("link", F.pmod("genome", F.lit(24)).alias("lineage"))
        .agg(F.round(F.avg("z"), 9).alias("x"))
    )


@query(f"WITH {LINKS} SELECT link, n, w, tied, round(z, 6) AS z FROM zl")
def signed_rank(spark, folder):
    return _round(X.signed_rank(lineage_means(spark, folder), ["link"], "x"), "z")


@query(
    f"""WITH {LINKS}, k AS (SELECT link, count(*) FILTER (WHERE x > 0) AS k, count(*) AS m FROM lm WHERE x <> 0 GROUP BY 1)
SELECT link, k AS positive, m AS n, round(list_sum(list_transform(range(k, m + 1),
  lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)))), 6) AS p FROM k"""
)
def sign_test(spark, folder):
    counts = lineage_means(spark, folder).where(F.col("x") != 0).groupBy("link").agg(
        F.count_if(F.col("x") > 0).alias("positive"), F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("p", F.round(X.sign_test_p("positive", "n"), 6))


@query(
    f"""WITH {LINKS}, m AS (SELECT link, quantile_cont(x, 0.5) AS med, count(*) AS n FROM lm GROUP BY 1)
SELECT lm.link, any_value(n) AS n, round(quantile_cont(abs(x - med), 0.5), 6) AS mad,
  round((2.3263478740408408 + 0.8416212335729143) * sqrt(pi() / 3) * 1.4826 * quantile_cont(abs(x - med), 0.5) / sqrt(any_value(n)), 6) AS mde
FROM lm JOIN m USING (link) GROUP BY 1"""
)
def detectable_shift(spark, folder):
    spread = X.median_and_mad(lineage_means(spark, folder), ["link"], "x")
    mde = X.detectable_shift(F.col("mad"), F.col("n"), tests=5)
    return _round(spread.select("link", "n", "mad", mde.alias("mde")), "mad", "mde")


@query(
    f"""WITH {STAND}, pc AS (SELECT sc.unit, round((1 + count(*) FILTER (WHERE round(ps.z, 9) >= round(sc.z, 9))) / (1 + count(*))::DOUBLE, 6) AS p
  FROM ps JOIN sc USING (unit) WHERE sc.z IS NOT NULL GROUP BY 1),
r AS (SELECT p, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM pc),
s AS (SELECT DISTINCT p, least(min(raw) OVER (ORDER BY p DESC), 1) AS q FROM r)
SELECT p, round(q, 6) AS q FROM s"""
)
def benjamini_hochberg(spark, folder):
    tests = cut_lineage(calibrated_units(spark, folder).select(F.col("p_cal").alias("p")))
    return _round(X.benjamini_hochberg(tests, "p"), "q")


PROFILE = RUNS + """,
ro AS (SELECT genome, pos, in_rgp, value - 50 AS v FROM ev),
pf AS (SELECT unit AS pass, floor((pos - "end" - 1) / 5)::BIGINT AS bin, count(*) AS n, avg(v) AS mean, avg(abs(v)) AS mean_abs,
  avg(v) FILTER (WHERE in_rgp) AS subset_mean
  FROM un JOIN ro ON ro.genome = un.genome AND pos BETWEEN "end" + 1 AND "end" + 20 GROUP BY 1, 2)"""


def _profile(spark, folder):
    units, _ = _units(spark, folder)
    readouts = C.genes(spark, folder).select("genome", "pos", "in_rgp", (F.col("value") - 50).alias("v"))
    passes = units.select("genome", F.col("unit").alias("pass"), "end")
    return M.downstream_profile(passes, readouts, 20, 5, "in_rgp")


@query(
    f"""WITH {PROFILE} SELECT pass, bin, n, round(mean, 6) AS mean, round(mean_abs, 6) AS mean_abs,
  round(subset_mean, 6) AS subset_mean FROM pf"""
)
def downstream_profile(spark, folder):
    return _round(_profile(spark, folder), "mean", "mean_abs", "subset_mean")


@query(
    f"""WITH {PROFILE}, b AS (SELECT bin, quantile_cont(mean, 0.5) AS med FROM pf GROUP BY 1),
d AS (SELECT bin, any_value(med) AS med, quantile_cont(abs(mean - med), 0.5) AS mad FROM pf JOIN b USING (bin) GROUP BY 1),
j AS (SELECT pass, bin, abs((mean - med) / greatest(1.4826 * mad, 1e-6)) > 1.5 AS beyond FROM pf JOIN d USING (bin))
SELECT pass, coalesce(max(CASE WHEN beyond THEN bin END) + 1, 0) AS radius,
  coalesce(min(CASE WHEN NOT beyond THEN bin END), 4) AS contiguous, round(avg(beyond::INT), 6) AS broad FROM j GROUP BY 1"""
)
def influence_radius(spark, folder):
    return _round(M.influence_radius(_profile(spark, folder), 4, 1.5), "broad")
