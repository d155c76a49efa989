"""Fork, predictor and association queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from seqweave.operators import association as A
from seqweave.operators import distance as D
from seqweave.operators import forks as K
from seqweave.operators import predictors as P
from seqweave.operators import sequence as S
from seqweave.operators import swaps as W
from seqweave.operators import tiling as T
from seqweave.plans import corpus as C
from seqweave.session import cut_lineage
from seqweave.sources.tables import table, typed

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


RULES = [
    # label, first copies only, top successors, least count, share, genomes and total
    ("genomes", False, None, 1, 0.0, 10, 0),
    ("balanced", False, 8, 20, 0.10, 1, 0),
    ("top8", False, 8, 1, 0.0, 10, 0),
    ("top6", False, 6, 20, 0.0, 1, 0),
    ("first_copy", True, 8, 1, 0.15, 1, 150),
    ("share5", False, None, 1, 0.05, 1, 0),
    ("share17", False, None, 1, 0.17, 1, 0),
    ("count20", False, None, 20, 0.0, 1, 0),
]


def _rule_sql():
    parts = []
    for label, first, top, n, share, genomes, total in RULES:
        parts.append(
            f"""SELECT '{label}' AS rule, fork, branch, n FROM (SELECT *, count(*) OVER (PARTITION BY fork) AS k FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fork ORDER BY n DESC, branch) AS r
    FROM {'sf1' if first else 'sa'}) WHERE r <= {top or 10**9} AND n >= {n} AND n >= {share} * total
    AND genomes >= {genomes} AND total >= {total})) WHERE k >= 2"""
        )
    return " UNION ALL ".join(parts)


FORKS = f"""{C.OG},
nx AS (SELECT genome, pos, name AS fork, lead(name) OVER (PARTITION BY genome ORDER BY pos) AS branch FROM og),
fc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY genome, fork ORDER BY pos) AS r FROM nx
  WHERE branch IS NOT NULL) WHERE r = 1),
sa AS (SELECT fork, branch, count(*) AS n, count(DISTINCT genome) AS genomes,
  sum(count(*)) OVER (PARTITION BY fork) AS total FROM nx WHERE branch IS NOT NULL GROUP BY 1, 2),
sf1 AS (SELECT fork, branch, count(*) AS n, count(DISTINCT genome) AS genomes,
  sum(count(*)) OVER (PARTITION BY fork) AS total FROM fc GROUP BY 1, 2)"""


@query(f"WITH {FORKS} {_rule_sql()}")
def fork_rules(spark, folder):
    """All the fork rules over one adjacency count."""
    rows = C.order_genes(spark, folder).drop("family").withColumnRenamed("name", "family")
    rows = cut_lineage(rows)
    stats = {first: cut_lineage(K.successor_stats(rows, first)) for first in (False, True)}
    out = [
        K.fork_branches(stats[first], top, n, share, genomes, total).withColumn("rule", F.lit(label))
        for label, first, top, n, share, genomes, total in RULES
    ]
    return reduce(lambda a, b: a.unionByName(b), out)


SITES = C.EV + """,
pt AS (SELECT genome, pos, name, allele, length, in_rgp,
  lag(name) OVER w AS fork, lag(allele) OVER w AS prev_allele,
  list(name) OVER (PARTITION BY genome ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS u2,
  list(name) OVER (PARTITION BY genome ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS u3,
  list(name) OVER (PARTITION BY genome ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS u5
  FROM ev WINDOW w AS (PARTITION BY genome ORDER BY pos)),
sites AS (SELECT genome, pos, genome % 2 AS half, fork, name AS branch, prev_allele, in_rgp, array_to_string(u2, '>') AS path_2,
  array_to_string(u3, '>') AS path_3, array_to_string(u5, '>') AS path_5 FROM pt WHERE pos >= 5),
fr AS (SELECT *, (count(*) OVER (PARTITION BY fork, branch) - count(*) OVER (PARTITION BY fork, genome, branch) + 0.5::DOUBLE)
  / (count(*) OVER (PARTITION BY fork) - count(*) OVER (PARTITION BY fork, genome) + 0.5 * 5) AS freq FROM sites)"""


def _lo(path):
    return (
        f"count(*) OVER (PARTITION BY fork, {path}, branch) - count(*) OVER (PARTITION BY fork, {path}, genome, branch)",
        f"count(*) OVER (PARTITION BY fork, {path}) - count(*) OVER (PARTITION BY fork, {path}, genome)",
    )


def sites(spark, folder):
    """One row per gene at a fork of the class sequence, with the paths before it."""
    rows = C.genes(spark, folder).drop("family").withColumnRenamed("name", "family")
    base = S.upstream_paths(rows, [2, 3, 5])
    both = T.over_tiles(
        base, ["genome"],
        lambda w: {"fork": F.lag("family").over(w), "prev_allele": F.lag("allele").over(w)},
        before=1,
    )
    found = both.where(F.col("pos") >= 5).select(
        "genome", "pos", F.pmod("genome", F.lit(2)).alias("half"), "fork",
        F.col("family").alias("branch"), "prev_allele", "in_rgp", "path_2", "path_3", "path_5",
    )
    return cut_lineage(found)


@query(f"WITH {SITES} SELECT fork, genome, branch, count(*) AS n, round(any_value(freq), 6) AS freq FROM fr GROUP BY 1, 2, 3")
def leave_one_out_frequency(spark, folder):
    return _round(P.leave_one_out_frequency(sites(spark, folder)), "freq")


@query(
    f"""WITH {SITES}, q AS (SELECT fork, genome, branch, path_3, freq, {_lo('path_3')[0]} AS same, {_lo('path_3')[1]} AS others FROM fr)
SELECT fork, path_3, genome, branch, count(*) AS n, any_value(same)::BIGINT AS same, any_value(others)::BIGINT AS others,
  round(any_value((same + freq) / (others + 1)), 6) AS q FROM q GROUP BY 1, 2, 3, 4"""
)
def path_predictor(spark, folder):
    rows = sites(spark, folder)
    out = P.path_predictor(rows, "path_3", P.leave_one_out_frequency(rows))
    return _round(out.drop("freq"), "q")


BACKOFF = f"""q AS (SELECT *, {_lo('path_5')[0]} AS s5, {_lo('path_5')[1]} AS o5, {_lo('path_3')[0]} AS s3, {_lo('path_3')[1]} AS o3,
  {_lo('path_2')[0]} AS s2, {_lo('path_2')[1]} AS o2 FROM fr),
bk AS (SELECT *, CASE WHEN o5 >= 3 THEN s5 WHEN o3 >= 3 THEN s3 WHEN o2 >= 3 THEN s2 ELSE 0 END AS same,
  CASE WHEN o5 >= 3 THEN o5 WHEN o3 >= 3 THEN o3 WHEN o2 >= 3 THEN o2 ELSE 0 END AS others FROM q)"""


@query(
    f"""WITH {SITES}, {BACKOFF}
SELECT fork, genome, branch, path_5, path_3, path_2, count(*) AS sites, any_value(same)::BIGINT AS same,
  any_value(others)::BIGINT AS others FROM bk GROUP BY 1, 2, 3, 4, 5, 6"""
)
def backoff_predictor(spark, folder):
    return P.backoff_counts(sites(spark, folder), ["path_5", "path_3", "path_2"])


GRID = [0.25, 0.5, 1, 2, 4, 8, 16, 32]


@query(
    f"""WITH {SITES}, {BACKOFF},
gr(a) AS (VALUES (0.25::DOUBLE), (0.5), (1), (2), (4), (8), (16), (32)),
co AS (SELECT half, a, sum(-log2((same + a * freq) / (others + a))) AS bits, count(*) AS sites FROM bk, gr GROUP BY 1, 2),
ft AS (SELECT half, a FROM (SELECT *, row_number() OVER (PARTITION BY half ORDER BY round(bits, 6), a) AS r FROM co) WHERE r = 1)
SELECT co.half, co.a::DOUBLE AS a, round(bits / sites, 6) AS bits, sites FROM co JOIN ft ON ft.half = 1 - co.half AND ft.a = co.a"""
)
def fitted_smoothing(spark, folder):
    rows = sites(spark, folder)
    counts = P.backoff_counts(rows, ["path_5", "path_3", "path_2"])
    freq = P.leave_one_out_frequency(rows).drop("n")
    scored = counts.join(freq, ["fork", "genome", "branch"]).withColumn("half", F.pmod("genome", F.lit(2)))
    return _round(P.fit_smoothing(scored.withColumnRenamed("sites", "n"), GRID), "bits")


@query(
    f"""WITH {SITES},
q AS (SELECT *, ({_lo('path_2')[0]} + freq) / ({_lo('path_2')[1]} + 1) AS q2, ({_lo('path_3')[0]} + freq) / ({_lo('path_3')[1]} + 1) AS q3,
  ({_lo('prev_allele')[0]} + freq) / ({_lo('prev_allele')[1]} + 1) AS qa FROM fr),
b AS (SELECT fork, half, 'frequency' AS method, -log2(freq) AS bits FROM q UNION ALL SELECT fork, half, 'path-2', -log2(q2) FROM q
  UNION ALL SELECT fork, half, 'path-3', -log2(q3) FROM q UNION ALL SELECT fork, half, 'allele', -log2(qa) FROM q)
SELECT method, fork, half, round(avg(bits), 6) AS bits, count(*) AS sites FROM b GROUP BY GROUPING SETS ((method, fork, half), (method))"""
)
def bits_per_site(spark, folder):
    """Log loss of each predictor per fork and half, and pooled over sites."""
    return _round(_bits(spark, folder), "bits")


def _bits(spark, folder):
    rows = sites(spark, folder)
    freq = P.leave_one_out_frequency(rows)
    cols = ["fork", "genome", "n", "q", "method"]
    out = freq.withColumn("q", F.col("freq")).withColumn("method", F.lit("frequency")).select(*cols)
    for path, label in (("path_2", "path-2"), ("path_3", "path-3"), ("prev_allele", "allele")):
        out = out.unionByName(P.path_predictor(rows, path, freq).withColumn("method", F.lit(label)).select(*cols))
    out = out.withColumn("half", F.pmod("genome", F.lit(2)))
    grouped = out.groupingSets([["method", "fork", "half"], ["method"]], "method", "fork", "half")
    return grouped.agg(
        (F.sum(F.col("n") * -F.log2("q")) / F.sum("n")).alias("bits"), F.sum("n").alias("sites")
    )


@query(
    ORACLES["bits_per_site"].replace("SELECT method, fork, half, round(avg(bits), 6) AS bits, count(*) AS sites FROM b GROUP BY GROUPING SETS ((method, fork, half), (method))",
    """SELECT fork, bool_and(al < base) AS contingent FROM (SELECT fork, half,
  avg(CASE WHEN method = 'allele' THEN bits END) AS al,
  least(avg(CASE WHEN method = 'frequency' THEN bits END), avg(CASE WHEN method = 'path-2' THEN bits END),
    avg(CASE WHEN method = 'path-3' THEN bits END)) AS base FROM b GROUP BY 1, 2) GROUP BY 1""")
)
def contingent_forks(spark, folder):
    """Forks where the allele predictor beats every other one in both halves."""
    bits = _bits(spark, folder).where(F.col("fork").isNotNull())
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("bits")))
    halves = bits.groupBy("fork", "half").agg(
        (pick("allele") < F.least(pick("frequency"), pick("path-2"), pick("path-3"))).alias("ok")
    )
    return halves.groupBy("fork").agg(F.bool_and("ok").alias("contingent"))


PRES = C.EV + """,
held AS (SELECT DISTINCT genome, family, genome % 6 AS stratum FROM ev),
fq AS (SELECT family, count(*) AS genomes, count(*) / (SELECT count(DISTINCT genome) FROM ev)::DOUBLE AS freq FROM held GROUP BY 1),
band AS (SELECT * FROM fq WHERE freq BETWEEN 0.1 AND 0.9),
pr AS (SELECT held.* FROM held JOIN band USING (family)),
sz AS (SELECT stratum, count(DISTINCT genome) AS n FROM pr GROUP BY 1 HAVING count(DISTINCT genome) >= 2),
mg AS (SELECT stratum, family, count(*) AS held, any_value(n) AS n FROM pr JOIN sz USING (stratum) GROUP BY 1, 2)"""

CMH = PRES + """,
pairs AS (SELECT x.family AS a, y.family AS b, x.stratum, x.held AS ra, y.held AS rb, x.n::DOUBLE AS n
  FROM mg x JOIN mg y ON y.stratum = x.stratum AND x.family < y.family),
ob AS (SELECT x.stratum, x.family AS a, y.family AS b, count(*) AS k FROM pr x JOIN pr y
  ON y.genome = x.genome AND x.family < y.family GROUP BY 1, 2, 3),
z AS (SELECT p.a, p.b, sum(coalesce(k, 0))::DOUBLE AS "both",
  round((sum(coalesce(k, 0)) - sum(ra * rb / n)) / sqrt(greatest(sum(ra * (n - ra) * rb * (n - rb) / (n * n * (n - 1))), 1e-9)), 9) AS z,
  sum(ra * (n - ra) * rb * (n - rb) / (n * n * (n - 1))) AS var
  FROM pairs p LEFT JOIN ob USING (a, b, stratum) GROUP BY 1, 2)"""


def presence(spark, folder):
    rows = C.genes(spark, folder)
    held = rows.select("genome", "family", F.pmod("genome", F.lit(6)).alias("stratum")).distinct()
    return cut_lineage(held.join(A.frequency_band(held).select("family"), "family"))


@query(f"WITH {PRES} SELECT family, genomes, round(freq, 6) AS freq FROM band")
def frequency_band(spark, folder):
    return _round(A.frequency_band(C.genes(spark, folder)), "freq")


@query(f'WITH {CMH} SELECT a, b, "both", round(z, 6) AS z, round(var, 6) AS var FROM z')
def cmh_matrix(spark, folder):
    held = presence(spark, folder)
    return _round(A.cmh_matrix(held, A.strata_margins(held)), "z", "var")


PERM = """pm0 AS (SELECT d.draw, stratum, genome, md5('perm|' || d.draw || '|' || genome) AS h
  FROM (SELECT DISTINCT stratum, genome FROM pr), (SELECT unnest(range(0, 2)) AS draw) d),
pm1 AS (SELECT *, row_number() OVER (PARTITION BY draw, stratum ORDER BY genome) AS ru,
  row_number() OVER (PARTITION BY draw, stratum ORDER BY h, genome) AS rh FROM pm0),
pm AS (SELECT x.draw, x.stratum, x.genome, y.genome AS other FROM pm1 x JOIN pm1 y
  ON y.draw = x.draw AND y.stratum = x.stratum AND y.rh = x.ru),
nob AS (SELECT pm.draw, x.stratum, x.family AS a, y.family AS b, count(*) AS k FROM pm JOIN pr x ON x.genome = pm.genome
  JOIN pr y ON y.genome = pm.other WHERE x.family < y.family GROUP BY 1, 2, 3, 4),
nz AS (SELECT d.draw, p.a, p.b, round((sum(coalesce(k, 0)) - sum(ra * rb / n))
  / sqrt(greatest(sum(ra * (n - ra) * rb * (n - rb) / (n * n * (n - 1))), 1e-9)), 9) AS z
  FROM pairs p CROSS JOIN (SELECT unnest(range(0, 2)) AS draw) d
  LEFT JOIN nob o ON o.draw = d.draw AND o.a = p.a AND o.b = p.b AND o.stratum = p.stratum GROUP BY 1, 2, 3)"""


def _null(held, margins, draws=2):
    relabel = A.permute_within(held, ["stratum"], "genome", draws)
    permuted = relabel.join(
        held.select("stratum", F.col("genome").alias("other"), "family"), ["stratum", "other"]
    ).select("draw", "stratum", "genome", "family")
    return A.cmh_matrix(held, margins, permuted, draws)


@query(f"WITH {CMH}, {PERM} SELECT draw::BIGINT AS draw, a, b, round(z, 6) AS z FROM nz")
def cmh_null(spark, folder):
    held = presence(spark, folder)
    null = _null(held, A.strata_margins(held))
    return _round(null.select("draw", "a", "b", "z"), "z")


@query(
    f"""WITH {CMH}, {PERM},
th AS (SELECT quantile_cont(abs(z), 0.99) AS t FROM nz), tl AS (SELECT avg((abs(z) > t)::INT) AS tail FROM nz, th)
SELECT CASE WHEN var <= 3 THEN 'low' WHEN "both" < 80 THEN 'some' ELSE 'many' END AS band, count(*) AS pairs,
  round(avg((abs(z) > t)::INT), 6) AS beyond, round(any_value(tail), 6) AS expected,
  round(avg((abs(z) > t)::INT) / greatest(any_value(tail), 1e-12), 4) AS ratio FROM z, th, tl GROUP BY 1"""
)
def null_bands(spark, folder):
    """Share of pairs beyond the null's 99th percentile, per band, against the null itself."""
    held = presence(spark, folder)
    margins = A.strata_margins(held)
    null = cut_lineage(_null(held, margins).select(F.abs("z").alias("z")))
    bounds = T.value_bounds(null, "z")
    threshold = T.grouped_quantile(null, [], "z", 0.99, "t", bounds)
    t = threshold.scalar()
    tail = null.agg(F.avg((F.col("z") > t).cast("double"))).scalar()
    band = F.when(F.col("var") <= 3, "low").when(F.col("both") < 80, "some").otherwise("many")
    out = A.banded_table(A.cmh_matrix(held, margins), band, t, tail)
    return _round(_round(out, "beyond", "expected"), "ratio", digits=4)


@query(
    f"""WITH {CMH.replace("FROM mg x JOIN mg y ON", "FROM mg x JOIN mg y ON")},
za AS (SELECT p.a, p.b, stratum % 2 AS half, round((sum(coalesce(k, 0)) - sum(ra * rb / n))
  / sqrt(greatest(sum(ra * (n - ra) * rb * (n - rb) / (n * n * (n - 1))), 1e-9)), 9) AS z
  FROM pairs p LEFT JOIN ob USING (a, b, stratum) GROUP BY 1, 2, 3)
SELECT x.a, x.b, round(x.z, 6) AS z_a, round(y.z, 6) AS z_b, sign(x.z) = sign(y.z) AND abs(x.z) > 1 AND abs(y.z) > 1 AS replicated
FROM za x JOIN za y ON y.a = x.a AND y.b = x.b WHERE x.half = 0 AND y.half = 1"""
)
def replication(spark, folder):
    """Z in two disjoint sets of strata, and whether the sign and size hold in both."""
    held = presence(spark, folder)
    halves = []
    for half, name in ((0, "z_a"), (1, "z_b")):
        part = held.where(F.pmod("stratum", F.lit(2)) == half)
        halves.append(A.cmh_matrix(part, A.strata_margins(part)).select("a", "b", F.col("z").alias(name)))
    both = halves[0].join(halves[1], ["a", "b"])
    za, zb = F.col("z_a"), F.col("z_b")
    ok = (F.signum(za) == F.signum(zb)) & (F.abs(za) > 1) & (F.abs(zb) > 1)
    return _round(both.withColumn("replicated", ok), "z_a", "z_b")


@query(
    f"""WITH {C.EV},
h AS (SELECT DISTINCT genome, family, genome % 6 AS lineage FROM ev),
c AS (SELECT lineage, genome, count(*) AS content FROM h GROUP BY 1, 2),
q AS (SELECT lineage, quantile_cont(content, 1/3) AS q1, quantile_cont(content, 2/3) AS q2 FROM c GROUP BY 1)
SELECT genome, lineage, content, ((content >= q1)::INT + (content >= q2)::INT)::BIGINT AS tertile FROM c JOIN q USING (lineage)"""
)
def content_tertiles(spark, folder):
    rows = C.genes(spark, folder).select("genome", "family", F.pmod("genome", F.lit(6)).alias("lineage")).distinct()
    return A.content_tertiles(rows)


@query(
    f"""WITH {C.EV}, h AS (SELECT DISTINCT genome, family FROM ev), n AS (SELECT family, count(*) AS n FROM h GROUP BY 1),
g AS (SELECT count(DISTINCT genome)::DOUBLE AS g FROM ev),
o AS (SELECT x.family AS a, y.family AS b, count(*)::DOUBLE AS s FROM h x JOIN h y ON y.genome = x.genome AND x.family < y.family GROUP BY 1, 2)
SELECT a, b, s AS "both", round(1 - s / (na.n + nb.n - s), 6) AS jaccard,
  round(CASE WHEN na.n < g AND nb.n < g THEN (g * s - na.n * nb.n) / sqrt(na.n * (g - na.n) * nb.n * (g - nb.n)) END, 6) AS phi
FROM o JOIN n na ON na.family = a JOIN n nb ON nb.family = b, g"""
)
def presence_similarity(spark, folder):
    return _round(A.presence_similarity(C.genes(spark, folder)), "jaccard", "phi")


LOCI = """lc AS (SELECT genome, family AS locus, min(allele) AS allele FROM ev GROUP BY 1, 2 HAVING count(*) = 1),
dist AS (SELECT x.genome AS g1, y.genome AS g2, count(*)::DOUBLE AS typed, avg((x.allele <> y.allele)::INT) AS d
  FROM lc x JOIN lc y ON y.locus = x.locus AND x.genome < y.genome GROUP BY 1, 2)"""


def loci(rows):
    """Families held once by a genome, with their allele."""
    single = rows.groupBy("genome", F.col("family").alias("locus")).agg(
        F.count(F.lit(1)).alias("n"), F.min("allele").alias("allele")
    )
    return cut_lineage(single.where(F.col("n") == 1).drop("n"))


@query(f"WITH {C.EV}, {LOCI} SELECT g1, g2, typed, round(d, 6) AS d FROM dist")
def allele_distance(spark, folder):
    return _round(D.allele_distance(loci(C.genes(spark, folder))), "d")


MH_SQL = """u AS (SELECT d.doc_id AS unit, lang || '|' || source AS stratum, (n_chars > 1000)::INT AS exposed, quality AS outcome
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT stratum, count(*) FILTER (WHERE exposed = 1 AND outcome = 1)::DOUBLE AS a,
  count(*) FILTER (WHERE exposed = 1 AND outcome = 0)::DOUBLE AS b, count(*) FILTER (WHERE exposed = 0 AND outcome = 1)::DOUBLE AS c,
  count(*) FILTER (WHERE exposed = 0 AND outcome = 0)::DOUBLE AS d FROM u GROUP BY 1),
i AS (SELECT *, a + b AS x, c + d AS y FROM t WHERE a + b > 0 AND c + d > 0)"""


def _units(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("unit"),
        F.concat_ws("|", "lang", "source").alias("stratum"),
        (F.col("n_chars") > 1000).cast("int").alias("exposed"),
        F.col("quality").alias("outcome"),
    )


@query(
    f"""WITH {MH_SQL} SELECT count(*) AS strata, round(sum(a * d / (x + y)) / greatest(sum(b * c / (x + y)), 1e-9), 6) AS odds_ratio,
  round(sum(x * y / (x + y) * (a / x - c / y)) / sum(x * y / (x + y)), 6) AS gap FROM i"""
)
def mantel_haenszel(spark, folder):
    cells = _units(spark, folder).groupBy("stratum", "exposed", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return _round(A.mantel_haenszel(cells), "odds_ratio", "gap")


@query(
    f"""WITH {MH_SQL},
p0 AS (SELECT draw, stratum, unit, exposed, outcome, md5('mh|' || draw || '|' || unit) AS h
  FROM u, (SELECT unnest(range(0, 20)) AS draw)),
p1 AS (SELECT *, row_number() OVER (PARTITION BY draw, stratum ORDER BY unit) AS ru,
  row_number() OVER (PARTITION BY draw, stratum ORDER BY h, unit) AS rh FROM p0),
p2 AS (SELECT x.draw, x.stratum, y.exposed, x.outcome FROM p1 x JOIN p1 y ON y.draw = x.draw AND y.stratum = x.stratum AND y.rh = x.ru),
pt AS (SELECT draw, stratum, count(*) FILTER (WHERE exposed = 1 AND outcome = 1)::DOUBLE AS a,
  count(*) FILTER (WHERE exposed = 1 AND outcome = 0)::DOUBLE AS b, count(*) FILTER (WHERE exposed = 0 AND outcome = 1)::DOUBLE AS c,
  count(*) FILTER (WHERE exposed = 0 AND outcome = 0)::DOUBLE AS d FROM p2 GROUP BY 1, 2),
pg AS (SELECT draw, sum(x * y / (x + y) * (a / x - c / y)) / sum(x * y / (x + y)) AS gap
  FROM (SELECT *, a + b AS x, c + d AS y FROM pt WHERE a + b > 0 AND c + d > 0) GROUP BY 1),
ob AS (SELECT sum(x * y / (x + y) * (a / x - c / y)) / sum(x * y / (x + y)) AS observed FROM i)
SELECT round(observed, 6) AS observed, round(avg(gap), 6) AS null_mean, round(stddev_pop(gap), 6) AS null_sd,
  round((1 + count(*) FILTER (WHERE round(gap, 12) >= round(observed, 12))) / (1 + count(*))::DOUBLE, 6) AS p FROM pg, ob GROUP BY observed"""
)
def permutation_test(spark, folder):
    return _round(A.permutation_test(_units(spark, folder), 20), "observed", "null_mean", "null_sd", "p")


AGREE = """st AS (SELECT genome, fork || '|' || path_2 AS stratum, prev_allele % 10 AS allele, branch FROM sites),
pw AS (SELECT x.stratum, (x.allele = y.allele)::INT AS exposed, (x.branch = y.branch)::INT AS outcome
  FROM st x JOIN st y ON y.stratum = x.stratum AND x.genome < y.genome),
t AS (SELECT stratum, count(*) FILTER (WHERE exposed = 1 AND outcome = 1)::DOUBLE AS a,
  count(*) FILTER (WHERE exposed = 1 AND outcome = 0)::DOUBLE AS b, count(*) FILTER (WHERE exposed = 0 AND outcome = 1)::DOUBLE AS c,
  count(*) FILTER (WHERE exposed = 0 AND outcome = 0)::DOUBLE AS d FROM pw GROUP BY 1),
i AS (SELECT *, a + b AS x, c + d AS y FROM t WHERE a + b > 0 AND c + d > 0)"""


def _agreement(spark, folder):
    rows = sites(spark, folder).select(
        "genome", F.concat_ws("|", "fork", "path_2").alias("stratum"),
        (F.col("prev_allele") % 10).alias("allele"), "branch",
    )
    return A.pair_agreement(rows)


@query(
    f"""WITH {SITES}, {AGREE}, l AS (SELECT stratum, 1 AS exposed, 1 AS outcome, a AS n FROM t UNION ALL SELECT stratum, 1, 0, b FROM t
  UNION ALL SELECT stratum, 0, 1, c FROM t UNION ALL SELECT stratum, 0, 0, d FROM t)
SELECT stratum, exposed::BIGINT AS exposed, outcome::BIGINT AS outcome, n FROM l"""
)
def pair_agreement(spark, folder):
    return _agreement(spark, folder)


@query(
    f"""WITH {SITES}, {AGREE} SELECT count(*) AS strata, round(sum(a * d / (x + y)) / greatest(sum(b * c / (x + y)), 1e-9), 6) AS odds_ratio,
  round(sum(x * y / (x + y) * (a / x - c / y)) / sum(x * y / (x + y)), 6) AS gap FROM i"""
)
def path_agreement_odds(spark, folder):
    """Same upstream allele against same branch, over pairs sharing the exact path."""
    return _round(A.mantel_haenszel(_agreement(spark, folder)), "odds_ratio", "gap")


@query(
    f"""WITH {SITES}, {LOCI},
near AS (SELECT g1 AS genome, g2 AS other, d FROM dist UNION ALL SELECT g2, g1, d FROM dist),
fg AS (SELECT DISTINCT fork, genome FROM sites),
nn AS (SELECT f.fork, f.genome, other FROM fg f JOIN near n ON n.genome = f.genome JOIN fg o ON o.fork = f.fork AND o.genome = n.other
  QUALIFY row_number() OVER (PARTITION BY f.fork, f.genome ORDER BY d, other) <= 15),
cn AS (SELECT nn.fork, nn.genome, s.branch, count(*) AS c FROM nn JOIN sites s ON s.fork = nn.fork AND s.genome = nn.other GROUP BY 1, 2, 3),
tt AS (SELECT fork, genome, sum(c) AS k FROM cn GROUP BY 1, 2)
SELECT f.fork, f.genome, f.branch, count(*) AS n, coalesce(any_value(c), 0) AS same, any_value(k)::BIGINT AS others,
  round((coalesce(any_value(c), 0) + any_value(freq)) / (any_value(k) + 1), 6) AS q
FROM fr f JOIN tt ON tt.fork = f.fork AND tt.genome = f.genome
LEFT JOIN cn ON cn.fork = f.fork AND cn.genome = f.genome AND cn.branch = f.branch GROUP BY 1, 2, 3"""
)
def nearest_genomes_predictor(spark, folder):
    """Branches of the 15 nearest genomes at the same fork."""
    rows = C.genes(spark, folder)
    at = sites(spark, folder)
    nearest = D.nearest_by_alleles(at.select("fork", "genome").distinct(), "fork", loci(rows), 15)
    return _round(P.neighbour_predictor(at, nearest, P.leave_one_out_frequency(at)), "q")


@query(
    f"""WITH {SITES},
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
fa AS (SELECT DISTINCT fork, prev_allele AS allele FROM sites),
nn AS (SELECT a.fork, a.allele, b.allele AS other FROM fa a JOIN fa b ON b.fork = a.fork AND b.allele <> a.allele
  JOIN v x ON x.vec_id = a.allele JOIN v y ON y.vec_id = b.allele
  QUALIFY row_number() OVER (PARTITION BY a.fork, a.allele ORDER BY 1 - round(list_cosine_similarity(x.e, y.e), 12), b.allele) <= 5),
o AS (SELECT nn.fork, nn.allele, s.genome, s.branch, count(*) AS v FROM nn JOIN sites s ON s.fork = nn.fork AND s.prev_allele = nn.other GROUP BY 1, 2, 3, 4),
r AS (SELECT f.fork, f.genome, f.prev_allele AS allele, f.branch, count(*) AS n, any_value(freq) AS freq FROM fr f GROUP BY 1, 2, 3, 4)
SELECT r.fork, r.genome, r.allele, r.branch, n,
  coalesce((SELECT sum(v) FROM o WHERE o.fork = r.fork AND o.allele = r.allele AND o.branch = r.branch AND o.genome <> r.genome), 0)::BIGINT AS same,
  coalesce((SELECT sum(v) FROM o WHERE o.fork = r.fork AND o.allele = r.allele AND o.genome <> r.genome), 0)::BIGINT AS others,
  round((coalesce((SELECT sum(v) FROM o WHERE o.fork = r.fork AND o.allele = r.allele AND o.branch = r.branch AND o.genome <> r.genome), 0) + freq)
    / (coalesce((SELECT sum(v) FROM o WHERE o.fork = r.fork AND o.allele = r.allele AND o.genome <> r.genome), 0) + 1), 6) AS q FROM r"""
)
def similar_allele_predictor(spark, folder):
    """Branches of the sites whose upstream allele has the most similar vector."""
    from seqweave.operators.neighbours import nearest_in_group
    from seqweave.plans.table_queries import vectors

    at = sites(spark, folder).withColumnRenamed("prev_allele", "allele")
    alleles = at.select("fork", "allele").distinct()
    known = vectors(spark, folder).join(
        alleles.select(F.col("allele").alias("id")).distinct(), "id", "left_semi"
    )
    near = nearest_in_group(
        alleles.withColumnRenamed("allele", "genome"), "fork", vector_distance(known), 5
    ).withColumnRenamed("genome", "allele")
    return _round(P.similar_allele_predictor(at, near, P.leave_one_out_frequency(at)), "q")


def vector_distance(vectors):
    """1 - cosine of every pair of vectors: g1, g2, d, as a blocked product over dimensions."""
    from seqweave.operators.pairs import pair_products

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    long = vectors.withColumn("_n", norm).select("id", F.posexplode("v").alias("dim", "x"), "_n").select(
        "id", "dim", (F.col("x") / F.col("_n")).alias("x")
    )
    dots = pair_products(cut_lineage(long), "id", "dim", ["x"])
    return dots.select(F.col("a").alias("g1"), F.col("b").alias("g2"), (1 - F.round("x", 12)).alias("d"))


@query(
    f"""WITH {SITES},
m3 AS (SELECT fork, path_3, branch AS best0 FROM sites GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY fork, path_3 ORDER BY count(*) DESC, branch) = 1),
m2 AS (SELECT fork, path_2, branch AS best1 FROM sites GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY fork, path_2 ORDER BY count(*) DESC, branch) = 1),
q AS (SELECT fr.*, ({_lo('path_3')[0]} + freq) / ({_lo('path_3')[1]} + 1) AS q0, ({_lo('path_2')[0]} + freq) / ({_lo('path_2')[1]} + 1) AS q1 FROM fr),
v AS (SELECT fork, split_part(path_3, '>', 1) AS family, q0, q1, best0 <> best1 AS flipped FROM q JOIN m3 USING (fork, path_3) JOIN m2 USING (fork, path_2)),
e AS (SELECT fork, family, count(*) AS n, avg(log2(q0) - log2(q1)) AS "drop", avg(flipped::INT) AS flip_rate FROM v GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT fork, family, n, round("drop", 6) AS "drop", round(flip_rate, 6) AS flip_rate, place FROM (
  SELECT *, row_number() OVER (PARTITION BY fork ORDER BY round("drop", 9) DESC, family) AS place FROM e) WHERE place <= 6"""
)
def ablation_effects(spark, folder):
    """The farthest gene of the path removed: what the true branch loses."""
    rows = sites(spark, folder)
    freq = P.leave_one_out_frequency(rows)
    q3 = P.path_predictor(rows, "path_3", freq).select("fork", "path_3", "genome", "branch", F.col("q").alias("q0"))
    q2 = P.path_predictor(rows, "path_2", freq).select("fork", "path_2", "genome", "branch", F.col("q").alias("q1"))

    def best(path, name):
        counts = rows.groupBy("fork", path, "branch").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("fork", path).agg(
            F.min(F.struct((-F.col("n")).alias("n"), F.col("branch").alias("b")))["b"].alias(name)
        )

    variants = (
        rows.join(q3, ["fork", "path_3", "genome", "branch"])
        .join(q2, ["fork", "path_2", "genome", "branch"])
        .join(best("path_3", "best0"), ["fork", "path_3"])
        .join(best("path_2", "best1"), ["fork", "path_2"])
        .select("fork", F.substring_index("path_3", ">", 1).alias("family"), "q0", "q1", (F.col("best0") != F.col("best1")).alias("flipped"))
    )
    return _round(P.ablation_effects(variants), "drop", "flip_rate")


RELATED = f"""{C.EV}, {LOCI},
tr AS (SELECT genome, locus AS trait, allele % 24 // 8 AS v FROM lc),
nx AS (SELECT genome, pos, name, lead(name) OVER (PARTITION BY genome ORDER BY pos) AS nxt FROM ev),
oc AS (SELECT genome, name AS outcome, arg_min(nxt, pos) AS b FROM nx WHERE nxt IS NOT NULL GROUP BY 1, 2),
bn AS (SELECT g1, g2, CASE WHEN d < 0.9 THEN 0 WHEN d < 0.95 THEN 1 ELSE 2 END AS bin FROM dist),
pq AS (SELECT bin, g1, g2, x.outcome, (x.b = y.b)::INT AS sb FROM bn JOIN oc x ON x.genome = g1 JOIN oc y ON y.genome = g2 AND y.outcome = x.outcome),
ps AS (SELECT g1, g2, x.trait FROM bn JOIN tr x ON x.genome = g1 JOIN tr y ON y.genome = g2 AND y.trait = x.trait AND y.v = x.v)"""

RELATED_Z = """mg{i} AS (SELECT bin, outcome, count(*)::DOUBLE AS n, sum(sb)::DOUBLE AS c FROM pq WHERE {w} GROUP BY 1, 2),
cr{i} AS (SELECT bin, trait, outcome, count(*)::DOUBLE AS r, sum(sb)::DOUBLE AS a FROM pq JOIN ps USING (g1, g2) WHERE {w} GROUP BY 1, 2, 3),
zz{i} AS (SELECT t.trait, m.outcome, round(sum(coalesce(a, 0) - coalesce(r, 0) * c / n) /
  sqrt(greatest(sum(coalesce(r, 0) * (n - coalesce(r, 0)) * c * (n - c) / (n * n * (n - 1))), 1e-9)), 9) AS z
  FROM mg{i} m CROSS JOIN (SELECT DISTINCT trait FROM tr) t LEFT JOIN cr{i} x ON x.bin = m.bin AND x.trait = t.trait AND x.outcome = m.outcome
  WHERE n > 1 GROUP BY 1, 2)"""


def _related(spark, folder):
    from seqweave.operators.graph import adjacencies

    rows = C.genes(spark, folder)
    single = loci(rows)
    traits = single.select("genome", F.col("locus").alias("name"), F.floor(F.col("allele") % 24 / 8).alias("value"))
    named = rows.drop("family").withColumnRenamed("name", "family")
    ahead = adjacencies(named).where(F.col("next").isNotNull())
    outcomes = ahead.groupBy("genome", F.col("family").alias("name")).agg(
        F.min(F.struct("pos", "next"))["next"].alias("value")
    )
    return cut_lineage(traits), cut_lineage(outcomes), single


#: Borders of the classes of relatedness.
CLASSES = [0.9, 0.95]


@query(f"WITH {RELATED}, {RELATED_Z.format(i='', w='true')} SELECT trait, outcome, round(z, 6) AS z FROM zz")
def relatedness_cmh(spark, folder):
    """Same allele against same branch over all pairs of genomes, by relatedness."""
    from seqweave.operators.relatedness import agreement_by_distance

    return _round(agreement_by_distance(*_related(spark, folder), CLASSES), "z")


@query(
    f"""WITH {RELATED}, {RELATED_Z.format(i='', w='true')}, {RELATED_Z.format(i='a', w='g1 % 2 = 0 AND g2 % 2 = 0')},
{RELATED_Z.format(i='b', w='g1 % 2 = 1 AND g2 % 2 = 1')},
j AS (SELECT z.z, a.z AS za, b.z AS zb, CASE WHEN split_part(z.trait, '#', 1) = z.outcome THEN 'same class' ELSE 'other class' END AS band
  FROM zz z JOIN zza a USING (trait, outcome) JOIN zzb b USING (trait, outcome))
SELECT band, count(*) AS tests, round(avg((z > 1)::INT), 6) AS beyond, round(avg((za > 1)::INT), 6) AS in_a, round(avg((zb > 1)::INT), 6) AS in_b,
  round(avg((za > 1 AND zb > 1)::INT), 6) AS in_both, round(avg((za > 1)::INT) * avg((zb > 1)::INT), 6) AS expected FROM j GROUP BY 1"""
)
def decay_table(spark, folder):
    """Share of strong associations per class, in all genomes and replicated in two halves."""
    from seqweave.operators.relatedness import agreement_by_distance, decay_table as run

    traits, outcomes, single = _related(spark, folder)
    tests = agreement_by_distance(traits, outcomes, single, CLASSES)
    for half, name in ((0, "z_a"), (1, "z_b")):
        part = single.where(F.pmod("genome", F.lit(2)) == half)
        tests = tests.join(agreement_by_distance(traits, outcomes, part, CLASSES).withColumnRenamed("z", name), ["trait", "outcome"])
    band = F.when(F.substring_index("trait", "#", 1) == F.col("outcome"), "same class").otherwise("other class")
    return _round(run(tests, band, 1.0), "beyond", "in_a", "in_b", "in_both", "expected")


@query(
    f"""WITH {SITES},
gr AS (SELECT fork, fork || '|' || path_3 AS grp, genome, pos, branch, prev_allele AS allele FROM sites WHERE prev_allele IS NOT NULL),
pl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp, branch ORDER BY genome, pos) - 1 AS place, count(*) OVER (PARTITION BY grp, branch) AS size FROM gr),
pn AS MATERIALIZED (SELECT *, max(place) OVER (PARTITION BY grp, branch, genome) + 1 AS aft, min(place) OVER (PARTITION BY grp, branch, genome) AS frm FROM pl),
bs AS (SELECT x.*, y.allele AS same FROM pn x JOIN pn y ON y.grp = x.grp AND y.branch = x.branch AND y.place = x.aft % x.size WHERE NOT (x.frm = 0 AND x.aft = x.size)),
sz AS (SELECT grp, branch AS other, any_value(size) AS n FROM pn GROUP BY ALL),
f1 AS (SELECT b.*, other, n, y.genome AS g1, y.allele AS a1, y.aft AS aft1 FROM bs b JOIN sz ON sz.grp = b.grp AND other <> b.branch
  JOIN pn y ON y.grp = b.grp AND y.branch = other AND y.place = b.place % n),
sw AS (SELECT fork, branch, other, allele, same, a1 AS crs FROM f1 WHERE g1 <> genome
  UNION ALL SELECT f1.fork, f1.branch, other, f1.allele, same, y.allele FROM f1 JOIN pn y ON y.grp = f1.grp AND y.branch = other AND y.place = aft1 % n WHERE g1 = f1.genome AND y.genome <> f1.genome),
al AS (SELECT DISTINCT fork, allele FROM gr), br AS (SELECT DISTINCT fork, branch FROM gr),
qc AS (SELECT fork, allele, branch, count(*) AS n FROM gr GROUP BY ALL),
qq AS (SELECT al.fork, al.allele, br.branch, (coalesce(n, 0) + 0.5::DOUBLE) / (sum(coalesce(n, 0)) OVER (PARTITION BY al.fork, al.allele) + 0.5::DOUBLE * count(*) OVER (PARTITION BY al.fork, al.allele)) AS q,
  first_value(br.branch) OVER (PARTITION BY al.fork, al.allele ORDER BY coalesce(n, 0) DESC, br.branch) AS best
  FROM al JOIN br ON br.fork = al.fork LEFT JOIN qc ON qc.fork = al.fork AND qc.allele = al.allele AND qc.branch = br.branch)
SELECT s.fork, count(*) AS n, round(avg(o.q), 6) AS own, round(avg(m.q), 6) AS same, round(avg(c.q), 6) AS "cross", round(avg((m.best = other)::INT), 6) AS flip_same, round(avg((c.best = other)::INT), 6) AS flip_cross
FROM sw s JOIN qq o ON o.fork = s.fork AND o.allele = s.allele AND o.branch = other JOIN qq m ON m.fork = s.fork AND m.allele = s.same AND m.branch = other
JOIN qq c ON c.fork = s.fork AND c.allele = s.crs AND c.branch = other GROUP BY 1"""
)
def allele_swap(spark, folder):
    """The allele before a fork exchanged for one of another branch, and for another one of the same branch."""
    rows = sites(spark, folder).where("prev_allele is not null").select(
        "fork", F.concat_ws("|", "fork", "path_3").alias("group"), "genome", "pos", "branch", F.col("prev_allele").alias("allele"))
    partners = W.swap_partners(rows.drop("fork")).withColumn("fork", F.substring_index("group", "|", 1))
    counts = rows.groupBy("fork", "allele", "branch").agg(F.count(F.lit(1)).alias("n"))
    branches = rows.groupBy("fork").agg(F.sort_array(F.collect_set("branch")).alias("b"))
    grid = rows.select("fork", "allele").distinct().join(branches, "fork").select("fork", "allele", F.explode("b").alias("branch"), F.size("b").alias("k"))
    full = cut_lineage(grid.join(counts, ["fork", "allele", "branch"], "left").fillna(0, ["n"]))
    total = full.groupBy("fork", "allele").agg(
        F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("n"), "branch"))["branch"].alias("best"))
    chances = full.join(total, ["fork", "allele"]).select("fork", "allele", "branch", ((F.col("n") + 0.5) / (F.col("t") + 0.5 * F.col("k"))).alias("q"), "best")
    return _round(W.swap_effects(partners, cut_lineage(chances)), "own", "same", "cross", "flip_same", "flip_cross")
