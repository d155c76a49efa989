"""Graph, call and decoder queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqweave.operators import decoder as D
from seqweave.operators import exports as E
from seqweave.operators import graph as G
from seqweave.plans import corpus as C
from seqweave.session import shared_folder
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
    f"""WITH {C.TR},
c AS (SELECT genome % 2 AS half, prev, family, count(*) AS n FROM tr GROUP BY 1, 2, 3),
best AS (SELECT half, prev, family AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY half, prev ORDER BY n DESC, family) AS r
  FROM c WHERE prev IS NOT NULL) WHERE r = 1),
allc AS (SELECT prev, family, sum(n) AS n FROM c WHERE prev IS NOT NULL GROUP BY 1, 2),
sh AS (SELECT prev, n / sum(n) OVER (PARTITION BY prev) AS share FROM allc),
fork AS (SELECT prev, count(*) FILTER (WHERE share >= 0.05) >= 2 AS fork FROM sh GROUP BY 1)
SELECT c.prev, coalesce(fork, false) AS fork, sum(n)::BIGINT AS calls,
  sum(CASE WHEN best = c.family THEN n ELSE 0 END)::BIGINT AS hits
FROM c LEFT JOIN best b ON b.prev = c.prev AND b.half = 1 - c.half
LEFT JOIN fork f ON f.prev = c.prev GROUP BY 1, 2"""
)
def successor_baseline(spark, folder):
    return G.cross_half_successor_calls(C.genes(spark, folder))


@query(
    f"""WITH {C.OG},
tr AS (SELECT *, lag(family) OVER (PARTITION BY genome ORDER BY pos) AS prev FROM og)
SELECT prev, family, count(*) AS n, count(DISTINCT genome) AS genomes
FROM tr WHERE prev IS NOT NULL GROUP BY 1, 2"""
)
def order_edges(spark, folder):
    return G.edges(C.order_genes(spark, folder))


@query(
    f"""WITH {C.TR}
SELECT prev, family, count(*) AS n, count(DISTINCT genome) AS genomes
FROM tr WHERE prev IS NOT NULL GROUP BY 1, 2"""
)
def edges(spark, folder):
    return G.edges(C.genes(spark, folder))


@query(
    f"""WITH {C.TR},
e AS (SELECT prev, family, count(*) AS n FROM tr WHERE prev IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, family) AS place FROM e)
SELECT prev AS family, string_agg(family || ':' || n, ',' ORDER BY place) AS next
FROM r WHERE place <= 5 GROUP BY 1"""
)
def top_successors(spark, folder):
    return G.top_successors(G.edges(C.genes(spark, folder)))


NODES = """w AS (SELECT * FROM ev WHERE pos < 20),
car AS (SELECT DISTINCT family, genome FROM w),
ex AS (SELECT family, genome, row_number() OVER (PARTITION BY family ORDER BY genome) AS r FROM car),
exs AS (SELECT family, string_agg(genome::VARCHAR, ',' ORDER BY genome) AS examples FROM ex WHERE r <= 10 GROUP BY 1),
loc AS (SELECT family, pos AS locus FROM (SELECT family, pos, row_number() OVER (
  PARTITION BY family ORDER BY count(*) DESC, pos) AS r FROM w GROUP BY 1, 2) WHERE r = 1),
al AS (SELECT family, allele FROM (SELECT family, allele, row_number() OVER (
  PARTITION BY family ORDER BY count(*) DESC, allele) AS r FROM w GROUP BY 1, 2) WHERE r = 1),
lab AS (SELECT family, name AS label FROM (SELECT family, name, row_number() OVER (
  PARTITION BY family ORDER BY count(*) DESC, name) AS r FROM w GROUP BY 1, 2) WHERE r = 1),
nodes AS (
  SELECT w.family, count(*) AS genes, round(avg(CASE WHEN in_rgp THEN 1.0::DOUBLE ELSE 0 END), 6) AS rgp,
    count(DISTINCT genome) AS carriers
  FROM w GROUP BY 1)"""


@query(
    f"""WITH {C.EV}, {NODES}
SELECT n.family, genes, rgp, carriers, locus, allele, label, examples
FROM nodes n JOIN loc USING (family) JOIN al USING (family) JOIN lab USING (family) JOIN exs USING (family)"""
)
def window_nodes(spark, folder):
    window = C.genes(spark, folder).where(F.col("pos") < C.WINDOW)
    return G.nodes(window).withColumn("rgp", F.round("rgp", 6))


@query(
    f"""WITH {C.CALLS}
SELECT genome, pos, round(entropy, 6) AS entropy, round(p_true, 6) AS p_true, rank_true FROM calls"""
)
def call_scores(spark, folder):
    return C.calls(spark, folder).select(
        "genome", "pos", F.round("entropy", 6).alias("entropy"), F.round("p_true", 6).alias("p_true"), "rank_true"
    )


DEC = """mass AS (SELECT half, cluster, family, sum(p) AS mass FROM ctop GROUP BY 1, 2, 3),
dec AS (SELECT half, cluster, family, mass / sum(mass) OVER (PARTITION BY half, cluster) AS weight FROM mass),
massall AS (SELECT cluster, family, sum(p) AS mass FROM ctop GROUP BY 1, 2),
decall AS (SELECT cluster, family, mass, sum(mass) OVER (PARTITION BY cluster) AS total,
  mass / sum(mass) OVER (PARTITION BY cluster) AS weight FROM massall)"""

READ = (
    DEC
    + """,
lists AS (SELECT DISTINCT half, prev, cluster, p FROM ctop),
score AS (SELECT l.half, l.prev, d.family, sum(l.p * d.weight) AS score
  FROM lists l JOIN dec d ON d.cluster = l.cluster AND d.half = 1 - l.half GROUP BY 1, 2, 3),
best AS (SELECT half, prev, family AS best FROM (SELECT *, row_number() OVER (
  PARTITION BY half, prev ORDER BY round(score, 9) DESC, family) AS r FROM score) WHERE r = 1),
lastp AS (SELECT prev, arg_max(p, place) AS p_last FROM model WHERE place <= 5 GROUP BY 1),
decoded AS (
  SELECT c.*, coalesce(b.best = c.family, false) AS hit, coalesce(s.score, 0) AS p_read, p_last
  FROM calls c LEFT JOIN best b ON b.half = c.half AND b.prev = c.prev
  LEFT JOIN score s ON s.half = c.half AND s.prev = c.prev AND s.family = c.family
  JOIN lastp l ON l.prev = c.prev)"""
)

TABLE = """count(*) AS n, round(avg(CASE WHEN rank_true = 1 THEN 1::DOUBLE ELSE 0 END), 6) AS top1,
  round(avg(CASE WHEN hit THEN 1::DOUBLE ELSE 0 END), 6) AS top1_dec,
  quantile_cont(rank_true, 0.5)::DOUBLE AS med_rank, round(avg(entropy), 6) AS entropy,
  round(pow(2, avg(-log2(greatest(CASE WHEN p_read > 0 THEN p_read ELSE p_last END, 1e-12)))), 6) AS ppl,
  round(avg(CASE WHEN p_read = 0 THEN 1::DOUBLE ELSE 0 END), 6) AS unread"""

ROUNDED = ["top1", "top1_dec", "entropy", "ppl", "unread"]


def _rounded(df, names, digits=6):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


def decoded(spark, folder):
    calls = C.calls(spark, folder)
    return D.decode(calls, D.decoder(calls, "half"))


@query(
    f"""WITH {C.CALLS}, {DEC}
SELECT family, cluster, round(mass, 6) AS mass, round(weight, 6) AS weight, place FROM (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(weight, 9) DESC, cluster) AS place
  FROM decall WHERE mass >= 0.5 AND weight >= 0.03) WHERE place <= 12"""
)
def decoder_weights(spark, folder):
    table = D.decoder(C.calls(spark, folder))
    kept = D.family_weights(table, min_share=0.03)
    return _rounded(kept.select("family", "cluster", "mass", "weight", "place"), ["mass", "weight"])


@query(
    f"""WITH {C.CALLS}, {DEC}
SELECT cluster, family AS read, round(clarity, 6) AS clarity FROM (
  SELECT cluster, family, max(mass) OVER (PARTITION BY cluster) / total AS clarity,
    row_number() OVER (PARTITION BY cluster ORDER BY round(mass, 9) DESC, family) AS r
  FROM decall WHERE total >= 1) WHERE r = 1"""
)
def cluster_readings(spark, folder):
    return _rounded(D.readings(D.decoder(C.calls(spark, folder))), ["clarity"])


@query(
    f"""WITH {C.CALLS}, {READ}
SELECT genome, pos, hit, round(p_read, 6) AS p_read FROM decoded"""
)
def cross_half_decode(spark, folder):
    return decoded(spark, folder).select("genome", "pos", "hit", F.round("p_read", 6).alias("p_read"))


@query(
    f"""WITH {C.CALLS}, {READ}
SELECT name, in_rgp, {TABLE} FROM decoded GROUP BY GROUPING SETS ((name), (in_rgp), ())"""
)
def call_tables(spark, folder):
    """Tables by class and by plastic region, and the total, in one pass."""
    table = decoded(spark, folder)
    grouped = table.groupingSets([["name"], ["in_rgp"], []], "name", "in_rgp").agg(*D.call_summary())
    return _rounded(grouped, ROUNDED)


@query(f"""WITH {C.CALLS}, {READ}
SELECT pos AS locus, {TABLE} FROM decoded WHERE pos < 20 GROUP BY 1""")
def per_locus(spark, folder):
    table = decoded(spark, folder).where(F.col("pos") < C.WINDOW)
    return _rounded(table.groupBy(F.col("pos").alias("locus")).agg(*D.call_summary()), ROUNDED)


MEAN = """mean AS (SELECT prev, cluster, p, place FROM (
  SELECT prev, cluster, p, row_number() OVER (PARTITION BY prev ORDER BY round(p, 9) DESC, cluster) AS place
  FROM (SELECT a.prev, cluster, s / n AS p
    FROM (SELECT prev, cluster, sum(p) AS s FROM ctop WHERE pos < 20 GROUP BY 1, 2) a
    JOIN (SELECT prev, count(*) AS n FROM calls WHERE pos < 20 GROUP BY 1) b ON a.prev = b.prev))
  WHERE place <= 8)"""


def _window_mean(spark, folder):
    return D.mean_calls(C.calls(spark, folder).where(F.col("pos") < C.WINDOW))


@query(f"""WITH {C.CALLS}, {MEAN} SELECT prev, cluster, round(p, 6) AS p, place FROM mean""")
def mean_call_after_family(spark, folder):
    return _rounded(_window_mean(spark, folder), ["p"])


@query(
    f"""WITH {C.CALLS}, {NODES}, {DEC}, {MEAN},
reads AS (SELECT cluster, family AS read FROM (SELECT *, row_number() OVER (
  PARTITION BY cluster ORDER BY round(mass, 9) DESC, family) AS r FROM decall WHERE total >= 1) WHERE r = 1),
wtr AS (SELECT DISTINCT prev, family FROM tr WHERE pos < 20 AND prev IS NOT NULL),
src AS (SELECT locus, family FROM (SELECT locus, n.family, row_number() OVER (
  PARTITION BY locus ORDER BY carriers DESC, n.family) AS r FROM nodes n JOIN loc USING (family)) WHERE r = 1),
ex2 AS (SELECT s.family, s.locus + 1 AS locus, m.cluster, m.p, r.read,
  row_number() OVER (PARTITION BY s.family ORDER BY m.p DESC, m.cluster) AS place
  FROM src s JOIN mean m ON m.prev = s.family LEFT JOIN reads r ON r.cluster = m.cluster
  WHERE NOT EXISTS (SELECT 1 FROM wtr e WHERE e.prev = s.family AND e.family = r.read))
SELECT family, locus, cluster, round(p, 6) AS p, read, place FROM ex2 WHERE place <= 2"""
    .replace("", "")
)
def expected_unobserved(spark, folder):
    rows = C.genes(spark, folder)
    window = rows.where(F.col("pos") < C.WINDOW)
    calls = C.calls(spark, folder, rows)
    mean = D.mean_calls(calls.where(F.col("pos") < C.WINDOW)).withColumnRenamed("prev", "family")
    reads = D.readings(D.decoder(calls)).select("cluster", "read")
    ghosts = G.expected_unobserved(
        G.nodes(window).select("family", "locus", "carriers"), G.edges(window), mean.drop("place"), reads
    )
    return _rounded(ghosts, ["p"])


@query(
    f"""WITH {C.CALLS}, {DEC},
brs AS (SELECT prev, family FROM (SELECT prev, family, row_number() OVER (
  PARTITION BY prev ORDER BY count(*) DESC, family) AS r FROM tr WHERE prev IS NOT NULL GROUP BY 1, 2) WHERE r <= 4),
lists AS (SELECT DISTINCT half, prev, cluster, p FROM ctop),
q AS (SELECT l.half, b.prev, b.family AS branch, coalesce(sum(l.p * d.weight), 0) AS q
  FROM brs b JOIN lists l ON l.prev = b.prev
  LEFT JOIN dec d ON d.family = b.family AND d.cluster = l.cluster AND d.half = 1 - l.half GROUP BY 1, 2, 3),
e AS (SELECT *, q + 1e-3 * greatest(sum(q) OVER (PARTITION BY half, prev), 1e-12) AS qe FROM q)
SELECT half, prev, branch, round(qe / sum(qe) OVER (PARTITION BY half, prev), 6) AS q FROM e"""
)
def branch_probabilities(spark, folder):
    from seqweave.operators.predictors import branch_probabilities as run

    calls = C.calls(spark, folder)
    pairs = calls.groupBy("prev", "family").agg(F.count(F.lit(1)).alias("n"))
    branches = G.top_k(pairs, ["prev"], [F.desc("n"), F.col("family")], 4).select(
        "prev", F.col("family").alias("branch")
    )
    return _rounded(run(calls, branches, D.decoder(calls, "half")), ["q"])


@query(f"WITH {C.CALLS}, {DEC} SELECT half, family, cluster, round(weight, 6) AS weight FROM dec")
def decoder_rows(spark, folder):
    """The decoder of each half written as blocks of sparse rows, and read back for the families of its calls."""
    calls = C.calls(spark, folder)
    weights = D.decoder(calls, "half").select("half", "family", "cluster", "weight")
    place = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    E.write_decoder(weights, place, per_block=16)
    rows, missing = E.decoder_rows(spark, place, calls.select("half", "family"))
    if not missing.isEmpty():
        raise ValueError("the decoder lacks rows of families that its own calls hold")
    return _rounded(rows, ["weight"])
