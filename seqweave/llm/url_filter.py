"""URL filters by link-graph propagation.

Rules decide the pages that they fit. They also make seeds: a host is trusted by
the share of its pages that rules allow and blocked by the share that they block.
Trust spreads along host links as personalised PageRank from trusted seeds;
distrust spreads against them from blocked seeds, from a blocked host to those
that link to it. A host whose distrust exceeds its trust by a threshold is
blocked. Masses are whole numbers, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.session import cut_lineage

#: Verdict and rule (host, then path) of the dealt query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Mass of a whole seed, percent of it that links pass on, rounds of spreading.
UNIT, PASSED, ROUNDS = 10**12, 85, 8
#: A host is blocked above this difference: half of what a seed keeps that blocks all its pages.
THRESHOLD = UNIT * (100 - PASSED) // 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"[hH][tT][tT][pP][sS]?://([^\s/?#\"'<>\\]+)"


def located(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path: empty for a null url and one without ``://``."""
    host = F.coalesce(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), F.lit(""))
    return pages.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (with host and path) with rule and ruled (its verdict), null where none fits; the longest rule wins.

    ``rules`` is a short list that becomes one expression; of equal rules the first stands.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, rest = text.partition("/")
        fits = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        fits = fits & F.startswith("path", F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def host_links(pages: DataFrame) -> DataFrame:
    """source, target: distinct host edges of the absolute links in ``html``, none from a host to itself."""
    found = pages.where("host <> '' and html is not null").select(
        F.col("host").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("t")
    )
    return found.select("source", F.translate("t", UPPER, LOWER).alias("target")).where("source <> target").distinct()


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust of every host with a seed or reached from one.

    ``seeds``: host, trust, distrust in ``UNIT``. Each round a host keeps its seed's part and takes ``PASSED``
    percent of what its neighbours hand out in equal shares; trust goes from source to target, distrust back.
    """
    both = edges.select(F.lit("t").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to")).unionByName(
        edges.select(F.lit("d").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"))
    )
    degree = both.groupBy("kind", "from").agg(F.count("*").alias("degree"))
    both = cut_lineage(both.join(degree, ["kind", "from"]))
    start = cut_lineage(
        seeds.select("host", F.explode(F.create_map(F.lit("t"), "trust", F.lit("d"), "distrust")).alias("kind", "mass"))
        .where("mass > 0").select("kind", "host", F.expr(f"mass * {100 - PASSED} div 100").alias("kept"))
    )
    mass = start.withColumnRenamed("kept", "mass")
    for k in range(rounds):
        moved = both.join(mass.withColumnRenamed("host", "from"), ["kind", "from"]).select(
            "kind", F.col("to").alias("host"), F.expr("mass div degree").alias("mass")
        ).groupBy("kind", "host").agg(F.expr(f"sum(mass) * {PASSED} div 100").alias("mass"))
        mass = moved.unionByName(start.withColumnRenamed("kept", "mass")).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if k % 4 == 3:
            mass = cut_lineage(mass)
    return mass.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "t", F.col("mass"))), F.lit(0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "d", F.col("mass"))), F.lit(0)).alias("distrust"),
    )


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust (of its host, 0 where nothing reaches it).

    verdict is the longest fitting rule's, else block where the host's distrust exceeds its trust by more than
    ``threshold``, else allow. Null urls and urls without ``://`` have neither host nor rule and are allowed. Repeated
    rows count as pages of their own; links only as edges. Other columns are not read.
    """
    rows = ruled(located(pages.select("page_id", "url", "html")), rules)
    slim = cut_lineage(rows.select("page_id", "host", "path", "rule", "ruled"))

    def share(verdict):
        return F.expr(f"count(case when ruled = '{verdict}' then 1 end) * {UNIT} div count(*)")

    seeds = slim.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = cut_lineage(spread(host_links(rows), seeds, rounds))
    verdict = F.coalesce("ruled", F.when(F.col("distrust") - F.col("trust") > threshold, F.lit("block")), F.lit("allow"))
    return slim.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("trust", "distrust")),
    )


def judge_sql(rules=RULES, rounds: int = ROUNDS, threshold: int = THRESHOLD) -> str:
    """The same as one DuckDB statement over the table ``pages``, its rounds written out."""
    rule = verdict = "NULL"
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, rest = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}')"
        rule = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END"
        verdict = f"CASE WHEN {fits} THEN '{said}' ELSE {verdict} END"
    link = LINK.replace("'", "''")
    low = f"'{UPPER}', '{LOWER}'"
    parts = [
        f"""located AS MATERIALIZED (SELECT page_id, html,
            translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {low}) AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
        f"ruled AS MATERIALIZED (SELECT *, {rule} AS rule, {verdict} AS ruled FROM located)",
        f"""links AS (SELECT DISTINCT source, target FROM (SELECT host AS source, translate(unnest(
            regexp_extract_all(html, '{link}', 1)), {low}) AS target FROM ruled WHERE host <> '') WHERE source <> target)""",
        """edges AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, a) AS degree FROM (
            SELECT 't' AS kind, source AS a, target AS b FROM links UNION ALL
            SELECT 'd', target, source FROM links))""",
        f"""seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') * {UNIT} // count(*) AS t,
            count(*) FILTER (ruled = 'block') * {UNIT} // count(*) AS d FROM ruled WHERE host <> '' GROUP BY host)""",
        f"""start AS MATERIALIZED (SELECT kind, host, (mass * {100 - PASSED} // 100)::BIGINT AS mass FROM (
            SELECT 't' AS kind, host, t AS mass FROM seeds UNION ALL SELECT 'd', host, d FROM seeds) WHERE mass > 0)""",
        "m0 AS MATERIALIZED (SELECT * FROM start)",
    ]
    parts += [
        f"""m{k} AS MATERIALIZED (SELECT kind, host, sum(mass)::BIGINT AS mass FROM (
            SELECT kind, b AS host, (sum(mass // degree)::BIGINT * {PASSED} // 100) AS mass
            FROM edges JOIN (SELECT kind, host AS a, mass FROM m{k - 1}) USING (kind, a) GROUP BY kind, b
            UNION ALL SELECT * FROM start) GROUP BY kind, host)"""
        for k in range(1, rounds + 1)
    ]
    return f"""WITH {', '.join(parts)},
        scores AS (SELECT host, coalesce(sum(mass) FILTER (kind = 't'), 0)::BIGINT AS trust,
            coalesce(sum(mass) FILTER (kind = 'd'), 0)::BIGINT AS distrust FROM m{rounds} GROUP BY host)
        SELECT page_id, host, path, rule, coalesce(ruled,
            CASE WHEN distrust - trust > {threshold} THEN 'block' END, 'allow') AS verdict,
            coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
        FROM ruled LEFT JOIN scores USING (host)"""
