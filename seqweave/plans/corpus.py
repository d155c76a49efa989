"""Sequence roles of the input tables.

``events``: a user is a genome, its events in time order are the genes, the
event type with a property code is the family and the code itself the allele.
``lineitem``/``orders``: a customer is a genome and its order lines are genes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.operators.tiling import number_rows, over_tiles
from seqweave.session import cut_lineage
from seqweave.sources.tables import table

WINDOW = 20  # columns of the default window
RGP_LEVEL = 60.0
CLUSTERS = 25
TOP = 5


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    code = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("genome"),
        "event_id",
        "ts",
        F.col("event_type").alias("name"),
        F.concat_ws("#", "event_type", (code % 8).cast("string")).alias("family"),
        code.alias("allele"),
        (F.col("value") > RGP_LEVEL).alias("in_rgp"),
        F.when(F.col("value") > RGP_LEVEL, code % 2).alias("spot"),
        F.when(code % 3 == 0, F.lit("-")).otherwise(F.lit("+")).alias("strand"),
        (F.col("user_id") * 2 + (F.dayofmonth("ts") > 15).cast("bigint")).alias("contig"),
        "value",
    )


def genes(spark: SparkSession, folder: str) -> DataFrame:
    """genome, pos, length and the gene columns; numbered in hour-sized pieces."""
    return number_rows(
        raw_events(spark, folder), ["genome"], ["ts", "event_id"], F.date_trunc("minute", "ts"), "pos", "length"
    ).drop("ts")


def contig_genes(spark: SparkSession, folder: str) -> DataFrame:
    """The same genes numbered within contigs (``idx``), with contig length and circularity."""
    return number_rows(
        raw_events(spark, folder), ["contig"], ["ts", "event_id"], F.date_trunc("minute", "ts"), "idx", "length"
    ).withColumn("circular", F.col("contig") % 3 != 0).drop("ts")


def order_genes(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines of a customer in date order; numbered in day-sized pieces."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    rows = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("o_custkey").alias("genome"),
            "o_orderdate",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.col("p_brand").alias("family"),
            F.col("p_type").alias("name"),
            F.col("l_suppkey").alias("allele"),
        )
    )
    return number_rows(
        rows,
        ["genome"],
        ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        F.to_date("o_orderdate"),
        "pos",
        "length",
    ).drop("o_orderdate")


def with_prev(rows: DataFrame) -> DataFrame:
    return over_tiles(
        rows, ["genome"], lambda w: {"prev": F.lag("family").over(w)}, before=1
    )


def count_model(prev_rows: DataFrame) -> DataFrame:
    """Order-one call model: per previous family, the share of each cluster after it.

    prev, cluster, p, rank (1 + clusters with a higher share), entropy in bits.
    """
    counts = (
        prev_rows.where(F.col("prev").isNotNull())
        .groupBy("prev", (F.col("allele") % CLUSTERS).alias("cluster"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = Window.partitionBy("prev")
    p = F.col("n") / F.sum("n").over(total)
    shares = counts.select("prev", "cluster", "n", p.alias("p"))
    return shares.select(
        "prev",
        "cluster",
        "p",
        F.rank().over(total.orderBy(F.desc("n"))).alias("rank"),
        F.row_number().over(total.orderBy(F.desc("n"), "cluster")).alias("place"),
        (-F.sum(F.col("p") * F.log2("p")).over(total)).alias("entropy"),
    )


def calls(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """One scored call per gene that has a predecessor.

    The scored calls are kept as a written table, the form later stages read
    several times. genome, pos, family, half, in_rgp, entropy, p_true, rank_true and ``top``,
    the best clusters with their probabilities, best first.
    """
    base = cut_lineage(with_prev(genes(spark, folder) if rows is None else rows))
    model = count_model(base)
    top = model.where(F.col("place") <= TOP).groupBy("prev").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "cluster", "p"))),
            lambda x: F.struct(x["cluster"].alias("cluster"), x["p"].alias("p")),
        ).alias("top"),
        F.first("entropy").alias("entropy"),
    )
    truth = model.select(
        "prev", "cluster", F.col("p").alias("p_true"), F.col("rank").alias("rank_true")
    )
    scored = (
        base.where(F.col("prev").isNotNull())
        .withColumn("cluster", F.col("allele") % CLUSTERS)
        .join(truth, ["prev", "cluster"])
        .join(top, "prev")
        .withColumn("half", F.pmod("genome", F.lit(2)))
        .select(
            "genome", "pos", "family", "prev", "half", "in_rgp", "name", "entropy", "p_true", "rank_true", "top"
        )
    )
    return cut_lineage(scored)


# --- the same roles for the checking engine -------------------------------------------

EV = """ev0 AS (
  SELECT user_id AS genome, event_id, ts, event_type AS name, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS allele
  FROM events),
ev AS (
  SELECT genome, name, allele, event_id, ts, value,
         name || '#' || (allele % 8) AS family,
         value > 60 AS in_rgp,
         CASE WHEN value > 60 THEN allele % 2 END AS spot,
         CASE WHEN allele % 3 = 0 THEN '-' ELSE '+' END AS strand,
         genome * 2 + CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END AS contig,
         row_number() OVER (PARTITION BY genome ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY genome) AS length
  FROM ev0)"""

CG = EV + """,
cg AS (
  SELECT genome, contig, contig % 3 <> 0 AS circular, name, family, allele, strand, in_rgp,
         row_number() OVER (PARTITION BY contig ORDER BY ts, event_id) - 1 AS idx,
         count(*) OVER (PARTITION BY contig) AS length
  FROM ev)"""

OG = """og AS (
  SELECT o_custkey AS genome, p_brand AS family, p_type AS name, l_suppkey AS allele,
         row_number() OVER (PARTITION BY o_custkey
           ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
         count(*) OVER (PARTITION BY o_custkey) AS length
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

TR = EV + """,
tr AS (SELECT *, lag(family) OVER (PARTITION BY genome ORDER BY pos) AS prev FROM ev)"""

CALLS = TR + """,
mc AS (SELECT prev, allele % 25 AS cluster, count(*) AS n FROM tr WHERE prev IS NOT NULL GROUP BY 1, 2),
mp AS (SELECT prev, cluster, n, n / sum(n) OVER (PARTITION BY prev) AS p FROM mc),
model AS (
  SELECT prev, cluster, p, rank() OVER (PARTITION BY prev ORDER BY n DESC) AS rnk,
         row_number() OVER (PARTITION BY prev ORDER BY n DESC, cluster) AS place,
         -sum(p * log2(p)) OVER (PARTITION BY prev) AS entropy
  FROM mp),
calls AS (
  SELECT tr.genome, tr.pos, tr.family, tr.prev, tr.name, tr.in_rgp, tr.genome % 2 AS half,
         m.p AS p_true, m.rnk AS rank_true, m.entropy
  FROM tr JOIN model m ON m.prev = tr.prev AND m.cluster = tr.allele % 25),
ctop AS (
  SELECT c.genome, c.pos, c.family, c.prev, c.half, c.name, c.in_rgp, m.cluster, m.p, m.place
  FROM calls c JOIN model m ON m.prev = c.prev AND m.place <= 5)"""
