"""Anchoring, window, path, segment and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import graph as G
from seqweave.operators import sequence as S
from seqweave.operators import tiling as T
from seqweave.plans import corpus as C
from seqweave.session import cut_lineage
from seqweave.sources.tables import typed

QUERIES = {}
ORACLES = {}
NAMES = ["signup", "view"]
ANCHOR = "click#3"
BB_SHARE = 0.3


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: typed(fn(spark, folder))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


ANCH = """af AS (
  SELECT name, family, CASE name WHEN 'signup' THEN 0 ELSE 1 END AS priority FROM (
    SELECT name, family, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, family) AS r
    FROM ev WHERE name IN ('signup', 'view') GROUP BY 1, 2) WHERE r = 1),
anc AS (SELECT genome, contig, priority AS start, idx AS anchor_idx, strand AS anchor_strand FROM (
  SELECT cg.*, priority, row_number() OVER (PARTITION BY genome ORDER BY priority, length DESC, contig, idx) AS r
  FROM cg JOIN af USING (family)) WHERE r = 1),
rot AS (SELECT cg.*, a.start,
  CASE WHEN anchor_strand = '-' THEN anchor_idx - idx ELSE idx - anchor_idx END AS off
  FROM cg JOIN anc a USING (genome, contig)),
rotated AS (SELECT *, ((off % length) + length) % length AS rpos FROM rot)"""


def _anchors(rows):
    return S.anchor_genes(rows, S.anchor_families(rows, NAMES))


@query(f"WITH {C.CG}, {ANCH} SELECT name, family, priority::BIGINT AS priority FROM af")
def anchor_families(spark, folder):
    return S.anchor_families(C.contig_genes(spark, folder), NAMES)


@query(f"WITH {C.CG}, {ANCH} SELECT genome, contig, start::BIGINT AS start, anchor_idx, anchor_strand FROM anc")
def anchor_genes(spark, folder):
    return _anchors(C.contig_genes(spark, folder))


@query(
    f"""WITH {C.CG} SELECT genome, contig, length FROM (SELECT genome, contig, count(*) AS length, row_number() OVER (
  PARTITION BY genome ORDER BY count(*) DESC, contig) AS r FROM cg GROUP BY 1, 2) WHERE r = 1"""
)
def longest_contig(spark, folder):
    return S.longest_contig(C.contig_genes(spark, folder))


@query(f"WITH {C.CG}, {ANCH} SELECT genome, contig, idx, rpos AS pos, family FROM rotated")
def rotate_orient(spark, folder):
    rows = C.contig_genes(spark, folder)
    return S.rotate(rows, _anchors(rows)).select("genome", "contig", "idx", "pos", "family")


@query(
    f"""WITH {C.CG}, {ANCH} SELECT genome, rpos + start AS "column", family FROM rotated
WHERE rpos < 20 - start AND (circular OR off >= 0)"""
)
def window_walk(spark, folder):
    rows = C.contig_genes(spark, folder)
    return S.window_walk(S.rotate(rows, _anchors(rows)), C.WINDOW).select("genome", "column", "family")


@query(f"WITH {C.CG}, {ANCH} SELECT genome, count(*) AS genes FROM ev WHERE genome NOT IN (SELECT genome FROM anc) GROUP BY 1"
       .replace("('signup', 'view')", "('signup')"))
def unanchored(spark, folder):
    """Genomes with no gene of the primary anchor family."""
    rows = C.contig_genes(spark, folder)
    anchors = S.anchor_genes(rows, S.anchor_families(rows, NAMES[:1]))
    return rows.join(anchors, "genome", "left_anti").groupBy("genome").agg(F.count(F.lit(1)).alias("genes"))


@query(
    f"""WITH {C.EV},
a AS (SELECT genome, min(pos) AS ap FROM ev WHERE family = 'click#3' GROUP BY 1 HAVING count(*) = 1)
SELECT genome, (((pos - ap) % length) + length) % length AS "column", family
FROM ev JOIN a USING (genome) WHERE (((pos - ap) % length) + length) % length < 20"""
)
def region_window(spark, folder):
    return S.region_window(C.genes(spark, folder), ANCHOR, C.WINDOW).select("genome", "column", "family")


@query(
    f"""WITH {C.EV} SELECT genome, pos, lag(family) OVER w AS prev, lead(family) OVER w AS next
FROM ev WINDOW w AS (PARTITION BY genome ORDER BY pos)"""
)
def neighbours(spark, folder):
    return G.adjacencies(C.genes(spark, folder)).select("genome", "pos", "prev", "next")


@query(
    f"""WITH {C.EV}, p AS (SELECT genome, pos,
  list(family) OVER (PARTITION BY genome ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS u3,
  list(family) OVER (PARTITION BY genome ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS u10 FROM ev)
SELECT genome, pos, CASE WHEN len(u3) >= 3 THEN array_to_string(u3, '>') END AS path_3,
  CASE WHEN len(u10) >= 10 THEN array_to_string(u10, '>') END AS path_10 FROM p"""
)
def upstream_paths(spark, folder):
    return S.upstream_paths(C.genes(spark, folder), [3, 10]).select("genome", "pos", "path_3", "path_10")


@query(
    f"""WITH {C.EV}, p AS (SELECT genome, pos,
  list(allele::VARCHAR) OVER (PARTITION BY genome ORDER BY pos ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING) AS u FROM ev)
SELECT genome, pos, coalesce(array_to_string(u, '>'), '') AS path_11 FROM p"""
)
def allele_haplotypes(spark, folder):
    rows = S.upstream_paths(C.genes(spark, folder), [11], value="allele", full=False)
    return rows.select("genome", "pos", "path_11")


@query(
    f"""WITH {C.EV} SELECT s.genome, s.pos AS site, u.family, max(u.pos) AS pos, arg_max(u.allele, u.pos) AS allele
FROM ev s JOIN ev u ON u.genome = s.genome AND u.pos BETWEEN s.pos - 20 AND s.pos - 1
WHERE s.family = 'error#5' GROUP BY 1, 2, 3"""
)
def nearest_upstream(spark, folder):
    return S.nearest_upstream(C.genes(spark, folder), F.col("family") == "error#5", 20)


BB = """cp AS (SELECT genome, family, count(*) AS n, min(pos) AS pos FROM ev GROUP BY 1, 2),
bb AS (SELECT family, count(*) AS single, quantile_cont(pos, 0.5)::DOUBLE AS median FROM cp WHERE n = 1
  GROUP BY 1 HAVING count(*) >= 0.3 * (SELECT count(DISTINCT genome) FROM ev))"""


@query(
    f"""WITH {C.EV}, {BB} SELECT family, single, median,
row_number() OVER (ORDER BY median, family) - 1 AS rank FROM bb"""
)
def backbone(spark, folder):
    return S.backbone(C.genes(spark, folder), BB_SHARE)


@query(
    f"""WITH {C.EV},
f AS (SELECT *, CASE WHEN in_rgp THEN spot END AS kind FROM ev),
s AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER (PARTITION BY genome ORDER BY pos) AND pos > 0
  THEN 0 ELSE 1 END AS st FROM f),
g AS (SELECT *, sum(st) OVER (PARTITION BY genome ORDER BY pos) AS run FROM s)
SELECT genome, any_value(spot) AS spot, min(pos) AS start, max(pos) AS "end", count(*) AS genes
FROM g WHERE in_rgp GROUP BY genome, run"""
)
def plastic_runs(spark, folder):
    return S.plastic_runs(C.genes(spark, folder))


BLOCKS = """m AS (SELECT name, genome, pos, length FROM ev WHERE in_rgp),
mm AS (SELECT name, genome, pos, length, row_number() OVER w AS i, count(*) OVER (PARTITION BY name, genome) AS n,
  (((pos - coalesce(lag(pos) OVER w, last_value(pos) OVER (PARTITION BY name, genome ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) % length) + length) % length AS gap
  FROM m WINDOW w AS (PARTITION BY name, genome ORDER BY pos)),
ms AS (SELECT *, CASE WHEN gap > 6 OR gap = 0 THEN 1 ELSE 0 END AS st FROM mm),
mr AS (SELECT *, sum(st) OVER (PARTITION BY name, genome ORDER BY pos) AS rs,
  sum(st) OVER (PARTITION BY name, genome) AS cuts FROM ms),
blocks AS (SELECT name, genome, CASE WHEN rs = 0 THEN cuts ELSE rs END AS block,
  min(CASE WHEN cuts = 0 OR st = 1 THEN pos END) AS start,
  coalesce(max(CASE WHEN rs = 0 THEN pos END), max(pos)) AS "end", count(*) AS genes
  FROM mr GROUP BY 1, 2, 3)"""


def _members(spark, folder):
    rows = C.genes(spark, folder).where("in_rgp")
    return rows.select("name", "genome", "pos", "length")


@query(f'WITH {C.EV}, {BLOCKS} SELECT name, genome, block::BIGINT AS block, start, "end", genes FROM blocks')
def circular_blocks(spark, folder):
    return S.circular_blocks(_members(spark, folder), ["name", "genome"], gap=6)


@query(
    f"""WITH {C.EV}, fm AS (SELECT family, quantile_cont(pos, 0.5)::DOUBLE AS median FROM ev GROUP BY 1),
s AS (SELECT *, CASE WHEN median - lag(median) OVER (ORDER BY median, family) <= 0.5 THEN 0 ELSE 1 END AS st FROM fm)
SELECT family, median, sum(st) OVER (ORDER BY median, family)::BIGINT AS "group" FROM s"""
)
def position_groups(spark, folder):
    medians = T.median_position(C.genes(spark, folder), ["family"], "pos", "median")
    return S.single_linkage(medians, "median", "family", 0.5)


FLANKS = """fl AS (SELECT e.genome, e.pos, e.family, e.length,
  (SELECT arg_max(u.family, u.pos) FROM un u WHERE u.genome = e.genome AND u.pos BETWEEN e.pos - 5 AND e.pos - 1) AS "left",
  (SELECT arg_min(u.family, u.pos) FROM un u WHERE u.genome = e.genome AND u.pos BETWEEN e.pos + 1 AND e.pos + 5) AS "right"
  FROM ev e)"""
UNROLL = """un AS (SELECT genome, family, pos + t * length AS pos FROM ev, (VALUES (-1), (0), (1)) AS v(t)
  WHERE family IN (SELECT family FROM bb WHERE single >= 0.33 * (SELECT count(DISTINCT genome) FROM ev)))"""


def _backbone_flag(rows, share):
    """Genes with a flag telling whether their family is backbone."""
    flags = S.backbone(rows, share).select("family", F.lit(True).alias("bb"))
    return rows.join(flags, "family", "left").withColumn("bb", F.coalesce("bb", F.lit(False)))


@query(f'WITH {C.EV}, {BB}, {UNROLL}, {FLANKS} SELECT genome, pos, "left", "right" FROM fl')
def backbone_flanks(spark, folder):
    rows = _backbone_flag(C.genes(spark, folder), 0.33)
    return S.backbone_flanks(rows, F.col("bb"), 5).select("genome", "pos", "left", "right")


@query(
    f"""WITH {C.EV}, {BB}, {UNROLL}, {FLANKS},
c AS (SELECT family, "left" AS v, count(*) AS n FROM fl GROUP BY 1, 2),
t AS (SELECT family, sum(n) AS total FROM c GROUP BY 1),
b AS (SELECT family, v, n FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, v) AS r
  FROM c WHERE v IS NOT NULL) WHERE r = 1)
SELECT t.family, CASE WHEN n >= 0.1 * total THEN v END AS "left", total::BIGINT AS total
FROM t LEFT JOIN b ON b.family = t.family"""
)
def flank_consensus(spark, folder):
    rows = _backbone_flag(C.genes(spark, folder), 0.33)
    flanks = S.backbone_flanks(rows, F.col("bb"), 5)
    return S.consensus(flanks, "family", "left", 0.1)


PAIRS = [("click#1", "view#2"), ("error#5", "purchase#0"), ("signup#3", "signup#4"), ("view#7", "click#6")]
PAIR_SQL = "pr(pair, a, b) AS (VALUES " + ", ".join(
    f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(PAIRS)
) + ")"
GEOM = f"""{PAIR_SQL},
cu AS (SELECT e.*, sum(CASE WHEN bb.family IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY genome ORDER BY pos) AS cum,
  sum(CASE WHEN bb.family IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY genome) AS tot,
  CASE WHEN bb.family IS NOT NULL THEN 1 ELSE 0 END AS isb FROM ev e LEFT JOIN bb ON bb.family = e.family),
cc AS (SELECT pair, x.genome, x.length, abs(x.pos - y.pos) AS span,
  CASE WHEN x.pos <= y.pos THEN y.cum - y.isb - x.cum ELSE x.cum - x.isb - y.cum END AS inn,
  CASE WHEN x.pos <= y.pos THEN x.tot - y.cum + x.cum - x.isb ELSE x.tot - x.cum + y.cum - y.isb END AS outr,
  x.spot AS sa, y.spot AS sb
  FROM pr JOIN cu x ON x.family = a JOIN cu y ON y.family = b AND y.genome = x.genome),
geom AS (SELECT pair, genome, min(least(span, length - span)) AS distance,
  min(greatest(CASE WHEN span <= length - span THEN inn ELSE outr END, 0)) AS sep FROM cc GROUP BY 1, 2)"""


def _pairs(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "pair bigint, a string, b string")


def _geometry(spark, folder):
    rows = _backbone_flag(C.genes(spark, folder), BB_SHARE)
    return cut_lineage(S.pair_geometry(rows, _pairs(spark), F.col("bb")))


@query(f"WITH {C.EV}, {BB}, {GEOM} SELECT pair::BIGINT AS pair, genome, distance, sep::BIGINT AS sep FROM geom")
def pair_geometry(spark, folder):
    return _geometry(spark, folder)


@query(
    f"""WITH {C.EV}, {BB}, {GEOM},
h AS (SELECT DISTINCT pair, genome, CASE WHEN family = a THEN 'a' ELSE 'b' END AS side FROM ev JOIN pr ON family IN (a, b)),
al AS (SELECT pair, count(*) FILTER (WHERE sides = 'a') AS alone_a, count(*) FILTER (WHERE sides = 'b') AS alone_b FROM (
  SELECT pair, genome, string_agg(side, '' ORDER BY side) AS sides FROM h GROUP BY 1, 2) GROUP BY 1)
SELECT g.pair::BIGINT AS pair, count(*) AS carriers, round(avg((distance <= 2)::INT), 6) AS near2,
  round(avg((distance <= 10)::INT), 6) AS near10, round(avg((sep >= 2)::INT), 6) AS sep_share,
  quantile_cont(distance, 0.5)::DOUBLE AS median_distance, alone_a, alone_b,
  count(*) >= 10 AND quantile_cont(distance, 0.5) < 5 AS tract,
  count(*) >= 10 AND avg((sep >= 2)::INT) >= 0.5 AND least(alone_a, alone_b) >= 3 AS separate
FROM geom g JOIN al ON al.pair = g.pair GROUP BY g.pair, alone_a, alone_b"""
)
def link_flags(spark, folder):
    from seqweave.operators.regions import link_flags as run

    return run(C.genes(spark, folder), _pairs(spark), _geometry(spark, folder), near=(2, 10), sep=2, tract=5)


def _edits(rows):
    """Edits derived from the codes of the genes."""
    code = F.col("allele")
    op = F.when(code % 11 == 0, "delete").when(code % 11 == 1, "substitute").when(code % 11 == 2, "insert")
    return rows.where(code % 11 <= 2).select("genome", "pos", op.alias("op"), F.lit("new#0").alias("family"))


@query(
    f"""WITH {C.EV},
o AS (SELECT genome, pos * 2 + 1 AS k, CASE WHEN allele % 11 = 1 THEN 'new#0' ELSE family END AS family
  FROM ev WHERE allele % 11 <> 0
  UNION ALL SELECT genome, pos * 2, 'new#0' FROM ev WHERE allele % 11 = 2)
SELECT genome, row_number() OVER (PARTITION BY genome ORDER BY k) - 1 AS pos, family FROM o"""
)
def sequence_edit(spark, folder):
    rows = C.genes(spark, folder)
    return S.edit(rows, _edits(rows))


@query(
    f"""WITH {C.EV},
st AS (SELECT genome, length, unnest(list_distinct(list_append(generate_series(0, greatest(length - 16, 0), 8),
  greatest(length - 16, 0)))) AS s FROM (SELECT DISTINCT genome, length FROM ev)),
c AS (SELECT e.genome, e.pos, s FROM ev e JOIN st USING (genome)
  WHERE e.pos >= s AND e.pos < s + 16 AND (s = 0 OR e.pos - s >= 8 OR s = greatest(e.length - 16, 0)))
SELECT genome, pos, min(s)::BIGINT AS "window" FROM c GROUP BY 1, 2"""
)
def reading_windows(spark, folder):
    return C.genes(spark, folder).select("genome", "pos", S.reading_window(16, 8).alias("window"))


@query(
    f"""WITH {C.CG},
c AS (SELECT genome, contig, count(*) AS n FROM cg GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER w - 1 AS type, coalesce(sum(n) OVER (PARTITION BY genome ORDER BY contig
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, count(*) OVER (PARTITION BY genome) AS k
  FROM c WINDOW w AS (PARTITION BY genome ORDER BY contig))
SELECT genome, (1 + b + type + idx)::BIGINT AS token, 'gene' AS kind, type FROM cg JOIN p USING (genome, contig)
UNION ALL SELECT genome, (1 + b + type + n)::BIGINT, CASE WHEN type = k - 1 THEN 'end' ELSE 'sep' END, type FROM p
UNION ALL SELECT genome, 0, 'start', type FROM p WHERE type = 0"""
)
def token_layout(spark, folder):
    return S.token_layout(C.contig_genes(spark, folder))


@query(
    f"""WITH {C.EV}, m AS (SELECT family, allele AS modal FROM (SELECT family, allele, row_number() OVER (
  PARTITION BY family ORDER BY count(*) DESC, allele) AS r FROM ev GROUP BY 1, 2) WHERE r = 1)
SELECT genome, pos, modal AS allele, allele <> modal AS changed FROM ev JOIN m USING (family)"""
)
def modal_alleles(spark, folder):
    rows = C.genes(spark, folder)
    modal = G.mode_by(rows, "family", "allele", "modal")
    return rows.join(modal, "family").select(
        "genome", "pos", F.col("modal").alias("allele"), (F.col("allele") != F.col("modal")).alias("changed")
    )


@query(
    f"""WITH {C.EV}, {BB} SELECT genome, pos, last_value(CASE WHEN bb.family IS NOT NULL THEN pos END IGNORE NULLS)
  OVER (PARTITION BY genome ORDER BY pos) AS anchor_pos FROM ev LEFT JOIN bb ON bb.family = ev.family"""
)
def last_anchor(spark, folder):
    """As-of join: the last backbone gene at or before each gene."""
    rows = _backbone_flag(C.genes(spark, folder), BB_SHARE)
    out = T.carry_last(rows, ["genome"], F.when(F.col("bb"), F.col("pos")), "anchor_pos")
    return out.select("genome", "pos", "anchor_pos")


@query(
    f"""WITH {C.EV}, {BLOCKS} SELECT e.genome, e.pos, count(*) AS blocks FROM ev e
JOIN blocks b ON b.genome = e.genome AND e.pos BETWEEN b.start AND b."end" GROUP BY 1, 2"""
)
def genes_in_blocks(spark, folder):
    blocks = S.circular_blocks(_members(spark, folder), ["name", "genome"], gap=6)
    inside = S.containing_interval(C.genes(spark, folder).select("genome", "pos"), blocks.select("genome", "start", "end"))
    return inside.groupBy("genome", "pos").agg(F.count(F.lit(1)).alias("blocks"))


@query(
    f"""WITH {C.EV},
j AS (SELECT a.genome, a.pos AS id, b.pos - a.pos AS "offset", b.pos AS ref, row_number() OVER (
  PARTITION BY a.genome, a.pos ORDER BY CASE b.pos - a.pos WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN -1 THEN 2 WHEN 2 THEN 3 ELSE 4 END) AS r
  FROM ev a JOIN ev b ON b.genome = a.genome + 1 AND b.family = a.family AND b.pos BETWEEN a.pos - 2 AND a.pos + 2)
SELECT genome, id, "offset", ref FROM j WHERE r = 1"""
)
def tolerance_match(spark, folder):
    """Each gene with the gene of the same family near the same place of the next genome."""
    rows = C.genes(spark, folder)
    left = rows.select("genome", "family", "pos", F.col("pos").alias("id"))
    right = rows.select((F.col("genome") - 1).alias("genome"), "family", "pos", F.col("pos").alias("ref"))
    return S.tolerance_match(left, right, ["genome", "family"], [0, 1, -1, 2, -2]).select(
        "genome", "id", "offset", "ref"
    )
