"""Claims of generated readings, held against the facts lines of the window.

Every column gets sentences with a range, bound numbers, comparisons and partitions; which of them are right follows
from the data, not from how they were made.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import claims as K
from seqweave.operators import facts as X
from seqweave.operators import graph as G
from seqweave.operators import interpretation as I
from seqweave.plans import corpus as C
from seqweave.plans.facts_queries import NUMS, lines
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


def facts(known):
    """role, locus, value of the facts lines, and gene, locus of their families."""
    own = X.numbers(known, "locus").select("role", F.col("locus").cast("bigint").alias("locus"), F.col("value").cast(K.EXACT).alias("value"))
    return cut_lineage(own), known.select(F.col("top").alias("gene"), F.col("locus").cast("bigint").alias("locus"))


def families(spark, folder):
    """locus, family, partition of all families of the window: persistent from 40 carriers in 100 genomes, shell from 20."""
    rows = C.genes(spark, folder)
    genomes = rows.groupBy("genome").agg(F.lit(1)).agg(F.count(F.lit(1)).cast("double")).scalar()
    share = F.col("carriers") / genomes
    part = F.when(share >= 0.4, "persistent").when(share >= 0.2, "shell").otherwise("cloud")
    return G.nodes(rows.where(F.col("pos") < C.WINDOW)).select("locus", "family", part.alias("partition"))


SENTENCES = """w0 AS (SELECT locus AS k, top, role, value::BIGINT AS v FROM nm JOIN lines USING (line_id, locus) WHERE role <> 'bits'),
w1 AS (SELECT k, top, max(v) FILTER (WHERE role = 'share') AS sh, max(v) FILTER (WHERE role = 'named') AS na, max(v) FILTER (WHERE role = 'RGP') AS rg FROM w0 GROUP BY 1, 2),
w2 AS (SELECT k, top, sh, na, rg, coalesce(lead(sh) OVER o, sh) AS sh2, lead(na) OVER o AS na2, coalesce(lead(k) OVER o, k) AS k2 FROM w1 WINDOW o AS (ORDER BY k)),
sen AS (SELECT k AS text_id, 0::BIGINT AS nth, 'columns ' || k || ' to ' || k2 || ' show a share ' || CASE WHEN k % 3 = 1 THEN 'from ' ELSE '' END
    || least(sh, sh2) + CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END || ' to ' || greatest(sh, sh2) || '%' AS text FROM w2
  UNION ALL SELECT k, 1, CASE WHEN k % 2 = 0 THEN 'column ' || k ELSE '`' || top || '`' END || ', carried by ' || CASE WHEN k % 4 = 3 THEN sh2 ELSE sh END || '%' FROM w2
  UNION ALL SELECT k, 2, 'column ' || k || ' has ' || CASE k % 3 WHEN 0 THEN 'a higher' WHEN 1 THEN 'a lower' ELSE 'the same' END || CASE WHEN k % 2 = 0 THEN ' share' ELSE ' bits' END
    || CASE k % 3 WHEN 2 THEN ' as' ELSE ' than' END || ' column ' || k2 || ', named ' || CASE WHEN k % 2 = 0 THEN 'rising' ELSE 'falling' END || ' from column ' || k || ' to column ' || k2 FROM w2
  UNION ALL SELECT k, 3, CASE k % 3 WHEN 0 THEN 'all' WHEN 1 THEN '1' ELSE '2' END || CASE WHEN k % 2 = 0 THEN ' shell' ELSE ' cloud' END
    || CASE k % 3 WHEN 0 THEN '' ELSE ' families' END || ' in columns ' || k || ' to ' || k2 FROM w2
  UNION ALL SELECT k, 4, CASE k % 4 WHEN 0 THEN 'most hesitant' WHEN 1 THEN 'fewest named' WHEN 2 THEN 'most carried' ELSE 'least carried' END || ' at column ' || k
    || ', least carried at column ' || k2 FROM w2
  UNION ALL SELECT k, 5, '`' || top || '` at column ' || CASE WHEN k % 3 = 0 THEN k2 ELSE k END FROM w2)"""


def sentences(facts_, genes):
    """text_id, nth, text, cites: six sentences a column."""
    value = lambda role: F.max(F.when(F.col("role") == role, F.col("value"))).cast("bigint")
    rows = facts_.groupBy("locus").agg(value("share").alias("sh")).join(genes, "locus")
    # The columns of one window, in their order.
    after = F.expr("struct(lead(locus) over (order by locus) as k, lead(sh) over (order by locus) as sh)")
    rows = rows.select(F.col("locus").alias("k"), F.col("gene").alias("top"), "sh", after.alias("n")).select(
        "k", "top", "sh", F.coalesce("n.k", "k").alias("k2"), F.coalesce("n.sh", "sh").alias("sh2"))
    text = lambda c: F.col(c).cast("string")
    k = F.col("k")
    word = lambda m, *options: F.element_at(F.array(*[F.lit(o) for o in options]), (k % m + 1).cast("int"))
    said = [
        F.concat(F.lit("columns "), text("k"), F.lit(" to "), text("k2"), F.lit(" show a share "), word(3, "", "from ", ""),
                 (F.least("sh", "sh2") + F.when(k % 5 == 0, 3).otherwise(0)).cast("string"), F.lit(" to "), F.greatest("sh", "sh2").cast("string"), F.lit("%")),
        F.concat(F.when(k % 2 == 0, F.concat(F.lit("column "), text("k"))).otherwise(F.concat(F.lit("`"), F.col("top"), F.lit("`"))),
                 F.lit(", carried by "), F.when(k % 4 == 3, F.col("sh2")).otherwise(F.col("sh")).cast("string"), F.lit("%")),
        F.concat(F.lit("column "), text("k"), F.lit(" has "), word(3, "a higher", "a lower", "the same"), word(2, " share", " bits"),
                 word(3, " than", " than", " as"), F.lit(" column "), text("k2"), F.lit(", named "), word(2, "rising", "falling"),
                 F.lit(" from column "), text("k"), F.lit(" to column "), text("k2")),
        F.concat(word(3, "all", "1", "2"), word(2, " shell", " cloud"), word(3, "", " families", " families"), F.lit(" in columns "), text("k"), F.lit(" to "), text("k2")),
        F.concat(word(4, "most hesitant", "fewest named", "most carried", "least carried"), F.lit(" at column "), text("k"),
                 F.lit(", least carried at column "), text("k2")),
        F.concat(F.lit("`"), F.col("top"), F.lit("` at column "), F.when(k % 3 == 0, text("k2")).otherwise(text("k"))),
    ]
    out = rows.select(k.alias("text_id"), F.posexplode(F.array(*said)).alias("nth", "text"))
    return cut_lineage(out.select("text_id", F.col("nth").cast("bigint").alias("nth"), "text", F.array().cast("array<string>").alias("cites")))


def _all(spark, folder):
    known, genes = facts(lines(spark, folder))
    return sentences(known, genes), known, genes


FACTS = f"""{NUMS}, {SENTENCES}, fa AS (SELECT role, locus, value::DECIMAL(18,6) AS v FROM nm)"""


def _match(pattern: str, groups: list[str]) -> str:
    doubled = pattern.replace("'", "''")
    parts = ", ".join(f"unnest(regexp_extract_all(text, '{doubled}', {i + 1})) AS {g}" for i, g in enumerate(groups))
    return f"SELECT text_id, nth, {parts} FROM sen"


@query(
    f"""WITH {C.CALLS}, {FACTS}, c AS ({_match(K.RANGE, ["f", "l", "role", "word", "lo", "hi"])}),
t AS (SELECT text_id, nth, role, f::BIGINT AS first, l::BIGINT AS last, word, lo::DECIMAL(18,6) AS low, hi::DECIMAL(18,6) AS high FROM c),
m AS (SELECT t.*, (SELECT min(v) FROM fa WHERE fa.role = t.role AND locus BETWEEN least(first, last) AND greatest(first, last)) AS mn,
  (SELECT max(v) FROM fa WHERE fa.role = t.role AND locus BETWEEN least(first, last) AND greatest(first, last)) AS mx,
  (SELECT max(v) FROM fa WHERE fa.role = t.role AND locus = first) AS vf, (SELECT max(v) FROM fa WHERE fa.role = t.role AND locus = last) AS vl FROM t)
SELECT text_id, nth, 0::BIGINT AS "at", role, first, last, low::DOUBLE AS low, high::DOUBLE AS high,
  coalesce((low = vf AND high = vl) OR (coalesce(word, '') = '' AND least(low, high) = mn AND greatest(low, high) = mx), false) AS supported FROM m"""
)
def range_claims(spark, folder):
    said, known, _ = _all(spark, folder)
    return K.range_claims(said, known)


@query(
    f"""WITH {C.CALLS}, {FACTS}, c AS ({_match(K.BOUND, ["k", "g", "v"])}),
t AS (SELECT text_id, nth, CASE WHEN k <> '' THEN k::BIGINT END AS locus, nullif(g, '') AS gene, v::DECIMAL(18,6) AS value FROM c)
SELECT text_id, nth, 0::BIGINT AS "at", locus, gene, value::DOUBLE AS value, EXISTS (SELECT 1 FROM fa JOIN lines USING (locus)
  WHERE role = 'share' AND v = value AND (fa.locus = t.locus OR top = gene)) AS supported FROM t"""
)
def bound_numbers(spark, folder):
    said, known, genes = _all(spark, folder)
    return K.bound_numbers(said, known, genes)


@query(
    f"""WITH {C.CALLS}, {FACTS}, c AS (SELECT text_id, nth, 0::BIGINT AS "at", role, f::BIGINT AS first, l::BIGINT AS last,
    CASE word WHEN 'a higher' THEN 1 WHEN 'a lower' THEN -1 ELSE 0 END AS said FROM ({_match(K.COMPARE, ["f", "word", "role", "l"])})
  UNION ALL SELECT text_id, nth, 1000, role, f::BIGINT, l::BIGINT, CASE word WHEN 'falling' THEN 1 ELSE -1 END FROM ({_match(K.TREND, ["role", "word", "f", "l"])}))
SELECT c.text_id, c.nth, c."at", c.role, first, last, said::BIGINT AS said,
  coalesce(said = CASE WHEN abs(a.v - b.v) <= 0.02 THEN 0 ELSE sign(a.v - b.v) END, false) AS holds
FROM c LEFT JOIN fa a ON a.role = c.role AND a.locus = first LEFT JOIN fa b ON b.role = c.role AND b.locus = last"""
)
def comparison_claims(spark, folder):
    said, known, _ = _all(spark, folder)
    return K.comparison_claims(said, known)


@query(
    f"""WITH {C.CALLS}, {FACTS}, pt AS (SELECT locus, family, CASE WHEN carriers / g >= 0.4 THEN 'persistent' WHEN carriers / g >= 0.2 THEN 'shell' ELSE 'cloud' END AS part FROM nl, g),
c AS ({_match(K.PARTITION, ["said", "part", "f", "l"])}), t AS (SELECT text_id, nth, said, part AS partition, f::BIGINT AS first, l::BIGINT AS last FROM c),
m AS (SELECT t.*, (SELECT count(DISTINCT family) FROM pt WHERE locus BETWEEN least(first, last) AND greatest(first, last)) AS n,
  (SELECT count(DISTINCT family) FROM pt WHERE pt.part = t.partition AND locus BETWEEN least(first, last) AND greatest(first, last)) AS matching FROM t)
SELECT text_id, nth, 0::BIGINT AS "at", said, partition, first, last, n, matching, CASE said WHEN 'all' THEN n > 0 AND n = matching ELSE matching >= TRY_CAST(said AS BIGINT) END AS holds FROM m"""
)
def partition_claims(spark, folder):
    said, _, _ = _all(spark, folder)
    return K.partition_claims(said, families(spark, folder))


@query(
    f"""WITH {C.CALLS}, {FACTS}, m AS (SELECT text_id, nth, unnest(range(0, len(w))) AS "at", unnest(w) AS said, unnest(l)::BIGINT AS locus FROM (
    SELECT text_id, nth, regexp_extract_all(text, '{K.EXTREME}', 1) AS w, regexp_extract_all(text, '{K.EXTREME}', 2) AS l FROM sen)),
r AS (SELECT *, CASE said WHEN 'most hesitant' THEN 'bits' WHEN 'fewest named' THEN 'named' ELSE 'share' END AS role FROM m)
SELECT text_id, nth, "at", said, r.locus, coalesce((SELECT max(v) FROM fa WHERE fa.role = r.role AND fa.locus = r.locus) =
  CASE WHEN said LIKE 'most%' THEN (SELECT max(v) FROM fa WHERE fa.role = r.role) ELSE (SELECT min(v) FROM fa WHERE fa.role = r.role) END, false) AS holds FROM r"""
)
def extreme_claims(spark, folder):
    said, known, _ = _all(spark, folder)
    return K.extreme_claims(said, known)


@query(
    f"""WITH {C.CALLS}, {FACTS}, c AS ({_match(K.PLACED, ["gene", "l"])})
SELECT text_id, nth, 0::BIGINT AS "at", gene, l::BIGINT AS locus, EXISTS (SELECT 1 FROM lines WHERE top = gene AND lines.locus = l::BIGINT) AS holds FROM c"""
)
def placed_genes(spark, folder):
    said, _, genes = _all(spark, folder)
    return K.placed_genes(said, genes)


def _stemmed(text: str) -> str:
    words = f"regexp_extract_all({text}, '[A-Za-z][A-Za-z''-]{{3,}}')"
    return f"list_distinct(list_transform({words}, lambda w: regexp_replace(lower(w), '{I.STEM}', '\\1')))"


@query(
    f"""WITH f AS (SELECT p_size::BIGINT AS text_id, min_by(p_type, p_partkey) || ' ' || max_by(p_type, p_partkey) AS t, split_part(min_by(p_type, p_partkey), ' ', 1) AS c FROM part GROUP BY 1),
x AS (SELECT text_id, 'Parts of this size are [[' || lower(t) || CASE WHEN text_id % 4 = 0 THEN ' wares' ELSE '' END || ']].' AS text, c FROM f),
ab AS (SELECT DISTINCT text_id, p_brand AS family FROM x JOIN part ON p_size = text_id AND split_part(p_type, ' ', 1) = c),
ix AS (SELECT DISTINCT p_brand AS family, unnest({_stemmed('p_type')}) AS stem FROM part),
ph AS (SELECT text_id, regexp_extract(text, '\\[\\[(.+?)\\]\\]', 1) AS phrase FROM x),
ws AS (SELECT text_id, phrase, len(regexp_extract_all(phrase, '[A-Za-z0-9][A-Za-z0-9''_-]*')) AS words, {_stemmed('phrase')} AS st FROM ph),
hi AS (SELECT w.text_id, count(DISTINCT ab.family) AS hits, count(DISTINCT ix.stem) AS known FROM (SELECT text_id, unnest(st) AS stem FROM ws) w
  JOIN ix USING (stem) JOIN ab ON ab.text_id = w.text_id AND ab.family = ix.family GROUP BY 1),
n AS (SELECT text_id, count(*) AS families FROM ab GROUP BY 1)
SELECT ws.text_id, 0::BIGINT AS "at", phrase, words, coalesce(families, 0) AS families, coalesce(hits, 0) AS hits, len(st) - coalesce(known, 0) AS unknown,
  words BETWEEN 2 AND 6 AND len(st) > 0 AND len(st) = coalesce(known, 0) AND coalesce(families, 0) > 0 AND coalesce(hits, 0) >= 0.5 * coalesce(families, 0) AS fits
FROM ws LEFT JOIN hi USING (text_id) LEFT JOIN n USING (text_id)"""
)
def interpretation_fit(spark, folder):
    """What is said of the parts of a size, against the types of the brands that make them."""
    parts = table(spark, folder, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    first = parts.groupBy(F.col("p_size").alias("text_id")).agg(
        F.concat_ws(" ", F.min_by("p_type", "p_partkey"), F.max_by("p_type", "p_partkey")).alias("t")).withColumn("c", F.substring_index("t", " ", 1))
    phrase = F.lower("t")
    text = F.concat(F.lit("Parts of this size are [["), phrase, F.when(F.col("text_id") % 4 == 0, " wares").otherwise(""), F.lit("]]."))
    texts = first.select("text_id", text.alias("text"))
    cited = first.join(parts, (F.col("p_size") == F.col("text_id")) & (F.substring_index("p_type", " ", 1) == F.col("c"))).select("text_id", F.col("p_brand").alias("family"))
    return I.interpretation_fit(texts, cited, parts.select(F.col("p_brand").alias("family"), F.col("p_type").alias("product")).distinct())
