"""Window facts and the checking of texts that cite them.

The texts are made from the facts themselves, some with a wrong number, name,
column or order, so that every check has something to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import facts as X
from seqweave.operators import graph as G
from seqweave.plans import corpus as C
from seqweave.plans.graph_queries import NODES, READ
from seqweave.operators import decoder as D
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


COLS = NODES + """,
nl AS (SELECT locus, n.family, carriers, (SELECT avg(in_rgp::INT) FROM w WHERE w.family = n.family) AS rgp FROM nodes n JOIN loc USING (family)),
rk AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY carriers DESC, family) AS r FROM nl),
g AS (SELECT count(DISTINCT genome)::DOUBLE AS g FROM ev),
cols AS (SELECT locus, max(family) FILTER (WHERE r = 1) AS top, max(family) FILTER (WHERE r = 2) AS second,
  max(carriers) FILTER (WHERE r = 1) / any_value(g) AS s1, coalesce(max(carriers) FILTER (WHERE r = 2), 0) / any_value(g) AS s2,
  coalesce(max(carriers) FILTER (WHERE r = 2), 0) AS n2, sum(carriers * rgp) / sum(carriers) AS rgp FROM rk, g GROUP BY 1),
ck AS (SELECT *, CASE WHEN s1 >= 0.45 THEN 'spine' WHEN s2 >= 0.38 THEN 'fork' ELSE 'variable' END AS kind FROM cols),
cs AS (SELECT *, CASE WHEN kind = lag(kind) OVER (ORDER BY locus) AND locus = lag(locus) OVER (ORDER BY locus) + 1 THEN 0 ELSE 1 END AS st FROM ck),
cr AS (SELECT *, sum(st) OVER (ORDER BY locus) AS run FROM cs)"""


def columns(spark, folder):
    rows = C.genes(spark, folder)
    window = rows.where(F.col("pos") < C.WINDOW)
    nodes = G.nodes(window).select("locus", "family", "carriers", "rgp")
    genomes = rows.groupBy("genome").agg(F.lit(1)).agg(F.count(F.lit(1)).cast("double")).scalar()
    kinds = X.column_kinds(cut_lineage(nodes), genomes, 0.45, 0.38)
    return cut_lineage(X.column_runs(kinds.withColumn("n2", F.round(F.col("s2") * genomes).cast("bigint"))))


@query(
    f"""WITH {C.EV}, {COLS} SELECT locus, top, second, round(s1, 6) AS s1, round(s2, 6) AS s2, round(rgp, 6) AS rgp, kind, run::BIGINT AS run FROM cr"""
)
def column_kinds(spark, folder):
    out = columns(spark, folder)
    for name in ("s1", "s2", "rgp"):
        out = out.withColumn(name, F.round(name, 6))
    return out.drop("n2")


@query(
    f"""WITH {C.EV}, {COLS}, p AS (SELECT locus, split_part(top, '#', 1) AS prefix FROM cr),
s AS (SELECT *, CASE WHEN prefix = lag(prefix) OVER (ORDER BY locus) AND locus = lag(locus) OVER (ORDER BY locus) + 1 THEN 0 ELSE 1 END AS st FROM p),
q AS (SELECT *, sum(st) OVER (ORDER BY locus) AS run FROM s)
SELECT prefix, min(locus) AS first, max(locus) AS last, count(*) AS n FROM q GROUP BY prefix, run HAVING count(*) >= 2"""
)
def prefix_groups(spark, folder):
    return X.prefix_groups(columns(spark, folder), F.substring_index("top", "#", 1), 2)


@query(
    f"""WITH {C.TR}, {COLS}, e AS (SELECT prev, family, count(DISTINCT genome) AS genomes FROM tr WHERE prev IS NOT NULL AND pos < 20 GROUP BY 1, 2)
SELECT a.locus, a.second, b.second AS next FROM ck a JOIN ck b ON b.locus = a.locus + 1 JOIN e ON e.prev = a.second AND e.family = b.second
WHERE a.kind = 'fork' AND b.kind = 'fork' AND genomes >= 0.02 * least(a.n2, b.n2)"""
)
def parallel_branches(spark, folder):
    window = C.genes(spark, folder).where(F.col("pos") < C.WINDOW)
    return X.parallel_branches(columns(spark, folder), G.edges(window), 0.02)


LINES = f"""{COLS}, {READ.split("WITH ")[-1]},
cl AS (SELECT pos AS locus, avg(hit::INT) AS named, avg(entropy) AS entropy FROM decoded WHERE pos < 20 GROUP BY 1),
lines AS (SELECT 'S' || run || '.c' || locus AS line_id, locus, top, kind, 'column ' || locus || ': `' || top || '` share ' || round(s1 * 100)::BIGINT || '%, named '
  || round(named * 100)::BIGINT || '%, ' || (round(entropy * 100)::BIGINT // 100) || '.' || lpad((round(entropy * 100)::BIGINT % 100)::VARCHAR, 2, '0')
  || ' bits; RGP ' || round(rgp * 100)::BIGINT || '%' AS text FROM cr JOIN cl USING (locus))"""


def lines(spark, folder):
    calls = C.calls(spark, folder)
    read = D.decode(calls, D.decoder(calls, "half")).where(F.col("pos") < C.WINDOW)
    per = read.groupBy(F.col("pos").alias("locus")).agg(
        F.avg(F.col("hit").cast("double")).alias("named"), F.avg("entropy").alias("entropy")
    )
    return cut_lineage(X.column_lines(columns(spark, folder), per))


@query(f"WITH {C.CALLS}, {LINES} SELECT line_id, locus, top, kind, text FROM lines")
def facts_lines(spark, folder):
    return lines(spark, folder)


NUMS = LINES + """,
ln AS (SELECT line_id, locus, unnest(regexp_extract_all(text, '(?:(RGP|named|share) )?(\\d+(?:\\.\\d+)?)(%| bits| families)', 1)) AS word,
  unnest(regexp_extract_all(text, '(?:(RGP|named|share) )?(\\d+(?:\\.\\d+)?)(%| bits| families)', 2)) AS value,
  unnest(regexp_extract_all(text, '(?:(RGP|named|share) )?(\\d+(?:\\.\\d+)?)(%| bits| families)', 3)) AS unit FROM lines),
nm AS (SELECT line_id, locus, CASE WHEN trim(unit) = 'bits' THEN 'bits' WHEN trim(unit) = 'families' THEN 'count' WHEN word <> '' THEN word ELSE 'share' END AS role, value FROM ln)"""


@query(f"WITH {C.CALLS}, {NUMS} SELECT line_id, role, value FROM nm")
def cited_numbers(spark, folder):
    return X.numbers(lines(spark, folder), "line_id").select("line_id", "role", "value")


ALLOWED = NUMS + """,
al0 AS (SELECT line_id, role, value::DECIMAL(18,6) AS own, unnest(CASE WHEN role = 'bits' THEN [value::DECIMAL(18,6)::DOUBLE, round(value::DECIMAL(18,6)::DOUBLE, 1), round_even(value::DOUBLE, 1)]
  ELSE [value::DOUBLE, round(value::DOUBLE, 1), round_even(value::DOUBLE, 1), round(value::DOUBLE), round_even(value::DOUBLE, 0)] END) AS a FROM nm),
alw AS (SELECT DISTINCT line_id, role, a::DECIMAL(18,6) AS allowed FROM al0 WHERE NOT (a IN (0, 100) AND a <> own::DOUBLE AND role NOT IN ('bits', 'count')))"""


@query(f"WITH {C.CALLS}, {ALLOWED} SELECT line_id, role, allowed::DOUBLE AS allowed FROM alw")
def allowed_values(spark, folder):
    return X.allowed_values(X.numbers(lines(spark, folder), "line_id"))


TEXTS = ALLOWED + """,
wr AS (SELECT line_id, locus, top, kind, text, regexp_extract(text, 'share (\\d+)%', 1)::BIGINT AS sh, regexp_extract(text, '(\\d+\\.\\d+) bits', 1) AS bits FROM lines),
sen AS (SELECT locus AS text_id, 0::BIGINT AS nth, '`' || CASE WHEN locus % 5 = 2 THEN 'nowhere#1' ELSE top END || '` has share ' || CASE WHEN locus % 4 = 1 THEN sh + 7 ELSE sh END || '%'
    || CASE WHEN locus % 3 = 0 THEN ', most stable' ELSE '' END AS text, line_id FROM wr
  UNION ALL SELECT locus, 1, 'Then the ' || CASE WHEN locus % 6 = 3 THEN 'spine' ELSE kind END || ' column ' || CASE WHEN locus % 7 = 4 THEN locus + 1 ELSE locus END
    || ' shows ' || left(bits, length(bits) - 1) || ' bits, most hesitant at column ' || locus, line_id FROM wr)"""


def texts(lines_):
    """Two sentences per column, some of them wrong."""
    k = F.col("locus")
    share = F.regexp_extract("text", r"share (\d+)%", 1).cast("bigint")
    bits = F.regexp_extract("text", r"(\d+\.\d+) bits", 1)
    cite = F.concat(F.lit(" {"), F.col("line_id"), F.lit("}"))
    first = F.concat(
        F.lit("`"), F.when(k % 5 == 2, "nowhere#1").otherwise(F.col("top")), F.lit("` has share "),
        F.when(k % 4 == 1, share + 7).otherwise(share).cast("string"), F.lit("%"),
        F.when(k % 3 == 0, ", most stable").otherwise(""), cite,
    )
    second = F.concat(
        F.lit(". Then the "), F.when(k % 6 == 3, "spine").otherwise(F.col("kind")), F.lit(" column "),
        F.when(k % 7 == 4, k + 1).otherwise(k).cast("string"), F.lit(" shows "),
        F.expr("left(regexp_extract(text, '(\\\\d+\\\\.\\\\d+) bits', 1), length(regexp_extract(text, '(\\\\d+\\\\.\\\\d+) bits', 1)) - 1)"),
        F.lit(" bits, most hesitant at column "), k.cast("string"), cite,
    )
    return lines_.select(k.alias("text_id"), F.concat(first, second).alias("body"))


@query(f"WITH {C.CALLS}, {TEXTS} SELECT text_id, nth, text, line_id AS cites FROM sen")
def cited_sentences(spark, folder):
    cut = X.sentences(texts(lines(spark, folder)))
    return cut.select("text_id", "nth", "text", F.array_join("cites", ",").alias("cites"))


SAID = TEXTS + """,
sn AS (SELECT text_id, nth, line_id, unnest(regexp_extract_all(text, '(?:(RGP|named|share) )?(\\d+(?:\\.\\d+)?)(%| bits| families)', 1)) AS word,
  unnest(regexp_extract_all(text, '(?:(RGP|named|share) )?(\\d+(?:\\.\\d+)?)(%| bits| families)', 2)) AS value,
  unnest(regexp_extract_all(text, '(?:(RGP|named|share) )?(\\d+(?:\\.\\d+)?)(%| bits| families)', 3)) AS unit FROM sen),
sr AS (SELECT text_id, nth, line_id, CASE WHEN trim(unit) = 'bits' THEN 'bits' WHEN word <> '' THEN word ELSE 'share' END AS role, value FROM sn),
badn AS (SELECT text_id, nth, role, value FROM sr WHERE NOT EXISTS (SELECT 1 FROM alw WHERE alw.line_id = sr.line_id AND alw.role = sr.role AND alw.allowed = sr.value::DECIMAL(18,6)))"""


@query(f"WITH {C.CALLS}, {SAID} SELECT text_id, nth, role, value FROM badn")
def unsupported_numbers(spark, folder):
    known = lines(spark, folder)
    return X.unsupported_numbers(X.sentences(texts(known)), known)


@query(f"WITH {C.CALLS}, {TEXTS} SELECT locus AS text_id, 0::BIGINT AS nth, 'nowhere#1' AS name FROM wr WHERE locus % 5 = 2")
def unsupported_names(spark, folder):
    known = lines(spark, folder)
    return X.unsupported_names(X.sentences(texts(known)), known)


@query(
    f"""WITH {C.CALLS}, {TEXTS} SELECT locus AS text_id, 1::BIGINT AS nth, CASE WHEN locus % 7 = 4 THEN locus + 1 ELSE locus END AS locus,
  CASE WHEN locus % 7 = 4 THEN 'not covered' ELSE 'kind' END AS why FROM wr WHERE locus % 7 = 4 OR (locus % 6 = 3 AND kind <> 'spine')"""
)
def unsupported_columns(spark, folder):
    known = lines(spark, folder)
    return X.unsupported_columns(X.sentences(texts(known)), known)


@query(f"WITH {C.CALLS}, {TEXTS} SELECT text_id, nth, 'superlative' AS fault FROM sen WHERE contains(text, 'most stable')")
def wording_faults(spark, folder):
    return X.wording_faults(X.sentences(texts(lines(spark, folder))))


@query(f"WITH {C.CALLS}, {TEXTS} SELECT locus AS text_id, 1::BIGINT AS nth, locus FROM wr WHERE bits::DOUBLE < (SELECT max(bits::DOUBLE) FROM wr)")
def false_extremes(spark, folder):
    known = lines(spark, folder)
    return X.false_extremes(X.sentences(texts(known)), known)


@query(
    f"""WITH {C.CALLS}, {SAID}, gd AS (SELECT * FROM sen WHERE (text_id, nth) NOT IN (SELECT (text_id, nth) FROM badn))
SELECT text_id, count(*) AS kept, string_agg(text, '. ' ORDER BY nth) AS body FROM gd GROUP BY 1"""
)
def kept_sentences(spark, folder):
    known = lines(spark, folder)
    cut = X.sentences(texts(known))
    return X.kept_sentences(cut, X.unsupported_numbers(cut, known), 60)


@query("SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(translate(text, '“”‘’–‑ ', '\"\"''''-- '), '\\s+', ' ', 'g'), ' +([.,;:!?%])', '\\1', 'g'))) AS tidy FROM conversations")
def tidy_texts(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", F.md5(X.tidy(F.col("text"))).alias("tidy"))


WORDED = COLS + """,
wd AS (SELECT locus, run, list_distinct([split_part(top, '#', 1), kind, 'class' || (ascii(right(top, 1)) % 3)]) AS words,
  list_distinct([split_part(second, '#', 1), 'class' || (ascii(right(second, 1)) % 3)]) AS others FROM cr),
sp AS (SELECT locus, unnest(words) AS word FROM wd)"""


def _words(family, *more):
    name, digit = F.substring_index(family, "#", 1), (F.ascii(F.right(F.col(family), F.lit(1))) % 3).cast("string")
    return F.array_distinct(F.array(name, *more, F.concat(F.lit("class"), digit)))


@query(
    f"""WITH {C.EV}, {WORDED},
nw AS (SELECT *, CASE WHEN locus - lag(locus) OVER o > 2 THEN 1 ELSE 0 END AS n FROM sp WHERE length(word) >= 5 WINDOW o AS (PARTITION BY word ORDER BY locus)),
rn AS (SELECT *, sum(n) OVER (PARTITION BY word ORDER BY locus) AS run FROM nw),
fd AS (SELECT word, min(locus) AS first, max(locus) AS last, count(*) AS hits FROM rn GROUP BY word, run HAVING count(*) >= 3 AND count(*) >= 0.6 * (max(locus) - min(locus) + 1)),
mn AS (SELECT f.word, first, last, hits, s.word AS said, count(*) AS n FROM fd f JOIN sp s ON s.locus BETWEEN first AND last AND length(s.word) >= 4
  GROUP BY ALL HAVING count(*) >= 2 AND count(*) >= 0.5 * (last - first + 1))
SELECT word, first, last, hits, array_to_string(list(said ORDER BY n DESC, said)[1:4], ',') AS words FROM mn GROUP BY ALL"""
)
def word_groups(spark, folder):
    """Stretches of columns whose families share a word."""
    rows = columns(spark, folder).select("locus", _words("top", F.col("kind")).alias("words"))
    return X.word_groups(cut_lineage(rows)).withColumn("words", F.array_join("words", ","))


@query(
    f"""WITH {C.EV}, {WORDED}, b AS (SELECT run AS branch, locus, unnest(others) AS said FROM wd),
z AS (SELECT run AS branch, count(*) AS size, min(locus) AS first, max(locus) AS last FROM wd GROUP BY 1),
m AS (SELECT b.branch, said, count(*) AS n, any_value(first) AS first, any_value(last) AS last FROM b JOIN z USING (branch) WHERE length(said) >= 4
  GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) >= 0.3 * any_value(size))
SELECT branch::BIGINT AS branch, first, last, array_to_string(list(said ORDER BY n DESC, said)[1:4], ',') AS words FROM m GROUP BY 1, 2, 3"""
)
def branch_groups(spark, folder):
    """Words on which the second families of a run of columns agree."""
    rows = columns(spark, folder).select(F.col("run").alias("branch"), "locus", _words("second").alias("words"))
    return X.branch_groups(cut_lineage(rows), 0.3).withColumn("words", F.array_join("words", ","))


@query(
    f"""WITH {C.CALLS}, {LINES}, n AS (SELECT locus, line_id, coalesce(lead(line_id) OVER (ORDER BY locus), line_id) AS following FROM lines),
s AS (SELECT locus AS text_id, 0::BIGINT AS nth, 'It opens' AS text, CASE WHEN locus % 2 = 0 THEN following ELSE line_id END AS cites FROM n
  UNION ALL SELECT locus, 1, CASE WHEN locus % 4 = 0 THEN 'And on' ELSE 'Then on' END, CASE WHEN locus % 2 = 0 THEN line_id ELSE following END FROM n),
c AS (SELECT *, regexp_extract(cites, '\\.c(\\d+)$', 1)::BIGINT AS col FROM s)
SELECT b.text_id, b.nth FROM c a JOIN c b ON b.text_id = a.text_id AND b.nth = a.nth + 1 WHERE regexp_matches(b.text, '(?i)\\b(then|after)\\b') AND b.col < a.col"""
)
def order_faults(spark, folder):
    """Sentences that claim to go on but cite columns before those of the sentence before."""
    # the columns of one window, in their order
    known = lines(spark, folder).select("locus", "line_id", F.expr("coalesce(lead(line_id) over (order by locus), line_id) as following"))
    k = F.col("locus")
    said = lambda nth, text, cite: F.struct(F.lit(nth).alias("nth"), text.alias("text"), F.array(cite).alias("cites"))
    first = said(0, F.lit("It opens"), F.when(k % 2 == 0, F.col("following")).otherwise(F.col("line_id")))
    second = said(1, F.when(k % 4 == 0, "And on").otherwise("Then on"), F.when(k % 2 == 0, F.col("line_id")).otherwise(F.col("following")))
    cut = known.select(k.alias("text_id"), F.explode(F.array(first, second)).alias("s")).select("text_id", "s.nth", "s.text", "s.cites")
    return X.backward_order(cut)
