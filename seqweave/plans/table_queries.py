"""Metadata, search, export and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.functions import columns as fc
from seqweave.functions import vocab
from seqweave.operators import decoder as D
from seqweave.operators import exports as E
from seqweave.operators import graph as G
from seqweave.operators import metadata as M
from seqweave.operators import neighbours as N
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


MISSING_SQL = "('', 'na', 'n/a', 'none', 'missing', 'unknown', 'not known', 'not collected', 'not applicable', 'not provided', 'not available', '-', 'null', 'unspecified', 'other', 'restricted access')"


def _clean_sql(x):
    t = f"regexp_replace(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')), '^[;,]+|[;,]+$', '', 'g')"
    return (
        f"CASE WHEN lower({t}) IN {MISSING_SQL} OR starts_with(lower({t}), 'not available') OR starts_with(lower({t}), 'not applicable')"
        f" OR starts_with(lower({t}), 'not collected') OR starts_with(lower({t}), 'missing') THEN '' ELSE {t} END"
    )


@query(f"SELECT conv_id, turn, role, md5({_clean_sql('text')}) AS cleaned FROM conversations")
def clean_texts(spark, folder):
    rows = table(spark, folder, "conversations")
    return rows.select("conv_id", "turn", "role", F.md5(M.clean(F.col("text"))).alias("cleaned"))


SEGMENTS = {"machinery": "industry", "automobile": "industry", "building": "works", "furniture": "home", "household": "home"}


@query(
    f"""SELECT c_custkey, coalesce(nullif({_clean_sql("CASE WHEN c_custkey % 3 = 0 THEN ' Unknown' ELSE '' END")}, ''),
  nullif({_clean_sql("CASE WHEN c_custkey % 2 = 0 THEN c_name || ' ;' END")}, ''), nullif({_clean_sql("c_mktsegment")}, ''), '') AS label,
  CASE lower(c_mktsegment) WHEN 'machinery' THEN 'industry' WHEN 'automobile' THEN 'industry' WHEN 'building' THEN 'works'
    WHEN 'furniture' THEN 'home' WHEN 'household' THEN 'home' ELSE c_mktsegment END AS kind FROM customer"""
)
def first_given_label(spark, folder):
    key, name = F.col("c_custkey"), F.col("c_name")
    label = M.first_given(
        F.when(key % 3 == 0, " Unknown").otherwise(""),
        F.when(key % 2 == 0, F.concat(name, F.lit(" ;"))),
        F.col("c_mktsegment"),
    )
    kind = M.canonical(F.col("c_mktsegment"), SEGMENTS)
    return table(spark, folder, "customer").select("c_custkey", label.alias("label"), kind.alias("kind"))


PRIORITY_LEVELS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}


@query(
    """SELECT o_orderkey, regexp_extract(o_orderpriority, '^(\\d)', 1) AS code,
  CASE WHEN regexp_extract(o_orderdate::DATE::VARCHAR, '\\b(19\\d\\d|20\\d\\d)\\b', 1) <> ''
    THEN 'Y' || regexp_extract(o_orderdate::DATE::VARCHAR, '\\b(19\\d\\d|20\\d\\d)\\b', 1) ELSE '' END AS year,
  CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END::BIGINT AS level FROM orders"""
)
def extract_codes(spark, folder):
    from seqweave.functions import vocab

    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    day = F.to_date("o_orderdate").cast("string")
    return rows.select(
        "o_orderkey",
        M.extract(F.col("o_orderpriority"), r"^(\d)").alias("code"),
        M.extract(day, vocab.YEAR, prefix="Y").alias("year"),
        M.ordinal(F.col("o_orderpriority"), PRIORITY_LEVELS).alias("level"),
    )


@query(
    """SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
  coalesce(nullif(regexp_extract(url, '/([a-z][a-z])/\\d+', 1), ''), regexp_extract(html, 'lang="([a-z]+)"', 1)) AS lang,
  regexp_extract(url, '/(\\d+)', 1) AS number FROM pages"""
)
def page_fields(spark, folder):
    """Fields of a page address, the language falling back on the page itself."""
    rows = table(spark, folder, "pages")
    lang = F.coalesce(
        F.nullif(M.extract(F.col("url"), r"/([a-z][a-z])/\d+"), F.lit("")), M.extract(F.col("html"), r'lang="([a-z]+)"')
    )
    return rows.select(
        "page_id", M.extract(F.col("url"), r"^https?://([^/]+)").alias("host"), lang.alias("lang"),
        M.extract(F.col("url"), r"/(\d+)").alias("number"),
    )


CLASSES = [("fasteners", r"\bbolt|\brod\b"), ("machines", r"gear|gizmo|widget"), ("hot goods", r"^hot"), ("flat", r"plate|ring")]


@query(
    """SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), '\\bbolt|\\brod\\b') THEN 'fasteners'
  WHEN regexp_matches(lower(p_name || ' ' || p_type), 'gear|gizmo|widget') THEN 'machines'
  WHEN regexp_matches(lower(p_name || ' ' || p_type), '^hot') THEN 'hot goods'
  WHEN regexp_matches(lower(p_name || ' ' || p_type), 'plate|ring') THEN 'flat' ELSE 'other' END AS class FROM part"""
)
def classify_parts(spark, folder):
    text = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, folder, "part").select("p_partkey", M.classify(text, CLASSES).alias("class"))


@query(
    f"""WITH p AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN p_name || ' family protein' WHEN 'SMALL' THEN 'phage ' || p_name WHEN 'STANDARD' THEN ' '
  WHEN 'MEDIUM' THEN 'putative protein' ELSE p_name END AS product FROM part)
SELECT p_partkey, product <> '' AND NOT regexp_matches(trim(product), '{vocab.GENERIC_PRODUCT}') AS specific,
  regexp_matches(product, '{vocab.MOBILE_PRODUCT}') AS mobile FROM p"""
)
def product_flags(spark, folder):
    """Whether a product says something, and whether it is of a mobile element; products made from the parts' types."""
    name, kind = F.col("p_name"), F.col("p_type")
    product = (
        F.when(kind == "PROMO", F.concat(name, F.lit(" family protein"))).when(kind == "SMALL", F.concat(F.lit("phage "), name))
        .when(kind == "STANDARD", " ").when(kind == "MEDIUM", "putative protein").otherwise(name)
    )
    return table(spark, folder, "part").select("p_partkey", M.is_specific(product).alias("specific"), M.is_mobile(product).alias("mobile"))


@query(
    """WITH s AS (SELECT p_partkey AS id, CASE WHEN lower(p_name) = 'red ring' OR lower(p_brand) = 'red ring' THEN 0
  WHEN starts_with(lower(p_name), 'red ring') THEN 1 WHEN contains(lower(p_name), 'red ring') THEN 2 ELSE 9 END AS score FROM part)
SELECT id, score::BIGINT AS score FROM s WHERE score < 9"""
)
def search_names(spark, folder):
    entries = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.array("p_name", "p_brand").alias("names"),
        F.col("p_type").alias("product"), F.col("p_partkey").alias("rank"),
    )
    return M.search(entries, "Red Ring").select("id", "score")


@query(
    """WITH s AS (SELECT p_partkey AS id, CASE WHEN starts_with(lower(p_name), 'r') OR starts_with(lower(p_brand), 'r') THEN 1
  WHEN contains(lower(p_name), 'ec') OR contains(lower(p_brand), 'ec') THEN 9 ELSE 9 END AS x,
  CASE WHEN contains(lower(p_name), 'eco') OR contains(lower(p_brand), 'eco') THEN 2 WHEN contains(lower(p_type), 'eco') THEN 3 ELSE 9 END AS score FROM part)
SELECT id, score::BIGINT AS score FROM s WHERE score < 9"""
)
def search_products(spark, folder):
    entries = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.array("p_name", "p_brand").alias("names"),
        F.col("p_type").alias("product"), F.col("p_partkey").alias("rank"),
    )
    return M.search(entries, "eco").select("id", "score")


@query(
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, CASE WHEN l_extendedprice = 0 THEN 0 ELSE
  round(l_extendedprice * pow(10, greatest(0, 2 - floor(log10(abs(l_extendedprice)))))) / pow(10, greatest(0, 2 - floor(log10(abs(l_extendedprice))))) END AS shown
FROM lineitem"""
)
def significant_digits(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fc.significant(F.col("l_extendedprice"), 3).alias("shown")
    )


@query(
    """WITH d AS (SELECT text, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1)
SELECT doc_id, first_doc, copies FROM documents JOIN d USING (text)"""
)
def distinct_texts(spark, folder):
    """Dictionary of distinct values: each kept once, rows refer to it by its first id."""
    rows = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    kept = rows.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    return rows.join(kept, "key").select("doc_id", "first_doc", "copies")


@query(
    f"""WITH {C.EV}, k AS (SELECT genome, pos, CASE WHEN in_rgp THEN '1' ELSE '0' END AS v FROM ev),
s AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY genome ORDER BY pos) THEN 0 ELSE 1 END AS st FROM k),
g AS (SELECT *, sum(st) OVER (PARTITION BY genome ORDER BY pos) AS run FROM s),
r AS (SELECT genome, min(pos) AS start, any_value(v) AS v, count(*) AS n FROM g GROUP BY genome, run)
SELECT genome, start, v, n, repeat(v || 'z', (n // 54)::INT) || CASE WHEN n % 54 < 3 THEN repeat(v, (n % 54)::INT)
  WHEN n % 54 < 29 THEN v || chr((n % 54 + 62)::INT) ELSE v || chr((n % 54 + 68)::INT) END AS code FROM r"""
)
def run_lengths(spark, folder):
    rows = C.genes(spark, folder).withColumn("v", F.when(F.col("in_rgp"), "1").otherwise("0"))
    return E.run_lengths(rows, ["genome"], "v").withColumn("code", E.run_code(F.col("v"), F.col("n")))


@query(
    f"""WITH {C.EV}, m AS (SELECT DISTINCT family, genome FROM ev),
b AS (SELECT family, genome // 8 AS byte, sum(1 << (genome % 8)::INT) AS bits FROM m GROUP BY 1, 2),
x AS (SELECT family, max(byte) AS last FROM b GROUP BY 1),
f AS (SELECT family, unnest(range(0, last + 1)) AS byte FROM x)
SELECT family, 0::BIGINT AS segment, string_agg(lpad(lower(to_hex(coalesce(bits, 0)::BIGINT)), 2, '0'), '' ORDER BY byte) AS bits
FROM f LEFT JOIN b USING (family, byte) GROUP BY 1"""
)
def presence_bits(spark, folder):
    return E.bit_sets(C.genes(spark, folder), "family", "genome")


@query(
    f"""WITH {C.CALLS} SELECT prev, cluster, rnk AS rank,
  round(least(greatest(-ln(p), 0), 16) / 16 * 65535)::BIGINT AS q FROM model"""
)
def quantised_calls(spark, folder):
    model = C.count_model(C.with_prev(C.genes(spark, folder)))
    return model.select("prev", "cluster", "rank", E.quantise_log(F.col("p")).alias("q"))


@query(
    f"""WITH {C.CALLS}, c AS (SELECT prev, place, sum(p) OVER (PARTITION BY prev ORDER BY place) AS cum FROM model)
SELECT prev, count(*) FILTER (WHERE round(cum, 9) < 0.9) + 1 AS nucleus FROM c GROUP BY 1"""
)
def nucleus_size(spark, folder):
    """How many of the best clusters are needed to hold 90 % of a call."""
    from pyspark.sql import Window

    model = C.count_model(C.with_prev(C.genes(spark, folder)))
    upto = Window.partitionBy("prev").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    cum = model.select("prev", F.sum("p").over(upto).alias("cum"))
    return cum.groupBy("prev").agg((F.count_if(F.round("cum", 9) < 0.9) + 1).alias("nucleus"))


VEC = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS m FROM embeddings),
x AS (SELECT q.vec_id AS id, b.vec_id AS exemplar, q.label, b.label AS cluster, round(list_cosine_similarity(q.e, b.e), 12) AS cosine
  FROM v q, v b WHERE b.m <= 6),
nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, exemplar) AS place FROM x)"""


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v")
    )


def _bank(rows):
    """The exemplar bank: the first six members of every label."""
    return G.top_k(rows, ["label"], [F.col("id")], 6).select(
        F.col("id").alias("exemplar"), "v", F.col("label").alias("cluster")
    )


@query(f"WITH {VEC} SELECT id, exemplar, round(cosine, 6) AS cosine, place FROM nn WHERE place <= 15")
def nearest_exemplars(spark, folder):
    rows = vectors(spark, folder)
    return _round(N.nearest_exemplars(rows, _bank(rows), 15), "cosine")


SOFT = VEC + """,
sm AS (SELECT id, label, exemplar, exp(cosine / 0.1) / sum(exp(cosine / 0.1)) OVER (PARTITION BY id) AS p, place FROM nn WHERE place <= 15)"""


def vector_calls(spark, folder):
    """Softmax over the 15 nearest exemplars as one call per vector."""
    rows = vectors(spark, folder)
    near = N.nearest_exemplars(rows, _bank(rows), 15)
    weight = F.exp(F.col("cosine") / 0.1)
    listed = near.withColumn("w", weight).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("exemplar").alias("cluster"), "w"))).alias("t"),
        F.sum("w").alias("s"),
    )
    top = F.transform("t", lambda x: F.struct(x["cluster"].alias("cluster"), (x["w"] / F.col("s")).alias("p")))
    labels = rows.select("id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("family"))
    return cut_lineage(
        listed.select("id", top.alias("top")).join(labels, "id").withColumn("half", F.pmod("id", F.lit(2)))
    )


@query(
    f"""WITH {SOFT},
ma AS (SELECT id % 2 AS half, exemplar, label, sum(p) AS mass FROM sm GROUP BY 1, 2, 3),
de AS (SELECT *, mass / sum(mass) OVER (PARTITION BY half, exemplar) AS w FROM ma),
sc AS (SELECT s.id, s.label AS truth, d.label, sum(p * w) AS score FROM sm s JOIN de d ON d.exemplar = s.exemplar AND d.half = 1 - s.id % 2 GROUP BY 1, 2, 3),
b AS (SELECT id, truth, label, score, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, 'L' || label) AS r FROM sc),
e AS (SELECT id, -sum(p * log2(p)) AS entropy FROM sm GROUP BY 1)
SELECT b.id, 'L' || truth AS family, 'L' || label AS best, round(entropy, 6) AS entropy,
  round(coalesce((SELECT score FROM sc WHERE sc.id = b.id AND sc.label = b.truth), 0), 6) AS p_read FROM b JOIN e USING (id) WHERE r = 1"""
)
def vector_decode(spark, folder):
    """Vector calls read through the cluster table of the other half."""
    calls = vector_calls(spark, folder)
    read = D.decode(calls, D.decoder(calls, "half"))
    ent = F.aggregate("top", F.lit(0.0), lambda s, x: s - x["p"] * F.log2(x["p"]))
    return read.select("id", "family", "best", F.round(ent, 6).alias("entropy"), F.round("p_read", 6).alias("p_read"))


@query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT a.vec_id AS id, a.label, b.vec_id AS other, b.label AS other_label, round(list_cosine_similarity(a.e, b.e), 12) AS c
  FROM v a, v b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY c DESC, b.vec_id) = 1)
SELECT id, other, label <> other_label AS mismatch, floor(c * 10)::BIGINT AS band FROM x"""
)
def nearest_collision(spark, folder):
    """Nearest other vector, whether its family differs, and the similarity band."""
    rows = vectors(spark, folder)
    near = N.nearest_exemplars(rows, rows.withColumnRenamed("id", "exemplar"), 2).where(F.col("id") != F.col("exemplar"))
    best = near.groupBy("id").agg(F.min(F.struct("place", "exemplar", "cosine")).alias("m"))
    label = rows.select("id", "label")
    other = rows.select(F.col("id").alias("other"), F.col("label").alias("other_label"))
    return (
        best.select("id", F.col("m.exemplar").alias("other"), F.col("m.cosine").alias("c"))
        .join(label, "id").join(other, "other")
        .select("id", "other", (F.col("label") != F.col("other_label")).alias("mismatch"), F.floor(F.col("c") * 10).alias("band"))
    )


@query(
    """WITH x AS (SELECT unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT dim, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1"""
)
def dimension_ranges(spark, folder):
    return E.dimension_ranges(vectors(spark, folder))


@query(
    """WITH x AS (SELECT vec_id AS id, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
r AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1)
SELECT id, string_agg(round((x - lo) / greatest(hi - lo, 1e-12) * 255)::BIGINT::VARCHAR, ',' ORDER BY dim) AS codes
FROM x JOIN r USING (dim) GROUP BY 1"""
)
def quantised_vectors(spark, folder):
    rows = E.quantise_affine(vectors(spark, folder))
    text = F.array_join(F.transform("codes", lambda c: c.cast("string")), ",")
    return rows.select("id", text.alias("codes"))


@query(
    """WITH x AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, dim, avg(x) AS x FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1)
SELECT label::BIGINT AS label, dim, round(x / norm, 6) AS x FROM m JOIN n USING (label)"""
)
def label_prototypes(spark, folder):
    """Mean vector of each label, scaled to length one."""
    from pyspark.sql import Window

    long = vectors(spark, folder).select("label", F.posexplode("v").alias("dim", "x"))
    mean = long.groupBy("label", "dim").agg(F.avg("x").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label")))
    return _round(mean.withColumn("x", F.col("x") / norm), "x")


@query(
    f"""WITH {C.TR}, d AS (SELECT DISTINCT genome % 2 AS half, prev, allele FROM tr WHERE prev IS NOT NULL)
SELECT a.half, a.prev, a.allele FROM d a WHERE NOT EXISTS
  (SELECT 1 FROM d WHERE d.half = 1 - a.half AND d.prev = a.prev AND d.allele = a.allele)"""
)
def uncovered_reads(spark, folder):
    """(family, allele) contexts one half needs and the other half's table does not hold."""
    rows = C.with_prev(C.genes(spark, folder)).where(F.col("prev").isNotNull())
    rows = rows.select(F.pmod("genome", F.lit(2)).alias("half"), "prev", "allele").distinct()
    missing = E.uncovered(rows, rows.withColumn("half", 1 - F.col("half")), ["half", "prev", "allele"])
    return missing.withColumn("half", 1 - F.col("half"))


@query(
    """SELECT b AS k, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT floor(max(value) / 10)::BIGINT + 1 FROM events))) AS b) LEFT JOIN
  (SELECT floor(value / 10)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1) ON k = b"""
)
def value_histogram(spark, folder):
    rows = table(spark, folder, "events").select(F.floor(F.col("value") / 10).alias("k"))
    return E.counts_with_empty(rows, "k")


@query(
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, round(max(n) / sum(n), 6) AS share, count(*) AS labels FROM c GROUP BY 1"""
)
def label_agreement(spark, folder):
    """Share of the most frequent label among the rows of each source."""
    counts = table(spark, folder, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source").agg(
        F.round(F.max("n") / F.sum("n"), 6).alias("share"), F.count(F.lit(1)).alias("labels")
    )


@query(
    """SELECT p_name, md5(coalesce(CASE WHEN pr <> '' THEN left(pr, 0) || CASE WHEN length(pr) > 0 THEN 'M' || substr(pr, 2) END END, '')) AS protein FROM (
  SELECT p_name, rtrim(array_to_string(list_transform(range(0, length(d) // 3), lambda i:
    coalesce(m[substr(d, (i * 3 + 1)::INT, 3)][1], 'X')), ''), '*') AS pr FROM (
    SELECT DISTINCT p_name, upper(translate(md5(p_name), '0123456789abcdef', 'TCAGTCAGTCAGTCAG')) AS d FROM part),
    (SELECT map_from_entries(list_transform(range(0, 64), lambda i: {'k': substr('TCAG', (i // 16 + 1)::INT, 1) || substr('TCAG', (i // 4 % 4 + 1)::INT, 1) || substr('TCAG', (i % 4 + 1)::INT, 1),
      'v': substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', (i + 1)::INT, 1)})) AS m))"""
    .replace("m[substr(d, (i * 3 + 1)::INT, 3)][1]", "m[substr(d, (i * 3 + 1)::INT, 3)]")
)
def translated(spark, folder):
    """Coding sequences spelled from the names, translated."""
    dna = F.translate(F.md5("p_name"), "0123456789abcdef", "TCAGTCAGTCAGTCAG")
    rows = table(spark, folder, "part").select("p_name").distinct()
    return rows.select("p_name", F.md5(M.translate(dna)).alias("protein"))
