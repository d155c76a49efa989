"""Typed claims of cited sentences, and joins that hold them against the facts of a window.

A small grammar reads four kinds of claim from a sentence with built-in expressions: a range of values over columns, a
value bound to a column or gene, a comparison with a direction, and the partition of the families of columns. Each
check joins its claims with the facts by what they name, so it works on claims and facts of any number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(18,6)"

#: The grammar: fixed wordings, their groups in the order named beside them.
RANGE = r"columns (\d+) to (\d+) show (?:a |an )?(share|named|RGP) (from )?(\d+(?:\.\d+)?) to (\d+(?:\.\d+)?)%"
BOUND = r"(?:column (\d+)|`([^`]+)`),? carried by (\d+(?:\.\d+)?)%"
COMPARE = r"column (\d+) has (a higher|a lower|the same) (share|named|RGP|bits) (?:than|as) column (\d+)"
TREND = r"(share|named|RGP|bits) (rising|falling) from column (\d+) to column (\d+)"
EXTREME = r"(most hesitant|fewest named|most carried|least carried) at column (\d+)"
PLACED = r"`([^`]+)` at column (\d+)"
PARTITION = r"(all|\d+) (persistent|shell|cloud)(?: families)? in columns (\d+) to (\d+)"


def _found(cut: DataFrame, pattern: str, groups: Sequence[str]) -> DataFrame:
    """Every match of ``pattern`` in the sentences: text_id, nth, cites, at (its place) and a column a group, null if empty."""
    parts = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i + 1)).alias(g) for i, g in enumerate(groups)]
    rows = cut.select("text_id", "nth", "cites", F.posexplode(F.arrays_zip(*parts)).alias("at", "_m"))
    return rows.select("text_id", "nth", "cites", F.col("at").cast("bigint").alias("at"), *[F.nullif(F.col(f"_m.{g}"), F.lit("")).alias(g) for g in groups])


def _typed(df: DataFrame, numbers: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    for c in numbers:
        df = df.withColumn(c, F.col(c).try_cast("bigint"))
    for c in values:
        df = df.withColumn(c, F.col(c).try_cast(EXACT))
    return df


def says(said: Column, own: Column) -> Column:
    """Whether a text may write ``said`` for a share ``own``: itself or rounded further, never rounded to 0 or 100."""
    exact = lambda x: x.cast(EXACT)
    rounded = [exact(f(own, d)) for d in (1, 0) for f in (F.round, F.bround)]
    near = F.array_contains(F.array(*rounded), said) & ~said.isin(0, 100)
    return F.coalesce((said == own) | near, F.lit(False))


def _covered(claims: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claims over columns first..last with the facts of their role: n columns, least, most, and the values at both ends.

    ``facts``: role, locus, value, those of one window, so a role has as many rows as the window columns.
    """
    inside = facts.select("role", "locus", "value")
    met = claims.join(inside, "role", "left").where(F.col("locus").isNull() | F.col("locus").between(F.least("first", "last"), F.greatest("first", "last")))
    at = lambda c: F.max(F.when(F.col("locus") == F.col(c), F.col("value")))
    told = met.groupBy(*keys).agg(F.count("locus").alias("columns"), F.min("value").alias("least"), F.max("value").alias("most"),
                                  at("first").alias("v_first"), at("last").alias("v_last"))
    return claims.join(told, list(keys), "left")


def range_claims(cut: DataFrame, facts: DataFrame) -> DataFrame:
    """"columns 3 to 6 show a share 40 to 52%": text_id, nth, at, role, first, last, low, high, supported.

    A range is supported if it is the lowest and highest value of these columns, or the values at the first and the
    last; with "from" only the latter, in this order. Columns without facts support nothing.
    """
    names = ["first", "last", "role", "word", "low", "high"]
    said = _typed(_found(cut, RANGE, names), ["first", "last"], ["low", "high"]).drop("cites")
    met = _covered(said, facts, ["text_id", "nth", "at"])
    span = says(F.least("low", "high"), F.col("least")) & says(F.greatest("low", "high"), F.col("most"))
    ends = says(F.col("low"), F.col("v_first")) & says(F.col("high"), F.col("v_last"))
    ok = F.coalesce(F.when(F.col("word").isNotNull(), ends).otherwise(span | ends), F.lit(False))
    return met.select("text_id", "nth", "at", "role", "first", "last", "low", "high", ok.alias("supported"))


def bound_numbers(cut: DataFrame, facts: DataFrame, genes: DataFrame) -> DataFrame:
    """"column 4, carried by 41%", "`x#1`, carried by 41%": text_id, nth, at, locus, gene, value, supported.

    The value must be the share of that column, or of a column at which that gene is (``genes``: gene, locus).
    """
    said = _typed(_found(cut, BOUND, ["locus", "gene", "value"]), ["locus"], ["value"]).drop("cites")
    shares = facts.where("role = 'share'").select("locus", F.col("value").alias("own"))
    places = genes.select(F.col("gene").alias("g_gene"), F.col("locus").alias("g_locus")).distinct()
    named = said.where("gene is not null").join(places, F.col("gene") == F.col("g_gene")).drop("locus", "g_gene").withColumnRenamed("g_locus", "locus")
    every = said.where("locus is not null").unionByName(named, allowMissingColumns=True)
    held = every.join(shares, "locus").where(says(F.col("value"), F.col("own"))).select("text_id", "nth", "at").distinct().withColumn("_ok", F.lit(True))
    out = said.join(held, ["text_id", "nth", "at"], "left")
    return out.select("text_id", "nth", "at", "locus", "gene", "value", F.coalesce("_ok", F.lit(False)).alias("supported"))


def comparison_claims(cut: DataFrame, facts: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """"column 3 has a higher share than column 5", "bits falling from column 3 to column 5": text_id, nth, at, role, first, last, said, holds.

    ``said`` is the sign of first minus last; values that differ by ``tolerance`` or less are the same (of shares:
    percent). A comparison with a column that has no facts does not hold.
    """
    compare = _found(cut, COMPARE, ["first", "word", "role", "last"])
    sign = F.when(F.col("word") == "a higher", 1).when(F.col("word") == "a lower", -1).otherwise(0)
    trend = _found(cut, TREND, ["role", "word", "first", "last"]).withColumn("at", F.col("at") + 1000)
    way = F.when(F.col("word") == "falling", 1).otherwise(-1)
    keep = ["text_id", "nth", "at", "role", "first", "last"]
    said = compare.select(*keep, sign.alias("said")).unionByName(trend.select(*keep, way.alias("said")))
    said = _typed(said, ["first", "last"])
    value = lambda c, out: facts.select("role", F.col("locus").alias(c), F.col("value").alias(out))
    met = said.join(value("first", "a"), ["role", "first"], "left").join(value("last", "b"), ["role", "last"], "left")
    gap = F.col("a") - F.col("b")
    real = F.when(F.abs(gap) <= F.lit(tolerance).cast(EXACT), 0).otherwise(F.signum(gap)).cast("int")
    return met.select(*keep, "said", F.coalesce(F.col("said") == real, F.lit(False)).alias("holds"))


def partition_claims(cut: DataFrame, families: DataFrame) -> DataFrame:
    """"all shell in columns 3 to 5", "2 cloud families in columns 3 to 5": text_id, nth, at, said, partition, first, last, n, matching, holds.

    ``families``: locus, family, partition. "all" needs every family of these columns, and one at least; a number
    that many families or more.
    """
    said = _typed(_found(cut, PARTITION, ["said", "partition", "first", "last"]), ["first", "last"]).drop("cites")
    known = families.select("locus", "family", F.col("partition").alias("own"))
    # Families of one window: as many as its columns hold.
    met = said.join(known, F.col("locus").between(F.least("first", "last"), F.greatest("first", "last")))
    counted = met.groupBy("text_id", "nth", "at").agg(F.count_distinct("family").alias("n"), F.count_distinct(F.when(F.col("own") == F.col("partition"), F.col("family"))).alias("matching"))
    out = said.join(counted, ["text_id", "nth", "at"], "left").fillna(0, ["n", "matching"])
    number = F.col("said").try_cast("bigint")
    ok = F.when(F.col("said") == "all", (F.col("n") > 0) & (F.col("n") == F.col("matching"))).otherwise(F.col("matching") >= number)
    return out.select("text_id", "nth", "at", "said", "partition", "first", "last", "n", "matching", F.coalesce(ok, F.lit(False)).alias("holds"))


#: What each wording of an extreme speaks of, and whether it is the highest value.
EXTREMES = {"most hesitant": ("bits", True), "fewest named": ("named", False), "most carried": ("share", True), "least carried": ("share", False)}


def extreme_claims(cut: DataFrame, facts: DataFrame) -> DataFrame:
    """"most hesitant at column 7": text_id, nth, at, said, locus, holds: whether no column has a more extreme value of that role."""
    said = _typed(_found(cut, EXTREME, ["said", "locus"]), ["locus"]).drop("cites")
    ends = facts.groupBy("role").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    role = F.create_map(*[F.lit(x) for w, (r, _) in EXTREMES.items() for x in (w, r)])
    high = F.col("said").isin([w for w, (_, up) in EXTREMES.items() if up])
    met = said.withColumn("role", F.element_at(role, F.col("said"))).join(facts.select("role", "locus", "value"), ["role", "locus"], "left").join(ends, "role", "left")
    ok = F.coalesce(F.col("value") == F.when(high, F.col("most")).otherwise(F.col("least")), F.lit(False))
    return met.select("text_id", "nth", "at", "said", "locus", ok.alias("holds"))


def placed_genes(cut: DataFrame, genes: DataFrame) -> DataFrame:
    """"`x#1` at column 7": text_id, nth, at, gene, locus, holds: whether the gene is one of that column (``genes``: gene, locus)."""
    said = _typed(_found(cut, PLACED, ["gene", "locus"]), ["locus"]).drop("cites")
    known = genes.select("gene", "locus").distinct().withColumn("_ok", F.lit(True))
    return said.join(known, ["gene", "locus"], "left").select("text_id", "nth", "at", "gene", "locus", F.coalesce("_ok", F.lit(False)).alias("holds"))
