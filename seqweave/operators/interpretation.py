"""Bracketed interpretations held against the product words of the families they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions import vocab

BRACKET = r"\[\[(.+?)\]\]"
WORD = r"[A-Za-z][A-Za-z'-]{3,}"


STEM = r"^(.{5,}?)(?:" + "|".join(vocab.ENDINGS) + r")$"


def stem(word: Column) -> Column:
    """A lower-case word without the longest ending that leaves five letters."""
    return F.regexp_replace(word, STEM, "$1")


def _stems(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: stem(F.lower(w)))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*vocab.PLAIN_WORDS)))


def interpretation_fit(texts: DataFrame, cited: DataFrame, products: DataFrame, least: float = 0.5) -> DataFrame:
    """text_id, at, phrase, words, families, hits, unknown, fits of every ``[[phrase]]`` of the texts.

    ``texts``: text_id, text; ``cited``: text_id, family, the families a text is about; ``products``: family, product.
    A phrase has 2 to 6 words; each of them must be, by its stem, a word of a product of the cited families (``unknown``
    counts those that are not), and families with one of its words must be the share ``least`` of them. Stems look their
    families up in an inverted index, so a phrase meets only families that share a word with it.
    """
    found = texts.select("text_id", F.posexplode(F.regexp_extract_all("text", F.lit(BRACKET), F.lit(1))).alias("at", "phrase"))
    phrases = found.withColumn("words", F.size(F.regexp_extract_all("phrase", F.lit(r"[A-Za-z0-9][A-Za-z0-9'_-]*"), F.lit(0))))
    index = products.select("family", F.explode(_stems(F.col("product"))).alias("stem")).distinct()
    about = cited.select("text_id", "family").distinct()
    asked = phrases.select("text_id", "at", F.explode(_stems(F.col("phrase"))).alias("stem"))
    met = asked.join(index, "stem").join(about, ["text_id", "family"], "left_semi")
    hits = met.groupBy("text_id", "at").agg(F.count_distinct("family").alias("hits"), F.count_distinct("stem").alias("known"))
    total = about.groupBy("text_id").agg(F.count(F.lit(1)).alias("families"))
    out = phrases.withColumn("_stems", F.size(_stems(F.col("phrase")))).join(total, "text_id", "left").join(hits, ["text_id", "at"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    unknown = F.col("_stems") - zero("known")
    fits = F.col("words").between(2, 6) & (F.col("_stems") > 0) & (unknown == 0) & (zero("families") > 0) & (zero("hits") >= least * zero("families"))
    return out.select("text_id", F.col("at").cast("bigint").alias("at"), "phrase", "words", zero("families").alias("families"), zero("hits").alias("hits"),
                      unknown.alias("unknown"), fits.alias("fits"))
