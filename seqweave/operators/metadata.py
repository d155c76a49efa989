"""Cleaning sample metadata, classifying texts and searching names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions import vocab


def clean(text: Column, missing: Sequence[str] = vocab.MISSING) -> Column:
    """Single spaces, no outer blanks or ``;,``; empty when the value means "not given"."""
    tidy = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    tidy = F.regexp_replace(tidy, r"^[;,]+|[;,]+$", "")
    low = F.lower(tidy)
    prefixed = reduce(lambda a, b: a | b, [low.startswith(p) for p in vocab.MISSING_PREFIXES])
    return F.when(low.isin(list(missing)) | prefixed, "").otherwise(tidy)


def first_given(*texts: Column) -> Column:
    """The first cleaned value that is not empty, else empty."""
    return F.coalesce(*[F.nullif(clean(t), F.lit("")) for t in texts], F.lit(""))


def canonical(text: Column, names: Mapping[str, str] = vocab.HOSTS) -> Column:
    """The common name of a value, or the value itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(text)), text)


def extract(text: Column, pattern: str, group: int = 1, prefix: str = "") -> Column:
    """First match of the pattern with a prefix, or empty."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", F.concat(F.lit(prefix), found)).otherwise("")


def serotype(organism: Column, *columns: Column) -> Column:
    """The leftmost O or H antigen of the first serotype column with one, else the O antigen of the organism name."""
    leftmost = f"(?:{vocab.SEROTYPE})|(?:{vocab.FLAGELLAR})"
    either = [F.nullif(extract(c, leftmost, group), F.lit("")) for c in columns for group in (1, 2)]
    return F.coalesce(*either, extract(organism, vocab.SEROTYPE))


def ordinal(text: Column, levels: Mapping[str, int] = vocab.LEVELS, default: int = vocab.LEVEL_DEFAULT) -> Column:
    cases = reduce(lambda acc, kv: acc.when(text == kv[0], kv[1]), levels.items(), F)
    return cases.otherwise(default)


def classify(text: Column, classes: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """Name of the first class whose pattern is found in the lower-case text."""
    low = F.lower(text)
    cases = reduce(lambda acc, c: acc.when(low.rlike(c[1]), c[0]), classes, F)
    return cases.otherwise(default)


def is_specific(product: Column) -> Column:
    return (F.coalesce(product, F.lit("")) != "") & ~F.trim(product).rlike(vocab.GENERIC_PRODUCT)


def is_mobile(product: Column) -> Column:
    return F.coalesce(product, F.lit("")).rlike(vocab.MOBILE_PRODUCT)


def search(entries: DataFrame, text: str) -> DataFrame:
    """Entries matching a query, best first by (class, rank).

    ``entries``: id, names (array), product, rank. Class 0: a name is the query,
    1: starts with it, 2: holds it, 3: the product holds it (three letters or
    more). ``#12`` or ``12`` asks for an id.
    """
    q = text.strip().lower()
    digits = q.lstrip("#").strip()
    if digits.isdigit():
        found = entries.where(F.col("id") == int(digits)).withColumn("score", F.lit(0))
    else:
        one = lambda n: (
            F.when(F.lower(n) == q, 0).when(F.lower(n).startswith(q), 1).when(F.contains(F.lower(n), F.lit(q)), 2).otherwise(9)
        )
        by_name = F.coalesce(F.array_min(F.transform("names", one)), F.lit(9))
        by_product = (by_name == 9) & F.lit(len(q) >= 3) & F.contains(F.lower("product"), F.lit(q))
        found = entries.withColumn("score", F.when(by_product, 3).otherwise(by_name)).where(F.col("score") < 9)
    return found.orderBy(F.least("score", F.lit(2)), "rank", "id")


def translate(dna: Column) -> Column:
    """Protein of a coding sequence: standard codons, a stop cut at the end, the first residue M.

    A codon with anything but the four bases reads X; incomplete codons are dropped.
    """
    bases = vocab.CODE_BASES
    codons = [a + b + c for a in bases for b in bases for c in bases]
    table = F.create_map(*[F.lit(x) for pair in zip(codons, vocab.CODE_AMINO_ACIDS) for x in pair])
    n = F.floor(F.length(dna) / 3).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    letters = F.transform(
        starts, lambda i: F.coalesce(F.element_at(table, F.substring(F.upper(dna), i * 3 + 1, F.lit(3))), F.lit("X"))
    )
    protein = F.rtrim(F.array_join(letters, ""), F.lit("*"))
    return F.when(protein != "", F.concat(F.lit("M"), F.substring(protein, F.lit(2), F.length(protein)))).otherwise("")
