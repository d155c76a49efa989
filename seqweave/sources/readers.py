"""Readers for annotation files, map documents and plain lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators.tiling import number_rows


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Coding sequences with a translation, in order: acc, organism, idx, start, end, strand,
    gene, product, protein.

    Files are split at the record separator, so one row is one record and a file
    of many records is read by many tasks; features are cut with expressions.
    """
    records = spark.read.option("lineSep", "\n//").text(path).where(F.col("value").rlike("LOCUS"))
    body = records.select(
        F.regexp_extract("value", r"LOCUS\s+(\S+)", 1).alias("acc"),
        F.trim(F.regexp_extract("value", r"\n\s+ORGANISM\s+([^\n]*)", 1)).alias("organism"),
        F.explode(F.split(F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*(.*?)(?:\nORIGIN|\nCONTIG|$)", 1), r"\n {5}(?=\S)")).alias("f"),
    ).where(F.col("f").startswith("CDS "))
    location = F.regexp_replace(F.regexp_extract("f", r"(?s)^CDS\s+([^/]*)", 1), r"\s+", "")
    places = F.transform(F.regexp_extract_all(location, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))
    qualifier = lambda name: F.regexp_replace(F.regexp_extract("f", rf'(?s)/{name}="([^"]*)"', 1), r"\s+", " ")
    genes = body.select(
        "acc",
        "organism",
        F.array_min(places).alias("start"),
        F.array_max(places).alias("end"),
        F.when(F.contains(location, F.lit("complement")), "-").otherwise("+").alias("strand"),
        qualifier("gene").alias("gene"),
        qualifier("product").alias("product"),
        F.replace(qualifier("translation"), F.lit(" "), F.lit("")).alias("protein"),
    ).where(F.col("protein") != "")
    return number_rows(genes, ["acc"], ["start", "end", "strand"], F.floor(F.col("start") / 100000), "idx")


def read_map_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of circular-map documents: one row per feature, with its file."""
    schema = "cgview struct<features: array<struct<name: string, type: string, start: bigint, stop: bigint, strand: bigint>>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    return docs.select(F.input_file_name().alias("file"), F.explode("cgview.features").alias("f")).select("file", "f.*")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text with their number from 0: id, line.

    Lines are numbered inside the splits of the files, and the lines of the
    splits before are added; files follow one another by name.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_k"),
    )
    return number_rows(lines, [], ["_file", "_at", "_k"], F.struct("_file", "_at"), "id").select("id", "line")
