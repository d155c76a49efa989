"""Compact forms of results: run lengths, bit sets, quantised values, sparse tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.operators.tiling import islands, number_rows
from seqweave.session import cut_lineage


def run_lengths(rows: DataFrame, keys: list[str], value: str, pos: str = "pos") -> DataFrame:
    """Runs of equal values along ``pos`` (dense per key): keys, start, value, n."""
    numbered = islands(
        rows, keys, lambda w: ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(pos).over(w).isNull(), "_run", pos
    )
    return numbered.groupBy(*keys, "_run").agg(
        F.min(pos).alias("start"), F.first(value).alias(value), F.count(F.lit(1)).alias("n")
    ).drop("_run")


def run_code(value: Column, n: Column) -> Column:
    """A run as text: fewer than 3 repeated, 3-28 as A-Z and 29-54 as a-z after the
    digit; longer runs are cut at 54."""
    whole = F.floor(n / 54)
    rest = n - whole * 54
    letter = F.when(rest < 29, F.char((rest + 62).cast("int"))).otherwise(F.char((rest + 68).cast("int")))
    tail = F.when(rest < 3, F.repeat(value, rest.cast("int"))).otherwise(F.concat(value, letter))
    return F.concat(F.repeat(F.concat(value, F.lit("z")), whole.cast("int")), tail)


def bit_sets(members: DataFrame, key: str, member: str, segment: int = 32768) -> DataFrame:
    """Membership as bits, first member lowest: key, segment, and the hex bytes of the segment.

    Bytes are summed first, so a row never holds more than one segment.
    """
    seg, inside = F.floor(F.col(member) / segment), F.pmod(member, F.lit(segment))
    byte = members.select(key, member).distinct().groupBy(
        key, seg.alias("segment"), F.floor(inside / 8).alias("byte")
    ).agg(F.sum(F.pow(F.lit(2), F.pmod(member, F.lit(8))).cast("bigint")).alias("bits"))
    filled = byte.groupBy(key, "segment").agg(
        F.map_from_entries(F.collect_list(F.struct("byte", "bits"))).alias("m"), F.max("byte").alias("last")
    )
    text = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("last")),
        lambda i: F.lpad(F.lower(F.hex(F.coalesce(F.element_at("m", i), F.lit(0)))), 2, "0"),
    )
    return filled.select(key, "segment", F.array_join(text, "").alias("bits"))


def quantise_log(p: Column, top: float = 16.0) -> Column:
    """Probability as a 16-bit integer: -ln p over [0, top]."""
    return F.round(F.least(F.greatest(-F.ln(F.greatest(p, F.lit(1e-300))), F.lit(0.0)), F.lit(top)) / top * 65535).cast(
        "bigint"
    )


def rank_knots(ranks: int, knots: int = 192) -> list[int]:
    """Ranks from 1 to ``ranks`` at even steps of their logarithm, each once."""
    steps = [(ranks ** (i / (knots - 1))) for i in range(knots)] if knots > 1 else [1]
    return sorted({min(ranks, max(1, round(s))) for s in steps})


def at_knots(ranked: DataFrame, rank: str, ranks: int, knots: int = 192) -> DataFrame:
    """Rows of ``ranked`` whose rank is a knot, with ``knot`` (its place among them), instead of the whole lists."""
    chosen = rank_knots(ranks, knots)
    places = F.create_map(*[F.lit(x) for i, r in enumerate(chosen) for x in (r, i)])
    return ranked.where(F.col(rank).isin(chosen)).withColumn("knot", F.element_at(places, F.col(rank).cast("int")))


def dimension_ranges(vectors: DataFrame, v: str = "v") -> DataFrame:
    """dim, lo, hi over all vectors."""
    return vectors.select(F.posexplode(v).alias("dim", "x")).groupBy("dim").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi")
    )


def quantise_affine(vectors: DataFrame, v: str = "v") -> DataFrame:
    """Vectors as 8-bit codes per dimension: round((x - lo) / (hi - lo) * 255).

    The ranges are one row per dimension, gathered into two arrays.
    """
    ordered = F.array_sort(F.collect_list(F.struct("dim", "lo", "hi")))
    ranges = dimension_ranges(vectors, v).agg(ordered.alias("r")).select(
        F.transform("r", lambda x: x["lo"]).alias("lo"), F.transform("r", lambda x: x["hi"]).alias("hi")
    )
    # one row: the ranges of all dimensions
    rows = vectors.join(F.broadcast(ranges))
    scaled = F.zip_with(
        F.zip_with(v, "lo", lambda x, lo: x - lo),
        F.zip_with("hi", "lo", lambda hi, lo: F.greatest(hi - lo, F.lit(1e-12))),
        lambda d, s: F.round(d / s * 255, 0).cast("int"),
    )
    return rows.withColumn("codes", scaled).drop("lo", "hi")


def uncovered(table: DataFrame, needed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are asked for but missing from a sparse table."""
    return needed.select(*keys).distinct().join(table.select(*keys).distinct(), keys, "left_anti")


def counts_with_empty(rows: DataFrame, key: str, least: int = 0, weight: Column | None = None) -> DataFrame:
    """Count (or weighted sum) per integer key from 0 to the largest one (at least
    ``least`` keys), empty keys as zero."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = rows.groupBy(key).agg(amount.alias("n"))
    largest = counted.agg(F.max(key)).first()[0]
    full = rows.sparkSession.range(max(least, (largest or 0) + 1)).withColumnRenamed("id", key)
    return full.join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def decoder_blocks(weights: DataFrame, per_block: int = 256) -> DataFrame:
    """Decoder rows as compressed sparse rows: half, block, families, starts, clusters, values.

    ``weights``: half, family, cluster, weight. A block holds the rows of ``per_block`` families next to each other by
    name: row i of a block is entries starts[i] to starts[i + 1] of clusters and values. Blocks hold as many
    entries as their families have clusters, of which a decoder keeps a fixed number.
    """
    names = number_rows(weights.select("half", "family").distinct(), ["half"], ["family"], F.substring("family", 1, 2), "_i")
    rows = weights.join(names, ["half", "family"]).withColumn("block", F.floor(F.col("_i") / per_block))
    listed = rows.groupBy("half", "block", "family").agg(F.array_sort(F.collect_list(F.struct("cluster", "weight"))).alias("e"))
    held = listed.groupBy("half", "block").agg(F.array_sort(F.collect_list(F.struct("family", "e"))).alias("r"))
    ends = F.aggregate(F.transform("r", lambda x: F.size(x["e"])), F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    entries = F.flatten(F.transform("r", lambda x: x["e"]))
    return held.select("half", "block", F.transform("r", lambda x: x["family"]).alias("families"), ends.alias("starts"),
                       F.transform(entries, lambda e: e["cluster"]).alias("clusters"), F.transform(entries, lambda e: e["weight"]).alias("values"))


def write_decoder(weights: DataFrame, folder: str, per_block: int = 256) -> None:
    """Write decoder blocks below ``folder``, a folder for each half and block, and beside them which block holds a family."""
    blocks = cut_lineage(decoder_blocks(weights, per_block))
    blocks.write.partitionBy("half", "block").parquet(f"{folder}/rows")
    blocks.select("half", "block", F.explode("families").alias("family")).write.parquet(f"{folder}/index")


def decoder_rows(spark: SparkSession, folder: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoder rows of ``wanted`` (half, family): half, family, cluster, weight; and the wanted rows that the table lacks.

    Only the folders of blocks that hold a wanted family are read: their numbers, fewer than the blocks, go into the filter.
    """
    wanted = wanted.select("half", "family").distinct()
    index = spark.read.parquet(f"{folder}/index")
    held = cut_lineage(wanted.join(index, ["half", "family"]))
    places = [(r["half"], r["block"]) for r in held.select("half", "block").distinct().collect()]
    rows = spark.read.parquet(f"{folder}/rows")
    mine = reduce(lambda a, b: a | b, [(F.col("half") == h) & (F.col("block") == b) for h, b in places], F.lit(False))
    row = F.posexplode("families").alias("_i", "family")
    cut = rows.where(mine).select("half", row, "starts", "clusters", "values").join(held.select("half", "family"), ["half", "family"])
    start, stop = F.get("starts", F.col("_i")), F.get("starts", F.col("_i") + 1)
    part = lambda c: F.slice(c, start + 1, stop - start)
    entry = F.explode(F.arrays_zip(part("clusters").alias("cluster"), part("values").alias("weight"))).alias("e")
    return cut.select("half", "family", entry).select("half", "family", "e.cluster", "e.weight"), wanted.join(index, ["half", "family"], "left_anti")
