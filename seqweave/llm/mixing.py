"""Mixing sources to target weights by balanced sampling with the cube method.

Sources share all words by weight, none above a multiple of its own size. The
ratio of target and size is the whole number of copies that each document of a
source gives, and its fraction the probability of one more. The cube method
turns these probabilities into 0 and 1 while the number of documents and the
number of words both keep their expected totals: three undecided units at a time
move along the null space of the two constraints until one is decided.

Flights run on blocks of a source's units, dealt by hash, so a large source is
many tasks. A block leaves two undecided units at most; they meet in a block of
the next level, 2,000 to one, until one block a source is left, whose last two
units are the landing problem. Large documents fly first, so what lands is small.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.llm.common import SPACE, whole_row
from seqweave.session import cut_lineage

#: Weights of the sources in turn; most words that a mix takes of a source, in its sizes.
WEIGHTS, MOST = (1, 2, 3), 3
#: Units of a block, and blocks whose rests meet in one block of the next level.
BLOCK, FAN, SEED = 4096, 1024, 17


def word_count(text):
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n and target of one row a source.

    Shares of all words by weight; a source above ``most`` times its size is held there and its excess shared
    among the others by weight. Sources by least size per weight are full one after the other; the first that
    is not gives the level of all after it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row a source
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("w", cycle.cast("double")).withColumn("cap", most * F.col("source_size"))
    rows = rows.withColumn("r", F.col("cap") / F.col("w"))
    rise = Window.orderBy("r", F.col("source").isNull(), "source")
    past = rise.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rest", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(past), F.lit(0)))
    rows = rows.withColumn("weights", F.sum("w").over(rise.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.col("rest") / F.col("weights"))
    level = F.min(F.when(F.col("r") >= F.col("level"), F.struct("r", "level"))).over(Window.partitionBy())["level"]
    rows = rows.withColumn("level", level)
    target = F.when(F.col("level").isNull() | (F.col("r") < F.col("level")), F.col("cap").cast("double"))
    return rows.select("source", "source_size", "n", target.otherwise(F.col("w") * F.col("level")).alias("target"))


def flight(size: np.ndarray, chance: np.ndarray, draws: np.ndarray, land: bool = False) -> np.ndarray:
    """Move inclusion chances to 0 or 1 with unchanged totals of chance and of chance times size.

    At most two units stay undecided; with ``land`` these too are decided, first with the number of documents
    kept, at last by chance.
    """
    out = chance.copy()
    held: list[int] = []
    eps = 1e-9
    draw = iter(draws)

    def move(units, along):
        up = min((1 - out[k]) / v if v > 0 else out[k] / -v for k, v in zip(units, along, strict=True) if v)
        down = min(out[k] / v if v > 0 else (1 - out[k]) / -v for k, v in zip(units, along, strict=True) if v)
        step = up if next(draw) * (up + down) < down else -down
        for k, v in zip(units, along, strict=True):
            moved = out[k] + step * v
            out[k] = 0.0 if moved < eps else 1.0 if moved > 1 - eps else moved
        return [k for k in units if 0.0 < out[k] < 1.0]

    for k in np.flatnonzero((chance > 0) & (chance < 1)).tolist():
        held.append(k)
        if len(held) == 3:
            a, b, c = (float(size[i]) for i in held)
            along = (c - b, a - c, b - a)
            top = max(map(abs, along))
            held = move(held, tuple(v / top for v in along) if top else (1.0, -1.0, 0.0))
    if land:
        if len(held) == 2:
            held = move(held, (1.0, -1.0))
        for k in held:
            out[k] = 1.0 if next(draw) < out[k] else 0.0
    return out


def _fly(units: DataFrame, level: int, land: bool, seed: int) -> DataFrame:
    """One flight of each block; equal blocks fly alike in every run."""

    def fly(key, rows):
        rows = rows.sort_by([("size", "descending"), *((c, "ascending") for c in ("doc_id", "text_hash", "turn"))])
        source, block = (k.as_py() for k in key)
        rng = np.random.default_rng([seed, level, block, source is None, zlib.crc32((source or "").encode())])
        size, chance = (rows.column(c).to_numpy() for c in ("size", "chance"))
        moved = flight(size, chance, rng.random(len(size) + 4), land)
        return rows.set_column(rows.schema.get_field_index("chance"), "chance", pa.array(moved))

    return units.groupBy("source", "block").applyInArrow(fly, units.schema)


def shares(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, size, source, source_size, target, copies (0 to ``most``).

    Repeated rows are units of their own. A null source is one source, a null text has size 0. The same rows give
    the same copies in every run, however they are partitioned.
    """
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    rows = cut_lineage(rows.groupBy("source", "doc_id", "text_hash", "size").agg(F.count("*").alias("times")))
    sizes = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n")
    )
    wanted = cut_lineage(targets(sizes, weights, most))
    largest = wanted.agg(F.max("n")).first()[0] or 1
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = wanted.select(F.col("source").alias("s"), "source_size", "target", F.floor(ratio).alias("base"),
                           (ratio - F.floor(ratio)).alias("chance"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    units = rows.join(wanted, rows["source"].eqNullSafe(F.col("s"))).drop("s")
    units = units.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).drop("times")
    units = units.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", "turn", F.lit(seed)), "blocks")).drop("blocks")
    blocks, level, done = -(-largest // BLOCK), 0, []
    while True:
        units = cut_lineage(_fly(units, level, blocks == 1, seed))
        if blocks == 1:
            done.append(units)
            break
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(units.where(~open_))
        units = units.where(open_).withColumn("block", F.floor(F.col("block") / FAN))
        blocks, level = -(-blocks // FAN), level + 1
    every = reduce(DataFrame.unionByName, done)
    return every.withColumn("copies", (F.col("base") + F.col("chance")).cast("bigint")).drop(
        "base", "chance", "turn", "block"
    )


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (its words in the mix, repeats counted)."""
    return shares(docs, weights, most, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_rows(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as it takes them, columns as they are."""
    names = ["source", "doc_id", "text_hash"]
    taken = shares(docs, weights, most, seed).groupBy(*names).agg(F.sum("copies").alias("c"), F.count("*").alias("n"))
    taken = cut_lineage(taken.where("c > 0").select(*(F.col(x).alias(f"_{x}") for x in names), "c", "n"))
    keyed = docs.select(whole_row(docs), "source", "doc_id", F.xxhash64("text").alias("text_hash"))
    same = reduce(lambda a, b: a & b, [keyed[x].eqNullSafe(taken[f"_{x}"]) for x in names])

    def repeated(rows, times):
        return rows.where(times > 0).select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), times))).select("row.*")

    out = repeated(keyed.join(taken, same), F.expr("c div n"))
    over = taken.where("c % n > 0")  # only of repeated rows
    if not over.isEmpty():
        same = reduce(lambda a, b: a & b, [keyed[x].eqNullSafe(over[f"_{x}"]) for x in names])
        rest = keyed.join(over, same).dropDuplicates([f"_{x}" for x in names])
        out = out.unionByName(repeated(rest, F.expr("c % n")))
    return out
