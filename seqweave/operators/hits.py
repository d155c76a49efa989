"""Pairs worth having, without a table of all pairs.

As in ``pairs`` two blocks of items meet in one task as matrices, but the task sees all their features, one chunk after
the other in sorted order, and holds only the running sums of its block pair. When the last chunk is in, the sums are
whole, so thresholds, histograms and best lists apply there; what leaves the task is hits or counts, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.operators.tiling import number_rows
from seqweave.session import cut_lineage

ITEMS_PER_BLOCK = 512
ROWS_PER_CHUNK = 500_000

#: Width of a step of |z| in histograms.
STEP = 0.001


def numbered(items: DataFrame, chunk: Column | None = None) -> DataFrame:
    """item, number: distinct items numbered in their order; ``chunk`` must rise with it (default: two characters)."""
    chunk = F.substring(F.col("item").cast("string"), 1, 2) if chunk is None else chunk
    return cut_lineage(number_rows(items.select("item").distinct(), [], ["item"], chunk, "number"))


def block_pairs(
    left: DataFrame, items: DataFrame, values: list[str], finish: Callable[[int, np.ndarray, np.ndarray, list[np.ndarray]], dict], schema: str,
    right: DataFrame | None = None,
) -> DataFrame:
    """What ``finish`` makes of the sums over shared features of all pairs of items with rising numbers.

    ``left`` (and ``right``, the second side of each pair; else the same): draw, item, feature, values; ``items`` from
    ``numbered``. ``finish(draw, a, b, sums)`` gets the numbers of a block pair's items, a row and a column per
    item, and for each value the sums of its products, and returns columns of ``schema``; only cells with a < b count.
    """
    known = items.agg(F.max("number")).first()[0]
    blocks = 0 if known is None else known // ITEMS_PER_BLOCK + 1
    sides = [left, left if right is None else right]
    chunks = max(1, -(-int(left.count()) // ROWS_PER_CHUNK))

    def spread(df, side):
        rows = df.join(items, "item").withColumn("_b", F.floor(F.col("number") / ITEMS_PER_BLOCK))
        # the blocks it meets: later ones from the left, earlier ones from the right, its own from both
        other = F.sequence(F.col("_b"), F.lit(blocks - 1)) if side == 0 else F.sequence(F.lit(0), F.col("_b"))
        pair = (F.col("_b"), F.col("_o")) if side == 0 else (F.col("_o"), F.col("_b"))
        return rows.withColumn("_o", F.explode(other)).select(
            F.col("draw").cast("bigint").alias("draw"), pair[0].cast("bigint").alias("bi"), pair[1].cast("bigint").alias("bj"), F.lit(side).alias("side"),
            F.pmod(F.xxhash64("feature"), F.lit(chunks)).alias("chunk"), F.xxhash64("feature").alias("feature"), F.col("number").cast("bigint").alias("number"),
            *[F.col(v).cast("double").alias(v) for v in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, held, chunk = None, None, [], None

        def add():
            table = pa.Table.from_batches(held)
            col = {c: table.column(c).to_numpy() for c in ("side", "feature", "number", *values)}
            feature = np.unique(col["feature"], return_inverse=True)[1]
            for start in range(0, int(feature.max()) + 1, 4096):
                mine = (feature >= start) & (feature < start + 4096)
                for s, v in zip(sums, values, strict=True):
                    x = np.zeros((2, ITEMS_PER_BLOCK, 4096))
                    np.add.at(x, (col["side"][mine], col["number"][mine] % ITEMS_PER_BLOCK, feature[mine] - start), col[v][mine])
                    s += x[0] @ x[1].T
            held.clear()

        def done():
            a, b = (np.arange(k * ITEMS_PER_BLOCK, min(known + 1, (k + 1) * ITEMS_PER_BLOCK)) for k in at[1:])
            return pa.RecordBatch.from_pydict(finish(at[0], a, b, [s[: len(a), : len(b)] for s in sums]))

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("draw", "bi", "bj", "chunk")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if start == stop:
                    continue
                key = tuple(keys[:, start].tolist())
                if held and (key[:3] != at or key[3] != chunk):
                    add()
                if key[:3] != at:
                    if at is not None:
                        yield done()
                    at, sums = key[:3], [np.zeros((ITEMS_PER_BLOCK, ITEMS_PER_BLOCK)) for _ in values]
                chunk = key[3]
                held.append(batch.slice(start, stop - start))
        if held:
            add()
        if at is not None:
            yield done()

    rows = spread(sides[0], 0).unionByName(spread(sides[1], 1))
    dealt = rows.repartition("draw", "bi", "bj").sortWithinPartitions("draw", "bi", "bj", "chunk")
    return dealt.mapInArrow(run, schema)


def _cmh(presence: DataFrame, margins: DataFrame, permuted: DataFrame | None = None, draws: int = 0):
    """The two sides of the product whose three sums are shared genomes, their expectation and its variance."""
    kept = margins.select("stratum").distinct()
    n, held = F.col("n").cast("double"), F.col("held").cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    margin = margins.select(
        F.col("family").alias("item"), F.concat(F.lit("s|"), F.col("stratum").cast("string")).alias("feature"), zero.alias("both"),
        (held / F.sqrt(n)).alias("expected"), (held * (n - held) / (n * F.sqrt(n - 1))).alias("var"))
    genome = lambda df: df.join(kept, "stratum", "left_semi").select(
        *[c for c in ("draw",) if c in df.columns], F.col("family").alias("item"),
        F.concat_ws("|", F.lit("g"), F.col("stratum").cast("string"), F.col("genome").cast("string")).alias("feature"),
        one.alias("both"), zero.alias("expected"), zero.alias("var"))
    if permuted is None:
        rows = genome(presence).unionByName(margin).withColumn("draw", F.lit(0))
        return cut_lineage(rows), None
    every = lambda df: df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    left = every(genome(presence).unionByName(margin))
    right = genome(permuted).unionByName(every(margin).select("draw", "item", "feature", "both", "expected", "var"))
    return cut_lineage(left), cut_lineage(right)


VALUES = ["both", "expected", "var"]


def _z(sums):
    both, expected, var = sums
    return np.round((both - expected) / np.sqrt(np.maximum(var, 1e-9)), 9)


def cmh_histogram(presence: DataFrame, margins: DataFrame, items: DataFrame, permuted: DataFrame | None = None, draws: int = 0, least_var: float = 0.0) -> DataFrame:
    """draw, step, pairs: how many pairs of families have a |z| in each step of ``STEP``, of those that share a stratum and have more than ``least_var`` variance.

    With ``permuted`` (draw of 0 .. draws - 1, stratum, genome, family) one side is relabelled; otherwise the draw is 0.
    """
    left, right = _cmh(presence, margins, permuted, draws)

    def finish(draw, a, b, sums):
        use = (a[:, None] < b[None, :]) & (sums[1] > 0) & (sums[2] > least_var)
        step, pairs = np.unique(np.floor(np.abs(_z(sums)[use]) / STEP).astype(np.int64), return_counts=True)
        return {"draw": np.full(len(step), draw), "step": step, "pairs": pairs}

    found = block_pairs(left, items, VALUES, finish, "draw bigint, step bigint, pairs bigint", right)
    return found.groupBy("draw", "step").agg(F.sum("pairs").alias("pairs"))


def histogram_quantile(histogram: DataFrame, q: float) -> float | None:
    """The upper edge of the first step that holds, with those below it, a share ``q`` of all pairs; None without pairs."""
    steps = histogram.groupBy("step").agg(F.sum("pairs").alias("pairs")).orderBy("step").collect()  # max |z| / STEP rows at most
    total, seen = sum(r["pairs"] for r in steps), 0
    for r in steps:
        seen += r["pairs"]
        if seen >= q * total:
            return (r["step"] + 1) * STEP
    return None


def cmh_hits(presence: DataFrame, margins: DataFrame, items: DataFrame, level: float, least_var: float = 0.0) -> DataFrame:
    """a, b, both, z, var of the pairs of families with |z| of ``level`` or more and more than ``least_var`` variance."""
    left, _ = _cmh(presence, margins)

    def finish(draw, a, b, sums):
        z = _z(sums)
        i, j = np.nonzero((a[:, None] < b[None, :]) & (sums[1] > 0) & (sums[2] > least_var) & (np.abs(z) >= level))
        return {"a": a[i], "b": b[j], "both": sums[0][i, j], "z": z[i, j], "var": sums[2][i, j]}

    found = block_pairs(left, items, VALUES, finish, "a bigint, b bigint, both double, z double, var double")
    return named(found, items)


def named(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with the names of their items instead of the numbers a and b."""
    side = lambda c: items.select(F.col("number").cast("bigint").alias(c), F.col("item").alias(f"_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.select(F.col("_a").alias("a"), F.col("_b").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")])


def similar_pairs(presence: DataFrame, items: DataFrame, most: float) -> DataFrame:
    """a, b, both, jaccard of the pairs of families whose Jaccard distance is ``most`` or less."""
    rows = presence.select(F.lit(0).alias("draw"), F.col("family").alias("item"), F.col("genome").alias("feature"), F.lit(1.0).alias("both")).distinct()
    # The counts of both items come as one more feature: n times 1 for the one, 1 times n for the other.
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("n"))
    zero = F.lit(0.0)
    sized = counts.select(F.lit(0).alias("draw"), "item", F.lit("n").alias("feature"), zero.alias("both"), F.col("n").alias("na"), F.lit(1.0).alias("nb"))
    base = rows.select("draw", "item", F.concat(F.lit("g|"), F.col("feature").cast("string")).alias("feature"), "both", zero.alias("na"), zero.alias("nb"))
    left = cut_lineage(base.unionByName(sized))
    right = cut_lineage(base.unionByName(sized.select("draw", "item", "feature", "both", F.lit(1.0).alias("na"), F.col("na").alias("nb"))))

    def finish(draw, a, b, sums):
        both, na, nb = sums
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.round(1 - both / (na + nb - both), 12)
        i, j = np.nonzero((a[:, None] < b[None, :]) & (both > 0) & (distance <= most))
        return {"a": a[i], "b": b[j], "both": both[i, j], "jaccard": distance[i, j]}

    found = block_pairs(left, items, ["both", "na", "nb"], finish, "a bigint, b bigint, both double, jaccard double", right)
    return named(found, items)
