"""Order-dependent operators that never hold a whole sequence in one task.

A plain ``Window.partitionBy(genome)`` sends all rows of one genome to one
task. Here every order-dependent result is built in two levels instead:

* rows are grouped by (key, tile), a tile being a bounded stretch of the order;
* what crosses a tile border is either replicated (a halo of fixed width, for
  lag/lead and bounded frames) or carried as one summary row per tile (prefix
  sums).

A key holding a third of all rows is then spread over as many tasks as it has
tiles. Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 65536


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column,
    pos: str = "pos",
    length: str | None = None,
) -> DataFrame:
    """0-based row number per key; ``length`` also adds the number of rows of the key.

    Rows are numbered inside pieces and the rows before each piece are added:
    ``chunk`` must rise with ``order`` and bound a piece (for example the minute
    of a timestamp, or the leading characters of a hash).
    """
    tagged = df.withColumn("_chunk", chunk)
    sizes = tagged.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(per_key).alias("_len"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = tagged.withColumn("_rn", F.row_number().over(inside) - 1)
    out = local.join(starts, [*keys, "_chunk"]).withColumn(pos, F.col("_rn") + F.col("_start"))
    if length:
        out = out.withColumn(length, F.col("_len"))
    return out.drop("_chunk", "_rn", "_start", "_len")


def halo_tiles(
    df: DataFrame, before: int = 0, after: int = 0, pos: str = "pos", size: int = TILE
) -> DataFrame:
    """Copy each row into every tile that sees it within ``before``/``after`` positions.

    Adds ``_tile`` and ``_core`` (true in the tile the row belongs to).
    """
    home = F.floor(F.col(pos) / size)
    first = F.floor((F.col(pos) - after) / size)
    last = F.floor((F.col(pos) + before) / size)
    return df.withColumn("_home", home).withColumn(
        "_tile", F.explode(F.sequence(first, last))
    ).withColumn("_core", F.col("_tile") == F.col("_home")).drop("_home")


def over_tiles(
    df: DataFrame,
    keys: Sequence[str],
    exprs: Callable[[Window], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    pos: str = "pos",
    size: int = TILE,
) -> DataFrame:
    """Window expressions reaching at most ``before`` rows back and ``after`` rows ahead.

    ``pos`` must be dense (consecutive integers) per key, so that a halo of n
    positions holds the n neighbouring rows.
    """
    tiled = halo_tiles(df, before, after, pos, size)
    window = Window.partitionBy(*keys, "_tile").orderBy(pos)
    new = exprs(window)
    return (
        tiled.select("*", *[c.alias(n) for n, c in new.items()])
        .where("_core")
        .drop("_tile", "_core")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    out: str,
    pos: str = "pos",
    size: int = TILE,
) -> DataFrame:
    """Inclusive prefix sum of ``value`` along ``pos``: tile sums plus tile offsets."""
    tiled = df.withColumn("_v", value).withColumn("_tile", F.floor(F.col(pos) / size))
    totals = tiled.groupBy(*keys, "_tile").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_tile", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_tile").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = tiled.withColumn("_local", F.sum("_v").over(inside))
    return (
        local.join(offsets, [*keys, "_tile"])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_v", "_tile", "_local", "_offset")
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    starts: Callable[[Window], Column],
    out: str = "island",
    pos: str = "pos",
    size: int = TILE,
) -> DataFrame:
    """Number the runs of consecutive rows; ``starts`` says where a new run begins.

    ``starts`` may look one row back.
    """
    flagged = over_tiles(
        df, keys, lambda w: {"_starts": starts(w).cast("int")}, before=1, pos=pos, size=size
    )
    return running_sum(flagged, keys, F.col("_starts"), out, pos, size).drop("_starts")


def unroll_circular(
    df: DataFrame, before: int, after: int, pos: str = "pos", length: str = "length"
) -> DataFrame:
    """Repeat the ends of each circular sequence on the other side.

    Rows near the origin reappear at ``pos + length`` and rows near the end at
    ``pos - length``, as often as needed to give every row ``before`` rows
    behind it and ``after`` ahead. ``_turn`` is 0 for the row itself.
    """
    low = -F.floor((F.col(pos) + before) / F.col(length))
    high = F.floor((F.col(length) - 1 + after - F.col(pos)) / F.col(length))
    return df.withColumn(
        "_turn", F.explode(F.sequence(low, high))
    ).withColumn(pos, F.col(pos) + F.col("_turn") * F.col(length))


def value_bounds(df: DataFrame, value: str, pieces: int = 64) -> list[float]:
    """At most ``pieces - 1`` cut points splitting ``value`` into even shares.

    They are read once and become literals of the plan, so every branch and
    every retried task cuts at the same places; the result of the operators
    using them does not depend on how good the cuts are.
    """
    probs = [i / pieces for i in range(1, pieces)]
    cuts = df.select(F.col(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")
    ).approxQuantile("v", probs, 0.005)
    return sorted(set(cuts))


def value_chunk(value: str, bounds: Sequence[float]) -> Column:
    """Index of the piece ``value`` falls into; rises with ``value``."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(float(b)) for b in bounds])
    v = F.col(value).cast("double")
    return F.size(F.filter(cuts, lambda b: b < v))


def running_count_by_value(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    bounds: Sequence[float] = (),
    chunk: Column | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Distinct values per key with ``n`` rows each, ``below`` rows under them and ``total``.

    Equal values are folded before anything is sorted, so ties cost nothing. With ``weight`` a row counts as that many.
    ``chunk`` (rising with the value) replaces the pieces given by ``bounds``.
    """
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    folded = df.groupBy(*keys, value).agg(count.alias("n")).withColumn(
        "_chunk", value_chunk(value, bounds) if chunk is None else chunk
    )
    sizes = folded.groupBy(*keys, "_chunk").agg(F.sum("n").alias("_t"))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"),
        F.sum("_t").over(per_key).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = folded.withColumn("_low", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return (
        local.join(starts, [*keys, "_chunk"])
        .withColumn("below", F.col("_low") + F.col("_start"))
        .select(*keys, value, "n", "below", "total")
    )


def grouped_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float,
    out: str,
    bounds: Sequence[float] = (),
    chunk: Column | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantile with linear interpolation, without holding a group in one task."""
    ranked = running_count_by_value(df, keys, value, bounds, chunk, weight)
    at = F.lit(q) * (F.col("total") - 1)
    low, high = F.floor(at), F.ceil(at)
    v = F.col(value).cast("double")
    first, last = F.col("below"), F.col("below") + F.col("n") - 1
    picked = ranked.select(
        *keys,
        F.when(first.__le__(low) & (low <= last), v).alias("_lo"),
        F.when(first.__le__(high) & (high <= last), v).alias("_hi"),
        (at - low).alias("_f"),
    ).where(F.col("_lo").isNotNull() | F.col("_hi").isNotNull())
    return picked.groupBy(*keys).agg(
        (F.max("_lo") + F.max("_f") * (F.max("_hi") - F.max("_lo"))).alias(out)
    )


def carry_last(
    df: DataFrame, keys: Sequence[str], value: Column, out: str, pos: str = "pos", size: int = TILE,
    reverse: bool = False,
) -> DataFrame:
    """Last non-null ``value`` at or before each row (at or after it when ``reverse``).

    An unbounded as-of lookup: the last value of each tile is handed to the
    tiles after it, so no task sees more than one tile.
    """
    sign = -1 if reverse else 1
    tiled = df.withColumn("_v", value).withColumn("_tile", F.floor(F.col(pos) / size) * sign)
    tails = tiled.where(F.col("_v").isNotNull()).groupBy(*keys, "_tile").agg(
        F.max(F.struct((F.col(pos) * sign).alias("p"), F.col("_v").alias("v")))["v"].alias("_t")
    )
    every = tiled.select(*keys, "_tile").distinct().join(tails, [*keys, "_tile"], "left")
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    handed = every.select(*keys, "_tile", F.last("_t", ignorenulls=True).over(before).alias("_handed"))
    order = F.desc(pos) if reverse else F.asc(pos)
    inside = Window.partitionBy(*keys, "_tile").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        tiled.withColumn("_own", F.last("_v", ignorenulls=True).over(inside))
        .join(handed, [*keys, "_tile"])
        .withColumn(out, F.coalesce("_own", "_handed"))
        .drop("_v", "_tile", "_own", "_handed")
    )


def median_position(df: DataFrame, keys: Sequence[str], pos: str, out: str) -> DataFrame:
    """Exact median of an integer position or distance per key, counted in tiles of the line."""
    return grouped_quantile(df, keys, pos, 0.5, out, chunk=F.floor(F.col(pos) / 4096))


def nearest_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], bounds: Sequence[float] = (), chunk: Column | None = None
) -> DataFrame:
    """Exact quantiles that are values of the group: keys, share, value at the place nearest to share (n - 1), halves to the even place."""
    ranked = running_count_by_value(df, keys, value, bounds, chunk)
    asked = ranked.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    at = F.bround(F.col("share") * (F.col("total") - 1))
    return asked.where((F.col("below") <= at) & (at < F.col("below") + F.col("n"))).select(*keys, "share", value)
