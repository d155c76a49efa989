"""Sharding by extendible hashing.

A shard is a prefix of hash bits. Beginning with one shard of all rows, only
shards above the byte limit are split on another bit, so the directory is a tree
of prefixes of different lengths. Sizes are added up per ``STEP`` further bits at
once; all shorter prefixes are sums of these, and each row's shard is the
shortest prefix that fits. Rows of the shards that still do not fit go on with
the next bits. Rows that share all bits repeat one another; their shard is filled
page by page.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.session import cut_lineage

#: Byte limit of a shard, bits of the hash, bits that one pass adds.
LIMIT, BITS, STEP = 1 << 20, 60, 15


def row_hash(doc_id, text):
    """60 bits of an md5 of id and text."""
    own = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.md5(text), F.lit("-")))
    return F.conv(F.substring(F.md5(own), 1, BITS // 4), 16, 10).cast("bigint")


def text_bytes(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def assigned(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, bytes, h, depth (bits), prefix (their value), page, shard, shard_bytes.

    ``shard`` is the prefix in binary digits, with a page number only for rows that repeat one another beyond the
    limit. A shard holds at most ``limit`` bytes, or a single larger document. An empty table has no shard. Null
    doc_ids and texts are values like others; other columns are not read.
    """
    text = F.col("text")
    rows = docs.select("doc_id", text_bytes(text).alias("bytes"), row_hash(F.col("doc_id"), text).alias("h"))
    rows, done, bits = cut_lineage(rows), [], 0
    while bits < BITS:
        low = 0 if bits == 0 else bits + 1
        bits += STEP
        sizes = rows.groupBy(F.shiftright("h", BITS - bits).alias("leaf")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n")
        )
        sizes = cut_lineage(sizes)  # at most 2^STEP rows for each shard that was too large before
        tree = sizes.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(bits))))
        prefix = F.expr(f"shiftright(leaf, {bits} - depth)")
        tree = tree.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n"))
        fits = tree.where(f"shard_bytes <= {limit} or n = 1").select("depth", "prefix", "shard_bytes")
        named = sizes.select("leaf").withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(bits))))
        named = named.withColumn("prefix", prefix).join(fits, ["depth", "prefix"])
        named = named.groupBy("leaf").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s"))
        named = cut_lineage(sizes.select("leaf").join(named, "leaf", "left").select("leaf", "s.*"))
        met = rows.withColumn("leaf", F.shiftright("h", BITS - bits)).join(named, "leaf").drop("leaf")
        done.append(met.where("depth is not null").withColumn("page", F.lit(None).cast("bigint")))
        if named.where("depth is null").isEmpty():
            break
        rows = cut_lineage(met.where("depth is null").select("doc_id", "bytes", "h"))
    else:
        done.append(_pages(rows, limit))
    every = reduce(DataFrame.unionByName, done)
    digits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return every.withColumn("shard", F.concat(digits, F.when(F.col("page").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("+"), F.col("page").cast("string"))
    )))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows equal in all bits, numbered per task and offset by the tasks before, so many to a page."""
    names = rows.columns
    rows = cut_lineage(rows.withColumn("task", F.spark_partition_id()))
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy("h", "task").orderBy("bytes")))
    tasks = rows.groupBy("h", "task").agg(F.count("*").alias("c"), F.max("bytes").alias("b"))
    past = Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.withColumn("before", F.coalesce(F.sum("c").over(past), F.lit(0)))
    tasks = tasks.withColumn("room", F.greatest(F.lit(1), F.expr(f"{limit} div greatest(1, max(b) over (partition by h))")))
    met = own.join(tasks.select("h", "task", "before", "room"), ["h", "task"])
    met = cut_lineage(met.select(*names, F.expr("(before + k - 1) div room").alias("page")))
    sums = met.groupBy("h", "page").agg(F.sum("bytes").alias("shard_bytes"))
    out = met.join(sums, ["h", "page"])
    return out.select(*names, F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), "shard_bytes", "page")


def shards_of(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes, depth, shard, shard_bytes of every document."""
    return assigned(docs, limit).select("doc_id", "bytes", F.col("depth").cast("bigint").alias("depth"), "shard", "shard_bytes")


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Write the rows of ``docs`` as Parquet below ``folder``, one subfolder a shard of the column ``shard_``."""
    names, text = docs.columns, F.col("text")
    told = assigned(docs, limit).select("h", "page", F.col("shard").alias("shard_"))
    rows = docs.select(F.struct(*names).alias("_row"), text_bytes(text).alias("bytes"), row_hash(F.col("doc_id"), text).alias("h"))
    out = rows.join(told.where("page is null").select("h", "shard_").distinct(), "h").select("_row.*", "shard_")
    over = told.where("page is not null").select("h").distinct()
    if not over.isEmpty():
        paged = _pages(rows.join(over, "h", "left_semi").select("_row", "bytes", "h"), limit)
        name = F.concat(F.expr(f"lpad(bin(h), {BITS}, '0')"), F.lit("+"), F.col("page").cast("string"))
        out = out.unionByName(paged.select("_row.*", name.alias("shard_")))
    out.repartition("shard_").write.partitionBy("shard_").parquet(folder)


def shards_sql(limit: int = LIMIT, depth: int = 24) -> str:
    """The same as one DuckDB statement over ``documents``, for data whose shards fit within ``depth`` bits."""
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
            ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, '-'), coalesce(md5(text), '-'))), 1, {BITS // 4}))::BIGINT AS h
            FROM documents),
        t AS MATERIALIZED (SELECT k AS depth, h >> ({BITS} - k) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS n
            FROM d, range(0, {depth + 1}) r(k) GROUP BY ALL),
        s AS (SELECT doc_id, bytes, h, min(depth) AS depth FROM d, range(0, {depth + 1}) r(k)
            JOIN t ON t.depth = r.k WHERE t.prefix = h >> ({BITS} - r.k) AND (t.shard_bytes <= {limit} OR t.n = 1)
            GROUP BY doc_id, bytes, h)
        SELECT doc_id, bytes, s.depth::BIGINT AS depth, CASE WHEN s.depth = 0 THEN '' ELSE
            lpad(bin(h >> ({BITS} - s.depth)), s.depth::INT, '0') END AS shard, t.shard_bytes
        FROM s JOIN t ON t.depth = s.depth AND t.prefix = h >> ({BITS} - s.depth)"""
