"""Exact duplicates with the heavy hitters split off.

Every row is read once, as a SHA-256 of its lower-cased text, and that small table is written. Misra-Gries summaries of
its parts, summed by digest, name the digests that can hold more than a set share of all rows; these are counted exactly,
their verified winners are broadcast and settle their rows where they lie. All other digests are shuffled: a group among
them holds at most that share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import slices
from seqweave.session import cut_lineage

#: Counters of a Misra-Gries summary. At most this many digests are heavy, so it bounds the broadcast; every digest with
#: more than 2 / (COUNTERS + 1) of all rows is among them.
COUNTERS = 1023

_DIGESTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int64())])
_SUMMARY = pa.schema([("digest", pa.binary()), ("counter", pa.int64()), ("total", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = [t.lower() if t else b"" for t in batch.column("text").to_pylist()]  # bytes.lower() turns only A-Z
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            pa.array([len(t) for t in texts], pa.int64()),
        ], schema=_DIGESTS)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, bytes (of the lower-cased text) and place (a number of its own) of every row, written."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(_digest, "doc_id bigint, digest binary, bytes bigint")
    return cut_lineage(rows.withColumn("place", F.monotonically_increasing_id()))


def summarise(counters: dict, fresh: dict, most: int) -> dict:
    """Misra-Gries: add fresh counts, then take the (most + 1)-th largest off all and keep what stays above zero."""
    for key, n in fresh.items():
        counters[key] = counters.get(key, 0) + n
    if len(counters) <= most:
        return counters
    cut = sorted(counters.values(), reverse=True)[most]
    return {key: n - cut for key, n in counters.items() if n > cut}


def heavy(rows: DataFrame, most: int = COUNTERS) -> DataFrame:
    """Exact group_size, keep_id and winning place of at most ``most`` digests, all with more than 2 / (most + 1) of the rows among them.

    A counter falls short of its digest's count by at most 1 / (most + 1) of its part's rows, and no counter exceeds
    the count. So sums above that share of all rows are fewer than ``most + 1``.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, total = {}, 0
        for batch in batches:
            total += batch.num_rows
            seen = pc.value_counts(batch.column("digest"))
            fresh = dict(zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True))
            counters = summarise(counters, fresh, most)
        keys = list(counters)
        yield pa.RecordBatch.from_arrays([
            pa.array([*keys, None], pa.binary()), pa.array([*counters.values(), 0], pa.int64()),
            pa.array([0] * len(keys) + [total], pa.int64()),
        ], schema=_SUMMARY)

    sums = rows.select("digest").mapInArrow(part, "digest binary, counter bigint, total bigint")
    sums = cut_lineage(sums.groupBy("digest").agg(F.sum("counter").alias("counter"), F.sum("total").alias("total")))
    total = sums.where("digest is null").select("total").first()
    total = total[0] if total else 0
    named = sums.where(f"digest is not null and counter * {most + 1} > {total}").select("digest")
    return cut_lineage(_groups(rows.join(F.broadcast(named), "digest", "left_semi")))


def _groups(rows: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("doc_id", "place"), F.struct(F.col("doc_id"), -F.col("place")))
    return rows.groupBy("digest").agg(
        F.count("*").alias("group_size"), best.alias("best"), (F.min("bytes") == F.max("bytes")).alias("same_bytes")
    ).select("digest", "group_size", F.expr("if(same_bytes, best, raise_error('a SHA-256 of texts of different length'))").alias("best"))


def judge(docs: DataFrame, most: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, and texts of any length are
    read whole. Of equal texts the row with the largest doc_id stays (null is smallest), of rows that repeat it exactly
    one; keep_id is its doc_id. Other columns are not read, an empty table gives no rows.
    """
    rows = digests(docs)
    top = heavy(rows, most)
    settled = rows.join(F.broadcast(top), "digest")
    rest = rows.join(F.broadcast(top.select("digest")), "digest", "left_anti").repartition("digest")
    met = rest.join(_groups(rest), "digest")
    cells = ["doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("best.place")).alias("kept"),
             F.lower(F.hex("digest")).alias("text_sha256")]
    return settled.select(*cells).unionByName(met.select(*cells))


def kept_rows(docs: DataFrame, most: int = COUNTERS) -> DataFrame:
    """Whole rows of ``docs`` that stay. Rows are told apart by (doc_id, digest); one of those that repeat both stays."""
    names = [f"`{c}`" for c in docs.columns]
    told = judge(docs, most).where("kept").select(F.col("doc_id").alias("_doc"), F.col("text_sha256").alias("_sha"))
    rows = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").alias("_doc"), text_sha256(F.col("text")).alias("_sha"))
    same = (F.col("rows._sha") == F.col("told._sha")) & F.col("rows._doc").eqNullSafe(F.col("told._doc"))
    met = rows.alias("rows").join(told.alias("told"), same, "left_semi")
    return met.dropDuplicates(["_sha", "_doc"]).select("_row.*")


def text_sha256(text):
    """SHA-256 of a text after lower-casing A-Z, null as empty, as a column."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()).cast("binary"), 256)


def judge_sql() -> str:
    """The same as one DuckDB statement, for unique doc_ids."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{upper}', '{upper.lower()}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER p AS keep_id, count(*) OVER p AS group_size, doc_id = max(doc_id) OVER p AS kept, text_sha256
        FROM d WINDOW p AS (PARTITION BY text_sha256)"""
