"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.session import cut_lineage

#: Characters that separate words: space and the control characters 9 to 13.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_row(df: DataFrame):
    """All columns of ``df`` as one struct named ``row``, so that no column an operator adds can clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the text of their struct ``row`` as a binary column ``text``, so that it travels once."""
    for batch in batches:
        text = pc.struct_field(batch.column("row"), "text").cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "text"])


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text; ``bytes.split`` separates at exactly the six ASCII white-space characters."""
    return text.split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\r\x0b\x0c")] = True
_BYTES[_SPACES] = 0
_BASE = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and the number of words of each text.

    A word's hash is a polynomial of its bytes, so all words are hashed at once, wherever they stand.
    """
    data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    space = _SPACES[data]
    starts = ~space
    starts[1:] &= space[:-1]
    begin = np.flatnonzero(starts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(begin, ends), prepend=0)
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    place = np.arange(len(data)) - begin[np.maximum(np.cumsum(starts) - 1, 0)]
    place[space] = 0
    powers = np.full(int(place.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    return mixed(np.add.reduceat(_BYTES[data] * np.multiply.accumulate(powers)[place], begin)), counts


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the ``width``-word shingles of each A-Z lower-cased text, and how many each has.

    The hashes of a text lie together in rising order. A text of fewer words is one shingle, one without words none.
    """
    hashes, words = word_hashes([t.lower() if t else b"" for t in texts])
    windows = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    ends = np.cumsum(windows)
    at = (np.cumsum(words) - words - ends + windows)[owner] + np.arange(len(owner))
    length = np.minimum(words, width)[owner]
    out = length.astype(np.uint64)
    held = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for j in range(width):
        out = out * np.uint64(0x100000001B3) + np.where(j < length, held[at + j], np.uint64(0))
    out = mixed(out)
    for first, last in zip((ends - windows).tolist(), ends.tolist(), strict=True):
        out[first:last].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], np.bincount(owner[fresh], minlength=len(texts))


def by_text(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` (binary) holds about ``most_bytes`` in each, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: node, component (the smallest node id of it), for nodes with an edge.

    Alternating large-star and small-star steps until an iteration changes
    nothing; each step is one aggregation and one join, so a hub's edges are
    never gathered in one row. Edges are written after each round.
    """
    pairs = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        pairs = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = cut_lineage(pairs)
        state = tuple(pairs.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
