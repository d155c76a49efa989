"""Nearest neighbours: of genomes by distance, of vectors by cosine."""

from __future__ import annotations

from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.session import cut_lineage

#: Queries whose similarities to a block of the bank are held at once.
SLICE = 512
#: Groups of queries, each of which the bank passes once, and vectors that travel in one row.
GROUPS, PACK = 24, 16


#: Parts in which a long list is cut before its best rows are merged.
PARTS = 64


def _nearest(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` rows of each key with the smallest (d, other): the best of each part of its list, then of these."""
    parted = rows.withColumn("_part", F.pmod(F.xxhash64("other"), F.lit(PARTS)))
    for by in ([*keys, "_part"], keys):
        order = Window.partitionBy(*by).orderBy("d", "other")
        parted = parted.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    return parted.drop("_part")


def nearest_in_group(members: DataFrame, group: str, distance: DataFrame, k: int, reach: int = 4) -> DataFrame:
    """The ``k`` nearest other genomes of the same group: group, genome, other.

    ``members``: group, genome; ``distance``: g1, g2, d, each pair once. Every
    genome first looks at its ``reach * k`` nearest genomes overall; only those
    that do not meet ``k`` members there look at their whole list, so the result
    is exact while most genomes read a short list. Lists are cut into parts whose
    best rows are merged, so no task sorts a whole list.
    """
    both = distance.select(F.col("g1").alias("genome"), F.col("g2").alias("other"), "d").unionByName(
        distance.select(F.col("g2").alias("genome"), F.col("g1").alias("other"), "d")
    )
    others = members.select(group, F.col("genome").alias("other"))

    def look(wanted, candidates):
        return _nearest(wanted.join(candidates, "genome").join(others, [group, "other"]).select(group, "genome", "other", "d"), [group, "genome"], k)

    first = cut_lineage(look(members, _nearest(both, ["genome"], reach * k).drop("_k")))
    full = first.where(F.col("_k") == k).select(group, "genome")
    rest = look(members.join(full, [group, "genome"], "left_anti"), both)
    done = first.join(full, [group, "genome"], "left_semi")
    return done.unionByName(rest).select(group, "genome", "other")


def _packed(rows: DataFrame, group: str) -> DataFrame:
    """Rows id, v and the number ``group``, some of one group packed into one row: group, ids, v, wide.

    Numbers travel as 4 bytes where these hold all of a row exactly, else as 8.
    """

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, of = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
            order = np.argsort(of, kind="stable")
            begin = np.flatnonzero(np.diff(of[order], prepend=-1))
            parts = [p for run in np.split(order, begin[1:]) for p in np.split(run, range(PACK, len(run), PACK))]
            short = [v[p].astype(np.float32) for p in parts]
            wide = [not np.array_equal(s, v[p], equal_nan=True) for s, p in zip(short, parts, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "group": pa.array([of[p[0]] for p in parts], pa.int32()), "ids": [ids[p].tobytes() for p in parts],
                "v": [(v[p] if w else s).tobytes() for w, s, p in zip(wide, short, parts, strict=True)], "wide": wide,
            })

    return rows.mapInArrow(work, f"{group} int, ids binary, v binary, wide boolean")


def _unpacked(ids: list[bytes], v: list[bytes], wide: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of length one of packed rows."""
    names = np.frombuffer(b"".join(ids), np.int64)
    each = zip(ids, v, wide, strict=True)
    rows = np.concatenate([np.frombuffer(x, float if w else np.float32).reshape(len(i) // 8, -1) for i, x, w in each]).astype(float)
    return names, rows / np.linalg.norm(rows, axis=1, keepdims=True)


class _Best:
    """The ``k`` most similar bank vectors of some queries so far, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, query: np.ndarray, k: int):
        self.ids, self.query, self.k = ids, query, k
        self.sims, self.names = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def meet(self, names: np.ndarray, bank: np.ndarray) -> None:
        """Take bank rows in, a slice of queries at a time."""
        k = self.k
        for at in range(0, len(self.ids), SLICE):
            part = slice(at, at + SLICE)
            sims = self.query[part] @ bank.T
            least = self.sims[part, -1]
            if k < sims.shape[1] and np.isinf(least).any():  # nothing seen yet
                least = np.partition(np.where(np.isnan(sims), -np.inf, sims), sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
            row, col = np.nonzero(sims >= least[:, None] - 1e-11)  # cosines are compared in 12 decimals
            if not len(row):
                continue
            touched = np.unique(row)
            row = np.concatenate([row, np.repeat(touched, k)])
            sims = np.concatenate([np.round(sims[row[: len(col)], col], 12), self.sims[part][touched].ravel()])
            told = np.concatenate([names[col], self.names[part][touched].ravel()])
            order = np.lexsort((told, -sims, row))
            row, sims, told = row[order], sims[order], told[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            first = place < k
            self.sims[at + row[first], place[first]] = sims[first]
            self.names[at + row[first], place[first]] = told[first]

    def rows(self) -> pa.RecordBatch:
        found = np.isfinite(self.sims)
        at, place = np.nonzero(found)
        return pa.RecordBatch.from_pydict({
            "id": self.ids[at], "exemplar": self.names[found], "cosine": self.sims[found], "place": pa.array(place + 1, pa.int32()),
        })


def nearest_exemplars(queries: DataFrame, bank: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """The ``k`` bank vectors with the highest cosine to each query: id, exemplar, cosine, place.

    ``queries``: id, v; ``bank``: exemplar, v. Queries are dealt into ``GROUPS`` groups, more only where a group would
    hold more than 16 blocks. A task holds the queries of one group and the best found for them while the bank
    passes by in blocks, so the bank is shipped once for each group and no list of candidates leaves a task.
    """
    n = queries.agg(F.count(F.lit(1))).first()[0]
    groups = max(GROUPS, -(-n // (16 * block_rows)))
    left = _packed(queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group")), "group")
    right = _packed(bank.select("exemplar", "v", F.lit(0).alias("group")), "group")
    right = right.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))

    def work(batches):
        group, asked, best = None, [], None
        for batch in batches:
            told = list(zip(*(batch.column(c).to_pylist() for c in ("group", "side", "ids", "v", "wide")), strict=True))
            for (g, side), rows in groupby(told, lambda r: r[:2]):
                if g != group:
                    if best:
                        yield best.rows()
                    group, asked, best = g, [], None
                if side == 0:
                    asked += rows
                elif asked:
                    best = best or _Best(*_unpacked(*list(zip(*asked, strict=True))[2:]), k)
                    while some := list(islice(rows, max(1, block_rows // PACK))):
                        best.meet(*_unpacked(*list(zip(*some, strict=True))[2:]))
        if best:
            yield best.rows()

    dealt = both.repartitionById(groups, "group").sortWithinPartitions("group", "side")
    return dealt.mapInArrow(work, "id bigint, exemplar bigint, cosine double, place int")
