"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors a cosine of at least c means a squared distance of at most
2 (1 - c). Vectors are rotated onto the principal axes of a bounded sample and
the axes dealt in turn into low-dimensional blocks. The squared distance is the
sum of the blocks', so if each block has a budget in proportion to its variance,
and the budgets add up to the whole, a linked pair keeps within the budget of one
block at least. Each block is a range join: vectors lie in order along its first
axis, and a strip of them meets those from its least value less the budget's radius
up to its largest one and that radius.

Vectors are dealt into groups by a hash. A task holds one group, in the order of
every block, while half of the other groups pass by in chunks, so each two groups
meet once and a vector travels to half as many tasks as there are groups, for all
blocks alike. Pairs within a block's budget are verified in double precision at once
and count only in the first block that holds them, so pairs are never written: a task
gives a count of links per vector and edges to one vector per linked group. Equal
vectors are one vector with a multiplicity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import components, local_roots
from seqweave.session import cut_lineage

#: Blocks of a vector; vectors that pass at once; rows and columns of a product, pairs verified at once; vectors that fit the rotation.
BLOCKS, CHUNK, STRIP, COLUMNS, PAIRS, SAMPLE = 4, 6144, 512, 4096, 16_384, 10_000
#: Groups of vectors; there are more only where a group would hold more than so many bytes of double precision.
GROUPS, HELD = 12, 64 << 20

FOUND = "node bigint, links bigint, root bigint"
_FOUND = pa.schema([(c, pa.int64()) for c in ("node", "links", "root")])


class Space:
    """A rotation for vectors of up to ``width`` components, the axes of each block and each block's budget."""

    def __init__(self, sample: np.ndarray, width: int, cosine: float, blocks: int):
        self.width, self.cosine = width, cosine
        cov = sample.T @ sample / max(1, len(sample)) if len(sample) else np.eye(width)
        values, axes = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")
        self.rotation = axes[:, order]
        blocks = max(1, min(blocks, width))
        self.axes = [np.arange(b, width, blocks) for b in range(blocks)]
        weight = np.array([max(values[order][a].sum(), 1e-3 / blocks) for a in self.axes])
        self.budget = 2 * (1 - cosine) * (1 + 1e-9) * weight / weight.sum()

    @classmethod
    def of(cls, state: dict) -> Space:
        """The space with these attributes, which travel as plain data: executors need no copy of this module."""
        space = cls.__new__(cls)
        vars(space).update(state)
        return space

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.rotation

    def radius(self, block: int) -> float:
        """A little more than two vectors within the budget can differ by along the block's first axis."""
        return float(np.sqrt(self.budget[block]) * (1 + 1e-6) + 1e-9)


def unit(vectors: list[bytes], width: int, kind: str) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x = np.frombuffer(v, kind)
        out[i, : len(x)] = x
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def packed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, node, size, vector (binary) of all rows, null where a vector links with nothing; and the number type."""
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"

    def work(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False)).astype(kind)  # a null is not a number here
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            rows = []
            for x in np.split(flat, ends[:-1]) if len(ends) else []:
                ok = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                if ok:
                    norm = np.linalg.norm(x.astype(float))
                    ok = bool(np.isfinite(norm)) and norm > 0
                rows.append((x + np.zeros(1, kind)).tobytes() if ok else None)  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["vec_id", "vector"])

    rows = vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(work, "vec_id bigint, vector binary")
    return rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))), kind


class Side:
    """Some vectors, and for each block their order along its first axis, apart by their lengths."""

    def __init__(self, space: Space, node: np.ndarray, times: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, held: bool):
        self.node, self.times, self.vectors, self.rotated = node, times, vectors, space.rotated(vectors)
        lengths = np.unique(sizes)
        self.order, self.along, self.runs, self.lifted = [], [], [], []
        for block, axes in enumerate(space.axes):
            order = np.lexsort((self.rotated[:, block], sizes))
            self.order.append(order)
            self.along.append(self.rotated[order, block])
            ends = np.searchsorted(sizes[order], lengths, "right").tolist()
            self.runs.append(dict(zip(lengths.tolist(), zip([0, *ends[:-1]], ends, strict=True), strict=True)))
            own = self.rotated[np.ix_(order, axes)]
            half, one = (own**2).sum(1)[:, None] / 2, np.ones((len(own), 1))
            slack = 1e-5  # for single precision
            parts = [own, one, half] if held else [own, (space.budget[block] + slack) / 2 - half, -one]
            lifted = np.hstack(parts).astype(np.float32)
            self.lifted.append(lifted.T.copy() if held else lifted)


def near(space: Space, block: int, passing: Side, held: Side, same: bool):
    """Index pairs of vectors within the budget of ``block``, a strip at a time; ``same``: pairs inside one group, once each."""
    radius, x, y = space.radius(block), passing.along[block], held.along[block]
    a, b = passing.lifted[block], held.lifted[block]
    for size, (begin, end) in passing.runs[block].items():
        first, last = held.runs[block].get(size, (0, 0))
        for s in range(begin, end, STRIP):
            e = min(end, s + STRIP)
            low = first + int(np.searchsorted(y[first:last], x[s] - radius, "left"))
            high = first + int(np.searchsorted(y[first:last], x[e - 1] + radius, "right"))
            for at in range(max(low, s) if same else low, high, COLUMNS):
                within = a[s:e] @ b[:, at : min(high, at + COLUMNS)] >= 0  # (budget - squared distance) / 2
                i, j = np.divmod(np.flatnonzero(within), within.shape[1])
                i, j = i + s, j + at
                if same:
                    ahead = i < j
                    i, j = i[ahead], j[ahead]
                if len(i):
                    yield passing.order[block][i], held.order[block][j]


def pair_links(space: Space, passing: Side, held: Side, same: bool = False):
    """Index pairs of linked vectors, each found in the first block that holds it."""
    found_i, found_j = [np.zeros(0, int)], [np.zeros(0, int)]
    for block, axes in enumerate(space.axes):
        for i, j in near(space, block, passing, held, same):
            for k in range(0, len(i), PAIRS):
                x, y = i[k : k + PAIRS], j[k : k + PAIRS]
                linked = np.einsum("ij,ij->i", passing.vectors[x], held.vectors[y]) >= space.cosine
                x, y = x[linked], y[linked]
                square = (passing.rotated[x] - held.rotated[y]) ** 2
                first = square[:, axes].sum(1) <= space.budget[block]
                for before in range(block):
                    first &= square[:, space.axes[before]].sum(1) > space.budget[before]
                found_i.append(x[first])
                found_j.append(y[first])
    return np.concatenate(found_i), np.concatenate(found_j)


class Group:
    """The vectors of one group, and what they are linked with so far: how many, and by whom in the group."""

    def __init__(self, space: Space, *columns: np.ndarray):
        self.space, self.side = space, Side(space, *columns, held=True)
        i, j = pair_links(space, Side(space, *columns, held=False), self.side, same=True)
        n, times = len(self.side.node), self.side.times
        self.links = np.bincount(i, times[j], n) + np.bincount(j, times[i], n)
        self.root = local_roots(n, i, j)

    def meet(self, *columns: np.ndarray) -> pa.RecordBatch:
        """Take in vectors of another group: their links, and one of the group that each is linked with."""
        passing, held = Side(self.space, *columns, held=False), self.side
        i, j = pair_links(self.space, passing, held)
        n = np.bincount(i, held.times[j], len(passing.node))
        self.links += np.bincount(j, passing.times[i], len(held.node))
        anchor = np.full(len(n), len(held.node))
        np.minimum.at(anchor, i, j)
        mine = np.arange(len(held.node))
        if len(i):
            self.root = local_roots(len(mine), np.concatenate([mine, anchor[i]]), np.concatenate([self.root, j]))
        seen = np.flatnonzero(n)
        return self._rows(passing.node[seen], n[seen], held.node[anchor[seen]])

    def rows(self) -> pa.RecordBatch:
        seen = np.flatnonzero(self.links)
        return self._rows(self.side.node[seen], self.links[seen], self.side.node[self.root[seen]])

    @staticmethod
    def _rows(node: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64)), pa.array(root)], schema=_FOUND)


def dealt(nodes: DataFrame, groups: int) -> DataFrame:
    """Rows with ``group``, the task they go to, and ``side``: 0 in the task of their own group, 1 where they pass by.

    A task's group meets those that follow it, up to half of all in a circle; of two that face each other, the first
    takes the second.
    """
    home, away = F.pmod("node", F.lit(groups)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(groups // 2)))
    rows = nodes.withColumn("away", away).withColumn("group", F.pmod(home - F.col("away"), F.lit(groups)))
    rows = rows.where((2 * F.col("away") != groups) | (F.col("group") < F.col("away")) | (F.col("away") == 0))
    return rows.withColumn("side", F.signum("away").cast("int")).drop("away")


def links(nodes: DataFrame, kind: str, cosine: float, blocks: int = BLOCKS, chunk: int = CHUNK,
          sample: int = SAMPLE) -> DataFrame:
    """node, links, root: vectors (by multiplicity) linked with each node in one task, and one node of its group there.

    ``nodes``: node, times, vector. The rotation is fitted on ``sample`` vectors at most; every vector is joined.
    ``chunk`` vectors pass a task's group at once.
    """
    item = 4 if kind == "<f4" else 8
    longest, n = nodes.agg(F.max(F.octet_length("vector")), F.count("*")).first()
    width = int((longest or item) // item)
    drawn = nodes.orderBy("node").limit(sample).select("vector").collect()
    space = Space(unit([bytes(r[0]) for r in drawn], width, kind), width, cosine, blocks)
    shared = nodes.sparkSession.sparkContext.broadcast(vars(space))
    groups = max(GROUPS, -(-n * width * 8 // HELD))

    def columns(rows: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
        vectors = rows.column("vector").to_pylist()
        sizes = np.array([len(v) for v in vectors], np.int64) // item
        return rows.column("node").to_numpy(), rows.column("times").to_numpy(), sizes, unit(vectors, width, kind)

    def work(batches):
        space, number, own, group = Space.of(shared.value), None, [], None
        for batch in batches:
            keys = np.stack([batch.column("group").to_numpy(), batch.column("side").to_numpy()])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if keys[0, a] != number:
                    if own or group:
                        yield (group or Group(space, *map(np.concatenate, zip(*own, strict=True)))).rows()
                    number, own, group = keys[0, a], [], None
                if keys[1, a] == 0:
                    own.append(columns(batch.slice(a, b - a), space.width))
                    continue
                if own:
                    group, own = Group(space, *map(np.concatenate, zip(*own, strict=True))), []
                for at in range(a, b if group else a, chunk):
                    yield group.meet(*columns(batch.slice(at, min(chunk, b - at)), space.width))
        if own or group:
            yield (group or Group(space, *map(np.concatenate, zip(*own, strict=True)))).rows()

    tasks = dealt(nodes.select("node", "times", "vector"), groups).repartitionById(groups, "group")
    return cut_lineage(tasks.sortWithinPartitions("group", "side").mapInArrow(work, FOUND))


def link_vectors(vectors: DataFrame, cosine: float = 0.9, blocks: int = BLOCKS, chunk: int = CHUNK,
                 sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other vectors with at least that cosine, component_id is the smallest vec_id reachable by
    links, itself included, kept whether that is the vector's own. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and so do vectors of different lengths. Repeated rows are vectors of
    their own. A null vec_id counts as larger than all others. Other columns, labels too, are not read.
    """
    rows, kind = packed(vectors)
    rows = cut_lineage(rows)
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("times"), F.first("vector").alias("vector"), F.min("vec_id").alias("least")
    )
    nodes = cut_lineage(nodes)
    found = links(nodes.select("node", "times", "vector"), kind, cosine, blocks, chunk, sample)
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    state = nodes.select("node", "times", "least").join(totals, "node", "left").join(group, "node", "left")
    state = state.withColumn("component", F.coalesce("component", "node"))
    smallest = state.groupBy("component").agg(F.min("least").alias("component_id"))
    state = state.join(smallest, "component").select(
        "node", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    out = rows.select("vec_id", "node").join(state, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
