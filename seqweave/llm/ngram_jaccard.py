"""N-gram Jaccard join with adaptive multi-match prefixes.

Two texts link when their sets of word shingles have a Jaccard similarity of at
least a percentage. With all shingles in one global order (rare first), two sets
that overlap enough share at least l shingles among the first |r| - o + l of
each, o being the least overlap that a partner of r must have. Each document
chooses its own l: a longer prefix costs more postings and drops more candidates.

How the work is dealt:

* pass 1 gives each text a class (equal shingle sets are one node) and adds up
  a table of ``BUCKETS`` counters, the estimated frequency of every shingle;
  it is the global order and the cost estimate, of fixed size at any scale;
* pass 2 emits each node's prefix; postings meet by shingle, hot shingles
  salted. In each of a few rounds a shingle's run is sorted anew and each node
  paired with the first of the run and with the one before it, never with all.
  The partner that a node meets most often is verified and merged, which joins
  families of near copies from both ends;
* what those rounds leave apart is settled exactly: nodes of different
  components that share a prefix shingle meet in tiles of bounded size, at the
  first shingle they share. Inside a tile, pairs that share as many prefix
  shingles as both prefixes promise are candidates, and each is verified. Pairs
  are never written: a tile gives a spanning forest of its links, at most one edge a node.

Skipping a pair inside one component loses nothing: only components are asked for.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqweave.llm.common import (
    arrow_rows,
    by_text,
    components,
    local_roots,
    mixed,
    shingle_sets,
    signed,
    slices,
    whole_row,
    with_text,
)
from seqweave.session import cut_lineage

#: Counters of the frequency table (4 bytes each) and pieces it travels in.
BUCKETS, PIECES = 1 << 20, 64
#: Longest extra prefix, and the price of verifying a pair in matched postings.
LONGEST, VERIFY_PRICE = 8, 20.0
#: Estimated partners of a shingle that no counter shows to be frequent.
RARE = 0.05
#: Postings of a shingle that one salted run holds, about.
RUN = 20_000
#: Rounds of linear pairing before the exact one, and orders of the runs in each.
PAIRINGS, ORDERS = 2, 2
#: Nodes and shingles that a side of a tile holds, about; shingles of a slice of its product.
SIDE, WEIGHT, SLICE = 512, 400_000, 2048
#: Bytes of text that a task cuts into shingles at once (each takes some 40 bytes of arrays for a while), of compressed
#: texts whose pairs it verifies at once, and rows of a tile that it turns into Python's own at once.
TAKEN, PRESSED, ROWS = 1 << 20, 1 << 18, 512

NODES = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("n", pa.int32()),
                   ("piece", pa.int32()), ("counts", pa.binary())])
POSTINGS = pa.schema([("token", pa.int64()), ("ways", pa.int32()), ("node", pa.int64()), ("n", pa.int32()),
                      ("need", pa.int32()), ("pos", pa.int32())])
TEXTS = pa.schema([("node", pa.int64()), ("text", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def nodes_of(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each shingle set: the node id and a check."""
    full = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[full]
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(sizes), np.uint64)
        if len(full):
            sums[full] = np.add.reduceat(mixed(values ^ np.uint64(seed)), begin)
        out.append(signed(mixed(sums + sizes.astype(np.uint64))))
    return out[0], out[1]


def classes(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, node, check, n of every row, and the frequency table (each node once per task)."""

    def work(batches):
        table, seen = np.zeros(BUCKETS, np.int64), set()
        for batch in slices(batches, "text", TAKEN):
            values, sizes = shingle_sets(batch.column("text").to_pylist(), width)
            nodes, checks = nodes_of(values, sizes)
            fresh = np.array([n not in seen and not seen.add(n) for n in nodes.tolist()], bool)
            told = values[np.repeat(fresh, sizes)]
            table += np.bincount((told >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
            none = [None] * len(nodes)
            yield arrow_rows(NODES, doc_id=batch.column("doc_id"), node=nodes, check=checks, n=sizes.astype(np.int32),
                             piece=none, counts=none)
        if table.any():
            parts = np.split(np.minimum(table, 2**31 - 1).astype(np.int32), PIECES)
            none = [None] * PIECES
            yield arrow_rows(NODES, doc_id=none, node=none, check=none, n=none, piece=range(PIECES),
                             counts=[p.tobytes() for p in parts])

    rows = cut_lineage(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(
            work, "doc_id bigint, node bigint, check bigint, n int, piece int, counts binary"
        )
    )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(counts, np.int32)
                sums[piece] = new.astype(np.int64) + sums.get(piece, 0)
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(list(sums), pa.int32()), "counts": [v.tobytes() for v in sums.values()]}
            )

    pieces = rows.where("piece is not null").select("piece", "counts").repartition("piece")
    table = np.zeros((PIECES, BUCKETS // PIECES), np.int64)
    for r in pieces.mapInArrow(add, "piece int, counts binary").collect():  # PIECES rows of fixed size
        table[r["piece"]] += np.frombuffer(r["counts"], np.int64)
    return rows.where("piece is null").drop("piece", "counts"), table.ravel()


def usually(frequency: np.ndarray) -> float:
    """What a counter holds at most without any frequent shingle."""
    middle = float(np.median(frequency))
    return middle + 3 * middle**0.5


def least_overlap(n, percent: int):
    return -(-percent * n // 100)


def prefix_of(shingles: np.ndarray, counts: np.ndarray, usual: float, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The document's prefix in global order, its estimated frequencies, and how many of it a partner must share.

    The cost of l is the estimated number of postings met by the first
    n - o + l shingles, each at the price of one match plus 1/l of a
    verification; the l of least cost is taken.
    """
    n = len(shingles)
    overlap = least_overlap(n, percent)
    order = np.lexsort((shingles, counts))
    excess = np.maximum(counts[order] - usual, 0.0) + RARE
    longest = max(1, min(LONGEST, overlap))
    need = np.arange(1, longest + 1)
    met = np.cumsum(excess)[n - overlap + need - 1]
    best = int(np.argmin(met * (1.0 + VERIFY_PRICE / need))) + 1
    kept = order[: n - overlap + best]
    return shingles[kept], excess[: len(kept)], best


def postings(docs: DataFrame, frequency: np.ndarray, width: int, percent: int) -> DataFrame:
    """token, ways, node, n, need, pos: the prefix of every node, each node once per task; ways: salts of the token."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(frequency, 2**31 - 1).astype(np.int32))
    usual = usually(frequency)

    def work(batches):
        seen, counts = set(), shared.value
        for batch in slices(batches, "text", TAKEN):
            values, sizes = shingle_sets(batch.column(0).to_pylist(), width)
            nodes = nodes_of(values, sizes)[0].tolist()
            tokens, ways, needs, owners, lengths, totals = [], [], [], [], [], []
            for node, s in zip(nodes, by_text(values, sizes), strict=True):
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                kept, excess, need = prefix_of(s, counts[(s >> np.uint64(44)).astype(np.int64)], usual, percent)
                tokens.append(kept)
                ways.append(excess)
                needs.append(need), owners.append(node), lengths.append(len(kept)), totals.append(len(s))
            if tokens:
                many = (np.concatenate(ways) // RUN + 1).astype(np.int32)
                owner, total, need = (np.repeat(np.array(x, np.int64), lengths) for x in (owners, totals, needs))
                yield arrow_rows(POSTINGS, token=signed(np.concatenate(tokens)), ways=many, node=owner,
                                 n=total.astype(np.int32), need=need.astype(np.int32),
                                 pos=np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]))

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(
        work, "token bigint, ways int, node bigint, n int, need int, pos int"
    )


def shared_postings(posted: DataFrame) -> DataFrame:
    """Postings of shingles that more than one node has, each node once; salted shingles are all kept."""

    def work(batches):
        last = held = None  # token, salt and node of the row before; its row, as long as it stands alone
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(7)]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.concatenate([[h], c]) for h, c in zip(held, columns, strict=True)]
            token, salt, node, ways = (columns[i] for i in (0, 1, 2, 3))
            same = np.zeros(len(token), bool)
            same[1:] = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            again = np.zeros(len(token), bool)  # the same node, from another task
            again[1:] = same[1:] & (node[1:] == node[:-1])
            if held is None and last is not None:
                same[0] = last[:2] == (token[0], salt[0])
                again[0] = same[0] and last[2] == node[0]
            follows = same & ~again
            run = np.cumsum(~same)
            joined = np.zeros(run[-1] + 1, bool)
            joined[run[follows]] = True
            keep = ~again & (joined[run] | (ways > 1))
            open_ = not keep[-1] and not again[-1]
            if again[-1] and not joined[run[-1]] and ways[-1] == 1 and run[-1] > 0:  # repeated, but still a single node
                begin = int(np.flatnonzero(~same)[-1])
                held = [c[begin] for c in columns]
            else:
                held = [c[-1] for c in columns] if open_ else None
            last = (token[-1], salt[-1], node[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[i][keep], f.type) for i, f in zip((0, 3, 2, 4, 5, 6), POSTINGS, strict=True)], schema=POSTINGS
            )

    salted = posted.withColumn("salt", F.pmod(F.xxhash64("node"), "ways").cast("int"))
    ordered = salted.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    return ordered.select("token", "salt", "node", "ways", "n", "need", "pos").mapInArrow(
        work, "token bigint, ways int, node bigint, n int, need int, pos int"
    )


def pairings(met: DataFrame, turn: int) -> DataFrame:
    """a, b: the partner that each node meets most often as the first of a shingle's run, and as the one before it.

    ``met``: token, ways, node, n, need, component. Runs are sorted by size in turn 0 and by a hash of the node and
    the turn afterwards. Only partners of other components that it meets ``need`` times count.
    """
    kind = "node bigint, component bigint, need int, first bigint, first_c bigint, before bigint, before_c bigint"
    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in kind.split(", ")])

    def work(batches):
        last = None  # token, salt, node, component of the row before; then the first row's node and component
        for batch in batches:
            token, salt, node, component, need = (batch.column(i).to_numpy() for i in range(5))
            if not len(token):
                continue
            same = np.zeros(len(token), bool)
            same[1:] = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            before, before_c = np.roll(node, 1), np.roll(component, 1)
            if last is not None and last[:2] == (token[0], salt[0]):
                same[0], before[0], before_c[0] = True, last[2], last[3]
            begin = np.maximum.accumulate(np.where(same, -1, np.arange(len(token))))
            carried = last[4:] if last is not None else (0, 0)
            first = np.where(begin >= 0, node[begin], carried[0])
            first_c = np.where(begin >= 0, component[begin], carried[1])
            last = (token[-1], salt[-1], node[-1], component[-1], first[-1], first_c[-1])
            keep = same & ((first_c != component) | (before_c != component))
            yield arrow_rows(schema, **{n: c[keep] for n, c in zip(
                schema.names, (node, component, need, first, first_c, before, before_c), strict=True)})

    salt = F.pmod(F.xxhash64("node", F.lit(turn)), "ways").cast("int")
    order = F.col("n").cast("bigint") if turn == 0 else F.xxhash64(F.lit(turn), "node")
    rows = met.select("token", salt.alias("salt"), "node", "component", "need", order.alias("place"))
    rows = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "place", "node").drop("place")
    rows = cut_lineage(rows.mapInArrow(work, kind))

    def favourite(other):
        seen = rows.where(F.col(f"{other}_c") != F.col("component")).groupBy("node", F.col(other).alias("other"))
        seen = seen.agg(F.count("*").alias("c"), F.min("need").alias("need")).where("c >= need")
        best = seen.groupBy("node").agg(F.max(F.struct("c", "other")).alias("m"))
        return best.select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b"))

    return favourite("first").unionByName(favourite("before"))


def possible(met: DataFrame) -> DataFrame:
    """Nodes that can link at all: a link shares the smaller of both needs in prefix shingles."""
    least = met.groupBy("token").agg(F.min("need").alias("other"))
    bound = met.join(least, "token").groupBy("node").agg(
        F.count("*").alias("c"), F.min(F.least("need", "other")).alias("bound")
    )
    return bound.where("c >= bound").select("node")


def texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, text (compressed) of the wanted nodes, one text each."""

    def work(batches):
        seen, press = set(), zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text", TAKEN):
            given = batch.column(0).to_pylist()
            values, sizes = shingle_sets(given, width)
            nodes, out = [], []
            for node, n, text in zip(nodes_of(values, sizes)[0].tolist(), sizes.tolist(), given, strict=True):
                if n and node not in seen:
                    seen.add(node)
                    nodes.append(node), out.append(press.compress(text.lower()))
            yield arrow_rows(TEXTS, node=nodes, text=out)

    every = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(work, "node bigint, text binary")
    return cut_lineage(every.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))


def verified(pairs: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the percentage, checked on their whole texts."""

    def work(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in slices(batches, "ta", PRESSED):
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            given = dict(zip(a, ta, strict=True)) | dict(zip(b, tb, strict=True))
            values, sizes = shingle_sets([open_.decompress(t) for t in given.values()], width)
            sets = dict(zip(given, by_text(values, sizes), strict=True))
            out = []
            for x, y in zip(a, b, strict=True):
                u, v = sets[x], sets[y]
                both = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * both >= percent * (len(u) + len(v) - both):
                    out.append((x, y))
            yield arrow_rows(LINKS, a=[x for x, _ in out], b=[y for _, y in out])

    met = (
        pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        .join(held.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )
    return met.mapInArrow(work, "a bigint, b bigint")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of shared values of each set on the left with each on the right, as sums of products of 0 and 1."""
    va, vb = np.concatenate(left), np.concatenate(right)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    shared = np.intersect1d(va, vb)
    total = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return total
    sides = []
    for v, r in ((va, ra), (vb, rb)):
        at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        hit = shared[at] == v
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], r[hit][order]))
    for start in range(0, len(shared), SLICE):
        parts = []
        for (at, r), n in zip(sides, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(at, (start, start + SLICE))
            x = np.zeros((n, min(SLICE, len(shared) - start)), np.float32)
            x[r[a:b], at[a:b] - start] = 1
            parts.append(x)
        total += parts[0] @ parts[1].T
    return total


def tiled(met: DataFrame, percent: int) -> DataFrame:
    """Rows dealt into tiles: token, kind, i, j, side, node, component; what shares a first token meets in one tile.

    Of a pair of sizes a <= b the smaller shares a shingle among its first a - 2p/(100+p) a + 1. A shingle needs such
    a row, and two components. Nodes that have the same shingle just before this one met there already, and nodes of
    one component need not meet: the largest such group of each shingle meets only the rest.
    """
    p = percent
    reach = F.expr(f"n - (({p} * n + 99) div 100) + 1")
    small = F.expr(f"pos < n - ((2 * {p} * n + {99 + p}) div {100 + p}) + 1")
    near = met.where(F.col("pos") < reach)
    open_ = near.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(small).alias("s"))
    near = near.join(open_.where("s and lo < hi").select("token"), "token", "left_semi")
    own = Window.partitionBy("node").orderBy("pos")
    near = cut_lineage(near.select("token", "node", "n", "component", F.lag("token").over(own).alias("past")))
    names = []
    for k, c in enumerate(("past", "component")):
        most = near.where(F.col(c).isNotNull()).groupBy("token", c).agg(F.count("*").alias("k"))
        names.append(most.groupBy("token").agg(F.max(F.struct("k", F.lit(k).alias("by"), F.col(c).alias("name"))).alias("m")))
    large = names[0].unionByName(names[1]).groupBy("token").agg(F.max("m").alias("m"))
    near = near.join(large, "token")
    large = F.coalesce(F.when(F.col("m.by") == 0, F.col("past")).otherwise(F.col("component")) == F.col("m.name"), F.lit(False))
    near = near.withColumn("large", large).drop("m", "past")
    held = lambda which: F.ceil(F.greatest(
        F.count(F.when(F.col("large") == which, 1)) / SIDE, F.sum(F.when(F.col("large") == which, F.col("n"))) / WEIGHT
    ))
    chunks = near.groupBy("token").agg(F.coalesce(held(False), F.lit(0)).alias("few"), F.coalesce(held(True), F.lit(0)).alias("many"))
    near = near.join(chunks.where("few > 0"), "token")
    near = near.withColumn("c", F.pmod(F.xxhash64("node"), F.when(F.col("large"), F.col("many")).otherwise(F.col("few"))))
    tile = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    count = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    c, few, many = F.col("c"), F.col("few").cast("bigint"), F.col("many").cast("bigint")
    rest = F.concat(
        F.transform(count(few), lambda j: tile(0, F.least(c, j), F.greatest(c, j), (c > j).cast("int"))),
        F.transform(count(many), lambda j: tile(1, c, j, F.lit(0))),
    )
    large = F.transform(count(few), lambda i: tile(1, i, c, F.lit(1)))
    return near.select("token", F.explode(F.when(F.col("large"), large).otherwise(rest)).alias("t"), "node", "component").select(
        "token", "t.*", "node", "component"
    )


TILE_ROWS = "token bigint, kind int, i bigint, j bigint, side int, node bigint, component bigint"


def each_tile(batches, work):
    """Call ``work`` with the rows on either side of each tile; rows of a tile follow one another."""
    rows, tile = [], None

    def told():
        left = [r for r in rows if r[4] == 0]
        alone = bool(rows) and tile[1] == 0 and tile[2] == tile[3]  # one chunk with itself
        right = left if alone else [r for r in rows if r[4] == 1]
        return work(left, right) if left and right and len(rows) > 1 else []

    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            for row in zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns), strict=True):
                if row[:4] != tile:
                    yield told()
                    rows, tile = [], row[:4]
                rows.append(row)
    yield told()


def apart_enough(left, right, sizes, percent: int) -> np.ndarray:
    """Which pairs of a tile have different components and sizes near enough."""
    ca, cb = (np.array([r[6] for r in x]) for x in (left, right))
    na, nb = (np.array(n) for n in sizes)
    near = 100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb)
    return near & (ca[:, None] != cb)


def candidates(met: DataFrame, percent: int) -> DataFrame:
    """Tile rows of the nodes that share as many prefix shingles with another component's node as both promise.

    ``met`` holds all prefix shingles that stand in several components, so it tells all that such a pair shares. A pair
    counts in the tile of the first shingle that it shares, and in no other.
    """
    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in TILE_ROWS.split(", ")])

    def work(left, right):
        possible = apart_enough(left, right, ([r[7] for r in left], [r[7] for r in right]), percent)
        need = np.minimum(np.array([r[8] for r in left])[:, None], np.array([r[8] for r in right]))
        if possible.any():
            lists = [[np.array(r[9], np.int64) for r in x] for x in (left, right)]
            earlier = [[t[: r[9].index(r[0])] for r, t in zip(x, y, strict=True)] for x, y in zip((left, right), lists, strict=True)]
            possible &= (overlaps(*lists) >= need) & (overlaps(*earlier) == 0)
        found = {left[k][:7] for k in np.flatnonzero(possible.any(1))}
        return [*(found | {right[k][:7] for k in np.flatnonzero(possible.any(0))})]

    def told(batches):
        for rows in each_tile(batches, work):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                                 schema=schema)

    tile = ["token", "kind", "i", "j"]
    lists = met.groupBy("node").agg(F.first("n").alias("n"), F.first("need").alias("need"),
                                       F.array_sort(F.collect_list(F.struct("pos", "token")))["token"].alias("tokens"))
    dealt = tiled(met, percent).join(lists, "node").select(*tile, "side", "node", "component", "n", "need", "tokens")
    return cut_lineage(dealt.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(told, TILE_ROWS))


def tile_links(met: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links between different components in each tile.

    Nodes that the links of a tile join, directly or over others, each get an edge to the first of their group.
    """

    def told(batches):
        open_, known = zstandard.ZstdDecompressor(), {}

        def sets(rows):
            fresh = {r[5]: r[7] for r in rows if r[5] not in known}
            if len(known) + len(fresh) > 4 * SIDE:
                known.clear()
                fresh = {r[5]: r[7] for r in rows}
            values, sizes = shingle_sets([open_.decompress(t) for t in fresh.values()], width)
            known.update(zip(fresh, by_text(values, sizes), strict=True))
            return [known[r[5]] for r in rows]

        def work(left, right):
            u, v = sets(left), sets(right)
            na, nb = [len(x) for x in u], [len(x) for x in v]
            possible = apart_enough(left, right, (na, nb), percent)
            if not possible.any():
                return []
            both = overlaps(u, v)
            linked = possible & (100 * both >= percent * (np.array(na)[:, None] + np.array(nb) - both))
            i, j = np.nonzero(linked)
            nodes = [r[5] for r in left] + ([] if right is left else [r[5] for r in right])
            root = local_roots(len(nodes), i, j if right is left else j + len(left))
            return [(nodes[k], nodes[root[k]]) for k in np.flatnonzero(root != np.arange(len(root)))]

        for found in each_tile(batches, work):
            if found:
                yield arrow_rows(LINKS, a=[x for x, _ in found], b=[y for _, y in found])

    tile = ["token", "kind", "i", "j"]
    rows = candidates(met, percent).join(held, "node").select(*tile, "side", "node", "component", "text")
    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(told, "a bigint, b bigint").distinct()


def merged(group: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component after more links: the components themselves are linked, then named anew."""
    if group is None:
        return cut_lineage(components(links))
    ends = links
    for end in ("a", "b"):
        named = group.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        ends = ends.join(named, end, "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    more = components(ends).withColumnRenamed("component", "new")
    moved = group.join(more.withColumnRenamed("node", "component"), "component", "left")
    moved = moved.select("node", F.coalesce("new", "component").alias("component"))
    fresh = more.select("node", F.col("new").alias("component")).join(group, "node", "left_anti")
    return cut_lineage(moved.unionByName(fresh))


def apart(met: DataFrame, group: DataFrame) -> DataFrame:
    """Postings with their components, of the shingles that stand in more than one of them."""
    named = met.drop("component").join(group, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    split = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return cut_lineage(named.join(split.select("token"), "token", "left_semi"))


def linked_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` by component: doc_id, node, check, n, component.

    ``component`` is a node id; rows with an empty shingle set (null text, no
    word) have a null one, for they link with nothing. One row per input row.
    """
    rows, frequency = classes(docs, width)
    met = cut_lineage(shared_postings(postings(docs, frequency, width, percent)))
    held = texts(docs, possible(met), width)
    met, group = met.withColumn("component", F.col("node")), None
    for turn in range(PAIRINGS):
        pairs = [pairings(met, turn * ORDERS + k) for k in range(ORDERS)]
        pairs = cut_lineage(reduce(DataFrame.unionByName, pairs).distinct())
        links = cut_lineage(verified(pairs, held, width, percent))
        group = merged(group, links)
        met = apart(met, group)
        if met.isEmpty():
            break
    met = cut_lineage(met.join(possible(met), "node", "left_semi"))  # all its shingles have other components
    group = merged(group, cut_lineage(tile_links(met, held, width, percent)))
    named = rows.join(group, "node", "left")
    return named.withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "node")))


def link_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Words are those of the A-Z lower-cased text between ASCII white space; a
    text of fewer than ``width`` words is one shingle. Null text and text
    without words have no shingle and stay alone. Rows with equal shingle sets
    link; repeated rows give repeated results. A null doc_id counts as larger
    than all others. Columns beyond doc_id and text are not read.
    """
    rows = cut_lineage(linked_rows(docs, width, percent))
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "component", "left").select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` with one document of each linked group, all columns kept.

    Of a group the row with the smallest doc_id stays (null last, then the smallest
    node; of repeated rows one). Rows without words link with nothing and all stay.
    """
    rows = cut_lineage(linked_rows(docs, width, percent))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    kept = rows.where("component is not null").groupBy("component").agg(F.min(place).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("_id"), F.col("k.node").alias("_node"))
    keyed = docs.select(whole_row(docs), F.col("doc_id").cast("bigint").alias("id"))
    form = T.StructType([keyed.schema["row"], keyed.schema["id"], T.StructField("node", T.LongType())])

    def work(batches):
        for batch in slices(with_text(batches), "text", TAKEN):
            values, sizes = shingle_sets(batch.column("text").to_pylist(), width)
            nodes = pa.array(nodes_of(values, sizes)[0], mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), nodes], names=["row", "id", "node"])

    noded = keyed.mapInArrow(work, form)
    same = (noded["node"] == kept["_node"]) & noded["id"].eqNullSafe(kept["_id"])
    single = noded.join(kept, same, "left_semi").dropDuplicates(["id", "node"])
    return single.unionByName(noded.where("node is null")).select("row.*")
