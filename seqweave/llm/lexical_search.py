"""Ranked lexical search over posting lists that are cut into blocks of similar documents.

The index is made where the texts lie: a task sorts its documents by a similarity sketch and cuts them into cells, so
each posting list falls into one block a cell. A block holds its postings with their impacts and the largest of them;
the largest impacts of all terms of a cell are the coordinatewise maximum over its documents, so their weighed sum
bounds the score of every document in it. A row of the index is a cell with its blocks. Queries are dealt with in
groups of bounded size: a task bounds all cells for all queries of a group, scores the cell with the highest bound of
each query first and then only cells whose bound reaches the k-th best score it has found; it returns k documents a
query.
"""

from __future__ import annotations

import contextlib
import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.llm.common import slices
from seqweave.session import cut_lineage

#: Documents of a cell, bytes of text sorted at once, and cells looked at in one step.
CELL, SORTED, STEP = 32, 2 << 20, 16
#: Cells that Parquet's reader holds and a task's search is sent at once.
CELLS = 16
#: Postings scored at once.
POSTINGS = 500_000
#: Queries of a group and bytes of their texts (one query at least): what a job sends to its tasks.
QUERIES, QUERY_BYTES = 500, 4 << 20

#: Stands for a doc_id that is null, which comes first among equal scores.
NULL = -(1 << 63)

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: In UTF-8 the characters of a term are letters and digits of ASCII and all bytes from 128 on.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[c for c in range(256) if c > 127 or chr(c).isalnum()]] = True

INDEX = "cell bigint, ids array<bigint>, terms array<string>, docs array<int>, tops array<int>, slots array<int>, impacts array<int>"
_INDEX = pa.schema([("cell", pa.int64()), ("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())),
                    *((c, pa.list_(pa.int32())) for c in ("docs", "tops", "slots", "impacts"))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for batch in slices(batches, "text", 1 << 20):
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        held = _IS_TERM[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        starts = np.cumsum(held & np.concatenate([[True], ~held[:-1]]))
        counts = np.diff(starts[np.cumsum([len(t) + 1 for t in texts]) - 1], prepend=0)
        docs, total = docs + int((counts > 0).sum()), total + int(counts.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], ["docs", "total"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""
    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_counted, "docs bigint, total bigint")
    n, total = rows.agg(F.sum("docs"), F.sum("total")).first()
    return n or 0, total or 0


class _Shard:
    """Terms of the documents that one step of a task sorts together."""

    def __init__(self, texts: list[bytes]):
        numbers: dict[bytes, int] = {}
        found = [np.array([numbers.setdefault(t, len(numbers)) for t in _TERM.findall(x.lower())], np.int32) for x in texts]
        self.n = np.array([len(f) for f in found], np.int64)
        ids = np.concatenate(found) if found else np.zeros(0, np.int32)
        self.terms = list(numbers)
        width = max(1, len(self.terms))
        pairs, self.tf = np.unique(np.repeat(np.arange(len(texts)), self.n) * width + ids, return_counts=True)
        self.doc, self.term = pairs // width, pairs % width

    def order(self) -> np.ndarray:
        """Documents with terms, similar ones side by side: by 32 signs, each a vote of the terms' hashes."""
        hashes = np.array([zlib.crc32(t) for t in self.terms], ">u4")
        signs = np.unpackbits(hashes.view(np.uint8).reshape(-1, 4), axis=1).astype(np.int8) * 2 - 1
        held = np.flatnonzero(self.n)
        begin = np.searchsorted(self.doc, held)
        votes = np.add.reduceat(signs[self.term], begin, axis=0, dtype=np.int32) if len(held) else np.zeros((0, 32), np.int32)
        sketch = np.packbits(votes > 0, axis=1).view(">u4").ravel()
        return held[np.argsort(sketch, kind="stable")]


def _listed(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def index(docs: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """The index of ``docs``, one row a cell: cell, ids of its documents, and its blocks in the order of terms.

    ``docs`` and ``tops`` count a block's postings and give its largest impact; ``slots`` (places in ``ids``) and
    ``impacts`` hold the postings of all blocks one after the other. Rows that repeat a doc_id have slots of their
    own; null and empty texts are in no cell.
    """
    n_docs, total = size or corpus_size(docs)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", SORTED):
            shard = _Shard([t or b"" for t in batch.column("text").to_pylist()])
            order = shard.order()
            if not len(order):
                continue
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array(order))
            place = np.full(batch.num_rows, -1)
            place[order] = np.arange(len(order))
            m = 10 + 90 * shard.n * n_docs // total
            impact = 1_000_000_000 * shard.tf // (1000 * shard.tf + 8 * m[shard.doc])
            at = place[shard.doc]
            by = np.lexsort((at, shard.term, at // CELL))
            at, term, impact = at[by], shard.term[by], impact[by]
            cell = at // CELL
            start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (cell[1:] != cell[:-1])]))
            counts = np.diff(np.append(start, len(at)))
            tops = np.maximum.reduceat(impact, start)
            names = pa.array(shard.terms, pa.binary()).cast(pa.string())
            many = -(-len(order) // CELL)
            for a in range(0, many, STEP):
                b = min(many, a + STEP)
                x, y = np.searchsorted(cell[start], (a, b))
                low, high = np.searchsorted(cell, (a, b))
                blocks = np.searchsorted(cell[start[x:y]], np.arange(a, b), "right")
                posts = np.searchsorted(cell[low:high], np.arange(a, b), "right")
                held = min(len(order), b * CELL) - a * CELL
                ints = lambda v: pa.array(v, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(first + np.arange(a, b)),
                    _listed(ids.slice(a * CELL, held), np.minimum(np.arange(1, b - a + 1) * CELL, held)),
                    _listed(names.take(pa.array(term[start[x:y]])), blocks), _listed(ints(counts[x:y]), blocks),
                    _listed(ints(tops[x:y]), blocks), _listed(ints(at[low:high] % CELL), posts), _listed(ints(impact[low:high]), posts),
                ], schema=_INDEX)
            first += many

    if not total:
        return docs.sparkSession.createDataFrame([], INDEX)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return cut_lineage(rows.mapInArrow(cells, INDEX))


class Group:
    """Some queries: their terms, and for each term the queries that hold it."""

    def __init__(self, rows: list):
        self.items = [r.item_id for r in rows]
        numbers: dict[str, int] = {}
        pairs = sorted({(numbers.setdefault(t, len(numbers)), q) for q, r in enumerate(rows) for t in r.terms or []})
        self.terms = list(numbers)
        self.query = np.array([q for _, q in pairs], np.int64)
        self.count = np.bincount([t for t, _ in pairs], minlength=len(numbers)).astype(np.int64)
        self.weight = np.zeros(len(numbers), np.int64)


class Search:
    """The best documents of a group's queries in the cells that a task has seen, best first."""

    def __init__(self, group: Group, k: int):
        self.group, self.k = group, k
        self.names = pa.array(group.terms, pa.string())
        self.begin = np.cumsum(group.count) - group.count
        self.least = np.ones(len(group.items), np.int64)
        self.best = np.zeros((3, 0), np.int64)  # query, score, document
        self.pairs = self.scored = 0

    def look(self, cells: pa.RecordBatch) -> None:
        """Take in some cells of the index."""
        g, n = self.group, cells.num_rows
        lists = {c: cells.column(c) for c in ("terms", "docs", "tops", "slots", "impacts", "ids")}
        flat = {c: v.flatten() for c, v in lists.items()}
        term = pc.fill_null(pc.index_in(flat["terms"], value_set=self.names), -1).to_numpy().astype(np.int64)
        cell = np.repeat(np.arange(n), lists["terms"].value_lengths().to_numpy())
        stop = np.cumsum(flat["docs"].to_numpy())
        known = np.flatnonzero(term >= 0)
        term, cell, docs = term[known], cell[known], flat["docs"].to_numpy()[known].astype(np.int64)
        first, tops = stop[known] - docs, flat["tops"].to_numpy()[known]
        times = g.count[term]
        block = np.repeat(np.arange(len(term)), times)
        query = g.query[np.repeat(self.begin[term] - np.cumsum(times) + times, times) + np.arange(len(block))]
        weight = g.weight[term[block]]
        pair = query * n + cell[block]
        # Products are whole numbers below 2^35, so their sums are exact in doubles for more than 100,000 terms.
        bound = np.bincount(pair, weight * tops[block], len(g.items) * n).reshape(len(g.items), n)
        ids = flat["ids"].fill_null(NULL).to_numpy()
        id_first = np.cumsum(lists["ids"].value_lengths().to_numpy()) - lists["ids"].value_lengths().to_numpy()
        slots, impacts = flat["slots"].to_numpy(), flat["impacts"].to_numpy()
        self.pairs += int((bound > 0).sum())
        done = np.zeros_like(bound, bool)
        for step in range(2):
            want = (bound >= self.least[:, None]) & ~done
            if step == 0:
                top = bound.argmax(1)
                mine = np.zeros_like(want)
                mine[np.arange(len(top)), top] = True
                want &= mine
            done |= want
            self.scored += int(want.sum())
            chosen = np.flatnonzero(want.ravel()[pair])
            number = (np.cumsum(want.ravel()) - 1)[pair]
            part = np.cumsum(np.bincount(number[chosen], docs[block[chosen]])) // POSTINGS
            for i in np.unique(part):
                mine = chosen[part[number[chosen]] == i]
                self._score(mine, want, number, n, block, docs, first, weight, slots, impacts, ids, id_first)

    def _score(self, chosen, want, number, n, block, docs, first, weight, slots, impacts, ids, id_first):
        """Score the documents of some pairs of query and cell, whose blocks are all in ``chosen``."""
        length = docs[block[chosen]]
        row = np.repeat(chosen, length)
        at = np.repeat(first[block[chosen]] - np.cumsum(length) + length, length) + np.arange(len(row))
        key = number[row] * CELL + slots[at]
        score = np.bincount(key, weight[row] * impacts[at]).astype(np.int64)
        hit = np.flatnonzero(score)
        where = np.flatnonzero(want.ravel())[hit // CELL]
        found = np.stack([where // n, score[hit], ids[id_first[where % n] + hit % CELL]])
        both = np.concatenate([self.best, found], axis=1)
        both = both[:, np.lexsort((both[2], -both[1], both[0]))]
        start = np.searchsorted(both[0], np.arange(len(self.least) + 1))
        place = np.arange(both.shape[1]) - start[both[0]]
        self.best = both[:, place < self.k]
        full = np.flatnonzero(np.diff(start) >= self.k)
        self.least[full] = both[1, start[full] + self.k - 1]


def _searched(blocks: DataFrame, group: Group, n_docs: int, k: int) -> DataFrame:
    """q, doc_id, score: what the tasks found for a group."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = pa.array(group.terms, pa.string()), np.zeros(len(group.terms), np.int64)
        for batch in batches:
            term = pc.fill_null(pc.index_in(batch.column("terms").flatten(), value_set=names), -1).to_numpy()
            np.add.at(seen, term[term >= 0], batch.column("docs").flatten().to_numpy()[term >= 0])
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], ["term", "df"])

    found = blocks.select("terms", "docs").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    for term, df in found.collect():  # at most the terms of a group
        group.weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(group, k)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                search.look(batch.slice(a, STEP))
        q, score, doc = search.best
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(doc, mask=doc == NULL), pa.array(score)], ["q", "doc_id", "score"])

    return blocks.mapInArrow(best, "q bigint, doc_id bigint, score bigint")


@contextlib.contextmanager
def _batches_of(spark, rows: int):
    """Within this, batches of Parquet's reader and of Arrow hold at most ``rows`` rows; a row of the index is some 200 kB.

    The reader's own 4,096 rows would be a task's whole share of the index.
    """
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def search(blocks: DataFrame, items: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, exactly.

    Documents score the sum of weight times impact over the item's distinct terms; equal scores go by doc_id (null
    first) and repeated documents each take a rank, repeated items are each answered. Items without terms, or none of
    whose terms occur, give no rows. The driver reads the items once, a partition at a time, and sends on one group of them.
    """
    spark = blocks.sparkSession
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    out, held, size = [], [], 0

    def answer(rows):
        group = Group(rows)
        place = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
        names = spark.createDataFrame(list(enumerate(group.items)), f"q bigint, item_id {items.schema['item_id'].dataType.simpleString()}")
        with _batches_of(spark, CELLS):
            found = _searched(blocks, group, n_docs, k).withColumn("rank", F.row_number().over(place)).where(f"rank <= {k}")
            return cut_lineage(found.join(names, "q").select("item_id", "rank", "doc_id", "score"))

    for row in items.select("item_id", terms.alias("terms")).toLocalIterator():
        bytes_ = sum(len(t) for t in row.terms or [])
        if held and (len(held) >= QUERIES or size + bytes_ > QUERY_BYTES):
            out.append(answer(held))
            held, size = [], 0
        held.append(row)
        size += bytes_
    if held or not out:
        out.append(answer(held))
    return functools.reduce(DataFrame.unionByName, out)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best rows of ``docs`` for every row of ``items`` (item_id, text); other columns are not read."""
    size = corpus_size(docs)
    return search(index(docs, size), items, size[0], k)


def rank_sql(k: int = 10) -> str:
    """The same as one DuckDB statement over ``documents`` and ``benchmark``, by scoring every document."""
    low = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {low} AS w FROM documents),
        s AS (SELECT count(*) AS n_all, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
        p AS MATERIALIZED (SELECT doc_id, term, len(w) AS n, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        q AS (SELECT item_id, unnest(list_distinct({low})) AS term FROM benchmark),
        r AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * n_all + 2) / (2 * df + 1)))::BIGINT
            * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // total))))::BIGINT AS score
            FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {k}"""
