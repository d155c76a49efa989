"""Quality classifier: interpolated modified Kneser-Ney over bytes, thresholds by language.

The model is a byte n-gram model trained on all trusted texts. Counts are made
per task and summed by n-gram in Spark; continuation counts, discounts, context
weights and interpolated probabilities are aggregations and joins of the count
tables, one order after the other.

Scoring joins every byte of every text with these tables. Entries of order 3 and
more are dealt into shards by the two bytes before the predicted one, which all
back-off steps of a position share, so one shard answers a position alone. A
shard has a bounded number of entries, so it is sent to all tasks; documents are
read once for each shard and keep their place, only sums per document move.
Orders 1 and 2 have at most 65,536 entries and go along with each shard.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.llm.common import arrow_rows, slices
from seqweave.session import cut_lineage, drop

#: Order of the model, and the byte that stands before and after each text.
ORDER, EDGE = 5, 10
#: Entries of one shard; only a single pair of bytes with more of them makes a larger one (at most 2^24 for order 5).
SHARD = 1_500_000
#: Share of the trusted texts of a language below its limit, when they are scored by models that have not seen them.
QUANTILE = 0.99
#: Cross-entropies are compared in steps of this many bits.
STEP = 0.001
#: Bytes of average cross-entropy that each text is given beforehand, so that a few words decide little.
PRIOR = 100

#: Bytes of text that a task counts or scores at once; each byte takes some 60 bytes of arrays for a while.
TAKEN = 1 << 20

COUNTS = pa.schema([("key", pa.int64()), ("half", pa.int64()), ("c", pa.int64())])

#: Address bits of the table that tells which documents may be labelled: 2^23 bits are 1 MB at every size.
PLACES = 23


def windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that end at each byte of the texts and at the edge after it, and where each text begins."""
    pad = bytes([EDGE]) * (order - 1)
    data = np.frombuffer(b"".join(pad + t + bytes([EDGE]) for t in texts) + pad, np.uint8).astype(np.int64)
    total = len(data) - (order - 1)
    keys = np.zeros(total, np.int64)
    for j in range(order):
        keys = (keys << 8) | data[j : j + total]
    sizes = np.array([len(t) + order for t in texts])
    ends = np.cumsum(sizes)
    inside = np.ones(total, bool)
    for j in range(1, order):
        inside[ends - j] = False
    return keys[inside], np.cumsum(sizes - (order - 1)) - (sizes - (order - 1))


def ngram_counts(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """key and how often each packed n-gram occurs in the texts (binary column ``text``): in all (c0), and with a column
    ``half`` (0 or 1) also in those of half 1 (c1) and of half 0 (c2), all counted in one pass."""
    halved = "half" in trusted.columns

    def work(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches, "text", TAKEN):
            for half in (0, 1) if halved else (0,):
                told = batch.column("half").to_pylist() if halved else [0] * batch.num_rows
                found = [t for t, h in zip(batch.column("text").to_pylist(), told, strict=True) if t and h == half]
                if not found:
                    continue
                new, c = np.unique(windows(found, order)[0], return_counts=True)
                merged = np.concatenate([keys, new << 1 | half])
                keys, at = np.unique(merged, return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, c])).astype(np.int64)
            if len(keys) > 2_000_000:
                yield arrow_rows(COUNTS, key=keys >> 1, half=keys & 1, c=counts)
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield arrow_rows(COUNTS, key=keys >> 1, half=keys & 1, c=counts)

    rows = trusted.select("text", *["half"] * halved).mapInArrow(work, "key bigint, half bigint, c bigint").groupBy("key")
    of = lambda h: F.sum(F.when(F.col("half") == h, F.col("c")).otherwise(0))
    return rows.agg(F.sum("c").alias("c0"), *([of(1).alias("c1"), of(0).alias("c2")] if halved else []))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from how many n-grams have counts 1 to 4.

    Where a count of counts is missing the discount is half the count.
    """
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k) for d, k in zip(raw, (1, 2, 3), strict=True))


class Model:
    """Tables of one trained model, or of three that share their entries: of all texts, of those of half 1, of half 0.

    ``entries``: kind (order of an n-gram, or minus the order whose context it is), key, v0 (probability or back-off
    weight), and v1, v2 of the halves, null where one lacks the entry; ``two``: for each the probabilities of all
    byte pairs. ``scorer``: which of them scores the texts of half 0 and of half 1.
    """

    def __init__(self, entries: DataFrame, two: list[np.ndarray], order: int, scorer: tuple[int, int]):
        self.entries, self.two, self.order, self.scorer = entries, two, order, scorer
        self.shared: list = []

    def forget(self):
        """Drop what scoring has sent to the tasks, once its results are written."""
        for b in self.shared:
            b.unpersist()
        self.shared.clear()
        drop(self.entries)


def train(trusted: DataFrame, order: int = ORDER) -> Model:
    """Model of the texts in the binary column ``text``; without any text every byte is equally likely.

    With a column ``half`` the models of both halves come from the same tables: every row carries its counts and
    values for all three, so each order is one chain of jobs.
    """
    spark = trusted.sparkSession
    which = range(3 if "half" in trusted.columns else 1)
    tables = {order: cut_lineage(ngram_counts(trusted, order))}
    for n in range(order - 1, 0, -1):
        mask = (1 << (8 * n)) - 1
        tables[n] = tables[n + 1].groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(
            *[F.count_if(F.col(f"c{m}") > 0).alias(f"c{m}") for m in which])
        if n > 2:
            tables[n] = cut_lineage(tables[n])
    parts, used = {}, list(tables.values())
    one, two, weights, totals = [], [], None, []
    for n in range(1, order + 1):
        many = [F.count_if(F.col(f"c{m}") == k) for m in which for k in range(1, 5)]
        told = tables[n].agg(*many).first()
        low = [discounts(*told[4 * m : 4 * m + 4]) for m in which]
        c = [F.col(f"c{m}") for m in which]
        taken = [F.when(c[m] == 0, 0.0).when(c[m] == 1, low[m][0]).when(c[m] == 2, low[m][1]).otherwise(low[m][2]) for m in which]
        left = F.shiftright("key", 8)
        some = lambda m, x: F.when(F.sum(c[m]) > 0, x)
        contexts = tables[n].groupBy(left.alias("context")).agg(
            *[x for m in which for x in (F.sum(c[m]).alias(f"total{m}"), some(m, F.sum(taken[m]) / F.sum(c[m])).alias(f"weight{m}"))])
        if n <= 2:  # at most 65,536 rows
            own = tables[n].join(contexts, left == F.col("context"))
            own = own.select("key", *[F.when(c[m] > 0, (c[m] - taken[m]) / F.col(f"total{m}")).otherwise(0.0).alias(f"own{m}") for m in which]).toPandas()
            got = contexts.toPandas()
            full = []
            for m in which:
                weight = np.ones(256 if n == 2 else 1)
                told_m = got[f"weight{m}"].to_numpy(float)
                weight[got["context"].to_numpy(int)] = np.where(np.isnan(told_m), 1.0, told_m)
                base = np.full(256, 1 / 256) if n == 1 else np.tile(one[m], 256)
                full.append(np.repeat(weight, 256) * base)
                full[m][own["key"].to_numpy(int)] += own[f"own{m}"].to_numpy(float)
            if n == 1:
                one, totals = full, [int(got[f"total{m}"].sum()) for m in which]
            else:
                two = full
                weights = spark.createDataFrame(
                    pd.DataFrame({"key": np.arange(65536), **{f"v{m}": two[m] for m in which}}), "key bigint, " + ", ".join(f"v{m} double" for m in which))
            continue
        below = (parts[n - 1] if n > 3 else weights).select(F.col("key").alias("tail"), *[F.col(f"v{m}").alias(f"lower{m}") for m in which])
        mask = (1 << (8 * (n - 1))) - 1
        value = lambda m: F.when(c[m] > 0, (c[m] - taken[m]) / F.col(f"total{m}") + F.col(f"weight{m}") * F.col(f"lower{m}"))
        parts[n] = cut_lineage(
            tables[n].join(contexts, left == F.col("context"))
            .join(below, F.col("key").bitwiseAND(F.lit(mask)) == F.col("tail"))
            .select("key", *[value(m).alias(f"v{m}") for m in which])
        )
        used.append(parts[n])
        parts[-n] = contexts.select(F.col("context").alias("key"), *[F.col(f"weight{m}").alias(f"v{m}") for m in which])
    entries = reduce(DataFrame.unionByName, [
        parts[k].select(F.lit(k).alias("kind"), "key", *[f"v{m}" for m in which]) for n in range(3, order + 1) for k in (n, -n)
    ])
    pair = F.when(F.col("kind") > 0, F.shiftright("key", 8)).otherwise(F.col("key")).bitwiseAND(F.lit(0xFFFF))
    entries = cut_lineage(entries.withColumn("pair", pair.cast("int")))
    for table in used:
        drop(table)
    both = len(totals) == 3 and totals[1] > 0 and totals[2] > 0
    return Model(entries, two, order, (1, 2) if both else (0, 0))


def shards(model: Model, most: int = SHARD):
    """Yield (pairs, lookup tables) of one shard after another; ``pairs`` marks the byte pairs it answers."""
    sizes = model.entries.groupBy("pair").count().toPandas()  # at most 65,536 rows
    held = np.zeros(65536, np.int64)
    held[sizes["pair"]] = sizes["count"]
    shard = np.zeros(65536, np.int64)
    number = used = 0
    for pair in range(65536):
        if used and used + held[pair] > most:
            number, used = number + 1, 0
        shard[pair], used = number, used + held[pair]
    names = [c for c in model.entries.columns if c.startswith("v")]

    def tables(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        kind, key = rows.column("kind").to_numpy(), rows.column("key").to_numpy()
        out = {int(n): (key[kind == n], np.empty((len(names), int((kind == n).sum())))) for n in np.unique(kind)}
        for m, c in enumerate(names):  # one column at a time; null is NaN
            column = rows.column(c).to_numpy()
            for n, (_, values) in out.items():
                values[m] = column[kind == n]
        return out

    for k in range(number + 1):
        pairs = np.flatnonzero(shard == k)
        yield shard == k, tables(model.entries.where(F.col("pair").between(int(pairs[0]), int(pairs[-1]))).drop("pair").toArrow())


class Lookup:
    """Probabilities of packed n-grams from one shard's tables."""

    def __init__(self, two: list[np.ndarray], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.two = two
        self.tables = {n: (pd.Index(k), v) for n, (k, v) in tables.items()}

    def find(self, kind: int, keys: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self.tables:
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        index, values = self.tables[kind]
        at = index.get_indexer(keys)
        found = values[m][at]
        return (at >= 0) & ~np.isnan(found), found

    def probability(self, keys: np.ndarray, n: int, m: int = 0) -> np.ndarray:
        keys = keys & ((1 << (8 * n)) - 1)
        if n == 2:
            return self.two[m][keys]
        known, out = self.find(n, keys, m)
        rest = keys[~known]
        if len(rest):
            seen, weight = self.find(-n, rest >> 8, m)
            out[~known] = np.where(seen, weight, 1.0) * self.probability(rest, n - 1, m)
        return out


def surprise(docs: DataFrame, model: Model, most: int = SHARD) -> DataFrame:
    """``docs`` columns but the binary ``text``, with bytes (edge included, null for empty text) and bits of surprise.

    With a column ``half`` there is also ``other``: the bits of texts whose half is not null under the model of the other half.
    """
    names = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    halved = "half" in names
    context, parts = docs.sparkSession.sparkContext, []
    for pairs, tables in shards(model, most):
        shared = context.broadcast((pairs, model.two, tables))
        del tables
        model.shared.append(shared)

        def work(batches, shared=shared, order=model.order, scorer=model.scorer):
            mine, two, tables = shared.value
            lookup = Lookup(two, tables)
            whole = bool(mine.all())

            def scored(texts, m):
                keys, begins = windows(texts, order)
                if whole:
                    each = -np.log2(lookup.probability(keys, order, m))
                else:
                    each, here = np.zeros(len(keys)), mine[(keys >> 8) & 0xFFFF]
                    each[here] = -np.log2(lookup.probability(keys[here], order, m))
                return np.add.reduceat(each, begins)

            for batch in slices(batches, "text", TAKEN):
                given = batch.column("text").to_pylist()
                half = batch.column("half").to_pylist() if halved else [None] * len(given)
                bits, other = np.zeros(len(given)), np.zeros(len(given))
                full = np.array([i for i, t in enumerate(given) if t], int)
                if len(full):
                    bits[full] = scored([given[i] for i in full], 0)
                for h in (0, 1):
                    some = np.array([i for i in full if half[i] == h], int)
                    if len(some):
                        other[some] = scored([given[i] for i in some], scorer[h]) if scorer[h] else bits[some]
                sizes = [len(t) + 1 if t else None for t in given]
                columns = [*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(bits)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(other)] * halved, names=[*names, "bytes", "bits", *["other"] * halved])

        parts.append(docs.select(*names, "text").mapInArrow(work, f"{kinds}, bytes bigint, bits double" + ", other double" * halved))
    if len(parts) == 1:
        return parts[0]
    every = reduce(DataFrame.unionByName, parts)
    sums = ["bits", *["other"] * halved]
    summed = every.groupBy(*names, "bytes").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("_n"))
    again = F.expr(f"sequence(1L, _n div {len(parts)})")
    for c in sums:
        summed = summed.withColumn(c, F.col(c) / (F.col("_n") / len(parts)))
    return summed.withColumn("_n", F.explode(again)).drop("_n")


def half_of(text):
    """Half of a text, by its hash, so that copies of a text are in one half."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def unseen(trusted: DataFrame, order: int = ORDER, most: int = SHARD) -> DataFrame:
    """``trusted`` with bytes and bits, each text scored by a model of the other half of the texts.

    ``trusted`` has a binary column ``text``. If one half is empty, its texts can't be kept from a model, and the
    model of all scores them.
    """
    halves = trusted.withColumn("half", half_of("text"))
    scored = surprise(halves, train(halves.select("text", "half"), order), most)
    return scored.drop("half", "bits").withColumnRenamed("other", "bits")


def _place(doc):
    return F.pmod(F.xxhash64(doc), F.lit(1 << PLACES))


def labelled_places(good: DataFrame):
    """A broadcast table of 2^PLACES bits, set for the documents of ``good``: a superset of them by hash."""
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    told = good.select(_place("doc_id").alias("p")).groupBy(F.shiftright("p", 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (PLACES - 6), np.int64)
    table[told.column("cell").to_numpy()] = told.column("bits").to_numpy()
    return good.sparkSession.sparkContext.broadcast(table.tobytes())


def maybe_labelled(rows: DataFrame, table) -> DataFrame:
    """Rows (with ``place``) whose bit is set, found where they lie; of the others none is labelled."""

    def work(batches):
        bits = np.frombuffer(table.value, np.uint64)
        for batch in batches:
            p = batch.column("place").to_numpy().astype(np.uint64)
            yield batch.filter(pa.array((bits[(p >> np.uint64(6)).astype(int)] >> (p & np.uint64(63))) & np.uint64(1) == 1))

    return rows.mapInArrow(work, rows.schema)


def limits(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """language, limit: the quantile of h, in steps of ``STEP``, of the texts that count in each language.

    ``scored``: language, h, trusted (whether the text counts). A language without trusted texts takes all its own.
    """
    bins = scored.where("h is not null").groupBy(
        "language", F.floor(F.col("h") / STEP).alias("bin")
    ).agg(F.count("*").alias("all"), F.count(F.when(F.col("trusted"), 1)).alias("good"))
    whole = Window.partitionBy("language")
    bins = bins.withColumn("n", F.when(F.sum("good").over(whole) > 0, F.col("good")).otherwise(F.col("all")))
    upto = F.sum("n").over(whole.orderBy("bin"))
    reached = bins.withColumn("upto", upto).withColumn("total", F.sum("n").over(whole))
    return reached.where(F.col("upto") >= quantile * F.col("total")).groupBy("language").agg(
        (STEP * (F.min("bin") + 1)).alias("limit")
    )


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, prior: int = PRIOR,
          most: int = SHARD) -> DataFrame:
    """One row per document: doc_id, text_hash, language, bytes, bits_per_byte, perplexity, limit, kept.

    Trusted are documents that some row of ``labels`` gives quality 1. A text is
    kept when its bits a byte, after ``prior`` bytes of the trusted mean of its
    language are added, stay within the limit of its language. Mean and limit
    are those of trusted texts under models that have not seen them. Null and empty
    texts have no perplexity and are not kept. A null lang is a language of its
    own. Repeated rows give repeated results; other columns are not read.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    own = docs.select("doc_id", F.col("lang").alias("language"), F.xxhash64("text").alias("text_hash"), _place("doc_id").alias("place"),
                      F.col("text").cast("binary").alias("text"))
    places = labelled_places(good)
    # labels grow with the documents, so both sides are shuffled at every size; but only texts that may be labelled
    trusted = maybe_labelled(own.select("doc_id", "place", "text"), places).join(good.hint("merge"), "doc_id", "left_semi")
    model = train(trusted.select("text", half_of("text").alias("half")), order)
    rows = own.withColumn("half", half_of("text")).drop("place")
    scored = surprise(rows, model, most).drop("half").join(good.withColumn("trusted", F.lit(True)), "doc_id", "left")
    scored = cut_lineage(scored.withColumn("trusted", F.coalesce("trusted", F.lit(False))))
    model.forget()
    places.unpersist()
    # trusted texts count by what the other half's model says of them, all others by the whole model
    known = scored.select("language", "bytes", F.when(F.col("trusted"), F.col("other")).otherwise(F.col("bits")).alias("bits"), "trusted")
    mean = known.where("bytes is not null").groupBy("language").agg(
        F.coalesce(F.sum(F.when(F.col("trusted"), F.col("bits"))) / F.sum(F.when(F.col("trusted"), F.col("bytes"))),
                   F.sum("bits") / F.sum("bytes")).alias("mean")
    ).withColumnRenamed("language", "l")

    def with_h(rows):
        h = (F.col("bits") + prior * F.col("mean")) / (F.col("bytes") + prior)
        return rows.join(mean, rows["language"].eqNullSafe(F.col("l")), "left").withColumn("h", h)

    scored = with_h(scored)
    limit = limits(with_h(known), quantile).withColumnRenamed("language", "l_")
    return scored.join(limit, scored["language"].eqNullSafe(F.col("l_")), "left").select(
        "doc_id", "text_hash", "language", "bytes", (F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
        F.pow(F.lit(2.0), F.col("bits") / F.col("bytes")).alias("perplexity"), F.col("limit"),
        F.coalesce(F.col("h") <= F.col("limit"), F.lit(False)).alias("kept"),
    )


def kept_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps, with their columns."""
    kept = judge(docs, labels, **options).where("kept").select("doc_id", "text_hash").distinct()
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_hash"])
    return docs.join(kept, same, "left_semi")
