"""Agglomerative clustering and communities as rounds of joins.

Each round is a distributed job over the pair or edge table and its result is
written before the next one starts, so a lost executor costs one round at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.session import cut_lineage


def average_linkage(distance: DataFrame, leaves: DataFrame, cut: float | None = None, absent: float = 1.0):
    """Average-linkage clusters of ``leaves`` (column leaf) from their distances (a, b, d).

    Pairs without a row are ``absent`` apart: clusters carry how many of their
    pairs have one. Clusters without any never merge, so ``cut`` must lie below
    ``absent`` unless all pairs are given.

    In every round all pairs of clusters that are each other's nearest merge at
    once; average linkage never brings a third cluster closer by a merge, so
    this builds the same tree as merging one pair at a time. Equal distances are
    ordered by the cluster names. Merging stops above ``cut``.

    Returns (members, merges): leaf, cluster, place (the leaf's place within its
    cluster when the tree is drawn); and kept, dropped, height, size.
    """
    one = F.lit(1).cast("bigint")
    pairs = cut_lineage(
        distance.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("d").cast("double").alias("s"),
            one.alias("na"), one.alias("nb"), one.alias("p"),
        )
    )
    rounds = []
    while True:
        both = F.col("na") * F.col("nb")
        mean = F.round((F.col("s") + absent * (both - F.col("p"))) / both, 12)
        near = pairs.select(F.struct(mean.alias("d"), "a", "b", "na", "nb").alias("m"))
        if cut is not None:
            near = near.where(F.col("m.d") <= cut)
        nearest = (
            near.select(F.explode(F.array("m.a", "m.b")).alias("cluster"), "m")
            .groupBy("cluster")
            .agg(F.min("m").alias("m"))
        )
        mutual = cut_lineage(
            nearest.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == 2).select(
                F.col("m.a").alias("kept"), F.col("m.b").alias("dropped"), F.col("m.d").alias("height"),
                F.col("m.na").alias("kept_n"), (F.col("m.na") + F.col("m.nb")).alias("size"),
            )
        )
        if mutual.isEmpty():
            break
        rounds.append(mutual)
        merged = mutual.select(
            F.explode(F.array("kept", "dropped")).alias("old"), F.col("kept").alias("new"), "size"
        )
        rename = lambda side: merged.select(
            F.col("old").alias(side), F.col("new").alias(f"_{side}"), F.col("size").alias(f"_n{side}")
        )
        relabelled = pairs.join(rename("a"), "a", "left").join(rename("b"), "b", "left").select(
            F.struct(F.coalesce("_a", "a").alias("c"), F.coalesce("_na", "na").alias("n")).alias("x"),
            F.struct(F.coalesce("_b", "b").alias("c"), F.coalesce("_nb", "nb").alias("n")).alias("y"),
            "s", "p",
        )
        folded = (
            relabelled.where(F.col("x.c") != F.col("y.c"))
            .groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
            .agg(F.sum("s").alias("s"), F.sum("p").alias("p"))
        )
        pairs = cut_lineage(
            folded.select(
                F.col("x.c").alias("a"), F.col("y.c").alias("b"), "s", "p", F.col("x.n").alias("na"), F.col("y.n").alias("nb")
            )
        )
    members = leaves.select("leaf", F.col("leaf").alias("cluster"), F.lit(0).cast("bigint").alias("place"))
    for i, mutual in enumerate(rounds):
        moved = mutual.select(F.col("dropped").alias("cluster"), "kept", "kept_n")
        members = members.join(moved, "cluster", "left").select(
            "leaf",
            F.coalesce("kept", "cluster").alias("cluster"),
            (F.col("place") + F.coalesce("kept_n", F.lit(0))).alias("place"),
        )
        if i % 6 == 5:
            members = cut_lineage(members)
    merges = reduce(lambda a, b: a.unionByName(b), rounds).drop("kept_n") if rounds else None
    return members, merges


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    return edges.select("a", "b", "w").unionByName(back)


def _local_moves(edges: DataFrame) -> DataFrame:
    """Move nodes between communities while modularity rises: node, community.

    A share of the nodes, by a hash that changes every round, may move at a time.
    Moves made at once can lower modularity together; such a round is undone and
    the share halved, down to single nodes, whose wished moves always raise it.
    So every round taken raises it, and it ends when no node wishes to move.
    """
    both = cut_lineage(_both_ways(edges))
    degree = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
        F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k")
    ))
    total = degree.agg(F.sum("k")).first()[0]
    state = cut_lineage(degree.select("node", F.col("node").alias("community"), "k"))
    reached, share, turn = modularity(edges, state), 2, 0
    while True:
        turn += 1
        weight = state.groupBy("community").agg(F.sum("k").alias("tot"))
        home = state.select(F.col("node").alias("b"), F.col("community"))
        links = (
            both.where(F.col("a") != F.col("b")).join(home, "b")
            .groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"))
        )
        own = state.select("node", F.col("community").alias("own"), "k")
        stay = state.select("node", "community", F.lit(0.0).alias("w"))
        options = (
            links.unionByName(stay).groupBy("node", "community").agg(F.sum("w").alias("w"))
            .join(own, "node").join(weight, "community")
        )
        others = F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * others / F.lit(total), 9)
        best = options.groupBy("node").agg(
            F.min(F.struct((-gain).alias("g"), F.col("community").alias("c"))).alias("best"),
            F.max(F.when(F.col("community") == F.col("own"), gain)).alias("stay"),
        )
        wishes = -F.col("best.g") > F.col("stay") + F.lit(1e-9 * total)
        moves = wishes & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(share)) == 0)
        nxt = cut_lineage(
            state.join(best, "node").select(
                "node",
                F.when(moves, F.col("best.c")).otherwise(F.col("community")).alias("community"),
                "k",
                wishes.alias("wished"),
                moves.alias("moved"),
            )
        )
        told = nxt.agg(F.max("wished"), F.max("moved")).first()
        if not told[0]:
            return state.select("node", "community")
        if not told[1]:
            share = max(2, share // 2)
            continue
        risen = modularity(edges, nxt)
        if risen > reached:
            state, reached, share = nxt.drop("wished", "moved"), risen, 2
        else:
            share *= 2


def communities(edges: DataFrame) -> DataFrame:
    """Communities of a weighted undirected graph by repeated local moves and folding.

    ``edges``: a, b, w, each pair once. Returns node, community (named by one of
    its nodes).
    """
    nodes = _both_ways(edges).select(F.col("a").alias("node")).distinct()
    member = cut_lineage(nodes.select("node", F.col("node").alias("community")))
    level = cut_lineage(edges.select("a", "b", F.col("w").cast("double").alias("w")))
    while True:
        found = cut_lineage(_local_moves(level))
        before = found.count()
        after = found.select("community").distinct().count()
        member = cut_lineage(
            member.join(found.select(F.col("node").alias("community"), F.col("community").alias("c")), "community")
            .select("node", F.col("c").alias("community"))
        )
        if after == before:
            return member
        side = lambda name: found.select(F.col("node").alias(name), F.col("community").alias(f"_{name}"))
        folded = level.join(side("a"), "a").join(side("b"), "b")
        level = cut_lineage(
            folded.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("w").alias("w"))
        )


def modularity(edges: DataFrame, member: DataFrame) -> float:
    """Modularity of a division, a single number."""
    both = _both_ways(edges)
    side = lambda name: member.select(F.col("node").alias(name), F.col("community").alias(f"_{name}"))
    joined = both.join(side("a"), "a").join(side("b"), "b")
    weight = F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))
    per = joined.groupBy(F.col("_a").alias("c")).agg(
        F.sum(weight).alias("tot"), F.sum(F.when(F.col("_a") == F.col("_b"), weight).otherwise(0.0)).alias("inner")
    )
    row = per.agg(F.sum("tot").alias("m2"), F.sum("inner").alias("i"), F.sum(F.col("tot") * F.col("tot")).alias("sq")).first()
    return row["i"] / row["m2"] - row["sq"] / row["m2"] ** 2
