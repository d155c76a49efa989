"""Requests a user makes of a gene table: a window by name or position, its neighbours,
the elements of a genome and what removing one does.

Every function takes DataFrames and returns DataFrames; only single anchors come
to the driver.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators import decoder as D
from seqweave.operators import facts as X
from seqweave.operators import graph as G
from seqweave.operators import locate as L
from seqweave.operators import matching as M
from seqweave.operators import sequence as S
from seqweave.session import cut_lineage


class Pangenome:
    """A gene table with its backbone, ready for window requests.

    ``genes``: genome, pos, length, family, allele, name, in_rgp, spot.
    """

    def __init__(self, genes: DataFrame, share: float = 0.95, width: int = 80):
        if width < 2:
            raise L.BadRequest("width must be at least 2")
        self.genes, self.width = genes, width
        bones = S.backbone(genes, share).select("family", "median", F.col("rank").cast("bigint").alias("rank"))
        self.anchors = cut_lineage(bones)

    def _anchor(self, condition, order):
        return self.anchors.where(condition).orderBy(*order).first()

    def resolve(self, q: str) -> str:
        """The family a query names: a family, or the most frequent family of a gene name."""
        if not self.genes.where(F.col("family") == q).isEmpty():
            return q
        row = S.anchor_families(self.genes, [q]).first()
        if row is None:
            raise L.NotFound(f"no gene or family is called {q}")
        return row["family"]

    def locate(self, q: str = "") -> dict:
        """The window for a query: empty (the first), a position, a family or a gene name.

        anchor and rank, and for a family its carriers there, column and other places.
        """
        q = (q or "").strip()
        if not q:
            row = self._anchor(F.col("rank") == 0, ["rank"])
            return {"anchor": row["family"], "rank": row["rank"]}
        if re.fullmatch(r"\d+", q):
            longest = self.genes.agg(F.max("length")).first()[0]
            if int(q) >= longest:
                raise L.NotFound(f"position {q} is past the end of the longest sequence ({longest})")
            row = self._anchor(F.col("median") <= int(q), [F.desc("rank")]) or self._anchor(F.col("rank") == 0, ["rank"])
            return {"anchor": row["family"], "rank": row["rank"]}
        family = self.resolve(q)
        offsets = cut_lineage(L.anchor_offsets(self.genes, self.anchors, family))
        own = self._anchor(F.col("family") == family, ["rank"])
        reach = L.REACH
        best = L.best_anchor(offsets, reach).first()
        if best is None or best["rank"] is None:
            reach = self.width - 1
            best = L.best_anchor(offsets, reach).first()
        if own is not None:
            rank = own["rank"]
        elif best is not None and best["rank"] is not None:
            rank = best["rank"]
        else:
            raise L.NotFound(f"no window shows {q}")
        anchor = self._anchor(F.col("rank") == rank, ["rank"])
        shown = offsets.where((F.col("rank") == rank) & (F.col("offset") < self.width)).count()
        carriers = self.genes.where(F.col("family") == family).select("genome").distinct().count()
        return {
            "anchor": anchor["family"], "rank": rank, "family": family, "carriers": carriers, "shown": shown,
            "places": L.other_places(offsets, rank, self.width, reach),
        }

    def region(self, q: str = "") -> tuple[dict, DataFrame, DataFrame]:
        """Where a query leads, and the nodes and edges of that window."""
        found = self.locate(q)
        window = cut_lineage(S.region_window(self.genes, found["anchor"], self.width))
        line = window.drop("pos", "length").withColumnRenamed("column", "pos")
        return found, G.nodes(line), G.edges(line)

    def neighbours(self, rank: int, step: float) -> dict:
        """The windows before and after one."""
        following = cut_lineage(L.next_windows(self.anchors, step))
        before = L.previous_windows(self.anchors, following, L.window_chain(following), step)
        pick = lambda df, c: (df.where(F.col("rank") == rank).first() or {c: None})[c]
        return {"previous": pick(before, "previous"), "next": pick(following, "next")}

    def elements(self, genome: int) -> DataFrame:
        """Maximal plastic runs of one genome: spot, start, end, genes."""
        found = S.plastic_runs(self.genes.where(F.col("genome") == genome))
        return found.where(F.col("spot").isNotNull()).orderBy("start")

    def prefix(self, genome: int, q: str, before: int = 400) -> tuple[DataFrame, DataFrame]:
        """A genome's own path from the anchor of a query's window to the family, and up to ``before`` genes ahead of it.

        Both: pos (of the genome), family, allele, in order; refused when the genome has the anchor not once, or
        not the family in the window.
        """
        found = self.locate(q)
        if "family" not in found:
            raise L.BadRequest("name a gene or family, not a position")
        mine = self.genes.where(F.col("genome") == genome)
        places = mine.where(F.col("family") == found["anchor"]).select("pos", "length").limit(2).collect()
        if len(places) != 1:
            raise L.NotFound(f"genome {genome} has {found['anchor']} not once")
        start, length = places[0]["pos"], places[0]["length"]
        offset = F.pmod(F.col("pos") - start, F.lit(length))
        path = mine.withColumn("_o", offset).where(F.col("_o") < min(self.width, length))
        end = path.where(F.col("family") == found["family"]).agg(F.min("_o")).first()[0]
        if end is None:
            raise L.NotFound(f"genome {genome} has {q} not in the window of {found['anchor']}")
        items = path.where(F.col("_o") <= end).orderBy("_o").select("pos", "family", "allele")
        ahead = mine.where((F.col("pos") < start) & (F.col("pos") >= start - before)).orderBy("pos").select("pos", "family", "allele")
        return items, ahead

    def genome_call(self, genome: int, q: str, calls: DataFrame, decoder: DataFrame) -> DataFrame:
        """What a model calls after a genome's path to a family, with what is there: read, score, rank, p_true.

        ``calls``: genome, pos (of the gene called), entropy, p_true, rank_true, top; ``decoder``: cluster, family, weight.
        """
        items, _ = self.prefix(genome, q)
        last = items.where(F.col("family") == self.resolve(q)).first()["pos"]  # the path ends at its first copy
        own = calls.where((F.col("genome") == genome) & (F.col("pos") == last + 1))
        if own.isEmpty():
            raise L.NotFound(f"no gene is called after position {last} of genome {genome}")
        return self._read(own, decoder)

    def path_call(self, path: list[str], calls: DataFrame, decoder: DataFrame, k: int = 30) -> DataFrame:
        """The ``k`` families a model expects after a path: read, score, rank, averaged over the calls made after it.

        ``calls`` as for ``genome_call``; a path is families in order, as genomes have it. At most 400 of them.
        """
        if not path:
            raise L.BadRequest("the path is empty")
        if len(path) > 400:
            raise L.BadRequest("a path has at most 400 families")
        steps = None
        for i, family in enumerate(reversed(path)):
            at = self.genes.where(F.col("family") == family).select("genome", (F.col("pos") + i + 1).alias("pos"))
            steps = at if steps is None else steps.join(at, ["genome", "pos"], "left_semi")
        met = calls.join(steps, ["genome", "pos"], "left_semi")
        if met.isEmpty():
            raise L.NotFound("no genome has a call after this path")
        return self._read(met, decoder).where(F.col("rank") <= k)

    def _read(self, calls: DataFrame, decoder: DataFrame) -> DataFrame:
        n = calls.agg(F.count(F.lit(1))).first()[0]
        spread = D.call_rows(calls).groupBy("cluster").agg((F.sum("p") / n).alias("p"))
        read = spread.join(decoder, "cluster").groupBy(F.col("family").alias("read")).agg(F.sum(F.col("p") * F.col("weight")).alias("score"))
        truth = calls.agg(F.avg("p_true").alias("p_true"), F.avg("entropy").alias("entropy"))
        order = Window.orderBy(F.desc(F.round("score", 9)), "read")  # one row a family that the calls' clusters read as
        # one row
        return read.withColumn("rank", F.row_number().over(order)).join(F.broadcast(truth)).select("read", "score", "rank", "p_true", "entropy")

    def reading(self, lines: DataFrame, body: str) -> tuple[DataFrame, DataFrame]:
        """A reading of a window held against its facts: what may stay (kept, body) and the faults (nth, fault, what)."""
        spark = lines.sparkSession
        cut = cut_lineage(X.sentences(spark.createDataFrame([(0, body)], "text_id long, body string")))
        said = lambda df, fault, what: df.select("text_id", F.col("nth").cast("bigint").alias("nth"), F.lit(fault).alias("fault"), F.col(what).cast("string").alias("what"))
        faults = [
            said(X.unsupported_numbers(cut, lines), "number", "value"), said(X.unsupported_names(cut, lines), "name", "name"),
            said(X.unsupported_columns(cut, lines), "column", "locus"), said(X.wording_faults(cut), "wording", "fault"),
            said(X.false_extremes(cut, lines), "extreme", "locus"),
        ]
        every = cut_lineage(reduce(lambda a, b: a.unionByName(b), faults))
        return X.kept_sentences(cut, every, 400), every

    def influence(self, passes: DataFrame, readouts: DataFrame, reach: int = 1000, bin_width: int = 25) -> tuple[DataFrame, DataFrame]:
        """Binned effect after each deletion and how far it is felt."""
        profile = cut_lineage(M.downstream_profile(passes, readouts, reach, bin_width, "in_rgp"))
        return profile, M.influence_radius(profile, -(-reach // bin_width))
