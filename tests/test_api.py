"""Window requests on a small made pangenome."""

import pytest

from seqweave.operators.locate import BadRequest, NotFound
from seqweave.plans.api import Pangenome


def genomes(spark):
    rows = []
    for g in range(6):
        line = ["A", "B", "x" if g < 4 else "y", "C", "D", "x" if g >= 4 else "z", "E"]
        for pos, fam in enumerate(line):
            rows.append((g, pos, len(line), fam, g % 2, f"gene{fam}", fam in "xyz", 1 if fam in "xyz" else None))
    return spark.createDataFrame(
        rows, "genome bigint, pos bigint, length bigint, family string, allele bigint, name string, in_rgp boolean, spot bigint"
    )


def test_requests(spark):
    pan = Pangenome(genomes(spark), width=4)
    assert pan.locate("") == {"anchor": "A", "rank": 0}
    assert pan.locate("3")["anchor"] == "C"
    assert pan.locate("geneC")["anchor"] == "C"
    found, nodes, edges = pan.region("x")
    assert found["family"] == "x" and found["carriers"] == 6
    table = {r.family: (r.locus, r.carriers) for r in nodes.collect()}
    assert table["x"][1] == found["shown"]
    assert sum(r.n for r in edges.collect()) == 6 * 3
    # x is single-copy everywhere, so it is an anchor too: A, B, x, C, D, E
    assert pan.neighbours(0, 3.0)["next"] == 3 and pan.neighbours(0, 3.0)["previous"] is None
    assert pan.neighbours(3, 3.0)["previous"] == 0
    assert [(r.start, r.end, r.genes) for r in pan.elements(0).collect()] == [(2, 2, 1), (5, 5, 1)]
    with pytest.raises(NotFound):
        pan.locate("nothing")
    with pytest.raises(NotFound):
        pan.locate("99")
    with pytest.raises(BadRequest):
        Pangenome(genomes(spark), width=1)


def test_prefixes_calls_and_readings(spark):
    pan = Pangenome(genomes(spark), width=4)
    items, ahead = pan.prefix(4, "C")
    assert [r.family for r in items.collect()][-1] == "C"
    with pytest.raises(NotFound):
        pan.prefix(99, "C")
    with pytest.raises(BadRequest):
        pan.prefix(0, "3")
    top = [[(1, 0.75), (2, 0.25)], [(1, 0.25), (2, 0.75)]]
    calls = spark.createDataFrame([(g, p, 0.5, 0.6, 1, top[g % 2]) for g in range(6) for p in range(1, 7)],
                                  "genome bigint, pos bigint, entropy double, p_true double, rank_true int, top array<struct<cluster:int,p:double>>")
    decoder = spark.createDataFrame([(1, "C", 1.0), (2, "D", 0.5), (2, "E", 0.5)], "cluster int, family string, weight double")
    got = pan.genome_call(4, "C", calls, decoder).orderBy("rank").collect()
    assert [(r.read, r.score) for r in got] == [("C", 0.75), ("D", 0.125), ("E", 0.125)] and got[0].p_true == 0.6
    mean = pan.path_call(["A", "B"], calls, decoder, k=2).orderBy("rank").collect()
    assert [(r.read, r.score) for r in mean] == [("C", 0.5), ("D", 0.25)]
    for wrong, error in (([], BadRequest), (["A"] * 401, BadRequest), (["B", "A"], NotFound)):
        with pytest.raises(error):
            pan.path_call(wrong, calls, decoder)


def test_reading_is_held_against_the_facts(spark):
    pan = Pangenome(genomes(spark), width=4)
    lines = spark.createDataFrame([("S1.c1", 1, "A", "spine", "column 1: `A` share 60%, named 50%, 1.20 bits; RGP 5%"),
                                   ("S1.c2", 2, "B", "spine", "column 2: `B` share 40%, named 70%, 2.50 bits; RGP 0%")],
                                  "line_id string, locus bigint, top string, kind string, text string")
    body = ("`A` has share 60% {S1.c1}. `B` has share 41% {S1.c2}. `Z` is here {S1.c2}. The fork column 1 is it {S1.c1}. "
            "It is most stable {S1.c1}. It is most hesitant at column 1 {S1.c1}. It is most hesitant at column 2 {S1.c2}.")
    kept, faults = pan.reading(lines, body)
    assert {(r.nth, r.fault) for r in faults.collect()} == {(1, "number"), (2, "name"), (3, "column"), (4, "wording"), (5, "extreme")}
    assert [r.kept for r in kept.collect()] == [2]
