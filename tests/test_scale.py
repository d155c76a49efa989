"""Plans and task sizes that hold on larger tables."""

from __future__ import annotations

import numpy as np

from seqweave.operators import decoder as D
from seqweave.operators import matching as M
from seqweave.operators import neighbours as N
from seqweave.plans import link_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_controls_are_matched_without_broadcasts(spark):
    rows = [(1, 100 + s, s, s + 1, 2, float(s)) for s in range(0, 40, 5)]
    pool = spark.createDataFrame(rows, "genome bigint, control bigint, c_start bigint, c_end bigint, c_size bigint, c_delta double")
    units = spark.createDataFrame(
        [(1, 100 + s, s, s + 1, 2, 10, s + 11, float(s)) for s in range(0, 40, 5)],
        "genome bigint, unit bigint, start bigint, end bigint, size bigint, dist bigint, row bigint, delta double",
    )
    controls = M.matched_controls(units, pool, log_factor=4.0)
    assert controls.count() > 0
    for found in (controls, M.unit_scores(units, controls)):
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)


def _loci(spark, seed=4, genomes=40):
    import random

    rnd = random.Random(seed)
    rows = [(g, f"l{i}", rnd.randrange(4)) for g in range(genomes) for i in range(9) if rnd.random() < 0.4]
    return rows, spark.createDataFrame(rows, "genome bigint, locus string, allele bigint")


def _distances(rows):
    import itertools

    held = {}
    for g, name, allele in rows:
        held.setdefault(g, {})[name] = allele
    out = {}
    for a, b in itertools.combinations(sorted(held), 2):
        both = held[a].keys() & held[b].keys()
        if both:
            out[a, b] = (len(both), 1 - sum(held[a][n] == held[b][n] for n in both) / len(both))
    return out


def test_distances_leave_their_tasks_folded(spark, monkeypatch):
    from seqweave.operators import distance as D
    from seqweave.operators import relatedness as R

    rows, loci = _loci(spark)
    want = _distances(rows)
    for name, size in (("GENOMES_PER_BLOCK", 8), ("SLICE", 3), ("BANK_GENOMES", 11)):
        monkeypatch.setattr(D, name, size)
    assert {(r.g1, r.g2): (r.typed, r.d) for r in D.allele_distance(loci).collect()} == want
    counts = D.distance_counts(loci)
    assert counts.groupBy().sum("n").first()[0] == len(want)
    assert counts.count() == len({d for _, d in want.values()})
    pairs = spark.createDataFrame([(a, b, d) for (a, b), (_, d) in want.items()], "g1 bigint, g2 bigint, d double")
    shares = lambda df, n: {tuple(r) for r in df.groupBy("bin").agg({n: "sum"} if n == "n" else {"bin": "count"}).collect()}
    assert shares(R.quantile_bins(counts, 4, weight="n"), "n") == shares(R.quantile_bins(pairs, 4), "bin")


def test_agreement_by_distance_is_that_of_the_pairs(spark, monkeypatch):
    import random

    from seqweave.operators import distance as D
    from seqweave.operators import relatedness as R

    rows, loci = _loci(spark, 5)
    rnd = random.Random(6)
    long = lambda names, values: spark.createDataFrame(
        [(g, n, rnd.choice(values)) for g in range(40) for n in names if rnd.random() < 0.7], "genome bigint, name string, value string").cache()
    traits, outcomes = long("pqr", "ab"), long("mn", "xyz")
    binned = [(a, b, (d >= 0.5) + (d >= 0.75)) for (a, b), (_, d) in _distances(rows).items()]
    plain = R.agreement_cmh(traits, outcomes, spark.createDataFrame(binned, "g1 bigint, g2 bigint, bin int"))
    monkeypatch.setattr(D, "GENOMES_PER_BLOCK", 7)
    got = R.agreement_by_distance(traits, outcomes, loci, [0.5, 0.75])
    table = lambda df: {(r.trait, r.outcome): r.z for r in df.collect()}
    assert table(got) == table(plain) and len(table(got)) == 6


def test_nearest_by_alleles_merges_parts(spark, monkeypatch):
    from seqweave.operators import distance as D

    rows, loci = _loci(spark, 8)
    dist = _distances(rows)
    members = [(f, g) for f, every in (("x", 1), ("y", 3)) for g in range(40) if g % every == 0]
    for name, size in (("GENOMES_PER_BLOCK", 12), ("SLICE", 4), ("BANK_GENOMES", 6)):
        monkeypatch.setattr(D, name, size)
    got = {}
    for r in D.nearest_by_alleles(spark.createDataFrame(members, "fork string, genome bigint"), "fork", loci, 4).collect():
        got.setdefault((r.fork, r.genome), set()).add(r.other)
    want = {}
    for f, g in members:
        near = sorted((dist[min(g, o), max(g, o)][1], o) for ff, o in members if ff == f and (min(g, o), max(g, o)) in dist)[:4]
        if near:
            want[f, g] = {o for _, o in near}
    assert got == want


def test_a_block_with_itself_is_shipped_once(spark, monkeypatch):
    import pandas as pd

    from seqweave.operators import pairs as P

    def told(values, by, symmetric):
        return lambda group: pd.DataFrame({"a": [int(group["_chunk"].iloc[0])], "b": [0], "shared": [float(len(group))]})

    rows = [(i, f) for i in range(5) for f in range(400)]
    monkeypatch.setattr(P, "_product", told)
    monkeypatch.setattr(P, "ROWS_PER_CHUNK", 500)
    sizes = [r.shared for r in P.pair_products(spark.createDataFrame(rows, "item bigint, feature bigint"), "item", "feature").collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 2 * 500


def test_ranks_are_joined_without_a_broadcast(spark):
    from seqweave.operators import correlation as K

    values = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 1.0), ("b", 1, 1.0)], "item string, unit bigint, value double")
    top = plan(K.average_ranks(values, 3)).split("Join", 1)[0]
    assert "SortMerge" in top and "Broadcast" not in top


def test_traits_without_pairs_keep_their_row(spark):
    from seqweave.operators import relatedness as R

    loci = spark.createDataFrame([(g, "l", g % 2) for g in range(6)], "genome bigint, locus string, allele bigint")
    long = lambda rows: spark.createDataFrame(rows, "genome bigint, name string, value string")
    traits = long([(g, "p", str(g % 2)) for g in range(6)] + [(99, "q", "1")])
    outcomes = long([(g, "m", str(g % 3)) for g in range(6)])
    got = {r.trait: r.z for r in R.agreement_by_distance(traits, outcomes, loci, [0.5]).collect()}
    assert got.keys() == {"p", "q"} and got["q"] == 0


def test_decode_ships_no_lists(spark):
    """rows of a list's clusters and families carry two hashes, not the list."""
    calls = spark.createDataFrame(
        [(i, i % 2, f"L{i % 3}", [(i % 4, 0.75), (4 + i % 2, 0.25)]) for i in range(24)],
        "id bigint, half bigint, family string, top array<struct<cluster: bigint, p: double>>",
    )
    read = D.decode(calls, D.decoder(calls, "half"))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "read#" in line and "top#" in line]
    assert read.columns[:2] == ["half", "top"] and read.count() == 24


def test_a_bank_passes_each_group_once(spark):
    """the bank is shipped for a fixed number of groups, and each query's best are complete where they are made."""
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, size=(90, 3)).astype(float)
    v[~v.any(1)] = 1.0
    v[40:50] += 1e-9  # needs 8 bytes
    v[50:] = v[:40]  # ties go to the smaller id
    rows = spark.createDataFrame([(i, v[i].tolist()) for i in range(90)], "id bigint, v array<double>")
    near = N.nearest_exemplars(rows, rows.withColumnRenamed("id", "exemplar"), 3, block_rows=2)
    assert near.rdd.getNumPartitions() == N.GROUPS
    assert "Window" not in near._jdf.queryExecution().optimizedPlan().toString()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 12)
    want = {(i, p + 1): int(j) for i in range(90) for p, j in enumerate(np.lexsort((np.arange(90), -sims[i]))[:3])}
    assert {(r.id, r.place): r.exemplar for r in near.collect()} == want
    assert N.nearest_exemplars(rows, rows.limit(0).withColumnRenamed("id", "exemplar"), 3).count() == 0
    assert N.nearest_exemplars(rows, rows.where("id < 2").withColumnRenamed("id", "exemplar"), 3).count() == 180


def test_controls_meet_their_units_once(spark):
    """the tier of a unit is counted over the rows it met, without making them again."""
    pool = spark.createDataFrame([(1, 2, 3, 4, 5, 1.0)], "genome bigint, control bigint, c_start bigint, c_end bigint, c_size bigint, c_delta double")
    units = spark.createDataFrame([(1, 1, 9, 9, 5, 9, 18, 1.0)],
                                  "genome bigint, unit bigint, start bigint, end bigint, size bigint, dist bigint, row bigint, delta double")
    assert plan(M.matched_controls(units, pool)).count("SortMergeJoin") == 1


def test_links_number_their_genes_once(spark, monkeypatch):
    """the genes are numbered once and written, not by each step that reads them."""
    made, genes = [], link_queries.C.genes
    monkeypatch.setattr(link_queries.C, "genes", lambda *a: made.append(1) or genes(*a))
    assert link_queries.tested(spark, "/root/testdata/sf0.01").count() > 0
    assert len(made) == 1


def test_blocks_look_at_their_positions_once(spark):
    from seqweave.operators.sequence import circular_blocks

    rows = [(g, p, 100) for g in range(3) for p in (2, 3, 40, 41, 90, 99)]
    blocks = circular_blocks(spark.createDataFrame(rows, "genome long, pos long, length long"), ["genome"], 15, size=8)
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("RangeFrame") <= 1
    got = sorted((r.genome, r.start, r.end, r.genes) for r in blocks.collect())
    assert got == [x for g in range(3) for x in ((g, 40, 41, 2), (g, 90, 3, 4))]


def test_genomes_travel_to_half_of_the_groups(spark, monkeypatch):
    """copies of a genome don't grow with the genomes of a block, and each two groups meet in one task."""
    from seqweave.operators import distance as D

    monkeypatch.setattr(D, "GENOMES_PER_BLOCK", 2)
    assert D.groups_of(D.packed(_loci(spark)[1])) == D.GROUPS
    rows = spark.range(90).selectExpr("id genome")
    for n in (5, 4, 2, 1):
        home = dict(D.dealt(rows, n).where("_s = 0").select("genome", "_g").collect())
        sent = [(r._g, home[r.genome]) for r in D.dealt(rows, n).select("genome", "_g").collect()]
        assert len(home) == 90 and len(sent) <= 90 * (n // 2 + 1)
        assert sorted({tuple(sorted(p)) for p in sent}) == [(i, j) for i in range(n) for j in range(i, n)]
        assert len({tuple(sorted(p)) for p in sent}) == len(set(sent))


def test_agreement_of_many_outcomes_and_alleles(spark, monkeypatch):
    """outcomes are taken a few at a time, alleles beyond a byte, distances beyond the table."""
    import random

    from seqweave.operators import distance as D
    from seqweave.operators import relatedness as R

    rnd = random.Random(11)
    rows = [(g, f"l{i}", rnd.randrange(400 if i else 3)) for g in range(420) for i in range(3) if rnd.random() < 0.9]
    loci = spark.createDataFrame(rows, "genome bigint, locus string, allele bigint")
    long = lambda names, values: spark.createDataFrame(
        [(g, n, rnd.choice(values)) for g in range(420) for n in names if rnd.random() < 0.7], "genome bigint, name string, value string").cache()
    traits, outcomes = long("pq", "abc"), long("mnorstu", "xyz")
    binned = [(a, b, int(d >= 0.6)) for (a, b), (_, d) in _distances(rows).items()]
    plain = R.agreement_cmh(traits, outcomes, spark.createDataFrame(binned, "g1 bigint, g2 bigint, bin int"))
    table = lambda df: {(r.trait, r.outcome): r.z for r in df.collect()}
    want = table(plain)
    for groups, looked_up, cells in ((1, 1024, 4_000_000), (3, 2, 300)):
        for name, size in (("GROUPS", groups), ("LOOKED_UP", looked_up), ("CELLS", cells), ("GENOMES_PER_BLOCK", 100), ("SLICE", 64)):
            monkeypatch.setattr(D, name, size)
        got = R.agreement_by_distance(traits, outcomes, loci, [0.6])
        assert table(got) == want and len(want) == 14


def test_nearest_lists_are_complete_where_they_are_made(spark, monkeypatch):
    """all genomes pass each group once, no lists of parts are merged; ties, rare sets and odd genomes included."""
    from seqweave.operators import distance as D

    rows, loci = _loci(spark, 21, 70)
    rows = [(g, name, allele % 2) for g, name, allele in rows]
    loci = spark.createDataFrame([*rows, (70, "alone", 1)], "genome bigint, locus string, allele bigint")
    dist = _distances(rows)
    members = [(f, g) for f, every in (("all", 1), ("some", 3), ("rare", 30)) for g in range(71) if g % every == 0]
    frame = spark.createDataFrame(members, "fork string, genome bigint")
    near = {(f, g): sorted((dist[min(g, o), max(g, o)][1], o) for ff, o in members if ff == f and (min(g, o), max(g, o)) in dist)[:5] for f, g in members}
    want = {(f, g, o) for (f, g), found in near.items() for _, o in found}
    for groups, block, size in ((1, 7, 4), (3, 2, 64), (8, 2048, 512)):
        for name, n in (("GROUPS", groups), ("GENOMES_PER_BLOCK", block), ("SLICE", size)):
            monkeypatch.setattr(D, name, n)
        got = D.nearest_by_alleles(frame, "fork", loci, 5)
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(want)
    sent = D.dealt(spark.range(50).selectExpr("id genome"), 4, twice=True)
    assert sent.count() == 200 and sent.where("_s = 0").count() == 50 and sent.groupBy("genome", "_g").count().count() == 200


def test_distances_of_small_blocks_are_sent_no_more_often(spark, monkeypatch):
    """what is shuffled for all pairs depends on the groups alone, and a task hands pairs out as it finds them."""
    from seqweave.operators import distance as D

    rows, loci = _loci(spark, 31, 60)
    sent, deal = [], D.dealt
    monkeypatch.setattr(D, "dealt", lambda *a, **k: sent.append(deal(*a, **k)) or sent[-1])
    for name, size in (("GROUPS", 4), ("GENOMES_PER_BLOCK", 4), ("SLICE", 8)):
        monkeypatch.setattr(D, name, size)
    got = {(r.g1, r.g2): (r.typed, r.d) for r in D.allele_distance(loci).collect()}
    assert got == _distances(rows) and len(sent) == 1
    assert sent[0].count() <= 3 * len({g for g, *_ in rows})
