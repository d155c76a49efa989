"""Small hand-made cases against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.functions import vocab
from seqweave.operators import association as A
from seqweave.operators import clustering as L
from seqweave.operators import matching as M
from seqweave.operators import metadata as MD
from seqweave.operators import neighbours as N
from seqweave.operators import sequence as S
from seqweave.operators import stats as X
from seqweave.operators import pairs as P


def test_rotation_both_strands_and_fallback(spark):
    rows = [
        # genome, contig, idx, length, circular, name, family, strand
        *[(1, 10, i, 4, True, "", f, "+") for i, f in enumerate("xAyz")],
        *[(2, 20, i, 4, True, "", f, "-") for i, f in enumerate("xAyz")],
        *[(3, 30, i, 3, False, "", f, "+") for i, f in enumerate("pBq")],
    ]
    df = spark.createDataFrame(rows, "genome bigint, contig bigint, idx bigint, length bigint, circular boolean, name string, family string, strand string")
    fams = spark.createDataFrame([("A", 0), ("B", 1)], "family string, priority int")
    turned = S.rotate(df, S.anchor_genes(df, fams))
    walk = {}
    for r in S.window_walk(turned, 4).collect():
        walk.setdefault(r.genome, {})[r.column] = r.family
    assert walk == {1: dict(enumerate("Ayzx")), 2: dict(enumerate("Axzy")), 3: {1: "B", 2: "q"}}


@pytest.mark.parametrize("size", [2, 65536])
@pytest.mark.parametrize("positions,want", [
    ([5], [(5, 5, 1)]),
    ([0, 30, 61], [(61, 30, 3)]),          # exactly 30 joins, also over the origin (91 - 61 = 30)
    ([0, 31, 62, 80], [(0, 0, 1), (31, 31, 1), (62, 80, 2)]),
    ([2, 3, 50, 88], [(50, 50, 1), (88, 3, 3)]),
])
def test_circular_blocks(spark, positions, want, size):
    length = 91 if positions[-1] == 61 else (120 if positions[-1] == 80 else 91)
    df = spark.createDataFrame([(1, p, length) for p in positions], "genome bigint, pos bigint, length bigint")
    got = sorted((r.start, r.end, r.genes) for r in S.circular_blocks(df, ["genome"], 30, size=size).collect())
    if positions == [0, 30, 61]:
        # gaps 30, 31, 30: one cut, so the block runs from 61 over the origin to 30
        assert got == [(61, 30, 3)]
    else:
        assert got == sorted(want)


def test_pair_geometry_against_all_copies(spark):
    rnd = random.Random(5)
    rows = [(g, p, 40, rnd.choice("abcde")) for g in range(6) for p in range(40)]
    df = spark.createDataFrame(rows, "genome bigint, pos bigint, length bigint, family string")
    pairs = spark.createDataFrame([(0, "a", "b"), (1, "c", "a")], "pair bigint, a string, b string")
    got = {(r.pair, r.genome): (r.distance, r.sep) for r in S.pair_geometry(df, pairs, F.col("family") == "e", size=7).collect()}
    seqs = {g: [f for gg, _, _, f in rows if gg == g] for g in range(6)}
    for pair, a, b in ((0, "a", "b"), (1, "c", "a")):
        for g, s in seqs.items():
            best_d, best_s = 99, 99
            for i, j in itertools.product(range(40), range(40)):
                if s[i] != a or s[j] != b:
                    continue
                lo, hi = min(i, j), max(i, j)
                inner = sum(s[k] == "e" for k in range(lo + 1, hi))
                outer = sum(s[k] == "e" for k in list(range(hi + 1, 40)) + list(range(lo)))
                best_d = min(best_d, hi - lo, 40 - hi + lo)
                best_s = min(best_s, inner if hi - lo <= 40 - hi + lo else outer)
            assert got[(pair, g)] == (best_d, best_s)


def test_pair_products_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    rows = sorted({(rnd.randrange(23), rnd.randrange(50)) for _ in range(400)})
    df = spark.createDataFrame([(i, f, (i * f) % 7 + 1.0) for i, f in rows], "item bigint, feature bigint, w double")
    want = {}
    by = {}
    for i, f in rows:
        by.setdefault(f, []).append(i)
    for f, items in by.items():
        for a, b in itertools.combinations(sorted(items), 2):
            w = ((a * f) % 7 + 1.0) * ((b * f) % 7 + 1.0)
            n, s = want.get((a, b), (0, 0.0))
            want[(a, b)] = (n + 1, s + w)
    monkeypatch.setattr(P, "ITEMS_PER_BLOCK", 6)
    monkeypatch.setattr(P, "ROWS_PER_CHUNK", 60)
    counts = {(r.a, r.b): r.shared for r in P.pair_products(df, "item", "feature").collect()}
    sums = {(r.a, r.b): r.w for r in P.pair_products(df, "item", "feature", ["w"]).collect()}
    assert counts == {k: v[0] for k, v in want.items()}
    assert sums == {k: v[1] for k, v in want.items()}


def test_pair_agreement_counts_pairs(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("pq"), rnd.randrange(6), rnd.randrange(3), rnd.choice("xy")) for _ in range(60)]
    df = spark.createDataFrame([(s, g, a, b) for s, g, a, b in rows], "stratum string, genome bigint, allele bigint, branch string")
    got = {(r.stratum, r.exposed, r.outcome): r.n for r in A.pair_agreement(df).collect()}
    want = {k: 0 for k in got}
    for x, y in itertools.combinations(rows, 2):
        if x[0] == y[0] and x[1] != y[1]:
            want[(x[0], int(x[2] == y[2]), int(x[3] == y[3]))] += 1
    assert got == want


def test_permutation_is_a_relabelling(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(90)], "stratum bigint, unit bigint")
    rows = A.permute_within(df, ["stratum"], "unit", 2).collect()
    assert len(rows) == 180
    for d in (0, 1):
        mine = [r for r in rows if r.draw == d]
        assert sorted(r.unit for r in mine) == sorted(r.other for r in mine) == list(range(90))
        assert all(r.unit % 3 == r.other % 3 for r in mine)
        assert any(r.unit != r.other for r in mine)


def test_average_linkage_matches_plain_merging(spark):
    rng = np.random.default_rng(4)
    pts = rng.random((14, 2))
    n = len(pts)
    d = {(i, j): float(np.linalg.norm(pts[i] - pts[j])) for i in range(n) for j in range(i + 1, n)}
    groups = {i: [i] for i in range(n)}
    cut = 0.45
    while len(groups) > 1:
        mean = lambda a, b: np.mean([d[tuple(sorted((x, y)))] for x in groups[a] for y in groups[b]])
        h, a, b = min((round(mean(a, b), 12), a, b) for a, b in itertools.combinations(sorted(groups), 2))
        if h > cut:
            break
        groups[a] += groups.pop(b)
    want = {frozenset(g) for g in groups.values()}
    dist = spark.createDataFrame([(i, j, v) for (i, j), v in d.items()], "a bigint, b bigint, d double")
    members, merges = L.average_linkage(dist, spark.range(n).withColumnRenamed("id", "leaf"), cut)
    got = {}
    places = {}
    for r in members.collect():
        got.setdefault(r.cluster, set()).add(r.leaf)
        places.setdefault(r.cluster, []).append(r.place)
    assert {frozenset(g) for g in got.values()} == want
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert merges.count() == n - len(want)


def test_communities_of_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10, 20) for a, b in itertools.combinations(range(base, base + 5), 2)]
    edges += [(0, 10, 0.5), (10, 20, 0.5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint, w double")
    member = L.communities(df)
    got = {}
    for r in member.collect():
        got.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(b, b + 5)) for b in (0, 10, 20)]
    assert L.modularity(df, member) > 0.6


def test_signed_rank_exact_and_ties(spark):
    values = [1.5, -0.5, 2.0, 3.0, -1.0, 4.0]
    df = spark.createDataFrame([("k", v) for v in values] + [("t", v) for v in (1.0, 1.0, -1.0, 2.0, 0.0, 3.0)], "k string, x double")
    out = X.signed_rank(df, ["k"], "x").withColumn("p", X.signed_rank_p("n", "w", "tied", "z"))
    rows = {r.k: r for r in out.collect()}
    ranks = {abs(v): i + 1 for i, v in enumerate(sorted(values, key=abs))}
    w = sum(ranks[v] for v in values if v > 0)
    tail = sum(1 for s in itertools.product((0, 1), repeat=6) if sum(r for r, on in zip(range(1, 7), s) if on) >= w) / 64
    assert rows["k"].n == 6 and rows["k"].w == w and rows["k"].p == pytest.approx(tail)
    assert rows["t"].n == 5 and rows["t"].tied and rows["t"].w == 2 + 2 + 4 + 5


def test_benjamini_hochberg_with_undefined(spark):
    p = [0.01, 0.04, float("nan"), 0.03, 0.5, 0.04]
    df = spark.createDataFrame([(x,) for x in p] + [(None,)], "p double")
    got = {r.p: r.q for r in X.benjamini_hochberg(df, "p").collect()}
    s = sorted(x for x in p if x == x)
    raw = [v * len(s) / (i + 1) for i, v in enumerate(s)]
    want = {v: min(raw[i:] + [1.0]) for i, v in enumerate(s)}
    for v in set(s):
        assert got[v] == pytest.approx(min(want[v], want[v]))
    assert set(got) == set(s)


def test_matched_controls_fall_through_tiers(spark):
    units = spark.createDataFrame([(1, 7, 100, 103, 4, 20, 123, 1.0)], "genome bigint, unit bigint, start bigint, end bigint, size bigint, dist bigint, row bigint, delta double")
    near = lambda ids, end, size: [(1, i, end - size + 1, end, size, float(i)) for i in ids]
    schema = "genome bigint, control bigint, c_start bigint, c_end bigint, c_size bigint, c_delta double"

    def tiers(pool, **kw):
        rows = M.matched_controls(units, spark.createDataFrame(pool, schema), **kw).collect()
        return sorted(r.control for r in rows), {r.tier for r in rows}

    narrow = near([1, 2, 3], 107, 3)                    # 16 before the row, not overlapping
    wide = near([4, 5], 93, 10)                          # 30 before the row, larger
    assert tiers(narrow + wide) == ([1, 2, 3], {1})
    assert tiers(narrow[:2] + wide) == ([1, 2, 4, 5], {2})
    assert tiers(narrow[:1] + wide[:1]) == ([1, 4], {2})
    far = near([6], 60, 4)                               # 63 before the row: only on the log scale
    assert tiers(narrow[:1] + far, log_factor=4.0) == ([1, 6], {3})


def test_verdicts(spark):
    cols = "tested boolean, q_effect double, p_sign double, q_opposite double, half0 double, half1 double, q_specific double, q_specific_raw double, q_specific_opp double, q_specific_raw_opp double"
    rows = [
        (False, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0), (True, 0.01, 0.01, 1.0, 1.0, 1.0, 0.01, 0.01, 1.0, 1.0),
        (True, 0.01, 0.01, 1.0, 1.0, 1.0, 0.01, 0.2, 1.0, 1.0), (True, 1.0, 1.0, 0.01, -1.0, -1.0, 1.0, 1.0, 0.01, 0.01),
        (True, 1.0, 1.0, 0.01, -1.0, -1.0, 1.0, 1.0, 0.5, 0.01), (True, 0.01, 0.01, 1.0, 1.0, -1.0, 0.0, 0.0, 1.0, 1.0),
    ]
    got = [r.v for r in spark.createDataFrame(rows, cols).select(X.verdict().alias("v")).collect()]
    assert got == ["nt", "knows", "not specific", "opposite", "not specific (opposite)", "none"]


def test_metadata(spark):
    df = spark.createDataFrame([
        ("  Not  Collected ", "Escherichia coli O157:H7 str. X", "ST 131", "2012-05", "Bos taurus"),
        (" K-12;,", "E. coli", "none", "", "Unknown host"),
    ], "strain string, org string, st string, day string, host string")
    out = df.select(
        MD.clean(F.col("strain")), MD.serotype(F.col("org"), F.lit("")), MD.extract(F.col("st"), vocab.SEQUENCE_TYPE, prefix="ST"),
        MD.extract(F.col("day"), vocab.YEAR), MD.canonical(F.col("host")),
    ).collect()
    assert [tuple(r) for r in out] == [("", "O157:H7", "ST131", "2012", "cattle"), ("K-12", "", "", "", "Unknown host")]
    dna = spark.createDataFrame([("GTGAAATAA",), ("ATGNNNTTTT",), ("AT",), ("TAA",)], "d string")
    assert [r[0] for r in dna.select(MD.translate(F.col("d"))).collect()] == ["MK", "MXF", "", ""]


def test_exemplars_in_blocks_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id bigint, v array<double>")
    bank = rows.where("id < 25").withColumnRenamed("id", "exemplar")
    take = lambda df: {(r.id, r.place): r.exemplar for r in df.collect()}
    small = take(N.nearest_exemplars(rows, bank, 4))
    monkeypatch.setattr(N, "SLICE", 2)
    assert take(N.nearest_exemplars(rows, bank, 4, block_rows=9)) == small
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(small[(i, 1)] == int(np.argmax(unit[i] @ unit[:25].T)) for i in range(60))


def test_nearest_in_group_looks_further_when_needed(spark):
    rnd = random.Random(9)
    n = 30
    dist = {(a, b): round(rnd.random(), 3) for a, b in itertools.combinations(range(n), 2)}
    members = [(f, g) for f, every in (("x", 1), ("y", 5)) for g in range(n) if g % every == 0]
    d = spark.createDataFrame([(a, b, v) for (a, b), v in dist.items()], "g1 bigint, g2 bigint, d double")
    m = spark.createDataFrame(members, "fork string, genome bigint")
    got = {}
    for r in N.nearest_in_group(m, "fork", d, 3, reach=1).collect():
        got.setdefault((r.fork, r.genome), set()).add(r.other)
    for f, g in members:
        near = sorted((dist[tuple(sorted((g, o)))], o) for ff, o in members if ff == f and o != g)[:3]
        assert got[(f, g)] == {o for _, o in near}


def test_edit_moves_everything_after(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate("abcde")], "genome bigint, pos bigint, family string")
    edits = spark.createDataFrame([(1, 0, "insert", "N"), (1, 1, "delete", ""), (1, 1, "insert", "M"), (1, 3, "substitute", "S")],
                                  "genome bigint, pos bigint, op string, family string")
    out = sorted((r.pos, r.family) for r in S.edit(df, edits, size=2).collect())
    assert out == list(enumerate("NaMcSe"))


def test_detectable_shift_and_sign_test(spark):
    df = spark.createDataFrame([(7, 9), (0, 0)], "k bigint, n bigint")
    p = [r[0] for r in df.select(X.sign_test_p("k", "n")).collect()]
    assert p[0] == pytest.approx(sum(math.comb(9, i) for i in (7, 8, 9)) / 512)
    assert p[1] is None or math.isnan(p[1])


def test_agreement_over_blocks_of_genomes(spark, monkeypatch):
    from seqweave.operators import relatedness as R

    rnd = random.Random(11)
    traits = {(g, t): rnd.randrange(2) for g in range(24) for t in "pqr" if rnd.random() < 0.6 and not (t == "r" and g > 4)}
    outcomes = {(g, o): rnd.choice("xy") for g in range(24) for o in "mn" if rnd.random() < 0.8}
    bins = {(a, b): rnd.randrange(2) for a, b in itertools.combinations(range(24), 2)}
    long = lambda d: spark.createDataFrame([(g, n, str(v)) for (g, n), v in d.items()], "genome bigint, name string, value string")
    binned = spark.createDataFrame([(a, b, v) for (a, b), v in bins.items()], "g1 bigint, g2 bigint, bin int")
    monkeypatch.setattr(R, "GENOMES_PER_BLOCK", 5)
    got = {(r.trait, r.outcome): r.z for r in R.agreement_cmh(long(traits), long(outcomes), binned).collect()}
    for t, o in itertools.product("pqr", "mn"):
        num = var = 0.0
        for b in (0, 1):
            ok = [(x, y) for (x, y), v in bins.items() if v == b and (x, o) in outcomes and (y, o) in outcomes]
            same = lambda d, k, x, y: (x, k) in d and (y, k) in d and d[(x, k)] == d[(y, k)]
            n, c = len(ok), sum(same(outcomes, o, x, y) for x, y in ok)
            r = sum(same(traits, t, x, y) for x, y in ok)
            a = sum(same(traits, t, x, y) and same(outcomes, o, x, y) for x, y in ok)
            if n > 1:
                num += a - r * c / n
                var += r * (n - r) * c * (n - c) / (n * n * (n - 1))
        assert got[(t, o)] == pytest.approx(num / max(var, 1e-9) ** 0.5)


def test_linkage_counts_pairs_without_a_distance_as_one(spark):
    from seqweave.operators import clustering as L

    leaves = spark.createDataFrame([("x",), ("y",), ("z",)], "leaf string")
    near = spark.createDataFrame([("x", "y", 0.2), ("x", "z", 0.82)], "a string, b string, d double")
    members, _ = L.average_linkage(near, leaves, cut=0.95)
    assert len({r.cluster for r in members.collect()}) == 1
    members, _ = L.average_linkage(near, leaves, cut=0.9)
    groups = {r.leaf: r.cluster for r in members.collect()}
    assert groups["x"] == groups["y"] != groups["z"]


def test_units_of_long_genomes_stay_apart(spark):
    from seqweave.operators import matching as M
    from seqweave.plans.knockout_queries import POSITIONS

    key = lambda genome, start: genome * POSITIONS + start
    spots = [(1, 100_010 + 40 * i) for i in range(6)] + [(2, 10 + 40 * i) for i in range(6)]
    units = spark.createDataFrame(
        [(g, key(g, s), s, s + 3, 4, 10, s + 13) for g, s in spots],
        "genome bigint, unit bigint, start bigint, end bigint, size bigint, dist bigint, row bigint")
    pool = spark.createDataFrame([(g, key(g, s), s, s + 3, 4, 1.0) for g, s in spots],
                                 "genome bigint, control bigint, c_start bigint, c_end bigint, c_size bigint, c_delta double")
    found = M.matched_controls(units, pool, log_factor=10.0).collect()
    assert found and all(r.unit // POSITIONS == r.control // POSITIONS for r in found)


def test_serotype_takes_the_leftmost_antigen(spark):
    df = spark.createDataFrame([("Escherichia coli O26", "H11 then O157", ""), ("E. coli O26:H11", "", "none")], "o string, a string, b string")
    got = [r[0] for r in df.select(MD.serotype(F.col("o"), F.col("a"), F.col("b"))).collect()]
    assert got == ["H11", "O26:H11"]
