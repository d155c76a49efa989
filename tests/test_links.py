"""Calibrated links, specificity, claims, trees, controls, swaps and admissions against plain versions."""

import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqweave.operators import claims, controls, correlation, exports, interpretation, links, stats, swaps, trees
from seqweave.streaming import admission


def test_calibrated_against_draws_one_by_one(spark):
    rng = random.Random(3)
    units = [(f"l{u % 3}", f"g{rng.randrange(9)}", u * 2**33 + 7, rng.randrange(-5, 9), [rng.choice([None, -3, -1, 0, 1, 2, 5]) for _ in range(rng.randrange(0, 6))])
             for u in range(120)]
    units.append(("l9", "g1", 5, 1, [1]))
    df = spark.createDataFrame(units, "link string, lineage string, unit long, x long, stand array<long>").repartition(4)
    got = {r.link: r for r in links.calibrated(df, draws=70, block=16, seed=5).collect()}
    p = links.PRIME

    def score(rows):
        sums = {}
        for lineage, v in rows:
            if v is not None:
                sums.setdefault(lineage, []).append(v)
        means = np.array([[sum(v) / len(v)] for v in sums.values()])
        return links._signed_rank(means, 5)[0] if len(means) else math.nan

    for link in ("l0", "l1", "l2"):
        mine = [u for u in units if u[0] == link and u[4]]
        real = score([(u[1], u[3]) for u in mine])
        draws = []
        for d in range(70):
            rows = []
            for _, lineage, unit, _, stand in mine:
                h = (unit % p + d * 7_368_787 + 5 * 15_485_863) % p
                for add in (12_345, 67_891):
                    h = (h * h + add) % p
                rows.append((lineage, stand[h * len(stand) // p]))
            draws.append(score(rows))
        draws = [z for z in draws if math.isfinite(z)]
        assert got[link].z == real and got[link].draws == len(draws)
        assert got[link].p_up == (1 + sum(z >= real for z in draws)) / (1 + len(draws))
        assert got[link].p_down == (1 + sum(z <= real for z in draws)) / (1 + len(draws))
    assert got["l9"].z is None and got["l9"].p_up is None and got["l9"].lineages == 1


def test_calibrated_p_is_even_without_an_effect(spark):
    rng = np.random.default_rng(1)
    rows = []
    for link in range(40):
        for unit in range(60):
            values = [int(v) for v in rng.normal(size=8) * 1000]
            rows.append((f"l{link}", f"g{unit % 12}", link * 1000 + unit, values[0], values))
    df = spark.createDataFrame(rows, "link string, lineage string, unit long, x long, stand array<long>")
    p = [r.p_up for r in links.calibrated(df, draws=200).collect()]
    assert 0.3 < np.mean(p) < 0.7 and np.mean(np.array(p) < 0.1) < 0.3


def test_specificity_bands(spark):
    rows = [(1, d, float(v)) for d, v in ((10, 5), (11, 1), (12, 1), (13, 2), (40, 9), (60, 1), (61, 2), (25, 3), (300, 1))]
    got = {r.dist: r for r in links.specificity(spark.createDataFrame(rows, "pass int, dist int, delta double")).collect()}
    for d, v in [(x, y) for _, x, y in rows]:
        near = [w for _, e, w in rows if e != d and abs(e - d) <= 0.35 * d]
        wide = [w for _, e, w in rows if e != d and abs(e - d) <= 0.6 * d]
        ref = near if len(near) >= 3 else wide
        if len(ref) < 3:
            assert d not in got
        else:
            assert got[d].n_ref == len(ref) and got[d].excess == v - np.median(ref)


def test_off_targets_are_the_nearest(spark):
    units = spark.createDataFrame([(1, 77, 100, 105, 40, 145)], "genome int, unit long, start int, end int, dist int, row int")
    entries = spark.createDataFrame([(1, e) for e in (103, 130, 131, 140, 145, 150, 158, 159, 160, 400)] + [(2, 144)], "genome int, entry int")
    assert [r.entry for r in links.off_targets(units, entries, most=3).orderBy("entry").collect()] == [140, 150, 158]


def test_upper_tail(spark):
    z = [-3.0, -0.5, 0.0, 1.0, 2.5]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(stats.upper_tail(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([0.5 * math.erfc(v / math.sqrt(2)) for v in z], abs=2e-7)


SAID = [(1, 0, "columns 3 to 5 show a share 40 to 52%, columns 5 to 3 show a share from 44 to 40%", []),
        (1, 1, "column 4, carried by 52%; `x#1`, carried by 41% and `none`, carried by 44%", []),
        (1, 2, "column 3 has a higher share than column 9; bits falling from column 3 to column 4", []),
        (1, 3, "all shell in columns 5 to 3, 2 cloud families in columns 4 to 4, 99999999999999999999 cloud families in columns 1 to 1", []), (1, 4, None, None)]


def test_claims(spark):
    said = spark.createDataFrame(SAID, "text_id int, nth int, text string, cites array<string>")
    facts = spark.createDataFrame([("share", 3, 40.0), ("share", 4, 52.0), ("share", 5, 44.4), ("bits", 3, 1.5), ("bits", 4, 1.49)], "role string, locus long, value double")
    facts = facts.withColumn("value", F.col("value").cast(claims.EXACT))
    genes = spark.createDataFrame([("x#1", 3), ("x#1", 4)], "gene string, locus long")
    assert [r.supported for r in claims.range_claims(said, facts).orderBy("at").collect()] == [True, True]
    assert [(r.locus, r.gene, r.supported) for r in claims.bound_numbers(said, facts, genes).orderBy("at").collect()] == [
        (4, None, True), (None, "x#1", False), (None, "none", False)]
    assert [(r.role, r.holds) for r in claims.comparison_claims(said, facts).orderBy("at").collect()] == [("share", False), ("bits", False)]
    families = spark.createDataFrame([(3, "a", "shell"), (4, "b", "shell"), (4, "c", "cloud"), (5, "d", "shell")], "locus long, family string, partition string")
    got = claims.partition_claims(said, families).orderBy("at").collect()
    assert [(r.n, r.matching, r.holds) for r in got] == [(4, 3, False), (2, 1, False), (0, 0, False)]


def test_says_rounds_but_never_to_the_edges(spark):
    pairs = [(44.0, 44.4, True), (44.5, 44.45, True), (44.4, 44.45, True), (45.0, 44.4, False), (0.0, 0.3, False), (100.0, 99.8, False), (0.0, 0.0, True)]
    df = spark.createDataFrame(pairs, "s double, o double, ok boolean").select(
        claims.says(F.col("s").cast(claims.EXACT), F.col("o").cast(claims.EXACT)).alias("got"), "ok")
    assert all(r.got == r.ok for r in df.collect())


def test_interpretation(spark):
    texts = spark.createDataFrame([(1, "It is [[sugar transporters]] and [[secretion]]; [[sugar hydrolysis]]"), (2, "nothing [[alone here]]"), (3, None)], "text_id int, text string")
    cited = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (1, "d")], "text_id int, family string")
    products = spark.createDataFrame([("a", "sugar transporter"), ("b", "Sugar ABC transport protein"), ("c", "secreted protein"), ("e", "glycosyl hydrolase")], "family string, product string")
    got = interpretation.interpretation_fit(texts, cited, products).orderBy("text_id", "at").collect()
    assert [(r.phrase, r.words, r.families, r.hits, r.unknown, r.fits) for r in got] == [
        ("sugar transporters", 2, 4, 2, 0, True), ("secretion", 1, 4, 1, 0, False), ("sugar hydrolysis", 2, 4, 2, 1, False), ("alone here", 2, 0, 0, 2, False)]
    words = ["hydrolysis", "transporters", "secretion", "reading", "gases"]
    stems = spark.createDataFrame([(w,) for w in words], "w string").select(interpretation.stem(F.col("w"))).collect()
    assert [r[0] for r in stems] == ["hydrol", "transport", "secret", "reading", "gases"]


@pytest.mark.parametrize("seed", range(4))
def test_greedy_halves(spark, seed):
    rng = random.Random(seed)
    sizes = [(f"{i:02d}x", rng.choice([1, 1, 2, 3, 5, 30]) if seed else 4) for i in range(rng.randrange(1, 40))]
    load, want = [0, 0], {}
    for name, n in sorted(sizes, key=lambda s: (-s[1], s[0])):
        side = 0 if load[0] <= load[1] else 1
        want[name], load[side] = side, load[side] + n
    df = spark.createDataFrame(sizes, "lineage string, n long")
    assert {r.lineage: r.side for r in trees.greedy_halves(df).collect()} == want
    top = {r.lineage: r.side for r in trees.largest_against_rest(df).collect()}
    assert sum(top.values()) == 1 and top[min(sizes, key=lambda s: (-s[1], s[0]))[0]] == 1
    assert {r.side for r in trees.hashed_halves(df).collect()} <= {0, 1}


def test_cuts_and_order_of_a_tree(spark):
    merges = spark.createDataFrame([("a", "b", 0.1, 2), ("c", "d", 0.2, 2), ("a", "c", 0.4, 4), ("e", "f", 0.4, 2), ("a", "e", 0.9, 6)],
                                   "kept string, dropped string, height double, size long")
    leaves = spark.createDataFrame([(x,) for x in "abcdef"], "leaf string")
    cut = lambda k: "".join(r.cluster for r in trees.flat_clusters(leaves, merges, k).orderBy("leaf").collect())
    assert [cut(k) for k in (6, 5, 4, 3, 2, 1)] == ["abcdef", "aacdef", "aaccef", "aaaaee", "aaaaee", "aaaaaa"]
    order = {r.leaf: (r.tree, r.place) for r in trees.leaf_order(leaves, merges).collect()}
    assert order == {x: ("a", i) for i, x in enumerate("abcdef")}
    with pytest.raises(ValueError):
        trees.flat_clusters(leaves, merges.where("height < 0.5"), 1)


def test_leave_one_out():
    rng = np.random.default_rng(0)
    for n in (2, 3, 4, 7, 8):
        values = rng.integers(0, 5, n).astype(float)
        median, mad = controls.leave_one_out(values)
        for i in range(n):
            others = np.delete(values, i)
            assert median[i] == np.median(others) and mad[i] == np.median(np.abs(others - np.median(others)))


def test_influence_null(spark):
    rng = random.Random(9)
    values = {p: [float(rng.choice([1, 2, 3, 4, 9])) for _ in range(6)] for p in range(1, 8)}
    profile = spark.createDataFrame([(p, b, v) for p, vs in values.items() for b, v in enumerate(vs)], "pass long, bin long, mean_abs double")
    who = spark.createDataFrame([(1, c, abs(c - 4)) for c in range(2, 8)] + [(8, 1, 1)], "unit long, control long, gap long")
    got = controls.influence_null(profile, who, most=5, level=1.0).collect()
    chosen = [4, 3, 5, 2, 6]

    def read(own, others):
        far, ratio = [], []
        for b in range(6):
            x = np.array([values[c][b] for c in others])
            med = np.median(x)
            far.append((values[own][b] - med) / max(1.4826 * np.median(np.abs(x - med)), 1e-6) >= 1.0)
            ratio.append(values[own][b] / med)
        quiet = [b for b in range(6) if not far[b]]
        return max([b + 1 for b in range(6) if far[b]], default=0), min(quiet, default=6), sum(far), round(float(np.median(ratio)), 9)

    real = read(1, chosen)
    null = [read(c, [d for d in chosen if d != c]) for c in chosen]
    assert len(got) == 1
    r = got[0]
    assert (r.unit, r.controls, r.radius, r.contiguous, r.beyond, r.broad) == (1, 5, *real)
    assert [r.p_radius, r.p_contiguous, r.p_beyond, r.p_broad] == [(1 + sum(n[i] >= real[i] for n in null)) / 6 for i in range(4)]


def panel(elements, targets):
    import hashlib

    out = []
    for genome in {e[0] for e in elements}:
        state = [dict(e=e, uses=0, free=[True] * (e[3] - e[2] + 1)) for e in elements if e[0] == genome]
        taken = []
        for _, step, size in sorted(t for t in targets if t[0] == genome):
            options = []
            for s in state:
                room = [i for i in range(len(s["free"]) - size + 1) if all(s["free"][i : i + size])]
                if room:
                    mid = (s["e"][2] + s["e"][3]) / 2
                    far = min((abs(t - mid) for t in taken), default=0.0)
                    tie = hashlib.md5(f"{genome}|{step}|{s['e'][1]}".encode()).hexdigest()
                    options.append(((s["uses"], -far, tie), s, room))
            if not options:
                continue
            _, s, room = min(options, key=lambda o: o[0])
            at = room[(genome * 31 + step * 17 + s["e"][1]) % len(room)]
            s["free"][at : at + size] = [False] * size
            s["uses"] += 1
            first = s["e"][2] + at
            taken.append(first + (size - 1) / 2)
            out.append((genome, step, s["e"][1], first, first + size - 1, size))
    return sorted(out)


def test_control_panel(spark):
    rng = random.Random(2)
    elements = []
    for genome in (1, 2, 3):
        at = 0
        for i in range(rng.randrange(3, 7)):
            at += rng.randrange(2, 30)
            end = at + rng.randrange(0, 6)
            elements.append((genome, i, at, end))
            at = end
    targets = [(g, k, s) for g in (1, 2, 3) for k, s in enumerate(sorted((rng.randrange(1, 5) for _ in range(6)), reverse=True))]
    got = controls.control_panel(spark.createDataFrame(elements, "genome long, element long, start long, end long"), spark.createDataFrame(targets, "genome long, step int, size int"))
    assert sorted(tuple(r) for r in got.collect()) == panel(elements, targets)


def test_rank_correlation(spark):
    rng = np.random.default_rng(4)
    grid = rng.integers(0, 4, (6, 30)) * (rng.random((6, 30)) < 0.7)
    grid[0] = 2
    rows = [(f"i{i}", u, float(grid[i, u])) for i in range(6) for u in range(30) if grid[i, u]]
    got = {(r.a, r.b): r for r in correlation.rank_correlation(spark.createDataFrame(rows, "item string, unit long, value double"), 30).collect()}
    frame = pd.DataFrame(grid.T.astype(float))
    for i in range(6):
        for j in range(i + 1, 6):
            r = got[f"i{i}", f"i{j}"]
            for name in ("pearson", "spearman"):
                a, b = (frame[k].rank() if name == "spearman" else frame[k] for k in (i, j))
                want = np.corrcoef(a, b)[0, 1] if i else None
                assert getattr(r, name) == (None if want is None else pytest.approx(want))


def test_swap_partners(spark):
    rng = random.Random(6)
    sites = [(f"p{rng.randrange(3)}", rng.randrange(4), pos, rng.choice("xyz"), pos) for pos in range(60)] + [("q", 1, 900, "x", 900), ("q", 1, 901, "y", 901)]
    got = swaps.swap_partners(spark.createDataFrame(sites, "group string, genome long, pos long, branch string, allele long")).collect()
    by = {s[4]: s for s in sites}
    donors = lambda s, branch: [t for t in sites if t[0] == s[0] and t[3] == branch and t[1] != s[1]]
    want = {(s[2], b) for s in sites for b in {t[3] for t in sites if t[0] == s[0]} - {s[3]} if donors(s, b) and donors(s, s[3])}
    assert {(r.pos, r.other) for r in got} == want and len(got) == len(want)
    for r in got:
        assert by[r.cross] in donors(by[r.allele], r.other) and by[r.same] in donors(by[r.allele], r.branch)


def test_decoder_rows_read_only_their_blocks(spark, tmp_path):
    weights = [(h, f"f{i:03d}", c, (i + c + h) / 100) for h in (0, 1) for i in range(40) for c in range(i % 4 + 1)]
    df = spark.createDataFrame(weights, "half long, family string, cluster long, weight double")
    exports.write_decoder(df, str(tmp_path / "d"), per_block=8)
    wanted = spark.createDataFrame([(0, "f001"), (0, "f003"), (0, "f003"), (1, "f039"), (1, "nowhere")], "half long, family string")
    rows, missing = exports.decoder_rows(spark, str(tmp_path / "d"), wanted)
    assert sorted(tuple(r) for r in rows.collect()) == sorted(w for w in weights if (w[0], w[1]) in {(0, "f001"), (0, "f003"), (1, "f039")})
    assert [tuple(r) for r in missing.collect()] == [(1, "nowhere")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "block" in plan.split("PartitionFilters")[1]
    assert exports.decoder_rows(spark, str(tmp_path / "d"), wanted.limit(0))[0].collect() == []


def test_admissions_equal_a_sequential_model(spark, tmp_path):
    rng = random.Random(8)
    limits = admission.Limits(most=3, window_ms=600_000, daily=7)
    base = pd.Timestamp("2024-03-01 23:20:00", tz="UTC")
    batches, number = [], 0
    for b in range(4):
        rows = []
        for _ in range(25):
            number += 1
            late = pd.Timedelta(minutes=rng.choice([0, 0, 0, -4]))
            rows.append((rng.choice("ab"), number, base + pd.Timedelta(minutes=9 * b, seconds=rng.randrange(540)) + late, rng.random() < 0.2))
        batches.append(rows)
    schema = "client string, id long, ts timestamp, refund boolean"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for i, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=["client", "id", "ts", "refund"])
        frame["ts"] = frame["ts"].dt.tz_localize(None).astype("datetime64[us]")
        frame.to_parquet(f"{source}/{i}.parquet", index=False)
        os.utime(f"{source}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = admission.admissions(stream, limits, "30 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
    query.awaitTermination(240)
    query.stop()
    got = {r.id: (r.outcome, r.wait_s) for r in spark.read.parquet(out).collect()}
    want = sequential(batches, limits)
    assert got == want and {o for o, _ in want.values()} == {"admitted", "refunded", "limit", "limit_day"}


def sequential(batches, limits):
    out, state = {}, {}
    for rows in batches:
        for client in {r[0] for r in rows}:
            times, day, today = state.get(client, ([], -1, 0))
            latest = times[-1] if times else 0
            for _, number, ts, refund in sorted((r for r in rows if r[0] == client), key=lambda r: (r[2], r[1])):
                latest = max(latest, int(ts.timestamp() * 1000))
                times, day, today, outcome, wait = limits.step(times, day, today, latest, refund)
                out[number] = (outcome, wait)
            state[client] = times, day, today
    return out


def test_block_pairs_over_blocks_and_chunks(spark, monkeypatch):
    from seqweave.operators import association, hits

    monkeypatch.setattr(hits, "ROWS_PER_CHUNK", 200)
    rng = random.Random(5)
    held = [(g, f"f{f:03d}", g % 3) for g in range(24) for f in range(700) if rng.random() < 0.06]
    df = spark.createDataFrame(held, "genome long, family string, stratum long")
    margins = association.strata_margins(df)
    items = hits.numbered(df.select(F.col("family").alias("item")), F.substring("item", 1, 3))
    want = {(r.a, r.b): r for r in association.cmh_matrix(df, margins).collect()}
    got = {(r.a, r.b): r for r in hits.cmh_hits(df, margins, items, 2.0).collect()}
    assert set(got) == {k for k, r in want.items() if abs(r.z) >= 2.0 and r["var"] > 0} and got
    assert all(got[k].z == pytest.approx(want[k].z) and got[k].both == want[k].both for k in got)
    counted = hits.cmh_histogram(df, margins, items, least_var=0.0).collect()
    assert sum(r.pairs for r in counted) == sum(r["var"] > 0 for r in want.values())
    sets = {}
    for g, f, _ in held:
        sets.setdefault(f, set()).add(g)
    near = {(r.a, r.b): r.jaccard for r in hits.similar_pairs(df, items, 0.6).collect()}
    pairs = {(a, b): 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert near == {k: pytest.approx(d) for k, d in pairs.items() if d <= 0.6}


def test_mixture_and_nearest_quantiles(spark):
    from seqweave.operators import predictors, relatedness, tiling

    rng = np.random.default_rng(2)
    rows = [(int(i % 2), 1 + int(i % 3), float(q), float(f)) for i, (q, f) in enumerate(rng.uniform(0.01, 1, (60, 2)))] + [(0, 1, 0.0, 0.5)]
    got = {r.half: r for r in predictors.fit_mixture(spark.createDataFrame(rows, "half long, n long, q double, freq double"), [0, 0.1, 0.4]).collect()}
    bits = lambda half, share: sum(n * -math.log2(max((1 - share) * q + share * f, 1e-12)) for h, n, q, f in rows if h == half)
    for half in (0, 1):
        share = min((0.0, 0.1, 0.4), key=lambda x: (round(bits(1 - half, x), 6), x))
        sites = sum(n for h, n, _, _ in rows if h == half)
        assert got[half].l == share and got[half].sites == sites and got[half].bits == pytest.approx(bits(half, share) / sites)

    values = [(k, int(v)) for k in "ab" for v in rng.integers(0, 9, 11 if k == "a" else 6)]
    shares = [0.0, 0.25, 0.45, 0.5, 1.0]
    near = {(r.k, r.share): r.v for r in tiling.nearest_quantiles(spark.createDataFrame(values, "k string, v long"), ["k"], "v", shares).collect()}
    for k in "ab":
        own = np.sort([v for name, v in values if name == k])
        assert [near[k, s] for s in shares] == [own[round(s * (len(own) - 1))] for s in shares]

    distance = [(i, j, float(d)) for i, j, d in zip(range(40), range(1, 41), rng.integers(0, 12, 40) / 12, strict=True)]
    bins = relatedness.quantile_bins(spark.createDataFrame(distance, "g1 long, g2 long, d double"), 5).collect()
    edges = np.quantile([d for _, _, d in distance], np.linspace(0, 1, 6))
    assert all(r.bin == np.clip(np.searchsorted(edges, r.d, "right") - 1, 0, 4) for r in bins)


def test_projected_hops(spark):
    from seqweave.operators import regions

    edges = spark.createDataFrame([("a1", "x"), ("x", "b1"), ("a2", "a1"), ("b1", "c1"), ("a1", "c1")], "a string, b string")
    labels = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("c1", "C")], "node string, label string")
    assert sorted(tuple(r) for r in regions.projected_hops(edges, labels, 2).collect()) == [("A", "B", 2), ("A", "C", 1), ("B", "C", 1)]


def test_rank_sum_methods(spark):
    rows = [(6, 18.0, False, 1.5), (6, 18.0, True, 1.5), (4, 10.0, False, 1.8), (60, 1200.0, False, 2.1)]
    df = spark.createDataFrame(rows, "n long, w double, tied boolean, z double")
    got = {m: [r[0] for r in df.select(stats.rank_sum_p(m)("n", "w", "tied", "z")).collect()] for m in ("auto", "exact", "normal")}
    exact = sum(sum(i + 1 for i in range(6) if mask >> i & 1) >= 18 for mask in range(64)) / 64
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    nothing = lambda v: v is None or math.isnan(v)
    assert got["auto"][0] == got["exact"][0] == pytest.approx(exact) and got["normal"][0] == pytest.approx(tail(1.5))
    assert got["auto"][1] == pytest.approx(tail(1.5)) and nothing(got["exact"][1]) and all(nothing(got[m][2]) for m in got)
    assert got["auto"][3] == pytest.approx(tail(2.1)) and got["exact"][3] == pytest.approx(tail(2.1), abs=0.002)
    with pytest.raises(ValueError):
        stats.rank_sum_p("guess")


def test_forks_by_sites(spark):
    from seqweave.operators import forks

    rows = [(g, p, f, r) for g in range(4) for p, (f, r) in enumerate([("a", False), ("b" if g % 2 else "c", g < 2), ("a", False), ("d", True)])]
    genes = spark.createDataFrame(rows, "genome long, pos long, family string, in_rgp boolean")
    read = lambda **k: sorted((r.fork, r.branch, r.n, r.sites, r.plastic) for r in forks.forks_by_sites(genes, 8, **k).collect())
    assert read() == [("a", "b", 2, 8, 0.75), ("a", "c", 2, 8, 0.75), ("a", "d", 4, 8, 0.75)]
    assert read(min_n=3) == [] and read(min_sites=9) == [] and read(min_plastic=0.8) == []
    assert read(first_copy=True) == [("a", "b", 2, 4, 0.5), ("a", "c", 2, 4, 0.5)]


def test_extremes_places_and_word_groups(spark):
    from seqweave.operators import facts as X

    said = spark.createDataFrame([(1, 0, "most hesitant at column 3, fewest named at column 4 and least carried at column 9; `x#1` at column 3, `x#1` at column 5", [])],
                                 "text_id int, nth int, text string, cites array<string>")
    facts = spark.createDataFrame([("bits", 3, 1.5), ("bits", 4, 1.4), ("named", 3, 50.0), ("named", 4, 50.0), ("share", 3, 1.0)], "role string, locus long, value double")
    facts = facts.withColumn("value", F.col("value").cast(claims.EXACT))
    assert [(r.said, r.holds) for r in claims.extreme_claims(said, facts).orderBy("at").collect()] == [
        ("most hesitant", True), ("fewest named", True), ("least carried", False)]
    genes = spark.createDataFrame([("x#1", 3)], "gene string, locus long")
    assert [(r.locus, r.holds) for r in claims.placed_genes(said, genes).orderBy("at").collect()] == [(3, True), (5, False)]

    columns = spark.createDataFrame([(1, ["flagellar", "hook"]), (2, ["flagellar", "hook", "hook"]), (4, ["flagellar", "motor"]), (9, ["flagellar"]), (10, ["kinase"])],
                                    "locus long, words array<string>")
    assert [tuple(r) for r in X.word_groups(columns).collect()] == [("flagellar", 1, 4, 3, ["flagellar", "hook"])]
    branches = spark.createDataFrame([("b1", 1, ["sugar", "abc"]), ("b1", 2, ["sugar"]), ("b1", 3, ["other"]), ("b2", 5, ["alone"])], "branch string, locus long, words array<string>")
    assert [tuple(r) for r in X.branch_groups(branches).collect()] == [("b1", 1, 3, ["sugar"])]
