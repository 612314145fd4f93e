"""Golden cases and properties of the operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import columns as C
from helixframe.functions.orderstat import tie_ranks
from helixframe.operators import bias, compare, components, duet, evaluate, extract, norm, pileup, ranges, reactivity, regions, stats


def one(spark, *cols, **values):
    return spark.createDataFrame([values or {"x": 1}]).select(*cols).first()


def test_remap(spark):
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.25, 0.3, 0.7, 1.4)], "x double")
    got = [round(r[0], 6) for r in df.select(C.linear_remap(F.col("x"), F.lit(1.4))).collect()]
    assert got == [-0.14, 0.35, 0.55, 0.85, 1.0]


def test_fold_change(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(C.fold_change(F.col("a"), F.col("b"))).collect()] == [1.0, math.inf, 1.5]


def test_diffscan(spark):
    df = spark.createDataFrame([(0.9, 0.2), (0.9, 0.04), (0.5, 0.1)], "a double, b double")
    p, s = C.diffscan(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(p, s).collect()] == [(0.001, True), (0.5, False), (0.05 if abs(0.5 - 0.1) <= 0.4 else 0.01, True)]


def test_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 20, 30)], "v int").withColumn("k", F.lit(1))
    assert sorted(r["rank"] for r in tie_ranks(df, ["k"], "v").collect()) == [1, 2.5, 2.5, 4]
    assert sorted(r["rank"] for r in tie_ranks(df, ["k"], "v", compat=True).collect()) == [0.5, 2, 2, 3.5]


def test_strings(spark):
    r = one(spark, C.reverse_complement(F.col("s")), C.safe_name(F.lit("a/b:c|d e\\f")), C.cell_label(F.lit("/d/x_DMSO_RHX672.sort.bam")), C.subsequence(F.col("s"), F.lit(2), F.lit(3)), C.subsequence(F.col("s"), F.lit(2), F.lit(9)), s="ACGXT")
    assert tuple(r) == ("ANCGT", "a_b_c_d_e_f", "RHX672", "CG", "")


def test_erf(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(-30, 31)], "x double")
    assert all(abs(r[1] - math.erf(r[0])) < 2e-7 for r in df.select("x", C.erf(F.col("x"))).collect())


def test_interval_merge(spark):
    df = spark.createDataFrame([("a", 0, 100), ("a", 5050, 5100), ("a", 20000, 20100)], "c string, start long, end long")
    assert sorted((r["start"], r["end"]) for r in ranges.merge_intervals(df, ["c"]).collect()) == [(0, 5100), (20000, 20100)]


def test_contiguity(spark):
    df = spark.createDataFrame([("a", p) for p in (1, 4, 8, 20, 22)], "c string, pos int")
    assert sorted(r["pos"] for r in ranges.contiguous_runs(df, ["c"]).collect()) == [1, 4, 8]


def test_window_plan(spark):
    df = spark.createDataFrame([(1, 120)], "start int, end int")
    assert sorted((r["win_start"], r["win_end"]) for r in ranges.window_plan(df).collect()) == [(1, 100), (51, 120), (101, 120), (120, 120)]
    pos = spark.range(1, 121).select(F.col("id").cast("int").alias("p"), F.explode(ranges.windows_of(F.col("id").cast("int"), F.lit(1), F.lit(120))).alias("w"))
    want = {(p, s) for s, e in ((1, 100), (51, 120), (101, 120), (120, 120)) for p in range(s, e + 1)}
    assert {(r["p"], r["w"]) for r in pos.collect()} == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 60)), max_size=12), st.lists(st.integers(0, 260), max_size=20), st.integers(1, 50))
def test_range_join_is_nested_loop(spark, spans, points, width):
    r = spark.createDataFrame([(i, "c", s, s + n) for i, (s, n) in enumerate(spans)], "i int, c string, start long, end long")
    p = spark.createDataFrame([(j, "c", x) for j, x in enumerate(points)], "j int, k string, pos long")
    got = sorted((x["j"], x["i"]) for x in ranges.points_in_ranges(p, r, [("k", "c")], "pos", "start", "end", width).collect())
    assert got == sorted((j, i) for j, x in enumerate(points) for i, (s, n) in enumerate(spans) if s <= x <= s + n)


def test_band_join(spark):
    a = spark.createDataFrame([("x", p) for p in (1, 7, 30)], "k string, p int")
    b = spark.createDataFrame([("x", q) for q in (0, 6, 12, 36)], "k string, q int")
    assert sorted((r["p"], r["q"]) for r in ranges.band_join(a, b, ["k"], "p", "q", 5).collect()) == [(1, 0), (1, 6), (7, 6), (7, 12)]


READS = [
    ("r1", 0, "c", 3, 60, "4M", "GTAC", "IIII"), ("r2", 16, "c", 3, 60, "2M1D2M", "GTCG", "II!I"), ("r3", 0, "c", 1, 60, "1S3M1I2M", "AACGTTA", "IIIIIII"), ("r4", 4, "*", 0, 0, "*", "ACGT", "IIII"), ("r5", 1024, "c", 1, 60, "4M", "TTTT", "IIII"),
]


def test_pileup(spark):
    reads = spark.createDataFrame(READS, "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string")
    fasta = spark.createDataFrame([("c", "ACGTACGTAC")], "contig string, seq string")
    p = {(r["strand"], r["pos"]): r for r in pileup.pileup(reads, fasta).collect()}
    assert p["+", 3]["depth"] == 2 and p["+", 3]["base"] == "G" and p["+", 3]["mut_count"] == 0
    assert p["+", 3]["ins"] == 1 and p["-", 4]["del"] == 1 and ("-", 5) not in p
    assert p["-", 6]["mut_count"] == 0 and p["-", 6]["base_c"] == 1 and p["-", 4]["stop_count"] == 1
    assert p["+", 2]["stop_count"] == 1 and p["+", 1]["stop_count"] == 1
    q = {(r["strand"], r["pos"]): r for r in pileup.pileup(reads, fasta, min_base_qual=20).collect()}
    assert q["-", 6]["effective_depth"] == 0 and q["-", 6]["depth"] == 1
    assert pileup.pileup(reads.limit(0), fasta).count() == 0


def test_pileup_adds_over_splits(spark):
    reads = spark.createDataFrame(READS, "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string")
    fasta = spark.createDataFrame([("c", "ACGTACGTAC")], "contig string, seq string")
    whole = {tuple(r) for r in pileup.pileup(reads, fasta).select("strand", "pos", "depth", "mut_count").collect()}
    parts = pileup.pileup(reads.where("qname = 'r1'"), fasta).unionByName(pileup.pileup(reads.where("qname <> 'r1'"), fasta))
    assert {tuple(r) for r in pileup.merge_pileups(parts).select("strand", "pos", "depth", "mut_count").collect()} == whole


def test_coverage(spark):
    reads = spark.createDataFrame(READS, "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string")
    assert [tuple(r) for r in pileup.coverage_intervals(reads).select("start", "end").collect()] == [(0, 7)]


def test_auc_symmetry(spark):
    rng = np.random.default_rng(0)
    data = [(float(v), bool(s)) for v, s in zip(rng.integers(0, 9, 200) / 10, rng.random(200) < 0.4, strict=True)]
    df = spark.createDataFrame(data, "v double, is_single boolean")
    auc = lambda d: evaluate.auc(d, "v").first()["auc"]
    a = auc(df)
    pos, neg = [v for v, s in data if s], [v for v, s in data if not s]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(a - want) < 1e-12 and abs(auc(df.withColumn("v", -F.col("v"))) - (1 - a)) < 1e-12 and abs(auc(df.withColumn("v", F.exp("v"))) - a) < 1e-12


def test_shift_recovery(spark):
    seq = "ACGUUGCAACGGUACCGAUUAGC"
    stru = spark.createDataFrame([(i + 1, b, i % 2 == 0) for i, b in enumerate(seq)], "pos int, base string, is_single boolean")
    sig = spark.createDataFrame([(i + 1 - 4, b.replace("U", "T"), 0.1) for i, b in enumerate(seq)], "pos int, base string, v double")
    assert evaluate.best_shift(sig, stru, 8).first()["shift"] == 4


def test_shift_counts_by_brute_force(spark):
    rng = np.random.default_rng(3)
    letters = ["A", "c", "G", "U", "t", None]
    sig = [(int(k), int(p), letters[int(b)]) for k, p, b in zip(rng.integers(0, 2, 150), rng.integers(-40, 60, 150), rng.integers(0, 6, 150), strict=True)]  # repeated positions on both sides
    stru = [(int(p), letters[int(b)], True) for p, b in zip(rng.integers(-50, 70, 120), rng.integers(0, 6, 120), strict=True)]
    got = evaluate.match_counts(spark.createDataFrame(sig, "k int, pos int, base string"), spark.createDataFrame(stru, "pos int, base string, is_single boolean"), 6, ["k"]).collect()
    plain = lambda b: None if b is None else b.upper().replace("U", "T")
    want = {}
    for k, p, b in sig:
        for q, c, _ in stru:
            if abs(q - p) <= 6:
                m, n = want.get((k, q - p), (0, 0))
                want[k, q - p] = (m + (b is not None and plain(b) == plain(c)), n + 1)
    assert {(r["k"], r["shift"]): (r["matches"], r["checked"]) for r in got} == want


def test_norm_scale_equivariance(spark):
    rng = np.random.default_rng(1)
    rows = [("c", "+", i, float(v)) for i, v in enumerate(rng.gamma(1, 1, 120))] + [("c", "+", 200, float("nan"))]
    df = spark.createDataFrame(rows, "chr string, strand string, pos int, v double")
    for m in ("percentile28", "winsor90", "boxplot"):
        a = [r["v"] for r in norm.normalize(df, m, ("v",)).orderBy("pos").collect()]
        b = [r["v"] for r in norm.normalize(df.withColumn("v", F.col("v") * 7), m, ("v",)).orderBy("pos").collect()]
        assert math.isnan(a[-1]) and np.allclose(a[:-1], b[:-1])


def test_kfactor_and_bias(spark):
    rng = np.random.default_rng(2)
    u = rng.random(400) * 0.05
    m = 0.6 * u + (rng.random(400) < 0.15) * 0.3
    pairs = spark.createDataFrame([("c", "+", i, "A", float(a), float(a), float(b), float(b)) for i, (a, b) in enumerate(zip(m, u, strict=True))], "chr string, strand string, pos int, base string, m_stop double, m_mut double, u_stop double, u_mut double")
    assert 0 <= reactivity.k_distribution(pairs).first()["k"] <= 2
    lab = pairs.withColumn("is_single", F.col("m_mut") > 0.2)
    assert 0.1 <= reactivity.k_structure(lab) <= 3.0
    depth = rng.integers(20, 3000, 500)
    rate = 0.05 * np.exp(-depth / 1200) + 0.005
    p = spark.createDataFrame([("c", "+", i, "A", int(d * r) + 1, 0, int(d)) for i, (d, r) in enumerate(zip(depth, rate, strict=True))], "chr string, strand string, pos int, base string, mut_count long, stop_count long, depth long")
    out = bias.correct(p)
    assert out.where("effective_depth < 1").count() == 0 and out.count() == 500
    with pytest.raises(ValueError):
        bias.correct(p.limit(3))


def test_tests_edge_cases(spark):
    schema = "s int, grp int, pair int, value double"
    df = spark.createDataFrame([(1, 1, 0, 5.0), (1, 2, 0, 1.0), (2, 1, 0, 1.0), (2, 1, 1, 1.0), (2, 2, 0, 1.0), (2, 2, 1, 1.0)], schema)
    for t in stats.TESTS:
        out = {r["s"]: r for r in stats.run_test(df, ["s"], t).collect()}
        assert set(out) == {1, 2} and not out[2]["significant"]
    assert stats.run_test(df.limit(0), ["s"], "t-test").count() == 0
    with pytest.raises(ValueError):
        stats.run_test(df, ["s"], "nope")


def test_regions(spark):
    rows = [("c", "+", i, 0.9 if 20 <= i < 32 else 0.2, 0.1 if 20 <= i < 32 else 0.2) for i in range(60)]
    pairs = spark.createDataFrame(rows, "chr string, strand string, pos int, value1 double, value2 double")
    found = regions.deltashape_regions(pairs).collect()
    assert len(found) == 1 and found[0]["end"] == 31 and found[0]["start"] <= 20
    t = regions.q_threshold(regions.window_tests(pairs), iterations=20)
    assert t.collect() == t.collect()


def test_compare_modes(spark):
    p = "chr string, strand string, pos int, base string, mut_count long, stop_count long, depth long"
    a = spark.createDataFrame([("c", "+", 1, "A", 50, 90, 100), ("c", "+", 2, "A", 1, 1, 100)], p)
    b = spark.createDataFrame([("c", "+", 1, "A", 10, 20, 100), ("c", "+", 2, "A", 1, 1, 100)], p)
    assert compare.mod_vs_unmod(a, b).count() == 0
    assert [r["pos"] for r in compare.mod_vs_unmod(a, b, test="diffscan").collect()] == [1]
    r = compare.replicates([a, a, a], [b, b, b], min_fold=0.0)
    assert {x["pos"] for x in r.collect()} == {1, 2}


def test_dbscan_equals_naive():
    rng = np.random.default_rng(3)
    pts = rng.integers(0, 4, (60, 2)).astype(float)
    uniq, n = np.unique(pts, axis=0, return_counts=True)
    got = duet.dbscan_weighted(uniq, n, 1.1, 5)
    near = ((pts[:, None] - pts[None]) ** 2).sum(2) <= 1.1**2
    core = near.sum(1) >= 5
    lab = {tuple(u): k for u, k in zip(uniq, got, strict=True)}
    for i in np.flatnonzero(core):
        for j in np.flatnonzero(core & near[i]):
            assert lab[tuple(pts[i])] == lab[tuple(pts[j])] > 0
    for i in np.flatnonzero(~core):
        assert (lab[tuple(pts[i])] > 0) == bool((core & near[i]).any())


def test_components(spark):
    n = spark.createDataFrame([(i,) for i in range(1, 41)], "node long")
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 35)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected(n, e).collect()}
    assert all(got[i] == 1 for i in range(1, 21)) and got[35] == 30 and got[40] == 40


def test_ensembles(spark):
    rows = [("c", "+", p, node, 10 + p % 3, 1, 1) for node, lo in ((1, 0), (2, 2), (3, 50)) for p in range(lo, lo + 12)]
    pos = spark.createDataFrame(rows, "chr string, strand string, pos int, node long, reads long, stops long, mutations long")
    m = {r["node"]: r["ensemble"] for r in duet.ensembles(pos).collect()}
    assert m[1] == m[2] != m[3]


def test_extract_and_transcripts(spark):
    gtf = spark.createDataFrame([("c", "gene", 5, 10, "+", "g1", "n"), ("c", "exon", 1, 99, "+", "g1", None), ("c", "exon", 20, 30, "-", "g2", None)], "seqname string, feature string, start long, end long, strand string, gene_id string, gene_name string")
    genes = {r["gene_id"]: (r["start"], r["end"]) for r in extract.genes_from_gtf(gtf).collect()}
    assert genes == {"g1": (5, 10), "g2": (20, 30)}
    ex = spark.createDataFrame([("c", "x", 5, 8, "-", "t", "g"), ("c", "x", 1, 2, "-", "t", "g"), ("c", "x", 9, 99, "-", "u", "g")], "seqname string, source string, start long, end long, strand string, transcript_id string, gene_id string")
    fa = spark.createDataFrame([("c", "ACGTTTGG")], "contig string, seq string")
    assert [(r["transcript_id"], r["seq"]) for r in extract.splice_transcripts(ex, fa).collect()] == [("t", "CCAAGT")]


def test_dynamic_windows_with_gaps(spark):
    rng = random.Random(5)
    rows = [(c, "+", p, None if rng.random() < 0.05 else float("nan") if rng.random() < (0.95 if 100 < p < 330 else 0.2) else rng.random()) for c, n in (("a", 700), ("b", 30), ("c", 1)) for p in range(n)]
    got = {(r["chr"], r["pos"]): r["v"] for r in norm.dynamic_windows(spark.createDataFrame(rows, "chr string, strand string, pos int, v double"), "v").collect()}
    for c in "abc":
        x = [r[3] for r in rows if r[0] == c]
        i = 0
        while i < len(x):
            j = min(i + 50, len(x))
            while j < len(x) and sum(v is not None and v == v for v in x[i:j]) < 10:
                j = min(j + 50, len(x))
            part = sorted(v for v in x[i:j] if v is not None and v == v)
            for p in range(i, j):
                v = x[p]
                if v is None or v != v:
                    assert (got[c, p] is None) == (v is None)
                elif len(part) < 2:
                    assert got[c, p] == v
                else:
                    lo, hi = part[int(len(part) * 0.05)], part[min(-(-len(part) * 95 // 100), len(part) - 1)]
                    assert abs(got[c, p] - min(max(v, lo), hi) / max(hi, 1e-6)) < 1e-12
            i = j
