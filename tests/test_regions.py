"""Files read in parts: regions of alignments, references and lines in splits; commands over many files."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import compare, duet, evaluate, extract, pileup
from helixframe.plans import cli
from helixframe.sources import alignments, tables
from helixframe.viz import svg


@pytest.fixture(scope="module")
def bam(tmp_path_factory):
    """A sorted file of two contigs in small blocks, with its index."""
    rng = random.Random(1)
    rows = []
    for contig, n in (("a", 4000), ("b", 2000)):
        for i, pos in enumerate(sorted(rng.randrange(1, 900_000) for _ in range(n))):
            cigar = rng.choice(["20M", "5M30N15M", "10M2D10M", "3S17M"])
            rows.append((f"{contig}{i}", 0, contig, pos, 60, cigar, "ACGTACGTACGTACGTACGT", "I" * 20))
    path = str(tmp_path_factory.mktemp("bam") / "x.bam")
    alignments.write_bgzf(alignments.encode_bam("@HD\n", [("a", 1_000_000), ("b", 1_000_000)], rows), path, block=2000)
    alignments.index_bam(path)
    return path, rows


def _overlaps(row, contig, first, last):
    return row[2] == contig and row[3] <= last and row[3] + alignments._span(row[5]) > first


@pytest.mark.parametrize("region", ["a:1-5000", "a:300000-300400", "b:899000", "b", "a:450000-750000", "c:1-5"])
def test_region_reads(spark, bam, region):
    path, rows = bam
    want = sorted(r for r in rows if _overlaps(r, *alignments.parse_region(region)))
    got = alignments.read_bam(spark, path, region=region)
    assert sorted(tuple(r)[:8] for r in got.collect()) == want
    if "-" in region and want:  # only the stretches that can hold the region are opened
        parts = alignments.BamReader(path, 1 << 25, alignments.parse_region(region)).partitions()
        span = sum((p.end >> 16) - (p.begin >> 16) for p in parts)
        assert all(isinstance(p, alignments._Chunk) for p in parts) and span < os.path.getsize(path) * (0.6 if "450000" in region else 0.25)


def test_region_without_index_and_in_pieces(spark, bam, tmp_path):
    path, rows = bam
    os.link(path, tmp_path / "y.bam")
    assert not alignments.has_index(str(tmp_path / "y.bam")) and alignments.has_index(path)
    want = sorted(r for r in rows if _overlaps(r, "a", 1000, 600_000))
    for source, split in ((str(tmp_path / "y.bam"), 1 << 25), (path, 4000), (f"{tmp_path}/*.bam", 5000)):
        assert sorted(tuple(r)[:8] for r in alignments.read_bam(spark, source, split, "a:1000-600000").collect()) == want
    with pytest.raises(ValueError):
        alignments.parse_region("a:9-3")
    with pytest.raises(FileNotFoundError):
        alignments.bam_files(str(tmp_path / "*.cram"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        alignments.bam_files(str(tmp_path / "empty"))


def test_batch_goes_on_after_a_bad_file(spark, bam, tmp_path):
    path, rows = bam
    (tmp_path / "in").mkdir()
    os.link(path, tmp_path / "in" / "good.bam")
    (tmp_path / "in" / "bad.bam").write_bytes(b"nothing of the kind")
    (tmp_path / "x.fa").write_text(">a\n" + "ACGT" * 250 + "\n>b\nACGT\n")
    with pytest.raises(SystemExit, match=r"bad\.bam"):
        cli.main(["count", "-b", f"{tmp_path}/in", "-f", f"{tmp_path}/x.fa", "-o", f"{tmp_path}/out", "--batch"])
    assert tables.read_pileup(spark, f"{tmp_path}/out/good").agg(F.max("pos")).first()[0] <= 1000
    with pytest.raises(SystemExit, match="no index"):
        cli.main(["count", "-b", f"{tmp_path}/in/good.bam", "-f", f"{tmp_path}/x.fa", "-o", f"{tmp_path}/o2", "--region", "a:1-100"])
    cli.main(["count", "-b", path, "-f", f"{tmp_path}/x.fa", "-o", f"{tmp_path}/o3", "--region", "a:1-100"])
    with pytest.raises(SystemExit, match="not found"):
        cli.main(["count", "-b", path, "-f", f"{tmp_path}/none.fa", "-o", f"{tmp_path}/o4"])
    with pytest.raises(SystemExit, match="out of range"):
        cli.main(["count", "-b", path, "-f", f"{tmp_path}/x.fa", "-o", f"{tmp_path}/o4", "--min-base-qual", "-1"])


def test_reference_in_splits(spark, tmp_path):
    rng = random.Random(2)
    contigs = {f"chr{i}": "".join(rng.choice("ACGTacgtN") for _ in range(n)) for i, n in enumerate((200_000, 0, 61, 3_000_000, 17))}
    (tmp_path / "x.fa").write_text("".join(f">{c} 5'->3' of {c}\n" + "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60)) for c, s in contigs.items()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got: dict[str, list] = {}
        for r in tables.read_reference(spark, str(tmp_path / "x.fa"), piece=5000).collect():
            got.setdefault(r["contig"], []).append((r["start"], r["seq"]))
        fasta = tables.read_reference(spark, str(tmp_path / "x.fa"), piece=5000)
        rows = [("chr0", 1), ("chr0", 200_000), ("chr3", 2_999_999), ("chr3", 4097), ("chr2", 61), ("chr2", 62), ("none", 5)]
        bases = {(r["chr"], r["pos"]): (r["base"], r["length"]) for r in pileup.with_reference(spark.createDataFrame(rows, "chr string, pos int"), fasta).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for c, s in contigs.items():
        text = ""
        for start, seq in sorted(got.get(c, [])):
            assert start == len(text)
            text += seq
        assert text == s.upper()
    assert set(got) == {c for c, s in contigs.items() if s}
    assert bases[("chr2", 62)] == ("N", 61) and bases[("none", 5)] == ("N", None)
    assert all(bases[c, p][0] == contigs[c][p - 1].upper() for c, p in rows[:5])
    assert {r["contig"]: r["seq"] for r in tables.read_fasta(spark, str(tmp_path / "x.fa")).where("contig <> 'chr1'").collect()} == {c: s.upper() for c, s in contigs.items() if s}


def test_lines_numbered_in_splits(spark, tmp_path):
    for name, n in (("a", 30_000), ("b", 3)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\r\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        rows = tables.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 30_003 and all(r["value"] == f"{r['file'][-1]} line {r['n']}" for r in rows)


def test_signals_of_several_layouts(spark, tmp_path):
    files = {
        "six": "ChrID,Strand,Position,Base,reactivity_stop,reactivity_mutation\nc,+,1,a,0.5,0.25\nc,-,2,U,0.7,NaN\n",
        "one": "ChrID,Strand,Position,Base,score2\nc,+,1,A,0.5\n",
        "bare": "c,+,1,A,0.5\nc,-,2,C,0.75\n",
        "four": "c,+,1,0.5\n",
    }
    for k, v in files.items():
        (tmp_path / k).write_text(v)
    read = lambda k, *a: [(r["signal"], r["pos"], r["base"], r["value"]) for r in tables.read_signal(spark, str(tmp_path / k), *a).collect()]
    assert read("six", "stop") == [("stop", 1, "A", 0.5)] and len(read("six", "all", "both")) == 4
    assert read("one", "stop") == [("score2", 1, "A", 0.5)] and read("bare", "stop", "-") == [("score", 2, "C", 0.75)]
    assert read("four", "all") == [("score", 1, "0", 0.5)]


def test_shift_of_each_base(spark):
    rng = random.Random(4)
    template = [(i, rng.choice("ACGU")) for i in range(1, 120)]
    signal = [(p + 5000, b) for p, b in template] + [(rng.randrange(7000, 9000), "A") for _ in range(20)]
    got = {r["base"]: r["shift"] for r in evaluate.base_shifts(spark.createDataFrame([*template, (100_500, "A")], "pos int, base string"), spark.createDataFrame(signal, "pos int, base string")).collect()}
    assert got == {"A": 5000, "C": 5000, "G": 5000, "T": 5000}
    drawing = "<svg>" + "".join(f'<title>{p} (position.label in template: {p}.{b})</title><text x="{p}" y="1">{b}</text>' for p, b in template[:3]) + "</svg>"
    r = spark.createDataFrame([(template[i][0] + 5000, template[i][1], 0.9) for i in range(3)], "pos int, base string, reactivity_stop double")
    assert svg.color_template(drawing, r, shift=got).count("<circle") == 3 and svg.color_template(drawing, r).count("<circle") == 0


def test_annotated_and_shared_genes(spark):
    p = spark.createDataFrame([(c, s, i, 100) for c, s in (("g1_Eup50_Edown50", "+"), ("g1", "-"), ("g2", "-"), ("g3", "+")) for i in range(5)], "chr string, strand string, pos int, depth long")
    strands = spark.createDataFrame([("g1", "+"), ("g2", "-")], "id string, strand string")
    kept = extract.annotated_only(p, strands)
    assert {(r["chr"], r["strand"]) for r in kept.collect()} == {("g1_Eup50_Edown50", "+"), ("g2", "-")}
    assert {r["chr"] for r in extract.shared_genes(p, kept).collect()} == {"g1_Eup50_Edown50", "g2"}


def test_exons_beside_transcripts(spark, tmp_path):
    (tmp_path / "x.gtf").write_text("".join(f'c\tsrc\texon\t{a}\t{b}\t.\t+\t.\tgene_id "g"; transcript_id "{t}";\n' for a, b, t in ((1, 4, "t1"), (7, 8, "t1"), (3, 3, "t2"))))
    (tmp_path / "x.fa").write_text(">c x>y\nACGTACGTAC\n")
    cli.main(["transcripts", "--gtf", f"{tmp_path}/x.gtf", "--fasta", f"{tmp_path}/x.fa", "-o", f"{tmp_path}/o", "--min-length", "2"])
    assert {(r["contig"], r["seq"]) for r in tables.read_fasta(spark, f"{tmp_path}/o.fa").collect()} == {("t1", "ACGTGT")}
    assert [tuple(r) for r in tables.read_exons(spark, f"{tmp_path}/o.gtf").orderBy("start").select("start", "end", "transcript_id", "gene_id").collect()] == [(1, 4, "t1", "g"), (7, 8, "t1", "g")]


def test_tables_of_fixed_layout(spark):
    p = lambda k: spark.createDataFrame([("c", "+", i, "A", 10 * k + i, 20 * k, 100, None, 0, 0, 0, 0, 0, 0) for i in range(3)], "chr string, strand string, pos int, base string, mut_count long, stop_count long, depth long, effective_depth long, ins long, del long, base_a long, base_c long, base_g long, base_t long")
    assert len(compare.samples_table(p(3), p(1), test=None).columns) == 13 and len(compare.samples_table(p(3), p(1), test="diffscan").columns) == 17
    both = compare.replicates_table([p(3), p(4)], [p(1), p(1)], min_fold=1.0)
    assert both.columns[:4] == ["ChrID", "Strand", "Position", "RefBase"] and len(both.columns) == 17
    row = both.where("Position = 0").first()
    assert (row["Group1_Mean_RFC"], row["Group1_Mean_PIPC"], row["PIPC_FoldChange"], row["RFC_FoldChange"]) == (35.0, 70.0, 3.5, 3.5)
    r = spark.createDataFrame([("c", "+", i, 0.1 * i, 0.2) for i in range(3)], "chr string, strand string, pos int, reactivity_stop double, reactivity_mutation double")
    assert compare.groups_table([r, r], [r, r]).columns[3:7] == ["Group1_Mean_Reactivity", "Group1_Std_Reactivity", "Group2_Mean_Reactivity", "Group2_Std_Reactivity"]
    assert compare.results_table(compare.reactivity_results(r, r)).columns[3:5] == ["Reactivity1_Mean", "Reactivity1_Std"]


def test_k_of_the_structures_gene_alone(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    fold = "".join(rng.choice(".()") for _ in range(60))
    (tmp_path / "rna.dot").write_text("".join(rng.choice("ACGU") for _ in range(60)) + "\n" + fold + "\n")
    header = "ChrID,pipe_truncation_Strand,pipe_truncation_ChrPos,rf_mutation_Base,rf_mutation_Count,pipe_truncation_count,depth,rf_mutation_ins,rf_mutation_del,base_A,base_C,base_G,base_T\n"
    for name in ("m", "u"):
        (tmp_path / f"{name}.csv").write_text(header + "".join(f"{c},{s},{i + 1},A,{rng.randrange(30)},{rng.randrange(30)},100,0,0,0,0,0,0\n" for c in ("rna", "other") for s in "+-" for i in range(60)))
    seen = []
    monkeypatch.setattr(cli.reactivity, "k_structure", lambda lab, m, u: seen.append((lab.count(), {(r["chr"], r["strand"]) for r in lab.select("chr", "strand").distinct().collect()})))
    cli.main(["reactivity", "-M", f"{tmp_path}/m.csv", "-U", f"{tmp_path}/u.csv", "-O", f"{tmp_path}/o", "--k-prediction-method", "recursive", "--structure-file", f"{tmp_path}/rna.dot"])
    assert seen == [(60, {("rna", "+")})] * 2


def test_report_and_duet_layouts(spark):
    rng = random.Random(9)
    lab = spark.createDataFrame([(rng.random(), rng.random() < 0.5) for _ in range(80)], "v double, is_single boolean")
    lines = [r["value"] for r in evaluate.report(lab, "v", "stop").collect()]
    assert lines[1] == "# Signal Type: stop" and lines[4].startswith("AUC\t") and lines[13].split("\t") == ["Threshold", "TPR", "FPR", "Precision", "Recall"]
    thresholds = [float(x.split("\t")[0]) for x in lines[14:]]
    assert len(thresholds) == 80 and thresholds == sorted(thresholds, reverse=True)
    sites = spark.createDataFrame([("c", "+", p, "A", rng.random(), rng.random()) for p in range(1, 260)], "chr string, strand string, pos int, base string, stop double, mutation double")
    events = spark.createDataFrame([("c", "+", r, rng.randrange(1, 260), k) for r in range(300) for k in ("stop", "mutation")], "chr string, strand string, read_id long, pos int, kind string")
    out = duet.analyse(events, sites)
    w, s, g, b = duet.windows_table(out, sites), duet.summary_table(out, sites), duet.global_table(out), duet.bases_table(out, sites)
    assert [len(x.columns) for x in (w, s, g, b)] == [15, 17, 11, 9]
    rows = w.collect()
    assert len(rows) == duet.windows(sites).count() and all(0 <= r["NoiseFraction"] <= 1 for r in rows)
    members = {r["WindowStart"]: r["n"] for r in s.groupBy("WindowStart").agg(F.sum("Members").alias("n")).collect()}
    assert all(members[r["WindowStart"]] == r["ReadCount"] for r in rows)
    assert {r["GlobalEnsembleID"] for r in b.collect()} == {r["GlobalEnsembleID"] for r in g.collect()} == {f"E{i + 1}" for i in range(out["ensembles"].count())}


def test_genes_are_named_by_depth(spark, tmp_path):
    p = spark.createDataFrame([("c", "+", i, 10 * i) for i in range(1, 9)], "chr string, strand string, pos int, depth long")
    genes = spark.createDataFrame([("c", 1, 4, "+", "g1", "a b/c"), ("c", 5, 6, "+", "g2", None), ("d", 1, 9, "+", "g3", None)], "seqname string, start long, end long, strand string, gene_id string, gene_name string")
    tables.write_genes(extract.extract_genes(p, genes), str(tmp_path / "o"))
    assert {d for d in os.listdir(tmp_path / "o") if d.startswith("gene=")} == {"gene=a_b_c_depth25.0", "gene=g2_depth55.0"}


def test_tracks_of_ensembles(spark):
    e = spark.createDataFrame([("c", "+", 7, 1, 100), ("c", "+", 8, 3, 98), ("c", "+", 9, 50, 60)], "chr string, strand string, ensemble long, start int, end int")
    figure = svg.track_figure(e)
    assert figure.count("#d7301f") == 2 and figure.count("#1b6ca8") == 1 and "<title>9</title>" in figure
