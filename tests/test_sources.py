"""Readers, converters, alignments, streaming, figures and the command line on small files."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from helixframe.operators import evaluate, pileup
from helixframe.plans import cli
from helixframe.sources import alignments, convert, tables
from helixframe.streaming import pileup_stream
from helixframe.viz import svg

from .test_operators import READS


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_bamreadcount_golden(spark):
    r = convert.bamreadcount(lines(spark, "EC_16S\t1\tA\t77\tA:77:60\tC:0:0\tG:0:0\tT:0:0\tN:0:0\t+AC:3:0", "bad")).collect()
    assert len(r) == 1
    assert [r[0][c] for c in ("chr", "strand", "pos", "base", "mut_count", "stop_count", "depth", "ins", "del", "base_a", "base_c", "base_g", "base_t")] == ["EC_16S", "+", 1, "A", 0, 0, 77, 0, 0, 77, 0, 0, 0]


def test_rctools(spark):
    t = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(["tr1", "A\t2\t10", "bad line", "C\t1\t9", "", "tr2", "G\t0\t5"])], "file string, n int, value string")
    got = [(r["chr"], r["pos"], r["base"], r["stop_count"], r["depth"]) for r in convert.rctools(t).orderBy("chr", "pos").collect()]
    assert ("tr1", 1, "A", 2, 10) in got and ("tr2", 1, "G", 0, 5) in got
    m = convert.rctools(t, mutations=True)
    both = convert.rctools_dual(m, convert.rctools(t))
    assert both.where("mut_count = 2 and stop_count = 2 and depth = 10").count() == 1


def test_bedgraph_golden(spark):
    x = lines(spark, "track x", *[f"c\t{p - 1}\t{p}\t{d}\t+" for p, d in ((1, 10), (2, 7), (3, 9), (9, 4))], "c\t1\t2\t5\t-")
    assert [r["stop_count"] for r in convert.bedgraph(x).orderBy("pos").collect()] == [3, 0, 9, 4]
    assert convert.bedgraph(lines(spark, "c\t0\t1\t3\t20\t+")).first()["stop_count"] == 3


def test_other_formats(spark):
    r = convert.icshape_rt(lines(spark, "@x", "c\t+\t4\t2.9\t7.2", "c\t-\t4\t2\t7")).collect()
    assert [(x["stop_count"], x["depth"]) for x in r] == [(2, 9)]
    r = convert.samtools_mpileup(lines(spark, "c\t4\tC\t.\t9\t1\t5\t2\t1\t0"), "-").first()
    assert (r["strand"], r["mut_count"], r["depth"]) == ("-", 4, 9)
    x = convert.rf_norm_xml(lines(spark, '<data><transcript id="t" length="3"><sequence>AC\nG</sequence><reactivity>0.1,NaN,\n0.3</reactivity></transcript></data>')).orderBy("pos").collect()
    assert [y["base"] for y in x] == list("ACG") and math.isnan(x[1]["reactivity_mutation"]) and math.isnan(x[0]["reactivity_stop"])
    p = spark.createDataFrame([(1, "1", "a", "0.5"), (2, "2", "c", "nan"), (3, "1", "g", "0.7")], "n int, Nucleotide string, Sequence string, Norm_profile string")
    assert [y["chr"] for y in convert.shapemapper_profile(p).orderBy("chr", "pos").collect()] == ["transcript", "transcript", "transcript_2"]
    s = spark.createDataFrame([(1, "1", "0", "20"), (2, "0", "2", "30")], "n int, AG string, CT string, read_depth string")
    fa = spark.createDataFrame([("c", "AC")], "contig string, seq string")
    got = convert.shapemapper2(s, fa).orderBy("pos").collect()
    assert [(y["base"], y["mut_count"], y["base_a"], y["base_c"]) for y in got] == [("A", 1, 19, 0), ("C", 2, 0, 28)]


@pytest.mark.parametrize(
    "first,want",
    [("<data>", "rf-norm-xml"), ("@ColNum 3", "icshape-rt"), ("ChrID,Strand,Position,Base", "rf-norm"), ("Nucleotide\tSequence\tNorm_profile", "shapemapper-profile"), ("AG\tread_depth", "shapemapper2"), ("tr1", "rf-rctools"), ("c\t1\tA\t+\t5\t1\t1\t1\t2\t0", "samtools-mpileup"), ("c\t1\t2\t7\t+", "bedgraph"), ("c\t1\tA\t5\t=:0", "bamreadcount"), ("c\t1\t2\t3\t9\t+", "bedgraph")],
)
def test_detect(first, want):
    assert convert.detect([first]) == want


def test_structure():
    assert tables.parse_structure("# x\nACG\nU\n.(.\n)") == [(1, "A", True), (2, "C", False), (3, "G", True), (4, "U", False)]
    with pytest.raises(ValueError):
        tables.parse_structure("ACG\n..")


def test_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nacg\nTT\n>b\nGG\n")
    assert {r["contig"]: r["seq"] for r in tables.read_fasta(spark, str(tmp_path / "x.fa")).collect()} == {"a": "ACGTT", "b": "GG"}
    (tmp_path / "x.gtf").write_text('#c\nc\ts\tgene\t3\t9\t.\t+\t.\tgene_id "g1"; gene_name "n1";\nc\ts\texon\t3\t5\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\nc\ts\tgene\tx\t9\t.\t+\t.\tgene_id "g2";\n')
    g = tables.read_gtf(spark, str(tmp_path / "x.gtf"))
    assert g.count() == 2 and tables.read_exons(spark, str(tmp_path / "x.gtf")).first()["transcript_id"] == "t1"
    assert {r["id"]: r["strand"] for r in tables.read_strand_map(spark, str(tmp_path / "x.gtf")).collect()}["t1"] == "+"
    reads = spark.createDataFrame(READS, "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string")
    p = pileup.pileup(reads, spark.createDataFrame([("c", "ACGTACGTAC")], "contig string, seq string"), min_base_qual=20)
    tables.write_pileup(p, str(tmp_path / "p"))
    back = tables.read_pileup(spark, str(tmp_path / "p"))
    assert {tuple(r) for r in back.select(*p.columns).collect()} == {tuple(r) for r in p.collect()}
    r = spark.createDataFrame([("c", "+", 1, "A", 0.5, float("nan"))], "chr string, strand string, pos int, base string, reactivity_stop double, reactivity_mutation double")
    tables.write_reactivity(r, str(tmp_path / "r"))
    got = tables.read_reactivity(spark, str(tmp_path / "r")).first()
    assert got["reactivity_stop"] == 0.5 and math.isnan(got["reactivity_mutation"])
    assert tables.unpivot_signals(r).count() == 2


def _sam(path):
    path.write_text("@HD\tVN:1.6\n" + "".join("\t".join(map(str, [*r[:6], "*", 0, 0, *r[6:]])) + "\n" for r in READS))


def test_sam_bam_round_trip(spark, tmp_path):
    _sam(tmp_path / "x.sam")
    many = [(f"q{i}", 0, "c", 1 + i % 5, 60, "4M", "ACGT", "IIII") for i in range(9000)] + READS
    alignments.write_bgzf(alignments.encode_bam("@HD\n", [("c", 10)], many), str(tmp_path / "x.bam"))
    sam = {tuple(r) for r in alignments.read_sam(spark, str(tmp_path / "x.sam")).drop("file").collect()}
    for split in (1 << 20, 3000):
        bam = alignments.read_bam(spark, str(tmp_path / "x.bam"), split).drop("file")
        assert bam.count() == len(many)
        assert sam <= {tuple(r) for r in bam.collect()}
    assert alignments.with_cell(alignments.read_sam(spark, str(tmp_path / "x.sam"))).first()["cell"] == "x"


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _sam(tmp_path / "in" / "a.sam")
    fasta = spark.createDataFrame([("c", "ACGTACGTAC")], "contig string, seq string")
    pileup_stream.write_pileup_stream(pileup_stream.sam_stream(spark, str(tmp_path / "in")), fasta, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = pileup.pileup(alignments.read_sam(spark, str(tmp_path / "in" / "a.sam")), fasta)
    key = ("chr", "strand", "pos", "depth", "mut_count", "stop_count")
    assert {tuple(r) for r in pileup_stream.read_merged(spark, str(tmp_path / "out")).select(*key).collect()} == {tuple(r) for r in batch.select(*key).collect()}


def test_figures(spark):
    df = spark.createDataFrame([(float(i % 7), i % 3 == 0) for i in range(50)], "v double, is_single boolean")
    assert "<path" in svg.roc_figure(evaluate.curve(df, "v"), []) and "</svg>" in svg.pr_figure(evaluate.curve(df, "v"))
    tpl = '<svg><g><title>1 (position.label in template: 1.A)</title><text x="3" y="4">A</text></g></svg>'
    r = spark.createDataFrame([("c", "+", 1, "A", 0.9, 0.1)], "chr string, strand string, pos int, base string, reactivity_stop double, reactivity_mutation double")
    out = svg.color_template(tpl, r)
    assert 'cx="3"' in out and "#d7301f" in out and "<script>" in svg.interactive_html(out)
    assert "<rect" in svg.reactivity_figure(r, "stop", "x")


def test_command_line(spark, tmp_path):
    _sam(tmp_path / "x.sam")
    (tmp_path / "x.fa").write_text(">c\nACGTACGTAC\n")
    run = lambda *a: cli.main([str(x) for x in a])
    run("count", "-b", tmp_path / "x.sam", "-f", tmp_path / "x.fa", "-o", tmp_path / "p")
    run("reactivity", "-M", tmp_path / "p", "-U", tmp_path / "p", "-O", tmp_path / "r", "-s", "siegfried", "-m", "siegfried")
    run("norm", "-i", tmp_path / "r", "-o", tmp_path / "n")
    assert tables.read_reactivity(spark, str(tmp_path / "n")).where(F.col("reactivity_stop") != 0).count() == 0
    with pytest.raises(SystemExit):
        run("nothing")


def test_layouts(spark):
    import numpy as np

    from helixframe.viz import layout

    rows = [("c", "+", e, p, 5, 1, 1, 0.9 if (e < 3) == (p < 5) else 0.1, 1) for e in range(6) for p in range(10)]
    b = spark.createDataFrame(rows, "chr string, strand string, ensemble long, pos int, reads long, stops long, mutations long, confidence double, windows long")
    names, places, x = layout.matrix(b)
    assert (names, places) == (list(range(6)), list(range(10)))
    y = layout.principal_axes(x)
    assert np.ptp(y[:3, 0]) < 1e-9 and abs(y[0, 0] - y[5, 0]) > 1
    assert {tuple(sorted(layout.row_order(x)[:3])), tuple(sorted(layout.row_order(x)[3:]))} == {(0, 1, 2), (3, 4, 5)}
    assert np.allclose(layout.neighbour_map(x), layout.neighbour_map(x)) and "<circle" in layout.embedding_figure(b, method="map")
