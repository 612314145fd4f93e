"""Gene regions of pileups, gene statistics, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .ranges import points_in_ranges


def genes_from_gtf(gtf: DataFrame, target: str | None = None) -> DataFrame:
    """seqname, start, end, strand, gene_id, gene_name per gene: the gene's own row where there is one, else the span of its exons and transcripts.

    ``target``: substring of the id or name.
    """
    g = gtf.where(F.col("feature").isin("gene", "transcript", "exon") & (F.coalesce("gene_id", F.lit("")) != ""))
    if target:
        g = g.where(F.col("gene_id").contains(target) | F.coalesce(F.col("gene_name").contains(target), F.lit(False)))
    own = F.col("feature") == "gene"
    pick = lambda f, c: F.coalesce(f(F.when(own, F.col(c))), f(c))
    return g.groupBy("seqname", "strand", "gene_id").agg(pick(F.min, "start").alias("start"), pick(F.max, "end").alias("end"), F.max("gene_name").alias("gene_name")).select("seqname", "start", "end", "strand", "gene_id", "gene_name")


def extract_genes(pileup: DataFrame, genes: DataFrame, stranded: bool = True, relative: bool = False) -> DataFrame:
    """Pileup rows inside each gene (closed range), with gene_id and gene_name; a row may belong to several genes.

    All genes in one pass by a binned range join. ``stranded`` wants equal
    strands; ``relative`` counts positions from the gene's start.
    """
    keys = [("chr", "seqname")] + ([("strand", "g_strand")] if stranded else [])
    g = genes.select("seqname", F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.col("strand").alias("g_strand"), "gene_id", "gene_name")
    out = points_in_ranges(pileup, g, keys, "pos", "g_start", "g_end")
    if relative:
        out = out.withColumn("pos", C.relative_position(F.col("pos"), F.col("g_start")))
    return out.drop("seqname", "g_start", "g_end", "g_strand")


def gene_depths(extracted: DataFrame) -> DataFrame:
    """gene_id, positions, avg_depth, file_name of the gene's table."""
    g = extracted.groupBy("gene_id").agg(F.max("gene_name").alias("gene_name"), F.count("*").alias("positions"), F.avg("depth").alias("avg_depth"))
    return g.withColumn("file_name", F.concat(C.safe_name(F.coalesce("gene_name", "gene_id")), F.lit("_depth"), F.format_string("%.1f", "avg_depth"), F.lit(".csv")))


def gene_stats(pileup: DataFrame, keys: list[str] = ["chr", "strand"], min_coverage: float = 0.2, min_depth: float = 50.0) -> DataFrame:  # noqa: B006
    """coverage (share of positions with depth), avg_depth, their product, and whether the gene is well covered."""
    g = pileup.groupBy(*keys).agg(F.avg(F.when(F.col("depth") > 0, 1.0).otherwise(0.0)).alias("coverage"), F.avg("depth").alias("avg_depth"), F.count("*").alias("positions"))
    return g.withColumn("coverage_depth", F.col("coverage") * F.col("avg_depth")).withColumn("high", (F.col("coverage") >= min_coverage) & (F.col("avg_depth") >= min_depth))


def annotated_only(pileup: DataFrame, strands: DataFrame) -> DataFrame:
    """Rows whose contig (a suffix from '_Eup' on taken off) is annotated on their strand; contigs without annotation go."""
    p = pileup.withColumn("_id", F.regexp_replace("chr", "_Eup.*$", ""))
    s = strands.select(F.col("id").alias("_id"), "strand")
    return p.join(s, ["_id", "strand"], "left_semi").select(*pileup.columns)


def shared_genes(mod: DataFrame, unmod: DataFrame, keys: list[str] = ["chr", "strand"], **limits: float) -> DataFrame:  # noqa: B006
    """``gene_stats`` of the modified pileup for the genes that the control has, too."""
    return gene_stats(mod, keys, **limits).join(unmod.select(*keys).distinct(), keys, "left_semi")


def splice_transcripts(exons: DataFrame, fasta: DataFrame, mapping: DataFrame | None = None, gene_list: DataFrame | None = None, min_length: int = 0) -> DataFrame:
    """transcript_id, gene_id, strand, n_exons, length, seq: exons in order of start, joined, reverse complemented on -.

    ``mapping`` (gene, transcript) and ``gene_list`` (gene) restrict the
    transcripts by semi joins. Exons off their contig give nothing. Sequences
    join by contig; exons of one transcript are gathered, which bounds a group
    by a transcript.
    """
    e = exons
    if mapping is not None:
        m = mapping.select(F.col("transcript").alias("transcript_id"), F.col("gene").alias("_gene"))
        if gene_list is not None:
            m = m.join(gene_list.select(F.col("gene").alias("_gene")), "_gene", "left_semi")
        e = e.join(m.select("transcript_id").distinct(), "transcript_id", "left_semi")
    elif gene_list is not None:
        e = e.join(gene_list.select(F.col("gene").alias("gene_id")), "gene_id", "left_semi")
    parts = e.join(fasta.select(F.col("contig").alias("seqname"), F.col("seq").alias("_contig")), "seqname").withColumn("_part", C.subsequence(F.col("_contig"), F.col("start"), F.col("end"))).drop("_contig")
    g = parts.groupBy("transcript_id").agg(F.max("gene_id").alias("gene_id"), F.max("strand").alias("strand"), F.array_sort(F.collect_list(F.struct("start", "end", "_part"))).alias("x"))
    seq = F.array_join(F.transform("x", lambda s: s["_part"]), "")
    g = g.withColumn("n_exons", F.size("x")).withColumn("seq", F.when(F.col("strand") == "-", C.reverse_complement(seq)).otherwise(F.upper(seq))).drop("x")
    return g.withColumn("length", F.length("seq")).where(F.col("length") >= max(1, min_length)).select("transcript_id", "gene_id", "strand", "n_exons", "length", "seq")
