"""Schemas of the tables that the operators exchange. Positions are 1-based; NaN is data, null is absence."""

from __future__ import annotations

PILEUP = (
    "chr string, strand string, pos int, base string, mut_count long, stop_count long, depth long, effective_depth long, "
    "ins long, del long, base_a long, base_c long, base_g long, base_t long"
)
REACTIVITY = "chr string, strand string, pos int, base string, reactivity_stop double, reactivity_mutation double"
READS = "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string"
GENES = "seqname string, start long, end long, strand string, gene_id string, gene_name string"
STRUCTURE = "pos int, base string, is_single boolean"
EXONS = "seqname string, source string, start long, end long, strand string, transcript_id string, gene_id string"

#: Headers of the pileup file in its two layouts, and of the reactivity file.
PILEUP_HEADER = [
    "ChrID", "pipe_truncation_Strand", "pipe_truncation_ChrPos", "rf_mutation_Base", "rf_mutation_Count", "pipe_truncation_count", "depth",
    "rf_mutation_ins", "rf_mutation_del", "base_A", "base_C", "base_G", "base_T",
]
PILEUP_HEADER_EFFECTIVE = [*PILEUP_HEADER[:7], "effective_depth", *PILEUP_HEADER[7:]]
REACTIVITY_HEADER = ["ChrID", "Strand", "Position", "Base", "reactivity_stop", "reactivity_mutation"]

#: File header name -> our column.
PILEUP_NAMES = dict(
    zip(
        PILEUP_HEADER_EFFECTIVE,
        ["chr", "strand", "pos", "base", "mut_count", "stop_count", "depth", "effective_depth", "ins", "del", "base_a", "base_c", "base_g", "base_t"],
        strict=True,
    )
)
