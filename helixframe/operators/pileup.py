"""Pileups from aligned reads.

A read is exploded into aligned bases by native array functions over its CIGAR,
then one grouped aggregation counts everything; partial sums combine before
the shuffle, so coverage depth does not skew tasks. Reads may come from SAM
text, BAM files or any table of the read schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import base_code

#: Flags of reads that a pileup leaves out: unmapped, secondary, failed, duplicate.
SKIP_FLAGS = 0x4 | 0x100 | 0x200 | 0x400


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len int, op string>> of a CIGAR string; empty for '*' and null."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct(F.substring(p, 1, F.length(p) - 1).cast("int").alias("len"), F.substring(p, -1, 1).alias("op")))


def _blocks() -> Column:
    """From column ``ops``: array of struct(ref, read, len, op, next) with 0-based offsets from the read's start."""
    state = "struct(cast(0 as int) as ref, cast(0 as int) as rd, cast(array() as array<struct<ref:int,rd:int,len:int,op:string,nxt:string>>) as out)"
    step = """(s, x) -> struct(
        cast(s.ref + if(x.o.op in ('M','=','X','D','N'), x.o.len, 0) as int) as ref,
        cast(s.rd + if(x.o.op in ('M','=','X','I','S'), x.o.len, 0) as int) as rd,
        if(x.o.op in ('M','=','X'), concat(s.out, array(struct(s.ref as ref, s.rd as rd, x.o.len as len, x.o.op as op, x.nxt as nxt))), s.out) as out)"""
    pairs = "transform(ops, (o, i) -> struct(o as o, try_element_at(ops, i + 2).op as nxt))"
    return F.expr(f"aggregate({pairs}, {state}, {step}, s -> s.out)")


def reference_span(ops: Column) -> Column:
    """Reference bases that an alignment covers."""
    return F.aggregate(ops, F.lit(0), lambda acc, o: acc + F.when(o["op"].isin("M", "=", "X", "D", "N"), o["len"]).otherwise(0))


def usable_reads(reads: DataFrame) -> DataFrame:
    """Reads that count: mapped, primary, not failed, no duplicates; with strand and parsed CIGAR."""
    ok = (F.col("flag").bitwiseAND(F.lit(SKIP_FLAGS)) == 0) & F.col("rname").isNotNull() & (F.col("rname") != "*")
    return reads.where(ok).withColumn("strand", F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+")).withColumn("ops", cigar_ops(F.col("cigar")))


def aligned_bases(reads: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per aligned base: chr, strand, pos (1-based), read_base, base_qual, next_op ('I', 'D' or null), and ``keep``.

    Phred+33 qualities; '*' gives null. Deleted and skipped columns give no row.
    """
    r = usable_reads(reads).withColumn("block", F.explode(_blocks()))
    r = r.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block.len") - 1)))
    at = F.col("block.rd") + F.col("i") + 1
    qual = F.when(F.col("qual").isNotNull() & (F.col("qual") != "*"), F.ascii(F.substring(F.col("qual"), at, F.lit(1))) - 33)
    after = F.when(F.col("i") == F.col("block.len") - 1, F.col("block.nxt"))
    return r.select(
        F.col("rname").alias("chr"), "strand", (F.col("pos") + F.col("block.ref") + F.col("i")).cast("int").alias("pos"), F.upper(F.substring(F.col("seq"), at, F.lit(1))).alias("read_base"),
        qual.alias("base_qual"), F.when(after.isin("I", "D"), after).alias("next_op"), *keep,
    )


def reference_bases(fasta: DataFrame) -> DataFrame:
    """contig, seq and maybe start (0-based place of seq) -> chr, pos, base (1-based, upper case)."""
    start = F.col("start") if "start" in fasta.columns else F.lit(0)
    return fasta.select(F.col("contig").alias("chr"), start.alias("_s"), F.posexplode(F.split(F.upper("seq"), "")).alias("p", "base")).where("base <> ''").select("chr", (F.col("_s") + F.col("p") + 1).cast("int").alias("pos"), "base")


def reference_parts(fasta: DataFrame, width: int = 4096) -> DataFrame:
    """contig, seq and maybe start -> chr, bin, start, part: pieces that don't cross multiples of ``width``."""
    f = fasta.select(F.col("contig").alias("chr"), (F.col("start") if "start" in fasta.columns else F.lit(0)).cast("long").alias("_s"), F.upper("seq").alias("_seq")).where("length(_seq) > 0")
    f = f.withColumn("bin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor((F.col("_s") + F.length("_seq") - 1) / width))))
    start = F.greatest(F.col("bin") * width, F.col("_s"))
    return f.select("chr", "bin", start.alias("start"), F.substring("_seq", (start - F.col("_s") + 1).cast("int"), ((F.col("bin") + 1) * width - start).cast("int")).alias("part"))


def with_reference(rows: DataFrame, fasta: DataFrame, width: int = 4096) -> DataFrame:
    """``rows`` (chr, pos) with base (N where the reference has none) and length of the contig (null if it is unknown).

    The reference stays in pieces; a row picks its base out of the piece of its
    bin, so the reference is never a row a base.
    """
    parts = reference_parts(fasta, width)
    lengths = parts.groupBy(F.col("chr").alias("_c")).agg(F.max(F.col("start") + F.length("part")).alias("length"))
    at = (F.col("chr") == F.col("_chr")) & (F.floor((F.col("pos") - 1) / width) == F.col("_bin")) & (F.col("pos") > F.col("_start")) & (F.col("pos") <= F.col("_start") + F.length("_part"))
    j = rows.join(parts.select(*[F.col(c).alias(f"_{c}") for c in parts.columns]), at, "left")
    j = j.select(*rows.columns, F.coalesce(F.substring(F.col("_part"), (F.col("pos") - F.col("_start")).cast("int"), F.lit(1)), F.lit("N")).alias("base"))
    return j.join(lengths, F.col("chr") == F.col("_c"), "left").drop("_c")


def stop_sites(reads: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Reverse-transcription stops: one before the leftmost base on +, one after it on -."""
    r = usable_reads(reads)
    p = F.when(F.col("strand") == "+", F.greatest(F.col("pos") - 1, F.lit(1))).otherwise(F.col("pos") + 1)
    return r.select(F.col("rname").alias("chr"), "strand", p.cast("int").alias("pos"), *keep)


def pileup(reads: DataFrame, fasta: DataFrame, min_base_qual: int = 0, strand: str = "both", by: list[str] = [], compat: bool = False) -> DataFrame:  # noqa: B006
    """Pileup rows (see schemas.PILEUP) of all positions with depth above 0, grouped further by ``by`` (a cell, say).

    A mutation is a base that differs from the reference and, with
    ``min_base_qual``, reaches that quality; effective_depth counts the bases
    that do (null without the filter). ins and del count reads whose next
    operation is one. ``compat`` adds one to the depth for each base before a
    deletion. Contigs that the FASTA lacks have base N and count no mutations.
    """
    cols = ["chr", "strand", "pos", *by]
    bases = aligned_bases(reads, by)
    stops = stop_sites(reads, by)
    if strand in ("+", "-"):
        bases, stops = bases.where(F.col("strand") == strand), stops.where(F.col("strand") == strand)
    lit0 = F.lit(0).cast("long")
    good = F.lit(True) if min_base_qual <= 0 else (F.coalesce(F.col("base_qual"), F.lit(0)) >= min_base_qual)
    rows = bases.select(*cols, "read_base", good.alias("good"), "next_op", F.lit(1).alias("d"), F.lit(0).alias("s")).unionByName(
        stops.select(*cols, F.lit(None).cast("string").alias("read_base"), F.lit(False).alias("good"), F.lit(None).cast("string").alias("next_op"), F.lit(0).alias("d"), F.lit(1).alias("s"))
    )
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    letters = {"a": ["A"], "c": ["C"], "g": ["G"], "t": ["T", "U"]}
    agg = rows.groupBy(*cols).agg(
        F.sum("s").cast("long").alias("stop_count"),
        F.sum("d").cast("long").alias("depth"),
        count(F.col("good")).alias("good_depth"),
        count(F.col("next_op") == "I").alias("ins"),
        count(F.col("next_op") == "D").alias("del"),
        *[count(F.col("read_base").isin(v)).alias(f"base_{k}") for k, v in letters.items()],
        *[count(F.col("read_base").isin(v) & F.col("good")).alias(f"good_{k}") for k, v in letters.items()],
    )
    agg = agg.where("depth > 0")
    out = with_reference(agg, fasta)
    same = F.coalesce(*[F.when(base_code(F.col("base")) == base_code(F.lit(v[0])), F.col(f"good_{k}")) for k, v in letters.items()], lit0)
    known = base_code(F.col("base")) != 15
    depth = F.col("depth") + F.col("del") if compat else F.col("depth")
    effective = F.col("good_depth") if min_base_qual > 0 else F.lit(None).cast("long")
    inside = F.col("length").isNull() | (F.col("pos") <= F.col("length"))
    return out.where(inside).select(
        *cols[:2], "pos", *by, "base", F.when(known, F.col("good_depth") - same).otherwise(lit0).alias("mut_count"), "stop_count", depth.alias("depth"),
        effective.alias("effective_depth"), "ins", "del", "base_a", "base_c", "base_g", "base_t",
    )


def merge_pileups(parts: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Sum of the counters of equal positions: partial pileups of shards, files or micro-batches."""
    keys = ["chr", "strand", "pos", *by]
    sums = ["mut_count", "stop_count", "depth", "effective_depth", "ins", "del", "base_a", "base_c", "base_g", "base_t"]
    return parts.groupBy(*keys).agg(F.max("base").alias("base"), *[F.sum(c).cast("long").alias(c) for c in sums if c in parts.columns])


def coverage_intervals(reads: DataFrame, gap: int = 5000) -> DataFrame:
    """Covered intervals of each contig: chr, start, end (0-based, half open), merged across gaps up to ``gap``."""
    from .ranges import merge_intervals

    r = usable_reads(reads).select(F.col("rname").alias("chr"), (F.col("pos") - 1).cast("long").alias("start"), (F.col("pos") - 1 + reference_span(F.col("ops"))).cast("long").alias("end"))
    return merge_intervals(r.where("end > start"), ["chr"], gap=gap)
