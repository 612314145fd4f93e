"""Count tables of other tools, as pileups or reactivity. Text in, native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import NAN, non_reference_count, normalize_base
from .tables import last_in_order, numbered_lines, read_fasta, read_reactivity

#: Formats in the order in which ``detect`` tries them.
FORMATS = ("rf-norm-xml", "icshape-rt", "rf-norm", "shapemapper-profile", "shapemapper2", "rf-rctools", "samtools-mpileup", "bedgraph", "bamreadcount")

_LETTERS = ("a", "c", "g", "t")


def _n(c: Column) -> Column:
    """A count: whole number, or a float cut to one; null if neither."""
    return F.coalesce(c.try_cast("long"), c.try_cast("double").try_cast("long"))


def _pileup(df: DataFrame, **cols: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    names = ("chr", "strand", "pos", "base", "mut_count", "stop_count", "depth", "effective_depth", "ins", "del", "base_a", "base_c", "base_g", "base_t")
    default = {"effective_depth": F.lit(None).cast("long"), "stop_count": zero, "ins": zero, "del": zero, **{f"base_{x}": zero for x in _LETTERS}}
    types = {"chr": "string", "strand": "string", "pos": "int", "base": "string"}
    return df.select(*[cols.get(n, default.get(n, F.col(n) if n in df.columns else zero)).cast(types.get(n, "long")).alias(n) for n in names])


def bamreadcount(lines: DataFrame, strand: str = "+") -> DataFrame:
    """Lines of chr, pos, ref, depth, then base:count:... fields. Mutations: non-reference bases; '+' and '-' are insertions and deletions."""
    f = F.split("value", "\t")
    d = lines.where(F.size(f) >= 5).select(f.alias("f"))
    count = lambda k: F.coalesce(F.expr(f"aggregate(filter(slice(f, 5, size(f)), x -> split(x, ':')[0] = '{k}'), 0L, (s, x) -> s + coalesce(try_cast(split(x, ':')[1] as bigint), 0L))"), F.lit(0))
    d = d.select(F.col("f")[0].alias("chr"), F.col("f")[1].try_cast("int").alias("pos"), F.upper(F.col("f")[2]).alias("base"), F.col("f")[3].try_cast("long").alias("depth"), *[count(x.upper()).alias(f"base_{x}") for x in _LETTERS], count("+").alias("ins"), count("-").alias("del"))
    d = d.where("pos is not null and depth is not null")
    return _pileup(d, strand=F.lit(strand), mut_count=non_reference_count(F.col("base"), *[F.col(f"base_{x}") for x in _LETTERS]), **{c: F.col(c) for c in ("ins", "del", "base_a", "base_c", "base_g", "base_t")})


def rctools(lines: DataFrame, mutations: bool = False, strand: str = "+") -> DataFrame:
    """Numbered lines: a transcript name alone on its line, then base, count, coverage per position.

    Positions advance on every line after the name, also on bad ones, which
    give no row. ``mutations``: counts are mutations, else stops. The other
    bases of a mutated position are unknown: the count goes to none of them.
    """
    f = F.split("value", "\t")
    x = lines.where("trim(value) <> ''").withColumn("f", f).withColumn("name", F.when((F.size(f) == 1) & ~(F.upper("value").rlike(r"^[ACGTU]$")), F.trim("value")))
    x = x.withColumn("chr", last_in_order(F.col("name"), ["file"], "n"))
    x = x.where("name is null and chr is not null").withColumn("pos", F.row_number().over(W.partitionBy("file", "chr").orderBy("n")))
    x = x.where(F.size("f") >= 3).select("chr", "pos", normalize_base(F.col("f")[0]).alias("base"), _n(F.col("f")[1]).alias("c"), _n(F.col("f")[2]).alias("depth")).where("c is not null and depth is not null and base in ('A', 'C', 'G', 'T', 'N')")
    c, zero = F.col("c"), F.lit(0)
    own = {f"base_{k}": F.when(F.col("base") == k.upper(), F.greatest(F.col("depth") - (c if mutations else zero), zero)).otherwise(zero) for k in _LETTERS}
    return _pileup(x, strand=F.lit(strand), mut_count=c if mutations else zero, stop_count=zero if mutations else c, **own)


def rctools_dual(mutation: DataFrame, stop: DataFrame) -> DataFrame:
    """Both counts of two ``rctools`` tables: full outer, the base of the mutation table first, the greater coverage."""
    key = ["chr", "strand", "pos"]
    m = mutation.select(*key, F.col("base").alias("mb"), F.col("mut_count").alias("m"), F.col("depth").alias("md"))
    s = stop.select(*key, F.col("base").alias("sb"), F.col("stop_count").alias("s"), F.col("depth").alias("sd"))
    j = m.join(s, key, "full_outer").withColumn("base", F.coalesce("mb", "sb")).withColumn("depth", F.greatest(F.coalesce("md", F.lit(0)), F.coalesce("sd", F.lit(0))))
    mut = F.coalesce("m", F.lit(0))
    own = {f"base_{k}": F.when(F.col("base") == k.upper(), F.greatest(F.col("depth") - mut, F.lit(0))).otherwise(F.lit(0)) for k in _LETTERS}
    return _pileup(j, mut_count=mut, stop_count=F.coalesce("s", F.lit(0)), **own)


def rf_norm_xml(texts: DataFrame, signal: str = "mut", strand: str = "+") -> DataFrame:
    """Reactivity of XML files (column value, one file per row): transcript id, sequence and comma-separated reactivity of equal length."""
    if signal not in ("mut", "stop"):
        raise ValueError("signal is mut or stop")
    get = lambda tag: F.regexp_replace(F.regexp_extract("value", rf"<{tag}[^>]*>([^<]*)</{tag}>", 1), r"\s", "")
    x = texts.select(F.regexp_extract("value", r'<transcript[^>]*\bid="([^"]*)"', 1).alias("chr"), F.split(get("sequence"), "").alias("s"), F.split(get("reactivity"), ",").alias("r"))
    x = x.withColumn("s", F.filter("s", lambda b: b != "")).where(F.size("s") == F.size("r"))
    x = x.select("chr", F.posexplode(F.arrays_zip("s", "r")).alias("p", "z"))
    v, nan = F.coalesce(F.col("z.r").try_cast("double"), F.lit(NAN)), F.lit(NAN)
    return x.select("chr", F.lit(strand).alias("strand"), (F.col("p") + 1).alias("pos"), F.upper("z.s").alias("base"), (v if signal == "stop" else nan).alias("reactivity_stop"), (v if signal == "mut" else nan).alias("reactivity_mutation"))


#: Places of the fields of a mutation-count table that are used: substitutions by target base, multi-nucleotide ones, deletions, depths.
SHAPEMAPPER_TARGETS = {
    "a": ["TA", "GA", "CA", "multinuc_A"],
    "t": ["AT", "GT", "CT", "multinuc_T"],
    "g": ["AG", "TG", "CG", "multinuc_G"],
    "c": ["AC", "TC", "GC", "multinuc_C"],
}


def shapemapper2(table: DataFrame, fasta: DataFrame, strand: str = "+") -> DataFrame:
    """Mutation counts with named columns and line number ``n`` (from 1): the n-th line is the n-th base of the reference.

    Missing columns count 0. Depth: effective_depth if there is one, else
    read_depth; the reference base gets what substitutions and deletions leave.
    """
    have = set(table.columns)
    num = lambda c: F.coalesce(_n(F.col(c)), F.lit(0)) if c in have else F.lit(0)
    offset = W.orderBy("contig")
    ref = fasta.withColumn("_o", F.sum(F.length("seq")).over(offset) - F.length("seq")).select("contig", "_o", F.posexplode(F.split("seq", "")).alias("p", "base")).where("base <> ''").select(F.col("contig").alias("chr"), (F.col("p") + 1).alias("pos"), "base", (F.col("_o") + F.col("p") + 1).alias("n"))
    targets = {k: sum((num(c) for c in v), F.lit(0)) for k, v in SHAPEMAPPER_TARGETS.items()}
    deletions = sum((num(c) for c in have if c.endswith("-") or c.endswith("_deletion")), F.lit(0))
    insertions = sum((num(c) for c in have if c.startswith("-") or c.endswith("_insertion")), F.lit(0))
    depth = F.coalesce(F.nullif(num("effective_depth"), F.lit(0)), num("read_depth"))
    t = table.select("n", depth.alias("depth"), deletions.alias("del"), insertions.alias("ins"), *[v.alias(f"to_{k}") for k, v in targets.items()])
    j = t.join(ref, "n")
    subs = F.col("to_a") + F.col("to_c") + F.col("to_g") + F.col("to_t")
    base = normalize_base(F.col("base"))
    own = {f"base_{k}": F.when(base == k.upper(), F.greatest(F.col("depth") - subs - F.col("del"), F.lit(0))).otherwise(F.col(f"to_{k}")) for k in _LETTERS}
    return _pileup(j, strand=F.lit(strand), mut_count=subs, ins=F.col("ins"), **{"del": F.col("del")}, **own)


def shapemapper_profile(table: DataFrame, name: str = "transcript", strand: str = "+") -> DataFrame:
    """Reactivity of a profile with columns Nucleotide, Sequence, Norm_profile, maybe Sequence_name, and line number ``n``.

    A new sequence begins where the position returns to 1; unnamed ones after
    the first are numbered.
    """
    t = table.select("n", F.col("Nucleotide").try_cast("int").alias("pos"), F.upper("Sequence").alias("base"), F.col("Norm_profile").try_cast("double").alias("v"), (F.col("Sequence_name") if "Sequence_name" in table.columns else F.lit(None).cast("string")).alias("name")).where("pos is not null")
    t = t.withColumn("k", F.sum((F.col("pos") == 1).cast("int")).over(W.orderBy("n")))
    chrom = F.coalesce("name", F.when(F.col("k") <= 1, F.lit(name)).otherwise(F.concat(F.lit(f"{name}_"), F.col("k"))))
    return t.select(chrom.alias("chr"), F.lit(strand).alias("strand"), "pos", "base", F.lit(NAN).alias("reactivity_stop"), F.coalesce("v", F.lit(NAN)).alias("reactivity_mutation"))


def samtools_mpileup(lines: DataFrame, strand: str = "+") -> DataFrame:
    """Tab lines of chr, pos, ref, strand, depth, A, C, G, T, N; a strand that is none takes the argument."""
    f = F.split("value", "\t")
    x = lines.where(F.size(f) >= 9).select(f[0].alias("chr"), f[1].try_cast("int").alias("pos"), F.upper(f[2]).alias("base"), f[3].alias("s"), f[4].try_cast("long").alias("depth"), *[F.coalesce(f[5 + i].try_cast("long"), F.lit(0)).alias(f"base_{k}") for i, k in enumerate(_LETTERS)]).where("pos is not null and depth is not null")
    return _pileup(x, strand=F.when(F.col("s").isin("+", "-"), F.col("s")).otherwise(strand), mut_count=non_reference_count(F.col("base"), *[F.col(f"base_{k}") for k in _LETTERS]), **{f"base_{k}": F.col(f"base_{k}") for k in _LETTERS})


def bedgraph(lines: DataFrame, filter_strand: str = "+", bases: DataFrame | None = None) -> DataFrame:
    """Tab lines of chr, start, end, coverage, strand, or chr, start, end, stop, depth, strand (0-based start).

    Five columns: the stop count is what the depth loses to the next position,
    0 at least, and all of it where the next position is not there.
    """
    f = F.split(F.trim("value"), r"\s+")
    x = lines.where(~F.col("value").rlike("^(track|browser|#)")).select(f.alias("f")).where(F.size("f") >= 5)
    six = F.size("f") >= 6
    x = x.select(F.col("f")[0].alias("chr"), (F.col("f")[1].try_cast("int") + 1).alias("pos"), F.when(six, _n(F.col("f")[3])).alias("stop6"), _n(F.when(six, F.col("f")[4]).otherwise(F.col("f")[3])).alias("depth"), F.when(six, F.try_element_at("f", F.lit(6))).otherwise(F.col("f")[4]).alias("strand"))
    x = x.where("pos is not null and depth is not null")
    if filter_strand in ("+", "-"):
        x = x.where(F.col("strand") == filter_strand)
    out = bedgraph_stops(x).withColumn("stop_count", F.coalesce("stop6", "stop_count"))
    base = F.lit("N")
    if bases is not None:
        out = out.join(bases.select("chr", "pos", F.col("base").alias("_b")), ["chr", "pos"], "left")
        base = F.coalesce("_b", F.lit("N"))
    return _pileup(out, base=base, stop_count=F.col("stop_count"), mut_count=F.lit(0))


def bedgraph_stops(depths: DataFrame) -> DataFrame:
    """chr, strand, pos, depth with stop_count: depth minus the next position's, 0 at least; all of it before a gap."""
    w = W.partitionBy("chr", "strand").orderBy("pos")
    follows = F.lead("pos").over(w) == F.col("pos") + 1
    return depths.withColumn("stop_count", F.when(follows, F.greatest(F.col("depth") - F.lead("depth").over(w), F.lit(0))).otherwise(F.col("depth")))


def icshape_rt(lines: DataFrame, bases: DataFrame | None = None, filter_strand: str = "+") -> DataFrame:
    """Lines of chr, strand, pos, RT, BD ('@' comments): stops RT, depth RT + BD, both cut to whole numbers."""
    f = F.split(F.trim("value"), r"\s+")
    x = lines.where(~F.col("value").startswith("@")).select(f.alias("f")).where(F.size("f") >= 5)
    x = x.select(F.col("f")[0].alias("chr"), F.col("f")[1].alias("strand"), F.col("f")[2].try_cast("int").alias("pos"), _n(F.col("f")[3]).alias("rt"), _n(F.col("f")[4]).alias("bd")).where("pos is not null and rt is not null and bd is not null")
    if filter_strand in ("+", "-"):
        x = x.where(F.col("strand") == filter_strand)
    base = F.lit("N")
    if bases is not None:
        x = x.join(bases.select("chr", "pos", F.col("base").alias("_b")), ["chr", "pos"], "left")
        base = F.coalesce("_b", F.lit("N"))
    return _pileup(x, base=base, stop_count=F.col("rt"), depth=F.col("rt") + F.col("bd"), mut_count=F.lit(0))


def detect(first_lines: list[str], path: str = "") -> str:
    """Format of a file from its first lines."""
    lines = [x for x in first_lines if x.strip()]
    if not lines:
        return "bamreadcount"
    head = lines[0]
    if path.endswith(".xml") or head.lstrip().startswith("<"):
        return "rf-norm-xml"
    if head.startswith(("@ColNum", "@ChrID", "@")):
        return "icshape-rt"
    if head.startswith("ChrID,Strand,Position"):
        return "rf-norm"
    names = head.split("\t")
    if {"Nucleotide", "Sequence", "Norm_profile"} <= set(names):
        return "shapemapper-profile"
    if "read_depth" in names or "effective_depth" in names:
        return "shapemapper2"
    if len(names) == 1:
        return "rf-rctools"
    f = lines[-1].split("\t")
    if len(f) >= 9 and f[3] in ("+", "-") and all(x.isdigit() for x in f[4:9]):
        return "samtools-mpileup"
    if len(f) in (5, 6) and f[1].isdigit() and f[2].isdigit() and f[-1] in ("+", "-"):
        return "bedgraph"
    return "bamreadcount"


def _named(spark: SparkSession, path: str) -> DataFrame:
    """A tab table with header as strings, with line number n from 1 in file order."""
    lines = numbered_lines(spark, path).where("value <> ''")
    names = lines.where("n = 1").select("value").first()["value"].split("\t")
    f = F.split("value", "\t")
    return lines.where("n > 1").select((F.col("n") - 1).alias("n"), *[F.try_element_at(f, F.lit(i + 1)).alias(c) for i, c in enumerate(names)])


def convert(spark: SparkSession, path: str, fmt: str | None = None, strand: str = "+", fasta: str | None = None, rf_count_mutations: bool = False, filter_strand: str = "+", rf_norm_signal: str = "mut", name: str = "transcript") -> DataFrame:
    """Any supported file as a pileup or, for the normalised formats, reactivity."""
    fmt = fmt or detect([r["value"] for r in spark.read.text(path).limit(3).collect()], path)
    text = lambda: spark.read.text(path)
    bases = None
    if fasta and fmt in ("bedgraph", "icshape-rt"):
        from ..operators.pileup import reference_bases

        bases = reference_bases(read_fasta(spark, fasta))
    match fmt:
        case "bamreadcount":
            return bamreadcount(text(), strand)
        case "rf-rctools":
            return rctools(numbered_lines(spark, path), rf_count_mutations, strand)
        case "rf-norm":
            return read_reactivity(spark, path)
        case "rf-norm-xml":
            return rf_norm_xml(spark.read.text(path, wholetext=True), rf_norm_signal, strand)
        case "shapemapper2":
            if not fasta:
                raise ValueError("shapemapper2 needs a FASTA")
            return shapemapper2(_named(spark, path), read_fasta(spark, fasta), strand)
        case "shapemapper-profile":
            return shapemapper_profile(_named(spark, path), name, strand)
        case "samtools-mpileup":
            return samtools_mpileup(text(), strand)
        case "bedgraph":
            return bedgraph(text(), filter_strand, bases)
        case "icshape-rt":
            return icshape_rt(text(), bases, filter_strand)
    raise ValueError(f"unknown format {fmt}; one of {FORMATS}")
