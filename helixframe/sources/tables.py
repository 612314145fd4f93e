"""Pileup, reactivity, reference, annotation and structure files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import safe_name
from ..operators.components import cut
from ..schemas import PILEUP_HEADER, PILEUP_HEADER_EFFECTIVE, PILEUP_NAMES, REACTIVITY_HEADER

_LONGS = ["mut_count", "stop_count", "depth", "effective_depth", "ins", "del", "base_a", "base_c", "base_g", "base_t"]


def _long(c: Column) -> Column:
    """Integers, also written as floats; null if it is no number."""
    return F.coalesce(c.try_cast("long"), F.round(c.try_cast("double")).try_cast("long"))


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """Pileup CSV of 13 or 14 columns, told apart by header; missing effective_depth is null; rows without a position are dropped."""
    raw = spark.read.option("header", True).csv(path)
    cols = [F.col(f"`{c}`").alias(PILEUP_NAMES[c]) for c in raw.columns if c in PILEUP_NAMES]
    extra = [F.col(f"`{c}`") for c in raw.columns if c not in PILEUP_NAMES]
    df = raw.select(*cols, *extra)
    for c in _LONGS:
        df = df.withColumn(c, _long(F.col(c)) if c in df.columns else F.lit(None).cast("long"))
    df = df.withColumn("pos", F.col("pos").try_cast("int")).where("pos is not null")
    return df.select("chr", "strand", "pos", "base", *_LONGS, *[c for c in df.columns if c not in ("chr", "strand", "pos", "base", *_LONGS)])


def write_pileup(df: DataFrame, path: str, by: str | None = None, effective: bool | None = None) -> None:
    """Pileup CSV of rows with depth; ``by`` makes a folder per value (cells).

    ``effective``: with effective_depth or without (None: with it if any row
    has one). The rows are computed once, into a checkpoint, and then sorted by
    range and written.
    """
    df = cut(df.where("depth > 0"))
    if effective is None:
        effective = "effective_depth" in df.columns and not df.where("effective_depth is not null").isEmpty()
    names = PILEUP_HEADER_EFFECTIVE if effective else PILEUP_HEADER
    cols = [F.col(PILEUP_NAMES[n]).alias(n) for n in names]
    out = df.repartitionByRange("chr", "strand", "pos").sortWithinPartitions("chr", "strand", "pos")
    out = out.select(*cols, *([F.col(by)] if by else []))
    writer = out.write.option("header", True).mode("overwrite")
    (writer.partitionBy(by) if by else writer).csv(path)


def read_reactivity(spark: SparkSession, path: str) -> DataFrame:
    """Reactivity CSV of 6 columns, or of 4 (one signal, then the mutation signal is NaN and the base N)."""
    raw = spark.read.option("header", True).csv(path)
    c = raw.columns
    num = lambda i: F.col(f"`{c[i]}`").try_cast("double")
    pos = F.col(f"`{c[2]}`").try_cast("int").alias("pos")
    head = [F.col(f"`{c[0]}`").alias("chr"), F.col(f"`{c[1]}`").alias("strand"), pos]
    if len(c) >= 6:
        out = raw.select(*head, F.col(f"`{c[3]}`").alias("base"), num(4).alias("reactivity_stop"), num(5).alias("reactivity_mutation"), *[F.col(f"`{x}`") for x in c[6:]])
    else:
        out = raw.select(*head, F.lit("N").alias("base"), num(3).alias("reactivity_stop"), F.lit(float("nan")).alias("reactivity_mutation"))
    return out.where("pos is not null")


def write_reactivity(df: DataFrame, path: str) -> None:
    """Six decimals, NaN as text, columns beyond the six kept."""
    six = lambda c: F.when(F.isnan(c), "NaN").otherwise(F.format_string("%.6f", F.col(c)))
    names = ["chr", "strand", "pos", "base"]
    out = df.select(*[F.col(a).alias(b) for a, b in zip(names, REACTIVITY_HEADER, strict=False)], *[six(c).alias(c) for c in REACTIVITY_HEADER[4:]], *[c for c in df.columns if c not in (*names, *REACTIVITY_HEADER[4:])])
    out.write.option("header", True).mode("overwrite").csv(path)


def read_signal(spark: SparkSession, path: str, signal: str = "all", strand: str = "+") -> DataFrame:
    """signal, pos, base, value for drawings, from tables of several layouts (chr[, strand], pos at the third place, base).

    Signal columns are found by header: names with reactivity_, or any column
    from the fifth on; without a header, or without such columns, the fifth
    (the fourth of a table of four) is the signal ``score``. A signal that the
    table lacks falls back to its only one. Tables of five columns and more are
    filtered by strand ('both': all); rows without a position or a number go.
    """
    raw = spark.read.csv(path)
    first = raw.first()
    names = ["" if x is None else x for x in first] if first else []
    header = len(names) >= 3 and not (names[2] or "").strip().isdigit()
    found: dict[str, int] = {}
    if header:
        found = {n.replace("reactivity_", ""): i for i, n in enumerate(names) if "reactivity_" in n or (i >= 4 and n not in ("Strand", "Position", "Base"))}
    elif len(names) >= 5:
        found = {"score": len(names) - 1}
    found = found or {"score": 4 if len(names) >= 5 else 3}
    pick = found if signal == "all" or (signal not in found and len(found) == 1) else {k: v for k, v in found.items() if k == signal}
    rows = raw if len(names) < 5 or strand == "both" else raw.where(F.trim("_c1") == ("-" if strand == "-" else "+"))
    out = [rows.select(F.lit(k).alias("signal"), F.col("_c2").try_cast("int").alias("pos"), F.upper(F.substring("_c3", 1, 1)).alias("base"), F.col(f"_c{i}").try_cast("double").alias("value")) for k, i in pick.items() if i < len(names)]
    empty = spark.createDataFrame([], "signal string, pos int, base string, value double")
    return reduce(DataFrame.unionByName, out, empty).where("pos is not null and value is not null")


def unpivot_signals(df: DataFrame) -> DataFrame:
    """chr, strand, pos, base, signal, value of every column whose name begins with reactivity_."""
    signals = [c for c in df.columns if c.startswith("reactivity_")]
    return df.unpivot(["chr", "strand", "pos", "base"], signals, "signal", "value").withColumn("signal", F.regexp_replace("signal", "^reactivity_", ""))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig (first word of the header), seq (upper case). A record is one row, so it must fit one; ``read_reference`` has no such limit."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n", 2)
    out = raw.select(F.regexp_extract(F.element_at(lines, 1), r"^>?(\S+)", 1).alias("contig"), F.upper(F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")), r"\s", "")).alias("seq"))
    return out.where("contig <> ''")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, block (place of the split in the file), value: lines, in order within each split."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _block_runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[str]]]:
    file, block, value = (batch.column(i) for i in range(3))
    files, blocks = file.to_pylist(), block.to_pylist()
    edge = [0, *(i for i in range(1, len(files)) if (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])), len(files)]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b > a:
            yield files[a], blocks[a], value.slice(a, b - a).to_pylist()


def read_reference(spark: SparkSession, path: str, piece: int = 1 << 16) -> DataFrame:
    """contig, start (0-based), seq (upper case): FASTA records in pieces of about ``piece`` bases, so that a contig needs no row of its own size.

    Files are read in splits, twice: first the bases after each header and at
    the head of each split are counted, which gives every stretch its place,
    then pieces are cut. Headers are lines that begin with '>'.
    """

    def stretches(batches: Iterator[pa.RecordBatch], out) -> Iterator[pa.RecordBatch]:
        """``out`` gets (file, block, number of the stretch, its contig or None, its lines in a batch)."""
        key, i, name = None, 0, None
        for batch in batches:
            for file, block, lines in _block_runs(batch):
                if (file, block) != key:
                    key, i, name = (file, block), 0, None
                held: list[str] = []
                for line in lines:
                    if line.startswith(">"):
                        yield from out(file, block, i, name, held)
                        i, held = i + 1, []
                        name = (line[1:].split() or [""])[0]
                    else:
                        held.append(line)
                yield from out(file, block, i, name, held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "i", "contig", "bases"]
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)], names)
        yield from stretches(batches, lambda file, block, i, name, held: [row(file, block, i, name, sum(len("".join(x.split())) for x in held))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "i", "offset", "seq"]
        done: dict[str, object] = {"key": None, "at": 0}

        def out(file, block, i, name, held):
            if done["key"] != (file, block, i):
                done.update(key=(file, block, i), at=0)
            text = "".join("".join(x.split()) for x in held).upper()
            for k in range(0, len(text), piece):
                part = text[k : k + piece]
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([i], pa.int32()), pa.array([done["at"]], pa.int64()), pa.array([part])], names)
                done["at"] += len(part)

        yield from stretches(batches, out)

    lines = _blocks(spark, path)
    per = lines.mapInArrow(count, "file string, block long, i int, contig string, bases long").groupBy("file", "block", "i").agg(F.max("contig").alias("contig"), F.sum("bases").alias("bases"))
    order = W.partitionBy("file").orderBy("block", "i")
    per = per.withColumn("record", F.sum(F.col("contig").isNotNull().cast("long")).over(order)).withColumn("contig", F.last("contig", ignorenulls=True).over(order))
    before = F.sum("bases").over(W.partitionBy("file", "record").orderBy("block", "i")) - F.col("bases")
    place = per.select("file", "block", "i", "contig", before.alias("before")).where("contig is not null and contig <> ''")
    pieces = lines.mapInArrow(cut, "file string, block long, i int, offset long, seq string")
    return pieces.join(place, ["file", "block", "i"]).select("contig", (F.col("before") + F.col("offset")).alias("start"), "seq")


def write_fasta(df: DataFrame, path: str, name: Column, seq: Column, width: int = 80) -> None:
    from ..functions.columns import wrap_fasta

    df.select(F.concat(F.lit(">"), name, F.lit("\n"), wrap_fasta(seq, width)).alias("value")).write.mode("overwrite").text(path)


def write_exons(exons: DataFrame, transcripts: DataFrame, path: str) -> None:
    """GTF of the exons of some transcripts (column transcript_id), in order of transcript and place."""
    kept = exons.join(transcripts.select("transcript_id").distinct(), "transcript_id", "left_semi")
    tags = F.concat(F.lit('gene_id "'), F.coalesce("gene_id", F.lit("")), F.lit('"; transcript_id "'), F.col("transcript_id"), F.lit('";'))
    dot = F.lit(".")
    line = F.concat_ws("\t", "seqname", "source", F.lit("exon"), F.col("start").cast("string"), F.col("end").cast("string"), dot, "strand", dot, tags)
    kept.repartitionByRange("transcript_id", "start", "end").sortWithinPartitions("transcript_id", "start", "end").select(line.alias("value")).write.mode("overwrite").text(path)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """seqname, source, feature, start, end, strand, gene_id, gene_name, transcript_id, attributes; other lines are skipped."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema("seqname string, source string, feature string, start string, end string, score string, strand string, frame string, attributes string").csv(path)
    tag = lambda k: F.nullif(F.regexp_extract("attributes", rf'(?:^|[;\s]){k}\s+"?([^";]+)"?', 1), F.lit(""))
    return raw.select("seqname", "source", "feature", F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), "strand", tag("gene_id").alias("gene_id"), tag("gene_name").alias("gene_name"), tag("transcript_id").alias("transcript_id"), "attributes").where("start is not null and end is not null")


def read_exons(spark: SparkSession, path: str) -> DataFrame:
    return read_gtf(spark, path).where("feature = 'exon' and transcript_id is not null").select("seqname", "source", "start", "end", "strand", "transcript_id", "gene_id")


def read_strand_map(spark: SparkSession, path: str) -> DataFrame:
    """id, strand of an annotation: GTF prefers transcript_id, GFF3 locus_tag to ID; the last line of an id wins."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema("seqname string, source string, feature string, start string, end string, score string, strand string, frame string, attributes string").csv(path).withColumn("_n", F.monotonically_increasing_id())
    pick = lambda pattern: F.nullif(F.regexp_extract("attributes", pattern, 1), F.lit(""))
    ident = F.coalesce(pick(r'transcript_id "([^"]+)"'), pick(r'gene_id "([^"]+)"'), pick(r"locus_tag=([^;]+)"), pick(r"(?:^|;)ID=([^;]+)"))
    return raw.withColumn("id", ident).where("id is not null and strand in ('+', '-')").groupBy("id").agg(F.max_by("strand", "_n").alias("strand"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """gene, transcript of a two-column table."""
    return spark.read.option("sep", "\t").schema("gene string, transcript string").csv(path).where("gene is not null and transcript is not null")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("gene")).where("gene <> ''")


def parse_structure(text: str) -> list[tuple[int, str, bool]]:
    """(pos, base, is_single) of a dot-bracket text: comments, then sequence and structure lines in any number.

    Raises ValueError if the lengths differ.
    """
    seq, fold = [], []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(("#", ">")):
            continue
        if set(line.upper()) <= set("ACGUT"):
            seq.append(line.upper())
        elif set(line) <= set(".()[]{}<>aA "):
            fold.append(line.replace(" ", ""))
    s, f = "".join(seq), "".join(fold)
    if len(s) != len(f):
        raise ValueError(f"sequence of {len(s)} and structure of {len(f)} characters")
    return [(i + 1, b, c == ".") for i, (b, c) in enumerate(zip(s, f, strict=True))]


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """pos, base, is_single of one dot-bracket file (one molecule, so parsed on the driver)."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(parse_structure(text), "pos int, base string, is_single boolean")


def write_genes(extracted: DataFrame, path: str) -> None:
    """One folder per gene, named safely and by its average depth (as in ``extract.gene_depths``); a gene without rows has none."""
    from ..operators.extract import gene_depths

    name = gene_depths(extracted).select(F.col("gene_id").alias("_g"), F.regexp_replace("file_name", "\\.csv$", "").alias("gene"))
    extracted.join(name, F.col("gene_id") == F.col("_g")).drop("_g").write.partitionBy("gene").option("header", True).mode("overwrite").csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, value: lines numbered from 1 within each file, for formats in which order matters.

    Files are read in splits, twice: lines are counted per split, which gives
    each split its first number, and numbered within it.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, i = None, 0
        for batch in batches:
            for file, block, lines in _block_runs(batch):
                if (file, block) != key:
                    key, i = (file, block), 0
                n = len(lines)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array(range(i + 1, i + n + 1), pa.int64()), pa.array(lines, pa.string())], ["file", "block", "i", "value"])
                i += n

    lines = _blocks(spark, path)
    count = lines.groupBy("file", "block").agg(F.count("*").alias("c"))
    base = count.select("file", "block", (F.sum("c").over(W.partitionBy("file").orderBy("block")) - F.col("c")).alias("base"))
    rows = lines.mapInArrow(number, "file string, block long, i long, value string")
    return rows.join(base, ["file", "block"]).select("file", (F.col("base") + F.col("i")).alias("n"), F.regexp_replace("value", "\r$", "").alias("value"))


def last_in_order(value: Column, keys: list[str], order: str) -> Column:
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order))
