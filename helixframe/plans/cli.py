"""Command line: ten commands over the operators, each reading and writing tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bias, compare, duet, evaluate, extract, norm, pileup, reactivity
from ..operators.regions import deltashape_regions, diffscan_regions
from ..session import get_session
from ..sources import alignments, convert, tables
from ..viz import svg


def _reads(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    return alignments.read_sam(spark, path) if path.endswith((".sam", ".sam.gz")) else alignments.read_bam(spark, path, region=region)


def _count(spark: SparkSession, a: argparse.Namespace, path: str, output: str) -> None:
    reads, fasta = _reads(spark, path, a.region), tables.read_reference(spark, a.fasta)
    by = ["cell"] if a.single_cell else []
    if by:
        reads = alignments.with_cell(reads)
    p = pileup.pileup(reads, fasta, a.min_base_qual, a.strand if a.strand in ("+", "-") else "both", by)
    if a.pcr_bias_correction:
        p = bias.correct_fixed(p, a.weight_increase, a.weight_decrease) if by else bias.correct(p, a.weight_increase, a.weight_decrease, drop_invalid=True)
    tables.write_pileup(p, output, by[0] if by else None, effective=a.pcr_bias_correction or a.min_base_qual > 0)


def count(spark: SparkSession, a: argparse.Namespace) -> None:
    """One pileup of all files, or, with --batch, one per file: bad files are passed over and named at the end."""
    if a.region and not a.bam.endswith((".sam", ".sam.gz")):
        bare = [f for f in alignments.bam_files(a.bam) if not alignments.has_index(f)]
        if bare:
            raise SystemExit(f"no index beside {', '.join(bare)}")
    if not a.batch:
        return _count(spark, a, a.bam, a.output)
    failed = []
    for f in alignments.bam_files(a.bam):
        try:
            _count(spark, a, f, f"{a.output}/{f.rpartition('/')[2].removesuffix('.bam')}")
        except Exception as e:  # noqa: BLE001  whatever is wrong with one file, the others go on
            failed.append(f"{f}: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}")
    if failed:
        raise SystemExit("failed:\n" + "\n".join(failed))


def correct(spark, a) -> None:
    tables.write_pileup(bias.correct(tables.read_pileup(spark, a.input), a.weight_increase, a.weight_decrease, species=a.species), a.output, effective=True)


def react(spark, a) -> None:
    mod = tables.read_pileup(spark, a.mod)
    pairs = reactivity.paired_rates(mod, tables.read_pileup(spark, a.unmod) if a.unmod else None)
    ks, km = 1.0, 1.0
    if a.unmod and "kfactor" in (a.stop_method, a.mutation_method):
        if a.k_prediction_method == "background":
            row = reactivity.k_background(pairs, reactivity.is_background(F.col("chr"), a.mod, a.k_background_gene_id)).first()
            ks, km = row["k_stop"], row["k_mutation"]
        elif a.k_prediction_method == "distribution":
            got = [reactivity.k_distribution(pairs, mod=m, unmod=u).first() for m, u in (("m_stop", "u_stop"), ("m_mut", "u_mut"))]
            ks, km = ((g["k"] if g else 1.0) for g in got)
        else:
            if not a.structure_file:
                raise SystemExit("recursive needs --structure-file")
            gene = a.structure_gene or a.structure_file.rpartition("/")[2].rpartition(".")[0]  # k is fitted on the structure's gene and holds for all
            own = pairs.where((F.col("chr") == gene) & (F.col("strand") == a.structure_strand))
            lab = own.join(tables.read_structure(spark, a.structure_file).select("pos", "is_single"), "pos")
            ks, km = (reactivity.k_structure(lab, m, u) or 1.0 for m, u in (("m_stop", "u_stop"), ("m_mut", "u_mut")))
    tables.write_reactivity(reactivity.reactivity(pairs, a.stop_method, a.mutation_method, ks, km, a.snp_cutoff, a.pseudocount), a.output)


def normalise(spark, a) -> None:
    r = tables.read_reactivity(spark, a.input)
    if a.dynamic:
        for s in ("reactivity_stop", "reactivity_mutation"):
            r = norm.dynamic_windows(r, s, size=a.window_size_dynamic)
    else:
        r = norm.normalize(r, a.method, linear=a.linear, compat=a.compat)
    tables.write_reactivity(r, a.output)


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def comparison(spark, a) -> None:
    many = lambda s: [tables.read_pileup(spark, p) for p in s.split(",")]
    react_many = lambda s: [tables.read_reactivity(spark, p) for p in s.split(",")]
    options = {"test": a.test, "alpha": a.alpha}
    limits = {"min_depth": a.min_depth, "min_fold": a.min_fold}
    if a.mode == "mod-vs-unmod":
        out = compare.samples_table(tables.read_pileup(spark, a.mod), tables.read_pileup(spark, a.unmod), test=None if a.test == "none" else a.test, alpha=a.alpha, **limits)
    elif a.mode == "biological-replicates":
        out = compare.replicates_table(many(a.group1), many(a.group2), **options, **limits)
    elif a.mode == "reactivity-groups":
        out = compare.groups_table(react_many(a.reactivity_group1), react_many(a.reactivity_group2), **options)
    else:
        one, two = tables.read_reactivity(spark, a.reactivity1), tables.read_reactivity(spark, a.reactivity2)
        found = compare.reactivity_results(one, two, **options)
        pairs = found.select("chr", "strand", "pos", "value1", "value2")
        if a.test == "diffscan":
            _csv(compare.regions_table(diffscan_regions(pairs, a.alpha), "threshold", "q"), a.output + ".regions.csv")
        else:
            _csv(compare.regions_table(deltashape_regions(pairs), "z_score", "z_factor"), a.output + ".regions.csv")
        out = compare.results_table(found)
    _csv(out, a.output)


def evaluation(spark, a) -> None:
    r = tables.read_reactivity(spark, a.reactivity).where((F.col("chr") == a.gene_id) & (F.col("strand") == a.strand))
    st = tables.read_structure(spark, a.structure)
    shift = evaluate.shift_range(r.count(), st.count()) if a.auto_shift else 0
    if a.signal_type == "both":
        _csv(evaluate.both_signals(r, st, shift), a.output)
        return
    value = f"reactivity_{a.signal_type}"
    lab = evaluate.label(r, st, evaluate.best_shift(r, st, shift), bases=a.reactive_bases, match_only=a.base_matching)
    c = evaluate.curve(lab, value)
    _csv(evaluate.auc(lab, value).crossJoin(evaluate.best_threshold(lab, value)), a.output + "/metrics")
    _csv(c, a.output + "/curve")
    evaluate.report(lab, value, a.signal_type).write.mode("overwrite").text(a.output + "/report")
    _csv(evaluate.by_base(lab, value), a.output + "/by_base")
    spark.createDataFrame([(svg.roc_figure(c, []),)], "value string").coalesce(1).write.mode("overwrite").text(a.output + "/roc_svg")


def extraction(spark, a) -> None:
    genes = extract.genes_from_gtf(tables.read_gtf(spark, a.gtf), a.target_gene)
    p = tables.read_pileup(spark, a.input) if a.input_format == "csv" else convert.convert(spark, a.input, "bamreadcount")
    tables.write_genes(extract.extract_genes(p, genes, stranded=a.input_format == "csv", relative=a.relative_position), a.output)


def conversion(spark, a) -> None:
    if a.input_mutation and a.input_stop:
        m = convert.convert(spark, a.input_mutation, "rf-rctools", a.strand, rf_count_mutations=True)
        out = convert.rctools_dual(m, convert.convert(spark, a.input_stop, "rf-rctools", a.strand))
    else:
        out = convert.convert(spark, a.input, a.format, a.strand, a.ref_fasta, a.rf_count_mutations, a.filter_strand, a.rf_norm_signal, a.chr_name or "transcript")
    (tables.write_pileup if "depth" in out.columns else tables.write_reactivity)(out, a.output)


def conformations(spark, a) -> None:
    sites = duet.clean_reactivity(tables.read_reactivity(spark, a.input))
    reads = _reads(spark, a.bam)
    named = reads.withColumn("read_id", F.xxhash64("qname", "flag"))
    aligned = pileup.aligned_bases(named, ["read_id"])
    u = pileup.usable_reads(named)
    end = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("pos") - 1 + pileup.reference_span(F.col("ops")))
    ends = u.select(F.col("rname").alias("chr"), "strand", "read_id", end.cast("int").alias("pos"))
    ref = pileup.reference_bases(tables.read_reference(spark, a.fasta))
    out = duet.analyse(duet.read_events(aligned, ends, sites, ref), sites, a.epsilon, a.min_samples, a.window_size, a.window_step)
    plan = (a.window_size, a.window_step)
    tables_ = {"windows": duet.windows_table(out, sites, *plan), "summary": duet.summary_table(out, sites, *plan), "global": duet.global_table(out), "global_per_base": duet.bases_table(out, sites)}
    for k, df in tables_.items():
        _csv(df, f"{a.output}/{k}")
    for name, figure in (("heatmap_svg", svg.ensemble_figure(out["bases"])), ("overlap_svg", svg.track_figure(out["ensembles"]))):
        spark.createDataFrame([(figure,)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.output}/{name}")


def plot(spark, a) -> None:
    p = tables.read_pileup(spark, a.mod)
    control = tables.read_pileup(spark, a.unmod) if a.unmod else None
    if a.annotation:
        strands = tables.read_strand_map(spark, a.annotation)
        p, control = (x if x is None else extract.annotated_only(x, strands) for x in (p, control))
    limits = {"min_coverage": a.coverage, "min_depth": a.depth}
    stats = extract.gene_stats(p, **limits) if control is None else extract.shared_genes(p, control, **limits)
    figures = [("coverage", svg.coverage_figure(stats))]
    high = stats.where("high").select("chr", "strand")
    of_high = lambda x: x.join(high, ["chr", "strand"], "left_semi")
    reactivity_ = tables.read_reactivity(spark, a.reactivity) if a.reactivity else None
    signals = svg.signal_figures(of_high(p), None if control is None else of_high(control), reactivity_)
    if a.reactivity and a.svg_template:
        text = "\n".join(x["value"] for x in spark.read.text(a.svg_template, wholetext=True).collect())
        signal = tables.read_signal(spark, a.reactivity, a.svg_signal, a.svg_strand)
        shift = 0
        if a.svg_ref:
            template = spark.createDataFrame(svg.template_positions(text) or [], "pos int, base string")
            shift = {r["base"]: r["shift"] for r in evaluate.base_shifts(template, signal, a.svg_max_shift).collect()}
        drawn = svg.color_template(text, signal.withColumnRenamed("value", f"reactivity_{a.svg_signal}"), a.svg_signal, shift, bases=a.svg_bases, filled=a.svg_circle_filled)
        figures.append(("structure", svg.interactive_html(drawn) if a.interactive else drawn))
    spark.createDataFrame(figures, "name string, value string").unionByName(signals).write.mode("overwrite").partitionBy("name").text(a.output)


def transcripts(spark, a) -> None:
    exons = tables.read_exons(spark, a.gtf)
    t = extract.splice_transcripts(exons, tables.read_fasta(spark, a.fasta), tables.read_mapping(spark, a.mapping) if a.mapping else None, tables.read_list(spark, a.genes) if a.genes else None, a.min_length)
    tables.write_fasta(t, f"{a.output}.fa", F.col("transcript_id"), F.col("seq"))
    tables.write_exons(exons, t, f"{a.output}.gtf")


#: Options with limits: (least, greatest, whether the least itself is allowed).
LIMITS = {
    "min_base_qual": (0, 93, True), "snp_cutoff": (0, 1, False), "pseudocount": (0, None, False), "min_depth": (0, None, True), "min_fold": (0, None, False), "alpha": (0, 1, False), "coverage": (0, 1, True), "depth": (0, None, True),
    "epsilon": (0, None, False), "min_samples": (1, None, True), "window_size": (1, None, True), "window_step": (1, None, True), "window_size_dynamic": (1, None, True), "min_length": (0, None, True), "weight_increase": (0, None, True), "weight_decrease": (0, None, True), "svg_max_shift": (0, None, True),
}

#: Options that name tables or files to read.
INPUTS = ("bam", "fasta", "input", "mod", "unmod", "structure_file", "reactivity", "structure", "gtf", "svg_template", "svg_ref", "annotation", "ref_fasta", "input_mutation", "input_stop", "mapping", "genes", "reactivity1", "reactivity2", "group1", "group2", "reactivity_group1", "reactivity_group2")


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    """SystemExit for options out of their limits, inputs that are not there and modes without their inputs."""
    for name, (low, high, closed) in LIMITS.items():
        v = getattr(a, name, None)
        if v is not None and (v < low or (v == low and not closed) or (high is not None and v > high)):
            raise SystemExit(f"--{name.replace('_', '-')} {v} is out of range")
    needs = {"mod-vs-unmod": ("mod", "unmod"), "biological-replicates": ("group1", "group2"), "reactivity-groups": ("reactivity_group1", "reactivity_group2"), "reactivity-results": ("reactivity1", "reactivity2")}
    for name in needs.get(getattr(a, "mode", None), ()):
        if not getattr(a, name):
            raise SystemExit(f"{a.mode} needs --{name.replace('_', '-')}")
    for name in INPUTS:
        for path in (getattr(a, name, None) or "").split(","):
            if path:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
                if found is None or not len(found):
                    raise SystemExit(f"--{name.replace('_', '-')}: {path} not found")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe")
    sub = p.add_subparsers(required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flags, kw in options:
            c.add_argument(*flags.split(), **kw)

    req, flag = {"required": True}, {"action": "store_true"}
    weights = [("--weight-increase", {"type": float, "default": 1.0}), ("--weight-decrease", {"type": float, "default": 0.5})]
    out = ("--output -o", req)
    command("count", count, ("--bam -b", req), ("--fasta -f", req), out, ("--strand -s", {"default": "+/-"}), ("--single-cell", flag), ("--min-base-qual", {"type": int, "default": 0}), ("--pcr-bias-correction", flag), ("--region", {}), ("--batch", flag), *weights)
    command("correct", correct, ("--input -i", req), out, ("--species", {}), *weights)
    command("reactivity", react, ("--mod -M", req), ("--unmod -U", {}), ("--output -O", req), ("--stop-method -s", {"default": "kfactor", "choices": ["kfactor", "ding", "rouskin", "siegfried"]}), ("--mutation-method -m", {"default": "kfactor", "choices": ["kfactor", "siegfried", "zubradt"]}), ("--pseudocount", {"type": float, "default": 1.0}), ("--snp-cutoff", {"type": float, "default": 0.25}), ("--k-prediction-method", {"default": "background", "choices": ["background", "distribution", "recursive"]}), ("--structure-file", {}), ("--structure-gene", {}), ("--structure-strand", {"default": "+"}), ("--k-background-gene-id", {}))
    command("norm", normalise, ("--input -i", req), out, ("--method -m", {"default": "winsor90", "choices": ["percentile28", "winsor90", "boxplot"]}), ("--linear", flag), ("--dynamic", flag), ("--window-size-dynamic", {"type": int, "default": 50}), ("--compat", flag))
    command("compare", comparison, ("--mode -m", {"default": "mod-vs-unmod", "choices": ["mod-vs-unmod", "biological-replicates", "reactivity-groups", "reactivity-results"]}), ("--mod -M", {}), ("--unmod -U", {}), ("--group1", {}), ("--group2", {}), ("--reactivity-group1", {}), ("--reactivity-group2", {}), ("--reactivity1", {}), ("--reactivity2", {}), out, ("--min-depth -d", {"type": int, "default": 10}), ("--min-fold -f", {"type": float, "default": 2.0}), ("--test -t", {"default": "t-test"}), ("--alpha -a", {"type": float, "default": 0.05}))
    command("evaluate", evaluation, ("--reactivity -r", req), ("--structure -s", req), out, ("--signal-type -t", {"default": "stop"}), ("--gene-id -g", req), ("--strand -S", {"default": "+"}), ("--base-matching", {"action": argparse.BooleanOptionalAction, "default": True}), ("--auto-shift", {"action": argparse.BooleanOptionalAction, "default": True}), ("--reactive-bases", {"default": "ACGT"}))
    command("plot", plot, ("--mod -M", req), ("--unmod -U", {}), ("--annotation", {}), out, ("--coverage -c", {"type": float, "default": 0.2}), ("--depth -d", {"type": float, "default": 50.0}), ("--reactivity -r", {}), ("--svg-template", {}), ("--svg-bases", {"default": "ACGT"}), ("--svg-signal", {"default": "stop"}), ("--svg-strand", {"default": "+"}), ("--svg-ref", {}), ("--svg-max-shift", {"type": int, "default": 20}), ("--svg-circle-filled", flag), ("--interactive", flag))
    command("duet", conformations, ("--input -i", req), ("--bam -b", req), ("--fasta -f", req), out, ("--epsilon", {"type": float, "default": 0.75}), ("--min-samples", {"type": int, "default": 5}), ("--window-size", {"type": int, "default": 100}), ("--window-step", {"type": int, "default": 50}))
    command("extract", extraction, ("--input -i", req), ("--gtf -g", req), ("--target-gene -t", req), out, ("--input-format", {"default": "csv"}), ("--relative-position", flag))
    command("convert", conversion, ("--input -i", {}), out, ("--format -f", {"choices": convert.FORMATS}), ("--rf-count-mutations", flag), ("--strand -s", {"default": "+"}), ("--ref-fasta", {}), ("--chr-name", {}), ("--input-mutation", {}), ("--input-stop", {}), ("--filter-strand", {"default": "+"}), ("--rf-norm-signal", {"default": "mut"}))
    command("transcripts", transcripts, ("--gtf", req), ("--fasta", req), out, ("--mapping", {}), ("--genes", {}), ("--min-length", {"type": int, "default": 0}))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = get_session()
    check(spark, a)
    a.run(spark, a)


if __name__ == "__main__":
    main()
