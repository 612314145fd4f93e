"""Comparisons of samples, replicates and groups, site by site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import stats

KEY = ["chr", "strand", "pos"]


def fold_changes(mod: DataFrame, unmod: DataFrame, min_depth: int = 10, min_fold: float = 2.0) -> DataFrame:
    """Sites of both samples with enough depth and at least one rate raised ``min_fold`` times.

    Counts and depths of both, stop_fold, mutation_fold (infinity for a control
    of 0, 1 where both are 0) and score, their mean.
    """
    part = lambda df, p: df.select(*KEY, *([F.col("base")] if p == "mod" else []), *[F.col(c).cast("double").alias(f"{p}_{c}") for c in ("mut_count", "stop_count", "depth")])
    j = part(mod, "mod").join(part(unmod, "unmod"), KEY).where((F.col("mod_depth") >= min_depth) & (F.col("unmod_depth") >= min_depth))
    r = lambda p, c: C.rate(F.col(f"{p}_{c}"), F.col(f"{p}_depth"))
    j = j.withColumn("stop_fold", C.fold_change(r("mod", "stop_count"), r("unmod", "stop_count"))).withColumn("mutation_fold", C.fold_change(r("mod", "mut_count"), r("unmod", "mut_count")))
    return j.withColumn("score", C.modification_score(F.col("stop_fold"), F.col("mutation_fold"))).where((F.col("stop_fold") >= min_fold) | (F.col("mutation_fold") >= min_fold))


def mod_vs_unmod(mod: DataFrame, unmod: DataFrame, min_depth: int = 10, min_fold: float = 2.0, test: str | None = "t-test", alpha: float = 0.05) -> DataFrame:
    """``fold_changes`` with a test of the two stop rates at each site; only significant sites stay if there is a test.

    One value against one: only diffscan and deltashape can be significant.
    """
    f = fold_changes(mod, unmod, min_depth, min_fold)
    if test is None:
        return f
    long = f.select(*KEY, F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), C.rate(F.col(f"{p}_stop_count"), F.col(f"{p}_depth")).alias("value")) for g, p in ((1, "mod"), (2, "unmod"))])).alias("x"))
    long = long.select(*KEY, F.col("x.grp").alias("grp"), F.lit(0).alias("pair"), F.col("x.value").alias("value"))
    return f.join(stats.run_test(long, KEY, test, alpha), KEY).where("significant")


def stack(tables: list[DataFrame], group: int, value: str) -> DataFrame:
    """Long table (KEY, grp, pair, value) of several samples of one group."""
    parts = [t.select(*KEY, F.lit(group).alias("grp"), F.lit(i).alias("pair"), F.col(value).cast("double").alias("value")) for i, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, parts)


def group_summary(long: DataFrame, keys: list[str] = KEY, single_std: float | None = 0.0) -> DataFrame:
    """Means, deviations (n - 1; a single value: ``single_std``) and counts of both groups; sites of both groups only."""
    v = lambda g: F.when(F.col("grp") == g, F.col("value"))
    out = long.groupBy(*keys).agg(*[f(v(g)).alias(f"{n}{g}") for g in (1, 2) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))]).where("n1 > 0 and n2 > 0")
    for g in (1, 2):
        out = out.withColumn(f"std{g}", F.coalesce(f"std{g}", F.lit(single_std)))
    return out


def compare_long(long: DataFrame, test: str = "t-test", alpha: float = 0.05, min_fold: float = 0.0, min_mean: float = 0.0, keys: list[str] = KEY, compat: bool = False) -> DataFrame:
    """Two groups of any number of samples: summary, fold change of the means and a test per site.

    One shuffle by site for the summary and one for the test, both on partial
    aggregates where the test allows it.
    """
    s = group_summary(long, keys).withColumn("fold", C.fold_change(F.col("mean1"), F.col("mean2")))
    s = s.where((F.col("fold") >= min_fold) & (F.col("mean1") >= min_mean) & (F.col("mean2") >= min_mean))
    return s.join(stats.run_test(long, keys, test, alpha, compat=compat), keys)


def replicates(group1: list[DataFrame], group2: list[DataFrame], signal: str = "stop_count", min_depth: int = 10, min_fold: float = 2.0, test: str = "t-test", alpha: float = 0.05, compat: bool = False) -> DataFrame:
    """Pileups of replicates; the test works on counts, mean depths of both groups must reach ``min_depth``."""
    long = stack(group1, 1, signal).unionByName(stack(group2, 2, signal))
    depth = group_summary(stack(group1, 1, "depth").unionByName(stack(group2, 2, "depth"))).select(*KEY, F.col("mean1").alias("depth1"), F.col("mean2").alias("depth2"))
    out = compare_long(long, test, alpha, compat=compat).join(depth, KEY)
    return out.where((F.col("depth1") >= min_depth) & (F.col("depth2") >= min_depth) & (F.col("fold") >= min_fold))


def reactivity_groups(group1: list[DataFrame], group2: list[DataFrame], signal: str = "reactivity_stop", test: str = "t-test", alpha: float = 0.05, min_fold: float = 0.0) -> DataFrame:
    """Reactivity tables of two groups; NaN values take no part."""
    clean = lambda t: t.where(~F.isnan(signal))
    return compare_long(stack([clean(t) for t in group1], 1, signal).unionByName(stack([clean(t) for t in group2], 2, signal)), test, alpha, min_fold)


def reactivity_results(one: DataFrame, two: DataFrame, signal: str = "reactivity_stop", test: str = "diffscan", alpha: float = 0.05) -> DataFrame:
    """Two reactivity tables site by site: values, difference, fold change and the test."""
    j = one.select(*KEY, F.col(signal).alias("value1")).join(two.select(*KEY, F.col(signal).alias("value2")), KEY).where(~F.isnan("value1") & ~F.isnan("value2"))
    long = j.select(*KEY, F.explode(F.array(F.struct(F.lit(1).alias("grp"), F.col("value1").alias("value")), F.struct(F.lit(2).alias("grp"), F.col("value2").alias("value")))).alias("x")).select(*KEY, "x.grp", F.lit(0).alias("pair"), "x.value")
    d = j.withColumn("difference", F.col("value1") - F.col("value2")).withColumn("fold", C.fold_change(F.col("value1"), F.col("value2")))
    return d.join(stats.run_test(long, KEY, test, alpha), KEY)


# ---------------------------------------------------------------- tables of fixed layout

_SITE = [("chr", "ChrID"), ("strand", "Strand"), ("pos", "Position")]
_TEST = [("statistic", "Test_Statistic"), ("p_value", "P_Value"), ("significant", "Significant"), ("effect_size", "Effect_Size")]

#: Column and header of the tables that comparisons write.
SAMPLES_LAYOUT = [
    *_SITE, ("base", "RefBase"), ("mod_mut_count", "Mod_RFC"), ("mod_stop_count", "Mod_PIPC"), ("mod_depth", "Mod_Depth"), ("unmod_mut_count", "Unmod_RFC"), ("unmod_stop_count", "Unmod_PIPC"), ("unmod_depth", "Unmod_Depth"),
    ("mutation_fold", "RFC_FoldChange"), ("stop_fold", "PIPC_FoldChange"), *_TEST, ("score", "Modification_Score"),
]
REPLICATES_LAYOUT = [
    *_SITE, ("base", "RefBase"), ("mut_mean1", "Group1_Mean_RFC"), ("mean1", "Group1_Mean_PIPC"), ("depth1", "Group1_Mean_Depth"), ("mut_mean2", "Group2_Mean_RFC"), ("mean2", "Group2_Mean_PIPC"), ("depth2", "Group2_Mean_Depth"),
    ("mutation_fold", "RFC_FoldChange"), ("fold", "PIPC_FoldChange"), *_TEST, ("score", "Modification_Score"),
]
REACTIVITY_LAYOUT = [
    *_SITE, ("mean1", "{0}1_Mean{1}"), ("std1", "{0}1_Std{1}"), ("mean2", "{0}2_Mean{1}"), ("std2", "{0}2_Std{1}"), ("fold", "FoldChange"), *_TEST,
]


def layout(df: DataFrame, columns: list[tuple[str, str]], *names: str) -> DataFrame:
    """The columns of a layout that ``df`` has, under their headers; flags as Yes and No."""
    flag = lambda c: F.when(F.col(c), "Yes").otherwise("No") if c == "significant" else F.col(c)
    return df.select(*[flag(c).alias(h.format(*names)) for c, h in columns if c in df.columns])


def samples_table(mod: DataFrame, unmod: DataFrame, **options) -> DataFrame:
    """``mod_vs_unmod`` in its layout: 17 columns with a test, 13 without."""
    return layout(mod_vs_unmod(mod, unmod, **options), SAMPLES_LAYOUT)


def replicates_table(group1: list[DataFrame], group2: list[DataFrame], **options) -> DataFrame:
    """``replicates`` with the means of mutations and the base: 17 columns."""
    out = replicates(group1, group2, **options)
    m = group_summary(stack(group1, 1, "mut_count").unionByName(stack(group2, 2, "mut_count"))).select(*KEY, F.col("mean1").alias("mut_mean1"), F.col("mean2").alias("mut_mean2"))
    base = reduce(DataFrame.unionByName, [t.select(*KEY, "base") for t in group1]).groupBy(*KEY).agg(F.min("base").alias("base"))
    out = out.join(m, KEY).join(base, KEY).withColumn("mutation_fold", C.fold_change(F.col("mut_mean1"), F.col("mut_mean2")))
    return layout(out.withColumn("score", C.modification_score(F.col("fold"), F.col("mutation_fold"))), REPLICATES_LAYOUT)


def groups_table(group1: list[DataFrame], group2: list[DataFrame], **options) -> DataFrame:
    """``reactivity_groups``: 12 columns."""
    return layout(reactivity_groups(group1, group2, **options), REACTIVITY_LAYOUT, "Group", "_Reactivity")


def results_table(results: DataFrame) -> DataFrame:
    """``reactivity_results``: 12 columns, deviations of single values 0."""
    r = results.withColumnsRenamed({"value1": "mean1", "value2": "mean2"}).withColumn("std1", F.lit(0.0)).withColumn("std2", F.lit(0.0))
    return layout(r, REACTIVITY_LAYOUT, "Reactivity", "")


def regions_table(regions: DataFrame, threshold: str, score: str) -> DataFrame:
    """Regions in eight columns; ``score`` and ``threshold`` name the columns that fill MaxQ and MonteCarlo_Threshold."""
    return regions.select(F.col("chr").alias("ChrID"), F.col("strand").alias("Strand"), F.col("start").alias("Start"), F.col("end").alias("End"), (F.col("end") - F.col("start") + 1).alias("Length"), F.col(score).alias("MaxQ"), F.col(threshold).alias("MonteCarlo_Threshold"), F.lit("Yes").alias("Significant"))
