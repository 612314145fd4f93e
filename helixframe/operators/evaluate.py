"""Evaluation of signals against a known secondary structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import normalize_base


def match_counts(signal: DataFrame, structure: DataFrame, max_shift: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, shift, matches, checked for every shift in -max_shift..max_shift: equal bases (T as U) at pos + shift.

    Equal rows of either side count once, with their number. Both sides go to
    bins as wide as the range of shifts, so a signal row meets the two bins
    that it can reach; neither side is multiplied by the shifts. The bins are
    merged, as a structure of many positions does not fit a broadcast.
    """
    width = 2 * max_shift + 1
    st = structure.groupBy(F.col("pos").cast("long").alias("spos"), normalize_base(F.col("base")).alias("sbase")).agg(F.count("*").alias("sn")).where("spos is not null")
    st = st.withColumn("bin", F.floor(F.col("spos") / width))
    s = signal.groupBy(*keys, "pos", normalize_base(F.col("base")).alias("b")).agg(F.count("*").alias("n")).where("pos is not null").withColumn("pos", F.col("pos").cast("long"))  # the cast after the group: a signal dealt by pos stays
    s = s.withColumn("bin", F.explode(F.array_distinct(F.array(F.floor((F.col("pos") - max_shift) / width), F.floor((F.col("pos") + max_shift) / width)))))
    shift, rows = F.col("spos") - F.col("pos"), F.col("n") * F.col("sn")
    j = s.join(st.hint("merge"), "bin").where(shift.between(-max_shift, max_shift))
    return j.groupBy(*keys, shift.cast("int").alias("shift")).agg(F.sum(F.when(F.col("b").isNotNull() & F.col("sbase").isNotNull(), F.when(F.col("b") == F.col("sbase"), rows).otherwise(0))).alias("matches"), F.sum(rows).alias("checked"))


def best_shift(signal: DataFrame, structure: DataFrame, max_shift: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, shift, matches: most matches, ties to the smaller shift."""
    m = match_counts(signal, structure, max_shift, keys)
    return m.groupBy(*keys).agg(F.max(F.struct("matches", (-F.col("shift")).alias("n"))).alias("b")).select(*keys, (-F.col("b.n")).cast("int").alias("shift"), F.col("b.matches").alias("matches"))


def shift_range(n_signal: int, n_structure: int) -> int:
    return min(abs(n_signal - n_structure) + 5, 20)


def base_shifts(template: DataFrame, signal: DataFrame, max_shift: int = 20, genomic: int = 100_000) -> DataFrame:
    """base, shift for drawings: the shift at which most template positions of a base fall on signal positions, ties by equal bases, then the smaller.

    ``template``: pos, base. The search is around the difference of the least
    positions of the base, 1,000 either way at least; template positions from
    ``genomic`` on are places already and take no part. The shifts explode the
    template, one molecule's positions.
    """
    wide = max(max_shift, 1000)
    t = template.where(F.col("pos") < genomic).select(F.col("pos").alias("tpos"), normalize_base(F.col("base")).alias("base"))
    s = signal.select("pos", normalize_base(F.col("base")).alias("sbase")).distinct()
    first = t.groupBy("base").agg(F.min("tpos").alias("t0")).join(s.groupBy(F.col("sbase").alias("base")).agg(F.min("pos").alias("s0")), "base").select("base", (F.col("s0") - F.col("t0")).alias("guess"))
    tries = t.join(first, "base").withColumn("shift", F.explode(F.sequence(F.col("guess") - wide, F.col("guess") + wide))).withColumn("pos", F.col("tpos") + F.col("shift"))
    n = tries.join(s, "pos").groupBy("base", "shift").agg(F.count("*").alias("checked"), F.sum((F.col("base") == F.col("sbase")).cast("long")).alias("matches"))
    best = n.groupBy("base").agg(F.max(F.struct("checked", "matches", (-F.col("shift")).alias("n"))).alias("b"))
    return best.select("base", (-F.col("b.n")).cast("int").alias("shift"))


def label(signal: DataFrame, structure: DataFrame, shift: int | DataFrame = 0, keys: list[str] = [], bases: str | None = None, match_only: bool = False) -> DataFrame:  # noqa: B006
    """Signal rows that fall on the structure at pos + shift, with sbase and is_single; the base stays with its row.

    ``bases`` keeps rows of some bases, ``match_only`` those whose base agrees.
    """
    st = structure.select(F.col("pos").alias("spos"), F.col("base").alias("sbase"), "is_single")
    s = signal
    if isinstance(shift, int):
        s = s.withColumn("spos", F.col("pos") + shift)
    else:
        s = (s.join(shift.select(*keys, "shift"), keys) if keys else s.crossJoin(F.broadcast(shift.select("shift")))).withColumn("spos", F.col("pos") + F.col("shift")).drop("shift")
    out = s.join(st, "spos").drop("spos")
    if bases:
        out = out.where(F.lit(bases.upper().replace("U", "T")).contains(normalize_base(F.col("base"))))
    return out.where(normalize_base(F.col("base")) == normalize_base(F.col("sbase"))) if match_only else out


def curve(labelled: DataFrame, value: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per threshold (distinct value): keys, threshold, tp, fp, tn, fn, tpr, fpr, precision, recall, f1, youden.

    A row is positive if its value reaches the threshold. NaN and null leave.
    Rows combine to value counts before the running sums, so a window sorts
    distinct values, not rows. Groups need both labels.
    """
    g = labelled.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("threshold")).agg(F.sum(F.col("is_single").cast("long")).alias("p"), F.sum((~F.col("is_single")).cast("long")).alias("q"))
    down, every = W.partitionBy(*keys).orderBy(F.col("threshold").desc()), W.partitionBy(*keys)
    g = g.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("q").over(down)).withColumn("n_pos", F.sum("p").over(every)).withColumn("n_neg", F.sum("q").over(every)).where("n_pos > 0 and n_neg > 0")
    tpr, fpr = F.col("tp") / F.col("n_pos"), F.col("fp") / F.col("n_neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return g.select(
        *keys, "threshold", "p", "q", "tp", "fp", (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn"), tpr.alias("tpr"), fpr.alias("fpr"), precision.alias("precision"), tpr.alias("recall"),
        F.when(F.col("tp") > 0, 2 * precision * tpr / (precision + tpr)).otherwise(0.0).alias("f1"), (tpr - fpr).alias("youden"),
    )


#: Columns of the curve that the best threshold's row gives.
_AT_BEST = ("threshold", "tp", "fp", "tn", "fn", "tpr", "fpr", "precision", "f1", "youden")


def _area() -> Column:
    return F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0)) / (F.sum("p") * F.sum("q"))


def _mean_precision() -> Column:
    return F.sum(F.col("precision") * F.col("p")) / F.sum("p")


def _best() -> Column:
    """Struct with the curve row that ``best_threshold`` takes."""
    inner = (F.col("tpr") > 0) & (F.col("tpr") < 1) & (F.col("fpr") > 0) & (F.col("fpr") < 1)
    return F.max(F.struct(inner.cast("int").alias("i"), F.when(inner, F.col("youden")).otherwise(F.col("f1")).alias("v"), *_AT_BEST))


def auc(labelled: DataFrame, value: str, keys: list[str] = [], compat: bool = False) -> DataFrame:  # noqa: B006
    """keys, auc, positives, negatives: exact area under the ROC curve, ties counting half.

    ``compat``: area with the points taken from low thresholds to high, that is
    1 - auc.
    """
    c = curve(labelled, value, keys)
    return c.groupBy(*keys).agg((1.0 - _area() if compat else _area()).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def average_precision(labelled: DataFrame, value: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, average_precision: precision at each threshold weighed by the recall it adds."""
    return curve(labelled, value, keys).groupBy(*keys).agg(_mean_precision().alias("average_precision"))


def best_threshold(labelled: DataFrame, value: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys and the curve row of the greatest Youden index, extremes of the curve excluded; else of the greatest F1. Ties: higher threshold."""
    return curve(labelled, value, keys).groupBy(*keys).agg(_best().alias("b")).select(*keys, *[f"b.{x}" for x in _AT_BEST])


def confusion(labelled: DataFrame, value: str, threshold: float, keys: list[str] = [], strict: bool = False) -> DataFrame:  # noqa: B006
    """Counts and rates at one threshold; ``strict`` takes values above it only. NaN and null leave."""
    x = labelled.where(F.col(value).isNotNull() & ~F.isnan(value))
    pos = F.col(value) > threshold if strict else F.col(value) >= threshold
    s, n = F.col("is_single"), lambda c: F.sum(c.cast("long"))
    g = x.groupBy(*keys).agg(n(pos & s).alias("tp"), n(pos & ~s).alias("fp"), n(~pos & ~s).alias("tn"), n(~pos & s).alias("fn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return g.withColumns({
        "sensitivity": over(tp, tp + fn), "specificity": over(tn, tn + fp), "ppv": over(tp, tp + fp), "npv": over(tn, tn + fn),
        "accuracy": over(tp + tn, tp + fp + tn + fn), "f1": over(2 * tp, 2 * tp + fp + fn),
    })


def grid_curve(labelled: DataFrame, value: str, points: int = 101, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts at ``points`` evenly spaced thresholds from the least to the greatest value of each group."""
    x = labelled.where(F.col(value).isNotNull() & ~F.isnan(value))
    edge = x.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    per = x.groupBy(*keys, F.col(value).alias("v")).agg(F.sum(F.col("is_single").cast("long")).alias("p"), F.sum((~F.col("is_single")).cast("long")).alias("q"))
    grid = x.sparkSession.range(points).select((F.col("id") / (points - 1)).alias("f"))
    e = edge.crossJoin(F.broadcast(grid)).withColumn("threshold", F.col("lo") + F.col("f") * (F.col("hi") - F.col("lo")))
    j = per.join(e, keys) if keys else per.crossJoin(e)
    n = lambda c, w: F.sum(F.when(c, F.col(w)).otherwise(0))
    hit = F.col("v") >= F.col("threshold")
    return j.groupBy(*keys, "f", "threshold").agg(n(hit, "p").alias("tp"), n(hit, "q").alias("fp"), n(~hit, "q").alias("tn"), n(~hit, "p").alias("fn")).drop("f")


def by_base(labelled: DataFrame, value: str, keys: list[str] = [], least: int = 10) -> DataFrame:  # noqa: B006
    """auc for each base with at least ``least`` rows, and for all of them ('all')."""
    x = labelled.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("of", F.explode(F.array(normalize_base(F.col("base")), F.lit("all"))))
    enough = x.groupBy(*keys, "of").count().where(F.col("count") >= least).drop("count")
    return auc(x.join(enough, [*keys, "of"], "left_semi"), value, [*keys, "of"])


def both_signals(reactivity: DataFrame, structure: DataFrame, max_shift: int = 20, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, signal, shift, auc, average_precision and the best threshold's metrics of the stop and the mutation signal, and which is better."""
    r = reactivity.select(*keys, "pos", "base", "reactivity_stop", "reactivity_mutation")
    k = [*keys, "signal"]  # the shift is one for both signals, as it counts bases
    lab = label(r, structure, best_shift(r, structure, max_shift, keys), keys).unpivot([*keys, "is_single"], ["reactivity_stop", "reactivity_mutation"], "signal", "value")
    out = curve(lab, "value", k).groupBy(*k).agg(_area().alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"), _mean_precision().alias("average_precision"), _best().alias("b"))
    out = out.select(*k, "auc", "positives", "negatives", "average_precision", *[f"b.{x}" for x in ("threshold", "tpr", "fpr", "precision", "f1", "youden")])
    return out.withColumn("better", F.col("auc") == F.max("auc").over(W.partitionBy(*keys)))


def report(labelled: DataFrame, value: str, signal: str) -> DataFrame:
    """Lines (column value) of a result file of one molecule: metrics at the best threshold, then the curve, in one partition."""
    best = best_threshold(labelled, value).crossJoin(auc(labelled, value).select("auc"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    metrics = {"AUC": F.col("auc"), "F1-score": F.col("f1"), "Sensitivity": F.col("tpr"), "Specificity": 1.0 - F.col("fpr"), "PPV": F.col("precision"), "NPV": over(tn, tn + fn), "Accuracy": over(tp + tn, tp + fp + tn + fn)}
    head = ["# Reactivity Accuracy Evaluation Results", f"# Signal Type: {signal}", "#", "# Overall Metrics:"]
    rows = [F.lit(x) for x in head] + [F.format_string(f"{k}\t%.6f", v) for k, v in metrics.items()] + [F.lit(x) for x in ("#", "# ROC Curve Data:", "Threshold\tTPR\tFPR\tPrecision\tRecall")]
    top = best.select(F.posexplode(F.array(*rows)).alias("n", "value")).select(F.lit(0).alias("part"), F.col("n").cast("double").alias("n"), "value")
    points = curve(labelled, value).select(F.lit(1).alias("part"), (-F.col("threshold")).alias("n"), F.format_string("%.6f\t%.6f\t%.6f\t%.6f\t%.6f", "threshold", "tpr", "fpr", "precision", "recall").alias("value"))
    return top.unionByName(points).coalesce(1).sortWithinPartitions("part", "n").select("value")
