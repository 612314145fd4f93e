"""Reactivity from modified and control pileups, and the choice of the control's weight k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import columns as C
from ..functions.orderstat import at_index, value_counts

KEY = ["chr", "strand", "pos"]


def signal_rates(pileup: DataFrame, effective: bool = True) -> DataFrame:
    """KEY, base, stop, mutation, depth: rates on the effective depth where there is one."""
    eff = F.col("effective_depth") if effective and "effective_depth" in pileup.columns else None
    d = C.used_depth(F.col("depth"), eff)
    base = F.col("base") if "base" in pileup.columns else F.lit("N")
    return pileup.select(*KEY, base.alias("base"), C.rate(F.col("stop_count"), d).alias("stop"), C.rate(F.col("mut_count"), d).alias("mutation"), F.col("depth"))


def paired_rates(mod: DataFrame, unmod: DataFrame | None) -> DataFrame:
    """KEY, base, m_stop, m_mut, u_stop, u_mut; positions without a control are dropped, without a control table its rates are 0."""
    m = signal_rates(mod).select(*KEY, "base", F.col("stop").alias("m_stop"), F.col("mutation").alias("m_mut"))
    if unmod is None:
        return m.withColumn("u_stop", F.lit(0.0)).withColumn("u_mut", F.lit(0.0))
    u = signal_rates(unmod).select(*KEY, F.col("stop").alias("u_stop"), F.col("mutation").alias("u_mut"))
    return m.join(u, KEY)


def _signal(method: str, mod: Column, unmod: Column, k: Column | float, pseudocount: float) -> Column:
    match method.lower():
        case "kfactor":
            return C.k_corrected(mod, unmod, k)
        case "ding":
            return C.log_difference(mod, unmod, pseudocount)
        case "rouskin" | "zubradt" | "current":
            return mod
        case "siegfried":
            return mod - unmod
    raise ValueError(f"unknown method {method}")


def reactivity(pairs: DataFrame, stop_method: str = "kfactor", mutation_method: str = "kfactor", k_stop: float = 1.0, k_mutation: float = 1.0, snp_cutoff: float = 0.25, pseudocount: float = 1.0) -> DataFrame:
    """KEY, base, reactivity_stop, reactivity_mutation; both NaN where the control's mutation rate reaches the SNP cutoff."""
    stop = _signal(stop_method, F.col("m_stop"), F.col("u_stop"), k_stop, pseudocount)
    mut = _signal(mutation_method, F.col("m_mut"), F.col("u_mut"), k_mutation, pseudocount)
    mask = lambda x: C.mask_snp(x, F.col("u_mut"), snp_cutoff)
    return pairs.select(*KEY, "base", mask(stop).alias("reactivity_stop"), mask(mut).alias("reactivity_mutation"))


def is_background(chr_col: Column, file_name: str = "", gene: str | None = None) -> Column:
    """Rows for the background k: the given gene, or names (of contig or file) that tell of ribosomal RNA."""
    if gene:
        return chr_col == gene
    marks = ("rRNA", "16S", "18S")
    if any(m in file_name for m in marks):
        return F.lit(True)
    return chr_col.contains(marks[0]) | chr_col.contains(marks[1]) | chr_col.contains(marks[2])


def k_background(pairs: DataFrame, where: Column | None = None) -> DataFrame:
    """One row k_stop, k_mutation: mean modified over mean control rate; 1 where there is none."""
    p = pairs if where is None else pairs.where(where)
    a = p.agg(*[F.avg(c).alias(c) for c in ("m_stop", "m_mut", "u_stop", "u_mut")])
    k = lambda m, u: F.coalesce(F.when(F.col(u) > 0, F.col(m) / F.col(u)), F.lit(1.0))
    return a.select(k("m_stop", "u_stop").alias("k_stop"), k("m_mut", "u_mut").alias("k_mutation"))


#: Percentiles, interquartile range and MAD of three features of good data (p10, p25, p75, p90, iqr, mad), and their weights.
FEATURE_TARGETS = {
    "vs_low": (7.8414, 8.9416, 14.3412, 15.0563, 5.3996, 2.9901),
    "vs_overall": (4.4704, 4.6323, 5.4478, 5.7248, 0.8155, 0.4657),
    "correction": (0.3297, 0.4243, 0.7732, 0.7907, 0.3489, 0.1628),
}
FEATURE_WEIGHTS = {"vs_low": 2.5, "vs_overall": 2.0, "correction": 1.0}


def feature_loss(x: Column, name: str) -> Column:
    """0 within the quartiles, half the distance in IQRs up to the deciles, twice the distance in MADs beyond."""
    p10, p25, p75, p90, iqr, mad = FEATURE_TARGETS[name]
    near = F.when(x < p25, (p25 - x) / iqr).otherwise((x - p75) / iqr) * 0.5
    far = F.when(x < p10, (p10 - x) / mad).otherwise((x - p90) / mad) * 2.0
    return F.when((x >= p25) & (x <= p75), 0.0).when((x >= p10) & (x <= p90), near).otherwise(far)


def k_grid_losses(pairs: DataFrame, mod: str = "m_mut", unmod: str = "u_mut", low: float = 0.0, high: float = 2.0, step: float = 0.01) -> DataFrame:
    """k, loss over a grid of k: the features of the highest tenth against the 40-60 % band of modified rates.

    Thresholds are exact order statistics from value counts (85 % and 30-50 %
    where a band has fewer than 10 rows). Rows are combined to sums by the grid
    point up to which they count, a row a point at most; the grid meets only
    these.
    """
    vc = value_counts(pairs, [], mod)
    n = F.col("n")
    at = lambda p: at_index(F.least(F.floor(n * p / 100), n - 1))
    t = vc.agg(*[at(p).alias(f"p{p}") for p in (30, 40, 50, 60, 85, 90)])
    rows = pairs.select(F.col(mod).alias("m"), F.col(unmod).alias("u")).crossJoin(F.broadcast(t))
    count = lambda c: F.sum(c.cast("int"))
    strict = [F.col("m") >= F.col("p90"), (F.col("m") >= F.col("p40")) & (F.col("m") < F.col("p60"))]
    loose = [F.col("m") >= F.col("p85"), (F.col("m") >= F.col("p30")) & (F.col("m") < F.col("p50"))]
    sizes = rows.agg(*[count(c).alias(f"c{i}") for i, c in enumerate(strict + loose)])
    rows = rows.crossJoin(F.broadcast(sizes))
    use = (F.col("c0") >= 10) & (F.col("c1") >= 10)
    can = use | ((F.col("c2") >= 10) & (F.col("c3") >= 10))
    rows = rows.where(can).withColumn("is_high", F.when(use, strict[0]).otherwise(loose[0])).withColumn("is_low", F.when(use, strict[1]).otherwise(loose[1]))
    # m - k u is above 0 for the grid points below m / u: sums by the last of these points, then for each k over the rows that reach it
    points = int(round((high - low) / step)) + 1
    last = F.when(F.col("u") > 0, F.ceil((F.col("m") / F.col("u") - low) / step) - 1).otherwise(F.when(F.col("m") > 0, F.lit(points - 1)).otherwise(F.lit(-1)))
    rows = rows.withColumn("last", F.greatest(F.lit(-1), F.least(last, F.lit(points - 1))).cast("int"))
    sets = {"hi": F.col("is_high"), "lo": F.col("is_low"), "every": F.lit(True)}
    sums = [F.sum(F.when(c, F.col(v))).alias(f"{v}_{n}") for n, c in sets.items() for v in ("m", "u")] + [F.sum(c.cast("long")).alias(f"n_{n}") for n, c in sets.items()]
    table = rows.groupBy("last").agg(*sums)
    whole = table.agg(*[F.sum(f"n_{n}").alias(f"n_{n}") for n in sets], F.sum("m_hi").alias("m_hi"))
    grid = rows.sparkSession.range(points).select(F.col("id").alias("i"), (F.lit(low) + F.col("id") * F.lit(step)).alias("k"))
    reach = grid.join(F.broadcast(table.select("last", *[f"{v}_{n}" for n in sets for v in ("m", "u")])), F.col("last") >= F.col("i"), "left")
    part = lambda n: F.coalesce(F.sum(f"m_{n}"), F.lit(0.0)) - F.col("k") * F.coalesce(F.sum(f"u_{n}"), F.lit(0.0))
    f = reach.groupBy("k").agg(*[part(n).alias(n) for n in sets]).crossJoin(F.broadcast(whole))
    f = f.select("k", *[(F.col(n) / F.col(f"n_{n}")).alias(n) for n in sets], (F.col("m_hi") / F.col("n_hi")).alias("hi_m"))
    feature = {"vs_low": F.col("hi") / F.col("lo"), "vs_overall": F.col("hi") / F.col("every"), "correction": F.when(F.col("hi_m") > 0, F.col("hi") / F.col("hi_m")).otherwise(0.0)}
    f = f.where((F.col("lo") > 0) & (F.col("every") > 0))
    return f.select("k", sum(FEATURE_WEIGHTS[c] * feature_loss(e, c) for c, e in feature.items()).alias("loss"))


def k_distribution(pairs: DataFrame, **grid) -> DataFrame:
    """One row k, loss: the least loss, ties to the smaller k; no row where the bands are too small."""
    losses = k_grid_losses(pairs, **grid)
    return losses.agg(F.min(F.struct(F.round("loss", 9).alias("l"), "k")).alias("b")).where("b is not null").select("b.k", F.col("b.l").alias("loss"))


def k_metrics(labelled: DataFrame, mod: str = "m_mut", unmod: str = "u_mut", low: float = 0.1, high: float = 3.0) -> DataFrame:
    """Metrics of every k from ``low`` to ``high`` by .01 against a structure (column is_single).

    k, auc, sensitivity, specificity (at the best Youden index), negative_ratio,
    zero counts and ratios of paired and single positions, score. Rows of equal
    rates are counted first; what is left of one molecule meets the 291 k in
    one aggregation, and one window per k.
    """
    grid = labelled.sparkSession.range(round(low * 100), round(high * 100) + 1).select((F.col("id") / 100.0).alias("k"))
    some = labelled.groupBy(F.col(mod).alias("m"), F.col(unmod).alias("u"), F.col("is_single").alias("s")).agg(F.count("*").alias("c"))
    x = some.crossJoin(F.broadcast(grid)).withColumn("raw", F.col("m") - F.col("k") * F.col("u"))
    x = x.withColumn("r", F.greatest("raw", F.lit(0.0)))
    one = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0))
    per = x.groupBy("k", "r").agg(one(F.col("s")).alias("p"), one(~F.col("s")).alias("q"), one(F.col("raw") < 0).alias("neg"))
    down = W.partitionBy("k").orderBy(F.col("r").desc())
    every = W.partitionBy("k")
    per = per.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("q").over(down)).withColumn("n_pos", F.sum("p").over(every)).withColumn("n_neg", F.sum("q").over(every)).where("n_pos > 0 and n_neg > 0")
    per = per.withColumn("youden", F.col("tp") / F.col("n_pos") - F.col("fp") / F.col("n_neg"))
    m = per.groupBy("k").agg(
        (F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0)) / (F.max("n_pos") * F.max("n_neg"))).alias("auc"),
        F.max(F.struct("youden", "r", (F.col("tp") / F.col("n_pos")).alias("sens"), (1.0 - F.col("fp") / F.col("n_neg")).alias("spec"))).alias("b"),
        (F.sum("neg") / (F.max("n_pos") + F.max("n_neg"))).alias("negative_ratio"),
        F.coalesce(F.sum(F.when(F.col("r") == 0, F.col("q"))), F.lit(0)).alias("zero_paired"),
        F.coalesce(F.sum(F.when(F.col("r") == 0, F.col("p"))), F.lit(0)).alias("zero_single"),
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
    )
    neg, zs, zp = F.col("negative_ratio"), F.col("zero_single") / F.col("n_pos"), F.col("zero_paired") / F.col("n_neg")
    penalty = F.when(neg > 0.5, 2.0 * F.pow(neg - 0.5, F.lit(2.0))).when(neg > 0.3, 0.5 * (neg - 0.3) / 0.2).otherwise(0.1 * neg / 0.3)
    penalty = penalty + F.when(zs > 0.3, F.when(zs - zp > 0.1, zs - zp).otherwise(0.5 * zs)).otherwise(0.0)
    score = 0.4 * F.col("auc") + 0.35 * F.col("b.sens") + 0.25 * F.col("b.spec") - penalty
    return m.select("k", "auc", F.col("b.sens").alias("sensitivity"), F.col("b.spec").alias("specificity"), "negative_ratio", "zero_paired", "zero_single", zp.alias("zero_ratio_paired"), zs.alias("zero_ratio_single"), score.alias("score"))


def k_structure(labelled: DataFrame, mod: str = "m_mut", unmod: str = "u_mut") -> float | None:
    """The k that scores best against a structure: coarse steps from the best of .7-1.3, then steps of .01 around.

    The metrics of all 291 candidates come from ``k_metrics``; only that table
    (bounded by the grid) is walked on the driver.
    """
    rows = {round(r["k"] * 100): r for r in k_metrics(labelled, mod, unmod).collect()}
    start = [(k, rows[k]["score"]) for k in range(70, 131, 10) if k in rows]
    if not start:
        return None
    best, best_score = max(start, key=lambda x: x[1])
    mean = lambda v: sum(v) / len(v) if v else -1.0
    left, right = mean([s for k, s in start if k < 100]), mean([s for k, s in start if k > 100])
    if best == 100:
        ways = [10] if right > left else [-10]
    elif best > 100:
        ways = [10] if right >= left else [10, -10]
    else:
        ways = [-10] if left >= right else [10, -10]

    def walk(way: int) -> tuple[float, int]:
        k, top, top_k, last, drops = best, best_score, best, best_score, 0
        zp, zs = rows[best]["zero_paired"], rows[best]["zero_single"]
        for _ in range(20):
            k += way
            if not 10 <= k <= 300:
                break
            r = rows.get(k)
            if r is None:
                drops += 1
            else:
                if r["zero_paired"] <= zp and r["zero_single"] > zs and zp > 0:
                    break
                zp, zs, score = r["zero_paired"], r["zero_single"], r["score"]
                if score > top:
                    top, top_k, drops = score, k, 0
                else:
                    drops = drops + 1 if score < last else 0
                last = score
            if drops >= 3:
                break
        return top, top_k

    found = max((walk(w) for w in ways), key=lambda x: x[0])
    if found[0] > best_score:
        best = found[1]
    fine = [(rows[k]["score"], -abs(k - best), k) for k in range(max(10, best - 9), best + 10) if k in rows and not math.isnan(rows[k]["score"])]
    return max(fine)[2] / 100.0
