"""Normalisation of reactivity per (chr, strand) and signal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import linear_remap
from ..functions.orderstat import at_index, slice_sum, value_counts

GROUP = ["chr", "strand"]


def group_scale(df: DataFrame, value: str, method: str, keys: list[str] = GROUP, compat: bool = False) -> DataFrame:
    """keys, low, high, divisor: clip bounds (null: none) and what to divide by.

    percentile28: mean of the 2-10 % slice from the top (``compat``: from the
    bottom, as the established tool computes it); groups below 10 values stay.
    winsor90: clip at 5 % and 95 %, divide by the upper bound (1e-6 at least);
    groups below 2 stay. boxplot: mean of the top tenth (``compat``: lowest
    tenth) of the values up to Q3 + 1.5 IQR; groups below 4 stay. NaN and null
    values take no part.
    """
    vc = value_counts(df, keys, value)
    n = F.col("n")
    none = F.lit(None).cast("double")
    if method == "percentile28":
        a, b = F.ceil(n * 0.02), F.ceil(n * 0.10)
        first, last = (a, b) if compat else (n - b, n - a)
        s = vc.groupBy(*keys).agg(F.first("n").alias("n"), (slice_sum(first, last) / F.first(F.when(b > a, (b - a).cast("double")))).alias("m"))
        div = F.when((F.col("n") >= 10) & (F.col("m") > 0), F.col("m")).otherwise(1.0)
        return s.select(*keys, none.alias("low"), none.alias("high"), div.alias("divisor"))
    if method == "winsor90":
        cap = n - 1
        s = vc.groupBy(*keys).agg(F.first("n").alias("n"), at_index(F.least(F.floor(n * 0.05), cap)).alias("low"), at_index(F.least(F.ceil(n * 0.95), cap)).alias("high"))
        on = F.col("n") >= 2
        return s.select(*keys, F.when(on, F.col("low")).alias("low"), F.when(on, F.col("high")).alias("high"), F.when(on, F.greatest("high", F.lit(1e-6))).otherwise(1.0).alias("divisor"))
    if method == "boxplot":
        q = vc.groupBy(*keys).agg(F.first("n").alias("n0"), at_index(F.least(F.ceil(n * 0.25), n - 1)).alias("q1"), at_index(F.least(F.ceil(n * 0.75), n - 1)).alias("q3"))
        fence = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
        kept = vc.join(q, keys).where(F.col("v") <= fence).withColumn("kept", F.sum("c").over(W.partitionBy(*keys)))
        k = F.ceil(F.col("kept") * 0.1)
        first, last = (F.lit(0), k) if compat else (F.col("kept") - k, F.col("kept"))
        s = kept.groupBy(*keys).agg(F.first("n0").alias("n"), (slice_sum(first, last) / F.first(k.cast("double"))).alias("m"))
        return s.select(*keys, none.alias("low"), none.alias("high"), F.when((F.col("n") >= 4) & (F.col("m") > 0), F.col("m")).otherwise(1.0).alias("divisor"))
    raise ValueError(f"unknown method {method}")


def scaled(x: Column, low: Column, high: Column, divisor: Column) -> Column:
    """NaN and null stay; the rest clipped and divided."""
    clipped = F.when(low.isNotNull() & (x < low), low).when(high.isNotNull() & (x > high), high).otherwise(x)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(clipped / F.coalesce(divisor, F.lit(1.0)))


def normalize(df: DataFrame, method: str, signals: tuple[str, ...] = ("reactivity_stop", "reactivity_mutation"), keys: list[str] = GROUP, linear: bool = False, compat: bool = False) -> DataFrame:
    """Each signal scaled per group, then, with ``linear``, remapped piecewise. Other columns stay.

    The scales are one row per group and join back on the group.
    """
    cols = df.columns
    for s in signals:
        scale = group_scale(df, s, method, keys, compat)
        df = df.join(scale, keys, "left").withColumn(s, scaled(F.col(s), F.col("low"), F.col("high"), F.col("divisor"))).drop("low", "high", "divisor")
        if linear:
            top = df.where(~F.isnan(s)).groupBy(*keys).agg(F.max(s).alias("_top"))
            df = df.join(top, keys, "left").withColumn(s, linear_remap(F.col(s), F.coalesce("_top", F.lit(0.0)))).drop("_top")
    return df.select(*cols)


def top_slice_scale(df: DataFrame, value: str, keys: list[str] = GROUP, skip_head: int = 32, skip_tail: int = 32, order: str = "pos") -> DataFrame:
    """Divide by the mean of the top 10-20 % of values, the first and last positions of a group left out of the statistics."""
    w = W.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(order))
    df2 = df.withColumn("_i", i).withColumn("_n", F.count("*").over(w))
    core = df2.where((F.col("_i") > skip_head) & (F.col("_i") <= F.col("_n") - skip_tail))
    vc = value_counts(core, keys, value)
    n = F.col("n")
    a, b = F.ceil(n * 0.1), F.ceil(n * 0.2)
    s = vc.groupBy(*keys).agg((slice_sum(n - b, n - a) / F.first(F.when(b > a, (b - a).cast("double")))).alias("_m"))
    return df.join(s, keys, "left").withColumn(value, F.when(F.col("_m") > 0, F.col(value) / F.col("_m")).otherwise(F.col(value))).drop("_m")


def dynamic_windows(df: DataFrame, value: str, keys: list[str] = GROUP, size: int = 50, least: int = 10) -> DataFrame:
    """Winsorised scaling inside windows that grow until they hold ``least`` finite values.

    Windows are runs of blocks of ``size`` rows, as they grow by whole blocks.
    Only the blocks' counts are walked in order, one pandas call per group on a
    row a block; order statistics are window functions within windows.
    """
    finite = F.col(value).isNotNull() & ~F.isnan(value)
    rows = df.withColumn("_block", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy("pos")) - 1) / size))
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.when(finite, 1)).alias("_n"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_block")
        window, held, out = 0, 0, []
        for n in g["_n"]:
            out.append(window)
            held += n
            if held >= least:
                window, held = window + 1, 0
        return g.assign(_window=out)[[*keys, "_block", "_window"]]

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    named = rows.join(counts.groupBy(*keys).applyInPandas(run, f"{schema}, _block long, _window long"), [*keys, "_block"])
    v = F.when(finite, F.col(value))
    every = W.partitionBy(*keys, "_window")
    named = named.withColumn("_i", F.row_number().over(every.orderBy(v.asc_nulls_last())) - 1).withColumn("_n", F.count(v).over(every))
    at = lambda i: F.max(F.when(F.col("_i") == i, v)).over(every)
    named = named.withColumn("_lo", at(F.floor(F.col("_n") * 0.05))).withColumn("_hi", at(F.least(F.ceil(F.col("_n") * 95 / 100), F.col("_n") - 1)))
    scaled_ = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi")) / F.greatest("_hi", F.lit(1e-6))
    return named.withColumn(value, F.when(finite & (F.col("_n") >= 2), scaled_).otherwise(F.col(value))).select(*df.columns)


def cross_sample(df: DataFrame, value: str, sample: str = "sample", site: list[str] = ["chr", "strand", "pos"], method: str = "median") -> DataFrame:  # noqa: B006
    """Make samples comparable: median (divide by the sample's median), robust (median and MAD) or quantile (mean of equal ranks)."""
    from ..functions.orderstat import mad, upper_median

    if method == "median":
        m = upper_median(df, [sample], value, "_m")
        return df.join(m, [sample]).withColumn(value, F.when(F.col("_m") != 0, F.col(value) / F.col("_m")).otherwise(F.col(value))).drop("_m")
    if method == "robust":
        m = upper_median(df, [sample], value, "_m").join(mad(df, [sample], value), [sample])
        return df.join(m, [sample]).withColumn(value, F.when(F.col("mad") > 0, (F.col(value) - F.col("_m")) / F.col("mad")).otherwise(F.col(value) - F.col("_m"))).drop("_m", "mad")
    if method == "quantile":
        r = df.withColumn("_r", F.row_number().over(W.partitionBy(sample).orderBy(value, *site)))
        mean = r.groupBy("_r").agg(F.avg(value).alias("_mean"))
        return r.join(mean, "_r").withColumn(value, F.col("_mean")).drop("_r", "_mean")
    raise ValueError(f"unknown method {method}")
