"""Exact order statistics of groups.

Values are ranked by a window per group, or read from (value, count) tables
where groups are large: counts are combined map-side, and a running sum over
distinct values finds any index without ranking rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, v, below (values smaller than v), upto (values up to v), n (all values of the group). Null and NaN are left out."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    run = W.partitionBy(*keys).orderBy("v")
    counts = counts.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(W.partitionBy(*keys)))
    return counts.withColumn("below", F.col("upto") - F.col("c"))


def at_index(index: Column) -> Column:
    """Aggregate over ``value_counts``: the value at a 0-based index of the sorted group."""
    return F.min(F.when((F.col("below") <= index) & (index < F.col("upto")), F.col("v")))


def slice_sum(first: Column, last: Column) -> Column:
    """Aggregate over ``value_counts``: sum of the sorted values at indexes first <= i < last."""
    inside = F.greatest(F.least(F.col("upto"), last) - F.greatest(F.col("below"), first), F.lit(0))
    return F.sum(inside * F.col("v"))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Per group the value at index n // 2."""
    return value_counts(df, keys, value).groupBy(*keys).agg(at_index(F.floor(F.col("n") / 2)).alias(name))


def tie_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank", compat: bool = False) -> DataFrame:
    """Average ranks from 1; ``compat`` gives ranks that are 0.5 too small for each run of ties."""
    w = W.partitionBy(*keys).orderBy(value)
    ties = F.count("*").over(W.partitionBy(*keys, value))
    mean = F.rank().over(w) + (ties - 1) / 2.0
    return df.withColumn(name, mean - 0.5 if compat else mean)


def mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median absolute deviation times 1.4826, with the upper median."""
    mid = upper_median(df, keys, value, "_m")
    return upper_median(df.join(mid, keys).withColumn("_d", F.abs(F.col(value) - F.col("_m"))), keys, "_d", "mad").withColumn("mad", F.col("mad") * 1.4826)
