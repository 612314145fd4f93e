"""Joins and windows on intervals, by bins and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def bins_of(start: Column, end: Column, width: int) -> Column:
    """Numbers of the bins that a closed interval touches; none for an empty interval."""
    lo, hi = F.floor(start / width), F.floor(end / width)
    return F.when(end >= start, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def points_in_ranges(points: DataFrame, ranges: DataFrame, keys: list[tuple[str, str]], point: str, start: str, end: str, width: int = 4096, how: str = "inner") -> DataFrame:
    """Points joined to every closed range that holds them.

    ``keys``: pairs (point column, range column) that must be equal. Ranges are
    copied to the bins they touch, points have one bin, so the join is an
    equi-join on keys and bin that AQE can broadcast or split; every pair comes
    out once.
    """
    r = ranges.withColumn("_bin", F.explode(bins_of(F.col(start), F.col(end), width)))
    cond = [points[a] == r[b] for a, b in keys] + [F.floor(points[point] / width) == r["_bin"], points[point] >= r[start], points[point] <= r[end]]
    out = points.join(r, cond, how)
    drop = [r[b] for a, b in keys if a == b]
    for c in drop:
        out = out.drop(c)
    return out.drop("_bin")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, distance: int) -> DataFrame:
    """Pairs with equal keys and |a - b| <= distance: the right side goes to its bin and both neighbours."""
    width = distance + 1
    l = left.withColumn("_bin", F.floor(F.col(a) / width))
    r = right.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(b) / width) + d for d in (-1, 0, 1)])))
    return l.join(r, [*keys, "_bin"]).where(F.abs(F.col(a) - F.col(b)) <= distance).drop("_bin")


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 5000) -> DataFrame:
    """Intervals of a group merged while the next one starts within ``gap`` of the end so far."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(w)).groupBy(*keys, "_g").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_g")


def contiguous_runs(df: DataFrame, keys: list[str], pos: str = "pos", max_gap: int = 4, min_length: int = 3) -> DataFrame:
    """Rows of runs of positions with gaps of at most ``max_gap`` and at least ``min_length`` members."""
    w = W.partitionBy(*keys).orderBy(pos)
    df = df.withColumn("_new", F.when(F.col(pos) - F.lag(pos).over(w) <= max_gap, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return df.withColumn("_n", F.count("*").over(W.partitionBy(*keys, "_run"))).where(F.col("_n") >= min_length).drop("_new", "_run", "_n")


def window_plan(bounds: DataFrame, size: int = 100, step: int = 50) -> DataFrame:
    """Sliding windows of each row of ``bounds`` (keys, start, end): win_start, win_end, the last ones clipped.

    Starts go from ``start`` in steps while they are below the end; a last
    window starts at the end itself.
    """
    starts = F.array_distinct(F.concat(F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("end") - 1), F.lit(step)), F.array("end")))
    return bounds.withColumn("win_start", F.explode(starts)).withColumn("win_end", F.least(F.col("win_start") + (size - 1), F.col("end")))


def windows_of(pos: Column, start: Column, end: Column, size: int = 100, step: int = 50) -> Column:
    """Starts of all windows of ``window_plan`` that hold a position, in closed form."""
    first = F.greatest(F.lit(0), F.ceil((pos - start - (size - 1)) / step)).cast("int")
    last = F.floor((pos - start) / step).cast("int")
    grid = F.filter(F.transform(F.sequence(first, F.greatest(first, last)), lambda i: (start + i * step).cast("int")), lambda s: ((s < end) | (s == start)) & (s <= pos))
    return F.array_distinct(F.concat(grid, F.when(pos == end, F.array(end.cast("int"))).otherwise(F.array().cast("array<int>"))))
