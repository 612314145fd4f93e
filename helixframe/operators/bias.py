"""Depth correction for PCR bias: a chi-square curve of mutation rate over depth, fitted to binned medians."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.orderstat import at_index, upper_median, value_counts

#: Bins, grid points, bounds of the amplitude, least scale, valid rates.
N_BINS, N_GRID = 50, 120
A_BOUNDS = (1e-6, 100.0)
LEAST_SCALE = 1e-3
MAX_RATE = 0.1


def valid_points(pileup: DataFrame) -> DataFrame:
    """depth, rate of the rows that the fit uses: 0 < mutation rate <= 0.1."""
    r = pileup.where("depth > 0").select(F.col("depth").cast("double").alias("depth"), (F.col("mut_count") / F.col("depth")).alias("rate"))
    return r.where((F.col("rate") > 0) & (F.col("rate") <= MAX_RATE))


def depth_bins(points: DataFrame, bins: int = N_BINS) -> DataFrame:
    """bin, depth, rate: upper medians of equal-width, right-closed depth bins (the first also closed on the left)."""
    edge = points.agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    x = points.crossJoin(F.broadcast(edge)).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    b = F.when(F.col("w") <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("depth") - F.col("lo")) / F.col("w"))))).cast("int")
    x = x.select(b.alias("bin"), "depth", "rate")
    return upper_median(x, ["bin"], "depth", "depth").join(upper_median(x, ["bin"], "rate", "rate"), "bin").select("bin", "depth", "rate")


def grid_fit(bins: DataFrame, points: int = N_GRID) -> DataFrame:
    """scale, a, sse for every point of the log grid of scales: a in closed form, within its bounds."""
    b = bins.where("rate > 0")
    spark = bins.sparkSession
    top = value_counts(b, [], "depth").agg((at_index(F.floor(F.col("n") / 2)) * 0.2).alias("top"))
    grid = spark.range(points).crossJoin(F.broadcast(top.where("top is not null"))).select(
        F.exp(F.log(F.lit(LEAST_SCALE)) + (F.log(F.greatest("top", F.lit(LEAST_SCALE * 2))) - F.log(F.lit(LEAST_SCALE))) * F.col("id") / (points - 1)).alias("scale")
    )
    x = b.crossJoin(F.broadcast(grid)).withColumn("g", 0.5 * F.exp(-F.greatest("depth", F.lit(1e-10)) / (2.0 * F.col("scale"))))
    s = x.groupBy("scale").agg(F.sum(F.col("rate") * F.col("g")).alias("yg"), F.sum(F.col("g") * F.col("g")).alias("gg"), F.sum(F.col("rate") * F.col("rate")).alias("yy"), F.count("*").alias("n"))
    a = F.when(F.col("gg") > 0, F.least(F.greatest(F.col("yg") / F.col("gg"), F.lit(A_BOUNDS[0])), F.lit(A_BOUNDS[1]))).otherwise(F.lit(A_BOUNDS[0]))
    s = s.withColumn("a", a)
    return s.select("scale", "a", (F.col("yy") - 2 * F.col("a") * F.col("yg") + F.col("a") * F.col("a") * F.col("gg")).alias("sse"), "n")


def fit(pileup: DataFrame) -> dict[str, float] | None:
    """Best scale and amplitude, r2 and target; None below 10 points or 5 bins.

    The grid's best cell is searched further where it is an edge cell; the
    driver sees at most N_GRID + N_BINS rows.
    """
    points = valid_points(pileup)
    n, top = points.agg(F.count("*"), F.max("depth")).first()
    if n < 10:
        return None
    rows = [(r["depth"], r["rate"]) for r in depth_bins(points).where("rate > 0").collect()]
    if len(rows) < 5:
        return None
    d, y = (np.array(c, float) for c in zip(*sorted(rows), strict=True))
    hi = max(0.2 * float(d[len(d) // 2]), 2 * LEAST_SCALE)

    def best_a(scale: float) -> tuple[float, float]:
        g = 0.5 * np.exp(-np.maximum(d, 1e-10) / (2 * scale))
        a = float(np.clip((y @ g) / max(g @ g, 1e-300), *A_BOUNDS))
        return float(((y - a * g) ** 2).sum()), a

    grid = np.geomspace(LEAST_SCALE, hi, N_GRID)
    sse = [best_a(s)[0] for s in grid]
    i = int(np.argmin(sse))
    scale = float(grid[i])
    if i in (0, N_GRID - 1):  # an edge cell: golden-section search inside it
        lo, up = (grid[0], grid[1]) if i == 0 else (grid[-2], grid[-1])
        for _ in range(60):
            a, b = up - 0.618 * (up - lo), lo + 0.618 * (up - lo)
            lo, up = (lo, b) if best_a(a)[0] < best_a(b)[0] else (a, up)
        scale = float(min((scale, (lo + up) / 2), key=lambda s: best_a(s)[0]))
    err, a = best_a(scale)
    total = float(((y - y.mean()) ** 2).sum())
    line = np.sort(a * 0.5 * np.exp(-np.maximum(np.linspace(0, 1.2 * top, 200), 1e-10) / (2 * scale)))
    target = float((line[99] + line[100]) / 2)
    if target <= 1e-6:
        target = float(upper_median(points.withColumn("k", F.lit(1)), ["k"], "rate").first()["median"])
    return {"scale": scale, "a": a, "r2": 1 - err / total if total > 0 else 0.0, "target": target}


def correct(pileup: DataFrame, weight_increase: float = 1.0, weight_decrease: float = 0.5, drop_invalid: bool = False, species: str | None = None) -> DataFrame:
    """``pileup`` with effective_depth from the fitted curve.

    Rows without a valid rate keep their depth (1 at least), or go with
    ``drop_invalid``. ``weight_decrease`` is accepted for the fixed-parameter
    form and has no effect here. Raises ValueError if there are too few points.
    """
    if species and "species" in pileup.columns:
        pileup = pileup.where(F.col("species") == species)
    f = fit(pileup)
    if f is None:
        raise ValueError("too few valid points for the depth fit")
    d = F.col("depth").cast("double")
    r = F.when(F.col("depth") > 0, F.col("mut_count") / F.col("depth")).otherwise(0.0)
    ok = (r > 0) & (r <= MAX_RATE)
    factor = C.correction_factor(C.chi_square_model(d, F.lit(f["a"]), F.lit(f["scale"])), F.lit(f["target"]), d, weight_increase)
    out = pileup.withColumn("effective_depth", F.when(ok, C.corrected_depth(d, factor)).otherwise(F.greatest(F.col("depth"), F.lit(1).cast("long"))))
    return out.where(ok) if drop_invalid else out


def correct_fixed(pileup: DataFrame, weight_increase: float = 1.0, weight_decrease: float = 0.5) -> DataFrame:
    """effective_depth by fixed parameters, row by row (single cells)."""
    r = F.when(F.col("depth") > 0, F.col("mut_count") / F.col("depth")).otherwise(0.0)
    return pileup.withColumn("effective_depth", C.fixed_effective_depth(F.col("depth").cast("double"), r, weight_increase, weight_decrease))
