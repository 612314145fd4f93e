"""Regions of difference along a strand: windowed tests, scan statistics, runs of significant sites."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import stats

GROUP = ["chr", "strand"]

#: Tasks that share a strand's shuffles.
SHARES = 8


def window_tests(pairs: DataFrame, radius: int = 2, keys: list[str] = GROUP, compat: bool = False) -> DataFrame:
    """keys, pos, p_value: signed-rank test over the ``2 radius + 1`` neighbours (by rank of position) of each site.

    ``pairs``: keys, pos, value1, value2. Each row is copied to the windows it
    belongs to, so a long strand spreads over tasks by (strand, centre).
    """
    i = W.partitionBy(*keys).orderBy("pos")
    n = pairs.withColumn("i", F.row_number().over(i))
    long = n.withColumn("centre", F.explode(F.sequence(F.col("i") - radius, F.col("i") + radius))).join(n.select(*keys, F.col("i").alias("centre"), F.col("pos").alias("at")), [*keys, "centre"])
    rows = long.select(*keys, F.col("at").alias("pos"), F.col("i").alias("pair"), F.explode(F.array(F.struct(F.lit(1).alias("grp"), F.col("value1").alias("value")), F.struct(F.lit(2).alias("grp"), F.col("value2").alias("value")))).alias("x"))
    return stats.wilcoxon(rows.select(*keys, "pos", "pair", "x.grp", "x.value"), [*keys, "pos"], compat=compat).select(*keys, "pos", "p_value")


def scan_q(sites: DataFrame, min_len: int = 5, max_len: int = 50, keys: list[str] = GROUP) -> DataFrame:
    """keys, start, end, length, q of every window of ``min_len`` to ``max_len`` sites: sum of -ln p over sqrt(length).

    Prefix sums by one window function; the end of each window is found by an
    equi-join on (keys, index).
    """
    w = W.partitionBy(*keys).orderBy("pos")
    v = F.when(F.col("p_value") > 0, -F.log("p_value")).otherwise(0.0)
    s = sites.withColumn("i", F.row_number().over(w)).withColumn("upto", F.sum(v).over(w)).withColumn("before", F.col("upto") - v)
    a = s.select(*keys, F.col("pos").alias("start"), "before", F.explode(F.sequence(F.lit(min_len), F.lit(max_len))).alias("length"), (F.col("i") - 1).alias("i0")).withColumn("i", F.col("i0") + F.col("length"))
    b = s.select(*keys, "i", F.col("pos").alias("end"), "upto")
    return a.join(b, [*keys, "i"]).select(*keys, "start", "end", "length", ((F.col("upto") - F.col("before")) / F.sqrt(F.col("length").cast("double"))).alias("q"))


def q_threshold(sites: DataFrame, alpha: float = 0.05, iterations: int = 200, min_len: int = 5, max_len: int = 50, seed: int = 0, keys: list[str] = GROUP) -> DataFrame:
    """keys, threshold: the (1 - alpha) order statistic of the greatest q of shuffled sites.

    Shuffles are seeded by (keys, seed, iteration), so results are repeatable.
    A strand's p-values go to SHARES tasks, each of which makes a share of the
    shuffles; the strand must fit a task.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        name = [g[k].iloc[0] for k in keys]
        p = g.sort_values("pos")["p_value"].to_numpy()
        sorted_v = np.where(p > 0, -np.log(np.where(p > 0, p, 1.0)), 0.0)
        out = []
        for it in range(int(g["share"].iloc[0]), iterations + 1, SHARES):
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(repr((name, seed, it)).encode()).digest()[:8], "little"))
            v = sorted_v.copy()
            rng.shuffle(v)
            pre = np.concatenate([[0.0], np.cumsum(v)])
            best = max((float((pre[n:] - pre[:-n]).max()) / n**0.5 for n in range(min_len, min(max_len, len(v)) + 1)), default=float("-inf"))
            out.append({**dict(zip(keys, name, strict=True)), "iteration": it, "q": best})
        return pd.DataFrame(out, columns=[*keys, "iteration", "q"])

    schema = ", ".join(f"{k} {sites.schema[k].dataType.simpleString()}" for k in keys)
    tries = sites.select(*keys, "pos", "p_value", F.explode(F.sequence(F.lit(1), F.lit(min(SHARES, iterations)))).alias("share"))
    maxima = tries.groupBy(*keys, "share").applyInPandas(run, f"{schema}, iteration int, q double").where(F.col("q") > float("-inf"))
    r = maxima.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy("q")) - 1).withColumn("n", F.count("*").over(W.partitionBy(*keys)))
    return r.groupBy(*keys).agg(F.min(F.when(F.col("i") == F.round((1.0 - alpha) * (F.col("n") - 1)), F.col("q"))).alias("threshold"))


def diffscan_regions(pairs: DataFrame, alpha: float = 0.05, radius: int = 2, min_len: int = 5, max_len: int = 50, iterations: int = 200, seed: int = 0) -> DataFrame:
    """Scan windows whose q reaches the strand's threshold: chr, strand, start, end, length, q, threshold."""
    sites = window_tests(pairs, radius)
    t = q_threshold(sites, alpha, iterations, min_len, max_len, seed)
    return scan_q(sites, min_len, max_len).join(t, GROUP).where("q >= threshold")


def site_scores(pairs: DataFrame) -> DataFrame:
    """z_factor and z_score of each site from the two values (error 10 %, deviation 0.1), and whether both are high enough."""
    d = F.abs(F.col("value1") - F.col("value2"))
    return pairs.withColumn("z_factor", F.when(d == 0, 0.0).otherwise(1.0 - 1.96 * 0.1 * (F.col("value1") + F.col("value2")) / d)).withColumn("z_score", d / 0.1).withColumn("hit", (F.col("z_factor") > 0) & (F.col("z_score") >= 1.0))


def deltashape_regions(pairs: DataFrame, min_len: int = 5, max_len: int = 50, keys: list[str] = GROUP, compat: bool = False) -> DataFrame:
    """Runs of sites that start at a hit (``compat``: at each open site, hit or not), take up to ``max_len`` sites, end at the first miss after a hit, and hold hits in half their length.

    keys, start, end, z_factor, z_score (greatest of the run), hits. Runs that
    start at hits are the runs of hits, cut every ``max_len`` sites: window
    functions over the hits. With ``compat``, a run's end decides where the
    next begins, so a strand is one pandas call on four numbers per site.
    """
    if not compat:
        w = W.partitionBy(*keys).orderBy("pos")
        h = site_scores(pairs).withColumn("_i", F.row_number().over(w)).where("hit").withColumn("_run", F.col("_i") - F.row_number().over(w))
        h = h.withColumn("_part", F.floor((F.row_number().over(W.partitionBy(*keys, "_run").orderBy("pos")) - 1) / max_len))
        g = h.groupBy(*keys, "_run", "_part").agg(F.min("pos").cast("int").alias("start"), F.max("pos").cast("int").alias("end"), F.max("z_factor").alias("z_factor"), F.max("z_score").alias("z_score"), F.count("*").cast("int").alias("hits"))
        return g.where(F.col("hits") >= min_len).drop("_run", "_part")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        pos, zf, zs, hit = (g[c].to_numpy() for c in ("pos", "z_factor", "z_score", "hit"))
        rows, at = [], 0
        while at < len(pos):
            stop = min(at + max_len, len(pos))
            hits = np.flatnonzero(hit[at:stop])
            if not len(hits):
                at += 1  # nothing ahead within reach: this site alone
                continue
            misses = np.flatnonzero(~hit[at + hits[0] : stop])
            last = at + hits[0] + (int(misses[0]) if len(misses) else stop - at - int(hits[0])) - 1
            n = int(hit[at : last + 1].sum())
            length = last - at + 1
            if length >= min_len and n >= length // 2:
                on = np.append(np.flatnonzero(hit[at : last + 1]) + at, at)
                rows.append([g[k].iloc[0] for k in keys] + [int(pos[at]), int(pos[last]), float(zf[on].max()), float(zs[on].max()), n])
            at = last + 1
        return pd.DataFrame(rows, columns=[*keys, "start", "end", "z_factor", "z_score", "hits"])

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return site_scores(pairs).select(*keys, "pos", "z_factor", "z_score", "hit").groupBy(*keys).applyInPandas(run, f"{schema}, start int, end int, z_factor double, z_score double, hits int")
