"""Alternative conformations: windows, read features, clusters and ensembles."""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import position_confidence
from .components import connected, cut
from .ranges import band_join, contiguous_runs, window_plan, windows_of

GROUP = ["chr", "strand"]
WINDOW = ["chr", "strand", "win_start"]


def clean_reactivity(reactivity: DataFrame) -> DataFrame:
    """chr, strand, pos, base, stop, mutation: finite rows, one per position (the first by value where a position repeats)."""
    r = reactivity.select(*GROUP, "pos", "base", F.col("reactivity_stop").alias("stop"), F.col("reactivity_mutation").alias("mutation"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    r = r.where(finite("stop") & finite("mutation"))
    return r.withColumn("_i", F.row_number().over(W.partitionBy(*GROUP, "pos").orderBy("stop", "mutation", "base"))).where("_i = 1").drop("_i")


def windows(sites: DataFrame, size: int = 100, step: int = 50) -> DataFrame:
    """chr, strand, win_start, win_end of the sliding windows over the positions of each strand."""
    return window_plan(sites.groupBy(*GROUP).agg(F.min("pos").alias("start"), F.max("pos").alias("end")), size, step).select(*WINDOW, "win_end")


def in_windows(rows: DataFrame, sites: DataFrame, pos: str = "pos", size: int = 100, step: int = 50) -> DataFrame:
    """``rows`` once for every window that holds their position (win_start); window starts in closed form, no range join."""
    b = sites.groupBy(*GROUP).agg(F.min("pos").alias("_s"), F.max("pos").alias("_e"))
    inside = rows.join(b, GROUP).where((F.col(pos) >= F.col("_s")) & (F.col(pos) <= F.col("_e")))
    return inside.withColumn("win_start", F.explode(windows_of(F.col(pos), F.col("_s"), F.col("_e"), size, step))).drop("_s", "_e")


def window_means(sites: DataFrame, size: int = 100, step: int = 50) -> DataFrame:
    """Positions and mean signals of every window."""
    return in_windows(sites, sites, "pos", size, step).groupBy(*WINDOW).agg(F.count("*").alias("positions"), F.avg("stop").alias("mean_stop"), F.avg("mutation").alias("mean_mutation"))


def read_events(aligned: DataFrame, ends: DataFrame, sites: DataFrame, reference: DataFrame) -> DataFrame:
    """chr, strand, read_id, pos, kind ('stop' or 'mutation') on tracked positions.

    ``aligned``: chr, strand, read_id, pos, read_base; ``ends``: chr, strand,
    read_id, pos of the stop; N and unknown reference bases are no mutations.
    """
    tracked = sites.select(*GROUP, "pos")
    m = aligned.join(reference.select("chr", "pos", F.col("base").alias("_ref")), ["chr", "pos"]).where(F.col("read_base").isin("A", "C", "G", "T") & F.col("_ref").isin("A", "C", "G", "T", "U") & (F.translate("_ref", "U", "T") != F.col("read_base")))
    both = m.select(*GROUP, "read_id", "pos", F.lit("mutation").alias("kind")).unionByName(ends.select(*GROUP, "read_id", "pos", F.lit("stop").alias("kind")))
    return both.join(tracked, [*GROUP, "pos"], "left_semi")


def read_features(events: DataFrame, sites: DataFrame, size: int = 100, step: int = 50) -> DataFrame:
    """WINDOW, read_id, stops, mutations, both (1 if a read has both): distinct positions per window and read."""
    w = in_windows(events, sites, "pos", size, step)
    g = w.groupBy(*WINDOW, "read_id").agg(F.countDistinct(F.when(F.col("kind") == "stop", F.col("pos"))).alias("stops"), F.countDistinct(F.when(F.col("kind") == "mutation", F.col("pos"))).alias("mutations"))
    return g.withColumn("both", ((F.col("stops") > 0) & (F.col("mutations") > 0)).cast("int"))


def feature_counts(features: DataFrame) -> DataFrame:
    """WINDOW, stops, mutations, both, reads: distinct vectors with multiplicities; all that clustering needs."""
    return features.groupBy(*WINDOW, "stops", "mutations", "both").agg(F.count("*").alias("reads"))


def standardize(counts: DataFrame) -> DataFrame:
    """Features of distinct vectors centred and scaled per window by the read-weighted population deviation (below 1e-6: 1)."""
    w = W.partitionBy(*WINDOW)
    n = F.sum("reads").over(w)
    out = counts
    for c in ("stops", "mutations", "both"):
        mean = F.sum(F.col(c) * F.col("reads")).over(w) / n
        sd = F.sqrt(F.greatest(F.sum(F.col(c) * F.col(c) * F.col("reads")).over(w) / n - mean * mean, F.lit(0.0)))
        out = out.withColumn(f"z_{c}", (F.col(c) - mean) / F.when(sd < 1e-6, 1.0).otherwise(sd))
    return out


def dbscan_weighted(points: np.ndarray, weight: np.ndarray, eps: float = 0.75, min_samples: int = 5) -> np.ndarray:
    """DBSCAN labels (0: noise, clusters from 1) of distinct points that stand for ``weight`` equal ones each.

    Core points have at least ``min_samples`` points, themselves included,
    within ``eps``. Clusters are numbered by their least core point in
    lexicographic order; a border point goes to the lowest numbered cluster
    near it, so labels do not depend on the order of input.
    """
    order = np.lexsort(points.T[::-1])
    p, w = points[order], weight[order]
    near = ((p[:, None, :] - p[None, :, :]) ** 2).sum(2) <= eps * eps + 1e-12
    core = near @ w >= min_samples
    label = np.zeros(len(p), int)
    k = 0
    for i in np.flatnonzero(core):
        if label[i]:
            continue
        k += 1
        front = np.zeros(len(p), bool)
        front[i] = True
        while front.any():
            label[front] = k
            front = near[front].any(0) & core & (label == 0)
    for i in np.flatnonzero(~core):
        c = label[near[i] & core]
        label[i] = c[c > 0].min() if (c > 0).any() else 0
    out = np.zeros(len(p), int)
    out[order] = label
    return out


def cluster_windows(features: DataFrame, eps: float = 0.75, min_samples: int = 5) -> DataFrame:
    """WINDOW, stops, mutations, both, reads, cluster, status for every distinct vector of a window.

    Windows with fewer than ``min_samples`` reads make one cluster of their own
    (status insufficient_reads); windows without a cluster are low_density.
    A pandas call sees a window's distinct vectors, tens of rows, however many
    reads there are.
    """
    z = standardize(feature_counts(features))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n = int(g["reads"].sum())
        if n < min_samples:
            g["cluster"], g["status"] = 1, "insufficient_reads"
        else:
            g["cluster"] = dbscan_weighted(g[["z_stops", "z_mutations", "z_both"]].to_numpy(float), g["reads"].to_numpy(), eps, min_samples)
            g["status"] = "ok" if (g["cluster"] > 0).any() else "low_density"
        return g[[*WINDOW, "stops", "mutations", "both", "reads", "cluster", "status"]]

    return z.groupBy(*WINDOW).applyInPandas(run, "chr string, strand string, win_start int, stops long, mutations long, both int, reads long, cluster int, status string")


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """Per window and cluster: reads, occupancy, mean features, share of reads with both, noise flag."""
    total = W.partitionBy(*WINDOW)
    wavg = lambda c: F.sum(F.col(c) * F.col("reads")) / F.sum("reads")
    g = clusters.groupBy(*WINDOW, "cluster").agg(F.sum("reads").alias("reads"), wavg("stops").alias("mean_stops"), wavg("mutations").alias("mean_mutations"), wavg("both").alias("dual_share"), F.first("status").alias("status"))
    return g.withColumn("occupancy", F.col("reads") / F.sum("reads").over(total)).withColumn("noise", F.col("cluster") == 0)


def cluster_positions(events: DataFrame, features: DataFrame, clusters: DataFrame, sites: DataFrame, size: int = 100, step: int = 50) -> DataFrame:
    """WINDOW, cluster, pos, reads, stops, mutations: reads of each cluster with an event at a position (noise left out)."""
    named = features.join(clusters.select(*WINDOW, "stops", "mutations", "both", "cluster"), [*WINDOW, "stops", "mutations", "both"]).where("cluster > 0").select(*WINDOW, "read_id", "cluster")
    w = in_windows(events.distinct(), sites, "pos", size, step).join(named, [*WINDOW, "read_id"])
    return w.groupBy(*WINDOW, "cluster", "pos").agg(
        F.countDistinct("read_id").alias("reads"), F.sum((F.col("kind") == "stop").cast("long")).alias("stops"), F.sum((F.col("kind") == "mutation").cast("long")).alias("mutations")
    )


def confidence(positions: DataFrame, sites: DataFrame) -> DataFrame:
    """``positions`` with confidence: reads and signal, raised by .15 (up to 1) beside a strong neighbour within 2 positions."""
    near = W.partitionBy(*GROUP).orderBy("pos").rangeBetween(-2, 2)
    s = sites.withColumn("_top", F.greatest("stop", "mutation")).withColumn("_near", F.max("_top").over(near))
    j = positions.join(s.select(*GROUP, "pos", "stop", "mutation", "_top", "_near"), [*GROUP, "pos"])
    c = position_confidence(F.col("reads").cast("double"), F.col("stop"), F.col("mutation"))
    boost = (F.col("_top") < 0.7) & (F.col("_near") >= 0.7)
    return j.withColumn("confidence", F.when(boost, F.least(c + 0.15, F.lit(1.0))).otherwise(c)).drop("_top", "_near", "stop", "mutation")


def cluster_scores(scored: DataFrame) -> DataFrame:
    """Read-weighted mean confidence of each cluster over its contiguous positions (gaps up to 4, runs of 3)."""
    runs = contiguous_runs(scored, [*WINDOW, "cluster"])
    return runs.groupBy(*WINDOW, "cluster").agg((F.sum(F.col("confidence") * F.col("reads")) / F.sum("reads")).alias("confidence"), F.count("*").alias("positions"))


def shared_pairs(positions: DataFrame, node: str = "node") -> DataFrame:
    """Pairs of nodes a < b of one strand with shared positions: shared, and the correlation of their reads there.

    The join is on (strand, position): its size is that of the sharing, as a
    position has the clusters of the few windows that hold it, and pairs come
    out aggregated.
    """
    p = positions.select(*GROUP, "pos", F.col(node).alias("n"), F.col("reads").cast("double").alias("r"))
    a, b = p.select(*GROUP, "pos", F.col("n").alias("a"), F.col("r").alias("ra")), p.select(*GROUP, "pos", F.col("n").alias("b"), F.col("r").alias("rb"))
    g = a.join(b, [*GROUP, "pos"]).where("a < b").groupBy(*GROUP, "a", "b").agg(F.count("*").alias("shared"), F.covar_pop("ra", "rb").alias("cov"), F.var_pop("ra").alias("va"), F.var_pop("rb").alias("vb"))
    flat = (F.col("shared") < 3) | (F.col("va") <= 1e-10) | (F.col("vb") <= 1e-10)
    return g.withColumn("corr", F.when(~flat, F.col("cov") / F.sqrt(F.col("va") * F.col("vb")))).drop("va", "vb", "cov")


def conflicts(positions: DataFrame, pairs: DataFrame, distance: int = 5, min_reads: int = 3) -> DataFrame:
    """Pairs (a, b) with positions of their own, well read, within ``distance`` of each other."""
    p = positions.where(F.col("reads") >= min_reads).select(*GROUP, "pos", "node")
    every = positions.select(*GROUP, "pos", "node")
    mine = pairs.select(*GROUP, "a", "b").join(p.withColumnRenamed("node", "a"), [*GROUP, "a"]).join(every.withColumnRenamed("node", "b"), [*GROUP, "b", "pos"], "left_anti")
    other = pairs.select(*GROUP, "a", "b").join(p.withColumnRenamed("node", "b"), [*GROUP, "b"]).join(every.withColumnRenamed("node", "a"), [*GROUP, "a", "pos"], "left_anti").withColumnRenamed("pos", "pos2")
    return band_join(mine, other, [*GROUP, "a", "b"], "pos", "pos2", distance).select(*GROUP, "a", "b").distinct()


def first_pass(positions: DataFrame, min_shared: int = 5, min_shared_fraction: float = 0.30, min_max_fraction: float = 0.20, min_correlation: float = 0.60) -> DataFrame:
    """node, ensemble: clusters joined where they share enough positions, correlate, and do not conflict."""
    size = positions.groupBy(*GROUP, "node").agg(F.count("*").alias("size"))
    pairs = shared_pairs(positions)
    s = lambda k: size.select(*GROUP, F.col("node").alias(k), F.col("size").alias(f"s_{k}"))
    j = pairs.join(s("a"), [*GROUP, "a"]).join(s("b"), [*GROUP, "b"])
    low, high = F.least("s_a", "s_b"), F.greatest("s_a", "s_b")
    ok = ((F.col("shared") >= min_shared) | (F.col("shared") / low >= min_shared_fraction)) & (F.col("shared") / high >= min_max_fraction) & (F.col("corr").isNull() | (F.col("corr") >= min_correlation))
    good = j.where(ok)
    good = cut(good)
    links = good.join(conflicts(positions, good), [*GROUP, "a", "b"], "left_anti").select("a", "b")
    return connected(positions.select("node").distinct(), links).withColumnRenamed("component", "ensemble")


def pool(positions: DataFrame, mapping: DataFrame, old: str = "node", new: str = "ensemble") -> DataFrame:
    """Positions of nodes summed up to the groups of ``mapping`` (old, new), renamed to node."""
    return positions.join(mapping, old).groupBy(*GROUP, F.col(new).alias("node"), "pos").agg(F.sum("reads").alias("reads"), F.sum("stops").alias("stops"), F.sum("mutations").alias("mutations"))


def second_pass(positions: DataFrame, min_shared: int = 3, min_shared_fraction: float = 0.30, min_max_fraction: float = 0.20, min_correlation: float = 0.60) -> DataFrame:
    """node, ensemble: average-linkage merging of the ensembles of a strand while the closest pair passes the limits.

    Distance is 1 - shared / smaller size; ensembles without a shared position
    are at 1 and never merge, so only pairs that share one are held. One pandas
    call per strand on its ensembles, which the first pass has made few.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(g["node"].unique())
        place = {n: i for i, n in enumerate(names)}
        reads: list[dict[int, float]] = [{} for _ in names]
        holders: dict[int, list[int]] = {}
        for node, pos, n in zip(g["node"], g["pos"], g["reads"], strict=True):
            reads[place[node]][pos] = reads[place[node]].get(pos, 0.0) + float(n)
        reads = [{p: n for p, n in x.items() if n > 0} for x in reads]
        for i, x in enumerate(reads):
            for p in x:
                holders.setdefault(p, []).append(i)
        shared: dict[tuple[int, int], int] = {}
        for held in holders.values():
            for pair in combinations(held, 2):
                shared[pair] = shared.get(pair, 0) + 1
        near: list[dict[int, float]] = [{} for _ in names]  # distances below 1
        for (a, b), n in shared.items():
            near[a][b] = near[b][a] = 1 - n / max(min(len(reads[a]), len(reads[b])), 1)
        heap = [(d, a, b) for a, x in enumerate(near) for b, d in x.items() if a < b]
        heapify(heap)
        owner, weight, barred = list(range(len(names))), [1.0] * len(names), set()

        def may(a: int, b: int) -> bool:
            both = sorted(reads[a].keys() & reads[b].keys())
            n, na, nb = len(both), len(reads[a]), len(reads[b])
            if n < min_shared or (n / min(na, nb) < min_shared_fraction and n / max(na, nb) < min_max_fraction):
                return False
            x, y = np.array([reads[a][p] for p in both]), np.array([reads[b][p] for p in both])
            return x.std() < 1e-5 or y.std() < 1e-5 or np.corrcoef(x, y)[0, 1] >= min_correlation

        while heap:
            d, a, b = heappop(heap)
            if near[a].get(b) != d or (a, b) in barred:
                continue
            if not may(a, b):
                barred.add((a, b))
                continue
            for c in (near[a].keys() | near[b].keys()) - {a, b}:
                mean = (weight[a] * near[a].get(c, 1.0) + weight[b] * near[b].get(c, 1.0)) / (weight[a] + weight[b])
                near[a][c] = near[c][a] = mean
                near[c].pop(b, None)
                barred.discard((min(a, c), max(a, c)))
                heappush(heap, (mean, min(a, c), max(a, c)))
            near[a].pop(b)
            near[b].clear()
            weight[a] += weight[b]
            for p, n in reads[b].items():
                reads[a][p] = reads[a].get(p, 0.0) + n
            owner = [a if o == b else o for o in owner]
        return pd.DataFrame({"node": names, "ensemble": names[owner]})

    return positions.groupBy(*GROUP).applyInPandas(run, "node long, ensemble long")


def third_pass(positions: DataFrame, max_positions: int = 10, min_correlation: float = 0.50) -> DataFrame:
    """node, ensemble: small ensembles go to the better correlated of the two that overlap them most."""
    size = positions.groupBy(*GROUP, "node").agg(F.count("*").alias("size"))
    pairs = shared_pairs(positions)
    two = pairs.select(*GROUP, F.col("a").alias("node"), F.col("b").alias("other"), "shared", "corr").unionByName(pairs.select(*GROUP, F.col("b").alias("node"), F.col("a").alias("other"), "shared", "corr"))
    small = two.join(size.where(F.col("size") <= max_positions), [*GROUP, "node"])
    r = W.partitionBy("node").orderBy(F.col("shared").desc(), F.col("corr").desc_nulls_last(), "other")
    top = small.withColumn("_r", F.row_number().over(r)).where("_r <= 2").where(F.col("corr") >= min_correlation)
    best = top.groupBy("node").agg(F.max(F.struct("corr", (-F.col("other")).alias("o"))).alias("b")).select(F.col("node").alias("a"), (-F.col("b.o")).alias("b"))
    return connected(positions.select("node").distinct(), best).withColumnRenamed("component", "ensemble")


def ensembles(positions: DataFrame, **limits) -> DataFrame:
    """node, first, second, ensemble: all three passes chained, ids renamed back to the clusters."""
    one = first_pass(positions, **limits).withColumnRenamed("ensemble", "first")
    p1 = cut(pool(positions, one, "node", "first"))
    two = cut(second_pass(p1).select(F.col("node").alias("first"), F.col("ensemble").alias("second")))
    p2 = cut(pool(p1.withColumnRenamed("node", "first"), two, "first", "second"))
    three = third_pass(p2).select(F.col("node").alias("second"), "ensemble")
    return one.join(two, "first").join(three, "second").select("node", "first", "second", "ensemble")


def ensemble_summary(positions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per ensemble: strand, nodes, windows, positions, reads, span, read-weighted confidence."""
    j = positions.join(mapping.select("node", "ensemble"), "node")
    return j.groupBy(*GROUP, "ensemble").agg(
        F.countDistinct("node").alias("clusters"), F.countDistinct("win_start").alias("windows"), F.countDistinct("pos").alias("positions"), F.sum("reads").alias("reads"),
        F.min("pos").alias("start"), F.max("pos").alias("end"), (F.sum(F.col("confidence") * F.col("reads")) / F.sum("reads")).alias("confidence"),
    )


def base_records(positions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per ensemble and position: reads, stops, mutations, read-weighted confidence, windows."""
    j = positions.join(mapping.select("node", "ensemble"), "node")
    return j.groupBy(*GROUP, "ensemble", "pos").agg(F.sum("reads").alias("reads"), F.sum("stops").alias("stops"), F.sum("mutations").alias("mutations"), (F.sum(F.col("confidence") * F.col("reads")) / F.sum("reads")).alias("confidence"), F.countDistinct("win_start").alias("windows"))


def analyse(events: DataFrame, sites: DataFrame, eps: float = 0.75, min_samples: int = 5, size: int = 100, step: int = 50) -> dict[str, DataFrame]:
    """All tables of an analysis: windows, clusters, summary, positions, ensembles, per base."""
    events, sites = cut(events), cut(sites)
    f = cut(read_features(events, sites, size, step))
    c = cut(cluster_windows(f, eps, min_samples))
    p = cluster_positions(events, f, c, sites, size, step).withColumn("node", F.xxhash64(*WINDOW, "cluster"))
    scored = cut(confidence(p, sites))
    m = ensembles(scored.select(*GROUP, "pos", "node", "reads", "stops", "mutations"))
    return {"windows": window_means(sites, size, step), "clusters": c, "summary": cluster_summary(c), "scores": cluster_scores(scored), "positions": scored, "ensembles": ensemble_summary(scored, m), "bases": base_records(scored, m), "mapping": m}


# ---------------------------------------------------------------- tables of fixed layout


def numbered(ensembles: DataFrame) -> DataFrame:
    """ensemble, GlobalEnsembleID: E1, E2, ... in order of strand and place (one row an ensemble)."""
    order = W.orderBy("chr", "strand", "start", "ensemble")
    return ensembles.select("ensemble", F.concat(F.lit("E"), F.row_number().over(order).cast("string")).alias("GlobalEnsembleID"))


def _clusters(out: dict[str, DataFrame]) -> DataFrame:
    """Clusters of all windows with confidence and the ensemble's name."""
    node = F.xxhash64(*WINDOW, "cluster")
    named = out["mapping"].select("node", "ensemble").join(numbered(out["ensembles"]), "ensemble").select("node", "GlobalEnsembleID")
    c = out["summary"].join(out["scores"].select(*WINDOW, "cluster", "confidence"), [*WINDOW, "cluster"], "left").withColumn("node", node)
    return c.join(named, "node", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).drop("node")


def _windows(out: dict[str, DataFrame], sites: DataFrame, size: int, step: int) -> DataFrame:
    return windows(sites, size, step).join(out["windows"], WINDOW, "left")


def windows_table(out: dict[str, DataFrame], sites: DataFrame, size: int = 100, step: int = 50) -> DataFrame:
    """15 columns, a row per window: reads, ensembles, the one with most reads, shares of noise and of reads with both signals, clusters in words."""
    c = _clusters(out)
    real, r = ~F.col("noise"), F.col("reads")
    six = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    words = F.format_string("c%d(occ=%.3f,conf=%.3f,stop=%.2f,mut=%.2f)", "cluster", "occupancy", "confidence", "mean_stops", "mean_mutations")
    listed = lambda cond, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("cluster", x.alias("w"))))), lambda s: s["w"]), ";")
    g = c.groupBy(*WINDOW).agg(
        F.first("status").alias("Status"), F.sum("reads").alias("ReadCount"), F.sum(real.cast("long")).alias("EnsembleCount"), F.max(F.when(real, F.struct("reads", (-F.col("cluster")).alias("n"), "occupancy"))).alias("top"),
        (F.sum(F.when(~real, r).otherwise(0)) / F.sum("reads")).alias("noise"), (F.sum(F.col("dual_share") * r) / F.sum("reads")).alias("dual"), listed(real, words).alias("words"),
        F.max(F.when(~real, F.format_string("noise=%.3f", "occupancy"))).alias("noise_words"), listed(F.col("GlobalEnsembleID").isNotNull(), F.format_string("c%d->%s", "cluster", "GlobalEnsembleID")).alias("global"),
    )
    w = _windows(out, sites, size, step).join(g, WINDOW, "left")
    text = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("NA"))
    return w.select(
        F.col("chr").alias("ChrID"), F.col("strand").alias("Strand"), F.col("win_start").alias("WindowStart"), F.col("win_end").alias("WindowEnd"), F.coalesce("Status", F.lit("insufficient_reads")).alias("Status"), F.coalesce("ReadCount", F.lit(0)).alias("ReadCount"),
        F.coalesce("EnsembleCount", F.lit(0)).alias("EnsembleCount"), F.coalesce((-F.col("top.n")).cast("string"), F.lit("NA")).alias("PrimaryEnsembleID"), six(F.col("top.occupancy")).alias("PrimaryOccupancy"), six(F.col("noise")).alias("NoiseFraction"),
        six(F.col("dual")).alias("DualSignalFraction"), six(F.col("mean_stop")).alias("MeanStopReactivity"), six(F.col("mean_mutation")).alias("MeanMutationReactivity"), text(F.concat_ws(";", F.nullif("words", F.lit("")), "noise_words")).alias("ClusterSummary"), text(F.col("global")).alias("GlobalEnsembles"),
    )


def summary_table(out: dict[str, DataFrame], sites: DataFrame, size: int = 100, step: int = 50) -> DataFrame:
    """17 columns, a row per window and cluster (one row of NA for a window without reads)."""
    c = _clusters(out).withColumn("ReadCount", F.sum("reads").over(W.partitionBy(*WINDOW)))
    j = _windows(out, sites, size, step).join(c, WINDOW, "left")
    six = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return j.select(
        F.col("chr").alias("ChrID"), F.col("strand").alias("Strand"), F.col("win_start").alias("WindowStart"), F.col("win_end").alias("WindowEnd"), F.coalesce("status", F.lit("insufficient_reads")).alias("Status"), F.coalesce("ReadCount", F.lit(0)).alias("ReadCount"),
        F.coalesce(F.col("cluster").cast("string"), F.lit("NA")).alias("EnsembleID"), F.coalesce("GlobalEnsembleID", F.lit("NA")).alias("GlobalEnsembleID"), F.coalesce("noise", F.lit(False)).alias("IsNoise"), F.coalesce("reads", F.lit(0)).alias("Members"),
        *[six(F.col(a)).alias(b) for a, b in (("occupancy", "Occupancy"), ("confidence", "ClusterConfidence"), ("mean_stops", "MeanStopCount"), ("mean_mutations", "MeanMutationCount"), ("dual_share", "DualSignalFraction"), ("mean_stop", "MeanStopReactivity"), ("mean_mutation", "MeanMutationReactivity"))],
    )


def global_table(out: dict[str, DataFrame]) -> DataFrame:
    """11 columns, a row per ensemble; reads with stops, mutations and both from its clusters' means."""
    c = _clusters(out).where("GlobalEnsembleID is not null")
    reads = lambda x: F.round(F.sum(F.col(x) * F.col("reads"))).cast("long")
    t = c.groupBy("GlobalEnsembleID").agg(F.sum("reads").alias("n"), reads("mean_stops").alias("TotalStopReads"), reads("mean_mutations").alias("TotalMutationReads"), reads("dual_share").alias("DualSignalReads"))
    e = out["ensembles"].join(numbered(out["ensembles"]), "ensemble").join(t, "GlobalEnsembleID")
    return e.select(F.col("chr").alias("ChrID"), F.col("strand").alias("Strand"), "GlobalEnsembleID", F.col("windows").alias("WindowCount"), F.col("clusters").alias("ClusterCount"), F.col("n").alias("ReadCount"), "TotalStopReads", "TotalMutationReads", "DualSignalReads", F.col("positions").alias("UniquePositions"), F.round("confidence", 6).alias("Confidence"))


def bases_table(out: dict[str, DataFrame], sites: DataFrame) -> DataFrame:
    """9 columns, a row per ensemble and position."""
    b = out["bases"].join(numbered(out["ensembles"]), "ensemble").join(sites.select(*GROUP, "pos", "stop", "mutation"), [*GROUP, "pos"])
    return b.select(F.col("chr").alias("ChrID"), F.col("strand").alias("Strand"), F.col("pos").alias("Position"), "GlobalEnsembleID", F.col("stops").alias("StopReads"), F.col("mutations").alias("MutationReads"), F.round("stop", 6).alias("StopReactivity"), F.round("mutation", 6).alias("MutationReactivity"), F.round("confidence", 6).alias("PositionConfidence"))
