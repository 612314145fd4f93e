"""Two-sample tests, as grouped aggregations.

Input of every test: a long table with the site columns ``keys``, ``grp`` (1 or
2) and ``value``. Output: keys, statistic, p_value, effect_size, significant.
``compat`` gives the literal results of the established tool where they differ
from the textbook: average ranks that are 0.5 too small, and for the signed-rank
test ranks in sorted order paired with differences in input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import columns as C
from ..functions.orderstat import tie_ranks

TESTS = ("t-test", "mann-whitney", "wilcoxon", "chi-square", "continuity", "diffscan", "deltashape")


def _out(df: DataFrame, keys: list[str], statistic: Column, p: Column, effect: Column, alpha: float) -> DataFrame:
    return df.select(*keys, statistic.alias("statistic"), p.alias("p_value"), effect.alias("effect_size")).withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def _of(g: int) -> Column:
    return F.when(F.col("grp") == g, F.col("value"))


def t_test(df: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Pooled t, p from the normal distribution; fewer than 2 values in a group: p = 1. Effect: Cohen's d."""
    g = df.groupBy(*keys).agg(*[f(_of(i)).alias(f"{n}{i}") for i in (1, 2) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n1, n2 = F.col("n1"), F.col("n2")
    enough = (n1 >= 2) & (n2 >= 2)
    pooled = F.when(enough, ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2))
    t = F.when(pooled > 0, (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1.0 / F.greatest(n1, F.lit(1)) + 1.0 / F.greatest(n2, F.lit(1))))).otherwise(0.0)
    return _out(g, keys, F.when(enough, t).otherwise(0.0), F.when(enough, C.two_sided_p(t)).otherwise(1.0), F.when(pooled > 0, (F.col("m1") - F.col("m2")) / F.sqrt(pooled)), alpha)


def mann_whitney(df: DataFrame, keys: list[str], alpha: float = 0.05, compat: bool = False) -> DataFrame:
    """U = min(U1, U2), p from the normal distribution without tie or continuity correction; effect (U - E) / (n1 n2)."""
    r = tie_ranks(df, keys, "value", "rank", compat)
    g = r.groupBy(*keys).agg(F.sum(F.when(F.col("grp") == 1, F.col("rank"))).alias("r1"), F.count(_of(1)).alias("n1"), F.count(_of(2)).alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    u = F.least(u1, n1 * n2 - u1)
    enough = (n1 >= 1) & (n2 >= 1)
    z = F.when(enough, (u - n1 * n2 / 2.0) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0))
    return _out(g, keys, F.when(enough, u).otherwise(0.0), F.when(enough, C.two_sided_p(z)).otherwise(1.0), F.when(enough, (u - n1 * n2 / 2.0) / F.greatest(n1 * n2, F.lit(1))), alpha)


def wilcoxon(df: DataFrame, keys: list[str], pair: str = "pair", alpha: float = 0.05, compat: bool = False) -> DataFrame:
    """Signed ranks of paired values (column ``pair`` names the partner); zeros leave. Unpaired values: p = 1.

    Effect: z / sqrt(n).
    """
    p = df.groupBy(*keys, pair).agg(F.max(_of(1)).alias("a"), F.max(_of(2)).alias("b"))
    whole = p.groupBy(*keys).agg(F.max((F.col("a").isNull() | F.col("b").isNull()).cast("int")).alias("odd"))
    d = p.where("a is not null and b is not null and a <> b").withColumn("d", F.col("a") - F.col("b")).withColumn("abs", F.abs(F.col("a") - F.col("b")))
    r = tie_ranks(d, keys, "abs", "rank", compat)
    if compat:  # the i-th smallest rank goes to the i-th difference as given
        by_rank = r.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy("abs", pair))).select(*keys, "i", "rank")
        by_input = r.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy(pair))).select(*keys, "i", "d")
        r = by_input.join(by_rank, [*keys, "i"])
    g = r.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("wp"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank"))), F.lit(0.0)).alias("wm"), F.count("*").alias("n"))
    g = whole.join(g, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w, n = F.least("wp", "wm"), F.col("n")
    ok = (F.col("odd") == 0) & (n > 0)
    z = F.when(ok, (w - n * (n + 1) / 4.0) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0))
    return _out(g, keys, F.when(ok, w).otherwise(0.0), F.when(ok, C.two_sided_p(z)).otherwise(1.0), F.when(ok, z / F.sqrt(n)), alpha)


def chi_square(df: DataFrame, keys: list[str], alpha: float = 0.05, continuity: bool = False) -> DataFrame:
    """Values split at the pooled mean, 2 x 2 chi-square with one degree of freedom; ``continuity`` takes 0.5 off the statistic."""
    mean = df.groupBy(*keys).agg(F.avg("value").alias("_m"))
    x = df.join(mean, keys)
    hi = F.col("value") > F.col("_m")
    cell = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    g = x.groupBy(*keys).agg(cell((F.col("grp") == 1) & hi).alias("a"), cell((F.col("grp") == 1) & ~hi).alias("b"), cell((F.col("grp") == 2) & hi).alias("c"), cell((F.col("grp") == 2) & ~hi).alias("d"))
    a, b, c, d = (F.col(k) for k in "abcd")
    n, below = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    chi = F.when(below > 0, n * F.pow(a * d - b * c, F.lit(2.0)) / below).otherwise(0.0)
    chi = F.greatest(chi - 0.5, F.lit(0.0)) if continuity else chi
    return _out(g, keys, chi, 1.0 - C.chi_square_cdf(chi, 1), F.when(n > 0, F.sqrt(chi / n)), alpha)


def diffscan(df: DataFrame, keys: list[str], pair: str = "pair", alpha: float = 0.05) -> DataFrame:
    """Single values: the fixed thresholds of ``columns.diffscan``. Several values: signed ranks."""
    g = df.groupBy(*keys).agg(F.count(_of(1)).alias("n1"), F.count(_of(2)).alias("n2"), F.max(_of(1)).alias("a"), F.max(_of(2)).alias("b"))
    one = g.where("n1 = 1 and n2 = 1")
    p, sig = C.diffscan(F.col("a"), F.col("b"))
    d = F.abs(F.col("a") - F.col("b"))
    single = one.select(*keys, d.alias("statistic"), p.alias("p_value"), d.alias("effect_size"), sig.alias("significant"))
    many = df.join(g.where("not (n1 = 1 and n2 = 1)").select(*keys), keys, "left_semi")
    return single.unionByName(wilcoxon(many, keys, pair, alpha))


def run_test(df: DataFrame, keys: list[str], test: str = "t-test", alpha: float = 0.05, pair: str = "pair", compat: bool = False) -> DataFrame:
    match test:
        case "t-test":
            return t_test(df, keys, alpha)
        case "mann-whitney":
            return mann_whitney(df, keys, alpha, compat)
        case "wilcoxon":
            return wilcoxon(df, keys, pair, alpha, compat)
        case "chi-square":
            return chi_square(df, keys, alpha)
        case "continuity":
            return chi_square(df, keys, alpha, continuity=True)
        case "diffscan" | "deltashape":
            return diffscan(df, keys, pair, alpha)
    raise ValueError(f"unknown test {test}; one of {TESTS}")
