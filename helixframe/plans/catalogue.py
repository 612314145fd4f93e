"""The engine's registered queries on the proxy views, and their SQL.

Doubles are rounded to 6 places on both sides, as the order of additions is
not fixed; NaN comes out as null beside a flag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.orderstat import tie_ranks, upper_median
from ..operators import bias, compare, duet, evaluate, extract, norm, pileup, ranges, reactivity, regions, stats
from ..sources import convert
from .proxies import oracle, view

KEY = ["chr", "strand", "pos"]
GROUP = ["chr", "strand"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *needs: str, recursive: bool = False):
    """Register a query under its function's name, with SQL on the views that it needs."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql, *needs, recursive=recursive)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _round(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _nudged(df: DataFrame) -> DataFrame:
    """Rounded ratios of counts, moved off exact ties, which engines round differently."""
    return df.select(*[F.round(F.col(c) + (0.0 if c == "threshold" else 1e-9), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _mod(spark, d):
    return view(spark, d, "pileup_mod_")


def _unmod(spark, d):
    return view(spark, d, "pileup_unmod_")


def _full(df: DataFrame) -> DataFrame:
    """Proxy pileups with the columns that files have."""
    return df.withColumn("base", F.lit("N")).withColumn("effective_depth", F.lit(None).cast("long"))


def _pairs(spark, d) -> DataFrame:
    return reactivity.paired_rates(_full(_mod(spark, d)), _full(_unmod(spark, d)))


def _siegfried(spark, d, masked: bool = True) -> DataFrame:
    return reactivity.reactivity(_pairs(spark, d), "siegfried", "siegfried", snp_cutoff=0.25 if masked else 2.0)


def _nan_null(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df


# ---------------------------------------------------------------- pileup


def _merged(spark, d, where: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Pileup of the single counts of line items, added up by the operator; rows with depth."""
    items = view(spark, d, "items_").where(where).withColumn("base", F.lit("N"))
    return pileup.merge_pileups(items, by).where("depth > 0").select(*KEY, *by, "mut_count", "stop_count", "depth")


@query("select chr, strand, pos, mut_count, stop_count, depth from pileup_mod_ where depth > 0", "pileup_mod_")
def pileup_mod(spark, d):
    return _merged(spark, d, "is_mod = 1")


@query("select chr, strand, pos, mut_count, stop_count, depth from pileup_unmod_ where depth > 0", "pileup_unmod_")
def pileup_unmod(spark, d):
    return _merged(spark, d, "is_mod = 0")


@query("select chr, strand, pos, mut_count, stop_count, depth from pileup_mod_ where strand = '+'", "pileup_mod_")
def pileup_strand_filter(spark, d):
    return _mod(spark, d).where(F.col("strand").isin(C.strand_choice("+"))).select(*KEY, "mut_count", "stop_count", "depth")


@query("select chr, strand, pos, cell, mut_count, stop_count, depth from pileup_cell_", "pileup_cell_")
def pileup_by_cell(spark, d):
    return _merged(spark, d, "true", ["cell"])


@query("select chr, strand, pos, cast(sum(mut_count) as bigint) as mut_count, cast(sum(stop_count) as bigint) as stop_count, cast(sum(depth) as bigint) as depth from pileup_cell_ group by 1, 2, 3", "pileup_cell_")
def pileup_merge(spark, d):
    return pileup.merge_pileups(view(spark, d, "pileup_cell_").withColumn("base", F.lit("N"))).select(*KEY, "mut_count", "stop_count", "depth")


_READS_SQL = """
with r as (select o_orderkey as id, 'c' || (o_custkey % 3) as chr, case when o_orderstatus = 'O' then '+' else '-' end as strand, (o_custkey % 400) + 1 as p, substr('ACGT', (o_orderkey % 4)::int + 1, 1) as b from orders),
x as (select r.*, i from r, range(10) t(i)),
a as (select chr, strand, p + i as pos, b from x)
"""


def _synthetic_reads(spark, d) -> DataFrame:
    """Reads of ten equal bases from orders: a SAM-like table."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    base = F.substring(F.lit("ACGT"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1))
    return o.select(
        F.col("o_orderkey").cast("string").alias("qname"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(16).alias("flag"), F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("rname"),
        (F.col("o_custkey") % 400 + 1).cast("int").alias("pos"), F.lit(60).alias("mapq"), F.lit("10M").alias("cigar"), F.repeat(base, 10).alias("seq"), F.repeat(F.lit("I"), 10).alias("qual"),
    )


def _synthetic_fasta(spark) -> DataFrame:
    return spark.createDataFrame([(f"c{i}", "ACGT" * 103) for i in range(3)], "contig string, seq string")


@query(
    _READS_SQL
    + """,
n as (select chr, strand, pos, count(*) as depth, sum((b = 'A')::int) as base_a, sum((b = 'C')::int) as base_c, sum((b = 'G')::int) as base_g, sum((b = 'T')::int) as base_t,
        sum((b <> substr('ACGT', ((pos - 1) % 4)::int + 1, 1))::int) as mut_count from a group by 1, 2, 3),
s as (select chr, strand, pos, count(*) as stop_count from (select chr, strand, case when strand = '+' then greatest(p - 1, 1) else p + 1 end as pos from r) group by 1, 2, 3)
select n.chr, n.strand, n.pos::int as pos, mut_count::bigint as mut_count, coalesce(stop_count, 0)::bigint as stop_count, depth::bigint as depth, base_a::bigint as base_a, base_c::bigint as base_c, base_g::bigint as base_g, base_t::bigint as base_t
from n left join s on n.chr = s.chr and n.strand = s.strand and n.pos = s.pos"""
)
def pileup_from_reads(spark, d):
    return pileup.pileup(_synthetic_reads(spark, d), _synthetic_fasta(spark)).select(*KEY, "mut_count", "stop_count", "depth", "base_a", "base_c", "base_g", "base_t")


# ---------------------------------------------------------------- rates and reactivity


@query("select chr, strand, pos, round(m_stop, 6) as m_stop, round(m_mut, 6) as m_mut, round(u_stop, 6) as u_stop, round(u_mut, 6) as u_mut from rates_", "rates_")
def rates(spark, d):
    return _round(_pairs(spark, d).select(*KEY, "m_stop", "m_mut", "u_stop", "u_mut"))


@query("select chr, strand, pos, masked, case when not masked then round(stop, 6) end as reactivity_stop from signal_", "signal_")
def snp_mask(spark, d):
    r = _siegfried(spark, d)
    return _round(_nan_null(r.withColumn("masked", F.isnan("reactivity_stop")), "reactivity_stop").select(*KEY, "masked", "reactivity_stop"))


@query("select chr, strand, pos, round(stop, 6) as reactivity_stop, round(mutation, 6) as reactivity_mutation from signal_ where not masked", "signal_")
def reactivity_siegfried(spark, d):
    r = _siegfried(spark, d)
    return _round(r.where(~F.isnan("reactivity_stop")).select(*KEY, "reactivity_stop", "reactivity_mutation"))


@query("select chr, strand, pos, round(m_stop, 6) as reactivity_stop, round(m_mut, 6) as reactivity_mutation from rates_ where u_mut < 0.25", "rates_")
def reactivity_rouskin_zubradt(spark, d):
    r = reactivity.reactivity(_pairs(spark, d), "rouskin", "zubradt")
    return _round(r.where(~F.isnan("reactivity_stop")).select(*KEY, "reactivity_stop", "reactivity_mutation"))


@query("select chr, strand, pos, round(greatest(ln(m_stop + 1.0) - ln(u_stop + 1.0), 0.0), 6) as reactivity_stop, round(greatest(ln(m_mut + 1.0) - ln(u_mut + 1.0), 0.0), 6) as reactivity_mutation from rates_ where u_mut < 0.25", "rates_")
def reactivity_ding(spark, d):
    r = reactivity.reactivity(_pairs(spark, d), "ding", "ding", pseudocount=1.0)
    return _round(r.where(~F.isnan("reactivity_stop")).select(*KEY, "reactivity_stop", "reactivity_mutation"))


@query("select round(coalesce(case when avg(u_stop) > 0 then avg(m_stop) / avg(u_stop) end, 1.0), 6) as k_stop, round(coalesce(case when avg(u_mut) > 0 then avg(m_mut) / avg(u_mut) end, 1.0), 6) as k_mutation from rates_ where chr = 'chr0'", "rates_")
def kfactor_background(spark, d):
    return _round(reactivity.k_background(_pairs(spark, d), reactivity.is_background(F.col("chr"), gene="chr0")))


@query(
    """with k as (select avg(m_stop) / avg(u_stop) as ks, avg(m_mut) / avg(u_mut) as km from rates_ where chr = 'chr0')
select chr, strand, pos, round(m_stop - ks * u_stop, 6) as reactivity_stop, round(m_mut - km * u_mut, 6) as reactivity_mutation from rates_, k where u_mut < 0.25""",
    "rates_",
)
def reactivity_kfactor(spark, d):
    p = _pairs(spark, d)
    k = reactivity.k_background(p, F.col("chr") == "chr0")
    x = p.crossJoin(F.broadcast(k)).where("u_mut < 0.25")
    return _round(x.select(*KEY, C.k_corrected(F.col("m_stop"), F.col("u_stop"), F.col("k_stop")).alias("reactivity_stop"), C.k_corrected(F.col("m_mut"), F.col("u_mut"), F.col("k_mutation")).alias("reactivity_mutation")))


@query("select chr, strand, pos, round(case when depth > 0 then cast(stop_count as double) / depth else 0 end, 6) as reactivity_stop, round(case when depth > 0 then cast(mut_count as double) / depth else 0 end, 6) as reactivity_mutation from pileup_mod_", "pileup_mod_")
def reactivity_mod_only(spark, d):
    r = reactivity.reactivity(reactivity.paired_rates(_full(_mod(spark, d)), None))
    return _round(r.select(*KEY, "reactivity_stop", "reactivity_mutation"))


_LOSS = lambda x, t: f"(case when {x} between {t[1]} and {t[2]} then 0 when {x} between {t[0]} and {t[3]} then 0.5 * (case when {x} < {t[1]} then ({t[1]} - {x}) / {t[4]} else ({x} - {t[2]}) / {t[4]} end) else 2.0 * (case when {x} < {t[0]} then ({t[0]} - {x}) / {t[5]} else ({x} - {t[3]}) / {t[5]} end) end)"

@query(
    f"""with o as (select m_mut, row_number() over (order by m_mut) - 1 as i, count(*) over () as n from rates_),
t as (select max(case when i = least(n * 40 // 100, n - 1) then m_mut end) as p40, max(case when i = least(n * 60 // 100, n - 1) then m_mut end) as p60, max(case when i = least(n * 90 // 100, n - 1) then m_mut end) as p90 from o),
x as (select k.id * 0.01::double as k, greatest(m_mut - k.id * 0.01::double * u_mut, 0.0) as r, m_mut >= p90 as hi, m_mut >= p40 and m_mut < p60 as lo, m_mut from rates_, t, range(201) k(id)),
f as (select k, avg(case when hi then r end) as h, avg(case when lo then r end) as l, avg(r) as e, avg(case when hi then m_mut end) as hm from x group by k)
select round(k, 6) as k, round(2.5 * {_LOSS('(h / l)', reactivity.FEATURE_TARGETS['vs_low'])} + 2.0 * {_LOSS('(h / e)', reactivity.FEATURE_TARGETS['vs_overall'])} + {_LOSS('(h / hm)', reactivity.FEATURE_TARGETS['correction'])}, 6) as loss from f where l > 0 and e > 0""",
    "rates_",
)
def kfactor_grid(spark, d):
    return _round(reactivity.k_grid_losses(_pairs(spark, d)))


@query(
    ORACLES["kfactor_grid"].replace("select round(k, 6) as k, round(2.5 *", "select round(k, 6) as k, round(round(2.5 *").replace(", 6) as loss from f where l > 0 and e > 0", ", 9), 6) as loss from f where l > 0 and e > 0 order by loss, k limit 1")
)
def kfactor_distribution(spark, d):
    return _round(reactivity.k_distribution(_pairs(spark, d)))


def _labelled_pairs(spark, d):
    return _pairs(spark, d).where("chr = 'chr0' and strand = '+'").join(view(spark, d, "structure_").select("pos", "is_single"), "pos")


@query(
    """with x as (select k.id / 100.0::double as k, greatest(m_mut - k.id / 100.0::double * u_mut, 0.0) as r, m_mut - k.id / 100.0::double * u_mut < 0 as neg, is_single as s
  from rates_ join structure_ using (pos), range(10, 301) k(id) where chr = 'chr0' and strand = '+'),
g as (select k, r, sum(s::int) as p, sum((not s)::int) as q, sum(neg::int) as neg from x group by k, r),
c as (select *, sum(p) over (partition by k order by r desc) as tp, sum(q) over (partition by k order by r desc) as fp from g),
t as (select k, sum(p) as p0, sum(q) as q0, sum(neg) as n0 from g group by k)
select round(c.k, 6) as k, round(sum(q * (tp - p / 2.0)) / (any_value(p0) * any_value(q0)), 6) as auc, round(any_value(n0) / (any_value(p0) + any_value(q0)), 6) as negative_ratio,
  cast(coalesce(sum(case when r = 0 then q end), 0) as bigint) as zero_paired, cast(coalesce(sum(case when r = 0 then p end), 0) as bigint) as zero_single
from c join t on c.k = t.k group by c.k""",
    "rates_", "structure_",
)
def kfactor_structure_metrics(spark, d):
    return _round(reactivity.k_metrics(_labelled_pairs(spark, d)).select("k", "auc", "negative_ratio", "zero_paired", "zero_single"))


@query()
def kfactor_structure(spark, d):
    return spark.createDataFrame([(reactivity.k_structure(_labelled_pairs(spark, d)),)], "k double")


# ---------------------------------------------------------------- normalisation

_ORDERED = "with o as (select chr, strand, pos, stop as v, row_number() over (partition by chr, strand order by stop) - 1 as i, count(*) over (partition by chr, strand) as n from signal_ where not masked)"


def _normal(spark, d, method, **options):
    r = norm.normalize(_siegfried(spark, d), method, ("reactivity_stop",), **options)
    return _round(r.where(~F.isnan("reactivity_stop")).select(*KEY, "reactivity_stop"))


@query(
    _ORDERED + """, s as (select chr, strand, max(n) as n, avg(case when i >= n - ceil(n * 0.10) and i < n - ceil(n * 0.02) then v end) as m from o group by 1, 2)
select o.chr, o.strand, o.pos, round(v / case when s.n >= 10 and m > 0 then m else 1.0 end, 6) as reactivity_stop from o join s on o.chr = s.chr and o.strand = s.strand""",
    "signal_",
)
def norm_percentile28(spark, d):
    return _normal(spark, d, "percentile28")


@query(
    _ORDERED + """, s as (select chr, strand, max(n) as n, avg(case when i >= ceil(n * 0.02) and i < ceil(n * 0.10) then v end) as m from o group by 1, 2)
select o.chr, o.strand, o.pos, round(v / case when s.n >= 10 and m > 0 then m else 1.0 end, 6) as reactivity_stop from o join s on o.chr = s.chr and o.strand = s.strand""",
    "signal_",
)
def norm_percentile28_compat(spark, d):
    return _normal(spark, d, "percentile28", compat=True)


_WINSOR = """, s as (select chr, strand, max(case when i = least(floor(n * 0.05), n - 1) then v end) as lo, max(case when i = least(ceil(n * 0.95), n - 1) then v end) as hi from o group by 1, 2)"""


@query(_ORDERED + _WINSOR + " select o.chr, o.strand, o.pos, round(least(greatest(v, lo), hi) / greatest(hi, 1e-6), 6) as reactivity_stop from o join s on o.chr = s.chr and o.strand = s.strand", "signal_")
def norm_winsor90(spark, d):
    return _normal(spark, d, "winsor90")


@query(
    _ORDERED + """, b as (select chr, strand, max(case when i = least(ceil(n * 0.25), n - 1) then v end) as q1, max(case when i = least(ceil(n * 0.75), n - 1) then v end) as q3 from o group by 1, 2),
k as (select o.*, count(*) over (partition by o.chr, o.strand) as kept, row_number() over (partition by o.chr, o.strand order by v) - 1 as j from o join b on o.chr = b.chr and o.strand = b.strand where v <= q3 + 1.5 * (q3 - q1)),
s as (select chr, strand, max(n) as n, avg(case when j >= kept - ceil(kept * 0.1) then v end) as m from k group by 1, 2)
select o.chr, o.strand, o.pos, round(v / case when s.n >= 4 and m > 0 then m else 1.0 end, 6) as reactivity_stop from o join s on o.chr = s.chr and o.strand = s.strand""",
    "signal_",
)
def norm_boxplot(spark, d):
    return _normal(spark, d, "boxplot")


@query(
    _ORDERED + _WINSOR + """, w as (select o.chr, o.strand, o.pos, least(greatest(v, lo), hi) / greatest(hi, 1e-6) as x from o join s on o.chr = s.chr and o.strand = s.strand),
t as (select *, max(x) over (partition by chr, strand) as top from w)
select chr, strand, pos, round(case when x < 0.25 then x / 0.25 * 0.35 when x < 0.3 then 0.35 + (x - 0.25) / 0.05 * 0.2 when x < 0.7 then 0.55 + (x - 0.3) / 0.4 * 0.3 when top > 0.7 then 0.85 + (x - 0.7) / (top - 0.7) * 0.15 else 0.85 end, 6) as reactivity_stop from t""",
    "signal_",
)
def norm_linear(spark, d):
    return _normal(spark, d, "winsor90", linear=True)


@query(
    """with o as (select chr, strand, pos, stop as v, (row_number() over (partition by chr, strand order by pos) - 1) // 50 as w from signal_ where not masked),
r as (select *, row_number() over (partition by chr, strand, w order by v) - 1 as i, count(*) over (partition by chr, strand, w) as n from o),
t as (select chr, strand, w, max(n) as n, max(case when i = floor(n * 0.05) then v end) as lo, max(case when i = least((n * 95 + 99) // 100, n - 1) then v end) as hi from r group by 1, 2, 3)
select o.chr, o.strand, o.pos, round(case when n >= 2 then least(greatest(v, lo), hi) / greatest(hi, 1e-6) else v end, 6) as reactivity_stop from o join t on o.chr = t.chr and o.strand = t.strand and o.w = t.w""",
    "signal_",
)
def norm_dynamic(spark, d):
    r = _siegfried(spark, d).where(~F.isnan("reactivity_stop")).select(*KEY, "reactivity_stop")
    return _round(norm.dynamic_windows(r, "reactivity_stop"))


@query(
    _ORDERED + """, c as (select *, row_number() over (partition by chr, strand order by pos) as p from o), k as (select chr, strand, v, row_number() over (partition by chr, strand order by v) - 1 as j, count(*) over (partition by chr, strand) as m from c where p > 32 and p <= n - 32),
s as (select chr, strand, avg(case when j >= m - ceil(m * 0.2) and j < m - ceil(m * 0.1) then v end) as a from k group by 1, 2)
select o.chr, o.strand, o.pos, round(case when a > 0 then v / a else v end, 6) as reactivity_stop from o left join s on o.chr = s.chr and o.strand = s.strand""",
    "signal_",
)
def norm_top_slice(spark, d):
    r = _siegfried(spark, d).where(~F.isnan("reactivity_stop")).select(*KEY, "reactivity_stop")
    return _round(norm.top_slice_scale(r, "reactivity_stop"))


def _samples(spark, d):
    return _mod(spark, d).select(*KEY, F.lit("mod").alias("sample"), F.col("depth").cast("double").alias("value")).unionByName(_unmod(spark, d).select(*KEY, F.lit("unmod").alias("sample"), F.col("depth").cast("double").alias("value")))


_SAMPLES = "with x as (select chr, strand, pos, 'mod' as sample, depth::double as value from pileup_mod_ union all select chr, strand, pos, 'unmod', depth::double from pileup_unmod_)"


@query(
    _SAMPLES + """, o as (select sample, value, row_number() over (partition by sample order by value) - 1 as i, count(*) over (partition by sample) as n from x),
m as (select sample, max(case when i = n // 2 then value end) as mid from o group by 1)
select x.sample, chr, strand, pos, round(value / mid, 6) as value from x join m on x.sample = m.sample""",
    "pileup_mod_", "pileup_unmod_",
)
def norm_cross_sample_median(spark, d):
    return _round(norm.cross_sample(_samples(spark, d), "value").select("sample", *KEY, "value"))


@query(
    _SAMPLES + """, r as (select *, row_number() over (partition by sample order by value, chr, strand, pos) as i from x), m as (select i, avg(value) as a from r group by 1)
select sample, chr, strand, pos, round(a, 6) as value from r join m on r.i = m.i""",
    "pileup_mod_", "pileup_unmod_",
)
def norm_cross_sample_quantile(spark, d):
    return _round(norm.cross_sample(_samples(spark, d), "value", method="quantile").select("sample", *KEY, "value"))


# ---------------------------------------------------------------- depth correction

_POINTS = "with p as (select depth::double as depth, mut_count::double / depth as rate from pileup_mod_ where depth > 0 and mut_count > 0 and mut_count::double / depth <= 0.1)"
_BINS = (
    _POINTS
    + """, e as (select min(depth) as lo, max(depth) as hi from p),
b as (select greatest(1, least(50, ceil((depth - lo) / ((hi - lo) / 50))))::int as bin, depth, rate from p, e),
d0 as (select bin, depth, row_number() over (partition by bin order by depth) - 1 as i, count(*) over (partition by bin) as n from b),
r0 as (select bin, rate, row_number() over (partition by bin order by rate) - 1 as i, count(*) over (partition by bin) as n from b),
bins as (select d0.bin, depth, rate from d0 join r0 on d0.bin = r0.bin where d0.i = d0.n // 2 and r0.i = r0.n // 2)"""
)


@query(_BINS + " select bin, round(depth, 6) as depth, round(rate, 6) as rate from bins", "pileup_mod_")
def bias_bins(spark, d):
    return _round(bias.depth_bins(bias.valid_points(_mod(spark, d))))


@query(
    _BINS
    + """, m as (select max(case when i = n // 2 then depth end) * 0.2 as top from (select depth, row_number() over (order by depth) - 1 as i, count(*) over () as n from bins)),
g as (select exp(ln(0.001) + (ln(greatest(top, 0.002)) - ln(0.001)) * id / 119) as scale from m, range(120) t(id)),
x as (select scale, rate, 0.5 * exp(-depth / (2 * scale)) as v from bins, g),
s as (select scale, sum(rate * v) as yg, sum(v * v) as gg, sum(rate * rate) as yy from x group by scale),
a as (select *, case when gg > 0 then least(greatest(yg / gg, 1e-6), 100.0) else 1e-6 end as a from s)
select round(scale, 6) as scale, round(a, 4) as a, round(yy - 2 * a * yg + a * a * gg, 6) as sse from a""",
    "pileup_mod_",
)
def bias_grid_fit(spark, d):
    g = bias.grid_fit(bias.depth_bins(bias.valid_points(_mod(spark, d))))
    return g.select(F.round("scale", 6).alias("scale"), F.round("a", 4).alias("a"), F.round("sse", 6).alias("sse"))


_FACTOR = """with x as (select chr, strand, pos, depth::double as depth, 0.3 * 0.5 * exp(-greatest(depth::double, 1e-10) / (2 * 150.0)) as y from pileup_mod_),
f as (select *, case when y > 0.015 then 1 + sqrt((y - 0.015) / 0.015) else least(greatest(b + (1 - b) * log2(1 + y / 0.015), 0.5), 1.0) end as factor
  from (select *, 0.88 + 0.12 / (1 + pow(depth / 500.0, 2)) - case when depth > 1000 then 0.08 * log10(depth / 1000.0) else 0 end as b from x))"""


@query(_FACTOR + " select chr, strand, pos, round(factor, 6) as factor, greatest(round(depth * least(greatest(factor, 0.5), 10.0)), 1)::bigint as effective_depth from f", "pileup_mod_")
def bias_factor(spark, d):
    depth = F.col("depth").cast("double")
    f = C.correction_factor(C.chi_square_model(depth, F.lit(0.3), F.lit(150.0)), F.lit(0.015), depth)
    return _mod(spark, d).select(*KEY, F.round(f, 6).alias("factor"), C.corrected_depth(depth, f).alias("effective_depth"))


#: The fit as the least point of the grid: right where that is no edge, or the error falls all the way to the edge, as on these tables.
_FIT = (
    ORACLES["bias_grid_fit"].replace(" select round(scale, 6) as scale, round(a, 4) as a, round(yy - 2 * a * yg + a * a * gg, 6) as sse from a", "").replace("\nselect round(scale, 6) as scale, round(a, 4) as a, round(yy - 2 * a * yg + a * a * gg, 6) as sse from a", "")
    + """,
fit as (select scale, a from a order by yy - 2 * a * yg + a * a * gg, scale limit 1),
line as (select a * 0.5 * exp(-greatest(id * 1.2 * hi / 199, 1e-10) / (2 * scale)) as y, row_number() over (order by id desc) - 1 as i from fit, e, range(200) t(id)),
target as (select avg(y) as target from line where i in (99, 100)),
c as (select chr, strand, pos, depth, depth::double as d, case when depth > 0 then mut_count::double / depth else 0 end as r, a * 0.5 * exp(-greatest(depth::double, 1e-10) / (2 * scale)) as y, target from pileup_mod_, fit, target),
f as (select *, case when d > 1000 then 0.88 + 0.12 / (1 + pow(d / 500.0, 2)) - 0.08 * log10(d / 1000.0) else 0.88 + 0.12 / (1 + pow(d / 500.0, 2)) end as b from c),
k as (select *, case when y > target then 1 + sqrt((y - target) / target) else least(greatest(b + (1 - b) * log2(1 + y / target), 0.5), 1.0) end as k from f)
select chr, strand, pos, depth, case when r > 0 and r <= 0.1 then greatest(round(d * least(greatest(k, 0.5), 10.0))::bigint, 1) else greatest(depth, 1) end as effective_depth from k"""
)


@query(_FIT)
def bias_correct(spark, d):
    return bias.correct(_full(_mod(spark, d))).select(*KEY, "depth", "effective_depth")


@query(
    """with x as (select chr, strand, pos, depth, depth::double as d, case when depth > 0 then mut_count::double / depth else 0 end as r, 0.15 * 0.5 * exp(-greatest(depth::double, 1e-10) / 400.0) as y from pileup_mod_),
f as (select *, case when d > 1000 then greatest(0.88 + 0.12 / (1 + pow(d / 500.0, 2)) - 0.08 * log10(d / 1000.0), 0.5) else 0.88 + 0.12 / (1 + pow(d / 500.0, 2)) end as b from x),
k as (select *, least(greatest(case when y > 0.015 then 1 + sqrt((y - 0.015) / 0.015) else b + (1 - b) * log2(1 + y / 0.015) * 0.5 end, 0.5), 10.0) as k from f)
select chr, strand, pos, depth, case when r > 0 and r <= 0.1 then greatest(trunc(d * k)::bigint, 1) else depth end as effective_depth from k""",
    "pileup_mod_",
)
def bias_fixed(spark, d):
    return bias.correct_fixed(_full(_mod(spark, d))).select(*KEY, "depth", "effective_depth")


# ---------------------------------------------------------------- comparisons

_FOLD = """with f as (select *, case when u_stop > 0 then m_stop / u_stop when m_stop > 0 then 'inf'::double else 1.0 end as sf, case when u_mut > 0 then m_mut / u_mut when m_mut > 0 then 'inf'::double else 1.0 end as mf from rates_ where m_depth >= 10 and u_depth >= 10)"""


@query(_FOLD + " select chr, strand, pos, sf = 'inf'::double as stop_inf, mf = 'inf'::double as mutation_inf, case when sf <> 'inf'::double then round(sf, 6) end as stop_fold, case when mf <> 'inf'::double then round(mf, 6) end as mutation_fold from f where sf >= 2 or mf >= 2", "rates_")
def fold_change(spark, d):
    f = compare.fold_changes(_full(_mod(spark, d)), _full(_unmod(spark, d)))
    inf = lambda c: F.col(c) == C.INF
    return f.select(*KEY, inf("stop_fold").alias("stop_inf"), inf("mutation_fold").alias("mutation_inf"), *[F.when(~inf(c), F.round(c, 6)).alias(c) for c in ("stop_fold", "mutation_fold")])


@query(
    _FOLD + """ select chr, strand, pos, round(abs(m_stop - u_stop), 6) as statistic, case when abs(m_stop - u_stop) > 0.6 then 0.001 when abs(m_stop - u_stop) > 0.4 then 0.01 else 0.05 end::double as p_value
from f where (sf >= 2 or mf >= 2) and abs(m_stop - u_stop) > 0.3 and (m_stop > 0.2 or u_stop > 0.2) and m_stop > 0.05 and u_stop > 0.05""",
    "rates_",
)
def compare_mod_unmod_diffscan(spark, d):
    c = compare.mod_vs_unmod(_full(_mod(spark, d)), _full(_unmod(spark, d)), test="diffscan")
    return _round(c.select(*KEY, "statistic", "p_value"))


_ERF = "(1 - (((((1.061405429 * t + -1.453152027) * t + 1.421413741) * t + -0.284496736) * t + 0.254829592) * t) * exp(-(z * z) / 2))"
_P = f"2 * (1 - 0.5 * (1 + {_ERF}))"


@query(
    f"""with g as (select chr, strand, pos, count(*) filter (grp = 1) as n1, count(*) filter (grp = 2) as n2, avg(value) filter (grp = 1) as m1, avg(value) filter (grp = 2) as m2, var_samp(value) filter (grp = 1) as v1, var_samp(value) filter (grp = 2) as v2 from replicates_ group by 1, 2, 3),
p as (select *, case when n1 >= 2 and n2 >= 2 then ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) end as pv from g),
s as (select *, case when n1 >= 2 and n2 >= 2 and pv > 0 then (m1 - m2) / sqrt(pv * (1.0 / n1 + 1.0 / n2)) else 0 end as st from p), z as (select *, abs(st) as z, 1 / (1 + 0.3275911 * abs(st) / sqrt(2.0)) as t from s)
select chr, strand, pos, round(st, 6) as statistic, case when n1 >= 2 and n2 >= 2 then round({_P}, 6) else 1 end::double as p_value from z""",
    "replicates_",
)
def compare_replicates_ttest(spark, d):
    return _round(stats.run_test(view(spark, d, "replicates_"), KEY, "t-test").select(*KEY, "statistic", "p_value"))


@query(
    f"""with r as (select *, rank() over (partition by chr, strand, pos order by value) + (count(*) over (partition by chr, strand, pos, value) - 1) / 2.0 as rk from replicates_),
g as (select chr, strand, pos, sum(rk) filter (grp = 1) as r1, count(*) filter (grp = 1) as n1, count(*) filter (grp = 2) as n2 from r group by 1, 2, 3),
u as (select *, least(r1 - n1 * (n1 + 1) / 2.0, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0)) as u from g where n1 > 0 and n2 > 0),
z as (select *, abs((u - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)) as z from u), t as (select *, 1 / (1 + 0.3275911 * z / sqrt(2.0)) as t from z)
select chr, strand, pos, round(u, 6)::double as statistic, round({_P}, 6) as p_value from t""",
    "replicates_",
)
def compare_replicates_mwu(spark, d):
    long = view(spark, d, "replicates_")
    n = compare.group_summary(long).select(*KEY)
    return _round(stats.mann_whitney(long, KEY).join(n, KEY, "left_semi").select(*KEY, "statistic", "p_value"))

@query(
    f"""with x as (select chr, strand, grp, cast(pos % 50 as int) as pos, cast(pos // 50 as int) as pair, avg(value) as value from replicates_ group by 1, 2, 3, 4, 5),
p as (select chr, strand, pos, pair, max(value) filter (grp = 1) as a, max(value) filter (grp = 2) as b from x group by 1, 2, 3, 4),
w as (select chr, strand, pos, max((a is null or b is null)::int) as odd from p group by 1, 2, 3),
r as (select *, a - b as d, rank() over (partition by chr, strand, pos order by abs(a - b)) + (count(*) over (partition by chr, strand, pos, abs(a - b)) - 1) / 2.0 as rk from p where a <> b),
g as (select chr, strand, pos, sum(case when d > 0 then rk else 0 end) as wp, sum(case when d < 0 then rk else 0 end) as wm, count(*) as n from r group by 1, 2, 3),
s as (select w.chr, w.strand, w.pos, case when odd = 0 then n end as n, case when odd = 0 then least(wp, wm) end as st from w left join g on g.chr = w.chr and g.strand = w.strand and g.pos = w.pos),
z as (select *, abs((st - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0)) as z from s), t as (select *, 1 / (1 + 0.3275911 * z / sqrt(2.0)) as t from z)
select chr, strand, pos, coalesce(round(st, 6)::double, 0) as statistic, coalesce(round({_P}, 6), 1) as p_value from t""",
    "replicates_",
)
def compare_wilcoxon(spark, d):
    x = view(spark, d, "replicates_").groupBy("chr", "strand", "grp", (F.col("pos") % 50).cast("int").alias("p"), F.floor(F.col("pos") / 50).cast("int").alias("pair")).agg(F.avg("value").alias("value")).withColumnRenamed("p", "pos")
    return _round(stats.wilcoxon(x, KEY).select(*KEY, "statistic", "p_value"))


def _chi_sql(st: str) -> str:
    return f"""with m as (select *, avg(value) over (partition by chr, strand, pos) as mean from replicates_),
g as (select chr, strand, pos, sum((grp = 1 and value > mean)::int)::double as a, sum((grp = 1 and value <= mean)::int)::double as b, sum((grp = 2 and value > mean)::int)::double as c, sum((grp = 2 and value <= mean)::int)::double as d from m group by 1, 2, 3),
s as (select *, case when (a + b) * (c + d) * (a + c) * (b + d) > 0 then (a + b + c + d) * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)) else 0 end as chi from g), q as (select *, {st} as st from s),
z as (select *, (st - 1) / sqrt(2.0) as y from q), t as (select *, abs(y) as z, 1 / (1 + 0.3275911 * abs(y) / sqrt(2.0)) as t from z)
select chr, strand, pos, round(st, 6) as statistic, round(case when st <= 0 then 1.0 else 1 - 0.5 * (1 + sign(y) * {_ERF}) end, 6) as p_value from t"""


@query(_chi_sql("chi"), "replicates_")
def compare_replicates_chisq(spark, d):
    return _round(stats.chi_square(view(spark, d, "replicates_"), KEY).select(*KEY, "statistic", "p_value"))


@query(_chi_sql("greatest(chi - 0.5, 0)"), "replicates_")
def compare_replicates_continuity(spark, d):
    return _round(stats.chi_square(view(spark, d, "replicates_"), KEY, continuity=True).select(*KEY, "statistic", "p_value"))


@query(
    "select chr, strand, pos, round(avg(value) filter (grp = 1), 6) as mean1, round(avg(value) filter (grp = 2), 6) as mean2, round(coalesce(stddev_samp(value) filter (grp = 1), 0), 6) as std1, round(coalesce(stddev_samp(value) filter (grp = 2), 0), 6) as std2, count(*) filter (grp = 1) as n1, count(*) filter (grp = 2) as n2 from replicates_ group by 1, 2, 3 having n1 > 0 and n2 > 0",
    "replicates_",
)
def compare_groups(spark, d):
    return _round(compare.group_summary(view(spark, d, "replicates_")).select(*KEY, "mean1", "mean2", "std1", "std2", "n1", "n2"))


@query("select chr, strand, pos, round(rank() over (partition by chr, strand order by depth) + (count(*) over (partition by chr, strand, depth) - 1) / 2.0, 6)::double as rank from pileup_mod_", "pileup_mod_")
def tie_average_ranks(spark, d):
    return tie_ranks(_mod(spark, d).select(*KEY, "depth"), GROUP, "depth").select(*KEY, F.col("rank").cast("double").alias("rank"))


@query("with o as (select chr, strand, depth, row_number() over (partition by chr, strand order by depth) - 1 as i, count(*) over (partition by chr, strand) as n from pileup_mod_) select chr, strand, max(case when i = n // 2 then depth end)::double as median from o group by 1, 2", "pileup_mod_")
def upper_medians(spark, d):
    return upper_median(_mod(spark, d).withColumn("depth", F.col("depth").cast("double")), GROUP, "depth")


# ---------------------------------------------------------------- regions


def _series(spark, d):
    return _pairs(spark, d).select(*KEY, F.col("m_stop").alias("value1"), F.col("u_stop").alias("value2"))


@query(
    """with s as (select chr, strand, pos, abs(m_stop - u_stop) as d, row_number() over (partition by chr, strand order by pos) as i, 1 / (1 + 20 * abs(m_stop - u_stop)) as p from rates_),
c as (select *, sum(-ln(p)) over (partition by chr, strand order by pos) as upto from s),
q as (select a.chr, a.strand, a.pos as s0, b.pos as e0, l.id as len, (b.upto - a.upto - ln(a.p)) / sqrt(l.id) as q from c a, range(5, 51) l(id), c b where a.chr = b.chr and a.strand = b.strand and b.i = a.i + l.id - 1)
select chr, strand, cast(count(*) as bigint) as windows, round(max(q), 6) as top from q group by 1, 2""",
    "rates_",
)
def scan_q_top(spark, d):
    s = _pairs(spark, d).select(*KEY, (1.0 / (1.0 + 20.0 * F.abs(F.col("m_stop") - F.col("u_stop")))).alias("p_value"))
    return _round(regions.scan_q(s).groupBy(*GROUP).agg(F.count("*").alias("windows"), F.max("q").alias("top")))


@query(
    f"""with s as (select chr, strand, pos, m_stop as a, u_stop as b, row_number() over (partition by chr, strand order by pos) as i from rates_),
p as (select c.chr, c.strand, c.pos, s.a - s.b as d from s c join s on c.chr = s.chr and c.strand = s.strand and s.i between c.i - 2 and c.i + 2 where s.a <> s.b),
r as (select *, rank() over (partition by chr, strand, pos order by abs(d)) + (count(*) over (partition by chr, strand, pos, abs(d)) - 1) / 2.0 as rk from p),
g as (select chr, strand, pos, sum(case when d > 0 then rk else 0 end) as wp, sum(case when d < 0 then rk else 0 end) as wm, count(*) as n from r group by 1, 2, 3),
z as (select *, abs((least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0)) as z from g), t as (select *, 1 / (1 + 0.3275911 * z / sqrt(2.0)) as t from z)
select s.chr, s.strand, s.pos, coalesce(round({_P}, 6), 1) as p_value from s left join t on s.chr = t.chr and s.strand = t.strand and s.pos = t.pos""",
    "rates_",
)
def window_wilcoxon(spark, d):
    return _round(regions.window_tests(_series(spark, d)))


@query()
def mc_threshold(spark, d):
    return _round(regions.q_threshold(regions.window_tests(_series(spark, d))))


@query(
    """with s as (select chr, strand, pos, m_stop as a, u_stop as b, abs(m_stop - u_stop) as d, row_number() over (partition by chr, strand order by pos) as i from rates_),
z as (select *, case when d = 0 then 0 else 1 - 1.96 * 0.1 * (a + b) / d end as zf, d / 0.1 as zs from s),
h as (select *, i - row_number() over (partition by chr, strand order by pos) as run from z where zf > 0 and zs >= 1.0),
c as (select *, (row_number() over (partition by chr, strand, run order by pos) - 1) // 50 as part from h)
select chr, strand, min(pos)::int as "start", max(pos)::int as "end", round(max(zf), 6) as z_factor, round(max(zs), 6) as z_score, count(*)::int as hits from c group by chr, strand, run, part""",
    "rates_",
)
def deltashape_regions(spark, d):
    return _round(regions.deltashape_regions(_series(spark, d), min_len=1))


@query(
    """with s as (select chr, strand, pos, m_stop as a, u_stop as b, abs(m_stop - u_stop) as d from rates_)
select chr, strand, pos, round(case when d = 0 then 0 else 1 - 1.96 * 0.1 * (a + b) / d end, 6) as z_factor, round(d / 0.1, 6) as z_score, (case when d = 0 then 0 else 1 - 1.96 * 0.1 * (a + b) / d end) > 0 and d / 0.1 >= 1.0 as hit from s""",
    "rates_",
)
def deltashape_sites(spark, d):
    return _round(regions.site_scores(_series(spark, d)).select(*KEY, "z_factor", "z_score", "hit"))


# ---------------------------------------------------------------- evaluation

_LABELLED = "with l as (select s.chr, s.strand, s.pos, s.mutation as v, t.base, t.is_single from signal_ s join structure_ t on s.pos = t.pos where not masked)"


def _labelled(spark, d):
    r = _siegfried(spark, d)
    st = view(spark, d, "structure_")
    return r.drop("base").join(st, "pos").where(~F.isnan("reactivity_mutation"))


_CURVE = _LABELLED + """, g as (select chr, strand, round(v, 9) as th, sum(is_single::int) as p, sum((not is_single)::int) as q from l group by 1, 2, 3),
c as (select *, sum(p) over w as tp, sum(q) over w as fp, sum(p) over (partition by chr, strand) as p0, sum(q) over (partition by chr, strand) as q0 from g window w as (partition by chr, strand order by th desc))"""


def _rounded_labels(spark, d):
    return _labelled(spark, d).withColumn("v", F.round("reactivity_mutation", 9) + 0.0)


@query(_CURVE + " select chr, strand, round(th, 6) as threshold, tp::bigint as tp, fp::bigint as fp, round(tp / p0 + 1e-9, 6) as tpr, round(fp / q0 + 1e-9, 6) as fpr from c", "signal_", "structure_")
def roc_curve(spark, d):
    return _nudged(evaluate.curve(_rounded_labels(spark, d), "v", GROUP).select(*GROUP, "threshold", "tp", "fp", "tpr", "fpr"))


@query(_CURVE + " select chr, strand, round(th, 6) as threshold, round(tp / (tp + fp) + 1e-9, 6) as precision, round(tp / p0 + 1e-9, 6) as recall from c", "signal_", "structure_")
def pr_curve(spark, d):
    return _nudged(evaluate.curve(_rounded_labels(spark, d), "v", GROUP).select(*GROUP, "threshold", "precision", "recall"))


@query(_CURVE + " select chr, strand, round(sum(q * (tp - p / 2.0)) / (sum(p) * sum(q)), 6) as auc, sum(p)::bigint as positives, sum(q)::bigint as negatives from c group by 1, 2", "signal_", "structure_")
def roc_auc_by_group(spark, d):
    return _round(evaluate.auc(_rounded_labels(spark, d), "v", GROUP))


@query(_CURVE + " select chr, strand, round(1 - sum(q * (tp - p / 2.0)) / (sum(p) * sum(q)), 6) as auc from c group by 1, 2", "signal_", "structure_")
def roc_auc_compat(spark, d):
    return _round(evaluate.auc(_rounded_labels(spark, d), "v", GROUP, compat=True).select(*GROUP, "auc"))


@query(_CURVE + " select chr, strand, round(sum(tp / (tp + fp) * p) / sum(p), 6) as average_precision from c group by 1, 2", "signal_", "structure_")
def average_precision(spark, d):
    return _round(evaluate.average_precision(_rounded_labels(spark, d), "v", GROUP))


@query(
    _CURVE + """, y as (select *, tp / p0 - fp / q0 as youden from c where tp > 0 and tp < p0 and fp > 0 and fp < q0)
select chr, strand, round(max(youden), 6) as youden from y group by 1, 2""",
    "signal_", "structure_",
)
def youden_threshold(spark, d):
    return _round(evaluate.best_threshold(_rounded_labels(spark, d), "v", GROUP).select(*GROUP, "youden"))


@query(
    _LABELLED + """, g as (select chr, strand, sum((v > 0.01 and is_single)::int) as tp, sum((v > 0.01 and not is_single)::int) as fp, sum((v <= 0.01 and not is_single)::int) as tn, sum((v <= 0.01 and is_single)::int) as fn from l group by 1, 2)
select chr, strand, tp::bigint as tp, fp::bigint as fp, tn::bigint as tn, fn::bigint as fn, round(tp / (tp + fn), 6) as sensitivity, round(tn / (tn + fp), 6) as specificity, round((tp + tn) / (tp + fp + tn + fn), 6) as accuracy, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1 from g""",
    "signal_", "structure_",
)
def confusion(spark, d):
    return _round(evaluate.confusion(_labelled(spark, d), "reactivity_mutation", 0.01, GROUP, strict=True).select(*GROUP, "tp", "fp", "tn", "fn", "sensitivity", "specificity", "accuracy", "f1"))


@query(
    _LABELLED + """, b as (select chr, strand, round(v, 9) as v, is_single, u.o as of from l, (values (1), (2)) t(i), lateral (select case when i = 1 then 'all' else replace(base, 'U', 'T') end as o) u),
n as (select chr, strand, of from b group by 1, 2, 3 having count(*) >= 10), g as (select b.chr, b.strand, b.of, v, sum(is_single::int) as p, sum((not is_single)::int) as q from b join n on b.chr = n.chr and b.strand = n.strand and b.of = n.of group by 1, 2, 3, 4),
c as (select *, sum(p) over (partition by chr, strand, of order by v desc) as tp from g)
select chr, strand, of, round(sum(q * (tp - p / 2.0)) / (sum(p) * sum(q)), 6) as auc from c group by 1, 2, 3 having sum(p) > 0 and sum(q) > 0""",
    "signal_", "structure_",
)
def roc_by_base(spark, d):
    return _round(evaluate.by_base(_rounded_labels(spark, d), "v", GROUP).select(*GROUP, "of", "auc"))


def _shifted(spark, d):
    """Signal whose bases are those of the structure three positions on; merged, so that neither is broadcast."""
    st = view(spark, d, "structure_").select((F.col("pos") - 3).alias("pos"), "base")
    return _siegfried(spark, d).drop("base").join(st.hint("merge"), "pos")


_SHIFT = """with s as (select g.chr, g.strand, g.pos, replace(t.base, 'U', 'T') as b from signal_ g join structure_ t on t.pos - 3 = g.pos),
m as (select s.chr, s.strand, h.id as shift, sum((s.b = replace(t.base, 'U', 'T'))::int)::bigint as matches, count(*)::bigint as checked from s, range(-20, 21) h(id), structure_ t where t.pos = s.pos + h.id group by 1, 2, 3)"""


@query(_SHIFT + " select chr, strand, shift::int as shift, matches, checked from m", "signal_", "structure_")
def shift_matches(spark, d):
    return evaluate.match_counts(_shifted(spark, d), view(spark, d, "structure_"), 20, GROUP)


@query(_SHIFT + ", r as (select *, row_number() over (partition by chr, strand order by matches desc, shift) as i from m) select chr, strand, shift::int as shift, matches from r where i = 1", "signal_", "structure_")
def auto_shift_best(spark, d):
    return evaluate.best_shift(_shifted(spark, d), view(spark, d, "structure_"), 20, GROUP)


@query("select s.chr, s.strand, s.pos, t.base as sbase, t.is_single, round(s.stop, 6) as reactivity_stop from signal_ s join structure_ t on t.pos = s.pos where not masked and replace(t.base, 'U', 'T') in ('A', 'C')", "signal_", "structure_")
def structure_join_by_base(spark, d):
    st = view(spark, d, "structure_")
    r = _siegfried(spark, d).where(~F.isnan("reactivity_stop")).drop("base").join(st.select("pos", "base"), "pos")
    return _round(evaluate.label(r, st, bases="AC").select(*KEY, "sbase", "is_single", "reactivity_stop"))


@query(
    _SHIFT.replace("t.pos - 3 = g.pos", "t.pos = g.pos") + """, b as (select chr, strand, shift, row_number() over (partition by chr, strand order by matches desc, shift) as i from m),
l as (select g.chr, g.strand, u.signal, u.v, t.is_single from signal_ g join structure_ o on o.pos = g.pos join b on b.chr = g.chr and b.strand = g.strand and b.i = 1 join structure_ t on t.pos = g.pos + b.shift,
  lateral (values ('reactivity_stop', g.stop), ('reactivity_mutation', g.mutation)) u(signal, v) where not masked),
g as (select chr, strand, signal, v, sum(is_single::int) as p, sum((not is_single)::int) as q from l group by 1, 2, 3, 4),
c as (select *, sum(p) over w as tp, sum(q) over w as fp, sum(p) over k as p0, sum(q) over k as q0 from g window w as (partition by chr, strand, signal order by v desc), k as (partition by chr, strand, signal)),
x as (select *, tp / p0 as tpr, fp / q0 as fpr, tp / (tp + fp) as pr from c where p0 > 0 and q0 > 0),
y as (select *, tpr - fpr as youden, case when tp > 0 then 2 * pr * tpr / (pr + tpr) else 0 end as f1, tpr > 0 and tpr < 1 and fpr > 0 and fpr < 1 as inside from x),
n as (select *, row_number() over (partition by chr, strand, signal order by inside desc, case when inside then youden else f1 end desc, v desc) as i from y),
a as (select chr, strand, signal, sum(q * (tp - p / 2.0)) / (sum(p) * sum(q)) as auc, sum(p)::bigint as positives, sum(q)::bigint as negatives, sum(pr * p) / sum(p) as average_precision from x group by 1, 2, 3)
select a.chr, a.strand, a.signal, round(auc, 6) as auc, positives, negatives, round(average_precision, 6) as average_precision, round(v, 6) as threshold, round(tpr, 6) as tpr, round(fpr, 6) as fpr, round(pr, 6) as precision, round(f1, 6) as f1, round(youden, 6) as youden,
  auc = max(auc) over (partition by a.chr, a.strand) as better from a join n on a.chr = n.chr and a.strand = n.strand and a.signal = n.signal and n.i = 1""",
    "signal_", "structure_",
)
def evaluate_both_signals(spark, d):
    r = _siegfried(spark, d).drop("base").join(view(spark, d, "structure_").select("pos", "base"), "pos")
    return _round(evaluate.both_signals(r, view(spark, d, "structure_"), keys=GROUP))


@query(
    _LABELLED + """, e as (select chr, strand, min(v) as lo, max(v) as hi from l group by 1, 2), t as (select chr, strand, lo + (id / 100.0::double) * (hi - lo) as th from e, range(101) r(id))
select l.chr, l.strand, round(th, 6) as threshold, sum((v >= th and is_single)::int)::bigint as tp, sum((v >= th and not is_single)::int)::bigint as fp, sum((v < th and not is_single)::int)::bigint as tn, sum((v < th and is_single)::int)::bigint as fn
from l join t on l.chr = t.chr and l.strand = t.strand group by l.chr, l.strand, th""",
    "signal_", "structure_",
)
def roc_grid101(spark, d):
    return _round(evaluate.grid_curve(_labelled(spark, d), "reactivity_mutation", 101, GROUP))


# ---------------------------------------------------------------- extraction


def _genes(spark, d):
    return view(spark, d, "genes_").select("seqname", F.col("g_start").alias("start"), F.col("g_end").alias("end"), F.col("g_strand").alias("strand"), "gene_id", F.lit(None).cast("string").alias("gene_name"))


_EXTRACT = "with x as (select gene_id, chr, strand, cast(pos - g_start + 1 as int) as pos, mut_count, stop_count, depth from pileup_mod_ join genes_ on chr = seqname and strand = g_strand and pos between g_start and g_end)"


@query(_EXTRACT + " select * from x", "pileup_mod_", "genes_")
def extract_genes(spark, d):
    return extract.extract_genes(_full(_mod(spark, d)), _genes(spark, d), relative=True).select("gene_id", *KEY, "mut_count", "stop_count", "depth")


@query(_EXTRACT + " select gene_id, count(*)::bigint as positions, round(avg(depth), 6) as avg_depth from x group by 1", "pileup_mod_", "genes_")
def gene_depth(spark, d):
    return _round(extract.gene_depths(extract.extract_genes(_full(_mod(spark, d)), _genes(spark, d))).select("gene_id", "positions", "avg_depth"))


@query(
    """with g as (select chr, strand, avg(case when depth > 0 then 1.0 else 0.0 end) as coverage, avg(depth) as avg_depth from pileup_mod_ group by 1, 2)
select chr, strand, round(coverage, 6)::double as coverage, round(avg_depth, 6) as avg_depth, round(coverage * avg_depth, 6)::double as coverage_depth, coverage >= 0.2 and avg_depth >= 50.0 as high from g""",
    "pileup_mod_",
)
def gene_stats_highlow(spark, d):
    return _round(extract.gene_stats(_mod(spark, d)).select(*GROUP, "coverage", "avg_depth", "coverage_depth", "high"))


@query(
    """select chr, strand, pos, depth, case when lead(pos) over w = pos + 1 then greatest(depth - lead(depth) over w, 0) else depth end as stop_count from pileup_mod_ window w as (partition by chr, strand order by pos)""",
    "pileup_mod_",
)
def bedgraph_stops(spark, d):
    return convert.bedgraph_stops(_mod(spark, d).select(*KEY, "depth"))


@query(
    """with i as (select l_suppkey % 7 as k, l_partkey * 10 as s, l_partkey * 10 + cast(l_quantity as bigint) as e from lineitem),
m as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as reach from i),
g as (select *, sum(case when reach is null or s > reach + 20 then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) as grp from m)
select k, min(s) as "start", max(e) as "end" from g group by k, grp"""
)
def interval_merge(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    i = li.select((F.col("l_suppkey") % 7).alias("k"), (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("bigint")).alias("end"))
    return ranges.merge_intervals(i, ["k"], gap=20)


def _transcripts(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(
        F.concat(F.lit("c"), F.col("p_partkey") % 3).alias("seqname"), F.lit("x").alias("source"), (F.col("p_partkey") % 60 * 4 + 1).cast("long").alias("start"), (F.col("p_partkey") % 60 * 4 + F.col("p_size")).cast("long").alias("end"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit("t"), F.col("p_partkey") % 20).alias("transcript_id"), F.concat(F.lit("g"), F.col("p_partkey") % 20).alias("gene_id"),
    )


@query(
    """with e as (select 'c' || (p_partkey % 3) as seqname, p_partkey % 60 * 4 + 1 as s, p_partkey % 60 * 4 + p_size as e, case when p_partkey % 2 = 0 then '+' else '-' end as strand, 't' || (p_partkey % 20) as transcript_id from part),
q as (select *, substr(repeat('ACGT', 103), s::int, (e - s + 1)::int) as part from e),
t as (select transcript_id, max(strand) as strand, count(*)::int as n_exons, string_agg(part, '' order by s, e, part) as seq from q group by 1)
select transcript_id, strand, n_exons, length(seq)::int as length, case when strand = '-' then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as seq from t where length(seq) > 0"""
)
def transcripts_splice(spark, d):
    return extract.splice_transcripts(_transcripts(spark, d), _synthetic_fasta(spark)).select("transcript_id", "strand", "n_exons", "length", "seq")


@query("select p_partkey, reverse(translate(regexp_replace(upper(p_name), '[^ACGTN]', 'N', 'g'), 'ACGT', 'TGCA')) as rc from part")
def revcomp(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", C.reverse_complement(F.col("p_name")).alias("rc"))


# ---------------------------------------------------------------- duet


def _sites(spark, d):
    return duet.clean_reactivity(_siegfried(spark, d))


def _events(spark, d):
    r = view(spark, d, "reads_")
    e = r.select("chr", "strand", "read_id", F.col("mut_pos").alias("pos"), F.lit("mutation").alias("kind")).unionByName(r.select("chr", "strand", "read_id", F.col("stop_pos").alias("pos"), F.lit("stop").alias("kind"))).distinct()
    return e.join(_sites(spark, d).select(*KEY), KEY, "left_semi")


_SITES = """with sites as (select chr, strand, pos, stop, mutation from signal_ where not masked),
bounds as (select chr, strand, min(pos) as s0, max(pos) as e0 from sites group by 1, 2),
win as (select distinct chr, strand, w as win_start, least(w + 99, e0) as win_end from (select chr, strand, e0, unnest(list_append(range(s0, greatest(e0, s0 + 1), 50), e0)) as w from bounds))"""
_FEATURES = _SITES + """, ev as (select distinct chr, strand, read_id, pos, kind from (select chr, strand, read_id, mut_pos as pos, 'mutation' as kind from reads_ union all select chr, strand, read_id, stop_pos, 'stop' from reads_) e
  where exists (select 1 from sites s where s.chr = e.chr and s.strand = e.strand and s.pos = e.pos)),
feat as (select w.chr, w.strand, w.win_start, read_id, count(distinct case when kind = 'stop' then pos end) as stops, count(distinct case when kind = 'mutation' then pos end) as mutations
  from ev join win w on ev.chr = w.chr and ev.strand = w.strand and ev.pos between w.win_start and w.win_end group by 1, 2, 3, 4)"""


@query(_SITES + " select chr, strand, win_start::int as win_start, win_end::int as win_end from win", "signal_")
def duet_windows(spark, d):
    return duet.windows(_sites(spark, d))


@query(_SITES + " select w.chr, w.strand, w.win_start::int as win_start, count(*)::bigint as positions, round(avg(stop), 6) as mean_stop, round(avg(mutation), 6) as mean_mutation from sites s join win w on s.chr = w.chr and s.strand = w.strand and s.pos between w.win_start and w.win_end group by 1, 2, 3", "signal_")
def duet_window_means(spark, d):
    return _round(duet.window_means(_sites(spark, d)))


@query(_FEATURES + " select chr, strand, win_start::int as win_start, read_id, stops, mutations, (stops > 0 and mutations > 0)::int as both from feat", "signal_", "reads_")
def duet_read_features(spark, d):
    return duet.read_features(_events(spark, d), _sites(spark, d))


@query(_FEATURES + " select chr, strand, win_start::int as win_start, stops, mutations, (stops > 0 and mutations > 0)::int as both, count(*)::bigint as reads from feat group by 1, 2, 3, 4, 5, 6", "signal_", "reads_")
def duet_feature_counts(spark, d):
    return duet.feature_counts(duet.read_features(_events(spark, d), _sites(spark, d)))


@query(
    """with h as (select chr, strand, pos from signal_ where not masked and stop > 0.01),
n as (select *, case when pos - lag(pos) over (partition by chr, strand order by pos) <= 4 then 0 else 1 end as fresh from h), r as (select *, sum(fresh) over (partition by chr, strand order by pos) as run from n),
c as (select *, count(*) over (partition by chr, strand, run) as k from r) select chr, strand, pos from c where k >= 3""",
    "signal_",
)
def duet_contiguity(spark, d):
    return ranges.contiguous_runs(_sites(spark, d).where("stop > 0.01").select(*KEY), GROUP)


@query(
    _FEATURES + """, p as (select chr, strand, pos, count(distinct read_id) as reads from ev group by 1, 2, 3), s as (select *, greatest(stop, mutation) as top, max(greatest(stop, mutation)) over (partition by chr, strand order by pos range between 2 preceding and 2 following) as near from sites)
select p.chr, p.strand, p.pos, round(case when top < 0.7 and near >= 0.7 then least(c + 0.15, 1.0) else c end, 6) as confidence
from (select p.*, s.top, s.near, 0.6 * (1 - exp(-reads / 50.0)) + 0.4 * least(greatest(top, 0.0), 1.0) as c from p join s on p.chr = s.chr and p.strand = s.strand and p.pos = s.pos) p""",
    "signal_", "reads_",
)
def duet_position_confidence(spark, d):
    p = _events(spark, d).groupBy(*KEY).agg(F.countDistinct("read_id").alias("reads"))
    return _round(duet.confidence(p, _sites(spark, d)).select(*KEY, "confidence"))


@query(
    _FEATURES + """, c as (select chr, strand, pos, read_id % 10 as node, count(distinct read_id)::double as reads from ev group by 1, 2, 3, 4),
j as (select a.chr, a.strand, a.node as a, b.node as b, a.reads as ra, b.reads as rb from c a join c b on a.chr = b.chr and a.strand = b.strand and a.pos = b.pos and a.node < b.node)
select chr, strand, a, b, count(*)::bigint as shared, round(case when count(*) >= 3 and var_pop(ra) > 1e-10 and var_pop(rb) > 1e-10 then corr(ra, rb) end, 6) as corr from j group by 1, 2, 3, 4""",
    "signal_", "reads_",
)
def duet_pair_overlap(spark, d):
    p = _events(spark, d).groupBy(*KEY, (F.col("read_id") % 10).alias("node")).agg(F.countDistinct("read_id").alias("reads"))
    return _round(duet.shared_pairs(p))


def _duet(spark, d):
    return duet.analyse(_events(spark, d), _sites(spark, d))


_CLUSTERS = _FEATURES + """, fc as (select chr, strand, win_start, stops, mutations, (stops > 0 and mutations > 0)::int as both, count(*)::bigint as reads from feat group by 1, 2, 3, 4, 5, 6),
mo as (select chr, strand, win_start, sum(reads)::double as n, """ + ", ".join(f'sum("{c}" * reads)::double / sum(reads) as m_{c}, sqrt(greatest(sum("{c}" * "{c}" * reads)::double / sum(reads) - pow(sum("{c}" * reads)::double / sum(reads), 2), 0)) as d_{c}' for c in ("stops", "mutations", "both")) + """ from fc group by 1, 2, 3),
pt as (select chr, strand, win_start, n, stops, mutations, "both", reads, row_number() over (partition by chr, strand, win_start order by stops, mutations, "both") as i, """ + ", ".join(f'("{c}" - m_{c}) / case when d_{c} < 1e-6 then 1 else d_{c} end as z_{c}' for c in ("stops", "mutations", "both")) + """ from fc join mo using (chr, strand, win_start)),
pr as (select a.chr, a.strand, a.win_start, a.i, b.i as j, b.reads from pt a join pt b using (chr, strand, win_start) where pow(a.z_stops - b.z_stops, 2) + pow(a.z_mutations - b.z_mutations, 2) + pow(a.z_both - b.z_both, 2) <= 0.75 * 0.75 + 1e-12),
co as (select chr, strand, win_start, i from pr group by 1, 2, 3, 4 having sum(reads) >= 5),
ed as (select chr, strand, win_start, i, j from pr join co using (chr, strand, win_start, i) semi join (select chr, strand, win_start, i as j from co) c2 using (chr, strand, win_start, j)),
re as (select chr, strand, win_start, i, i as seen from co union select re.chr, re.strand, re.win_start, re.i, ed.j from re join ed on re.chr = ed.chr and re.strand = ed.strand and re.win_start = ed.win_start and re.seen = ed.i),
ro as (select chr, strand, win_start, i, min(seen) as root from re group by 1, 2, 3, 4),
nu as (select chr, strand, win_start, i, dense_rank() over (partition by chr, strand, win_start order by root) as k from ro),
la as (select chr, strand, win_start, pr.i, min(k) as k from pr join nu using (chr, strand, win_start) where nu.i = pr.j group by 1, 2, 3, 4),
cl as (select pt.chr, pt.strand, pt.win_start::int as win_start, stops, mutations, "both", reads, (case when n < 5 then 1 else coalesce(nu.k, la.k, 0) end)::int as cluster,
  case when n < 5 then 'insufficient_reads' when max(coalesce(nu.k, la.k, 0)) over (partition by pt.chr, pt.strand, pt.win_start) > 0 then 'ok' else 'low_density' end as status
  from pt left join nu using (chr, strand, win_start, i) left join la using (chr, strand, win_start, i))"""


@query(_CLUSTERS + " select * from cl", "signal_", "reads_", recursive=True)
def duet_dbscan(spark, d):
    return duet.cluster_windows(duet.read_features(_events(spark, d), _sites(spark, d)))


@query(
    _CLUSTERS + """ select chr, strand, win_start, cluster, sum(reads)::bigint as reads, round(sum(stops * reads)::double / sum(reads), 6) as mean_stops, round(sum(mutations * reads)::double / sum(reads), 6) as mean_mutations, round(sum("both" * reads)::double / sum(reads), 6) as dual_share,
  any_value(status) as status, round(sum(reads)::double / sum(sum(reads)) over (partition by chr, strand, win_start), 6) as occupancy, cluster = 0 as noise from cl group by chr, strand, win_start, cluster""",
    "signal_", "reads_", recursive=True,
)
def duet_cluster_summary(spark, d):
    return _round(duet.cluster_summary(duet.cluster_windows(duet.read_features(_events(spark, d), _sites(spark, d)))))


@query()
def duet_ensembles(spark, d):
    return _round(_duet(spark, d)["ensembles"])


@query()
def duet_ensemble_bases(spark, d):
    return _round(_duet(spark, d)["bases"])


# ---------------------------------------------------------------- formats


@query(
    """with x as (select 'chr' || (p_partkey % 3) as chr, p_partkey::int as pos, substr('ACGT', (p_size % 4)::int + 1, 1) as base, p_size::bigint as a, (p_size * 2)::bigint as c, (p_partkey % 5)::bigint as g, (p_partkey % 7)::bigint as t, (p_partkey % 3)::bigint as ins from part)
select chr, '+' as strand, pos, base, a + c + g + t - case base when 'A' then a when 'C' then c when 'G' then g else t end as mut_count, a + c + g + t as depth, ins, a as base_a, c as base_c, g as base_g, t as base_t from x"""
)
def fmt_bamreadcount(spark, d):
    p, a, c, g, t = (F.col("p_partkey"), F.col("p_size").cast("long"), (F.col("p_size") * 2).cast("long"), F.col("p_partkey") % 5, F.col("p_partkey") % 7)
    field = lambda k, v: F.concat(F.lit(f"{k}:"), v, F.lit(":60.00:37.00"))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), p % 3), p.cast("string"), F.substring(F.lit("ACGT"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)), (a + c + g + t).cast("string"), F.lit("=:0:0"), field("A", a), field("C", c), field("G", g), field("T", t), F.lit("N:0:0"), field("+", p % 3))
    out = convert.bamreadcount(spark.read.parquet(f"{d}/part.parquet").select(line.alias("value")))
    return out.select(*KEY, "base", "mut_count", "depth", "ins", "base_a", "base_c", "base_g", "base_t")


@query(
    """with m as (select chr, strand, pos, mut_count, depth from pileup_mod_), s as (select chr, strand, pos, stop_count, depth from pileup_unmod_)
select coalesce(m.chr, s.chr) as chr, coalesce(m.strand, s.strand) as strand, coalesce(m.pos, s.pos) as pos, coalesce(mut_count, 0) as mut_count, coalesce(stop_count, 0) as stop_count, greatest(coalesce(m.depth, 0), coalesce(s.depth, 0)) as depth
from m full join s on m.chr = s.chr and m.strand = s.strand and m.pos = s.pos""",
    "pileup_mod_", "pileup_unmod_",
)
def fmt_rctools_dual(spark, d):
    return convert.rctools_dual(_full(_mod(spark, d)), _full(_unmod(spark, d))).select(*KEY, "mut_count", "stop_count", "depth")


@query(
    """with x as (select 'chr' || (p_partkey % 3) as chr, p_partkey::int as pos, substr('ACGT', (p_size % 4)::int + 1, 1) as base, p_size::bigint as a, (p_partkey % 5)::bigint as c, (p_partkey % 7)::bigint as g, (p_partkey % 2)::bigint as t, case when p_partkey % 2 = 0 then '-' else '+' end as strand from part)
select chr, strand, pos, base, a + c + g + t - case base when 'A' then a when 'C' then c when 'G' then g else t end as mut_count, a + c + g + t as depth from x"""
)
def fmt_samtools_mpileup(spark, d):
    p, a = F.col("p_partkey"), F.col("p_size").cast("long")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), p % 3), p.cast("string"), F.substring(F.lit("ACGT"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)), F.when(p % 2 == 0, "-").otherwise("."), *[x.cast("string") for x in (a + p % 5 + p % 7 + p % 2, a, p % 5, p % 7, p % 2)], F.lit("0"))
    return convert.samtools_mpileup(spark.read.parquet(f"{d}/part.parquet").select(line.alias("value"))).select(*KEY, "base", "mut_count", "depth")


@query("select 'chr' || (p_partkey % 3) as chr, '+' as strand, p_partkey::int as pos, p_size::bigint as stop_count, (p_size + p_partkey % 9)::bigint as depth from part where p_partkey % 4 <> 0")
def fmt_icshape_rt(spark, d):
    p = F.col("p_partkey")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), p % 3), F.when(p % 4 == 0, "-").otherwise("+"), p.cast("string"), F.concat(F.col("p_size").cast("string"), F.lit(".75")), F.concat((p % 9).cast("string"), F.lit(".25")))
    return convert.icshape_rt(spark.read.parquet(f"{d}/part.parquet").select(line.alias("value"))).select(*KEY, "stop_count", "depth")


@query("select p_partkey, case when p_retailprice / 2000.0 < 0.3 then '#d9d9d9' when p_retailprice / 2000.0 < 0.65 then '#f5c04a' else '#d7301f' end as color from part")
def color_buckets(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", C.color_bucket(F.col("p_retailprice").cast("double") / 2000.0, C.DEFAULT_RANGES).alias("color"))
