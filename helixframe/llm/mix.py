"""Mixing sources to target weights by hash-threshold histograms.

DataFrame operations only. Every document has a fixed hash; a source's mix
takes the documents whose hash is below the source's threshold, so the choice
needs no sort, is the same on every run, and smaller budgets are nested in
larger ones. The threshold is found by histograms: sum the words by source and
leading hash digits, find the bucket in which the budget falls, and look at the
next digits of that bucket alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .util import BROADCAST_ROWS, cut

#: Fixed values of the contract: repeating weights of the sources in code point order, and the most repeats.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3

#: The hash has 60 bits: 5 histogram levels of 12.
LEVELS, BITS = 5, 12


def word_count(text: Column) -> Column:
    """Number of maximal runs of bytes other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id's decimal text ('' for null), as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = MOST_REPEATS) -> DataFrame:
    """Target of each source from ``source, source_size``.

    Sources in code point order (null last) get the weights in turn and share
    the whole of all sizes; a target stops at ``cap`` times its source's size
    and the excess goes to the others by weight until none is above. That fixed
    point has a closed form: order the sources by the share at which they fill
    up; the first k are full, where k is the least number for which the rest,
    sharing what is left, stay below their caps. One row per source only.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("weight"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("w_all", F.sum("weight").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("share", (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
        # the share per unit of weight once all sources that fill up earlier are full
        .withColumn("open", F.col("cap") >= F.col("share") * F.col("weight"))
        .withColumn("level", F.coalesce(F.min(F.when(F.col("open"), F.struct(F.row_number().over(fill).alias("k"), "share"))).over(every)["share"], F.lit(0.0)))
        .withColumn("any_open", F.max("open").over(every))
    )
    target = F.when(F.col("any_open"), F.least(F.col("cap"), F.col("level") * F.col("weight"))).otherwise(F.col("cap"))
    return s.select("source", "source_size", target.alias("target"))


def _digit(level: int) -> Column:
    """Bucket of the hash at a level: its leading (level + 1) * BITS bits."""
    return F.shiftright(F.col("h"), (LEVELS - 1 - level) * BITS)


def hash_thresholds(sized: DataFrame, budgets: DataFrame, names: Sequence[str] = ("budget",)) -> DataFrame:
    """Largest hash taken for every source and budget column.

    ``sized``: source, size, h. ``budgets``: source and one double column per
    name; budgets of one source may be nested in any number. Words of hashes up
    to the threshold come nearest to the budget: the hash in which the budget
    falls is taken if its middle lies below it. Returns source, name, threshold
    (-1: take nothing).

    Each level sums words by (source, bucket), map-side combined, and only rows
    of boundary buckets are read at the next level; all tables but ``sized``
    have one row per source and budget.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("budget")) for n in names]))
    state = budgets.select("source", stack.alias("x")).select(
        "source", "x.name", "x.budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("done")
    )
    state = cut(state)
    few = state.count() <= BROADCAST_ROWS
    side = F.broadcast if few else (lambda x: x)
    for level in range(LEVELS):
        state = state.drop("g")
        rows = sized.select("source", "size", F.col("h")).withColumn("bucket", _digit(level))
        if level == 0:
            hist = rows.groupBy("source", "bucket").agg(F.sum("size").alias("g"))
            cand = hist.join(side(state), hist["source"].eqNullSafe(state["source"])).drop(hist["source"])
        else:
            want = state.select("source", F.col("prefix").alias("p")).distinct()
            r = rows.join(side(want), rows["source"].eqNullSafe(want["source"]) & (F.shiftright(F.col("bucket"), BITS) == F.col("p"))).drop(want["source"])
            hist = r.groupBy("source", "bucket").agg(F.sum("size").alias("g"))
            cand = hist.join(side(state), hist["source"].eqNullSafe(state["source"]) & (F.shiftright(hist["bucket"], BITS) == state["prefix"])).drop(hist["source"])
        run = W.partitionBy("source", "name").orderBy("bucket")
        cand = cand.withColumn("upto", F.col("below") + F.sum("g").over(run))
        # the boundary bucket: the first whose running sum reaches the budget; the last bucket if none does
        reach = F.struct(F.when(F.col("upto") >= F.col("budget"), F.lit(0)).otherwise(F.lit(1)), F.when(F.col("upto") >= F.col("budget"), F.col("bucket")).otherwise(-F.col("bucket")))
        pick = cand.groupBy("source", "name").agg(
            F.min_by(F.struct(F.col("bucket").alias("prefix"), (F.col("upto") - F.col("g")).alias("below"), "g", "budget"), reach).alias("b")
        )
        state = cut(pick.select("source", "name", "b.budget", "b.prefix", "b.below", "b.g"))
    take = F.col("below") + F.col("g") / 2.0 < F.col("budget")
    return state.select("source", "name", F.when(take, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = MOST_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Repeats of every document in the mix: doc_id, source, size, source_size, target, copies, taken.

    A source with target t and size s is taken floor(t / s) times whole, and
    documents below its hash threshold once more, so that its words come within
    half a document of t and no document exceeds ``cap`` times its size. Null
    or empty texts have size 0; null is a source of its own; rows that repeat a
    doc_id share a hash and are taken alike; a source of size 0 has target 0
    and takes nothing; an empty table gives an empty result. Other columns of
    ``docs`` are ignored.
    """
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), doc_hash(F.col(id_col)).alias("h")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(sizes, weights, cap)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = cut(goals.withColumn("base", base).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")))
    cuts = hash_thresholds(sized, goals.select("source", "budget")).select(F.col("source").alias("s2"), "threshold")
    goals = cut(goals.join(cuts, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2"))
    few = goals.count() <= BROADCAST_ROWS
    g = goals.select(F.col("source").alias("s2"), "source_size", "target", "base", "threshold")
    out = sized.join(F.broadcast(g) if few else g, F.col("source").eqNullSafe(F.col("s2")))
    copies = F.col("base") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it (columns unchanged).

    Documents are matched to their decision by the threshold of their source,
    not by id, so the texts are not shuffled while the sources are few.
    """
    m = mix_sources(docs, **options)
    rule = cut(
        m.groupBy("source").agg(
            F.min("copies").alias("base"), F.max("copies").alias("most"), F.max(F.struct("copies", doc_hash(F.col("doc_id")).alias("h")))["h"].alias("top")
        ).withColumn("top", F.when(F.col("most") > F.col("base"), F.col("top")).otherwise(F.lit(-1)))
    )
    few = rule.count() <= BROADCAST_ROWS
    r = rule.select(F.col("source").alias("_mix_source"), F.col("base").alias("_mix_base"), F.col("top").alias("_mix_top"))
    copies = F.col("_mix_base") + F.when(doc_hash(F.col("doc_id")) <= F.col("_mix_top"), 1).otherwise(0)
    out = docs.join(F.broadcast(r) if few else r, docs["source"].eqNullSafe(F.col("_mix_source")))
    return out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(copies, F.lit(1).cast("long"))))).where(copies > 0).select(*docs.columns)


def op5_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
src as (select source, sum(size)::bigint as source_size from sized group by source),
w as (select *, (case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as weight,
             source_size * 3.0::double as cap from src),
f as (select *, row_number() over (order by cap / weight, source is null, source) as k,
             sum(source_size) over ()::double as total, sum(weight) over () as w_all,
             coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as cap_before,
             coalesce(sum(weight) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as w_before from w),
sh as (select *, (total - cap_before) / (w_all - w_before) as share from f),
lv as (select share as level from sh where cap >= share * weight order by k limit 1),
goal as (select source, source_size, least(cap, coalesce((select level from lv) * weight, cap)) as target from sh),
goal2 as (select *, (case when source_size > 0 then floor(target / source_size) else 0 end)::bigint as base from goal),
per as (select source, h, sum(size) as g from sized group by source, h),
cum as (select source, h, g, sum(g) over (partition by source order by h) as c from per),
cutoff as (select g.source, max(c.h) as threshold from goal2 g join cum c on g.source is not distinct from c.source
           where c.c - c.g / 2.0 < g.target - g.base * g.source_size group by g.source)
select s.doc_id, s.size, g.source_size, g.target,
       (s.size * (g.base + case when s.h <= c.threshold then 1 else 0 end))::bigint as taken
from sized s join goal2 g on s.source is not distinct from g.source
left join cutoff c on c.source is not distinct from s.source
"""
