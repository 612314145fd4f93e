"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and split into low-dimensional blocks. Two vectors
within squared distance T agree in at least one block within that block's share
of T. Each block is range-joined by itself, strip by strip along its first
coordinate; what lies within the budget of a block is checked exactly on the
whole vectors, and a pair counts in the first block that finds it, so links are
counted without ever being listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .topk import usable
from .util import BROADCAST_ROWS, Scratch, connected_components, cut, rekeyed, shared_keys

#: Blocks a vector is split into.
BLOCKS = 4

#: A strip of more vectors than this is cut into chunks that meet pairwise.
CHUNK = 32_768

#: Rows of a distance matrix held at once.
TILE = 128


@lru_cache(maxsize=4)
def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def block_edges(d: int) -> np.ndarray:
    return np.linspace(0, d, min(BLOCKS, d) + 1).round().astype(int)


def budgets(d: int, total: float) -> np.ndarray:
    """Squared-distance budget of each block, in proportion to its dimensions, with room for rounding."""
    return total * np.diff(block_edges(d)) / d * (1 + 1e-9) + 1e-12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision (rows of zeros stay)."""
    x = x.astype(np.float64)
    top = np.abs(x).max(1, keepdims=True, initial=0)
    x = x / np.where(top > 0, top, 1)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def _strip_batches(total: float, kind: type):
    """cls, weight, vector -> one row per block with the strip of its first rotated coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in set(lens := b.column(2).value_lengths().to_pylist()):
                pick = [i for i, n in enumerate(lens) if n == d]
                part = b.take(pa.array(pick))
                x = part.column(2).flatten().to_numpy().reshape(-1, d)
                y = unit(x) @ rotation(d)
                raw = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                for k, (edge, w) in enumerate(zip(block_edges(d)[:-1], np.sqrt(budgets(d, total)), strict=True)):
                    strip = np.floor(y[:, edge] / (w * (1 + 1e-6))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), d, np.int32)), pa.array(np.full(len(x), k, np.int32)), pa.array(strip), part.column(0), part.column(1), raw], ["d", "block", "strip", "cls", "weight", "vec"]
                    )

    return run


def _pairs_within(ya: np.ndarray, yb: np.ndarray, ua: np.ndarray, ub: np.ndarray, k: int, d: int, total: float, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of linked pairs whose first block within budget is k, tile by tile; same: i < j only."""
    edge, budget = block_edges(d), budgets(d, total)
    a, b = ya[:, edge[k] : edge[k + 1]].astype(np.float32), yb[:, edge[k] : edge[k + 1]].astype(np.float32)
    # single precision finds candidates, with room for its rounding: |a|^2 + |b|^2 - 2 ab <= budget
    room = np.float32(budget[k] + 1e-5) - (a * a).sum(1)
    right = np.ascontiguousarray(np.concatenate([b, (b * b).sum(1)[:, None]], 1).T)
    left = np.concatenate([-2 * a, np.ones((len(a), 1), np.float32)], 1)
    for s in range(0, len(a), TILE):
        low = s + 1 if same else 0  # pairs i < j only: columns up to the tile's first row are done
        part = left[s : s + TILE] @ right[:, low:]
        at = np.flatnonzero(part <= room[s : s + TILE, None])
        i, j = np.divmod(at, right.shape[1] - low) if right.shape[1] > low else (at, at)
        j = j + low
        if same:
            keep = i + s < j
            i, j = i[keep], j[keep]
        i = i + s
        for p in range(0, len(i), 1 << 16):  # verify exactly, a bounded number at a time
            x, y = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
            ok = np.einsum("ij,ij->i", ua[x], ub[y]) >= cosine
            x, y = x[ok], y[ok]
            diff = np.add.reduceat((ya[x] - yb[y]) ** 2, edge[:-1], axis=1)
            within = diff[:, : k + 1] <= budget[: k + 1]
            found = within[:, k] & ~within[:, :k].any(1)
            if found.any():
                yield x[found], y[found]


def _link_batches(total: float, cosine: float, dtype: type):
    """Rows sorted by task; a task is one chunk against itself (side 0 only) or against another (sides 0 and 1)."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        d, k, kind = t.column(0)[0].as_py(), t.column(1)[0].as_py(), t.column(3)[0].as_py()
        side, cls, weight = np.asarray(t.column(6)), np.asarray(t.column(7)), np.asarray(t.column(8))
        u = unit(np.frombuffer(b"".join(t.column(9).to_pylist()), dtype).reshape(-1, d))
        y = u @ rotation(d)
        left = np.flatnonzero(side == 0)
        right = left if kind == 0 else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return None
        links, label = np.zeros(len(cls), np.int64), np.arange(len(cls))
        for i, j in _pairs_within(y[left], y[right], u[left], u[right], k, d, total, cosine, kind == 0):
            i, j = left[i], right[j]
            links += np.bincount(i, weight[j], len(cls)).astype(np.int64) + np.bincount(j, weight[i], len(cls)).astype(np.int64)
            while True:  # join labels to the least of each component
                low = np.minimum(label[i], label[j])
                new = label.copy()
                np.minimum.at(new, label[i], low)
                np.minimum.at(new, label[j], low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        hit = links > 0
        if not hit.any():
            return None
        while (label[label] != label).any():
            label = label[label]
        return pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(links[hit]), pa.array(cls[label[hit]])], ["cls", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(6)], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(keys[x])
                if key != current:
                    if held and (out := solve(held)) is not None:
                        yield out
                    held, current = [], key
                held.append(b.slice(x, y - x))
        if held and (out := solve(held)) is not None:
            yield out

    return run


def _class_key(vector: Column) -> Column:
    return F.xxhash64(vector)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors link if their cosine, in double precision, is at least ``cosine``.
    Null or zero vectors, and vectors with null or non-finite components, link
    with nothing; vectors of different length do not link; rows that repeat a
    vector are copies, each linked to the others. component_id is the smallest
    vec_id reachable. Other columns are ignored; an empty table gives an empty
    result.

    Equal vectors are one class with a weight. In each block a class goes to
    its strip (as wide as the block's budget, so partners are in the same or
    the next strip); strips beyond CHUNK classes are cut into chunks that meet
    pairwise, so no task holds more than two chunks. Tasks return a row per
    linked class and block at most: links counted and the least class reached.
    """
    with Scratch(vectors.sparkSession) as tmp:
        return tmp.keep(tmp.stored(_near_vectors(vectors, tmp, cosine, id_col, vector_col), "near"))


def _near_vectors(vectors: DataFrame, tmp: Scratch, cosine: float, id_col: str, vector_col: str) -> DataFrame:
    total = 2.0 - 2.0 * cosine
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    fit = usable(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("ok", fit)
    v = v.withColumn("cls", F.when(F.col("ok"), _class_key(F.col("v")))).withColumn("check", F.xxhash64(F.lit(-1), "v"))
    classes = tmp.stored(v.where("ok").groupBy("cls", "check").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.any_value("v").alias("v")), "classes")
    shared = shared_keys(classes)
    v, classes = rekeyed(v, shared), rekeyed(classes, shared)
    # single precision travels as it is; all is computed in double
    kind, name = (np.float32, "float") if v.schema["v"].dataType.elementType.simpleString() == "float" else (np.float64, "double")
    strips = tmp.stored(
        classes.select("cls", "weight", F.transform("v", lambda x: x.cast(name)).alias("v")).mapInArrow(_strip_batches(total, kind), "d int, block int, strip long, cls long, weight long, vec binary"), "strips", 4096
    )
    sizes = cut(strips.groupBy("d", "block", "strip").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    side = F.broadcast if sizes.count() <= BROADCAST_ROWS else (lambda x: x)
    near = sizes.select("d", "block", "strip", "chunks")
    for name, shift in (("next", -1), ("prev", 1)):
        near = near.join(side(sizes.select("d", "block", (F.col("strip") + shift).alias("strip"), F.col("chunks").alias(name))), ["d", "block", "strip"], "left")
    near = near.withColumn("next", F.coalesce("next", F.lit(0))).withColumn("prev", F.coalesce("prev", F.lit(0)))
    rows = strips.join(side(near), ["d", "block", "strip"]).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("chunks")).cast("int"))

    def task(strip, kind, i, j, s):
        return F.struct(strip.alias("strip"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), s.alias("side"))

    own, zero, one = F.col("own"), F.lit(0), F.lit(1)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # kind 0: a chunk against itself; 1: two chunks of a strip; 2: a chunk against one of the next strip
    within = F.transform(upto(F.col("chunks")), lambda j: F.when(j == own, task(F.col("strip"), 0, own, own, zero)).when(own < j, task(F.col("strip"), 1, own, j, zero)).otherwise(task(F.col("strip"), 1, j, own, one)))
    ahead = F.transform(upto(F.col("next")), lambda j: task(F.col("strip"), 2, own, j, zero))
    behind = F.transform(upto(F.col("prev")), lambda j: task(F.col("strip") - 1, 2, j, own, one))
    dealt = rows.select("d", "block", "cls", "weight", "vec", F.explode(F.concat(within, ahead, behind)).alias("t")).select("d", "block", "t.strip", "t.kind", "t.i", "t.j", "t.side", "cls", "weight", "vec")
    keys = ["d", "block", "strip", "kind", "i", "j"]
    found = tmp.stored(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link_batches(total, cosine, kind), "cls long, links long, root long"), "links", 4096)
    tmp.drop(strips)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    owner = (
        classes.select("cls", "least", "weight")
        .join(links, "cls", "left")
        .join(comps.select(F.col("node").alias("cls"), "component"), "cls", "left")
        .withColumn("component", F.coalesce("component", "cls"))
    )
    least = owner.groupBy("component").agg(F.min("least").alias("component_id"))
    named = owner.join(least, "component").select(F.col("cls").alias("cls2"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = v.select("vec_id", "cls").join(named, F.col("cls") == F.col("cls2"), "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, comp.isNull()).alias("kept"))


def op4_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP4_SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
g as (select * from v where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_inner_product(v, v) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
      where list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9),
r as (select vec_id as node, vec_id as seen from v union select r.node, l.b from r join l on l.a = r.seen)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join (select node, min(seen) as component_id from r group by node) c on c.node = v.vec_id
left join (select a, count(*) as n from l group by a) n on n.a = v.vec_id
"""
