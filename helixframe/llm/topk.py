"""Exact top-k inner products with block-at-a-time pruning.

Vectors are indexed in segments; a segment is a run of blocks, document ranges
that each have a forward index (its vectors) and the maxima of its signed terms.
Groups of queries meet groups of segments in cells. In a cell, a query sums term
maxima into an upper bound for every block, takes blocks from the highest bound
down, and stops when a bound falls below its k-th best score, which starts at
the floor that its own segment gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .util import Scratch

#: Vectors of a block, and of a segment: the unit that is moved.
BLOCK, SEGMENT = 128, 2048

#: Segments and queries of a cell, on average, and the least number of cells if there are segments for them.
CELL_SEGMENTS, CELL_QUERIES, LEAST_CELLS = 24, 2048, 24


def usable(vector: Column) -> Column:
    """No null vector, no null or non-finite component."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantize(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of a list<long> column, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lens = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lens), width), kind)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _order_key(x: np.ndarray) -> np.ndarray:
    """Signs of fixed random projections as an integer: near vectors often share it."""
    rng = np.random.default_rng(5)
    p = rng.standard_normal((x.shape[1], 16))
    return ((x.astype(np.float64) @ p > 0) @ (1 << np.arange(15, -1, -1))).astype(np.int32)


def _key_batches(width: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), width, kind)
                yield pa.RecordBatch.from_arrays([pa.array(_order_key(x)), b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "vec_id", "vec"])

    return run


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in single or double precision where 24 or 53 bits are enough."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * x.shape[1]
    if most < 2**24:
        return (x.astype(np.float32) @ q.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64).T


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, by query: score descending, then id ascending."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    head = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
    return order[rank < k]


def _kth(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, score: np.ndarray, vec: np.ndarray) -> None:
    """Raise each query's bound (score, id of the k-th best) to that of its k found, which ``_best`` has put in order."""
    count = np.bincount(query, minlength=len(score))
    last = np.cumsum(count) - 1
    full = np.flatnonzero(count == k)
    s, v = scores[last[full]], ids[last[full]]
    up = (s > score[full]) | ((s == score[full]) & (v < vec[full]))
    score[full[up]], vec[full[up]] = s[up], v[up]


def _segment_batches(width: int, kind: type, k: int, every: int):
    """Sorted vectors to segments; each query among them gets a floor: score and id of its k-th best in the segment."""

    def flush(rows: list[tuple[int, bytes]], name: str) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], np.int64)
        x = np.frombuffer(b"".join(r[1] for r in rows), kind).reshape(len(rows), width)
        q = np.flatnonzero(ids % every == 0)
        score, vec = np.full(len(q), np.iinfo(np.int64).min), np.full(len(q), np.iinfo(np.int64).max)
        if len(q):
            s = _scores(x[q], x)
            least = np.partition(s, max(len(rows) - k - 1, 0), axis=1)[:, max(len(rows) - k - 1, 0)]  # the query's own row may be one of the best
            i, j = np.nonzero((s >= least[:, None]) & (ids[None, :] != ids[q][:, None]))
            keep = _best(i, ids[j], s[i, j], k)
            _kth(i[keep], ids[j[keep]], s[i[keep], j[keep]], k, score, vec)
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([len(q)], pa.int64()), *(pa.array([z.tobytes()], pa.binary()) for z in (ids, x, ids[q], x[q], np.stack([score, vec])))],
            ["segment", "n_queries", "ids", "vecs", "query_ids", "query_vecs", "floors"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes]] = []
        last, key0 = None, 0
        for b in batches:
            for key, vec_id, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (vec_id, vec) == last:  # a repeated row
                    continue
                last = (vec_id, vec)
                if not rows:
                    key0 = key
                rows.append(last)
                if len(rows) == SEGMENT:
                    yield flush(rows, f"{key0}-{rows[0][0]}")
                    rows = []
        if rows:
            yield flush(rows, f"{key0}-{rows[0][0]}")

    return run


def _search(qid: np.ndarray, q: np.ndarray, score: np.ndarray, vec: np.ndarray, ids: np.ndarray, x: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the query, id, score) of the k best of each query among some blocks; score and vec are the floors."""
    ends = np.append(starts[1:], len(ids))
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    first = np.minimum.reduceat(ids, starts)
    bound = _scores(np.maximum(q, 0), high) + _scores(np.minimum(q, 0), low)  # queries x blocks
    order = np.argsort(-bound, axis=1, kind="stable")
    found = [np.zeros(0, np.int64)] * 3
    at, step, active = 0, 1, np.arange(len(qid))
    while at < len(starts) and len(active):
        # a query whose next bound is below its k-th best is done: later bounds are lower still
        active = active[bound[active, order[active, at]] >= score[active]]
        take = order[active, at : at + step]
        who, blk = np.repeat(active, take.shape[1]), take.ravel()
        top = bound[who, blk]
        on = (top > score[who]) | ((top == score[who]) & (first[blk] <= vec[who]))  # not those that can only tie with larger ids
        who, blk = who[on], blk[on]
        by = np.argsort(blk, kind="stable")
        who, blk = who[by], blk[by]
        edge = [0, *(np.flatnonzero(blk[1:] != blk[:-1]) + 1).tolist(), len(blk)] if len(blk) else [0]
        new: list[list[np.ndarray]] = [[z] for z in found]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            one, lo, hi = who[a:b], starts[blk[a]], ends[blk[a]]
            part = ids[lo:hi]
            s = _scores(q[one], x[lo:hi])
            ok = (s > score[one, None]) | ((s == score[one, None]) & (part[None, :] <= vec[one, None]))
            i, j = np.nonzero(ok & (part[None, :] != qid[one, None]))
            for z, y in zip(new, (one[i], part[j], s[i, j]), strict=True):
                z.append(y)
        found = [np.concatenate(z) for z in new]
        keep = _best(*found, k)
        found = [z[keep] for z in found]
        _kth(*found, k, score, vec)
        at += step
        step *= 2
    return tuple(found)


def _cell_batches(width: int, kind: type, k: int):
    """Rows sorted by cell, queries before segments: what each cell has of its queries' k best."""

    def solve(queries: list[tuple], segments: list[tuple]) -> pa.RecordBatch | None:
        if not queries or not segments:
            return None
        qid, ids = (np.concatenate([np.frombuffer(r[0], np.int64) for r in rows]) for rows in (queries, segments))
        q, x = (np.concatenate([np.frombuffer(r[1], kind).reshape(-1, width) for r in rows]) for rows in (queries, segments))
        floors = np.concatenate([np.frombuffer(r[2], np.int64).reshape(2, -1) for r in queries], axis=1)
        lens = np.array([len(r[0]) // 8 for r in segments])
        starts = np.concatenate([np.arange(0, n, BLOCK) + at for n, at in zip(lens, np.cumsum(lens) - lens, strict=True)])
        who, vec, score = _search(qid, q, floors[0].copy(), floors[1].copy(), ids, x, starts, k)
        return pa.RecordBatch.from_arrays([pa.array(qid[who]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, ([], [])
        for b in batches:
            for name, side, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if name != cell:
                    if (out := solve(*held)) is not None:
                        yield out
                    cell, held = name, ([], [])
                held[side].append(row)
        if (out := solve(*held)) is not None:
            yield out

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` the k best other rows, exactly.

    Score: inner product of the quantized vectors, shorter ones padded with
    zeros; ties go to the smaller id. Null vectors, vectors with null or
    non-finite components and null ids take no part; a row that repeats id and
    vector counts once; several vectors under one id are several candidates and
    one query with the best of both; other columns are ignored. Empty input:
    empty result.

    Every group of queries meets every group of segments once, in a cell of
    bounded size; a vector is copied once for each group of queries, a query
    once for each group of segments. Only what can still be among a query's k
    best leaves a cell, k rows at most.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select("vec_id", quantize(F.col("v"), scale).alias("v"))
    width, most = v.agg(F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    width, most = max(1, width or 0), most or 0
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    with Scratch(spark) as tmp:
        ordered = v.mapInArrow(_key_batches(width, kind), "key int, vec_id long, vec binary").repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id", "vec")
        index = tmp.stored(
            ordered.mapInArrow(_segment_batches(width, kind, k, every), "segment string, n_queries long, ids binary, vecs binary, query_ids binary, query_vecs binary, floors binary"), "segments", 4096
        )
        n_segments, n_queries = index.agg(F.count("*"), F.coalesce(F.sum("n_queries"), F.lit(0))).first()
        q_groups = max(1, -(-n_queries // CELL_QUERIES))
        s_groups = max(1, -(-n_segments // CELL_SEGMENTS), min(n_segments, -(-LEAST_CELLS // q_groups)))
        own = lambda seed, groups: F.pmod(F.xxhash64("segment", F.lit(seed)), F.lit(groups))
        each = lambda groups: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
        queries = index.where("n_queries > 0").select(own(1, q_groups).alias("a"), each(s_groups).alias("b"), F.lit(0).alias("side"), "query_ids", "query_vecs", "floors")
        segments = index.select(each(q_groups).alias("a"), own(2, s_groups).alias("b"), F.lit(1).alias("side"), "ids", "vecs", F.lit(None).cast("binary"))
        cells = queries.union(segments).withColumn("cell", F.col("a") * s_groups + F.col("b")).select("cell", "side", "query_ids", "query_vecs", "floors")
        found = cells.repartition(q_groups * s_groups, "cell").sortWithinPartitions("cell", "side").mapInArrow(_cell_batches(width, kind, k), "query_id long, vec_id long, score long")
        best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        return tmp.keep(tmp.stored(out, "best", 16))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP2_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify rank <= 20
"""
