"""Quality classifier on supervised subword embeddings.

Hashed vectors of words and of character n-grams inside words are averaged over
a document and fed to a softmax; vectors and softmax are learned together by
stochastic gradient descent in numpy. As the model is linear in the average,
scoring reads one number per word or n-gram from a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytefeat import gram_buckets, padded, pieces, span_hashes, text_buffers, words
from .langid import held_out
from .mix import doc_hash
from .util import step, stored

BITS, ORDERS, DIM = 16, (2, 3, 4), 16

#: With ``repeats``, a word that follows itself adds the vector of this bucket, whatever the word.
REPEAT = 1

#: The classifier is fitted on a sample of about so many labelled rows, half of them of either label if there are enough.
MAX_TRAIN_ROWS = 3000


def _grams(data: np.ndarray, offsets: np.ndarray, repeats: bool):
    """For words, repeats of words, then each gram order: (bucket, counted, text starts or None, rows or None)."""
    buf, first = padded(data, offsets)
    s, e, _ = words(buf, np.array([0, len(buf)]))
    row = np.searchsorted(first, s, side="right") - 1
    word = span_hashes(buf, s, e)
    yield (word >> np.uint64(64 - BITS)).astype(np.uint32), None, None, row
    if repeats:
        again = row[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])]
        yield np.full(len(again), REPEAT, np.uint32), None, None, again
    for n in ORDERS:
        bucket, ok = gram_buckets(buf, n, BITS)
        yield bucket, ok, first, None


def counts(data: np.ndarray, offsets: np.ndarray, repeats: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    n_rows = len(offsets) - 1
    keys = []
    for bucket, ok, first, row in _grams(data, offsets, repeats):
        if row is None:
            row = np.searchsorted(first, np.arange(len(bucket)), side="right") - 1
            bucket, row = bucket[ok], row[ok]
        keys.append((row.astype(np.int64) << BITS) | bucket)
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    edge = np.searchsorted(key >> BITS, np.arange(n_rows + 1))
    low = (key & ((1 << BITS) - 1)).astype(np.uint16)
    return [(low[a:b], n[a:b].astype(np.uint32)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


@dataclass
class Model:
    table: np.ndarray  # log-odds of each bucket
    bias: float
    repeats: bool = False

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n_rows = len(offsets) - 1
        total, number = np.zeros(n_rows), np.zeros(n_rows)
        for bucket, ok, first, row in _grams(data, offsets, self.repeats):
            if row is not None:
                total += np.bincount(row, self.table[bucket], n_rows)
                number += np.bincount(row, minlength=n_rows)
            elif len(bucket):
                on = first < len(bucket)  # texts near the end may be shorter than a gram
                at = first[on]
                total[on] += np.add.reduceat(np.where(ok, self.table[bucket], np.float32(0)), at, dtype=np.float64)
                number[on] += np.add.reduceat(ok, at, dtype=np.int64)
        return total / np.maximum(number, 1) + self.bias


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 3.0, seed: int = 11) -> Model:
    """Embeddings, averaged per document, and softmax, by SGD on weighted cross-entropy with a falling rate.

    The gradient of an average spreads thinly over its terms, so steps on the
    embeddings are scaled up by a fixed factor.
    """
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i : i + batch]
            lens = np.array([len(docs[k][0]) for k in pick])
            ids = np.concatenate([docs[k][0] for k in pick]).astype(np.int64)
            n = np.concatenate([docs[k][1] for k in pick]).astype(np.float32)
            row = np.repeat(np.arange(len(pick)), lens)
            x = n / np.maximum(np.bincount(row, n, len(pick)), 1)[row].astype(np.float32)
            used, place = np.unique(ids, return_inverse=True)
            dense = np.zeros((len(pick), len(used)), np.float32)
            dense[row, place] = x
            vec = emb[used]
            hidden = dense @ vec
            z = hidden @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            g = p * weight[pick, None] / len(pick)
            lr = rate * (1 - step / steps)
            step += 1
            emb[used] = vec - 50 * lr * (dense.T @ (g @ out.T))
            out -= lr * (hidden.T @ g)
            bias -= lr * g.sum(0)
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _count_batches(repeats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = text_buffers(batch.column(2))
            for i, j in pieces(offsets):
                c = counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], repeats)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([a.tobytes() for a, _ in c], pa.binary()), pa.array([b.tobytes() for _, b in c], pa.binary())],
                    ["doc_id", "quality", "ids", "n"],
                )

    return run


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, repeats: bool = False) -> Model:
    """Fit on labelled rows that are not held out.

    Labels other than 0 and 1, and null ids, are ignored. The sample is chosen
    from the labels alone, by hash of the id, so only a table of bounded size
    is joined to the documents and texts stay where they are; of rows that
    share an id one is taken. Rows are weighted back to the labels' shares.
    Without labels every score is 0.5. Words and character n-grams are the
    features; ``repeats`` adds one for words that follow themselves, which no
    gram of a single word can show.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    number = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not number:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    each = max_rows // 2
    rate = F.create_map(*[F.lit(v) for q, c in number.items() for v in (q, int(min(1.0, each / c) * 2**60))])
    picked = known.where(doc_hash(F.col("doc_id")) <= rate[F.col("quality")]).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
    with step(docs.sparkSession):
        counted = rows.mapInArrow(_count_batches(repeats), "doc_id long, quality int, ids binary, n binary")
        got = counted.groupBy("doc_id", "quality").agg(F.min(F.struct("ids", "n")).alias("x")).select("doc_id", "quality", "x.ids", "x.n").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    y = np.array(got.column("quality").to_pylist(), np.int64)
    share = np.array([number.get(q, 0) for q in (0, 1)], np.float64) / sum(number.values())
    if len(set(y.tolist())) < 2:  # one label or none among the rows: its share is all there is to say
        p = np.clip(share[1], 0.01, 0.99)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))
    sample = np.bincount(y, minlength=2) / len(y)
    x = [(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint32)) for a, b in zip(got.column("ids").to_pylist(), got.column("n").to_pylist(), strict=True)]
    return replace(fit(x, y, (share / sample)[y].astype(np.float32)), repeats=repeats)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from its whole text; columns ``keep`` pass through.

    Null and empty texts get the score of a text without features. Repeated
    rows get equal scores; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = text_buffers(batch.column(2))
            z = np.zeros(batch.num_rows)
            for i, j in pieces(offsets):
                z[i:j] = model.logits(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            kept = [batch.column(3 + i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *kept], ["doc_id", "held_out", "score", "predicted", *[f"kept_{i}" for i in range(len(keep))]]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    types = "".join(f", kept_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = stored(rows.mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int{types}"), "scores")
    return out.select("doc_id", "held_out", "score", "predicted", *[F.col(f"kept_{i}").alias(f"kept_{c}") for i, c in enumerate(keep)])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, learn(docs, labels, repeats=True))
