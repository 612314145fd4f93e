"""Language identification with error-correcting output codes.

Each language has a codeword; a binary classifier on hashed byte n-grams
predicts each bit; decoding picks the codeword of least weighted loss, and
flags texts whose two best codewords are nearly as good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytefeat import gram_buckets, padded, pieces, text_buffers
from .util import step, stored

BITS, ORDERS = 12, (1, 2, 3)

#: The classifier is fitted on a sample of about so many rows, spread evenly over the languages.
MAX_TRAIN_ROWS = 2000

#: Languages learned: those with the most rows (ties by name).
MAX_LANGS = 256

#: Answer for texts without a letter.
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: CRC-32 of the id's text leaves 1 modulo 3 (null: '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of -1 and 1, far apart; every column has both signs.

    Up to 5 classes: all 2**(k-1) - 1 distinct splits. More: the best of seeded
    random codes of about 10 log2(k) bits, by least distance.
    """
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 5:
        n = 2 ** (k - 1) - 1
        code = np.array([[1] * n] + [[1 if (c >> (k - 1 - r)) & 1 else -1 for c in range(n)] for r in range(1, k)], np.float32)
        return code
    rng = np.random.default_rng(seed)
    n, best, far = int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.float32), (k, n))
        if (np.abs(c.sum(0)) == k).any():
            continue
        d = ((n - c @ c.T) / 2 + np.eye(k) * n).min()
        if d > far:
            best, far = c, d
    return best


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of length 1: square roots of the counts of hashed 1- to 3-byte grams of whole texts, A-Z lowered."""
    n_rows, width = len(offsets) - 1, 1 << BITS
    buf, first = padded(data, offsets)
    buf[(buf >= 65) & (buf <= 90)] += 32
    base = np.repeat(np.arange(n_rows, dtype=np.int64) * width, np.diff(np.append(first, len(buf) - 1)))
    counts = np.zeros(n_rows * width, np.float32)
    for n in ORDERS:
        bucket, ok = gram_buckets(buf, n, BITS)
        m = min(len(bucket), len(base))
        ok = ok[:m]
        counts += np.bincount(base[:m][ok] + bucket[:m][ok], minlength=n_rows * width)
    x = np.sqrt(counts.reshape(n_rows, width))
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weight: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits: weights of the decoding loss, rows sum to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Trust-weighted logistic loss of each row against each codeword."""
        f = x @ self.weight + self.bias
        agree = np.logaddexp(0, -f)  # loss if the bit is 1
        differ = np.logaddexp(0, f)
        plus = self.code > 0
        return agree @ np.where(plus, self.trust, 0).T + differ @ np.where(plus, 0, self.trust).T

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous)."""
        loss = self.losses(x)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, top[:, -1], top[:, -1] - second < 0.2


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], rounds: int = 300, rate: float = 30.0, decay: float = 1e-5) -> Model:
    """One logistic classifier per bit, all bits at once, by gradient descent; classes count alike.

    The trust of a bit for a language is the share of that language's rows for
    which the bit came out right, less chance.
    """
    code = codewords(len(langs))
    target = code[y]
    share = 1.0 / np.maximum(np.bincount(y, minlength=len(langs)), 1)
    row_w = (share[y] / share[y].sum()).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    for _ in range(rounds if len(langs) > 1 else 0):
        f = x @ w + b
        g = -target * row_w / (1 + np.exp(np.clip(target * f, -30, 30)))
        w -= rate * (x.T @ g + decay * w)
        b -= rate * 0.1 * g.sum(0)
    right = ((x @ w + b) * target > 0).astype(np.float64)
    trust = np.stack([np.clip(right[y == i].mean(0) if (y == i).any() else np.ones(code.shape[1]), 0.5, 1) - 0.45 for i in range(len(langs))])
    return Model(langs, code, w, b, (trust / trust.sum(1, keepdims=True)).astype(np.float32))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, _ = text_buffers(batch.column(1))
        for i, j in pieces(offsets):
            x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def learn(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_langs: int = MAX_LANGS) -> Model | None:
    """Fit on ``docs`` (doc_id, text, lang): rows held out, or with null text or lang, are not used.

    The sample is chosen by a hash of the row, at a rate per language that
    gives about ``max_rows`` rows in all; rows that repeat another count once;
    only feature vectors reach the driver, and the table of rates has at most
    ``max_langs`` rows. None if nothing is left to learn from.
    """
    spark = docs.sparkSession
    seen = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = seen.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max_langs).collect()
    if not counts:
        return None
    each = max(1, max_rows // len(counts))
    rates = spark.createDataFrame([(r["lang"], int(min(1.0, each / r["count"]) * 2**60)) for r in counts], "lang string, rate long")
    sample = seen.join(F.broadcast(rates), "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 4) <= F.col("rate"))
    with step(spark):
        rows = sample.select("lang", "text").mapInArrow(_feature_batches, "lang string, x binary").distinct().toArrow()
    if not rows.num_rows:
        return None
    names = rows.column("lang").to_pylist()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(len(names), -1).astype(np.float32)
    order = sorted(range(len(names)), key=lambda i: (names[i], x[i].tobytes()))  # rows arrive in any order
    present = sorted(set(names))
    return fit(x[order], np.array([present.index(names[i]) for i in order]), present)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row, from its whole text alone.

    Null texts, texts without a letter and, with no model, all texts get
    ``und`` with score 0. Repeated rows get equal answers; ties go to the
    language of least name; other columns are ignored; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = text_buffers(batch.column(1))
            usable = np.asarray(batch.column(2).to_pylist(), bool)
            n = batch.num_rows
            lang, score, vague = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
            if model is not None:
                for i, j in pieces(offsets):
                    lang[i:j], score[i:j], vague[i:j] = model.predict(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            lang[~usable] = -1
            out = [model.langs[k] if k >= 0 else UNDETERMINED for k in lang]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(out, pa.string()), pa.array(np.where(lang >= 0, score, 0.0)), pa.array(vague | (lang < 0))],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("usable"), held_out(F.col(id_col)).alias("held_out"))
    return stored(rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"), "languages")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, learn(docs))
