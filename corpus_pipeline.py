"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, minhash, mix, quality, suffix
from helixframe.llm.util import BROADCAST_IDS, Scratch, broadcast_if_small, cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Each row is judged by its text alone: null texts as empty ones, rows that
    repeat another alike, whole texts however long. Extra columns pass through;
    an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.learn(docs.select("doc_id", "text"), labels, repeats=True)
    digest = {"digest": F.xxhash64("text"), "check": F.xxhash64(F.lit(1), "text")}
    scored = quality.score(docs.select("doc_id", "text", *[c.alias(n) for n, c in digest.items()]), model, keep=tuple(digest))
    rejected = broadcast_if_small(cut(scored.where("predicted = 0").select(*[F.col(f"kept_{n}").alias(n) for n in digest]).distinct()), BROADCAST_IDS)
    # a text's score hangs on the text alone, so texts are looked up by digest and stay where they are
    return docs.join(rejected, [c == rejected[n] for n, c in digest.items()], "left_anti")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, 0.8): the one of least id.

    Documents without words (null texts among them) link with nothing and all
    stay; so do rows of null id, which no id can stand for, unless they are
    near a row that has one; rows that share a kept id all stay. Extra columns
    pass through; an empty table stays empty.
    """
    near = minhash.near_duplicates(docs, k=5)
    gone = broadcast_if_small(cut(near.groupBy("doc_id").agg(F.max("kept").alias("stays")).where("not stays").select(F.col("doc_id").alias("gone"))), BROADCAST_IDS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that also start in a document of smaller id are cut out of the texts; no document goes.

    Texts without such a passage stay as they are, null ones too; rows that
    share an id do not cut each other; null ids count as largest. n_chars
    follows the text; extra columns pass through; an empty table stays empty.
    """
    out = suffix.remove_repeats(docs, as_text=True)
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, three times at most; a document that it doesn't take goes.

    Sizes are words of the whole text (null: 0); null is a source like another,
    the last in order; equal ids share a hash, so rows that repeat one are
    taken alike. Extra columns pass through; an empty table stays empty.
    """
    return mix.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts are empty; very long words are encoded in windows, with the same
    ids; a row for each row, repeated or not; an empty table gives none.
    """
    return bpe.round_trip(docs, bpe.Vocabulary.public())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL can't express a trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as tmp:
        for name, stage in STAGES[:-1]:
            before, docs = docs, tmp.stored(stage(spark, docs, sf_dir), name)
            tmp.drop(before)
        return STAGES[-1][1](spark, docs, sf_dir)
