"""An extension: pileups that grow while alignments arrive.

A pileup is a sum, so micro-batches of reads add up: each batch is piled up by
the batch operator and merged into a table by ``foreachBatch``; or the counters
are kept as a streaming aggregation in update mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pileup import merge_pileups, pileup


def sam_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Reads of SAM text files as they appear under ``path``."""
    f = F.split("value", "\t")
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.where(~F.col("value").startswith("@")).where(F.size(f) >= 11).select(
        f[0].alias("qname"), f[1].try_cast("int").alias("flag"), f[2].alias("rname"), f[3].try_cast("int").alias("pos"), f[4].try_cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual")
    )


def write_pileup_stream(reads: DataFrame, fasta: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Append a partial pileup per micro-batch under ``out`` (batch=N); ``read_merged`` sums them.

    A batch that is run again overwrites its own folder, so the sum counts
    every read once.
    """

    def add(batch: DataFrame, n: int) -> None:
        pileup(batch, fasta, **options).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_merged(spark: SparkSession, out: str) -> DataFrame:
    return merge_pileups(spark.read.parquet(out))
