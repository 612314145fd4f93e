"""Shared helpers: scratch storage, size-checked broadcasts, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch while a step runs, unless the step says otherwise: texts can be long and Python workers are small.
BATCH_ROWS = 512


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where the setting is absent, a private folder is made once per session and
    removed when the process ends, but only if driver and executors are one
    process; on a cluster, executors could not see it, and RuntimeError is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if base is None:
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not jsc.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="helixframe-ckpt-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM exits."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/helixframe-{name}-{uuid.uuid4().hex}"
    fs, hadoop_path = _file_system(spark, path)
    fs.mkdirs(hadoop_path.getParent())
    fs.deleteOnExit(hadoop_path)
    return path


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


@contextmanager
def settings(spark: SparkSession, **conf: object) -> Iterator[None]:
    """Session settings (dots written as ``__``) that hold inside the block; the caller's come back after it."""
    names = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def step(spark: SparkSession, rows: int = BATCH_ROWS):
    """Settings of one step, until it has run: Arrow batches of ``rows``, and shuffle files that go when the step ends."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


class Scratch:
    """Tables of one operator's run, written to the shared folder.

    ``stored`` writes a table once and reads it back, which cuts the lineage in
    a way that survives lost executors and lets later readers prune columns.
    Tables live until ``drop`` is called on them or the block ends; those named
    by ``keep`` stay, as the result reads them, until the driver's JVM exits.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, tuple[object, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for held, _path in list(self.paths.values()):
            self.drop(held)

    def path(self, name: str) -> str:
        """A path for files of the caller's own, deleted when the block ends."""
        path = scratch_path(self.spark, name)
        self.paths[id(path)] = (path, path)
        return path

    def stored(self, df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
        path = scratch_path(self.spark, name)
        with step(self.spark, rows):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: object) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            if (held := self.paths.pop(id(df), None)) is not None:
                fs, hadoop_path = _file_system(self.spark, held[1])
                fs.delete(hadoop_path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave a table to the caller."""
        self.paths.pop(id(df), None)
        return df


def stored(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it back; the table stays until the driver's JVM exits."""
    scratch = Scratch(df.sparkSession)
    return scratch.keep(scratch.stored(df, name, rows))


def cut(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """Eager reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    with step(df.sparkSession, rows):
        return df.checkpoint(eager=True)


def shared_keys(classes: DataFrame, key: str = "cls") -> DataFrame | None:
    """The 64-bit keys that several rows of ``classes`` have, None if there are none.

    Classes are told apart by key and check, 128 bits; of 10**10, a few pairs
    are expected to share the key. Such classes get a key of both digests by
    ``rekeyed``, in every table that names classes, so that joins on the key
    alone never mix classes.
    """
    shared = cut(classes.groupBy(key).count().where("count > 1").select(key))
    return None if shared.isEmpty() else shared


def rekeyed(df: DataFrame, shared: DataFrame | None, key: str = "cls", check: str = "check") -> DataFrame:
    """``df`` with the keys of ``shared`` replaced by a digest of key and check."""
    if shared is None:
        return df
    hit = broadcast_if_small(shared.select(F.col(key).alias("_shared")))
    j = df.join(hit, F.col(key) == F.col("_shared"), "left")
    return j.withColumn(key, F.when(F.col("_shared").isNotNull(), F.xxhash64(key, check)).otherwise(F.col(key))).drop("_shared")


def pieces_of(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for ``rows`` rows of work that Spark can't weigh by bytes: at most ``each`` rows in one on average."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // each), min(usual, -(-8 * rows // each)), 1)


#: A side is broadcast only when counted and found to have no more rows than this.
BROADCAST_ROWS = 5_000

#: The same for rows of one number.
BROADCAST_IDS = 250_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a count; ``df`` should be stored or checkpointed already."""
    return F.broadcast(df) if df.count() <= limit else df


#: Up to so many edges are contracted by one task (16 bytes each); more by rounds of joins.
ONE_TASK_EDGES = 500_000


def _contract_batches(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([find(int(x)) for x in nodes], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Smallest id reachable from each node of an undirected edge list (columns ``a``, ``b``).

    Edge lists counted and found to have no more than ``one_task`` rows are
    contracted by a single task. Larger ones go through alternating large-star
    and small-star contraction: every round is two map-side-combined minima and
    two equi-joins on node ids, and the number of rounds grows with the
    logarithm of the longest path. Edges live in the shared folder between
    rounds; the driver sees two numbers per round. Nodes that have no edge are
    not returned; loops and repeated edges do no harm; an empty input gives an
    empty result. Returns ``node``, ``component`` (long).
    """
    e = (
        edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = cut(e)
    if e.count() <= one_task:
        return e.coalesce(1).mapInArrow(_contract_batches, "node long, component long")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the least neighbour of u (or u itself)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u itself, is linked to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v")
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        # converged when the edges are stars: no centre is a leaf, and nothing moved
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    leaves = e.groupBy("u").agg(F.min("v").alias("v"))
    return leaves.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        leaves.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
