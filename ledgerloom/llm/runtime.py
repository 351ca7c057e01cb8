"""Session plumbing shared by the operators: shared folder, lineage cuts, sizing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_by_bytes(spark: SparkSession) -> None:
    """Arrow batches of about ``ARROW_BYTES`` (one row at least), unless the session sets a bound of its own.

    By number of rows alone, 10,000 long texts or slices are one batch, held by the executor and by the worker.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, ARROW_BYTES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batch_by_bytes(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode (tests)."""
    batch_by_bytes(spark)
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame, large: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; after a ``large`` exchange let go of the shuffle files that led to it, too."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    del df  # its plan holds the shuffles
    if large:
        gc.collect()
        spark._jvm.System.gc()
    return out


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` dealt to ``parts`` partitions by ``key``, sorted by it and checkpointed: later joins on ``key`` move only their other side.

    The checkpoint is made without adaptive execution, whose plans don't tell how their rows are dealt.
    """
    spark = df.sparkSession
    shared_dir(spark)
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return settle(df.repartition(parts, key).sortWithinPartitions(key), large=True)
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give freed memory of this process back to the system: a worker is kept for later tasks, and its executor's memory counts what it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_bytes(df: DataFrame) -> int | None:
    """The size of the files that ``df`` is read from, whatever store they are in, by Catalyst's statistics; None if some input is no file scan.

    Leaves are added up: the estimate of a whole plan multiplies the sides of its joins.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    if not all(leaf.nodeName() == "LogicalRelation" for leaf in leaves):
        return None
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in leaves)


def bucket_count(df: DataFrame, per_bucket: int = 8 << 20) -> int:
    """Message buckets for hash exchanges: grows with the input so that a bucket stays of one size. Texts that come from no file are measured."""
    size = file_bytes(df)
    if size is None:
        size = df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(2 * shuffle_partitions(df.sparkSession), -(-size // per_bucket))


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back; file statistics tell the next step its size."""
    path = fresh_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(table: DataFrame, most: int) -> DataFrame:
    """``table``, to be broadcast if it has no more than ``most`` rows; else Spark joins it by shuffle."""
    return F.broadcast(table) if table.count() <= most else table
