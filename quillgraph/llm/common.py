"""Shared helpers of the training-data operators: shared storage, materialisation, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.components import CHECKPOINT_KEY, materialize  # noqa: F401

BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of texts that a Python worker is handed at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; there must be one."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise RuntimeError(f"{CHECKPOINT_KEY} is not set: name a folder that the driver and all executors share")
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled_sample(documents: DataFrame, labels: DataFrame, column: str, per_value: int, where: str = "true") -> DataFrame:
    """At most ``per_value`` labelled documents for each value (0, 1) of ``column``: (text, label).

    The bound makes both the broadcast of ids and the collected rows bounded; rows are chosen by the
    order of a hash of doc_id, so the choice depends neither on partitioning nor on the table's order.
    """
    picked = None
    for value in (0, 1):
        part = (
            labels.where(f"doc_id is not null and {column} = {value} and ({where})")
            .select("doc_id", F.lit(value).alias("label"))
            .dropDuplicates(["doc_id"])
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(per_value)
        )
        picked = part if picked is None else picked.unionByName(part)
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session hands rows to Python in batches of at most ``most`` bytes (a longer row alone); a smaller bound is kept.

    Spark's own bound is 10,000 rows or 64 MB, held by the JVM and the worker of every task. Operators work with any
    bound; small executors need a smaller one. It is the session's setting, so queries make it, not operators.
    """
    now = int((spark.conf.get(BATCH_KEY, None) or "-1").removesuffix("b"))
    if not 0 < now <= most:
        spark.conf.set(BATCH_KEY, str(most))


def release_memory() -> None:
    """Give memory that Python, Arrow and the C library hold for later use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """A function over Arrow batches whose worker holds no more than it needs when its task ends: workers live on and share an executor's memory with what comes next."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return tidied


def utf8(value: str | None) -> bytes:
    return value.encode("utf-8", "surrogatepass") if value else b""
