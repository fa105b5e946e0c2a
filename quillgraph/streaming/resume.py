"""Incremental runs: resume by completion marker, deduplicated streams, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def available_now(spark: SparkSession, source: str, schema: StructType, checkpoint: str, sink: str, key: str, time: str | None = None, late: str = "7 days") -> StreamingQuery:
    """Whatever new Parquet files the source has, each key once, appended to the sink; a restart goes on where it ended.

    With ``time``, a timestamp column, keys are told apart within the watermark ``late`` and the state stays bounded; keys
    that repeat later are told apart in the sink (``latest``). Without it every key is held for good: for small sets alone.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    rows = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()


def three_sinks(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream split by status into ok, error and invalid."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name in ("ok", "error", "invalid"):
            batch.where(F.col("status") == name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, kind: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, kind, n) in tumbling windows, with a watermark on streams."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def pending_work(universe: DataFrame, ok: DataFrame, key: str) -> DataFrame:
    """All without the done ones; invalid results are tried again."""
    return universe.join(ok.select(key).distinct(), key, "left_anti")


def completed(log: DataFrame, key: str, kind: str = "event", marker: str = "query_completed") -> DataFrame:
    """(key) of the units of work whose completion marker is in the log; rows of a unit that broke off don't count."""
    return log.where(F.col(kind) == marker).select(key).distinct()


def resume_plan(plan: DataFrame, log: DataFrame, key: str, kind: str = "event", marker: str = "query_completed") -> DataFrame:
    """The units of a plan that have no completion marker."""
    return plan.join(completed(log, key, kind, marker), key, "left_anti")


def run_states(log: DataFrame, key: str = "stage", time: str = "at") -> DataFrame:
    """(stage, state, at): each stage's last entry in an append-only log of states running, done, failed or skipped."""
    return log.groupBy(key).agg(F.max_by(F.struct("state", time), time).alias("r")).select(key, "r.*")


def upstream_running(log: DataFrame, stages: list[str], key: str = "stage", time: str = "at") -> DataFrame:
    """The stages that are running: a later one should wait for them."""
    return run_states(log, key, time).where(F.col(key).isin(*stages) & (F.col("state") == "running"))


def once(rows: DataFrame, key: str, order: str) -> DataFrame:
    """What was delivered at least once, each key once: the first by ``order``."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("r")).select(key, "r.*")
