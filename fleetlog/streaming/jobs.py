"""Streams of usage events and messages. Each function takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.usage import COUNTERS
from .deltas import STORE

_STATE = "spark.sql.streaming.stateStore"
#: State on disk, with the changes of each batch beside it, a bound for what is in memory, and no look at each key again just to count them.
DISK_STATE = {f"{_STATE}.providerClass": STORE, **{f"{_STATE}.rocksdb.{k}": v for k, v in (("changelogCheckpointing.enabled", "true"), ("boundedMemoryUsage", "true"), ("allowFAllocate", "false"), ("trackTotalNumberOfRows", "false"))}}


@contextmanager
def disk_state(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB. The session's own store holds it in the heap, about 350 bytes for each hash of stream_dedup().

    A stream keeps its number of state partitions: two for each core unless told otherwise, and no more than the session's shuffles have.
    Each has files of its own in every batch, and none is held whole.
    """
    shuffles = "spark.sql.shuffle.partitions"
    wanted = DISK_STATE | {shuffles: str(partitions or min(int(spark.conf.get(shuffles)), 2 * spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def file_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Lines (source_path, raw) of new files. Files that grow are not seen again; sources.ranges reads those."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").load(folder).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("raw"))


def stream_usage(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sums by session, 15 minutes and model, for the update or append mode. Rows behind the watermark are dropped; late.split_late() keeps and counts them."""
    windowed = events.withWatermark("ts", late).groupBy("session_id", F.window("ts", "15 minutes").alias("w"), "model")
    return windowed.agg(F.count("*").alias("turn_count"), *[F.sum(c).alias(c) for c in COUNTERS]).select("session_id", F.unix_seconds("w.start").alias("bucket"), "model", "turn_count", *COUNTERS)


def stream_dedup(events: DataFrame, late: str = "1 hour", keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """The first row of each hash under `keys` inside the watermark; rows without a hash all stay. The batch keeps the largest instead; a nightly batch puts that right. State has every hash inside the watermark: where they don't fit the heap, start it under disk_state()."""
    timed = events.withWatermark("ts", late)
    return timed.where("usage_hash is not null").dropDuplicatesWithinWatermark([*keys, "usage_hash"]).unionByName(timed.where("usage_hash is null"))


def activity_bursts(messages: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(session_id, start, end, messages) of runs without a longer pause."""
    grouped = messages.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("messages")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")
