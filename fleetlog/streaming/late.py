"""Rows that come behind the watermark, told apart and counted where they enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.kept import exists


def window_end(ts: str = "ts", seconds: int = 900) -> Column:
    """When the tumbling window of a row ends; window() itself would leave out rows without a time."""
    return F.timestamp_seconds((F.floor(F.unix_millis(ts) / (1000 * seconds)) + 1) * seconds)


def split_batch(batch: DataFrame, number: int, folder: str, closes: Column, late: str, ts: str = "ts") -> None:
    """Writes a batch's rows to `folder`/rows, late ones apart, and its counts to `folder`/counts, in one pass over the rows.

    The watermark is the newest time of all earlier batches less `late`, as a stateful operator of the same stream has it; a row is late if it
    closes by then. A batch that runs again overwrites its own rows and counts. Rows without a time are not late.
    """
    spark = batch.sparkSession
    before = f"{folder}/counts/batch={number - 1}"
    newest = spark.read.schema("rows long, late long, newest timestamp").parquet(before).first().newest if number and exists(spark, before) else None
    mark = F.lit(newest) - F.expr(f"interval {late}") if newest is not None else F.lit(None).cast("timestamp")
    seen = Observation()
    told = batch.withColumn("late", F.coalesce(closes <= mark, F.lit(False)))
    told = told.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"), F.max(ts).alias("newest"))
    told.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/batch={number}")
    counted = seen.get
    latest = max((x for x in (newest, counted["newest"]) if x is not None), default=None)
    spark.createDataFrame([(counted["rows"], counted["late"], latest)], "rows long, late long, newest timestamp").coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")


def split_late(rows: DataFrame, folder: str, checkpoint: str, closes: Column, late: str = "1 hour", ts: str = "ts"):
    """Starts a query that splits a stream's rows as split_batch() does, and ends when all there is has been read."""
    return rows.writeStream.foreachBatch(lambda batch, number: split_batch(batch, number, folder, closes, late, ts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_rows(spark: SparkSession, folder: str, schema: str, late: bool) -> DataFrame:
    """The late rows so far, or those in time, with their batch."""
    rows = spark.read.schema(f"{schema}, batch long, late boolean").option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return rows.where(F.col("late") == late).drop("late")


def late_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, rows, late): every batch there ever was, not only recent progress."""
    return spark.read.schema("rows long, late long, newest timestamp, batch long").option("basePath", f"{folder}/counts").parquet(f"{folder}/counts").select("batch", "rows", "late")
