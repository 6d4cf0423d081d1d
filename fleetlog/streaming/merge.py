"""Streams of rows merged by id into a kept table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import merge_sessions
from ..sources.kept import KeptTable, hash_part


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of each key the last by `order`."""
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def sessions_table(rows: DataFrame, folder: str) -> KeptTable:
    """The kept table of sessions with the columns of `rows`, and `changed`: whether the change that last wrote the row's part changed a text of it."""
    return KeptTable(rows.sparkSession, folder, T.StructType([*rows.schema.fields, T.StructField("changed", T.BooleanType())]))


def merge_batch(table: KeptTable, batch: DataFrame, number: int, order: list[str], replacing_provider: str | None = None, parts: int = 16) -> list[str]:
    """One batch of sessions merged in as merge_sessions() does; of a session that the batch has twice the last by `order` counts. A batch that runs again changes nothing."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return merge_sessions(old.drop("changed"), newest(new, "id", order), replacing_provider)

    return table.change(number, batch, hash_part("id", parts), merge, ("id",))


def stream_merge(rows: DataFrame, folder: str, checkpoint: str, order: list[str], replacing_provider: str | None = None, parts: int = 16, keep: int = 3, after: Callable[[KeptTable, int], None] | None = None):
    """Starts a query that merges a stream of sessions into a kept table, batch by batch, and ends when all there is has been read.

    Each batch reads and writes only the hash parts that its ids lie in. `after` is called with the table and the number of each batch.
    """
    table = sessions_table(rows, folder)

    def write(batch: DataFrame, number: int) -> None:
        merge_batch(table, batch, number, order, replacing_provider, parts)
        table.forget(keep)
        if after:
            after(table, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
