"""The fact table (session_id, bucket, model, sums) as a kept table, refreshed by whole sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kept import KeptTable, hash_part


class FactTable:
    """Facts below `folder`, in parts of `days` days by their bucket, each sorted by bucket and session.

    A refresh takes out all facts of the changed sessions and puts in their new ones. It reads and writes only the parts
    in which these sessions have facts or had some; a second table, of each session's parts, says which. A refresh with a
    number that was made already changes nothing, and one that broke off can be made again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, days: int = 30, parts: int = 16):
        self.facts = KeptTable(spark, f"{folder}/facts", schema)
        self.places = KeptTable(spark, f"{folder}/places", T.StructType([T.StructField("session_id", schema["session_id"].dataType), T.StructField("places", T.ArrayType(T.StringType()))]))
        self.seconds, self.parts = days * 86400, parts

    def number(self) -> int:
        """The number of the last whole refresh, or -1."""
        return min(self.facts.number(), self.places.number())

    def refresh(self, number: int, stats: DataFrame, changed: DataFrame | None = None) -> list[str]:
        """Replaces the facts of the sessions in `changed` (session_id), by default those in `stats`, by the rows of `stats`. The parts that were replaced."""
        place = F.floor(F.col("bucket") / self.seconds)
        stats = stats.persist()
        try:
            ids = (stats if changed is None else changed).select("session_id").distinct()
            # A row for each part, of which there are as many as spans of days.
            lies_in = self.places.read().join(ids, "session_id", "left_semi").select(F.explode("places").alias("place")).distinct()
            was = [r.place for r in lies_in.collect()] if self.places.number() >= 0 else []
            touched = self.facts.change(number, stats, place, lambda old, new: old.join(ids, "session_id", "left_anti").unionByName(new) if self.facts.number() >= 0 else new, ("bucket", "session_id"), was)
            now = ids.join(stats.groupBy("session_id").agg(F.collect_set(place.cast("string")).alias("places")), "session_id", "left").withColumn("places", F.coalesce("places", F.array().cast("array<string>")))
            self.places.change(number, now, hash_part("session_id", self.parts), lambda old, new: old.join(new, "session_id", "left_anti").unionByName(new.where(F.size("places") > 0)))
        finally:
            stats.unpersist()
        return touched

    def read(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """The facts with bucket in [start, end), from the parts that can have them."""
        low = None if start is None else start // self.seconds
        high = None if end is None else (end - 1) // self.seconds
        parts = [p for p in self.facts.versions() if (low is None or int(p) >= low) and (high is None or int(p) <= high)]
        rows = self.facts.read(parts)
        rows = rows if start is None else rows.where(F.col("bucket") >= start)
        return rows if end is None else rows.where(F.col("bucket") < end)
