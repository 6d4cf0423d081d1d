"""Exact sets of sessions by day, that can be put together for any range of days.

Sessions get dense numbers in the order of their first bucket, so the sessions of a day lie close together. A day's
sessions are bitmaps of 32,768 numbers each, of which only the 64-bit words that have a session are kept; the sessions
of a range are the OR of its days' words, and their number is exact, without reading facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import civil_date
from ..operators.usage import COUNTERS
from ..sources.kept import shared_folder


def session_numbers(facts: DataFrame) -> DataFrame:
    """(session_id, number): numbers from 1 without gaps, by first bucket and id. Sorted in ranges; only the ranges' lengths, a row for each, are added up."""
    spark = facts.sparkSession
    folder = shared_folder(spark, "numbers")
    first = facts.groupBy("session_id").agg(F.min("bucket").alias("first"))
    ranged = first.repartitionByRange("first", "session_id").sortWithinPartitions("first", "session_id")
    # Within a range the id that rises with the row; written, so that it stays.
    ranged.select("session_id", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    ranges = rows.groupBy("range").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(ranges, "range").select("session_id", (F.col("base") + F.col("at") - F.col("low") + 1).alias("number"))


def day_sets(base: DataFrame, numbers: DataFrame, tz: str, by: tuple[str, ...] = ("provider",)) -> DataFrame:
    """(date, *by, chunk, sessions): the sessions with facts on each local day as bitmaps, one for each chunk of numbers that the day has, as the words (word, bits) that aren't 0.

    A chunk has 512 words; a day with few sessions of it has few, where a whole bitmap would take 4 KB in each sort.
    """
    seen = base.withColumn("date", civil_date("bucket", tz)).where("date is not null").select("session_id", "date", *by).distinct().join(numbers, "session_id")
    chunk, at = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number")
    # Dealt by chunk before, so that both sums are made where the rows are.
    placed = seen.select("date", *by, chunk.alias("chunk"), F.floor(at / 64).cast("short").alias("word"), F.expr("shiftleft(1L, cast(bitmap_bit_position(number) % 64 as int))").alias("bits")).repartition("date", *by, "chunk")
    words = placed.groupBy("date", *by, "chunk", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("date", *by, "chunk").agg(F.collect_list(F.struct("word", "bits")).alias("sessions"))


def day_sums(base: DataFrame, tz: str, by: tuple[str, ...] = ("provider",)) -> DataFrame:
    """(date, *by) with the sums of counters and cost."""
    return base.withColumn("date", civil_date("bucket", tz)).where("date is not null").groupBy("date", *by).agg(*[F.sum(c).alias(c) for c in ["turn_count", *COUNTERS]], F.sum("cost_usd").alias("cost_usd"))


def sessions_of(sets: DataFrame, *by: str) -> DataFrame:
    """(*by, sessions): distinct sessions of all rows of each group of sets, over whatever days and groups they have."""
    # Dealt as they are, by chunk: the words of a chunk are put together in one place, with 8 bytes for each.
    words = sets.repartition(*by, "chunk").select(*by, "chunk", F.inline("sessions")).groupBy(*by, "chunk", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy(*by).agg(F.sum(F.bit_count("bits")).cast("long").alias("sessions"))


def over_ranges(sets: DataFrame, sums: DataFrame, ranges: DataFrame, *by: str) -> DataFrame:
    """(name, *by, sessions, turn_count, counters): of each range (name, first, last day) the distinct sessions and the sums, from the days only. Ranges may overlap; a day is a row of each that has it."""
    days = ranges.select("name", F.explode(F.transform(F.sequence(F.to_date("first"), F.to_date("last")), lambda d: d.cast("string"))).alias("date"))
    counted = sessions_of(sets.join(days, "date"), "name", *by)
    added = sums.join(days, "date").groupBy("name", *by).agg(*[F.sum(c).alias(c) for c in ["turn_count", *COUNTERS]])
    return counted.join(added, ["name", *by])
