"""Running values along sessions of any length, without a session in one task.

A long session is cut into segments at quantiles of its order. Each segment is summed
up on its own, the summaries are scanned (a row for each segment), and the values within a
segment start from those. Rows of a segment are one window partition, not those of a session.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import shared_folder

#: approx_percentile finds a place among these many; more segments would be of very unequal length.
MOST_SEGMENTS = 4096


def long_sessions(rows: DataFrame, order: str, segment_rows: int, key: str = "session_id") -> DataFrame | None:
    """(key, cuts): where the sessions of more than `segment_rows` rows are cut, about that far apart in the longest and no farther in others; None if there are none.

    The cuts are written once, as quantiles found again needn't be the same.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "segments")
    rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > segment_rows).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    most = counts.agg(F.max("n")).first()[0]
    if most is None:
        return None
    pieces = min(MOST_SEGMENTS, math.ceil(most / segment_rows))
    at = F.array(*[F.lit(k / pieces) for k in range(1, pieces)])
    long = rows.select(key, order).join(counts.select(key), key, "left_semi")
    long.groupBy(key).agg(F.array_distinct(F.percentile_approx(order, at, 16 * pieces)).alias("cuts")).write.parquet(f"{folder}/cuts")
    return spark.read.parquet(f"{folder}/cuts")


def before(rows: DataFrame, order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, segment_rows: int | None = None, key: str = "session_id") -> DataFrame:
    """Adds, by name, sums over the rows of the session before each row (0 if there are none) and last values there that aren't null.

    Rows of a session differ in `order`, a number. With `segment_rows` sessions of more rows are cut; the values are the same. Without it
    a session is one window partition.
    """
    sums, lasts = sums or {}, lasts or {}
    cuts = long_sessions(rows, order, segment_rows, key) if segment_rows else None
    values = {f"_v{k}": c for k, c in enumerate([*sums.values(), *lasts.values()])}
    rows = rows.withColumns(values)
    own, summed, last = dict(zip([*sums, *lasts], values)), list(sums), list(lasts)
    if cuts is None:
        window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        made = {n: F.coalesce(F.sum(own[n]).over(window), F.lit(0)) for n in summed} | {n: F.last(own[n], ignorenulls=True).over(window) for n in last}
        return rows.withColumns(made).drop(*values)
    cuts = cuts.withColumnRenamed(key, "_key")
    segment = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))
    dealt = rows.join(cuts.withColumnRenamed("cuts", "_cuts"), F.col(key) == F.col("_key"), "left").withColumn("_segment", F.when(F.col("_cuts").isNull(), 0).otherwise(segment)).drop("_key", "_cuts")
    # What each segment of a cut session comes to, and what comes before it.
    of_long = dealt.join(cuts.select("_key"), F.col(key) == F.col("_key"), "left_semi")
    parts = of_long.groupBy(F.col(key).alias("_key"), F.col("_segment").alias("_at")).agg(*[F.sum(own[n]).alias(f"_s_{n}") for n in summed], *[F.max_by(own[n], F.when(F.col(own[n]).isNotNull(), F.col(order))).alias(f"_l_{n}") for n in last], F.count("*").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_key", "_at", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in summed], *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in last])
    inside = Window.partitionBy(key, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = {n: F.coalesce(F.sum(own[n]).over(inside), F.lit(0)) for n in summed} | {n: F.last(own[n], ignorenulls=True).over(inside) for n in last}
    joined = dealt.withColumns(local).join(parts, (F.col(key) == F.col("_key")) & (F.col("_segment") == F.col("_at")), "left")
    whole = {n: F.col(n) + F.coalesce(F.col(f"_s_{n}"), F.lit(0)) for n in summed} | {n: F.coalesce(n, f"_l_{n}") for n in last}
    return joined.withColumns(whole).drop(*values, "_segment", "_key", "_at", *[f"_s_{n}" for n in summed], *[f"_l_{n}" for n in last])
