"""Running values of cut sessions against those of whole ones."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlog.operators import order, scans, usage


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for session, n in ((1, 900), (2, 3), (3, 50), (4, 41), (None, 30)):
        for seq in rng.sample(range(5000), n):
            data.append((session, seq, rng.randrange(100) if rng.random() < 0.3 else None, rng.choice([None, None, "a", "b"])))
    return spark.createDataFrame(data, "session_id long, seq long, v long, w string").repartition(7)


def got(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("segment_rows", [40, 7, 1, 10_000])
def test_cut_sessions_equal_whole_ones(rows, segment_rows):
    how = {"sums": {"s": F.coalesce("v", F.lit(0)), "n": F.lit(1)}, "lasts": {"last_v": F.col("v"), "last_w": F.col("w")}}
    window = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("*", F.coalesce(F.sum("v").over(window), F.lit(0)).alias("s"), F.count("*").over(window).alias("n"), F.last("v", ignorenulls=True).over(window).alias("last_v"), F.last("w", ignorenulls=True).over(window).alias("last_w"))
    assert got(scans.before(rows, "seq", segment_rows=segment_rows, **how)) == got(want) == got(scans.before(rows, "seq", **how))


def test_no_task_has_a_long_session(spark):
    hot = spark.range(200_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("session_id"), F.col("id").alias("seq"), F.lit(1).alias("x"))
    cuts = scans.long_sessions(hot, "seq", 10_000)
    (row,) = cuts.collect()
    assert row.session_id == 0 and len(row.cuts) == 17
    sizes = hot.where("session_id = 0").groupBy(F.size(F.filter(F.array(*map(F.lit, row.cuts)), lambda c: c < F.col("seq")))).count().collect()
    assert len(sizes) == 18 and max(r["count"] for r in sizes) < 12_000
    made = scans.before(hot, "seq", sums={"n": F.lit(1)}, segment_rows=10_000).where("session_id = 0")
    assert made.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (0, 179_999, 180_000)


def test_operators_on_cut_sessions(spark, rows):
    logs = rows.where("session_id is not null").select("session_id", "seq", F.col("v").alias("total_x"), F.when(F.col("seq") % 5 == 0, F.col("seq")).alias("last_x"), F.col("w").alias("info_model"), F.lit(None).cast("string").alias("payload_model"), F.when(F.col("seq") % 3 == 0, F.lit("c")).alias("context_model"), F.lit(None).cast("string").alias("usage_model"))
    assert got(usage.counter_delta(logs, ["x"])) == got(usage.counter_delta(logs, ["x"], segment_rows=9))
    few = logs.withColumn("info_model", F.when((F.col("session_id") == 3) | (F.col("seq") > 4900), "only")).withColumn("context_model", F.lit(None).cast("string"))
    for frame in (logs, few):
        assert got(usage.fill_model(frame).select("session_id", "seq", "model")) == got(usage.fill_model(frame, segment_rows=9).select("session_id", "seq", "model"))
    said = rows.where("session_id is not null").select("session_id", F.col("seq").alias("msg_index"), F.lit("assistant").alias("role"), F.col("w").alias("content"), *[F.col("v").alias(c) for c in usage.COUNTERS])
    assert got(usage.estimate_from_chars(said)) == got(usage.estimate_from_chars(said, segment_rows=9))
    timeline = order.token_timeline(said, segment_rows=9)
    assert got(order.token_timeline(said)) == got(timeline) and got(order.token_buckets(timeline, 7)) == got(order.token_buckets(timeline, 7, windows=False))
