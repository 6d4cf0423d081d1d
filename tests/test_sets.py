"""Sets of sessions by day against counting distinct sessions."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlog.functions.times import civil_date
from fleetlog.operators.usage import COUNTERS
from fleetlog.plans import sets


@pytest.fixture(scope="module")
def base(spark):
    rng = random.Random(2)
    rows = []
    for session in range(40_000):
        start = rng.randrange(60)
        rows += [(session * 3 + 7, (start + k) * 86400, rng.choice("pq")) for k in range(rng.choice([1, 1, 2, 5]))]
    rows = spark.createDataFrame(rows, "session_id long, bucket long, provider string")
    return rows.withColumns({**{c: F.lit(1).cast("long") for c in ["turn_count", *COUNTERS]}, "cost_usd": F.lit(0.5)})


def test_numbers_are_dense(base):
    numbers = sets.session_numbers(base)
    assert numbers.agg(F.count("*"), F.count_distinct("number"), F.min("number"), F.max("number")).first()[:] == (40_000, 40_000, 1, 40_000)
    first = base.groupBy("session_id").agg(F.min("bucket").alias("first")).join(numbers, "session_id").orderBy("number").select("first").collect()
    assert [r.first for r in first] == sorted(r.first for r in first)


def test_any_range_is_exact(spark, base):
    days = sets.day_sets(base, sets.session_numbers(base), "UTC")
    # More numbers than one bitmap has, and few bitmaps a day.
    assert days.select("chunk").distinct().count() == 2 and days.groupBy("date", "provider").count().agg(F.max("count")).first()[0] <= 2
    ranges = [("a", "1970-01-01", "1970-01-10"), ("b", "1970-01-05", "1970-03-10"), ("c", "1970-02-01", "1970-02-01"), ("empty", "1980-01-01", "1980-01-02")]
    got = sets.over_ranges(days, sets.day_sums(base, "UTC"), spark.createDataFrame(ranges, "name string, first string, last string"), "provider")
    dated = base.withColumn("date", civil_date("bucket", "UTC"))
    for name, first, last in ranges:
        want = dated.where(F.col("date").between(first, last)).groupBy("provider").agg(F.count_distinct("session_id").alias("sessions"), F.sum("turn_count").alias("turn_count"))
        assert sorted(map(tuple, got.where(F.col("name") == name).select("provider", "sessions", "turn_count").collect())) == sorted(map(tuple, want.collect()))
    assert sets.sessions_of(days).first().sessions == 40_000


def test_a_day_keeps_the_words_that_it_has(spark):
    base = spark.range(40_000).selectExpr("id as session_id", "id % 50 * 86400 as bucket", "'p' as provider")
    numbers = spark.range(40_000).selectExpr("id as session_id", "id + 1 as number")
    days = sets.day_sets(base, numbers, "UTC")
    # 800 sessions a day far from each other, 8 bytes and a place each; a whole bitmap of the first chunk has 4,096 bytes.
    assert days.agg(F.max(F.size("sessions"))).first()[0] <= 656 and days.select(F.inline("sessions")).agg(F.sum(F.bit_count("bits"))).first()[0] == 40_000
    every = spark.range(64).selectExpr("id as session_id", "0L as bucket", "'p' as provider")
    assert sets.day_sets(every, numbers, "UTC").select(F.inline("sessions")).collect() == [(0, -1)] and sets.sessions_of(sets.day_sets(every, numbers, "UTC")).first().sessions == 64
    # The sets are put together in a hash aggregate over longs; bitmaps of 4 KB were sorted.
    assert "SortAggregate" not in sets.sessions_of(days, "provider")._jdf.queryExecution().executedPlan().toString()
