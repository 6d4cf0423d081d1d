"""The kept fact table: refreshes by session, reads by days."""

import pytest
from pyspark.sql import functions as F

from fleetlog.operators import usage
from fleetlog.plans import reports
from fleetlog.registry import usage as U
from fleetlog.sources import tables
from fleetlog.sources.facts import FactTable

DAY = 86400


def rows(spark, *facts):
    return spark.createDataFrame(list(facts), "session_id long, bucket long, model string, n long")


def got(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture
def table(spark, tmp_path):
    table = FactTable(spark, str(tmp_path / "t"), rows(spark, (1, 0, "m", 1)).schema, days=10, parts=3)
    assert table.number() == -1 and table.read().count() == 0
    table.refresh(0, rows(spark, *[(s, d * DAY, "m", s) for s in range(20) for d in (s, s + 30)]))
    return table


def test_a_refresh_replaces_whole_sessions(spark, table):
    whole = got(table.read())
    assert set(table.facts.versions()) == set("0134")
    # Session 3 moves from parts 0 and 3 to part 4; session 5 goes; 50 is new.
    touched = table.refresh(1, rows(spark, (3, 45 * DAY, "m", 33), (50, 46 * DAY, "m", 50)), spark.createDataFrame([(3,), (5,), (50,)], "session_id long"))
    assert touched == ["0", "3", "4"] and table.facts.versions() == {"0": 1, "1": 0, "3": 1, "4": 1}
    want = sorted([f for f in whole if f[0] not in (3, 5)] + [(3, 45 * DAY, "m", 33), (50, 46 * DAY, "m", 50)])
    assert got(table.read()) == want
    # The same refresh again, and one after it.
    assert table.refresh(1, rows(spark, (3, 0, "m", 99))) == [] and got(table.read()) == want
    assert table.refresh(2, rows(spark, (3, 0, "m", 99))) == ["0", "4"]
    assert got(table.read()) == sorted([f for f in want if f[0] != 3] + [(3, 0, "m", 99)])


def test_a_refresh_that_broke_off_is_made_again(spark, table, monkeypatch):
    change = table.places.change
    monkeypatch.setattr(table.places, "change", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.refresh(1, rows(spark, (3, 45 * DAY, "m", 33)))
    monkeypatch.setattr(table.places, "change", change)
    assert table.number() == 0
    table.refresh(1, rows(spark, (3, 45 * DAY, "m", 33)))
    table.refresh(2, rows(spark, (3, 46 * DAY, "m", 34)))
    assert [f for f in got(table.read()) if f[0] == 3] == [(3, 46 * DAY, "m", 34)]


def test_reads_by_days_take_their_parts(spark, table):
    some = table.read(10 * DAY, 20 * DAY)
    assert got(some) == sorted((s, s * DAY, "m", s) for s in range(10, 20))
    assert len({f.rsplit("/", 2)[-2] for f in some.inputFiles()}) == 1


def test_facts_follow_their_input(spark, sf, tmp_path):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    folder = str(tmp_path / "sf")
    line.write.parquet(f"{folder}/lineitem.parquet")
    whole = U.facts(spark, folder).agg(F.sum("turn_count")).first()[0]
    spark.createDataFrame(line.limit(100).collect(), line.schema).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    assert U.facts(spark, folder).agg(F.sum("turn_count")).first()[0] < whole


def test_events_of_one_model_do_not_meet_in_one_task(spark):
    events = spark.range(0, 4000, 1, 8).selectExpr("id as session_id", "'no' as model", "id as input_tokens", "0L as output_tokens", "0L as cache_read_tokens", "0L as cache_write_tokens", "cast(null as double) as cost_usd")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        priced = usage.priced(events, tables.prices(spark)).groupBy(F.spark_partition_id().alias("at")).agg(F.count("*").alias("n"), F.sum("cost").alias("cost")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(priced) == 8 and max(r.n for r in priced) == 500 and abs(sum(r.cost for r in priced) - 4e-6 * sum(range(4000))) < 1e-6


def test_facts_without_a_parent_do_not_meet_in_one_task(spark):
    stats = spark.range(0, 4000, 1, 8).selectExpr("id as session_id", "'m' as model")
    sessions = spark.range(4000).selectExpr("id", "if(id % 3 = 0, 'high', if(id % 3 = 1, 'low', null)) as provider", "if(id % 4 = 0, null, id % 4 = 1) as is_sidechain", "if(id % 5 = 0, id + 3000, null) as parent_id", "'m' as model")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = reports.usage_base(stats, sessions).select("session_id", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    gone = {i for i in range(1000) if i % 3 == 0 and i % 4 == 1 and i % 5 == 0}
    assert {r.session_id for r in rows} == set(range(4000)) - gone
    sizes = [sum(r.at == k for r in rows) for k in {r.at for r in rows}]
    assert len(sizes) == 8 and max(sizes) < 800
