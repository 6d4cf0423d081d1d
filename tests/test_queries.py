"""Every registered query against its SQL on the smallest tables, and the pieces that need no Spark."""

import datetime
import decimal
import math

import duckdb
import pytest

from fleetlog import registry
from fleetlog.functions import times
from fleetlog.operators import catalog, search

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    found = duck.sql(registry.ORACLES[name])
    assert columns == sorted(found.columns)
    want = [dict(zip(found.columns, r)) for r in found.fetchall()]
    rows = lambda xs: sorted(repr(tuple(plain(x[c]) for c in columns)) for x in xs)
    assert rows(r.asDict() for r in got.collect()) == rows(want)


def test_all_queries_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_rates_of_whole_sessions(spark, sf):
    from fleetlog.operators import order
    from fleetlog.sources import tables

    rows = tables.event_messages(spark, sf)
    long = {r.session_id for r in rows.where("msg_index >= 12").select("session_id").distinct().collect()}
    first = {r.session_id: r.tools_per_user_turn for r in order.session_report(rows.where("msg_index < 12")).collect()}
    whole = {r.session_id: r.tools_per_user_turn for r in registry.QUERIES["sa_6_rates"](spark, sf).collect()}
    assert set(whole) == set(first) and any(whole[x] != first[x] for x in long)
    none = order.session_report(rows.where("role = 'system'")).first()
    assert none.tokens_per_turn is None and none.tools_per_user_turn is None


def test_every_session_has_a_title(spark, sf, duck):
    titles = {r.session_id: r.title for r in registry.QUERIES["win_3_resolve_title"](spark, sf).collect()}
    assert set(titles) == {x for (x,) in duck.sql("select distinct user_id from events").fetchall()}
    assert any(x % 4 == 0 and t != "Untitled" for x, t in titles.items()) and all(t == "Untitled" for x, t in titles.items() if x % 5 == 0)


def test_day_bounds():
    assert times.day_range_epochs("2011-12-30", "2011-12-30", "Pacific/Apia") == (1325239200, 1325239200)
    start, end = times.day_range_epochs("2024-03-10", "2024-03-10", "America/New_York")
    assert end - start == 23 * 3600
    assert times.preset_range(3, datetime.date(1970, 1, 2)) == ("1970-01-01", "1970-01-02") and times.preset_range(0, datetime.date(2000, 1, 1)) is None
    for bad in (("2020-01-02", "2020-01-01"), ("2020-1-2", "2020-01-03"), ("1969-12-31", "2020-01-01"), ("2020-01-01", None)):
        with pytest.raises(ValueError):
            times.validate_range(*bad)
    with pytest.raises(Exception):
        times.resolve_timezone("Nowhere/Land")
    assert times.calendar_window(2023, datetime.date(2024, 5, 1)) == ("2023-01-01", "2023-12-31") and times.calendar_window(2024, datetime.date(2024, 5, 1))[1] == "2024-05-01"


def test_query_text():
    assert search.parse_query("fix Provider:low bug after:2024-01-02 before:soon") == ("fix bug", {"provider": "low", "after": 1704153600})


def test_delete_guard():
    assert not catalog.delete_allowed(0, 5) and catalog.delete_allowed(1, 10) and not catalog.delete_allowed(10, 20) and catalog.delete_allowed(11, 20) and catalog.delete_allowed(0, 99, aggressive=True)


def test_result_kinds_by_precedence(spark):
    from fleetlog.functions import tools

    rows = [
        ("Bash", "mcp", None, "mcp"), ("ImageGeneration", "media", None, "image"), ("Bash", "shell", None, None), ("Bash", "shell", '{"stdout":"x","outputPath":"p"}', "persisted_output"),
        ("Edit", "file", '{"output":"x"}', "file_patch"), ("Edit", "file", '{"oldString":"a"}', None), ("Bash", "shell", '{"oldString":"a","newString":"b","stdout":""}', "file_patch"), ("Bash", "shell", '{"output":"x"}', "terminal_output"),
        ("Read", "file", '{"output":"x"}', None), ("WebFetch", "web", '{"agent_id":1,"task":2}', "agent_summary"), ("WebFetch", "web", '{"task":2}', "task_status"), ("WebFetch", "web", "{}", "web_result"), ("Skill", "skill", "{}", "tool_output"),
    ]
    frame = spark.createDataFrame(rows, "canonical string, category string, result string, want string")
    got = frame.select("want", tools.tool_result_kind("canonical", "category", "result").alias("kind")).collect()
    assert [r.kind for r in got] == [r.want for r in got]


def test_results_are_parsed_once(spark, sf):
    plan = registry.QUERIES["exp_22_23_37_results"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("get_json_object") < 15


def test_fields_follow_get_json_object(spark):
    from pyspark.sql import functions as F

    from fleetlog.functions import tools

    texts = [None, "", "x", "{}", "[]", '[{"a":1}]', '{"a":1', '{"a":1} x', '{"a":null,"a":2}', '{"a":1,"a":2}', '{"a":1.0}', '{"a":1e3}', '{"a":{"b": 1}}', '{"a":[1, 2]}', "{'a':'q'}", '{"a":"x\ny"}', '{"a":NaN}', '{"a":"\\u00e9"}', '{"a":true}', '{"a":"",}', '"a"', "null", '{"b":{"a":1}}', '{a:1}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.get_json_object("t", "$.a").alias("want"), tools.fields_of("t")["a"].alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == []
    nested = spark.createDataFrame([('{"metadata":{"outputPath":1}}',), ('{"metadata":"{\\"outputPath\\":1}"}',), ('{"metadata":{"outputPath":null}}',)], "r string").selectExpr("r", "'Z' as c")
    assert [r[0] for r in nested.select(tools.tool_result_kind("c", "c", "r")).collect()] == ["persisted_output", None, None]
