"""More queries over sessions, usage and messages, each with its SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import agents, pricing, times
from ..operators import catalog, order, search, usage
from ..plans import reports, sets
from ..sources import tables as T
from . import usage as U

QUERIES, ORACLES = {}, {}
TODAY = datetime.date(1998, 3, 5)
DAY_START, DAY_END = U.midnight("1998-03-05"), U.midnight("1998-03-06")
YEAR_START, YEAR_END = U.midnight("1998-01-01"), U.midnight("1998-03-06")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("jn_1_stats_sessions", f"{U.FACTS}, {T.SESSIONS_SQL} SELECT t.session_id, bucket, t.model, s.provider, s.project_path, turn_count FROM stats t JOIN sessions s ON t.session_id = s.id")
def jn_1(spark, sf):
    facts, rows = U.facts(spark, sf), T.sessions(spark, sf)
    return facts.join(rows.drop("model"), facts["session_id"] == rows["id"]).select("session_id", "bucket", "model", "provider", "project_path", "turn_count")


@query("jn_2_exclude_folded", f"{U.BASE} SELECT provider, count(*) AS n, CAST(sum({U.ALL}) AS BIGINT) AS tokens FROM base GROUP BY 1")
def jn_2(spark, sf):
    return U.base(spark, sf).groupBy("provider").agg(F.count("*").alias("n"), F.sum(usage.total()).alias("tokens"))


RANGES = (("month", "1997-03-01", "1997-03-31"), ("quarter", "1997-01-01", "1997-03-31"), ("years", "1995-06-17", "1998-02-28"), ("none", "2020-01-01", "2020-01-31"))


@query("agg_1_sessions_over_ranges", f"""{U.BASE}, d AS (SELECT *, {U.DAY} AS date FROM base), r(name, first, last) AS (VALUES {', '.join(map(str, RANGES))})
  SELECT name, provider, count(DISTINCT session_id) AS sessions, {U.SUM4} FROM d JOIN r ON date BETWEEN first AND last GROUP BY 1, 2""")
def agg_1_ranges(spark, sf):
    """Distinct sessions and sums of ranges that overlap, from sets and sums of days."""
    base = U.base(spark, sf)
    days = sets.day_sets(base, sets.session_numbers(base), U.TZ)
    return sets.over_ranges(days, sets.day_sums(base, U.TZ), spark.createDataFrame(RANGES, "name string, first string, last string"), "provider")


@query("jn_4_project_tools", f"{U.BASE}, {U.IDS_SQL}, {U.TOOLS_SQL} SELECT session_id, tool_key, count FROM tool_stats WHERE session_id IN (SELECT id FROM ids)")
def jn_4(spark, sf):
    ids = U.QUERIES["agg_12_project_session_ids"](spark, sf)
    return U.tool_rows(spark, sf).join(ids.select(F.col("id").alias("session_id")), "session_id", "left_semi").select("session_id", "tool_key", "count")


@query("agg_19_usage_stats", f"""{U.BASE}, {U.BOUND} SELECT 'sessions' AS part, '' AS name, CAST(count(DISTINCT session_id) AS DOUBLE) AS value FROM bounded UNION ALL SELECT 'model', model, CAST(sum({U.ALL}) AS DOUBLE) FROM bounded GROUP BY 2
  UNION ALL SELECT 'provider', provider, CAST(count(DISTINCT session_id) AS DOUBLE) FROM bounded GROUP BY 2 UNION ALL SELECT 'previous', '', CAST(count(DISTINCT session_id) AS DOUBLE) FROM base WHERE bucket >= 2 * {U.START_SQL} - {U.END_SQL} AND bucket < {U.START_SQL}""")
def agg_19(spark, sf):
    made = reports.usage_stats(U.facts(spark, sf), T.sessions(spark, sf), None, U.TZ, TODAY, start="1997-01-01", end="1998-12-31")
    part = lambda df, kind, name, value: df.select(F.lit(kind).alias("part"), name.alias("name"), value.cast("double").alias("value"))
    return (
        part(made["sessions"], "sessions", F.lit(""), F.col("sessions")).unionByName(part(made["models"], "model", F.col("model"), usage.total()))
        .unionByName(part(made["sessions_by_provider"], "provider", F.col("provider"), F.col("sessions"))).unionByName(part(made["previous"], "previous", F.lit(""), F.col("sessions")))
    )


@query("agg_20_project_tool_report", f"{U.BASE}, {U.IDS_SQL}, {U.TOOLS_SQL} SELECT CAST(sum(count) AS BIGINT) AS calls, (SELECT count(*) FROM ids) AS sessions FROM tool_stats WHERE session_id IN (SELECT id FROM ids)")
def agg_20(spark, sf):
    ids = U.QUERIES["agg_12_project_session_ids"](spark, sf)
    calls = reports.project_tool_usage(U.tool_rows(spark, sf), ids).agg(F.sum("calls").alias("calls"))
    return calls.join(F.broadcast(ids.agg(F.count("*").alias("sessions"))))


@query("agg_21_today", f"{U.BASE} SELECT coalesce(round(sum(cost_usd) + 1e-9, 4), 0) AS cost_usd, CAST(coalesce(sum({U.ALL}), 0) AS BIGINT) AS tokens FROM base WHERE bucket >= {DAY_START} AND bucket < {DAY_END}")
def agg_21(spark, sf):
    return reports.cost_and_tokens(reports.bounded(U.base(spark, sf), None, *times.resolve_bounds(U.TZ, TODAY, days=1)))


@query("agg_22_calendar", f"{U.BASE} SELECT {U.DAY} AS date, CAST(sum(turn_count) AS BIGINT) AS turns FROM base WHERE bucket >= {YEAR_START} AND bucket < {YEAR_END} GROUP BY 1")
def agg_22(spark, sf):
    days, _ = reports.activity_calendar(U.base(spark, sf), U.TZ, *times.day_range_epochs(*times.calendar_window(1998, TODAY), U.TZ))
    return days.select("date", "turns")


@query("exp_7_effective_model", f"{U.FACTS}, {T.SESSIONS_SQL} SELECT t.session_id, bucket, coalesce(nullif(CASE WHEN t.session_id % 2 = 0 THEN '' ELSE t.model END, ''), s.model, '') AS model FROM stats t JOIN sessions s ON t.session_id = s.id")
def exp_7(spark, sf):
    facts = U.facts(spark, sf).withColumn("model", F.when(F.col("session_id") % 2 == 0, "").otherwise(F.col("model")))
    return reports.with_sessions(facts, T.sessions(spark, sf)).select("session_id", "bucket", "model")


@query("exp_9_renderable", f"WITH {T.event_messages_sql()}, m AS (SELECT session_id, msg_index, role, CASE WHEN msg_index % 3 = 0 THEN ' ' ELSE content END AS content, CASE WHEN role = 'tool' AND msg_index % 5 = 0 THEN concat('toolu_', msg_index) ELSE tool_name END AS tool_name FROM messages) SELECT session_id, msg_index, CASE WHEN role = 'tool' THEN coalesce(tool_name, '') NOT LIKE 'toolu\\_%' ESCAPE '\\' AND (trim(content) <> '' OR coalesce(tool_name, '') <> '') ELSE trim(content) <> '' END AS shown FROM m")
def exp_9(spark, sf):
    rows = T.event_messages(spark, sf).withColumn("content", F.expr("if(msg_index % 3 = 0, ' ', content)")).withColumn("tool_name", F.expr("if(role = 'tool' and msg_index % 5 = 0, concat('toolu_', msg_index), tool_name)"))
    return rows.select("session_id", "msg_index", order.renderable().alias("shown"))


@query("win_6_image_placeholder", f"""WITH {T.event_messages_sql()}, r AS (SELECT session_id, msg_index, role, role = 'assistant' AS gives, CASE WHEN role = 'assistant' THEN concat('s', msg_index) END AS sources FROM messages WHERE role <> 'system'),
  l AS (SELECT *, role = 'user' AS waits, lead(gives) OVER w AS next_gives, lead(sources) OVER w AS next_sources, lag(role) OVER w = 'user' AS after_wait FROM r WINDOW w AS (PARTITION BY session_id ORDER BY msg_index))
  SELECT session_id, msg_index, role, CASE WHEN waits AND next_gives THEN next_sources ELSE sources END AS sources FROM l WHERE NOT (gives AND coalesce(after_wait, false))""")
def win_6(spark, sf):
    rows = T.event_messages(spark, sf).selectExpr("session_id", "msg_index", "role", "role = 'user' as has_image", "role = 'assistant' as is_meta", "role = 'system' as bookkeeping", "if(role = 'assistant', concat('s', msg_index), null) as sources")
    return order.merge_image_placeholder(rows)


@query("sa_5_token_totals", f"{U.FACTS}, {T.SESSIONS_SQL}, t AS (SELECT session_id, sum({U.ALL}) AS own FROM stats WHERE session_id % 3 <> 0 GROUP BY 1), e AS (SELECT session_id, sum({U.ALL}) AS loaded FROM usage_events GROUP BY 1) SELECT e.session_id, CAST(CASE WHEN coalesce(own, 0) > 0 THEN own ELSE loaded END AS BIGINT) AS tokens FROM e LEFT JOIN t USING (session_id)")
def sa_5(spark, sf):
    own = U.facts(spark, sf).where("session_id % 3 <> 0").groupBy("session_id").agg(F.sum(usage.total()).alias("own"))
    loaded = T.usage_events(spark, sf).groupBy("session_id").agg(F.sum(usage.total()).alias("loaded"))
    return loaded.join(own, "session_id", "left").select("session_id", F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("loaded")).alias("tokens"))


@query("sa_6_rates", f"""WITH {T.event_messages_sql()} SELECT session_id, round(sum(input_tokens + output_tokens + cache_read_tokens + cache_write_tokens) / nullif(count(*) FILTER (role = 'assistant'), 0), 6) AS tokens_per_turn, round(count(*) FILTER (role = 'tool') / nullif(count(*) FILTER (role = 'user'), 0), 6) AS tools_per_user_turn FROM messages GROUP BY 1""")
def sa_6(spark, sf):
    made = order.session_report(T.event_messages(spark, sf))
    return made.select("session_id", F.when(F.col("assistant") > 0, F.col("tokens_per_turn")).alias("tokens_per_turn"), "tools_per_user_turn")


@query("cat_12_purge_unknown", f"WITH {T.SESSIONS_SQL} SELECT id, provider FROM sessions WHERE provider IN ('low', 'medium')")
def cat_12(spark, sf):
    return catalog.purge_unknown(T.sessions(spark, sf), ["low", "medium"]).select("id", "provider")


@query("cat_8_content_changed", f"WITH {T.SESSIONS_SQL} SELECT count(*) FILTER (id % 4 = 0) AS rewritten, count(*) AS n FROM sessions")
def cat_8(spark, sf):
    rows = T.sessions(spark, sf).withColumn("title_custom", F.lit(False))
    new = rows.withColumn("content_text", F.expr("if(id % 4 = 0, concat(content_text, '!'), content_text)"))
    merged = catalog.merge_sessions(rows, new)
    return merged.agg(F.count_if("changed").alias("rewritten"), F.count("*").alias("n"))


@query("pr_4_model_candidates", """WITH m AS (SELECT DISTINCT concat('X', p_partkey % 90) AS x FROM part) SELECT concat('V/', x, '-20250101-fast') AS model, unnest([lower(concat('v/', x, '-20250101-fast')), lower(concat(x, '-20250101-fast')), lower(concat('v/', x, '-20250101')), lower(concat(x, '-20250101')), lower(concat('v/', x)), lower(x)]) AS candidate FROM m""")
def pr_4(spark, sf):
    models = T.read(spark, sf, "part").selectExpr("concat('V/X', p_partkey % 90, '-20250101-fast') as model").distinct()
    return models.select("model", F.explode(pricing.model_candidates("model")).alias("candidate"))


@query("exp_25_system_events", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN concat('[turn_duration] ', CAST(l_suppkey AS VARCHAR), '.5s, ', l_linenumber, ' messages') WHEN 1 THEN CASE WHEN l_suppkey * 100 < 1000 THEN concat('[compact_boundary] ', l_suppkey * 100, ' tokens') ELSE concat('[compact_boundary] ', l_suppkey // 10, '.', l_suppkey % 10, 'k tokens') END
  WHEN 2 THEN concat('[api_error] Unknown (retry ', l_linenumber, '/10)') WHEN 3 THEN '[away_summary]' WHEN 4 THEN concat('[stop_hook_summary] 1 hooks: run (', l_suppkey, 'ms)') END AS line FROM lineitem""")
def exp_25(spark, sf):
    rows = T.read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", """case l_partkey % 6 when 0 then concat('{"subtype":"turn_duration","durationMs":', l_suppkey * 1000 + 500, ',"messageCount":', l_linenumber, '}') when 1 then concat('{"subtype":"compact_boundary","compactMetadata":{"preTokens":', l_suppkey * 100, '}}')
      when 2 then concat('{"subtype":"api_error","retryAttempt":', l_linenumber, ',"maxRetries":10}') when 3 then '{"subtype":"away_summary","content":" "}' when 4 then concat('{"subtype":"stop_hook_summary","hookCount":1,"hookInfos":[{"command":"run","durationMs":', l_suppkey, '}]}') else '{"subtype":"new"}' end as j""")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", agents.system_event_text("j").alias("line"))


@query("jn_12_subagent_info", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'nick' WHEN 1 THEN concat('n', o_custkey) END AS nickname, concat('do ', o_custkey) AS description, CASE o_orderkey % 3 WHEN 0 THEN 'meta' WHEN 1 THEN 'tgt' ELSE concat('t', o_custkey) END AS agent_id, CASE WHEN o_orderkey % 3 = 0 THEN 'c1,c2' END AS children FROM orders""")
def jn_12(spark, sf):
    rows = T.read(spark, sf, "orders").selectExpr(
        "o_orderkey", """concat('{"prompt":"do ', o_custkey, '"', if(o_orderkey % 3 = 1, ',"targets":["tgt"]', ''), '}') as tool_input""",
        """case o_orderkey % 3 when 0 then '{"nickname":"nick"}' when 1 then concat('{"name":"n', o_custkey, '@session-1"}') else concat('ok\\nagent_id: t', o_custkey, ' x') end as content""", """if(o_orderkey % 3 = 0, '{"agentId":"meta","childConversationIds":["c1","","c2"]}', null) as structured""")
    return agents.subagent_info(rows).select("o_orderkey", "nickname", "description", "agent_id", F.array_join("child_ids", ",").alias("children"))


@query("jn_15_child_titles", """SELECT concat('a', o_orderkey) AS child_id, concat('job ', o_custkey) AS title FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT concat('b', o_orderkey), CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE concat('job ', o_custkey) END FROM orders WHERE o_orderkey % 2 = 1""")
def jn_15(spark, sf):
    orders = T.read(spark, sf, "orders")
    calls = orders.selectExpr("o_orderkey as session_id", "'c' as call_id", """concat('{"description":"job ', o_custkey, '"}') as tool_input""")
    results = orders.selectExpr("o_orderkey as session_id", "'c' as call_id", "1 as line_no", """if(o_orderkey % 2 = 0, concat('done\\nagent_id: a', o_orderkey), concat('<subagent agent_id="b', o_orderkey, '"', if(o_orderkey % 3 = 0, ' item="own"', ''), '> <subagent agent_id="z" outcome="failed">')) as output""")
    return agents.child_titles(calls, results)


@query("exp_35_parse_search", f"WITH {T.DOCS_SQL} SELECT id FROM docs WHERE provider = 'en' AND contains(project_name, 'src1') AND contains(translate(content_text, '{search.UPPER}', '{search.LOWER}'), 'the') ORDER BY CASE WHEN contains(translate(title, '{search.UPPER}', '{search.LOWER}'), 'the') THEN 0 WHEN contains(project_name, 'the') THEN 1 ELSE 2 END, created_at DESC, id LIMIT 100")
def exp_35(spark, sf):
    q, filters = search.parse_query("The provider:en project:src1")
    return search.search(T.search_docs(spark, sf), q, **filters).select("id")
