"""Queries that apply the column functions to whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, times, tools
from ..sources import tables as T

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


ODD_TS = "case when l_orderkey % 6 = 0 then date_format(l_shipdate, 'yyyy-MM-dd') when l_orderkey % 6 = 1 then date_format(l_shipdate, 'yyyy-MM') when l_orderkey % 6 = 2 then date_format(l_shipdate, 'yyyy-MM-dd HH:mm') when l_orderkey % 6 = 3 then concat(date_format(l_shipdate, \"yyyy-MM-dd'T'\"), '23:50:07.5+02:00') when l_orderkey % 6 = 4 then 'soon' else concat(date_format(l_shipdate, \"yyyy-MM-dd'T'\"), '01:02:03Z') end"


@query("exp_2_to_bucket", """SELECT l_orderkey, l_linenumber, CAST(CASE l_orderkey % 6 WHEN 0 THEN floor((epoch(l_shipdate) + 43200) / 900) * 900 WHEN 3 THEN floor((epoch(l_shipdate) + 85807.5 - 7200) / 900) * 900 WHEN 5 THEN floor((epoch(l_shipdate) + 3723) / 900) * 900 END AS BIGINT) AS bucket FROM lineitem""")
def exp_2(spark, sf):
    return T.read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{ODD_TS} as ts").select("l_orderkey", "l_linenumber", times.to_bucket("ts").alias("bucket"))


@query("exp_3_civil_date", "SELECT event_id, CAST(CAST((to_timestamp(epoch(ts)) AT TIME ZONE 'Pacific/Apia') AS DATE) AS VARCHAR) AS date FROM events")
def exp_3(spark, sf):
    return T.read(spark, sf, "events").selectExpr("event_id", f"{T.epoch('ts')} as at").select("event_id", times.civil_date("at", "Pacific/Apia").alias("date"))


@query("exp_11_project_name", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '(No Project)' WHEN 1 THEN '/' WHEN 2 THEN concat('c', o_custkey) ELSE concat('d', o_custkey) END AS name FROM orders")
def exp_11(spark, sf):
    paths = T.read(spark, sf, "orders").selectExpr("o_orderkey", "case o_orderkey % 4 when 0 then if(o_orderkey % 8 = 0, '', null) when 1 then '/' when 2 then concat('/w/x/c', o_custkey) else concat('/w/d', o_custkey, '/') end as path")
    return paths.select("o_orderkey", text.project_name("path").alias("name"))


@query("exp_12_session_title", "SELECT conv_id, turn, coalesce(nullif(trim(CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN text ELSE concat('x', text) END), ''), 'Untitled') AS title FROM conversations")
def exp_12(spark, sf):
    rows = T.read(spark, sf, "conversations").selectExpr("conv_id", "turn", "case turn % 3 when 0 then '[Image #1] [Image: source: /a.png]' when 1 then concat('[Image #2]', text) else concat('x[Image]', text) end as t")
    return rows.select("conv_id", "turn", text.session_title("t").alias("title"))


@query("exp_10_system_content", "SELECT doc_id, doc_id % 5 IN (0, 1) OR (doc_id % 5 = 2 AND octet_length(encode(concat('<x>', trim(text)))) > 200) AS is_system FROM documents")
def exp_10(spark, sf):
    rows = T.read(spark, sf, "documents").selectExpr("doc_id", "case doc_id % 5 when 0 then concat(' <system-note> ', text) when 1 then concat(text, ' sandbox_mode') when 2 then concat('<x>', text) when 3 then concat('<x>```', text) else text end as t")
    return rows.select("doc_id", text.is_system_content("t").alias("is_system"))


@query("snk_4_redact_home", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat('~/p', o_custkey) WHEN 1 THEN concat('~/p', o_custkey) WHEN 2 THEN concat('~/p/q', o_custkey) WHEN 3 THEN concat('~/home/x', o_custkey) ELSE concat('/srv/p', o_custkey) END AS path FROM orders")
def snk_4(spark, sf):
    rows = T.read(spark, sf, "orders").selectExpr("o_orderkey", "case o_orderkey % 5 when 0 then concat('/home/u1/p', o_custkey) when 1 then concat('/Users/u/p', o_custkey) when 2 then concat('C:', chr(92), 'Users', chr(92), 'u', chr(92), 'p', chr(92), 'q', o_custkey) when 3 then concat('~/home/x', o_custkey) else concat('/srv/p', o_custkey) end as p")
    return rows.select("o_orderkey", text.redact_home("p").alias("path"))


@query("exp_33_fmt_tokens", "SELECT o_orderkey, CASE WHEN n >= 1000000 THEN concat(printf('%.1f', n / 1e6), 'M') WHEN n >= 1000 THEN concat(printf('%.1f', n / 1e3), 'k') ELSE CAST(n AS VARCHAR) END AS label FROM (SELECT o_orderkey, o_orderkey * o_custkey % 3000001 AS n FROM orders)")
def exp_33(spark, sf):
    return T.read(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey * o_custkey % 3000001 as n").select("o_orderkey", text.fmt_tokens("n").alias("label"))


@query("exp_32_mixed_ts", "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN floor(epoch(ts)) * 1000 WHEN 1 THEN floor(epoch(ts)) * 1000 ELSE floor(epoch(ts)) * 1000 END AS BIGINT) AS ms FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3")
def exp_32(spark, sf):
    rows = T.read(spark, sf, "events").selectExpr("event_id", f"{T.epoch('ts')} as s", "ts").selectExpr("event_id", "case when event_id % 4 = 3 then 'never' when event_id % 3 = 0 then cast(s as string) when event_id % 3 = 1 then cast(s * 1000 as string) else date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end as t")
    return rows.select("event_id", times.mixed_ts_ms("t").alias("ms"))


@query("exp_26_image_sources", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('/a', doc_id, '.png|b.jpg') WHEN 1 THEN concat('c', doc_id) ELSE '' END AS sources FROM documents")
def exp_26(spark, sf):
    rows = T.read(spark, sf, "documents").selectExpr("doc_id", "case doc_id % 3 when 0 then concat('[Image: source: /a', doc_id, '.png] ', text, ' [Image source: b.jpg]') when 1 then concat(text, '[Image #4][Image source: c', doc_id, ']') else concat('[Image #1]', text) end as t")
    return rows.select("doc_id", F.array_join(text.image_sources("t"), "|").alias("sources"))


@query("exp_28_persisted_paths", "SELECT doc_id, concat('/o/', doc_id % 7) AS paths FROM documents")
def exp_28(spark, sf):
    rows = T.read(spark, sf, "documents").selectExpr("doc_id", "concat('saved to: /no ', '<persisted-output>\\nFull output saved to: /o/', doc_id % 7, '\\n', substr(text, 1, 50), '</persisted-output> <persisted-output>saved to: /o/', doc_id % 7, '</persisted-output>') as t")
    return rows.select("doc_id", F.array_join(text.persisted_paths("t"), "|").alias("paths"))


@query("exp_31_strip_ansi", "SELECT doc_id, concat('red ', doc_id, ' end') AS plain FROM documents")
def exp_31(spark, sf):
    rows = T.read(spark, sf, "documents").selectExpr("doc_id", "concat(chr(27), '[31mred', chr(27), '[0m \\n\\n  ', doc_id, '\\r\\n', chr(27), '[2Kend') as t")
    return rows.select("doc_id", text.strip_ansi("t").alias("plain"))


@query("exp_27_content_segments", "SELECT doc_id, 0 AS pos, 'text' AS kind, NULL::VARCHAR AS lang, 'intro' AS body FROM documents UNION ALL SELECT doc_id, 1, 'code', 'py', concat('x = ', doc_id) FROM documents UNION ALL SELECT doc_id, 2, 'image', NULL, 'a.png' FROM documents UNION ALL SELECT doc_id, 3, 'text', NULL, concat(' tail ', lang) FROM documents")
def exp_27(spark, sf):
    rows = T.read(spark, sf, "documents").selectExpr("doc_id", "concat('intro```py\\nx = ', doc_id, '\\n```[Image: source: a.png] tail ', lang) as t")
    return rows.select("doc_id", F.posexplode(text.content_segments("t")).alias("pos", "s")).select("doc_id", "pos", "s.*")


@query("exp_29_content_parts", "SELECT doc_id, concat('hello ', doc_id, chr(10), '[Audio: source: u', doc_id, ']', chr(10), '[Image: source: v]', chr(10), '[unsupported blob]') AS rendered FROM documents")
def exp_29(spark, sf):
    parts = "array(named_struct('type', 'text', 'text', concat('hello ', doc_id), 'url', ''), named_struct('type', 'text', 'text', '<audio>', 'url', ''), named_struct('type', 'audio_url', 'text', '', 'url', concat('u', doc_id)), named_struct('type', 'image_url', 'text', '', 'url', 'v'), named_struct('type', 'blob', 'text', '', 'url', ''))"
    return T.read(spark, sf, "documents").selectExpr("doc_id", f"{parts} as parts").select("doc_id", text.content_parts_text("parts").alias("rendered"))


@query("exp_36_display_key", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN concat('cc-mirror:v', o_orderkey % 5) WHEN o_orderkey % 3 = 0 THEN 'cc-mirror' ELSE 'other' END AS key FROM orders")
def exp_36(spark, sf):
    rows = T.read(spark, sf, "orders").selectExpr("o_orderkey", "if(o_orderkey % 3 = 0, 'cc-mirror', 'other') as provider", "if(o_orderkey % 2 = 0, concat('v', o_orderkey % 5), '') as variant")
    return rows.select("o_orderkey", text.display_key("provider", "variant").alias("key"))


@query("exp_38_user_text_range", "SELECT doc_id, substr(text, CAST(least(doc_id % 7, doc_id % 40) + 1 AS INTEGER), CAST(doc_id % 40 - least(doc_id % 7, doc_id % 40) AS INTEGER)) AS part FROM documents")
def exp_38(spark, sf):
    return T.read(spark, sf, "documents").selectExpr("doc_id", "text", "doc_id % 7 as a", "doc_id % 40 as b").select("doc_id", text.user_text_range("text", "a", "b").alias("part"))


@query("src_13_parent_from_path", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('s', o_custkey) WHEN 1 THEN 'inner' END AS parent FROM orders")
def src_13(spark, sf):
    rows = T.read(spark, sf, "orders").selectExpr("o_orderkey", "case o_orderkey % 3 when 0 then concat('/r/s', o_custkey, '/subagents/a.jsonl') when 1 then concat('/r/s', o_custkey, '/subagents/inner/subagents/x/a.jsonl') else '/r/a.jsonl' end as path")
    return rows.select("o_orderkey", text.parent_from_path("path").alias("parent"))


RAW = "case l_partkey % 6 when 0 then 'read_file' when 1 then 'exec_command' when 2 then 'mcp__git__list_all' when 3 then 'chat-x' when 4 then 'strange' else 'MyAgentTool' end"


@query("exp_17_19_tools", f"""SELECT l_orderkey, l_linenumber, l_partkey, r.* FROM lineitem JOIN (VALUES (0, 'Read', 'file', 'Read'), (1, 'Bash', 'shell', 'Bash'), (2, 'mcp__git__list_all', 'mcp', 'list all'), (3, 'chat-x', 'mcp', 'chat-x'), (4, 'strange', 'unknown', 'strange'), (5, 'Agent', 'agent', 'Agent')) r(k, canonical, category, display) ON l_partkey % 6 = k""")
def exp_17(spark, sf):
    rows = T.read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "cast(l_partkey % 6 as int) as k", f"{RAW} as tool_name", "'folding' as provider")
    return tools.with_tools(rows, "folding").select("l_orderkey", "l_linenumber", "l_partkey", "k", "canonical", "category", "display")


@query("exp_20_server_name", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 6 = 2 THEN 'git' END AS server, CASE WHEN l_partkey % 6 = 2 THEN 'list_all' END AS tool FROM lineitem")
def exp_20(spark, sf):
    rows = T.read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{RAW} as raw")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", tools.server_name("raw").alias("n")).select("l_orderkey", "l_linenumber", "l_partkey", "n.server", "n.tool")


@query("exp_21_tool_targets", """SELECT target, count(*) AS calls FROM (SELECT CASE l_partkey % 4 WHEN 0 THEN concat('~/f', l_suppkey % 9) WHEN 1 THEN concat('ls ', l_suppkey % 9) WHEN 2 THEN concat('/x', l_suppkey % 9, '/ ~/d') ELSE concat('do ', l_suppkey % 9) END AS target FROM lineitem) GROUP BY 1""")
def exp_21(spark, sf):
    rows = T.read(spark, sf, "lineitem").selectExpr("case l_partkey % 4 when 0 then 'Read' when 1 then 'Bash' when 2 then 'Grep' else 'Agent' end as canonical", "case l_partkey % 4 when 0 then to_json(named_struct('path', concat('/home/u/f', l_suppkey % 9))) when 1 then to_json(named_struct('cmd', concat('ls ', l_suppkey % 9))) when 2 then to_json(named_struct('pattern', concat('x', l_suppkey % 9), 'path', '/Users/u/d')) else to_json(named_struct('prompt', concat('do ', l_suppkey % 9))) end as input")
    return rows.select(tools.tool_target("canonical", "input").alias("target")).groupBy("target").agg(F.count("*").alias("calls"))


RESULTS = """case l_partkey % 9 when 0 then '{"stdout":"x"}' when 1 then '{"oldString":"a","newString":"b"}' when 2 then '{"agentId":"q","status":"done"}' when 3 then '{"task":1}' when 4 then '{"metadata":{"outputPath":"/p"}}' when 5 then '{"interrupted":true}' when 6 then '{"success":false}' when 7 then '{"url":"u","durationMs":3}' else null end"""


@query("exp_22_23_37_results", """SELECT l_orderkey, l_linenumber, l_partkey, r.s AS status, CASE WHEN l_suppkey % 10 = 0 THEN 'error' ELSE r.s END AS real_status, r.kind, r.name FROM lineitem JOIN (VALUES (0, 'success', 'terminal_output', 'Bash'), (1, 'success', 'file_patch', 'Edit'), (2, 'done', 'agent_summary', 'Agent'), (3, 'success', 'task_status', 'TaskCreate'), (4, 'success', 'persisted_output', 'id'), (5, 'interrupted', 'web_result', 'id'), (6, 'error', 'web_result', 'id'), (7, 'success', 'web_result', 'WebFetch'), (8, 'success', NULL, 'id')) r(k, s, kind, name) ON l_partkey % 9 = k""")
def exp_22(spark, sf):
    rows = T.read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{RESULTS} as result", "l_suppkey % 10 = 0 as is_error", "cast(null as string) as given", "'WebFetch' as canonical", "'web' as category", "'id' as call_id", "false as fine").withColumn("fields", tools.fields_of("result"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", tools.tool_status("result", "fine", "given", "fields").alias("status"), tools.tool_status("result", "is_error", "given", "fields").alias("real_status"), tools.tool_result_kind("canonical", "category", "result", "fields").alias("kind"), tools.orphan_tool_name("result", "call_id", "fields").alias("name"))


@query("exp_24_structured_ids", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS agent, CASE WHEN l_partkey % 3 = 2 THEN CAST(l_suppkey AS VARCHAR) END AS task FROM lineitem")
def exp_24(spark, sf):
    rows = T.read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", """case l_partkey % 3 when 0 then '{"agentId":"a","agent_id":"z"}' when 1 then '{"new_thread_id":"b","sub_session_id":"c"}' else concat('{"task_id":"', l_suppkey, '"}') end as r""")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", tools.structured_ids("r").alias("i")).selectExpr("l_orderkey", "l_linenumber", "l_partkey", "i.agentId as agent", "i.taskId as task")


@query("exp_14_block_log_usage", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey END AS input, CASE WHEN l_partkey % 4 <> 0 THEN greatest(l_suppkey, CASE WHEN l_partkey % 4 = 1 THEN 3 * l_linenumber ELSE 0 END) END AS cache_write FROM lineitem")
def exp_14(spark, sf):
    rows = T.read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "case l_partkey % 4 when 0 then '{\"input_tokens\":0}' when 1 then concat('{\"input_tokens\":', l_partkey, ',\"cache_creation_input_tokens\":', l_suppkey, ',\"cache_creation\":{\"ephemeral_5m_input_tokens\":', l_linenumber, ',\"ephemeral_1h_input_tokens\":', 2 * l_linenumber, '}}') else concat('{\"input_tokens\":', l_partkey, ',\"cache_creation_input_tokens\":', l_suppkey, '}') end as u")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", tools.block_log_usage("u").alias("u")).selectExpr("l_orderkey", "l_linenumber", "l_partkey", "u.input", "u.cache_write")


@query("exp_13_15_usage_fields", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 3 WHEN 0 THEN l_partkey WHEN 1 THEN l_suppkey END AS first_input, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey + 5 END AS output FROM lineitem")
def exp_13(spark, sf):
    rows = T.read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "case l_partkey % 3 when 0 then concat('{\"input\":', l_partkey, ',\"output\":', l_suppkey, ',\"reasoning\":5}') when 1 then concat('{\"in\":', l_suppkey, ',\"input\":\"bad\"}') else '{}' end as u")
    first = tools.usage_fields("u", {"input": ["$.in", "$.input"], "output": ["$.output"]})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", first.alias("a"), tools.relational_usage("u").alias("b")).selectExpr("l_orderkey", "l_linenumber", "l_partkey", "a.input as first_input", "b.output as output")


@query("exp_16_split_input", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey - l_suppkey * 5 - l_linenumber >= 0 THEN l_partkey - l_suppkey * 5 - l_linenumber END AS strict, l_partkey - least(l_suppkey * 5, l_partkey) AS clamped FROM lineitem")
def exp_16(spark, sf):
    rows = T.read(spark, sf, "lineitem").withColumn("cached", F.col("l_suppkey") * 5)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", tools.split_input("l_partkey", "cached", "l_linenumber").alias("strict"), tools.split_input("l_partkey", "cached", clamp=True).alias("clamped"))


@query("exp_30_agent_mail", "SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [concat('[agent_mail] a', doc_id, ': done'), '[agent_mail] b: body'] ELSE ['[agent_mail] plain'] END) AS mail FROM documents")
def exp_30(spark, sf):
    rows = T.read(spark, sf, "documents").selectExpr("doc_id", "if(doc_id % 2 = 0, concat('Another <teammate-message teammate_id=\"a', doc_id, '\" summary=\"done\">x</teammate-message>\\n<teammate-message teammate_id=\"b\">\\n body </teammate-message>'), ' plain ') as t")
    return rows.select("doc_id", F.explode(text.agent_mail("t")).alias("mail"))
