"""Queries over logs, exports, ranges and streams, each with its SQL. The logs are made of the tables' rows."""

from __future__ import annotations

import contextlib
import datetime

from pyspark.sql import functions as F

from ..functions import times
from ..operators import catalog, postings, search, usage
from ..plans import reports
from ..sources import kept, logs, ranges, sinks
from ..sources import tables as T
from ..sources.facts import FactTable
from ..streaming import deltas, jobs, late, merge
from . import usage as U

QUERIES, ORACLES = {}, {}
MESSAGES = f"WITH {T.event_messages_sql()}"
LATE = "100000 days"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def lines_of(rows, raw: str):
    """Lines of one log for each session: a message is a line, of which every 17th is broken."""
    made = rows.selectExpr("cast(session_id as string) as source_path", "msg_index + 1 as line_no", f"if(msg_index % 17 = 5, '{{bad', {raw}) as raw")
    return logs.checked(made)


def event_lines(spark, sf):
    return T.event_messages(spark, sf).selectExpr("session_id % 16 as log", "row_number() over (partition by session_id % 16 order by session_id, msg_index) as line_no", "if(msg_index % 11 = 3, ' ', if(msg_index % 17 = 5, '{bad', to_json(struct(session_id, content)))) as raw")


EVENT_LINES = f"""{MESSAGES}, made AS (SELECT session_id % 16 AS log, row_number() OVER (PARTITION BY session_id % 16 ORDER BY session_id, msg_index) AS line_no, msg_index % 11 = 3 AS blank, msg_index % 17 = 5 AS bad, content FROM messages)"""


def log_folder(spark, sf):
    folder = kept.shared_folder(spark, "logs")
    logs.write_logs(event_lines(spark, sf), folder)
    return folder


def log_number():
    return F.regexp_extract("source_path", "log=([0-9]+)", 1).cast("long").alias("log")


@query("src_1_discover_logs", f"{EVENT_LINES} SELECT DISTINCT log, 'agent' AS provider FROM made")
def src_1(spark, sf):
    found = logs.discover_logs(spark, log_folder(spark, sf), logs.LogFormat("agent", "part-*.txt")).where("size > 0 and mtime > 0")
    return found.select(log_number(), "provider")


LISTING_SQL = """listing AS (SELECT concat('/logs/', CASE o_orderkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'archive' ELSE 'old' END, '/', o_orderkey // 2, '.jsonl') AS source_path, concat(o_orderkey // 2, '.jsonl') AS rel_path,
  o_orderkey % 3 AS root_rank, o_orderkey AS session_id, CAST(floor(o_totalprice) AS BIGINT) AS size, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS mtime, concat('title ', o_custkey) AS title FROM orders)"""
KNOWN_SQL = "known AS (SELECT source_path, size + CASE WHEN session_id % 5 = 0 THEN 1 ELSE 0 END AS size, mtime, session_id, CASE WHEN session_id % 4 = 0 THEN NULL ELSE title END AS title FROM listing WHERE session_id % 7 <> 0)"
STALE_SQL = "stale AS (SELECT l.* FROM listing l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.mtime <> 0 AND k.source_path = l.source_path AND k.size = l.size AND k.mtime = l.mtime))"


def listing(spark, sf):
    return T.read(spark, sf, "orders").selectExpr(
        "concat('/logs/', case o_orderkey % 3 when 0 then 'active' when 1 then 'archive' else 'old' end, '/', o_orderkey div 2, '.jsonl') as source_path", "concat(o_orderkey div 2, '.jsonl') as rel_path",
        "o_orderkey % 3 as root_rank", "o_orderkey as session_id", "cast(floor(o_totalprice) as bigint) as size", f"if(o_orderkey % 13 = 0, 0, {T.epoch('o_orderdate')}) as mtime", "concat('title ', o_custkey) as title",
    )


def known(spark, sf):
    return listing(spark, sf).where("session_id % 7 <> 0").selectExpr("source_path", "size + if(session_id % 5 = 0, 1, 0) as size", "mtime", "session_id", "if(session_id % 4 = 0, null, title) as title")


@query("src_2_prefer_active_copy", f"WITH {LISTING_SQL} SELECT rel_path, root_rank, source_path FROM listing QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY root_rank, source_path) = 1")
def src_2(spark, sf):
    return logs.prefer_active_copy(listing(spark, sf).select("rel_path", "root_rank", "source_path"))


@query("src_3_stale_files", f"WITH {LISTING_SQL}, {KNOWN_SQL}, {STALE_SQL} SELECT source_path, size, mtime, true AS stale FROM stale UNION ALL SELECT source_path, size, mtime, false FROM listing WHERE source_path NOT IN (SELECT source_path FROM stale)")
def src_3(spark, sf):
    rows, seen = listing(spark, sf).select("source_path", "size", "mtime"), known(spark, sf)
    return logs.stale_files(rows, seen).withColumn("stale", F.lit(True)).unionByName(logs.unchanged_files(rows, seen).withColumn("stale", F.lit(False)))


@query("src_4_stale_by_title", f"WITH {LISTING_SQL}, {KNOWN_SQL}, {STALE_SQL} SELECT source_path, size, mtime FROM stale UNION ALL SELECT l.source_path, l.size, l.mtime FROM listing l JOIN known k USING (source_path) WHERE l.source_path NOT IN (SELECT source_path FROM stale) AND k.title IS NOT NULL AND l.session_id % 3 = 0")
def src_4(spark, sf):
    rows = listing(spark, sf)
    titles = rows.select("session_id", F.expr("if(session_id % 3 = 0, concat(title, ' renamed'), title)").alias("title"))
    return logs.stale_by_title(rows.select("source_path", "size", "mtime"), known(spark, sf), titles)


@query("src_5_known_sources", f"WITH {LISTING_SQL}, s AS (SELECT concat('/p/', session_id // 4) AS source_path, size, mtime, session_id, session_id % 4 < 2 AS is_sidechain, title, session_id % 3 = 0 AS title_custom FROM listing WHERE root_rank < 2) SELECT source_path, size, mtime, session_id, CASE WHEN NOT title_custom THEN title END AS title FROM s QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY is_sidechain, session_id) = 1")
def src_5(spark, sf):
    rows = listing(spark, sf).selectExpr("concat('/p/', session_id div 4) as source_path", "size", "mtime", "session_id as id", "session_id % 4 < 2 as is_sidechain", "title", "session_id % 3 = 0 as title_custom", "if(root_rank < 2, 'agent', 'other') as provider")
    return logs.known_sources(rows, "agent")


@query("src_6_read_log_lines", f"{EVENT_LINES} SELECT log, line_no, bad AS malformed, CASE WHEN NOT bad THEN content END AS content FROM made WHERE NOT blank")
def src_6(spark, sf):
    lines = logs.read_log_lines(spark, log_folder(spark, sf))
    return lines.select(log_number(), "line_no", "malformed", F.when(~F.col("malformed"), F.get_json_object("raw", "$.content")).alias("content"))


@query("src_6_malformed_counts", f"{EVENT_LINES} SELECT log, count(*) FILTER (bad) AS malformed, count(*) AS lines FROM made WHERE NOT blank GROUP BY 1")
def src_6_malformed(spark, sf):
    lines = event_lines(spark, sf).selectExpr("cast(log as string) as source_path", "line_no", "raw")
    return logs.malformed_counts(logs.checked(lines)).select(F.col("source_path").cast("long").alias("log"), "malformed", "lines")


BLOCK_RAW = """case role
  when 'user' then to_json(named_struct('type', 'user', 'timestamp', '2024-01-02T03:04:05Z', 'message', named_struct('role', 'user', 'content', content)))
  when 'assistant' then to_json(named_struct('type', 'assistant', 'message', named_struct('role', 'assistant', 'model', 'm1', 'content', array(named_struct('type', 'thinking', 'thinking', concat('about ', content), 'text', null),
    named_struct('type', 'text', 'thinking', null, 'text', content), named_struct('type', 'text', 'thinking', null, 'text', 'more')), 'usage', named_struct('input_tokens', input_tokens, 'output_tokens', output_tokens, 'cache_read_input_tokens', cache_read_tokens))))
  when 'tool' then to_json(named_struct('type', 'assistant', 'message', named_struct('role', 'assistant', 'content', array(named_struct('type', 'tool_use', 'id', concat('c', msg_index), 'name', tool_name, 'input', named_struct('path', content))))))
  else to_json(named_struct('type', 'user', 'message', named_struct('role', 'user', 'content', array(named_struct('type', 'tool_result', 'tool_use_id', concat('c', msg_index), 'content', content, 'is_error', true), named_struct('type', 'odd', 'tool_use_id', null, 'content', null, 'is_error', null))))) end"""
_BLOCK = "CAST(session_id AS VARCHAR) AS source_path, msg_index + 1 AS line_no"


@query("src_7_normalize_block_log", f"""{MESSAGES}, good AS (SELECT * FROM messages WHERE msg_index % 17 <> 5)
  SELECT {_BLOCK}, 0 AS part, 'user' AS role, content, NULL AS tool_name, NULL AS tool_path, NULL AS call_id, NULL::BOOLEAN AS is_error, NULL::BIGINT AS used, 1704164645::BIGINT AS at FROM good WHERE role = 'user'
  UNION ALL SELECT {_BLOCK}, 0, 'system', 'about ' || content, NULL, NULL, NULL, NULL, nullif(input_tokens + output_tokens + cache_read_tokens, 0), NULL FROM good WHERE role = 'assistant'
  UNION ALL SELECT {_BLOCK}, 1, 'assistant', content || chr(10) || 'more', NULL, NULL, NULL, NULL, nullif(input_tokens + output_tokens + cache_read_tokens, 0), NULL FROM good WHERE role = 'assistant'
  UNION ALL SELECT {_BLOCK}, 0, 'tool', NULL, tool_name, content, 'c' || msg_index, NULL, NULL, NULL FROM good WHERE role = 'tool'
  UNION ALL SELECT {_BLOCK}, 0, 'result', content, NULL, NULL, 'c' || msg_index, true, NULL, NULL FROM good WHERE role = 'system'
  UNION ALL SELECT {_BLOCK}, 1, 'unknown', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM good WHERE role = 'system'""")
def src_7(spark, sf):
    rows = logs.normalize_block_log(lines_of(T.event_messages(spark, sf), BLOCK_RAW))
    used = F.col("usage.input") + F.col("usage.output") + F.col("usage.cache_read") + F.col("usage.cache_write")
    return rows.select("source_path", "line_no", "part", "role", "content", "tool_name", F.get_json_object("tool_input", "$.path").alias("tool_path"), "call_id", "is_error", used.alias("used"), F.unix_seconds("ts").alias("at"))


EVENT_RAW = """case role
  when 'user' then to_json(named_struct('type', 'event_msg', 'payload', named_struct('type', 'user_message', 'message', content)))
  when 'assistant' then if(msg_index % 2 = 0, to_json(named_struct('type', 'response_item', 'payload', named_struct('type', 'message', 'role', 'assistant', 'content', array(named_struct('text', content), named_struct('text', 'end'))))),
    to_json(named_struct('type', 'event_msg', 'payload', named_struct('type', 'token_count', 'info', named_struct('total_token_usage', named_struct('input_tokens', input_tokens, 'output_tokens', output_tokens), 'model', 'm2')))))
  when 'tool' then if(tool_name = 'read_file', to_json(named_struct('type', 'response_item', 'payload', named_struct('type', 'function_call', 'name', tool_name, 'call_id', concat('c', msg_index)))),
    to_json(named_struct('type', 'response_item', 'payload', named_struct('type', 'function_call_output', 'call_id', concat('c', msg_index), 'output', content))))
  else if(msg_index % 2 = 0, to_json(named_struct('type', 'turn_context', 'payload', named_struct('model', 'm1'))), to_json(named_struct('type', 'strange'))) end"""


@query("src_8_normalize_event_log", f"""{MESSAGES}, k AS (SELECT *, CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN CASE WHEN msg_index % 2 = 0 THEN 'message' ELSE 'token_count' END
    WHEN 'tool' THEN CASE WHEN tool_name = 'read_file' THEN 'function_call' ELSE 'function_call_output' END ELSE CASE WHEN msg_index % 2 = 0 THEN 'turn_context' ELSE 'unknown' END END AS kind FROM messages WHERE msg_index % 17 <> 5)
  SELECT {_BLOCK}, kind, CASE kind WHEN 'user_message' THEN 'user' WHEN 'message' THEN 'assistant' WHEN 'function_call' THEN 'tool' WHEN 'function_call_output' THEN 'result' END AS role,
    CASE kind WHEN 'user_message' THEN content WHEN 'message' THEN content || chr(10) || 'end' WHEN 'function_call_output' THEN content END AS content, CASE WHEN kind = 'function_call' THEN tool_name END AS tool_name,
    CASE WHEN role = 'tool' THEN 'c' || msg_index END AS call_id, CASE WHEN kind = 'turn_context' THEN 'm1' END AS model, CASE WHEN kind = 'token_count' THEN input_tokens END AS total_input_tokens, CASE WHEN kind = 'token_count' THEN 'm2' END AS info_model FROM k""")
def src_8(spark, sf):
    rows = logs.normalize_event_log(lines_of(T.event_messages(spark, sf), EVENT_RAW))
    return rows.select("source_path", "line_no", "kind", "role", "content", "tool_name", "call_id", "model", "total_input_tokens", "info_model")


WIRE_RAW = """case role
  when 'user' then to_json(named_struct('type', if(msg_index % 2 = 0, 'turn.prompt', 'context.append_message'), 'time', ts_ms, 'message', named_struct('role', 'user', 'content', content)))
  when 'assistant' then if(msg_index % 3 = 0, to_json(named_struct('type', 'usage.record', 'time', ts_ms, 'usage', named_struct('inputOther', input_tokens, 'output', output_tokens), 'usageScope', 'turn', 'model', 'm3')),
    to_json(named_struct('type', 'context.append_loop_event', 'time', ts_ms, 'event', named_struct('type', 'content.part', 'part', if(msg_index % 3 = 1, named_struct('type', 'text', 'text', content, 'think', null), named_struct('type', 'think', 'text', null, 'think', content))))))
  when 'tool' then to_json(named_struct('type', 'context.append_loop_event', 'time', ts_ms, 'event', named_struct('type', 'tool.call', 'toolCallId', concat('c', msg_index), 'name', tool_name)))
  else to_json(named_struct('type', 'context.append_loop_event', 'time', ts_ms, 'event', named_struct('type', 'tool.result', 'toolCallId', concat('c', msg_index), 'result', content))) end"""


@query("src_9_normalize_wire_log", f"""{MESSAGES}, k AS (SELECT *, CASE role WHEN 'user' THEN CASE WHEN msg_index % 2 = 0 THEN 'turn.prompt' ELSE 'context.append_message' END WHEN 'assistant' THEN CASE WHEN msg_index % 3 = 0 THEN 'usage.record' ELSE 'content.part' END WHEN 'tool' THEN 'tool.call' ELSE 'tool.result' END AS kind FROM messages WHERE msg_index % 17 <> 5)
  SELECT {_BLOCK}, kind, CASE kind WHEN 'content.part' THEN CASE WHEN msg_index % 3 = 2 THEN 'system' ELSE 'assistant' END WHEN 'tool.call' THEN 'tool' WHEN 'tool.result' THEN 'result' WHEN 'usage.record' THEN NULL ELSE 'user' END AS role,
    CASE WHEN kind NOT IN ('usage.record', 'tool.call') THEN content END AS content, CASE WHEN kind = 'tool.call' THEN tool_name END AS tool_name, CASE WHEN kind LIKE 'tool.%' THEN 'c' || msg_index END AS call_id, ts_ms,
    CASE WHEN kind = 'usage.record' THEN input_tokens END AS input_other, CASE WHEN kind = 'usage.record' THEN 'turn' END AS scope, CASE WHEN kind = 'usage.record' THEN 'm3' END AS model FROM k""")
def src_9(spark, sf):
    rows = logs.normalize_wire_log(lines_of(T.event_messages(spark, sf), WIRE_RAW))
    return rows.select("source_path", "line_no", "kind", "role", "content", "tool_name", "call_id", "ts_ms", F.col("usage.inputOther").alias("input_other"), "scope", "model")


UPDATE_RAW = """to_json(named_struct('timestamp', ts_ms div 1000, 'params', named_struct('update', if(role = 'tool',
  named_struct('sessionUpdate', 'tool_call_update', 'toolCallId', concat('c', msg_index div 4), 'status', if(msg_index % 2 = 0, tool_name, null), 'title', content, 'rawOutput', if(msg_index % 3 = 0, content, null), '_meta', null),
  named_struct('sessionUpdate', 'user_message_chunk', 'toolCallId', null, 'status', null, 'title', null, 'rawOutput', null, '_meta', named_struct('promptIndex', msg_index div 3))))))"""


@query("src_10_normalize_update_log", f"""{MESSAGES}, good AS (SELECT * FROM messages WHERE msg_index % 17 <> 5),
  prompts AS (SELECT session_id, msg_index // 3 AS prompt_index, arg_min(ts_ms // 1000, msg_index) AS ts FROM good WHERE role <> 'tool' GROUP BY 1, 2),
  tools AS (SELECT session_id, 'c' || (msg_index // 4) AS call_id, arg_max(tool_name, msg_index) FILTER (msg_index % 2 = 0) AS status, arg_max(content, msg_index) AS title, arg_max(content, msg_index) FILTER (msg_index % 3 = 0) AS tool_output FROM good WHERE role = 'tool' GROUP BY 1, 2),
  t AS (SELECT session_id, msg_index AS line_no, CASE WHEN role = 'user' THEN 'user' ELSE 'other' END AS type, content, msg_index // 3 AS prompt_index, CASE WHEN role = 'tool' THEN 'c' || (msg_index // 4) END AS call_id FROM messages)
  SELECT CAST(session_id AS VARCHAR) AS session_id, line_no, type, content, prompt_index, call_id, CASE WHEN type = 'user' THEN ts END AS ts, status, title, tool_output FROM t LEFT JOIN prompts USING (session_id, prompt_index) LEFT JOIN tools USING (session_id, call_id)""")
def src_10(spark, sf):
    rows = T.event_messages(spark, sf)
    transcript = rows.selectExpr("cast(session_id as string) as session_id", "msg_index as line_no", "if(role = 'user', 'user', 'other') as type", "content", "msg_index div 3 as prompt_index", "if(role = 'tool', concat('c', msg_index div 4), null) as call_id")
    return logs.normalize_update_log(transcript, lines_of(rows, UPDATE_RAW)).drop("tool_input")


@query("src_11_normalize_relational", f"""WITH {T.SESSIONS_SQL}, m AS (SELECT l_orderkey AS session_id, count(*) AS messages, max(CASE WHEN l_linenumber % 2 = 0 THEN l_shipmode_ END) AS model FROM (SELECT *, concat('m', l_suppkey % 3) AS l_shipmode_ FROM lineitem) GROUP BY 1),
  p AS (SELECT l_orderkey AS session_id, string_agg('text ' || l_partkey, chr(10) ORDER BY n) AS content_text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 4 <> 0)) WHERE n <= 3 GROUP BY 1)
  SELECT s.id, s.title, CASE WHEN s.id % 3 = 0 THEN CASE WHEN s.id % 2 = 0 THEN '' ELSE '/tree/' || s.project_name END ELSE s.project_path END AS project_path, upper(s.project_name) AS project_name, CASE WHEN s.id % 5 = 0 THEN 'main' END AS branch, coalesce(m.messages, 0) AS messages, m.model, coalesce(p.content_text, '') AS content_text
  FROM (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN concat(project_name, 'root') ELSE project_name END AS project_name) FROM sessions) s LEFT JOIN m ON m.session_id = s.id LEFT JOIN p ON p.session_id = s.id""")
def src_11(spark, sf):
    own = T.sessions(spark, sf).withColumn("project_name", F.expr("if(id % 2 = 0, concat(project_name, 'root'), project_name)"))
    session = own.selectExpr("id", "title", "if(id % 3 = 0, '', project_path) as directory", "project_name as project_id", "if(id % 5 = 0, 'w', null) as workspace_id")
    project = own.select("project_name").distinct().selectExpr("project_name as id", "if(project_name like '%root', '/', concat('/tree/', project_name)) as worktree", "upper(project_name) as name")
    workspace = own.select(F.lit("w").alias("id"), F.lit("main").alias("branch")).distinct()
    line = T.read(spark, sf, "lineitem")
    message = line.selectExpr("l_linenumber as id", "l_orderkey as session_id", "to_json(named_struct('role', if(l_linenumber % 2 = 0, 'assistant', 'user'), 'modelID', concat('m', l_suppkey % 3))) as data")
    part = line.select("l_orderkey", "l_partkey", "l_suppkey").distinct().selectExpr("l_suppkey as message_id", "l_orderkey as session_id", "to_json(named_struct('type', if(l_partkey % 4 <> 0, 'text', 'tool'), 'text', concat('text ', l_partkey))) as data", "l_partkey as time_created")
    return logs.normalize_relational(session, project, workspace, message, part, texts=3)


@query("src_12_migrate_legacy_ids", f"""{MESSAGES}, e AS (SELECT CAST(session_id AS VARCHAR) AS source_path, msg_index + 2 AS line_no, session_id % 5 AS version, concat('i', msg_index) AS id, concat('p', msg_index) AS parent_id, CASE WHEN role = 'tool' THEN 'hookMessage' ELSE role END AS role FROM messages WHERE session_id % 5 <= 3)
  SELECT source_path, line_no, CASE WHEN version = 1 THEN printf('legacy-%08d', line_no - 2) ELSE id END AS id, CASE WHEN version <> 1 THEN parent_id WHEN line_no > 2 THEN printf('legacy-%08d', line_no - 3) END AS parent_id, CASE WHEN version < 3 AND role = 'hookMessage' THEN 'custom' ELSE role END AS role FROM e""")
def src_12(spark, sf):
    entries = T.event_messages(spark, sf).selectExpr("cast(session_id as string) as source_path", "msg_index + 2 as line_no", "session_id % 5 as version", "concat('i', msg_index) as id", "concat('p', msg_index) as parent_id", "if(role = 'tool', 'hookMessage', role) as role")
    return logs.migrate_legacy_ids(entries).select("source_path", "line_no", "id", "parent_id", "role")


@query("src_14_sidecar_titles", f"{MESSAGES} SELECT concat('s', session_id) AS session_id, arg_max(content, msg_index) AS title FROM messages WHERE msg_index % 17 <> 5 AND role <> 'system' GROUP BY 1")
def src_14(spark, sf):
    return logs.sidecar_titles(lines_of(T.event_messages(spark, sf), "to_json(named_struct('id', if(role = 'system', null, concat('s', session_id)), 'thread_name', content))"))


CHAT_SESSIONS = "chats AS (SELECT conv_id AS id, concat('a/b: ', conv_id) AS title, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CASE WHEN conv_id % 2 = 0 THEN 5 ELSE 0 END AS output_tokens FROM conversations GROUP BY 1)"


def chats(spark, sf):
    """Sessions and messages of the conversations."""
    rows = T.chat_messages(spark, sf).withColumn("tool_name", F.lit(None).cast("string"))
    made = rows.groupBy(F.col("session_id").alias("id")).agg(F.sum(F.char_length("content")).alias("input_tokens"))
    return made.selectExpr("id", "concat('a/b: ', id) as title", "input_tokens", "if(id % 2 = 0, 5L, 0L) as output_tokens"), rows


@query("snk_1_export_json", f"WITH {CHAT_SESSIONS}, b AS (SELECT conv_id AS id, count(*) AS messages, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS body FROM conversations GROUP BY 1) SELECT id, title, input_tokens, messages, body FROM chats JOIN b USING (id)")
def snk_1(spark, sf):
    docs = sinks.export_json(*chats(spark, sf))
    parsed = docs.select("id", F.from_json("doc", "meta struct<title: string, input_tokens: bigint>, messages array<struct<role: string, content: string>>").alias("d"))
    body = F.array_join(F.transform("d.messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return parsed.select("id", "d.meta.title", "d.meta.input_tokens", F.size("d.messages").cast("long").alias("messages"), F.md5(body).alias("body"))


_SHORT = "CASE WHEN {0} >= 1000000 THEN printf('%.1fM', {0} / 1e6) WHEN {0} >= 1000 THEN printf('%.1fk', {0} / 1e3) ELSE CAST({0} AS VARCHAR) END"
MARKDOWN = f"""{CHAT_SESSIONS}, parts AS (SELECT conv_id AS id, turn, concat('### ', role, chr(10), chr(10), CASE WHEN text[1:1] = '#' OR text[1:3] = '---' THEN concat('> ', replace(text, chr(10), chr(10) || '> ')) ELSE text END, chr(10), chr(10)) AS part FROM conversations WHERE trim(text) <> ''),
  bodies AS (SELECT id, string_agg(part, '' ORDER BY turn) AS body FROM parts GROUP BY 1),
  docs AS (SELECT id, title, concat('# ', title, chr(10), chr(10), CASE WHEN input_tokens + output_tokens > 0 THEN concat('| input | output | total |', chr(10), '|---|---|---|', chr(10), '| ', {_SHORT.format('input_tokens')}, ' | ', {_SHORT.format('output_tokens')}, ' | ', {_SHORT.format('(input_tokens + output_tokens)')}, ' |', chr(10), chr(10)) ELSE '' END, coalesce(body, '')) AS doc FROM chats LEFT JOIN bodies USING (id))"""


@query("snk_2_export_markdown", f"WITH {MARKDOWN} SELECT id, doc FROM docs")
def snk_2(spark, sf):
    return sinks.export_markdown(*chats(spark, sf))


@query("snk_3_export_batch", f"WITH {MARKDOWN} SELECT concat(replace(replace(title, '/', '_'), ':', '_'), '_', CAST(id AS VARCHAR)[1:8], '.md') AS file_name, md5(doc) AS doc FROM docs WHERE id IN (SELECT conv_id FROM conversations WHERE turn = 4)")
def snk_3(spark, sf):
    sessions, rows = chats(spark, sf)
    chosen = rows.where("msg_index = 4").select(F.col("session_id").alias("id")).distinct()
    return sinks.export_batch(sinks.export_markdown(sessions, rows), sessions, chosen, "md").withColumn("doc", F.md5("doc"))


@query("snk_3_export_files", f"WITH {MARKDOWN} SELECT id, concat(replace(replace(title, '/', '_'), ':', '_'), '_', CAST(id AS VARCHAR)[1:8], '.md') AS file_name, md5(doc) AS doc, CAST(strlen(doc) AS BIGINT) AS bytes FROM docs")
def snk_3_files(spark, sf):
    """Every session as a file, a message at a time, read back."""
    sessions, rows = chats(spark, sf)
    folder = kept.shared_folder(spark, "exports")
    written = sinks.export_files(sinks.markdown_pieces(sessions, rows), sessions, folder, "md")
    docs = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("name"), F.md5("value").alias("doc"))
    return written.join(docs, F.col("file_name") == F.replace("name", F.lit("%20"), F.lit(" "))).select(F.col("id").cast("long").alias("id"), "file_name", "doc", "bytes")


@query("snk_5_write_tables", f"{U.FACTS} SELECT session_id, bucket, model, turn_count, strftime(to_timestamp(bucket) AT TIME ZONE 'UTC', '%Y-%m') AS bucket_month FROM stats")
def snk_5(spark, sf):
    """All facts by month, then one month's again, which takes the place of that month only."""
    stats, folder = U.facts(spark, sf).select("session_id", "bucket", "model", "turn_count"), kept.shared_folder(spark, "tables")
    month = F.date_format(F.timestamp_seconds("bucket"), "yyyy-MM")
    sinks.write_tables(stats, folder, month.alias("bucket_month"))
    sinks.write_tables(stats.where(F.col("bucket") < 694224000), folder, month.alias("bucket_month"))
    return spark.read.schema("session_id long, bucket long, model string, turn_count long, bucket_month string").parquet(folder)


@query("snk_5_refresh_facts", f"{U.FACTS} SELECT session_id, bucket, model, turn_count, input_tokens FROM stats WHERE session_id % 11 <> 4")
def snk_5_refresh(spark, sf):
    """Facts of which some sessions were missing, some were others and some are gone after a refresh."""
    events = T.usage_events(spark, sf)
    before = events.where("session_id % 7 <> 2").withColumn("input_tokens", F.expr("if(session_id % 5 = 1, input_tokens + 1, input_tokens)")).withColumn("ts", F.expr("if(session_id % 5 = 1, replace(ts, '1995', '1996'), ts)"))
    changed = "session_id % 7 = 2 or session_id % 5 = 1 or session_id % 11 = 4"
    first = usage.token_stats(before, T.prices(spark))
    table = FactTable(spark, kept.shared_folder(spark, "facts"), first.schema)
    table.refresh(0, first)
    table.refresh(1, usage.token_stats(events.where(f"({changed}) and session_id % 11 <> 4"), T.prices(spark)), events.where(changed).select("session_id"))
    return table.read().select("session_id", "bucket", "model", "turn_count", "input_tokens")


@query("exp_4_day_range", f"{U.BASE} SELECT provider, count(*) AS facts FROM base WHERE bucket >= {U.midnight('1996-04-07')} AND bucket < {U.midnight('1997-04-07')} GROUP BY 1")
def exp_4(spark, sf):
    """The bounds are days on which the zone's clocks change."""
    bounds = times.day_range_epochs("1996-04-07", "1997-04-06", U.TZ)
    return reports.bounded(U.base(spark, sf), None, *bounds).groupBy("provider").agg(F.count("*").alias("facts"))


_RANGES = """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN '1969-12-31' WHEN l_partkey % 5 = 0 THEN '1995-2-03' ELSE {date}(l_shipdate) END AS a,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 7 = 0 THEN '2023-02-29' ELSE '1995-06-17' END AS b FROM {lineitem}"""


@query("exp_5_range_problem", f"""WITH r AS ({_RANGES.format(date="strftime('%Y-%m-%d', ", lineitem="lineitem").replace(", (l_shipdate)", ", l_shipdate)")}) SELECT CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL OR b IS NULL THEN 'half' WHEN a IN ('1969-12-31', '1995-2-03') OR b = '2023-02-29' THEN 'no date' WHEN a > b THEN 'order' END AS problem, count(*) AS n FROM r GROUP BY 1""")
def exp_5(spark, sf):
    rows = T.read(spark, sf, "lineitem").selectExpr(
        "case when l_partkey % 11 = 0 then null when l_partkey % 7 = 0 then '1969-12-31' when l_partkey % 5 = 0 then '1995-2-03' else date_format(l_shipdate, 'yyyy-MM-dd') end as a",
        "case when l_suppkey % 11 = 0 then null when l_suppkey % 7 = 0 then '2023-02-29' else '1995-06-17' end as b",
    )
    return rows.groupBy(times.range_problem("a", "b").alias("problem")).agg(F.count("*").alias("n"))


@query("exp_6_preset_range", f"{U.BASE} SELECT {U.DAY} AS date, count(DISTINCT session_id) AS sessions FROM base WHERE bucket >= {U.midnight('1996-01-02')} AND bucket < {U.midnight('1996-03-02')} GROUP BY 1")
def exp_6(spark, sf):
    bounds = times.resolve_bounds(U.TZ, datetime.date(1996, 3, 1), days=60)
    return reports.activity_daily(reports.bounded(U.base(spark, sf), None, *bounds), U.TZ).select("date", "sessions")


ZONES = ("UTC", "Asia/Kolkata", "Pacific/Apia", "Nowhere/Land")


@query("exp_8_resolve_timezone", f"{U.FACTS} " + " UNION ALL ".join(f"SELECT '{z}' AS zone, CAST(CAST(to_timestamp(bucket) AT TIME ZONE '{z}' AS DATE) AS VARCHAR) AS date, count(*) AS facts FROM stats GROUP BY 2" for z in ZONES[:3]))
def exp_8(spark, sf):
    """Facts by local day in each zone that exists."""
    out = None
    for zone in ZONES:
        try:
            times.resolve_timezone(zone)
        except Exception:  # an unknown zone is refused before planning
            continue
        rows = U.facts(spark, sf).groupBy(times.civil_date("bucket", zone).alias("date")).agg(F.count("*").alias("facts")).withColumn("zone", F.lit(zone))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("agg_28_calendar_window", f"{U.BASE}, d AS (SELECT {U.DAY} AS date, turn_count FROM base) SELECT kind, date, CAST(sum(turn_count) AS BIGINT) AS turns FROM d JOIN (VALUES ('past', '1996-01-01', '1996-12-31'), ('this', '1998-01-01', '1998-08-05'), ('trailing', '1997-08-06', '1998-08-05')) w(kind, a, b) ON date BETWEEN a AND b GROUP BY 1, 2")
def agg_28(spark, sf):
    days = U.base(spark, sf).select(times.civil_date("bucket", U.TZ).alias("date"), "turn_count").groupBy("date").agg(F.sum("turn_count").alias("turns"))
    out = None
    for kind, year in (("past", 1996), ("this", 1998), ("trailing", None)):
        first, last = times.calendar_window(year, datetime.date(1998, 8, 5))
        rows = days.where(F.col("date").between(first, last)).select(F.lit(kind).alias("kind"), "date", "turns")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("cat_9_delete_guard", f"WITH {T.SESSIONS_SQL}, c AS (SELECT project_path, provider, count(*) FILTER (id % 10 < 2 + length(provider)) AS alive, count(*) AS stored FROM sessions GROUP BY 1, 2) SELECT *, alive > 0 AND (stored <= 10 OR alive / stored > 0.5) AS allowed FROM c")
def cat_9(spark, sf):
    counts = T.sessions(spark, sf).groupBy("project_path", "provider").agg(F.count_if(F.col("id") % 10 < 2 + F.length("provider")).alias("alive"), F.count("*").alias("stored"))
    return catalog.guarded(counts)


_Q = "the an"
_FOLDED = f"WITH {T.DOCS_SQL}, folded AS (SELECT *, translate(coalesce(title, ''), '{search.UPPER}', '{search.LOWER}') AS t, translate(coalesce(content_text, ''), '{search.UPPER}', '{search.LOWER}') AS c, translate(coalesce(project_name, ''), '{search.UPPER}', '{search.LOWER}') AS p FROM docs)"


_NEW_TITLE = "CASE WHEN id % 4 = 0 THEN reverse(t) ELSE t END"


def _index(spark, sf, fields=search.FIELDS):
    """An index over the documents whose titles, of a quarter, were another when it was built, and which was refreshed since; the documents as they are."""
    docs = T.search_docs(spark, sf)
    index = postings.PostingIndex(spark, kept.shared_folder(spark, "postings"), fields, most_layers=2)
    index.build(docs)
    now = docs.withColumn("title", F.expr("if(id % 4 = 0, reverse(title), title)"))
    for k in range(3):
        index.refresh(now, docs.where(f"id % 4 = 0 and id % 3 = {k}").select("id"))
    return index, now


@query("srch_2_indexed_search", f"{_FOLDED} SELECT id, {_NEW_TITLE.replace('t)', 'title)').replace('ELSE t', 'ELSE title')} AS title FROM folded WHERE contains({_NEW_TITLE}, '{_Q}') OR contains(c, '{_Q}') OR contains(p, '{_Q}')")
def srch_2_indexed(spark, sf):
    index, docs = _index(spark, sf)
    return index.search(docs, _Q).select("id", "title")


@query("cat_8_changed_postings", f"{_FOLDED}, g AS (SELECT id, 'title' AS field, {_NEW_TITLE} AS x FROM folded UNION ALL SELECT id, 'project_name', p FROM folded) SELECT DISTINCT substr(x, CAST(i AS INTEGER), 3) AS trigram, id, field FROM (SELECT id, field, x, unnest(range(1, length(x) - 1)) AS i FROM g WHERE length(x) >= 3)")
def cat_8_postings(spark, sf):
    """The postings after the titles of some rows have changed, through layers and a merge of them."""
    return _index(spark, sf, ("title", "project_name"))[0].postings()


def streamed(spark, frame, job, mode="append", name="stream", state=None):
    """What a streaming job makes of the rows of a frame, which come as files of a folder. It is started under `state`, if that is given."""
    folder = kept.shared_folder(spark, name)
    frame.write.parquet(f"{folder}/in")
    made = job(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in"))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else number}")

    with state or contextlib.nullcontext():
        query = made.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def stream_events(spark, sf):
    return usage.valid_usage(T.usage_events(spark, sf)).selectExpr("session_id", "cast(seq as long) as seq", "cast(ts as timestamp) as ts", "model", *usage.COUNTERS, "turn_count", "if(seq % 5 = 4, null, usage_hash) as usage_hash")


STREAM = f"WITH {T.EVENTS_SQL}, ev AS (SELECT *, epoch(CAST(ts AS TIMESTAMPTZ)) AS sec, CASE WHEN seq % 5 = 4 THEN NULL ELSE usage_hash END AS h FROM usage_events WHERE ts IS NOT NULL AND model <> '' AND model <> '<synthetic>')"


#: Rows arrive in slices of 800 days, up to 50 days behind their time.
SLICE = "CAST(floor((floor(sec / 86400) + (session_id * 7 + seq * 13) % 50) / 800) AS BIGINT)"
DELAY_DAYS = 30
ARRIVED = f"""arrived AS (SELECT *, {SLICE} AS slice FROM ev), newest AS (SELECT slice, max(sec) AS sec FROM arrived GROUP BY slice),
  marks AS (SELECT slice, max(sec) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY_DAYS * 86400} AS mark FROM newest),
  told AS (SELECT a.*, coalesce(floor(a.sec / 900) * 900 + 900 <= mark, false) AS late FROM arrived a JOIN marks USING (slice))"""


def arrivals(spark, rows, folder, start, unit=86400, behind=50, length=800):
    """Feeds rows with ts, session_id and seq slice by slice, of `length` units of so many seconds, to a query that start(folder of files) makes, until it has read each. Rows come up to `behind` units after their time."""
    sliced = f"{folder}/sliced"
    rows.withColumn("slice", F.expr(f"cast(floor((floor(unix_seconds(ts) / {unit}) + (session_id * 7 + seq * 13) % {behind}) / {length}) as bigint)")).write.partitionBy("slice").parquet(sliced)
    for k in sorted(r.slice for r in spark.read.parquet(sliced).select("slice").distinct().collect()):
        spark.read.schema(rows.schema).parquet(f"{sliced}/slice={k}").write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).awaitTermination()


def to_files(frame, folder):
    """Starts a streaming frame that writes each batch's result to `folder`/out."""

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return frame.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


@query("st_1_stream_usage", f"""{STREAM}, {ARRIVED} SELECT session_id, CAST(floor(sec / 900) * 900 AS BIGINT) AS bucket, model, count(*) AS turn_count, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in usage.COUNTERS)} FROM told
  WHERE NOT late AND floor(sec / 900) * 900 + 900 <= (SELECT max(sec) - {DELAY_DAYS * 86400} FROM arrived) GROUP BY 1, 2, 3""")
def st_1(spark, sf):
    """Windows that the watermark has closed, of the rows that weren't late."""
    folder, rows = kept.shared_folder(spark, "usage"), stream_events(spark, sf)
    arrivals(spark, rows, folder, lambda s: to_files(jobs.stream_usage(s, f"{DELAY_DAYS} days"), folder))
    schema = jobs.stream_usage(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "1 day").schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


@query("st_2_stream_dedup", f"{STREAM} SELECT session_id, h AS usage_hash, CASE WHEN h IS NULL THEN count(*) ELSE 1 END AS n FROM ev GROUP BY 1, 2")
def st_2(spark, sf):
    """Nothing leaves the state here, so it grows with the table and is kept on disk. Columns that the result hasn't are not written for the stream."""
    rows = streamed(spark, stream_events(spark, sf).select("session_id", "ts", "usage_hash"), lambda s: jobs.stream_dedup(s, LATE), state=jobs.disk_state(spark))
    return rows.groupBy("session_id", "usage_hash").agg(F.count("*").alias("n"))


@query("st_3_stream_delta", f"""{STREAM}, e AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY sec, seq) AS seq, input_tokens FROM ev),
  t AS (SELECT session_id, seq, CASE WHEN seq % 3 = 0 THEN NULL ELSE sum(CASE WHEN seq % 4 = 0 THEN -input_tokens ELSE input_tokens END) OVER (PARTITION BY session_id ORDER BY seq) END AS total, CASE WHEN seq % 5 = 1 THEN input_tokens END AS own FROM e),
  s AS (SELECT *, coalesce(last_value(total IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM t) SELECT session_id, seq, CAST(coalesce(own, greatest(0, total - seen)) AS BIGINT) AS input_tokens FROM s""")
def st_3(spark, sf):
    """A session's rows come out of order in several slices; one much newer row at the end lets the last go."""
    total = "if(seq % 3 = 0, null, sum(if(seq % 4 = 0, -input_tokens, input_tokens)) over (partition by session_id order by seq)) as total_input_tokens"
    rows = stream_events(spark, sf).withColumn("seq", F.expr("cast(row_number() over (partition by session_id order by ts, seq) as long)"))
    rows = rows.selectExpr("session_id", "seq", "ts", total, "if(seq % 5 = 1, input_tokens, null) as last_input_tokens")
    end = rows.agg(F.max("ts").alias("ts")).selectExpr("-1L as session_id", "1L as seq", "ts + interval 1000 days as ts", "0L as total_input_tokens", "null as last_input_tokens")
    folder = kept.shared_folder(spark, "deltas")
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        arrivals(spark, rows.unionByName(end), folder, lambda s: to_files(deltas.stream_delta(s, late="60 days", idle="3000 days"), folder))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    return spark.read.schema("session_id long, seq long, input_tokens long").option("recursiveFileLookup", "true").parquet(f"{folder}/out").where("session_id >= 0")


@query("st_4_activity_bursts", f"""{MESSAGES}, g AS (SELECT session_id, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms) < 18000000 THEN 0 ELSE 1 END AS fresh FROM messages),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT session_id, min(ts_ms) AS start_ms, max(ts_ms) + 18000000 AS end_ms, count(*) AS messages FROM r GROUP BY session_id, run""")
def st_4(spark, sf):
    """Messages come up to a day late, two days are waited for, and one much newer message at the end lets the last bursts go."""
    rows = T.event_messages(spark, sf).selectExpr("session_id", "timestamp_millis(ts_ms) as ts", "cast(msg_index as long) as seq")
    end = rows.agg(F.max("ts").alias("ts")).selectExpr("-1L as session_id", "ts + interval 100 days as ts", "0L as seq")
    folder = kept.shared_folder(spark, "bursts")
    arrivals(spark, rows.unionByName(end), folder, lambda s: to_files(jobs.activity_bursts(s, "5 hours", "2 days"), folder), 3600, 24, 192)
    bursts = spark.read.schema("session_id long, start timestamp, end timestamp, messages long").option("recursiveFileLookup", "true").parquet(f"{folder}/out").where("session_id >= 0")
    return bursts.select("session_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "messages")


def _merged(old: str, new: str) -> str:
    """SQL for the rows of `new` merged into those of `old`."""
    return f"""SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.provider ELSE n.provider END AS provider, CASE WHEN n.id IS NULL OR o.title_custom THEN o.title ELSE n.title END AS title,
    coalesce(o.title_custom, false) OR coalesce(n.title_custom, false) AS title_custom, CASE WHEN n.id IS NULL THEN o.content_text ELSE n.content_text END AS content_text,
    CASE WHEN n.id IS NULL OR coalesce(n.project_path, '') = '' THEN o.project_path ELSE n.project_path END AS project_path,
    CASE WHEN n.id IS NULL THEN o.project_name WHEN coalesce(n.project_name, '') IN ('', 'Unknown Project') THEN coalesce(o.project_name, n.project_name) ELSE n.project_name END AS project_name,
    CASE WHEN n.id IS NULL THEN o.is_sidechain WHEN n.provider = 'low' THEN n.is_sidechain ELSE coalesce(o.is_sidechain, false) OR n.is_sidechain END AS is_sidechain,
    CASE WHEN n.id IS NULL THEN o.parent_id WHEN n.provider = 'low' THEN n.parent_id ELSE coalesce(n.parent_id, o.parent_id) END AS parent_id,
    n.id IS NOT NULL AND NOT (o.id IS NOT NULL AND o.title = n.title AND o.content_text = n.content_text AND o.project_name = n.project_name) AS changed FROM {old} o FULL JOIN {new} n ON o.id = n.id"""


#: Sessions as three passes of a scan find them: which, and what differs in them.
PASSES = (
    ("id % 3 <> 0", {"title_custom": "id % 4 = 0"}),
    ("id % 5 <> 1", {"title": "concat(title, CASE WHEN id % 2 = 0 THEN ' new' ELSE '' END)", "project_path": "CASE WHEN id % 5 = 0 THEN '' ELSE concat(project_path, 'x') END", "project_name": "CASE WHEN id % 7 = 0 THEN 'Unknown Project' ELSE project_name END", "is_sidechain": "id % 11 = 0", "parent_id": "CASE WHEN id % 2 = 0 THEN parent_id END"}),
    ("id % 2 = 0", {"title": "concat(title, ' third')", "content_text": "CASE WHEN id % 4 = 0 THEN content_text ELSE concat(content_text, '!') END", "project_path": "CASE WHEN id % 6 = 0 THEN NULL ELSE project_path END", "project_name": "CASE WHEN id % 10 = 0 THEN '' ELSE concat(project_name, 'z') END", "is_sidechain": "false", "parent_id": "CASE WHEN id % 8 = 0 THEN id + 1 END"}),
)
_MERGE_COLUMNS = ("id", "provider", "title", "title_custom", "content_text", "project_path", "project_name", "is_sidechain", "parent_id")


def _pass(k: int) -> list[str]:
    own = {"title_custom": "false"} | PASSES[k][1]
    return [f"{own[c]} AS {c}" if c in own else c for c in _MERGE_COLUMNS]


@query("st_5_stream_merge", f"WITH {T.SESSIONS_SQL}, " + ", ".join(f"w{k} AS (SELECT {', '.join(_pass(k))} FROM sessions WHERE {PASSES[k][0]})" for k in range(3)) + f", m1 AS ({_merged('w0', 'w1')}), m2 AS ({_merged('m1', 'w2')}) SELECT id, title, title_custom, content_text, project_path, project_name, is_sidechain, parent_id, changed FROM m2")
def st_5(spark, sf):
    """Three batches of sessions merged by id. The second has each session twice, and is merged once more after it was."""
    folder, sessions = kept.shared_folder(spark, "merge"), T.sessions(spark, sf)
    for k in range(3):
        rows = sessions.where(PASSES[k][0]).selectExpr(*_pass(k), "1L as version")
        if k == 1:
            rows = rows.unionByName(rows.withColumns({"version": F.lit(0).cast("long"), "title": F.lit("old")}))
        rows.write.mode("append").parquet(f"{folder}/in")
        again = lambda table, number: merge.merge_batch(table, rows.withColumn("title", F.lit("again")), 1, ["version"], "low") if number else None  # noqa: B023, E731
        merge.stream_merge(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", ["version"], "low", after=again).awaitTermination()
    # Parts without a row in the last batch can't be: each has some ids that it changed.
    last = merge.sessions_table(rows, f"{folder}/out")
    return last.read().select("id", "title", "title_custom", "content_text", "project_path", "project_name", "is_sidechain", "parent_id", "changed")


def put_logs(lines, folder: str) -> None:
    """Lines (log, line_no, raw) as one file for each log, in place of the file that was there."""
    lines = lines.select(F.col("log").cast("string").alias("log"), "line_no", "raw").repartition("log").sortWithinPartitions("log", "line_no")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root)
        out, own = None, None
        for batch in batches:
            for log, raw in zip(batch.column("log").to_pylist(), batch.column("raw").to_pylist()):
                if log != own:
                    if out:
                        out.close()
                        files.move(f"{root}/.{own}.part", f"{root}/log={own}.jsonl")
                    own, out = log, files.open_output_stream(f"{root}/.{log}.part")
                out.write(raw.encode() + b"\n")
        if out:
            out.close()
            files.move(f"{root}/.{own}.part", f"{root}/log={own}.jsonl")
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.string())], names=["log"])

    lines.mapInArrow(write, "log string").write.format("noop").mode("overwrite").save()


#: Of each log three fifths are there at first; then it grows, and every fifth log is written anew.
GROWN = f"""{EVENT_LINES}, counted AS (SELECT *, count(*) OVER (PARTITION BY log) AS n FROM made),
  read AS (SELECT log, line_no, 1 AS pass FROM counted WHERE NOT blank AND line_no <= n * 3 // 5 UNION ALL SELECT log, line_no, 2 FROM counted WHERE NOT blank AND (line_no > n * 3 // 5 OR log % 5 = 2))"""


def grown_logs(spark, sf):
    lines = event_lines(spark, sf).withColumn("n", F.expr("count(*) over (partition by log)"))
    return lines.where("line_no <= floor(n * 3 / 5)"), lines.withColumn("raw", F.expr("if(log % 5 = 2 and raw <> ' ', concat('x', raw), raw)"))


@query("st_6_changed_lines", f"{GROWN} SELECT log, line_no, pass FROM read")
def st_6(spark, sf):
    """Three passes over the logs; the last finds nothing new."""
    folder, fmt = kept.shared_folder(spark, "grown"), logs.LogFormat("agent")
    known, out = None, None
    for k, lines in enumerate([*grown_logs(spark, sf), None], start=1):
        if lines is not None:
            put_logs(lines, f"{folder}/in")
        new, known = ranges.grown_lines(spark, f"{folder}/in", fmt, f"{folder}/pass={k}", known)
        new = new.select(log_number(), "line_no", F.lit(k).alias("pass"))
        out = new if out is None else out.unionByName(new)
    return out


@query("st_6_growing_source", f"{GROWN} SELECT log, pass, count(*) AS lines FROM read GROUP BY 1, 2")
def st_6_source(spark, sf):
    """The same logs as a streaming source, a batch for each state of them."""
    folder = kept.shared_folder(spark, "source")
    spark.dataSource.register(ranges.GrowingLogs)
    for k, lines in enumerate(grown_logs(spark, sf), start=1):
        put_logs(lines, f"{folder}/in")
        stream = spark.readStream.format("growing_logs").option("path", f"{folder}/in").load().select("source_path", "at", "raw", F.lit(k).alias("pass"))
        to_files(stream, folder).awaitTermination()
    rows = spark.read.schema("source_path string, at long, raw string, pass int").option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return rows.where(F.trim("raw") != "").groupBy(log_number(), "pass").agg(F.count("*").alias("lines"))


@query("st_7_late_rows", f"{STREAM}, {ARRIVED} SELECT session_id, model, late, count(*) AS n FROM told GROUP BY 1, 2, 3")
def st_7(spark, sf):
    """Rows in time and late ones, by session and model."""
    folder, rows = kept.shared_folder(spark, "late"), stream_events(spark, sf)
    arrivals(spark, rows, folder, lambda s: late.split_late(s, f"{folder}/split", f"{folder}/state", late.window_end(), f"{DELAY_DAYS} days"))
    both = [late.split_rows(spark, f"{folder}/split", "session_id long, model string", x).withColumn("late", F.lit(x)) for x in (True, False)]
    return both[0].unionByName(both[1]).groupBy("session_id", "model", "late").agg(F.count("*").alias("n"))
