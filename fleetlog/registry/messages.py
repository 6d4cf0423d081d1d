"""Queries over messages of a session, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import order
from ..sources import tables as T

QUERIES, ORACLES = {}, {}
SQUEEZE = 100
EVENTS = f"WITH {T.event_messages_sql()}"
SQUEEZED = f"WITH {T.event_messages_sql(SQUEEZE)}"
CHAT = f"WITH {T.CHAT_SQL}"
TOTAL = "(input_tokens + output_tokens + cache_read_tokens + cache_write_tokens)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("win_11_merge_tool_runs", f"""{EVENTS}, r AS (SELECT *, role = 'tool' AS t, row_number() OVER (PARTITION BY session_id ORDER BY msg_index) - row_number() OVER (PARTITION BY session_id, role = 'tool' ORDER BY msg_index) AS island FROM messages)
  SELECT session_id, min(msg_index) AS first_index, count(*) AS n, CASE WHEN NOT t THEN 'message' WHEN count(*) > 1 THEN 'merged_tools' ELSE 'tool' END AS kind, max(ts_ms) AS last_ts FROM r GROUP BY session_id, t, island, CASE WHEN t THEN -1 ELSE msg_index END""")
def win_11(spark, sf):
    return order.merge_tool_runs(T.event_messages(spark, sf))


@query("win_12_time_separators", f"{SQUEEZED}, g AS (SELECT session_id, msg_index, role, ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY msg_index) AS gap_ms FROM messages) SELECT session_id, msg_index, gap_ms FROM g WHERE gap_ms > 300000 AND role <> 'tool'")
def win_12(spark, sf):
    return order.time_separators(T.event_messages(spark, sf, SQUEEZE))


PREVIEW = r"substr(trim(regexp_replace(substr(content, 1, 960), '[ \t\n\r]+', ' ', 'g')), 1, 240)"
BLANK = r"trim(regexp_replace(coalesce(content, ''), '[ \t\n\r]+', ' ', 'g')) <> ''"


@query("win_14_turn_outline", f"""{CHAT}, s AS (SELECT *, role = 'user' AND {BLANK} AS st, role = 'assistant' AND {BLANK} AS rp FROM messages), t AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY msg_index) - 1 AS ordinal FROM s)
  SELECT session_id, CAST(ordinal AS BIGINT) AS ordinal, min(msg_index) FILTER (st) AS msg_index, arg_min({PREVIEW}, msg_index) FILTER (st) AS prompt, arg_min({PREVIEW}, msg_index) FILTER (rp) AS reply FROM t WHERE ordinal >= 0 GROUP BY 1, 2""")
def win_14(spark, sf):
    return order.turn_outline(T.chat_messages(spark, sf))


@query("win_15_session_window", f"{CHAT}, n AS (SELECT session_id, msg_index, row_number() OVER (PARTITION BY session_id ORDER BY msg_index) - 1 AS p, count(*) OVER (PARTITION BY session_id) AS c FROM messages) SELECT session_id, msg_index FROM n WHERE p >= greatest(0, c - 3) AND p < greatest(0, c - 3) + 2")
def win_15(spark, sf):
    return order.session_window(T.chat_messages(spark, sf), -3, 2).select("session_id", "msg_index")


TIMELINE = f"""t AS (SELECT session_id, msg_index, row_number() OVER w - 1 AS position, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, {TOTAL} AS total, CAST(sum({TOTAL}) OVER w AS BIGINT) AS cumulative
  FROM messages WHERE input_tokens IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY msg_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("win_16_token_timeline", f"{EVENTS}, {TIMELINE} SELECT * REPLACE (CAST(position AS INTEGER) AS position, CAST(cache_write_tokens AS BIGINT) AS cache_write_tokens) FROM t")
def win_16(spark, sf):
    """Sessions are cut at 30 rows, so that most are."""
    return order.token_timeline(T.event_messages(spark, sf), segment_rows=30)


@query("win_17_token_buckets", f"""{EVENTS}, {TIMELINE}, b AS (SELECT *, position // greatest(1, CAST(ceil(count(*) OVER (PARTITION BY session_id) / 10.0) AS BIGINT)) AS bucket FROM t)
  SELECT session_id, bucket, count(*) AS points, CAST(sum(total) AS BIGINT) AS total, arg_max(cumulative, position) AS cumulative FROM b GROUP BY 1, 2""")
def win_17(spark, sf):
    return order.token_buckets(order.token_timeline(T.event_messages(spark, sf)), 10)


@query("win_18_peak_point", f"{EVENTS}, {TIMELINE} SELECT session_id, msg_index, total FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY total DESC, position) = 1")
def win_18(spark, sf):
    return order.peak_point(order.token_timeline(T.event_messages(spark, sf)))


@query("win_19_match_locations", f"{CHAT}, h AS (SELECT session_id, msg_index, (length(lower(content)) - length(replace(lower(content), 'the', ''))) // 3 AS n FROM messages WHERE role IN ('user', 'assistant')) SELECT session_id, msg_index, CAST(unnest(range(n)) AS INTEGER) AS nth FROM h WHERE n > 0")
def win_19(spark, sf):
    return order.match_locations(T.chat_messages(spark, sf), "The")


@query("win_4_mode_changes", f"{EVENTS}, m AS (SELECT session_id, msg_index, CASE WHEN msg_index % 3 = 0 THEN NULL WHEN cache_read_tokens > 50 THEN 'plan' ELSE 'normal' END AS mode FROM messages), l AS (SELECT *, lag(mode, 1, 'normal') OVER (PARTITION BY session_id ORDER BY msg_index) AS was FROM m WHERE mode IS NOT NULL) SELECT session_id, msg_index, mode FROM l WHERE mode <> was")
def win_4(spark, sf):
    rows = T.event_messages(spark, sf).withColumn("mode", F.expr("case when msg_index % 3 = 0 then null when cache_read_tokens > 50 then 'plan' else 'normal' end"))
    return order.mode_changes(rows).select("session_id", "msg_index", "mode")


@query("win_1_dedup_replayed_lines", "SELECT l_orderkey AS source_path, min(line_no) AS line_no, k1, k2 FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS line_no, CASE WHEN l_partkey % 5 <> 0 THEN l_returnflag END AS k1, l_linenumber AS k2 FROM lineitem) GROUP BY l_orderkey, k1, k2, CASE WHEN k1 IS NULL THEN line_no END")
def win_1(spark, sf):
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    rows = T.read(spark, sf, "lineitem").withColumn("line_no", seq.cast("long")).selectExpr("l_orderkey as source_path", "line_no", "if(l_partkey % 5 <> 0, l_returnflag, null) as k1", "l_linenumber as k2")
    return order.dedup_replayed_lines(rows, ["k1", "k2"])


LINES = """lines AS (SELECT user_id AS session_id, event_id AS line_no, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('/w/', event_id % 9) END AS cwd, CASE WHEN event_id % 3 = 0 THEN concat('v', event_id % 5) END AS version, CASE WHEN event_id % 5 = 0 THEN concat('m', event_id % 7) ELSE '' END AS model,
  CASE event_id % 6 WHEN 0 THEN 'HEAD' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE concat('b', event_id % 6) END AS git_branch, event_type = 'error' AS is_sidechain, CASE WHEN event_id % 2 = 0 THEN event_id * 10 END AS ts FROM events)"""


def first_of(c: str, unless: str = "") -> str:
    return f"arg_min({c}, line_no) FILTER ({c} <> '' AND {c} <> '{unless}') AS {c}"


@query("win_2_session_attributes", f"WITH {LINES} SELECT session_id, {first_of('cwd')}, {first_of('version')}, {first_of('model')}, {first_of('git_branch', 'HEAD')}, bool_or(is_sidechain) AS is_sidechain, arg_min(ts, line_no) FILTER (ts IS NOT NULL) AS first_ts, arg_max(ts, line_no) FILTER (ts IS NOT NULL) AS last_ts FROM lines GROUP BY 1")
def win_2(spark, sf):
    rows = T.read(spark, sf, "events").selectExpr(
        "user_id as session_id", "event_id as line_no", "if(event_id % 4 = 0, '', concat('/w/', event_id % 9)) as cwd", "if(event_id % 3 = 0, concat('v', event_id % 5), null) as version", "if(event_id % 5 = 0, concat('m', event_id % 7), '') as model",
        "case event_id % 6 when 0 then 'HEAD' when 1 then '' when 2 then null else concat('b', event_id % 6) end as git_branch", "event_type = 'error' as is_sidechain", "if(event_id % 2 = 0, event_id * 10, null) as ts")
    return order.session_attributes(rows)


@query("win_3_resolve_title", """WITH l AS (SELECT user_id AS session_id, event_id AS line_no, CASE event_type WHEN 'signup' THEN 'custom-title' WHEN 'error' THEN 'ai-title' WHEN 'click' THEN 'user' WHEN 'view' THEN 'summary' ELSE 'agent-name' END AS type, CASE WHEN user_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '' ELSE concat(event_type, event_id) END AS value FROM events)
  SELECT session_id, coalesce(arg_max(value, line_no) FILTER (type = 'custom-title' AND value <> ''), arg_max(value, line_no) FILTER (type = 'ai-title' AND value <> ''), arg_max(value, line_no) FILTER (type = 'agent-name' AND value <> ''), arg_min(value, line_no) FILTER (type = 'user' AND value <> ''), arg_min(value, line_no) FILTER (type = 'summary' AND value <> ''), 'Untitled') AS title FROM l GROUP BY 1""")
def win_3(spark, sf):
    rows = T.read(spark, sf, "events").selectExpr(
        "user_id as session_id", "event_id as line_no", "case event_type when 'signup' then 'custom-title' when 'error' then 'ai-title' when 'click' then 'user' when 'view' then 'summary' else 'agent-name' end as type", "case when user_id % 5 = 0 then null when event_id % 3 = 0 then '' else concat(event_type, event_id) end as value")
    return order.resolve_title(rows)


@query("win_5_attach_turn_usage", f"""{EVENTS}, t AS (SELECT session_id, msg_index, CASE WHEN session_id % 10 = 0 THEN 'system' ELSE role END AS role, input_tokens, msg_index // 4 AS turn FROM messages), u AS (SELECT session_id, turn, max(input_tokens) AS input_tokens, max(msg_index) FILTER (role <> 'system') AS place, max(msg_index) AS last_one FROM t GROUP BY 1, 2)
  SELECT t.session_id, t.turn, CAST(t.msg_index AS DOUBLE) AS msg_index, t.role, CASE WHEN t.msg_index = u.place THEN u.input_tokens END AS input_tokens FROM t JOIN u USING (session_id, turn) UNION ALL SELECT session_id, turn, last_one + 0.5, 'assistant', input_tokens FROM u WHERE place IS NULL AND input_tokens IS NOT NULL""")
def win_5(spark, sf):
    rows = T.event_messages(spark, sf).withColumn("turn", F.expr("msg_index div 4")).withColumn("role", F.expr("if(session_id % 10 = 0, 'system', role)"))
    return order.attach_turn_usage(rows).select("session_id", "turn", "msg_index", "role", "input_tokens")


@query("win_8_rollback_cancelled", f"""{EVENTS}, t AS (SELECT session_id, msg_index, CASE role WHEN 'user' THEN 'turn.prompt' WHEN 'system' THEN CASE WHEN msg_index % 3 = 0 THEN 'turn.cancel' ELSE 'usage.record' END ELSE 'context.append' END AS type FROM messages), n AS (SELECT *, sum(CASE WHEN type = 'turn.prompt' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY msg_index) AS turn FROM t),
  c AS (SELECT *, max(msg_index) FILTER (type = 'turn.cancel') OVER (PARTITION BY session_id, turn) AS cancel FROM n) SELECT session_id, msg_index, type FROM c WHERE NOT coalesce(turn > 0 AND msg_index <= cancel AND type <> 'usage.record', false)""")
def win_8(spark, sf):
    rows = T.event_messages(spark, sf).selectExpr("session_id", "msg_index", "case role when 'user' then 'turn.prompt' when 'system' then if(msg_index % 3 = 0, 'turn.cancel', 'usage.record') else 'context.append' end as type")
    return order.rollback_cancelled_turns(rows)


@query("win_10_splice_compaction", f"""{EVENTS}, r AS (SELECT session_id, concat('summary ', msg_index) AS content, msg_index AS lo, msg_index + 3 AS hi FROM messages WHERE msg_index % 20 = 5), s AS (SELECT session_id, content, unnest(range(lo, hi)) AS msg_index FROM r), e AS (SELECT session_id, max(msg_index) AS m FROM messages GROUP BY 1)
  SELECT session_id, CAST(msg_index AS DOUBLE) AS place, content FROM messages ANTI JOIN s USING (session_id, msg_index) UNION ALL SELECT session_id, CAST(coalesce(min(m2.msg_index), max(e.m) + 0.5, 0) AS DOUBLE), s.content FROM s LEFT JOIN messages m2 USING (session_id, msg_index) LEFT JOIN e USING (session_id) GROUP BY session_id, s.content""")
def win_10(spark, sf):
    rows = T.event_messages(spark, sf).select("session_id", "msg_index", "content")
    made = rows.where("msg_index % 20 = 5").selectExpr("session_id", "concat('summary ', msg_index) as content", "sequence(msg_index, msg_index + 2) as shadows")
    return order.splice_compaction(rows, made)


@query("win_21_interleave_notes", f"""{EVENTS}, m AS (SELECT session_id, msg_index, CASE WHEN msg_index % 5 <> 0 THEN ts_ms END AS ts_ms FROM messages WHERE role <> 'system'), n AS (SELECT session_id, msg_index AS note_index, CASE WHEN msg_index % 7 <> 0 THEN ts_ms END AS ts_ms FROM messages WHERE role = 'system'),
  p AS (SELECT session_id, 1 AS k, msg_index, ts_ms, msg_index AS slot FROM m UNION ALL SELECT session_id, 0, note_index, ts_ms, (SELECT min(msg_index) FROM m WHERE m.session_id = n.session_id AND m.ts_ms >= n.ts_ms) FROM n)
  SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY slot NULLS LAST, k, ts_ms NULLS LAST, msg_index) - 1 AS INTEGER) AS place, CASE k WHEN 1 THEN 'message' ELSE 'note' END AS kind, msg_index FROM p""")
def win_21(spark, sf):
    rows = T.event_messages(spark, sf)
    messages = rows.where("role <> 'system'").selectExpr("session_id", "msg_index", "if(msg_index % 5 <> 0, ts_ms, null) as ts_ms", "content")
    notes = rows.where("role = 'system'").selectExpr("session_id", "msg_index as note_index", "if(msg_index % 7 <> 0, ts_ms, null) as ts_ms", "content")
    return order.interleave_notes(messages, notes)


@query("win_23_assemble_chunks", f"{EVENTS}, c AS (SELECT session_id, msg_index // 12 AS turn, msg_index // 4 % 3 AS step, msg_index // 2 % 2 AS block, role = 'tool' AS kind, msg_index AS seq, content AS delta FROM messages) SELECT session_id, turn, step, block, kind, string_agg(delta, '' ORDER BY seq) AS text FROM c WHERE (session_id + turn + step) % 3 <> 0 GROUP BY ALL")
def win_23(spark, sf):
    chunks = T.event_messages(spark, sf).selectExpr("session_id", "msg_index div 12 as turn", "msg_index div 4 % 3 as step", "msg_index div 2 % 2 as block", "role = 'tool' as kind", "msg_index as seq", "content as delta")
    return order.assemble_stream_chunks(chunks, chunks.where("(session_id + turn + step) % 3 = 0"))


@query("win_24_merge_double_prompt", f"""{EVENTS}, r AS (SELECT session_id, msg_index, CASE WHEN msg_index % 2 = 0 THEN 'item' ELSE 'event' END AS type, concat('p', (msg_index + session_id % 2) // 2 % 3) AS content, CASE WHEN msg_index % 2 = 0 AND msg_index % 3 = 0 THEN concat('i', msg_index) END AS images, CASE WHEN msg_index % 4 <> 1 THEN ts_ms END AS ts_ms FROM messages),
  l AS (SELECT *, lag(type) OVER w AS pt, lag(content) OVER w AS pc, lag(images) OVER w AS pi, lag(ts_ms) OVER w AS pts, lead(type) OVER w AS nt, lead(content) OVER w AS nc FROM r WINDOW w AS (PARTITION BY session_id ORDER BY msg_index))
  SELECT session_id, msg_index, type, content, CASE WHEN type = 'event' AND pt = 'item' AND pc = content THEN coalesce(images, pi) ELSE images END AS images, CASE WHEN type = 'event' AND pt = 'item' AND pc = content THEN coalesce(ts_ms, pts) ELSE ts_ms END AS ts_ms FROM l WHERE NOT coalesce(type = 'item' AND nt = 'event' AND nc = content, false)""")
def win_24(spark, sf):
    rows = T.event_messages(spark, sf).selectExpr("session_id", "msg_index", "if(msg_index % 2 = 0, 'item', 'event') as type", "concat('p', (msg_index + session_id % 2) div 2 % 3) as content", "if(msg_index % 2 = 0 and msg_index % 3 = 0, concat('i', msg_index), null) as images", "if(msg_index % 4 <> 1, ts_ms, null) as ts_ms")
    return order.merge_double_prompt(rows)


@query("win_7_drop_fork_context", f"""{EVENTS}, t AS (SELECT session_id, msg_index AS line_no, CASE WHEN msg_index IN (0, 2) THEN 'session_meta' WHEN role = 'user' THEN 'task_started' WHEN role = 'assistant' THEN 'token_count' WHEN role = 'system' THEN 'turn_context' ELSE 'response_item' END AS type, CASE WHEN msg_index = 0 THEN 500000000 ELSE ts_ms END AS started_at FROM messages),
  w AS (SELECT *, sum(CASE WHEN type = 'session_meta' THEN 1 ELSE 0 END) OVER v AS metas, first_value(CASE WHEN type = 'session_meta' THEN started_at END IGNORE NULLS) OVER v AS st FROM t WINDOW v AS (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  b AS (SELECT *, max(CASE WHEN type = 'task_started' AND started_at >= st THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) AS begun FROM w) SELECT session_id, line_no, type FROM b WHERE NOT (metas >= 2 AND begun = 0 AND type NOT IN ('token_count', 'turn_context'))""")
def win_7(spark, sf):
    rows = T.event_messages(spark, sf).selectExpr("session_id", "msg_index as line_no", "case when msg_index in (0, 2) then 'session_meta' when role = 'user' then 'task_started' when role = 'assistant' then 'token_count' when role = 'system' then 'turn_context' else 'response_item' end as type", "if(msg_index = 0, 500000000, ts_ms) as started_at")
    return order.drop_fork_context(rows).select("session_id", "line_no", "type")


@query("win_22_compaction_cutoff", f"""{EVENTS}, tr AS (SELECT session_id, msg_index, CASE WHEN msg_index % 4 <> 0 THEN msg_index // 3 END AS prompt_index FROM messages WHERE msg_index >= session_id % 30), up AS (SELECT session_id, msg_index, msg_index // 3 AS prompt_index FROM messages), o AS (SELECT session_id, min(prompt_index) AS lo FROM tr GROUP BY 1),
  old AS (SELECT up.* FROM up JOIN o USING (session_id) WHERE prompt_index < lo) SELECT session_id, msg_index, prompt_index, 'updates' AS origin FROM old UNION ALL SELECT session_id, msg_index, prompt_index, 'transcript' FROM tr WHERE prompt_index IS NOT NULL OR session_id NOT IN (SELECT session_id FROM old)""")
def win_22(spark, sf):
    rows = T.event_messages(spark, sf)
    transcript = rows.where("msg_index >= session_id % 30").selectExpr("session_id", "msg_index", "if(msg_index % 4 <> 0, msg_index div 3, null) as prompt_index")
    return order.compaction_cutoff(transcript, rows.selectExpr("session_id", "msg_index", "msg_index div 3 as prompt_index"))


@query("win_9_active_branch", f"""WITH RECURSIVE {T.event_messages_sql()}, e AS (SELECT session_id, msg_index AS id, CASE WHEN msg_index > 0 THEN msg_index - 1 - msg_index % 3 END AS up FROM messages), n AS (SELECT session_id, id, CASE WHEN up >= 0 THEN up END AS up FROM e), w AS (SELECT session_id, max(id) AS id FROM n GROUP BY 1 UNION SELECT n.session_id, n.up FROM w JOIN n USING (session_id, id) WHERE n.up IS NOT NULL) SELECT session_id, id FROM w""")
def win_9(spark, sf):
    rows = T.event_messages(spark, sf).selectExpr("session_id", "msg_index as id", "msg_index as line_no", "if(msg_index - 1 - msg_index % 3 >= 0, msg_index - 1 - msg_index % 3, null) as parent_id")
    return order.active_branch(rows)


ROLE_SUMS = ", ".join(f"count(*) FILTER (role = '{r}') AS {('\"' + r + '\"') if r == 'user' else r}" for r in ("user", "assistant", "tool", "system"))


@query("sa_1_role_counts", f"{EVENTS} SELECT session_id, {ROLE_SUMS} FROM messages GROUP BY 1")
def sa_1(spark, sf):
    return order.role_counts(T.event_messages(spark, sf))


@query("sa_2_role_counts_shown", f"{CHAT} SELECT session_id, {ROLE_SUMS} FROM messages WHERE trim(coalesce(content, '')) <> '' GROUP BY 1")
def sa_2(spark, sf):
    return order.role_counts(T.chat_messages(spark, sf).withColumn("tool_name", F.lit(None).cast("string")).where(order.renderable()))


@query("sa_3_tool_distribution", f"{EVENTS}, t AS (SELECT session_id, tool_name AS tool, count(*) AS calls FROM messages WHERE role = 'tool' GROUP BY 1, 2) SELECT *, round(calls / sum(calls) OVER (PARTITION BY session_id), 6) AS share FROM t")
def sa_3(spark, sf):
    return order.tool_distribution(T.event_messages(spark, sf))


@query("sa_4_time_span", f"{EVENTS} SELECT session_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM messages GROUP BY 1")
def sa_4(spark, sf):
    return T.event_messages(spark, sf).groupBy("session_id").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query("sa_7_session_report", f"""{EVENTS}, g AS (SELECT session_id, {ROLE_SUMS}, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens,
    CAST(coalesce(sum(cache_write_tokens), 0) AS BIGINT) AS cache_write_tokens FROM messages GROUP BY 1), {TIMELINE}, p AS (SELECT session_id, msg_index AS peak_index FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY total DESC, msg_index) = 1)
  SELECT g.*, peak_index, round((input_tokens + output_tokens + cache_read_tokens + cache_write_tokens) / nullif(assistant, 0), 6) AS tokens_per_turn, round(tool / nullif("user", 0), 6) AS tools_per_user_turn,
    round(cache_read_tokens / nullif(input_tokens + cache_read_tokens + cache_write_tokens, 0), 6) AS cache_share FROM g LEFT JOIN p USING (session_id)""")
def sa_7(spark, sf):
    return order.session_report(T.event_messages(spark, sf))


@query("sa_8_last_activity", f"{EVENTS} SELECT session_id, max(ts_ms) FILTER (role IN ('user', 'assistant')) AS updated_ms FROM messages GROUP BY 1")
def sa_8(spark, sf):
    return order.last_activity(T.event_messages(spark, sf))
