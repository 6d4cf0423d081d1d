"""Catalog, join and merge queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from ..sources import tables as T

QUERIES, ORACLES = {}, {}
S = f"WITH {T.SESSIONS_SQL}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("cat_1_list_recent", f"{S} SELECT id, updated_at FROM sessions WHERE parent_id IS NULL ORDER BY updated_at DESC, id LIMIT 100")
def cat_1(spark, sf):
    return catalog.list_recent(T.sessions(spark, sf), 100).select("id", "updated_at")


@query("cat_1_children", f"{S} SELECT id FROM sessions WHERE parent_id = 9")
def cat_1_children(spark, sf):
    return catalog.children(T.sessions(spark, sf), 9).select("id")


def tree_rows(spark, sf):
    """Chains of up to 9 sessions inside a provider, some parents elsewhere."""
    return T.sessions(spark, sf).selectExpr("id", "concat('p', id div 40 % 3) as provider", "if(id % 13 < 10 and id >= 1, id - 1 - id % 2, null) as parent_id", "concat('/w/', id div 20) as project_path")


TREE = "t AS (SELECT o_orderkey AS id, concat('p', o_orderkey // 40 % 3) AS provider, CASE WHEN o_orderkey % 13 < 10 AND o_orderkey >= 1 THEN o_orderkey - 1 - o_orderkey % 2 END AS parent_id, concat('/w/', o_orderkey // 20) AS project_path FROM orders)"


@query("cat_2_session_tree", f"WITH RECURSIVE {TREE}, l AS (SELECT c.id, CASE WHEN p.id IS NOT NULL AND p.id <> c.id THEN p.id END AS up FROM t c LEFT JOIN t p ON c.parent_id = p.id AND c.provider = p.provider AND c.project_path = p.project_path), w AS (SELECT id, id AS root_id, 0 AS depth FROM l WHERE up IS NULL UNION ALL SELECT l.id, w.root_id, w.depth + 1 FROM l JOIN w ON l.up = w.id) SELECT * FROM w")
def cat_2(spark, sf):
    return catalog.session_tree(tree_rows(spark, sf))


@query("cat_3_descendants", f"WITH RECURSIVE {TREE}, l AS (SELECT c.id, CASE WHEN p.id IS NOT NULL AND p.id <> c.id THEN p.id END AS up FROM t c LEFT JOIN t p ON c.parent_id = p.id AND c.provider = p.provider AND c.project_path = p.project_path), w AS (SELECT id, id AS root_id, 0 AS depth FROM l WHERE up IS NULL UNION ALL SELECT l.id, w.root_id, w.depth + 1 FROM l JOIN w ON l.up = w.id) SELECT root_id, count(*) AS sessions, CAST(max(depth) AS INTEGER) AS depth FROM w GROUP BY 1")
def cat_3(spark, sf):
    return catalog.tree_counts(cat_2(spark, sf))


FAV = f"{S}, {T.FAVORITES_SQL}"


@query("jn_5_favorites", f"{FAV} SELECT id, added_at, title, provider FROM favorites JOIN sessions ON session_id = id")
def jn_5(spark, sf):
    return catalog.favorites_list(T.favorites(spark, sf), T.sessions(spark, sf))


@query("cat_4_favorites_edit", f"{FAV}, m AS (SELECT doc_id AS session_id, doc_id + 7 AS added_at FROM labels), u AS (SELECT * FROM favorites UNION ALL SELECT * FROM m WHERE session_id NOT IN (SELECT session_id FROM favorites)) SELECT * FROM u WHERE session_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def cat_4(spark, sf):
    labels = T.read(spark, sf, "labels")
    grown = catalog.add_favorites(T.favorites(spark, sf), labels.selectExpr("doc_id as session_id", "doc_id + 7 as added_at"))
    return catalog.remove_favorites(grown, labels.where("toxic = 1").selectExpr("doc_id as session_id"))


@query("cat_5_favorites_tree", f"{FAV} SELECT provider, project_path, count(*) AS sessions FROM sessions WHERE id IN (SELECT session_id FROM favorites) GROUP BY 1, 2")
def cat_5(spark, sf):
    return catalog.favorites_tree(T.favorites(spark, sf), T.sessions(spark, sf))


@query("cat_6_rename", f"{S} SELECT id, CASE WHEN id % 10 = 0 THEN concat('own ', id) ELSE title END AS title, id % 10 = 0 AS title_custom FROM sessions")
def cat_6(spark, sf):
    rows = T.sessions(spark, sf)
    titles = rows.where("id % 10 = 0").selectExpr("id", "concat('own ', id) as custom_title")
    return catalog.rename(rows, titles).select("id", "title", "title_custom")


MERGE = f"""{S}, o AS (SELECT id, provider, title, id % 4 = 0 AS title_custom, content_text, project_path, project_name, is_sidechain, parent_id FROM sessions WHERE id % 3 <> 0),
  n AS (SELECT id, provider, concat(title, CASE WHEN id % 2 = 0 THEN ' new' ELSE '' END) AS title, false AS title_custom, content_text, CASE WHEN id % 5 = 0 THEN '' ELSE concat(project_path, 'x') END AS project_path, CASE WHEN id % 7 = 0 THEN 'Unknown Project' ELSE project_name END AS project_name, id % 11 = 0 AS is_sidechain, CASE WHEN id % 2 = 0 THEN parent_id END AS parent_id FROM sessions WHERE id % 5 <> 1)
  SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.title WHEN o.title_custom THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NULL THEN o.project_path WHEN n.project_path = '' THEN o.project_path ELSE n.project_path END AS project_path,
    CASE WHEN n.id IS NULL THEN o.project_name WHEN n.project_name = 'Unknown Project' THEN coalesce(o.project_name, n.project_name) ELSE n.project_name END AS project_name,
    CASE WHEN n.id IS NULL THEN o.is_sidechain WHEN n.provider = 'low' THEN n.is_sidechain ELSE coalesce(o.is_sidechain, false) OR n.is_sidechain END AS is_sidechain, CASE WHEN n.id IS NULL THEN o.parent_id WHEN n.provider = 'low' THEN n.parent_id ELSE coalesce(n.parent_id, o.parent_id) END AS parent_id,
    n.id IS NOT NULL AND NOT (o.id IS NOT NULL AND o.title = n.title AND o.content_text = n.content_text AND o.project_name = n.project_name) AS changed FROM o FULL JOIN n ON o.id = n.id"""


@query("cat_7_merge_sessions", MERGE)
def cat_7(spark, sf):
    rows = T.sessions(spark, sf)
    columns = ["provider", "title", "title_custom", "content_text", "project_path", "project_name", "is_sidechain", "parent_id"]
    old = rows.where("id % 3 <> 0").withColumn("title_custom", F.expr("id % 4 = 0")).select("id", *columns)
    new = rows.where("id % 5 <> 1").selectExpr("id", "provider", "concat(title, if(id % 2 = 0, ' new', '')) as title", "false as title_custom", "content_text", "if(id % 5 = 0, '', concat(project_path, 'x')) as project_path", "if(id % 7 = 0, 'Unknown Project', project_name) as project_name", "id % 11 = 0 as is_sidechain", "if(id % 2 = 0, parent_id, null) as parent_id")
    return catalog.merge_sessions(old, new, "low").select("id", "title", "project_path", "project_name", "is_sidechain", "parent_id", "changed")


@query("cat_10_delete_missing", f"{S}, s AS (SELECT id, concat('/f/', id % 50) AS source_path FROM sessions) SELECT id FROM s WHERE NOT (id % 50 < 20 AND id % 4 = 0) AND NOT (id % 50 >= 45)")
def cat_10(spark, sf):
    rows = T.sessions(spark, sf).selectExpr("id", "concat('/f/', id % 50) as source_path")
    scanned = rows.where("id % 50 < 20").select("source_path").distinct()
    kept = catalog.delete_missing(rows, scanned, rows.where("id % 4 <> 0"))
    return catalog.delete_vanished(kept, scanned, rows.where("id % 50 < 45").select("source_path").distinct()).select("id")


@query("cat_11_cascade", f"{S}, {T.FAVORITES_SQL} SELECT session_id, added_at FROM favorites WHERE session_id IN (SELECT id FROM sessions WHERE provider IN ('low', 'high'))")
def cat_11(spark, sf):
    return catalog.cascade(T.favorites(spark, sf), catalog.purge_unknown(T.sessions(spark, sf), ["low", "high"]))


@query("jn_9_backfill_children", f"""{S}, s AS (SELECT id, CASE WHEN id % 2 = 0 THEN parent_id END AS parent_id, is_sidechain, CASE WHEN id % 3 = 0 THEN '' ELSE project_path END AS project_path, CASE WHEN id % 3 = 1 THEN 'Unknown Project' ELSE project_name END AS project_name FROM sessions),
  d AS (SELECT child AS id, min(p) AS p FROM (SELECT id AS p, unnest([id, id + 5, id + 9]) AS child FROM s WHERE id % 10 = 0) WHERE p <> child GROUP BY 1)
  SELECT s.id, CASE WHEN d.p IS NOT NULL THEN coalesce(s.parent_id, d.p) ELSE s.parent_id END AS parent_id, s.is_sidechain OR d.p IS NOT NULL AS is_sidechain, CASE WHEN d.p IS NOT NULL AND s.project_path IN ('', 'Unknown Project') THEN coalesce(q.project_path, s.project_path) ELSE s.project_path END AS project_path,
    CASE WHEN d.p IS NOT NULL AND s.project_name IN ('', 'Unknown Project') THEN coalesce(q.project_name, s.project_name) ELSE s.project_name END AS project_name FROM s LEFT JOIN d ON s.id = d.id LEFT JOIN s q ON q.id = d.p""")
def jn_9(spark, sf):
    rows = T.sessions(spark, sf).selectExpr("id", "if(id % 2 = 0, parent_id, null) as parent_id", "is_sidechain", "if(id % 3 = 0, '', project_path) as project_path", "if(id % 3 = 1, 'Unknown Project', project_name) as project_name")
    return catalog.backfill_children(rows, rows.where("id % 10 = 0").selectExpr("id as parent_id", "array(id, id + 5, id + 9) as child_ids"))


@query("jn_10_inherit_project", f"{S} SELECT c.id, coalesce(nullif(p.project_path, ''), c.project_path) AS project_path FROM sessions c LEFT JOIN sessions p ON c.parent_id = p.id")
def jn_10(spark, sf):
    return catalog.inherit_project(T.sessions(spark, sf)).select("id", "project_path")


CALLS = """calls AS (SELECT l_orderkey AS session_id, concat('c', l_partkey % 5) AS call_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS msg_index, concat('a', l_suppkey % 3) AS assistant_uuid FROM lineitem),
  results AS (SELECT session_id, concat('c', (msg_index + session_id) % 6) AS call_id, msg_index AS line_no, concat('out ', msg_index) AS output, CASE WHEN msg_index % 2 = 0 THEN 'error' ELSE 'success' END AS status, assistant_uuid FROM calls)"""


def calls_results(spark, sf):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    calls = T.read(spark, sf, "lineitem").withColumn("msg_index", seq.cast("long")).selectExpr("l_orderkey as session_id", "concat('c', l_partkey % 5) as call_id", "msg_index", "concat('a', l_suppkey % 3) as assistant_uuid")
    results = calls.selectExpr("session_id", "concat('c', (msg_index + session_id) % 6) as call_id", "msg_index as line_no", "concat('out ', msg_index) as output", "if(msg_index % 2 = 0, 'error', 'success') as status", "assistant_uuid")
    return calls, results


@query("jn_6_pair_tool_results", f"WITH {CALLS}, r AS (SELECT session_id, call_id, arg_max(output, line_no) AS output, arg_max(status, line_no) AS status FROM results GROUP BY 1, 2), m AS (SELECT *, max(msg_index) OVER (PARTITION BY session_id, call_id) AS newest FROM calls) SELECT m.session_id, m.call_id, msg_index, CASE WHEN msg_index = newest THEN output END AS output, CASE WHEN msg_index = newest THEN status END AS status FROM m LEFT JOIN r USING (session_id, call_id)")
def jn_6(spark, sf):
    calls, results = calls_results(spark, sf)
    return catalog.pair_tool_results(calls.drop("assistant_uuid"), results)


@query("jn_7_pair_by_assistant", f"WITH {CALLS}, one AS (SELECT session_id, assistant_uuid, min(call_id) AS paired FROM calls GROUP BY 1, 2 HAVING count(*) = 1) SELECT session_id, line_no, paired AS call_id FROM results JOIN one USING (session_id, assistant_uuid)")
def jn_7(spark, sf):
    calls, results = calls_results(spark, sf)
    return catalog.pair_by_assistant(calls, results.drop("call_id")).select("session_id", "line_no", "call_id")


@query("jn_8_orphan_results", f"WITH {CALLS} SELECT session_id, call_id, line_no FROM results ANTI JOIN calls USING (session_id, call_id)")
def jn_8(spark, sf):
    calls, results = calls_results(spark, sf)
    return catalog.orphan_results(calls, results).select("session_id", "call_id", "line_no")


@query("jn_11_match_subagent", f"""{S}, c AS (SELECT id AS call_id, id - id % 7 + 2 AS parent_id, CASE WHEN id % 7 = 5 THEN concat('agent-', id - id % 7 + 3, '@session-9') END AS agent_id, CASE WHEN id % 7 = 6 THEN 'kid 3' END AS nickname, CASE WHEN id % 7 = 0 THEN 'kid' ELSE '' END AS description FROM sessions WHERE id % 7 IN (0, 1, 5, 6)),
  k AS (SELECT id AS child_id, parent_id, CASE WHEN id % 7 = 3 THEN concat('kid ', id % 7) ELSE 'other' END AS title FROM sessions WHERE id % 7 IN (3, 4)),
  p AS (SELECT call_id, child_id, CASE WHEN CAST(child_id AS VARCHAR) = regexp_replace(regexp_replace(agent_id, '@session-.*$', ''), '^agent-', '') THEN 1 WHEN nickname = title THEN 2 WHEN description <> '' AND starts_with(title, description) THEN 3 END AS rule FROM c JOIN k USING (parent_id))
  SELECT call_id, child_id, rule FROM p WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY rule, child_id) = 1""")
def jn_11(spark, sf):
    rows = T.sessions(spark, sf)
    calls = rows.where("id % 7 in (0, 1, 5, 6)").selectExpr("id as call_id", "id - id % 7 + 2 as parent_id", "if(id % 7 = 5, concat('agent-', id - id % 7 + 3, '@session-9'), null) as agent_id", "if(id % 7 = 6, 'kid 3', null) as nickname", "if(id % 7 = 0, 'kid', '') as description")
    children = rows.where("id % 7 in (3, 4)").selectExpr("id", "parent_id", "if(id % 7 = 3, concat('kid ', id % 7), 'other') as title")
    return catalog.match_subagent(calls, children)


@query("jn_14_parent_by_path", f"{S}, h AS (SELECT id, concat('/l/', id % 4, '/', id, '.jsonl') AS source_path, CASE id % 3 WHEN 0 THEN concat(id - 4, '.jsonl') WHEN 1 THEN concat('/l/', (id + 2) % 4, '/', id + 2, '.jsonl') ELSE concat(id, '.jsonl') END AS parent_path FROM sessions), r AS (SELECT id, CASE WHEN parent_path LIKE '/%' THEN parent_path ELSE concat(regexp_replace(source_path, '[^/]*$', ''), parent_path) END AS p FROM h) SELECT r.id, CASE WHEN h.id <> r.id THEN h.id END AS parent_id FROM r LEFT JOIN h ON r.p = h.source_path")
def jn_14(spark, sf):
    rows = T.sessions(spark, sf).selectExpr("id", "concat('/l/', id % 4, '/', id, '.jsonl') as source_path", "case id % 3 when 0 then concat(id - 4, '.jsonl') when 1 then concat('/l/', (id + 2) % 4, '/', id + 2, '.jsonl') else concat(id, '.jsonl') end as parent_path")
    return catalog.parent_by_header_path(rows)


@query("jn_16_attach_prompt_usage", f"WITH {T.event_messages_sql()}, r AS (SELECT session_id, msg_index, role, content, msg_index // 5 AS prompt_index FROM messages), u AS (SELECT session_id, msg_index // 5 AS prompt_index, arg_max(input_tokens, msg_index) AS n FROM messages WHERE input_tokens IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, max(msg_index) FILTER (role = 'assistant') OVER (PARTITION BY session_id, prompt_index) AS place FROM r) SELECT p.session_id, msg_index, CASE WHEN msg_index = place THEN n END AS input_tokens FROM p LEFT JOIN u USING (session_id, prompt_index)")
def jn_16(spark, sf):
    rows = T.event_messages(spark, sf)
    turns = rows.selectExpr("session_id", "msg_index", "role", "content", "msg_index div 5 as prompt_index")
    reports = rows.where("input_tokens is not null").selectExpr("session_id", "msg_index div 5 as prompt_index", "msg_index as line_no", "input_tokens")
    return catalog.attach_prompt_usage(turns, reports).select("session_id", "msg_index", "input_tokens")
