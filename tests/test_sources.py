"""Logs, sinks and streams on small files of our own."""

import json

from pyspark.sql import functions as F

from fleetlog.operators import usage
from fleetlog.sources import logs, sinks
from fleetlog.sources import tables as T
from fleetlog.streaming import jobs


def write(folder, name, rows, tail="\n"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + tail)
    return str(path)


def test_discovery_and_freshness(spark, tmp_path):
    write(tmp_path, "a.jsonl", ["{}"])
    write(tmp_path, "s1/subagents/x/b.jsonl", ["{}", "{}"])
    write(tmp_path, "c.txt", ["no"])
    found = logs.discover_logs(spark, str(tmp_path), logs.LogFormat("p"))
    assert sorted(r.source_path.rsplit("/", 1)[1] for r in found.collect()) == ["a.jsonl", "b.jsonl"]
    known = found.withColumn("size", F.when(F.col("source_path").endswith("a.jsonl"), F.col("size") + 1).otherwise(F.col("size")))
    assert [r.source_path[-7:] for r in logs.stale_files(found, known).collect()] == ["a.jsonl"]
    assert [r.source_path[-7:] for r in logs.unchanged_files(found, known).collect()] == ["b.jsonl"]
    zero = found.withColumn("mtime", F.lit(0).cast("long"))
    assert logs.stale_files(found, zero).count() == 2
    copies = spark.createDataFrame([("r", 1, "old"), ("r", 0, "new"), ("q", 1, "only")], "rel_path string, root_rank int, source_path string")
    assert {r.source_path for r in logs.prefer_active_copy(copies).collect()} == {"new", "only"}


def test_titles_and_known_sources(spark):
    listing = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 2, 5)], "source_path string, size long, mtime long")
    known = spark.createDataFrame([("a", 1, 5, 1, "t"), ("b", 1, 5, 2, None), ("c", 1, 5, 3, "t")], "source_path string, size long, mtime long, session_id long, title string")
    titles = spark.createDataFrame([(1, "new"), (2, "new"), (3, "t")], "session_id long, title string")
    assert {r.source_path for r in logs.stale_by_title(listing, known, titles).collect()} == {"a", "c"}
    sessions = spark.createDataFrame([(1, "p", "a", 1, 5, True, "side", False), (2, "p", "a", 1, 5, False, "main", False), (3, "p", "b", 1, 5, False, "own", True), (4, "q", "c", 1, 1, False, "x", False)], "id long, provider string, source_path string, size long, mtime long, is_sidechain boolean, title string, title_custom boolean")
    assert {(r.source_path, r.session_id, r.title) for r in logs.known_sources(sessions, "p").collect()} == {("a", 2, "main"), ("b", 3, None)}


def test_lines(spark, tmp_path):
    write(tmp_path, "a.jsonl", ['{"a":1}', "", "  ", "{bad", '{"b":2}'], tail="")
    assert [(r.line_no, r.malformed) for r in logs.read_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, False), (4, True), (5, False)]
    assert logs.read_log_lines(spark, str(tmp_path), torn_tail=True).count() == 2
    assert logs.malformed_counts(logs.read_log_lines(spark, str(tmp_path))).first().malformed == 1


def test_block_log(spark, tmp_path):
    usage_of = {"input_tokens": 3, "output_tokens": 4, "cache_creation_input_tokens": 1, "cache_creation": {"ephemeral_5m_input_tokens": 2, "ephemeral_1h_input_tokens": 5}}
    write(tmp_path, "a.jsonl", [
        {"type": "user", "timestamp": "2026-01-02T03:04:05Z", "message": {"role": "user", "content": "hi"}},
        {"type": "assistant", "message": {"role": "assistant", "model": "m", "usage": usage_of, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "ls"}}, {"type": "text", "text": "c"}, {"type": "odd"}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "out", "is_error": False}]}},
        {"type": "mode"}, "{bad",
    ])
    rows = logs.normalize_block_log(logs.read_log_lines(spark, str(tmp_path))).orderBy("line_no", "part").collect()
    assert [(r.line_no, r.role, r.content, r.call_id) for r in rows] == [(1, "user", "hi", None), (2, "system", "hm", None), (2, "assistant", "a\nb", None), (2, "tool", None, "c1"), (2, "assistant", "c", None), (2, "unknown", None, None), (3, "result", "out", "c1")]
    assert rows[1].usage.cache_write == 7 and json.loads(rows[3].tool_input) == {"command": "ls"} and rows[0].usage is None


def test_event_and_wire_logs(spark, tmp_path):
    write(tmp_path / "e", "a.jsonl", [
        {"type": "session_meta", "payload": {"id": "s", "cwd": "/w"}}, {"type": "turn_context", "payload": {"model": "m1"}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "t", "text": "x"}, {"type": "t", "text": "y"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "c", "arguments": "{}"}}, {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "o"}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 9, "output_tokens": 2}}}}, {"type": "new"},
    ])
    rows = logs.normalize_event_log(logs.read_log_lines(spark, str(tmp_path / "e"))).orderBy("line_no").collect()
    assert [(r.kind, r.role, r.content) for r in rows] == [("session_meta", None, None), ("turn_context", None, None), ("message", "assistant", "x\ny"), ("function_call", "tool", None), ("function_call_output", "result", "o"), ("token_count", None, None), ("unknown", None, None)]
    assert (rows[5].total_input_tokens, rows[5].last_input_tokens) == (9, None)
    write(tmp_path / "w", "w.jsonl", [{"type": "turn.prompt", "time": 1}, {"type": "context.append_loop_event", "event": {"type": "content.part", "part": {"type": "text", "text": "t"}}}, {"type": "context.append_loop_event", "event": {"type": "tool.call", "toolCallId": "c", "name": "n"}}, {"type": "usage.record", "usage": {"inputOther": 4, "output": 1}, "usageScope": "turn"}])
    rows = logs.normalize_wire_log(logs.read_log_lines(spark, str(tmp_path / "w"))).orderBy("line_no").collect()
    assert [(r.kind, r.role) for r in rows] == [("turn.prompt", "user"), ("content.part", "assistant"), ("tool.call", "tool"), ("usage.record", None)] and rows[3].usage.inputOther == 4


def test_updates_relational_and_legacy(spark, tmp_path):
    chunk = lambda i, t: {"timestamp": t, "params": {"update": {"sessionUpdate": "user_message_chunk", "_meta": {"promptIndex": i}}}}
    tool = lambda **x: {"timestamp": 9, "params": {"update": {"sessionUpdate": "tool_call_update", "toolCallId": "k", **x}}}
    write(tmp_path, "u.jsonl", [chunk(0, 5), chunk(0, 6), chunk(1, 8), tool(status="pending", title="T"), tool(status="done")])
    prompts, tools = logs.fold_updates(logs.read_log_lines(spark, str(tmp_path)))
    assert {(r.prompt_index, r.ts) for r in prompts.collect()} == {(0, 5), (1, 8)} and tools.first().asDict()["status"] == "done" and tools.first().title == "T"
    session = spark.createDataFrame([("s", "t", "", "p", None), ("z", "t", "/own", "q", "w")], "id string, title string, directory string, project_id string, workspace_id string")
    project = spark.createDataFrame([("p", "/tree", "P")], "id string, worktree string, name string")
    workspace = spark.createDataFrame([("w", "main")], "id string, branch string")
    message = spark.createDataFrame([("m1", "s", '{"role":"assistant","modelID":"x"}', 1), ("m2", "s", '{"role":"user"}', 2)], "id string, session_id string, data string, time_created long")
    part = spark.createDataFrame([("m2", "s", '{"type":"text","text":"two"}', 2), ("m1", "s", '{"type":"text","text":"one"}', 1), ("m1", "s", '{"type":"tool"}', 3)], "message_id string, session_id string, data string, time_created long")
    got = {r.id: r for r in logs.normalize_relational(session, project, workspace, message, part).collect()}
    assert (got["s"].project_path, got["s"].messages, got["s"].model, got["s"].content_text) == ("/tree", 2, "x", "one\ntwo") and (got["z"].project_path, got["z"].branch, got["z"].messages) == ("/own", "main", 0)
    entries = spark.createDataFrame([("a", 2, 1, None, None, "hookMessage"), ("a", 3, 1, None, None, "user"), ("b", 2, 3, "i", "h", "hookMessage"), ("c", 2, 4, "j", None, "user")], "source_path string, line_no int, version int, id string, parent_id string, role string")
    assert {(r.source_path, r.id, r.parent_id, r.role) for r in logs.migrate_legacy_ids(entries).collect()} == {("a", "legacy-00000000", None, "custom"), ("a", "legacy-00000001", "legacy-00000000", "user"), ("b", "i", "h", "hookMessage")}
    write(tmp_path / "t", "i.jsonl", [{"id": "s", "thread_name": "old"}, "{bad", {"id": "s", "thread_name": "new"}])
    assert [tuple(r) for r in logs.sidecar_titles(logs.read_log_lines(spark, str(tmp_path / "t"))).collect()] == [("s", "new")]


def test_exports(spark, sf, tmp_path):
    messages = T.chat_messages(spark, sf).withColumn("tool_name", F.lit(None).cast("string"))
    ids = messages.select(F.col("session_id").alias("id")).distinct()
    sessions = ids.selectExpr("id", "concat('a/b:', id) as title", "1500L as input_tokens", "if(id % 2 = 0, 5L, 0L) as output_tokens")
    docs = {r.id: json.loads(r.doc) for r in sinks.export_json(sessions, messages).collect()}
    want = {}
    for r in messages.orderBy("session_id", "msg_index").collect():
        want.setdefault(r.session_id, []).append(r.content)
    assert {k: [m.get("content") for m in v["messages"]] for k, v in docs.items()} == want
    markdown = sinks.export_markdown(sessions, messages)
    assert "| 1.5k |" in markdown.first().doc and markdown.first().doc.startswith("# a/b:")
    batch = sinks.export_batch(markdown, sessions, ids.limit(3), "md")
    batch.write.partitionBy("file_name").text(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("file_name=a_b_*"))) == 3


def test_write_tables_replaces_days(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(b, n) for b, n in x], "bucket long, n long")
    sinks.write_tables(rows((0, 1), (86400, 2)), str(tmp_path / "t"))
    sinks.write_tables(rows((86400, 3)), str(tmp_path / "t"))
    assert {(r.bucket, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(0, 1), (86400, 3)}


def run_stream(frame, tmp_path, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_streams_equal_batches(spark, sf, tmp_path):
    events = usage.valid_usage(T.usage_events(spark, sf)).where("session_id < 200").selectExpr("session_id", "cast(seq as long) as seq", "cast(ts as timestamp) as ts", "model", *usage.COUNTERS, "usage_hash")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(jobs.stream_usage(source, "100000 days"), tmp_path, "usage", "complete")
    want = events.groupBy("session_id", (F.floor(F.unix_seconds("ts") / 900) * 900).alias("bucket"), "model").agg(F.sum("input_tokens").alias("n"))
    assert {(r.session_id, r.bucket, r.model, r.input_tokens) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert run_stream(jobs.stream_dedup(source, "100000 days"), tmp_path, "dedup").count() == events.select("session_id", "usage_hash").distinct().count()
    bursts = run_stream(jobs.activity_bursts(source, late="100000 days"), tmp_path, "bursts", "complete").agg(F.sum("messages")).first()[0]
    assert bursts == events.count()
    write(tmp_path / "lines", "a.jsonl", ["{}", "{}"])
    lines = jobs.file_stream(spark, str(tmp_path / "lines"))
    assert run_stream(lines, tmp_path, "lines").count() == 2


def test_stream_keeps_rows_without_hash(spark, tmp_path):
    rows = [(1, 1, None), (2, 1, None), (1, 2, "h"), (1, 3, "h"), (2, 2, "h")]
    frame = spark.createDataFrame(rows, "session_id long, seq long, usage_hash string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "in"))
    got = run_stream(jobs.stream_dedup(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))), tmp_path, "nohash")
    assert sorted((r.session_id, r.usage_hash) for r in got.collect() if r.usage_hash) == [(1, "h"), (2, "h")] and got.where("usage_hash is null").count() == 2


def test_lines_in_blocks(spark, tmp_path):
    rows = [f'{{"n":{i}}}' if i % 7 else "" for i in range(4000)]
    write(tmp_path, "a.jsonl", rows, tail="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = logs.read_log_lines(spark, str(tmp_path)).collect()
        assert {(r.line_no, r.raw) for r in got} == {(i + 1, r) for i, r in enumerate(rows) if r}
        assert logs.read_log_lines(spark, str(tmp_path), torn_tail=True).count() == len(got) - 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parents_behind_dots(spark):
    from fleetlog.operators import catalog

    rows = [("p", "/a/x.jsonl", None), ("c", "/a/b/c/y.jsonl", "../.././x.jsonl"), ("d", "/a/z.jsonl", "/a/b/../x.jsonl"), ("e", "/e.jsonl", "e.jsonl")]
    got = {r.id: r.parent_id for r in catalog.parent_by_header_path(spark.createDataFrame(rows, "id string, source_path string, parent_path string")).collect()}
    assert got == {"p": None, "c": "p", "d": "p", "e": None}
