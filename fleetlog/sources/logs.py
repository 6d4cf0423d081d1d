"""Logs of many formats to lines, and lines to messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tools import block_log_usage


@dataclass(frozen=True)
class LogFormat:
    """Where a family of logs lies; `torn_tail` ignores a last line without newline."""

    provider: str
    glob: str = "*.jsonl"
    torn_tail: bool = False


def discover_logs(spark: SparkSession, root: str, fmt: LogFormat) -> DataFrame:
    """(provider, source_path, size, mtime) of all logs below the folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", fmt.glob).load(root)
    return files.select(F.lit(fmt.provider).alias("provider"), F.col("path").alias("source_path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def prefer_active_copy(files: DataFrame) -> DataFrame:
    """Of copies with one relative path that in the root of the lowest rank; files have (rel_path, root_rank, source_path)."""
    first = Window.partitionBy("rel_path").orderBy("root_rank", "source_path")
    return files.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def stale_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose size or mtime differs from what is known; an mtime of 0 is always read again."""
    same = known.where("mtime <> 0").select("source_path", "size", "mtime")
    return listing.join(same, ["source_path", "size", "mtime"], "left_anti")


def unchanged_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    return listing.join(known.where("mtime <> 0").select("source_path", "size", "mtime"), ["source_path", "size", "mtime"], "left_semi")


def stale_by_title(listing: DataFrame, known: DataFrame, titles: DataFrame) -> DataFrame:
    """Stale files, and unchanged ones whose side-file title differs from the stored one (a null stored title is the user's own and stays)."""
    kept = unchanged_files(listing, known).join(known.select("source_path", "session_id", F.col("title").alias("_stored")), "source_path").join(titles.select("session_id", F.col("title").alias("_now")), "session_id")
    changed = kept.where("_stored is not null and _now <> _stored").select(listing.columns)
    return stale_files(listing, known).unionByName(changed)


def known_sources(sessions: DataFrame, provider: str) -> DataFrame:
    """One row for each path, of the main session before side chains; a custom title counts as null."""
    first = Window.partitionBy("source_path").orderBy("is_sidechain", "id")
    ranked = sessions.where(F.col("provider") == provider).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return ranked.select("source_path", "size", "mtime", F.col("id").alias("session_id"), F.when(~F.col("title_custom"), F.col("title")).alias("title"))


def checked(lines: DataFrame) -> DataFrame:
    """Lines (source_path, line_no, raw) that aren't blank, with `malformed`."""
    return lines.where(F.trim("raw") != "").select("source_path", "line_no", "raw", F.expr("try_parse_json(raw) is null").alias("malformed"))


def read_log_lines(spark: SparkSession, paths: str | list[str], torn_tail: bool = False) -> DataFrame:
    """(source_path, line_no from 1, raw, malformed): lines that aren't blank; with `torn_tail` a last line without newline is left out.

    Large files are read in blocks. Lines are numbered by their place in a block and the lines of the blocks before it.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("at"),
    )
    # A row for each block of a file.
    before = Window.partitionBy("source_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_path")
    blocks = lines.groupBy("source_path", "block", "size").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("raw") + 1).alias("bytes"))
    blocks = blocks.select(F.col("source_path").alias("_path"), F.col("block").alias("_block"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done"), F.sum("n").over(whole).alias("last"), (F.sum("bytes").over(whole) > F.col("size")).alias("torn"))
    numbered = lines.join(blocks, (F.col("source_path") == F.col("_path")) & (F.col("block") == F.col("_block"))).withColumn("line_no", (F.col("done") + F.col("at") - F.col("first") + 1).cast("long"))
    return checked(numbered.where(~(F.col("torn") & (F.col("line_no") == F.col("last")))) if torn_tail else numbered)


def write_logs(lines: DataFrame, folder: str) -> None:
    """Writes lines (log, line_no, raw) as a file for each log, in order."""
    dealt = lines.repartition("log").sortWithinPartitions("log", "line_no")
    dealt.select(F.col("raw").alias("value"), "log").write.partitionBy("log").text(folder)


def malformed_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("source_path").agg(F.count_if("malformed").alias("malformed"), F.count("*").alias("lines"))


BLOCK = "struct<type: string, timestamp: string, requestId: string, sessionId: string, cwd: string, version: string, gitBranch: string, isSidechain: boolean, isMeta: boolean, message: struct<role: string, model: string, id: string, content: string, usage: string>>"
PART = "array<struct<type: string, text: string, thinking: string, id: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean>>"


def normalize_block_log(lines: DataFrame) -> DataFrame:
    """(source_path, line_no, part, role, content, tool_name, tool_input, call_id, is_error, usage, model, ts) of a content-array log.

    Of a line, thinking becomes a system row, runs of text parts one row of the line's role, a tool use a tool row and a tool result a result row; other parts are `unknown`.
    """
    parsed = lines.where("not malformed").withColumn("j", F.from_json("raw", BLOCK)).where("j.type in ('user', 'assistant')")
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("j.message.content").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("thinking", "string"), ("id", "string"), ("name", "string"), ("input", "string"), ("tool_use_id", "string"), ("content", "string"), ("is_error", "boolean"))]))
    parts = F.when(F.startswith(F.ltrim("j.message.content"), F.lit("[")), F.from_json("j.message.content", PART)).otherwise(plain)
    each = parsed.select("source_path", "line_no", "j", F.posexplode(parts).alias("part", "p"))
    line = Window.partitionBy("source_path", "line_no").orderBy("part")
    was = F.coalesce(F.lag("p.type").over(line), F.lit(""))
    runs = each.withColumn("_was", was).withColumn("run", F.sum(F.when((F.col("p.type") == "text") & (F.col("_was") == "text"), 0).otherwise(1)).over(line))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", F.col("p.text").alias("t")))), lambda x: x["t"]), "\n")
    rows = runs.groupBy("source_path", "line_no", "run").agg(F.first("j").alias("j"), F.min("part").alias("part"), F.min_by("p", "part").alias("p"), ordered.alias("text"))
    kind = F.col("p.type")
    role = F.when(kind == "thinking", "system").when(kind == "text", F.col("j.message.role")).when(kind == "tool_use", "tool").when(kind == "tool_result", "result").otherwise("unknown")
    return rows.select(
        "source_path", "line_no", "part", role.alias("role"), F.when(kind == "text", F.col("text")).when(kind == "thinking", F.col("p.thinking")).otherwise(F.col("p.content")).alias("content"),
        F.col("p.name").alias("tool_name"), F.col("p.input").alias("tool_input"), F.coalesce("p.id", "p.tool_use_id").alias("call_id"), F.col("p.is_error").alias("is_error"),
        block_log_usage("j.message.usage").alias("usage"), F.col("j.message.model").alias("model"), F.try_to_timestamp("j.timestamp").alias("ts"),
    )


ENVELOPE = "struct<type: string, timestamp: string, payload: struct<id: string, forked_from_id: string, cwd: string, model: string, type: string, role: string, content: string, name: string, call_id: string, arguments: string, output: string, message: string, started_at: bigint, info: string>>"
COUNTS = "struct<last_token_usage: struct<input_tokens: bigint, cached_input_tokens: bigint, output_tokens: bigint>, total_token_usage: struct<input_tokens: bigint, cached_input_tokens: bigint, output_tokens: bigint>, model: string>"


def normalize_event_log(lines: DataFrame) -> DataFrame:
    """(source_path, line_no, kind, role, content, tool_name, call_id, model, last and total counters) of an envelope log; kinds it doesn't know are `unknown`."""
    j = lines.where("not malformed").withColumn("j", F.from_json("raw", ENVELOPE)).withColumn("c", F.from_json("j.payload.info", COUNTS))
    kind = F.when(F.col("j.type").isin("session_meta", "turn_context", "compacted"), F.col("j.type")).when(F.col("j.type") == "response_item", F.col("j.payload.type")).when(F.col("j.type") == "event_msg", F.col("j.payload.type")).otherwise("unknown")
    role = F.when(kind == "message", F.col("j.payload.role")).when(kind == "function_call", "tool").when(kind == "function_call_output", "result").when(kind == "user_message", "user")
    body = F.array_join(F.transform(F.from_json("j.payload.content", "array<struct<text: string>>"), lambda x: x["text"]), "\n")
    return j.select(
        "source_path", "line_no", kind.alias("kind"), role.alias("role"), F.coalesce(body, "j.payload.message", "j.payload.output").alias("content"), F.col("j.payload.name").alias("tool_name"), F.col("j.payload.call_id").alias("call_id"), F.col("j.payload.model").alias("model"),
        *[F.col(f"c.{w}_token_usage.{n}").alias(f"{w}_{n}") for w in ("last", "total") for n in ("input_tokens", "cached_input_tokens", "output_tokens")], F.col("c.model").alias("info_model"),
    )


WIRE = "struct<type: string, time: bigint, message: struct<role: string, content: string>, event: struct<type: string, part: struct<type: string, text: string, think: string>, toolCallId: string, name: string, args: string, result: string>, usage: struct<inputOther: bigint, output: bigint, inputCacheRead: bigint, inputCacheCreation: bigint>, model: string, usageScope: string>"


def normalize_wire_log(lines: DataFrame) -> DataFrame:
    """Rows of a loop-event log: prompts, content parts, tool calls and results, step usages and closing records."""
    j = lines.where("not malformed").withColumn("j", F.from_json("raw", WIRE))
    kind = F.when(F.col("j.type") == "context.append_loop_event", F.col("j.event.type")).otherwise(F.col("j.type"))
    role = F.when(kind == "content.part", F.when(F.col("j.event.part.type") == "think", "system").otherwise("assistant")).when(kind == "tool.call", "tool").when(kind == "tool.result", "result").when(kind == "turn.prompt", "user").when(kind == "context.append_message", F.col("j.message.role"))
    return j.select("source_path", "line_no", kind.alias("kind"), role.alias("role"), F.coalesce("j.event.part.text", "j.event.part.think", "j.event.result", "j.message.content").alias("content"), F.col("j.event.name").alias("tool_name"), F.col("j.event.toolCallId").alias("call_id"), F.col("j.time").alias("ts_ms"), F.col("j.usage").alias("usage"), F.col("j.usageScope").alias("scope"), F.col("j.model").alias("model"))


UPDATE = "struct<timestamp: bigint, params: struct<update: struct<sessionUpdate: string, toolCallId: string, status: string, title: string, rawInput: string, rawOutput: string, _meta: struct<promptIndex: bigint>>>>"


def fold_updates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of an update stream: the time of each prompt's first chunk, and each tool's state, in which the last value that isn't null wins."""
    u = lines.where("not malformed").withColumn("j", F.from_json("raw", UPDATE)).select("source_path", "line_no", F.col("j.timestamp").alias("ts"), "j.params.update.*")
    prompts = u.where("sessionUpdate = 'user_message_chunk'").groupBy("source_path", F.col("_meta.promptIndex").alias("prompt_index")).agg(F.min_by("ts", "line_no").alias("ts"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    tools = u.where("toolCallId is not null").groupBy("source_path", "toolCallId").agg(last("status"), last("title"), last("rawInput"), last("rawOutput"))
    return prompts, tools


def normalize_update_log(transcript: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows (session_id, line_no, type, content, prompt_index, call_id) of a transcript with what its update stream knows: user rows get the time of their prompt's first chunk, rows with a call id the state of their tool.

    `updates` are lines of update streams, of which source_path names the session.
    """
    prompts, tools = fold_updates(updates)
    prompts = prompts.select(F.col("source_path").alias("session_id"), "prompt_index", "ts")
    tools = tools.select(F.col("source_path").alias("session_id"), F.col("toolCallId").alias("call_id"), "status", "title", F.col("rawInput").alias("tool_input"), F.col("rawOutput").alias("tool_output"))
    timed = transcript.join(prompts, ["session_id", "prompt_index"], "left").withColumn("ts", F.when(F.col("type") == "user", F.col("ts")))
    return timed.join(tools, ["session_id", "call_id"], "left").select("session_id", "line_no", "type", "content", "prompt_index", "call_id", "ts", "status", "title", "tool_input", "tool_output")


def normalize_relational(session: DataFrame, project: DataFrame, workspace: DataFrame, message: DataFrame, part: DataFrame, texts: int = 50) -> DataFrame:
    """Sessions of a relational log: number of messages, the first `texts` text parts in time order, the model of an assistant message, the project's path unless it isn't there, the branch."""
    counts = message.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages"), F.max(F.when(F.get_json_object("data", "$.role") == "assistant", F.get_json_object("data", "$.modelID"))).alias("model"))
    first = Window.partitionBy("session_id").orderBy("time_created", "message_id")
    body = part.where(F.get_json_object("data", "$.type") == "text").withColumn("n", F.row_number().over(first)).where(F.col("n") <= texts)
    body = body.groupBy(F.col("session_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.get_json_object("data", "$.text").alias("t")))), lambda x: x["t"]), "\n").alias("content_text"))
    named = project.select(F.col("id").alias("project_id"), "worktree", F.col("name").alias("project_name"))
    joined = session.join(named, "project_id", "left").join(workspace.select(F.col("id").alias("workspace_id"), "branch"), "workspace_id", "left").join(counts, "id", "left").join(body, "id", "left")
    path = F.when((F.coalesce("directory", F.lit("")) == "") & (F.col("worktree") != "/"), F.col("worktree")).otherwise(F.col("directory"))
    return joined.select("id", "title", path.alias("project_path"), "project_name", "branch", F.coalesce("messages", F.lit(0)).alias("messages"), "model", F.coalesce("content_text", F.lit("")).alias("content_text"))


def migrate_legacy_ids(entries: DataFrame) -> DataFrame:
    """Entries (source_path, line_no, version, id, parent_id, role): version 1 gets ids by line and the entry before as parent, before 3 one role has another name, above 3 is dropped."""
    own = F.when(F.col("version") == 1, F.format_string("legacy-%08d", F.col("line_no") - 2)).otherwise(F.col("id"))
    named = entries.where("version <= 3").withColumn("id", own)
    before = F.lag("id").over(Window.partitionBy("source_path").orderBy("line_no"))
    return named.withColumn("parent_id", F.when(F.col("version") == 1, before).otherwise(F.col("parent_id"))).withColumn("role", F.when((F.col("version") < 3) & (F.col("role") == "hookMessage"), "custom").otherwise(F.col("role")))


def sidecar_titles(lines: DataFrame) -> DataFrame:
    """(session_id, title) of an index of JSON lines; the last line of an id counts."""
    rows = lines.where("not malformed").select("line_no", F.get_json_object("raw", "$.id").alias("session_id"), F.get_json_object("raw", "$.thread_name").alias("title")).where("session_id is not null")
    return rows.groupBy("session_id").agg(F.max_by("title", "line_no").alias("title"))
