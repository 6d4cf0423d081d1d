"""Spawned agents: what a call says about its children, and texts of system events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import field


def system_event_text(json: str) -> Column:
    """A line for each known subtype of a system event; null for others."""
    n = lambda p: F.coalesce(F.get_json_object(json, f"$.{p}").try_cast("double"), F.lit(0.0))
    whole = lambda p: n(p).cast("long").cast("string")
    tenths = lambda x: F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))
    sub, note = F.get_json_object(json, "$.subtype"), F.coalesce(F.get_json_object(json, "$.content"), F.lit(""))
    noted = lambda tag: F.when(F.trim(note) == "", f"[{tag}]").otherwise(F.concat(F.lit(f"[{tag}] "), note))
    before = n("compactMetadata.preTokens")
    hooks = F.from_json(F.get_json_object(json, "$.hookInfos"), "array<struct<command: string, durationMs: bigint>>")
    hook = F.array_join(F.transform(F.coalesce(hooks, F.array().cast("array<struct<command: string, durationMs: bigint>>")), lambda h: F.concat(F.coalesce(h["command"], F.lit("unknown")), F.lit(" ("), F.coalesce(h["durationMs"], F.lit(0)).cast("string"), F.lit("ms)"))), ", ")
    return (
        F.when(sub == "turn_duration", F.concat(F.lit("[turn_duration] "), tenths(n("durationMs") / 1000), F.lit("s, "), whole("messageCount"), F.lit(" messages")))
        .when(sub == "compact_boundary", F.concat(F.lit("[compact_boundary] "), F.when(before < 1000, before.cast("long").cast("string")).otherwise(F.concat(tenths(before / 1000), F.lit("k"))), F.lit(" tokens")))
        .when(sub == "microcompact_boundary", F.concat(F.lit("[microcompact_boundary] "), tenths(n("microcompactMetadata.preTokens") / 1000), F.lit("k tokens saved "), tenths(n("microcompactMetadata.tokensSaved") / 1000), F.lit("k")))
        .when(sub == "stop_hook_summary", F.concat(F.lit("[stop_hook_summary] "), whole("hookCount"), F.lit(" hooks: "), hook))
        .when(sub == "api_error", F.concat(F.lit("[api_error] "), F.coalesce(F.get_json_object(json, "$.cause.code"), F.lit("Unknown")), F.lit(" (retry "), whole("retryAttempt"), F.lit("/"), whole("maxRetries"), F.lit(")")))
        .when(sub == "away_summary", noted("away_summary")).when(sub == "scheduled_task_fire", noted("scheduled_task_fire"))
    )


def subagent_info(calls: DataFrame, input_col: str = "tool_input", output_col: str = "content", meta_col: str = "structured") -> DataFrame:
    """Adds nickname, description, agent_id and child_ids to agent calls, each by its order of sources."""
    suffix = lambda c: F.regexp_replace(c, "@session-.*$", "")
    by_text = F.nullif(F.regexp_extract(F.coalesce(output_col, F.lit("")), r"(?m)^agent_id:\s*(\S+)", 1), F.lit(""))
    targets = F.from_json(F.get_json_object(input_col, "$.targets"), "array<string>")
    one_target = F.when(F.size(targets) == 1, targets[0])
    ids = F.filter(F.from_json(F.get_json_object(meta_col, "$.childConversationIds"), "array<string>"), lambda x: x != "")
    return calls.withColumns({
        "nickname": F.coalesce(F.get_json_object(output_col, "$.nickname"), suffix(F.nullif(field(output_col, "name", "teammate_id"), F.lit("")))),
        "description": field(input_col, "description", "prompt", "message"),
        "agent_id": F.coalesce(by_text, F.get_json_object(meta_col, "$.agentId"), field(input_col, "target", "agent_id", "agentId"), one_target),
        "child_ids": F.when(F.size(ids) > 0, ids),
    })


def child_titles(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(child_id, title): a spawning call's description goes to the agents that its result lists, as `agent_id:` lines or as tags that didn't fail, whose `item` beats the description; the first result of a child counts."""
    described = calls.select("session_id", "call_id", field("tool_input", "description").alias("description"))
    joined = results.join(described, ["session_id", "call_id"])
    lines = joined.select("line_no", "description", F.explode(F.regexp_extract_all("output", F.lit(r"(?m)^agent_id:\s*(\S+)"), F.lit(1))).alias("child_id"))
    tags = joined.select("line_no", "description", F.explode(F.regexp_extract_all("output", F.lit(r"<subagent [^>]*>"), F.lit(0))).alias("tag")).where("tag not like '%outcome=\"failed\"%'")
    tags = tags.select("line_no", F.coalesce(F.nullif(F.regexp_extract("tag", 'item="([^"]*)"', 1), F.lit("")), F.col("description")).alias("description"), F.regexp_extract("tag", 'agent_id="([^"]*)"', 1).alias("child_id"))
    return lines.select("line_no", "description", "child_id").unionByName(tags).where("child_id <> ''").groupBy("child_id").agg(F.min_by("description", "line_no").alias("title"))
