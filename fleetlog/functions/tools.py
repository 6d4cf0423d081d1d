"""What a tool call is, what it touched and how it ended."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical tools with their category, label and other names.
TOOLS = {
    "Bash": ("shell", "Bash", ["Shell", "shell", "bash", "exec", "exec_command", "shell_command", "run_shell_command", "run_in_terminal", "run_terminal_command", "run_terminal_cmd", "write_stdin", "Monitor", "LocalShellCall", "run_command", "AwaitShell"]),
    "Read": ("file", "Read", ["read", "ReadFile", "read_file", "view", "view_file"]),
    "Write": ("file", "Write", ["write", "WriteFile", "write_file", "create", "write_to_file"]),
    "Edit": ("file", "Edit", ["edit", "edit_file", "replace", "StrReplace", "str_replace", "search_replace", "StrReplaceFile", "ApplyPatch", "Apply_patch", "MultiEdit", "str_replace_editor", "apply_patch", "EditNotebook", "replace_file_content", "multi_replace_file_content"]),
    "Delete": ("file", "Delete", ["delete"]),
    "Grep": ("search", "Grep", ["grep", "rg", "Search", "SemanticSearch", "grep_search", "search_file_content"]),
    "Glob": ("search", "Glob", ["glob", "file_search", "ReadFolder", "list_directory", "list", "list_dir", "ls", "find", "find_by_name"]),
    "Agent": ("agent", "Agent", ["Task", "task", "Subagent", "subagent", "AgentSwarm", "agent", "read_agent", "spawn_agent", "spawn_subagent", "wait_agent", "send_input", "close_agent", "invoke_subagent", "define_subagent"]),
    "SendMessage": ("agent", "send message", ["send_message"]),
    "FollowupTask": ("task", "followup task", ["followup_task"]),
    "ListAgents": ("agent", "list agents", ["list_agents"]),
    "TaskCreate": ("task", "task create", []),
    "TaskUpdate": ("task", "task update", []),
    "TaskList": ("task", "task list", ["task_query"]),
    "TaskOutput": ("task", "task output", ["get_task_output", "get_command_or_subagent_output", "task_output"]),
    "TaskStop": ("task", "task stop", ["kill_task"]),
    "Workflow": ("tool", "workflow", []),
    "StructuredOutput": ("tool", "structured output", []),
    "Plan": ("plan", "Plan", ["update_plan", "TodoWrite", "TodoList", "todo", "todowrite", "todo_write", "EnterPlanMode", "ExitPlanMode", "enter_plan_mode", "exit_plan_mode", "manage_task"]),
    "AskUserQuestion": ("interaction", "ask user", ["request_user_input", "ask_user", "question"]),
    "RequestPermissions": ("interaction", "request permissions", ["request_permissions", "ask_permission", "list_permissions"]),
    "ScheduleWakeup": ("cron", "schedule wakeup", ["schedule"]),
    "CronCreate": ("cron", "cron create", []),
    "CronList": ("cron", "cron list", []),
    "CronDelete": ("cron", "cron delete", []),
    "Lint": ("tool", "Lint", ["ReadLints"]),
    "WebFetch": ("web", "web fetch", ["web_fetch", "webfetch", "FetchURL", "read_url_content"]),
    "WebSearch": ("web", "web search", ["web_search", "web_search_call", "websearch", "search_web", "x_search", "x_semantic_search", "x_keyword_search", "x_thread_fetch", "x_user_search", "XSearch"]),
    "ImageGeneration": ("media", "image generation", ["image_generation_call", "image_generation_end", "image_gen", "ImageGen", "image_to_video", "reference_to_video", "image_edit"]),
    "DynamicTool": ("tool", "dynamic tool", ["dynamic_tool_call", "dynamic_tool_call_request", "dynamic_tool_call_response", "load_workspace_dependencies", "install_workspace_dependencies"]),
    "JavaScript": ("tool", "node repl", ["js", "js_add_node_module_dir", "js_reset"]),
    "ReadMediaFile": ("media", "read media file", ["view_image"]),
    "ComputerUse": ("tool", "computer use", ["get_app_state", "list_apps", "click", "press_key", "scroll", "drag", "type_text", "set_value", "select_text", "perform_secondary_action"]),
    "CreateGoal": ("goal", "create goal", ["create_goal"]),
    "GetGoal": ("goal", "get goal", ["get_goal"]),
    "SetGoalBudget": ("goal", "set goal budget", ["set_goal_budget"]),
    "UpdateGoal": ("goal", "update goal", ["update_goal"]),
    "ToolSearch": ("search", "tool search", ["codesearch"]),
    "ListMcpResourcesTool": ("search", "list mcp resources", ["list_mcp_resources", "list_mcp_resource_templates", "read_mcp_resource"]),
    "Skill": ("skill", "skill", ["skill"]),
    "SQL": ("database", "SQL", ["sql"]),
}
SERVER_TOOL = "^mcp__(.*?)__(.*)$"


def tool_names(spark: SparkSession) -> DataFrame:
    """(raw, canonical, category, label), one row for each name; the first tool that has a name keeps it."""
    rows = {}
    for canonical, (category, label, others) in TOOLS.items():
        for raw in [canonical, *others]:
            rows.setdefault(raw, (raw, canonical, category, label))
    return spark.createDataFrame(list(rows.values()), "raw string, canonical string, category string, label string")


def with_tools(calls: DataFrame, agent_provider: str | None = None) -> DataFrame:
    """Adds canonical, category and display to rows with tool_name (and provider): server tools by their own names, `agent_provider` counts any name with agent as Agent, unknown names stay."""
    names = tool_names(calls.sparkSession)
    raw = F.col("tool_name")
    key = raw if agent_provider is None else F.when((F.col("provider") == agent_provider) & raw.rlike("[Aa]gent"), "Agent").otherwise(raw)
    # One row for each known name: a fixed size.
    joined = calls.withColumn("_key", key).join(F.broadcast(names.withColumnRenamed("raw", "_key")), "_key", "left")
    server = raw.startswith("mcp__") | raw.startswith("chat-")
    display = F.when(raw.rlike(SERVER_TOOL), F.replace(F.regexp_extract(raw, SERVER_TOOL, 2), F.lit("_"), F.lit(" "))).otherwise(F.coalesce("label", raw))
    return joined.select(*calls.columns, F.coalesce("canonical", raw).alias("canonical"), F.when(server, "mcp").otherwise(F.coalesce("category", F.lit("unknown"))).alias("category"), display.alias("display"))


def server_name(raw: str) -> Column:
    """(server, tool) of a server tool's name; null for others."""
    return F.when(F.col(raw).rlike(SERVER_TOOL), F.struct(F.regexp_extract(raw, SERVER_TOOL, 1).alias("server"), F.regexp_extract(raw, SERVER_TOOL, 2).alias("tool")))


def field(json: str, *names: str) -> Column:
    """The first of the fields that is there."""
    return F.coalesce(*[F.get_json_object(json, f"$.{n}") for n in names])


def tool_target(canonical: str, json: str) -> Column:
    """What a call touched: file, command, pattern, task."""
    c = F.col(canonical)
    home = lambda x: F.regexp_replace(F.regexp_replace(x, r"^([A-Za-z]:)?/Users/[^/]+", "~"), r"^/home/[^/]+", "~")
    path = field(json, "path", "dir_path", "SearchPath")
    return (
        F.when(c.isin("Read", "Write", "Edit"), home(field(json, "file_path", "filePath", "path", "AbsolutePath", "TargetFile")))
        .when(c == "Bash", field(json, "description", "command", "cmd", "CommandLine"))
        .when(c == "Grep", F.concat(F.lit("/"), field(json, "pattern", "query", "Query"), F.lit("/"), F.coalesce(F.concat(F.lit(" "), home(path)), F.lit(""))))
        .when(c == "Glob", field(json, "pattern", "dir_path", "path", "DirectoryPath"))
        .when(c.isin("Agent", "SendMessage", "FollowupTask"), field(json, "description", "prompt", "message", "content"))
        .when(c == "TaskCreate", field(json, "subject", "description"))
    )


def has(json: str, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}").isNotNull()


def fields_of(json: str) -> Column:
    """The top-level fields of a JSON object as a map of texts, by the rules of get_json_object; null for other texts. A text is parsed once, where each get_json_object parses it anew."""
    parsed = F.from_json(json, "map<string,string>", {"allowUnquotedControlChars": "true", "allowNonNumericNumbers": "false"})
    # A name that is there twice has the first value that isn't null.
    return F.map_filter(parsed, lambda _, value: value.isNotNull())


def _over_fields(json: str, fields: str | None, made: Callable[[Column], Column]) -> Column:
    """made(map of the fields): of the column that has it, else of the text, parsed once."""
    return made(F.col(fields)) if fields is not None else F.transform(F.array(fields_of(json)), made)[0]


def _there(fields: Column, json: str, name: str) -> Column:
    """Whether a field, or one inside a field, isn't null; only a text whose outer field is there is searched for an inner one."""
    outer, _, inner = name.partition(".")
    found = fields[outer].isNotNull()
    return found & has(json, name) if inner else found


def tool_status(json: str, is_error: str, status: str, fields: str | None = None) -> Column:
    """How a call ended. `fields` names a column with fields_of() the text, if there is one."""
    return _over_fields(json, fields, lambda own: (
        F.when(F.coalesce(F.col(is_error), F.lit(False)), "error").when(F.col(status).isNotNull(), F.col(status)).when(own["status"].isNotNull(), own["status"])
        .when(own["interrupted"] == "true", "interrupted").when(own["success"] == "true", "success").when(own["success"] == "false", "error").otherwise("success")
    ))


# Fields of a result that tell its kind, and tools whose results are of one kind. Earlier rules come first.
RESULT_FIELDS = {
    "persisted_output": ["persistedOutputPath", "outputPath", "metadata.outputPath"],
    "file_patch": ["structuredPatch", "patch", "patches", "fileDiff", "diff", "filediff", "metadata.diff", "metadata.filediff", "resultDisplay.fileDiff"],
    "terminal_output": ["stdout", "stderr", "exitCode"],
    "agent_summary": ["agentId", "agent_id"],
    "task_status": ["task", "taskId", "task_id", "tasks"],
}
RESULT_TOOLS = {
    "search_result": ["ToolSearch"],
    "web_result": ["WebSearch", "WebFetch"],
    "interaction_result": ["AskUserQuestion", "RequestPermissions"],
    "schedule_result": ["ScheduleWakeup", "CronCreate", "CronList", "CronDelete"],
    "goal_status": ["CreateGoal", "GetGoal", "SetGoalBudget", "UpdateGoal"],
    "tool_output": ["DynamicTool", "JavaScript", "ComputerUse", "Workflow", "StructuredOutput", "Skill", "SendMessage"],
}


def tool_result_kind(canonical: str, category: str, json: str, fields: str | None = None) -> Column:
    """The kind of a result: a server tool's and an image's by the tool alone; else, if there is a result, by the first rule on its fields, then by the tool. `fields` as in tool_status()."""
    tool = F.col(canonical)

    def kind_of(own: Column) -> Column:
        there = lambda n: _there(own, json, n)
        # What counts beside the fields of a kind.
        also = {
            "file_patch": [there("oldString") & there("newString"), there("old_string") & there("new_string"), (tool == "Edit") & (there("output") | there("message"))],
            "terminal_output": [(tool == "Bash") & there("output")],
        }
        rules = [(F.col(category) == "mcp", "mcp"), (tool == "ImageGeneration", "image"), (F.col(json).isNull(), None)]
        rules += [(reduce(or_, [*map(there, names), *also.get(kind, [])]), kind) for kind, names in RESULT_FIELDS.items()]
        rules += [(tool.isin(names), kind) for kind, names in RESULT_TOOLS.items()]
        # Of the rules that hold, the first; those after it are not worked out.
        return reduce(lambda earlier, rule: earlier.when(rule[0], F.lit(rule[1]).cast("string")), rules, F)

    return _over_fields(json, fields, kind_of)


def structured_ids(json: str) -> Column:
    """agentId, taskId and the persisted path of a result, from their own fields or the older ones."""
    return F.struct(field(json, "agentId", "agent_id", "teammate_id", "new_thread_id", "sub_session_id").alias("agentId"), field(json, "taskId", "task_id").alias("taskId"), field(json, "persistedOutputPath", "outputPath", "metadata.outputPath").alias("persistedOutputPath"))


def orphan_tool_name(json: str, call_id: str, fields: str | None = None) -> Column:
    """The tool of a result without a call, by its fields; else the call's id. `fields` as in tool_status()."""
    def name_of(own: Column) -> Column:
        h = lambda n: _there(own, json, n)
        return (
            F.when(h("commandName") & h("allowedTools"), "SlashCommand").when(h("oldString") & h("newString"), "Edit").when(h("stdout") | h("stderr"), "Bash").when(h("matches") & h("total_deferred_tools"), "ToolSearch")
            .when(h("taskId") & h("updatedFields"), "TaskUpdate").when(h("task"), "TaskCreate").when(h("agentId"), "Agent").when(h("url") & h("durationMs"), "WebFetch").when(h("filePath"), "Write").otherwise(F.coalesce(F.col(call_id), F.lit("UnknownToolResult")))
        )

    return _over_fields(json, fields, name_of)


def usage_fields(json: str, paths: dict[str, list[str]]) -> Column:
    """A struct of counters, each from the first of its paths; null if none is there at all."""
    found = {k: F.coalesce(*[F.get_json_object(json, p) for p in ps]).try_cast("long") for k, ps in paths.items()}
    nothing = F.coalesce(*found.values()).isNull()
    return F.when(~nothing, F.struct(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in found.items()]))


def block_log_usage(json: str) -> Column:
    """Counters of a content-array log: the cache write is the larger of the flat number and its parts; all zero is null."""
    n = lambda p: F.coalesce(F.get_json_object(json, f"$.{p}").try_cast("long"), F.lit(0))
    write = F.greatest(n("cache_creation_input_tokens"), n("cache_creation.ephemeral_5m_input_tokens") + n("cache_creation.ephemeral_1h_input_tokens"))
    made = [n("input_tokens").alias("input"), n("output_tokens").alias("output"), n("cache_read_input_tokens").alias("cache_read"), write.alias("cache_write")]
    return F.when(n("input_tokens") + n("output_tokens") + n("cache_read_input_tokens") + write > 0, F.struct(*made))


def relational_usage(json: str) -> Column:
    """Input and output are required, reasoning counts as output; a bad number is null."""
    n = lambda p: F.get_json_object(json, f"$.{p}").try_cast("long")
    return F.when(n("input").isNotNull() & n("output").isNotNull(), F.struct(n("input").alias("input"), (n("output") + F.coalesce(n("reasoning"), F.lit(0))).alias("output"), F.coalesce(n("cache.read"), F.lit(0)).alias("cache_read"), F.coalesce(n("cache.write"), F.lit(0)).alias("cache_write")))


def split_input(total: str, cached: str, created: str | None = None, clamp: bool = False) -> Column:
    """Uncached input: what is left of the total; a negative rest is null, or with `clamp` the cached part is cut to the total."""
    if clamp:
        return F.col(total) - F.least(F.col(cached), F.col(total))
    rest = F.col(total) - F.col(cached) - (F.col(created) if created else F.lit(0))
    return F.when(rest >= 0, rest)
