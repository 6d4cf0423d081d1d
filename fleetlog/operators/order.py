"""Operators that follow the order of messages in a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import before
from .usage import COUNTERS, total


def by_session(*order: str):
    return Window.partitionBy("session_id").orderBy(*(order or ("msg_index",)))


def renderable(role: str = "role", content: str = "content", tool: str = "tool_name") -> Column:
    """Tool rows with a name that isn't a bare call id, or content; others with content that isn't blank."""
    text = F.trim(F.coalesce(content, F.lit(""))) != ""
    named = F.coalesce(F.col(tool), F.lit(""))
    return F.when(F.col(role) == "tool", (text | (named != "")) & ~named.startswith("toolu_")).otherwise(text)


def dedup_replayed_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The first line of each key in a file; lines with a null in their key all stay."""
    nothing = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    first = Window.partitionBy("source_path", *keys).orderBy("line_no")
    return lines.withColumn("_n", F.when(nothing, 1).otherwise(F.row_number().over(first))).where("_n = 1").drop("_n")


def session_attributes(lines: DataFrame) -> DataFrame:
    """One row for each session: first cwd, version and model that aren't empty, first branch that isn't HEAD, sidechain if any, first and last timestamp in line order."""
    def first(c: str, unless: str = "") -> Column:
        return F.min_by(c, F.when((F.col(c) != "") & (F.col(c) != unless), F.col("line_no"))).alias(c)

    at = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    return lines.groupBy("session_id").agg(first("cwd"), first("version"), first("model"), first("git_branch", "HEAD"), F.bool_or("is_sidechain").alias("is_sidechain"), F.min_by("ts", at).alias("first_ts"), F.max_by("ts", at).alias("last_ts"))


def resolve_title(lines: DataFrame) -> DataFrame:
    """custom, then ai title (last values), agent name, first user text, first summary; rows (session_id, line_no, type, value)."""
    def pick(kind: str, which) -> Column:
        return which("value", F.when((F.col("type") == kind) & (F.col("value") != ""), F.col("line_no")))

    return lines.groupBy("session_id").agg(F.coalesce(pick("custom-title", F.max_by), pick("ai-title", F.max_by), pick("agent-name", F.max_by), pick("user", F.min_by), pick("summary", F.min_by), F.lit("Untitled")).alias("title"))


def mode_changes(rows: DataFrame, mode: str = "mode", seed: str = "normal") -> DataFrame:
    """Rows whose mode differs from the one last seen; sessions start in `seed`."""
    seen = rows.where(F.col(mode).isNotNull())
    return seen.withColumn("_was", F.lag(mode, 1, seed).over(by_session())).where(F.col(mode) != F.col("_was")).drop("_was")


def attach_turn_usage(rows: DataFrame) -> DataFrame:
    """Usage of a turn (on any of its rows) goes to its last row that isn't a system row; a turn without one gets an empty assistant row after its rows."""
    turn = Window.partitionBy("session_id", "turn")
    usage = [F.max(c).over(turn).alias(c) for c in COUNTERS]
    target = F.max(F.when(F.col("role") != "system", F.col("msg_index"))).over(turn)
    known = rows.select("session_id", "turn", "msg_index", "role", "content", *usage, target.alias("_at"))
    own = known.select("session_id", "turn", "msg_index", "role", "content", *[F.when(F.col("msg_index") == F.col("_at"), F.col(c)).alias(c) for c in COUNTERS])
    empty = known.where("_at is null and input_tokens is not null").groupBy("session_id", "turn").agg((F.max("msg_index") + 0.5).alias("msg_index"), *[F.max(c).alias(c) for c in COUNTERS])
    empty = empty.select("session_id", "turn", "msg_index", F.lit("assistant").alias("role"), F.lit("").alias("content"), *COUNTERS)
    return own.withColumn("msg_index", F.col("msg_index").cast("double")).unionByName(empty)


def drop_fork_context(rows: DataFrame) -> DataFrame:
    """A child's log repeats its parent's: from the second session_meta on rows are dropped until the first task_started at or after the child's start; token counts and models stay."""
    upto = by_session("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    metas = F.sum(F.when(F.col("type") == "session_meta", 1).otherwise(0)).over(upto)
    start = F.first(F.when(F.col("type") == "session_meta", F.col("started_at")), ignorenulls=True).over(upto)
    begun = F.max(F.when((F.col("type") == "task_started") & (F.col("started_at") >= start), 1).otherwise(0)).over(upto)
    return rows.withColumn("_drop", (metas >= 2) & (begun == 0) & ~F.col("type").isin("token_count", "turn_context")).where("not _drop").drop("_drop")


def rollback_cancelled_turns(rows: DataFrame) -> DataFrame:
    """turn.cancel takes back the messages since the last turn.prompt; usage rows stay."""
    upto = by_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("_turn", F.sum(F.when(F.col("type") == "turn.prompt", 1).otherwise(0)).over(upto))
    last = Window.partitionBy("session_id", "_turn")
    marked = marked.withColumn("_cancel", F.max(F.when(F.col("type") == "turn.cancel", F.col("msg_index"))).over(last))
    gone = (F.col("_turn") > 0) & (F.col("msg_index") <= F.col("_cancel")) & (F.col("type") != "usage.record")
    return marked.where(~F.coalesce(gone, F.lit(False))).drop("_turn", "_cancel")


def splice_compaction(rows: DataFrame, replacements: DataFrame) -> DataFrame:
    """Replacement rows (session_id, content, shadows array of msg_index) take the place of the first row they shadow; shadowed rows go; without a match they are appended."""
    shadows = replacements.select("session_id", F.explode("shadows").alias("msg_index"))
    kept = rows.join(shadows, ["session_id", "msg_index"], "left_anti").select("session_id", F.col("msg_index").cast("double").alias("place"), "content")
    each = replacements.select("session_id", "content", F.explode_outer("shadows").alias("msg_index"))
    hit = each.join(rows.select("session_id", "msg_index", F.lit(True).alias("_hit")), ["session_id", "msg_index"], "left")
    placed = hit.groupBy("session_id", "content").agg(F.min(F.when(F.col("_hit"), F.col("msg_index"))).alias("at"))
    ends = rows.groupBy("session_id").agg(F.max("msg_index").alias("_end"))
    placed = placed.join(ends, "session_id", "left").select("session_id", F.coalesce(F.col("at"), F.col("_end") + 0.5, F.lit(0.0)).cast("double").alias("place"), "content")
    return kept.unionByName(placed)


def merge_tool_runs(rows: DataFrame) -> DataFrame:
    """(session_id, first_index, n, kind): runs of renderable tool rows but Agent's become one row; other rows stand alone."""
    shown = rows.where(renderable())
    tool = (F.col("role") == "tool") & (F.coalesce("tool_name", F.lit("")) != "Agent")
    island = F.row_number().over(by_session()) - F.row_number().over(Window.partitionBy("session_id", "_tool").orderBy("msg_index"))
    marked = shown.withColumn("_tool", tool).withColumn("_island", island).withColumn("_alone", F.when(F.col("_tool"), F.lit(-1)).otherwise(F.col("msg_index")))
    return marked.groupBy("session_id", "_tool", "_island", "_alone").agg(F.min("msg_index").alias("first_index"), F.count("*").alias("n"), F.max("ts_ms").alias("last_ts")).select(
        "session_id", "first_index", "n", F.when(~F.col("_tool"), "message").when(F.col("n") > 1, "merged_tools").otherwise("tool").alias("kind"), "last_ts")


def time_separators(rows: DataFrame, gap_ms: int = 300_000) -> DataFrame:
    """(session_id, msg_index, gap_ms) where a separator stands before the row: more than the gap after the row before it, never first, never before a tool row."""
    shown = rows.where(renderable())
    gap = F.col("ts_ms") - F.lag("ts_ms").over(by_session())
    return shown.withColumn("gap_ms", gap).where((F.col("gap_ms") > gap_ms) & (F.col("role") != "tool")).select("session_id", "msg_index", "gap_ms")


def preview(text: str) -> Column:
    """First 960 characters, whitespace collapsed, then the first 240."""
    return F.substring(F.trim(F.regexp_replace(F.substring(text, 1, 960), r"[ \t\n\r]+", " ")), 1, 240)


def turn_outline(rows: DataFrame) -> DataFrame:
    """(session_id, ordinal, msg_index, prompt, reply): a turn for each user row with text; the reply is the first assistant text before the next turn."""
    text = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"[ \t\n\r]+", " ")) != ""
    start = (F.col("role") == "user") & text
    upto = by_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = rows.withColumn("_start", start).withColumn("ordinal", F.sum(F.col("_start").cast("long")).over(upto) - 1).where("ordinal >= 0")
    own, reply = F.when(F.col("_start"), F.col("msg_index")), F.when((F.col("role") == "assistant") & text, F.col("msg_index"))
    return turns.groupBy("session_id", "ordinal").agg(F.min(own).alias("msg_index"), F.min_by(preview("content"), own).alias("prompt"), F.min_by(preview("content"), reply).alias("reply"))


def session_window(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """`limit` rows from `offset` on; a negative offset counts from the end and shows at least `limit` rows."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    at = F.row_number().over(by_session()) - 1
    start = F.lit(offset) if offset >= 0 else F.greatest(F.lit(0), n - max(-offset, limit))
    marked = rows.withColumn("_at", at).withColumn("_from", F.least(start, n))
    return marked.where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + limit)).drop("_at", "_from")


def token_timeline(rows: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Rows with usage: position, total and running total. Sessions of more than `segment_rows` rows are cut."""
    used = rows.where("input_tokens is not null").withColumn("total", total())
    used = before(used, "msg_index", sums={"position": F.lit(1), "_done": F.col("total")}, segment_rows=segment_rows)
    return used.select("session_id", "msg_index", F.col("position").cast("int").alias("position"), *COUNTERS, "total", (F.col("_done") + F.col("total")).alias("cumulative"))


def token_buckets(timeline: DataFrame, most: int = 44, windows: bool = True) -> DataFrame:
    """The timeline in at most `most` buckets of equal length: sums, and the last running total. Without `windows` the lengths are joined, so that no session is one window partition."""
    if windows:
        sized = timeline.withColumn("_n", F.count("*").over(Window.partitionBy("session_id")))
    else:
        lengths = timeline.groupBy(F.col("session_id").alias("_of")).agg(F.count("*").alias("_n"))
        sized = timeline.join(lengths, F.col("session_id").eqNullSafe(F.col("_of")))
    size = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    sized = sized.withColumn("bucket", F.floor(F.col("position") / size).cast("long"))
    return sized.groupBy("session_id", "bucket").agg(F.count("*").alias("points"), F.sum("total").alias("total"), F.max_by("cumulative", "position").alias("cumulative"))


def peak_point(timeline: DataFrame) -> DataFrame:
    """The point of the largest total, the earliest of equals."""
    return timeline.groupBy("session_id").agg(F.max_by(F.struct("msg_index", "total"), F.struct("total", -F.col("position"))).alias("p")).select("session_id", "p.msg_index", "p.total")


def match_locations(rows: DataFrame, term: str) -> DataFrame:
    """(session_id, msg_index, nth) of each non-overlapping hit in user and assistant rows, lower case."""
    low, t = F.lower(F.coalesce("content", F.lit(""))), term.lower()
    hits = F.floor((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int")
    found = rows.where(F.col("role").isin("user", "assistant")).withColumn("_hits", hits).where("_hits > 0")
    return found.select("session_id", "msg_index", F.explode(F.sequence(F.lit(0), F.col("_hits") - 1)).alias("nth"))


def interleave_notes(messages: DataFrame, notes: DataFrame) -> DataFrame:
    """(session_id, place, kind, content): a note goes before the first timed message at or after it; untimed notes come last. Messages and notes have ts_ms and an index."""
    both = messages.select("session_id", F.lit(1).alias("kind"), "msg_index", "ts_ms", "content").unionByName(notes.select("session_id", F.lit(0).alias("kind"), F.col("note_index").alias("msg_index"), "ts_ms", "content"))
    following = Window.partitionBy("session_id").orderBy("ts_ms", "kind", "msg_index").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    timed = both.where("ts_ms is not null").withColumn("slot", F.min(F.when(F.col("kind") == 1, F.col("msg_index"))).over(following))
    rest = both.where("ts_ms is null").withColumn("slot", F.when(F.col("kind") == 1, F.col("msg_index")))
    placed = timed.unionByName(rest).withColumn("slot", F.when(F.col("kind") == 1, F.col("msg_index")).otherwise(F.col("slot")))
    order = Window.partitionBy("session_id").orderBy(F.asc_nulls_last("slot"), "kind", F.asc_nulls_last("ts_ms"), "msg_index")
    return placed.select("session_id", (F.row_number().over(order) - 1).alias("place"), F.when(F.col("kind") == 1, "message").otherwise("note").alias("kind"), "msg_index")


def compaction_cutoff(transcript: DataFrame, updates: DataFrame) -> DataFrame:
    """Prompts below the oldest index still in the transcript come from the update stream; the transcript's rows without an index go then."""
    oldest = transcript.groupBy("session_id").agg(F.min("prompt_index").alias("_oldest"))
    older = updates.join(oldest, "session_id").where("prompt_index < _oldest").select(updates.columns)
    rebuilt = older.select("session_id").distinct().withColumn("_rebuilt", F.lit(True))
    kept = transcript.join(rebuilt, "session_id", "left").where("prompt_index is not null or _rebuilt is null").drop("_rebuilt")
    return older.withColumn("origin", F.lit("updates")).unionByName(kept.withColumn("origin", F.lit("transcript")))


def assemble_stream_chunks(chunks: DataFrame, assembled: DataFrame) -> DataFrame:
    """Deltas of a block in order, for steps without an assembled message. A block's deltas are one group, as large as its text."""
    open_steps = chunks.join(assembled.select("session_id", "turn", "step").distinct(), ["session_id", "turn", "step"], "left_anti")
    ordered = F.sort_array(F.collect_list(F.struct("seq", "delta")))
    return open_steps.groupBy("session_id", "turn", "step", "block", "kind").agg(F.array_join(F.transform(ordered, lambda x: x["delta"]), "").alias("text"))


def merge_double_prompt(rows: DataFrame) -> DataFrame:
    """A prompt logged as an item and right after as an event with the same text counts once: the event, with the item's images, and its time where it has none."""
    before = by_session()
    paired = (F.col("type") == "event") & (F.lag("type").over(before) == "item") & (F.lag("content").over(before) == F.col("content"))
    taken = (F.col("type") == "item") & (F.lead("type").over(before) == "event") & (F.lead("content").over(before) == F.col("content"))
    return rows.select(
        "session_id", "msg_index", "type", "content", F.when(paired, F.coalesce("images", F.lag("images").over(before))).otherwise(F.col("images")).alias("images"),
        F.when(paired, F.coalesce("ts_ms", F.lag("ts_ms").over(before))).otherwise(F.col("ts_ms")).alias("ts_ms"), taken.alias("_taken"),
    ).where("not coalesce(_taken, false)").drop("_taken")


def merge_image_placeholder(rows: DataFrame) -> DataFrame:
    """A user row with an image but no source takes the sources of the next row that counts, if that is a meta row with sources, which then goes. Rows of bookkeeping types don't count."""
    counted = rows.where(~F.col("bookkeeping"))
    waits = (F.col("role") == "user") & F.col("has_image") & F.col("sources").isNull()
    gives = F.col("is_meta") & F.col("sources").isNotNull()
    line = by_session()
    merged = counted.withColumn("_waits", waits).withColumn("_gives", gives)
    filled = F.when(F.col("_waits") & F.lead("_gives").over(line), F.lead("sources").over(line)).otherwise(F.col("sources"))
    used = F.col("_gives") & F.coalesce(F.lag("_waits").over(line), F.lit(False))
    return merged.select("session_id", "msg_index", "role", filled.alias("sources"), used.alias("_used")).where("not _used").drop("_used")


def active_branch(entries: DataFrame, rounds: int = 40) -> DataFrame:
    """(session_id, id) on the path from each session's last entry up to its root, by doubling parent links: after r rounds paths of 2^r entries are covered."""
    nodes = entries.select("session_id", "id", F.col("parent_id").alias("up"))
    on = entries.groupBy("session_id").agg(F.max_by("id", "line_no").alias("id"))
    count = -1
    for r in range(rounds):
        reached = on.join(nodes, ["session_id", "id"]).where("up is not null").select("session_id", F.col("up").alias("id"))
        on = on.unionByName(reached).distinct().checkpoint()
        now = on.count()
        if now == count:
            break
        count = now
        above = nodes.select("session_id", F.col("id").alias("up"), F.col("up").alias("higher"))
        nodes = nodes.join(above, ["session_id", "up"], "left").select("session_id", "id", F.col("higher").alias("up")).checkpoint()
    return on.join(entries.select("session_id", "id"), ["session_id", "id"], "left_semi")


def role_counts(rows: DataFrame, roles=("user", "assistant", "tool", "system")) -> DataFrame:
    return rows.groupBy("session_id").agg(*[F.count_if(F.col("role") == r).alias(r) for r in roles])


def tool_distribution(rows: DataFrame) -> DataFrame:
    """Calls and share of each tool name in a session."""
    named = rows.where("role = 'tool'").groupBy("session_id", F.coalesce("tool_name", F.lit("Tool")).alias("tool")).agg(F.count("*").alias("calls"))
    return named.withColumn("share", F.round(F.col("calls") / F.sum("calls").over(Window.partitionBy("session_id")), 6))


def session_report(rows: DataFrame) -> DataFrame:
    """One row for each session: role counts, time span, sums, rates (null on a zero denominator) and the peak."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    base = rows.groupBy("session_id").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("user", "assistant", "tool", "system")], F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), *sums,
                                          F.max_by("msg_index", F.when(F.col("input_tokens").isNotNull(), F.struct(total(), -F.col("msg_index")))).alias("peak_index"))
    return base.withColumns({
        "tokens_per_turn": F.round(F.try_divide(total(), F.col("assistant")), 6), "tools_per_user_turn": F.round(F.try_divide("tool", "user"), 6),
        "cache_share": F.round(F.try_divide("cache_read_tokens", F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")), 6),
    })


def last_activity(rows: DataFrame) -> DataFrame:
    """Time of the latest user or assistant row."""
    return rows.groupBy("session_id").agg(F.max(F.when(F.col("role").isin("user", "assistant"), F.col("ts_ms"))).alias("updated_ms"))
