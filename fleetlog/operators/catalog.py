"""Sessions as a catalog: lists, trees, favorites, and merging snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXTS = ["title", "content_text", "project_name"]


def get_session(sessions: DataFrame, key) -> DataFrame:
    return sessions.where(F.col("id") == key)


def list_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), "id")


def list_recent(sessions: DataFrame, limit: int) -> DataFrame:
    """Root sessions, the last updated first."""
    return sessions.where("parent_id is null").orderBy(F.desc("updated_at"), "id").limit(limit)


def children(sessions: DataFrame, parent) -> DataFrame:
    return sessions.where(F.col("parent_id") == parent).orderBy("created_at", "id")


def session_tree(sessions: DataFrame, keys: tuple[str, ...] = ("provider", "project_path"), rounds: int = 31) -> DataFrame:
    """(id, root_id, depth) inside each partition by `keys`: a child whose parent is not there is a root; sessions on a cycle have no row.

    Parent links double in each round, so depth d takes about log2(d) joins. Links that
    go on for more than 2^rounds steps can only be cycles.
    """
    own = sessions.select("id", *keys, "parent_id")
    above = sessions.select(F.col("id").alias("parent_id"), *[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_there"))
    linked = own.join(above, "parent_id", "left")
    inside = F.coalesce(F.col("_there"), F.lit(False)) & (F.col("parent_id") != F.col("id"))
    for k in keys:
        inside = inside & F.col(k).eqNullSafe(F.col(f"_{k}"))
    steps = linked.select("id", F.when(inside, F.col("parent_id")).alias("up"), F.when(inside, F.col("id")).isNotNull().cast("int").alias("n")).withColumn("root", F.when(F.col("up").isNull(), F.col("id"))).checkpoint()
    for _ in range(rounds):
        if steps.where("root is null").isEmpty():
            break
        over = steps.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("n").alias("_n"), F.col("root").alias("_root"))
        steps = steps.join(over, "up", "left").select("id", F.coalesce("root", "_root").alias("root"), F.when(F.col("root").isNull(), F.col("n") + F.coalesce("_n", F.lit(0))).otherwise(F.col("n")).alias("n"), F.when(F.col("root").isNull() & F.col("_root").isNull(), F.col("_up")).alias("up")).checkpoint()
    return steps.where("root is not null").select("id", F.col("root").alias("root_id"), F.col("n").alias("depth"))


def tree_counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("root_id").agg(F.count("*").alias("sessions"), F.max("depth").alias("depth"))


def favorites_list(favorites: DataFrame, sessions: DataFrame) -> DataFrame:
    """Favorites that have a session, the newest added first."""
    return favorites.join(sessions, favorites["session_id"] == sessions["id"]).select("id", "added_at", "title", "provider").orderBy(F.desc("added_at"), "id")


def add_favorites(favorites: DataFrame, more: DataFrame) -> DataFrame:
    """Those that are there already stay as they are."""
    fresh = Window.partitionBy("session_id").orderBy("added_at")
    new = more.withColumn("_n", F.row_number().over(fresh)).where("_n = 1").drop("_n")
    return favorites.unionByName(new.join(favorites.select("session_id"), "session_id", "left_anti"))


def remove_favorites(favorites: DataFrame, gone: DataFrame) -> DataFrame:
    return favorites.join(gone.select("session_id"), "session_id", "left_anti")


def favorites_tree(favorites: DataFrame, sessions: DataFrame) -> DataFrame:
    """(provider, project_path, sessions) of the favorites."""
    kept = sessions.join(favorites.select(F.col("session_id").alias("id")), "id", "left_semi")
    return kept.groupBy("provider", "project_path").agg(F.count("*").alias("sessions"))


def rename(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Own titles (id, custom_title) over those that scans found."""
    return sessions.join(titles, "id", "left").withColumn("title_custom", F.col("custom_title").isNotNull()).withColumn("title", F.coalesce("custom_title", "title")).drop("custom_title")


def merge_sessions(old: DataFrame, new: DataFrame, replacing_provider: str | None = None) -> DataFrame:
    """Old rows under new ones by id. A custom title stays; an empty path and an empty or unknown project name keep the old; a side chain stays one and keeps its parent, but for `replacing_provider`; other columns are the new row's. changed says whether a text column differs."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full")
    fresh, known = F.col("b.id").isNotNull(), F.col("a.id").isNotNull()
    free = F.lit(False) if replacing_provider is None else F.col("b.provider") == replacing_provider

    def pick(c: str) -> Column:
        was, now = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == "title":
            now = F.when(F.col("a.title_custom"), was).otherwise(now)
        elif c == "title_custom":
            now = F.coalesce(was, F.lit(False)) | F.coalesce(now, F.lit(False))
        elif c == "project_path":
            now = F.when(F.coalesce(now, F.lit("")) == "", was).otherwise(now)
        elif c == "project_name":
            now = F.when(F.coalesce(now, F.lit("")).isin("", "Unknown Project"), F.coalesce(was, now)).otherwise(now)
        elif c == "is_sidechain":
            now = F.when(free, now).otherwise(F.coalesce(was, F.lit(False)) | now)
        elif c == "parent_id":
            now = F.when(free, now).otherwise(F.coalesce(now, was))
        return F.when(fresh, now).otherwise(was).alias(c)

    texts = [c for c in TEXTS if c in new.columns]
    same = F.xxhash64(*[F.col(f"a.{c}") for c in texts]) == F.xxhash64(*[F.col(f"b.{c}") for c in texts])
    return both.select(*[pick(c) for c in new.columns], (fresh & ~(known & same)).alias("changed"))


def delete_allowed(alive: int, stored: int, aggressive: bool = False) -> bool:
    """Whether missing sessions may be deleted: never if nothing is alive, always for few, else if over half is alive."""
    return aggressive or (alive > 0 and (stored <= 10 or alive / stored > 0.5))


def guarded(counts: DataFrame, aggressive: bool = False) -> DataFrame:
    """Rows (alive, stored) with `allowed`, as delete_allowed() decides."""
    enough = (F.col("alive") > 0) & ((F.col("stored") <= 10) | (F.col("alive") / F.col("stored") > 0.5))
    return counts.withColumn("allowed", F.lit(aggressive) | enough)


def delete_missing(sessions: DataFrame, scanned_sources: DataFrame, found: DataFrame) -> DataFrame:
    """Without the ids that a rescanned source no longer has; found has (id), scanned_sources (source_path)."""
    missing = sessions.join(scanned_sources, "source_path", "left_semi").join(found.select("id"), "id", "left_anti")
    return sessions.join(missing.select("id"), "id", "left_anti")


def delete_vanished(sessions: DataFrame, scanned: DataFrame, listing: DataFrame) -> DataFrame:
    """Without the sessions of sources that are neither in the scan nor in the listing of files."""
    gone = sessions.join(scanned, "source_path", "left_anti").join(listing, "source_path", "left_anti")
    return sessions.join(gone.select("id"), "id", "left_anti")


def cascade(rows: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    return rows.join(sessions.select(F.col("id").alias(key)), key, "left_semi")


def purge_unknown(sessions: DataFrame, providers: list[str]) -> DataFrame:
    return sessions.where(F.col("provider").isin(providers))


def backfill_children(sessions: DataFrame, declared: DataFrame) -> DataFrame:
    """Children that parents declare (parent_id, child_ids): the first parent by id wins; an empty parent is set, the child becomes a side chain and takes project fields it lacks."""
    each = declared.select(F.col("parent_id").alias("_p"), F.explode("child_ids").alias("id")).where("_p <> id").groupBy("id").agg(F.min("_p").alias("_p"))
    parents = sessions.select(F.col("id").alias("_p"), F.col("project_path").alias("_path"), F.col("project_name").alias("_name"))
    joined = sessions.join(each.join(parents, "_p", "left"), "id", "left")
    took = F.col("_p").isNotNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", "Unknown Project")
    return joined.select(*[
        F.when(took, F.coalesce("parent_id", "_p")).otherwise(F.col(c)).alias(c) if c == "parent_id" else (F.col(c) | took).alias(c) if c == "is_sidechain"
        else F.when(took & blank(c), F.coalesce("_path", c)).otherwise(F.col(c)).alias(c) if c == "project_path" else F.when(took & blank(c), F.coalesce("_name", c)).otherwise(F.col(c)).alias(c) if c == "project_name" else F.col(c)
        for c in sessions.columns])


def inherit_project(sessions: DataFrame) -> DataFrame:
    """Children take their parent's path if it has one."""
    parents = sessions.select(F.col("id").alias("parent_id"), F.nullif("project_path", F.lit("")).alias("_path"))
    return sessions.join(parents, "parent_id", "left").withColumn("project_path", F.coalesce("_path", "project_path")).select(sessions.columns)


def pair_tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (session_id, call_id, msg_index, tool_name) with the last result (session_id, call_id, line_no, output, status); of calls that register an id again the last one has it."""
    last = results.groupBy("session_id", "call_id").agg(F.max_by(F.struct("output", "status"), "line_no").alias("r"))
    newest = F.max("msg_index").over(Window.partitionBy("session_id", "call_id"))
    marked = calls.withColumn("_own", F.col("msg_index") == newest)
    joined = marked.join(last, ["session_id", "call_id"], "left")
    return joined.select(*calls.columns, F.when(F.col("_own"), F.col("r.output")).alias("output"), F.when(F.col("_own"), F.col("r.status")).alias("status"))


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    return results.join(calls.select("session_id", "call_id").distinct(), ["session_id", "call_id"], "left_anti")


def pair_by_assistant(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results by the assistant line that they answer, where that line had just one call."""
    single = calls.groupBy("session_id", "assistant_uuid").agg(F.count("*").alias("n"), F.min("call_id").alias("call_id")).where("n = 1").drop("n")
    return results.join(single, ["session_id", "assistant_uuid"])


def attach_prompt_usage(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Totals of a turn go to its last assistant row with text; of several reports for an index the last counts, and an index that comes again keeps its usage on its last occurrence."""
    last = reports.groupBy("session_id", "prompt_index").agg(F.max_by("input_tokens", "line_no").alias("input_tokens"))
    able = (F.col("role") == "assistant") & (F.trim(F.coalesce("content", F.lit(""))) != "")
    place = F.max(F.when(able, F.col("msg_index"))).over(Window.partitionBy("session_id", "prompt_index"))
    return rows.withColumn("_at", place).join(last, ["session_id", "prompt_index"], "left").select(*rows.columns, F.when(F.col("msg_index") == F.col("_at"), F.col("input_tokens")).alias("input_tokens"))


def parent_by_header_path(headers: DataFrame) -> DataFrame:
    """(id, parent_id) from (id, source_path, parent_path): the session whose log the child's header names, absolutely or from the child's folder; none for itself or a missing log."""
    folder = F.regexp_replace("source_path", "[^/]*$", "")
    path = F.when(F.col("parent_path").startswith("/"), F.col("parent_path")).otherwise(F.concat(folder, "parent_path"))
    # From the left, `..` takes back the part before it.
    parts = F.filter(F.split(path, "/"), lambda p: p != ".")
    step = lambda done, p: F.when((p == "..") & (F.size(done) > 1), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(p)))
    path = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    known = headers.select(F.col("source_path").alias("_path"), F.col("id").alias("_id"))
    joined = headers.withColumn("_path", path).join(known, "_path", "left")
    return joined.select("id", F.when(F.col("_id") != F.col("id"), F.col("_id")).alias("parent_id"))


def match_subagent(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """(call_id, child_id, rule) for calls (call_id, parent_id, agent_id, nickname, description) and child sessions (id, parent_id, title): by agent id, then by nickname, then by description or a prefix either way; the best rule, then the smallest id.

    Each rule is an equality join with the smallest child of each key of a parent, so calls and children of one parent are never paired
    with each other. Prefixes are joined by the lengths that the parent's other side has.
    """
    calls = calls.select("call_id", "parent_id", F.regexp_replace(F.regexp_replace("agent_id", "@session-.*$", ""), "^agent-", "").alias("agent"), "nickname", "description")
    children = candidates.select(F.col("id").alias("child_id"), "parent_id", "title")

    def matched(call_key: Column, keyed: DataFrame, rule: int, given: DataFrame = calls) -> DataFrame:
        """Calls whose key a child has; `keyed` has children with `key`."""
        first = keyed.where("key is not null").groupBy("parent_id", "key").agg(F.min("child_id").alias("child_id"))
        return given.withColumn("key", call_key).join(first, ["parent_id", "key"]).select("call_id", F.struct(F.lit(rule).alias("rule"), "child_id").alias("best"))

    own = F.col("child_id").cast("string")
    aliases = children.withColumn("key", F.explode(F.array(own, F.when(own.startswith("agent-"), F.substring(own, 7, 1 << 30)), F.col("title"))))
    found = matched(F.col("agent"), aliases, 1).unionByName(matched(F.col("nickname"), children.withColumn("key", F.col("title")), 2))
    # Titles that start with a description.
    described = calls.where("description <> ''")
    lengths = described.groupBy("parent_id").agg(F.collect_set(F.char_length("description")).alias("lengths"))
    fit = F.explode(F.filter("lengths", lambda n: n <= F.char_length("title")))
    starts = children.join(lengths, "parent_id").withColumn("n", fit).withColumn("key", F.substring(F.col("title"), F.lit(1), F.col("n")))
    found = found.unionByName(matched(F.col("description"), starts, 3, described))
    # Descriptions that start with a title that was cut off.
    cut = children.withColumn("key", F.regexp_replace("title", "(\\.\\.\\.|…)$", "")).where("key <> title")
    lengths = cut.groupBy("parent_id").agg(F.collect_set(F.char_length("key")).alias("lengths"))
    fit = F.explode(F.filter("lengths", lambda n: n <= F.char_length("description")))
    found = found.unionByName(matched(F.substring(F.col("description"), F.lit(1), F.col("n")), cut, 3, described.join(lengths, "parent_id").withColumn("n", fit)))
    best = found.groupBy("call_id").agg(F.min("best").alias("best"))
    return best.select("call_id", "best.child_id", "best.rule")
