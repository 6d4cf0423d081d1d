"""Token accounting: which usage rows count, and their sums by session, bucket and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.times import to_bucket
from .scans import before

COUNTERS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
SYNTHETIC = "<synthetic>"


def total() -> Column:
    return F.col(COUNTERS[0]) + F.col(COUNTERS[1]) + F.col(COUNTERS[2]) + F.col(COUNTERS[3])


def usage_source(messages: DataFrame, events: DataFrame) -> DataFrame:
    """A session's events if it has any, else the usage on its messages (same columns)."""
    return events.unionByName(messages.join(events.select("session_id").distinct(), "session_id", "left_anti"))


def dedup_max(events: DataFrame) -> DataFrame:
    """Of the rows of a session with one hash the largest total, the earliest of equals; rows without a hash all stay."""
    best = Window.partitionBy("session_id", "usage_hash").orderBy(total().desc(), "seq")
    return events.withColumn("_n", F.when(F.col("usage_hash").isNull(), 1).otherwise(F.row_number().over(best))).where("_n = 1").drop("_n")


def dedup_cross(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """A hash counts once for a provider: parents before children, then by session and row. The claim stands even if the row is invalid later."""
    known = sessions.select(F.col("id").alias("session_id"), "provider", F.col("parent_id").isNotNull().alias("_child"))
    first = Window.partitionBy("provider", "usage_hash").orderBy("_child", "session_id", "seq")
    joined = events.join(known, "session_id")
    # Rows without a hash all stay, so they don't go through the window, where a provider's would be one partition.
    claimed = joined.where("usage_hash is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return claimed.unionByName(joined.where("usage_hash is null")).drop("_child", "provider")


def invalid_reason() -> Column:
    """Why a row doesn't count; null if it does."""
    return (
        F.when(F.col("ts").isNull() | (F.col("ts") == ""), "no_timestamp").when(to_bucket("ts").isNull(), "bad_timestamp")
        .when(F.col("model").isNull() | (F.col("model") == ""), "no_model").when(F.col("model") == SYNTHETIC, "synthetic")
    )


def valid_usage(events: DataFrame) -> DataFrame:
    return events.where(invalid_reason().isNull())


def invalid_counts(events: DataFrame) -> DataFrame:
    return events.select(invalid_reason().alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def priced(events: DataFrame, prices: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Adds cost: the wire's, else estimated. Prices are looked up once for each distinct model, of `models` if it is given: a frame with at least the events' models that is cheaper to read.

    The prices are broadcast, a row for each model that has one: dealt by model, all events of a model would meet in one task.
    """
    known = pricing.lookup(events if models is None else models, prices)
    return events.join(F.broadcast(known), "model", "left").withColumn("cost", pricing.resolve_cost()).drop(*[c for c in known.columns if c != "model"])


def sum_stats(events: DataFrame) -> DataFrame:
    """One row for each session, bucket and model, from rows with a cost."""
    sums = [F.sum(c).alias(c) for c in ["turn_count", *COUNTERS]]
    return events.withColumn("bucket", to_bucket("ts")).groupBy("session_id", "bucket", "model").agg(*sums, F.sum("cost").alias("cost_usd"))


def token_stats(events: DataFrame, prices: DataFrame) -> DataFrame:
    """The fact table: the largest row of each hash, then validity, then price, then sums."""
    return sum_stats(priced(valid_usage(dedup_max(events)), prices, events))


def counter_delta(rows: DataFrame, counters: list[str], segment_rows: int | None = None) -> DataFrame:
    """(session_id, seq, ts, model) and the counters of each row: as given in `last_<c>`, else the cumulative `total_<c>` less the one seen before, 0 at least. Sessions of more than `segment_rows` rows are cut."""
    out = before(rows, "seq", lasts={f"_seen_{c}": F.col(f"total_{c}") for c in counters}, segment_rows=segment_rows)
    for c in counters:
        out = out.withColumn(c, F.coalesce(F.col(f"last_{c}"), F.greatest(F.lit(0), F.col(f"total_{c}") - F.coalesce(f"_seen_{c}", F.lit(0)))))
    return out.drop(*[f"_seen_{c}" for c in counters])


def drop_exact_repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a session that agree in all `keys` count once, the first."""
    first = Window.partitionBy("session_id", *keys).orderBy("seq")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def skip_replay_burst(rows: DataFrame, forked: str = "forked") -> DataFrame:
    """In a forked log the rows of the first row's second are the parent's: marks them `primes_only`."""
    whole = Window.partitionBy("session_id")
    running = whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    second = F.floor(F.col("ts_ms") / 1000)
    first = F.first(second).over(running)
    left = F.max(second > first).over(running)
    return rows.withColumn("primes_only", F.col(forked) & ~F.coalesce(left, F.lit(False)))


def fill_model(rows: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """model: the row's own by info, payload, then the last seen in the session, then the usage's; what stays open takes the session's only model, if it has just one. With `segment_rows` sessions of more rows are cut, and no session is one window partition."""
    own = F.coalesce("info_model", "payload_model", "context_model")
    found = before(rows, "seq", lasts={"_last": own}, segment_rows=segment_rows)
    found = found.withColumn("model", F.coalesce("info_model", "payload_model", own, "_last", "usage_model")).drop("_last")
    if segment_rows is None:
        whole = Window.partitionBy("session_id")
        only = F.when(F.min("model").over(whole) == F.max("model").over(whole), F.min("model").over(whole))
        return found.withColumn("model", F.coalesce("model", only))
    single = found.groupBy(F.col("session_id").alias("_of")).agg(F.min("model").alias("_only"), F.max("model").alias("_other")).where("_only = _other").drop("_other")
    return found.join(single, F.col("session_id").eqNullSafe(F.col("_of")), "left").withColumn("model", F.coalesce("model", "_only")).drop("_of", "_only")


def ticks_to_usd(turns: DataFrame) -> DataFrame:
    """(session_id, turn, model, cost_usd) from rows with a map `model_usage` of model to ticks (null where unknown): 1e10 ticks are a dollar.

    Incomplete or partial costs are not trusted; the turn's own ticks stand in only for a single model.
    """
    each = turns.select("session_id", "turn", "turn_ticks", "incomplete", "partial", F.size("model_usage").alias("models"), F.explode("model_usage").alias("model", "ticks"))
    ticks = F.coalesce("ticks", F.when(F.col("models") == 1, F.col("turn_ticks")))
    trusted = ~F.coalesce("incomplete", F.lit(False)) & ~F.coalesce("partial", F.lit(False))
    return each.select("session_id", "turn", "model", F.when(trusted, ticks / 1e10).alias("cost_usd"))


def estimate_from_chars(messages: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Assistant rows of logs without usage: a token is four characters, of the running context for input, of the row for output; 1 at least."""
    sized = messages.select("session_id", "msg_index", "role", F.char_length(F.coalesce("content", F.lit(""))).alias("chars"))
    sized = before(sized, "msg_index", sums={"context": F.col("chars")}, segment_rows=segment_rows)
    return sized.select(
        "session_id", "msg_index", "role", F.greatest(F.lit(1), F.floor(F.col("context") / 4)).cast("long").alias("input_tokens"), F.greatest(F.lit(1), F.floor(F.col("chars") / 4)).cast("long").alias("output_tokens"),
    ).where("role = 'assistant'").drop("role")


def session_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def indexed_totals(stats: DataFrame) -> DataFrame:
    """Sums of a session's stat rows; a session without rows has none."""
    return session_totals(stats)


def with_totals(sessions: DataFrame, stats: DataFrame) -> DataFrame:
    """Sessions with their four sums, 0 without stat rows."""
    sums = session_totals(stats).withColumnRenamed("session_id", "id")
    joined = sessions.join(sums, "id", "left")
    return joined.select(*sessions.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS])


def fold_step_usage(rows: DataFrame) -> DataFrame:
    """(session_id, turn, counters): a turn's steps add up; a closing record of scope `turn`, the last one, replaces the sum.

    Rows: session_id, seq, type (prompt, step, close), scope and the counters.
    """
    upto = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = rows.withColumn("turn", F.sum(F.when(F.col("type") == "prompt", 1).otherwise(0)).over(upto)).where("type <> 'prompt'")
    closing = (F.col("type") == "close") & (F.col("scope") == "turn")
    made = []
    for c in COUNTERS:
        made.append(F.coalesce(F.max_by(F.when(closing, F.col(c)), F.when(closing, F.col("seq"))), F.sum(F.when(F.col("type") == "step", F.col(c)))).alias(c))
    return turns.groupBy("session_id", "turn").agg(*made)


def tool_stats(messages: DataFrame) -> DataFrame:
    """(session_id, tool_key, label, category, count) of tool rows with tool_name and, if known, canonical, display and category. The first row of a key names it; blank keys drop out."""
    key = F.trim(F.coalesce(F.when(F.trim("canonical") != "", F.col("canonical")), F.col("tool_name")))
    keyed = messages.where("role = 'tool'").withColumn("tool_key", key).where("tool_key <> ''")
    label = F.coalesce(F.when(F.trim("display") != "", F.trim("display")), F.col("tool_key"))
    return keyed.groupBy("session_id", "tool_key").agg(
        F.min_by(label, "msg_index").alias("label"), F.min_by(F.coalesce("category", F.lit("tool")), "msg_index").alias("category"), F.count("*").alias("count"),
    )
