"""Usage reports over the fact table of session, bucket and model."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import civil_date, resolve_bounds
from ..operators.usage import COUNTERS, total

FOLDING = "high"


def sums() -> list:
    return [F.sum(c).alias(c) for c in ["turn_count", *COUNTERS]]


def dollars():
    """Sum of the cost, rounded to 4 digits; a sum just on the border, by whatever order it was added in, goes up."""
    return F.round(F.sum("cost_usd") + 1e-9, 4)


def bounded(df: DataFrame, providers: list[str] | None = None, start: int | None = None, end: int | None = None, bucket: str = "bucket") -> DataFrame:
    """Rows of the providers (None: all; an empty list: no rows) with bucket in [start, end); either end may be open."""
    if providers is not None:
        df = df.where(F.col("provider").isin(providers)) if providers else df.where(F.lit(False))
    if start is not None:
        df = df.where(F.col(bucket) >= start)
    if end is not None:
        df = df.where(F.col(bucket) < end)
    return df


def with_sessions(stats: DataFrame, sessions: DataFrame) -> DataFrame:
    """Facts with their sessions. model is the fact's, else the session's, else empty."""
    joined = stats.join(sessions.withColumnRenamed("model", "session_model"), stats["session_id"] == sessions["id"])
    return joined.withColumn("model", F.coalesce(F.nullif("model", F.lit("")), "session_model", F.lit("")))


def usage_base(stats: DataFrame, sessions: DataFrame, folding: str = FOLDING) -> DataFrame:
    """Facts with their sessions, without the child sessions of the folding provider whose parent has facts itself."""
    joined = with_sessions(stats, sessions)
    parents = stats.select(F.col("session_id").alias("_parent")).distinct()
    child = F.coalesce((F.col("provider") == folding) & F.col("is_sidechain") & F.col("parent_id").isNotNull(), F.lit(False))
    # Other rows are dealt by their own session, as rows without a parent would all meet in one task.
    keyed = joined.withColumn("_child", child).withColumn("_key", F.when(F.col("_child"), F.col("parent_id")).otherwise(F.col("session_id")))
    return keyed.join(parents, (F.col("_key") == F.col("_parent")) & F.col("_child"), "left_anti").drop("_child", "_key")


def session_count(base: DataFrame) -> DataFrame:
    return base.agg(F.count_distinct("session_id").alias("sessions"))


def session_count_by_provider(base: DataFrame) -> DataFrame:
    return base.groupBy("provider").agg(F.count_distinct("session_id").alias("sessions"))


def totals(base: DataFrame) -> DataFrame:
    return base.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["turn_count", *COUNTERS]])


def totals_range(base: DataFrame) -> DataFrame:
    return base.agg(F.count_distinct("session_id").alias("sessions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["turn_count", *COUNTERS]], F.coalesce(dollars(), F.lit(0.0)).alias("cost_usd"))


def cost_and_tokens(base: DataFrame) -> DataFrame:
    return base.agg(F.coalesce(dollars(), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.sum(total()), F.lit(0)).alias("tokens"))


def daily(base: DataFrame, tz: str) -> DataFrame:
    return base.withColumn("date", civil_date("bucket", tz)).where("date is not null").groupBy("date", "provider").agg(F.sum(total()).alias("tokens"), dollars().alias("cost_usd")).orderBy("date", "provider")


def activity_daily(base: DataFrame, tz: str) -> DataFrame:
    dated = base.withColumn("date", civil_date("bucket", tz)).where("date is not null")
    return dated.groupBy("date").agg(F.count_distinct("session_id").alias("sessions"), F.sum("turn_count").alias("turns"), F.sum(total()).alias("tokens"), dollars().alias("cost_usd")).orderBy("date")


def activity_years(base: DataFrame, tz: str) -> DataFrame:
    year = F.substring(civil_date("bucket", tz), 1, 4).cast("int")
    return base.select(year.alias("year")).where("year between 1970 and 9999").distinct().orderBy(F.desc("year"))


def by_model(base: DataFrame) -> DataFrame:
    return base.groupBy("model").agg(*sums(), dollars().alias("cost_usd")).orderBy((F.col("input_tokens") + F.col("output_tokens")).desc(), "model")


def recent_detail(base: DataFrame, sessions: DataFrame, limit: int) -> DataFrame:
    """By session and model, inside the bounds of `base`, of the root sessions in it that were updated last."""
    roots = base.where("parent_id is null").select("session_id", "updated_at").distinct().orderBy(F.desc("updated_at"), "session_id").limit(limit)
    return base.join(roots.select("session_id"), "session_id", "left_semi").groupBy("session_id", "updated_at", "model").agg(*sums(), dollars().alias("cost_usd"))


def recent_sessions(detail: DataFrame) -> DataFrame:
    """Sums of each session and its dominant model: most tokens, then the higher cost, then by name."""
    keyed = F.struct(F.sum(total()).alias("t"), F.sum("cost_usd").alias("c"))
    models = detail.groupBy("session_id", "updated_at", "model").agg(keyed.alias("k"), *sums(), F.sum("cost_usd").alias("cost_usd"))
    first = Window.partitionBy("session_id").orderBy(F.desc("k.t"), F.desc("k.c"), "model")
    ranked = models.withColumn("n", F.row_number().over(first))
    return ranked.groupBy("session_id", "updated_at").agg(F.max(F.when(F.col("n") == 1, F.col("model"))).alias("model"), *sums(), dollars().alias("cost_usd")).orderBy(F.desc("updated_at"), "session_id")


def project_model_detail(base: DataFrame) -> DataFrame:
    return base.groupBy("project_path", "project_name", "provider", "session_id", "model").agg(*sums(), dollars().alias("cost_usd"))


def project_session_ids(stats: DataFrame, sessions: DataFrame, project_path: str) -> DataFrame:
    """Sessions of the project with facts, newest first; folded children count here."""
    active = stats.select(F.col("session_id").alias("id")).distinct()
    return sessions.where(F.col("project_path") == project_path).join(active, "id", "left_semi").select("id", "updated_at").orderBy(F.desc("updated_at"), "id")


def project_tool_usage(tool_stats: DataFrame, session_ids: DataFrame) -> DataFrame:
    kept = tool_stats.join(session_ids.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return kept.groupBy("tool_key").agg(
        F.coalesce(F.max(F.nullif("label", F.lit(""))), F.col("tool_key")).alias("label"), F.coalesce(F.max(F.nullif("category", F.lit(""))), F.lit("tool")).alias("category"),
        F.sum("count").alias("calls"), F.count_distinct("session_id").alias("sessions"),
    ).orderBy(F.desc("calls"), "tool_key")


def missing_tool_stats(session_ids: DataFrame, computed: DataFrame) -> DataFrame:
    return session_ids.join(computed.select(F.col("session_id").alias("id")), "id", "left_anti").orderBy(F.desc("updated_at"), "id")


def project_daily(base: DataFrame, tz: str) -> DataFrame:
    dated = base.withColumn("date", civil_date("bucket", tz)).where("date is not null")
    return dated.groupBy("date", "provider", "model").agg(F.count_distinct("session_id").alias("sessions"), *sums(), dollars().alias("cost_usd")).orderBy("date", "provider", "model")


def project_costs(base: DataFrame) -> DataFrame:
    """A row for each project path: name of most input and output tokens, providers, exact session count, sums, and parts by provider and by model."""
    size = F.col("input_tokens") + F.col("output_tokens")
    # Sums of each session first, so that the sets and the exact counts go over fewer rows.
    each = base.groupBy("project_path", "project_name", "provider", "model", "session_id").agg(F.sum(size).alias("size"), F.sum(total()).alias("all_tokens"), F.sum("cost_usd").alias("cost_usd"))
    sets = each.groupingSets([("project_path",), ("project_path", "provider"), ("project_path", "model"), ("project_path", "project_name")], "project_path", "project_name", "provider", "model").agg(
        F.grouping_id().alias("g"), F.count_distinct("session_id").alias("sessions"), F.sum("all_tokens").alias("tokens"), F.sum("size").alias("w"), dollars().alias("cost_usd"),
    )
    # Bits of the grouping id, from the left: path, name, provider, model; 1 where the set lacks the column.
    whole, by_name = F.col("g") == 0b0111, F.col("g") == 0b0011

    def parts(key: str):
        item = F.struct((-F.col("cost_usd")).alias("order"), F.col(key).alias("name"), "sessions", "tokens", "cost_usd")
        made = F.sort_array(F.collect_list(F.when(F.col("g") == (0b0101 if key == "provider" else 0b0110), item)))
        return F.transform(made, lambda x: F.struct(x["name"].alias("name"), x["sessions"].alias("sessions"), x["tokens"].alias("tokens"), x["cost_usd"].alias("cost_usd")))

    out = sets.groupBy("project_path").agg(
        *[F.max(F.when(whole, F.col(c))).alias(c) for c in ("sessions", "tokens", "cost_usd")], F.sort_array(F.collect_set("provider")).alias("providers"), F.max_by("project_name", F.when(by_name, F.struct("w", "project_name"))).alias("project_name"), parts("provider").alias("by_provider"), parts("model").alias("by_model"),
    )
    return out.orderBy(F.desc("cost_usd"), "project_path")


def cache_hit_rate():
    return F.coalesce(F.try_divide("cache_read_tokens", F.col("cache_read_tokens") + F.col("input_tokens")), F.lit(0.0))


def previous_bounds(start: int | None, end: int | None) -> tuple[int, int] | None:
    """The window of equal length just before; none if a side is open."""
    return None if start is None or end is None else (start - (end - start), start)


def previous_period(base: DataFrame, start: int | None, end: int | None) -> DataFrame | None:
    """totals_range() of the window before; no row if it has neither sessions nor turns."""
    before = previous_bounds(start, end)
    return None if before is None else totals_range(bounded(base, None, *before)).where("sessions > 0 or turn_count > 0")


def usage_stats(stats: DataFrame, sessions: DataFrame, providers: list[str] | None, tz: str, today: datetime.date, limit: int = 50, **window) -> dict[str, DataFrame]:
    """All parts of the usage page over one set of bounds."""
    start, end = resolve_bounds(tz, today, **window)
    whole = usage_base(stats, sessions)
    base = bounded(whole, providers, start, end)
    before = previous_period(bounded(whole, providers), start, end)
    detail = recent_detail(base, sessions, limit)
    return {
        "sessions": session_count(base), "sessions_by_provider": session_count_by_provider(base), "totals": totals_range(base).withColumn("cache_hit_rate", F.round(cache_hit_rate(), 6)), "daily": daily(base, tz), "models": by_model(base),
        "projects": project_costs(base), "recent": recent_sessions(detail), **({"previous": before} if before is not None else {}),
    }


def activity_calendar(base: DataFrame, tz: str, start: int | None = None, end: int | None = None) -> tuple[DataFrame, DataFrame]:
    return activity_daily(bounded(base, None, start, end), tz), activity_years(base, tz)


def trend_percent(current, previous):
    """Change over the previous value; null where that is missing or 0."""
    return F.try_divide(current - previous, previous)


def daily_chart(rows: DataFrame, metric: str, providers: list[str]) -> DataFrame:
    """date, a column for each provider (0 where it has none) and their sum."""
    wide = rows.groupBy("date").pivot("provider", providers).agg(F.sum(metric))
    columns = [F.coalesce(F.col(f"`{p}`"), F.lit(0)) for p in providers]
    return wide.select("date", *[c.alias(p.replace(" ", "_")) for c, p in zip(columns, providers)], sum(columns[1:], columns[0]).alias("total")).orderBy("date")


def day_breakdown(rows: DataFrame, date: str, metric: str) -> DataFrame:
    kept = rows.where((F.col("date") == date) & (F.col(metric) > 0))
    return kept.select("provider", F.col(metric).alias("value"), F.sum(metric).over(Window.partitionBy("date")).alias("total")).orderBy(F.desc("value"), "provider")


def trend_series(rows: DataFrame, metric: str, dimension: str, k: int, start: str, end: str) -> DataFrame:
    """(rank, name, date, value): the k names of the largest positive totals, on every date of the axis, 0 where there is nothing. The axis and the k names have fixed sizes."""
    top = rows.groupBy(F.col(dimension).alias("name")).agg(F.sum(metric).alias("all")).where("all > 0").orderBy(F.desc("all"), "name").limit(k)
    top = top.select("name", F.row_number().over(Window.orderBy(F.desc("all"), "name")).alias("rank"))
    axis = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day")
    grid = top.select("rank", "name", axis).select("rank", "name", F.date_format("day", "yyyy-MM-dd").alias("date"))
    values = rows.groupBy(F.col(dimension).alias("name"), "date").agg(F.sum(metric).alias("v"))
    return grid.join(values, ["name", "date"], "left").select("rank", "name", "date", F.coalesce("v", F.lit(0)).alias("value"))


def heatmap_grid(rows: DataFrame, metric: str, start: str, end: str) -> DataFrame:
    """(week, weekday, date, value, level, month): Sunday-first weeks padded to whole ones. Levels 1..4 by the values at floor(p n) of the sorted positive ones; 0 out of range or without a value. month is set in the first column that has its first day."""
    bounds = F.sequence(F.date_sub(F.to_date(F.lit(start)), F.dayofweek(F.to_date(F.lit(start))) - 1), F.date_add(F.to_date(F.lit(end)), 7 - F.dayofweek(F.to_date(F.lit(end)))))
    days = rows.sparkSession.range(1).select(F.posexplode(bounds).alias("i", "day")).select(F.floor(F.col("i") / 7).cast("int").alias("week"), (F.col("i") % 7).alias("weekday"), F.date_format("day", "yyyy-MM-dd").alias("date"))
    inside = rows.where(F.col("date").between(start, end)).select("date", F.col(metric).alias("v"))
    # A row for each day of the window with a value: bounded by the window.
    ordered = F.sort_array(F.collect_list(F.when(F.col("v") > 0, F.col("v"))))
    steps = inside.agg(ordered.alias("a")).select(*[F.expr(f"try_element_at(a, cast(least(size(a) - 1, floor({p} * size(a))) + 1 as int))").alias(f"t{i}") for i, p in enumerate((0.25, 0.5, 0.75))])
    joined = days.join(inside, "date", "left").join(F.broadcast(steps), F.lit(True), "left")
    level = F.when(F.coalesce("v", F.lit(0)) <= 0, 0).when(F.col("v") <= F.col("t0"), 1).when(F.col("v") <= F.col("t1"), 2).when(F.col("v") <= F.col("t2"), 3).otherwise(4)
    month = F.when(F.substring("date", 9, 2) == "01", F.substring("date", 1, 7))
    return joined.select("week", "weekday", "date", F.coalesce("v", F.lit(0)).alias("value"), level.alias("level"), F.when(F.col("date").between(start, end), month).alias("month"))


def token_mix(base: DataFrame) -> DataFrame:
    """(counter, tokens, share) of all tokens."""
    sums = base.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
    tall = sums.unpivot([], COUNTERS, "counter", "tokens")
    return tall.withColumn("share", F.round(F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)), 6))


def folder_overview(base: DataFrame, k: int = 5) -> DataFrame:
    """The k project paths of most tokens, with their share of all."""
    each = base.groupBy("project_path").agg(F.sum(total()).alias("tokens"), dollars().alias("cost_usd"))
    all_tokens = base.agg(F.sum(total()).alias("all"))
    return each.join(F.broadcast(all_tokens)).withColumn("share", F.round(F.try_divide("tokens", "all"), 6)).drop("all").orderBy(F.desc("tokens"), "project_path").limit(k)


def sort_limit(rows: DataFrame, column: str, key: str, ascending: bool = False, n: int = 25) -> DataFrame:
    if n not in (10, 25, 50, 100):
        raise ValueError("n is 10, 25, 50 or 100")
    return rows.orderBy(F.col(column).asc() if ascending else F.col(column).desc(), key).limit(n)


def provider_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("provider").agg(F.count("*").alias("sessions"))


def provider_snapshots(providers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every provider of the dimension (position, provider), with 0 where it has no session."""
    return providers.join(provider_counts(sessions), "provider", "left").select("position", "provider", F.coalesce("sessions", F.lit(0)).alias("sessions")).orderBy("position")


def child_counts(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    return sessions.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").groupBy("parent_id").agg(F.count("*").alias("children"))
