"""Queries over sessions and usage events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pricing, times
from ..operators import usage
from ..plans import reports
from ..sources import kept
from ..sources import tables as T
from ..sources.facts import FactTable

TZ = "America/New_York"
START, END = times.day_range_epochs("1997-01-01", "1998-12-31", TZ)
PROJECT = "/work/c7"
QUERIES, ORACLES = {}, {}


def midnight(day: str) -> str:
    """SQL of the other engine for the epoch second of a local midnight."""
    return f"CAST(epoch(TIMESTAMP '{day} 00:00:00' AT TIME ZONE '{TZ}') AS BIGINT)"


START_SQL, END_SQL = midnight("1997-01-01"), midnight("1999-01-01")

DEDUP_SQL = """deduped AS (SELECT * FROM usage_events QUALIFY row_number() OVER (PARTITION BY session_id, usage_hash ORDER BY input_tokens + output_tokens + cache_read_tokens + cache_write_tokens DESC, seq) = 1)"""
VALID_SQL = "valid AS (SELECT * FROM deduped WHERE ts IS NOT NULL AND model <> '' AND model <> '<synthetic>')"
TIER = "(CASE WHEN {above} IS NOT NULL AND {n} > 200000 THEN 200000 * {p} + ({n} - 200000) * {above} ELSE {n} * {p} END)"
COST_SQL = f"""priced AS (SELECT v.*, coalesce(cost_usd, CASE WHEN p_in IS NOT NULL THEN {TIER.format(above='p_in_above', n='input_tokens', p='p_in')} + {TIER.format(above='p_out_above', n='output_tokens', p='p_out')}
    + cache_read_tokens * p_read + cache_write_tokens * p_write ELSE 0 END) AS cost FROM valid v LEFT JOIN prices ON lower(v.model) = model_key)"""
STATS_SQL = """stats AS (SELECT session_id, CAST(floor(epoch(CAST(ts AS TIMESTAMPTZ)) / 900) * 900 AS BIGINT) AS bucket, model, CAST(sum(turn_count) AS BIGINT) AS turn_count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, sum(cost) AS cost_usd FROM priced GROUP BY ALL)"""
BASE_SQL = """base AS (SELECT t.session_id, t.bucket, t.turn_count, t.input_tokens, t.output_tokens, t.cache_read_tokens, t.cache_write_tokens, t.cost_usd, coalesce(nullif(t.model, ''), s.model, '') AS model,
    s.provider, s.project_path, s.project_name, s.parent_id, s.updated_at FROM stats t JOIN sessions s ON t.session_id = s.id
    WHERE NOT (s.provider = 'high' AND s.is_sidechain AND s.parent_id IS NOT NULL AND s.parent_id IN (SELECT session_id FROM stats)))"""
FACTS = f"WITH {T.PRICES_SQL}, {T.EVENTS_SQL}, {DEDUP_SQL}, {VALID_SQL}, {COST_SQL}, {STATS_SQL}"
BASE = f"{FACTS}, {T.SESSIONS_SQL}, {BASE_SQL}"
BOUND = f"bounded AS (SELECT * FROM base WHERE bucket >= {START_SQL} AND bucket < {END_SQL})"
ALL = "input_tokens + output_tokens + cache_read_tokens + cache_write_tokens"
SUM4 = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ["turn_count", *usage.COUNTERS])
ZERO4 = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ["turn_count", *usage.COUNTERS])
COST = "round(sum(cost_usd) + 1e-9, 4) AS cost_usd"
DAY = f"CAST(CAST(to_timestamp(bucket) AT TIME ZONE '{TZ}' AS DATE) AS VARCHAR)"


def fresh_facts(spark, sf):
    return usage.token_stats(T.usage_events(spark, sf), T.prices(spark))


def facts(spark, sf):
    """The fact table of these inputs, kept in the shared folder by application and a stamp of the inputs' files; the first report of an input builds it."""
    stats = fresh_facts(spark, sf)
    name = f"facts-{spark.sparkContext.applicationId}-{kept.stamp(spark, f'{sf}/lineitem.parquet')}"
    table = FactTable(spark, f"{kept.shared_root(spark)}/{name}", stats.schema, days=365)
    if table.number() < 0:
        table.refresh(0, stats)
    return table.read()


def base(spark, sf):
    return reports.usage_base(facts(spark, sf), T.sessions(spark, sf))


def bounded(spark, sf, providers=None):
    return reports.bounded(base(spark, sf), providers, START, END)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("agg_4_usage_daily", f"{BASE} SELECT {DAY} AS date, provider, CAST(sum({ALL}) AS BIGINT) AS tokens, {COST} FROM base GROUP BY ALL")
def agg_4(spark, sf):
    return reports.daily(base(spark, sf), TZ)


@query("use_5_token_stats", f"{FACTS} SELECT * REPLACE (round(cost_usd + 1e-9, 4) AS cost_usd) FROM stats")
def use_5(spark, sf):
    return fresh_facts(spark, sf).withColumn("cost_usd", F.round(F.col("cost_usd") + 1e-9, 4))


@query("agg_1_session_count", f"{BASE}, {BOUND} SELECT count(DISTINCT session_id) AS sessions FROM bounded")
def agg_1(spark, sf):
    return reports.session_count(bounded(spark, sf))


@query("agg_2_session_count_by_provider", f"{BASE}, {BOUND} SELECT provider, count(DISTINCT session_id) AS sessions FROM bounded GROUP BY 1")
def agg_2(spark, sf):
    return reports.session_count_by_provider(bounded(spark, sf))


@query("agg_3_usage_totals", f"{BASE}, {BOUND} SELECT {ZERO4} FROM bounded WHERE provider IN ('urgent', 'low')")
def agg_3(spark, sf):
    return reports.totals(bounded(spark, sf, ["urgent", "low"]))


_RANGE_SUMS = f"count(DISTINCT session_id) AS sessions, {ZERO4}, coalesce(round(sum(cost_usd) + 1e-9, 4), 0) AS cost_usd"


@query("exp_1_empty_providers", f"{BASE}, {BOUND} SELECT 'all' AS chosen, {_RANGE_SUMS} FROM bounded UNION ALL SELECT 'some', {_RANGE_SUMS} FROM bounded WHERE provider IN ('high', 'low') UNION ALL SELECT 'none', {_RANGE_SUMS} FROM bounded WHERE false")
def exp_1(spark, sf):
    """Without a list of providers all count, with an empty one none."""
    lists = {"all": None, "some": ["high", "low"], "none": []}
    made = [reports.totals_range(bounded(spark, sf, providers)).select(F.lit(name).alias("chosen"), "*") for name, providers in lists.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("agg_5_activity_daily", f"{BASE}, {BOUND} SELECT {DAY} AS date, count(DISTINCT session_id) AS sessions, CAST(sum(turn_count) AS BIGINT) AS turns, CAST(sum({ALL}) AS BIGINT) AS tokens, {COST} FROM bounded GROUP BY 1")
def agg_5(spark, sf):
    return reports.activity_daily(bounded(spark, sf), TZ)


@query("agg_6_activity_years", f"{BASE} SELECT DISTINCT CAST(substr({DAY}, 1, 4) AS INTEGER) AS year FROM base")
def agg_6(spark, sf):
    return reports.activity_years(base(spark, sf), TZ)


@query("agg_7_usage_by_model", f"{BASE}, {BOUND} SELECT model, {SUM4}, {COST} FROM bounded GROUP BY 1")
def agg_7(spark, sf):
    return reports.by_model(bounded(spark, sf))


DETAIL_SQL = f"""roots AS (SELECT DISTINCT session_id, updated_at FROM bounded WHERE parent_id IS NULL ORDER BY updated_at DESC, session_id LIMIT 50),
  detail AS (SELECT session_id, updated_at, model, {SUM4}, {COST} FROM bounded WHERE session_id IN (SELECT session_id FROM roots) GROUP BY 1, 2, 3)"""


@query("agg_8_recent_session_detail", f"{BASE}, {BOUND}, {DETAIL_SQL} SELECT * FROM detail")
def agg_8(spark, sf):
    return reports.recent_detail(bounded(spark, sf), T.sessions(spark, sf), 50)


@query("agg_9_totals_range", f"{BASE}, {BOUND} SELECT count(DISTINCT session_id) AS sessions, {ZERO4}, coalesce(round(sum(cost_usd) + 1e-9, 4), 0) AS cost_usd FROM bounded")
def agg_9(spark, sf):
    return reports.totals_range(bounded(spark, sf))


@query("agg_10_cost_and_tokens", f"{BASE}, {BOUND} SELECT coalesce(round(sum(cost_usd) + 1e-9, 4), 0) AS cost_usd, CAST(coalesce(sum({ALL}), 0) AS BIGINT) AS tokens FROM bounded")
def agg_10(spark, sf):
    return reports.cost_and_tokens(bounded(spark, sf))


@query("agg_11_project_model_detail", f"{BASE}, {BOUND} SELECT project_path, project_name, provider, session_id, model, {SUM4}, {COST} FROM bounded GROUP BY 1, 2, 3, 4, 5")
def agg_11(spark, sf):
    return reports.project_model_detail(bounded(spark, sf))


IDS_SQL = f"ids AS (SELECT id, updated_at FROM sessions WHERE project_path = '{PROJECT}' AND id IN (SELECT session_id FROM stats))"


@query("agg_12_project_session_ids", f"{BASE}, {IDS_SQL} SELECT * FROM ids")
def agg_12(spark, sf):
    return reports.project_session_ids(facts(spark, sf), T.sessions(spark, sf), PROJECT)


TOOLS_SQL = "tool_stats AS (SELECT l_orderkey AS session_id, l_returnflag AS tool_key, '' AS label, CASE WHEN l_returnflag = 'N' THEN '' ELSE 'file' END AS category, count(*) AS count FROM lineitem GROUP BY ALL)"


def tool_rows(spark, sf):
    return T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("tool_key"), F.lit("").alias("label"), F.when(F.col("l_returnflag") == "N", "").otherwise("file").alias("category")).agg(F.count("*").alias("count"))


@query("agg_13_project_tool_usage", f"{BASE}, {IDS_SQL}, {TOOLS_SQL} SELECT tool_key, coalesce(max(nullif(label, '')), tool_key) AS label, coalesce(max(nullif(category, '')), 'tool') AS category, CAST(sum(count) AS BIGINT) AS calls, count(DISTINCT session_id) AS sessions FROM tool_stats WHERE session_id IN (SELECT id FROM ids) GROUP BY tool_key")
def agg_13(spark, sf):
    return reports.project_tool_usage(tool_rows(spark, sf), agg_12(spark, sf))


@query("jn_3_missing_tool_stats", f"{BASE}, {IDS_SQL}, {TOOLS_SQL} SELECT * FROM ids WHERE id NOT IN (SELECT session_id FROM tool_stats WHERE session_id % 3 <> 0)")
def jn_3(spark, sf):
    return reports.missing_tool_stats(agg_12(spark, sf), tool_rows(spark, sf).where("session_id % 3 <> 0"))


@query("agg_14_project_daily", f"{BASE}, {BOUND} SELECT {DAY} AS date, provider, model, count(DISTINCT session_id) AS sessions, {SUM4}, {COST} FROM bounded WHERE project_path = '{PROJECT}' GROUP BY 1, 2, 3")
def agg_14(spark, sf):
    return reports.project_daily(bounded(spark, sf).where(F.col("project_path") == PROJECT), TZ)


@query("agg_15_project_costs", f"""{BASE}, {BOUND}, names AS (SELECT project_path, arg_max(project_name, w) AS project_name FROM (SELECT project_path, project_name, sum(input_tokens + output_tokens) AS w FROM bounded GROUP BY 1, 2) GROUP BY 1),
  sets AS (SELECT project_path, provider, model, count(DISTINCT session_id) AS sessions, CAST(sum({ALL}) AS BIGINT) AS tokens, {COST}, grouping(provider) AS gp, grouping(model) AS gm FROM bounded GROUP BY GROUPING SETS ((project_path), (project_path, provider), (project_path, model)))
  SELECT project_path, project_name, CASE WHEN gp = 0 THEN 'provider' WHEN gm = 0 THEN 'model' ELSE 'all' END AS part, coalesce(provider, model, '') AS name, sessions, tokens, cost_usd FROM sets JOIN names USING (project_path)""")
def agg_15(spark, sf):
    costs = reports.project_costs(bounded(spark, sf))
    whole = costs.select("project_path", "project_name", F.lit("all").alias("part"), F.lit("").alias("name"), "sessions", "tokens", "cost_usd")
    for part in ("provider", "model"):
        whole = whole.unionByName(costs.select("project_path", "project_name", F.lit(part).alias("part"), F.explode(f"by_{part}").alias("x")).select("project_path", "project_name", "part", "x.*"))
    return whole


@query("agg_16_recent_sessions", f"""{BASE}, {BOUND}, {DETAIL_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {ALL} DESC, cost_usd DESC, model) AS n FROM detail)
  SELECT session_id, updated_at, max(CASE WHEN n = 1 THEN model END) AS model, {SUM4}, {COST} FROM ranked GROUP BY 1, 2""")
def agg_16(spark, sf):
    return reports.recent_sessions(agg_8(spark, sf))


@query("agg_17_cache_hit_rate", f"{BASE}, {BOUND} SELECT provider, round(coalesce(sum(cache_read_tokens) / nullif(sum(cache_read_tokens) + sum(input_tokens), 0), 0), 6) AS rate FROM bounded GROUP BY 1")
def agg_17(spark, sf):
    sums = bounded(spark, sf).groupBy("provider").agg(*reports.sums())
    return sums.select("provider", F.round(reports.cache_hit_rate(), 6).alias("rate"))


@query("agg_18_previous_period", f"{BASE} SELECT count(DISTINCT session_id) AS sessions, {ZERO4}, coalesce(round(sum(cost_usd) + 1e-9, 4), 0) AS cost_usd FROM base WHERE bucket >= 2 * {START_SQL} - {END_SQL} AND bucket < {START_SQL}")
def agg_18(spark, sf):
    return reports.previous_period(base(spark, sf), START, END)


@query("agg_23_trend_percent", f"{BASE} SELECT provider, round((now - before) / nullif(before, 0), 6) AS trend FROM (SELECT provider, sum(CASE WHEN bucket >= {START_SQL} AND bucket < {END_SQL} THEN {ALL} ELSE 0 END) AS now, sum(CASE WHEN bucket >= 2 * {START_SQL} - {END_SQL} AND bucket < {START_SQL} THEN {ALL} ELSE 0 END) AS before FROM base GROUP BY 1)")
def agg_23(spark, sf):
    inside = lambda a, b: F.sum(F.when((F.col("bucket") >= a) & (F.col("bucket") < b), usage.total()).otherwise(0))
    sums = base(spark, sf).groupBy("provider").agg(inside(START, END).alias("now"), inside(2 * START - END, START).alias("before"))
    return sums.select("provider", F.round(reports.trend_percent(F.col("now"), F.col("before")), 6).alias("trend"))


PROVIDERS = ["urgent", "high", "medium", "not specified", "low"]
DAILY_SQL = f"daily AS (SELECT {DAY} AS date, provider, CAST(sum({ALL}) AS BIGINT) AS tokens FROM bounded GROUP BY 1, 2)"


@query("agg_24_daily_chart", f"{BASE}, {BOUND}, {DAILY_SQL} SELECT date, {', '.join(f'''CAST(coalesce(sum(tokens) FILTER (provider = '{p}'), 0) AS BIGINT) AS {p.replace(' ', '_')}''' for p in PROVIDERS)}, CAST(sum(tokens) AS BIGINT) AS total FROM daily GROUP BY 1")
def agg_24(spark, sf):
    return reports.daily_chart(reports.daily(bounded(spark, sf), TZ), "tokens", PROVIDERS)


@query("agg_25_day_breakdown", f"{BASE}, {BOUND}, {DAILY_SQL} SELECT provider, tokens AS value, CAST(sum(tokens) OVER () AS BIGINT) AS total FROM daily WHERE date = '1998-03-05' AND tokens > 0")
def agg_25(spark, sf):
    return reports.day_breakdown(reports.daily(bounded(spark, sf), TZ), "1998-03-05", "tokens")


@query("agg_26_trend_series", f"""{BASE}, {BOUND}, d AS (SELECT {DAY} AS date, model, sum({ALL}) AS v FROM bounded GROUP BY 1, 2),
  top AS (SELECT model, row_number() OVER (ORDER BY sum(v) DESC, model) AS rank FROM d GROUP BY 1 HAVING sum(v) > 0 ORDER BY 2 LIMIT 6),
  axis AS (SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS date FROM range(DATE '1997-01-01', DATE '1999-01-01', INTERVAL 1 DAY) t(x))
  SELECT CAST(rank AS INTEGER) AS rank, top.model AS name, axis.date, CAST(coalesce(v, 0) AS BIGINT) AS value FROM top CROSS JOIN axis LEFT JOIN d ON d.model = top.model AND d.date = axis.date""")
def agg_26(spark, sf):
    rows = bounded(spark, sf).withColumn("date", times.civil_date("bucket", TZ)).withColumn("tokens", usage.total())
    return reports.trend_series(rows, "tokens", "model", 6, "1997-01-01", "1998-12-31")


@query("agg_27_heatmap_grid", f"""{BASE}, {BOUND}, d AS (SELECT {DAY} AS date, CAST(sum({ALL}) AS BIGINT) AS v FROM bounded GROUP BY 1), w AS (SELECT * FROM d WHERE date BETWEEN '1998-01-01' AND '1998-12-31'),
  s AS (SELECT v, row_number() OVER (ORDER BY v) AS n, count(*) OVER () AS c FROM w WHERE v > 0),
  t AS (SELECT max(v) FILTER (n = least(c - 1, floor(0.25 * c)) + 1) AS t0, max(v) FILTER (n = least(c - 1, floor(0.5 * c)) + 1) AS t1, max(v) FILTER (n = least(c - 1, floor(0.75 * c)) + 1) AS t2 FROM s),
  g AS (SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS date, CAST(date_diff('day', DATE '1997-12-28', CAST(x AS DATE)) AS INTEGER) AS i FROM range(DATE '1997-12-28', DATE '1999-01-03', INTERVAL 1 DAY) r(x))
  SELECT i // 7 AS week, i % 7 AS weekday, g.date, coalesce(v, 0) AS value, CASE WHEN coalesce(v, 0) <= 0 THEN 0 WHEN v <= t0 THEN 1 WHEN v <= t1 THEN 2 WHEN v <= t2 THEN 3 ELSE 4 END AS level,
    CASE WHEN g.date BETWEEN '1998-01-01' AND '1998-12-31' AND substr(g.date, 9, 2) = '01' THEN substr(g.date, 1, 7) END AS month FROM g LEFT JOIN w USING (date) CROSS JOIN t""")
def agg_27(spark, sf):
    return reports.heatmap_grid(reports.activity_daily(bounded(spark, sf), TZ), "tokens", "1998-01-01", "1998-12-31")


@query("agg_29_token_mix", f"{BASE}, {BOUND}, s AS (SELECT {ZERO4} FROM bounded), u AS (UNPIVOT (SELECT * EXCLUDE turn_count FROM s) ON * INTO NAME counter VALUE tokens) SELECT counter, tokens, round(tokens / sum(tokens) OVER (), 6) AS share FROM u")
def agg_29(spark, sf):
    return reports.token_mix(bounded(spark, sf))


@query("agg_30_folder_overview", f"{BASE}, {BOUND} SELECT project_path, CAST(sum({ALL}) AS BIGINT) AS tokens, {COST}, round(sum({ALL}) / (SELECT sum({ALL}) FROM bounded), 6) AS share FROM bounded GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def agg_30(spark, sf):
    return reports.folder_overview(bounded(spark, sf))


@query("agg_31_sort_limit", f"{BASE}, {BOUND} SELECT session_id, model, {SUM4}, {COST} FROM bounded GROUP BY 1, 2 ORDER BY cost_usd DESC NULLS LAST, concat(session_id, ' ', model) LIMIT 25")
def agg_31(spark, sf):
    rows = bounded(spark, sf).groupBy("session_id", "model").agg(*reports.sums(), reports.dollars().alias("cost_usd"))
    return reports.sort_limit(rows.withColumn("key", F.concat("session_id", F.lit(" "), "model")), "cost_usd", "key").drop("key")


@query("agg_32_provider_counts", f"WITH {T.SESSIONS_SQL} SELECT provider, count(*) AS sessions FROM sessions GROUP BY 1")
def agg_32(spark, sf):
    return reports.provider_counts(T.sessions(spark, sf))


@query("agg_33_provider_snapshots", f"WITH {T.SESSIONS_SQL}, p(position, provider) AS (VALUES {', '.join(f'''({i}, '{p}')''' for i, p in enumerate([*PROVIDERS, 'none']))}) SELECT position, p.provider, count(id) AS sessions FROM p LEFT JOIN sessions s USING (provider) GROUP BY 1, 2")
def agg_33(spark, sf):
    return reports.provider_snapshots(spark.createDataFrame(list(enumerate([*PROVIDERS, "none"])), "position int, provider string"), T.sessions(spark, sf))


@query("agg_34_child_counts", f"WITH {T.SESSIONS_SQL} SELECT parent_id, count(*) AS children FROM sessions WHERE parent_id IN (SELECT id FROM sessions WHERE project_path = '{PROJECT}') GROUP BY 1")
def agg_34(spark, sf):
    rows = T.sessions(spark, sf)
    return reports.child_counts(rows, rows.where(F.col("project_path") == PROJECT))


@query("use_2_dedup_max", f"WITH {T.EVENTS_SQL}, {DEDUP_SQL} SELECT session_id, seq, usage_hash, {ALL} AS tokens FROM deduped")
def use_2(spark, sf):
    return usage.dedup_max(T.usage_events(spark, sf)).select("session_id", "seq", "usage_hash", usage.total().alias("tokens"))


CROSS_SQL = f"""shared AS (SELECT * REPLACE (concat(session_id % 5000, ':', cache_write_tokens // 7) AS usage_hash) FROM usage_events),
  claimed AS (SELECT e.* FROM shared e JOIN sessions s ON e.session_id = s.id QUALIFY row_number() OVER (PARTITION BY s.provider, usage_hash ORDER BY s.parent_id IS NOT NULL, session_id, seq) = 1)"""


def shared_hashes(spark, sf):
    return T.usage_events(spark, sf).withColumn("usage_hash", F.expr("concat(session_id % 5000, ':', cache_write_tokens div 7)"))


@query("use_3_dedup_cross", f"WITH {T.EVENTS_SQL}, {T.SESSIONS_SQL}, {CROSS_SQL} SELECT session_id, seq, usage_hash FROM claimed WHERE ts IS NOT NULL AND model NOT IN ('', '<synthetic>')")
def use_3(spark, sf):
    return usage.valid_usage(usage.dedup_cross(shared_hashes(spark, sf), T.sessions(spark, sf))).select("session_id", "seq", "usage_hash")


@query("use_4_invalid_counts", f"WITH {T.EVENTS_SQL} SELECT CASE WHEN ts IS NULL THEN 'no_timestamp' WHEN model = '' THEN 'no_model' ELSE 'synthetic' END AS reason, count(*) AS n FROM usage_events WHERE ts IS NULL OR model IN ('', '<synthetic>') GROUP BY 1")
def use_4(spark, sf):
    return usage.invalid_counts(T.usage_events(spark, sf))


@query("use_1_usage_source", f"WITH {T.EVENTS_SQL}, e AS (SELECT * FROM usage_events WHERE session_id % 2 = 0), m AS (SELECT * FROM usage_events WHERE seq <= 2) SELECT session_id, seq, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM m WHERE session_id NOT IN (SELECT session_id FROM e)) GROUP BY 1, 2")
def use_1(spark, sf):
    events = T.usage_events(spark, sf)
    return usage.usage_source(events.where("seq <= 2"), events.where("session_id % 2 = 0")).groupBy("session_id", "seq").agg(F.count("*").alias("n"))


@query("use_13_session_totals", f"WITH {T.EVENTS_SQL} SELECT session_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in usage.COUNTERS)} FROM usage_events GROUP BY 1")
def use_13(spark, sf):
    return usage.session_totals(T.usage_events(spark, sf))


@query("use_14_indexed_totals", f"{FACTS} SELECT session_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in usage.COUNTERS)} FROM stats GROUP BY 1")
def use_14(spark, sf):
    return usage.indexed_totals(facts(spark, sf))


@query("use_15_with_totals", f"{FACTS}, {T.SESSIONS_SQL} SELECT s.id, s.provider, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in usage.COUNTERS)} FROM sessions s LEFT JOIN stats t ON t.session_id = s.id GROUP BY 1, 2")
def use_15(spark, sf):
    return usage.with_totals(T.sessions(spark, sf), facts(spark, sf)).select("id", "provider", *usage.COUNTERS)


@query("use_7_drop_exact_repeats", f"WITH {T.EVENTS_SQL} SELECT session_id, seq FROM usage_events QUALIFY row_number() OVER (PARTITION BY session_id, model, input_tokens // 1000, cache_write_tokens ORDER BY seq) = 1")
def use_7(spark, sf):
    rows = T.usage_events(spark, sf).withColumn("k", F.expr("input_tokens div 1000"))
    return usage.drop_exact_repeats(rows, ["model", "k", "cache_write_tokens"]).select("session_id", "seq")


@query("use_9_fill_model", f"""WITH {T.EVENTS_SQL}, r AS (SELECT session_id, seq, CASE WHEN seq % 4 = 1 THEN nullif(model, '') END AS info, CASE WHEN seq % 3 = 2 THEN concat('p', model) END AS payload, CASE WHEN seq % 5 = 3 THEN concat('c', model) END AS ctx, CASE WHEN seq % 2 = 0 THEN 'u' END AS own FROM usage_events),
  f AS (SELECT session_id, seq, coalesce(info, payload, last_value(coalesce(info, payload, ctx) IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), own) AS model FROM r),
  o AS (SELECT session_id, CASE WHEN count(DISTINCT model) = 1 THEN max(model) END AS only_one FROM f GROUP BY 1) SELECT session_id, seq, coalesce(model, only_one) AS model FROM f JOIN o USING (session_id)""")
def use_9(spark, sf):
    rows = T.usage_events(spark, sf).selectExpr("session_id", "seq", "if(seq % 4 = 1, nullif(model, ''), null) as info_model", "if(seq % 3 = 2, concat('p', model), null) as payload_model", "if(seq % 5 = 3, concat('c', model), null) as context_model", "if(seq % 2 = 0, 'u', null) as usage_model")
    return usage.fill_model(rows).select("session_id", "seq", "model")


@query("use_6_counter_delta", f"""WITH {T.event_messages_sql()}, r AS (SELECT session_id, msg_index AS seq, CASE WHEN msg_index % 7 = 3 THEN input_tokens END AS last_in, CASE WHEN msg_index % 7 <> 3 THEN sum(coalesce(input_tokens, 0)) OVER (PARTITION BY session_id, ts_ms // 86400000 ORDER BY msg_index) END AS total_in FROM messages)
  SELECT session_id, seq, CAST(coalesce(last_in, greatest(0, total_in - coalesce(last_value(total_in IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS input_tokens FROM r""")
def use_6(spark, sf):
    day = Window.partitionBy("session_id", F.expr("ts_ms div 86400000")).orderBy("msg_index")
    rows = T.event_messages(spark, sf).select(
        "session_id", F.col("msg_index").alias("seq"), F.expr("if(msg_index % 7 = 3, input_tokens, null)").alias("last_input_tokens"),
        F.when(F.col("msg_index") % 7 != 3, F.sum(F.coalesce("input_tokens", F.lit(0))).over(day)).alias("total_input_tokens"),
    )
    return usage.counter_delta(rows, ["input_tokens"], segment_rows=40).select("session_id", "seq", "input_tokens")


@query("use_8_skip_replay_burst", f"""WITH {T.event_messages_sql(100000)}, r AS (SELECT session_id, msg_index, session_id % 2 = 0 AS forked, ts_ms // 1000 AS sec FROM messages), f AS (SELECT *, first_value(sec) OVER w AS first_sec FROM r WINDOW w AS (PARTITION BY session_id ORDER BY msg_index)),
  g AS (SELECT *, bool_or(sec > first_sec) OVER (PARTITION BY session_id ORDER BY msg_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gone FROM f) SELECT session_id, msg_index, forked AND NOT gone AS primes_only FROM g""")
def use_8(spark, sf):
    rows = T.event_messages(spark, sf, 100000).withColumn("seq", F.col("msg_index")).withColumn("forked", F.col("session_id") % 2 == 0)
    return usage.skip_replay_burst(rows).select("session_id", "msg_index", "primes_only")


@query("use_12_estimate_from_chars", f"""WITH {T.CHAT_SQL}, c AS (SELECT session_id, msg_index, role, length(coalesce(content, '')) AS n, coalesce(sum(length(coalesce(content, ''))) OVER (PARTITION BY session_id ORDER BY msg_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM messages)
  SELECT session_id, msg_index, CAST(greatest(1, before // 4) AS BIGINT) AS input_tokens, CAST(greatest(1, n // 4) AS BIGINT) AS output_tokens FROM c WHERE role = 'assistant'""")
def use_12(spark, sf):
    return usage.estimate_from_chars(T.chat_messages(spark, sf), segment_rows=3)


@query("use_11_ticks_to_usd", """WITH t AS (SELECT l_orderkey AS session_id, l_linenumber AS turn, count(*) AS models, CAST(sum(l_extendedprice) * 100 AS BIGINT) AS turn_ticks, min(l_suppkey) % 5 = 0 AS incomplete FROM lineitem GROUP BY 1, 2),
  m AS (SELECT l_orderkey AS session_id, l_linenumber AS turn, l_returnflag AS model, max(CASE WHEN l_partkey % 3 = 0 THEN l_partkey * 100000 END) AS ticks FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT session_id, turn, count(*) AS models FROM m GROUP BY 1, 2)
  SELECT m.session_id, m.turn, model, round(CASE WHEN NOT incomplete THEN coalesce(ticks, CASE WHEN c.models = 1 THEN turn_ticks END) / 1e10 END, 6) AS cost_usd FROM m JOIN t USING (session_id, turn) JOIN c USING (session_id, turn)""")
def use_11(spark, sf):
    line = T.read(spark, sf, "lineitem")
    models = line.groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.max(F.expr("if(l_partkey % 3 = 0, l_partkey * 100000, null)")).alias("ticks"))
    maps = models.groupBy("l_orderkey", "l_linenumber").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "ticks"))).alias("model_usage"))
    turns = line.groupBy("l_orderkey", "l_linenumber").agg((F.sum("l_extendedprice") * 100).cast("bigint").alias("turn_ticks"), (F.min("l_suppkey") % 5 == 0).alias("incomplete"))
    rows = turns.join(maps, ["l_orderkey", "l_linenumber"]).withColumn("partial", F.lit(False)).withColumnRenamed("l_orderkey", "session_id").withColumnRenamed("l_linenumber", "turn")
    return usage.ticks_to_usd(rows).withColumn("cost_usd", F.round("cost_usd", 6))


@query("use_20_fold_steps", f"""WITH {T.event_messages_sql()}, r AS (SELECT session_id, msg_index AS seq, CASE WHEN role = 'user' THEN 'prompt' WHEN role = 'tool' AND tool_name = 'exec_command' THEN 'close' ELSE 'step' END AS type, CASE WHEN msg_index % 2 = 0 THEN 'turn' ELSE 'session' END AS scope, coalesce(input_tokens, msg_index) AS n FROM messages),
  t AS (SELECT *, sum(CASE WHEN type = 'prompt' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS turn FROM r)
  SELECT session_id, CAST(turn AS BIGINT) AS turn, CAST(coalesce(arg_max(n, seq) FILTER (type = 'close' AND scope = 'turn'), sum(n) FILTER (type = 'step')) AS BIGINT) AS input_tokens FROM t WHERE type <> 'prompt' GROUP BY 1, 2""")
def use_20(spark, sf):
    rows = T.event_messages(spark, sf).selectExpr("session_id", "msg_index as seq", "case when role = 'user' then 'prompt' when tool_name = 'exec_command' then 'close' else 'step' end as type", "if(msg_index % 2 = 0, 'turn', 'session') as scope", "coalesce(input_tokens, msg_index) as input_tokens", "0L as output_tokens", "0L as cache_read_tokens", "0L as cache_write_tokens")
    return usage.fold_step_usage(rows).select("session_id", "turn", "input_tokens")


@query("use_16_tool_stats", f"WITH {T.event_messages_sql()} SELECT session_id, CASE tool_name WHEN 'read_file' THEN 'Read' ELSE tool_name END AS tool_key, CASE tool_name WHEN 'read_file' THEN 'Read' ELSE tool_name END AS label, CASE tool_name WHEN 'read_file' THEN 'file' ELSE 'tool' END AS category, count(*) AS count FROM messages WHERE role = 'tool' GROUP BY ALL")
def use_16(spark, sf):
    rows = T.event_messages(spark, sf)
    named = rows.selectExpr("*", "if(tool_name = 'read_file', ' Read ', '  ') as canonical", "cast(null as string) as display", "if(tool_name = 'read_file', 'file', null) as category")
    return usage.tool_stats(named)


@query("pr_5_price_lookup", f"""WITH {T.PRICES_SQL}, m AS (SELECT DISTINCT concat(CASE l_linenumber % 4 WHEN 0 THEN 'acme/' ELSE '' END, l_returnflag, l_linestatus, CASE l_linenumber % 3 WHEN 0 THEN '-20250514' WHEN 1 THEN '.1' ELSE '' END, CASE l_linenumber % 5 WHEN 0 THEN '-fast' ELSE '' END) AS model FROM lineitem)
  SELECT model, p_in AS input, p_out AS output FROM m JOIN prices ON regexp_replace(regexp_replace(regexp_replace(lower(model), '^.*/', ''), '-fast$', ''), '(-[0-9]{{4,}}|[.][0-9]+)$', '') = model_key""")
def pr_5(spark, sf):
    model = "concat(case l_linenumber % 4 when 0 then 'acme/' else '' end, l_returnflag, l_linestatus, case l_linenumber % 3 when 0 then '-20250514' when 1 then '.1' else '' end, case l_linenumber % 5 when 0 then '-fast' else '' end)"
    models = T.read(spark, sf, "lineitem").selectExpr(f"{model} as model").distinct()
    return pricing.lookup(models, T.prices(spark)).select("model", "input", "output")


@query("pr_6_estimate_cost", f"""WITH {T.PRICES_SQL}, u AS (SELECT l_orderkey AS session_id, concat(l_returnflag, l_linestatus) AS model, CAST(sum(l_quantity) * 4000 AS BIGINT) AS input_tokens, CAST(sum(l_partkey) AS BIGINT) * 100 AS output_tokens, CAST(sum(l_suppkey) AS BIGINT) AS cache_read_tokens, CAST(count(*) AS BIGINT) AS cache_write_tokens FROM lineitem GROUP BY 1, 2)
  SELECT session_id, model, round(coalesce({TIER.format(above='p_in_above', n='input_tokens', p='p_in')} + {TIER.format(above='p_out_above', n='output_tokens', p='p_out')} + cache_read_tokens * p_read + cache_write_tokens * p_write, 0) + 1e-9, 4) AS cost FROM u LEFT JOIN prices ON lower(model) = model_key""")
def pr_6(spark, sf):
    used = T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.concat("l_returnflag", "l_linestatus").alias("model")).agg(
        (F.sum("l_quantity") * 4000).cast("bigint").alias("input_tokens"), (F.sum("l_partkey") * 100).alias("output_tokens"), F.sum("l_suppkey").alias("cache_read_tokens"), F.count("*").alias("cache_write_tokens"))
    known = pricing.lookup(used, T.prices(spark))
    cost = F.when(F.col("input").isNull(), 0.0).otherwise(pricing.estimate_cost())
    return used.join(F.broadcast(known), "model", "left").select("session_id", "model", F.round(cost + 1e-9, 4).alias("cost"))


@query("pr_7_resolve_cost", f"WITH {T.PRICES_SQL}, {T.EVENTS_SQL}, {DEDUP_SQL}, {VALID_SQL}, {COST_SQL} SELECT session_id, seq, round(cost + 1e-10, 6) AS cost FROM priced")
def pr_7(spark, sf):
    return usage.priced(usage.valid_usage(usage.dedup_max(T.usage_events(spark, sf))), T.prices(spark)).select("session_id", "seq", F.round(F.col("cost") + 1e-10, 6).alias("cost"))


def catalog_rows(spark, sf):
    """A catalog as JSON made of parts: suppliers' nations are providers, parts are models."""
    part = T.read(spark, sf, "part").selectExpr("concat('P', p_partkey % 7) as provider", "concat('Model-', p_partkey % 40) as model", "(p_partkey % 11) - 1.0 as i", "(p_partkey % 5) - 1.0 as o").groupBy("provider", "model").agg(F.max("i").alias("i"), F.max("o").alias("o"))
    models = part.groupBy("provider").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(F.struct(F.col("i").alias("input"), F.col("o").alias("output")).alias("cost"))))).alias("models"))
    return models.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("provider", F.struct("models"))))).alias("json"))


CATALOG_SQL = """flat AS (SELECT concat('p', p_partkey % 7, '/model-', p_partkey % 40) AS model_key, concat('P', p_partkey % 7) AS provider_id, concat('Model-', p_partkey % 40) AS model_id, max((p_partkey % 11) - 1.0) AS i, max((p_partkey % 5) - 1.0) AS o FROM part GROUP BY 1, 2, 3),
  priced AS (SELECT model_key, provider_id, model_id, CASE WHEN i > 0 THEN i / 1e6 END AS input, CASE WHEN o > 0 THEN o / 1e6 END AS output FROM flat WHERE i > 0 OR o > 0)"""


@query("pr_1_flatten_catalog", f"WITH {CATALOG_SQL} SELECT model_key, round(input * 1e6, 4) AS input, round(output * 1e6, 4) AS output FROM priced")
def pr_1(spark, sf):
    return pricing.flatten_catalog(catalog_rows(spark, sf)).selectExpr("model_key", "round(input * 1e6, 4) as input", "round(output * 1e6, 4) as output")


@query("pr_2_short_aliases", f"WITH {CATALOG_SQL}, short AS (SELECT lower(model_id) AS model_key, input, output FROM priced QUALIFY row_number() OVER (PARTITION BY lower(model_id) ORDER BY provider_id, model_id) = 1) SELECT model_key, round(input * 1e6, 4) AS input, round(output * 1e6, 4) AS output FROM (SELECT model_key, input, output FROM priced UNION ALL SELECT * FROM short)")
def pr_2(spark, sf):
    return pricing.short_aliases(pricing.flatten_catalog(catalog_rows(spark, sf))).selectExpr("model_key", "round(input * 1e6, 4) as input", "round(output * 1e6, 4) as output")


@query("pr_3_cached_aliases", f"WITH {CATALOG_SQL}, short AS (SELECT substr(model_key, strpos(model_key, '/') + 1) AS model_key, input, output FROM priced QUALIFY row_number() OVER (PARTITION BY substr(model_key, strpos(model_key, '/') + 1) ORDER BY priced.model_key) = 1) SELECT model_key, round(input * 1e6, 4) AS input FROM (SELECT model_key, input FROM priced UNION ALL SELECT model_key, input FROM short)")
def pr_3(spark, sf):
    return pricing.cached_aliases(pricing.flatten_catalog(catalog_rows(spark, sf))).selectExpr("model_key", "round(input * 1e6, 4) as input")


@query("pr_8_catalog_model_count", "SELECT CAST(count(*) AS BIGINT) AS models FROM (SELECT DISTINCT p_partkey % 7, p_partkey % 40 FROM part)")
def pr_8(spark, sf):
    parsed = catalog_rows(spark, sf).select(F.explode(F.from_json("json", pricing.CATALOG)).alias("k", "p"))
    return parsed.agg(F.sum(F.size("p.models")).alias("models"))
