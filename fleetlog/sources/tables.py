"""The engine's tables over the driver's parquet tables, as DataFrames and as SQL views of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str) -> str:
    """SQL for the epoch second of a timestamp without zone, whatever the session's zone is."""
    return f"timestampdiff(SECOND, {EPOCH}, {column})"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "lower(split_part(o_orderpriority, '-', 2)) as provider",
        "concat('order ', o_orderstatus, ' ', o_orderkey) as title",
        "concat('order ', o_orderstatus, ' ', o_orderkey, ' ', o_orderpriority) as content_text",
        "concat('/work/c', o_custkey % 50) as project_path",
        "concat('c', o_custkey % 25) as project_name",
        f"{epoch('o_orderdate')} + o_orderkey % 86400 as created_at",
        f"{epoch('o_orderdate')} + o_orderkey % 86400 + o_orderkey % 977 as updated_at",
        "if(o_orderkey % 7 in (3, 4), o_orderkey - 1, null) as parent_id",
        "o_orderkey % 7 in (3, 4) as is_sidechain",
        "if(o_orderkey % 6 = 0, null, concat('m', o_orderkey % 6)) as model",
    )


SESSIONS_SQL = """sessions AS (
  SELECT o_orderkey AS id, lower(split_part(o_orderpriority, '-', 2)) AS provider,
    concat('order ', o_orderstatus, ' ', o_orderkey) AS title, concat('order ', o_orderstatus, ' ', o_orderkey, ' ', o_orderpriority) AS content_text,
    concat('/work/c', o_custkey % 50) AS project_path, concat('c', o_custkey % 25) AS project_name,
    CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS created_at,
    CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 + o_orderkey % 977 AS updated_at,
    CASE WHEN o_orderkey % 7 IN (3, 4) THEN o_orderkey - 1 END AS parent_id, o_orderkey % 7 IN (3, 4) AS is_sidechain,
    CASE WHEN o_orderkey % 6 <> 0 THEN concat('m', o_orderkey % 6) END AS model FROM orders)"""

LINE_ORDER = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER.split(", ")))
    return line.withColumn("seq", seq).selectExpr(
        "l_orderkey as session_id",
        "seq",
        "if(l_partkey % 97 = 0, null, date_format(timestampadd(MINUTE, l_partkey % 1440, l_shipdate), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")) as ts",
        "case when l_suppkey % 53 = 0 then '<synthetic>' when l_suppkey % 59 = 0 then '' else concat(l_returnflag, l_linestatus) end as model",
        "1L as turn_count",
        "cast(l_quantity * 100 as bigint) as input_tokens",
        "l_partkey % 500 as output_tokens",
        "l_suppkey * 10 as cache_read_tokens",
        "cast(l_linenumber * 7 as bigint) as cache_write_tokens",
        "concat(l_orderkey, ':', l_linenumber) as usage_hash",
        "if(l_linenumber % 2 = 1, l_extendedprice / 10000, null) as cost_usd",
    )


EVENTS_SQL = f"""usage_events AS (
  SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS seq,
    CASE WHEN l_partkey % 97 <> 0 THEN strftime(l_shipdate + to_minutes(l_partkey % 1440), '%Y-%m-%dT%H:%M:%SZ') END AS ts,
    CASE WHEN l_suppkey % 53 = 0 THEN '<synthetic>' WHEN l_suppkey % 59 = 0 THEN '' ELSE concat(l_returnflag, l_linestatus) END AS model,
    1 AS turn_count, CAST(l_quantity * 100 AS BIGINT) AS input_tokens, l_partkey % 500 AS output_tokens, l_suppkey * 10 AS cache_read_tokens,
    CAST(l_linenumber * 7 AS BIGINT) AS cache_write_tokens, concat(l_orderkey, ':', l_linenumber) AS usage_hash,
    CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice / 10000 END AS cost_usd FROM lineitem)"""

#: Rates per token. NO is dearer above the threshold, RF has no price on purpose.
PRICES = [
    ("af", 3e-6, 15e-6, 0.3e-6, 3.75e-6, None, None),
    ("ao", 1e-6, 5e-6, 0.1e-6, 1.25e-6, None, None),
    ("nf", 2e-6, 8e-6, 0.5e-6, 0.0, None, None),
    ("ro", 0.5e-6, 2e-6, 0.05e-6, 0.6e-6, None, None),
    ("no", 4e-6, 20e-6, 0.4e-6, 5e-6, 8e-6, 30e-6),
]
PRICE_SCHEMA = "model_key string, input double, output double, cache_read double, cache_write double, input_above double, output_above double"


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, PRICE_SCHEMA)


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)"


PRICES_SQL = "prices(model_key, p_in, p_out, p_read, p_write, p_in_above, p_out_above) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in PRICES) + ")"

ROLES = {"signup": "user", "view": "assistant", "click": "tool", "purchase": "tool", "error": "system"}


def event_messages(spark: SparkSession, sf_dir: str, squeeze: int = 1) -> DataFrame:
    """Messages of one user each over `events`; `squeeze` divides the time since the first day."""
    start = "TIMESTAMP_NTZ'2024-01-01'"
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    made = read(spark, sf_dir, "events").withColumn("n", seq)
    return made.selectExpr(
        "user_id as session_id", "cast(n as bigint) as msg_index",
        f"timestampdiff(MICROSECOND, {start}, ts) div 1000 div {squeeze} as ts_ms",
        "case event_type when 'signup' then 'user' when 'view' then 'assistant' when 'click' then 'tool' when 'purchase' then 'tool' else 'system' end as role",
        "case event_type when 'click' then 'read_file' when 'purchase' then 'exec_command' end as tool_name",
        "concat(event_type, ' ', event_id) as content",
        "if(event_type = 'view', cast(floor(value * 100) as bigint), null) as input_tokens",
        "if(event_type = 'view', event_id % 300, null) as output_tokens",
        "if(event_type = 'view', cast(get_json_object(props, '$.k') as bigint), null) as cache_read_tokens",
        "if(event_type = 'view', 0L, null) as cache_write_tokens",
    )


def event_messages_sql(squeeze: int = 1) -> str:
    return f"""messages AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS msg_index,
    ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000) // {squeeze} AS ts_ms,
    CASE event_type WHEN 'signup' THEN 'user' WHEN 'view' THEN 'assistant' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'tool' ELSE 'system' END AS role,
    CASE event_type WHEN 'click' THEN 'read_file' WHEN 'purchase' THEN 'exec_command' END AS tool_name,
    concat(event_type, ' ', event_id) AS content,
    CASE WHEN event_type = 'view' THEN CAST(floor(value * 100) AS BIGINT) END AS input_tokens,
    CASE WHEN event_type = 'view' THEN event_id % 300 END AS output_tokens,
    CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS cache_read_tokens,
    CASE WHEN event_type = 'view' THEN 0 END AS cache_write_tokens FROM events)"""


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").selectExpr("conv_id as session_id", "cast(turn as bigint) as msg_index", "role", "text as content")


CHAT_SQL = "messages AS (SELECT conv_id AS session_id, turn AS msg_index, role, text AS content FROM conversations)"


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr("doc_id as id", "substr(text, 1, 40) as title", "text as content_text", "source as project_name", "lang as provider", "doc_id * 7919 % 1000 as created_at")


DOCS_SQL = "docs AS (SELECT doc_id AS id, substr(text, 1, 40) AS title, text AS content_text, source AS project_name, lang AS provider, doc_id * 7919 % 1000 AS created_at FROM documents)"


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").where("quality = 1").selectExpr("doc_id as session_id", "doc_id * 60 as added_at")


FAVORITES_SQL = "favorites AS (SELECT doc_id AS session_id, doc_id * 60 AS added_at FROM labels WHERE quality = 1)"
