"""Exports written piece by piece against the documents made whole."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlog.sources import sinks
from fleetlog.sources import tables as T


@pytest.fixture(scope="module")
def chats(spark, sf):
    messages = T.chat_messages(spark, sf).withColumn("tool_name", F.lit(None).cast("string"))
    sessions = messages.select(F.col("session_id").alias("id")).distinct().selectExpr("id", "concat('a/b:', id) as title", "1500L as input_tokens", "if(id % 2 = 0, 5L, 0L) as output_tokens")
    return sessions.unionByName(spark.createDataFrame([(123456789, "same", 0, 0), (123456780, "same", 0, 0)], sessions.schema)), messages


def read(folder):
    return {p.name: p.read_text(newline="") for p in folder.iterdir() if p.is_file() and not p.name.startswith(".")}


def test_markdown_files_equal_documents(chats, tmp_path):
    sessions, messages = chats
    written = sinks.export_files(sinks.markdown_pieces(sessions, messages), sessions, f"file://{tmp_path}/out", "md").collect()
    files = read(tmp_path / "out")
    docs = {str(r.id): r.doc for r in sinks.export_markdown(sessions, messages).collect()}
    assert len(written) == len(files) == len(docs) and all(files[r.file_name] == docs[r.id] and r.bytes == len(docs[r.id].encode()) for r in written)
    # Ids that agree in their first 8 characters keep files of their own.
    assert {"same_123456789.md", "same_123456780.md"} <= set(files)
    assert not list((tmp_path / "out").glob(".*.part"))


def test_json_files_equal_documents(chats, tmp_path):
    sessions, messages = chats
    written = sinks.export_files(sinks.json_pieces(sessions, messages), sessions, f"file://{tmp_path}/out", "json").collect()
    files = read(tmp_path / "out")
    docs = {str(r.id): json.loads(r.doc) for r in sinks.export_json(sessions, messages).collect()}
    assert {r.id: json.loads(files[r.file_name]) for r in written} == {k: {"messages": []} | d for k, d in docs.items()}


def test_a_large_session_is_streamed(spark, tmp_path):
    n, text = 60, "x" * (1 << 20)
    messages = spark.range(n).select(F.lit(1).alias("session_id"), F.col("id").alias("msg_index"), F.lit("user").alias("role"), F.lit(text).alias("content"), F.lit(None).cast("string").alias("tool_name"))
    sessions = spark.createDataFrame([(1, "large", 0, 0)], "id int, title string, input_tokens long, output_tokens long")
    (row,) = sinks.export_files(sinks.markdown_pieces(sessions, messages), sessions, f"file://{tmp_path}/out", "md").collect()
    assert row.bytes == (tmp_path / "out" / row.file_name).stat().st_size > n << 20
