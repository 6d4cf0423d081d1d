"""Exports of sessions, and writing of the fact tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fmt_tokens
from ..operators.order import renderable
from .kept import children, remove

BAD_CHARACTERS = '/\\:*?"<>|'


def _ordered(value: Column) -> Column:
    """Values of a session in message order; a session's messages are one export, so one group."""
    return F.transform(F.sort_array(F.collect_list(F.struct("msg_index", value.alias("v")))), lambda x: x["v"])


def export_json(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, doc): one JSON document with meta and messages for each session."""
    body = messages.groupBy(F.col("session_id").alias("id")).agg(_ordered(F.struct(*[c for c in messages.columns if c != "session_id"])).alias("messages"))
    meta = F.struct(*sessions.columns)
    return sessions.join(body, "id", "left").select("id", F.to_json(F.struct(meta.alias("meta"), F.col("messages"))).alias("doc"))


def _markdown_parts(messages: DataFrame) -> DataFrame:
    """The rows that show, with `part`, their text under a heading."""
    text = F.coalesce("content", F.lit(""))
    quoted = F.when(F.startswith(text, F.lit("#")) | F.startswith(text, F.lit("---")), F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))).otherwise(text)
    return messages.where(renderable()).withColumn("part", F.concat(F.lit("### "), F.col("role"), F.lit("\n\n"), quoted, F.lit("\n\n")))


def _markdown_head(sessions: DataFrame) -> DataFrame:
    """Sessions with `head`, the title and the token table."""
    counted = sessions.withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))
    table = F.when(F.col("tokens") > 0, F.concat(F.lit("| input | output | total |\n|---|---|---|\n| "), fmt_tokens("input_tokens"), F.lit(" | "), fmt_tokens("output_tokens"), F.lit(" | "), fmt_tokens("tokens"), F.lit(" |\n\n"))).otherwise("")
    return counted.withColumn("head", F.concat(F.lit("# "), "title", F.lit("\n\n"), table))


def export_markdown(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, doc): title, a token table if there are input or output tokens (their sum, without the cache), and the rows that show; content that starts with `#` or `---` is quoted."""
    body = _markdown_parts(messages).groupBy(F.col("session_id").alias("id")).agg(F.array_join(_ordered(F.col("part")), "").alias("body"))
    return _markdown_head(sessions).join(body, "id", "left").select("id", F.concat("head", F.coalesce("body", F.lit(""))).alias("doc"))


def markdown_pieces(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, place, msg_index, separator, piece): the parts of export_markdown()'s documents, a row for each message."""
    head = _markdown_head(sessions).select("id", F.lit(0).alias("place"), F.lit(0).cast("long").alias("msg_index"), F.lit("").alias("separator"), F.col("head").alias("piece"))
    return head.unionByName(_markdown_parts(messages).select(F.col("session_id").alias("id"), F.lit(1).alias("place"), F.col("msg_index").cast("long").alias("msg_index"), F.lit("").alias("separator"), F.col("part").alias("piece")))


def json_pieces(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, place, msg_index, separator, piece): the parts of export_json()'s documents, a row for each message; a session without messages has an empty list of them."""
    row = lambda frame, key, place, index, separator, piece: frame.select(F.col(key).alias("id"), F.lit(place).alias("place"), index.cast("long").alias("msg_index"), F.lit(separator).alias("separator"), piece.alias("piece"))
    head = row(sessions, "id", 0, F.lit(0), "", F.concat(F.lit('{"meta":'), F.to_json(F.struct(*sessions.columns)), F.lit(',"messages":[')))
    body = row(messages, "session_id", 1, F.col("msg_index"), ",", F.to_json(F.struct(*[c for c in messages.columns if c != "session_id"])))
    return head.unionByName(body).unionByName(row(sessions, "id", 2, F.lit(0), "", F.lit("]}")))


def export_files(pieces: DataFrame, sessions: DataFrame, folder: str, extension: str) -> DataFrame:
    """Writes a file for each session below `folder`, a piece at a time, and returns (id, file_name, bytes) of them.

    A session's file may have any size; a task holds one piece of it. Pieces of other ids than those of `sessions` are left out. Files
    get their names when they are whole, so an attempt that is lost leaves none, and one that runs twice writes the same. Where the
    first 8 characters of ids don't tell two files apart, they get the whole id.
    """
    spark = pieces.sparkSession
    named = sessions.select("id", file_name("title", "id", extension).alias("short"), F.concat(F.regexp_replace(file_name("title", "id", ""), "[^_]*$", ""), F.col("id").cast("string"), F.lit(f".{extension}")).alias("long"))
    named = named.select("id", F.when(F.count("*").over(Window.partitionBy("short")) > 1, F.col("long")).otherwise(F.col("short")).alias("file_name"))
    dealt = pieces.join(named, "id").withColumn("key", F.col("id").cast("string")).select("key", "file_name", "place", "msg_index", "separator", "piece").repartition("key").sortWithinPartitions("key", "place", "msg_index")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root)
        out, own, done = None, None, []

        def close():
            out.close()
            files.move(f"{root}/{part}", f"{root}/{own[1]}")
            done.append((*own, size))

        for batch in batches:
            for key, name, place, separator, piece in zip(*(batch.column(c) for c in ("key", "file_name", "place", "separator", "piece"))):
                row = (key.as_py(), name.as_py())
                if row != own:
                    if out:
                        close()
                    own, part, size, last = row, f".{uuid.uuid4().hex}.part", 0, None
                    out = files.open_output_stream(f"{root}/{part}")
                data = (separator.as_py() if last == place.as_py() else "").encode() + (piece.as_py() or "").encode()
                out.write(data)
                size, last = size + len(data), place.as_py()
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["id", "file_name", "bytes"])
                done.clear()
        if out:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["id", "file_name", "bytes"])

    listing = f"{folder.rstrip('/')}/.written-{uuid.uuid4().hex}"
    dealt.mapInArrow(write, "id string, file_name string, bytes long").write.parquet(listing)
    for name in children(spark, folder):
        if name.endswith(".part"):
            remove(spark, f"{folder}/{name}")
    return spark.read.schema("id string, file_name string, bytes long").parquet(listing)


def file_name(title: str, key: str, extension: str) -> Column:
    """First 100 characters of the title with bad characters as `_`, then 8 of the id."""
    clean = F.translate(F.substring(title, 1, 100), BAD_CHARACTERS, "_" * len(BAD_CHARACTERS))
    return F.concat(clean, F.lit("_"), F.substring(F.col(key).cast("string"), 1, 8), F.lit(f".{extension}"))


def export_batch(docs: DataFrame, sessions: DataFrame, ids: DataFrame, extension: str) -> DataFrame:
    """(file_name, doc) of the chosen ids; write with partitionBy("file_name").text()."""
    chosen = docs.join(ids.select("id"), "id", "left_semi").join(sessions.select("id", "title"), "id")
    return chosen.select(file_name("title", "id", extension).alias("file_name"), "doc")


def write_tables(stats: DataFrame, path: str, part: Column | None = None) -> None:
    """Replaces the parts that `stats` has, and no others: by bucket_date, or by `part`, a named column."""
    part = F.to_date(F.timestamp_seconds("bucket")).alias("bucket_date") if part is None else part
    dated = stats.select("*", part)
    name = dated.columns[-1]
    dated.repartition(name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
