"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches. A batch's lines are counted by hash and merge-anti-joined
with the runs that are there: hashes that a run already has in enough documents are
dropped, the rest become a sorted run of the lowest level. When a level is full its
runs are merged into one of the next. Runs are bucketed and sorted by hash, so the
joins read them as they lie, without a shuffle. A line that many documents have is
one row of a task's partial sums, whoever has it.

After the last batch, each block of documents gets the repeated hashes among its
lines, and its texts lose those lines. The few hashes that very many lines have go
to all blocks as a bounded broadcast.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MOST_HOT, batches_of, cut_table, lists_of, shared_dir, small_batches

BLOCK_BYTES = 1 << 20
SALTS = 64
#: Rows with the same id and text are dealt out by salts if there are more of them than this, and than a MOST_HOT-th of all.
SAME_ROWS = 1000
WHITE = " \t\n\x0b\x0c\r"


class LineRuns:
    """How many documents have a line, by line hash, in sorted runs; `levels` has the runs of each level.

    A hash that reaches `min_docs` in one run isn't counted on in later batches,
    so counts from `min_docs` on say no more than that.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int | None = None):
        if fanout < 2 or min_docs < 1:
            raise ValueError("fanout is 2 or more, min_docs 1 or more")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]

    def _run(self, counts: DataFrame) -> DataFrame:
        """The counts as a table in the shared folder, bucketed and sorted by hash; no name stays in the catalog."""
        name = f"line_run_{uuid.uuid4().hex}"
        folder = f"{shared_dir(self.spark)}/{name}"
        counts.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").options(path=folder, compression="zstd").saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"drop table {name}")
        return run

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """The runs merged two by two by their hashes. Not a union: Spark 4.1 takes a union of bucketed tables for bucketed, but may read it unbucketed, and sums then miss rows."""
        out = runs[0]
        for run in runs[1:]:
            other = run.select(F.col("h").alias("h2"), F.col("n").alias("n2"))
            out = out.join(other, F.col("h") == F.col("h2"), "full").select(F.coalesce("h", "h2").alias("h"), (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))
        return out

    def add(self, batch: DataFrame) -> None:
        """A batch of rows (h, n), n documents of the batch with the line; a document is in one batch only."""
        fresh = batch.groupBy("h").agg(F.sum("n").alias("n"))
        for run in self.runs():
            fresh = fresh.join(run.where(F.col("n") >= self.min_docs).hint("merge"), "h", "left_anti")
        self.levels[0].append(self._run(fresh))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._run(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)

    def repeated(self) -> DataFrame:
        """(h, n) of the lines that at least `min_docs` documents have, as a run."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "h binary, n long")
        return self._run(self._merged(runs).where(F.col("n") >= self.min_docs))


def _lines(texts: pa.Array, min_chars: int):
    """The lines of all texts, the index of each one's text, the code of its key, and the hashes of the keys by code, null for too short keys."""
    pieces = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat = pieces.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(flat, characters=WHITE)).dictionary_encode()
    named = keys.dictionary
    short = pc.less(pc.utf8_length(named), min_chars)
    hashes = pa.array([hashlib.sha256(k).digest()[:16] for k in named.cast(pa.binary()).to_pylist()], pa.binary())
    return flat, pc.list_parent_indices(pieces), keys.indices, pc.if_else(short, pa.scalar(None, pa.binary()), hashes)


def line_hashes(base: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """(block, h, n, batch): n rows of a block that have a line, in parts; a row has its block."""

    def run(chunks):
        for chunk in chunks:
            for start, part in batches_of(chunk.column("text"), 8 << 20):
                _, of, code, hashes = _lines(part, min_chars)
                # Each line once for a row, then counted by block.
                once = np.unique(of.to_numpy(zero_copy_only=False).astype(np.int64) * len(hashes) + code.to_numpy(zero_copy_only=False))
                block = chunk.column("block").slice(start, len(part)).to_numpy(zero_copy_only=False)
                pair, n = np.unique(block[once // len(hashes)].astype(np.int64) * len(hashes) + once % len(hashes), return_counts=True)
                made = pa.RecordBatch.from_arrays([pa.array(pair // len(hashes), pa.int32()), hashes.take(pa.array(pair % len(hashes))), pa.array(n, pa.int64())], names=["block", "h", "n"])
                yield made.filter(pc.is_valid(made.column("h")))

    return base.select("block", "text").mapInArrow(run, "block int, h binary, n long").withColumn("batch", F.col("block") % batches)


def drop_lines(packed: DataFrame, found: DataFrame, often: list[bytes], min_chars: int) -> DataFrame:
    """(id, n_lines, n_dropped, kept) for packed texts by block and the repeated hashes of each block; `often` holds for all blocks."""
    everywhere = pa.array(often, pa.binary())

    def run(key, texts, found):
        inflate = zstandard.ZstdDecompressor()
        drop = pa.concat_arrays([*found.column("h").cast(pa.binary()).chunks, everywhere])
        ids, held = texts.column("id").combine_chunks(), texts.column("packed").to_pylist()
        made = []
        at = 0
        while at < len(held):
            part, size = [], 0
            while at < len(held) and size < 8 << 20:
                part.append(inflate.decompress(held[at]))
                size += len(part[-1])
                at += 1
            flat, of, code, hashes = _lines(pa.array(part, pa.binary()).cast(pa.string()), min_chars)
            stays = pc.invert(pc.is_in(hashes, drop)).take(code)
            before = np.bincount(of.to_numpy(zero_copy_only=False), minlength=len(part))
            lists = lists_of(flat.filter(stays), of.filter(stays), len(part))
            after = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            made.append(pa.Table.from_arrays([ids.slice(at - len(part), len(part)), pa.array(before, pa.int64()), pa.array(before - after, pa.int64()), pc.binary_join(lists, "\n")], names=["id", "n_lines", "n_dropped", "kept"]))
        return pa.concat_tables(made) if made else pa.table({"id": ids.slice(0, 0), "n_lines": pa.array([], pa.int64()), "n_dropped": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})

    return packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, f"id {packed.schema['id'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 5, fanout: int = 2) -> DataFrame:
    """One row per row of `docs`: id, n_lines, n_dropped, kept (the lines left, joined by line feeds).

    A line's key is the line without white space (blank, \\t to \\r) at its ends,
    A to Z in lower case. A line goes from every row if at least `min_docs` rows
    have its key and the key has `min_chars` code points or more. A null or empty
    text is one empty line. Each row is a document, whether or not its id repeats
    or is null, and rows equal in all columns count one by one. An empty table
    gives none; other columns are not read. `batches` and `fanout` say how often
    runs are added and merged, not what is dropped.
    """
    spark = docs.sparkSession
    # The text decides the row's block too, so a repeated id fills none.
    base = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("row", F.xxhash64("id", "text"))
    sizes = cut_table(base.groupBy("row").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")))
    rows, total = sizes.agg(F.sum("rows"), F.sum("bytes")).first()
    blocks = max(1, round((total or 0) / BLOCK_BYTES)) | 1
    same = sizes.where(F.col("rows") > max(SAME_ROWS, (rows or 0) // MOST_HOT)).select("row", F.row_number().over(Window.orderBy("row")).alias("hot"))
    # Rows that are the same too often have blocks of their own: one to count in, SALTS of them for their texts.
    base = base.join(F.broadcast(same), "row", "left").withColumn("block", F.coalesce(F.lit(blocks) + (F.col("hot") - 1) * SALTS, F.pmod("row", F.lit(blocks))).cast("int"))

    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines = line_hashes(base, batches, min_chars)
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(folder)
    lines = spark.read.schema(lines.schema).parquet(folder)
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).select("h", "n"))
    repeated = runs.repeated()

    counted = repeated.join(lines.groupBy("h").agg(F.count("*").alias("parts")), "h")
    most = lines.count() // MOST_HOT
    often = [bytes(r.h) for r in counted.where(F.col("parts") > max(SAME_ROWS, most)).select("h").collect()]
    found = lines.select("block", "h").where(~F.col("h").isin(often)) if often else lines.select("block", "h")
    found = found.join(repeated.select("h"), "h", "left_semi").distinct()
    found = found.withColumn("block", F.explode(F.when(F.col("block") >= blocks, F.sequence("block", F.col("block") + SALTS - 1)).otherwise(F.array("block"))))

    def pack(chunks):
        deflate = zstandard.ZstdCompressor(level=1)
        for chunk in chunks:
            for start, part in batches_of(chunk.column("text"), 8 << 20):
                packed = pa.array([deflate.compress(t.as_buffer()) for t in part], pa.binary())
                yield pa.RecordBatch.from_arrays([*(chunk.column(c).slice(start, len(part)) for c in ("id", "block")), packed], names=["id", "block", "packed"])

    salt = F.when(F.col("block") >= blocks, F.monotonically_increasing_id() % SALTS).otherwise(0)
    packed = base.select("id", (F.col("block") + salt).cast("int").alias("block"), "text").mapInArrow(pack, f"id {base.schema['id'].dataType.simpleString()}, block int, packed binary")
    return drop_lines(packed, found, often, min_chars).withColumnRenamed("id", id_col)
