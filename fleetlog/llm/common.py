"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCEPIECE_MODEL = "piece_bpe_32k.model"
#: A key is hot from this part of all rows on, so there are never more hot keys than this, and they may be broadcast.
MOST_HOT = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on
    one machine only, a temporary one where the session names none."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fleetlog-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def packed(frame: DataFrame, *out: str):
    """All columns of the frame but those of `out` as one struct, so that their names can clash with none beside it."""
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns if c not in out])


def unpacked(frame: DataFrame, columns: list[str], row: str, **own) -> DataFrame:
    """The columns again, by name from the struct `row` or, for a name in `own`, from that column."""
    return frame.select(*[own[c].alias(c) if c in own else F.col(row)[c].alias(c) for c in columns])


def cut(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def cut_table(frame: DataFrame) -> DataFrame:
    """The same rows from a compressed table in the shared folder; smaller there than a checkpoint."""
    folder = f"{shared_dir(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def small_batches(frame: DataFrame, size: str = "8m") -> DataFrame:
    """The frame, with its session handing Python tasks this much at a time, which bounds their memory and the JVM's buffers."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return frame


def crc32_text(column):
    """Unsigned CRC-32 of the UTF-8 text, as a long."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8"))


def load_sentencepiece(model: str):
    """The processor for an absolute path, or for a file that the installed
    public_tokenizers package knows by name. Called inside tasks."""
    import os

    import sentencepiece

    if not os.path.isabs(model):
        import public_tokenizers

        model = public_tokenizers.path(model)
    return sentencepiece.SentencePieceProcessor(model_file=model)


def lists_of(flat, parents, n: int):
    """Arrow lists of the values by the rising index of their parent, of which there are `n`."""
    import numpy as np
    import pyarrow as pa

    sizes = np.bincount(parents.to_numpy(zero_copy_only=False), minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)


def batches_of(array, size: int):
    """Slices of an Arrow array of at most about `size` bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not len(array):
        return
    lengths = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // size
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(array)]
    for a, b in zip(bounds, bounds[1:]):
        yield a, array.slice(a, b - a)
