"""Byte ranges of files: only what was added to logs since they were last read.

A file is known by the bytes and lines read of it and by a mark, a hash of the bytes
at its start and before the place reached. If the mark still holds the file is read
on from there; if not it was written anew and is read from its start. Ranges are cut
into pieces, a row each, so Spark deals out one large file like many small ones. A
line belongs to the piece in which it starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .logs import LogFormat, checked, discover_logs, stale_files

PIECE_BYTES = 32 << 20
MARK_BYTES = 1024
CHUNK = 1 << 20
KNOWN = "source_path string, size long, mtime long, bytes long, lines long, mark string"


def opened(path: str):
    """A file of any file system that Arrow knows, for reading at any place."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    return files.open_input_file(name)


def mark_of(file, at: int) -> str:
    """A hash of the first bytes and of those before `at`."""
    file.seek(0)
    head = file.read(min(MARK_BYTES, at))
    file.seek(max(0, at - MARK_BYTES))
    return hashlib.sha256(head + b"|" + file.read(min(MARK_BYTES, at))).hexdigest()


def newlines(file, begin: int, end: int) -> int:
    file.seek(begin)
    n, left = 0, end - begin
    while left > 0 and (data := file.read(min(CHUNK, left))):
        n += data.count(b"\n")
        left -= len(data)
    return n


def whole_lines(file, start: int, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line without its newline) of the lines that start in `begin` to `end`, of a range from `start`; a last line without newline is left out. One line and one chunk are held."""
    at = begin - (begin > start)
    file.seek(at)
    held, skip = [], begin > start
    while at < end and (data := file.read(CHUNK)):
        first, *others = data.split(b"\n")
        held.append(first)
        for other in others:
            line = b"".join(held)
            if at >= end:
                return
            if not skip:
                yield at, line
            skip, held = False, [other]
            at += len(line) + 1


def resumed(changed: DataFrame) -> DataFrame:
    """Adds start and had, the bytes and lines already read, to changed files (source_path, size, mtime, bytes, lines, mark): 0 if the file is new, shorter, or its mark no longer holds."""

    def run(batches):
        for batch in batches:
            starts, had = [], []
            for path, size, bytes_, lines, mark in zip(*(batch.column(c).to_pylist() for c in ("source_path", "size", "bytes", "lines", "mark"))):
                same = False
                if bytes_ and size >= bytes_:
                    with opened(path) as file:
                        same = mark_of(file, bytes_) == mark
                starts.append(bytes_ if same else 0)
                had.append(lines if same else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source_path", "size", "mtime")), pa.array(starts, pa.int64()), pa.array(had, pa.int64())], names=["source_path", "size", "mtime", "start", "had"])

    return changed.select("source_path", "size", "mtime", "bytes", "lines", "mark").mapInArrow(run, "source_path string, size long, mtime long, start long, had long")


def pieces_of(files: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(source_path, start, begin, stop, before) for files (source_path, size, start, had): the pieces of each range and the lines before each. Pieces of ranges of more than one are counted first."""
    begin = F.explode(F.sequence("start", F.col("size") - 1, F.lit(piece_bytes).cast("long")))
    pieces = files.where("size > start").select("source_path", "start", "size", "had", begin.alias("begin")).withColumn("stop", F.least("size", F.col("begin") + piece_bytes)).repartition("source_path", "begin")

    def count(batches):
        for batch in batches:
            found = []
            for path, start, a, b in zip(*(batch.column(c).to_pylist() for c in ("source_path", "start", "begin", "stop"))):
                with opened(path) as file:
                    found.append(newlines(file, a, b))
            yield pa.RecordBatch.from_arrays([batch.column("source_path"), batch.column("begin"), pa.array(found, pa.int64())], names=["source_path", "begin", "found"])

    many = pieces.where(F.col("size") - F.col("start") > piece_bytes)
    earlier = Window.partitionBy("source_path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    counts = many.select("source_path", "start", "begin", "stop").mapInArrow(count, "source_path string, begin long, found long")
    counts = counts.select("source_path", "begin", F.coalesce(F.sum("found").over(earlier), F.lit(0)).alias("found"))
    several = many.join(counts, ["source_path", "begin"]).withColumn("before", F.col("had") + F.col("found"))
    one = pieces.where(F.col("size") - F.col("start") <= piece_bytes).withColumn("before", F.col("had"))
    columns = ["source_path", "start", "begin", "stop", "before"]
    return several.select(columns).unionByName(one.select(columns))


def read_pieces(pieces: DataFrame, meter=None) -> DataFrame:
    """(source_path, line_no, at, stop, raw) of whole lines, blank ones too; bytes that aren't UTF-8 are replaced. `meter`, an accumulator, gets the bytes of the pieces."""

    def run(batches):
        for batch in batches:
            for path, start, begin, stop, before in zip(*(batch.column(c).to_pylist() for c in ("source_path", "start", "begin", "stop", "before"))):
                if meter is not None:
                    meter.add(stop - begin)
                made, size = [], 0
                with opened(path) as file:
                    line_no = before
                    # The line that begins in an earlier piece and ends in this one is among those before its first.
                    if begin > start:
                        file.seek(begin - 1)
                        line_no += file.read(1) != b"\n"
                    for at, line in whole_lines(file, start, begin, stop):
                        line_no += 1
                        made.append((path, line_no, at, at + len(line) + 1, line.decode("utf-8", "replace")))
                        size += len(line)
                        if size > 4 << 20 or len(made) >= 10_000:
                            yield _batch(made)
                            made, size = [], 0
                if made:
                    yield _batch(made)

    return pieces.mapInArrow(run, "source_path string, line_no long, at long, stop long, raw string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["source_path", "line_no", "at", "stop", "raw"])


def marked(files: DataFrame) -> DataFrame:
    """Adds the mark to files (source_path, size, mtime, bytes, lines)."""

    def run(batches):
        for batch in batches:
            marks = []
            for path, at in zip(batch.column("source_path").to_pylist(), batch.column("bytes").to_pylist()):
                with opened(path) as file:
                    marks.append(mark_of(file, at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], names=[*batch.schema.names, "mark"])

    return files.select("source_path", "size", "mtime", "bytes", "lines").mapInArrow(run, KNOWN)


def grown_lines(spark: SparkSession, folder: str, fmt: LogFormat, kept: str, known: DataFrame | None = None, piece_bytes: int = PIECE_BYTES, meter=None) -> tuple[DataFrame, DataFrame]:
    """The lines (source_path, line_no, raw, malformed) that logs below `folder` have and `known` doesn't, and the new `known`, in the columns of KNOWN.

    One pass of a job that runs again and again; `kept`, a new folder, gets what it read, once. Only bytes that were added are read, and
    up to 2 KB of each changed file for its mark. A file that was written anew, at whatever size, is read from its start; one that
    is changed in the middle only isn't noticed. A torn last line waits for its newline. A file that is gone is forgotten. No path goes through the driver.
    """
    # Each step is read back as it was written, so later changes of the folder don't reach into this pass.
    def put(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{kept}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{kept}/{name}")

    listing = put(discover_logs(spark, folder, fmt).select("source_path", "size", "mtime"), "listing")
    known = spark.createDataFrame([], KNOWN) if known is None else known
    changed = stale_files(listing, known).join(known.select("source_path", "bytes", "lines", "mark"), "source_path", "left")
    files = put(resumed(changed), "files")
    lines = put(read_pieces(pieces_of(files, piece_bytes), meter), "lines")
    ends = lines.groupBy("source_path").agg(F.max("stop").alias("stop"), F.max("line_no").alias("now"))
    reached = files.join(ends, "source_path", "left").select("source_path", "size", "mtime", F.coalesce("stop", "start").alias("bytes"), F.coalesce("now", "had").alias("lines"))
    unchanged = known.join(files, "source_path", "left_anti").join(listing.select("source_path"), "source_path", "left_semi")
    return checked(lines), put(marked(reached).unionByName(unchanged), "known")


class Piece(InputPartition):
    def __init__(self, path: str, start: int, begin: int, stop: int):
        self.path, self.start, self.begin, self.stop = path, start, begin, stop


class GrowingReader(DataSourceStreamReader):
    """Offsets are {path: [bytes up to the last newline, mark]}."""

    def __init__(self, folder: str, suffix: str, piece_bytes: int):
        self.folder, self.suffix, self.piece_bytes = folder, suffix, piece_bytes
        self.cached: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder)
        now = {}
        for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type != fs.FileType.File or not info.path.endswith(self.suffix) or info.base_name[:1] in "._":
                continue
            stamp = (info.size, info.mtime_ns)
            if self.cached.get(info.path, [None])[0] != stamp:
                with files.open_input_file(info.path) as file:
                    end = last_newline(file, info.size)
                    self.cached[info.path] = [stamp, [end, mark_of(file, end)]]
            now[info.path] = self.cached[info.path][1]
        return now

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.folder)
        out = []
        for path, (stop, mark) in sorted(end.items()):
            first, was = start.get(path, [0, ""])
            if [first, was] == [stop, mark]:
                continue
            if first:
                with files.open_input_file(path) as file:
                    first = first if first <= stop and mark_of(file, first) == was else 0
            out += [Piece(path, first, a, min(stop, a + self.piece_bytes)) for a in range(first, stop, self.piece_bytes)]
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.folder)
        with files.open_input_file(piece.path) as file:
            for at, line in whole_lines(file, piece.start, piece.begin, piece.stop):
                yield piece.path, at, line.decode("utf-8", "replace")


def last_newline(file, end: int) -> int:
    """The place after the last newline before `end`, or 0."""
    while end > 0:
        at = max(0, end - CHUNK)
        file.seek(at)
        found = file.read(end - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    return 0


class GrowingLogs(DataSource):
    """A streaming source of the lines (source_path, at, raw) of logs that grow: spark.dataSource.register(GrowingLogs), then
    readStream.format("growing_logs").option("path", folder). `at` is a line's place in its file; `suffix` (.jsonl) chooses the files.

    Each micro-batch reads only the bytes that were added, in pieces. The offsets, a few dozen bytes a file, are kept by the
    driver, which also looks at each file's last bytes: for more than some ten thousand logs use grown_lines().
    """

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return "source_path string, at long, raw string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("pieceBytes", PIECE_BYTES)))
