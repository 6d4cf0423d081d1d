"""Logs that grow, shrink or are written anew, read by byte ranges."""

import io
import random

import pytest
from pyspark.sql import functions as F

from fleetlog.sources import logs, ranges


class Passes:
    """grown_lines() again and again over a folder; read() gives each new line's file, number and text."""

    def __init__(self, spark, folder, piece_bytes=ranges.PIECE_BYTES):
        self.spark, self.folder, self.piece_bytes, self.known, self.n = spark, folder, piece_bytes, None, 0

    def read(self):
        self.n += 1
        self.meter = self.spark.sparkContext.accumulator(0)
        new, self.known = ranges.grown_lines(self.spark, str(self.folder / "in"), logs.LogFormat("p"), str(self.folder / f"kept{self.n}"), self.known, self.piece_bytes, self.meter)
        return sorted((r.source_path.rsplit("/", 1)[-1][:-6], r.line_no, r.raw) for r in new.collect())

    def put(self, name, text, mode="w"):
        (self.folder / "in").mkdir(exist_ok=True)
        with open(self.folder / "in" / f"{name}.jsonl", mode) as f:
            f.write(text)


@pytest.mark.parametrize("piece_bytes", [ranges.PIECE_BYTES, 7])
def test_only_what_was_added_is_read(spark, tmp_path, piece_bytes):
    logs_ = Passes(spark, tmp_path, piece_bytes)
    long = "y" * 3000
    logs_.put("a", '{"n":1}\n\n{"n":2}\n')
    logs_.put("b", '{"n":1}\n{torn')
    logs_.put("c", long + "\n" + "é\n" * 5)
    logs_.put("e", "")
    assert logs_.read() == [("a", 1, '{"n":1}'), ("a", 3, '{"n":2}'), ("b", 1, '{"n":1}'), ("c", 1, long), *(("c", k, "é") for k in range(2, 7))]
    assert logs_.read() == [] and logs_.meter.value == 0
    logs_.put("a", '{"n":3}\n{"n":4}', "a")
    logs_.put("b", "}\n", "a")
    logs_.put("c", "z\n", "a")
    assert logs_.read() == [("a", 4, '{"n":3}'), ("b", 2, "{torn}"), ("c", 7, "z")]
    # What was added, and the torn lines once more.
    assert logs_.meter.value == 15 + (5 + 2) + 2
    logs_.put("a", "\n", "a")
    assert logs_.read() == [("a", 5, '{"n":4}')]


def test_files_written_anew(spark, tmp_path):
    logs_ = Passes(spark, tmp_path)
    for name in "abcd":
        logs_.put(name, "1\n2\n")
    logs_.put("tail", "same head " * 200 + "\n1\n")
    logs_.read()
    # Smaller, of the same size, larger; with the same head but another tail; one is gone.
    logs_.put("a", "7\n")
    logs_.put("b", "5\n6\n")
    logs_.put("c", "7\n8\n9\n")
    logs_.put("tail", "same head " * 200 + "\n2\n3\n")
    (tmp_path / "in" / "d.jsonl").unlink()
    got = logs_.read()
    assert [x for x in got if x[0] != "tail"] == [("a", 1, "7"), ("b", 1, "5"), ("b", 2, "6"), ("c", 1, "7"), ("c", 2, "8"), ("c", 3, "9")]
    assert [x[1:] for x in got if x[0] == "tail"][1:] == [(2, "2"), (3, "3")]
    assert {r.source_path[-7] for r in logs_.known.collect()} == set("abcl")
    logs_.put("d", "1\n")
    assert logs_.read() == [("d", 1, "1")]


def test_lines_of_pieces():
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\n\n") for _ in range(rng.randrange(40)))
        start = rng.choice([0, *(k + 1 for k, c in enumerate(data) if c == 10)])
        want, at = [], start
        for line in data[start:].split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        size = rng.randrange(1, 12)
        got = [x for begin in range(start, len(data), size) for x in ranges.whole_lines(io.BytesIO(data), start, begin, min(len(data), begin + size))]
        assert got == want
        assert ranges.last_newline(io.BytesIO(data), len(data)) == data.rfind(b"\n") + 1


def test_growing_source(spark, tmp_path):
    spark.dataSource.register(ranges.GrowingLogs)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    out = []

    def go():
        stream = spark.readStream.format("growing_logs").option("path", str(tmp_path / "in")).option("pieceBytes", 5).load()
        got = []
        query = stream.writeStream.foreachBatch(lambda b, n: got.extend((r.source_path[-7], r["at"], r.raw) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        out.append(sorted(got))

    (tmp_path / "in" / "a.jsonl").write_text("one\ntwo\ntorn")
    (tmp_path / "in" / "sub" / "b.jsonl").write_text("1\n2\n")
    (tmp_path / "in" / "c.other").write_text("1\n2\n")
    go()
    with open(tmp_path / "in" / "a.jsonl", "a") as f:
        f.write(" no more\nfour\n")
    (tmp_path / "in" / "sub" / "b.jsonl").write_text("3\n4\n5\n")
    go()
    go()
    assert out == [[("a", 0, "one"), ("a", 4, "two"), ("b", 0, "1"), ("b", 2, "2")], [("a", 8, "torn no more"), ("a", 21, "four"), ("b", 0, "3"), ("b", 2, "4"), ("b", 4, "5")], []]
