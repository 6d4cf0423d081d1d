"""Line deduplication against counting in a dictionary."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlog.llm import line_runs

WHITE = " \t\n\x0b\x0c\r"
TEXTS = [None, "", "\n", "\n\n", "one", " One \r", "oNE\none", "one\n\n", "É\né", "\x85one\x85", "x" * 50_000 + "\none", "line\n" * 20_000, "a\tb\x00"]


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def want(rows, min_docs=10, min_chars=1):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, lines in split for k in {key(x) for x in lines})
    gone = {k for k, n in seen.items() if n >= min_docs and len(k) >= min_chars}
    return sorted(repr((i, len(lines), sum(key(x) in gone for x in lines), "\n".join(x for x in lines if key(x) not in gone))) for i, lines in split)


def got(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    common = [f"common {i}" for i in range(30)]
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)]
    for i in range(400):
        lines = [rng.choice([c, c.upper(), f" {c}\t"]) if rng.random() < 0.3 else f"own {rng.randrange(3000)}" for c in rng.choices(common, k=rng.randrange(12))]
        rows.append((rng.choice([None, 5, 100 + i]), "\n".join(lines)))
    rows += [(5, "same row\nlast"), (5, "same row\nlast")] * 4 + [(6, "same row")]
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, h string, block int").repartition(6)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(line_runs, "BLOCK_BYTES", 2000)


@pytest.mark.parametrize("how", [{}, {"batches": 1}, {"batches": 9, "fanout": 3}, {"min_docs": 2, "min_chars": 6}, {"min_docs": 1}])
def test_lines(spark, docs, how):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = line_runs.drop_repeated_lines(docs, **how)
    assert kept.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert got(kept) == want(rows, how.get("min_docs", 10), how.get("min_chars", 1))


def test_same_rows_and_hot_lines_are_dealt_out(spark, docs, monkeypatch):
    monkeypatch.setattr(line_runs, "SAME_ROWS", 3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(line_runs.drop_repeated_lines(docs)) == want(rows)


def test_no_rows(spark, docs):
    assert line_runs.drop_repeated_lines(docs.where("false")).count() == 0
    assert got(line_runs.drop_repeated_lines(docs.where("false").unionByName(spark.createDataFrame([(None, None, None, None)], docs.schema)))) == want([(None, None)])


def test_runs_levels_and_anti_join(spark):
    runs = line_runs.LineRuns(spark, min_docs=3, fanout=2, buckets=4)
    batch = lambda *xs: spark.createDataFrame([(bytes([k]), n) for k, n in xs], "h binary, n long")
    runs.add(batch((1, 1), (2, 2), (2, 1), (3, 1)))
    assert [len(x) for x in runs.levels] == [1]
    # 2 is known in three documents, so the next run leaves it out; both are merged into level 1.
    runs.add(batch((2, 7), (1, 1), (4, 1)))
    assert [len(x) for x in runs.levels] == [0, 1]
    assert {bytes(r.h)[0]: r.n for r in runs.levels[1][0].collect()} == {1: 2, 2: 3, 3: 1, 4: 1}
    runs.add(batch((1, 1), (4, 1)))
    runs.add(batch((1, 5)))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {bytes(r.h)[0] for r in runs.repeated().collect()} == {1, 2}
    merging = runs._merged([runs.levels[2][0], runs.repeated()])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in merging and "Exchange" not in merging
    plan = runs.levels[2][0].join(runs.repeated().hint("merge"), "h", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    with pytest.raises(ValueError):
        line_runs.LineRuns(spark, 0)
