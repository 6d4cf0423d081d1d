"""Fill-in-the-middle against a plain rebuilding of each document."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlog.llm import fill_middle

TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "a\r\nb\r\n", "é\n漢字\n\nñ", "has <P> in it\nx", "<M>", "< P>\n<\n<S\n", "x" * 100_000, "line\n" * 30_000, "M>\n<", " a\x0bb\x00c\n\x85",
]


def want(doc_id, text, seed=7, rate=100, spm=50, markers=("<P>", "<S>", "<M>")):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(x in text for x in markers) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), markers[1] + s + markers[0] + p + markers[2] + m
    return len(lines), "psm", len(p), len(m), markers[0] + p + markers[1] + s + markers[2] + m


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i * 7 - 20, t, "n", 5) for i, t in enumerate(TEXTS * 4)] + [(3, "same\nid\n", "n", 5), (3, "same\nid\n", "n", 5), (None, "no\nid\n", "n", 5), (None, None, None, None)]
    rows += [(1000 + i, "".join(rng.choice(["a", "b ", "\n", "é", "<", "P>", "\r\n"]) for _ in range(rng.randrange(60))), "n", 5) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(4)


@pytest.mark.parametrize("how", [{}, {"seed": 9, "rate": 60, "spm_rate": 20}, {"markers": ("<|pre|>", "<|suf|>", "<|mid|>")}])
def test_fill_middle(spark, docs, how):
    made = fill_middle.fill_in_middle(docs, **how)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    marks = {"markers": how["markers"]} if "markers" in how else {}
    rows = made.select("*", fill_middle.restored(**marks).alias("back")).collect()
    expected = [(r.doc_id, *want(r.doc_id, r.text, how.get("seed", 7), how.get("rate", 100), how.get("spm_rate", 50), **marks), r.text or "") for r in docs.collect()]
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, expected))
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_fill_middle_of_nothing(spark, docs):
    assert fill_middle.fill_in_middle(docs.where("false")).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("", "", ""), ("<<P>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, markers=bad)


def test_batches_bound_the_work(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "BATCH_BYTES", 100)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb\n"), F.col("id").cast("string")).alias("text")).coalesce(1)
    rows = {r.doc_id: r.output for r in fill_middle.fill_in_middle(docs).collect()}
    assert rows == {i: want(i, f"a\nb\n{i}")[-1] for i in range(200)}
