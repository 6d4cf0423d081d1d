"""Repeated ids, missing ids and clashing names, in op8 and in each stage of the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from fleetlog.llm import suffix_dedup

#: Names of columns that the operators work with.
NAMES = ["id", "_id", "digest", "_hash", "hash", "text_hash", "_gone", "n_removed", "n_spans", "n_bytes", "kept", "rest", "row", "block", "packed", "bits", "h", "lang_pred", "score", "claimed", "own", "leads", "class_id", "n_links", "tokens", "budget", "whole", "more", "domain", "ids", "n_tokens", "tags", "two words", "dot.ted"]


def brute(rows, length=50):
    """(id, text, n_removed, n_spans, kept) of each row: bytes that a row with a smaller id has too."""
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        for s in range(len(t) - length + 1):
            first.setdefault(t[s : s + length], i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for s in range(len(t) - length + 1):
            if i is not None and first[t[s : s + length]] < i:
                gone[s + 1 : s + 1 + length] = True
        out.append((i is None, i or 0, t, int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), "".join(c for c, g in zip(t, gone[1:]) if not g)))
    return sorted(out)


def repeated(seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    shared = [word(80) for _ in range(6)]
    rows = [(1, shared[0]), (2, word(20) + shared[0] + word(9)), (2, word(300)), (2, word(20)), (None, shared[0]), (None, shared[0]), (None, None), (3, ""), (3, None)]
    # The same passage at the same place of two texts with one id, and copies of a text under several ids, one of them a repeated one.
    rows += [(5, "same place " + shared[1] + word(30)), (5, "same place " + shared[1] + word(40)), (4, shared[1]), (9, shared[2] * 2), (6, shared[2] * 2), (9, word(200)), (9, shared[2] * 2), (9, shared[3] + "x")]
    rows += [(rng.randrange(10, 16), word(rng.randrange(40)) + rng.choice(shared) + word(rng.randrange(40)) + rng.choice(shared)[:60]) for _ in range(40)]
    return rows


@pytest.mark.parametrize("seed, parts, hot", [(1, 1, 128), (2, 5, 128), (3, 3, 2), (4, 2, 1)])
def test_rows_of_one_id_keep_their_own_texts(spark, seed, parts, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    rows = repeated(seed)
    want = brute([(i, t or "") for i, t in rows])
    for order in range(2):
        random.Random(order).shuffle(rows)
        given = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long").repartition(parts)
        got = [(r.doc_id is None, r.doc_id or 0, rows[r.rest.k][1] or "", r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in suffix_dedup.remove_repeats(given, carry=("k",), hot=hot).collect()]
        assert sorted(got) == want


def test_pipeline_stage_with_repeated_ids(spark):
    rows = repeated(7)
    docs = spark.createDataFrame([(i, t, "en", "s1", -1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_chars) for r in pipeline.cut_repeated_passages(spark, docs, "").collect())
    want = sorted((n, i, k, len(k) if gone else -1) for n, i, _, gone, _, k in brute([(i, t or "") for i, t in rows]) if k or not gone)
    assert got == want


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stages_keep_clashing_columns(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = docs.select(F.row_number().over(Window.orderBy("doc_id")).alias("k"), "doc_id")
    docs = docs.join(ids.where("k <= 60").select("doc_id"), "doc_id", "left_semi")
    odd = docs
    kinds = ["cast({} as int)", "concat('v', {})", "cast({} as double) / 4", "named_struct('a', {})", "array({}, null)"]
    for k, name in enumerate(NAMES):
        odd = odd.withColumn(name, F.expr(kinds[k % len(kinds)].format("doc_id")))
    plain, kept = stage(spark, docs, sf), stage(spark, odd, sf)
    if stage is pipeline.encode_pieces:
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, plain.collect()))
        return
    assert kept.dtypes == odd.dtypes
    rows = kept.collect()
    assert sorted(map(repr, (tuple(r[c] for c in docs.columns) for r in rows))) == sorted(map(repr, (tuple(r) for r in plain.collect())))
    for r in rows:
        i = r["doc_id"]
        values = [i, f"v{i}", i / 4, (i,), [i, None]]
        assert all((tuple(r[n]) if k % 5 == 3 else r[n]) == values[k % 5] for k, n in enumerate(NAMES))
