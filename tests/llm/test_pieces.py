"""SentencePiece operators against the library itself."""

import random

from fleetlog.llm import piece_table, token_counts
from fleetlog.llm.common import SENTENCEPIECE_MODEL, load_sentencepiece

SP = load_sentencepiece(SENTENCEPIECE_MODEL)
ODD = [None, "", " ", "  ", "a", " a", "a  b ", "\n\na\tb", "a▁b", "▁", "é漢字 𝔘 \x00x", "<s> </s> <unk><0x0A>", "ＡＢ ﬁ　x", "x" * 5000, "漢字" * 3000, ("word " * 4000) + "end", "  \n  " * 900]


def rows(spark):
    rng = random.Random(3)
    alphabet = "ab  ▁éß漢\n.,𝔘" + " "
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(3000))) for _ in range(60)]
    texts = [*ODD, *more, "dup dup", "dup dup"]
    return texts, spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_encode_is_the_library(spark):
    texts, docs = rows(spark)
    got = {r.doc_id: (r.ids, r.decoded) for r in piece_table.encode(docs, table_bytes=5000).collect()}
    for i, text in enumerate(texts):
        ids = SP.encode(text or "")
        assert got[i] == (ids, SP.decode(ids)), repr(text)[:60]


def test_encode_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in piece_table.encode(docs).collect():
        assert r.ids == SP.encode(texts[r.doc_id]) and r.decoded == SP.decode(r.ids)


def test_counts_are_the_library_for_any_chunk(spark):
    texts, docs = rows(spark)
    for chunk, overlap in ((64, 8), (257, 16), (1000, 200)):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, chunk=chunk, overlap=overlap).collect()}
        for i, text in enumerate(texts):
            assert got[i] == (len((text or "").encode()), len(SP.encode(text or ""))), (chunk, repr(text)[:60])


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert piece_table.encode(none).count() == 0 and token_counts.count_tokens(none).count() == 0


def test_word_table_keeps_frequent_words():
    import numpy as np
    import pyarrow as pa

    table = piece_table.WordTable(SP, 4000)
    for k in range(30):
        words = [" the", " of"] + [f" w{k}x{j}" for j in range(20)]
        got = table.ids(pa.array(words, pa.large_string()), np.array([50, 50] + [1] * 20))
        assert got.to_pylist() == [SP.encode(w[1:]) for w in words]
    assert {" the", " of"} <= set(table.words.to_pylist()) and table.words.nbytes + table.found.nbytes <= 4000


def test_other_models_are_encoded_whole(monkeypatch):
    class Trims:
        def __getattr__(self, name):
            return getattr(SP, name)

        def normalize(self, text):
            return SP.normalize(text.strip())

    assert piece_table.splittable(SP) and not piece_table.splittable(Trims())
