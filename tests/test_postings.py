"""The kept trigram index against searching all texts."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlog.operators import postings, search

SCHEMA = "id long, title string, content_text string, project_name string"


def pairs(frame):
    return sorted((r.id, r.title) for r in frame.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeÉé ") for _ in range(rng.randrange(1, 7)))
    rows = [(i, " ".join(word() for _ in range(4)), " ".join(word() for _ in range(60)), rng.choice(["p one", None, "", "ab"])) for i in range(400)]
    return spark.createDataFrame([*rows, (900, None, None, None), (901, "Needle in hay", "x", "y"), (902, "aaa", "aaaa", "a\nb")], SCHEMA).repartition(4)


@pytest.mark.parametrize("few", [1000, 3])
def test_search_equals_scan(spark, docs, tmp_path, monkeypatch, few):
    monkeypatch.setattr(postings, "FEW_IDS", few)
    index = postings.PostingIndex(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        index.blocks()
    index.build(docs)
    for q in ("needle", "NEEDLE in hay", "aaa", "abc", "é É", "ab", "\nb", "zzz", "in hay and much more"):
        assert pairs(index.search(docs, q)) == pairs(search.phrase_search(docs, q)), q
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, search.trigram_postings(docs).select("trigram", "id", "field").collect()))


def test_layers_and_compaction(spark, docs, tmp_path):
    index = postings.PostingIndex(spark, str(tmp_path / "i"), most_layers=3)
    index.build(docs)
    now = docs
    for k in range(5):
        now = now.withColumn("title", F.when(F.col("id") % 7 == k, F.concat(F.lit(f"round {k} "), F.coalesce("title", F.lit("")))).otherwise(F.col("title")))
        if k == 3:
            now = now.where("id <> 901")
        changed = spark.range(1000).where(f"id % 7 = {k} or id = 901")
        index.refresh(now, changed)
        assert pairs(index.search(now, f"round {k}")) == pairs(search.phrase_search(now, f"round {k}"))
        assert len(index._layers()) <= 3
    assert index.search(now, "needle").count() == 0
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, search.trigram_postings(now).select("trigram", "id", "field").collect()))
    index.compact()
    assert [n.split("=")[0] for _, n in index._layers()] == ["base"] and pairs(index.search(now, "round 4")) == pairs(search.phrase_search(now, "round 4"))


def scanned(frame):
    """Rows that the scans of a frame's plan gave out."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    todo, rows = [plan], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif name.startswith(("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage")):
            todo.append(node.plan())
        elif name.startswith("Scan"):
            rows += node.metrics().apply("numOutputRows").value()
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_a_search_reads_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "ROW_GROUP_BYTES", 16 << 10)
    words = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit("").alias("content_text"), F.lit("").alias("project_name"))
    docs = words.unionByName(spark.createDataFrame([(5000, "qqq rare", "", "")], SCHEMA))
    index = postings.PostingIndex(spark, str(tmp_path / "i"))
    index.build(docs)
    every = index.blocks().count()
    assert every > 3000
    assert scanned(index.candidates("qqq")) < every / 5
    assert [r.id for r in index.search(docs, "qqq rare").collect()] == [5000]


def test_blocks_of_a_frequent_trigram(spark):
    rows = spark.range(5000).select(F.lit("abc").alias("trigram"), "id", F.lit("title").alias("field"))
    blocks = postings.blocks_of(rows, 100).collect()
    assert all(len(b.ids) <= 100 and b.ids == sorted(b.ids) and (b.first_id, b.last_id) == (b.ids[0], b.ids[-1]) for b in blocks)
    assert sorted(i for b in blocks for i in b.ids) == list(range(5000))


def test_indexable_text(spark):
    schema = "session_id long, msg_index long, role string, content string, tool_name string, tool_input string"
    rows = [
        (1, 2, "assistant", " kept as it is\n", None, None), (1, 1, "user", "first", None, None), (1, 3, "user", " \n", None, None), (1, 4, "system", "[thinking]  " + "é" * 1200, None, None),
        (1, 5, "system", "not searched", None, None), (1, 6, "tool", " \n" + "o" * 400 + " ", "Bash", "i" * 301), (1, 7, "tool", None, None, " "), (1, 8, "tool", "out", "", None), (1, 9, "system", "[thinking]  ", None, None), (1, 10, "other", "x", None, None),
        (2, 1, "assistant", None, None, None), (3, 1, "system", "y", None, None),
    ]
    got = {r.session_id: r.text for r in search.indexable_text(spark.createDataFrame(rows, schema), spark.createDataFrame([(2, "from the provider"), (1, "not this")], "session_id long, content_text string")).collect()}
    assert got == {1: "\n".join(["first", " kept as it is\n", "é" * 1000, "Bash", "i" * 300, "o" * 300, "out"]), 2: "from the provider", 3: ""}
    assert {r.session_id for r in search.indexable_text(spark.createDataFrame(rows, schema)).where("text = ''").collect()} == {2, 3}


def listed(frame):
    return sorted(((r.trigram, r.id, r.field) for r in frame.select("trigram", F.explode("ids").alias("id"), "field").collect()), key=repr)


@pytest.mark.parametrize("chunk", [1 << 22, 64])
def test_grouped_texts_are_the_postings(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(postings, "CHUNK_BYTES", chunk)
    odd = [
        (1000, "aAaAaA", "", "ab"), (1000, "the same id", None, "x"), (None, "no id at all", "né\x00\U0001f600\U0001f601é", None), (-5, "ÀÉ[`@{Zz", "\U0001f600" * 3, "a b"),
        (1001, "".join(map(chr, range(0x4E00, 0x4E00 + 20000))), "".join(map(chr, range(0xAC00, 0xD7A3))), "\r\n\t"),
    ]
    both = docs.unionByName(spark.createDataFrame(odd, SCHEMA)).coalesce(1)
    blocks = postings.grouped_texts(both, block_ids=50)
    expected = sorted(((r.trigram, r.id, r.field) for r in search.trigram_postings(both).collect()), key=repr)
    assert listed(blocks) == expected == listed(postings.merged_blocks(blocks, 70))
    for r in postings.merged_blocks(blocks.where("first_id is not null"), 70).collect():
        assert len(r.ids) <= 70 and r.ids == sorted(r.ids) and (r.first_id, r.last_id) == (r.ids[0], r.ids[-1])
    if chunk == 1 << 22:
        assert blocks.count() < len(expected) / 2


def test_many_letters_and_bad_bytes():
    import pyarrow as pa

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    texts, ids = pa.array([every, "abcd", *["xyz"] * 20]), pa.array(range(22), pa.int64())
    found = [(b.column("trigram").to_pylist(), b.column("ids").to_pylist()) for b in postings._grams(texts, ids, "t", 1024)]
    pairs = {(g, i) for grams, lists in found for g, ii in zip(grams, lists) for i in ii}
    low = search.fold_text(every)
    assert pairs == {(low[i : i + 3], 0) for i in range(len(low) - 2)} | {("abc", 1), ("bcd", 1)} | {("xyz", i) for i in range(2, 22)}
    broken = pa.StringArray.from_buffers(2, pa.py_buffer(b"\0\0\0\0\4\0\0\0\7\0\0\0"), pa.py_buffer(b"ab\xffcdef"))
    found = [r for b in postings._grams(broken, pa.array([7, 8], pa.int64()), "t", 1024) for r in b.to_pylist()]
    assert {(r["trigram"], *r["ids"]) for r in found} == {("ab�", 7), ("b�c", 7), ("def", 8)}


def test_texts_are_gone_through_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    docs = spark.range(300).select("id", F.lit("a title").alias("title"), told(F.sha2(F.col("id").cast("string"), 256)).alias("content_text"), F.lit("p").alias("project_name"))
    index = postings.PostingIndex(spark, str(tmp_path / "i"))
    index.build(docs)
    assert seen.value == 300
    index.refresh(docs, spark.range(30))
    assert seen.value <= 630


def test_small_changes_leave_the_base(spark, docs, tmp_path, monkeypatch):
    index = postings.PostingIndex(spark, str(tmp_path / "i"), most_layers=2)
    index.build(docs)
    for k in range(3):
        index.refresh(docs.where("id <> 3"), spark.range(10 * k, 10 * k + 12))
    assert [n for _, n in index._layers()] == ["base=1", "layer=2-4"]
    now = sorted(map(tuple, search.trigram_postings(docs.where("id <> 3")).collect()))
    assert sorted(map(tuple, index.postings().collect())) == now
    index.refresh(docs.where("id <> 3"), spark.range(300))
    assert [n for _, n in index._layers()] == ["base=5"]
    assert sorted(map(tuple, index.postings().collect())) == now
    # What a merge that broke off before it deleted anything leaves behind is not read.
    monkeypatch.setattr(postings, "remove", lambda *_: None)
    index.refresh(docs.where("id <> 4"), spark.range(5))
    index.refresh(docs.where("id <> 5"), spark.range(4, 8))
    assert {"layer=6", "layer=7"} < set(postings.children(spark, index.folder)) and [n for _, n in index._layers()] == ["base=5", "layer=6-7"]
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, search.trigram_postings(docs.where("id <> 5")).collect()))


def test_contains_folds_ascii_only_and_makes_no_folded_copy(spark):
    texts = ["", "The AN", "K kelvin", "ſharp ß ẞ", "É é", "İ i ı", "a.b", "axb", "\\E \\Q", "[x]{2}(y)*+?^$|", "a_b %c", "line\nTwo\r\t", "\U0001f600x\U0001f601", "nul\x00X", "-#&~`'\"<>,;:=@!/"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, t string")
    queries = [*texts, "the an", "k", "s", "SS", "É", "é", "i", "A.B", "\\e", "[X]", "(", "*", "_", "%C", "\ntwo", "\U0001f600X", "\x00x", "$", " ", "#", "-"]
    found = docs.select("id", *[search.contains("t", q).alias(f"q{k}") for k, q in enumerate(queries)]).orderBy("id").collect()
    for r, t in zip(found, [*texts, ""]):
        assert [r[f"q{k}"] for k in range(len(queries))] == [search.fold_text(q) in search.fold_text(t) for q in queries], t
    assert "translate" not in docs.where(search.contains("t", "x"))._jdf.queryExecution().toString().lower()
