"""The numbered operators against brute force on small tables."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlog.llm import iblt, langid, mixing, path_join, queries, range_join, sharding, suffix_dedup, warc

LINES = ["alpha beta gamma", "delta", "epsilon zeta", "", "  ", "eta theta iota kappa", "lambda", "mü ñandú 漢字"]


def texts(seed: int, n: int) -> list:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "漢字"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 120))) for _ in range(n)]
    out = [None, "", " ", "one", "\n\n", "x" * 30_000, "word " * 6000]
    for i, t in enumerate(base):
        out.append(t)
        if i % 3 == 0:
            changed = t.split()
            changed[len(changed) // 2] = "changed"
            out.append(" ".join(changed))
        if i % 4 == 0:
            out += [t, t]
        if i % 5 == 0:
            out.append("prefix " + t[: len(t) // 2] + " tail " + rng.choice(base)[:200])
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 5}" if i % 7 else None, 0, "clash") for i, t in enumerate(texts(1, 60))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(5)


def local(docs) -> dict:
    return {r.doc_id: r.text for r in docs.collect()}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_fingerprints(spark, docs):
    rng = random.Random(2)
    more = [("\n".join(rng.choice(LINES) + str(rng.randrange(9)) for _ in range(rng.randrange(0, 400)))) for _ in range(25)]
    rows = [(1000 + i, t) for i, t in enumerate(more)] + [(2000, "\n".join(map(str, range(3000))))]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    known = {i: t or "" for i, t in local(given).items()}
    down = sorted(known, reverse=True)
    following = dict(zip(down, down[1:] + down[:1]))

    def paragraphs(text):
        return {x for x in text.split("\n") if x.strip(" ")}

    def alike(a, b):
        a, b = paragraphs(a), paragraphs(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    seen = {}
    for r in iblt.fingerprints(given).collect():
        own, after = known[r.doc_id], known[following[r.doc_id]]
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(own, edited)) and r.near_next == pytest.approx(alike(own, after))
        assert seen.setdefault(own, r.fingerprint) == r.fingerprint
    assert len({x for x in seen.values()}) > 30
    assert iblt.fingerprints(empty(spark)).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert iblt.fingerprints(one).first().near_next == 1.0


def test_language(spark, sf, docs):
    known = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_language_id(spark, sf).join(known, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    model = langid.fit(docs, F.lit(True))
    for r in langid.annotate(docs, model).collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.fit(empty(spark), F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_language_is_the_explicit_kernel(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(80).collect()
    given = spark.createDataFrame([(r.doc_id, r.text[:150], r.lang) for r in rows], "doc_id long, text string, lang string")
    learn = [r for r in rows if r.doc_id % 3]

    def grams(text):
        clean = "".join(c if c.isalpha() else " " for c in text[:150].lower())
        return {clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1)}

    def kernel(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    sets = [grams(r.text) for r in learn]
    langs = sorted({r.lang for r in learn})
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    alpha = np.linalg.solve(gram + np.eye(len(sets)), np.array([[1.0 if r.lang == x else -1.0 for x in langs] for r in learn]))
    # All learned texts are landmarks, so Nystrom features lose nothing; buckets that two n-grams share do, a little.
    model = langid.fit(given, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r for r in langid.predict(given, model).collect()}
    for r in rows:
        raw = np.array([kernel(grams(r.text), x) for x in sets]) @ alpha
        best = int(raw.argmax())
        assert abs(got[r.doc_id].score - min(1, max(0, (raw[best] + 1) / 2))) < 0.06
        assert got[r.doc_id].lang_pred == langs[best] or np.sort(raw)[-1] - np.sort(raw)[-2] < 0.05


def test_language_of_copies(spark):
    words = {"fr": "le chat est sur la table et le chien dort", "en": "the cat is on the table and the dog sleeps"}
    rows = [(i, words["fr"], "fr") for i in range(3000)] + [(5000 + i, f"{words['en']} number {i}", "en") for i in range(50)] + [(9000, "123", "xx"), (9001, None, "yy"), (9002, "où " * 300_000, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(given, F.lit(True), per_lang=20)
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(given, model).collect()}
    assert all(got[i] == "fr" for i in range(3000)) and all(got[5000 + i] == "en" for i in range(50)) and got[9000] == got[9001] == "und" and got[9002] in model.langs


@pytest.mark.parametrize("foreign", ["de", "en", "es", "fr"])
def test_language_stage_rejects(spark, sf, foreign):
    import corpus_pipeline as pipeline

    rng = random.Random(4)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (20, 100, 1000) for _ in range(10)]
    start = spark.read.parquet(f"{sf}/documents.parquet")
    # A language without labels is one that the stage can't learn.
    given = start.withColumn("lang", F.expr(f"nullif(lang, '{foreign}')")).unionByName(spark.createDataFrame([(10**6 + i, t, None, "noise", len(t)) for i, t in enumerate(noise)], start.schema))
    own = {r.doc_id: r.lang for r in start.collect()}
    kept = {r.doc_id for r in pipeline.identify_language(spark, given, sf).collect()}
    assert max(kept) < 10**6
    assert {i for i, lang in own.items() if lang != foreign} <= kept
    theirs = {i for i, lang in own.items() if lang == foreign}
    assert len(theirs & kept) <= 0.1 * len(theirs)


def test_mixing(spark, docs):
    for fraction, epochs in ((0.5, 1), (0.9, 4), (3.0, 4)):
        rows = mixing.mix(docs, fraction=fraction, epochs=epochs).collect()
        assert len(rows) == docs.count()
        total = sum(r.n_tokens for r in rows)
        leaves = {}
        for r in rows:
            leaves.setdefault((r.domain, r.lang, r.source), []).append(r)
        assert abs(sum(v[0].leaf_budget for v in leaves.values()) - min(total * fraction, total * epochs)) <= len(leaves) + 1
        for rs in leaves.values():
            drawn = sum(r.copies * r.n_tokens for r in rs)
            longest = max(r.n_tokens for r in rs)
            assert rs[0].leaf_budget - longest <= drawn <= rs[0].leaf_budget <= rs[0].leaf_tokens * epochs
            assert max(r.copies for r in rs) <= epochs
    weights = spark.createDataFrame([("lang", "en", 3.0), ("domain", "d1", 2.0)], "level string, name string, weight double")
    assert mixing.mix(docs, weights=weights).count() == docs.count()
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_is_repeatable(spark):
    rows = [(i % 3 if i % 4 else None, f"w{i % 7} x y" * (i % 5) or None, "en", "src1") for i in range(400)] + [(7, "same row", "en", "src2")] * 2500
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    seen = {tuple(sorted((str(r) for r in mixing.mix(given.repartition(n)).collect()))) for n in (1, 3, 8)}
    assert len(seen) == 1
    made = mixing.mix(given, fraction=0.5, epochs=1).collect()
    assert len(made) == len(rows)
    drawn = sum(r.copies * r.n_tokens for r in made)
    assert 0.9 * sum(r.n_tokens for r in made) * 0.5 < drawn <= sum(r.n_tokens for r in made) * 0.5


def test_water_level(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 5), ("b", "x", "4", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, 200, epochs=1).collect()}
    # Domain a gets 100: y can use 5, so x gets 95, of which source 1 can use 10.
    assert got == {"1": 10, "2": 85, "3": 5, "4": 100}


def test_warc(spark):
    rng = random.Random(4)
    htmls = [None, "", "a", "a", "ü" * 1000, "\r\n\r\nWARC/1.0\r\n", "x" * 3_000_000] + [rng.choice(["<p>same</p>", f"<p>{i}</p>"]) for i in range(80)]
    rows = [(i, None if i % 9 == 0 else f"http://e/{i} \r\nx", h, "clash") for i, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    got = {r.page_id: r for r in warc.read_records(warc.archive_pages(pages), warc.shared_dir(spark), with_payload=True).collect()}
    largest = {}
    for i, h in enumerate(htmls):
        largest[h or ""] = i
    for i, h in enumerate(htmls):
        data, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        first = largest[h or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert r.payload == (data if first == i else None)
    for keep in (True, False):
        folder = f"{warc.shared_dir(spark)}/kept-{keep}-{rng.random()}"
        assert warc.archive_pages(pages, folder, keep_streams=keep).count() > 0
        files, top = warc._opened(f"{folder}/streams")
        assert bool([f for f in os.listdir(top) if f.endswith(".warc.gz")]) == keep
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.archive_pages(none), warc.shared_dir(spark)).count() == 0


def test_warc_stream_pieces():
    records = [warc.record_bytes(i, "u", b"p" * i * 1000, "D", None if i % 2 else 3) for i in range(9)]
    import gzip
    import io

    whole = gzip.compress(b"".join(records[:5])) + gzip.compress(b"".join(records[5:]))
    assert [r for _, r in warc.split_records(warc.inflate(io.BytesIO(whole), 777))] == records
    with pytest.raises(ValueError):
        list(warc.split_records(iter([records[3][:-9]])))


def test_range_join(spark, monkeypatch):
    monkeypatch.setattr(range_join, "CELL", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(500):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.5, 20)], None if i % 50 == 7 else i % 3))
    rows += [(500 + i, rows[3][1], rows[3][2]) for i in range(20)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] * 16, 1), (604, [float("inf")] * 16, 1), (605, [], 1), (606, [1.0] * 3, 1), (607, [2.0] * 3, 1)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, dim string").repartition(4)
    good = {i: (np.float32(v).astype(float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i, *_ in rows}
    for i, (a, la) in good.items():
        for j, (b, lb) in good.items():
            if i != j and la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i].add(j)
    component = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            low = min([component[i], *(component[j] for j in js)])
            if low < component[i]:
                component[i], changed = low, True
    assert sum(map(len, links.values())) > 500
    for tile in (1024, 16):
        for r in range_join.near_vectors(frame, tile=tile).collect():
            assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), component[r.vec_id], component[r.vec_id] == r.vec_id)
    assert range_join.near_vectors(frame.limit(0)).count() == 0


def test_range_join_copies_no_vector_for_a_tile(spark):
    rng = np.random.default_rng(8)
    n, dim = 6000, 24
    vectors = rng.normal(size=(n, dim))
    for i in range(0, n, 3):  # a third lie beside an earlier one, many of them beside the first
        vectors[i] = vectors[rng.integers(max(1, i)) if i % 2 else 0] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.3])
    vectors, labels = vectors.astype(np.float32), np.where(np.arange(n) % 10 == 1, 1, 0)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    component, before = np.arange(n), None
    while before is None or (component != before).any():
        before = component
        component = np.minimum(before, np.where(near, before[None, :], n).min(1))
    frame = spark.createDataFrame(list(zip(range(n), vectors.tolist(), labels.tolist())), "vec_id long, embedding array<float>, label int").repartition(4)
    jvm = spark._jvm
    held = lambda: {f.getName(): f.length() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    start = held()
    got = range_join.near_vectors(frame, tile=64).collect()
    assert sum(size for name, size in held().items() if name not in start) < 10 * vectors.nbytes
    assert len(got) == n and near.sum() > 100_000
    assert all((r.n_links, r.component_id, r.kept) == (near[r.vec_id].sum(), component[r.vec_id], component[r.vec_id] == r.vec_id) for r in got)


def test_sharding(spark, docs):
    many = docs.select("doc_id", "text").unionByName(spark.range(5000, 9000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"))).unionByName(spark.createDataFrame([(None, "n"), (None, None)] + [(None, "same")] * 300, "doc_id long, text string"))
    rows = sharding.shard(many, part_rows=100).collect()
    assert len(rows) == many.count()
    total, biggest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    assert all(abs(sum(r["size"] for r in rs) - total / 16) <= 2 * biggest for rs in by_shard.values())
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by_shard.values())
    known = local(docs)
    for r in rows:
        if r.doc_id in known:
            data = (known[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32, r.grown_shard) == (len(data) + 1, zlib.crc32(data), None)
    assert sharding.shard(empty(spark)).count() == 0


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(11)
    rows = [(i, f"text {rng.randrange(6000)} " * 3) for i in range(20_000)] + [(30_000 + i, "large group") for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), ranges=16, part_rows=50).collect()
    known, where = dict(rows), {}
    for r in got:
        where.setdefault(known[r.doc_id], set()).add(r.shard)
    assert all(len(v) == 1 for t, v in where.items() if t != "large group") and len(got) == len(rows)
    sums = [sum(r["size"] for r in got if r.shard == s) for s in range(16)]
    assert max(sums) <= 1.05 * sum(sums) / 16 and min(sums) >= 0.95 * sum(sums) / 16
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def brute_repeats(texts: dict, length: int = 50) -> dict:
    first, out = {}, {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][s : s + length], i)
    for i, data in texts.items():
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < i:
                gone[s : s + length] = True
        out[i] = (len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(data, np.uint8)[~gone[:-1]]))
    return out


def test_repeats(spark, docs):
    rng = random.Random(8)
    more = ["ab" * rng.randrange(40, 60) for _ in range(6)] + ["".join(rng.choice("ab") for _ in range(400)) for _ in range(20)] + ["z" * k for k in (49, 50, 51, 120)] * 2
    given = docs.select("doc_id", "text", F.lit(1).alias("row")).unionByName(spark.createDataFrame([(1000 + i, t, 1) for i, t in enumerate(more)], "doc_id long, text string, row int"))
    want = brute_repeats({i: (t or "").encode() for i, t in local(given).items()})
    for r in suffix_dedup.remove_repeats(given).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
    odd = spark.createDataFrame([(None, "q" * 80), (1, "q" * 80), (1, "q" * 80), (2, "q" * 80)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect()) == [(0, 0), (1, 0), (1, 0), (2, 80)]
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("hot, hot_total, length", [(2, 50_000, 50), (1, 50_000, 50), (10**9, 3, 50), (3, 5, 20), (2, 8, 200)])
def test_hot_grams_change_no_result(spark, monkeypatch, hot, hot_total, length):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 9000)
    rng = random.Random(hot)
    passage = "a passage that a third of all documents have, long enough for several grams, and more so with these words " * 2
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 90)))
    given = [line() + (passage[rng.randrange(0, 30) : len(passage) - rng.randrange(0, 30)] if rng.random() < 0.6 else line()) + line() for _ in range(150)]
    given += [passage, passage, "z" * 300, "z" * 260 + "y", given[3], given[3] + "!", "", chr(0) * 120]
    rng.shuffle(given)
    want = brute_repeats({i: t.encode() for i, t in enumerate(given)}, length)
    rows = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    for r in suffix_dedup.remove_repeats(rows, length=length, hot=hot, hot_total=hot_total).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("length", [20, 50, 200])
def test_repeats_of_any_length(spark, length):
    rng = random.Random(length)
    shared = [bytes(rng.choice(b"ab\x00") for _ in range(500)).decode() for _ in range(3)]
    given = ["first " + "\x00" * 60, "other " + "\x00" * 60, "\x00" * 300, "x" * 700, "y" + "x" * 650]
    given += [rng.choice(shared)[rng.randrange(200) :][: rng.randrange(300)] + str(i) + rng.choice(shared)[rng.randrange(300) :] for i in range(30)]
    want = brute_repeats({i: t.encode() for i, t in enumerate(given)}, length)
    rows = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    for r in suffix_dedup.remove_repeats(rows, length=length).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(rows, length=10)


def test_suffix_ranks():
    rng = np.random.default_rng(9)
    for n in (5, 6, 7, 8, 40, 301):
        for letters in (1, 2, 30):
            text = rng.integers(1, letters + 1, n)
            for wanted in (np.arange(n), np.arange(1, n, 2)):
                at = wanted[np.argsort(suffix_dedup.suffix_ranks(text, 50, wanted))]
                prefixes = [tuple(text[i : i + 50].tolist()) for i in at]
                assert prefixes == sorted(prefixes)


def test_large_sorts():
    # Names and ranks of this many different suffixes together need more than 63 bits.
    text = np.random.default_rng(6).integers(1, 257, 7 << 19)
    wanted = np.arange(0, len(text) - 50, 1009)
    at = wanted[np.argsort(suffix_dedup.suffix_ranks(text, 50, wanted))]
    prefixes = [tuple(text[i : i + 50].tolist()) for i in at]
    assert prefixes == sorted(prefixes)


def test_hot_gram(monkeypatch):
    rng = np.random.default_rng(7)
    sizes = []
    whole = suffix_dedup.earliest
    monkeypatch.setattr(suffix_dedup, "earliest", lambda rows, starts, stops, first, length: sizes.append(int((stops - starts + 1).sum())) or whole(rows, starts, stops, first, length))
    for kind in range(3):
        n, length, reach = 400, 50, 34
        rows = rng.integers(1, 3, (n, 84)).astype(np.uint8)
        for k in range(n):
            like = rng.integers(0, n)
            a, b = sorted(rng.integers(0, 85, 2)) if kind == 0 else ((0, 60) if kind == 1 else (20, 84))
            rows[k, a:b] = rows[like if kind == 0 else 0, a:b]
        rows[:, 34:50] = 7
        starts, stops = 34 - rng.integers(0, 35, n), 50 + rng.integers(0, 35, n)
        first = rng.permutation(n)
        want = whole(rows, starts, stops, first, length)
        monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 2000)
        sizes.clear()
        got = suffix_dedup.earliest_bounded(rows, starts, stops, first, length, 0, reach)
        assert (got == want).all() and max(sizes) <= 2000


def brute_jaccard(texts: dict):
    hashes = path_join.WordHashes()
    sets = {i: frozenset(path_join.shingles(t, hashes).tolist()) for i, t in texts.items()}
    root, links = {i: i for i in texts}, {i: 0 for i in texts}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if (texts[i] or "") == (texts[j] or "") or (a and b and len(a & b) >= 0.8 * len(a | b)):
                links[i] += 1
                links[j] += 1
                low, high = sorted((root[i], root[j]))
                root = {x: low if r == high else r for x, r in root.items()}
    return root, links


def test_near_duplicates(spark, docs, monkeypatch):
    monkeypatch.setattr(path_join, "TILE", 16)
    rng = random.Random(10)
    base = [f"b{i}" for i in range(150)]
    many = []
    for i in range(70):
        t = list(base)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(150)] = f"x{rng.randrange(9)}"
        many.append((1000 + i, " ".join(t)))
    given = docs.select("doc_id", "text", F.lit(0).alias("own")).unionByName(spark.createDataFrame([(*r, 0) for r in many], "doc_id long, text string, own int"))
    root, links = brute_jaccard(local(given))
    for small in (64, 8):
        for r in path_join.near_duplicates(given, small=small).collect():
            assert (r.class_id, r.n_links) == (root[r.doc_id], links[r.doc_id]), r.doc_id
    assert path_join.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_any_ids(spark):
    base = " ".join(f"n{i}" for i in range(200))
    rows = [(1, "one text here"), (1, "quite another text"), (1, base), (1, base), (None, base + " tail"), (None, "lonely"), (None, "lonely"), (5, base + " end"), (3, None), (4, ""), (None, " ")]
    given = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, leads string").repartition(4)
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.n_links) for r in path_join.near_duplicates(given).collect()))
    assert got == sorted([(1, 1, 0), (1, 1, 0), (1, 1, 3), (1, 1, 3), (0, 1, 3), (0, 0, 1), (0, 0, 1), (5, 1, 3), (3, 3, 1), (4, 3, 1), (0, 0, 0)])
    kept = path_join.without_duplicates(given)
    assert kept.columns == given.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, "one text here"), (1, "quite another text"), (1, base), (0, "lonely"), (3, ""), (0, " ")])


def test_recall_at_the_threshold(spark):
    rng = random.Random(12)
    rows, pairs = [], []
    for k in range(400):
        # 96 n-grams; five words apart, two changed words take ten of them: 86 of 106 are shared.
        own = [f"p{k}x{i}" for i in range(100)]
        like = list(own)
        for at in (rng.randrange(10, 40), rng.randrange(50, 90)):
            like[at] = "changed"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(like))]
    got = {r.doc_id: r.class_id for r in path_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(400)) >= 399
    for depth in (3, 8):
        assert path_join.runs_for(0.9999, 0.8, depth) > path_join.runs_for(0.99, 0.8, depth)


def test_dense_sets(spark):
    rng = random.Random(13)
    base = [f"d{i}" for i in range(300)]
    rows = []
    for i in range(600):
        t = list(base)
        for at in rng.sample(range(300), 3):
            t[at] = f"y{rng.randrange(99)}"
        rows.append((i, " ".join(t)))
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    root, links = brute_jaccard(dict(rows))
    assert len(set(root.values())) < 300
    for r in path_join.near_duplicates(given, small=32, large=64).collect():
        assert (r.class_id, r.n_links) == (root[r.doc_id], links[r.doc_id])


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline
    from fleetlog.llm.common import cut_table

    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    for name, stage in pipeline.STAGES:
        docs = cut_table(stage(spark, docs, sf))
        held[name] = docs
        if name != "pieces":
            assert docs.dtypes == start.dtypes
    known = local(start)
    assert {r.doc_id for r in held["language"].collect()} == {i for i, t in known.items() if any(c.isalpha() for c in t or "")}
    root, _ = brute_jaccard(local(held["language"]))
    assert {r.doc_id for r in held["near_duplicates"].collect()} == set(root.values())
    want = brute_repeats({i: t.encode() for i, t in local(held["near_duplicates"]).items()})
    got = local(held["repeated_passages"])
    assert all(got[i] == w[3].decode("utf-8", "ignore") for i, w in want.items() if i in got) and all(w[3] == b"" for i, w in want.items() if i not in got)
    kept = local(held["mixture"])
    # Each leaf stops before the document that no longer fits, so small leaves stay under their budgets.
    assert set(kept) <= set(got) and 0.5 < sum(len(t.split()) for t in kept.values()) / sum(len(t.split()) for t in got.values()) <= 0.8
    assert {r.doc_id for r in held["pieces"].collect()} == set(kept)
    assert sorted(r.n_tokens for r in pipeline.run(spark, sf).collect()) == sorted(r.n_tokens for r in held["pieces"].collect())


def test_pipeline_of_odd_rows(spark, sf):
    import corpus_pipeline as pipeline

    known = spark.read.parquet(f"{sf}/documents.parquet")
    word = {r.doc_id: r for r in known.limit(12).collect()}
    a, b, c = (list(word.values())[i] for i in (0, 1, 2))
    odd = [(1, a.text, a.lang, a.source, a.n_chars), (1, b.text, b.lang, b.source, b.n_chars), (None, c.text, c.lang, c.source, c.n_chars), (7, None, None, None, None), (8, "", "en", "src1", 0)]
    docs = spark.createDataFrame(odd, known.schema)
    near = pipeline.drop_near_duplicates(spark, docs, sf)
    assert sorted((r.doc_id or 0, r.text or "") for r in near.collect()) == sorted([(1, a.text), (1, b.text), (0, c.text), (7, "")])
    for fraction in (1.0,):
        from fleetlog.llm import mixing

        assert mixing.draw(near, fraction=fraction).count() >= 3
    none = known.limit(0)
    for name, stage in pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0, name
