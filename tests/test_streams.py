"""Streams with state, merges by id, and late rows, against the batch operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fleetlog.operators import catalog, usage
from fleetlog.registry import QUERIES, ingest
from fleetlog.sources.kept import KeptTable, children, hash_part
from fleetlog.streaming import deltas, jobs, late, merge

START = datetime.datetime(2024, 1, 1)


def minutes(n):
    return START + datetime.timedelta(minutes=n)


def test_deltas_of_rows_out_of_order(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for session in range(6):
        total, at = 0, 0
        for seq in range(12):
            at += rng.randrange(1, 20)
            total = rng.randrange(40) if rng.random() < 0.1 else total + rng.randrange(50)
            rows.append((session, seq, minutes(at), None if rng.random() < 0.2 else total, rng.randrange(9) if rng.random() < 0.2 else None))
    schema = "session_id long, seq long, ts timestamp, total_input_tokens long, last_input_tokens long"
    # Up to 40 minutes of disorder, in five batches; the watermark is an hour behind.
    dealt = sorted(rows, key=lambda r: (r[2] - START).seconds // 60 + rng.randrange(40))
    dealt.append((-1, 0, minutes(100_000), 0, None))
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for k in range(5):
            part = dealt[k * len(dealt) // 5 : (k + 1) * len(dealt) // 5]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = deltas.stream_delta(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), late="1 hour")
            out.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    made = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = usage.counter_delta(spark.createDataFrame(rows, schema).withColumn("model", F.lit(None)), ["input_tokens"]).select("session_id", "seq", "ts", "input_tokens")
    assert sorted(r for r in made if r[0] >= 0) == sorted(tuple(r) for r in want.collect())


def test_deltas_of_many_sessions_in_few_groups(spark, tmp_path):
    schema = "session_id long, seq long, ts timestamp, total_input_tokens long, last_input_tokens long"
    big = 1 << 60
    rows = [(s, q, minutes(q), big + s + q, None) for s in range(3000) for q in (1, 2)]
    # Totals no float can hold beside missing ones, a pause of over a day, and rows without a session.
    rows += [(5000, 1, minutes(1), big + 1, None), (5000, 2, minutes(2), None, None), (5000, 3, minutes(3), big + 2, None), (5000, 4, minutes(3000), big + 9, None), (None, 1, minutes(1), 7, None), (None, 2, minutes(2), 9, None)]
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        kept = []
        for part in (rows[::2], rows[1::2], [(-1, 0, minutes(100_000), 0, None)]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = deltas.stream_delta(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), late="4000 minutes", groups=4)
            query = out.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination(300)
            kept.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    made = {(r.session_id, r.seq): r.input_tokens for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(s, q): big + s + 1 if q == 1 else 1 for s in range(3000) for q in (1, 2)}
    want |= {(5000, 1): big + 1, (5000, 2): 0, (5000, 3): 1, (5000, 4): big + 9, (None, 1): 7, (None, 2): 2}
    assert {k: v for k, v in made.items() if k[0] != -1} == want
    assert max(kept) < 100


def test_dedup_with_its_state_on_disk(spark, tmp_path):
    schema = "session_id long, ts timestamp, usage_hash string"
    waves = [[(s, minutes(s), f"h{s % 7}" if s % 5 else None) for s in range(60)] for _ in range(2)] + [[(3, minutes(70), "h3"), (3, minutes(71), "new"), (0, minutes(72), None), (1, minutes(73), "h3")]]
    wanted = [*jobs.DISK_STATE, "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k, None) for k in wanted]
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = jobs.stream_dedup(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 day")
        with jobs.disk_state(spark, 3):
            query = out.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert [spark.conf.get(k, None) for k in wanted] == before
        query.awaitTermination(300)
        state = query.recentProgress[0]["stateOperators"][0]
        assert state["numShufflePartitions"] == 3 and "rocksdbPutCount" in state["customMetrics"]
    got = sorted((r.session_id, r.usage_hash or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())
    rows = [(s, h) for wave in waves for s, _, h in wave]
    assert got == sorted([(s, h) for s, h in set(rows) if h] + [(s, "") for s, h in rows if not h])


def test_registered_dedup_holds_no_state_in_the_heap(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest.kept, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    assert QUERIES["st_2_stream_dedup"](spark, sf).count() > 1000
    kinds = {p.suffix for p in (tmp_path / "stream/state/state/0").glob("*/*") if p.is_file() and not p.name.startswith(".")}
    assert kinds & {".changelog", ".zip"} and ".delta" not in kinds


def test_late_rows_are_counted_where_they_enter(spark, tmp_path):
    schema = "session_id long, ts timestamp, model string"
    waves = [[(1, minutes(600), "m")], [(1, minutes(5), "m")] * 100 + [(2, minutes(590), "m"), (3, None, "m")], [(1, minutes(549), "m"), (1, minutes(552), "m"), (4, minutes(900), "m")]]
    for wave in waves:
        spark.createDataFrame(wave, schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        late.split_late(source, str(tmp_path / "split"), str(tmp_path / "cp"), late.window_end(), "50 minutes").awaitTermination(120)
    # The watermark is minute 550: of the last batch the row of minute 549 still counts, as its window ends at 555.
    assert sorted(map(tuple, late.late_counts(spark, str(tmp_path / "split")).collect())) == [(0, 1, 0), (1, 102, 100), (2, 3, 0)]
    rows = late.split_rows(spark, str(tmp_path / "split"), schema, True)
    assert rows.count() == 100 and {r.batch for r in rows.collect()} == {1}


def test_counts_of_more_than_100_batches(spark, tmp_path):
    folder = str(tmp_path / "split")
    rows = lambda k: spark.createDataFrame([(k, minutes(10 * k)), (k, minutes(10 * k - 100))], "session_id long, ts timestamp").coalesce(1)
    for k in [*range(104), 50, 103]:  # two run again
        late.split_batch(rows(k), k, folder, F.col("ts"), "30 minutes")
    # The older row of each batch is behind the watermark from the second batch on.
    assert late.late_counts(spark, folder).agg(F.count("*"), F.sum("rows"), F.sum("late")).first()[:] == (104, 208, 103)


COLUMNS = "id long, provider string, title string, title_custom boolean, content_text string, project_path string, project_name string, is_sidechain boolean, parent_id long, version long"


def sessions(rng, n, version):
    pick = lambda *xs: rng.choice(xs)
    return [(rng.randrange(60), pick("low", "high"), f"t{rng.randrange(9)}", rng.random() < 0.2, f"c{rng.randrange(3)}", pick("", None, "/a", "/b"), pick("", "Unknown Project", "p", None), rng.random() < 0.3, pick(None, 1, 2), version * 100 + k) for k in range(n)]


def test_merged_by_id_over_batches(spark, tmp_path):
    rng, want = random.Random(2), spark.createDataFrame([], COLUMNS).drop("version")
    table = None
    for k in range(4):
        batch = spark.createDataFrame(sessions(rng, 40, k), COLUMNS)
        table = merge.sessions_table(batch, str(tmp_path / "t"))
        wrote = merge.merge_batch(table, batch, k, ["version"], "low", parts=5)
        assert set(wrote) <= set("01234") and merge.merge_batch(table, batch.withColumn("title", F.lit("no")), k, ["version"], parts=5) == []
        want = spark.createDataFrame(catalog.merge_sessions(want, merge.newest(batch, "id", ["version"]).drop("version"), "low").drop("changed").collect(), want.schema)
        assert sorted(map(repr, table.read().drop("version", "changed").collect())) == sorted(map(repr, want.collect()))


def test_kept_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    table = KeptTable(spark, folder, rows((1, "")).schema)
    assert table.read().count() == 0 and table.number() == -1
    put = lambda n, *x: table.change(n, rows(*x), hash_part("id", 4), lambda old, new: old.join(new, "id", "left_anti").unionByName(new))
    put(0, *[(i, "a") for i in range(40)])
    before = table.versions()
    touched = put(1, (7, "b"))
    assert len(touched) == 1 and {p for p, v in table.versions().items() if v == 1} == set(touched) and len(before) == 4
    # A change that breaks off before its manifest is not seen, and can be made again.
    rows((7, "broken")).write.parquet(f"{folder}/version=2/part={touched[0]}")
    assert {r.v for r in table.read().where("id = 7").collect()} == {"b"}
    with pytest.raises(Exception):
        table.change(2, rows((8, "x")), hash_part("id", 4), lambda old, new: new.select(F.raise_error(F.lit("no")).alias("id"), "v"))
    assert table.number() == 1
    put(2, (7, "c"))
    assert table.read().where("id = 7").first().v == "c" and table.read().count() == 40 and table.read(number=1).where("id = 7").first().v == "b"
    table.change(3, rows((7, "gone")), hash_part("id", 4), lambda old, new: old.where("false"))
    assert set(table.versions()) == set("0123") - set(touched)
    table.forget(1)
    assert children(spark, f"{folder}/manifest") == ["change=3"] and table.read().count() == 40 - len([r for r in spark.range(40).select(hash_part("id", 4).alias("p")).collect() if str(r.p) in touched])
