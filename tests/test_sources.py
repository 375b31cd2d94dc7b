"""File sources, the fixture data source, traces, statistics and the streaming store."""

import json
import os
import sqlite3
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import content, overlap, stats, subsets
from affinis.plans import recommender
from affinis.schemas import InputRefused, ValidationFailed
from affinis.sources import files, fixture, trace
from affinis.streaming.deltas import SumStore, event_counts, maintain


def write(path, lines):
    path.write_text("".join(f"{x}\n" for x in lines))
    return f"file://{path}"


def test_reviews_keep_file_order(spark, tmp_path):
    p = write(tmp_path / "r.json", [json.dumps({"user_id": "u", "business_id": "b", "stars": s, "text": "x", "more": 1}) for s in (1, 5, 3)])
    assert [(r.line, r.stars) for r in files.numbered_reviews(spark, p).orderBy("line").collect()] == [(0, 1.0), (1, 5.0), (2, 3.0)]
    assert files.reviews(spark, p).count() == 3


def test_malformed_lines_fail(spark, tmp_path):
    p = write(tmp_path / "bad.json", ['{"user_id": "u"', '{"user_id": "v"}'])
    with pytest.raises(Exception, match="(?i)malformed"):
        files.reviews(spark, p).collect()


def test_models_averages_stop_words(spark, tmp_path):
    m = write(tmp_path / "m.json", ['{"b1": "z", "b2": "a", "sim": 0.5}'])
    assert tuple(files.model(spark, m).first()) == ("a", "z", 0.5)
    a = write(tmp_path / "avg.json", ['{"u1": 3.5, "UNK": 3.0}'])
    assert {r.id: r.avg for r in files.averages(spark, a).collect()} == {"u1": 3.5, "UNK": 3.0}
    assert files.averages_beside("/x/y/train.json", "user_avg.json") == "/x/y/user_avg.json"
    stop = files.stop_words(spark, write(tmp_path / "stop", ["the", "a", "the"]))
    assert sorted(r.word for r in stop.collect()) == sorted([*content.EXTRA_STOP, "a", "the"])
    d = spark.createDataFrame([("b", "the cat A hat")], "doc string, text string")
    assert sorted(r.word for r in content.tokens(d, "doc", stop=stop).collect()) == ["cat", "hat"]


def test_sectioned_file_roundtrip(spark, tmp_path):
    items = spark.createDataFrame([("b1", ["x", "y"])], "b string, words array<string>")
    users = spark.createDataFrame([("u1", ["x"])], "u string, words array<string>")
    out = f"file://{tmp_path}/sect"
    files.write_sections({"business profiles:": items, "user profiles:": users}, out)
    got = files.sections(spark, out, ["business profiles:", "user profiles:"])
    assert [tuple(r) for r in files.profiles_of(got["business profiles:"], "b", "words").collect()] == [("b1", ["x", "y"])]
    assert [tuple(r) for r in files.profiles_of(got["user profiles:"], "u", "words").collect()] == [("u1", ["x"])]


def test_jsonl_sink_and_names(spark, tmp_path):
    sims = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.0)], "i int, j int, sim double")
    ents = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "e int, id string")
    files.write_jsonl(files.sims_to_model(sims, ents), f"file://{tmp_path}/out", single=True)
    assert spark.read.json(f"file://{tmp_path}/out").select("a", "b", "sim").collect()[0] == ("a", "b", 0.5)


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(e, d, float((e * 7 + d * 3) % 5 + 1)) for e in range(6) for d in range(5) if (e + d) % 4]
    r = spark.createDataFrame(rows, "e long, d long, v double")
    fixture.export(r, overlap.with_similarity(overlap.six_sums(r)), str(tmp_path / "f"))
    return tmp_path / "f"


def test_fixture_is_valid_and_read_in_parts(spark, stored, monkeypatch):
    fixture.require_valid(spark, str(stored))
    read = lambda part: sorted(map(tuple, spark.read.format("csr_fixture").option("path", str(stored)).option("part", part).load().collect()))
    assert read(2) == read(1000) and len(read(2)) == fixture.checked(str(stored))[1]
    whole = [r for b in fixture.FixtureReader(str(stored), "ratings", 1000).read(fixture.InputPartition((0, 6))) for r in b.to_pylist()]
    monkeypatch.setattr(fixture, "BATCH", 2)
    assert whole == [r for b in fixture.FixtureReader(str(stored), "ratings", 1000).read(fixture.InputPartition((0, 6))) for r in b.to_pylist()]


def test_fixture_is_gathered_in_chunks(spark, stored, tmp_path, monkeypatch):
    """The driver holds ROWS rows at most; ids may be texts; an entity of more rows comes whole."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(e, d, float((e * 7 + d * 3) % 5 + 1)) for e in range(6) for d in range(5) if (e + d) % 4]
    most, made = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: most.append((df.columns, len(t := made(df)))) or t)
    for limit in (7,):
        monkeypatch.setattr(fixture, "ROWS", limit)
        for kind in ("long", "string"):
            r = spark.createDataFrame([(e, d, v) if kind == "long" else (f"{e}", f"{d}", v) for e, d, v in rows], f"e {kind}, d {kind}, v double")
            most.clear()
            meta = fixture.export(r, overlap.with_similarity(overlap.six_sums(r)), out := str(tmp_path / f"{kind}{limit}"))
            chunks = [n for columns, n in most if "n" not in columns]
            assert len(chunks) > 4 and max(chunks) <= max(limit, 5)
            assert meta["files"] == json.loads((stored / "meta.json").read_text())["files"]
            fixture.checked(out)


def test_corrupted_golden_is_found(spark, stored):
    g = np.fromfile(stored / "golden.bin")
    g[0] += 1e-6
    g.tofile(stored / "golden.bin")
    with pytest.raises(ValidationFailed, match="golden_recomputed"):
        fixture.require_valid(spark, str(stored))


def test_short_golden_is_refused(spark, stored):
    np.fromfile(stored / "golden.bin")[:-1].tofile(stored / "golden.bin")
    with pytest.raises(InputRefused, match="golden"):
        fixture.checked(str(stored))


def test_trace_overlap(spark, tmp_path):
    db = str(tmp_path / "t.sqlite")
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE StringIds (id INTEGER, value TEXT)")
        con.execute("CREATE TABLE CUPTI_ACTIVITY_KIND_KERNEL (deviceId INTEGER, shortName INTEGER, start INTEGER, end INTEGER)")
        con.executemany("INSERT INTO StringIds VALUES (?, ?)", [(1, "reduce"), (2, "stats")])
        con.executemany("INSERT INTO CUPTI_ACTIVITY_KIND_KERNEL VALUES (?, ?, ?, ?)", [(0, 1, 0, 10), (0, 1, 5, 20), (0, 2, 15, 40), (0, 2, 60, 70)])
    k = trace.kernels(spark, db)
    r = stats.overlap_report(k.where("name = 'reduce'").select("device", "s", "e"), k.where("name = 'stats'").select("device", "s", "e"), ["device"], 7)
    assert tuple(r.first()) == (0, 20, 35, 5)


def test_records_and_summary(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    xs = [1.0, 4.0, 2.0, 8.0, 3.5]
    for b, x in enumerate(xs):
        trace.append_record(str(p), {"config": "c", "block": b, "segment": "s", "seconds": x})
    trace.append_record(str(p), {"config": "d", "block": 0, "segment": "s", "seconds": 1.0})
    got = {r.config: r for r in stats.trial_summary(trace.records(spark, f"file://{p}")).collect()}
    q1, _, q3 = statistics.quantiles(xs, n=4)
    assert (got["c"].p25_s, got["c"].p75_s, got["c"].median_s) == (q1, q3, 3.5)
    assert got["c"].stdev_s == pytest.approx(statistics.stdev(xs)) and got["d"].p25_s is None and got["d"].stdev_s == 0.0


def test_tokens_and_profiles(spark):
    d = spark.createDataFrame([("b", "The cat, the CAT 42 - sat."), ("c", None), ("d", "")], "doc string, text string")
    assert sorted((r.doc, r.word) for r in content.tokens(d, "doc", stop=["the"]).collect()) == [("b", "cat"), ("b", "cat"), ("b", "sat")]
    items = spark.createDataFrame([("b", ["x", "y"]), ("c", ["z"])], "doc string, words array<string>")
    reviews = spark.createDataFrame([("u", "c", 2), ("u", "b", 1), ("v", "q", 1)], "u string, doc string, ord int")
    assert {r.u: r.words for r in content.user_profiles(reviews, items).collect()} == {"u": ["x", "y", "z"], "v": []}
    assert {r.u: r.words for r in content.user_profiles(reviews, items, "first").collect()} == {"u": ["x", "y"], "v": []}


def test_stream_of_cells_equals_the_whole(spark, tmp_path):
    rows = [(e, d, float((e * 5 + d) % 7 + 1)) for e in range(8) for d in range(6)]
    r = spark.createDataFrame(rows, "e long, d long, v double")
    src = f"{tmp_path}/in"
    for k in range(3):
        r.where(F.pmod(F.col("e") + F.col("d"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(src)
    r.limit(5).coalesce(1).write.mode("append").parquet(src)  # cells that come again count once
    store = SumStore(spark, f"{tmp_path}/store")
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = maintain(stream, store, f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert q.exception() is None
    want = overlap.with_similarity(overlap.six_sums(r))
    key = lambda d: sorted(map(tuple, d.select("i", "j", "n", "sim").collect()))
    assert key(store.totals()) == key(want)


def test_batches_run_again_and_compaction_change_nothing(spark, tmp_path):
    rows = [(e, d, float((e * 5 + d) % 7 + 1)) for e in range(8) for d in range(6)]
    r = spark.createDataFrame(rows, "e long, d long, v double")
    twice = r.union(r.select("e", "d", (F.col("v") + 1).alias("v")))
    want = overlap.with_similarity(overlap.six_sums(r.select("e", "d", (F.col("v") + 1).alias("v"))))
    key = lambda d: sorted(map(tuple, d.select("i", "j", "n", "sim").collect()))
    store = SumStore(spark, f"{tmp_path}/store")
    for b in (0, 1, 1, 2):  # a batch that is run again
        store.add(twice.where(F.pmod(F.col("d"), F.lit(3)) == b), b)
        store.compact(b - 1)
    assert key(store.totals()) == key(want)
    store.compact(2)
    assert key(store.totals()) == key(want)
    late = SumStore(spark, f"{tmp_path}/late")
    late.add(r.withColumn("ord", F.lit(2)).union(r.select("e", "d", (F.col("v") + 1).alias("v"), F.lit(1).alias("ord"))), 0)
    assert key(late.totals()) == key(overlap.with_similarity(overlap.six_sums(r)))


def test_partial_sums_are_merged_in_turns_and_go(spark, tmp_path, monkeypatch):
    """The shuffle of a turn goes before the next one; lists and merged rows do not stay; a result that
    was formed before stays whole."""
    from affinis.sources import shared
    from affinis.streaming import deltas

    r = spark.createDataFrame([(e, d, float((e * 5 + d) % 7 + 1)) for e in range(40) for d in range(9)], "e long, d long, v double")
    want = overlap.with_similarity(overlap.six_sums(r, 1))
    key = lambda d: sorted(map(tuple, d.select("i", "j", *deltas.SIX, "sim").collect()))
    monkeypatch.setattr(deltas, "TURN", 6000)
    root, turns = shared.shared_dir(spark).removeprefix("file://") + "/affinis", []
    monkeypatch.setattr(deltas, "freed", turns.append)
    lists = lambda: {x for x in os.listdir(root) if x.startswith("lists-")} if os.path.isdir(root) else set()
    before = lists()
    store = SumStore(spark, f"{tmp_path}/store")
    for b in range(3):
        store.add(r.where(F.pmod(F.col("d"), F.lit(3)) == b), b)
    assert lists() == before
    early = store.totals(1)
    turns.clear()
    store.compact(1)
    assert len(turns) > 2
    assert {x for k in ("base", "sums") for x in os.listdir(tmp_path / "store" / k)} == {"batch=1", "batch=2"} and not os.path.exists(tmp_path / "store/merging")
    assert key(store.totals(1)) == key(early) == key(want)
    store.compact(2)
    store.add(r.where("d % 3 = 1"), 1)  # run again after it was merged
    assert os.listdir(tmp_path / "store/base") == ["batch=2"] and key(store.totals(1)) == key(want)


def test_results_keep_their_places(spark, tmp_path):
    sims = spark.range(5000).select((F.col("id") % 71).alias("i"), F.col("id").alias("j"), F.rand(3).alias("sim"))
    files.write_results(sims, f"{tmp_path}/out")
    want = [r.sim for r in sims.orderBy("i", "j").collect()]
    assert [r.sim for r in files.results(spark, f"{tmp_path}/out").orderBy("k").collect()] == want


def test_shard_ranges_beyond_doubles(spark):
    total = 2**53 + 3
    ranges = subsets.shard_ranges(spark, total, 7).orderBy("g").collect()
    assert [(r.begin, r.end) for r in ranges] == [(total * g // 7, total * (g + 1) // 7) for g in range(7)]


def test_train_and_predict_from_files(spark, tmp_path):
    """The last line of a pair counts; an unknown item falls back to the overall average of the file."""
    rows = [("u1", "b1", 1), ("u1", "b1", 4), ("u2", "b1", 5), ("u3", "b1", 1), ("u1", "b2", 4), ("u2", "b2", 5), ("u3", "b2", 1), ("u4", "b2", 2), ("u4", "b3", 3)]
    train = write(tmp_path / "train.json", [json.dumps({"user_id": u, "business_id": b, "stars": s, "text": ""}) for u, b, s in rows])
    test = write(tmp_path / "test.json", [json.dumps({"user_id": u, "business_id": b}) for u, b in (("u4", "b1"), ("u9", "b9"))])
    paths = [f"file://{tmp_path}/{x}" for x in ("model", "avg", "out")]
    recommender.train(spark, train, paths[0], "item", averages_path=paths[1])
    assert [(r.a, r.b) for r in files.model(spark, paths[0]).collect()] == [("b1", "b2")]
    recommender.predict(spark, train, test, paths[0], paths[2], "item", averages_path=paths[1])
    got = {(r.user_id, r.business_id): r.stars for r in files.reviews(spark, paths[2]).collect()}
    assert got["u4", "b1"] == 2.0 and got["u9", "b9"] == pytest.approx(sum([4, 5, 1, 4, 5, 1, 2, 3]) / 8)
    with pytest.raises(InputRefused):
        recommender.train(spark, train, paths[0], "page")


def test_event_windows(spark):
    e = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 23:00:00"), (1, "2024-01-02 00:00:00")], "user_id long, ts string").select("user_id", F.to_timestamp("ts").alias("ts"))
    assert sorted(r.n for r in event_counts(e).collect()) == [1, 2]


def test_train_and_predict_leave_their_files_alone(spark, tmp_path):
    from affinis.sources import shared

    at = lambda n: f"file://{tmp_path}/{n}"
    rows = spark.createDataFrame([(f"u{u}", f"b{b}", float((u * b) % 5)) for u in range(6) for b in range(5)], "user_id string, business_id string, stars double")
    files.write_jsonl(rows, at("train"), compression="gzip")
    root = shared.shared_dir(spark).removeprefix("file://") + "/affinis"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    recommender.train(spark, at("train"), at("model"), averages_path=at("averages"), compression="gzip")
    recommender.predict(spark, at("train"), at("train"), at("model"), at("out"), averages_path=at("averages"), compression="gzip")
    assert files.reviews(spark, at("out")).count() == 30
    assert set(os.listdir(root)) <= before
    assert all(f.endswith((".gz", "_SUCCESS", ".crc")) for n in ("model", "out") for f in os.listdir(tmp_path / n))
