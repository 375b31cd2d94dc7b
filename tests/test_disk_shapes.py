"""Queries whose intermediate rows outgrew the disk, or that ran on a local master only."""

import tempfile
import time
from pathlib import Path

import pytest

from affinis.operators import blocks, lsh, overlap, ratings, subsets
from affinis.plans import files_catalogue, relations as rel
from affinis.plans.catalogue import QUERIES
from affinis.sources import files, shared

SF = "/root/testdata/sf0.001"


def test_bucket_pairs_do_not_look_up_the_rows_of_each(spark, monkeypatch):
    r = spark.createDataFrame([(e, d, float((e + d) % 5)) for e in range(30) for d in range(20) if (e + d) % 3], "e long, d long, v double")
    want = sorted(map(tuple, lsh.verified_pairs(r, 0.3, strategy="overlap").collect()))

    def refuse(*_):
        raise AssertionError("rows of each pair")

    monkeypatch.setattr(lsh, "sums_of", refuse)
    assert want and sorted(map(tuple, lsh.verified_pairs(r, 0.3, strategy="bucket").collect())) == want


def test_fixture_lies_in_the_shared_folder(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a folder of the driver's own")

    monkeypatch.setattr(tempfile, "TemporaryDirectory", refuse)
    assert all(r.violations == 0 for r in QUERIES["fixture_roundtrip"](spark, SF).collect())


def test_results_are_placed_without_a_shuffle_of_lines(spark, tmp_path):
    sims = spark.createDataFrame([(i, j, float(i * 100 + j)) for i in range(20) for j in range(i + 1, 20)], "i long, j long, sim double")
    files.write_results(sims, f"file://{tmp_path}/r")
    for size in ("128m", "100b"):  # whole files, and files cut into splits
        was = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = files.results(spark, f"file://{tmp_path}/r")
            assert [r.sim for r in df.orderBy("k").collect()] == sorted(r.sim for r in sims.collect())
            assert sorted(r.k for r in df.collect()) == list(range(190))
            assert "row_number" not in df._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ratings_are_dealt_once_for_their_aggregate_and_their_lists(spark):
    text = plan(blocks._lists(rel.suppliers(spark, SF), 1))
    assert text.count("Exchange hashpartitioning(d#") == 1 and "Exchange hashpartitioning(e#" not in text


def test_shuffles_of_a_written_table_go_before_the_next_step(spark):
    def left():
        return sum(f.stat().st_size for f in Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()).rglob("shuffle_*.data"))

    shared.freed(spark)
    time.sleep(1)
    before = left()
    shared.kept(spark.range(400_000).selectExpr("id", "uuid() AS x").repartition("id"), "rows")
    time.sleep(0.5)
    assert left() <= before + 1_000_000


def test_the_driver_makes_no_files_for_written_tables(spark):
    """For each it would start a process, which doubles its memory for a moment."""
    root = Path(shared.shared_dir(spark).removeprefix("file://")) / "affinis"
    before = set(root.iterdir()) if root.exists() else set()
    QUERIES["lsh_jaccard_pairs_100"](spark, SF)
    made = [p for p in root.iterdir() if p not in before]
    assert {"ratings", "signatures", "candidates"} <= {p.name.split("-")[0] for p in made}
    assert not any((p / "_SUCCESS").exists() for p in made)


def refused(*_, **__):
    raise AssertionError("must not be called")


def test_exact_models_do_not_look_for_entities_of_few_rows(spark, monkeypatch):
    from affinis.plans.engine import similarity

    monkeypatch.setattr(ratings, "supported", refused)
    r = spark.createDataFrame([(e, d, float((e * d) % 5)) for e in range(8) for d in range(6) if e < 7 or d < 2], "e long, d long, v double")
    want = sorted(map(tuple, overlap.model(overlap.six_sums(r)).collect()))
    for payload in ("packed", "i32"):
        assert want and sorted(map(tuple, similarity(r, payload=payload, partition="dim", shards=2).collect())) == want


def test_part_model_does_not_look_for_entities_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(ratings, "supported", refused)
    assert QUERIES["part_pearson_emitted"](spark, SF).columns == ["i", "j", "n", "sim"]


def test_prefix_is_formed_once(spark):
    pairs = spark.range(2000).selectExpr("id % 50 AS i", "id AS j", "rand(1) AS sim")
    assert "Range" not in plan(subsets.prefix_report(pairs, [1, 3, 64]))


def test_result_check_forms_similarities_once(spark):
    assert "MapInArrow" not in plan(QUERIES["result_check_report"](spark, SF))


def test_crosscheck_forms_similarities_once(spark):
    assert "MapInArrow" not in plan(QUERIES["model_crosscheck"](spark, SF))


def test_membership_difference_forms_similarities_once(spark):
    assert "MapInArrow" not in plan(QUERIES["model_membership_difference"](spark, SF))


def test_large_tables_are_joined_and_listed_in_turns(spark, monkeypatch):
    """The shuffles of a turn go before the next one, and joined rows go when their lists are written."""
    key = lambda df: sorted(map(tuple, df.collect()))
    names = ["pair_six_stats", "packed_words", "pearson_two_pass", "source_model"]
    want = {n: key(QUERIES[n](spark, SF)) for n in names}
    monkeypatch.setattr(rel, "leaf_bytes", lambda df: [2 * rel.TURN])
    monkeypatch.setattr(blocks, "leaf_bytes", lambda df: [2 * blocks.TURN])
    shuffles = lambda df: plan(df).count("Exchange")
    assert "SortMergeJoin" not in plan(rel.suppliers(spark, SF, apart=True)) and shuffles(rel.suppliers(spark, SF, apart=True)) == 1
    shared._ONCE.clear()
    turns = []
    made = blocks._lists
    monkeypatch.setattr(blocks, "_lists", lambda *a: turns.append(1) or made(*a))
    for n in names:
        turns.clear()
        assert want[n] and key(QUERIES[n](spark, SF)) == want[n], n
        assert len(turns) == 2 and not shared._ONCE


def test_the_model_file_is_compressed_and_its_sums_go_before_it_is_read(spark):
    freed = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(files_catalogue, "freed", freed.append)
        files = QUERIES["source_model"](spark, SF).inputFiles()
    assert files and all(f.endswith(".json.gz") for f in files) and len(freed) == 1
