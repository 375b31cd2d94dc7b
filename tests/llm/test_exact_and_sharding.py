"""Exact dedup against DuckDB, sharding laws, and the edge cases of both."""

import zlib

from duck import connection, same
from pyspark.sql import functions as F

from affinis.llm import exact_dedup as X
from affinis.llm import queries as Q
from affinis.llm import sharding as S

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept string, shard string, Score double"
ODD = [(1, "a b\tc", "x", "y", 1.0), (2, "abc", "x", "y", 1.0), (3, None, None, None, None), (4, "", None, None, None), (5, " \n", None, None, None), (6, "é", None, None, None), (6, "é", None, None, None), (None, "q", None, None, None), (-9, "q", None, None, None), (8, "z" * 200_000, None, None, None), (9, "z" * 200_000 + " ", None, None, None)]


def test_equals_duckdb(spark):
    same(Q.op8_exact_dedup(spark, SF), connection(SF), X.ORACLE)


def test_exact_edge_cases(spark):
    got = {}
    for r in X.exact_dedup(spark.createDataFrame(ODD, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].keep_id for i in (1, 2)] == [1, 1]  # the longer original stays
    assert {got[i][0].keep_id for i in (3, 4, 5)} == {5} and got[3][0].group_size == 3
    assert len(got[6]) == 2 and all(r.kept and r.group_size == 2 for r in got[6])
    assert got[None][0].keep_id == -9 and not got[None][0].kept and got[-9][0].kept
    assert got[8][0].keep_id == 9


def test_only_null_ids(spark):
    r = X.exact_dedup(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert [x.keep_id for x in r] == [None, None] and all(x.kept and x.group_size == 2 for x in r)


def test_extreme_ids(spark):
    ids = [2**63 - 1, -(2**63), 0]
    r = X.exact_dedup(spark.createDataFrame([(i, "a") for i in ids], "doc_id long, text string")).collect()
    assert {x.keep_id for x in r} == {-(2**63)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.exact_dedup(empty).count() == 0 and S.sharded(empty).count() == 0


def test_hot_group_is_one_class(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    r = X.exact_dedup(d)
    assert r.where("group_size = 1000 AND keep_id = 0").count() == 1000 and r.where("kept").count() == 2001


def _law(rows, shards):
    size = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return size


def test_shards_are_near_equal_and_gapless(spark):
    docs = Q.table(spark, SF, "documents")
    rows = Q.op4_sharding(spark, SF).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text)
    size = _law(rows, 16)
    longest = max(r["size"] for r in rows)
    assert max(abs(s - sum(size) / 16) for s in size) <= max(longest, 0.02 * sum(size) / 16) + 1
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def test_small_groups_stay_together_and_hot_ones_are_cut(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "hot " * 20).when(F.col("id") < 1520, "rare " * 10).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    rows = S.sharded(d).collect()
    size = _law(rows, 16)
    assert max(size) - min(size) <= 2 * 0.03 * sum(size) / 16 + 200
    assert len({r.shard for r in rows if r.doc_id < 1500}) > 4
    assert len({r.shard for r in rows if 1500 <= r.doc_id < 1520}) == 1


def test_sharding_edge_cases(spark):
    rows = S.sharded(spark.createDataFrame(ODD, SCHEMA), shards=4).collect()
    assert len(rows) == len(ODD)
    _law(rows, 4)
    assert {r["size"] for r in rows if r.doc_id in (3, 4)} == {1}


def test_ranges_grow_and_hot_groups_are_cut(spark, monkeypatch):
    """A third of all rows have one text; ranges of few rows are cut until none is overfull."""
    monkeypatch.setattr(S, "LEAST_EACH", 10)
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))).alias("text"))
    rows = S.sharded(d, shards=4, ranges=8, rows_each=100).collect()
    _law(rows, 4)
    size = [sum(r["size"] for r in rows if r.shard == k) for k in range(4)]
    assert len(rows) == 3000 and max(size) - min(size) <= 2 * max(51, 0.02 * sum(size) / 4) + 2


def test_rows_with_one_key_do_not_hold_up(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_EACH", 10)
    d = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = S.sharded(d, shards=4, ranges=8).collect()
    assert len(rows) == 500
    _law(rows, 4)
