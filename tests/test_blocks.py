"""Sums of pairs block by block: against brute force, and without a shuffle of pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from affinis.operators import blocks, overlap


def cells(n=60, dims=80, share=0.3, seed=3, name=int):
    rng = random.Random(seed)
    return [(name(e), d, float(rng.randint(0, 9))) for e in range(n) for d in range(dims) if rng.random() < share]


def brute(rows, least):
    at = {}
    for e, d, v in rows:
        at.setdefault(d, []).append((e, v))
    sums = {}
    for c in at.values():
        for (i, x), (j, y) in itertools.combinations(sorted(c), 2):
            if i < j:
                s = sums.setdefault((i, j), [0, 0.0, 0.0, 0.0, 0.0, 0.0])
                for k, t in enumerate((1, x, y, x * x, y * y, x * y)):
                    s[k] += t
    return {k: tuple(s) for k, s in sums.items() if s[0] >= least}


def got(df):
    return {(r[0], r[1]): tuple(r)[2:] for r in df.collect()}


def pair_shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange" in x and "hashpartitioning(i#" in x]


@pytest.mark.parametrize("name", [int, lambda e: f"b{e}é"])
def test_sums_equal_brute_force_without_a_shuffle_of_pairs(spark, name):
    rows = cells(name=name)
    kind = "long" if isinstance(rows[0][0], int) else "string"
    r = spark.createDataFrame([*rows, (None, 1, 1.0), (rows[0][0], None, 1.0)], f"e {kind}, d long, v double")
    df = overlap.six_sums(r)
    assert not pair_shuffles(df)
    assert got(df) == brute(rows, 3)


def test_repeated_cells_meet_others_only(spark):
    rows = [*cells(20, 30), *cells(20, 30)[::7]]
    assert got(overlap.six_sums(spark.createDataFrame(rows, "e long, d long, v double"), 1)) == brute(rows, 1)


@pytest.mark.parametrize("payload,shards", [("f64", 3), ("i32", 1), ("i32", 3), ("packed", 1), ("packed", 4)])
def test_payloads_and_shards(spark, payload, shards):
    rows = cells()
    df = overlap.sharded_sums(spark.createDataFrame(rows, "e long, d long, v double"), shards, 3, payload)
    assert not pair_shuffles(df)
    assert got(df) == brute(rows, 3)


def test_two_passes_need_no_shuffle_of_pairs(spark):
    r = spark.createDataFrame(cells(), "e long, d long, v double")
    df = overlap.two_pass(r)
    assert not pair_shuffles(df)
    want = {(x.i, x.j): (x.n, x.sim) for x in overlap.with_similarity(overlap.six_sums(r)).collect()}
    found = got(df)
    assert set(found) == set(want) and all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-12 for k in want)


def test_empty_and_lonely_cells(spark):
    for rows in ([], [(1, 1, 2.0)], [(1, 1, 2.0), (2, 2, 3.0)]):
        assert overlap.six_sums(spark.createDataFrame(rows, "e long, d long, v double"), 1).count() == 0


@pytest.mark.parametrize("form", ["f64", "packed", "centred"])
def test_an_entity_of_many_pairs_is_cut(monkeypatch, form):
    rows = cells(40, 60)
    lists = [sorted((e, v) for e, d, v in rows if d == k) for k in range(60)]
    lists = [x for x in lists if len(x) > 1]
    b = pa.RecordBatch.from_pydict({"block": [0] * len(lists), "take": [len(x) for x in lists], "shard": [k % 3 for k in range(len(lists))], "es": [[e for e, _ in x] for x in lists], "vs": [[v for _, v in x] for x in lists], "olds": pa.nulls(len(lists), pa.list_(pa.bool_()))}, schema=pa.schema([("block", pa.int32()), ("take", pa.int32()), ("shard", pa.int32()), ("es", pa.list_(pa.int64())), ("vs", pa.list_(pa.float64())), ("olds", pa.list_(pa.bool_()))]))
    names = list("ijnabc") if form == "centred" else list("ijnabcde")

    def run():
        out = pa.Table.from_batches(list(blocks._Block([b], form, 3).batches(names))).to_pydict()
        return {k[:2]: k[2:] for k in zip(*out.values(), strict=True)}

    whole = run()
    monkeypatch.setattr(blocks, "PAIRS", 50)
    cut = run()
    assert set(cut) == set(whole) and all(np.allclose(cut[k], whole[k]) for k in whole)
    if form != "centred":
        assert cut == brute(rows, 3)


def test_lists_are_split_by_blocks_of_entities():
    es, vs = [[1, 2, 5, 9], [5, 9], [9, 9]], [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0], [7.0, 8.0]]
    b = pa.RecordBatch.from_pydict({"shard": pa.array([0, 1, 2], pa.int32()), "es": es, "vs": vs, "olds": pa.nulls(3, pa.list_(pa.bool_()))})
    out = pa.Table.from_batches(list(blocks._split([2, 6])([b]))).to_pydict()
    assert list(zip(out["block"], out["take"], out["shard"], out["es"], strict=True)) == [(0, 1, 0, [1, 2, 5, 9]), (1, 2, 0, [2, 5, 9]), (1, 1, 1, [5, 9]), (2, 2, 2, [9, 9])]
