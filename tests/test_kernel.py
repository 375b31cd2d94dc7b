"""Microcases, payload domains, partition invariance, refusals and fault injection."""

import math

import pytest
from pyspark.sql import functions as F

from affinis.functions.hashing import coefficients, primes_from
from affinis.operators import overlap, predict, ratings, subsets, validate
from affinis.plans.engine import similarity
from affinis.schemas import InputRefused, ValidationFailed

CASES = {
    "identical": ({1: 1, 2: 2, 3: 3}, {1: 1, 2: 2, 3: 3}, (3, 6, 6, 14, 14, 14), 1.0),
    "inverse": ({1: 1, 2: 2, 3: 3}, {1: 3, 2: 2, 3: 1}, (3, 6, 6, 14, 14, 10), -1.0),
    "one_overlap": ({1: 5, 2: 1}, {1: 4, 3: 2}, None, None),
    "no_overlap": ({1: 1, 2: 2}, {3: 5, 4: 4}, None, None),
    "two_overlap": ({1: 1, 2: 2}, {1: 2, 2: 4}, None, None),
    "zero_variance": ({1: 4, 2: 4, 3: 4}, {1: 1, 2: 3, 3: 5}, (3, 12, 9, 48, 35, 36), 0.0),
    "orthogonal": ({1: 1, 2: 2, 3: 3}, {1: 2, 2: 4, 3: 2}, (3, 6, 8, 14, 24, 16), 0.0),
    "fractional": ({1: 1, 2: 2, 3: 4}, {1: 1, 2: 3, 3: 3}, (3, 7, 7, 21, 19, 19), 0.7559289460184544),
    "intersection_only": ({1: 1, 2: 2, 3: 4, 4: 5}, {1: 1, 2: 3, 3: 3, 5: 2}, (3, 7, 7, 21, 19, 19), 0.7559289460184544),
}


def table(spark, rows):
    return spark.createDataFrame([(e, d, float(v)) for e, r in enumerate(rows) for d, v in r.items()], "e long, d long, v double")


def test_microcases_in_both_forms(spark):
    rows = [(2 * k + s, d + 10 * k, float(v)) for k, c in enumerate(CASES.values()) for s in (0, 1) for d, v in c[s].items()]
    r = spark.createDataFrame(rows, "e long, d long, v double")
    got = {x.i // 2: x for x in overlap.with_similarity(overlap.six_sums(r)).collect()}
    two = {x.i // 2: x.sim for x in overlap.two_pass(r).collect()}
    for k, (name, (_, _, sums, sim)) in enumerate(CASES.items()):
        if sums is None:
            assert k not in got, name
        else:
            g = got[k]
            assert (g.n, g.sx, g.sy, g.sxx, g.syy, g.sxy) == sums, name
            assert math.isclose(g.sim, sim, abs_tol=1e-12) and math.isclose(two[k], sim, abs_tol=1e-12), name
    emitted = {x.i // 2 for x in similarity(r).collect()}
    assert emitted == {k for k, c in enumerate(CASES.values()) if c[3] and c[3] > 0}


OK = [{0: 1, 1: 2, 2: 3, 3: 4}, {0: 2, 1: 3, 2: 4, 3: 5}, {0: 5, 1: 4, 2: 3, 3: 2}]
DOMAINS = {
    "ok": (OK, (True, True, True)),
    "fractional": ([{**OK[0], 2: 3.5}, *OK[1:]], (True, False, False)),
    "negative": ([OK[0], {**OK[1], 0: -2}, OK[2]], (True, False, False)),
    "packed_overflow": ([{d: 1000 for d in range(5)}, {0: 1000, 1: 1000, 2: 1000, 3: 1000, 4: 999}, {0: 999, 1: 1000, 2: 1000, 3: 1000, 4: 1000}], (True, True, False)),
    "i32_overflow": ([{d: 100000 for d in range(3)}, {0: 100000, 1: 100000, 2: 99999}, {0: 99999, 1: 100000, 2: 100000}], (True, False, False)),
}


@pytest.mark.parametrize("name", DOMAINS)
def test_payload_domains(spark, name):
    rows, accept = DOMAINS[name]
    r = table(spark, rows)
    plain = sorted(map(tuple, similarity(r, emit=False).collect()))
    for payload, ok in zip(("f64", "i32", "packed"), accept, strict=True):
        if ok:
            assert sorted(map(tuple, similarity(r, payload=payload, partition="dim", shards=2, emit=False).collect())) == plain
        else:
            with pytest.raises(InputRefused):
                similarity(r, payload=payload, partition="dim")


@pytest.mark.parametrize("rows,vmax,payload,ok", [(2097150, 1, "packed", True), (2097151, 1, "packed", True), (2097152, 1, "packed", False), (2097151, 0, "packed", True), (2097152, 0, "packed", False), (83886, 5, "packed", True), (83887, 5, "packed", False), (1363, 5, "packed", True), (2147483647, 1, "i32", True), (2147483648, 1, "i32", False), (2147483648, 0, "i32", False), (2147483648, 9e9, "f64", True)])
def test_capacity_boundaries(rows, vmax, payload, ok):
    assert ratings.accepts(rows, vmax, payload) is ok


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_nonfinite_ratings_are_refused(spark, bad):
    r = table(spark, [{**OK[0], 1: bad}, *OK[1:]])
    for payload in ("f64", "i32", "packed"):
        with pytest.raises(InputRefused):
            similarity(r, payload=payload, partition="dim")
    with pytest.raises(InputRefused):
        ratings.refuse_nonfinite(r)


@pytest.mark.parametrize("shards", [1, 2, 3, 7])
def test_dimension_shards_change_nothing(spark, shards):
    r = table(spark, OK)
    assert sorted(map(tuple, similarity(r, partition="dim", shards=shards, emit=False).collect())) == sorted(map(tuple, similarity(r, emit=False).collect()))


@pytest.mark.parametrize("options", [{"payload": "packed"}, {"payload": "i32", "partition": "pair"}, {"partition": "dim", "shards": 0}, {"payload": "f16"}, {"partition": "row"}, {"shards": 2}, {"fast": True}, {"candidates": "lsh", "payload": "i32"}, {"candidates": "some"}])
def test_options_that_do_not_apply_are_refused(spark, options):
    with pytest.raises(InputRefused):
        similarity(table(spark, OK), **options)


def test_last_row_wins_and_nulls_go(spark):
    raw = spark.createDataFrame([("a", "x", 1.0, 0), ("a", "x", 2.0, 1), ("b", "x", 3.0, 2), (None, "x", 4.0, 3), ("b", None, 4.0, 4), ("c", "x", None, 5)], "e string, d string, v double, line int")
    assert sorted(map(tuple, ratings.last_wins(raw, ["line"]).collect())) == [("a", "x", 2.0), ("b", "x", 3.0)]


def test_given_pairs_are_all_answered(spark):
    pairs = spark.createDataFrame([(0, 1), (0, 9), (2, 1)], "i long, j long")
    got = {(r.i, r.j): (r.n, r.sim) for r in overlap.given_pairs(pairs, table(spark, OK)).collect()}
    assert set(got) == {(0, 1), (0, 9), (2, 1)} and got[0, 9] == (0, 0.0) and got[0, 1][0] == 4


def test_dense_ids_are_exact_over_ranges(spark):
    v = spark.range(5000).select((F.col("id") * 7919 % 100003).alias("e"))
    got = [r.idx for r in ratings.dense_ids(v, "e").orderBy("e").collect()]
    assert got == list(range(5000))


SIMS = [(0, 1, 0.5), (0, 2, 0.25), (1, 2, -0.75)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, sim double")


@pytest.mark.parametrize(
    "change,reason",
    [
        (lambda s: s, None),
        (lambda s: [(i, j, v + 0.9e-12) for i, j, v in s], None),
        (lambda s: [(*s[0][:2], s[0][2] + 1.1e-12), *s[1:]], "tolerance"),
        (lambda s: [(i, j, float("nan")) for i, j, _ in s], "finiteness"),
        (lambda s: [(*s[0][:2], float("inf")), *s[1:]], "finiteness"),
        (lambda s: [(*s[0][:2], s[1][2]), (*s[1][:2], s[0][2]), s[2]], "tolerance"),
        (lambda s: s[:-1], "length"),
        (lambda s: [*s[:-1], (7, 8, s[-1][2])], "length"),
    ],
)
def test_fault_injection(spark, change, reason):
    v = validate.result_check(frame(spark, change(SIMS)), frame(spark, SIMS))
    assert v.first().reason == reason and v.first().passed is (reason is None)
    if reason:
        with pytest.raises(ValidationFailed):
            validate.require(v)


def test_membership_alone_can_fail(spark):
    v = validate.result_check(frame(spark, [(0, 1, 5e-13)]), frame(spark, [(0, 1, 0.0)])).first()
    assert v.reason == "membership" and v.tol_failures == 0


def test_user_prediction_denominators(spark):
    r = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0), (2, 3, 1.0)], "u long, i long, v double")
    m = frame(spark, [(1, 2, 0.5)])
    t = spark.createDataFrame([(1, 3)], "u long, i long")
    # the rater's average is 3, deviation -2
    assert predict.user_based(t, r, m).first().pred == pytest.approx(3 - 2 * 0.5 / 0.5)
    assert predict.user_based(t, r, m, denominator="avg").first().pred == pytest.approx(3 - 2 * 0.5 / 3)
    item = spark.createDataFrame([(1, 9)], "u long, i long")
    assert predict.item_based(item, r, m).first().pred == pytest.approx(3.0)
    assert predict.item_based(item, r, m, fallback="zero").first().pred == 0.0


def test_lane_cost_and_tiles(spark):
    order = spark.createDataFrame([(k, 0, 0, s) for k, s in enumerate([3, 5, 64, 1])], "slot long, i long, j long, short long")
    c = subsets.lane_cost(order, 16).first()
    assert (c.effective, c.slots) == (73, 32 * (1 + 4))
    with pytest.raises(InputRefused):
        subsets.lane_cost(order, 3)
    r = subsets.shard_ranges(spark, 10, 3)
    assert tuple(subsets.tiles(r, 10).first()) == (0, 10)
    assert subsets.tiles(r.where("g <> 1"), 10).first().gaps == 1


def test_hash_family():
    assert primes_from(2, 6) == (2, 3, 5, 7, 11, 13)
    assert len(coefficients(100)) == 100 and coefficients(1)[0] == (5003 + 9127, 2 + 1009 + 1)
