"""Pipeline stages: null and repeated ids, odd tables, brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
ROWS = [(None, "only here"), (None, "a  b"), (1, "a b"), (2, "one text"), (2, "another text"), (3, "one  text"), (4, "same"), (4, "same"), (None, "no id"), (None, "no id"), (5, None), (6, "")]


def test_null_and_repeated_ids_stay(spark):
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted(((r.doc_id, r.text) for r in P.exact(spark, d, "").collect()), key=str)
    want = [(None, "a  b")] if (None, "a  b") in got else [(1, "a b")]
    assert got == sorted([*want, (None, "only here"), (None, "no id"), (2, "another text"), (3, "one  text"), (4, "same"), (5, None)], key=str)
    left = P.near(spark, d.where("doc_id IS NULL OR doc_id = 2"), "").collect()
    assert sum(r.doc_id is None for r in left) == 4 and sum(r.doc_id == 2 for r in left) == 2


WIDE = "doc_id long, text string, lang string, source string, n_chars int, ids string, kept boolean, Word int, _gone_ string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), "x", False, 1, "y") for i, t in [*ROWS, (7, "v w " * 20_000), (None, None), (8, "12 !!")]]
    return spark.createDataFrame(rows, WIDE)


def test_every_stage_takes_odd_tables(spark, odd):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns, no rows."""
    nothing = odd.select(*[F.when(F.col("doc_id") > 99, F.col(c)).alias(c) for c in odd.columns])
    for name, stage in P.STAGES:
        for d in (odd, nothing, odd.limit(0)):
            out = stage(spark, d, SF)
            last = name == "pieces"
            assert last or out.columns == P.COLUMNS
            rows = out.collect()
            if d is odd and last:
                assert sorted(r.text for r in rows) == sorted(r.text or "" for r in odd.collect())
                assert all(r.n_ids == len(r.ids) for r in rows)
            if d is odd and name == "language":
                assert {r.text for r in rows} == {t for _, t in ROWS if t} | {"v w " * 20_000}
                assert len(rows) == sum(bool(t) for _, t in ROWS) + 1


def test_exact_stage_equals_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    best = {}
    for r in d.collect():
        key = (r.text or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r"))
        if key not in best or (-len(r.text or ""), r.doc_id) < best[key]:
            best[key] = (-len(r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in P.exact(spark, d, SF).collect()) == sorted(i for _, i in best.values())


def test_copies_take_effect(spark, monkeypatch):
    monkeypatch.setattr(P.mixing, "mixed", lambda docs, model: docs.withColumn("copies", F.col("doc_id").cast("int") % 3))
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 30")
    got = [r.doc_id for r in P.to_weights(spark, d, SF).collect()]
    assert sorted(got) == sorted(i for i in range(30) for _ in range(i % 3) if i in {r.doc_id for r in d.collect()})
