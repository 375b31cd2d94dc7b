"""Pairs of entities over shared dimensions, and their six additive sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.pearson import emitted, finalise, packed_words, unpacked
from affinis.operators import blocks
from affinis.schemas import POLICY, SIX, Policy


def shared(ratings: DataFrame) -> DataFrame:
    """(i, j, d, x, y) with i < j: an inverted-index self-join, never a product of entities."""
    a = ratings.select(F.col("e").alias("i"), "d", F.col("v").alias("x"))
    b = ratings.select(F.col("e").alias("j"), F.col("d").alias("d2"), F.col("v").alias("y"))
    return a.join(b, (F.col("d") == F.col("d2")) & (F.col("i") < F.col("j"))).select("i", "j", "d", "x", "y")


def _sums() -> list:
    x, y = F.col("x"), F.col("y")
    return [F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")]


def overlap_counts(ratings: DataFrame, least: int = POLICY.min_overlap) -> DataFrame:
    return shared(ratings).groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def six_sums(ratings: DataFrame, least: int = POLICY.min_overlap) -> DataFrame:
    """(i, j, six sums) of pairs with enough overlap, formed block by block; values whose sums are no
    doubles go by the join."""
    if blocks.takes(ratings):
        return blocks.pair_sums(ratings, least)
    return shared(ratings).groupBy("i", "j").agg(*_sums()).where(F.col("n") >= least)


def _words() -> list:
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    w0, w1 = packed_words(F.lit(1), x, y, x * x, y * y, x * y)
    return [F.sum(w0).alias("w0"), F.sum(w1).alias("w1")]


def _unpacked(sums: DataFrame) -> DataFrame:
    return sums.select("i", "j", *[c.alias(n) for c, n in zip(unpacked(F.col("w0"), F.col("w1")), SIX, strict=True)])


def _narrow(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int")})


def _as_doubles(sums: DataFrame, least: int) -> DataFrame:
    return sums.where(F.col("n") >= least).select("i", "j", "n", *[F.col(c).cast("double").alias(c) for c in SIX[1:]])


def sharded_sums(ratings: DataFrame, shards: int, least: int = POLICY.min_overlap, payload: str = "f64") -> DataFrame:
    """Partial sums for each shard of the dimensions, then their sum. Equal to the unsharded sums,
    since partial sums are a commutative monoid in every payload: packed words are added as they are,
    as pack(a) + pack(b) = pack(a + b), and are unpacked once at the end. Callers must have passed
    the gate of the payload. Both sums are formed where the pairs are."""
    if blocks.takes(ratings):
        return blocks.pair_sums(ratings, least, payload, shards)
    shard = F.pmod(F.xxhash64("d"), F.lit(shards)).alias("shard")
    if payload == "packed":
        part = shared(ratings).groupBy("i", "j", shard).agg(*_words())
        return _as_doubles(_unpacked(part.groupBy("i", "j").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))), least)
    pairs = shared(ratings)
    part = (_narrow(pairs) if payload == "i32" else pairs).groupBy("i", "j", shard).agg(*_sums())
    whole = part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SIX])
    return _as_doubles(whole, least) if payload == "i32" else whole.where(F.col("n") >= least)


def packed_sums(ratings: DataFrame, least: int = POLICY.min_overlap) -> DataFrame:
    """Six sums as two bigint sums; callers must have passed the packed gate."""
    return _as_doubles(_unpacked(shared(ratings).groupBy("i", "j").agg(*_words())), least)


def narrow_sums(ratings: DataFrame, least: int = POLICY.min_overlap) -> DataFrame:
    """Six sums over 32-bit integers; callers must have passed the i32 gate."""
    return _as_doubles(_narrow(shared(ratings)).groupBy("i", "j").agg(*_sums()), least)


def with_similarity(sums: DataFrame) -> DataFrame:
    return sums.withColumn("sim", finalise(*[F.col(c) for c in SIX]))


def model(sums: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """(i, j, n, sim) of emitted pairs."""
    return with_similarity(sums).where(emitted(F.col("sim"), policy.eps)).select("i", "j", "n", "sim")


def sums_of(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Six sums of the given distinct pairs (i, j) that share a dimension; only their rows meet."""
    x = ratings.select(F.col("e").alias("i"), "d", F.col("v").alias("x"))
    y = ratings.select(F.col("e").alias("j"), "d", F.col("v").alias("y"))
    return pairs.select("i", "j").join(x, "i").join(y, ["j", "d"]).groupBy("i", "j").agg(*_sums())


def given_pairs(pairs: DataFrame, ratings: DataFrame, many: bool = False) -> DataFrame:
    """(i, j, n, sim) of exactly the given pairs: none is added or left out, no overlap gives 0.

    many: the pairs, i < j, are about all that share a dimension, so the sums of all are formed and
    looked up, where the rows of each pair would come to more."""
    asked = pairs.select("i", "j").distinct()
    sums = with_similarity(six_sums(ratings, 1) if many else sums_of(asked, ratings))  # before the join, as one value is less than six sums
    return asked.join(sums.select("i", "j", "n", "sim"), ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sim", F.lit(0.0)).alias("sim"))


def two_pass(ratings: DataFrame, least: int = POLICY.min_overlap) -> DataFrame:
    """(i, j, n, sim) by means first and centred sums then; a cross-check of the one-pass form."""
    sums = blocks.pair_sums(ratings, least, "centred")
    return sums.select("i", "j", "n", F.when((F.col("c") == 0) | (F.col("a") <= 0) | (F.col("b") <= 0), F.lit(0.0)).otherwise(F.col("c") / (F.sqrt("a") * F.sqrt("b"))).alias("sim"))
