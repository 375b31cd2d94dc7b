"""Rating relations over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators.ratings import last_wins
from affinis.sources.shared import leaf_bytes, once

#: Bytes of input whose rows are joined in one turn.
TURN = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples(spark: SparkSession, sf_dir: str, entity: str, dim: str, turn: int = 0, turns: int = 1) -> DataFrame:
    """(e, d, v, ok, ln): order lines as ratings, with the key that decides between duplicates; those
    of one of several turns, by a hash of the order."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if turns > 1:
        line, orders = (t.where(F.pmod(F.xxhash64(k), F.lit(turns)) == turn) for t, k in ((line, "l_orderkey"), (orders, "o_orderkey")))
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col(entity).alias("e"), F.col(dim).alias("d"), F.col("l_quantity").alias("v"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"))


def joined(spark: SparkSession, sf_dir: str, entity: str, dim: str) -> DataFrame:
    """The triples of a large table, joined in turns and written for one reader: the shuffles of a turn
    go before the next one and before rows are dealt by dimension. Those of a small one as they are."""
    whole = triples(spark, sf_dir, entity, dim)
    turns = -(-sum(leaf_bytes(whole)) // TURN)
    kinds = {table(spark, sf_dir, t).schema[k].dataType for t, k in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))}
    if turns < 2 or len(kinds) > 1:  # keys of two types have no common hash
        return whole
    return reduce(DataFrame.union, [once(triples(spark, sf_dir, entity, dim, t, turns), "triples") for t in range(turns)])


def rated(spark: SparkSession, sf_dir: str, entity: str = "l_suppkey", dim: str = "o_custkey", apart: bool = False) -> DataFrame:
    """One row per (e, d). Rows are dealt by dimension once, which serves the aggregate over (e, d) and
    the lists of dimensions alike. apart: rows of large tables are joined in turns first, for sums over
    pairs that are the only reader."""
    rows = joined(spark, sf_dir, entity, dim) if apart else triples(spark, sf_dir, entity, dim)
    return last_wins(rows.repartition("d"), ["ok", "ln", "v"])


def suppliers(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    return rated(spark, sf_dir, "l_suppkey", "o_custkey", apart)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir, "l_partkey", "o_custkey")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other orientation: customers as entities over parts."""
    return rated(spark, sf_dir, "o_custkey", "l_partkey")


def as_users(ratings: DataFrame) -> DataFrame:
    """(u, i, v) of a relation whose entities are items."""
    return ratings.select(F.col("d").alias("u"), F.col("e").alias("i"), "v")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, kind, s, e): each event as an interval of k minutes (k from its JSON properties), in seconds."""
    ev = table(spark, sf_dir, "events")
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(F.col("user_id").alias("u"), F.col("event_type").alias("kind"), start.alias("s"), (start + k * 60 + 60).alias("e"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(config, block, segment, seconds): order lines as benchmark trials, one block per line number
    and day of month, which give several configurations a time in each block."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_returnflag").alias("config"), (F.dayofmonth("l_shipdate") * 10 + F.col("l_linenumber")).cast("long").alias("block"), F.col("l_linestatus").alias("segment")).agg(F.sum("l_quantity").alias("seconds"))
