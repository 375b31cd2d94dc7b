"""Ingest of rating triples (e, d, v): orientation, deduplication, support, ids, subsets, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.pearson import finite
from affinis.schemas import InputRefused
from affinis.sources.shared import written


def oriented(triples: DataFrame, mode: str, user: str = "user_id", item: str = "business_id", value: str = "stars", order: list[str] | None = None) -> DataFrame:
    """(e, d, v, *order): items as entities over users (mode item), or the reverse (mode user)."""
    if mode not in ("item", "user"):
        raise InputRefused(f"mode must be item or user, not {mode!r}")
    e, d = (item, user) if mode == "item" else (user, item)
    return triples.select(F.col(e).alias("e"), F.col(d).alias("d"), F.col(value).alias("v"), *(order or []))


def last_wins(triples: DataFrame, order: list[str]) -> DataFrame:
    """One row per (e, d): the one with the greatest order key. Nulls in e, d or v are left out.

    Keys must tell apart rows of different values; end them with the value itself if in doubt."""
    rows = triples.where("e IS NOT NULL AND d IS NOT NULL AND v IS NOT NULL")
    return rows.groupBy("e", "d").agg(F.max_by("v", F.struct(*order)).alias("v"))


def support(ratings: DataFrame, least: int = 3) -> DataFrame:
    """(e, n) of entities with at least ``least`` rows."""
    return ratings.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def supported(ratings: DataFrame, least: int = 3) -> DataFrame:
    """Rows of entities with at least ``least`` rows; the others can reach no overlap of that size."""
    return ratings.join(support(ratings, least).select("e"), "e", "left_semi")


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """(column, idx): distinct values numbered from 0 in ascending order.

    Distinct values are dealt to ranges once; ranges are numbered side by side, each from where the
    ranges before it end. The table of ranges has one short row for each, which bounds what is
    broadcast."""
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    parted = written(distinct.repartitionByRange(column).withColumn("_p", F.spark_partition_id()), "distinct")
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_at", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_at")
    w = Window.partitionBy("_p").orderBy(column)
    return parted.withColumn("idx", F.row_number().over(w) - 1).join(F.broadcast(before), "_p").select(column, (F.col("idx") + F.col("_at")).cast("long").alias("idx"))


def mod_subset(ratings: DataFrame, mod: int, rem: int) -> DataFrame:
    """Rows of the entities whose index in sorted order leaves ``rem`` modulo ``mod``."""
    ids = dense_ids(ratings, "e").where(F.pmod(F.col("idx"), F.lit(mod)) == rem)
    return ratings.join(ids.select("e"), "e", "left_semi")


def most_active(ratings: DataFrame, k: int) -> DataFrame:
    """(e, n) of the k entities with most rows; ties by entity ascending. A top-k report."""
    return ratings.groupBy("e").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("e")).limit(k)


def rows_of(ratings: DataFrame, entities: DataFrame) -> DataFrame:
    return ratings.join(entities.select("e"), "e", "left_semi")


def row_lengths(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("e").agg(F.count("*").alias("len"))


def restricted_lengths(ratings: DataFrame, low: Column | int, high: Column | int) -> DataFrame:
    """(e, len): rows of each entity with a dimension in [low, high); 0 where there is none."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return ratings.groupBy("e").agg(F.count_if((F.col("d") >= lit(low)) & (F.col("d") < lit(high))).alias("len"))


def refuse_nonfinite(ratings: DataFrame) -> DataFrame:
    """``ratings`` itself, or InputRefused naming one offending row."""
    bad = ratings.where(~finite(F.col("v"))).limit(1).collect()
    if bad:
        raise InputRefused(f"rating of {bad[0]['e']!r}, {bad[0]['d']!r} is not finite")
    return ratings


# --- payload domain -----------------------------------------------------------------------------

# fixed values: largest integer a field of each payload holds; f64 has no bound
LIMITS = {"f64": None, "i32": 2**31 - 1, "packed": 2**21 - 1}


def accepts(max_row: int, vmax: float, payload: str) -> bool:
    """Whether sums over ``max_row`` values up to ``vmax`` fit the payload's fields."""
    limit = LIMITS[payload]
    return limit is None or (max_row <= limit and vmax * max_row <= limit and vmax * vmax * max_row <= limit)


def domain(ratings: DataFrame) -> DataFrame:
    """One row: max_row, vmax, integral (all values nonnegative integers), finite."""
    v = F.col("v")
    # two levels, so that both scalars come from one pass and one small shuffle
    per = ratings.groupBy("e").agg(F.count("*").alias("len"), F.max("v").alias("v"), F.min((finite(v) & (v >= 0) & (v == F.floor(v))).cast("int")).alias("i"), F.min(finite(v).cast("int")).alias("f"))
    return per.agg(F.coalesce(F.max("len"), F.lit(0)).alias("max_row"), F.coalesce(F.max("v"), F.lit(0.0)).alias("vmax"), (F.coalesce(F.min("i"), F.lit(1)) == 1).alias("integral"), (F.coalesce(F.min("f"), F.lit(1)) == 1).alias("finite"))


def gate(ratings: DataFrame, payload: str) -> None:
    """InputRefused unless ``ratings`` lie in the domain of ``payload``."""
    if payload not in LIMITS:
        raise InputRefused(f"payload must be one of {sorted(LIMITS)}, not {payload!r}")
    r = domain(ratings).first()
    if not r.finite:
        raise InputRefused("ratings hold values that are not finite")
    if payload != "f64" and not r.integral:
        raise InputRefused(f"payload {payload} needs nonnegative integers")
    if not accepts(r.max_row, r.vmax, payload):
        raise InputRefused(f"rows of {r.max_row} values up to {r.vmax:g} exceed payload {payload}")
