"""Statistics of trials, and operations on intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _exclusive(q: float):
    """Quantile by the exclusive method: position q (n + 1) in the sorted list ``xs``, from 1."""
    pos = f"({q}D * (size(xs) + 1))"
    low = f"least(greatest(cast(floor({pos}) AS int), 1), size(xs) - 1)"
    return F.expr(f"get(xs, {low} - 1) + (get(xs, {low}) - get(xs, {low} - 1)) * ({pos} - {low})")


def trial_summary(trials: DataFrame, by: str = "config", value: str = "seconds") -> DataFrame:
    """(config, n_trials, median_s, min_s, max_s, stdev_s, p25_s, p75_s, iqr_s), rounded to 9 places.

    Quartiles (exclusive method) are null below 4 trials; a single trial has deviation 0. The trials
    of one configuration are a bounded list."""
    g = trials.groupBy(F.col(by).alias("config")).agg(F.count("*").alias("n_trials"), F.median(value).alias("median_s"), F.min(value).alias("min_s"), F.max(value).alias("max_s"), F.coalesce(F.when(F.count("*") > 1, F.stddev_samp(value)), F.lit(0.0)).alias("stdev_s"), F.array_sort(F.collect_list(value)).alias("xs"))
    enough = F.col("n_trials") >= 4
    g = g.withColumn("p25_s", F.when(enough, _exclusive(0.25))).withColumn("p75_s", F.when(enough, _exclusive(0.75)))
    r = lambda c: F.round(F.col(c), 9).alias(c)
    return g.select("config", "n_trials", r("median_s"), r("min_s"), r("max_s"), r("stdev_s"), r("p25_s"), r("p75_s"), F.round(F.col("p75_s") - F.col("p25_s"), 9).alias("iqr_s"))


def log_ratios(trials: DataFrame, x: str, y: str) -> DataFrame:
    """(block, segment, r): log of the ratio of two configurations in the blocks that ran both."""
    one = lambda c, n: trials.where(F.col("config") == c).select("block", "segment", F.col("seconds").alias(n))
    return one(x, "tx").join(one(y, "ty"), ["block", "segment"]).select("block", "segment", F.ln(F.col("tx") / F.col("ty")).alias("r"))


def paired_ratio(trials: DataFrame, x: str, y: str) -> DataFrame:
    """One row: geometric mean of paired ratios with a 1.96 standard error interval."""
    s = log_ratios(trials, x, y).agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    se = F.col("sd") / F.sqrt("n") * 1.96
    return s.select("n", F.round(F.exp("m"), 9).alias("ratio"), F.round(F.exp(F.col("m") - se), 9).alias("low"), F.round(F.exp(F.col("m") + se), 9).alias("high"))


def bootstrap(trials: DataFrame, x: str, y: str, draws: int = 5000, seed: int = 20260917) -> DataFrame:
    """One row: 2.5 and 97.5 % bounds of the geometric mean over block resamples within segments.

    Each draw picks as many blocks of a segment as it has; picks come from md5 of (seed, draw, segment,
    place), so runs and engines agree. draws x blocks rows are formed and aggregated side by side."""
    r = log_ratios(trials, x, y)
    w = Window.partitionBy("segment").orderBy("block")
    blocks = r.withColumn("at", F.row_number().over(w) - 1)
    sizes = r.groupBy("segment").agg(F.count("*").alias("size"))
    places = blocks.select("segment", "at").join(sizes, "segment").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    name = F.concat_ws("|", F.lit(str(seed)), "draw", "segment", "at")
    picks = places.select("segment", "draw", F.pmod(F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long"), F.col("size")).cast("int").alias("at"))
    means = picks.join(blocks.select("segment", "at", "r"), ["segment", "at"]).groupBy("draw").agg(F.avg("r").alias("m"))
    lo, hi = F.percentile("m", 0.025), F.percentile("m", 0.975)
    return means.agg(F.count("*").alias("draws"), F.round(F.exp(lo), 9).alias("low"), F.round(F.exp(hi), 9).alias("high"))


def interval_union(intervals: DataFrame, by: list[str]) -> DataFrame:
    """(by, s, e): overlapping or touching intervals of each group as one."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def interval_intersection(a: DataFrame, b: DataFrame, by: list[str], bucket: int) -> DataFrame:
    """(by, s, e): parts that intervals of ``a`` and ``b`` share, as a range join over buckets of
    width ``bucket``. A pair is formed in the bucket where its common part begins, so it is found once."""
    spread = lambda d, s, e: d.select(*by, F.col("s").alias(s), F.col("e").alias(e), F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor((F.col("e") - 1) / bucket))).alias("cell")).where(F.col(s) < F.col(e))
    x, y = spread(a.where("s < e"), "sa", "ea"), spread(b.where("s < e"), "sb", "eb")
    both = x.join(y, [*by, "cell"]).where("sa < eb AND sb < ea").withColumns({"s": F.greatest("sa", "sb"), "e": F.least("ea", "eb")})
    return both.where(F.floor(F.col("s") / bucket) == F.col("cell")).select(*by, "s", "e")


def overlap_report(a: DataFrame, b: DataFrame, by: list[str], bucket: int) -> DataFrame:
    """(by, a_total, b_total, overlapped): lengths of two families of intervals and of what they share."""
    ua, ub = interval_union(a, by), interval_union(b, by)
    total = lambda d, n: d.groupBy(*by).agg(F.sum(F.col("e") - F.col("s")).alias(n))
    both = total(ua, "a_total").join(total(ub, "b_total"), by)
    return both.join(total(interval_intersection(ua, ub, by, bucket), "overlapped"), by, "left").select(*by, "a_total", "b_total", F.coalesce("overlapped", F.lit(0)).cast("long").alias("overlapped"))
