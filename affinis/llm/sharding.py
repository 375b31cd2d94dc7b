"""Balanced shards by sampled splitters.

1. Every record gets a key: a hash of its text, then its id, as fixed-width hex. Equal texts are
   neighbours in key order, and a hot group of equal texts can still be split by id.
2. A sample of keys is drawn with a chance in proportion to the record's size, so its quantiles
   are quantiles of bytes. Its size is bounded by ``sample`` whatever the input.
3. Every ``sample / ranges``-th key becomes a splitter, and no range has more than about
   ``rows_each`` rows. Records are dealt to the ranges between the splitters; ranges that hold
   more than twice their share of bytes or of rows draw further keys and are cut again, until none is
   overfull, unless all its rows have one key (rows that are equal in text and id).
4. Inside a range records are ranked by key. With the ranges' totals (one short row per range) this
   gives each record its exact place in the global order by bytes, and the shard follows from it.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import written

HASH_CHARS = 16
LEAST_EACH = 1000  # rows that are worth a range


def _key(text: Column, doc_id: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(text)), HASH_CHARS, "0"), F.lpad(F.hex(F.coalesce(doc_id, F.lit(-1)).cast("bigint")), 16, "0")))


def _range_of(splitters: list[str]) -> Column:
    """Index of the range of ``key``: binary search by a fold over step widths."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    steps, width = [], 1
    while width <= n:
        steps.insert(0, width)
        width *= 2
    array = ", ".join(f"'{s}'" for s in splitters)
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (at, w) -> CASE WHEN at + w <= {n} AND key >= get(array({array}), at + w - 1) THEN at + w ELSE at END)")


def _drawn(light: DataFrame, total: int, sample: int, salt: int) -> list[str]:
    """Keys drawn with chance min(1, size * sample / total); about ``sample`` of them at most."""
    chance = F.col("size") * F.lit(sample / max(total, 1))
    unit = F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sorted(r.key for r in light.where(unit < chance).select("key").collect())


def _cuts(keys: list[str], every: int) -> list[str]:
    """Every ``every``-th key. A splitter falls back to the start of its text's group, so that no
    small group is cut; where that start is taken already, the group is hot and is cut by id."""
    out: list[str] = []
    for k in keys[every // 2 :: every]:
        start = k[:HASH_CHARS]
        cut = start if not out or out[-1] < start else k
        if not out or cut > out[-1]:
            out.append(cut)
    return out


def sharded(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id", ranges: int = 256, sample: int = 4096, rows_each: int = 1_000_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Law: ``bytes``. Sizes of shards differ from the mean by less than the larger of the longest
    record and 2 % of a shard. Rows of equal text stay in one shard if together they are no larger
    than that; a larger group is cut by id. Null texts count as empty, with size 1. Repeated rows
    are dealt like any others, a null id ranks as -1. Slots count from 0 in each shard. Extra columns
    are ignored; an empty table gives an empty table. Small tables have fewer ranges than ``ranges``,
    and those of more than ``ranges * rows_each`` rows have more; ``sample`` keys go with ``ranges``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    light = written(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), _key(body, F.col(doc_id)).alias("key")), "light")
    total, rows, longest = light.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    each = max(1, sample // ranges)
    ranges = max(1, min(ranges, rows // LEAST_EACH), -(-rows // rows_each))
    sample = each * ranges
    cuts = _cuts(_drawn(light, total, sample, 0), max(1, sample // ranges))
    turn = 0
    while True:
        turn += 1
        dealt = light.withColumn("range", _range_of(cuts))
        load = {r["range"]: (r.b, r.n) for r in dealt.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").collect()}
        over = [i for i, (b, n) in load.items() if (b > 2 * total / ranges and b > 2 * longest) or n > 2 * rows / ranges + 1]
        if not over:
            break
        part = dealt.where(F.col("range").isin(over))
        held = sum(max(load[i][0] / max(total, 1), load[i][1] / max(rows, 1)) for i in over)
        more = _drawn(part.withColumn("size", F.greatest("size", F.lit(total / max(rows, 1)))), max(1, int(held * total)), max(64, int(8 * ranges * held)), turn)
        # where too few keys were drawn, the greatest key of a range cuts it too
        tops = [] if turn % 4 else [r.hi for r in part.groupBy("range").agg(F.max("key").alias("hi")).collect()]
        cuts = sorted(set(cuts) | set(_cuts(more, 4)) | set(tops))
    dealt = light.withColumn("range", _range_of(cuts)).withColumn("group", F.substring("key", 1, HASH_CHARS))
    totals = sorted((r["range"], r.b, r.n) for r in dealt.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())
    spot, at_b, at_n = {}, 0, 0
    for i, b, n in totals:
        spot[i] = (at_b, at_n)
        at_b, at_n = at_b + b, at_n + n
    size = len(cuts) + 1
    before = [spot.get(i, (0, 0)) for i in range(size)]
    literal = lambda k: F.expr(f"get(array({', '.join(f'{x[k]}L' for x in before)}), range)")
    in_range = Window.partitionBy("range").orderBy("key")
    upto = in_range.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "group")
    ranked = (
        dealt.withColumn("rank", F.row_number().over(in_range) - 1 + literal(1))
        .withColumn("from", F.coalesce(F.sum("size").over(upto), F.lit(0)) + literal(0))
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_from", F.min("from").over(group))
    )
    whole = max(longest, int(0.02 * total / shards))
    middle = F.when(F.col("group_bytes") <= whole, F.col("group_from") * 2 + F.col("group_bytes")).otherwise(F.col("from") * 2 + F.col("size"))
    placed = written(ranked.select("doc_id", "size", "text_crc32", "rank", F.least(F.floor(middle * shards / F.lit(2.0 * max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard")), "placed")
    first = {r.shard: r.at for r in placed.groupBy("shard").agg(F.min("rank").alias("at")).collect()}
    starts = F.expr(f"get(array({', '.join(f'{first.get(i, 0)}L' for i in range(shards))}), shard)")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - starts).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
