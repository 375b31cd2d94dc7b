"""Exact deduplication in three combining stages, on built-in expressions only.

A first pass counts digests (no texts), by salt and then in all. A digest that occurs once has nothing
to be compared with, so its row is a class of its own. Rows of the other digests go through three
stages, with the whole text as a grouping key in each; the digest only decides where a row goes.

Stage 1 is the map-side half of the first aggregate: every task keeps one row of each text it has
read. Stage 2 merges those rows by (digest, salt, text), so a text that fills a third of the table
is spread over ``salts`` tasks. Stage 3 combines the at most ``salts`` winners of each text. The
verdict goes back to the rows by (digest, salt, text) too.

Which digests occur twice is told by a table of bits, of at most 2**FILTER_BITS / 64 words whatever
the input, which is broadcast. A bit that is set by another digest only sends a row through the stages
that could have done without; so on inputs with very many repeated digests more rows pass them, and
the result stays the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import FILTER_BITS, SPACES, fewer_files, key_filter, marked, small_batches, written

#: Lengths and ids are packed into one decimal (length first, then the smaller id), because the
#: hash aggregate holds decimals in place while structs would force a sort on whole texts.
SPAN = 10**20
TOP = 2**63


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _rank(doc_id: Column, text: Column) -> Column:
    """length * SPAN + (TOP - id), which is 1 to 2**64 for a bigint; 0 stands for a null id."""
    length = F.length(F.coalesce(text, F.lit(""))).cast("decimal(38,0)")
    low = F.coalesce(F.expr(f"{TOP}BD") - doc_id.cast("decimal(19,0)"), F.expr("0BD"))
    return (length * F.expr(f"{SPAN}BD") + low).cast("decimal(38,0)")


def _salt(doc_id: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("salt")), F.lit(salts)).cast("int")


def exact_groups(rows: DataFrame, salts: int) -> DataFrame:
    """Of rows (digest, salt, norm, rank): one row per (text class, salt that occurs in it) with
    digest, norm, salt, best (the greatest rank), group_size."""
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("rank").alias("best"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("seen"))
    return whole.select("digest", "norm", "best", "group_size", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (shiftright(seen, s) & 1L) = 1L)")).alias("salt"))


def _id_of(rank: Column) -> Column:
    low = rank % F.expr(f"{SPAN}BD")
    return F.when(low > 0, F.expr(f"{TOP}BD") - low).cast("bigint")


def repeated_digests(light: DataFrame) -> DataFrame:
    """Digests that occur twice, of (digest, salt)."""
    return light.groupBy("digest", "salt").agg(F.count("*").alias("n")).groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")


def _parts(docs: DataFrame, text: str, doc_id: str, salts: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, digest) of all rows; the filter of repeated digests; and all columns of the rows that
    it lets through, with _digest_, salt, norm, rank."""
    if not 1 <= salts <= 62:  # a salt is a bit of a bigint
        raise ValueError("salts must be between 1 and 62")
    small_batches(docs.sparkSession)
    salt = _salt(F.col(doc_id), salts)
    light = written(docs.select(F.col(doc_id).alias("doc_id"), digest_of(F.col(text)).alias("digest"), salt.alias("salt")), "digests")
    words = key_filter(repeated_digests(light), F.col("digest"), bits)
    rows = marked(docs.withColumn("_digest_", digest_of(F.col(text))), F.col("_digest_"), words, "_twice_", bits)
    return light, words, rows


def _several(rows: DataFrame, text: str, doc_id: str, salts: int, *kept: Column) -> DataFrame:
    return rows.where("_twice_").select(F.col("_digest_").alias("digest"), _salt(F.col(doc_id), salts).alias("salt"), normalised(F.col(text)).alias("norm"), _rank(F.col(doc_id), F.col(text)).alias("rank"), *kept)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 16, bits: int = FILTER_BITS) -> DataFrame:
    """All columns of ``docs`` are left behind but the id: doc_id, keep_id, group_size, kept,
    text_sha256, one row per row of ``docs``.

    Null and empty texts (and texts of white space only) form one class. Of equal texts the row with
    the most code points in the original text stays, then the smallest id; a null id comes last.
    Repeated rows of one id all count in group_size and carry the same verdict. Extra columns, of any
    name, are ignored. An empty table gives an empty table.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    light, words, rows = _parts(source, "text", "doc_id", salts, bits)
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    single = marked(light, F.col("digest"), words, "twice", bits).where("NOT twice").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), sha)
    several = _several(rows, "text", "doc_id", salts, F.col("doc_id"))
    groups = exact_groups(several.drop("doc_id"), salts).withColumn("keep_id", _id_of(F.col("best")))
    judged = several.drop("rank").join(groups, ["digest", "salt", "norm"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha)
    return single.unionByName(fewer_files(judged))


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 16, bits: int = FILTER_BITS) -> DataFrame:
    """All columns of one row of each class of equal texts: the row that ``exact_dedup`` keeps. Of rows
    that share that id too, the one with the greatest text stays. Rows whose text occurs once are
    passed on where they are."""
    _, _, rows = _parts(docs, text, doc_id, salts, bits)
    names = [F.col(f"`{c}`") for c in docs.columns]
    several = _several(rows, text, doc_id, salts, F.struct(*names).alias("row"))
    groups = exact_groups(several.drop("row"), salts)
    best = several.join(groups, ["digest", "salt", "norm"]).where("rank = best")
    one = best.groupBy("digest", "norm").agg(F.max_by("row", F.coalesce(F.col(f"row.`{text}`"), F.lit(""))).alias("row")).select("row.*")
    return rows.where("NOT _twice_").select(*names).unionByName(one)


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
     g AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
