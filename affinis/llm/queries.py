"""The registered queries of the operators, each over its whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import exact_dedup, jpeg, language, minhash, mixing, pieces, pii, repeats, sharding, toxicity
from affinis.llm.common import held_out, table


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.model_of(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, model, keep=["doc_id"], back=True)
    return encoded.select("doc_id", "n_ids", "n_other", F.xxhash64("other_ids").alias("other_hash"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "hits")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs, table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, model, mixing.TARGETS, keep=["doc_id"])


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    return language.identify(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "proportions")


QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_media": op6_media,
    "op7_repeats": op7_repeats,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_minhash": op9_minhash,
    "op10_language": op10_language,
}

ORACLES = {
    "op7_repeats": repeats.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_minhash": minhash.ORACLE,
}
