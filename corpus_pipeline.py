"""A training corpus from raw documents, in five stages.

Every stage is a function of (spark, docs, sf_dir) and works on all rows that its predecessor kept.
``run`` writes each stage's rows to the shared folder and reads them back as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import exact_dedup, language, minhash, mixing, pieces
from affinis.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by the mixture model; those without letters go, among them
    null and empty texts. Repeated rows and rows without an id stay."""
    model = language.train(docs)
    return language.identify(docs.select(*COLUMNS), model).where("lang_pred <> 'und'").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts, the one that exact_dedup keeps. A null id stays where no
    row of the class has an id; rows that share an id stay each if their texts differ. Null and empty
    texts are one class."""
    return exact_dedup.without_copies(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id. Rows with a null id
    all stay, as do null and empty texts; so do all rows of an id that is kept."""
    return minhash.without_near_copies(docs.select(*COLUMNS))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their fitted rates: as many rows of each as its copies, so that the totals of
    the domains meet their targets also where a rate is above 1. The choice hangs on the id alone, so
    repeated rows share it; null and empty texts, which have no tokens, are drawn like any others."""
    model = mixing.train(docs, table(spark, sf_dir, "labels"))
    drawn = mixing.mixed(docs.select(*COLUMNS), model).where("copies >= 1")
    return drawn.withColumn("_copy_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the text that they decode to in place of the original one. Null and
    empty texts have no ids and an empty text; repeated rows and null ids stay."""
    model = pieces.model_of(spark)
    encoded = pieces.encode(docs, model, keep=["doc_id", "lang", "source", "n_chars"], both=False, back=True)
    return encoded.drop("other_ids", "n_other").withColumnRenamed("decoded", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", to_weights),
    ("pieces", to_pieces),
]

#: Learned models decide the first and fourth stage, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
