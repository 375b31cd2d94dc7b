"""Queries over files: tables are written in each format to the shared folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import content, overlap, predict
from affinis.plans import recommender
from affinis.plans import relations as rel
from affinis.sources import files, trace
from affinis.sources.shared import fresh, freed, kept, removed

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _named(spark: SparkSession, sf_dir: str, kind: str = "item") -> DataFrame:
    """(user_id, business_id, stars): ratings under names, one row per pair."""
    r = rel.suppliers(spark, sf_dir) if kind == "item" else rel.customers(spark, sf_dir).select(F.col("d").alias("e"), F.col("e").alias("d"), "v")
    return r.select(F.concat(F.lit("u"), "d").alias("user_id"), F.concat(F.lit("b"), "e").alias("business_id"), F.col("v").alias("stars"))


def _reviews(spark, sf_dir, kind="item", compression=None) -> str:
    path = fresh(spark, "reviews")
    files.write_jsonl(_named(spark, sf_dir, kind), path, compression=compression)
    freed(spark)
    return path


@query
def source_reviews(spark, sf_dir):
    return files.reviews(spark, _reviews(spark, sf_dir)).select("user_id", "business_id", "stars")


@query
def source_test_pairs(spark, sf_dir):
    return files.test_pairs(spark, _reviews(spark, sf_dir)).select("user_id", "business_id")


@query
def source_numbered_lines(spark, sf_dir):
    """The numbers of lines cover 0 to n - 1 once, whatever the split of the file."""
    lines = files.numbered_lines(spark, _reviews(spark, sf_dir))
    return lines.agg(F.count("*").alias("n"), F.min("line").alias("first"), F.max("line").alias("last"), F.sum("line").alias("total"), F.count_distinct("line").alias("numbers"))


@query
def source_numbered_reviews(spark, sf_dir):
    """Reviews in the order of one sorted file; the last of a business is the one on its last line."""
    path = fresh(spark, "sorted")
    files.write_jsonl(_named(spark, sf_dir).orderBy("business_id", "user_id"), path, single=True)
    r = files.numbered_reviews(spark, path)
    return r.groupBy("business_id").agg(F.max_by("user_id", "line").alias("user_id"), F.min_by("user_id", "line").alias("first_user"))


def _item_model(spark, sf_dir):
    return overlap.model(overlap.six_sums(rel.suppliers(spark, sf_dir, apart=True)))


@query
def source_model(spark, sf_dir):
    """A model file with its pairs the wrong way round, read as canonical pairs."""
    path = fresh(spark, "model")
    m = _item_model(spark, sf_dir)
    files.write_jsonl(m.select(F.concat(F.lit("b"), "j").alias("b1"), F.concat(F.lit("b"), "i").alias("b2"), "sim"), path, compression="gzip")
    freed(spark)
    return files.model(spark, path)


@query
def source_averages(spark, sf_dir):
    """Averages as one object, found beside the training file."""
    folder = fresh(spark, "train")
    at = files.averages_beside(f"{folder}/train.json", "averages.json")
    files.write_averages(predict.averages(rel.suppliers(spark, sf_dir), "e"), at)
    return files.averages(spark, at).withColumn("avg", F.round("avg", 9))


@query
def source_stop_words(spark, sf_dir):
    """Tokens that are left after the anti-join with a stop list: the words of all pages of benchmark."""
    path = fresh(spark, "stop")
    words = content.tokens(rel.table(spark, sf_dir, "benchmark"), "item_id").select("word").distinct()
    words.write.text(path)
    docs = rel.table(spark, sf_dir, "documents")
    return content.term_counts(content.tokens(docs, "source", stop=files.stop_words(spark, path)))


@query
def source_sections(spark, sf_dir):
    """Profiles written as one sectioned file and read back by section."""
    top = content.top_words(content.tfidf(rel.table(spark, sf_dir, "documents").select("text", "source"), "source", rare_share=1e-5), 20)
    items = content.profiles(top)
    path = fresh(spark, "sections")
    marks = ["business profiles:", "user profiles:"]
    files.write_sections({marks[0]: items.select(F.col("doc").alias("b"), "words"), marks[1]: items.select(F.col("doc").alias("u"), F.slice("words", 1, 1).alias("words"))}, path)
    got = files.sections(spark, path, marks)
    one = lambda m, k: files.profiles_of(got[m], k, "words").select(F.lit(k).alias("section"), F.col("id"), F.posexplode("words").alias("at", "word"))
    return one(marks[0], "b").union(one(marks[1], "u"))


@query
def sink_model_by_name(spark, sf_dir):
    """Similarities by index, named and written as a model file, read back."""
    r = kept(rel.suppliers(spark, sf_dir), "ratings")
    sims = overlap.with_similarity(overlap.six_sums(r))
    names = r.select("e").distinct().select("e", F.concat(F.lit("b"), "e").alias("id"))
    path = fresh(spark, "named")
    files.write_jsonl(files.sims_to_model(sims, names).select(F.col("a").alias("b1"), F.col("b").alias("b2"), "sim"), path)
    return files.model(spark, path)


@query
def sink_results(spark, sf_dir):
    """All similarities as one column in the order of pairs, read back by their place."""
    sims = overlap.with_similarity(overlap.six_sums(rel.suppliers(spark, sf_dir)))
    path = fresh(spark, "results")
    files.write_results(sims, path)
    return files.results(spark, path)


@query
def source_trace(spark, sf_dir):
    """Kernel intervals of a SQLite trace. Traces are local files that the driver reads."""
    import os
    import sqlite3
    import tempfile

    rows = rel.table(spark, sf_dir, "events").where("event_id < 1000").select("event_id", "user_id").orderBy("event_id").collect()
    with tempfile.TemporaryDirectory() as d:
        at = os.path.join(d, "t.sqlite")
        with sqlite3.connect(at) as con:
            con.execute("CREATE TABLE StringIds (id INTEGER, value TEXT)")
            con.execute("CREATE TABLE CUPTI_ACTIVITY_KIND_KERNEL (deviceId INTEGER, shortName INTEGER, start INTEGER, end INTEGER)")
            con.executemany("INSERT INTO StringIds VALUES (?, ?)", [(0, "stats"), (1, "reduce")])
            con.executemany("INSERT INTO CUPTI_ACTIVITY_KIND_KERNEL VALUES (?, ?, ?, ?)", [(r.user_id % 4, r.event_id % 2, 10 * r.event_id, 10 * r.event_id + r.user_id % 7 + 1) for r in rows])
        found = [tuple(r) for r in trace.kernels(spark, at).collect()]
    return spark.createDataFrame(found, "device long, name string, s long, e long")


@query
def source_records(spark, sf_dir):
    """Trials as records, one JSON line each, read back and summed."""
    path = fresh(spark, "records")
    files.write_jsonl(rel.trials(spark, sf_dir), path)
    return trace.records(spark, path).groupBy("config").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 6).alias("seconds"))


# --- train and predict --------------------------------------------------------------------------


def _end_to_end(spark, sf_dir, kind, with_file: bool):
    train, model, out, avg = _reviews(spark, sf_dir, kind, "gzip"), fresh(spark, "model"), fresh(spark, "predictions"), fresh(spark, "averages") if with_file else None
    recommender.train(spark, train, model, kind, averages_path=avg, compression="gzip")
    recommender.predict(spark, train, train, model, out, kind, averages_path=avg, compression="gzip")
    removed(spark, model)  # nothing reads it any more
    both = files.reviews(spark, train).alias("t").join(files.reviews(spark, out).alias("p"), ["user_id", "business_id"], "left")
    diff = F.col("p.stars") - F.col("t.stars")
    return both.agg(F.count("*").alias("n"), F.count("p.stars").alias("answered"), F.round(F.sqrt(F.avg(diff * diff)), 6).alias("rmse"))


@query
def train_predict_item(spark, sf_dir):
    return _end_to_end(spark, sf_dir, "item", True)


@query
def train_predict_user(spark, sf_dir):
    return _end_to_end(spark, sf_dir, "user", True)
