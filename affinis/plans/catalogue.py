"""Registry of the engine's own queries: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import content, lsh, overlap, predict, ratings, stats, subsets, validate
from affinis.plans import relations as rel
from affinis.plans.engine import similarity
from affinis.plans.files_catalogue import QUERIES as FILE_QUERIES
from affinis.schemas import SIX
from affinis.sources.shared import kept

# fixed values
PREFIX_SIZES = [1, 2, 3, 63, 64, 65, 127, 128, 129, 511, 512, 513]
TOP_K = 50
QUERIES: dict = dict(FILE_QUERIES)


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- ratings ------------------------------------------------------------------------------------


@query
def ratings_dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.suppliers(spark, sf_dir)


@query
def ratings_user_orientation(spark, sf_dir):
    raw = rel.triples(spark, sf_dir, "l_suppkey", "o_custkey").toDF("item", "user", "v", "ok", "ln")
    return ratings.last_wins(ratings.oriented(raw, "user", "user", "item", "v", ["ok", "ln"]), ["ok", "ln", "v"])


@query
def distinct_ids(spark, sf_dir):
    r = rel.suppliers(spark, sf_dir)
    ids = lambda c: r.select(F.lit(c).alias("side"), F.col(c).alias("id")).distinct()
    return ids("e").union(ids("d"))


@query
def entity_support_filter(spark, sf_dir):
    return ratings.support(rel.parts(spark, sf_dir), 3)


@query
def supported_rows(spark, sf_dir):
    return ratings.supported(rel.parts(spark, sf_dir), 30)


@query
def dense_entity_ids(spark, sf_dir):
    return ratings.dense_ids(rel.parts(spark, sf_dir), "e").select(F.col("e"), "idx")


@query
def mod_subset(spark, sf_dir):
    return ratings.mod_subset(rel.parts(spark, sf_dir), 11, 0)


@query
def topk_active_entities(spark, sf_dir):
    r = rel.parts(spark, sf_dir)
    return ratings.rows_of(r, ratings.most_active(r, TOP_K))


@query
def row_length_stats(spark, sf_dir):
    return ratings.row_lengths(rel.suppliers(spark, sf_dir)).agg(F.max("len").alias("max_row"), F.min("len").alias("min_row"), F.sum("len").alias("nnz"))


@query
def restricted_row_lengths(spark, sf_dir):
    return ratings.restricted_lengths(rel.suppliers(spark, sf_dir), 100, 500)


@query
def payload_domain_report(spark, sf_dir):
    d = ratings.domain(rel.suppliers(spark, sf_dir))
    limits = spark.createDataFrame([(k, v if v is not None else 2**62) for k, v in ratings.LIMITS.items()], "payload string, top long")
    ok = F.col("finite") & ((F.col("payload") == "f64") | (F.col("integral") & (F.col("max_row") <= F.col("top")) & (F.col("vmax") * F.col("max_row") <= F.col("top")) & (F.col("vmax") * F.col("vmax") * F.col("max_row") <= F.col("top"))))
    return limits.crossJoin(F.broadcast(d)).select("payload", "max_row", "vmax", "integral", "finite", ok.alias("accepted"))


@query
def payload_bit_audit(spark, sf_dir):
    return subsets.bit_audit(rel.suppliers(spark, sf_dir))


# --- pairs and similarity -----------------------------------------------------------------------


@query
def pair_overlap_counts(spark, sf_dir):
    return overlap.overlap_counts(rel.suppliers(spark, sf_dir))


@query
def pair_six_stats(spark, sf_dir):
    return overlap.six_sums(rel.suppliers(spark, sf_dir, apart=True))


@query
def item_pearson_all(spark, sf_dir):
    return overlap.with_similarity(overlap.six_sums(rel.parts(spark, sf_dir))).select("i", "j", "n", "sim")


@query
def item_pearson_emitted(spark, sf_dir):
    return overlap.model(overlap.six_sums(rel.suppliers(spark, sf_dir)))


@query
def part_pearson_emitted(spark, sf_dir):
    # entities of too few rows reach no overlap, so none are looked for first
    return overlap.model(overlap.six_sums(rel.parts(spark, sf_dir)))


@query
def user_pearson_emitted(spark, sf_dir):
    return overlap.model(overlap.six_sums(ratings.supported(rel.customers(spark, sf_dir))))


@query
def pearson_two_pass(spark, sf_dir):
    return overlap.two_pass(rel.suppliers(spark, sf_dir, apart=True)).withColumn("sim", F.round("sim", 9) + F.lit(0.0))


@query
def given_pairs_pearson(spark, sf_dir):
    r = rel.parts(spark, sf_dir)
    e = r.select("e").distinct()
    pairs = e.select(F.col("e").alias("i"), (F.col("e") + 1).alias("j")).union(e.select(F.col("e").alias("i"), (F.col("e") + 97).alias("j")))
    return overlap.given_pairs(pairs, r)


@query
def pearson_dim_sharded(spark, sf_dir):
    return similarity(rel.suppliers(spark, sf_dir), partition="dim", shards=3)


@query
def pearson_packed(spark, sf_dir):
    return similarity(rel.suppliers(spark, sf_dir), payload="packed", partition="dim")


@query
def pearson_i32(spark, sf_dir):
    return similarity(rel.suppliers(spark, sf_dir), payload="i32", partition="dim", emit=False)


@query
def pearson_packed_dim(spark, sf_dir):
    return similarity(rel.suppliers(spark, sf_dir), payload="packed", partition="dim", shards=4)


@query
def pearson_i32_dim(spark, sf_dir):
    return similarity(rel.suppliers(spark, sf_dir), payload="i32", partition="dim", shards=4)


@query
def packed_words(spark, sf_dir):
    from affinis.functions.pearson import packed_words as words, unpacked

    s = overlap.six_sums(rel.suppliers(spark, sf_dir, apart=True))
    w0, w1 = words(*[F.col(c) for c in SIX])
    w = s.select("i", "j", w0.alias("w0"), w1.alias("w1"))
    return w.select("i", "j", "w0", "w1", *[c.alias(n) for c, n in zip(unpacked(F.col("w0"), F.col("w1")), SIX, strict=True)])


# --- candidates by hashing ----------------------------------------------------------------------


@query
def minhash_signatures(spark, sf_dir):
    return lsh.signatures(rel.suppliers(spark, sf_dir)).select("e", F.posexplode("sig").alias("k", "h")).select("e", F.col("k").cast("long").alias("k"), "h")


@query
def lsh_bands(spark, sf_dir):
    return lsh.bands(lsh.signatures(rel.suppliers(spark, sf_dir)), 2).select("e", F.col("band").cast("long").alias("band"), "bucket")


@query
def lsh_candidates(spark, sf_dir):
    return lsh.candidates(lsh.signatures(rel.suppliers(spark, sf_dir)))


@query
def lsh_jaccard_pairs(spark, sf_dir):
    return lsh.verified_pairs(rel.parts(spark, sf_dir), 0.05)


@query
def lsh_jaccard_pairs_100(spark, sf_dir):
    return lsh.verified_pairs(rel.suppliers(spark, sf_dir), 0.05, hashes=100, strategy="bucket")


@query
def lsh_user_pearson(spark, sf_dir):
    return similarity(rel.customers(spark, sf_dir), candidates="lsh")


# --- prediction ---------------------------------------------------------------------------------


def _item_setup(spark, sf_dir):
    r = kept(rel.suppliers(spark, sf_dir), "ratings")  # read four times
    u = rel.as_users(r)
    return u, kept(overlap.model(overlap.six_sums(r)).select("i", "j", "sim"), "model")


@query
def item_topn_prediction(spark, sf_dir):
    u, m = _item_setup(spark, sf_dir)
    return predict.item_based(u.select("u", "i"), u, m).withColumn("pred", F.round("pred", 6))


def _user_setup(spark, sf_dir):
    r = rel.customers(spark, sf_dir)
    m = overlap.model(overlap.six_sums(ratings.supported(r)))
    return r.select(F.col("e").alias("u"), F.col("d").alias("i"), "v"), m


@query
def user_prediction_corrected(spark, sf_dir):
    u, m = _user_setup(spark, sf_dir)
    return predict.user_based(u.select("u", "i"), u, m).withColumn("pred", F.round("pred", 6))


@query
def user_prediction_compat(spark, sf_dir):
    u, m = _user_setup(spark, sf_dir)
    return predict.user_based(u.select("u", "i"), u, m, denominator="avg").withColumn("pred", F.round("pred", 6))


@query
def entity_averages_with_unk(spark, sf_dir):
    return predict.averages(rel.suppliers(spark, sf_dir), "e").withColumn("avg", F.round("avg", 9))


@query
def prediction_rmse(spark, sf_dir):
    u, m = _item_setup(spark, sf_dir)
    pred = kept(predict.item_based(u.select("u", "i"), u, m), "predictions")  # so that lists go before the join
    whole = u.agg(F.avg("v").alias("avg"))
    return predict.rmse(pred, u, whole).select("n", F.round("rmse", 6).alias("rmse"), F.round("coverage", 6).alias("coverage"))


# --- content ------------------------------------------------------------------------------------


def _docs(spark, sf_dir):
    return rel.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query
def doc_tokens(spark, sf_dir):
    return content.term_counts(content.tokens(_docs(spark, sf_dir), "source"))


@query
def doc_tf(spark, sf_dir):
    return content.term_frequency(doc_tokens(spark, sf_dir)).withColumn("tf", F.round("tf", 9))


@query
def word_idf(spark, sf_dir):
    c = doc_tokens(spark, sf_dir)
    n, t = c.agg(F.count_distinct("doc"), F.sum("cnt")).first()
    return content.inverse_frequency(c, n, 1e-5 * (t or 0)).withColumn("idf", F.round("idf", 9))


def _top(spark, sf_dir):
    return content.top_words(content.tfidf(_docs(spark, sf_dir), "source", rare_share=1e-5))


@query
def doc_tfidf_top200(spark, sf_dir):
    return _top(spark, sf_dir).select("doc", "word", "tfidf", F.col("rank").cast("long").alias("rank"))


def _profiles(spark, sf_dir, kind):
    reviews = _docs(spark, sf_dir).select(F.col("lang").alias("u"), F.col("source").alias("doc"), F.col("doc_id").alias("ord"))
    items = content.profiles(_top(spark, sf_dir))
    return reviews, items, content.user_profiles(reviews, items, kind)


@query
def user_profile_union(spark, sf_dir):
    return _profiles(spark, sf_dir, "union")[2].select("u", F.explode("words").alias("word"))


@query
def user_profile_first(spark, sf_dir):
    return _profiles(spark, sf_dir, "first")[2].select("u", F.explode("words").alias("word"))


@query
def set_cosine_pairs(spark, sf_dir):
    reviews, items, users = _profiles(spark, sf_dir, "first")
    return content.matches(reviews.select("u", "doc").distinct(), users, items).withColumn("sim", F.round("sim", 9))


# --- validation ---------------------------------------------------------------------------------


def _disturbed(m: DataFrame) -> DataFrame:
    """A result with known faults: small and large differences, values that are no numbers, gaps."""
    k = F.col("i") + F.col("j")
    sim = F.when(k % 97 == 0, F.lit(float("nan"))).when(k % 53 == 0, F.col("sim") + 1e-3).when(k % 7 == 0, F.col("sim") + 1e-13).otherwise(F.col("sim"))
    return m.where(k % 31 != 0).select("i", "j", sim.alias("sim"))


@query
def result_check_pass(spark, sf_dir):
    r = kept(rel.suppliers(spark, sf_dir), "ratings")
    return validate.result_check(similarity(r, payload="packed", partition="dim", emit=False), overlap.with_similarity(overlap.six_sums(r)))


@query
def result_check_report(spark, sf_dir):
    m = kept(overlap.with_similarity(overlap.six_sums(rel.suppliers(spark, sf_dir))).select("i", "j", "sim"), "sims")  # read twice
    return validate.result_check(_disturbed(m), m)


@query
def model_crosscheck(spark, sf_dir):
    m = kept(overlap.model(overlap.six_sums(rel.suppliers(spark, sf_dir))).select("i", "j", "sim"), "model")  # read twice
    other = _disturbed(m).where(~F.isnan("sim"))
    return validate.crosscheck(m.select(F.col("i").alias("a"), F.col("j").alias("b"), "sim"), other.select(F.col("j").alias("a"), F.col("i").alias("b"), "sim"))


@query
def model_membership_difference(spark, sf_dir):
    m = kept(overlap.model(overlap.six_sums(rel.suppliers(spark, sf_dir))).select("i", "j", "sim"), "model")  # read twice
    return m.select("i", "j").exceptAll(_disturbed(m).select("i", "j"))


# --- subsets and orders -------------------------------------------------------------------------


@query
def overlap_band_flat(spark, sf_dir):
    return subsets.overlap_band(overlap.six_sums(rel.parts(spark, sf_dir)), "flat").select("i", "j", "n")


@query
def overlap_band_skew(spark, sf_dir):
    return subsets.overlap_band(overlap.six_sums(rel.suppliers(spark, sf_dir)), "skew").select("i", "j", "n")


@query
def overlap_band_stats(spark, sf_dir):
    return subsets.band_stats(overlap.overlap_counts(rel.suppliers(spark, sf_dir)))


@query
def prefix_pairs_boundary(spark, sf_dir):
    return subsets.prefix_report(overlap.with_similarity(overlap.six_sums(rel.suppliers(spark, sf_dir))), PREFIX_SIZES)


@query
def stratified_match_sample(spark, sf_dir):
    r = rel.parts(spark, sf_dir)
    return subsets.matched_sample(overlap.overlap_counts(r), r, [(1, 30, 24), (2, 38, 33)], 1).select("i", "j", "side", "bucket", F.col("depth").cast("int").alias("depth"), "decile")


@query
def short_len_order(spark, sf_dir):
    r = rel.suppliers(spark, sf_dir)
    return subsets.by_short_length(overlap.overlap_counts(r).select("i", "j"), r)


@query
def lane_slot_cost(spark, sf_dir):
    order = short_len_order(spark, sf_dir)
    out = None
    for g in (1, 4, 32):
        one = subsets.lane_cost(order, g)
        out = one if out is None else out.union(one)
    return out


@query
def shard_ranges_tile(spark, sf_dir):
    total = rel.table(spark, sf_dir, "lineitem").count()
    out = None
    for shards in (1, 3, 7):
        r = subsets.shard_ranges(spark, total, shards)
        one = subsets.tiles(r, total).select(F.lit(shards).alias("shards"), "gaps", "covered")
        out = one if out is None else out.union(one)
    return out


# --- intervals and trials -----------------------------------------------------------------------


@query
def interval_union(spark, sf_dir):
    return stats.interval_union(rel.intervals(spark, sf_dir), ["u"])


@query
def interval_overlap(spark, sf_dir):
    iv = rel.intervals(spark, sf_dir)
    kinds = iv.agg(F.min("kind").alias("a"), F.max("kind").alias("b"))
    both = iv.crossJoin(F.broadcast(kinds))
    return stats.overlap_report(both.where("kind = a").select("u", "s", "e"), both.where("kind = b").select("u", "s", "e"), ["u"], 6 * 3600)


@query
def trial_summary(spark, sf_dir):
    return stats.trial_summary(rel.trials(spark, sf_dir))


@query
def paired_log_ratio(spark, sf_dir):
    return stats.paired_ratio(rel.trials(spark, sf_dir), "A", "R")


@query
def bootstrap_ci(spark, sf_dir):
    return stats.bootstrap(rel.trials(spark, sf_dir), "A", "R")


@query
def fixture_roundtrip(spark, sf_dir):
    """Export as a fixture, read it back through the data source, validate it. Its files lie in the
    folder that driver and executors share, which must be one of their file systems."""
    from affinis.sources import fixture
    from affinis.sources.shared import fresh

    at = fresh(spark, "fixture").removeprefix("file://")
    if ":/" in at:
        raise ValueError(f"fixtures are local files; {at} is not in a file system that driver and executors mount")
    r = kept(rel.suppliers(spark, sf_dir), "ratings")
    fixture.export(r, overlap.with_similarity(overlap.six_sums(r)), at)
    rows = fixture.validated(spark, at).collect()
    return spark.createDataFrame(rows, "rule string, violations long")


@query
def incremental_sums(spark, sf_dir):
    """Six sums after three micro-batches, equal to those of the whole table."""
    from affinis.sources.shared import fresh
    from affinis.streaming.deltas import SumStore

    store = SumStore(spark, fresh(spark, "sums"))
    r = kept(rel.suppliers(spark, sf_dir), "ratings")
    for b in range(3):
        store.add(r.where(F.pmod(F.col("d"), F.lit(3)) == b), b)
        if b == 1:
            store.compact(b)
    return store.totals().select("i", "j", "n", "sim")
