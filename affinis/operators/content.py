"""Content profiles: tokens, term weights, top words, set cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.schemas import InputRefused
from affinis.sources.shared import written

# fixed values: characters that are deleted before splitting, and stop words beside those of a file
DELETED = "([,.!?:;])1234567890$/\\\"%#"
EXTRA_STOP = ["\n", " ", "-"]


def token_array(text: Column, stop: list[str] | None = None) -> Column:
    words = F.filter(F.split(F.translate(F.lower(text), DELETED, ""), r"\s+"), lambda t: t != "")
    listed = [*EXTRA_STOP, *(stop or [])]
    return F.filter(words, lambda t: ~t.isin(listed))


def tokens(docs: DataFrame, doc: str, text: str = "text", stop: list[str] | DataFrame | None = None) -> DataFrame:
    """(doc, word), one row per occurrence. Documents of one ``doc`` are read as one. stop: a short
    list, or a table (word) of any length."""
    listed = None if isinstance(stop, DataFrame) else stop
    out = docs.select(F.col(doc).alias("doc"), F.explode(token_array(F.col(text), listed)).alias("word"))
    return out.join(stop, "word", "left_anti").select("doc", "word") if isinstance(stop, DataFrame) else out


def term_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("doc", "word").agg(F.count("*").alias("cnt"))


def term_frequency(counts: DataFrame) -> DataFrame:
    """(doc, word, cnt, tf): count over the largest count of the document. The table of largest counts
    is joined back rather than read off a window, which would hold all words of a document at once."""
    top = counts.groupBy("doc").agg(F.max("cnt").alias("top"))
    return counts.join(top, "doc").select("doc", "word", "cnt", (F.col("cnt") / F.col("top")).alias("tf"))


def inverse_frequency(counts: DataFrame, documents: int, rare: float) -> DataFrame:
    """(word, df, total, idf) of words with more than ``rare`` occurrences; idf = log2(N / df)."""
    w = counts.groupBy("word").agg(F.count("*").alias("df"), F.sum("cnt").alias("total"))
    return w.where(F.col("total") > rare).select("word", "df", "total", F.log2(F.lit(documents) / F.col("df")).alias("idf"))


def tfidf(docs: DataFrame, doc: str, text: str = "text", stop: list[str] | DataFrame | None = None, rare_share: float = 1e-6) -> DataFrame:
    """(doc, word, tfidf), rounded to 9 places so that ranks do not hang on the last bit.

    Words with at most ``rare_share`` of all tokens are left out."""
    # texts are read and counted once; all that follows reads the counts
    counts = written(term_counts(tokens(docs, doc, text, stop)), "term-counts")
    per = counts.groupBy("doc").agg(F.sum("cnt").alias("t"))
    scalars = per.agg(F.count("*").alias("n"), F.sum("t").alias("t")).first()
    idf = inverse_frequency(counts, scalars.n, rare_share * (scalars.t or 0))
    return term_frequency(counts).join(idf, "word").select("doc", "word", F.round(F.col("tf") * F.col("idf"), 9).alias("tfidf"))


def top_words(weights: DataFrame, k: int = 200) -> DataFrame:
    """The k words of largest weight of each document; ties by word ascending."""
    w = Window.partitionBy("doc").orderBy(F.desc("tfidf"), F.asc("word"))
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def profiles(top: DataFrame) -> DataFrame:
    """(doc, words): the top words as an ordered list."""
    return top.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("words"))


def user_profiles(reviews: DataFrame, items: DataFrame, kind: str = "union") -> DataFrame:
    """(u, words) from reviews (u, doc, ord) and item profiles: the words of all reviewed items
    (union), or those of the first one (first). Users whose items have no profile get no words."""
    if kind == "first":
        first = reviews.groupBy("u").agg(F.min_by("doc", "ord").alias("doc"))
        return first.join(items, "doc", "left").select("u", F.coalesce(F.array_sort(F.array_distinct("words")), F.array().cast("array<string>")).alias("words"))
    if kind != "union":
        raise InputRefused(f"kind must be union or first, not {kind!r}")
    pairs = reviews.select("u", "doc").distinct().join(items, "doc", "left")
    return pairs.groupBy("u").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("words", F.array().cast("array<string>")))))).alias("words"))


def set_cosine(a: Column, b: Column) -> Column:
    """|A and B| / sqrt(|A|) sqrt(|B|); 0 where one is empty or absent."""
    na, nb = F.size(F.coalesce(a, F.array().cast("array<string>"))), F.size(F.coalesce(b, F.array().cast("array<string>")))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / (F.sqrt(na) * F.sqrt(nb)))


def matches(pairs: DataFrame, users: DataFrame, items: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(u, doc, sim) of the given pairs at or above ``threshold``."""
    both = pairs.join(users.withColumnRenamed("words", "wu"), "u", "left").join(items.withColumnRenamed("words", "wi"), "doc", "left")
    return both.select("u", "doc", set_cosine(F.col("wu"), F.col("wi")).alias("sim")).where(F.col("sim") >= threshold)
