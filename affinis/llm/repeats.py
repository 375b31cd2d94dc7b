"""Repeated passages by windows at content-chosen anchors.

1. Every window of ``least_words`` words has an anchor that its own words choose: the position with
   the least hash of ``GRAM`` words among those with at least ``KEY`` words of the window to their
   right. Equal windows have equal anchors, whatever surrounds them.
2. The keys of a text (hashes of the ``KEY`` words at its anchors, each once) are sorted over the
   cluster. Keys of a single document go; the windows at the other ones stay. What stays too much does no
   harm, so the first and last key of every sorted range simply stay.
3. The hashes of the windows that stay are sorted over the cluster, then by document. Every window
   gets the least id among the other documents that hold it. Ranges are dealt to tasks by sampled
   splitters, so even a passage in a third of all rows is spread; windows at the ends of ranges get
   their ids from a table of at most two rows a range.
4. Back in text order, windows in a row with the same partner are one match.

Words and windows are compared by hashes of 64 bits.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm.common import dropped, key_filter, marked, numbers, small_batches, written

KEY, GRAM = 20, 4
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(text: str | None) -> np.ndarray:
    one = xxhash.xxh3_64_intdigest
    return np.array([one(w) for w in (text or "").encode("utf-8", "surrogatepass").split()], np.uint64)


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position that has as many; by doubling."""
    n = max(0, len(h) - k + 1)

    def joined(x, y):
        z = (x * ODD) ^ y
        z ^= z >> np.uint64(31)
        z *= MIX
        return z ^ (z >> np.uint64(29))

    out, at, width, s = None, 0, 1, h
    while True:
        if k & width:
            part = s[at : at + n]
            out = part if out is None else joined(out, part)
            at += width
        if 2 * width > k:
            return out
        s = joined(s[:-width], s[width:])
        width *= 2


def anchors(h: np.ndarray, least_words: int) -> np.ndarray:
    """Position of the anchor of each window of ``least_words`` words."""
    window = least_words - (KEY - 1)
    if len(h) < least_words or window < 1:
        return np.zeros(0, np.int64)
    g = _grams(h, GRAM)[: len(h) - KEY + 1]
    return np.lib.stride_tricks.sliding_window_view(g, window).argmin(axis=1) + np.arange(len(h) - least_words + 1)


def chosen(h: np.ndarray, least_words: int) -> np.ndarray:
    """Positions that are the anchor of some window."""
    return np.unique(anchors(h, least_words))


def _edges(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which words start and stop (exclusive)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.concatenate([[False], (c != 32) & ((c < 9) | (c > 13)), [False]])
    return np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])


def _numbers(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``written``, with Arrow batches that suit rows of a few numbers."""
    with numbers(spark):
        return written(df, name)


def _columns(batches) -> list[np.ndarray]:
    """All rows of a partition, as one array a column; [] where there are none."""
    table = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(c).to_numpy() for b in table]) for c in range(table[0].num_columns)] if table else []


def keys(docs: DataFrame, text: str, doc_id: str, least_words: int) -> DataFrame:
    """doc_id, k: the distinct hashes of the KEY words at a document's anchors."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, ks = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None:
                    continue
                h = word_hashes(t)
                p = chosen(h, least_words)
                if len(p):
                    k = np.unique(_grams(h, KEY)[p])
                    ids.append(np.full(len(k), i, np.int64)), ks.append(k.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(ks))], names=["doc_id", "k"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, k long")


def _shared(rows: DataFrame) -> DataFrame:
    """Of (doc_id, k), sorted by k and doc_id: rows whose k several documents of the partition hold,
    and those of its first and last k."""
    import pyarrow as pa

    def run(batches):
        cols = _columns(batches)
        if not cols:
            return
        d, k = cols
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        last = np.concatenate([first[1:], [len(k)]]) - 1
        stay = d[first] != d[last]
        stay[[0, -1]] = True
        stay = np.repeat(stay, last - first + 1)
        yield pa.RecordBatch.from_arrays([pa.array(d[stay]), pa.array(k[stay])], names=["doc_id", "k"])

    return rows.select("doc_id", "k").mapInArrow(run, "doc_id long, k long")


def _windows(rows: DataFrame, least_words: int) -> DataFrame:
    """Of (doc_id, text, ks): one row per window whose anchor has a key of ks."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for i, t, ks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                h = word_hashes(t)
                at = anchors(h, least_words)
                if not len(at):
                    continue
                p = np.flatnonzero(np.isin(_grams(h, KEY).view(np.int64), ks.values.to_numpy())[at])
                start, stop = _edges(t)
                out.append((np.full(len(p), i, np.int64), p.astype(np.int32), start[p].astype(np.int32), stop[p + least_words - 1].astype(np.int32), _grams(h, least_words)[p].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["doc_id", "pos", "from", "to", "hash"])

    return rows.select("doc_id", "text", "ks").mapInArrow(run, "doc_id long, pos int, from int, to int, hash long")


def _partners(rows: DataFrame) -> DataFrame:
    """Of windows sorted by hash and doc_id: those that several documents hold, with the least id of
    the others. Windows of a partition's first and last hash keep their hash and have no partner yet."""
    import pyarrow as pa

    def run(batches):
        cols = _columns(batches)
        if not cols:
            return
        d, p, f, t, h = cols
        n = len(d)
        new = np.concatenate([[True], h[1:] != h[:-1]])
        run_ = new | np.concatenate([[True], d[1:] != d[:-1]])
        group = np.cumsum(new) - 1
        least = d[new]
        heads = np.flatnonzero(run_)
        second = heads[1:][~new[heads[1:]] & new[heads[:-1]]]
        several, after = np.zeros(len(least), bool), np.zeros(len(least), np.int64)
        several[group[second]], after[group[second]] = True, d[second]
        open_ = np.zeros(n, bool)
        open_[(group == 0) | (group == group[-1])] = True
        i = np.flatnonzero(open_ | several[group])
        o, g = open_[i], group[i]
        partner = np.where(d[i] == least[g], after[g], least[g])
        yield pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(p[i]), pa.array(f[i]), pa.array(t[i]), pa.array(partner, mask=o), pa.array(h[i], mask=~o)], names=["doc_id", "pos", "from", "to", "partner", "hash"])

    return rows.select("doc_id", "pos", "from", "to", "hash").mapInArrow(run, "doc_id long, pos int, from int, to int, partner long, hash long")


def _two_least(rows: DataFrame) -> DataFrame:
    """Of (hash, doc_id): the two least ids of each hash in each partition, a row for either."""
    import pyarrow as pa

    def run(batches):
        best: dict[int, list[int]] = {}
        for b in batches:
            h, d = (b.column(c).to_numpy() for c in range(2))
            for x in np.unique(h).tolist():
                best[x] = sorted({*best.get(x, []), *np.unique(d[h == x])[:2].tolist()})[:2]
        out = [(x, i) for x, ids in best.items() for i in ids]
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(2)], names=["hash", "doc_id"])

    return rows.select("hash", "doc_id").mapInArrow(run, "hash long, doc_id long")


def _looked_up(rows: DataFrame, hashes: np.ndarray, least: np.ndarray, after: np.ndarray) -> DataFrame:
    """All windows with their partner: those that have none yet get the least id of the other
    documents by their hash, which must be one of the given (sorted) hashes, or they go."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            d, h = b.column(0).to_numpy(), b.column(5).fill_null(0).to_numpy()
            known = b.column(5).is_null().to_numpy(zero_copy_only=False)
            partner = b.column(4).fill_null(0).to_numpy().copy()
            if len(hashes) and not known.all():
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = ~known & (hashes[at] == h)
                partner[hit] = np.where(d == least[at], after[at], least[at])[hit]
                known |= hit
            i = pa.array(np.flatnonzero(known))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(i) for c in range(4)), pa.array(partner).take(i)], names=["doc_id", "pos", "from", "to", "partner"])

    return rows.select("doc_id", "pos", "from", "to", "partner", "hash").mapInArrow(run, "doc_id long, pos int, from int, to int, partner long")


def _stretches(rows: DataFrame, least_words: int) -> DataFrame:
    """Of windows sorted by doc_id and pos: windows in a row with the same partner, as one."""
    import pyarrow as pa

    names = ["doc_id", "start", "stop", "from", "to", "partner"]

    def batch(cols):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            d, p, f, t, q = (b.column(c).to_numpy() for c in range(5))
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1])])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(d)]]) - 1
            cols = [d[first], p[first], (p[last] + least_words).astype(np.int32), f[first], t[last], q[first]]
            if held is not None:
                if held[0] == d[0] and held[2] - least_words + 1 == p[0] and held[5] == q[0]:
                    cols[1][0], cols[3][0] = held[1], held[3]
                else:
                    cols = [np.concatenate([[x], c]).astype(c.dtype) for x, c in zip(held, cols, strict=True)]
            held = [c[-1] for c in cols]
            if len(cols[0]) > 1:
                yield batch([c[:-1] for c in cols])
        if held is not None:
            yield batch([np.array([x]) for x in held])

    return rows.select("doc_id", "pos", "from", "to", "partner").mapInArrow(run, "doc_id long, start int, stop int, from int, to int, partner long")


def matches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_words: int = 50) -> DataFrame:
    """Stretches of repeated words: doc_id, start, stop (words), from, to (code points), partner, the
    least id of the other documents that hold each window of ``least_words`` words of the stretch."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    made = written(keys(docs, text, doc_id, least_words), "keys")
    order = made.repartitionByRange(n, "k", "doc_id").sortWithinPartitions("k", "doc_id")
    shared = _numbers(spark, _shared(order), "shared")
    dropped(made)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    own = F.col("doc_id")
    texts = marked(texts, own, key_filter(shared, own), "shares").where("shares").drop("shares")
    some = shared.groupBy("doc_id").agg(F.collect_set("k").alias("ks"))
    rows = texts.join(some, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("ks").alias("ks"))
    windows = written(_windows(rows, least_words), "windows")
    dropped(shared)
    order = windows.repartitionByRange(n, "hash", "doc_id", "pos").sortWithinPartitions("hash", "doc_id")
    found = _numbers(spark, _partners(order), "partners")
    dropped(windows)
    # windows at the ends of ranges: at most two hashes a range, so their ids fit the driver
    ends = found.where("hash IS NOT NULL")
    ids: dict[int, set[int]] = {}
    for r in _two_least(ends).collect():
        ids.setdefault(r["hash"], set()).add(r["doc_id"])
    several = sorted((x, *sorted(i)[:2]) for x, i in ids.items() if len(i) > 1)
    hashes, least, after = np.array(several, np.int64).reshape(-1, 3).T
    whole = _looked_up(found, hashes, least, after)
    out = _numbers(spark, _stretches(whole.repartition(n, "doc_id").sortWithinPartitions("doc_id", "pos"), least_words), "matches")
    dropped(found)
    return out


def merged(spans: DataFrame) -> DataFrame:
    """Spans of each document that touch or overlap, as one: least partner, and how many matches."""
    by = Window.partitionBy("doc_id").orderBy("start", "stop", "partner")
    seen = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.withColumn("new", F.when(seen.isNull() | (F.col("start") > seen), 1).otherwise(0)).withColumn("part", F.sum("new").over(by))
    return cut.groupBy("doc_id", "part").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("from").alias("start_char"), F.max("to").alias("end_char"), F.min("partner").alias("partner_id"), F.count("*").alias("matches")).drop("part")


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_words: int = 50) -> DataFrame:
    """One row per repeated passage of a document: doc_id, start_word, end_word, start_char, end_char
    (code points, ends exclusive), n_words, partner_id, matches, duplicate.

    A passage counts if another document holds at least ``least_words`` of the same words in a row
    (words are what white space separates, case matters). partner_id is the least id among all other
    documents that hold such words of it; duplicate is true if that is smaller than doc_id. matches
    counts the stretches of the passage that differ in their least partner. Null and empty texts and
    rows with a null id have no passages. Of rows with the same id the greatest text counts, and they
    are one document. Extra columns are ignored; an empty table gives an empty table.
    """
    m = merged(matches(docs, text, doc_id, least_words))
    return m.select("doc_id", "start_word", "end_word", "start_char", "end_char", (F.col("end_word") - F.col("start_word")).alias("n_words"), "partner_id", "matches", (F.col("partner_id") < F.col("doc_id")).alias("duplicate"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_words: int = 50) -> DataFrame:
    """All rows and columns of ``docs``; passages that a document with a smaller id holds are cut."""
    cut = merged(matches(docs, text, doc_id, least_words).where("partner < doc_id")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("_cuts_"))
    rows = docs.join(cut.select(F.col("doc_id").alias("_cut_id_"), "_cuts_"), F.col(doc_id) == F.col("_cut_id_"), "left")
    pieces = F.expr(f"concat_ws('', transform(sequence(0, size(_cuts_)), i -> CASE WHEN i = 0 THEN substring(`{text}`, 1, _cuts_[0].start_char) ELSE substring(`{text}`, get(_cuts_, i - 1).end_char + 1, coalesce(get(_cuts_, i).start_char, length(`{text}`)) - get(_cuts_, i - 1).end_char) END))")
    return rows.withColumn(text, F.when(F.col("_cuts_").isNull(), F.col(text)).otherwise(pieces)).select(*docs.columns)


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+') AS ts FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
u AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS k FROM t),
c AS (SELECT doc_id, t, k, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM u),
w AS (SELECT doc_id, t, stop - length(t) AS start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM c WHERE NOT regexp_matches(t, '^[\x20\x09-\x0D]')),
l AS (SELECT doc_id, list(t ORDER BY pos) AS ws, list(start ORDER BY pos) AS starts, list(stop ORDER BY pos) AS stops FROM w GROUP BY doc_id HAVING count(*) >= 50),
x AS (SELECT doc_id, starts, stops, ws, unnest(range(0, len(ws) - 49)) AS pos FROM l),
h AS (SELECT doc_id, pos, starts[pos + 1] AS start, stops[pos + 50] AS stop, md5(array_to_string(ws[pos + 1:pos + 50], ' ')) AS h FROM x),
two AS (SELECT h, min(doc_id) AS a, max(doc_id) AS z FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
second AS (SELECT h.h, min(h.doc_id) AS b FROM h JOIN two ON two.h = h.h AND h.doc_id > two.a GROUP BY h.h),
m AS (SELECT h.doc_id, h.pos, h.start, h.stop, CASE WHEN h.doc_id = two.a THEN second.b ELSE two.a END AS partner FROM h JOIN two ON two.h = h.h JOIN second ON second.h = h.h),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, partner ORDER BY pos) AS g FROM m),
s AS (SELECT doc_id, partner, min(pos) AS first, max(pos) + 50 AS last, min(start) AS start, max(stop) AS stop FROM i GROUP BY doc_id, partner, g),
r AS (SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first, last, partner ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s),
q AS (SELECT *, sum(CASE WHEN seen IS NULL OR first > seen THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY first, last, partner ROWS UNBOUNDED PRECEDING) AS part FROM r)
SELECT doc_id, min(first)::INTEGER AS start_word, max(last)::INTEGER AS end_word, min(start)::INTEGER AS start_char, max(stop)::INTEGER AS end_char, (max(last) - min(first))::INTEGER AS n_words, min(partner) AS partner_id, count(*) AS matches, min(partner) < doc_id AS duplicate FROM q GROUP BY doc_id, part
"""

__all__ = ["anchors", "chosen", "keys", "matches", "merged", "repeated", "without_repeats", "word_hashes"]
