"""Near-duplicate classes by MinHash bands and sequential Bayesian verification.

1. Each text becomes a set of hashed word shingles, a MinHash signature and band keys. Texts with
   the same set are one node, its least id stands for them.
2. Band keys are sorted over the cluster in ranges by (key, id), so a bucket of any size is spread.
   Round one pairs every member of a bucket with the least id that its range has of the bucket, and
   these with each other, so a bucket of n members gives n - 1 pairs. Pairs are compared batch by
   batch of their signatures; a pair goes as soon as the posterior probability of similarity at or
   above the threshold falls under ``miss``. Survivors are verified on their full sets, and the
   links give provisional classes.
3. Round two visits the buckets that still hold several classes, and compares all members of
   different classes there. The comparison happens inside a task on signatures; only survivors
   leave it, each from the first bucket the two share. They are verified like the others.
4. Classes are the components of all links.

A pair at the threshold misses all of ``bands`` bands with probability (1 - t**rows)**bands, 3e-7 by
default. ``miss`` holds for each batch of a signature: over the ten batches a pair right at the
threshold is ruled out with probability 7.0e-4 by default (6.1e-4 with equal bytes of unequal hashes).
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import connected_components, dropped, fewer_files, key_filter, mapped, marked, numbers, small_batches, written

BANDS, ROWS, HASHES, BATCH = 40, 4, 640, 64
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 4096  # members of a bucket that one task holds
GROUP = 8  # partners of a text that are verified together
HUB = 512  # partners of a text that one task deals with


def _constants(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20_240_607)
    return r.randint(0, 2**31, hashes).astype(np.uint32) * np.uint32(2) + np.uint32(1), r.randint(0, 2**32, hashes, dtype=np.uint64).astype(np.uint32)


MUL, ADD = _constants(HASHES)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. bytes.lower() maps A-Z alone, bytes.split()
    cuts at exactly [\\x20\\x09-\\x0D]."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    one = xxhash.xxh3_64_intdigest
    h = np.array([one(x) for x in w], np.uint64)
    k = min(words, len(h))
    n = len(h) - k + 1
    s = np.full(n, np.uint64(k))
    for i in range(k):
        s = s * MIX + h[i : i + n]
        s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A key of 128 bits."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())


def signature(s: np.ndarray) -> np.ndarray:
    """Least value of HASHES hash functions over the set."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 256):
        np.minimum(out, (low[at : at + 256, None] * MUL + ADD).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    v = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        v = v * MIX + sig[: BANDS * ROWS].reshape(BANDS, ROWS)[:, i]
        v ^= v >> np.uint64(29)
    return v.view(np.int64)


def features(docs: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """doc_id, n, k1, k2 (a 128-bit key of the set), bands, sig (8 bits of each least value)."""

    def make():
        def work(texts):
            n, k1, k2, bands, sigs = [], [], [], [], []
            for t in texts:
                s = shingles(t, words)
                n.append(len(s))
                if not len(s):
                    k1.append(None), k2.append(None), bands.append(None), sigs.append(None)
                    continue
                a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                k1.append(int(a)), k2.append(int(b))
                sig = signature(s)
                bands.append(band_keys(sig))
                sigs.append((sig * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8).tobytes())
            return [n, k1, k2, bands, sigs]

        return work

    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"], "n long, k1 long, k2 long, bands array<long>, sig binary", make)


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each count of compared hashes (BATCH, 2 BATCH, ...): matches under which a pair goes.

    With a uniform prior, P(similarity >= t | m of n match) is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of the rows of two signature matrices that no batch has ruled out."""
    alive = np.arange(len(a))
    got = np.zeros(len(a), np.int32)
    for i, need in enumerate(least):
        cols = slice(i * BATCH, (i + 1) * BATCH)
        got = got + (a[alive, cols] == b[alive, cols]).sum(axis=1)
        ok = got >= need
        alive, got = alive[ok], got[ok]
    return alive


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def shared_buckets(keyed: DataFrame) -> DataFrame:
    """Of (key, id) in ranges sorted by both: (key, id, first) for the members of buckets that hold
    several, ``first`` being the least id that the range has of the bucket. Buckets at the ends of a
    range may go on in the next one; their rows are ``open`` and stay even if they are alone."""
    import pyarrow as pa

    names = ["key", "id", "first", "open"]

    def run(batches):
        held = None  # a row that was alone in its bucket when its batch ended
        key = first = opening = None
        for b in batches:
            k, i = b.column(0).to_numpy(), b.column(1).to_numpy()
            if held is not None:
                k, i = np.append(held[0], k), np.append(held[1], i)
            if not len(k):
                continue
            opening = k[0] if opening is None else opening
            goes_on = held is None and key is not None and k[0] == key
            new = np.concatenate([[not goes_on], k[1:] != k[:-1]])
            heads = np.flatnonzero(new)
            bucket = np.cumsum(new)  # 0: the bucket of the batch before
            least = np.append(first if goes_on else 0, i[heads])[bucket]
            size = np.append(2, np.diff(np.append(heads, len(k))))[bucket]
            stay = (size > 1) | (k == opening)
            key, first = k[-1], least[-1]
            held = None if stay[-1] else (k[-1], i[-1])
            g = np.flatnonzero(stay)
            yield pa.RecordBatch.from_arrays([pa.array(k[g]), pa.array(i[g]), pa.array(least[g]), pa.array((k == opening)[g])], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first]), pa.array([first]), pa.array([True])], names=names)

    return keyed.select("key", "id").mapInArrow(run, "key long, id long, first long, open boolean")


def pruned(pairs: DataFrame, reps: DataFrame, least: list[int], percent: int) -> DataFrame:
    """Pairs (a, b) that survive the comparison of their signatures."""
    import pyarrow as pa

    sig = reps.select("id", "sig", "n")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")

    def run(batches):
        for x in batches:
            keep = pa.array(survivors(_matrix(x.column(2)), _matrix(x.column(3)), least))
            yield pa.RecordBatch.from_arrays([x.column(0).take(keep), x.column(1).take(keep)], names=["a", "b"])

    return both.where(f"least(na, nb) * 100 >= greatest(na, nb) * {percent}").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union.

    Pairs with the same ``a`` are verified GROUP at a time, so that a text with many partners is sent
    once for GROUP of them. The size of a group is fixed, whatever the number of partners; those of a
    hub are dealt to as many tasks as they need. Texts of no pair are left where they are."""
    import pyarrow as pa

    hubs = pairs.groupBy("a").agg(F.count("*").alias("m")).where(f"m > {HUB}")
    salted = pairs.join(hubs, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / HUB)), F.lit(0))).repartition("a", "salt")
    part = F.floor((F.row_number().over(Window.partitionBy("a", "salt").orderBy("b")) - 1) / GROUP).alias("part")
    grouped = salted.select("a", "salt", "b", part)
    ends = grouped.select("a", "salt", "part", F.col("b").alias("id")).union(grouped.groupBy("a", "salt", "part").agg(F.first("a").alias("id")))
    own = F.col("id")
    some = marked(texts, own, key_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), own), "of_pair").where("of_pair").drop("of_pair")
    sets = ends.join(some, "id").groupBy("a", "salt", "part").agg(F.collect_set(F.struct("id", "text")).alias("members")).select("a", "members")

    def run(batches):
        for c in batches:
            out_a, out_b = [], []
            for a, members in zip(c.column(0).to_pylist(), c.column(1), strict=True):
                own: dict[int, np.ndarray] = {}
                for m in members:
                    i, t = m["id"].as_py(), shingles(m["text"].as_py(), words)
                    if len(t) and (i not in own or set_key(t) > set_key(own[i])):  # an id with several texts
                        own[i] = t
                s = own.pop(a)
                for b, t in own.items():
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        out_a.append(a), out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return sets.mapInArrow(run, "a long, b long")


def _crossed(rows: DataFrame, least: list[int], percent: int) -> DataFrame:
    """Surviving pairs of members of one bucket that belong to different classes.

    rows: key, p, q, id, n, comp, bands, sig, part; sorted by key, p, q within partitions."""
    import pyarrow as pa

    def pairs_of(g):
        key, ids, n, comp, bands, sig, part, low = g
        size = len(ids)
        band = int((bands[0] == key).argmax())
        _, of, counts = np.unique(comp, return_inverse=True, return_counts=True)
        count = counts[of]
        out_a, out_b = [], []
        step = max(1, 200_000 // size)
        for lo in range(0, size, step):
            i = np.arange(lo, min(size, lo + step))
            ok = (comp[i, None] != comp[None, :]) & (np.minimum(n[i, None], n[None, :]) * 100 >= np.maximum(n[i, None], n[None, :]) * percent)
            # between two blocks of a bucket only pairs across them, within a block each pair once
            ok &= np.where(low, part[i, None] < part[None, :], i[:, None] < np.arange(size)[None, :])
            x, y = np.nonzero(ok)
            x = i[x]
            if not len(x):
                continue
            first = (bands[x] == bands[y]).argmax(axis=1) == band
            x, y = x[first], y[first]
            k = survivors(sig[x], sig[y], least)
            # the member of the smaller class comes first: it has the more partners
            x, y = x[k], y[k]
            small = count[x] <= count[y]
            out_a.append(ids[np.where(small, x, y)]), out_b.append(ids[np.where(small, y, x)])
        return out_a, out_b

    def run(batches):
        held, key = [], None

        def done():
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            a, b = pairs_of((key[0], *cols[:6], bool(cols[6][0])))
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for x in batches:
            if not x.num_rows:
                continue
            k = np.array(list(zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)))
            cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            cols = [x.column(3).to_numpy(), x.column(4).to_numpy(), x.column(5).to_numpy(), np.asarray(x.column(6).flatten().to_numpy()).reshape(-1, BANDS), _matrix(x.column(7)), x.column(8).to_numpy(), (k[:, 1] != k[:, 2])]
            for s, e in zip([0, *cut], [*cut, len(k)], strict=True):
                now = tuple(k[s])
                if key is not None and now != key:
                    yield from done()
                    held.clear()
                key = now
                held.append([c[s:e] for c in cols])
        if held:
            yield from done()

    return rows.mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 75, miss: float = 1e-4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Two texts are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the least id reachable. Fewer than ``words`` words make one shingle; a null text
    or one without words has the empty set, is linked with nothing and stands for itself. A row with
    a null id is linked with nothing, its component is null and it is kept. Repeated rows of one id
    count as one node; if their texts differ, the text whose set has the greatest hash tells its links.
    Extra columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    least = least_matches(percent / 100, miss)
    made = written(features(docs, text, doc_id, words).withColumn("row", F.monotonically_increasing_id()), "features")
    # one row for each id, that of its greatest set; then the least id of each set, merged by salt
    # first and handed back by salt
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int").alias("salt")
    ids = made.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("k1").alias("k1"), F.max_by("k2", "k1").alias("k2"), F.max_by("row", "k1").alias("row"))
    ids = written(ids.select("doc_id", "k1", "k2", "row", salt), "ids")
    sets = ids.groupBy("k1", "k2", "salt").agg(F.min("doc_id").alias("id")).groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("seen"))
    sets = sets.select("k1", "k2", "rep", F.explode(F.expr("filter(sequence(0, 15), s -> (shiftright(seen, s) & 1L) = 1L)")).alias("salt"))
    members = written(fewer_files(ids.join(sets, ["k1", "k2", "salt"]).select("doc_id", "rep", "row")), "members")
    nodes = written(made.select("row", F.col("doc_id").alias("id"), "n", "bands", "sig").join(members.where("doc_id = rep").select("row"), "row", "left_semi").drop("row"), "nodes")
    counts = written(fewer_files(made.select("doc_id", "n")), "counts")
    dropped(made, ids)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    order = nodes.select(F.explode("bands").alias("key"), "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    with numbers(spark):
        spots = written(shared_buckets(order), "buckets")
    ends = spots.where("open").select("key", "first").distinct()
    across = ends.join(ends.groupBy("key").agg(F.min("first").alias("a")), "key").select("a", F.col("first").alias("b"))
    first = spots.select(F.col("first").alias("a"), F.col("id").alias("b")).union(across).where("a <> b").distinct()
    tested = written(pruned(first, nodes, least, percent), "survivors")
    links = written(verified(tested, texts, words, percent), "links")
    classes = written(fewer_files(connected_components(links)), "classes")

    of = written(spots.select("key", "id").distinct().join(classes.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "spots")
    dropped(spots, links)
    mixed = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    at = of.join(mixed, "key").select("key", "id", "comp", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part"))
    # a bucket beyond BLOCK members is compared block by block
    at = at.select("key", "id", "comp", "part", F.explode(F.expr("transform(sequence(0, blocks - 1), j -> struct(least(part, j) AS p, greatest(part, j) AS q))")).alias("at"))
    rows = at.join(nodes, "id").select("key", "at.p", "at.q", "id", "n", "comp", "bands", "sig", "part")
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    # round one has tested pairs with the lesser id first
    second = written(_crossed(rows, least, percent).alias("s").join(tested.alias("t"), F.expr("least(s.a, s.b) = t.a AND greatest(s.a, s.b) = t.b"), "left_anti"), "second")
    dropped(nodes, tested, of)
    more = written(verified(second, texts, words, percent), "more")
    if not more.isEmpty():
        before = classes
        classes = written(fewer_files(connected_components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))), "classes")
        dropped(before)
    dropped(second, more)
    ends = members.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    every = counts.join(ends, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return fewer_files(every.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def without_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 75, miss: float = 1e-4) -> DataFrame:
    """All columns of the rows that ``near_dedup`` keeps: one document of each class, the one with the
    least id, and all rows with a null id. Rows that are surely kept are passed on where they are; only
    those whose id may be a dropped one meet the list of these."""
    gone = written(fewer_files(near_dedup(docs, text, doc_id, words, percent, miss).where("NOT kept").select(F.col("doc_id").alias("_gone_")).distinct()), "gone")
    rows = marked(docs, F.col(doc_id), key_filter(gone, F.col("_gone_")), "_maybe_")
    left = rows.where("_maybe_").join(gone, F.col(doc_id) == F.col("_gone_"), "left_anti")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.where("NOT _maybe_").select(*names).unionByName(left.select(*names))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT i, j FROM inter JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT i AS a, j AS b FROM link UNION ALL SELECT j, i FROM link),
reach(doc_id, r) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = r),
least AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.c, d.doc_id) AS component_id, coalesce(least.c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

__all__ = ["features", "least_matches", "near_dedup", "shingles", "signature", "survivors", "without_near_copies"]
