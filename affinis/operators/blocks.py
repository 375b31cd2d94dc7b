"""Sums over pairs of entities, formed where they are needed: no pair is ever shuffled.

The cells of each dimension make one list, sorted by entity. Entities are cut into blocks of about
equal work by ranges, and a list goes to each block that holds one of its entities, from its first
one there on. A task then forms all pairs whose lesser entity lies in its block and adds them up by
sorting, PAIRS at a time, so its memory hangs on neither the block nor the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions.pearson import FIELD_BITS, FIELD_MASK
from affinis.sources.shared import fresh, freed, kept, leaf_bytes, spent, unmarked

#: Pairs formed at once in a task; work that makes a block, and least work where blocks are few. The
#: work of a cell is its partners and CELL more.
PAIRS, BLOCK_WORK, LEAST_WORK, CELL = 1 << 20, 1 << 24, 1 << 19, 16
#: Sampled cells a block; they only set the bounds of blocks.
SAMPLE = 64
#: Cells of an Arrow batch, about.
CELLS = 1 << 18
#: Bytes of written rows whose lists are formed in one turn.
TURN = 256 << 20
SUMS = "n long, sx double, sy double, sxx double, syy double, sxy double"
FORMS = {"f64": SUMS, "i32": SUMS, "packed": SUMS, "centred": "n long, c double, a double, b double"}


def takes(ratings: DataFrame) -> bool:
    """Whether values are of a type whose sums are doubles."""
    return isinstance(ratings.schema["v"].dataType, (T.DoubleType, T.FloatType))


def _lists(ratings: DataFrame, shards: int) -> DataFrame:
    """(shard, es, vs, olds): the cells of each dimension with two and more, sorted by entity."""
    shard = F.pmod(F.xxhash64("d"), F.lit(shards)).cast("int").alias("shard") if shards > 1 else F.lit(0).alias("shard")
    cell = F.struct("e", F.col("v").cast("double").alias("v"), *(["old"] if "old" in ratings.columns else []))
    cells = ratings.where("e IS NOT NULL AND d IS NOT NULL").repartition("d")
    each = cells.groupBy("d").agg(F.sort_array(F.collect_list(cell)).alias("l")).where(F.size("l") > 1)
    return each.select(shard, F.col("l.e").alias("es"), F.col("l.v").alias("vs"), (F.col("l.old") if "old" in ratings.columns else F.lit(None).cast("array<boolean>")).alias("olds"))


def _stored(ratings: DataFrame, shards: int) -> DataFrame:
    """The lists, written. Where rows come from written tables alone, dimensions take turns, so that
    the shuffle of one turn goes before the next."""
    files = ratings.inputFiles()
    turns = max(1, -(-sum(leaf_bytes(ratings)) // TURN)) if files and all("/affinis/triples-" in f for f in files) else 1
    if turns == 1:
        out = kept(_lists(ratings, shards), "lists")
    else:
        path, turn = fresh(ratings.sparkSession, "lists"), F.pmod(F.xxhash64("d", F.lit(1)), F.lit(turns))
        for t in range(turns):
            df = _lists(ratings.where(turn == t), shards)
            unmarked(df, "append").parquet(path)
            freed(ratings.sparkSession)
        out = ratings.sparkSession.read.schema(df.schema).parquet(path)
    spent(ratings)
    return out


def _bounds(lists: DataFrame) -> tuple[list, int]:
    """The least entities of all blocks but the first, and the number of blocks."""
    spark = lists.sparkSession
    size = F.size("es").cast("long")
    pairs, cells = lists.agg(F.coalesce(F.sum(size * (size - 1) / 2), F.lit(0.0)), F.coalesce(F.sum(size), F.lit(0))).first()
    work = int(pairs) + CELL * cells
    blocks = max(-(-work // BLOCK_WORK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-work // LEAST_WORK)), 1)
    if blocks == 1:
        return [], 1
    share = min(1.0, SAMPLE * blocks / cells)
    at = lists.select(size.alias("m"), F.posexplode("es").alias("at", "e")).where(F.rand(7) < share)
    rows = at.select("e", (F.col("m") - 1 - F.col("at") + CELL).cast("double").alias("w")).orderBy("e").collect()
    ends = np.cumsum([r.w for r in rows]) if rows else np.zeros(0)
    cuts = np.searchsorted(ends, ends[-1] * np.arange(1, blocks) / blocks) if rows else []
    found = [rows[c].e for c in cuts]
    return [b for k, b in enumerate(found) if not k or b != found[k - 1]], blocks


def _codes(flat) -> tuple[np.ndarray, object]:
    """Ranks of the values of an Arrow array, and the values in order."""
    import pyarrow.compute as pc

    coded = flat.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


def _split(bounds: list):
    """Lists -> (block, take, shard, es, vs, olds): from the first entity of each block on; the first
    ``take`` cells are those of the block."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            shard, es, vs, olds = (b.column(c) for c in range(4))
            flat = es.flatten()
            sizes = np.diff(np.asarray(es.offsets))
            if not len(flat):
                continue
            if bounds:
                edge = pa.array(bounds, flat.type)
                codes, values = _codes(pa.concat_arrays([flat, edge]))
                cells, marks = codes[: len(flat)], codes[len(flat) :]
                block = np.searchsorted(marks, cells, side="right")
            else:
                block = np.zeros(len(flat), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.cumsum(sizes)
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
            take = np.diff(np.r_[first, len(flat)])
            left = ends[row[first]] - first
            useful = left > 1
            first, take, left = first[useful], take[useful], left[useful]
            # cells of a batch are bounded, whatever the number of blocks of a list
            upto = np.cumsum(left)
            for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(upto // CELLS)) + 1):
                if len(part):
                    n = left[part]
                    offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                    at = pa.array(np.repeat(first[part] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()))
                    lists = [pa.ListArray.from_arrays(offsets, a.take(at)) for a in (flat, vs.flatten())]
                    old = pa.ListArray.from_arrays(offsets, olds.flatten().take(at)) if olds.null_count < len(olds) else pa.nulls(len(part), olds.type)
                    yield pa.RecordBatch.from_arrays([pa.array(block[first[part]].astype(np.int32)), pa.array(take[part].astype(np.int32)), shard.take(pa.array(row[first[part]])), *lists, old], names=["block", "take", "shard", "es", "vs", "olds"])

    return run


def _words(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    x, y = x.astype(np.int64), y.astype(np.int64)
    one = np.int64(1 << 2 * FIELD_BITS)
    return [one | x << FIELD_BITS | y, (x * x) << 2 * FIELD_BITS | (y * y) << FIELD_BITS | x * y]


def _terms(x: np.ndarray, y: np.ndarray, form: str) -> list[np.ndarray]:
    """What is added up over the dimensions of a pair, besides their number."""
    if form == "packed":
        return _words(x, y)
    if form == "i32":
        x, y = x.astype(np.int32).astype(np.int64), y.astype(np.int32).astype(np.int64)
    return [x, y, x * x, y * y, x * y]


def _added(keys: list[np.ndarray], columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places where the sorted keys begin anew, and the sums of the columns from there on."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return at, [np.add.reduceat(c, at) if len(at) else c for c in columns]


class _Block:
    """The lists of one block, and the pairs whose lesser entity lies in it."""

    def __init__(self, batches: list, form: str, least: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pa.Table.from_batches(batches).combine_chunks()
        col = lambda n: pa.concat_arrays(whole.column(n).chunks)
        es = col("es")
        self.form, self.least = form, least
        self.code, self.names = _codes(es.flatten())
        self.v = col("vs").flatten().to_numpy(zero_copy_only=False)
        sizes = np.asarray(pc.list_value_length(es)).astype(np.int64)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        self.shard = np.repeat(np.asarray(col("shard")), sizes)
        olds = col("olds")
        self.old = olds.flatten().to_numpy(zero_copy_only=False).astype(bool) if olds.null_count < len(olds) else None
        # partners of a cell: from the end of its run of one entity to the end of its list
        run = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (self.code[1:] != self.code[:-1])])
        run_end = np.repeat(np.r_[run[1:], len(row)], np.diff(np.r_[run, len(row)]))
        self.end, self.start = ends[row], run_end
        left = np.flatnonzero(np.arange(len(row)) - np.repeat(ends - sizes, sizes) < np.repeat(np.asarray(col("take")).astype(np.int64), sizes))
        left = left[self.end[left] > self.start[left]]
        self.left = left[np.argsort(self.code[left], kind="stable")]

    def pairs(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the pairs of some lesser cells, by key of the pair and shard."""
        n = self.end[cells] - self.start[cells]
        total = np.cumsum(n)
        li = np.repeat(cells, n)
        ri = np.arange(total[-1]) + np.repeat(self.start[cells] - (total - n), n)
        if self.old is not None:
            fresh = ~(self.old[li] & self.old[ri])
            li, ri = li[fresh], ri[fresh]
        return li, ri

    def sums(self, cells: np.ndarray, least: int) -> list[np.ndarray]:
        """(i, j, n, terms) of all pairs of at least ``least`` dimensions."""
        li, ri = self.pairs(cells)
        key = self.code[li] * len(self.names) + self.code[ri]
        order = np.lexsort((self.shard[li], key)) if self.shard[li[:1]].size and (self.shard[0] != self.shard).any() else np.argsort(key, kind="stable")
        key = key[order]
        at, _ = _added([key], [])
        n = np.diff(np.r_[at, len(key)])
        many = n >= least
        inside = np.repeat(many, n)
        key, li, ri = key[inside], li[order[inside]], ri[order[inside]]
        x, y = self.v[li], self.v[ri]
        n = n[many]
        if self.form == "centred":
            at = np.cumsum(n) - n
            dx, dy = (c - np.repeat(np.add.reduceat(c, at) / n if len(at) else n, n) for c in (x, y))
            return [*np.divmod(key[at], len(self.names)), n, *_added([key], [dx * dy, dx * dx, dy * dy])[1]]
        # partial sums of each shard in the form of the payload, then their sums
        at, part = _added([key, self.shard[li]], _terms(x, y, self.form))
        key = key[at]
        at, part = _added([key], part)
        return [*np.divmod(key[at], len(self.names)), n, *part]

    def all(self) -> Iterator[list[np.ndarray]]:
        """Sums of whole entities, about PAIRS pairs at a time; one of more pairs is cut and merged."""
        work = np.cumsum(self.end[self.left] - self.start[self.left])
        code = self.code[self.left]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        upto = np.r_[starts[1:], len(code)] if len(code) else starts
        k = 0
        while k < len(starts):
            done = work[starts[k] - 1] if starts[k] else 0
            last = max(k + 1, int(np.searchsorted(work[upto - 1], done + PAIRS, side="right")))
            cells = self.left[starts[k] : upto[last - 1]]
            if work[upto[last - 1] - 1] - done <= PAIRS:
                yield self.sums(cells, self.least)
            else:
                yield self.cut(cells)
            k = last

    def cut(self, cells: np.ndarray) -> list[np.ndarray]:
        """Sums of one entity, by parts of its pairs that are merged."""
        parts = np.split(cells, np.flatnonzero(np.diff(np.cumsum(self.end[cells] - self.start[cells]) // PAIRS)) + 1)
        if self.form != "centred":
            whole = self.merged(self.sums(part, 0) for part in parts)
        else:
            self.form = "f64"
            i, j, n, sx, sy, *_ = self.merged(self.sums(part, 0) for part in parts)
            self.form = "centred"
            mx, my = np.zeros((2, len(self.names)))
            mx[j], my[j] = sx / n, sy / n
            whole = self.merged(self.deviations(part, mx, my) for part in parts)
        return [c[whole[2] >= self.least] for c in whole]

    def deviations(self, cells: np.ndarray, mx: np.ndarray, my: np.ndarray) -> list[np.ndarray]:
        """(i, j, n, c, a, b) of pairs of one entity, about given means."""
        li, ri = self.pairs(cells)
        order = np.argsort(self.code[ri], kind="stable")
        li, ri = li[order], ri[order]
        j = self.code[ri]
        dx, dy = self.v[li] - mx[j], self.v[ri] - my[j]
        at, added = _added([j], [np.ones(len(j), np.int64), dx * dy, dx * dx, dy * dy])
        return [self.code[li[at]], j[at], *added]

    @staticmethod
    def merged(parts) -> list[np.ndarray]:
        whole = None
        for one in parts:
            if whole is not None:
                both = [np.concatenate(c) for c in zip(whole, one, strict=True)]
                order = np.argsort(both[1], kind="stable")
                both = [c[order] for c in both]
                at, added = _added([both[1]], both[2:])
                one = [both[0][at], both[1][at], *added]
            whole = one
        return whole

    def batches(self, names: list[str]) -> Iterator:
        import pyarrow as pa

        for i, j, n, *terms in self.all():
            if self.form == "packed":
                w0, w1 = terms
                terms = [(w >> s * FIELD_BITS) & FIELD_MASK for w in (w0, w1) for s in (2, 1, 0)][1:]
            values = [pa.array(n.astype(np.int64)), *(pa.array(c.astype(np.float64)) for c in terms)]
            out = pa.RecordBatch.from_arrays([self.names.take(pa.array(i)), self.names.take(pa.array(j)), *values], names=names)
            for lo in range(0, len(n), 1 << 16):
                yield out.slice(lo, 1 << 16)


def _sum(form: str, least: int, names: list[str]):
    def run(batches) -> Iterator:
        import pyarrow as pa

        held, now = [], None
        for b in batches:
            block = np.asarray(b.column(0))
            cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and block[lo] != now:
                    yield from _Block(held, form, least).batches(names)
                    held = []
                now = block[lo]
                one = b.slice(lo, hi - lo)
                held.append(pa.RecordBatch.from_arrays([_own(c) for c in one.columns], names=one.schema.names))
        if held:
            yield from _Block(held, form, least).batches(names)

    return run


def _own(column):
    """The rows of a slice alone, without what else its batch holds."""
    import pyarrow as pa

    return pa.concat_arrays([column]) if column.offset == 0 else column.take(pa.array(np.arange(len(column))))


def pair_sums(ratings: DataFrame, least: int, form: str = "f64", shards: int = 1) -> DataFrame:
    """(i, j, ...) of pairs i < j with at least ``least`` shared dimensions: the six sums, in doubles;
    centred: n and the sums c, a, b of products of deviations from the pair's means.

    ``ratings`` (e, d, v) without null values. With a column ``old``, pairs of two old cells are left
    out. Lists are written into the shared folder, so this runs jobs at once."""
    lists = _stored(ratings, shards)
    bounds, blocks = _bounds(lists)
    kind = ratings.schema["e"].dataType
    fields = {f.name: f.dataType for f in lists.schema.fields}
    part = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("take", T.IntegerType()), T.StructField("shard", T.IntegerType()), *(T.StructField(c, fields[c]) for c in ("es", "vs", "olds"))])
    dealt = lists.mapInArrow(_split(bounds), part).repartition(blocks, "block").sortWithinPartitions("block")
    out = T.StructType([T.StructField("i", kind), T.StructField("j", kind), *T.StructType.fromDDL(FORMS[form]).fields])
    return dealt.mapInArrow(_sum(form, least, out.names), out)
