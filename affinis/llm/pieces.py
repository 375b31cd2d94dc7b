"""SentencePiece encoding as a relational lattice.

1. Texts are escaped and cut into chunks where no piece of the model can reach across (at blanks,
   and between letters, digits and other signs if the model's pieces allow it). The chunks of each block
   of texts are listed once. Distinct ones are counted over the whole table, so all further work is
   done once for each of them.
2. Every chunk is exploded into its substrings of bounded length, which are equi-joined to the piece
   table. The matches are the edges of the chunk's lattice, grouped by chunk. The join side that is
   broadcast is the piece table, whose size the model fixes.
3. Higher-order aggregates fold each lattice to a path, which is kept as one number: a bit for each
   boundary between pieces. ``viterbi`` finds the path of the best total score (what a unigram model
   asks for). ``merge`` finds the path that a BPE model asks for: it joins the best-scored adjacent
   pair again and again. Both paths are there for every chunk; the model file says which one gives
   ``ids``.
4. Documents are put together from the chunks, in blocks of bounded size. Paths of frequent chunks
   come from a broadcast table of fixed size. All others are joined by chunk and sent to the blocks
   that hold them, where they meet the block's documents and become ids. Texts are cut, looked up and
   joined a block at a time, in columns.

A block is named by its place in the scan. Where a scan deals its rows otherwise when it is read
again, a block misses paths and folds those chunks by itself, with the same result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property
from struct import pack

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.common import dropped, fewer_files, numbers, ragged, small_batches, written
from affinis.sources.shared import freed

BLANK = "▁"
LONGEST = 34  # code points of a chunk that is folded in SQL; cost and boundaries of a path fit a bigint
PART = 4_000  # chunks whose lattices one partition holds
HOT = 131_072  # entries of the broadcast table of frequent chunks
BLOCK = 8 << 20  # code points of the documents that are put together at once
COUNTED = 1 << 19  # chunks of blocks that a task counts at once
ROWS = 1 << 20  # paths that a task packs at once
SENT = 256  # rows of one batch of results
LEVEL = 3  # of compression of the texts that are sent to their blocks
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
COARSE = re.compile(rf"{BLANK}*[^{BLANK}]+|{BLANK}+")
END = "\U0010ffff"  # ends a chunk while units are cut in columns


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    unknown: int
    bytes_: list[int]  # id of each byte piece, or nothing
    algorithm: str
    prefix: bool = True
    ids: dict[str, int] = field(default_factory=dict)  # pieces that stand for text

    @cached_property
    def widest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def cutter(self) -> re.Pattern:
        """Chunks of the escaped text: a run of letters, one digit, or a run of other signs, each with
        the blanks before it. If a piece reaches across such a cut, chunks end at blanks only."""
        # signs that count as word characters but are no letters (as superscripts) go with the signs
        odd = "".join(sorted(c for c in set().union(*self.ids) if re.fullmatch(r"[^\W\d_]", c) and not c.isalpha()))
        letters, signs, control = rf"[^\W\d_{odd}]+", rf"(?:[^{BLANK}\w\x00-\x0c\x0e-\x1f]|[_{odd}])+", r"[\x00-\x0c\x0e-\x1f]"
        fine = re.compile(rf"{BLANK}*{letters}|{BLANK}*\d|{BLANK}*{signs}|{BLANK}+|{control}")
        whole = re.compile(rf"{BLANK}*(?:{letters}|\d|{signs}|{control})?")
        return fine if all(whole.fullmatch(p) for p in self.ids) else COARSE

    @cached_property
    def column_cutter(self) -> str:
        """The cutter for columns, whose regular expressions know other tables of letters: the kinds of
        all signs of two bytes are asked of Python and written out."""
        if self.cutter is COARSE:
            return f"{BLANK}*[^{BLANK}]+|{BLANK}+"
        spans: dict[str, list[list[int]]] = {"letters": [], "digit": [], "signs": [], "control": []}
        for c in (c for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and chr(c) != BLANK):
            kind = "control" if c < 32 and c != 13 else "digit" if re.fullmatch(r"\d", chr(c)) else "signs" if len(self.cutter.findall(f"!{chr(c)}")) == 1 else "letters"
            if spans[kind] and spans[kind][-1][1] == c - 1:
                spans[kind][-1][1] = c
            else:
                spans[kind].append([c, c])
        letters, digit, signs, control = ("[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans[k]) + "]" for k in spans)
        return f"{BLANK}*{letters}+|{BLANK}*{digit}|{BLANK}*{signs}+|{BLANK}+|{control}"

    @cached_property
    def penalty(self) -> float:
        """Score of a code point that is no piece, as the library sets it."""
        return min((self.scores[i] for i in self.ids.values()), default=0.0) - 10


def load(path: str = DEFAULT_MODEL) -> Model:
    """Read a SentencePiece model file. Models whose normaliser rewrites text are refused, because
    decoding could not give the text back."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with identity normalisation are supported")
    kinds = [p.type for p in proto.pieces]
    if any(k == 4 for k in kinds):
        raise ValueError("user-defined pieces are not supported")
    text = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
    if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in text):
        raise ValueError("pieces with a blank inside are not supported")
    return Model([p.piece for p in proto.pieces], [p.score for p in proto.pieces], kinds.index(2), [i for i, k in enumerate(kinds) if k == 6], "merge" if proto.trainer_spec.model_type == 2 else "viterbi", proto.normalizer_spec.add_dummy_prefix, text)


def escaped(text: str | None, prefix: bool = True) -> str:
    return ((BLANK if prefix else "") + text.replace(" ", BLANK)) if text else ""


def _spelled(ch: str, m: Model) -> list[int]:
    return [m.bytes_[b] for b in ch.encode("utf-8", "surrogatepass")] if m.bytes_ else [m.unknown]


def bounds_viterbi(chunk: str, m: Model) -> list[int]:
    """Boundaries of the best path of one chunk, in Python; for chunks beyond LONGEST, and as a check
    of the fold. Of equal paths the one with the longest last piece stays, as in the library."""
    n, widest, penalty, ids, scores = len(chunk), m.widest, m.penalty, m.ids, m.scores
    best = [0.0] + [-np.inf] * n
    back = [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - widest), e):
            i = ids.get(chunk[s:e])
            w = scores[i] if i is not None else penalty if e - s == 1 else None
            if w is not None and best[s] + w > best[e]:
                best[e], back[e] = best[s] + w, s
    out = [n]
    while n:
        n = back[n]
        out.append(n)
    return out[::-1]


def bounds_merge(chunk: str, m: Model) -> list[int]:
    """Boundaries after best-first merging of one chunk with a priority queue, in Python."""
    import heapq

    parts = list(chunk)
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    queue: list[tuple[float, int, int, str]] = []

    def offer(i):
        j = right[i]
        if j < len(parts):
            k = m.ids.get(parts[i] + parts[j])
            if k is not None:
                heapq.heappush(queue, (-m.scores[k], i, j, parts[i] + parts[j]))

    for i in range(len(parts)):
        offer(i)
    while queue:
        _, i, j, both = heapq.heappop(queue)
        if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, ""
        right[i] = right[j]
        if right[i] < len(parts):
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [i for i, p in enumerate(parts) if p] + [len(chunk)]


def ids_at(chunk: str, bounds: list[int], m: Model) -> list[int]:
    """The ids of the pieces between the boundaries."""
    out: list[int] = []
    for s, e in zip(bounds, bounds[1:], strict=False):
        i = m.ids.get(chunk[s:e])
        out += [i] if i is not None else _spelled(chunk[s:e], m)
    return out


def fold_viterbi(chunk: str, m: Model) -> list[int]:
    return ids_at(chunk, bounds_viterbi(chunk, m), m)


def fold_merge(chunk: str, m: Model) -> list[int]:
    return ids_at(chunk, bounds_merge(chunk, m), m)


# --- the lattice --------------------------------------------------------------------------------


def words_of(text: str, m: Model) -> tuple[list[str], list[str]]:
    """The text at its blanks: words that have one blank before them (without it), and pieces of the
    escaped text. Chunks never go on behind a blank, so words can be cut one by one."""
    words = text.split(" ")
    if "" not in words:
        if m.prefix:
            return words, []
        return words[1:], words[:1]
    return [], COARSE.findall(escaped(text, m.prefix))


def _stem(w: str) -> str | None:
    """The letters of a word of letters and one ASCII sign or digit at its end."""
    return w[:-1] if w[-1:] < "\x80" and not w[-1:].isalpha() and w[:-1].isalpha() else None


def cut_word(m: Model):
    """A function that gives the chunks of a word with one blank before it: what the cutter finds, with
    short ways for letters alone, and for letters before one ASCII sign or digit."""
    find = m.cutter.findall
    if m.cutter is COARSE:
        return lambda w: find(BLANK + w)

    def cut(w: str) -> list[str]:
        if w.isalpha():
            return [BLANK + w]
        stem = _stem(w)
        return find(BLANK + w) if stem is None else [BLANK + stem, w[-1]]

    return cut


def units(column, m: Model):
    """(units, at, counts) of a column of texts: the distinct words of their escaped forms with the
    blanks before them, the places of all words among these, and how many words each text has. Chunks
    never go on behind a blank, so words can be cut one by one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = column.fill_null("")
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    at, counts = coded.indices.to_numpy(), parts.value_lengths().to_numpy()
    words = pc.binary_join_element_wise(pa.scalar(BLANK), coded.dictionary, "")
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    odd = np.full(len(texts), not m.prefix)  # without a prefix the first word has no blank before it
    if empty.any():
        odd |= np.add.reduceat(empty[at], np.cumsum(counts) - counts) > 0
    if not odd.any():
        return words, at, counts
    # blanks in a row, and texts that are empty
    lists = [COARSE.findall(escaped(texts[i].as_py(), m.prefix)) for i in np.flatnonzero(odd).tolist()]
    own = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
    normal, counts = at[np.repeat(~odd, counts)], counts.copy()
    counts[odd] = list(map(len, lists))
    tag = np.repeat(odd, counts)
    at = np.empty(len(tag), np.int64)
    at[~tag], at[tag] = normal, own.indices.to_numpy() + len(words)
    used = np.bincount(at, minlength=len(words) + len(own.dictionary)) > 0
    return pa.concat_arrays([words, own.dictionary]).filter(pa.array(used)), (np.cumsum(used) - 1)[at], counts


def cut_units(found, m: Model):
    """(chunks, counts): the chunks of a column of units, and how many each has. What the cutter finds."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.split_pattern(pc.replace_substring_regex(found, m.column_cutter, rf"\0{END}"), END)
    counts = parts.value_lengths().to_numpy()
    slow = pc.match_substring_regex(found, r"[\x{10000}-\x{10ffff}]").to_numpy(zero_copy_only=False)
    mine = np.repeat(~slow, counts)
    mine[np.cumsum(counts) - 1] = False  # what stands behind the end of the last chunk
    chunks, counts = parts.flatten().filter(pa.array(mine)), counts - 1
    if slow.any():
        lists = [m.cutter.findall(u) for u in found.filter(pa.array(slow)).to_pylist()]
        counts[slow] = list(map(len, lists))
        tag = np.repeat(slow, counts)
        order = np.empty(len(tag), np.int64)
        order[~tag], order[tag] = np.arange(len(chunks)), len(chunks) + np.arange(tag.sum())
        chunks = pa.concat_arrays([chunks, pa.array([c for x in lists for c in x], pa.string())]).take(pa.array(order))
    return chunks, counts


def block_chunks(rows: DataFrame, m: Model) -> DataFrame:
    """(block, data): the distinct chunks of each block of texts with their counts, packed. ``rows``: texts
    and the numbers of their partitions."""
    import pyarrow as pa

    small_batches(rows.sparkSession)
    m.column_cutter  # noqa: B018 - found here, once, and not in every task

    def run(batches):
        for block, held in _blocks(batches, 0):
            found, at, _ = units(pa.concat_arrays([b.column(0) for b in held]), m)
            chunks, counts = cut_units(found, m)
            chunks, n = _summed(chunks, np.repeat(np.bincount(at, minlength=len(found)), counts))
            if len(chunks):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed_chunks(chunks, [n])], pa.binary())], names=["block", "data"])

    return rows.mapInArrow(run, "block long, data binary")


def _summed(chunks, n: np.ndarray):
    """The distinct chunks of a column, and the sums of their numbers."""
    coded = chunks.dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), n, len(coded.dictionary)).astype(np.int64)


def chunk_counts(lists: DataFrame, flush: int = COUNTED) -> DataFrame:
    """(chunk, n): distinct chunks of all blocks with their counts, combined in each task first."""
    import pyarrow as pa

    def run(batches):
        held: list = []

        def out():
            made = _summed(pa.concat_arrays([c for c, _ in held]), np.concatenate([n for _, (n,) in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([made[0], pa.array(made[1])], names=["chunk", "n"])

        size = 0
        for b in batches:
            for data in b.column(0):
                held.append(unpacked_chunks(data.as_py()))
                size += len(held[-1][0])
                if size >= flush:
                    yield out()
                    size = 0
        if held:
            yield out()

    return lists.select("data").mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


#: An edge is one bigint: end . start (6 bits each) . late (1 bit) . rank (29 bits, the lower the
#: better). Packed edges sort by their end and then by their start.
END_AT, START_AT, LATE_AT = 36, 30, 29
RANKS = (1 << LATE_AT) - 1
#: A path is one bigint, with a bit for each boundary; with integer scores its cost stands above.
COST = LONGEST + 1
PATHS = (1 << COST) - 1


def ranks(m: Model) -> tuple[dict[str, int], int, list[float]]:
    """(rank of each piece, rank of an unknown code point, score of each rank or nothing).

    If scores are integers, ranks are costs that add up and order paths as the scores do. Scores far
    below all others (as of pieces that training did not score) keep their distance from each other
    and stay worse than any path without them, but come so near that sums fit a path's number."""
    own = {p: m.scores[i] for p, i in m.ids.items()}
    order = sorted({*own.values(), m.penalty}, reverse=True)
    if all(v == int(v) and v <= 0 for v in order):
        cost = [int(-v) for v in order]
        i = max(range(len(cost) - 1), key=lambda i: cost[i + 1] - cost[i], default=0)
        near = LONGEST * (cost[i] + cost[-1] - cost[min(i + 1, len(cost) - 1)]) + 1
        less = max(0, cost[min(i + 1, len(cost) - 1)] - near)
        rank = {v: c - (less if k > i else 0) for k, (v, c) in enumerate(zip(order, cost, strict=True))}
        if LONGEST * rank[m.penalty] < 2 ** (63 - COST):
            return {p: rank[v] for p, v in own.items()}, rank[m.penalty], []
    at = {v: k for k, v in enumerate(order)}
    return {p: at[v] for p, v in own.items()}, at[m.penalty], order


def late_pieces(m: Model) -> set[str]:
    """Pieces that two neighbours make of which one has a lesser score than the piece: merging them
    can become possible after worse pieces have been made."""
    own = {p: m.scores[i] for p, i in m.ids.items()}
    later = lambda part, v: len(part) > 1 and part in own and own[part] <= v
    whole = lambda part: len(part) == 1 or part in own
    return {p for p, v in own.items() if any(whole(p[:k]) and whole(p[k:]) and (later(p[:k], v) or later(p[k:], v)) for k in range(1, len(p)))}


def lattices(chunks: DataFrame, m: Model) -> DataFrame:
    """(chunk, n, edges): packed edges in order of end and start; code points that are no piece have
    an edge of their own. ``chunks`` must be dealt by chunk: then neither the explode, the join nor
    the grouping moves rows."""
    spark = chunks.sparkSession
    rank, lost, _ = ranks(m)
    late = late_pieces(m)
    table = spark.createDataFrame([(p, (p in late) << LATE_AT | rank[p]) for p in m.ids], "piece string, code long")
    # two plain explodes, so that substrings are cut in generated code and not in a lambda
    starts = chunks.where(F.length("chunk") <= LONGEST).select("chunk", "n", F.explode(F.expr("sequence(0, length(chunk) - 1)")).alias("s"))
    spans = starts.select("chunk", "n", "s", F.explode(F.expr(f"sequence(1, least({m.widest}, length(chunk) - s))")).alias("l"))
    place = F.expr(f"shiftleft(cast(s AS bigint), {START_AT}) | shiftleft(cast(s + l AS bigint), {END_AT})").alias("place")
    sub = spans.select("chunk", "n", place, "l", F.expr("substring(chunk, s + 1, l)").alias("piece"))
    edge = F.coalesce("code", F.lit(lost)).bitwiseOR(F.col("place"))
    return sub.join(F.broadcast(table), "piece", "left").where("code IS NOT NULL OR l = 1").groupBy("chunk").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(edge)).alias("edges"))


def viterbi_path(m: Model) -> Column:
    """Fold of ``edges`` to the path of the best total score; of equal paths the one with the longest
    last piece stays. ``done`` holds the best path to every settled position, ``now`` the best one so
    far to the position in hand."""
    e, s, rank = f"cast(shiftright(x, {END_AT}) AS int)", f"cast(shiftright(x, {START_AT}) & 63 AS int)", f"(x & {RANKS})"
    order = ranks(m)[2]
    if not order:  # of two paths with equal costs, the lesser number has the longer last piece
        cost = f"shiftleft({rank}, {COST})"
        settled = "a.now + shiftleft(1L, size(a.done))"
        step = f"""if(shiftright(x, {END_AT}) > size(a.done), named_struct('done', concat(a.done, array({settled})), 'now', coalesce(get(a.done, {s}), {settled}) + {cost}),
            if(get(a.done, {s}) + {cost} < a.now, named_struct('done', a.done, 'now', get(a.done, {s}) + {cost}), a))"""
        return F.expr(f"aggregate(edges, named_struct('done', array(1L), 'now', {2**63 - 1}L), (a, x) -> {step}, a -> (a.now & {PATHS}L) | shiftleft(1L, length(chunk)))")
    score = f"get(array({', '.join(f'{v!r}D' for v in order)}), cast({rank} AS int))"
    end = f"shiftleft(1L, {e})"
    grown = "CASE WHEN {e} > size(a.done) THEN concat(a.done, array(named_struct('score', a.score, 'path', a.path))) ELSE a.done END".format(e=e)
    step = f"""CASE WHEN {e} > size(a.done) THEN element_at(transform(array({grown}), d -> named_struct('done', d, 'score', get(d, {s}).score + {score}, 'path', get(d, {s}).path | {end})), 1)
        WHEN get(a.done, {s}).score + {score} > a.score THEN named_struct('done', a.done, 'score', get(a.done, {s}).score + {score}, 'path', get(a.done, {s}).path | {end}) ELSE a END"""
    return F.expr(f"aggregate(edges, named_struct('done', array(named_struct('score', 0.0D, 'path', 1L)), 'score', -1.7e308D, 'path', 0L), (a, x) -> {step}, a -> a.path)")


def merge_path(m: Model) -> Column:
    """Fold of ``edges`` to the path that best-first merging leaves. An edge can be merged if both its
    ends are boundaries and one boundary lies between them.

    One pass over the edges in order of rank does it, unless a merge makes an edge possible whose turn
    is over. Only late edges can be such; where one is, the path becomes -1 and a fold that looks for
    the best edge before every merge takes over."""
    # edges as numbers of rank . start (6 bits) . late (1 bit) . end (6 bits), in that order
    order = f"sort_array(transform(filter(edges, x -> shiftright(x, {END_AT}) - (shiftright(x, {START_AT}) & 63) > 1), x -> shiftleft(x & {RANKS}, 13) | shiftleft(shiftright(x, {LATE_AT}) & 127, 6) | shiftright(x, {END_AT})))"
    s, e = "cast(shiftright({0}, 7) & 63 AS int)", "cast({0} & 63 AS int)"
    ends = f"(shiftleft(1L, {s}) | shiftleft(1L, {e}))"
    inner = f"(shiftleft(1L, {e}) - shiftleft(2L, {s}))"
    can = lambda path, y: f"({path} & {ends.format(y)}) = {ends.format(y)} AND bit_count({path} & {inner.format(y)}) = 1"
    late = "filter(js, y -> (y & 64) > 0)"
    start = "shiftleft(1L, length(chunk) + 1) - 1L"
    merged = f"path & ~{inner.format('y')}"
    step = f"if(path >= 0 AND {can('path', 'y')}, if(size(late) > 0 AND exists(late, z -> z < y AND {can('(' + merged + ')', 'z')}), -1L, {merged}), path)"
    slow = f"""aggregate(sequence(1, greatest(length(chunk) - 1, 1)), {start}, (path, k) -> path & ~coalesce(get(transform(slice(filter(js, y -> {can('path', 'y')}), 1, 1), y -> {inner.format('y')}), 0), 0L))"""
    fast = f"aggregate(array({late}), 0L, (o, late) -> aggregate(js, {start}, (path, y) -> {step}))"
    return F.expr(f"aggregate(array({order}), 0L, (o, js) -> CASE WHEN size(js) = 0 THEN {start} ELSE aggregate(array({fast}), 0L, (u, quick) -> CASE WHEN quick >= 0 THEN quick ELSE {slow} END) END)")


def bounds_of(path: int) -> list[int]:
    """The boundaries that the bits of a path stand for."""
    return [i for i in range(path.bit_length()) if path >> i & 1]


def dictionary(docs: DataFrame, m: Model, text: str = "text", both: bool = True, lists: DataFrame | None = None) -> DataFrame:
    """(chunk, n, merge, viterbi): every distinct chunk of at most LONGEST code points with its two
    paths; unless ``both``, the path that the model does not ask for is 0. Written to the shared folder.
    ``lists``: what ``block_chunks`` gives of the texts, where it is at hand."""
    spark = docs.sparkSession
    if lists is None:
        lists = block_chunks(docs.select(F.col(text), F.spark_partition_id()), m)
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key, None)
    counts = written(fewer_files(chunk_counts(lists)), "chunks")
    # partitions of a fixed number of chunks hold their edges in memory (beyond that the aggregate
    # sorts); the paths are so short that they go into few files
    spark.conf.set(key, str(2 * PART))
    try:
        dealt = counts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // PART)), "chunk")
        paths = {"merge": merge_path, "viterbi": viterbi_path}
        folded = lattices(dealt, m).select("chunk", "n", *((f(m) if both or k == m.algorithm else F.lit(0).cast("bigint")).alias(k) for k, f in paths.items()))
        out = written(fewer_files(folded.repartition("chunk")), "pieces")
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    dropped(counts)
    return out


# --- documents ----------------------------------------------------------------------------------


def _hot(pieces: DataFrame, most: int) -> DataFrame:
    """The most frequent chunks: at most ``most``, all of a count or none."""
    total, least = 0, None
    counts = pieces.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("m")).collect()
    for r in sorted(counts, reverse=True):
        total += r.m
        if total > most:
            break
        least = r.n
    return pieces.where(F.lit(False) if least is None else F.col("n") >= least)


class Coder:
    """Ids of texts from the ids of chunks, as bytes. One for each task. ``frequent``: columns of the
    frequent chunks and their ids (or nothing); what is learnt besides goes with its block."""

    def __init__(self, m: Model, frequent, both: bool):
        import pyarrow as pa

        self.m, self.both, self.find, self.cut = m, both, m.cutter.findall, cut_word(m)
        self.frequent = tuple(frequent) or (pa.array([], pa.string()), *(pa.array([], pa.binary()) for _ in range(2)))
        self.rare: dict[str, tuple[bytes, bytes]] = {}
        self.columns: list[tuple] = []

    def block(self) -> None:
        """A block begins: forget those before it."""
        self.rare.clear(), self.columns.clear()

    def learn(self, chunks: list[tuple[str, tuple[bytes, bytes]]]) -> None:
        """Take in the ids of a block's chunks."""
        self.rare.update(chunks)

    def learn_paths(self, data: bytes) -> None:
        """Take in chunks and their paths as ``packed_chunks`` gives them."""
        chunks, paths = unpacked_chunks(data)
        self.columns.append((chunks, *spelled_columns(chunks, paths, self.m, self.both)))

    def chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids of a chunk that no column has: it is folded here, unless it was before."""
        got = self.rare.get(chunk)
        if got is None:
            got = spelled(chunk, bounds_merge(chunk, self.m), bounds_viterbi(chunk, self.m) if self.both or self.m.algorithm == "viterbi" else [], self.m, self.both)
            self.rare[chunk] = got
        return got

    def text(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of the model's algorithm and of the other one, by the plain way: a check of ``texts``."""
        words, rest = words_of(text, self.m) if text else ([], [])
        got = [self.chunk(c) for w in rest for c in self.find(w)] + [self.chunk(c) for w in words for c in self.cut(w)]
        return b"".join([x[0] for x in got]), b"".join([x[1] for x in got])

    def texts(self, column) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many each text has) of a column of texts, for each algorithm that is asked for."""
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = np.dtype(id_kind(self.m))
        found, at, sizes = units(column, self.m)
        chunks, counts = cut_units(found, self.m)
        known = [pa.concat_arrays(x) for x in zip(self.frequent, *self.columns, strict=True)]
        place = pc.index_in(chunks, value_set=known[0])
        if place.null_count:
            lost = chunks.filter(place.is_null()).unique()
            own = [self.chunk(c) for c in lost.to_pylist()]
            known = [pa.concat_arrays([known[0], lost]), *(pa.concat_arrays([x, pa.array([o[k] for o in own], pa.binary())]) for k, x in enumerate(known[1:]))]
            place = pc.index_in(chunks, value_set=known[0])
        ends, whole = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(sizes))
        out = []
        for ids in known[1 : 3 if self.both else 2]:
            starts, data = _buffers(ids.take(place))
            each = pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(starts[ends].astype(np.int32)), pa.py_buffer(data)])
            starts, data = _buffers(each.take(pa.array(at)))
            out.append((data.view(kind).astype(np.int32), np.diff(starts[whole]) // kind.itemsize))
        return out


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(where each value begins and the last one ends, bytes) of a column of strings or bytes."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    return starts - starts[0], data


def spelled_columns(chunks, paths: list[np.ndarray], m: Model, both: bool):
    """Columns of the ids of chunks along the paths of the model's algorithm and of the other one; the
    other is empty unless ``both``. As ``spelled`` has them, for all chunks at once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = np.dtype(id_kind(m))
    starts, data = _buffers(chunks)
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # where code points begin
    first = np.searchsorted(heads, starts)  # the first code point of each chunk
    counts = np.diff(first)
    at = ragged(counts)
    value_set, own = pa.array(list(m.ids), pa.string()), np.array(list(m.ids.values()), np.int64)
    out = []
    for path in paths[: 2 if both else 1]:
        cuts = heads[(np.repeat(path, counts) >> at & 1) > 0]
        sizes = np.diff(np.append(cuts, len(data)))
        parts = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(data))
        place = pc.index_in(parts, value_set=value_set)
        lost = place.is_null().to_numpy(zero_copy_only=False)
        many = np.where(lost, sizes if m.bytes_ else 1, 1)
        ids = np.empty(many.sum(), kind)
        tag = np.repeat(lost, many)
        ids[~tag] = own[place.drop_null().to_numpy()] if len(own) else 0
        if lost.any():
            ids[tag] = np.array(m.bytes_)[data[np.repeat(cuts[lost], sizes[lost]) + ragged(sizes[lost])]] if m.bytes_ else m.unknown
        ends = np.append(0, np.cumsum(many))[np.searchsorted(cuts, starts)] * kind.itemsize
        out.append(pa.BinaryArray.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)]))
    return out if both else [*out, pa.array([b""] * len(chunks), pa.binary())]


def spelled(chunk: str, merge: list[int], viterbi: list[int], m: Model, both: bool) -> tuple[bytes, bytes]:
    """Ids of a chunk between the boundaries of the model's algorithm, and those of the other one."""
    one, two = (viterbi, merge) if m.algorithm == "viterbi" else (merge, viterbi)
    kind = "H" if len(m.pieces) <= 1 << 16 else "I"
    ids = ids_at(chunk, one, m)
    first = pack(f"<{len(ids)}{kind}", *ids)
    if not both or one == two:
        return first, first if both else b""
    ids = ids_at(chunk, two, m)
    return first, pack(f"<{len(ids)}{kind}", *ids)


def id_kind(m: Model) -> str:
    return "<u2" if len(m.pieces) <= 1 << 16 else "<u4"


def _blocks(batches, at: int):
    """(number of the block, its batches), each of about BLOCK code points in column ``at``; the next
    column holds the number of the partition. The block's number comes from the place of the rows in
    the scan, whatever the size of its batches."""
    import pyarrow.compute as pc

    held, size, k = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(at + 1)[0].as_py() << 24 if k is None else k
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            done = sizes[start - 1] if start else 0
            stop = int(np.searchsorted(sizes, done + BLOCK - size)) + 1  # the row that fills the block
            held.append(b.slice(start, stop - start))
            if stop <= b.num_rows:
                yield k, held
                held, size, k = [], 0, k + 1
            else:
                size += int(sizes[-1] - done)
            start = stop
    if held:
        yield k, held


def packed(rows: list[tuple[str, bytes, bytes]]) -> bytes:
    """Chunks and their ids as compressed bytes: count, lengths, chunks, ids."""
    cols = [[c.encode("utf-8", "surrogatepass") for c, _, _ in rows], [x for _, x, _ in rows], [x for _, _, x in rows]]
    return zstandard.compress(b"".join([np.array([len(rows), *(len(x) for col in cols for x in col)], "<u4").tobytes(), *(x for col in cols for x in col)]), 3)


def unpacked(data: bytes) -> list[tuple[str, tuple[bytes, bytes]]]:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (4 + 12 * n + np.cumsum(np.frombuffer(data, "<u4", 3 * n, 4))).tolist()
    cut = [data[s:e] for s, e in zip([4 + 12 * n, *ends], ends, strict=False)]
    return list(zip([c.decode("utf-8", "surrogatepass") for c in cut[:n]], zip(cut[n : 2 * n], cut[2 * n :], strict=True), strict=True))


def packed_chunks(chunks, numbers: list[np.ndarray]) -> bytes:
    """A column of chunks and columns of their numbers as compressed bytes. Of a second column it is kept
    where it differs; bytes of numbers stand by their place, which makes them smaller."""
    starts, data = _buffers(chunks)
    told = [np.diff(starts), numbers[0], *(x ^ numbers[0] for x in numbers[1:])]
    sizes, *told = (x.astype("<i8").view("u1").reshape(-1, 8).T.tobytes() for x in told)
    return packed([(data.tobytes().decode("utf-8", "surrogatepass"), sizes, b"".join(told))])


def unpacked_chunks(data: bytes):
    import pyarrow as pa

    ((text, told),) = unpacked(data)
    sizes, *told = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in np.frombuffer(b"".join(told), "u1").reshape(-1, 8, len(told[0]) // 8))
    chunks = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(text.encode("utf-8", "surrogatepass")))
    return chunks, [told[0], *(x ^ told[0] for x in told[1:])]


def encode(docs: DataFrame, m: Model, text: str = "text", keep: list[str] | None = None, both: bool = True, hot: int = HOT, back: bool = False) -> DataFrame:
    """Columns ``keep`` (default: all) plus ids, n_ids, other_ids and n_other; with ``back`` also decoded,
    the text that the ids decode to, as ``decode`` gives it.

    ids are the model's ids of the whole text. other_ids are those of the other algorithm (the
    best-score path for a BPE model, merging for a unigram model), null unless ``both``. Null and
    empty texts have no ids. Repeated rows get equal ids. Columns with the new names give way.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    small_batches(spark)
    # the partition's number is asked of the scan itself: a union numbers its tasks anew
    lists = written(block_chunks(docs.select(F.col(text).alias("_text_"), F.spark_partition_id().alias("_part_")), m), "lists")
    pieces = dictionary(docs, m, text, both, lists)
    own_first = ["viterbi", "merge"] if m.algorithm == "viterbi" else ["merge", "viterbi"]  # the model's paths, then the others
    top = _hot(pieces, hot).select("chunk", *own_first).toArrow()
    often = pa.concat_arrays([pa.array([], pa.string()), *top.column(0).chunks])
    frequent = spark.sparkContext.broadcast((often, *spelled_columns(often, [top.column(k).to_numpy() for k in (1, 2)], m, both)))
    new = StructType.fromDDL("ids array<int>, n_ids int, other_ids array<int>, n_other int" + ", decoded string" * back)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in new.names}]
    rows = docs.select(*names, F.col(text).alias("_text_"), F.spark_partition_id().alias("_part_"))
    schema = StructType([*rows.schema.fields[:-2], *new.fields])

    def spots(batches):
        known = frequent.value[0]
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                chunks = unpacked_chunks(data.as_py())[0]
                chunks = chunks.filter(pc.and_(pc.invert(pc.is_in(chunks, value_set=known)), pc.less_equal(pc.utf8_length(chunks), LONGEST)))
                if len(chunks):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chunks), block)), chunks], names=["block", "chunk"])

    def grouped(batches):
        """The paths of a task's chunks, packed by block."""

        def out():
            rows_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            order = np.argsort(rows_.column(0).to_numpy(), kind="stable")
            at, chunks, paths = rows_.column(0).to_numpy()[order], rows_.column(1).take(pa.array(order)), [rows_.column(k).to_numpy()[order] for k in ((2, 3) if both else (2,))]
            blocks, starts = np.unique(at, return_index=True)
            data = [packed_chunks(chunks[s:e], [p[s:e] for p in paths]) for s, e in zip(starts.tolist(), [*starts.tolist()[1:], len(at)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(data, pa.binary())], names=["block", "data"])

        held: list = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
            n += b.num_rows
            if n >= ROWS:
                yield out()
                n = 0
        if held:
            yield out()

    def stowed(batches):
        for block, held in _blocks(batches, len(names)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*(b.columns for b in held), strict=True)], schema=held[0].schema))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

    def put(batches):
        coder, at, text_of = Coder(m, frequent.value, both), None, column_decoder(m)
        for b in batches:
            for i in range(b.num_rows):
                block, is_text, data = (b.column(c)[i].as_py() for c in range(3))
                if block != at:
                    coder.block()
                    at = block
                if not is_text:  # comes before the texts of its block
                    coder.learn_paths(data)
                    continue
                for rows_ in pa.ipc.open_stream(data):
                    lists = []
                    for ids, sizes in coder.texts(rows_.column(len(names))):
                        lists += [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids)), pa.array(sizes.astype(np.int32))]
                    if not both:
                        lists += [pa.nulls(rows_.num_rows, pa.list_(pa.int32())), pa.nulls(rows_.num_rows, pa.int32())]
                    for at_row in range(0, rows_.num_rows, SENT):
                        part = [x.slice(at_row, SENT) for x in (*rows_.columns[: len(names)], *lists)]
                        yield pa.RecordBatch.from_arrays([*part, *([text_of(part[len(names)])] if back else [])], names=schema.names)

    with numbers(spark):
        some = lists.mapInArrow(spots, "block long, chunk string").join(pieces.select("chunk", *own_first), "chunk")
        found = written(fewer_files(some.select("block", "chunk", *own_first)).mapInArrow(grouped, "block long, data binary"), "paths")
    del some
    dropped(pieces, lists)
    freed(spark)  # the shuffles of chunks and paths go before the texts are dealt
    texts = rows.mapInArrow(stowed, "block long, data binary")
    every = found.select("block", F.lit(False).alias("is_text"), "data").unionByName(texts.select("block", F.lit(True).alias("is_text"), "data"))
    return fewer_files(every.repartition("block").sortWithinPartitions("block", "is_text")).mapInArrow(put, schema)


def decoded(ids: list[int], m: Model) -> str:
    """The text of a list of ids. Byte pieces in a row are read as UTF-8."""
    own = {i: b for b, i in enumerate(m.bytes_)}
    out, run = [], bytearray()
    for i in ids:
        if i in own:
            run.append(own[i])
            continue
        if run:
            out.append(run.decode("utf-8", "replace"))
            run.clear()
        if i == m.unknown:
            out.append(" ⁇ ")
        elif m.pieces[i] in m.ids:
            out.append(m.pieces[i].replace(BLANK, " "))
    out.append(run.decode("utf-8", "replace"))
    text = "".join(out)
    return text[1:] if m.prefix and text[:1] == " " else text


def column_decoder(m: Model):
    """A function from a column of lists of ids to that of their texts, null for null. All ids are looked
    up and joined at once; only rows with bytes of longer characters or unknown pieces go one by one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = {i: chr(b) for b, i in enumerate(m.bytes_[:128])}  # bytes that are characters by themselves
    table = pa.array([p.replace(BLANK, " ") if p in m.ids else plain.get(i) for i, p in enumerate(m.pieces)], pa.string())

    def run(rows):
        sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), table.take(rows.flatten()))
        out = []
        for i, t in enumerate(pc.binary_join(pieces, "").to_pylist()):
            if not rows[i].is_valid:
                out.append(None)
            elif t is None:  # some id is a byte of a longer character or unknown
                out.append(decoded(rows[i].values.to_numpy().tolist(), m))
            else:
                out.append(t[1:] if m.prefix and t[:1] == " " else t)
        return pa.array(out, pa.string())

    return run


def decode(encoded: DataFrame, m: Model, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) plus decoded, the text of the ids (null where they are null)."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    small_batches(encoded.sparkSession)
    names = [c for c in (encoded.columns if keep is None else keep) if c.lower() != "decoded"]
    src = encoded.select(*names, F.col(ids).alias("_ids_"))
    schema = StructType([*src.schema.fields[:-1], StructField("decoded", StringType())])

    def run(batches):
        text_of = column_decoder(m)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text_of(b.column(b.num_columns - 1))], names=schema.names)

    return src.mapInArrow(run, schema)


def model_of(spark: SparkSession) -> Model:
    """The model named in the session's affinis.piece.model, else the default file."""
    return load(spark.conf.get("affinis.piece.model", DEFAULT_MODEL))
