"""Pieces, toxicity, personal data, media and languages: round trips, brute force, edge cases."""

import dataclasses
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import common, jpeg, language, mixing, pieces, pii, toxicity
from affinis.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, score string, spans string, lang string"
ODD = [(1, None, "a", "b", "c", "en"), (2, "", "a", "b", "c", None), (3, " \n\t ", None, None, None, "en"), (4, "123 !!", None, None, None, "en"), (5, "wort " * 40_000, None, None, None, "de"), (6, "日本 🙂 the and of", None, None, None, "en"), (6, "日本 🙂 the and of", None, None, None, "en"), (None, "the same", None, None, None, "en"), (9, "x" * 3000, None, None, None, "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- pieces -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.load()


@pytest.fixture(scope="module")
def library():
    import sentencepiece as spm

    return spm.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


def test_ids_equal_the_library_and_decode(spark, model, library):
    docs = Q.table(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = pieces.decode(pieces.encode(docs, model, keep=["doc_id"], hot=500), model).collect()
    assert len(got) == len(text)
    for r in got:
        assert r.ids == library.encode(text[r.doc_id]) and r.decoded == text[r.doc_id]


def test_folds_equal_plain_python(spark, model):
    d = pieces.dictionary(Q.table(spark, SF, "documents").limit(40), model).collect()
    assert len(d) > 1000
    for r in d:
        assert pieces.bounds_of(r.merge) == pieces.bounds_merge(r.chunk, model) and pieces.bounds_of(r.viterbi) == pieces.bounds_viterbi(r.chunk, model), r.chunk


def test_merges_that_become_possible_late(spark):
    """abc scores better than bc, which has to be made first: one pass in order of scores would miss it."""
    scores = {"abc": -1.0, "bc": -2.0, "a": -9.0, "b": -9.0, "c": -9.0, "cd": -3.0, "d": -9.0, "abcd": -4.0}
    m = pieces.Model(["<unk>", *scores], [0.0, *scores.values()], 0, [], "merge", False, {p: i + 1 for i, p in enumerate(scores)})
    assert pieces.late_pieces(m) == {"abc"}
    rnd = np.random.RandomState(5)
    words = {"".join(rnd.choice(list("abcdx"), rnd.randint(1, 30))) for _ in range(400)}
    for r in pieces.dictionary(spark.createDataFrame([(w,) for w in words], "text string"), m).collect():
        assert pieces.bounds_of(r.merge) == pieces.bounds_merge(r.chunk, m), r.chunk


def test_scores_that_are_no_integers(spark):
    rnd = np.random.RandomState(8)
    scores = {p: float(-rnd.rand() * 9) for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "bca", "aa"]}
    m = pieces.Model(["<unk>", *scores], [0.0, *scores.values()], 0, [], "viterbi", False, {p: i + 1 for i, p in enumerate(scores)})
    words = {"".join(rnd.choice(list("abcx"), rnd.randint(1, 30))) for _ in range(300)}
    for r in pieces.dictionary(spark.createDataFrame([(w,) for w in words], "text string"), m).collect():
        assert pieces.bounds_of(r.viterbi) == pieces.bounds_viterbi(r.chunk, m) and pieces.bounds_of(r.merge) == pieces.bounds_merge(r.chunk, m), r.chunk


@pytest.fixture(scope="module")
def unigram():
    """The same pieces and scores, loaded by the library as a unigram model."""
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(pieces.DEFAULT_MODEL, "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    proto.trainer_spec.model_type = 1
    return spm.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_best_paths_are_those_of_the_unigram_library(spark, model, unigram):
    words = spark.createDataFrame([("ofreentionin",), ("thataningingnd",), ("elleoique",), ("Schlüssel",), ("nmftmlee",)], "text string")
    one = dataclasses.replace(model, algorithm="viterbi")
    for r in pieces.encode(words, one, hot=0).collect():
        assert r.ids == unigram.encode(r.text), r.text
    for r in pieces.encode(words, model).collect():
        assert r.other_ids == unigram.encode(r.text) and r.n_other == len(r.other_ids), r.text


def test_blocks_that_miss_paths_fold_by_themselves(model, library):
    coder = pieces.Coder(model, {}, True)
    coder.learn([("▁never", (b"", b"")), ("?!", (b"", b""))])
    t = "Thedreat  ofoneainhe, 12 é" + "z" * 60
    ids, other = (np.frombuffer(x, pieces.id_kind(model)).tolist() for x in coder.text(t))
    assert ids == library.encode(t) and pieces.decoded(other, model) == t


def test_columns_equal_single_texts(model):
    import pyarrow as pa

    texts = ["a b, c. d5 e_ f", None, "", " x", "x ", "two  blanks", "Ünï-cöde Ⅷx xⅧ ² a²", "\n\n a\tb", "x" * 100, "日本 🙂", "a\u2581b"]
    for both in (True, False):
        coder = pieces.Coder(model, {}, both)
        for (ids, sizes), k in zip(coder.texts(pa.array(texts)), range(2), strict=False):
            want = [np.frombuffer(coder.text(t)[k], pieces.id_kind(model)).tolist() for t in texts]
            ends = np.cumsum(sizes)
            assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == want
        assert [s.tolist() for _, s in coder.texts(pa.array([], pa.string()))] == [[]] * (1 + both)
    cut = pieces.cut_word(model)
    for w in " ".join(t or "" for t in texts).split(" "):
        assert cut(w) == model.cutter.findall(pieces.BLANK + w)


def test_packed_ids():
    rows = [("▁a", b"12", b""), ("", b"", b"3"), ("é" * 40, b"4" * 300, b"5")]
    assert pieces.unpacked(pieces.packed(rows)) == [(c, (x, y)) for c, x, y in rows]


def test_blocks_do_not_hang_on_batches(monkeypatch):
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["abc", None, "de", "", "f" * 10, "g"]), pa.array([1] * 6)], names=["t", "part"])
    monkeypatch.setattr(pieces, "BLOCK", 4)
    got = [(k - (1 << 24), [t for x in held for t in x.column(0).to_pylist()]) for k, held in pieces._blocks([b, b.slice(0, 0), b.slice(0, 2)], 0)]
    assert got == [(0, ["abc", None, "de"]), (1, ["", "f" * 10]), (2, ["g", "abc"]), (3, [None])]


def test_blocks_meet_their_paths(spark, model, monkeypatch, tmp_path):
    """Both scans number the blocks alike, so that no block has to fold chunks by itself."""
    docs = Q.table(spark, SF, "documents").repartition(5).select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/d")
    seen = []
    monkeypatch.setattr(pieces, "written", lambda df, name: seen.append(common.written(df, name)) or seen[-1])
    encoded = pieces.encode(spark.read.parquet(f"{tmp_path}/d"), model, hot=0)
    assert encoded.count() == docs.count()
    paths = {r.block for r in seen[-1].select("block").collect()}
    parts = spark.read.parquet(f"{tmp_path}/d").select(F.spark_partition_id().alias("p")).distinct().count()
    assert seen[-1].columns == ["block", "data"] and {b >> 24 for b in paths} == set(range(parts))


def test_piece_edge_cases(spark, odd, empty, model, library):
    both_ways = pieces.encode(odd, model, hot=3, back=True).withColumnRenamed("decoded", "with_it")
    got = pieces.decode(both_ways, model).collect()
    assert all(r.decoded == r.with_it for r in got)
    assert len(got) == len(ODD) and pieces.encode(empty, model).count() == 0
    for r in got:
        want = next(t for i, t, *_ in ODD if i == r.doc_id)
        assert (r.ids, r.decoded) == (library.encode(want or ""), want or "")


def test_unknown_pieces_without_bytes():
    m = pieces.Model(["<unk>", "a", "▁a"], [0.0, -1.0, -0.5], 0, [], "viterbi", True, {"a": 1, "▁a": 2})
    assert pieces.fold_viterbi("▁aza", m) == [2, 0, 1] and pieces.decoded([2, 0, 1], m) == "a ⁇ a"


# --- toxicity -----------------------------------------------------------------------------------


def near(a, b):
    """Whether the Levenshtein distance is at most 1, by trying all edits."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, l = sorted((a, b), key=len)
    return any(l[:i] + l[i + 1 :] == s for i in range(len(l)))


def test_automaton_equals_brute_force():
    terms = ["idiot", "moron", "trash", "scum", "idiots"]
    m = toxicity.Matcher([(t, 1.0 + i, False) for i, t in enumerate(terms)] + [("vequ", 9.0, True)])
    rnd = random.Random(4)
    words = terms + ["vequ", "vequa", "vequaire", "vejuu"]
    for _ in range(4000):
        w = list(rnd.choice(words))
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "i", "o"])
        w = "".join(w)
        kind, _ = m.match(w)
        if w in terms:
            assert kind == 1, w
        elif w.startswith("vequ") and len(w) > 3:
            assert kind == 2, w
        else:
            assert (kind == 3) == any(near(w, t) for t in terms if len(t) >= toxicity.FUZZY_FROM), w


def test_context_weighs_quotation_against_abuse():
    model = toxicity.Model([("idiot", 4.0, False)], np.array([-4.0, 6.0, 0, 0, 0, 0, 0]))
    m = toxicity.Matcher(model.terms)
    score = lambda t: float(toxicity.features(t, m, model) @ model.weights)
    assert score("you are an idiot") > 0 > score('he wrote "idiot" on the wall') > score("a clean text")
    assert score("you are an idoit") < score("you are an idiott")  # two edits, one edit


def test_toxicity_finds_labelled_rows(spark):
    got = {r.doc_id: r for r in Q.op2_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    docs = {r.doc_id: r.text.lower() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    loud = re.compile(r"\b(idiot|moron|scum|worthless|pathetic|disgusting|trash|clown|stupid|loser)\b")
    sure = [x.doc_id for x in labels if x.toxic == 1 and len(loud.findall(docs[x.doc_id])) > 1]
    assert sum(got[i].predicted for i in sure) >= 0.9 * len(sure) > 10
    assert sum(got[x.doc_id].predicted for x in labels if x.toxic == 0) <= 0.03 * len(labels)


def test_toxicity_edge_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd.select("doc_id", "text"), labels)
    r = toxicity.scored(odd, model)
    assert r.count() == len(ODD) and {c.lower() for c in r.columns} == {"doc_id", "text", "ids", "spans", "lang", "score", "predicted", "hits"}
    assert toxicity.scored(empty, toxicity.train(empty, labels.limit(0))).count() == 0


# --- personal data ------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain(text):
    """The base spans, by the patterns as they are written."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return out


def test_base_spans_equal_the_patterns(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rnd = random.Random(5)
    texts += ["".join(rnd.choice("ab1290@@..- +()4") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["mail a@b.c@d.e@f.gh", "4111 1111 1111 1111", "+1 (988) 555-2485", "300.1.1.1 1.2.3.4.5", "000000.1.2.3"]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def brute(k, f):
    """The best tag sequence of one chain, by trying all of them."""
    from itertools import product

    e, move = pii._emissions(k[None], f)[0], f.move + pii._allowed_moves()
    score = lambda tags: pii.START[tags[0]] + sum(e[i, t] for i, t in enumerate(tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:], strict=False))
    return max(score(t) for t in product(range(len(pii.TAGS)), repeat=len(k))), score


def test_viterbi_equals_brute_force():
    f = pii.train(rounds=40)
    rnd = np.random.RandomState(1)
    for n in (1, 2, 4):
        k = rnd.randint(0, f.emit.shape[1], n)
        best, score = brute(k, f)
        assert score(pii.viterbi(k[None], np.array([n]), f)[0].tolist()) == pytest.approx(best)


def test_field_finds_what_patterns_miss():
    f = pii.train()
    for raw, kind in pii.LABELLED:
        a, b = (raw.find("[["), raw.rfind("]]")) if kind else (-1, 0)
        text = raw if a < 0 else raw[:a] + raw[a + 2 : b] + raw[b + 2 :]
        assert pii.field_spans([text], f)[0] == ([(kind, a, b - 2)] if kind else []), text
    new = ["please call (312) 555-0142 now", "write to jane at corp dot com soon"]
    assert [[s[0] for s in x] for x in pii.field_spans(new, f)] == [["phone"], ["email"]]


def test_pii_edge_cases(spark, odd, empty):
    r = pii.found(odd).collect()
    assert len(r) == len(ODD) and {x.base_sha256 for x in r} == {hashlib.sha256(b"").hexdigest()}
    assert pii.found(empty).count() == 0
    m = pii.masked(spark.createDataFrame([(1, "to a@b.cd, +1 (988) 555-2485."), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x.text for x in m] == ["to <EMAIL>, <PHONE>.", None]


# --- media --------------------------------------------------------------------------------------


@pytest.mark.parametrize("units", [1, 2, 3, 9, 4096])
def test_payload_survives(units):
    p = os.urandom(192 * units)
    pic = jpeg.Picture(jpeg.write(p))
    assert pic.payload() == p
    rgb = pic.rgb()
    assert rgb.shape == (pic.height, pic.width, 3) and rgb.dtype == np.uint8


def test_bitwise_reading_equals_array_reading(monkeypatch):
    m = jpeg.write(os.urandom(192 * 7))
    fast = jpeg.Picture(m)
    monkeypatch.setattr(jpeg.Picture, "_whole", lambda *a: False)
    slow = jpeg.Picture(m)
    assert all((a == b).all() for a, b in zip(fast.planes, slow.planes, strict=True))


class Writer:
    """A plain progressive encoder for any coefficients, bit by bit: what reading is held against."""

    def __init__(self):
        self.bits = ""

    def symbol(self, s):
        self.bits += f"{s:08b}"  # codes of 8 bits for symbols 0 to 254

    def value(self, v, n):
        if n:
            self.bits += f"{v if v > 0 else v + (1 << n) - 1:0{n}b}"

    def data(self):
        raw = self.bits + "1" * (-len(self.bits) % 8)
        return int(raw, 2).to_bytes(len(raw) // 8, "big").replace(b"\xff", b"\xff\x00") if raw else b""


def progressive(planes, sample, height, width):
    """Scans: DC at half precision for all components, AC bands at half precision, then refinements."""
    seg, mv = jpeg._segment, max(v for v, _ in sample)
    mh = max(h for _, h in sample)
    out = [b"\xff\xd8", seg(0xDB, b"\x00" + bytes(range(1, 65)))]
    out.append(seg(0xC2, bytes([8, height >> 8, height & 255, width >> 8, width & 255, len(planes)]) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (v, h) in enumerate(sample))))
    table = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    out += [seg(0xC4, b"\x00" + table), seg(0xC4, b"\x10" + table)]
    w, pred = Writer(), [0] * len(planes)
    for r in range(-(-height // (8 * mv))):
        for q in range(-(-width // (8 * mh))):
            for c, (v, h) in enumerate(sample):
                for y in range(v):
                    for x in range(h):
                        dc = int(planes[c][r * v + y, q * h + x, 0]) >> 1
                        d, pred[c] = dc - pred[c], dc
                        n = abs(d).bit_length()
                        w.symbol(n), w.value(d, n)
    out.append(seg(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, 0]) for c in range(len(planes))) + bytes([0, 0, 1])) + w.data())
    for c, (v, h) in enumerate(sample):
        rows, cols = -(-(-(-height * v // mv)) // 8), -(-(-(-width * h // mh)) // 8)
        blocks = [planes[c][r, q].astype(int) for r in range(rows) for q in range(cols)]
        for first, last in ((1, 5), (6, 63)):
            w = Writer()
            for b in blocks:
                half = np.sign(b) * (np.abs(b) >> 1)
                at = [k for k in range(first, last + 1) if half[k]]
                k = first
                for j in at:
                    while j - k > 15:
                        w.symbol(0xF0)
                        k += 16
                    n = int(abs(half[j])).bit_length()
                    w.symbol((j - k) << 4 | n), w.value(int(half[j]), n)
                    k = j + 1
                if k <= last:
                    w.symbol(0x00)
            out.append(jpeg._scan(c + 1, first, last, 0, 1, w.data()))
        w = Writer()
        for b in blocks:
            new = [k for k in range(1, 64) if abs(b[k]) == 1]
            k = 1
            for j in new:
                run, fixes = 0, ""
                while k < j or run > 15:
                    if abs(b[k]) > 1:
                        fixes += str(abs(int(b[k])) & 1)
                    elif run == 15 and k < j:
                        w.symbol(0xF0)
                        w.bits += fixes
                        run, fixes = -1, ""
                        run += 1
                        k += 1
                        continue
                    else:
                        run += 1
                    k += 1
                w.symbol(run << 4 | 1)
                w.bits += "1" if b[j] > 0 else "0"
                w.bits += fixes
                k = j + 1
            if k < 64:
                w.symbol(0x00)
                w.bits += "".join(str(abs(int(b[i])) & 1) for i in range(k, 64) if abs(b[i]) > 1)
        out.append(jpeg._scan(c + 1, 1, 63, 1, 0, w.data()))
        w = Writer()
        for b in blocks:
            w.bits += str(int(b[0]) & 1)
        out.append(jpeg._scan(c + 1, 0, 0, 1, 0, w.data()))
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("sample,height,width", [([(1, 1)], 8, 8), ([(2, 2), (1, 1), (1, 1)], 21, 37), ([(1, 2), (1, 1), (1, 1)], 16, 30), ([(1, 1)] * 3, 9, 17)])
def test_general_progressive_files(sample, height, width):
    rnd = np.random.RandomState(height)
    mv, mh = max(v for v, _ in sample), max(h for _, h in sample)
    planes = []
    for v, h in sample:
        p = rnd.randint(-40, 41, (-(-height // (8 * mv)) * v, -(-width // (8 * mh)) * h, 64)) * (rnd.rand(64) < 0.3)
        rows, cols = -(-(-(-height * v // mv)) // 8), -(-(-(-width * h // mh)) // 8)
        # blocks beyond the picture are coded by the interleaved scan alone, which holds DC halves
        p[rows:, :, 1:], p[:, cols:, 1:] = 0, 0
        p[rows:, :, 0] &= ~1
        p[:, cols:, 0] &= ~1
        planes.append(p)
    pic = jpeg.Picture(progressive(planes, sample, height, width))
    assert all((a == b).all() for a, b in zip(pic.planes, planes, strict=True))
    rgb = pic.rgb()
    assert rgb.shape == (height, width, 3)
    # the transform by its definition
    x = np.arange(8)
    c = np.cos((2 * x[None] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(0.5), 1.0) / 2
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = planes[0][0, 0] * np.arange(1, 65)
    y = np.clip(np.rint(c.T @ block.reshape(8, 8) @ c + 128), 0, 255)
    if len(sample) == 1:
        assert np.abs(rgb[:8, :8, 0].astype(int) - y[:height, :width]).max() <= 1


def test_media_query_and_columns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q.op6_media(spark, SF).collect():
        n, p = jpeg.padded(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    d = spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "doc_id long, text string")
    m = jpeg.opened(jpeg.stored(d)).collect()
    assert [len(x.rgb) == x.height * x.width * 3 for x in m] == [True] * 3 and m[0].media == m[2].media
    bad = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xc0\x00\x02"),), (None,), (bytearray(b"no"),)], "media binary")
    assert [x.rgb for x in jpeg.opened(bad).collect()] == [None] * 3


def test_media_edge_cases(odd, empty):
    r = jpeg.digests(odd).collect()
    assert {x.payload_bytes for x in r if x.doc_id in (1, 2)} == {192} and jpeg.digests(empty).count() == 0


# --- languages ----------------------------------------------------------------------------------


def test_languages_are_told(spark):
    r = Q.op10_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = r.where("held_out").join(docs, "doc_id")
    assert both.where("lang = lang_pred").count() >= 0.98 * both.count() > 100


def test_mixed_documents_get_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    by = {r.lang: r.text for r in docs.where("n_chars BETWEEN 1500 AND 4000").groupBy("lang").agg(F.max("text").alias("text")).collect()}
    pi, size = language.mixtures([by["en"] + " " + by["de"], by["fr"], "", None, "1 2 3"], model)
    assert size.tolist() == [2, 1, 0, 0, 0]
    assert set(np.argsort(-pi[0])[:2]) == {model.languages.index("en"), model.languages.index("de")}


def test_language_edge_cases(spark, odd, empty):
    r = {x.doc_id: x for x in language.identify(odd, language.train(odd)).collect()}
    assert [r[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and r[1].score == 0.0
    none = language.train(empty)
    assert none.languages == [] and language.identify(empty, none).count() == 0
    assert {x.lang_pred for x in language.identify(odd, none).collect()} == {"und"}


# --- mixing -------------------------------------------------------------------------------------


def test_rates_meet_targets(spark):
    rnd = np.random.RandomState(3)
    rows = [(int(t), p.tolist()) for t, p in zip(rnd.randint(1, 500, 400), rnd.dirichlet([0.3] * 3, 400), strict=True)]
    known = spark.createDataFrame(rows, "tokens long, p array<double>")
    f = mixing.fit(known, mixing.DOMAINS, {"plain": 0.5, "low": 0.3, "toxic": 0.2}, tolerance=1e-3, ridge=1e-4)
    t, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    r = f.rates(p)
    got = (r * t) @ p
    assert (r >= 0).all() and np.allclose(got, f.targets, rtol=5e-3) and np.allclose(got / got.sum(), [0.5, 0.3, 0.2], atol=3e-3)


def test_copies_follow_rates(spark):
    d = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("c"))
    assert d.agg(F.avg("c")).first()[0] == pytest.approx(1.3, abs=0.02)
    assert spark.range(100).select(mixing.copies(F.lit(2.0), F.col("id")).alias("c")).where("c <> 2").count() == 0


def test_mixing_edge_cases(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    model = mixing.train(odd.select("doc_id", "text"), labels)
    r = mixing.mixed(odd, model).collect()
    assert len(r) == len(ODD) and all(x.rate >= 0 and abs(x.p_plain + x.p_low + x.p_toxic - 1) < 1e-6 for x in r)
    blank = mixing.train(empty.select("doc_id", "text"), labels.limit(0))
    assert mixing.mixed(empty, blank).count() == 0
