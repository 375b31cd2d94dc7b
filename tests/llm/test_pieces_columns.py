"""Texts of the pieces operator are cut, looked up and joined in columns."""

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from affinis.llm import pieces

ODD = ["a b, c. d5 e_ f", None, "", " x", "x ", "two  blanks", "Ünï-cöde Ⅷx xⅧ ² a²", "\n\n a\tb\r\x00c", "x" * 100, "日本 🙂 a🙂b \U0010ffff.", "a▁b ▁", "٣4 àéîõü! ñ́", "it's (e.g.) 3.14, no?"]


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def test_units_and_chunks_are_what_the_cutter_finds(model):
    every = ["!" + chr(c) + "a" for c in range(1, 1 << 16) if not 0xD800 <= c < 0xE000]
    for texts in (ODD, ["one two", "three"], [], every):
        found, at, counts = pieces.units(pa.array(texts, pa.string()), model)
        chunks, each = pieces.cut_units(found, model)
        ends, words = np.cumsum(each), found.to_pylist()
        own = [chunks[e - n : e].to_pylist() for e, n in zip(ends.tolist(), each.tolist(), strict=True)]
        assert own == [model.cutter.findall(w) for w in words]
        got, start = [], 0
        for n in counts.tolist():
            got.append([c for i in at[start : start + n].tolist() for c in own[i]])
            start += n
        assert got == [model.cutter.findall(pieces.escaped(t)) for t in texts]
        assert sorted(set(at.tolist())) == list(range(len(words)))


def test_chunk_counts_of_odd_texts(spark, model, monkeypatch):
    want = Counter(c for t in ODD for c in model.cutter.findall(pieces.escaped(t)))
    docs = spark.createDataFrame([(t, 0) for t in ODD], "text string, part int").coalesce(1)
    monkeypatch.setattr(pieces, "BLOCK", 20)
    for flush in (1, pieces.COUNTED):
        lists = pieces.block_chunks(docs, model)
        assert {r.chunk: r.n for r in pieces.chunk_counts(lists, flush).collect()} == dict(want)


def test_ids_along_paths_and_their_packing(model):
    rnd = np.random.RandomState(3)
    chunks = ["▁never", "?!", "é", "日本", "🙂x", "\n", "z" * 34, *("".join(rnd.choice(list("aeinothrsxé🙂"), rnd.randint(1, 34))) for _ in range(300))]
    bounds = [(pieces.bounds_merge(c, model), pieces.bounds_viterbi(c, model)) for c in chunks]
    paths = [np.array([sum(1 << i for i in b[k]) for b in bounds]) for k in range(2)]
    for both in (True, False):
        got_chunks, got = pieces.unpacked_chunks(pieces.packed_chunks(pa.array(chunks), paths[: 1 + both]))
        assert got_chunks.to_pylist() == chunks and all((a == b).all() for a, b in zip(got, paths, strict=False))
        ids = pieces.spelled_columns(got_chunks, got, model, both)
        assert list(zip(*(x.to_pylist() for x in ids), strict=True)) == [pieces.spelled(c, *b, model, both) for c, b in zip(chunks, bounds, strict=True)]
    rows = [(c, *pieces.spelled(c, *b, model, True)) for c, b in zip(chunks, bounds, strict=True)]
    assert len(pieces.packed_chunks(pa.array(chunks), paths)) < 0.7 * len(pieces.packed(rows))


def test_words_cost_no_call_of_their_own(model):
    words = [f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvwxyzé"]
    texts = pa.array([" ".join(words[i::20]) for i in range(20)])
    coder = pieces.Coder(model, {}, True)
    coder.learn([(pieces.BLANK + w, pieces.spelled(pieces.BLANK + w, pieces.bounds_merge(pieces.BLANK + w, model), pieces.bounds_viterbi(pieces.BLANK + w, model), model, True)) for w in words])
    chunks = pa.array(list(coder.rare))
    coder = pieces.Coder(model, (chunks, *(pa.array([x[k] for x in coder.rare.values()], pa.binary()) for k in range(2))), True)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        got = coder.texts(texts)
    finally:
        sys.setprofile(None)
    assert calls < len(words) / 2 and all(len(s) == 20 and len(i) == s.sum() for i, s in got)
