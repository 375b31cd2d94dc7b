"""Repeated passages: repeated lines and partner ids, against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from affinis.llm import repeats


def brute(texts, least=50):
    """Of each document, the words that another one repeats, and whether one with a smaller id does."""
    words = {i: t.split() for i, t in texts.items()}
    held = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            held[tuple(w[k : k + least])].add(i)
    marks, later = {i: np.zeros(len(w), bool) for i, w in words.items()}, {i: np.zeros(len(w), bool) for i, w in words.items()}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            others = held[tuple(w[k : k + least])] - {i}
            marks[i][k : k + least] |= bool(others)
            later[i][k : k + least] |= any(o < i for o in others)
    return marks, later


def covered(rows, texts, start="start_word", stop="end_word"):
    out = {i: np.zeros(len(t.split()), bool) for i, t in texts.items()}
    for r in rows:
        out[r["doc_id"]][r[start] : r[stop]] = True
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def equal(a, b):
    return all((a[i] == b[i]).all() for i in a)


def test_repeated_lines_equal_brute_force(spark):
    texts = {}
    for p in range(1, 29):
        line = " ".join(f"p{p}w{j}" for j in range(p)) + " "
        for i, times in enumerate((200, 4 + 50 // p, 12)):
            texts[100 * p + i] = line * times + f"end{i}"
    d = frame(spark, texts)
    want, _ = brute(texts)
    assert equal(covered(repeats.repeated(d).collect(), texts), want)


@pytest.mark.parametrize("length", [50, 55, 62])
def test_least_partner_of_every_copy(spark, length):
    rnd = np.random.RandomState(length)
    noise = lambda n: [f"x{v}" for v in rnd.randint(0, 10**9, n)]
    texts = {}
    for k in range(5):
        p = noise(length)
        for i in range(40):
            texts[100 * k + i] = " ".join([*noise(rnd.randint(0, 60)), *p, *noise(rnd.randint(0, 60))])
    rows = repeats.repeated(frame(spark, texts)).collect()
    assert len(rows) == 200 and {r.n_words for r in rows} == {length}
    assert all(r.partner_id == (r.doc_id - r.doc_id % 100 or 0) + (r.doc_id % 100 == 0) for r in rows)
    assert [r.doc_id for r in rows if not r.duplicate] and sorted(r.doc_id for r in rows if not r.duplicate) == [0, 100, 200, 300, 400]


def test_copies_beyond_shorter_neighbours(spark):
    """Two whole copies among many documents that hold only 20 to 49 words of the passage."""
    rnd = np.random.RandomState(3)
    noise = lambda n: [f"x{v}" for v in rnd.randint(0, 10**9, n)]
    texts = {}
    for k in range(20):
        p = noise(60)
        for i in range(20):
            a = rnd.randint(0, 30)
            texts[100 * k + i] = " ".join([*noise(30), *(p if i in (4, 15) else p[a : a + rnd.randint(20, 50)]), *noise(30)])
    d = frame(spark, texts)
    want, later = brute(texts)
    assert equal(covered(repeats.repeated(d).collect(), texts), want)
    assert equal(covered(repeats.matches(d).where("partner < doc_id").collect(), texts, "start", "stop"), later)


@pytest.mark.parametrize("shared", [20, 34, 40, 49])
def test_half_copies_hide_nothing(spark, shared):
    """Passages of 50 words in two documents each, and 30 documents that hold less than 50 words of them."""
    rnd = np.random.RandomState(shared)
    noise = lambda n: [f"x{v}" for v in rnd.randint(0, 10**9, n)]
    texts = {}
    for k in range(20):
        p = noise(50)
        for _ in range(2):
            texts[len(texts)] = " ".join([*noise(rnd.randint(0, 40)), *p, *noise(rnd.randint(0, 40))])
        for _ in range(30):
            a = rnd.randint(0, 51 - shared)
            texts[len(texts)] = " ".join([*noise(rnd.randint(0, 40)), *p[a : a + shared], *noise(rnd.randint(0, 40))])
    rows = repeats.repeated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for k in range(20) for i in (32 * k, 32 * k + 1))
    assert all(r.n_words == 50 and r.partner_id == r.doc_id + (1 if r.doc_id % 32 == 0 else -1) for r in rows)
