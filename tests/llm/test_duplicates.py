"""Near-duplicates and repeated passages against brute force; the pipeline; edge cases."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from affinis.llm import common, minhash, repeats
from affinis.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and {got[i] for i in range(101, 160)} == {100} and got[300] == 200


def brute_classes(texts, percent=75):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_classes_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute_classes(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op9_minhash(spark, SF).collect()}
    assert got == want


def test_chained_copies_equal_brute_force(spark):
    """Copies of copies: links that do not run through the least id of a bucket must not get lost."""
    rnd = np.random.RandomState(11)
    texts, base = {}, [f"w{x}" for x in rnd.randint(0, 5000, 120)]
    for i in range(150):
        w = list(base)
        for k in rnd.choice(len(w), rnd.randint(0, 4), replace=False):
            w[k] = f"n{rnd.randint(0, 9)}"
        if i % 10 == 0:
            base = w
        texts[1000 - i] = " ".join(w)
    want = brute_classes(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_pruning_keeps_similar_pairs():
    least = minhash.least_matches(0.75, 1e-4)
    assert len(least) == minhash.HASHES // minhash.BATCH and all(a < b for a, b in zip(least, least[1:], strict=False))
    a = np.arange(minhash.HASHES, dtype=np.uint8)[None]
    assert len(minhash.survivors(a, a, least)) == 1 and len(minhash.survivors(a, a + 1, least)) == 0


ODD = [(1, None, 5, "k"), (2, "", 5, "k"), (3, " \t", 5, "k"), (4, "one two", 5, "k"), (5, "ONE  two", 5, "k"), (6, "É x", 5, "k"), (7, "é x", 5, "k"), (8, "a b c d e f", 5, "k"), (8, "a b c d e f", 5, "k"), (None, "one two", 5, "k"), (9, "v w " * 30_000, 5, "k")]
SCHEMA = "doc_id long, text string, n_shingles int, part string"


def test_near_edge_cases(spark):
    got = defaultdict(list)
    for r in minhash.near_dedup(spark.createDataFrame(ODD, SCHEMA)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(ODD)
    assert [got[i][0].component_id for i in (1, 2, 3)] == [1, 2, 3] and got[1][0].n_shingles == 0 and got[1][0].kept
    assert (got[4][0].component_id, got[5][0].component_id, got[5][0].kept) == (4, 4, False)
    assert got[7][0].component_id == 7  # only A-Z are lower-cased
    assert len(got[8]) == 2 and {r.component_id for r in got[8]} == {8}
    assert got[None][0].component_id is None and got[None][0].kept
    assert got[9][0].n_shingles == 2
    assert minhash.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_repeats(texts, least=50):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    seen = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])].add(i)
    marks = {i: np.zeros(len(w), bool) for i, w in words.items()}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            if len(seen[tuple(w[k : k + least])]) > 1:
                marks[i][k : k + least] = True
    return marks


def marked(rows, texts):
    out = {i: np.zeros(len((t or "").split()), bool) for i, t in texts.items()}
    for r in rows:
        out[r.doc_id][r.start_word : r.end_word] = True
    return out


def test_passages_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op7_repeats(spark, SF).collect()
    want, got = brute_repeats(texts), marked(rows, texts)
    found = sum(int((want[i] & got[i]).sum()) for i in texts)
    assert found == sum(int(m.sum()) for m in want.values()) > 0
    assert not any((got[i] & ~want[i]).any() for i in texts)
    for r in rows:
        assert len(texts[r.doc_id][r.start_char : r.end_char].split()) == r.n_words


@pytest.mark.parametrize("length", [50, 51, 80])
def test_planted_passages_are_found(spark, length):
    rnd = np.random.RandomState(length)
    noise = lambda n: [f"x{v}" for v in rnd.randint(0, 10**9, n)]
    p = noise(length)
    texts = {i: " ".join([*noise(rnd.randint(0, 60)), *p, *noise(rnd.randint(0, 60))]) if i % 2 else " ".join(noise(90)) for i in range(60)}
    texts[100] = " ".join([*noise(20), *p[:49], *noise(20)])  # one word short
    rows = repeats.repeated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {i for i in range(60) if i % 2} and {r.n_words for r in rows} == {length}
    assert [r.doc_id for r in rows if not r.duplicate] == [1] and {r.partner_id for r in rows if r.duplicate} == {1}


def test_one_word_over_and_over(spark):
    texts = {1: "w " * 3000, 2: "w " * 400 + "end", 3: "start " + "w " * 49}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    texts = dict(texts)
    got, want = marked(repeats.repeated(d).collect(), texts), brute_repeats(texts)
    assert not got[3].any() and got[2].mean() > 0.9 and got[1].any() and not (got[1] & ~want[1]).any()


def test_passages_are_cut_once(spark):
    p = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, f"a {p} b", "q"), (2, f"é {p} d", "q"), (3, None, None), (4, "", None)], "doc_id long, text string, start_char string")
    got = {r.doc_id: r.text for r in repeats.without_repeats(d).collect()}
    assert got == {1: f"a {p} b", 2: "é  d", 3: None, 4: ""}
    assert repeats.repeated(spark.createDataFrame(ODD, SCHEMA)).count() == 0
    assert repeats.repeated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline_keeps_its_promises(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "mixing", "pieces"]
    first = P.STAGES[0][1](spark, docs, SF)
    assert first.columns == P.COLUMNS and first.count() == docs.count()
    out = P.run(spark, SF).collect()
    assert 0 < len(out)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == text[r.doc_id] and r.n_ids == len(r.ids) for r in out)
    stages = docs
    for _, stage in P.STAGES[:3]:
        stages = stage(spark, stages, SF)
    kept = brute_classes({r.doc_id: r.text for r in stages.collect()})
    assert all(c == i for i, (_, c) in kept.items())


def test_empty_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
