"""Languages: a document in all learned languages keeps them all."""

import numpy as np

from affinis.llm import language


def test_all_languages_of_a_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs)
    own = {k: [r.text for r in docs.where(docs.lang == k).orderBy("doc_id").limit(40).collect() if r.text] for k in model.languages}
    k = len(model.languages)
    assert k > 3
    text = " ".join(" ".join(" ".join(t.split()[:100]) for t in own[x][:10]) for x in model.languages)
    share, size = language.mixtures([text], model)
    assert size[0] == k and (share[0] > 0.05).all() and np.isclose(share.sum(), 1, atol=1e-3)
    assert (language.mixtures([x[0] for x in own.values()], model)[1] < k).all()


def test_parts_of_bounded_size_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs)
    texts = [r.text for r in docs.collect()] + [None, "", "12"]
    share, size = language.mixtures(texts, model)
    monkeypatch.setattr(language, "CELLS", 1000)
    less, sizes = language.mixtures(texts, model)
    assert (size == sizes).all() and np.allclose(share, less, atol=1e-5)


def plain_mixture(text, model, rounds=8, penalty=2.0, floor=-12.0):
    """The best set by a plain loop: EM over words, sets nested by proportion, penalised likelihood."""
    k = len(model.languages)
    b = language._bytes(text)
    h = language.grams(b)
    starts = [i for i in range(1, len(b)) if b[i] != 32 and b[i - 1] == 32]
    if not starts:
        return np.zeros(k), 0
    bounds = [starts[0] - 1, *[s - 1 for s in starts[1:]], len(h)]
    ll = np.array([model.table[h[x:y]].sum(axis=0) for x, y in zip(bounds, bounds[1:], strict=False)])
    ll = np.maximum(ll - ll.max(axis=1, keepdims=True), floor)
    p = np.exp(ll)

    def em(pi, times):
        for _ in range(times):
            r = p * pi
            pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        return pi

    single = ll.sum(axis=0)
    best = int(single.argmax())
    full = em(np.full(k, 1 / k), rounds)
    order = [best, *[i for i in np.argsort(-full, kind="stable") if i != best]]
    chosen, size, at = np.eye(k)[best], 1, single[best]
    for s in range(2, k + 1):
        mask = np.zeros(k)
        mask[order[:s]] = 1
        pi = full * mask + 1e-3 * mask
        pi = em(pi / pi.sum(), max(2, rounds // 2))
        now = np.log((p * pi).sum(axis=1)).sum()
        if now - at > (s - size) * (penalty * 0.5 * np.log(len(p) + 1) + penalty):
            chosen, size, at = pi, s, now
    return chosen, size


def test_mixtures_equal_plain_expectation_maximisation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs)
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text]
    texts = [*texts[:80], *(" ".join(texts[i].split()[:60] + texts[-i - 1].split()[:40]) for i in range(60)), "12 !!", "a"]
    share, size = language.mixtures(texts, model)
    for t, x, n in zip(texts, share, size, strict=True):
        want, m = plain_mixture(t, model)
        assert n == m and np.allclose(x, want, atol=2e-3), t[:80]
