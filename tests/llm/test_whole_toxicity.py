"""Toxicity: terms with a digit or sign inside are one edit away."""

import numpy as np
import pytest

from affinis.llm import toxicity

MODEL = toxicity.Model([("idiot", 4.0, False), ("moron", 4.0, False), ("vequ", 9.0, True)], np.array([-4.0, 6.0, 0, 0, 0, 0, 0]))
MATCHER = toxicity.Matcher(MODEL.terms)


def hits(text):
    return round(float(np.expm1(toxicity.features(text, MATCHER, MODEL)[2])))


@pytest.mark.parametrize("text", ["you id1ot", "you ID*OT!", "id_ot", "such an idi@t, you", "you-id10t id1ot", "idi-ot", "i.diot", "9id1ot22", "so,id1ot", "you/id*ot"])
def test_digits_and_signs_inside_are_edits(text):
    assert hits(text) == 1


def test_counts_and_other_words():
    assert hits("id1ot m0ron idiot") == 3 and hits("mo*ron id1ot") == 2 and hits("id1ot2m0ron") == 2
    assert hits("idiot-moron") == 2 and hits("idiot's") == 1 and hits("idiot2") == 1
    assert [hits(t) for t in ("1d10t", "i*d*ot", "id1 ot", "id--ot", "it's a2b c-d 2024-01-02")] == [0] * 5


def test_quoted_forms_weigh_less():
    score = lambda t: float(toxicity.features(t, MATCHER, MODEL) @ MODEL.weights)
    assert score('they said "id*ot" once') < score("they are an id*ot now")


def within_one(a, b):
    """Whether one letter put in, left out or changed makes a of b; plainly."""
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


class PlainMatcher:
    """Every word against every term."""

    def __init__(self, terms):
        self.terms = terms

    def match(self, word):
        exact = [w for t, w, stem in self.terms if not stem and t == word]
        stems = [w for t, w, stem in self.terms if stem and word.startswith(t)]
        near = [w for t, w, stem in self.terms if not stem and len(t) >= toxicity.FUZZY_FROM and within_one(t, word)]
        return (1, max(exact)) if exact else (2, max(stems)) if stems else (3, max(near)) if near else (0, 0.0)


def plain_score(text, model, matcher):
    """The score of a text as the module states it, one token after the other."""
    lower = (text or "").lower()
    whole, i = [], 0
    kinds = {w: matcher.match(w) for w in set(toxicity.WORD.findall(lower))}
    hits = {w: m for w, m in kinds.items() if m[0]}
    spans = []
    for x in toxicity.BROKEN.finditer(lower):
        a, b = x.start(), x.end(3)
        m = matcher.match(lower[a:b]) if b - a >= toxicity.FUZZY_FROM and x[1] not in hits and x[3] not in hits and not (spans and a < spans[-1][1]) else (0, 0.0)
        if m[0]:
            hits[lower[a:b]] = m
            spans.append((a, b))
    for t in toxicity.TOKEN.finditer(lower):
        inside = [s for s in spans if s[0] < t.end() and t.start() < s[1]]
        if not inside:
            whole.append(t[0])
        whole += [lower[a:b] for a, b in spans[i:] if b <= t.end()]
        i = sum(b <= t.end() for _, b in spans)
    scores, stems = [], 0
    for n, w in enumerate(whole):
        m = hits.get(w) or (None if w.isalpha() else hits.get(w.strip("0123456789")))
        if not m:
            continue
        left, right = whole[max(0, n - model.window) : n], whole[n + 1 : n + 1 + model.window]
        quoted = sum(x in toxicity.QUOTES for x in left) % 2 == 1 and any(x in toxicity.QUOTES for x in right)
        quoted = quoted or any(x in toxicity.REPORTING for x in left[-3:])
        told = any(x in toxicity.ADDRESS for x in left[-2:] + right[:1])
        scores.append(m[1] * (model.fuzzy if m[0] == 3 else 1) * (model.quoted if quoted and not told else 1))
        stems += m[0] == 2
    x = np.zeros(toxicity.FEATURES)
    x[0] = 1
    if scores:
        x[1:] = min(1.0, max(scores) / 3), np.log1p(len(scores)), np.log1p(sum(scores)), sum(scores) / (10 + len(whole)) ** 0.5, max(scores) / 3, np.log1p(stems)
    return 1 / (1 + np.exp(-(x @ model.weights)))


def test_scores_equal_brute_force(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert len(model.terms) > 5
    some = docs.where("doc_id % 4 = 0").select("doc_id", "text")
    got = {r.doc_id: r for r in toxicity.scored(some, model).collect()}
    matcher = PlainMatcher(model.terms)
    hit = 0
    for r in some.collect():
        want = plain_score(r.text, model, matcher)
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-9), r.doc_id
        assert got[r.doc_id].predicted == int(want >= 0.3)
        hit += got[r.doc_id].hits > 0
    assert hit > 5
