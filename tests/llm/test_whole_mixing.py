"""Mixing: totals meet their targets on skewed tables, or the gap is told."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from affinis.llm import mixing


def known(spark, p, t):
    return spark.createDataFrame([(int(n), list(map(float, q))) for n, q in zip(t, p, strict=True)], "tokens long, p array<double>")


@pytest.mark.parametrize("rare", [0.002, 0.005, 0.01])
@pytest.mark.parametrize("soft", [0.0, 0.003])
def test_totals_of_rare_domains_meet_their_targets(spark, rare, soft):
    p = np.repeat(np.eye(3), [665, 335 - int(1000 * rare), int(1000 * rare)], axis=0) * (1 - 3 * soft) + soft
    t = np.full(len(p), 100)
    f = mixing.fit(known(spark, p, t), mixing.DOMAINS, mixing.TARGETS)
    r = f.rates(p)
    assert (r >= 0).all() and (np.abs((r * t) @ p / f.targets - 1) <= 0.01).all() and f.missed.max() <= 0.01


def test_targets_out_of_reach_are_told(spark):
    p = np.full((50, 3), 1 / 3)
    with pytest.warns(UserWarning, match="toxic"):
        f = mixing.fit(known(spark, p, np.full(50, 10)), mixing.DOMAINS, mixing.TARGETS)
    assert f.missed.max() > 0.01 and np.isfinite(f.rates(p)).all()


def central(p, t, goal, ridge, rounds=200_000):
    """The objective of the module's docstring by plain projected gradient steps on all rates."""
    r = np.ones(len(p))
    step = 1 / (ridge + max(np.linalg.eigvalsh((p * t[:, None]).T @ (p / goal))))
    for _ in range(rounds):
        n = np.maximum(0.0, r - step * (p @ (((r * t) @ p - goal) / goal) + ridge * (r - 1)))
        if np.abs(n - r).max() < 1e-12:
            break
        r = n
    return r


@pytest.mark.parametrize("weights", [{"plain": 0.5, "low": 0.3, "toxic": 0.2}, {"plain": 0.9, "low": 0.06, "toxic": 0.04}])
def test_rates_equal_a_central_solver(spark, weights):
    rnd = np.random.RandomState(4)
    p, t = rnd.dirichlet([0.3] * 3, 300), rnd.randint(0, 500, 300)
    f = mixing.fit(known(spark, p, t), mixing.DOMAINS, weights)
    r, want = f.rates(p), central(p, t, f.targets, f.ridge)
    assert np.allclose(r[t > 0], want[t > 0], atol=1e-3)
    d = known(spark, p, t).select(f.rate(F.col("p")).alias("r")).collect()
    assert np.allclose([x.r for x in d], r, atol=1e-12)


def plain_features(text, odds):
    """What the fast features stand for."""
    t, k = text or "", odds.shape[1]
    x = np.zeros(mixing.FORM + 2 * k)
    x[0] = 1
    if not t:
        return x
    words, n = t.split(), len(t)
    w = max(1, len(words))
    x[1 : mixing.FORM] = min(1, 4 * len(mixing.SIGN.findall(t)) / n), min(1, 4 * sum(c in "0123456789" for c in t) / n), sum(x.isupper() for x in words) / w, len(set(words)) / w, min(1, t.count("\n") / w), min(2, n / w / 10), np.log1p(len(words)) / 10
    b = sorted({xxhash.xxh3_64_intdigest(x) & (mixing.BUCKETS - 1) for x in mixing.WORD.findall(t.lower())})
    if b:
        o = np.sort(odds[b], axis=0)[::-1]
        x[mixing.FORM : mixing.FORM + k], x[mixing.FORM + k :] = o[0] / 3, o[: mixing.TOP].sum(axis=0) / (3 * mixing.TOP)
    return x


def test_features_equal_their_plain_form(spark):
    odds = np.random.RandomState(2).randn(mixing.BUCKETS, 3).astype(np.float32)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in [*texts, None, "", " ", "A1b_c ÄÖ²\n\t12 x-y İI", "日本 🙂", "w " * 5000]:
        assert np.allclose(mixing.features(t, odds), plain_features(t, odds), atol=1e-5), t
