"""Mixing documents to target weights of domains, with soft membership.

1. A softmax classifier over form features and the log odds of hashed words is fitted on a bounded
   sample of labelled rows. It gives every document posteriors p over the domains.
2. Every document gets a nonnegative rate r. Expected token totals of the domains are
   S_k = sum r t p_k. The rates nearest to 1 whose totals meet the targets are the projections
   r = max(0, 1 + p . y) of one number y_k a domain. These minimise
       1/2 sum_k (S_k - T_k)^2 / T_k + ridge/2 sum t (r - 1)^2
   for a ridge that falls until the totals are met. y follows gradient steps that are scaled by the
   derivative of the totals, so that rare domains move as fast as large ones; after each step the
   rates are projected to 0 and above again. Each round is one distributed sum of the totals and
   their derivative; a rate depends on the document's own p and on y only, so rounds exchange
   nothing else, and a lost task is simply computed again.
3. A rate becomes copies: its whole part, and one more with the chance of its fraction, decided by a
   hash of the id.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import bounded_sample, dropped, held_out, mapped, numbers, small_batches, written

DOMAINS = ["plain", "low", "toxic"]
#: Target shares of expected tokens; the total is such that ``plain`` keeps a little more than it has.
TARGETS = {"plain": 0.86, "low": 0.09, "toxic": 0.05}
ANCHOR, LIFT = "plain", 1.02
BUCKETS = 1 << 18
HELD = 200_000  # runs of signs whose hashes a task holds
FORM, TOP, LEAST = 8, 5, 3
SIGN = re.compile(r"[^\w\s]")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    domains: list[str]
    odds: np.ndarray  # (BUCKETS, domains): smoothed log odds of hashed words, 0 for rare ones
    weights: np.ndarray  # (features, domains)


class _Buckets(dict):
    """The hashed words of each run of signs between white space: a number, or a tuple if they are not
    just one. Forgets all when it holds too many."""

    def __missing__(self, run: str) -> int | tuple[int, ...]:
        if len(self) >= HELD:
            self.clear()
        got = tuple([xxhash.xxh3_64_intdigest(w) & (BUCKETS - 1) for w in WORD.findall(run.lower())])
        got = self[run] = got[0] if len(got) == 1 else got
        return got


_known = _Buckets()


def buckets(runs: set[str]) -> np.ndarray:
    """Distinct hashed words of the runs of a text."""
    got = set(map(_known.__getitem__, runs))
    for many in [x for x in got if type(x) is tuple]:
        got.discard(many)
        got.update(many)
    return np.sort(np.fromiter(got, np.int64, len(got)))


@cache
def _kinds() -> np.ndarray:
    """For each code point: 1 a sign (neither word nor space), 2 an ASCII digit, else 0."""
    out = np.zeros(0x110000, np.uint8)
    out[[m.start() for m in SIGN.finditer("".join(map(chr, range(0x110000))))]] = 1
    out[48:58] = 2
    return out


def features(text: str | None, odds: np.ndarray) -> np.ndarray:
    """Form (shares of signs, digits, capitals, distinct words, lines; lengths), and of each domain
    the largest log odds of a word and the mean of the TOP largest."""
    t = text or ""
    k = odds.shape[1]
    x = np.zeros(FORM + 2 * k)
    x[0] = 1
    n = len(t)
    if not n:
        return x
    words = t.split()
    runs = set(words)
    signs, digits = np.bincount(_kinds()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=3)[1:].tolist()
    w = max(1, len(words))
    x[1:FORM] = min(1, 4 * signs / n), min(1, 4 * digits / n), sum(map(str.isupper, words)) / w, len(runs) / w, min(1, t.count("\n") / w), min(2, n / w / 10), np.log1p(len(words)) / 10
    b = buckets(runs)
    if len(b):
        o = odds[b]
        top = -np.partition(-o, min(TOP, len(o)) - 1, axis=0)[:TOP]
        x[FORM : FORM + k] = o.max(axis=0) / 3
        x[FORM + k :] = top.sum(axis=0) / (3 * TOP)
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fitted(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-3, rounds: int = 400, rate: float = 0.1) -> np.ndarray:
    """Softmax regression by Adam on the whole sample; deterministic."""
    w = np.zeros((x.shape[1], classes))
    m, v = np.zeros_like(w), np.zeros_like(w)
    target = np.eye(classes)[y]
    for i in range(1, rounds + 1):
        g = x.T @ (_softmax(x @ w) - target) / len(x) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return w


def _odds(counts, sizes: np.ndarray, smooth: float = 4.0) -> np.ndarray:
    """Log odds of each domain against the rest, drawn towards 0 by ``smooth`` made-up rows."""
    k = len(sizes)
    out = np.zeros((BUCKETS, k), np.float32)
    if not len(counts) or sizes.sum() == 0:
        return out
    n = counts[[f"n{i}" for i in range(k)]].to_numpy(float)
    prior = np.clip(sizes / sizes.sum(), 1e-3, 1 - 1e-3)
    own, rest = n + smooth * prior, n.sum(axis=1, keepdims=True) - n + smooth * (1 - prior)
    out[counts["word"].to_numpy()] = np.log(own / rest) - np.log(prior / (1 - prior))
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = 8000) -> Model:
    """Fit on at most about ``rows`` labelled rows, held-out rows apart. A row is toxic if its label
    says so, else low if its quality is 0, else plain; null labels are passed over. The sampled labels
    are the side that is broadcast. Without labels every domain is equally likely."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    k = len(DOMAINS)
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 0)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull() & ~held_out(F.col("doc_id")))
    sample = bounded_sample(own.groupBy("doc_id").agg(F.max("domain").alias("domain")), F.col("doc_id"), rows)
    both = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("domain", "text"), "labelled")
    sizes = np.zeros(k)
    for r in both.groupBy("domain").agg(F.count("*").alias("n")).collect():
        sizes[r["domain"]] = r["n"]

    def spread(batches):
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = buckets(set((t or "").split()))
                yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), *(pa.array(np.full(len(w), int(y == i))) for i in range(k))], names=["word", *(f"n{i}" for i in range(k))])

    counts = both.mapInArrow(spread, "word int, " + ", ".join(f"n{i} long" for i in range(k))).groupBy("word").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(k))).where(" + ".join(f"n{i}" for i in range(k)) + f" >= {LEAST}").toPandas()
    odds = _odds(counts, sizes)
    got = mapped(both, "text", ["domain"], "x array<double>", lambda: lambda texts: [[features(t, odds).tolist() for t in texts]]).toPandas()
    dropped(both)
    if not len(got):
        return Model(DOMAINS, odds, np.zeros((FORM + 2 * k, k)))
    return Model(DOMAINS, odds, fitted(np.array(got["x"].tolist()), got["domain"].to_numpy(), k))


def posteriors(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) plus tokens (words between white space) and p, the posteriors."""

    def make():
        def work(texts):
            if not texts:
                return [[], []]
            p = _softmax(np.array([features(t, model.odds) for t in texts]) @ model.weights).astype(np.float64)
            return [[len((t or "").split()) for t in texts], (p / p.sum(axis=1, keepdims=True)).tolist()]

        return work

    return mapped(docs, text, docs.columns if keep is None else keep, "tokens long, p array<double>", make)


@dataclass
class Fit:
    targets: np.ndarray
    totals: np.ndarray
    y: np.ndarray
    ridge: float

    @property
    def missed(self) -> np.ndarray:
        """How far each total is from its target, as a share of it."""
        return np.abs(self.totals - self.targets) / np.where(self.targets > 0, self.targets, 1.0)

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1 + p @ self.y)

    def rate(self, p: Column) -> Column:
        return F.greatest(F.lit(0.0), reduce(lambda r, k: r + p[k] * F.lit(float(self.y[k])), range(len(self.y)), F.lit(1.0)))


def fit(known: DataFrame, domains: list[str], weights: dict[str, float], anchor: str = ANCHOR, lift: float = LIFT, ridge: float = 1e-2, rounds: int = 200, tolerance: float = 1e-2) -> Fit:
    """known: tokens, p. The rates that minimise the objective for the first of ``ridge``, a tenth of
    it and so on, that brings every domain's total within ``tolerance`` of its target. Where none down
    to a millionth does, the rates of the full ridge are given and it warns; ``missed`` says by how
    much. It raises where ``rounds`` sums were not enough to find a minimum."""
    import pyarrow as pa

    k = len(domains)
    share = np.array([weights[d] for d in domains], float)
    if (share <= 0).any():
        raise ValueError("target weights must be positive")
    share /= share.sum()
    left = rounds

    def sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, their derivative by y, and sum t r^2 / 2, whose derivative the totals are."""
        nonlocal left
        left -= 1
        if left < 0:
            raise RuntimeError(f"no minimum within {rounds} rounds")

        def run(batches):
            s = np.zeros(k + k * k + 1)
            for b in batches:
                if b.num_rows:
                    p, t = b.column(1).flatten().to_numpy().reshape(-1, k), b.column(0).to_numpy()
                    r = np.maximum(0.0, 1 + p @ y)
                    s[:k] += (r * t) @ p
                    s[k:-1] += ((p * (t * (r > 0))[:, None]).T @ p).ravel()
                    s[-1] += (t * r) @ r / 2
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(s)], names=["k", "s"])

        with numbers(known.sparkSession):
            rows = known.select("tokens", "p").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(k + k * k + 1)
        for r in rows:
            out[r.k] = r.s
        return out[:k], out[k:-1].reshape(k, k), float(out[-1])

    y = np.zeros(k)
    now, slope, half = sums(y)
    at = domains.index(anchor)
    goal = share * (lift * now[at] / share[at])
    if not now[at] > 0:
        return Fit(goal, now, y, ridge)
    first, pull = None, ridge
    while True:
        # the least of the convex sum t r^2 / 2 - T . y + pull/2 y . T y is where the objective is least
        g = now - goal + pull * goal * y
        if (np.abs(g) <= 0.01 * tolerance * goal).all():
            f = Fit(goal, now, y, pull)
            if f.missed.max() <= tolerance:
                return f
            first, pull = first or f, pull / 10
            if pull < 1e-6 * ridge:  # out of reach: without the full ridge, rates would grow for nothing
                warnings.warn("totals off their targets by " + ", ".join(f"{n} {x:.1%}" for n, x in zip(domains, first.missed, strict=True)), stacklevel=2)
                return first
            continue
        d = -np.linalg.solve(slope + np.diag(pull * goal), g)
        height, size = half - goal @ y + pull / 2 * (goal * y) @ y, 1.0
        while True:
            z = y + size * d
            s, m, h = sums(z)
            if h - goal @ z + pull / 2 * (goal * z) @ z <= height + 1e-4 * size * (g @ d) + 1e-12 * abs(height):
                y, now, slope, half = z, s, m, h
                break
            size /= 2


def copies(rate: Column, key: Column) -> Column:
    """floor(rate), and one more with the chance of the fraction."""
    unit = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, model: Model, weights: dict[str, float] | None = None, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) plus tokens, p_<domain> for each domain, rate and copies.

    Null and empty texts have no tokens; their rate follows from the posteriors of an empty text.
    Repeated rows get equal rates. Where the anchor domain has no tokens all rates are 1. Where no
    rates meet the targets, those of the full ridge are used, and ``fit`` warns. Columns of ``docs``
    with the new names give way.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"tokens", "p", "rate", "copies", *(f"p_{d}" for d in model.domains)}]
    known = written(posteriors(docs.select(*names, F.col(text).alias("_body_"), F.col(doc_id).alias("_id_")), model, "_body_", [*names, "_id_"]), "posteriors")
    f = fit(known, model.domains, weights or TARGETS)

    out = known.withColumn("rate", f.rate(F.col("p")))
    return out.select(*names, "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", copies(F.col("rate"), F.col("_id_")).alias("copies"))
