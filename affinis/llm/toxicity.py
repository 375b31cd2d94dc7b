"""Toxicity scores from a mined lexicon, fuzzy matching and context windows.

1. Terms (whole words, and stems that open words) are mined from labelled rows by how much more
   often toxic documents hold them.
2. Words are matched by the automaton that arises when the Levenshtein automata of distance 1 are
   intersected with the trie of all terms. Its states are sets of (trie node, edits) and are
   determinised as they are met, so a word costs a few table steps and most words die early.
   Words with one digit or sign inside are matched whole where none of their letter runs is a hit.
3. Each hit is weighed by its context window: marks of quotation and words of reporting around it
   speak for a quotation, address of the reader for abuse.
4. A logistic regression on a few sums of these scores gives the document's score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import bounded_sample, held_out, mapped, small_batches

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W_]+|[\"'“”„‟«»‹›‘’]")
#: Two runs of letters with one digit or sign between them; a second one would be a second edit.
BROKEN = re.compile(r"(?<![^\W\d_])([^\W\d_]+)([^\w\s]|[\d_])(?=([^\W\d_]+))")
FUZZY_FROM = 5  # letters a term needs before one edit is allowed
# fixed values: marks of quotation, words of reporting, words of address
QUOTES = set("\"“”„‟«»‹›")
REPORTING = {"said", "says", "quoted", "quote", "quotes", "wrote", "called", "term", "word", "dit", "écrit", "sagte", "schrieb", "dijo", "escribió"}
ADDRESS = {"you", "your", "youre", "tu", "toi", "vous", "du", "dich", "ihr", "tú", "ti", "usted"}


class Matcher:
    """Lazily determinised product of distance-1 automata with a trie of (term, weight, is_stem)."""

    def __init__(self, terms: list[tuple[str, float, bool]]):
        self.child: list[dict[str, int]] = [{}]
        self.end: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.depth = [0]
        for term, weight, stem in terms:
            at = 0
            for ch in term:
                if ch not in self.child[at]:
                    self.child[at][ch] = len(self.child)
                    self.child.append({})
                    self.end.append(0.0), self.stem.append(0.0), self.depth.append(self.depth[at] + 1)
                at = self.child[at][ch]
            (self.stem if stem else self.end)[at] = max(weight, (self.stem if stem else self.end)[at])
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.accept: list[tuple[int, float]] = []  # kind 0 none, 1 exact, 2 stem, 3 one edit
        self.start = self._state(frozenset([(0, 0)]))

    def _state(self, s: frozenset) -> int:
        if s not in self.ids:
            self.ids[s] = len(self.sets)
            self.sets.append(s)
            self.step.append({})
            self.accept.append(self._accepts(s))
        return self.ids[s]

    def _accepts(self, s) -> tuple[int, float]:
        exact = [self.end[n] for n, e in s if n >= 0 and e == 0 and self.end[n] > 0]
        if exact:
            return 1, max(exact)
        stems = [self.stem[~n] for n, _ in s if n < 0]
        if stems:
            return 2, max(stems)
        near = [self.end[n] for n, e in s if n >= 0 and e == 1 and self.end[n] > 0 and self.depth[n] >= FUZZY_FROM]
        near += [self.end[c] for n, e in s if n >= 0 and e == 0 for c in self.child[n].values() if self.end[c] > 0 and self.depth[c] >= FUZZY_FROM]
        return (3, max(near)) if near else (0, 0.0)

    def _next(self, s, ch) -> frozenset:
        out = set()
        for n, e in s:
            if n < 0:  # behind a stem everything is taken
                out.add((n, e))
                continue
            kids = self.child[n]
            if ch in kids:
                out.add((kids[ch], e))
            if e == 0:
                out.add((n, 1))  # a letter too many
                for c in kids.values():
                    out.add((c, 1))  # another letter
                    if ch in self.child[c]:
                        out.add((self.child[c][ch], 1))  # a letter left out
        out |= {(~n, 0) for n, e in out if n > 0 and e == 0 and self.stem[n] > 0}
        return frozenset(x for x in out if not (x[1] == 1 and (x[0], 0) in out))

    def match(self, word: str) -> tuple[int, float]:
        at = self.start
        for ch in word:
            nxt = self.step[at].get(ch)
            if nxt is None:
                # letters outside the trie's alphabet share the transitions of any such letter
                nxt = self.step[at][ch] = self._state(self._next(self.sets[at], ch))
            at = nxt
            if not self.sets[at]:
                return 0, 0.0
        return self.accept[at]


@dataclass
class Model:
    terms: list[tuple[str, float, bool]]
    weights: np.ndarray
    fuzzy: float = 0.7
    quoted: float = 0.15
    window: int = 6


FEATURES = 7


def _broken(lower: str, hits: dict[str, tuple[int, float]], matcher: Matcher) -> list[tuple[int, int]]:
    """Spans of words with a digit or sign inside that match a term; adds them to ``hits``."""
    spans: list[tuple[int, int]] = []
    for x in BROKEN.finditer(lower):
        a, b = x.start(), x.end(3)
        if b - a < FUZZY_FROM or x[1] in hits or x[3] in hits or (spans and a < spans[-1][1]):
            continue
        m = matcher.match(lower[a:b])
        if m[0]:
            hits[lower[a:b]] = m
            spans.append((a, b))
    return spans


def _joined(lower: str, spans: list[tuple[int, int]]) -> list[str]:
    """Tokens, with each span as one token in place of those that it meets."""
    out, i = [], 0
    for t in TOKEN.finditer(lower):
        if i == len(spans) or t.end() <= spans[i][0]:
            out.append(t[0])
        while i < len(spans) and spans[i][1] <= t.end():  # the last token that meets the span
            out.append(lower[slice(*spans[i])])
            i += 1
    return out


def features(text: str | None, matcher: Matcher, model: Model) -> np.ndarray:
    """Sums over the hits of a text: bias, any, log count, log weight, density, best, stems."""
    out = np.zeros(FEATURES)
    out[0] = 1
    lower = (text or "").lower()
    words = set(WORD.findall(lower))
    hits = {w: m for w in words if (m := matcher.match(w))[0]}
    broken = _broken(lower, hits, matcher)
    if not hits:
        return out
    tokens = _joined(lower, broken) if broken else TOKEN.findall(lower)
    scores, stems = [], 0
    for i, w in enumerate(tokens):
        m = hits.get(w) or (hits.get(w.strip("0123456789")) if not w.isalpha() else None)
        if not m:
            continue
        left, right = tokens[max(0, i - model.window) : i], tokens[i + 1 : i + 1 + model.window]
        s = m[1] * (model.fuzzy if m[0] == 3 else 1.0)
        quoted = (sum(x in QUOTES for x in left) % 2 == 1 and any(x in QUOTES for x in right)) or any(x in REPORTING for x in left[-3:])
        if quoted and not any(x in ADDRESS for x in left[-2:] + right[:1]):
            s *= model.quoted
        scores.append(s)
        stems += m[0] == 2
    if scores:
        total = sum(scores)
        out[1:] = min(1.0, max(scores) / 3), np.log1p(len(scores)), np.log1p(total), total / (10 + len(tokens)) ** 0.5, max(scores) / 3, np.log1p(stems)
    return out


def mine(words: DataFrame, positives: int, negatives: int) -> list[tuple[str, float, bool]]:
    """Terms from (term, stem, n1, n0): document counts in toxic and other rows. All that pass the
    thresholds; their number is bounded by the words of the sample."""
    base = positives / max(1, positives + negatives)
    share = F.col("n1") / (F.col("n1") + F.col("n0"))
    expected = (F.col("n1") + F.col("n0")) * base
    z = (F.col("n1") - expected) / F.sqrt(expected * F.lit(max(1e-9, 1 - base)) + F.lit(0.25))
    rows = words.where((F.col("n1") >= 3) & (share >= 0.75) & (z >= 4.5)).select("term", "stem", "n1", "n0", z.alias("z")).orderBy(F.desc("z"), "term", "stem").collect()
    odds = lambda r: float(np.clip(np.log((r.n1 + 0.5) / (r.n0 + 0.5)) - np.log(max(positives, 1) / max(negatives, 1)), 0.5, 6))
    kept: set[str] = set()
    for r in sorted((r for r in rows if r.stem), key=lambda r: len(r.term)):  # a longer stem of a kept stem adds nothing
        if not any(r.term[:k] in kept for k in range(1, len(r.term))):
            kept.add(r.term)
    return [(r.term, odds(r), r.stem) for r in rows if not r.stem or r.term in kept]


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Model:
    """Learn terms and weights from a sample of at most about ``rows`` labelled rows that are not
    held out. The sampled labels (two short columns) are the side that is broadcast. Rows with a null
    id or label are passed over; an id with several labels counts as toxic if one of them is 1."""
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    sample = bounded_sample(own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), F.col("doc_id"), rows)
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")
    rows_ = rows_.persist()
    try:
        n = {r.toxic: r.n for r in rows_.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        pos, neg = n.get(1, 0), sum(v for k, v in n.items() if k != 1)

        def spread(batches):
            import pyarrow as pa

            for b in batches:
                term, stem, y1 = [], [], []
                for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = set(WORD.findall((t or "").lower()))
                    opens = {w[:k] for w in words for k in (4, 5, 6) if len(w) > k}
                    term += [*words, *opens]
                    stem += [False] * len(words) + [True] * len(opens)
                    y1 += [int(y == 1)] * (len(words) + len(opens))
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(stem, pa.bool_()), pa.array(y1, pa.int64())], names=["term", "stem", "y1"])

        counts = rows_.mapInArrow(spread, "term string, stem boolean, y1 long").groupBy("term", "stem").agg(F.sum("y1").alias("n1"), F.sum(1 - F.col("y1")).alias("n0"))
        terms = mine(counts, pos, neg)
        model = Model(terms, np.array([-3.0, 3.0, 0.5, 0.5, 0.0, 0.5, 0.0]))
        if not pos or not neg:
            return model
        got = mapped(rows_, "text", ["toxic"], "x array<double>", lambda: _featurise(model)).toPandas()
        model.weights = _logistic(np.array(got["x"].tolist()), (got["toxic"] == 1).to_numpy(float))
        return model
    finally:
        rows_.unpersist()


def _featurise(model: Model):
    matcher = Matcher(model.terms)
    return lambda texts: [[features(t, matcher, model).tolist() for t in texts]]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, cut: float = 0.3) -> DataFrame:
    """Columns ``keep`` (default: all) plus score, predicted (1 if score >= ``cut``) and hits.

    Null texts count as empty; a text without words gets the score of a text without hits. Repeated
    rows get equal scores. Columns of ``docs`` with the new names give way.
    """

    def make():
        matcher = Matcher(model.terms)

        def work(texts):
            x = np.array([features(t, matcher, model) for t in texts]).reshape(len(texts), FEATURES)
            s = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            return [s.tolist(), (s >= cut).astype(int).tolist(), np.rint(np.expm1(x[:, 2])).astype(int).tolist()]

        return work

    return mapped(docs, text, docs.columns if keep is None else keep, "score double, predicted int, hits int", make)
