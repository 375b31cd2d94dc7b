"""Language identification as mixture inference.

A model holds, for each language, log probabilities of hashed byte 4-grams. A document is a bag of
words, each drawn from one language; expectation-maximisation finds the proportions. The language
set is chosen by penalised likelihood: the sets are nested (best single language first, then by
proportion), and a further language must raise the log-likelihood by more than the penalty.
All arithmetic runs in numpy over whole Arrow batches: words of all documents lie in one array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import bounded_sample, held_out, mapped, small_batches

BITS = 16
GRAM = 4
CELLS = 1 << 18  # numbers that the table gives at once, whatever the number of languages
HAS_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are no letters become spaces; all bytes of longer code points stay.
TO_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (2**BITS, languages): log probability less the mean over languages


def _bytes(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(TO_LETTERS) + b"    "


def grams(joined: bytes) -> np.ndarray:
    """The hash of the 4 bytes from each position but the last three."""
    a = np.frombuffer(joined, np.uint8).astype(np.uint32)
    v = a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24
    return (v * np.uint32(2654435761)) >> np.uint32(32 - BITS)


BLANKS = grams(b"    ")[0]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = 20_000) -> Model:
    """Learn from a sample of at most about ``rows`` rows with text and language, held-out rows apart."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sample = bounded_sample(known, F.col("id"), rows).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = grams(_bytes(t))
                sums[k] = sums.get(k, 0) + np.bincount(h, minlength=1 << BITS)
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["lang", "gram", "n"])

    got = sample.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    table = np.full((1 << BITS, len(languages)), 0.5)
    for i, k in enumerate(languages):
        own = got[got["lang"] == k]
        table[own["gram"].to_numpy(), i] += own["n"].to_numpy()
    table = np.log(table / table.sum(axis=0)) if languages else table
    table = (table - table.mean(axis=1, keepdims=True)).astype(np.float32) if languages else table
    table[BLANKS] = 0  # blanks tell nothing, however many of them follow a word
    return Model(languages, table)


def mixtures(texts: list[str | None], model: Model, rounds: int = 8, most: int | None = None, penalty: float = 2.0, floor: float = -12.0):
    """(proportions (documents, languages), size of the chosen set). Documents without words: zeros.
    Sets grow up to ``most`` languages (default: all) as long as the likelihood pays for the penalty."""
    k, n = len(model.languages), len(texts)
    if not n or not k:
        return np.zeros((n, k)), np.zeros(n, int)
    parts = [_bytes(t) for t in texts]
    joined = b"".join(parts)
    a = np.frombuffer(joined, np.uint8)
    inside = a != 32
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    doc = np.searchsorted(np.cumsum([len(p) for p in parts]), start, side="right")
    if not len(start):
        return np.zeros((n, k)), np.zeros(n, int)
    # each position's gram counts for the word whose first letter is at or after the gram's start
    h = grams(joined)
    edges = np.cumsum([len(p) for p in parts])[:-1]
    h[edges - 1] = h[edges - 2] = BLANKS  # they reach into the next text
    ll = np.empty((len(start), k), np.float32)
    ends = np.append(start[1:], len(h) + start[0]) - start[0]
    lo = 0
    while lo < len(start):  # words whose table rows fill CELLS numbers, at least one
        hi = max(lo + 1, int(np.searchsorted(ends, start[lo] - start[0] + CELLS // k, side="right")))
        a, b = start[lo] - 1, start[0] - 1 + ends[hi - 1]
        ll[lo:hi] = np.add.reduceat(model.table[h[a:b]], start[lo:hi] - start[lo], axis=0)
        lo = hi
    ll -= ll.max(axis=1, keepdims=True)
    np.maximum(ll, floor, out=ll)
    p = np.exp(ll)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    own = doc[first]
    words = np.diff(np.append(first, len(doc)))
    row = np.repeat(np.arange(len(own)), words)

    def fit(pi, times):
        for _ in range(times):
            r = p * pi[row]
            r /= r.sum(axis=1, keepdims=True)
            pi = np.add.reduceat(r, first, axis=0) / words[:, None]
        return pi

    def likelihood(pi):
        return np.add.reduceat(np.log(np.maximum((p * pi[row]).sum(axis=1), 1e-30)), first)

    single = np.add.reduceat(ll, first, axis=0)
    best = single.argmax(axis=1)
    chosen = np.eye(k, dtype=np.float32)[best]
    size = np.ones(len(own), int)
    most = k if most is None else min(most, k)
    if most > 1:
        full = fit(np.full((len(own), k), 1 / k, np.float32), rounds)
        rank = full.copy()
        rank[np.arange(len(own)), best] = 2
        order = np.argsort(-rank, axis=1, kind="stable")
        at = single[np.arange(len(own)), best]
        for s in range(2, most + 1):
            mask = np.zeros((len(own), k), np.float32)
            np.put_along_axis(mask, order[:, :s], 1, axis=1)
            pi = full * mask + 1e-3 * mask
            pi = fit(pi / pi.sum(axis=1, keepdims=True), max(2, rounds // 2))
            now = likelihood(pi)
            # a further language is a further parameter, priced by the number of words
            better = now - at > (s - size) * (penalty * 0.5 * np.log(words + 1) + penalty)
            chosen[better], size[better], at = pi[better], s, np.where(better, now, at)
    out, sizes = np.zeros((n, k)), np.zeros(n, int)
    out[own], sizes[own] = chosen, size
    return out, sizes


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all of ``docs``) plus lang_pred, score, languages, proportions.

    score is the proportion of lang_pred in the document. A text that is null or has no letter gives
    ``und``, score 0 and empty arrays; so does every text where the model knows no language. Ties go
    to the first language in alphabetical order. Columns of ``docs`` with the new names give way.
    """

    def make():
        def work(texts):
            # in parts of bounded size: rows by words by languages are held several times
            sizes = np.cumsum([len(t or "") for t in texts]) // max(1, CELLS * 4 // max(1, len(model.languages)))
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)] if len(texts) else [0]
            parts = [mixtures(texts[a:b], model) for a, b in zip(cuts, cuts[1:], strict=False)]
            pi, size = np.concatenate([x for x, _ in parts]) if parts else np.zeros((0, len(model.languages))), np.concatenate([n for _, n in parts]) if parts else []
            lang, score, names, shares = [], [], [], []
            for t, x, s in zip(texts, pi, size, strict=True):
                if not s or not HAS_LETTER.search(t or ""):
                    lang.append("und"), score.append(0.0), names.append([]), shares.append([])
                    continue
                order = np.argsort(-x, kind="stable")[:s]
                lang.append(model.languages[order[0]])
                score.append(min(1.0, float(x[order[0]])))
                names.append([model.languages[i] for i in order])
                shares.append([float(x[i]) for i in order])
            return [lang, score, names, shares]

        return work

    return mapped(docs, text, docs.columns if keep is None else keep, "lang_pred string, score double, languages array<string>, proportions array<double>", make)


__all__ = ["Model", "identify", "mixtures", "train"]
