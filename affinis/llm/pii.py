"""Personal data: fixed patterns, and a linear-chain conditional random field beside them.

The patterns give the base spans. The random field tags tokens by their shapes and those of their
neighbours, and adds spans that the patterns miss: addresses with a spelled-out at and dot, phone
numbers without the plus, grouped card numbers. It is trained by gradient ascent on a small labelled
table and decoded by Viterbi for many windows at once in numpy.

Decoding is constrained: a token can be part of a span only near a trigger (a digit, an at sign, or
a spelled-out at or dot) or where it is joined to such tokens around an address. Elsewhere the tag is
O, so the chain falls apart into windows of any length, and decoding these is exact for the whole
text. Tagged addresses are completed by what their form joins to them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from affinis.llm.common import mapped, ragged

# fixed values: the kinds in the order of the result, and the base patterns
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only start where a run of digits does, and takes whole runs: so no digit is read often
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, without those that fail their check."""
    out: list[Span] = []
    text = text or ""
    if "@" in text:
        # the local part cannot hold an at sign, so the match of each at sign starts at the head
        # of the run of local characters before it, but not inside the match before
        last = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- the random field -------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
REACH = 5  # tokens around a trigger that may belong to a span
OFFSETS = (-2, -1, 0, 1, 2)
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Words that have a feature of their own; all other words are known by their shapes.
KEYWORDS = frozenset("at dot com org net tel phone call fax card visa number no email mail ip address host port version ref order token id line page year".split())

#: The small labelled table: (text, kind) with the span in [[ ]]; no mark: no personal data.
LABELLED: list[tuple[str, str]] = [
    ("write to [[anna.berg at mail dot example dot com]] today", "email"),
    ("reach me: [[tom_k (at) host dot org]] or later", "email"),
    ("contact [[li42 [at] box7.example.net]] please", "email"),
    ("my email is [[j.doe at example dot org]].", "email"),
    ("mail [[sam at home dot net]], thanks", "email"),
    ("we meet at noon in the hall and dot the page", ""),
    ("look at the com port of the host", ""),
    ("call [[(555) 123-4567]] now", "phone"),
    ("tel [[555-123-4567]] after six", "phone"),
    ("phone: [[(030) 9876 5432]] or mail", "phone"),
    ("the number is [[555.867.5309]], ask for Ann", "phone"),
    ("fax [[(212) 555-0187]].", "phone"),
    ("tel. [[0171 555 2368]] works", "phone"),
    ("call me [[988-555-2485]] in the evening", "phone"),
    ("card [[4111 1111 1111 1111]] expires soon", "card"),
    ("paid by visa [[4012-8888-8888-1881]] on Monday", "card"),
    ("visa card no [[5500.0000.0000.0004]] was used", "card"),
    ("card number [[3782 822463 10005]]", "card"),
    ("host [[10 . 0 . 0 . 12]] is down", "ip"),
    ("ip address [[192 . 168 . 1 . 7]] answered", "ip"),
    ("ip [[172.16. 4. 9]] port 80", "ip"),
    ("in 1987 there were 250 of them and 13 left", ""),
    ("version 2.10.3 fixes line 88 of page 12", ""),
    ("order 48213-77 ref 2024-03-15 page 4", ""),
    ("from 10 to 12 of 30, about 45 %", ""),
    ("token = \"24be64439e3e49cf46b2\" and id 99120", ""),
    ("### 4785 ### 53 %%% 7 $$$", ""),
    ("the price is 1,250,000 in 2019 - 2021", ""),
    ("at 5 o'clock on 12.05.2020 we left", ""),
    ("rows 1 2 3 4 5 6 7 8 9 10", ""),
    ("scores 12-7, 9-11 and 15-13", ""),
    ("see section 3.2.1.4 and figure 7", ""),
    ("password=b7db7aa4a5fcc78305 is set", ""),
]


def shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 7)}"
    if token.isalpha():
        return "X" if token.isupper() else "Xx" if token[:1].isupper() else "x1" if len(token) == 1 else "x"
    return token


def _tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


@dataclass
class Field:
    keys: dict[str, int]
    emit: np.ndarray  # (offsets, keys, tags)
    move: np.ndarray  # (tags, tags)
    joint: dict[str, int]
    pair: np.ndarray  # (pairs of shapes, tags)

    def key(self, token: str) -> int:
        low = token.lower()
        return self.keys.get(f"w:{low}", -1) if low in KEYWORDS else self.keys.get(shape(token), -1)


def _allowed_moves() -> np.ndarray:
    bad = np.zeros((len(TAGS), len(TAGS)))
    for i, a in enumerate(TAGS):
        for j, b in enumerate(TAGS):
            if b[0] == "I" and (a == "O" or a[2:] != b[2:]):
                bad[i, j] = -1e4
    return bad


START = np.array([-1e4 if t[0] == "I" else 0.0 for t in TAGS])


def _emissions(k: np.ndarray, f: Field) -> np.ndarray:
    """k: (windows, length) keys, the last row of emit is for tokens unknown and beyond the edge."""
    w, n = k.shape
    wide = np.pad(k, ((0, 0), (2, 2)), constant_values=f.emit.shape[1] - 1)
    return sum(f.emit[i, wide[:, 2 + o : 2 + o + n]] for i, o in enumerate(OFFSETS))


def train(labelled: list[tuple[str, str]] | None = None, rounds: int = 300, rate: float = 0.3, ridge: float = 0.02) -> Field:
    """Maximum conditional likelihood by Adagrad; exact gradients from forward-backward sums."""
    rows = []
    for raw, kind in LABELLED if labelled is None else labelled:
        a, b = raw.find("[[") if kind else -1, raw.rfind("]]")
        text = raw if a < 0 else raw[:a] + raw[a + 2 : b] + raw[b + 2 :]
        toks = _tokens(text)
        tags = [0] * len(toks)
        inside = [i for i, (s, e) in enumerate(toks) if a >= 0 and s >= a and e <= b - 2]
        for n, i in enumerate(inside):
            tags[i] = TAGS.index(("I-" if n else "B-") + kind)
        rows.append(([text[s:e] for s, e in toks], tags))
    names = sorted({f"w:{t.lower()}" if t.lower() in KEYWORDS else shape(t) for ts, _ in rows for t in ts})
    keys = {n: i for i, n in enumerate(names)}
    f = Field(keys, np.zeros((len(OFFSETS), len(keys) + 1, len(TAGS))), np.zeros((len(TAGS), len(TAGS))), {}, np.zeros((0, len(TAGS))))
    width = max(len(t) for t, _ in rows)
    k = np.full((len(rows), width), len(keys))
    y = np.zeros((len(rows), width), int)
    size = np.array([len(t) for t, _ in rows])
    for i, (t, g) in enumerate(rows):
        k[i, : len(t)] = [f.key(x) for x in t]
        y[i, : len(t)] = g
    real = np.arange(width)[None, :] < size[:, None]
    bad = _allowed_moves()
    seen_e, seen_m = np.full_like(f.emit, 1e-6), np.full_like(f.move, 1e-6)
    wide = np.pad(k, ((0, 0), (2, 2)), constant_values=len(keys))
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    at = np.arange(len(rows))
    for _ in range(rounds):
        e = np.where(real[:, :, None], _emissions(k, f), 0.0)
        m = f.move + bad
        fwd = np.zeros((len(rows), width, len(TAGS)))
        bwd = np.zeros_like(fwd)
        fwd[:, 0] = START + e[:, 0]
        for t in range(1, width):
            step = lse(fwd[:, t - 1, :, None] + m[None], 1) + e[:, t]
            fwd[:, t] = np.where(real[:, t, None], step, fwd[:, t - 1])
        z = lse(fwd[:, -1], 1)
        for t in range(width - 2, -1, -1):
            step = lse(m[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(real[:, t + 1, None], step, 0.0)
        p = np.exp(fwd + bwd - z[:, None, None])
        gap = np.where(real[:, :, None], np.eye(len(TAGS))[y] - p, 0.0)
        ge = -ridge * f.emit
        for i, o in enumerate(OFFSETS):
            np.add.at(ge[i], wide[:, 2 + o : 2 + o + width], gap)
        gm = -ridge * f.move
        for t in range(1, width):
            q = np.exp(fwd[:, t - 1, :, None] + m[None] + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None])
            on = real[:, t]
            gm -= q[on].sum(axis=0)
            np.add.at(gm, (y[at[on], t - 1], y[at[on], t]), 1.0)
        seen_e += ge**2
        seen_m += gm**2
        f.emit += rate * ge / np.sqrt(seen_e)
        f.move += rate * gm / np.sqrt(seen_m)
    return f


BLOCK = 4096  # tokens whose emissions are held at once
CELLS = 4096 * 96  # tokens of all chains that are decoded at once, if one chain is not longer


def viterbi(k: np.ndarray, size: np.ndarray, f: Field) -> np.ndarray:
    """Best tags of many windows at once: k (windows, length), size: their true lengths. The state is
    carried from block to block of tokens."""
    w, n = k.shape
    m = f.move + _allowed_moves()
    wide = np.pad(k, ((0, 0), (2, 2)), constant_values=f.emit.shape[1] - 1)
    back = np.zeros((w, n, len(TAGS)), np.int8)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        e = _emissions(wide[:, lo : hi + 4], f)[:, 2:-2]
        if lo == 0:
            best = START + e[:, 0]
        for t in range(max(1, lo), hi):
            c = best[:, :, None] + m[None]
            back[:, t] = c.argmax(axis=1)
            step = c.max(axis=1) + e[:, t - lo]
            live = (t < size)[:, None]
            back[:, t] = np.where(live, back[:, t], np.arange(len(TAGS))[None])
            best = np.where(live, step, best)
    tags = np.zeros((w, n), np.int8)
    tags[:, -1] = best.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        tags[:, t - 1] = back[np.arange(w), t, tags[:, t]]
    return np.where(np.arange(n)[None] < size[:, None], tags, 0)


ADDRESS = re.compile(r"(?i)@|\b(?:at|dot)\b")
TRIGGER = re.compile(r"(?i)[0-9@]|\b(?:at|dot)\b")
JOINED = re.compile(r"[\w.%+-]*")


def _near(text: str, toks: list[tuple[int, int]]) -> np.ndarray:
    """Tokens within REACH of a trigger, and what is joined to these around an address."""
    n = len(toks)
    near = np.zeros(n, bool)
    at = np.flatnonzero([bool(TRIGGER.search(text[s:e])) for s, e in toks])
    if not len(at):
        return near
    near[np.clip(np.repeat(at, 2 * REACH + 1) + np.tile(np.arange(-REACH, REACH + 1), len(at)), 0, n - 1)] = True
    for step in (1, -1):
        seen = np.zeros(n, bool)
        for i in at:
            if not ADDRESS.search(text[slice(*toks[i])]):
                continue
            j = min(max(i + step * REACH, 0), n - 1)
            while 0 <= j + step < n and not seen[j]:
                seen[j] = True
                left, right = sorted((toks[j], toks[j + step]))
                if left[1] != right[0] or not JOINED.fullmatch(text, left[0], right[1]):
                    break
                j += step
                near[j] = True
    return near


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Token spans near triggers, as separate chains of any length."""
    found: list[list[tuple[int, int]]] = []
    end = -1
    pad, most = 60, 200

    def until(m) -> int:
        b = m.end() + pad
        return b if m.group().isdigit() else JOINED.match(text, min(b, len(text)), b + most).end()

    for m in TRIGGER.finditer(text):
        if m.start() < end:
            continue
        # a stretch: from well before this trigger up to where no trigger has come for a while
        a, b = max(0, m.start() - pad, end), until(m)
        for nxt in TRIGGER.finditer(text, m.end()):
            if nxt.start() > b:
                break
            b = max(b, until(nxt))
        while a > 0 and JOINED.fullmatch(text, a - 1, a) and a > end and m.start() - a < most:
            a -= 1
        toks = [(a + s, a + e) for s, e in _tokens(text[a:b])]
        end = b
        run: list[tuple[int, int]] = []
        for t, ok in zip(toks, _near(text, toks), strict=True):
            if ok:
                run.append(t)
            elif run:
                found.append(run)
                run = []
        if run:
            found.append(run)
    return found


#: An address with a spelled-out at; beyond the form, a bracketed at or a spelled-out dot is needed.
SPELLED = re.compile(r"(?i)[\w.%+-]+[ ]*[\[(]?[ ]*(?:@|\bat\b)[ ]*[\])]?[ ]*[\w-]+(?:[ ]*[\[(]?[ ]*\bdot\b[ ]*[\])]?[ ]*[\w-]+|\.[\w-]+)+")
BRACKETED = re.compile(r"(?i)[\[(][ ]*(?:@|at)[ ]*[\])]|\bdot\b")

HEADLESS = re.compile(r"(?i)[\[( ]*(?:@|at\b)")


def _plausible(kind: str, s: str) -> bool:
    d = sum("0" <= c <= "9" for c in s)
    if kind == "card":
        digits = re.sub(r"\D", "", s)
        return 13 <= d <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= d <= 15 and not s.isdigit()
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and re.fullmatch(r"[0-9. ]+", s) is not None
    return len(s) <= 120 and SPELLED.fullmatch(s) is not None and BRACKETED.search(s) is not None


def _completed(text: str, a: int, b: int, most: int = 120) -> tuple[int, int]:
    """A tagged address with what its form joins to it on both sides."""
    start = a
    if HEADLESS.match(text, a):
        while start > 0 and a - start < most and text[start - 1] in " [(":
            start -= 1
    while start > 0 and a - start < most and JOINED.fullmatch(text, start - 1, start):
        start -= 1
    while start < a and text[start] in ".%+-":
        start += 1
    m = SPELLED.match(text, start, b + most)
    return (start, max(b, m.end())) if m and m.end() > a else (a, b)


def field_spans(texts: list[str | None], f: Field, block: int = 4096) -> list[list[Span]]:
    """Spans that the random field finds in each text; only such as pass a check of their form."""
    out: list[list[Span]] = [[] for _ in texts]
    memo: dict[str, int] = {}
    chains: list[tuple[int, list[tuple[int, int]], np.ndarray]] = []

    def flush():
        chains.sort(key=lambda c: len(c[2]))
        lo = 0
        while lo < len(chains):
            # as many chains as fill the cells of one block, at least one
            hi = lo + 1
            while hi < min(lo + block, len(chains)) and (hi + 1 - lo) * len(chains[hi][2]) <= CELLS:
                hi += 1
            part, lo = chains[lo:hi], hi
            size = np.array([len(c[2]) for c in part])
            k = np.full((len(part), size.max()), f.emit.shape[1] - 1)
            k[np.repeat(np.arange(len(part)), size), ragged(size)] = np.concatenate([c[2] for c in part])
            tags = viterbi(k, size, f)
            for (doc, toks, _), row in zip(part, tags, strict=True):
                i, n = 0, len(toks)
                while i < n:
                    if TAGS[row[i]][0] == "B":
                        j = i + 1
                        while j < n and TAGS[row[j]][0] == "I":
                            j += 1
                        kind, a, b = TAGS[row[i]][2:], toks[i][0], toks[j - 1][1]
                        if kind == "email":
                            a, b = _completed(texts[doc], a, b)
                        if _plausible(kind, texts[doc][a:b]) and (kind, a, b) not in out[doc][-1:]:
                            out[doc].append((kind, a, b))
                        i = j
                    else:
                        i += 1
        chains.clear()

    for doc, text in enumerate(texts):
        if not text:
            continue
        for run in windows(text):
            keys = []
            for s, e in run:
                w = text[s:e]
                if w not in memo:
                    if len(memo) > 50_000:
                        memo.clear()
                    memo[w] = f.key(w)
                keys.append(memo[w])
            chains.append((doc, run, np.array(keys)))
        if len(chains) >= block:
            flush()
    flush()
    return out


def all_spans(texts: list[str | None], f: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) of each text. A span of the field that meets a base span gives way to it."""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (rank[s[0]], s[1])
    out = []
    for text, more in zip(texts, field_spans(texts, f), strict=True):
        base = base_spans(text)
        starts, reach = [], []  # base spans by their start, and how far those up to there reach
        for _, a, b in sorted(base, key=lambda s: s[1]) if more else ():
            starts.append(a), reach.append(max(b, reach[-1] if reach else 0))
        kept = [s for s in more if not (i := bisect.bisect_left(starts, s[2])) or reach[i - 1] <= s[1]]
        out.append((sorted(base, key=order), sorted(base + kept, key=order)))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame, field: Field | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) plus n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (kind:start:end, code points, end exclusive) and n_added.

    Null texts count as empty: no span, and the digest of an empty string. Repeated rows get equal
    values. Columns of ``docs`` with the new names give way.
    """
    f = field or train()

    def make():
        def work(texts):
            rows = all_spans(texts, f)
            n = [[sum(s[0] == k for s in base) for base, _ in rows] for k in KINDS]
            return [*n, [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], [listed(every) for _, every in rows], [len(every) - len(base) for base, every in rows]]

        return work

    return mapped(docs, text, docs.columns if keep is None else keep, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added int", make)


def masked(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with every span of the text replaced by <KIND>; a null text stays."""
    f = field or train()

    def make():
        def work(texts):
            out = []
            for t, (_, spans) in zip(texts, all_spans(texts, f), strict=True):
                if t is not None:
                    cut, at = [], 0
                    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if a >= at:
                            cut += [t[at:a], f"<{k.upper()}>"]
                            at = b
                    t = "".join([*cut, t[at:]])
                out.append(t)
            return [out]

        return work

    return mapped(docs, text, docs.columns, f"{text} string", make).select(*docs.columns)
