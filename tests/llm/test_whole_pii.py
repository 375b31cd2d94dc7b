"""Personal data: long runs and long addresses are decoded whole."""

import random
import re
import time

import numpy as np
import pytest

from affinis.llm import pii

FIELD = pii.train()


def spans(text):
    return [(k, text[a:b]) for k, a, b in pii.field_spans([text], FIELD)[0]]


@pytest.mark.parametrize("address", ["tom (at) mail.example.co.uk", "anna at mail dot eng dot example dot com", "j.r.r.tolkien at host dot org"])
def test_long_addresses_are_whole(address):
    for text in (address, f"write to {address} today"):
        assert spans(text) == [("email", address)]


def test_dense_lists_are_not_cut():
    text = " ".join(["call 988-555-2485 or (555) 123-4567,"] * 100)
    assert len(pii.windows(text)) == 1
    assert [s for _, s in spans(text)] == ["988-555-2485", "(555) 123-4567"] * 100


def test_blocks_carry_the_state(monkeypatch):
    k = np.random.RandomState(1).randint(0, len(FIELD.keys) + 1, (5, 203))
    size = np.array([203, 150, 7, 8, 1])
    want = pii.viterbi(k, size, FIELD)
    monkeypatch.setattr(pii, "BLOCK", 8)
    assert (pii.viterbi(k, size, FIELD) == want).all()


@pytest.mark.parametrize("text", ["7" * 1_000_000, "1." * 500_000, "1.2.3.4" + ".5" * 400_000, "+" * 1_000_000, "+1" + " " * 1_000_000, "a@b." * 250_000, "12.34.5" * 150_000 + "x", "4111 " * 200_000])
def test_base_spans_of_long_texts_take_linear_time(text):
    start = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - start < 5


def test_addresses_equal_the_stated_pattern():
    pattern = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rnd = random.Random(6)
    for _ in range(5000):
        t = "".join(rnd.choice("1.2.3.0 x") for _ in range(rnd.randint(0, 40)))
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in pattern.finditer(t)], t


def test_added_spans_never_meet_base_ones():
    field = pii.train()
    texts = ["call 555-123-4567 or +49 30 1234567 now, mail a@b.com, tom (at) host dot org", "ip 10 . 0 . 0 . 12 and 10.0.0.12"] * 3
    for base, every in pii.all_spans(texts, field):
        added = [s for s in every if s not in base]
        assert not any(s[1] < b[2] and b[1] < s[2] for s in added for b in base)
