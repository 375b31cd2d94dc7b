"""Minhash: the stated chance that pruning loses a pair at the threshold, over all batches."""

import math

import numpy as np
import pytest

from affinis.llm import minhash


@pytest.mark.parametrize(("match", "stated"), [(0.75, "7.0e-4"), (0.75 + 0.25 / 256, "6.1e-4")])
def test_stated_miss_is_that_of_all_batches(match, stated):
    one = [math.comb(minhash.BATCH, i) * match**i * (1 - match) ** (minhash.BATCH - i) for i in range(minhash.BATCH + 1)]
    alive, lost = np.ones(1), 0.0
    for need in minhash.least_matches(0.75, 1e-4):
        alive = np.convolve(alive, one)
        lost += alive[:need].sum()
        alive[:need] = 0
    assert lost == pytest.approx(float(stated), rel=0.02) and stated in minhash.__doc__
