"""Which pairs of a bucket are verified."""

from math import comb

import numpy as np

from sluice.llm import near_dedup as N


def test_margin_misses_no_more_than_banding():
    least = N.PLACES * (0.8 - N.MARGIN)
    missed = sum(comb(N.PLACES, i) * 0.8**i * 0.2 ** (N.PLACES - i) for i in range(N.PLACES + 1) if i < least)
    assert missed <= (1 - 0.8**N.ROWS) ** N.BANDS


def test_chance_match_in_an_earlier_band():
    """Equal 16-bit values in band 0 of two rows that share the bucket of band 1 only."""
    sig = np.arange(N.PLACES, dtype=np.uint16)
    keys = np.arange(2 * N.BANDS, dtype=np.int64).reshape(2, -1)
    keys[1, 1] = keys[0, 1]
    rows = {"id": [1, 2], "component": [1, 2], "minor": [True, False], "sig": [sig.tobytes() + k.tobytes() + np.int64(100).tobytes() for k in keys]}
    assert [(i, near.tolist()) for i, near in N._near(rows, 1, 80, 80)] == [(0, [1])]
    assert not list(N._near(rows, 0, 80, 80))


def test_sizes_that_rule_a_link_out():
    sig, keys = np.arange(N.PLACES, dtype=np.uint16), np.arange(N.BANDS, dtype=np.int64)
    for sizes, met in (((80, 100), True), ((79, 100), False)):
        rows = {"id": [1, 2], "component": [1, 2], "minor": [True, False], "sig": [sig.tobytes() + keys.tobytes() + np.int64(n).tobytes() for n in sizes]}
        assert bool(list(N._near(rows, 0, 80, 80))) == met
