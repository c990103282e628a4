"""The parts of winnowing against their definitions, with ties and windows longer than the text, and how often hashes are made distinct."""

import numpy as np
import pytest

from barwright.llm import winnow


@pytest.mark.parametrize("w", [1, 2, 7, 12, 40])
def test_window_minima_take_the_rightmost_least(w):
    rng = np.random.default_rng(w)
    for size, top in ((1, 5), (11, 2), (12, 3), (300, 4), (300, 1 << 60)):
        hashes = rng.integers(0, top, size).astype(np.uint64) + np.uint64((1 << 64) - (1 << 61))
        span = min(w, size)
        expected = sorted({max(i for i in range(start, start + span) if hashes[i] == min(hashes[start:start + span])) for start in range(size - span + 1)})
        assert winnow.window_minima(hashes, w).tolist() == expected


def test_written_and_likeness():
    hashes, at = np.array([1, 0xFFFFFFFFFFFFFFFF, 0xABC << 32], np.uint64), np.array([0, 9, 300])
    assert winnow.written(hashes, at) == "00000001+0 ffffffff+9 00000000+123"
    assert winnow.written(hashes[:0], at[:0]) == ""
    assert winnow.distinct(np.array([3, 1, 3, 2, 1], np.uint64)).tolist() == [1, 2, 3] and not len(winnow.distinct(hashes[:0]))
    assert winnow.likeness(np.array([1, 2, 2], np.uint64), np.array([2, 3], np.uint64)) == 1 / 3
    assert winnow.likeness(hashes[:0], hashes[:0]) == 1.0 and winnow.likeness(hashes, hashes[:0]) == 0.0
