"""Viterbi against brute force where gains lie between half a penalty and one."""

from itertools import product

import numpy as np

from paperloom.llm import language_id


def _total(scores, path, penalty):
    return sum(scores[i][j] for i, j in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_two_labels_side_by_side():
    assert language_id.viterbi(np.array([[10.0, -100, 0], [-100, 10, 0]]), 12.0).tolist() == [0, 1]
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 6))
        scores = rng.normal(0, 7, (n, 3)) * (rng.random((n, 3)) < 0.7)
        best = max(_total(scores, p, 12.0) for p in product(range(3), repeat=n))
        assert np.isclose(_total(scores, language_id.viterbi(scores, 12.0), 12.0), best)
