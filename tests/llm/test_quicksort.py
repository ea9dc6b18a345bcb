"""The shallow quicksort and the blind tries against plain sorting."""

from __future__ import annotations

import numpy as np
import pytest

from yardline.llm import suffix_sort


@pytest.mark.parametrize("small", [1, 4, 256])
@pytest.mark.parametrize("n,letters", [(0, 2), (1, 2), (300, 1), (1500, 2), (2500, 3), (1500, 200)])
def test_order_and_groups_equal_sorted_strings(monkeypatch, small, n, letters):
    monkeypatch.setattr(suffix_sort, "SMALL", small)
    rng = np.random.default_rng(n + letters)
    text, starts = rng.integers(0, letters, n + 64).astype(np.uint8), rng.permutation(n)
    for depth, shallow in ((16, 8), (40, 24), (24, 24), (64, 24)):
        order, same = suffix_sort.deep_shallow(text, starts, depth, shallow)
        keys = [text[starts[i] : starts[i] + depth].tobytes() for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(n))
        assert same.tolist() == [k > 0 and keys[k] == keys[k - 1] for k in range(n)]
