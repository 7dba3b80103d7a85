"""The index of the similarity links stays small."""

import tracemalloc

import numpy as np

from lodestone.llm.jaccard import forest


def test_numbers_of_one_holder_cost_no_list():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 32, 250, dtype=np.uint32)) for _ in range(1200)]
    near = [np.unique(np.concatenate([s[:220], r.integers(0, 1 << 32, 15, dtype=np.uint32)])) for s in sets[::100]]
    members = [(i, s.tobytes()) for i, s in enumerate(sets + near)]
    tracemalloc.start()
    try:
        found = forest(members, 0.8)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(found) == [(1200 + i, 100 * i) for i in range(12)]
    assert peak / sum(map(len, sets)) < 140  # bytes a number; with a list for each some 190
