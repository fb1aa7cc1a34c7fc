import tracemalloc

import numpy as np

from helixframe.llm import lm_score


def test_counts_of_a_part_take_little_memory():
    r = np.random.default_rng(3)
    keys = [np.unique(r.integers(0, 1 << 18, 6000).astype(np.uint64)) for _ in range(60)]
    n, h = ([r.integers(0, 4, len(k)) for k in keys] for _ in range(2))
    size = sum(len(k) for k in keys)
    raw = [[lm_score._planes(x) for x in y] for y in (n, h)]
    want_n, want_h = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
    for k, x, y in zip(keys, n, h, strict=True):
        want_n[k] += x
        want_h[k] += y
    asked = list(keys)
    tracemalloc.start()
    whole, held, total, model = lm_score._summed(asked, *raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((lm_score._numbers(x) == (want_n + want_h)[k]).all() for x, k in zip(whole, keys, strict=True))
    assert all((lm_score._numbers(x) == want_n[k[y > 0]]).all() for x, k, y in zip(held, keys, h, strict=True))
    assert total.sum() == (want_n + want_h).sum() and model.sum() == want_n.sum()
    assert peak < 44 * size, peak / size
