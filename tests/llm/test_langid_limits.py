import random
import tracemalloc

import numpy as np
import pyarrow as pa

from helixframe.llm import langid


class _Sure:
    """Scores that rise from 0.5 to 1 over the texts of a length; one long text has nearly 1."""

    temperature = 1.0

    def logits(self, texts):
        long = np.array([len(t) > 50 for t in texts.to_pylist()])
        p = np.where(long, 0.9999, np.linspace(0.5, 0.99, len(texts)))
        return np.log(np.stack([p, 1 - p], axis=1)), np.where(long, 9, 6)


def test_one_text_does_not_set_the_limit_of_its_length():
    found = langid._thresholds(_Sure(), ["ab"] * 999 + ["a" * 60])
    assert (found < 0.52).all() and (found >= 0.5).all()
    assert (langid._thresholds(_Sure(), ["a" * 60]) > 0.99).all()


def test_training_holds_few_subwords_at_once():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=24)) for _ in range(4000)]
    model = langid.Model(["x", "y"], np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)), np.zeros(2), 1.0, np.zeros(langid.LENGTHS))
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        rows = langid.bags(pa.array(texts))
        assert tracemalloc.get_traced_memory()[1] < 15 * size
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        langid._thresholds(model, texts)
        assert tracemalloc.get_traced_memory()[1] - held < 15 * size
    finally:
        tracemalloc.stop()
    # runs of texts have the rows that all together have
    parts = list(langid.subwords(*langid.bytes_of(pa.array(texts))))
    assert all(np.array_equal(rows[i], np.concatenate([x[at[i] : at[i + 1]] for x, at in parts])) for i in range(0, 4000, 37))
