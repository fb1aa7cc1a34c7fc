import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from helixframe.llm import suffix_dedup
from helixframe.llm.suffix_dedup import remove_repeats, window_minima

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("spans", T.LongType())])


def brute(rows, length):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for (i, *_), d in zip(rows, data, strict=True):
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and (not p or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(2, 6)))
    passages = [" ".join(word() for _ in range(rnd.choice([12, 30, 60]))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(rnd.choice([0, 3, 40, 120])))
        for _ in range(rnd.choice([0, 1, 2])):
            at = rnd.randint(0, len(text))
            text = text[:at] + rnd.choice(passages) + text[at:]
        if i % 9 == 0:
            text += "xy" * 150
        if i % 10 == 0 and rows:
            text = rows[-1][1][5:] if rows[-1][1] else text
        rows.append((i, text, "k", 1))
    return rows + [(100, None, None, None), (101, "", None, None), (102, rows[3][1], None, None), (102, rows[3][1], None, None), (None, rows[4][1], None, None)]


@pytest.mark.parametrize("seed,length,gram,piece,block", [(1, 200, 48, 1 << 20, 400_000), (2, 60, 20, 1 << 20, 50), (3, 60, 20, 333, 7)])
def test_against_brute_force(spark, monkeypatch, seed, length, gram, piece, block):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = corpus(seed)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), length, gram).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_window_minima():
    v = np.random.default_rng(1).integers(0, 1000, 997).astype(np.uint64)
    assert (window_minima(v, 17) == [v[i : i + 17].min() for i in range(981)]).all()
