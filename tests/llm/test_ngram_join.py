import random

import numpy as np
import pytest
from pyspark.sql import types as T

from helixframe.llm import ngram_join
from helixframe.llm.ngram_join import RTree, ngram_jaccard_components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType()), T.StructField("node", T.LongType())])


def brute(rows, k, num, den):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    shared = " ".join(rnd.choices(vocab, k=60))
    rows, i = [], 0
    for g in range(25):
        base = rnd.choices(vocab, k=rnd.choice([2, 5, 12, 40, 200]))
        for _ in range(rnd.choice([1, 2, 8])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            text = " ".join(words)
            if g % 3 == 0:
                text += " " + shared
            rows.append((i * 7 % 1009, text.title() if i % 5 == 0 else text, "x", 1))
            i += 1
    return rows + [(5000, None, None, None), (5001, "", "", 0), (5002, " \n ", "", 0)]


@pytest.mark.parametrize("k,num,den,block", [(3, 90, 100, 512), (5, 8, 10, 512), (2, 5, 10, 3)])
def test_against_brute_force(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(ngram_join, "CELL_BLOCK", block)
    rows = corpus()
    got = {r[0]: (r[1], r[2]) for r in ngram_jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3), k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d", None, None), (3, "a b c d", None, None), (3, "a b c d", None, None), (9, "A B C D", None, None)]
    got = sorted(map(tuple, ngram_jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90, 100).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 3), (3, 2, 3), (9, 2, 3)], key=str)


def test_empty_table(spark):
    assert ngram_jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_equals_scan():
    rng = np.random.default_rng(3)
    points = rng.poisson(4, (700, ngram_join.GROUPS)).astype(np.int32)
    sizes = points.sum(axis=1)
    tree = RTree(points, sizes)
    for spot in points[:40]:
        want = np.flatnonzero(180 * np.minimum(points, spot).sum(axis=1) >= 85 * (sizes + spot.sum()))
        assert sorted(tree.search(spot, int(spot.sum()), 85, 95)) == list(want)


def brute_links(rows, k, num, den):
    """Links of different sets between their smallest ids, and per id the number of ids it links to."""
    sets = {i: words(text, k) for i, text, *_ in rows}
    least, links, counts = {}, set(), dict.fromkeys(sets, 0)
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]), i)
    for x in sets:
        for y in sets:
            if x != y and sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                counts[x] += 1
                if sets[x] != sets[y]:
                    links.add(tuple(sorted((least[frozenset(sets[x])], least[frozenset(sets[y])]))))
    return links, counts


def words(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,num,den,block", [(3, 90, 100, 512), (2, 5, 10, 3)])
def test_every_link_is_found(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(ngram_join, "CELL_BLOCK", block)
    rows = corpus()
    links, named = ngram_join.ngram_jaccard_links(spark.createDataFrame(rows, SCHEMA).repartition(3), k, num, den)
    got = [tuple(r) for r in links.collect()]
    want, counts = brute_links(rows, k, num, den)
    assert len(got) == len(set(got)) and set(got) == want
    each = {r["doc_id"]: r for r in named.collect()}
    assert {i: r["n_links"] for i, r in each.items()} == counts
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in each.items()} == brute(rows, k, num, den)


def test_links_inside_a_component(spark):
    # three texts that all link with each other, the first of them twice, and rows without id or words
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base + ["x"]), " ".join(base + ["y"])]
    rows = [(1, texts[0], "", 0), (2, texts[1], "", 0), (3, texts[2], "", 0), (4, texts[0], "", 0), (None, texts[0], "", 0), (9, "", "", 0)]
    links, named = ngram_join.ngram_jaccard_links(spark.createDataFrame(rows, SCHEMA), 3, 90, 100)
    assert sorted(map(tuple, links.collect())) == [(1, 2), (1, 3), (2, 3)]
    assert {r["doc_id"]: r["n_links"] for r in named.collect()} == {1: 3, 2: 3, 3: 3, 4: 3, None: 0, 9: 0}
