import pytest
from pyspark.sql import functions as F

from helixframe.operators import assembly as A
from helixframe.operators import placement


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def graph_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, ol int")


def test_coordinates(spark):
    e = graph_of(spark, [(1, 2, 10), (2, 4, 10), (1, 3, 10), (3, 4, 10)])
    n = spark.createDataFrame([(1, 100), (2, 50), (3, 90), (4, 20)], "node long, len int")
    at = A.recoordinate(e, n, spark.createDataFrame([(1,)], "node long"))
    assert got(at, "node", "start") == [(1, 0), (2, 90), (3, 90), (4, 170)]
    assert got(A.offset_conflicts(e, at, n, 30), "src", "dst", "diff") == [(2, 4, 40)]


def test_crosses_and_clones(spark):
    e = graph_of(spark, [(1, 5, 9), (2, 5, 9), (5, 6, 8), (5, 7, 8)])
    n = spark.createDataFrame([(i, 10) for i in (1, 2, 5, 6, 7)], "node long, len int")
    hits = spark.createDataFrame([(1, 6, 8), (2, 7, 5), (2, 6, 1)], "src long, dst long, n int")
    assert got(A.crosses(e), "node") == [(5,)]
    assert got(A.cross_pairings(e, hits), "src", "dst") == [(1, 6), (2, 7)]
    edges, nodes = A.clone_nodes(e, n, spark.createDataFrame([(5, 50, 2, 7)], "node long, copy long, src long, dst long"))
    assert got(edges, "src", "dst") == [(1, 5), (2, 50), (5, 6), (50, 7)]
    assert got(nodes.where("node in (5, 50)"), "node", "clone_group") == [(5, 5), (50, 5)]


def test_bubbles_islands_chains(spark):
    e = graph_of(spark, [(1, 2, 1), (1, 3, 1), (2, 4, 1), (3, 4, 1), (8, 9, 1)])
    n = spark.createDataFrame([(1, 9, 30, "AC"), (2, 5, 2, "CT"), (3, 6, 9, "CG"), (4, 9, 30, "GA"), (8, 9, 1, "AA"), (9, 9, 1, "AC")], "node long, len int, n_reads long, seq string")
    edges, nodes = A.pop_bubbles(e, n)
    assert got(nodes, "node") == [(1,), (3,), (4,), (8,), (9,)]
    assert got(A.drop_islands(edges, nodes), "node") == [(1,), (3,), (4,)]
    outer, merged = A.compress(edges, nodes)
    assert got(merged, "node", "seq", "n_reads") == [(1, "ACGA", 69), (8, "AAC", 2)] and outer.isEmpty()


def test_walks(spark):
    e = graph_of(spark, [(1, 2, 30), (1, 3, 60), (2, 4, 50), (3, 4, 10), (4, 1, 40)])
    one = spark.createDataFrame([(1,)], "node long")
    scores = spark.createDataFrame([(1, 3, 5)], "src long, dst long, score int")
    assert got(A.best_walk(e, scores, one), "place", "node") == [(0, 1), (1, 3), (2, 4)]
    assert got(A.widest_path(e, one).where("node <> 1"), "node", "width") == [(2, 30), (3, 60), (4, 30)]
    lengths = spark.createDataFrame([(i, 100) for i in range(1, 5)], "node long, len int")
    assert got(A.path_pairs(e, lengths, spark.createDataFrame([(1,), (4,)], "node long"), 130), "start", "node", "dist") == [(1, 4, 120), (4, 1, 60)]


def test_marks(spark):
    m = spark.createDataFrame([(1, v) for v in (0, 5, 8, 100, 104, 300)], "k long, v long")
    assert got(A.clumps(m, "k", "v", 10, 2), "v") == [(0,), (5,), (8,)]
    placed = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 20), (1, 3, 5, 12)], "node long, read_no long, start long, end long")
    stretches = placement.depth(placed)
    assert got(stretches, "pos", "until", "depth") == [(0, 5, 1), (5, 10, 3), (10, 12, 2), (12, 20, 1)]
    assert got(A.weak_spot(stretches), "pos", "depth") == [(0, 1)]
    assert got(placement.redundant(placed, 100), "read_no", "redundant") == [(1, False), (2, False), (3, True)]


def test_joins_of_ends(spark):
    o = spark.createDataFrame([(1, 2, 50), (1, 3, 60), (4, 3, 70)], "q_id long, read_no long, over_len int")
    assert got(A.mutual_best(o), "q_id", "read_no") == [(4, 3)]
    ends = spark.createDataFrame([(1, "TTACGTA")], "node long, seq string")
    heads = spark.createDataFrame([(2, "ACGTACC"), (3, "CGTATT"), (9, "GGGG")], "node long, seq string")
    hits = spark.createDataFrame([(1, 3, 2)], "src long, dst long, n int")
    assert got(A.bridges(ends, heads, hits, 3), "src", "dst", "ol") == [(1, 3, 4)]


def test_contigs(spark):
    c = spark.createDataFrame([("h", "AACCGG", 2, 4)], "header string, seq string, origin_start int, origin_end int")
    assert got(A.split_contig(c), "left", "origin", "right") == [("AA", "CC", "GG")]
    arms = spark.createDataFrame([(1, "ACGT", "ACT"), (2, "AAGT", "ACGT"), (3, "", "")], "pair long, a string, b string")
    assert got(A.fold_alleles(arms), "pair", "seq") == [(1, "ACGT"), (2, "ANGT"), (3, "")]
    n, e, p = A.split_node(spark.createDataFrame([(1, "AACCGG"), (2, "GG")], "node long, seq string"), graph_of(spark, [(1, 2, 2)]), spark.createDataFrame([(1, 7, 0, 3), (1, 8, 4, 6)], "node long, read_no long, start long, end long"), spark.createDataFrame([(1, 3, 10)], "node long, at int, new_node long"))
    assert got(n, "node", "seq") == [(1, "AAC"), (2, "GG"), (10, "CGG")] and got(e, "src", "dst", "ol") == [(1, 10, 0), (10, 2, 2)]
    assert got(p, "node", "read_no", "start", "end") == [(1, 7, 0, 3), (10, 8, 1, 3)]
    assert spark.range(1).select(A.multiplicity(F.lit(41.0), 20)).first()[0] == 2


def test_walks_and_bubbles_that_are_cut_short_raise(spark):
    e = graph_of(spark, [(1, 2, 30), (1, 3, 60), (2, 4, 50), (3, 4, 10)])
    scores = spark.createDataFrame([(1, 3, 5)], "src long, dst long, score int")
    with pytest.raises(RuntimeError):
        A.best_walk(e, scores, spark.createDataFrame([(1,)], "node long"), rounds=1)
    n = spark.createDataFrame([(1, 9, 30), (2, 5, 2), (3, 6, 9), (4, 9, 30)], "node long, len int, n_reads long")
    with pytest.raises(RuntimeError):
        A.pop_bubbles(e, n, rounds=1)
