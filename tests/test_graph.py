import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import calibrate, correct, extension, graph, placement


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "src long, dst long, ol int")


def nodes_of(spark, ids, reads=1):
    return spark.createDataFrame([(i, reads, "ACGT") for i in ids], "node long, n_reads long, seq string")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sets_and_reach(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (3, 4), (2, 5), (6, 5), (4, 2), (7, 8)])
    one = nodes_of(spark, [1])
    assert got(graph.reach(e, one), "node", "dist") == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 2)]
    assert got(graph.reach(graph.reversed(e), nodes_of(spark, [5])), "node") == [(i,) for i in (1, 2, 3, 4, 5, 6)]
    assert got(graph.reach(e, one, never=nodes_of(spark, [3])), "node") == [(1,), (2,), (5,)]
    assert got(graph.reach(e, one, only=nodes_of(spark, [2, 5])), "node") == [(1,), (2,), (5,)]
    assert got(graph.reach(e, one, limit=1), "node") == [(1,), (2,)]
    assert got(graph.between(e, one, nodes_of(spark, [4])), "node") == [(1,), (2,), (3,), (4,)]
    assert got(graph.looped(e, nodes_of(spark, range(1, 9))), "node") == [(2,), (3,), (4,)]
    assert got(graph.exclusive(e, one, nodes_of(spark, [6])), "side", "node") == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 6)]
    two = nodes_of(spark, [2, 3]).selectExpr("0L AS start", "node")
    assert got(graph.reach(e, two), "start", "node", "dist") == [(0, 2, 0), (0, 3, 0), (0, 4, 1), (0, 5, 1)]
    assert got(graph.components(e, nodes_of(spark, range(1, 10))), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 7), (8, 7), (9, 9)]
    assert got(graph.open_ends(e, nodes_of(spark, range(1, 9))), "node") == [(5,), (8,)]
    assert got(graph.dependents(e, nodes_of(spark, [2, 7])), "node") == [(3,), (8,)]
    assert got(graph.drop_nodes(e, nodes_of(spark, [2])), "src", "dst") == [(3, 4), (6, 5), (7, 8)]
    assert got(graph.upsert_edges(e, edges_of(spark, [(1, 2), (9, 1)])), "src", "dst") == sorted([(1, 2), (2, 3), (3, 4), (2, 5), (6, 5), (4, 2), (7, 8), (9, 1)])


def test_weighted_reach(spark):
    e = spark.createDataFrame([(1, 2, 60), (2, 3, 60), (1, 3, 20)], "src long, dst long, ol int")
    lengths = spark.createDataFrame([(i, 100) for i in (1, 2, 3)], "node long, len int")
    assert got(graph.reach(e, nodes_of(spark, [1]), lengths=lengths), "node", "dist") == [(1, 0), (2, 40), (3, 80)]
    assert got(graph.reach(e, nodes_of(spark, [1]), lengths=lengths, limit=40), "node") == [(1,), (2,)]


def test_chains_and_rings(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (3, 4), (3, 5), (10, 11), (11, 12), (12, 10)])
    assert got(graph.chains(e, nodes_of(spark, [1, 2, 3, 4, 5, 10, 11, 12])), "node", "chain", "place") == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0), (5, 5, 0), (10, 10, 0), (11, 10, 1), (12, 10, 2)]


def test_components_of_random_graphs(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    root = list(range(60))
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got(graph.components(edges_of(spark, pairs), nodes_of(spark, range(60))), "node", "component") == list(enumerate(root))


def test_tips_bubbles_paths(spark):
    e = edges_of(spark, [(1, 2), (1, 3), (3, 4), (1, 5), (5, 6), (1, 7), (7, 6)])
    n = spark.createDataFrame([(1, 9, ""), (2, 1, ""), (3, 9, ""), (4, 9, ""), (5, 2, ""), (6, 9, ""), (7, 8, "")], "node long, n_reads long, seq string")
    assert got(graph.blunt_tips(e, n, 2), "node") == [(2,)]
    assert got(graph.bubbles(e, n, 5), "a", "z", "weak", "strong") == [(1, 6, 5, 7)]
    steps = spark.createDataFrame([("gap", 0, "ACGT", 0), ("gap", 1, "TT", -3), ("over", 0, "ACGT", 0), ("over", 1, "GTAA", 2), ("bad", 0, "ACGT", 0), ("bad", 1, "CCAA", 2)], "path string, place int, seq string, ol int")
    assert got(graph.path_sequences(steps), "path", "seq") == [("bad", "ACNNAA"), ("gap", "ACGTNNNTT"), ("over", "ACGTAA")]


def test_distances_and_limits(spark):
    m = spark.createDataFrame([(1, v) for v in (100, 150, 400)], "k long, v long")
    assert got(graph.merge_distances(m, "k", "v"), "low", "high") == [(100, 150), (400, 400)]
    m = spark.createDataFrame([(1, v) for v in (10, 50, 30, 5)], "k long, v long")
    assert graph.furthest(m, "k", "v").first()["limits"] == [50, 30, 10]


def test_borders_of_rules(spark):
    m = spark.createDataFrame([(1, v) for v in (0, 100, 199, 400)], "k long, v long")
    merged = graph.merge_distances(m, "k", "v")
    assert got(merged, "low", "high") == [(0, 0), (100, 199), (400, 400)]  # a gap of exactly 100 is none
    asked = spark.createDataFrame([(1, e) for e in (0, 50, 150, 250, 350, 500, -7)], "k long, e long")
    assert got(graph.interval_diff(merged, asked, "k", "e"), "e", "diff") == [(-7, 7), (0, 0), (50, -50), (150, 0), (250, -51), (350, 50), (500, -100)]
    assert got(graph.interval_diff(merged, asked, "k", "e", right=False), "e", "diff") == [(-7, -7), (0, 0), (50, 50), (150, 0), (250, 51), (350, -50), (500, 100)]
    same = spark.createDataFrame([(1, 1, 0, 50), (1, 2, 0, 50), (1, 3, 0, 100), (1, 4, 0, 100), (1, 5, 60, 160)], "node long, read_no long, start long, end long")
    assert got(placement.redundant(same, 100), "read_no", "redundant") == [(1, True), (2, True), (3, False), (4, False), (5, False)]
    two = spark.createDataFrame([(2,), (3,)], "l int")
    assert calibrate.n50(two, "l", True).first()["n50"] == 2
    ties = spark.createDataFrame([(c, 1) for c in (30, 20, 20, 20, 20)], "c int, len int")
    assert calibrate.weighted_mean_top(ties, "c", "len").first()["mean"] == 22.5
    b = spark.createDataFrame([(1, 0, None, "A", 50, 1, 10), (1, 1, None, "C", 50, 1, 2), (1, 2, None, "G", 50, 1, 3)], "q_id long, branch long, parent long, seq string, max_over int, max_ext int, n_reads long")
    assert got(extension.cull_branches(b, 1), "n_reads") == [(3,), (10,)]
    reverse = spark.createDataFrame([(1, 7, 1, 0, 100), (1, 7, 3, 200, 300), (1, 7, 4, 0, 100), (1, 7, 7, 200, 300)], "lib_id int, node_id long, read_id long, start long, end long")
    assert got(calibrate.mate_distances(reverse), "orientation", "distance") == [(2, 300)]
    chain = spark.createDataFrame([(1, 2, 10), (2, 3, 0), (3, 4, 5)], "src long, dst long, ol int")
    assert got(graph.chains(chain, nodes_of(spark, range(1, 5))), "node", "chain") == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_statistics(spark):
    v = spark.createDataFrame([("a", x) for x in (4, 1, 3, 2)], "k string, v int")
    assert calibrate.upper_median(v, "k", "v").first()["v"] == 3
    c = spark.createDataFrame([(30, 100), (20, 100), (10, 200)], "c int, len int")
    assert calibrate.weighted_mean_top(c, "c", "len").first()["mean"] == 17.5
    assert calibrate.weighted_point(spark.createDataFrame([(10, 100), (20, 100), (30, 100)], "c int, len int"), "c", "len", 0.67).first()["c"] == 30
    lengths = spark.createDataFrame([(10,), (20,), (30,)], "l int")
    assert (calibrate.n50(lengths, "l", True).first()["n50"], calibrate.n50(lengths, "l", False).first()["n50"]) == (20, 30)
    e = spark.range(1).select(placement.estimate(F.array(F.lit(100), F.lit(200), F.lit(400)), F.array()).alias("x"), placement.estimate(F.array().cast("array<int>"), F.array(F.lit(100), F.lit(200))).alias("y")).first()
    assert tuple(e) == (200, 150)
    assert spark.range(1).select(placement.node_coverage(F.lit(12), F.lit(400), 100, 9)).first()[0] == 2.5


def test_duplicates(spark):
    head = "ACGTACGTACGTACGTTTGG"
    rows = [(1, head + "CCAA", head[::-1], "I" * 24, "I" * 20), (2, head + "CCAA", head[::-1], "I" * 24, "I" * 20), (3, head + "GGTTAACCGGTTAACCGGTT" * 3, head[::-1], "I" * 80, "I" * 20), (4, "N" + head, head, "I" * 21, "I" * 20), (5, "T" * 24, head, "I" * 24, "I" * 20)]
    p = spark.createDataFrame(rows, "pair_no long, r1 string, r2 string, q1 string, q2 string")
    assert got(correct.dedup_candidates(p), "pair_no") == [(1,), (2,), (3,)]
    left = got(correct.drop_duplicates(p), "pair_no")
    assert (2,) not in left and {(1,), (4,), (5,)} <= set(left)
    again = spark.createDataFrame([r for r in rows if (r[0],) in left], p.schema)
    assert got(correct.drop_duplicates(again), "pair_no") == left  # a second pass removes nothing


def test_growth_rebuilds_the_text(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choices("ACGT", k=400))
    reads = spark.createDataFrame([(i, text[a : a + 100]) for i, a in enumerate(range(0, 301, 20))], "read_no long, seq string")
    seeds = spark.createDataFrame([(1, text[:100]), (2, "A" * 100)], "q_id long, seq string")
    grown = {r["q_id"]: r for r in extension.grow(seeds, reads, 45, 1000).collect()}
    assert grown[1]["seq"] == text and grown[1]["stop"] == 1 and grown[2]["seq"] == "A" * 100


def test_branches(spark):
    rows = [(1, 10, "ACGT", 50, 4), (1, 11, "ACG", 60, 3), (1, 12, "AGG", 55, 3), (1, 13, "T", 40, 1)]
    o = spark.createDataFrame(rows, "q_id long, read_no long, ext string, over_len int, ext_len int")
    b = extension.compile_branches(o, 300)
    assert got(b, "branch", "seq", "n_reads", "max_over") == [(0, "ACGT", 2, 60), (1, "AGG", 1, 55), (2, "T", 1, 40)]
    assert got(extension.cull_branches(b, 2), "seq") == [("ACGT",)]
    assert got(extension.next_bases(o), "base", "n") == [("A", 3), ("T", 1)]


def test_duplicates_of_each_other_and_flipped(spark):
    a, b = "ACGTACGTACGTACGT", "TGCATGCATGCATGCA"
    one, two, other = a + "CATTGACCTGAATCGGATCA" * 4, a + "GGCCTTAAGTCTAGACTTAC" * 4, b + "CTAGGATCCATTACGTCAGT" * 4
    rows = [(1, one, other), (2, two, other), (3, two, other), (4, other, one), (5, other, two)]
    p = spark.createDataFrame([(i, x, y, "I" * len(x), "I" * len(y)) for i, x, y in rows], "pair_no long, r1 string, r2 string, q1 string, q2 string")
    assert got(correct.drop_duplicates(p), "pair_no") == [(1,), (2,)]
    assert got(correct.confirm_duplicates(correct.dedup_keys(p)), "pair_no", "lead") == [(1, 1), (2, 2), (3, 2), (4, 1), (5, 2)]


def test_growth_that_is_cut_short_raises(spark):
    text = "".join(random.Random(5).choices("ACGT", k=400))
    reads = spark.createDataFrame([(i, text[a : a + 100]) for i, a in enumerate(range(0, 301, 20))], "read_no long, seq string")
    with pytest.raises(RuntimeError):
        extension.grow(spark.createDataFrame([(1, text[:100])], "q_id long, seq string"), reads, 45, 1000, rounds=1)


def test_unary_chain_merge_leaves_rings_out(spark, tmp_path):
    import random

    import duckdb

    from helixframe.registry import ORACLES, QUERIES

    r = random.Random(7)
    # a text of period 200 has five windows that follow one another in a ring; the first one's id is no multiple of 17
    period, line = ("".join(r.choice("ACGT") for _ in range(n)) for n in (200, 500))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(1, period * 3), (2, line)])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    want = con.execute(f"SELECT node, chain, place FROM ({ORACLES['unary_chain_merge']})").fetchall()
    got = QUERIES["unary_chain_merge"](spark, str(tmp_path)).select("node", "chain", "place").collect()
    assert sorted(tuple(x) for x in got) == sorted(want)


@pytest.mark.parametrize("weighted", [False, True])
def test_reach_equals_brute_force_over_blocks(spark, monkeypatch, weighted):
    """Blocks of a few edges, ids far apart and below 0, ways that leave a block and return, starts that are a set or have no id."""
    monkeypatch.setattr(graph, "BLOCK", 5)
    monkeypatch.setattr(graph, "CELLS", 7)
    rnd = random.Random(4)
    ids = [i * 1000 - 9000 for i in range(30)]
    ways = {(rnd.choice(ids), rnd.choice(ids)): rnd.randrange(1, 90) for _ in range(55)}
    e = spark.createDataFrame([(a, b, ol) for (a, b), ol in ways.items()], "src long, dst long, ol int")
    starts = [(1, ids[0]), (1, ids[5]), (None, ids[7]), (3, ids[3]), (4, None), (5, 10**15)]
    for limit in (None, 2 if not weighted else 120):
        want = {}
        for s in {s for s, _ in starts}:
            dist = {v: 0 for t, v in starts if t == s}
            for _ in ids:
                for (a, b), ol in ways.items():
                    d = dist.get(a, 10**9) + (100 - ol if weighted else 1)
                    if d <= (limit or 10**8) and d < dist.get(b, 10**9):
                        dist[b] = d
            want |= {(s, v): d for v, d in dist.items()}
        lengths = spark.createDataFrame([(i, 100) for i in ids], "node long, len int") if weighted else None
        found = graph.reach(e, spark.createDataFrame(starts, "start long, node long"), lengths=lengths, limit=limit).collect()
        assert len(found) == len(want) and {(r["start"], r["node"]): r["dist"] for r in found} == want


def test_reach_follows_a_long_way_in_few_rounds(spark):
    e = edges_of(spark, [(i, i + 1) for i in range(400)])
    assert got(graph.reach(e, nodes_of(spark, [0]), rounds=3), "node", "dist") == [(i, i) for i in range(401)]


def test_reach_over_uneven_ids(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 1)
    e = edges_of(spark, [(i, i + 1) for i in range(70)] + [(70, 10**17)])
    assert got(graph.reach(e, nodes_of(spark, [60])), "node", "dist") == [(60 + i, i) for i in range(11)] + [(10**17, 11)]


def test_reach_without_distances(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 2)
    e = edges_of(spark, [(1, 9), (9, 2), (1, 2), (2, 3), (3, 1), (7, 1)])
    assert got(graph.reach(e, nodes_of(spark, [1, 2]), dists=False), "start", "node", "dist") == [(s, v, 0) for s in (1, 2) for v in (1, 2, 3, 9)]
    with pytest.raises(ValueError):
        graph.reach(e, nodes_of(spark, [1]), dists=False, limit=2)


def test_reach_not_starts_from_every_node(spark, tmp_path):
    import duckdb

    from helixframe.registry import ORACLES, QUERIES

    r = random.Random(8)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, "".join(r.choice("ACGT") for _ in range(600))) for i in (1, 2)])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    found = {tuple(x) for x in QUERIES["reach_not"](spark, str(tmp_path)).select("start", "node").collect()}
    assert {s for s, _ in found} == {i * 100_000 + k for i in (1, 2) for k in range(13)}
    assert found == set(con.execute(f"SELECT start, node FROM ({ORACLES['reach_not']})").fetchall())


@pytest.mark.parametrize("room", [20, 1 << 23])
def test_limited_reach_shares_what_lies_around_a_block(spark, monkeypatch, room):
    """Ways of many starts into one node are followed in the blocks of the starts; none of them travels to that node's block."""
    monkeypatch.setattr(graph, "BLOCK", 40)
    monkeypatch.setattr(graph, "ROOM", room)
    rows = []

    def noted(df, label, write=graph.materialize):
        found = write(df, label)
        if "inside" in found.columns and "block" not in found.columns:
            rows.append(found.where("node = 1000").count())
        return found

    monkeypatch.setattr(graph, "materialize", noted)
    e = edges_of(spark, [(i, 1000) for i in range(200)] + [(1000 + i, 1001 + i) for i in range(5)] + [(1003, 7), (1005, 1000)])
    want = {(i, i): 0 for i in range(200)} | {(i, 1000 + d): d + 1 for i in range(200) for d in range(5)} | {(i, 7): 5 for i in range(200) if i != 7}
    found = graph.reach(e, nodes_of(spark, range(200)), limit=5).collect()
    assert len(found) == len(want) and {(r["start"], r["node"]): r["dist"] for r in found} == want
    assert max(rows) <= 12
