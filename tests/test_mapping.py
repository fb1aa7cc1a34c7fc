"""Overlaps of distinct sequences by seeds."""

import random

import pytest

from helixframe.operators import assembly, extension, mapping


def _reads():
    r = random.Random(5)
    text = "".join(r.choice("ACGT") for _ in range(300))
    seqs = [text[i : i + 60] for i in range(0, 240, 7)] * 2 + ["ACGTA" * 12, "A" * 60, "CGTAA" * 12, "N" * 60, text[3:90], text[50:75], "A" * 59 + "C", text[5:25]]
    return [(i * 3 % 101, s) for i, s in enumerate(seqs)]


def _brute(rows, least):
    return [(a, b, n, len(t) - n) for a, s in rows for b, t in rows for n in range(least, len(s)) if n <= len(t) and s[-n:] == t[:n]]


@pytest.mark.parametrize("least", [1, 2, 20, 45])
def test_overlaps_equal_brute_force(spark, least):
    rows = _reads()
    reads = spark.createDataFrame(rows, "read_no long, seq string")
    assert sorted(tuple(x) for x in mapping.overlap_join(reads, least).collect()) == sorted(_brute(rows, least))
    best = {}
    for a, b, n, _ in _brute(rows, least):
        best[a, b] = max(n, best.get((a, b), 0))
    got = mapping.overlap_join(reads, least, longest=True).select("q_id", "read_no", "over_len").collect()
    assert sorted(tuple(x) for x in got) == sorted((*k, n) for k, n in best.items())


def test_queries_on_sequences_equal_those_on_reads(spark):
    rows = [x for x in _reads() if len(x[1]) == 60]
    reads = spark.createDataFrame(rows, "read_no long, seq string")
    every = mapping.overlap_join(reads, 20).cache()
    same = lambda x, y: sorted(tuple(r) for r in x.select(y.columns).collect()) == sorted(tuple(r) for r in y.collect())
    for most in (1, 3, 500):
        assert same(mapping.top_read_overlaps(reads, 20, most), mapping.top_overlaps(every, most))
    nodes = mapping.node_overlaps(reads, 20)
    ext = every.join(reads, "read_no").selectExpr("q_id", "read_no", "over_len", "ext_len", "substring(seq, over_len + 1) ext")
    assert same(mapping.to_reads(extension.next_bases(nodes, "n"), reads), extension.next_bases(ext))
    assert same(mapping.to_reads(extension.volumes(nodes), reads), extension.volumes(every))
    assert same(assembly.mutual_best(nodes.select("q_id", "read_no", "over_len")), assembly.mutual_best(mapping.best_overlaps(every)))


@pytest.mark.parametrize("name", ["overlap_join", "overlap_best_per_id", "overlap_top", "mutual_best", "next_bases", "extension_volumes"])
def test_pairs_of_reads_are_not_shuffled(spark, name):
    """Only the join on seeds has strings as sides; none multiplies reads before a shuffle."""
    from helixframe.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "startswith" in plan.lower()
    assert not any("Join" in x and "seq#" in x.split("StartsWith")[0] for x in plan.splitlines())


def test_places_share_seeds(spark):
    r = random.Random(6)
    seqs = spark.createDataFrame([(i, "".join(r.choice("ACGT") for _ in range(100))) for i in range(200)], "read_no long, seq string")
    own = mapping.grouped(seqs)
    rows = own.mapInArrow(mapping._seeded(45, False), "seq string, node long, n long, ids array<long>, key long, at int, lo int, hi int").count()
    assert rows < 200 * 8  # one for each place would be 55


def test_only_seeds_that_a_head_has_travel(spark):
    r = random.Random(7)
    text = "".join(r.choice("ACGT") for _ in range(8100))
    rows = [(i, text[i * 40 : i * 40 + 100]) for i in range(200)] + [(999, text[:100])]
    reads = spark.createDataFrame(rows, "read_no long, seq string")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = mapping.overlap_join(reads, 45)
        assert sorted(tuple(x) for x in found.collect()) == sorted(_brute(rows, 45))
        plan = found._jdf.queryExecution().executedPlan()
        stages = [plan]
        written = []
        while stages:
            node = stages.pop()
            if "QueryStage" in node.nodeName():
                node = node.plan()
            if node.nodeName() == "Exchange":
                written.append(node.metrics().apply("shuffleRecordsWritten").value())
            inner = [node.children().apply(i) for i in range(node.children().size())]
            stages += inner or ([node.executedPlan()] if node.nodeName().startswith("AdaptiveSparkPlan") else [])
        # 200 heads; of the tails' seeds, five or six a sequence, about those at the next one's head
        assert len(written) == 2 and sum(written) < 200 + 200 * 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_map_exact_equals_brute_force_with_shared_seeds(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("ACGT") for _ in range(n)) for n in (700, 256, 512, 100, 40)] + ["ACGTA" * 130, "N" * 300]
    reads = [(i, t[a : a + n]) for i, (t, a, n) in enumerate((r.choice(texts), r.randrange(0, 260), r.choice((40, 41, 60))) for _ in range(80))] + [(99, "AC"), (98, "ACGTA" * 9)]
    want = [(q, i, a, a + len(s)) for q, t in enumerate(texts) for i, s in reads if len(s) >= 32 for a in range(len(t) - len(s) + 1) if t[a : a + len(s)] == s]
    q, s = spark.createDataFrame(list(enumerate(texts)), "q_id long, seq string"), spark.createDataFrame(reads, "read_no long, seq string")
    found = mapping.map_exact(q, s)
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)
    # places aren't exploded and there is one join
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_mutual_best_finds_overlaps_once(spark):
    from helixframe.registry import QUERIES

    plan = QUERIES["mutual_best"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_map_hamming_shuffles_its_keys_once(spark):
    r = random.Random(9)
    base = ["".join(r.choice("ACGT") for _ in range(60)) for _ in range(40)]
    seqs = base + [s[:i] + "N" + s[i + 1 :] for i, s in enumerate(base)] + [s[:5] + s[7:] + "AC" for s in base]
    rows = list(enumerate(dict.fromkeys(seqs)))
    want = sorted((a, b, n) for a, s in rows for b, t in rows if a < b and (n := sum(x != y for x, y in zip(s, t, strict=True))) <= 6)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = mapping.map_hamming(spark.createDataFrame(rows, "read_no long, seq string"), 6, 60)
        assert sorted(tuple(x) for x in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ReusedExchange" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
