"""Hand-computed cases of the scalar functions and parameters."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe import params
from helixframe.functions import alignment
from helixframe.functions import sequence as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("seq,want", [("ACGTN", "NACGT"), ("acgT", "Acgt"), ("", ""), ("AXG", "CNT")])
def test_revcomp(spark, seq, want):
    assert value(spark, S.revcomp(F.lit(seq))) == want


def test_revcomp_twice(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choices("ACGTN", k=rnd.randint(0, 50))),) for _ in range(50)]
    df = spark.createDataFrame(rows, "s string")
    assert df.where(S.revcomp(S.revcomp(F.col("s"))) != F.col("s")).count() == 0


@pytest.mark.parametrize("seq,want", [("ACGNNACGTT", "ACGTT"), ("ACGNTTT", "ACG"), ("NNN", ""), ("", "")])
def test_longest_clean_run(spark, seq, want):
    assert value(spark, S.longest_clean_run(F.lit(seq))) == want


def test_is_sequence(spark):
    assert value(spark, S.is_sequence(F.lit("ACGTN"))) and not value(spark, S.is_sequence(F.lit("ACGTn")))


@pytest.mark.parametrize("left,right,least,want", [("AACGT", "CGTTT", 2, 3), ("AAAA", "AAAA", 2, 4), ("AACG", "CG", 2, 0), ("ACGT", "TTTT", 2, 0), ("A", "ACGT", 2, 0)])
def test_overlap(spark, left, right, least, want):
    assert value(spark, S.overlap_length(F.lit(left), F.lit(right), least)) == want


@pytest.mark.parametrize("counts,want", [((0, 5, 2, 5), 4), ((1, 0, 0, 2), 3), ((0, 0, 0, 0), 4), ((7, 0, 0, 2), 0)])
def test_max_branch(spark, counts, want):
    assert value(spark, S.max_branch(F.array(*map(F.lit, counts)))) == want


def test_ids(spark):
    for i, rev, inward, forward in [(0, 1, 3, 2), (1, 0, 2, 3), (2, 3, 1, 0), (3, 2, 0, 1), (4, 5, 7, 6), (5, 4, 6, 7)]:
        assert value(spark, S.reverse_id(F.lit(i))) == rev
        assert value(spark, S.mate_id(F.lit(i), F.lit(2))) == inward == value(spark, S.mate_id(F.lit(i), F.lit(3)))
        assert value(spark, S.mate_id(F.lit(i), F.lit(1))) == forward
    assert value(spark, S.mate_id(F.lit(4), F.lit(0))) is None and value(spark, S.mate_direction(F.lit(4), F.lit(0))) == 2


def test_other_scalars(spark):
    assert value(spark, S.quality_mask(F.lit("ACGT"), F.lit("I#I!"), 40)) == "ANGN"
    assert value(spark, S.homopolymer_score(F.lit("AAAACCGGG"))) == 3
    assert value(spark, S.end_homopolymer(F.lit("ACGGG"), True)) == 3 and value(spark, S.end_homopolymer(F.lit("AACG"), False)) == 2
    assert value(spark, S.end_trim(F.lit("ACGTAC"), F.lit("ACGG"))) == 2
    assert value(spark, S.mask_from(F.lit("ACGT"), F.lit(1))) == "ANNN"
    assert value(spark, S.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2
    assert value(spark, S.common_prefix(F.lit("ACGT"), F.lit("ACT"))) == "AC"
    assert tuple(value(spark, S.end_match(F.lit("GGACG"), F.lit("TACGT"), 2, True))) == (1, 4)
    assert value(spark, S.end_match(F.lit("GGG"), F.lit("TACGT"), 2, True)) is None
    assert value(spark, S.congruent(F.lit("ACG"), F.lit("ACGTT"))) and not value(spark, S.congruent(F.lit("ACG"), F.lit("AG")))
    assert value(spark, S.kmers(F.lit("ACGT"), 3)) == ["ACG", "CGT"] and value(spark, S.kmers(F.lit("AC"), 3)) == []


def test_params():
    assert params.library_window(300) == (1, 560)
    assert params.seed_chunks(100, 5) == [0, 16, 33, 50, 66, 83, 100]
    limits = params.search_limits(100, 20)
    assert (limits["min_overlap"], limits["max_overlaps"], limits["const_cutoff"], limits["overlap_low"], limits["overlap_high"]) == (45, 400, 40, 25, 80)
    assert [params.clamp_extension(x) for x in (5, 5000, 10**6)] == [1000, 5000, 200_000]


def test_alignment():
    assert alignment.align("ACGT", "ACGT") == ("ACGT", "ACGT", 4)
    a, b, score = alignment.align("AAACGT", "ACGT")
    assert score == 4 and len(a) == len(b) == 6  # a longer run of A costs nothing
    assert alignment.align("ACGT", "AGT")[2] == 2
    assert alignment.penalty("ACGTACGT", "IIIIIIII", "ACGTACGT") == 0 and alignment.penalty("ACGTACGA", "IIIIIIII", "ACGTACGC") > 0
    for x, y in (("ACGGT", "AGT"), ("", "AC"), ("TTT", "")):
        p, q, _ = alignment.align(x, y)
        assert p.replace("-", "") == x and q.replace("-", "") == y


def test_alignment_columns(spark):
    df = spark.createDataFrame([("ACGT", "ACT"), ("AC", "AC")], "a string, b string")
    got = [tuple(r["x"]) for r in df.select(alignment.global_alignment(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[1] == ("AC", "AC", 2) and got[0][0].replace("-", "") == "ACGT"


def test_windows_of_long_and_short_sequences(spark):
    from helixframe.operators.index import windows

    texts = {1: "ACGT" * 200 + "GATTACA" * 50, 2: "ACG", 3: "", 4: "A" * 256, 5: "C" * 257, 6: None}
    got = windows(spark.createDataFrame(list(texts.items()), "q_id long, seq string"), 3, 10).collect()
    want = [(q, i + 1, s[i : i + 10]) for q, s in texts.items() if s for i in range(len(s) - 2)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_map_exact_reads_of_several_lengths(spark):
    from helixframe.operators.mapping import map_exact

    import random

    dice = random.Random(3)
    genome = "".join(dice.choice("ACGT") for _ in range(900)) + "ACGT" * 20
    reads = [genome[a : a + n] for a, n in ((0, 40), (10, 33), (250, 300), (500, 32), (900, 36), (3, 31), (700, 100), (700, 100))] + ["A" * 50, ""]
    got = map_exact(spark.createDataFrame([(7, genome), (8, genome[:35]), (9, "")], "q_id long, seq string"), spark.createDataFrame(list(enumerate(reads)), "read_no long, seq string"))
    want = [(q, i, p, p + len(r)) for q, g in ((7, genome), (8, genome[:35])) for i, r in enumerate(reads) if len(r) >= 32 for p in range(len(g)) if g.startswith(r, p)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_map_hamming_by_brute_force(spark):
    from helixframe.operators.mapping import map_hamming

    import random

    dice = random.Random(5)
    base = ["".join(dice.choice("ACGTN") for _ in range(47)) for _ in range(6)]
    seqs = [("".join(dice.choice("ACGTN") if dice.random() < 0.06 else c for c in s)) for s in base for _ in range(12)] + base + base[:2] + ["ACG"]
    first = {}
    for i, s in enumerate(seqs):
        first.setdefault(s, i)
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_no long, seq string")
    for errors in (0, 1, 4, 46):
        want = []
        for a, i in first.items():
            for b, j in first.items():
                d = sum(x != y for x, y in zip(a, b, strict=False))
                if i < j and len(a) == len(b) == 47 and d <= errors:
                    want.append((i, j, d))
        assert sorted(tuple(r) for r in map_hamming(reads, errors, 47).collect()) == sorted(want)
