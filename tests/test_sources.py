import pytest

from helixframe.sources import reads as R
from helixframe.streaming import incremental


def test_formats_are_told_by_file(spark, tmp_path):
    long = "n" * (1 << 20)
    (tmp_path / "a.fq").write_text(f"@{long}\nACGT\n+\nIIII\n")
    (tmp_path / "b.fa").write_text(">x\nGGCC\n>y\nTTAA\n")
    (tmp_path / "c.txt").write_text("AAAA\nCCCC\n")
    found = R.read_records(spark, f"file://{tmp_path}").collect()
    rows = sorted((r["path"].rsplit("/", 1)[1], r["record"], r["name"], r["seq"], r["qual"]) for r in found)
    assert rows == [("a.fq", 0, long, "ACGT", "IIII"), ("b.fa", 0, "x", "GGCC", None), ("b.fa", 1, "y", "TTAA", None), ("c.txt", 0, None, "AAAA", None), ("c.txt", 1, None, "CCCC", None)]


def test_formats(spark, tmp_path):
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\n{'ACGT'[i % 4] * 90}\n+\n{'I' * 90}\n" for i in range(10)))
    (tmp_path / "b.fa").write_text("".join(f">s{i}\nACGTACGT\n" for i in range(3)))
    (tmp_path / "c.txt").write_text("ACGT\nGGGG\n")
    fq = R.read_records(spark, f"file://{tmp_path}/a.fq")
    rows = {r["record"]: r for r in fq.collect()}
    assert rows[3]["name"] == "r3" and rows[3]["seq"] == "T" * 90 and rows[9]["qual"] == "I" * 90 and len(rows) == 10
    assert R.read_length(fq) == 90
    pairs = {r["pair_no"]: r for r in R.interleaved_pairs(fq).collect()}
    assert pairs[1]["r1"] == "G" * 90 and pairs[1]["r2"] == "T" * 90
    assert sorted((r["name"], r["seq"]) for r in R.read_records(spark, f"file://{tmp_path}/b.fa").collect()) == [(f"s{i}", "ACGTACGT") for i in range(3)]
    assert sorted(r["seq"] for r in R.read_records(spark, f"file://{tmp_path}/c.txt").collect()) == ["ACGT", "GGGG"]
    with pytest.raises(ValueError):
        R.read_length(R.read_records(spark, f"file://{tmp_path}/c.txt"))


def test_lists():
    assert R.parse_libraries("# x\n\nsingle s\npaired a b\npaired c\n") == [("paired", ["a", "b"]), ("paired", ["c"]), ("single", ["s"])]
    for bad in ("single a", "paired a b c", "other a", "paired a\n" * 6):
        with pytest.raises(ValueError):
            R.parse_libraries(bad)
    assert R.parse_seeds("acgt\r\nGGG\n\nTTT") == [("Input_sequence_1", "ACGT"), ("Input_sequence_2", "GGG")]
    assert R.parse_seeds(">x y\nAC\nGT\n>z\nA") == [("x y", "ACGT"), ("z", "A")]
    with pytest.raises(ValueError):
        R.parse_seeds("ACGN")


def test_sinks(spark, tmp_path):
    loci = spark.createDataFrame([("l1", "AC", "G", "T")], "header string, origin string, left string, right string")
    R.write_fasta(R.locus_records(loci).coalesce(1), f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == ">l1\nAC\n>l1_left_extension\nG\n>l1_right_extension\nT\n"
    with pytest.raises(Exception, match="already exists"):
        R.write_fasta(R.locus_records(loci), f"file://{tmp_path}/out")


def test_graph_dump_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 2, "ACGT", "", 0, 3, "0_4_1", "a"), (2, 1, "GG", "1", 1, 0, "", "")], "node_id long, drxn int, seq string, cloned string, stop_l int, stop_r int, ends string, tags string")
    edges = spark.createDataFrame([(1, 2, 1, 2, False), (2, 1, 0, -3, True)], "src long, dst long, drxn int, ol int, leap boolean")
    R.write_graph_dump(nodes, edges, f"file://{tmp_path}/dump")
    n, e = R.read_graph_dump(spark, f"file://{tmp_path}/dump")
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect()))
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.collect()))


def test_streams_equal_batches(spark, tmp_path):
    from helixframe.operators.index import kmer_counts

    rows = [(i, "ACGTACGTAA"[i % 3 :] * 3) for i in range(12)]
    df = spark.createDataFrame(rows, "read_no long, seq string")
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = incremental.kmer_counts(stream, 4).writeStream.outputMode("complete").format("memory").queryName("kmers").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("kmers").collect())) == sorted((r["kmer"], r["n"]) for r in kmer_counts(df, 4).collect())
