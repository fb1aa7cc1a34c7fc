"""Read views derived from documents: the letters A, C, G and T of a text, cut into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import revcomp

READ, STEP = 100, 40


def genomes(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("seq"))


def _windows(df: DataFrame) -> DataFrame:
    starts = F.sequence(F.lit(0), F.floor((F.length("seq") - READ) / STEP).cast("int"))
    cut = df.where(F.length("seq") >= READ).select("doc_id", "seq", F.explode(starts).alias("k"))
    return cut.select((F.col("doc_id") * 100_000 + F.col("k")).alias("read_no"), "doc_id", F.col("k").cast("long").alias("k"), F.substring(F.col("seq"), F.col("k") * STEP + 1, F.lit(READ)).alias("seq"))


def reads(documents: DataFrame) -> DataFrame:
    """read_no, doc_id, k, seq."""
    return _windows(genomes(documents))


def reads_with_n(documents: DataFrame) -> DataFrame:
    """The same windows of the whole text's letters, those that are no base as N."""
    letters = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACGT]", "N")
    return _windows(documents.select("doc_id", letters.alias("seq")))


def reads_with_quality(documents: DataFrame) -> DataFrame:
    place = F.sequence(F.lit(0), F.lit(READ - 1))
    return reads(documents).withColumn("qual", F.array_join(F.transform(place, lambda p: F.char(F.lit(33) + (F.col("k") * 7 + p * 13) % 41)), ""))


def stranded(reads: DataFrame) -> DataFrame:
    """Both strands: read_id 2n forward, 2n + 1 reverse."""
    both = F.array(F.struct(F.lit(0).alias("rev"), F.col("seq").alias("seq")), F.struct(F.lit(1).alias("rev"), revcomp(F.col("seq")).alias("seq")))
    return reads.select("read_no", F.explode(both).alias("s")).select((F.col("read_no") * 2 + F.col("s.rev")).alias("read_id"), "read_no", (F.col("s.rev") == 1).alias("is_rev"), F.col("s.seq").alias("seq"))


def pairs(reads: DataFrame) -> DataFrame:
    """Window k with the reverse complement of window k + 5 of the same document: inward mates, 300 apart."""
    right = reads.select("doc_id", (F.col("k") - 5).alias("k"), revcomp(F.col("seq")).alias("r2"))
    return reads.select(F.col("read_no").alias("pair_no"), "doc_id", "k", F.col("seq").alias("r1")).join(right, ["doc_id", "k"])


def sequences(reads: DataFrame) -> DataFrame:
    """Distinct sequences with their smallest read and number of reads."""
    return reads.groupBy("seq").agg(F.min("read_no").alias("node_id"), F.count("*").alias("n_reads"))


def window_edges(reads: DataFrame) -> DataFrame:
    """Distinct edges between the distinct sequences of windows k, k + 1 (overlap 60) and k, k + 2 (overlap 20)."""
    named = reads.join(sequences(reads).select("seq", "node_id"), "seq").select("doc_id", "k", "node_id")
    steps = named.select("doc_id", F.explode(F.array(F.struct((F.col("k") + 1).alias("k"), F.lit(60).alias("ol")), F.struct((F.col("k") + 2).alias("k"), F.lit(20).alias("ol")))).alias("s"), F.col("node_id").alias("src"))
    steps = steps.select("doc_id", F.col("s.k").alias("k"), F.col("s.ol").alias("ol"), "src")
    joined = steps.join(named.select("doc_id", "k", F.col("node_id").alias("dst")), ["doc_id", "k"]).where("src <> dst")
    return joined.groupBy("src", "dst").agg(F.max("ol").alias("ol"))
