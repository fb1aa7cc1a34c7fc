"""K-mer counts, duplicate removal and windows over streams.

Checkpoints and state belong in the shared folder; callers name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import kmers
from helixframe.operators.correct import dedup_keys


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of a stream of reads (seq); use with output mode update or complete."""
    return reads.select(F.explode(kmers(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def first_of_key(pairs: DataFrame, time: str, delay: str) -> DataFrame:
    """Pairs of which none with the same key came within the delay; pairs without a key all pass as their own."""
    keyed = dedup_keys(pairs).withColumn("key", F.coalesce("key", F.concat(F.lit("#"), F.col("pair_no").cast("string"))))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])


def windowed_counts(events: DataFrame, time: str, key: str, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(window, key, n, total) of tumbling or sliding windows; late rows beyond the delay are left out."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, delay).groupBy(window, key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
