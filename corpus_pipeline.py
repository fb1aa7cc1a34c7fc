"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import langid
from helixframe.llm.decontaminate import drop_contaminated
from helixframe.llm.line_dedup import drop_repeated_lines
from helixframe.llm.mixing import mix_sources
from helixframe.llm.ngram_join import drop_near_copies
from helixframe.storage import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a null text, one without a letter or an unsure prediction goes. Ties go to the first language; texts count whole."""
    return langid.keep_recognised(docs, langid.train(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones, in the order of doc_id; those with nothing left go, null texts and ids stay. n_chars follows the text."""
    return drop_repeated_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, by five words and a similarity of 0.8; rows with a null id, or without words, stay."""
    return drop_near_copies(docs, k=5, num=8, den=10)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; rows with a null id or text stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, num=8, den=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken; those without words go."""
    return mix_sources(docs, weights=(3, 1, 2), share=1.5, most=2.0).where("taken > 0")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontaminate", decontaminate), ("mix", mix)]
#: Language identification learns a model, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
