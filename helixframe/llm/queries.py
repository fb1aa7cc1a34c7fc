"""The pipeline operators as queries over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import langid, oracles, quality, url_filter, warc
from helixframe.llm.decontaminate import find_leaks
from helixframe.llm.line_dedup import dedup_lines
from helixframe.llm.lm_score import score_texts
from helixframe.llm.mixing import mix_sources
from helixframe.llm.ngram_join import ngram_jaccard_components, ngram_jaccard_links
from helixframe.llm.suffix_dedup import remove_repeats

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op1_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_links(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)[1]


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), at_least=0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=5, num=8, den=10)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0, keep=["doc_id"])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), length=200).drop("kept")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op7_lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op7_lm_score."""
    return score_texts(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.fold("doc_id", 5) == 0
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES), default="allow", keep=["page_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard, op1_ngram_links, op2_warc, op3_quality, op4_decontaminate, op5_mixing, op6_suffix_dedup, op7_lm_score, op7_lm_base, op8_langid, op9_line_dedup, op10_url_filter)
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": oracles.OP1,
    "op1_ngram_links": oracles.OP1_LINKS,
    "op2_warc": oracles.OP2,
    "op3_quality": oracles.OP3,
    "op4_decontaminate": oracles.OP4,
    "op5_mixing": oracles.OP5,
    "op6_suffix_dedup": oracles.OP6,
    "op7_lm_base": oracles.OP7_BASE,
    "op9_line_dedup": oracles.OP9,
    "op10_url_filter": oracles.OP10,
}
