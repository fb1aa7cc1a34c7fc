"""Line dedup by overlapping windows of three consecutive lines.

A line is what stands between line feeds; lines without a word take no part.
Windows of three consecutive lines (trimmed of blanks) are hashed, windows
found more than once in the whole corpus are known by their first occurrence
in the order of doc_id and position, and every line that a later occurrence
covers is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.names import Named
from helixframe.storage import materialize

WIDTH = 3


def _lines(text):
    return F.split(text, "\n", -1)


def _worded(text):
    """(line number, trimmed line) of the lines with a word."""
    numbered = F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(" \t\n\x0b\x0c\r")).alias("x")))
    return F.filter(numbered, lambda s: F.length(s["x"]) > 0)


def _windows(docs: DataFrame) -> DataFrame:
    """One row per window: document key, index among the worded lines, hash."""
    spread = docs.select("doc_id", F.xxhash64("text").alias("of"), _worded(F.col("text")).alias("w")).where(F.size("w") >= WIDTH)
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - WIDTH), lambda i: F.xxhash64(*(F.get("w", i + j)["x"] for j in range(WIDTH))))
    return spread.select("doc_id", "of", F.posexplode(hashes).alias("at", "h"))


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, of, covered): indexes, among a document's worded lines, that later occurrences cover."""
    windows = materialize(_windows(docs.where("doc_id is not null and text is not null")), "windows")
    first = windows.groupBy("h").agg(F.min(F.struct("doc_id", "of", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    later = windows.join(first, "h").where(F.struct("doc_id", "of", "at") > F.col("first"))
    spans = later.groupBy("doc_id", "of").agg(F.collect_set("at").alias("at"))
    merged = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + WIDTH - 1))))
    return spans.select("doc_id", "of", merged.alias("covered"))


def _cut(own: Named) -> DataFrame:
    """The renamed table with cut (the text left), n_lines and n_removed."""
    docs = own.df
    covered = covered_lines(docs.select(own["doc_id"].alias("doc_id"), own["text"].alias("text")))
    joined = docs.join(covered, (own["doc_id"] == F.col("doc_id")) & (F.xxhash64(own["text"]) == F.col("of")), "left")
    worded = F.coalesce(_worded(own["text"]), F.array().cast("array<struct<i:int,x:string>>"))
    gone = F.transform("covered", lambda c: F.get("w", c)["i"])
    lines = _lines(own["text"])
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col("covered").isNull(), own["text"]).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n_removed = F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long")
    return joined.withColumn("w", worded).select(*docs.columns, text.alias("cut"), F.size("w").cast("long").alias("n_lines"), n_removed.alias("n_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text cut down, and n_lines and n_removed (long) appended.

    Rows with a null doc_id or text, and texts of fewer than three worded
    lines, stay as they are. Rows that repeat doc_id and text are one
    document: they get the same result; of equal windows the first in the
    order of doc_id and place stays. Lines and texts may be of any length.
    Columns of docs named like the added ones are replaced; others, whatever
    their names, are kept.
    """
    own = Named(docs)
    cut = _cut(own).withColumn(own.name("text"), F.col("cut"))
    return own.back(cut, n_lines=F.col("n_lines"), n_removed=F.col("n_removed"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs, all columns and no more, with text cut down as in dedup_lines; rows of which no line is left go.

    n_chars, where docs has it, is the length of a text that was cut, in its
    own type.
    """
    own = Named(docs)
    cut = _cut(own).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in own:
        kind = own.df.schema[own.name("n_chars")].dataType
        cut = cut.withColumn(own.name("n_chars"), F.when(F.col("n_removed") > 0, F.length("cut").cast(kind)).otherwise(own["n_chars"]))
    return own.back(cut.withColumn(own.name("text"), F.col("cut")))
