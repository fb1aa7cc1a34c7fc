"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document gets the key -ln(u) / quality with u from a hash of its id. In
a source, documents in the order of their keys are a weighted sample without
replacement. A source's target of words is met by whole epochs first; what
is left is met by the documents whose prefix sum of words ends nearest to it.

The prefix sums need no sort of a whole source: sizes are summed by source
and key bucket (partial sums before the shuffle), the bucket in which the
budget ends is found on those sums, and only its documents are ordered. The
outcome of a source is one row, (epochs, bucket, last key), and a document's
share follows from that row and its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.names import Named
from helixframe.storage import materialize

BUCKETS = 4096
_SPACE = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.coalesce(F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, _SPACE))), F.lit(0)).cast("long")


def plausible(text: Column, size: Column) -> Column:
    """A quality weight: 1 for texts of 10 words or more of 3 to 12 characters on average, else a quarter."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when((size >= 10) & mean.between(3, 12), 1.0).otherwise(0.25)


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """docs with __size, __key, __bucket and __id."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    digits = F.conv(F.substring(F.md5(F.concat(own, F.lit(seed))), 1, 13), 16, 10).cast("double")
    return (
        docs.withColumn("__size", word_count(F.col("text")))
        .withColumn("__key", -F.ln((digits + 0.5) / float(1 << 52)) / plausible(F.col("text"), F.col("__size")))
        .withColumn("__bucket", F.least(F.floor((1 - F.exp(-F.col("__key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        .withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: shares of share * all words by weight, cut at most * source_size, the excess reshared by weight.

    With the sources in order of the share at which they are cut, those cut
    are a prefix; one pass of running sums over the sources finds its end.
    One row per source takes part, never rows of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_cut = Window.orderBy("cut_at", F.col("source").asc_nulls_last())
    before, after = by_cut.rowsBetween(Window.unboundedPreceding, -1), by_cut.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(Window.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    free = F.min(F.when(F.col("level") < F.col("cut_at"), F.struct("place", "level"))).over(Window.partitionBy())
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cut_at", most * F.col("source_size") / F.col("weight"))
        .withColumn("place", F.row_number().over(by_cut))
        .withColumn("level", level)
        .withColumn("free", free)
        .select("source", "source_size", F.when(F.col("free").isNull() | (F.col("place") < F.col("free.place")), most * F.col("source_size")).otherwise(F.col("weight") * F.col("free.level")).cast("double").alias("target"))
    )


def plan_sources(keyed: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per source: source_size, target, epochs, the bucket in which the rest ends and the last document taken in it."""
    rows = materialize(keyed.select("source", "__size", "__key", "__bucket", "__id"), "mix-rows")
    sums = materialize(rows.groupBy("source", "__bucket").agg(F.sum("__size").alias("s")), "mix-sums")
    aims = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, most)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = materialize(aims.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-aims")
    running = sums.withColumn("end", F.sum("s").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)))
    a, b = aims.alias("a"), running.alias("b")
    ends = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("b.end") > F.col("a.rest")))
    ends = ends.groupBy(F.col("a.source").alias("source")).agg(F.min(F.struct(F.col("b.__bucket").alias("bucket"), (F.col("b.end") - F.col("b.s")).alias("start"), F.col("a.rest").alias("rest"))).alias("at"))
    ends = materialize(ends.select("source", "at.*"), "mix-ends")
    inside = rows.alias("r").join(ends.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.__bucket") == F.col("e.bucket")))
    inside = inside.groupBy(F.col("r.source").alias("source"), "__key", "__id", "__size").agg(F.sum("__size").alias("s"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    upto = F.sum("s").over(Window.partitionBy("source").orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", F.col("start") + upto).where("upto - s / 2 <= rest").groupBy("source").agg(F.max(F.struct("__key", "__id", "__size")).alias("last"))
    e, t = ends.alias("e"), last.alias("t")
    cut = e.join(t, F.col("e.source").eqNullSafe(F.col("t.source")), "left").select(F.col("e.source").alias("source"), "bucket", "last")
    c = cut.alias("c")
    plan = a.join(c, F.col("a.source").eqNullSafe(F.col("c.source")), "left").select(F.col("a.source").alias("__source"), *(F.col(c).alias(f"__{c}") for c in ("source_size", "target", "epochs", "last")), F.col("bucket").alias("__end"))
    return materialize(plan, "mix-plan")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (default all) with size, source_size, target and taken.

    taken is the number of words the mix takes of a document, repeats
    counted. Sources in code point order, null last, have the weights in
    turn. A null text has size 0; documents of size 0 take nothing. Rows
    that repeat id, source and size are taken together or not at all. A null
    doc_id draws its key from the text. An empty table gives no rows. Columns
    of docs named like the added ones are replaced. The plan of the sources
    is a written table of one row each; Spark broadcasts it only below its
    own size threshold.
    """
    own = Named(docs)
    keyed = _keyed(own.df.select("*", own["doc_id"].alias("doc_id"), own["text"].alias("text"), own["source"].alias("source")), seed)
    plan = plan_sources(keyed, weights, share, most)
    chosen = (F.col("__bucket") < F.col("__end")) | ((F.col("__bucket") == F.col("__end")) & (F.struct("__key", "__id", "__size") <= F.col("__last")))
    extra = F.when(F.coalesce(chosen, F.lit(False)), F.col("__size")).otherwise(0)
    joined = keyed.join(plan, F.col("source").eqNullSafe(F.col("__source")))
    return own.back(joined, keep, size=F.col("__size"), source_size=F.col("__source_size"), target=F.col("__target"), taken=(F.col("__epochs") * F.col("__size") + extra).cast("long"))
