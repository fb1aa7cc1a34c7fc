"""Extensions of a sequence's end: overlaps folded into branches, culled and joined.

Per query the overlaps are bounded (the overlap join keeps the top ones), so
the ordered fold runs on one query's rows at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.params import GIVE_UP_BRANCHES, STRONG_BRANCH

BRANCH = "q_id long, branch long, parent long, seq string, max_over int, max_ext int, n_reads long"


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Place extensions, longest first, in a tree: one that continues a branch's text joins it, one that departs opens a branch under it."""
    rows = pdf.sort_values(["ext_len", "over_len", "read_no"], ascending=[False, False, True])
    branches: list[dict] = []
    for read, ext, over in zip(rows["read_no"], rows["ext"], rows["over_len"], strict=True):
        best, shared = None, -1
        for b in branches:
            n = next((i for i, (x, y) in enumerate(zip(ext, b["seq"], strict=False)) if x != y), min(len(ext), len(b["seq"])))
            if n > shared:
                best, shared = b, n
        if best is not None and shared == len(ext):
            best["reads"].add(read)
            best["max_over"] = max(best["max_over"], over)
        else:
            branches.append({"branch": len(branches), "parent": best["branch"] if best is not None and shared else None, "seq": ext, "max_over": over, "reads": {read}})
    out = [(pdf["q_id"].iloc[0], b["branch"], b["parent"], b["seq"], b["max_over"], len(b["seq"]), len(b["reads"])) for b in branches]
    return pd.DataFrame(out, columns=["q_id", "branch", "parent", "seq", "max_over", "max_ext", "n_reads"]).astype({"parent": "Int64"})


def compile_branches(overlaps: DataFrame, most: int) -> DataFrame:
    """BRANCH rows of overlaps (q_id, read_no, ext, over_len, ext_len): at most `most` overlaps of a query take part, longest extensions first."""
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("ext_len"), F.desc("over_len"), "read_no"))
    kept = overlaps.where("ext_len > 0").withColumn("p", place).where(F.col("p") <= most).drop("p")
    return kept.groupBy("q_id").applyInPandas(_fold, BRANCH)


def cull_branches(branches: DataFrame, least_reads: int = 2, cutoff: int = 0) -> DataFrame:
    """Branches with enough reads that no other of the query dominates.

    A branch dominates another when its overlap is longer by more than twice
    the cutoff, or without a cutoff when it has five times the reads. Queries
    with GIVE_UP_BRANCHES branches or more lose all unless one has five reads.
    """
    strong = branches.where(F.col("n_reads") >= least_reads)
    per = Window.partitionBy("q_id")
    counted = strong.withColumn("n", F.count("*").over(per)).withColumn("top_reads", F.max("n_reads").over(per)).withColumn("top_over", F.max("max_over").over(per))
    dominated = (F.col("top_over") > F.col("max_over") + 2 * cutoff) if cutoff else (F.col("top_reads") >= 5 * F.col("n_reads"))
    return counted.where(((F.col("n") < GIVE_UP_BRANCHES) | (F.col("top_reads") >= 5)) & ~dominated).drop("n", "top_reads", "top_over")


def trim_branches(branches: DataFrame, share: float = 0.9) -> DataFrame:
    """Branches cut to share of the query's longest extension."""
    most = F.floor(F.max("max_ext").over(Window.partitionBy("q_id")) * share).cast("int")
    return branches.withColumn("seq", F.substring(F.col("seq"), F.lit(1), F.greatest(most, F.lit(1)))).withColumn("max_ext", F.length("seq"))


def join_reads(overlaps: DataFrame, right: str) -> DataFrame:
    """Overlaps whose extension runs into the text `right`: reads that span the junction."""
    n = F.least(F.length("ext"), F.lit(len(right)))
    return overlaps.where((F.length("ext") > 0) & (F.substring(F.col("ext"), F.lit(1), n) == F.substring(F.lit(right), F.lit(1), n))).dropDuplicates(["q_id", "read_no"])


def volumes(overlaps: DataFrame) -> DataFrame:
    """(q_id, volume): summed lengths of extensions beyond the query's shortest, each overlap length once."""
    once = overlaps.groupBy("q_id", "over_len").agg(F.max("ext_len").alias("ext_len"))
    return once.withColumn("least", F.min("ext_len").over(Window.partitionBy("q_id"))).groupBy("q_id").agg(F.sum(F.col("ext_len") - F.col("least")).alias("volume"))


def next_bases(overlaps: DataFrame, reads: str | None = None) -> DataFrame:
    """(q_id, base, n): bases that follow the query; beside one of STRONG_BRANCH reads or more others need two, else one. A row counts as one read, or as many as the column `reads` says."""
    count = F.sum(reads) if reads else F.count("*")
    counts = overlaps.where("ext_len > 0").groupBy("q_id", F.substring("ext", 1, 1).alias("base")).agg(count.alias("n"))
    top = F.max("n").over(Window.partitionBy("q_id"))
    return counts.withColumn("top", top).where((F.col("n") >= 2) | (F.col("top") < STRONG_BRANCH)).drop("top")


def extend_once(ends: DataFrame, reads: DataFrame, least: int, most: int) -> DataFrame:
    """ends (q_id, seq) grown by the one branch that their overlaps agree on; those with none or several stay, with stop 1 or 2."""
    tail = ends.select("q_id", "seq")
    longest = reads.agg(F.max(F.length("seq"))).first()[0] or 0
    spots = tail.where(F.length("seq") > least).select("q_id", F.expr(f"right(seq, {longest})").alias("q")).select("q_id", "q", F.explode(F.sequence(F.lit(1), F.length("q") - least + 1)).alias("i"))
    spots = spots.withColumn("key", F.substring(F.col("q"), F.col("i"), F.lit(least)))
    heads = reads.where(F.length("seq") >= least).select("read_no", F.col("seq").alias("t"), F.substring("seq", 1, least).alias("key"))
    rest = F.substring(F.col("q"), F.col("i"), F.length("q"))
    hit = spots.join(heads, "key").where(F.startswith("t", rest)).select("q_id", "read_no", F.length(rest).alias("over_len"), F.expr("substring(t, length(q) - i + 2)").alias("ext")).withColumn("ext_len", F.length("ext"))
    branches = trim_branches(cull_branches(compile_branches(hit, most), 1))
    counted = branches.groupBy("q_id").agg(F.count("*").alias("n"), F.max(F.struct("max_over", "n_reads", "seq")).alias("b"))
    return tail.join(counted, "q_id", "left").select("q_id", F.when(F.col("n") == 1, F.concat("seq", "b.seq")).otherwise(F.col("seq")).alias("seq"), F.when(F.col("n").isNull(), 1).when(F.col("n") > 1, 2).otherwise(0).alias("stop"))


def grow(seeds: DataFrame, reads: DataFrame, least: int, limit: int, most: int = 300, rounds: int | None = None) -> DataFrame:
    """(q_id, seq, stop): seeds extended to the right until nothing extends them, branches disagree, or `limit` bases were added.

    All seeds grow in one job per round; the table is written each round so
    that the plan doesn't grow with the sequences. A round adds a base at
    least, so there are no more than limit + 1 rounds; a smaller bound that is
    hit is an error.
    """
    from helixframe.storage import materialize

    now = materialize(seeds.select("q_id", "seq", F.lit(0).alias("stop"), F.length("seq").alias("start")), "grow")
    for _ in range(limit + 1 if rounds is None else rounds):
        if now.where("stop = 0").isEmpty():
            break
        moved = extend_once(now.where("stop = 0"), reads, least, most).join(now.select("q_id", "start"), "q_id")
        moved = moved.select("q_id", "seq", F.when((F.col("stop") == 0) & (F.length("seq") - F.col("start") >= limit), 3).otherwise(F.col("stop")).alias("stop"), "start")
        now = materialize(now.where("stop <> 0").union(moved), "grow")
    if not now.where("stop = 0").isEmpty():
        raise RuntimeError("growth did not end")
    return now.select("q_id", "seq", "stop")
