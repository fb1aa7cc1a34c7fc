"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.storage import materialize

#: Rows of a centre that are few enough for one task.
HOT = 512


def _with_least(rows: DataFrame, hot: int) -> DataFrame:
    """rows (u, v) with m, the least v of each u.

    Centres with more than `hot` rows have it by broadcast and are dealt over
    all tasks in the join of the others, so that the rows of none meet in one
    task; hot is at least a 65536th of all rows, so there are fewer than 65536.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    few = F.broadcast(least.where(F.col("c") > hot).select("u", F.col("m").alias("known")))
    dealt = rows.join(few, "u", "left").withColumn("salt", F.when(F.col("known").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("v")))
    found = dealt.join(least.select("u", "m", F.lit(0).cast("long").alias("salt")), ["u", "salt"], "left")
    return found.select("u", "v", F.coalesce("known", "m").alias("m"))


def _large_star(edges: DataFrame, hot: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, hot).select(F.col("v").alias("u"), F.least("u", "m").alias("v"), F.col("u").alias("of")).where("u > of").select("u", "v")


def _small_star(edges: DataFrame, hot: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _with_least(down, hot).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v) that isn't its component's smallest node.

    Each round is two aggregations with map-side combine and two joins on a
    node key, without its hot centres; the rounds grow with the logarithm of the longest path. Self
    loops and repeated edges are ignored; nulls must be filtered out before.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    sign, rows = None, now.count()
    for _ in range(max_rounds):
        # each of the two stars has at most twice the edges as rows
        hot = max(HOT, 2 * rows >> 16)
        now = materialize(_small_star(_large_star(now, hot), hot).distinct(), "cc")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == sign:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign, rows = tuple(seen), seen[0]
    raise RuntimeError("components did not converge")
