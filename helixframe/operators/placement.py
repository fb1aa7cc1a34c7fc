"""Reads placed on nodes: redundancy, depth, mates, distances, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import mate_id
from helixframe.params import MAX_LIBRARIES, RELIABLE_READS, VERIFIED_HITS


def redundant(placed: DataFrame, read_length: int) -> DataFrame:
    """placed (node, read_no, start, end) with redundant: a strictly longer interval of another read contains it. Full-length reads never are.

    Distinct intervals of a node are put in the order (start, -end): those
    before begin at or before an interval's start, and the furthest of their
    ends tells, so one running maximum replaces a range join.
    """
    order = Window.partitionBy("node").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("node", "start", "end").distinct().withColumn("inside", F.coalesce(F.max("end").over(order) >= F.col("end"), F.lit(False)))
    return placed.join(inside, ["node", "start", "end"]).withColumn("redundant", F.col("inside") & (F.col("end") - F.col("start") != read_length)).drop("inside")


def depth(placed: DataFrame) -> DataFrame:
    """(node, pos, until, depth): constant stretches of depth, from the interval ends alone."""
    ends = placed.select("node", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e")).groupBy("node", "e.pos").agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy("node").orderBy("pos")
    return ends.select("node", "pos", F.lead("pos").over(order).alias("until"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("depth")).where("until is not null")


def capped_depth(placed: DataFrame, cap: float) -> DataFrame:
    """(node, mean): mean of the depth per base, cut at cap, from the first read's start to the last one's end."""
    width = F.col("until") - F.col("pos")
    return depth(placed).groupBy("node").agg((F.sum(F.least(F.col("depth").cast("double"), F.lit(float(cap))) * width) / F.sum(width)).alias("mean"))


def densest_window(marks: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """(key, at, n): the first place with the most marks from it on within width."""
    order = Window.partitionBy(key).orderBy(value).rangeBetween(0, width)
    counted = marks.select(key, value).withColumn("n", F.count("*").over(order))
    best = counted.groupBy(key).agg(F.max(F.struct("n", (-F.col(value)).alias("back"))).alias("b"))
    return best.select(key, (-F.col("b.back")).alias("at"), F.col("b.n").alias("n"))


def misassembled(marks: DataFrame, key: str, value: str, width: int, cutoff: int) -> DataFrame:
    """(key, begin, end): the first stretch of less than width that holds a mark and `cutoff` more, up to its last mark."""
    order = Window.partitionBy(key).orderBy(value)
    ahead = marks.select(key, value).withColumn("ahead", F.lead(value, cutoff).over(order))
    begin = ahead.where(F.col("ahead") - F.col(value) < width).groupBy(key).agg(F.min(value).alias("begin"))
    return marks.join(begin, key).where((F.col(value) >= F.col("begin")) & (F.col(value) - F.col("begin") < width)).groupBy(key, "begin").agg(F.max(value).alias("end"))


def misassembly_window(read_length: int, mean: int, cover: float) -> tuple[int, int]:
    """Width and cutoff for misassembled from the mean distance and the cover of paired-end libraries."""
    width = max(read_length, mean // 2)
    return width, int(max(3.0, width * cover / (read_length * 6)))


def estimate(pe: Column, mp: Column) -> Column:
    """Median of paired-end estimates, else of mate-pair ones: the mean of the middle two, whole."""

    def median(values: Column) -> Column:
        s, n = F.sort_array(values), F.size(values)
        return F.floor((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return F.when(F.size(pe) > 0, median(pe)).when(F.size(mp) > 0, median(mp)).cast("long")


def node_coverage(n_reads: Column, length: Column, read_length: int, cover: float) -> Column:
    """(reads - 2) * read length / length; cover for fewer than three reads."""
    return F.when(n_reads < 3, F.lit(float(cover))).otherwise((n_reads - 2) * read_length / length)


def length_for_coverage(length: Column, best_left: Column, best_right: Column, read_length: int) -> Column:
    """length less half of the best overlaps on both sides; a side without an edge counts a read, or the node if that is shorter. At least 1."""
    open_end = F.least(length, F.lit(read_length))
    return F.greatest(length - F.floor((F.coalesce(best_left, open_end) + F.coalesce(best_right, open_end)) / 2), F.lit(1)).cast("int")


def copies(n_reads: Column, covered_length: Column, read_length: int, spacing: float, cover: float) -> Column:
    """How many copies a node's reads stand for: three more reads over three more spacings, against 0.7 of the cover."""
    return (n_reads + 3) * read_length / (covered_length + spacing * 3) / (cover * 0.7)


def is_single_copy(n_reads: Column, coverage: Column, length: Column, read_length: int, cover: float) -> Column:
    return (n_reads >= RELIABLE_READS) & (coverage < cover * (1.4 + F.least(F.lit(0.4), length / (20.0 * read_length))))


def is_multi_copy(coverage: Column, length: Column, read_length: int, cover: float) -> Column:
    return coverage > cover * (1.3 + F.least(F.lit(0.2), length / (20.0 * read_length)))


def library_of(reads: DataFrame, libraries: DataFrame) -> DataFrame:
    """reads (read_id) with the library whose [begin_id, end_id) holds them; null outside all. More libraries than a run may have are an error, so the broadcast is of a few rows."""
    rows = libraries.select("lib_id", "begin_id", "end_id", "orientation", "insert_size")
    if rows.count() > 2 * MAX_LIBRARIES:
        raise ValueError(f"more than {2 * MAX_LIBRARIES} libraries")
    return reads.join(F.broadcast(rows), (F.col("read_id") >= F.col("begin_id")) & (F.col("read_id") < F.col("end_id")), "left").drop("begin_id", "end_id")


def with_mates(placed: DataFrame) -> DataFrame:
    """placed (read_id, orientation, …) with mate_id."""
    return placed.withColumn("mate_id", mate_id(F.col("read_id"), F.col("orientation")))


def unpaired(placed: DataFrame) -> DataFrame:
    """Placements whose mate is on no node."""
    mates = with_mates(placed).where("mate_id is not null")
    return mates.join(placed.select(F.col("read_id").alias("mate_id")).distinct(), "mate_id", "left_anti")


def pair_hits(placed: DataFrame) -> DataFrame:
    """(src, dst, n, estimates): pairs of nodes that mates join."""
    a = with_mates(placed).where("mate_id is not null").select("mate_id", F.col("node").alias("src"), F.col("start").alias("a"))
    b = placed.select(F.col("read_id").alias("mate_id"), F.col("node").alias("dst"), F.col("end").alias("b"))
    return a.join(b, "mate_id").groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum(F.col("b") - F.col("a")).alias("distance"))


def verified(hits: DataFrame) -> DataFrame:
    """Nodes with VERIFIED_HITS hits or more to others on both sides."""
    out = hits.where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("forward"))
    back = hits.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("backward"))
    return out.join(back, "node").where((F.col("forward") >= VERIFIED_HITS) & (F.col("backward") >= VERIFIED_HITS)).select("node")


def best_clone(candidates: DataFrame) -> DataFrame:
    """Of several nodes that a mate may lie on (read_id, node, distance, expected) the one whose distance is nearest the expected."""
    place = F.row_number().over(Window.partitionBy("read_id").orderBy(F.abs(F.col("distance") - F.col("expected")), "node"))
    return candidates.withColumn("place", place).where("place = 1").drop("place")


def next_read(placed: DataFrame, marks: DataFrame, nodes: DataFrame, right: bool = True) -> DataFrame:
    """(node, mark, next): the first start after each mark (node, mark), or the node's end (nodes: node, begin, end) where that comes first or no read starts; leftward the last end before it, or the node's begin."""
    sign, edge, limit = (1, "start", "end") if right else (-1, "end", "begin")
    both = placed.select("node", (sign * F.col(edge)).alias("at"), F.lit(None).cast("long").alias("mark")).union(marks.select("node", sign * F.col("mark"), F.col("mark").cast("long")))
    order = Window.partitionBy("node").orderBy("at", F.col("mark").isNull().cast("int").desc()).rowsBetween(1, Window.unboundedFollowing)
    ahead = F.first(F.when(F.col("mark").isNull(), F.col("at")), True).over(order)
    found = both.withColumn("ahead", ahead).where("mark is not null").join(nodes.select("node", (sign * F.col(limit)).alias("last")), "node")
    return found.select("node", "mark", (sign * F.least("ahead", "last")).alias("next"))


def path_pair_score(hits: DataFrame, distances: DataFrame, margin: Column) -> DataFrame:
    """(src, dst, score): hits of node pairs whose distance on the graph is less than the estimate plus margin."""
    joined = hits.join(distances.select(F.col("start").alias("src"), F.col("node").alias("dst"), "dist"), ["src", "dst"])
    return joined.where(F.col("dist") < F.col("estimate") + margin).groupBy("src", "dst").agg(F.sum("n").alias("score"))
