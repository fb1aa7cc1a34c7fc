"""Passes over assembly graphs: coordinates, clones, paths, repeats, gaps, contigs.

Tables: edges (src, dst, ol), nodes (node, len, n_reads, …), hits (src, dst,
n). Loops are bounded and write their state each round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.alignment import global_alignment
from helixframe.operators.graph import bubbles, chains, components, degrees, drop_nodes, reach
from helixframe.params import BUBBLE_READS
from helixframe.storage import materialize


def recoordinate(edges: DataFrame, nodes: DataFrame, origins: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, start): the furthest coordinate that ways from the origins (node at 0) give: start of the source plus its length minus the overlap.

    Each round relaxes only nodes that moved. Ways around a cycle would grow
    without end, so a coordinate may not pass the summed length of all nodes.
    """
    most = nodes.agg(F.sum("len")).first()[0] or 0
    steps = materialize(edges.join(nodes.select(F.col("node").alias("src"), "len"), "src").select("src", "dst", (F.col("len") - F.col("ol")).alias("step")), "steps")
    now = materialize(origins.select("node", F.lit(0).cast("long").alias("start"), F.lit(True).alias("moved")).distinct(), "coords")
    for _ in range(rounds):
        ahead = now.where("moved").select(F.col("node").alias("src"), "start").join(steps, "src").select(F.col("dst").alias("node"), (F.col("start") + F.col("step")).cast("long").alias("start"), F.lit(1).alias("new")).where(F.col("start") <= most)
        merged = now.select("node", "start", F.lit(0).alias("new")).union(ahead).groupBy("node").agg(F.max(F.struct("start", (-F.col("new")).alias("old"))).alias("b"))
        now = materialize(merged.select("node", "b.start", (F.col("b.old") < 0).alias("moved")), "coords")
        if now.where("moved").isEmpty():
            return now.select("node", "start")
    raise RuntimeError("coordinates did not settle")


def offset_conflicts(edges: DataFrame, coords: DataFrame, nodes: DataFrame, most: int = 200) -> DataFrame:
    """(src, dst, diff): edges whose end lies more than `most` away from where the edge puts it."""
    a = coords.select(F.col("node").alias("src"), F.col("start").alias("a"))
    b = coords.select(F.col("node").alias("dst"), F.col("start").alias("b"))
    diff = F.col("b") - (F.col("a") + F.col("len") - F.col("ol"))
    return edges.join(a, "src").join(b, "dst").join(nodes.select(F.col("node").alias("src"), "len"), "src").select("src", "dst", diff.alias("diff")).where(F.abs("diff") > most)


def clone_nodes(edges: DataFrame, nodes: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes with each (node, copy, src, dst) of copies as a node of its own between one way in and one way out.

    The copied node's edges to the named neighbours go to the copy; copy ids
    come from the caller; clone_group is the node that was copied.
    """
    own = nodes.join(copies.select("node", "copy").distinct(), "node").withColumn("clone_group", F.col("node")).withColumn("node", F.col("copy")).drop("copy")
    base = nodes.withColumn("clone_group", F.col("node"))
    into = copies.select("src", F.col("node").alias("dst"), "copy").where("src is not null")
    out = copies.select(F.col("node").alias("src"), "dst", "copy").where("dst is not null")
    moved = edges.join(into, ["src", "dst"]).select("src", F.col("copy").alias("dst"), "ol").union(edges.join(out, ["src", "dst"]).select(F.col("copy").alias("src"), "dst", "ol"))
    left = edges.join(into, ["src", "dst"], "left_anti").join(out, ["src", "dst"], "left_anti").select("src", "dst", "ol")
    return left.union(moved), base.unionByName(own)


def crosses(edges: DataFrame) -> DataFrame:
    """Nodes with several ways in and several ways out."""
    return degrees(edges).where("n_in > 1 and n_out > 1").select("node")


def cross_pairings(edges: DataFrame, hits: DataFrame, least: int = 1, ratio: int = 4) -> DataFrame:
    """(node, src, dst, score): at each cross the way in and way out that mates join, where the score beats every competing one `ratio` times."""
    c = crosses(edges)
    into = edges.select("src", F.col("dst").alias("node")).join(c, "node")
    out = edges.select(F.col("src").alias("node"), "dst").join(c, "node")
    scored = into.join(out, "node").join(hits.select("src", "dst", "n"), ["src", "dst"], "left").select("node", "src", "dst", F.coalesce("n", F.lit(0)).alias("score"))
    row, column = Window.partitionBy("node", "src"), Window.partitionBy("node", "dst")
    miss = F.sum("score").over(row) + F.sum("score").over(column) - 2 * F.col("score")
    return scored.withColumn("miss", miss).where((F.col("score") >= least) & (F.col("score") >= ratio * F.col("miss"))).drop("miss")


def pop_bubbles(edges: DataFrame, nodes: DataFrame, most_reads: int = BUBBLE_READS, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes without weak arms of bubbles whose stronger arm differs in length, until none is left; each round drops a node at least. A bound that is hit is an error."""
    for _ in count() if rounds is None else range(rounds):
        found = bubbles(edges, nodes, most_reads)
        lengths = nodes.select("node", "len")
        found = found.join(lengths.toDF("weak", "weak_len"), "weak").join(lengths.toDF("strong", "strong_len"), "strong").where("weak_len <> strong_len")
        gone = materialize(found.select(F.col("weak").alias("node")).distinct(), "gone")
        if gone.isEmpty():
            return edges, nodes
        edges = materialize(drop_nodes(edges, gone), "edges")
        nodes = materialize(nodes.join(gone, "node", "left_anti"), "nodes")
    raise RuntimeError("bubbles are left")


def drop_islands(edges: DataFrame, nodes: DataFrame, least_reads: int = 20) -> DataFrame:
    """nodes without those of components in which no unary chain has least_reads reads."""
    chain = chains(edges, nodes).join(nodes.select("node", "n_reads"), "node")
    weight = F.sum("n_reads").over(Window.partitionBy("chain"))
    best = chain.withColumn("w", weight).join(components(edges, nodes), "node").groupBy("component").agg(F.max("w").alias("w")).where(F.col("w") >= least_reads)
    return nodes.join(components(edges, nodes).join(best, "component").select("node"), "node")


def compress(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unary chains as one node each: (edges between chains, nodes (node, seq, n_reads))."""
    from helixframe.operators.graph import path_sequences

    placed = materialize(chains(edges, nodes), "chains")
    prev = placed.select("chain", (F.col("place") + 1).alias("place"), F.col("node").alias("src"))
    inner = placed.join(prev, ["chain", "place"], "left").join(edges.select("src", F.col("dst").alias("node"), "ol"), ["src", "node"], "left")
    steps = inner.join(nodes.select("node", "seq", "n_reads"), "node").select(F.col("chain").alias("path"), "place", "seq", F.coalesce("ol", F.lit(0)).alias("ol"), "n_reads")
    merged = path_sequences(steps).join(steps.groupBy("path").agg(F.sum("n_reads").alias("n_reads")), "path").select(F.col("path").alias("node"), "seq", "n_reads")
    last = placed.groupBy("chain").agg(F.max("place").alias("place"))
    tails = placed.join(last, ["chain", "place"]).select(F.col("node").alias("src"), F.col("chain").alias("a"))
    heads = placed.where("place = 0").select(F.col("node").alias("dst"), F.col("chain").alias("b"))
    outer = edges.join(tails, "src").join(heads, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "ol")
    return outer, merged


def best_walk(edges: DataFrame, scores: DataFrame, starts: DataFrame, rounds: int | None = None) -> DataFrame:
    """(start, place, node): from each start on to the neighbour with the best score (src, dst, score), smaller node first, until an end or a node seen before. A bound of steps that is hit is an error."""
    choice = edges.select("src", "dst").join(scores.select("src", "dst", "score"), ["src", "dst"], "left").groupBy("src").agg(F.max(F.struct(F.coalesce("score", F.lit(0)).alias("s"), (-F.col("dst")).alias("d"))).alias("b")).select("src", (-F.col("b.d")).alias("dst"))
    choice = materialize(choice, "choice")
    now = materialize(starts.select(F.col("node").alias("start"), F.lit(0).alias("place"), "node"), "walk")
    for place in count() if rounds is None else range(rounds):
        ahead = now.where(F.col("place") == place).select("start", F.col("node").alias("src")).join(choice, "src").select("start", F.lit(place + 1).alias("place"), F.col("dst").alias("node"))
        ahead = materialize(ahead.join(now.select("start", "node"), ["start", "node"], "left_anti").select("start", "place", "node"), "ahead")
        if ahead.isEmpty():
            return now
        now = materialize(now.union(ahead), "walk")
    raise RuntimeError("walks did not end")


def widest_path(edges: DataFrame, starts: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, width): the largest smallest overlap along ways from the starts."""
    now = materialize(starts.select("node", F.lit(1 << 30).alias("width"), F.lit(True).alias("moved")), "width")
    for _ in range(rounds):
        ahead = now.where("moved").select(F.col("node").alias("src"), "width").join(edges.select("src", "dst", "ol"), "src").select(F.col("dst").alias("node"), F.least("width", "ol").alias("width"), F.lit(1).alias("new"))
        merged = now.select("node", "width", F.lit(0).alias("new")).union(ahead).groupBy("node").agg(F.max(F.struct("width", (-F.col("new")).alias("old"))).alias("b"))
        now = materialize(merged.select("node", "b.width", (F.col("b.old") < 0).alias("moved")), "width")
        if now.where("moved").isEmpty():
            return now.select("node", "width")
    raise RuntimeError("widths did not settle")


def path_pairs(edges: DataFrame, lengths: DataFrame, ends: DataFrame, limit: int) -> DataFrame:
    """(start, node, dist) of pairs of path ends (node) at most limit apart on the graph."""
    found = reach(edges, ends, lengths=lengths, limit=limit)
    return found.join(ends.select("node"), "node", "left_semi").where("start <> node")


def confirmed(pairs: DataFrame, size: Column, tolerance: float = 0.2, slack: int = 300) -> DataFrame:
    """Pairs whose distance is within tolerance * dist + slack of the library's size."""
    return pairs.where(F.abs(F.col("dist") - size) <= tolerance * F.col("dist") + slack)


def multiplicity(coverage: Column, cover: float) -> Column:
    """Copies that a node's coverage stands for, at least one."""
    return F.greatest(F.round(coverage / cover), F.lit(1)).cast("int")


def clumps(marks: DataFrame, key: str, value: str, width: int, least: int) -> DataFrame:
    """Marks that lie in a stretch of `width` with at least `least` others: every one from which, or up to which, such a stretch goes."""
    order = Window.partitionBy(key).orderBy(value)
    ahead, behind = F.count("*").over(order.rangeBetween(0, width)) - 1, F.count("*").over(order.rangeBetween(-width, 0)) - 1
    dense = marks.withColumn("ahead", ahead).withColumn("behind", behind)
    hold = F.max(F.when(F.col("ahead") >= least, F.col(value))).over(order.rangeBetween(-width, 0))
    return dense.withColumn("from_dense", hold).where(F.col("from_dense").isNotNull() | (F.col("behind") >= least)).drop("ahead", "behind", "from_dense")


def weak_spot(stretches: DataFrame) -> DataFrame:
    """(node, pos, depth): the first place of the smallest depth of constant stretches (node, pos, until, depth)."""
    return stretches.groupBy("node").agg(F.min(F.struct("depth", "pos")).alias("b")).select("node", "b.pos", "b.depth")


def mutual_best(overlaps: DataFrame) -> DataFrame:
    """Overlaps (q_id, read_no, over_len) that are the longest of both their reads; ties to the smaller id."""
    # both reads name their best in one pass, so the overlaps are found once; a pair that both name is mutual
    side = lambda q, own, other: F.struct(F.lit(q).alias("q"), F.col(own).alias("own"), F.struct("over_len", (-F.col(other)).alias("back")).alias("b"))
    sides = overlaps.select(F.explode(F.array(side(True, "q_id", "read_no"), side(False, "read_no", "q_id"))).alias("s")).select("s.*")
    best = sides.groupBy("q", "own").agg(F.max("b").alias("b"))
    named = best.select(F.when(F.col("q"), F.col("own")).otherwise(-F.col("b.back")).alias("q_id"), F.when(F.col("q"), -F.col("b.back")).otherwise(F.col("own")).alias("read_no"), "b.over_len")
    return named.groupBy("q_id", "read_no", "over_len").agg(F.count("*").alias("n")).where("n = 2").drop("n")


def bridges(ends: DataFrame, heads: DataFrame, hits: DataFrame, least: int = 25) -> DataFrame:
    """(src, dst, ol): for each end (node, seq) the head (node, seq) that overlaps by `least` or more with the largest hits + ol / 10."""
    from helixframe.functions.sequence import overlap_length

    keys = heads.select(F.col("node").alias("dst"), F.col("seq").alias("b"), F.substring("seq", 1, least).alias("key"))
    spots = ends.where(F.length("seq") >= least).select(F.col("node").alias("src"), F.col("seq").alias("a"), F.explode(F.sequence(F.lit(1), F.length("seq") - least + 1)).alias("i")).withColumn("key", F.substring(F.col("a"), F.col("i"), F.lit(least)))
    met = spots.join(keys, "key").where("src <> dst").select("src", "dst", "a", "b").distinct().withColumn("ol", overlap_length(F.col("a"), F.col("b"), least)).where("ol > 0")
    scored = met.join(hits.select("src", "dst", "n"), ["src", "dst"], "left").withColumn("score", F.coalesce("n", F.lit(0)) + F.col("ol") / 10)
    return scored.groupBy("src").agg(F.max(F.struct("score", (-F.col("dst")).alias("d"), "ol")).alias("b")).select("src", (-F.col("b.d")).alias("dst"), "b.ol")


def split_contig(contigs: DataFrame) -> DataFrame:
    """(header, left, origin, right) of contigs (header, seq, origin_start, origin_end): what lies before, in and after the origin."""
    return contigs.select("header", F.expr("substring(seq, 1, origin_start)").alias("left"), F.expr("substring(seq, origin_start + 1, origin_end - origin_start)").alias("origin"), F.expr("substring(seq, origin_end + 1)").alias("right"))


def fold_alleles(arms: DataFrame) -> DataFrame:
    """(pair, seq) of two parallel arms (pair, a, b) folded into one: where the alignment differs N, gaps filled from the other arm."""
    joined = arms.withColumn("x", global_alignment(F.col("a"), F.col("b")))
    base = lambda i: F.substring(F.col("x.a"), i, F.lit(1))
    other = lambda i: F.substring(F.col("x.b"), i, F.lit(1))
    letters = F.transform(F.sequence(F.lit(1), F.length("x.a")), lambda i: F.when(base(i) == other(i), base(i)).when(base(i) == "-", other(i)).when(other(i) == "-", base(i)).otherwise("N"))
    return joined.select("pair", F.when(F.length("x.a") > 0, F.array_join(letters, "")).otherwise("").alias("seq"))


def split_node(nodes: DataFrame, edges: DataFrame, placed: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, seq), edges and placements with each (node, at, new_node) of cuts made two nodes that share no base.

    Reads go to the part that holds their start; edges out go to the new
    right part.
    """
    c = cuts.select("node", "at", "new_node")
    joined = nodes.join(c, "node", "left")
    left = joined.select("node", F.when(F.col("at").isNull(), F.col("seq")).otherwise(F.expr("substring(seq, 1, at)")).alias("seq"))
    right = joined.where("at is not null").select(F.col("new_node").alias("node"), F.expr("substring(seq, at + 1)").alias("seq"))
    e = edges.join(c.select(F.col("node").alias("src"), "new_node"), "src", "left").select(F.coalesce("new_node", "src").alias("src"), "dst", "ol").union(c.select("node", "new_node", F.lit(0)))
    p = placed.join(c, "node", "left").withColumn("moved", F.coalesce(F.col("start") >= F.col("at"), F.lit(False)))
    p = p.select(F.when(F.col("moved"), F.col("new_node")).otherwise(F.col("node")).alias("node"), "read_no", F.when(F.col("moved"), F.col("start") - F.col("at")).otherwise(F.col("start")).alias("start"), F.when(F.col("moved"), F.col("end") - F.col("at")).otherwise(F.col("end")).alias("end"))
    return left.union(right), e, p
