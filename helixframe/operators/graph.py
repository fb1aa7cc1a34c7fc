"""Directed graphs as edge tables (src, dst, ol): sets, reach, distances, paths.

A leftward operator is the rightward one over reversed(edges).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.components import connected_components
from helixframe.params import MERGE_DISTANCE
from helixframe.storage import materialize


def reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out, best_in, best_out (largest overlaps)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.max("ol").alias("best_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.max("ol").alias("best_in"))
    return out.join(into, "node", "full").select("node", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"), "best_in", "best_out")


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with those of new added or put in the place of the same pair's."""
    return edges.join(new.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(new)


def drop_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def drop_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select(edges.columns)


def dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours of nodes that have no other edge into them."""
    into = edges.groupBy("dst").agg(F.count("*").alias("n"))
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(into.where("n = 1"), "dst", "left_semi").select(F.col("dst").alias("node")).distinct()


#: Edges of a block of neighbouring ids, (start, node) cells that one task looks at together, and those that it returns in one table at most.
BLOCK, CELLS, ROOM = 4096, 1 << 22, 1 << 23
#: More than any distance.
_FAR = np.iinfo(np.int64).max


def _blocks(steps: DataFrame, size: int) -> Callable[[str], Column]:
    """The block of a node: ranges of ids with about `size` edges on average, or hashes where ids lie so unevenly that a range has 64 times as many."""
    n, low, high = steps.agg(F.count("*"), F.min("src"), F.max("src")).first()
    width = max(1, (high - low + 1) * size // n) if n else 1
    if width < 1 << 62:
        by_range = lambda c: F.expr(f"cast({c} AS long) div {width}L")
        most = steps.groupBy(by_range("src").alias("block")).count().agg(F.max("count")).first()[0] or 0
        if most <= 64 * size:
            return by_range
    return lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n // size + 1))


def _within(limit: int | None):
    """(start, node, dist, inside) from the fresh rows (start, node, dist) and steps (src, dst, cost, inside) of a block: all that they reach in it, and the nodes of other blocks that they enter, which are not inside. One table for some of the starts at a time."""

    def run(fresh: pa.Table, steps: pa.Table) -> Iterator[pa.Table]:
        names = fresh["start"].combine_chunks().dictionary_encode(null_encoding="encode")
        if fresh["node"].null_count or not fresh.num_rows:  # no edge has such a node, or no start was dealt here
            yield pa.table([fresh["start"], fresh["node"], fresh["dist"], pa.array([True] * fresh.num_rows, pa.bool_())], names=["start", "node", "dist", "inside"])
            return
        src, dst, cost, near = (steps[c].to_numpy() for c in ("src", "dst", "cost", "inside"))
        node, dist = fresh["node"].to_numpy(), fresh["dist"].to_numpy()
        order = np.argsort(src, kind="stable")
        src, dst, cost, near = src[order], dst[order], cost[order], near[order].astype(bool)
        own = np.unique(np.concatenate([node, src, dst[near]]))
        first, last = np.searchsorted(src, own), np.searchsorted(src, own, "right")
        to = np.searchsorted(own, dst)
        n, start, at = len(own), names.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(own, node)
        rows = max(1, CELLS // n)
        best = np.full(min(rows, len(names.dictionary)) * n, _FAR)

        def table(start: np.ndarray, node: np.ndarray, dist: np.ndarray, inside: bool) -> pa.Table:
            return pa.table([names.dictionary.take(pa.array(start)), pa.array(node), pa.array(dist), pa.array(np.full(len(start), inside))], names=["start", "node", "dist", "inside"])

        for low in range(0, len(names.dictionary), rows):
            here = (start >= low) & (start < low + rows)
            cells = (start[here] - low) * n + at[here]
            np.minimum.at(best, cells, dist[here])
            cells = np.unique(cells)
            seen = [cells]
            left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while len(cells):
                after = []
                # a slice has about CELLS ways on, or one cell
                ways = np.cumsum(last[cells % n] - first[cells % n])
                for part in np.split(cells, np.flatnonzero(np.diff(ways // CELLS)) + 1):
                    place = part % n
                    count = last[place] - first[place]
                    step = np.repeat(first[place] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    row, far = np.repeat(part - place, count), np.repeat(best[part], count) + cost[step]
                    if limit is not None:
                        kept = far <= limit
                        step, row, far = step[kept], row[kept], far[kept]
                    out = ~near[step]
                    if out.any():
                        left.append((row[out] // n + low, dst[step[out]], far[out]))
                    cell, far = (row + to[step])[~out], far[~out]
                    better = far < best[cell]
                    np.minimum.at(best, cell[better], far[better])
                    after.append(np.unique(cell[better]))
                cells = np.unique(np.concatenate(after))
                seen.append(cells)
            cells = np.unique(np.concatenate(seen))
            yield table(cells // n + low, own[cells % n], best[cells], True)
            best[cells] = _FAR
            if left:  # of several ways to a node the shortest
                row, place, far = (np.concatenate([x[i] for x in left]) for i in range(3))
                order = np.lexsort((far, place, row))
                row, place, far = row[order], place[order], far[order]
                once = np.ones(len(row), bool)
                once[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
                yield table(row[once], place[once], far[once], False)

    return run


def _whole(limit: int | None):
    """_within as one table."""
    return lambda fresh, steps: pa.concat_tables(_within(limit)(fresh, steps))


def _alone(limit: int):
    """_within over a block's starts (start, node, dist) and ways (node, to, dist), told apart by `to`; the tables are handed on one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        asked = pc.is_null(rows["to"])
        ways = rows.filter(pc.invert(asked)).select(["node", "to", "dist"]).rename_columns(["src", "dst", "cost"])
        for found in _within(limit)(rows.filter(asked), ways.append_column("inside", pa.array(np.ones(ways.num_rows, bool)))):
            yield from found.select(["start", "node", "dist"]).to_batches()

    return run


def reach(edges: DataFrame, starts: DataFrame, only: DataFrame | None = None, never: DataFrame | None = None, lengths: DataFrame | None = None, limit: int | None = None, rounds: int = 1000, dists: bool = True) -> DataFrame:
    """(start, node, dist) of all nodes reached from each start, itself included at 0.

    Starts are nodes, or nodes with a `start` that names a set of them.

    only and never restrict the nodes that may be entered. With lengths (node,
    len) a step costs len - ol, dist is the smallest sum and paths longer than
    limit end; without them dist counts steps. Without dists all are 0, and a
    node is not entered again by a shorter way. Nodes of neighbouring ids form
    a block, and a round follows all ways inside the blocks of the frontier to
    their ends, so rounds grow with the borders that a path crosses, not with
    its steps. Nodes that are entered over a border are the next frontier, if
    no shorter way to them is known; all else is written once. The starts of a
    block are dealt over tasks by what they may reach.

    With a limit and single nodes as starts, rounds only find what lies around
    the starts of each block, which they share; then all ways of a block's
    starts are followed in it in one task, a slice of starts at a time.
    """
    if not dists and (lengths is not None or limit is not None):
        raise ValueError("a limit needs dists")
    steps = edges.select("src", "dst", *(["ol"] if lengths is not None else []))
    if only is not None:
        steps = steps.join(only.select(F.col("node").alias("dst")), "dst", "left_semi")
    if never is not None:
        steps = steps.join(never.select(F.col("node").alias("dst")), "dst", "left_anti")
    if lengths is not None:
        steps = steps.join(lengths.select(F.col("node").alias("dst"), "len"), "dst").withColumn("cost", F.greatest(F.col("len") - F.col("ol"), F.lit(1)))
    else:
        steps = steps.withColumn("cost", F.lit(1 if dists else 0))
    long = lambda c: F.col(c).cast("long").alias(c)
    steps = materialize(steps.groupBy(long("src"), long("dst")).agg(F.min("cost").cast("long").alias("cost")), "steps")
    around = limit is not None and "start" not in starts.columns
    block = _blocks(steps, 4 * BLOCK if around else BLOCK)
    steps = steps.select("src", "dst", "cost", block("src").alias("block"), (block("src") == block("dst")).alias("inside"))
    fresh = materialize(starts.select(F.col("start" if "start" in starts.columns else "node").alias("start"), long("node"), F.lit(0).cast("long").alias("dist")).distinct(), "reach")
    if not around:
        return _rounds(steps, block, fresh, limit, rounds)
    near = materialize(_rounds(steps, block, fresh.select(block("node").alias("start"), "node", "dist"), limit, rounds), "around")
    ways = near.where(F.col("dist") < limit).join(steps.select("src", "dst", "cost"), F.col("node") == F.col("src")).where(F.col("dist") + F.col("cost") <= limit)
    ways = ways.select(F.col("start").alias("block"), F.lit(None).cast(fresh.schema["start"].dataType).alias("start"), "node", F.col("dst").alias("to"), F.col("cost").alias("dist"))
    asked = fresh.select(block("node").alias("block"), "start", "node", F.lit(None).cast("long").alias("to"), "dist")
    schema = f"start {fresh.schema['start'].dataType.simpleString()}, node long, dist long"
    return asked.union(ways).groupBy("block").applyInArrow(_alone(limit), schema)


def _dealt(asked: DataFrame, ways: DataFrame, sizes: DataFrame, limit: int | None) -> DataFrame:
    """_whole over asked (start, node, dist, block) and ways (src, dst, cost, block, inside). The starts of a block are dealt over tasks of about ROOM / n each, n the nodes that may be found there (sizes: block, n)."""
    many = asked.groupBy("block").agg(F.approx_count_distinct("start").alias("starts")).join(sizes, "block")
    parts = many.select("block", F.ceil(F.col("starts") * F.col("n") / ROOM).cast("int").alias("parts")).where("parts > 1")
    asked = asked.join(parts, "block", "left").withColumn("part", F.pmod(F.xxhash64("start"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    ways = ways.join(parts, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    schema = f"start {asked.schema['start'].dataType.simpleString()}, node long, dist long, inside boolean"
    return asked.groupBy("block", "part").cogroup(ways.groupBy("block", "part")).applyInArrow(_whole(limit), schema)


def _rounds(steps: DataFrame, block: Callable[[str], Column], fresh: DataFrame, limit: int | None, rounds: int) -> DataFrame:
    """(start, node, dist) of what is reached from fresh (start, node, dist) by steps (src, dst, cost, block, inside)."""
    sizes = steps.groupBy("block").agg(F.count("*").alias("n"))
    known = None
    for i in range(rounds):
        asked = fresh.withColumn("block", block("node"))
        ways = steps.join(asked.select("block").distinct(), "block", "left_semi")
        moved = materialize(_dealt(asked, ways, sizes, limit), "reach")
        inside = moved.where("inside").select("start", "node", "dist")
        known = inside if known is None else known.union(inside)
        if i % 32 == 31:  # a plan of few tables
            known = materialize(known.groupBy("start", "node").agg(F.min("dist").alias("dist")), "reach")
        over = moved.where("not inside").groupBy("start", "node").agg(F.min("dist").alias("dist"))
        met = over.select(F.col("start").alias("s"), F.col("node").alias("n"))
        before = known.join(met, F.col("start").eqNullSafe(F.col("s")) & (F.col("node") == F.col("n")), "left_semi")
        best = before.withColumn("new", F.lit(0)).union(over.withColumn("new", F.lit(1))).groupBy("start", "node").agg(F.min(F.struct("dist", "new")).alias("best"))
        fresh = materialize(best.where("best.new = 1").select("start", "node", "best.dist"), "reach")
        if fresh.isEmpty():
            return known.groupBy("start", "node").agg(F.min("dist").alias("dist"))
    raise RuntimeError("reach did not settle")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges reach in either direction."""
    roots = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def exclusive(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, node): what a reaches and b doesn't, and the reverse."""
    ra, rb = (reach(edges, x.select(F.lit(0).alias("start"), "node"), dists=False).select("node") for x in (a, b))
    return ra.exceptAll(rb).select(F.lit("a").alias("side"), "node").union(rb.exceptAll(ra).select(F.lit("b").alias("side"), "node"))


def between(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes on paths from a to b."""
    return reach(edges, a, dists=False).select("node").intersect(reach(reversed(edges), b, dists=False).select("node"))


def looped(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle."""
    first = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("origin"), F.col("dst").alias("node"))
    back = reach(edges, first.select("node").distinct(), dists=False)
    return first.join(back.select(F.col("start").alias("node"), F.col("node").alias("origin")), ["node", "origin"]).select(F.col("origin").alias("node")).distinct()


def open_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def merge_distances(marks: DataFrame, key: str, value: str, gap: int = MERGE_DISTANCE) -> DataFrame:
    """(key, low, high, n): values less than gap apart from the one before form an interval."""
    order = Window.partitionBy(key).orderBy(value)
    fresh = F.when(F.col(value) - F.lag(value).over(order) < gap, 0).otherwise(1)
    island = marks.select(key, value).withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).drop("island")


def interval_diff(intervals: DataFrame, estimates: DataFrame, key: str, value: str, right: bool = True) -> DataFrame:
    """(key, value, diff) of estimates (key, value): 0 inside an interval (key, low, high), else the signed way to the nearest border, the lower one of two.

    Rightward the way is the border less the estimate, leftward the reverse.
    Keys without an interval are left out, and a null estimate of the others
    has a null way.
    """
    marks = intervals.select(key, F.col("low").alias("at"), "low", "high", F.lit(None).cast("long").alias("est"), F.lit(False).alias("asked"))
    asked = estimates.select(key, F.col(value).alias("at"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.col(value).cast("long").alias("est"), F.lit(True).alias("asked")).distinct()
    order = Window.partitionBy(key).orderBy("at", "asked")
    behind = F.last("high", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("low", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    some = F.max(~F.col("asked")).over(Window.partitionBy(key))
    found = marks.union(asked).select(key, "est", "asked", some.alias("some"), (behind - F.col("est")).alias("b"), (ahead - F.col("est")).alias("a")).where("asked and some and (est is null or a is not null or b is not null)")
    way = F.when(F.col("b") >= 0, 0).when(F.col("a").isNull() | (-F.col("b") <= F.col("a")), F.col("b")).otherwise(F.col("a"))
    return found.select(key, F.col("est").alias(value), (way if right else -way).cast("long").alias("diff"))


def furthest(marks: DataFrame, key: str, value: str, top: int = 3) -> DataFrame:
    """(key, limits): the `top` largest values, largest first; each task keeps `top` of a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value)))
    kept = marks.select(key, value).withColumn("p", place).where(F.col("p") <= top)
    return kept.groupBy(key).agg(F.sort_array(F.collect_list(value), asc=False).alias("limits"))


def chains(edges: DataFrame, nodes: DataFrame, rings: bool = True) -> DataFrame:
    """(node, chain, place): unary chains, named by their first node; place counts from 0.

    An edge is inside a chain when it is its source's only way out and its
    target's only way in, and its ends overlap (ol > 0). Places come from pointer doubling over those links,
    so long chains take a logarithmic number of rounds. Nodes of cycles
    without an entry are a chain each that begins at their smallest node, or
    are left out without `rings`.
    """
    deg = degrees(edges)
    inner = edges.join(deg.where("n_out = 1").select(F.col("node").alias("src")), "src", "left_semi").join(deg.where("n_in = 1").select(F.col("node").alias("dst")), "dst", "left_semi").where("src <> dst and ol > 0").select("src", "dst")
    inner = materialize(inner, "links")
    groups = connected_components(inner.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    named = nodes.select("node").join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    heads = named.join(inner.select(F.col("dst").alias("node")), "node", "left_anti").select("root").distinct()
    if rings:
        cut = named.join(heads, "root", "left_anti").select("root").distinct()
        inner = inner.join(cut.select(F.col("root").alias("dst")), "dst", "left_anti")  # a ring is cut before its smallest node
    else:
        named = named.join(heads, "root", "left_semi")
        inner = inner.join(named.select(F.col("node").alias("dst")), "dst", "left_semi")
    jump = materialize(named.join(inner.select(F.col("dst").alias("node"), F.col("src").alias("back")), "node", "left").select("node", F.coalesce("back", "node").alias("to"), F.col("back").isNotNull().cast("long").alias("hops")), "jump")
    while True:
        ahead = jump.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        after = materialize(jump.join(ahead, "to").select("node", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops")), "jump")
        if after.agg(F.sum("hops")).first()[0] == jump.agg(F.sum("hops")).first()[0]:
            return after.select("node", F.col("to").alias("chain"), F.col("hops").alias("place"))
        jump = after


def blunt_tips(edges: DataFrame, nodes: DataFrame, most_reads: int) -> DataFrame:
    """Dead-end nodes with at most most_reads reads whose only neighbour has another way on with more reads."""
    deg = degrees(edges)
    tips = nodes.where(F.col("n_reads") <= most_reads).join(deg.where("n_out = 0 and n_in = 1"), "node").select("node", "n_reads")
    fork = edges.select(F.col("dst").alias("node"), "src").join(tips, "node")
    other = edges.select("src", F.col("dst").alias("other")).join(nodes.select(F.col("node").alias("other"), F.col("n_reads").alias("other_reads")), "other")
    return fork.join(other, "src").where("other <> node and other_reads > n_reads").select("node").distinct()


def bubbles(edges: DataFrame, nodes: DataFrame, most_reads: int) -> DataFrame:
    """(a, z, weak, strong): two ways of one node between a and z, the weak one with at most most_reads reads and fewer than the strong."""
    way = edges.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(edges.select(F.col("src").alias("m"), F.col("dst").alias("z")), "m").where("a <> z").join(nodes.select(F.col("node").alias("m"), "n_reads"), "m")
    x, y = way.toDF("weak", "a", "z", "nx"), way.toDF("strong", "a", "z", "ny")
    return x.where(F.col("nx") <= most_reads).join(y, ["a", "z"]).where("weak <> strong and nx < ny").select("a", "z", "weak", "strong")


def reduce_edges(edges: DataFrame, score: str, least: int) -> DataFrame:
    """Edges without those of score 0 beside a sibling of `least` or more."""
    best = F.max(score).over(Window.partitionBy("src"))
    return edges.withColumn("best", best).where((F.col(score) > 0) | (F.col("best") < least)).drop("best")


def transitive_edges(edges: DataFrame) -> DataFrame:
    """Edges that a way of two steps replaces."""
    two = edges.select("src", F.col("dst").alias("m")).join(edges.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst").distinct()
    return edges.join(two, ["src", "dst"], "left_semi")


def path_sequences(steps: DataFrame) -> DataFrame:
    """(path, seq): ordered steps (path, place, seq, ol) joined, each without the `ol` bases it shares with the one before.

    A negative ol is a gap of as many N; where shared bases differ between
    the two, both copies of that overlap become N.
    """
    ordered = F.sort_array(F.collect_list(F.struct("place", "seq", "ol")))

    def join(a, x):
        n = F.greatest(x["ol"], F.lit(0))
        tail = F.substring(a, F.length(a) - n + 1, n)
        head = F.substring(x["seq"], F.lit(1), n)
        rest = F.substring(x["seq"], n + 1, F.length(x["seq"]))
        gap = F.concat(a, F.repeat(F.lit("N"), (-x["ol"]).cast("int")), x["seq"])
        kept = F.substring(a, F.lit(1), F.length(a) - n)
        agreed = F.when(tail == head, a).otherwise(F.concat(kept, F.repeat(F.lit("N"), n.cast("int"))))
        return F.when(F.length(a) == 0, x["seq"]).when(x["ol"] < 0, gap).otherwise(F.concat(agreed, rest))

    return steps.groupBy("path").agg(ordered.alias("s")).select("path", F.aggregate("s", F.lit(""), join).alias("seq"))


def invariants(edges: DataFrame, nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """(rule, broken): counts of rows that break the rules of a graph; all 0 in a sound one."""
    left, right = nodes.select(F.col("node").alias("src"), F.col("seq").alias("a")), nodes.select(F.col("node").alias("dst"), F.col("seq").alias("b"))
    texts = edges.where("ol > 0").join(left, "src").join(right, "dst")
    bad_text = texts.where(F.substring(F.col("a"), F.length("a") - F.col("ol") + 1, F.col("ol")) != F.substring(F.col("b"), F.lit(1), F.col("ol")))
    twice = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")
    outside = placed.join(nodes.select("node", F.length("seq").alias("len")), "node").where("start < 0 or end > len or end <= start")
    count = lambda df, name: df.agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken")
    return count(bad_text, "overlap_text").union(count(twice, "edge_twice")).union(count(outside, "read_outside"))
