"""N-gram Jaccard join with count vectors and an R-tree.

Every text becomes the set of its distinct k-word shingles. Texts with equal
sets are one node. Shingles are hashed into GROUPS groups; the counts of a
set in these groups are a point, and the sum over groups of the smaller
coordinate of two points bounds how many shingles two sets share. A link
needs (num + den) * shared >= num * (n_a + n_b) for a similarity of num/den.

Points of hashed counts of one size lie close together, so an R-tree over
all of them prunes little and cannot be dealt over machines. The upper level
of the search is therefore an exact routing: two linked sets share one of the
first n - ceil(num/den * n) + 1 shingles of each in any common order, and the
order here puts the shingles that are very frequent in the corpus last (a
count sketch of fixed size tells them). Sets that share such a shingle meet
in a cell. Within a cell:

1. the cells of one smallest node, the pivot, are put together; an R-tree
   over the points of their members is asked for what may link with the
   pivot, finer vectors and then the sets verify: connected components come
   from that;
2. the cells of a pivot whose members ended in several components are
   searched again, in parts of sizes that may link, by R-trees over blocks of
   their points, for pairs of two components.

For components a pair in one component needs no second look, so connectivity
is whole though not every link is looked at, and a group of g copies costs g
pairs in place of g * g. ngram_jaccard_links looks at every pair: the cells of
one smallest node are searched by the same trees for all pairs of their
members, also those of one component, and all that the bound lets through are
verified. Its pairs are as many as there are links of different sets at least;
exact copies are one node and count by their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.membership import bitmap_of, may_hold, slot_of
from helixframe.llm.names import Named
from helixframe.llm.text import chunks, shingle_sets
from helixframe.operators.components import connected_components
from helixframe.storage import materialize

GROUPS = 64
#: Most groups of the vectors that trees search.
MIDDLE = 256
#: Most groups of a fine vector, whose number follows the set's size. Vectors fold, so any two can be compared.
FINE = 4096
#: Counters of the frequency sketch and slices in which it is summed: 2 MB at most on the driver.
SKETCH, SLICES = 1 << 18, 16
#: Signatures that a task gathers before it sends them on, and that one cell partition should get.
BLOCK, PART = 400_000, 1_000_000
#: Points of a cell that are searched together.
CELL_BLOCK = 512
#: Rows of such cells that one task should get together.
CELL_ROWS = 25_000
LEAF = 16


def node_of(members: np.ndarray) -> int:
    """The id of a set of shingle hashes (sorted, distinct)."""
    return xxhash.xxh64_intdigest(members.tobytes()) - (1 << 63)


def _packed(counts: np.ndarray) -> bytes:
    """The groups as a power of two, the width of a number in half bytes, then the numbers."""
    most = counts.max()
    head = len(counts).bit_length() - 1
    if most < 1 << 4:
        return bytes([head, 1]) + (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([head, 2 * width]) + counts.astype(f"<u{width}").tobytes()


def count_vectors(members: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The counts of a set in GROUPS groups, in groups of two to four members (MIDDLE at most) and of one or two (FINE at most)."""
    bits = len(members).bit_length()
    groups, middle = min(max(GROUPS, 1 << bits >> 1), FINE), min(max(GROUPS, 1 << bits >> 2), MIDDLE)
    fine = np.bincount((members >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups)
    return _packed(fine.reshape(-1, GROUPS).sum(axis=0)), _packed(fine.reshape(-1, middle).sum(axis=0)), _packed(fine)


def point(raw: bytes) -> np.ndarray:
    if raw[1] > 1:
        return np.frombuffer(raw, f"<u{raw[1] >> 1}", offset=2).astype(np.int32)
    both = np.frombuffer(raw, np.uint8, offset=2)
    counts = np.empty(2 * len(both), np.int32)
    counts[::2], counts[1::2] = both & 15, both >> 4
    return counts


def shared_at_most(a: bytes, b: bytes) -> int:
    """The summed coordinate minima of two vectors, folded to the smaller number of groups."""
    x, y = point(a), point(b)
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, n).sum(axis=0), y.reshape(-1, n).sum(axis=0)).sum())


def prefix_length(n: int, num: int, den: int) -> int:
    return n - (n * num + den - 1) // den + 1


_DESCRIBED = ["doc_id", "of", "n", "node", "point", "middle", "fine", "slice", "counts"]


def _describe(k: int):
    """Per document its node, size and point; per task slices of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        for batch in chunks(batches):
            nodes, sizes, vectors = [], [], []
            every = []
            for members in shingle_sets(batch["text"], k):
                sizes.append(len(members))
                nodes.append(node_of(members) if len(members) else None)
                vectors.append(count_vectors(members) if len(members) else (None, None, None))
                every.append(members)
            sketch += np.bincount((np.concatenate(every) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["of"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), *(pa.array([v[i] for v in vectors], pa.binary()) for i in range(3)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=_DESCRIBED,
            )
        parts = [np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in np.split(sketch, SLICES)]
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(SLICES, pa.int64())] * 4, *[pa.nulls(SLICES, pa.binary())] * 3, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())],
            names=_DESCRIBED,
        )

    return run


def _sum_slices(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in pdf["counts"])
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})


def _frequency_class(described: DataFrame) -> bytes:
    """For each counter 0 where shingles are as frequent as most, else the power of two above that."""
    rows = described.where("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(_sum_slices, "slice int, counts binary").collect()
    if not rows:
        return bytes(SKETCH)
    total = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in sorted(rows, key=lambda r: r["slice"])])
    usual = max(4.0, 2 * float(np.median(total)))
    return np.floor(np.log2(np.maximum(total / usual, 0.5))).clip(-1, 60).astype(np.int8).__add__(1).astype(np.uint8).tobytes()


def _signatures(k: int, num: int, den: int, classes, parts: int):
    """Per task and cell partition the routing shingles of its distinct sets; the smallest node of each shingle leads, the others follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(classes.value, np.uint8)
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            more = np.ones(len(key), bool)
            more[first] = False
            follows = np.diff(np.append(first, len(key))) > 1
            part = ((key[first] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            lead = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[lead], np.arange(parts + 1))
            extra = np.array_split(np.flatnonzero(more), parts)  # settled later by a join, so any partition will do
            rows = []
            for p in range(parts):
                own = lead[cut[p] : cut[p + 1]]
                if len(own) or len(extra[p]):
                    rows.append((p, key[first[own]].tobytes(), node[first[own]].tobytes(), follows[own].tobytes(), key[extra[p]].tobytes(), node[extra[p]].tobytes()))
            keys.clear()
            nodes.clear()
            seen.clear()
            held = 0
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "keys", "nodes", "follows", "more_keys", "more_nodes"])

        for batch in chunks(batches):
            for members in shingle_sets(batch["text"], k):
                if not len(members) or (node := node_of(members)) in seen:
                    continue
                seen.add(node)
                need = prefix_length(len(members), num, den)
                at = rank[(members & np.uint64(SKETCH - 1)).astype(np.int64)]
                if at.any():
                    members = members[np.argsort(at, kind="stable")]
                keys.append(members[:need])
                nodes.append(np.full(need, node, np.int64))
                held += need
            if held >= BLOCK:
                yield flush()
        if held:
            yield flush()

    return run


def _cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """(cell, node, pivot): the tasks' leading nodes with their cell's smallest; (cell, pivot, pivot) where nodes follow; the followers, not leading, with themselves."""
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
    node = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["nodes"]])
    follows = np.concatenate([np.frombuffer(x, bool) for x in pdf["follows"]])
    order = np.lexsort((node, key))
    key, node, follows = key[order], node[order], follows[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    pivot = np.repeat(node[first], np.diff(np.append(first, len(key))))
    followed = first[np.logical_or.reduceat(follows, first)] if len(first) else first
    rows = np.concatenate([np.flatnonzero(node != pivot), followed])
    more_key = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["more_keys"]])
    more_node = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["more_nodes"]])
    return pd.DataFrame(
        {
            "cell": np.concatenate([key[rows], more_key]).view(np.int64),
            "node": np.concatenate([node[rows], more_node]),
            "pivot": np.concatenate([pivot[rows], more_node]),
            "lead": np.concatenate([np.ones(len(rows), bool), np.zeros(len(more_key), bool)]),
        }
    )


def _bounded(num: int, den: int):
    """Pairs whose summed coordinate minima allow a link."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                most = np.fromiter((shared_at_most(a, b) for a, b in zip(pdf["x"], pdf["y"], strict=True)), np.int64, len(pdf))
                keep = (num + den) * most >= num * (pdf["n_a"] + pdf["n_b"])
                yield pdf.loc[keep, ["a", "b"]]

    return run


class RTree:
    """Points packed by their size and leading coordinates into leaves of LEAF; inner nodes hold coordinate maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        starts = np.arange(0, len(sizes), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, starts, axis=0), np.minimum.reduceat(self.sizes, starts))]
        while len(self.levels[-1][1]) > LEAF:
            top, low = self.levels[-1]
            starts = np.arange(0, len(low), LEAF)
            self.levels.append((np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(low, starts)))

    def search(self, spot: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Indexes of the points that can share enough with spot."""
        at = np.arange(len(self.levels[-1][1]))
        for depth, (top, low) in enumerate(reversed(self.levels)):
            hit = (num + den) * np.minimum(top[at], spot).sum(axis=1) >= num * (low[at] + size)
            width = len(self.sizes) if depth == len(self.levels) - 1 else len(self.levels[-2 - depth][1])
            at = (at[hit][:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < width]
        hit = (num + den) * np.minimum(self.points[at], spot).sum(axis=1) >= num * (self.sizes[at] + size)
        return self.order[at[hit]]


def _cross_pairs(nodes: np.ndarray, roots: np.ndarray, points: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs of a left and a right point of two components that the bound lets through."""
    tree = RTree(points[right], sizes[right])
    found = [tree.search(points[i], int(sizes[i]), num, den) for i in left]
    a, b = np.repeat(left, [len(f) for f in found]), right[np.concatenate(found)]
    apart = roots[a] != roots[b]
    return a[apart], b[apart]


def _pivot_pairs(num: int, den: int):
    """(pivot, node) of the members that a tree over each block of a pivot's cells finds near the pivot, whose own point comes with every block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pivot", "i", "node"], kind="stable")
        where = pdf[["pivot", "i"]].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(axis=1)]))
        points, (pivots, nodes, sizes) = np.stack([point(x) for x in pdf["point"]]), (pdf[c].to_numpy() for c in ("pivot", "node", "n"))
        size = np.diff(np.append(first, len(pdf)))
        lead = np.repeat(np.flatnonzero(nodes == pivots), size)  # each block has its pivot once
        # a tree of one leaf has only the leaf's own test, which is made for all such trees at once
        rest = np.flatnonzero((nodes != pivots) & (np.repeat(size, size) <= LEAF + 1))
        hit = (num + den) * np.minimum(points[rest], points[lead[rest]]).sum(axis=1) >= num * (sizes[rest] + sizes[lead[rest]])
        a, b = [pivots[rest[hit]]], [nodes[rest[hit]]]
        for begin, n in zip(first[size > LEAF + 1], size[size > LEAF + 1], strict=True):
            rest = begin + np.flatnonzero(nodes[begin : begin + n] != pivots[begin])
            found = rest[RTree(points[rest], sizes[rest]).search(points[lead[begin]], int(sizes[lead[begin]]), num, den)]
            a.append(pivots[found])
            b.append(nodes[found])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _tree_pairs(num: int, den: int):
    """Of all cells and block pairs that were dealt to one group the pairs that coarse and then finer vectors let through.

    A small cell comes as one block (side 2), a large one as pairs of blocks
    (side 0 with ends outside the largest component, side 1 with all).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pivot", "i", "j"], kind="stable")
        where = pdf[["pivot", "i", "j"]].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(axis=1)]))
        finer = [point(x) for x in pdf["middle"]]
        points = np.stack([x.reshape(-1, GROUPS).sum(axis=0) for x in finer])
        nodes, roots, sizes, side, minor = (pdf[c].to_numpy() for c in ("node", "root", "n", "side", "minor"))
        out: set[tuple[int, int]] = set()
        for begin, end in zip(first, np.append(first[1:], len(pdf)), strict=True):
            own = slice(begin, end)
            left, right = np.flatnonzero((side[own] != 1) & minor[own]), np.flatnonzero(side[own] != 0)
            if not len(left) or not len(right):
                continue
            x_y = np.sort(np.stack(_cross_pairs(nodes[own], roots[own], points[own], sizes[own], left, right, num, den), axis=1), axis=1)
            for x, y in np.unique(x_y, axis=0):
                x, y = begin + x, begin + y
                pair = (int(min(nodes[x], nodes[y])), int(max(nodes[x], nodes[y])))
                if pair not in out:
                    a, b = finer[x], finer[y]
                    n = min(len(a), len(b))
                    most = np.minimum(a.reshape(-1, n).sum(axis=0), b.reshape(-1, n).sum(axis=0)).sum()
                    if (num + den) * most >= num * (sizes[x] + sizes[y]):
                        out.add(pair)
        found = sorted(out)
        return pd.DataFrame({"a": pd.Series([p[0] for p in found], dtype="int64"), "b": pd.Series([p[1] for p in found], dtype="int64")})

    return run


def _sets(k: int, bitmap):
    """(node, members) of the documents that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(bitmap.value, batch["slot"].to_numpy())))
            for part in chunks([batch]):
                found = {node_of(m): m.tobytes() for m in shingle_sets(part["text"], k) if len(m)}
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["node", "members"])

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["members_a"], batch["members_b"], strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Links:
    """Candidate pairs of nodes to verified links."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int):
        self.docs, self.nodes, self.k, self.num, self.den = docs, nodes, k, num, den

    def _within(self, pairs: DataFrame, column: str) -> DataFrame:
        """Pairs that the vectors of a column let through."""
        spots = self.nodes.select("node", "n", F.col(column).alias("v"))
        return (
            pairs.join(spots.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("v").alias("x")), "a")
            .join(spots.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("v").alias("y")), "b")
            .mapInPandas(_bounded(self.num, self.den), "a long, b long")
        )

    def verify(self, pairs: DataFrame, *vectors: str) -> DataFrame:
        """Pairs that the named vectors and then the sets confirm. Of texts only those of the pairs' nodes are read again."""
        near = pairs
        for column in vectors:
            near = materialize(self._within(near, column), "near")
        wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct().join(self.nodes.select("node", "doc_id"), "node")
        wanted = materialize(wanted, "wanted")
        bits, bitmap = bitmap_of(wanted, "doc_id")
        found = self.docs.where("doc_id is not null").select(slot_of(F.col("doc_id"), bits).alias("slot"), "text").mapInArrow(_sets(self.k, bitmap), "node long, members binary")
        sets = materialize(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
        return (
            near.join(sets.select(F.col("node").alias("a"), F.col("members").alias("members_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("members").alias("members_b")), "b")
            .select("a", "b", "members_a", "members_b")
            .mapInArrow(_verified(self.num, self.den), "a long, b long")
        )


def _rooted(nodes: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    return nodes.join(roots.withColumnRenamed("node", column), column, "left").withColumn("root", F.coalesce("root", column))


def _routed(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs cast, each row with its size and node, the nodes, and (node, pivot) of the nodes in cells that another node leads."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = materialize(docs.withColumn("of", F.xxhash64("text")).mapInArrow(_describe(k), "doc_id long, of long, n long, node long, point binary, middle binary, fine binary, slice int, counts binary"), "described")
    each = described.where("slice is null").select("doc_id", "of", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"), "point", "middle", "fine")
    nodes = materialize(each.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), *(F.min(c).alias(c) for c in ("point", "middle", "fine"))), "nodes")

    classes = spark.sparkContext.broadcast(_frequency_class(described))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, round(total * (den - num) / den / PART))
    sent = docs.where("doc_id is not null").mapInArrow(_signatures(k, num, den, classes, parts), "part int, keys binary, nodes binary, follows binary, more_keys binary, more_nodes binary")
    cells = materialize(sent.groupBy("part").applyInPandas(_cells, "cell long, node long, pivot long, lead boolean"), "cells")
    more = cells.where("not lead").select("cell", "node").join(cells.where("lead and node = pivot").select("cell", "pivot"), "cell").select("node", "pivot")
    star = materialize(cells.where("lead and node <> pivot").select("node", "pivot").union(more).distinct(), "star")
    return docs, each, nodes, star


def _sized(rows: DataFrame, sizes: DataFrame, shift: int = 16) -> DataFrame:
    """rows (pivot, …) joined with sizes (pivot, every, …).

    Pivots with more than a 2**shift-th of all rows (so fewer than twice 2**shift of them)
    are broadcast, so that no pivot's rows meet in one task; the others are
    small by that.
    """
    least = max(CELL_BLOCK, rows.count() >> shift)
    hot = F.broadcast(sizes.where(F.col("every") > least))
    rest = rows.join(hot.select("pivot"), "pivot", "left_anti").join(sizes.where(F.col("every") <= least), "pivot")
    return rows.join(hot, "pivot").unionByName(rest)


def _band(num: int, den: int):
    """Sizes of two linked sets differ by a factor of den/num at most, so in bands of that width (a little more, for rounding) they lie in one or in two neighbours."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(max(math.log(den / num), 1e-3) * (1 + 1e-6)))


def _open_parts(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(pivot, every, parts) of rows (pivot, node, root, n): what is left to be searched of a pivot's cells, by size.

    Part c has the bands c and c + 1. It is open where members ended in
    several components and some are of band c; one without these has nothing
    that part c + 1 hasn't. A pivot has as many parts as sizes have bands.
    """
    dealt = rows.withColumn("band", _band(num, den)).withColumn("c", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    counts = dealt.groupBy("pivot", "c", "root").agg(F.count("*").alias("k"), F.max(F.col("c") == F.col("band")).alias("lower"))
    parts = counts.groupBy("pivot", "c").agg(F.sum("k").alias("every"), F.max("lower").alias("lower"), F.max(F.struct("k", "root")).alias("most")).where("lower and every > most.k")
    # a pair of two components has an end outside the largest one
    ni, nj = (F.ceil(x / CELL_BLOCK).cast("int") for x in (F.col("every") - F.col("most.k"), F.col("every")))
    part = F.struct("c", F.col("most.root").alias("main"), ni.alias("ni"), nj.alias("nj"))
    return parts.groupBy("pivot").agg(F.sum("every").alias("every"), F.collect_list(part).alias("parts"))


def _near_pivots(star: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pivots and the members of their cells that the trees find near them. A large cell is searched in blocks, in as many tasks.

    Members whose size alone rules a link with the pivot out get no point.
    """
    ni = F.ceil(F.col("every") / CELL_BLOCK).cast("int")
    sizes = star.groupBy("pivot").agg(F.count("*").alias("every")).withColumn("ni", ni)
    sizes = materialize(sizes.join(nodes.select(F.col("node").alias("pivot"), F.col("n").alias("n_p")), "pivot"), "pivots")
    members = _sized(star, sizes).select("pivot", "node", "n_p", F.pmod(F.xxhash64("node"), F.col("ni")).cast("int").alias("i"))
    leads = sizes.select("pivot", F.col("pivot").alias("node"), "n_p", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"))
    groups = -(-(sizes.agg(F.sum(F.col("every") + F.col("ni"))).first()[0] or 0) // CELL_ROWS)
    dealt = members.union(leads).join(nodes.select("node", "n", "point"), "node").where(F.lit(num + den) * F.least("n", "n_p") >= F.lit(num) * (F.col("n") + F.col("n_p"))).drop("n_p")
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("pivot", "i"), F.lit(max(1, groups))))
    return dealt.groupBy("g").applyInPandas(_pivot_pairs(num, den), "a long, b long")


def _searched(blocks: DataFrame, num: int, den: int, both: bool) -> DataFrame | None:
    """Distinct pairs that the trees find in blocks (pivot, ni, nj, minor, node, root, n, middle); None without rows.

    A large cell is dealt as pairs of its blocks. Where both sides are all
    members (ni = nj), a pair of blocks is searched once, i <= j.
    """
    dealt = F.when(F.col("nj") > 1, F.col("ni") + F.when(F.col("minor"), F.col("nj")).otherwise(0)).otherwise(1)
    groups = -(-(blocks.agg(F.sum(dealt)).first()[0] or 0) // CELL_ROWS)
    if not groups:
        return None
    own, zero = F.xxhash64("node"), F.lit(0).cast("long")
    large, i, j = blocks.where("nj > 1"), F.pmod(own, F.col("ni")), F.pmod(own, F.col("nj"))
    others = (F.sequence(i if both else zero, F.col("nj").cast("long") - 1), F.sequence(zero, (j if both else F.col("ni").cast("long") - 1)))
    spread = [
        part.withColumn("side", F.lit(side)).withColumn("other", F.explode(other)).select("pivot", *i_j, "side", "minor", "node", "root", "n", "middle")
        for side, part, other, i_j in (
            (0, large.where("minor"), others[0], (i.alias("i"), F.col("other").alias("j"))),
            (1, large, others[1], (F.col("other").alias("i"), j.alias("j"))),
            (2, blocks.where("nj = 1"), F.array(zero), (zero.alias("i"), zero.alias("j"))),
        )
    ]
    dealt = spread[0].union(spread[1]).union(spread[2]).withColumn("g", F.pmod(F.xxhash64("pivot", "i", "j"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(_tree_pairs(num, den), "a long, b long").distinct()


def ngram_jaccard_components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs (doc_id, text).

    Two documents link when den * |A and B| >= num * |A or B| over their sets
    of distinct k-word shingles; component_id is the smallest doc_id that
    links reach. A document without words (or a null text) has 0 shingles and
    is its own component. Rows with a null doc_id keep their size, have a
    null component_id and link to nothing. Rows that repeat a doc_id each get
    a result of their own text. Other columns of docs are ignored.
    """
    return _components(docs, k, num, den).drop("of")


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs, all columns, with the document of the smallest doc_id of each group of linked texts alone.

    Rows are judged by their own text: of rows that repeat a doc_id with
    different texts those go whose text links to a smaller doc_id. Rows with a
    null doc_id or without words stay, as do repeated rows of the smallest.
    """
    gone = _components(docs, k, num, den).where("component_id <> doc_id").select("doc_id", "of").distinct()
    own = Named(docs)
    return own.back(own.df.join(gone, (own["doc_id"].cast("long") == F.col("doc_id")) & (F.xxhash64(own["text"].cast("string")) == F.col("of")), "left_anti"))


def _components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """ngram_jaccard_components with of, a hash of each row's text."""
    docs, each, nodes, star = _routed(docs, k, num, den)
    links = _Links(docs, nodes, k, num, den)
    found = materialize(links.verify(_near_pivots(star, nodes, num, den), "fine"), "links")
    roots = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # the members of one pivot's cells together, by size; the pivot itself has been compared with all of them
    known = _rooted(nodes.select("node", "n"), roots, "node")
    rows = materialize(star.join(known, "node").select("pivot", "node", "root", "n"), "members")
    own = _sized(rows, materialize(_open_parts(rows, num, den), "pivots"), 12).withColumn("band", _band(num, den))
    own = own.withColumn("p", F.explode(F.filter("parts", lambda p: (p["c"] == F.col("band")) | (p["c"] == F.col("band") - 1))))
    blocks = own.select(F.xxhash64("pivot", "p.c").alias("pivot"), "node", "root", "p.main", "p.ni", "p.nj").join(nodes.select("node", "n", "middle"), "node")
    blocks = materialize(blocks.withColumn("minor", F.col("root") != F.col("main")), "cell-rows")
    pairs = _searched(blocks, num, den, both=False)
    if pairs is not None:
        again = links.verify(materialize(pairs.join(star.select(F.col("pivot").alias("a"), F.col("node").alias("b")), ["a", "b"], "left_anti"), "pairs"), "fine")
        found = materialize(found.union(again), "links")
        roots = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return _named(each, nodes, roots, "of")


def _named(each: DataFrame, nodes: DataFrame, roots: DataFrame, *more: str) -> DataFrame:
    """each with the smallest doc_id of its node's component."""
    rooted = _rooted(nodes.select("node", "doc_id"), roots, "node")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("node", "component_id"), "named")
    return each.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def ngram_jaccard_links(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """Every link: (a, b) between different sets, and per row of docs (doc_id, n_shingles, component_id, n_links).

    Sets are named by their smallest doc_id, a < b. n_links counts all other
    rows with an id that the row links to, exact copies among them, so links
    of different sets count by the rows that have them. Rows as in
    ngram_jaccard_components; those without words or id have no links.
    """
    docs, each, nodes, star = _routed(docs, k, num, den)
    rows = materialize(star.union(star.select("pivot", "pivot").distinct()), "members")
    width = F.ceil(F.col("every") / CELL_BLOCK).cast("int")
    sizes = materialize(rows.groupBy("pivot").agg(F.count("*").alias("every")).select("pivot", "every", width.alias("ni"), width.alias("nj")), "pivots")
    # a root of its own for each node: every pair is a pair of two
    blocks = _sized(rows, sizes).join(nodes.select("node", "n", "middle"), "node").select("pivot", "ni", "nj", F.lit(True).alias("minor"), "node", F.col("node").alias("root"), "n", "middle")
    pairs = _searched(materialize(blocks, "cell-rows"), num, den, both=True)
    if pairs is None:
        pairs = docs.sparkSession.createDataFrame([], "a long, b long")
    found = materialize(_Links(docs, nodes, k, num, den).verify(materialize(pairs, "pairs"), "fine"), "links")
    roots = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))

    copies = each.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"))
    ends = found.union(found.select("b", "a")).toDF("node", "other").join(copies.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("copies").alias("linked"))
    counts = materialize(copies.join(ends, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "n-links")
    named = _named(each.join(counts, "node", "left"), nodes, roots, "n_links").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    spots = nodes.select("node", "doc_id")
    links = found.join(spots.toDF("a", "x"), "a").join(spots.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return links, named
