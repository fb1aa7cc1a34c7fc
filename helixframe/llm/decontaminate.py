"""Benchmark decontamination: size-partitioned MinHash containment search of short items in long documents.

An item is the set of its distinct k-word shingles; it leaks into a document
when at least num/den of its shingles occur in the document. Items are
partitioned by set size, a partition for each power of two. A partition has
its own sketch length m, that of its largest item, and its own table of the
bottom m min-hash values of each item; and it knows the fewest shingles with
which a document can contain enough of its smallest item. A document asks
only the partitions that its own size allows. Of an item of q shingles one
of the bottom q - ceil(num/den * q) + 1 is in every document that contains
enough of it, so the search misses nothing; the items found are verified by
exact containment of all their shingles.

Equal item texts are one item. Items travel to the executors in blocks of at
most BLOCK_BYTES of text (the size is read before); a larger benchmark takes
several blocks one after the other, each a scan of the documents whose
broadcast is released before the next, so what is broadcast at a time has a
fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.names import Named
from helixframe.llm.ngram_join import prefix_length
from helixframe.llm.text import bytes_of, chunks, running_shingles, shingle_sets, shingles, word_hashes
from helixframe.storage import materialize

BLOCK_BYTES = 16 << 20
_SLOTS = 1 << 22


class Partition:
    """Items of like size: their sketches in one sorted table."""

    def __init__(self, sets: list[np.ndarray], items: list[int], num: int, den: int):
        sizes = [len(sets[i]) for i in items]
        #: The sketch length, and the fewest shingles of a document that can contain an item.
        self.length, self.least = prefix_length(max(sizes), num, den), -(-min(sizes) * num // den)
        low = [sets[i][: self.length] for i in items]
        values, owners = np.concatenate(low), np.repeat(items, [len(x) for x in low])
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def hits(self, every: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Those of the spots whose shingle is in some sketch."""
        at = np.searchsorted(self.values, every[spots])
        return spots[self.values[np.minimum(at, len(self.values) - 1)] == every[spots]]

    def owners_of(self, found: np.ndarray) -> set[int]:
        lo, hi = np.searchsorted(self.values, found, "left"), np.searchsorted(self.values, found, "right")
        return {int(o) for a, b in zip(lo, hi, strict=True) for o in self.owners[a:b]}


class Sketches:
    """The items of a block, partitioned by size."""

    def __init__(self, keys: list, texts: list[str], k: int, num: int, den: int):
        self.k, self.num, self.den, self.keys = k, num, den, keys
        self.sets = list(shingle_sets(pa.array(texts, pa.string()), k))
        by_size: dict[int, list[int]] = {}
        for i, members in enumerate(self.sets):
            if len(members):
                by_size.setdefault(len(members).bit_length(), []).append(i)
        self.partitions = [Partition(self.sets, by_size[b], num, den) for b in sorted(by_size)]

    @cached_property
    def slots(self) -> np.ndarray:
        """Which partitions may hold a value, by its lowest bits: one look tells for all. Made where it is used, so it isn't sent."""
        found = np.zeros(_SLOTS, np.uint16)
        for p, part in enumerate(self.partitions):
            found[self._slot(part.values)] |= self._bit(p)
        return found

    @staticmethod
    def _bit(p: int) -> np.uint16:
        return np.uint16(1 << min(p, 15))

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return (values & np.uint64(_SLOTS - 1)).astype(np.int64)

    def candidates(self, every: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> dict[int, set[int]]:
        """Items that may leak, by row: of shingles every that belong to the rows owner, whose numbers of shingles are sizes."""
        out: dict[int, set[int]] = {}
        maybe = self.slots[self._slot(every)]
        some = np.flatnonzero(maybe)
        for p, part in enumerate(self.partitions):
            spots = some[(maybe[some] & self._bit(p)) > 0]
            spots = part.hits(every, spots[sizes[owner[spots]] >= part.least])
            for row in np.unique(owner[spots]):
                out.setdefault(int(row), set()).update(part.owners_of(np.unique(every[spots[owner[spots] == row]])))
        return out

    def leaks(self, members: np.ndarray, items: set[int]) -> Iterator[tuple[int, int, int]]:
        """(item, shared, size) of the items that members contain."""
        for i in sorted(items):
            own = self.sets[i]
            shared = int(np.isin(own, members, assume_unique=True).sum())
            if self.den * shared >= self.num * len(own):
                yield i, shared, len(own)

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, shared, size) of all leaks into texts."""
        hashes, at = word_hashes(*bytes_of(texts))
        words, k = np.diff(at), self.k
        every = running_shingles(hashes, k)
        owner = np.repeat(np.arange(len(words)), words)
        inside = owner[: len(every)] == owner[k - 1 :][: len(every)]
        every, owner = every[inside], owner[: len(every)][inside]
        short = np.flatnonzero((words < k) & (words > 0))
        if len(short):
            every = np.concatenate([every, *(shingles(hashes[at[r] : at[r + 1]], k) for r in short)])
            owner = np.concatenate([owner, short])
        for row, items in sorted(self.candidates(every, owner, np.maximum(words - k + 1, 1)).items()):
            for found in self.leaks(np.unique(shingles(hashes[at[row] : at[row + 1]], k)), items):
                yield row, *found


def _search(sketches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketches.value
        for batch in chunks(batches):
            found = list(table.search(batch["text"]))
            rows = batch["doc_id"].take(pa.array([f[0] for f in found], pa.int64()))
            columns = [pa.array([table.keys[f[1]] for f in found], pa.string()), *(pa.array([f[i] for f in found], pa.int64()) for i in (2, 3)), pa.array([f[2] / f[3] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([rows, *columns], names=["doc_id", "item", "shared", "item_shingles", "containment"])

    return run


def _clean(sketches, text: str):
    """Rows whose text, the last column, contains no item, without that column; those with a null id, the last but one, stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            keep = np.ones(batch.num_rows, bool)
            keep[[f[0] for f in sketches.value.search(batch[text])]] = False
            keep |= batch.column(batch.num_columns - 2).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 2)], names=batch.schema.names[:-2]).filter(pa.array(keep))

    return run


def _blocks(items: DataFrame, k: int, num: int, den: int) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast sketches of a block of the distinct texts of items (key, text) at a time, and whether it is the only one."""
    texts = items.select("key", "text").distinct()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_BYTES))
    for b in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()
        yield items.sparkSession.sparkContext.broadcast(Sketches([r["key"] for r in rows], [r["text"] for r in rows], k, num, den)), blocks == 1


def _keyed(items: DataFrame) -> DataFrame:
    """(item_id, key, text) of items with a text; the key is a digest of the text."""
    text = F.col("text").cast("string")
    return items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).where("text is not null").select("item_id", F.sha1("text").alias("key"), "text")


def find_leaks(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every item that a document contains.

    docs has doc_id and text, items item_id and text; other columns are
    ignored. Words are compared with A-Z lower-cased. Texts with fewer than k
    words are one shingle, the whole sequence. Null or empty texts contain
    nothing and are contained nowhere. Texts of any length are searched
    whole. Items with a null item_id are searched too and reported with a
    null id; rows that repeat an item or a document are reported once each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = _keyed(items)
    found = None
    for sketches, only in _blocks(items, k, num, den):
        one = docs.mapInArrow(_search(sketches), "doc_id long, item string, shared long, item_shingles long, containment double")
        if not only:
            one = materialize(one, "leaks")
            sketches.unpersist()
        found = one if found is None else found.union(one)
    return found.join(items.select(F.col("key").alias("item"), "item_id"), "item").select("doc_id", "item_id", "shared", "item_shingles", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs, all columns, without the rows whose text contains an item.

    Rows are judged by their own text, so of rows that repeat a doc_id only
    those that contain an item go. A row with a null doc_id is never dropped.
    """
    for sketches, only in _blocks(_keyed(items), k, num, den):
        own = Named(docs)
        sent = own.df.select("*", own["doc_id"].alias("id"), own["text"].cast("string").alias("t"))
        docs = own.back(sent.mapInArrow(_clean(sketches, "t"), own.df.schema))
        if not only:
            docs = materialize(docs, "clean")
            sketches.unpersist()
    return docs
