"""Removal of repeated byte strings by sparse prefix doubling.

Every byte that a string of LENGTH bytes covers goes when that string starts
anywhere else too. Full prefix doubling would rank every position of the
corpus in a first sort that is a multiple of the input. Here the positions
of the first round are sampled so that nothing can be missed, ranks are
64-bit hashes, and positions drop out as soon as their rank is unique:

1. Offset GRAM. Every window of LENGTH bytes has an anchor, the place of the
   smallest hash among its GRAM-byte strings; equal windows have equal
   anchors. The windows with one anchor are a run of starts. Runs are sorted
   by the rank of their anchor's GRAM bytes; a unique rank drops the run.
2. Offset of the whole run, from the first window's start to the last one's
   end. Runs that agree there are repeated as a whole. A rank of round 1
   under which all runs agree needs nothing more.
3. Of the runs that agree at their anchor but not as a whole, one of each
   kind is taken apart into shorter runs, whose starts lie in one step of
   STEP bytes before the anchor, and round 2 is held over these.
4. Offset LENGTH. What still differs is taken apart into its windows, whose
   ranks are sorted; those met twice are repeated.

Each task sorts and ranks its own rows first and sends at most two rows per
anchor rank and one per window rank, so a passage that a third of all
documents share costs a few rows per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.membership import bitmap_of, may_belong
from helixframe.llm.text import CHUNK_BYTES, bytes_of, chunks, mix
from helixframe.storage import materialize

LENGTH, GRAM = 200, 48
PIECE = 1 << 20
STEP = 12
#: Rows that a task sorts before it sends them on, and that one sorting partition should get.
BLOCK, PART = 400_000, 1_500_000
#: Bytes of texts whose settled runs are put together by one task.
BUCKET_BYTES = 24 << 20
_SPOT = np.uint64((1 << 28) - 1)
#: A run: its first start, how many starts follow, and how far behind the first its anchor lies.
_SPANS = np.dtype([("p", "<u4"), ("span", "<u2"), ("back", "<u2")])


_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            take = min(done, size - done)
            have[done : done + take] = have[:take] * np.uint64(pow(base, done, 1 << 64))
            done += take
        if size <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have


class Rolling:
    """Hashes of substrings of a few dozen bytes; they choose anchors and sort runs, and decide nothing."""

    def __init__(self, data: np.ndarray):
        self.run = np.empty(len(data) + 1, np.uint64)
        self.run[0] = 0
        np.cumsum(_VALUE[data] * _power(_BASE, len(data) + 1)[: len(data)], out=self.run[1:])
        self.inverse = _power(_INVERSE, len(data) + 1)[: len(data) + 1]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.run[b] - self.run[a]) * self.inverse[a])

    def every(self, width: int) -> np.ndarray:
        """Of all substrings of this width, in order."""
        return mix((self.run[width:] - self.run[: len(self.run) - width]) * self.inverse[: len(self.run) - width])


def digests(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """XXH3 digests of the bytes a to b: what tells repeated strings from others."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every width values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text index, first start in the text, span, distance of the anchor, anchor rank, whole rank) of the runs of windows, piece by piece."""
    for s in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[s : s + PIECE + length - 1]
        roll = Rolling(part)
        grams = roll.every(gram)
        index = np.arange(len(grams), dtype=np.uint64)
        least = window_minima((grams & ~_SPOT) | index, length - gram + 1)
        starts = np.arange(s, s + len(least))
        owner = np.searchsorted(offs, starts, side="right") - 1
        good = np.flatnonzero(starts + length <= offs[owner + 1])
        if not len(good):
            continue
        anchor = (least[good] & _SPOT).astype(np.int64)
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1] + 1)])
        first = np.flatnonzero(new)
        p1, p2 = good[first], good[np.append(first[1:], len(good)) - 1]
        at = anchor[first]
        whole = mix(digests(part, p1, p2 + length) + (((at - p1) << 20) + (p2 - p1)).astype(np.uint64))
        text = owner[p1]
        yield text, p1 + s - offs[text], p2 - p1, at - p1, grams[at], whole


#: A run that is settled: flags 1 repeated as a whole, 2 to be taken apart.
_DONE = np.dtype([("key", "<i8"), ("p", "<u4"), ("span", "<u2"), ("back", "<u2"), ("flags", "u1")])


def _done(rows: np.ndarray, flags: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Rows with flags as one blob per bucket of their keys."""
    rows, flags = rows[flags > 0], flags[flags > 0]
    out = np.empty(len(rows), _DONE)
    for name in _DONE.names[:-1]:
        out[name] = rows[name] if name in rows.dtype.names else 0
    out["flags"] = flags
    bucket = out["key"] % buckets
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, out[order[x:y]].tobytes()) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]


def _per_key(*flags: int):
    """One row (key, a blob of spans for each flag) per text of a bucket that has any."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(x, _DONE) for x in pdf["rows"]])
        rows = rows[(rows["flags"] & sum(flags)) > 0]
        rows = rows[np.argsort(rows["key"], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])) if len(rows) else np.empty(0, np.int64)
        spans = np.empty(len(rows), _SPANS)
        for name in _SPANS.names:
            spans[name] = rows[name]
        return pd.DataFrame({"key": rows["key"][first], "spans": [spans[x:y].tobytes() for x, y in zip(first, np.append(first[1:], len(rows)), strict=True)]})

    return run


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    out[0] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


_SENT = "part int, bucket int, rows binary"
_RUN = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("key", "<i8"), ("p", "<u4"), ("span", "<u2"), ("back", "<u2"), ("flags", "u1")])
_WINDOW = np.dtype([("rank", "<u8"), ("key", "<i8"), ("p", "<u4"), ("known", "u1")])


def _batch(dealt: list[tuple[int, bytes]], done: list[tuple[int, bytes]], parts: int) -> pa.RecordBatch:
    """Rows to be sorted by others (bucket -1), and settled rows, which travel along to any partition."""
    rows = [(p, -1, x) for p, x in dealt] + [(b % parts, b, x) for b, x in done]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["part", "bucket", "rows"])


def _deal(rows: np.ndarray, ranks: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    part = ((ranks >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, rows[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


def _local_runs(rows: np.ndarray, parts: int, buckets: int) -> pa.RecordBatch:
    """Sort a task's runs; settle what it can, and send two kinds of each anchor rank at most."""
    rows = rows[np.lexsort((rows["whole"], rows["gram"]))]
    copy = _same_as_before(rows["gram"], rows["whole"])
    full = copy.copy()
    full[:-1] |= copy[1:]
    kinds = np.flatnonzero(~copy)
    gram = rows["gram"][kinds]
    again = _same_as_before(gram)
    several = again.copy()
    several[:-1] |= again[1:]
    third = again.copy()
    third[2:] &= again[1:-1]
    third[:2] = False
    taken = np.zeros(len(rows), bool)
    taken[kinds] = several
    rows["flags"] = full + 2 * taken
    sent = kinds[~third]
    settled = np.ones(len(rows), bool)
    settled[sent] = False
    return _batch(_deal(rows[sent], rows["gram"][sent], parts), _done(rows[settled], rows["flags"][settled], buckets), parts)


def _round_one(length: int, gram: int, parts: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in chunks(batches):
            keys = batch["key"].to_numpy(zero_copy_only=False)
            for text, p, span, back, rank, whole in runs_of(*bytes_of(batch["text"]), length, gram):
                rows = np.empty(len(p), _RUN)
                rows["gram"], rows["whole"], rows["key"], rows["p"], rows["span"], rows["back"] = rank, whole, keys[text], p, span, back
                held.append(rows)
                n += len(rows)
            if n >= BLOCK:
                yield _local_runs(np.concatenate(held), parts, buckets)
                held, n = [], 0
        if n:
            yield _local_runs(np.concatenate(held), parts, buckets)

    return run


def _merge(settle, kind: np.dtype, buckets: int):
    """settle for the rows of one partition, beside those that came settled."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf["bucket"] >= 0
        out = pdf.loc[ready, ["bucket", "rows"]]
        if not ready.all():
            more = _done(*settle(np.concatenate([np.frombuffer(x, kind) for x in pdf.loc[~ready, "rows"]])), buckets)
            out = pd.concat([out, pd.DataFrame({"bucket": pd.Series([m[0] for m in more], dtype="int32"), "rows": pd.Series([m[1] for m in more], dtype=object)})])
        return out

    return run


def _merge_runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a partition, sorted, and their flags."""
    rows = rows[np.lexsort((rows["whole"], rows["gram"]))]
    copy = _same_as_before(rows["gram"], rows["whole"])
    full = (rows["flags"] & 1) > 0
    full |= copy
    full[:-1] |= copy[1:]
    taken = (rows["flags"] & 2) > 0
    kinds = np.flatnonzero(~copy)
    again = _same_as_before(rows["gram"][kinds])
    several = again.copy()
    several[:-1] |= again[1:]
    taken[kinds] |= several
    return rows, full + 2 * taken.astype(np.uint8)


def _local_windows(rows: np.ndarray, parts: int, buckets: int) -> pa.RecordBatch:
    rows = rows[np.argsort(rows["rank"], kind="stable")]
    copy = _same_as_before(rows["rank"])
    full = copy.copy()
    full[:-1] |= copy[1:]
    rows["known"] = full
    return _batch(_deal(rows[~copy], rows["rank"][~copy], parts), _done(rows, full.astype(np.uint8), buckets), parts)


def _stretches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0] to high[0], low[1] to high[1] and so on, all ends included, on end."""
    size = high - low + 1
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())


def _spans_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, text, spans to take apart) of each row."""
    data, offs = bytes_of(batch["text"])
    for i, (key, raw) in enumerate(zip(batch["key"].to_pylist(), batch["spans"].to_pylist(), strict=True)):
        yield key, data[offs[i] : offs[i + 1]], np.frombuffer(raw, _SPANS)


def _round_two(length: int, gram: int, parts: int, buckets: int):
    """Runs cut at every STEP bytes before their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in chunks(batches):
            for key, own, spans in _spans_of(batch):
                back = spans["back"].astype(np.int64)
                anchor = spans["p"] + back
                least = back - spans["span"]
                low, high = least // STEP, back // STEP
                step = _stretches(low, high)
                of = np.repeat(np.arange(len(spans)), high - low + 1)
                far, near = np.minimum(back[of], step * STEP + STEP - 1), np.maximum(least[of], step * STEP)
                rows = np.empty(len(step), _RUN)
                p1, p2 = anchor[of] - far, anchor[of] - near
                rows["gram"] = mix(digests(own, anchor, anchor + gram)[of] + step.astype(np.uint64))
                rows["whole"] = mix(digests(own, p1, p2 + length) + ((far << 20) + (p2 - p1)).astype(np.uint64))
                rows["key"], rows["p"], rows["span"], rows["back"] = key, p1, p2 - p1, far
                held.append(rows)
                n += len(rows)
            if n >= BLOCK:
                yield _local_runs(np.concatenate(held), parts, buckets)
                held, n = [], 0
        if n:
            yield _local_runs(np.concatenate(held), parts, buckets)

    return run


def _round_three(length: int, parts: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in chunks(batches):
            for key, own, spans in _spans_of(batch):
                first = spans["p"].astype(np.int64)
                p = _stretches(first, first + spans["span"])
                rows = np.empty(len(p), _WINDOW)
                rows["rank"] = digests(own, p, p + length)
                rows["key"], rows["p"], rows["known"] = key, p, 0
                held.append(rows)
                n += len(rows)
            if n >= 2 * BLOCK:
                yield _local_windows(np.concatenate(held), parts, buckets)
                held, n = [], 0
        if n:
            yield _local_windows(np.concatenate(held), parts, buckets)

    return run


def _merge_windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = rows[np.argsort(rows["rank"], kind="stable")]
    copy = _same_as_before(rows["rank"])
    full = copy.copy()
    full[:-1] |= copy[1:]
    return rows, (full & (rows["known"] == 0)).astype(np.uint8)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offs = bytes_of(batch["text"])
            out = []
            for i, raw in enumerate(batch["spans"].to_pylist()):
                own = data[offs[i] : offs[i + 1]]
                spans = np.frombuffer(raw or b"", _SPANS)
                if not len(spans):
                    out.append((len(own), 0, 0, own.tobytes()))
                    continue
                edge = np.zeros(len(own) + 1, np.int32)
                np.add.at(edge, spans["p"], 1)
                np.add.at(edge, spans["p"].astype(np.int64) + spans["span"] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((len(own), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), own[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array([o[j] for o in out], pa.int64()) for j in range(3)), pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string()), pa.array([o[3] for o in out], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) per row of docs (doc_id, text).

    A null text is empty; texts under length bytes lose nothing. All copies
    of a repeated string go, and strings are judged on the input. Rows that
    repeat doc_id and text are copies of each other. A null doc_id is kept
    as it is. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    long = docs.where(F.octet_length("text") >= length)
    total = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, round(2 * total / (length - gram + 2) / PART))
    buckets = max(1, round(total / BUCKET_BYTES))

    def settled(sent: DataFrame, settle, kind: np.dtype) -> DataFrame:
        return materialize(sent.groupBy("part").applyInPandas(_merge(settle, kind, buckets), "bucket int, rows binary"), "settled")

    def apart(done: DataFrame) -> tuple[DataFrame, int]:
        """Texts with the spans that a round leaves to be taken apart, and how many spans that are."""
        spans = materialize(done.groupBy("bucket").applyInPandas(_per_key(2), "key long, spans binary"), "apart")
        size = spans.agg(F.sum(F.length("spans"))).first()[0] or 0
        bits, bitmap = bitmap_of(spans, "key")
        return long.select("key", "text").where(may_belong(F.col("key"), bits, bitmap)).join(spans, "key"), size // _SPANS.itemsize

    first = settled(long.select("key", "text").mapInArrow(_round_one(length, gram, parts, buckets), _SENT), _merge_runs, _RUN)
    left, size = apart(first)
    parts = max(1, round(size * (length - gram) / 2 / STEP / PART))
    second = settled(left.mapInArrow(_round_two(length, gram, parts, buckets), _SENT), _merge_runs, _RUN)
    left, size = apart(second)
    parts = max(1, round(size * STEP / PART))
    third = settled(left.mapInArrow(_round_three(length, parts, buckets), _SENT), _merge_windows, _WINDOW)
    spans = materialize(first.union(second).union(third).groupBy("bucket").applyInPandas(_per_key(1), "key long, spans binary"), "spans")
    bits, bitmap = bitmap_of(spans, "key")
    touched = may_belong(F.col("key"), bits, bitmap)
    whole = docs.where(~touched).select("doc_id", "text", F.lit(None).cast("binary").alias("spans"))
    cut = docs.where(touched).join(spans, "key", "left").select("doc_id", "text", "spans")
    return whole.union(cut).mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
