"""Scores of whole texts under an interpolated bigram model.

The model mixes maximum-likelihood estimates of a word after its
predecessor, of the word alone and a uniform share, with weights for each
bucket of the predecessor's frequency. The weights are learnt by
expectation-maximisation: counts of one part of the training documents give
the estimates, the tokens of a held-out part (by a hash of the id) the
expectations. Scores then use the counts of all training documents.

No table of n-grams is broadcast. Texts are packed into blocks; each block
sends its distinct n-grams with its own counts to the partitions of a hash,
which sum them and reply to each block in the order of its request. A
frequent n-gram is one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.text import bytes_of, chunks, mix, word_hashes
from helixframe.storage import materialize

BLOCK_BYTES, PART = 6 << 20, 1_000_000
BUCKETS, LEVELS, ROUNDS = 24, 60, 40
END = np.uint64(0x656E64206F662074)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, docs, fitted): about BLOCK_BYTES of documents as one compressed table, and those of the held-out part for the weights alone."""
    held: list[pa.RecordBatch] = []
    size = 0

    def packed(rows: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return zstandard.compress(sink.getvalue(), 3)

    def flush() -> pa.RecordBatch:
        nonlocal size
        rows = pa.Table.from_batches(held)
        fitted = rows.filter(pa.compute.equal(rows["part"], 1))
        held.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array([packed(rows)], pa.binary()), pa.array([packed(fitted)], pa.binary())], names=["docs", "fitted"])

    for batch in chunks(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield flush()
    if held:
        yield flush()


def unpack(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(raw)).read_all().combine_chunks()


def _hashed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block's texts and where texts begin, a few megabytes of text at a time."""
    hashes, at = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    done = 0
    for batch in chunks(rows.select(["text"]).to_batches()):
        h, a = word_hashes(*bytes_of(batch["text"]))
        hashes.append(h)
        at.append(a[1:] + done)
        done += len(h)
    return np.concatenate(hashes), np.concatenate(at)


class Tokens:
    """The tokens of a block of texts, an end after each, and their distinct unigrams and bigrams dealt over parts."""

    def __init__(self, rows: pa.Table, parts: int):
        words, at = _hashed(rows)
        n = len(at) - 1
        ends = at[1:] + np.arange(n)
        self.tokens = np.empty(len(words) + n, np.uint64)
        solid = np.ones(len(self.tokens), bool)
        solid[ends] = False
        self.tokens[solid] = words
        self.tokens[ends] = END
        self.begin = np.concatenate([[0], ends + 1])
        before = np.concatenate([[END], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        self.doc = np.repeat(np.arange(n), np.diff(self.begin))
        self.parts = parts
        self.one, self.one_at, self.one_cut = self._distinct(self.tokens)
        self.two, self.two_at, self.two_cut = self._distinct(mix(before * _A + self.tokens * _B))
        self.before_at = np.concatenate([self.one_at[self.begin[1] - 1 : self.begin[1]], self.one_at[:-1]]) if n else self.one_at

    def _distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order of (part, key), each token's index among them, and where parts begin."""
        found, inverse = np.unique(keys, return_inverse=True)
        part = ((found >> np.uint64(4)) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(found), np.int64)
        place[order] = np.arange(len(found))
        return found[order], place[inverse], np.searchsorted(part[order], np.arange(self.parts + 1))


def _planes(values: np.ndarray) -> bytes:
    """Numbers as one byte with the number of bytes that the largest needs, then all lowest bytes, all next and so on; planes of zeros compress away."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(raw.T).tobytes()


def _numbers(raw: bytes | pa.Buffer) -> np.ndarray:
    every = np.frombuffer(raw, np.uint8)
    width = int(every[0])
    planes = every[1:].reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _rising(keys: np.ndarray) -> bytes:
    """Sorted keys as planes of their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _risen(raw: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(_numbers(raw), dtype=np.uint64)


_REQUEST = "part int, block long, one binary, one_n binary, one_h binary, two binary, two_n binary, two_h binary"


def _ask(parts: int):
    """Per block and part the distinct n-grams, how often they are in its training documents (n) and in those of the held-out part (h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch["block"].to_pylist(), batch["docs"], strict=True):
                rows = unpack(raw.as_buffer())
                t = Tokens(rows, parts)
                part = rows["part"].to_numpy()[t.doc]
                counts = [np.bincount(at[part == v], minlength=len(keys)) for keys, at in ((t.one, t.one_at), (t.two, t.two_at)) for v in (0, 1)]
                out = []
                for p in np.flatnonzero((np.diff(t.one_cut) > 0) | (np.diff(t.two_cut) > 0)).tolist():
                    a, b, c, d = *t.one_cut[p : p + 2], *t.two_cut[p : p + 2]
                    out.append((p, block, _rising(t.one[a:b]), *(_planes(x[a:b]) for x in counts[:2]), _rising(t.two[c:d]), *(_planes(x[c:d]) for x in counts[2:])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64()] + [pa.binary()] * 6, strict=True)], names=[f.split()[0] for f in _REQUEST.split(", ")])

    return run


_REPLY = "block long, part int, one binary, two binary, one_h binary, two_h binary, tokens long, words long, tokens_h long, words_h long"


def _summed(keys: list[np.ndarray], n: list[bytes], h: list[bytes]) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """For each block the counts over all blocks: of all training documents for all keys, and without the held-out part for keys that the block has there."""
    cut = np.cumsum([len(k) for k in keys])[:-1]
    every = np.concatenate(keys)
    keys.clear()
    # places of the distinct keys, in half the room of np.unique's
    order = np.argsort(every, kind="stable").astype(np.uint32 if len(every) < 1 << 32 else np.int64)
    every = every[order]
    fresh = np.ones(len(every), bool)
    fresh[1:] = every[1:] != every[:-1]
    del every
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    distinct = int(fresh.sum())
    del order, fresh
    own_h = np.concatenate([_numbers(x) for x in h])
    held_any = np.split(own_h > 0, cut)
    total = np.bincount(inverse, weights=own_h, minlength=distinct).astype(np.int64)
    del own_h
    model = np.bincount(inverse, weights=np.concatenate([_numbers(x) for x in n]), minlength=distinct).astype(np.int64)
    total += model
    places = np.split(inverse, cut)
    whole = [_planes(total[at]) for at in places]
    held = [_planes(model[at[own]]) for at, own in zip(places, held_any, strict=True)]
    return whole, held, total, model


def _reply(asked: pa.Table) -> pa.Table:
    """The replies to all requests of a part. Requests are read where they lie in Arrow's memory, unigrams are done with before bigrams begin."""
    buffers = lambda name: [x.as_buffer() for x in asked[name]]
    binary = lambda x: pa.array(x, pa.binary())
    one, one_h, total, model = _summed([_risen(x) for x in buffers("one")], buffers("one_n"), buffers("one_h"))
    one, one_h = binary(one), binary(one_h)
    sums = [int(total.sum()), int((total > 0).sum()), int(model.sum()), int((model > 0).sum())]
    del total, model
    two, two_h = (binary(x) for x in _summed([_risen(x) for x in buffers("two")], buffers("two_n"), buffers("two_h"))[:2])
    rest = [pa.array([x] + [0] * (asked.num_rows - 1), pa.int64()) for x in sums]
    return pa.table([asked["block"], asked["part"], one, two, one_h, two_h, *rest], names=[f.split()[0] for f in _REPLY.split(", ")])


def _counts(replies: pd.DataFrame, column: str) -> np.ndarray:
    return np.concatenate([_numbers(x) for x in replies.sort_values("part")[column]] or [np.empty(0)]).astype(np.float64)


def _estimates(t: Tokens, one: np.ndarray, two: np.ndarray, total: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """For every token the bucket of its predecessor's count and the estimates from bigram and word; and the uniform share."""
    before = one[t.before_at]
    pair = two[t.two_at]
    with np.errstate(divide="ignore", invalid="ignore"):
        f2 = np.where(before > 0, pair / np.maximum(before, 1), 0.0)
    bucket = np.where(before > 0, np.floor(np.log2(np.maximum(before, 1))) + 1, 0).astype(np.int64).clip(0, BUCKETS - 1)
    return bucket, np.minimum(f2, 1.0), one[t.one_at] / max(total, 1), 1.0 / (words + 1)


def _levels(f: np.ndarray) -> np.ndarray:
    """Half powers of two of an estimate: 0 for none, else 1 to LEVELS - 1."""
    with np.errstate(divide="ignore"):
        return np.where(f > 0, np.floor(-2 * np.log2(np.where(f > 0, f, 1))).clip(0, LEVELS - 2) + 1, 0).astype(np.int64)


def _expect(parts: int, total: int, words: int):
    """Held-out tokens of one block counted by bucket and levels of their estimates; cells keep the sums of the estimates."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for raw in left["fitted"]:
            t = Tokens(unpack(raw), parts)
            if len(t.tokens):
                bucket, f2, f1, _ = _estimates(t, _counts(right, "one_h"), _counts(right, "two_h"), total, words)
                cell = (bucket * LEVELS + _levels(f2)) * LEVELS + _levels(f1)
                ids, at = np.unique(cell, return_inverse=True)
                out.append(pd.DataFrame({"cell": ids, "n": np.bincount(at), "s2": np.bincount(at, weights=f2), "s1": np.bincount(at, weights=f1)}))
        return pd.concat(out) if out else pd.DataFrame({"cell": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "s2": pd.Series(dtype="float64"), "s1": pd.Series(dtype="float64")})

    return run


def maximise(bucket: np.ndarray, n: np.ndarray, f2: np.ndarray, f1: np.ndarray, f0: float) -> np.ndarray:
    """Weights (bigram, word, uniform) per bucket by expectation-maximisation; a bucket without tokens has the weights of all."""

    def learn(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        weights = start
        parts = np.stack([f2[rows], f1[rows], np.full(len(rows), f0)], axis=1)
        for _ in range(ROUNDS):
            mixed = parts * weights
            share = (mixed / mixed.sum(axis=1, keepdims=True) * n[rows][:, None]).sum(axis=0)
            weights = np.maximum(share / share.sum(), 1e-6)
            weights = weights / weights.sum()
        return weights

    even = np.full(3, 1 / 3)
    every = learn(np.arange(len(n)), even) if len(n) else even
    out = np.tile(every, (BUCKETS, 1))
    for b in range(BUCKETS):
        rows = np.flatnonzero(bucket == b)
        if len(rows):
            out[b] = learn(rows, every)
    out[0] = [0.0, out[0][1] + out[0][0] / 2, out[0][2] + out[0][0] / 2]  # an unseen predecessor has no bigram estimate
    return out


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(parts: int, total: int, words: int, weights: np.ndarray):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for raw in left["docs"]:
            rows = unpack(raw)
            t = Tokens(rows, parts)
            one, two = _counts(right, "one"), _counts(right, "two")
            bucket, f2, f1, f0 = _estimates(t, one, two, total, words)
            w = weights[bucket]
            p = w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] * f0
            c = one[t.one_at]
            n = len(rows)
            sums = [np.bincount(t.doc, weights=x, minlength=n) for x in (c > 0, np.log10((c + 1) / (total + words + 1)), np.log10(p))]
            ids = rows["doc_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            out.append(pd.DataFrame({"doc_id": ids, "held_out": rows["part"].to_numpy() == 2, "n_tokens": np.diff(t.begin), "n_known": sums[0].astype(np.int64), "train_tokens": total, "base_score": sums[1], "score": sums[2]}))
        return pd.concat(out)

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs (doc_id, text).

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out from all
    learning; those with remainder 3 are the part of the training documents
    on which the weights are learnt. A null id counts as the empty text, a
    null text is empty: one token, the end. Rows that repeat count as often
    as they occur. Other columns are ignored; an empty table gives no rows.
    """
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.when(remainder == 2, 2).when(remainder == 3, 1).otherwise(0).cast("int").alias("part"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    packed = materialize(rows.mapInArrow(_pack, "docs binary, fitted binary").withColumn("block", F.monotonically_increasing_id()), "packed")
    parts = max(1, round(size / 9 / PART))
    replies = packed.select("block", "docs").mapInArrow(_ask(parts), _REQUEST).groupBy("part").applyInArrow(_reply, _REPLY)
    replies = materialize(replies, "replies")
    total, words, total_h, words_h = (x or 0 for x in replies.agg(*(F.sum(c) for c in ("tokens", "words", "tokens_h", "words_h"))).first())
    cells = packed.select("block", "fitted").groupBy("block").cogroup(replies.select("block", "part", "one_h", "two_h").groupBy("block")).applyInPandas(_expect(parts, total_h, words_h), "cell long, n long, s2 double, s1 double")
    # at most BUCKETS * LEVELS * LEVELS rows
    grid = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).orderBy("cell").toPandas()
    n = grid["n"].to_numpy(dtype=np.float64)
    weights = maximise(grid["cell"].to_numpy(dtype=np.int64) // (LEVELS * LEVELS), n, (grid["s2"] / n).to_numpy(dtype=np.float64), (grid["s1"] / n).to_numpy(dtype=np.float64), 1.0 / (words_h + 1))
    return packed.select("block", "docs").groupBy("block").cogroup(replies.select("block", "part", "one", "two").groupBy("block")).applyInPandas(_score(parts, total, words, weights), _SCORED)
