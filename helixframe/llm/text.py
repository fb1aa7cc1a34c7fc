"""Words, word hashes and shingles of whole Arrow batches, vectorised over bytes.

Words are the runs of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text. In
UTF-8 these bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_STEPS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The lowest 0 to 8 bytes of a number.
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Longer spans are hashed one by one.
LONG_SPAN = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `most` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
        at, total = 0, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        while at < batch.num_rows:
            end = int(np.searchsorted(total, total[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts on end, and where each text begins (and the last ends); a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, values = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8)[offs[0] : offs[-1]] if values is not None and len(values) else np.empty(0, np.uint8)
    return data, offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in data, and for each text the index of its first word (and the count)."""
    solid = ~SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begins[cut] = solid[cut]
        ends[cut - 1] = solid[cut - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offs)


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of data.

    Eight bytes at a time are taken into a running value that begins with the
    length, each step a bijection: no two spans of one length up to eight
    bytes collide, and longer ones have no collisions that follow from their
    form, as sums of powers have.
    """
    size = last - first
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix(size.astype(np.uint64) + _STEPS[0])
    long = size > LONG_SPAN
    live = np.flatnonzero(~long) if long.any() else np.arange(len(first))
    done = 0
    while len(live):
        left = size[live] - done
        out[live] = mix(out[live] * _STEPS[1] ^ (eight[first[live] + done] & _LOW_BYTES[np.minimum(left, 8)]))
        done += 8
        live = live[left > 8]
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(long).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[first[i] : last[i]])
    return out


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and for each text the index of its first word (and the count)."""
    if lower:
        data = LOWER[data]
    first, last, at = word_spans(data, offs)
    return span_hashes(data, first, last), at


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text's words; with fewer words the whole sequence is one; without words none."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    return running_shingles(hashes, min(k, n))


def running_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles of the words on end; those across two texts are for the caller to leave out."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    total = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * _STEPS[j]
    return mix(total)


def shingle_sets(texts: pa.Array, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For every text the sorted distinct hashes of its shingles."""
    hashes, at = word_hashes(*bytes_of(texts), lower=lower)
    every = running_shingles(hashes, k)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield np.unique(every[a : b - k + 1]) if b - a >= k else shingles(hashes[a:b], k)
