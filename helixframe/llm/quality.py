"""Quality rules by distribution divergence.

A document is compared with references of its language: the histogram of its
character classes and the histogram of the language's common words. The
distance is Jensen-Shannon's (the root of the divergence, base 2, 0 to 1). A
document fails when it is farther than the limits from every language's
reference; under MIN_WORDS words the distances say too little and the rule
lets it pass, as it does a document whose language is named but has no
reference. References are sums over all documents of a language, and every
language has one; they travel to the executors in blocks of BLOCK_LANGUAGES.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.text import LOWER, SPACE, bytes_of, chunks, running_shingles, word_hashes
from helixframe.storage import materialize

MIN_WORDS, BLOCK_LANGUAGES, COMMON = 50, 256, 100
#: Distinct words that a task holds before it sends partial sums on.
HELD_WORDS = 400_000
CHAR_LIMIT, WORD_LIMIT = 0.25, 0.45
#: A document of n words may be farther by these over n: histograms of few words scatter.
CHAR_SLACK, WORD_SLACK = 6.0, 0.4
SYMBOLS = b"#*$%&|<>"
#: Classes of bytes: lower letters one by one, upper letters, digits, blanks, common punctuation, symbols, controls, lead bytes of other letters.
CLASSES = 34
_CLASS = np.full(256, 33, np.uint8)
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = 26
_CLASS[48:58] = 27
_CLASS[33:48] = 28
_CLASS[[58, 59, 63, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126, 61]] = 28
_CLASS[[*SYMBOLS, 43]] = 29
_CLASS[:32] = 30
_CLASS[127] = 30
_CLASS[SPACE] = 31
_CLASS[128:192] = 32  # continuation bytes are not counted
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def classes_of(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per text the counts of its character classes, blanks and continuation bytes left out."""
    n = len(offs) - 1
    owner = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount(owner * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    counts[:, 31:33] = 0
    return counts


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0).sum(), np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def repeated_positions(hashes: np.ndarray, width: int = 5) -> int:
    """Words of one text that lie in a window of width words found twice or more in it."""
    every = running_shingles(hashes, width)
    if len(every) < 2:
        return 0
    order = np.argsort(every, kind="stable")
    same = every[order[1:]] == every[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(every), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    spots = np.flatnonzero(again)
    np.add.at(edge, spots, 1)
    np.add.at(edge, spots + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language partial sums: character classes (kind 0) and words (kind 1)."""
    chars: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, 0, b"%d" % i, int(n)) for lang, c in chars.items() for i, n in enumerate(c) if n]
        rows += [(lang, 1, w, n) for lang, c in words.items() for w, n in c.items()]
        chars.clear()
        words.clear()
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        types = (pa.string(), pa.int32(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["lang", "kind", "item", "n"])

    for batch in chunks(batches):
        data, offs = bytes_of(batch["text"])
        counts = classes_of(data, offs)
        raw = LOWER[data].tobytes()
        for i, lang in enumerate(batch["lang"].to_pylist()):
            chars[lang] = chars.get(lang, 0) + counts[i]
            words.setdefault(lang, Counter()).update(raw[offs[i] : offs[i + 1]].split())
        if sum(map(len, words.values())) > HELD_WORDS:
            yield out()
    yield out()


@dataclass
class References:
    """Reference histograms: characters classes per language; common words with their shares, the rest as one share."""

    chars: list[np.ndarray]
    words: list[dict[bytes, int]]
    shares: list[np.ndarray]
    languages: list[str]

    def blocks(self) -> Iterator[References]:
        for i in range(0, len(self.languages), BLOCK_LANGUAGES):
            own = slice(i, i + BLOCK_LANGUAGES)
            yield References(self.chars[own], self.words[own], self.shares[own], self.languages[own])

    def distances(self, counts: np.ndarray, raw: bytes, n: int) -> tuple[float, float]:
        """The smallest distances of a document's two histograms to those of a language."""
        if not self.chars:
            return 0.0, 0.0
        found = Counter(raw.split())
        nearest = []
        for common, share in zip(self.words, self.shares, strict=True):
            own = np.zeros(len(share))
            for w in common.keys() & found.keys():
                own[common[w]] = found[w]
            own[-1] = n - own.sum()
            nearest.append(distance(own, share))
        return min(distance(counts, c) for c in self.chars), min(nearest)


def learn_references(docs: DataFrame) -> References:
    """References of every language with words, over all documents with text and lang.

    Words are summed per task before the shuffle; at most COMMON words and
    CLASSES numbers per language come to the driver.
    """
    partial = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(_partial_counts, "lang string, kind int, item binary, n long")
    sums = materialize(partial.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "histograms")
    totals = {r["lang"]: r["n"] for r in sums.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
    top: dict[str, list] = {lang: [] for lang in totals}
    chars = {lang: np.zeros(CLASSES) for lang in totals}
    for r in sums.where("kind = 1").withColumn("place", place).where(F.col("place") <= COMMON).collect():
        top[r["lang"]].append((r["place"], bytes(r["item"]), r["n"]))
    for r in sums.where("kind = 0").collect():
        if r["lang"] in chars:
            chars[r["lang"]][int(r["item"])] = r["n"]
    found = References([], [], [], list(totals))
    for lang in totals:
        rows = sorted(top[lang])
        found.words.append({w: i for i, (_, w, _) in enumerate(rows)})
        found.shares.append(np.array([*(n for _, _, n in rows), totals[lang] - sum(n for _, _, n in rows)], float))
        found.chars.append(chars[lang])
    return found


def _judge(sent: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = [x.value for x in sent]
        known = {lang for x in refs for lang in x.languages}
        for batch in chunks(batches):
            data, offs = bytes_of(batch["text"])
            hashes, at = word_hashes(data, offs, lower=False)
            counts = classes_of(data, offs)
            points = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data])])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
            raw, low = data.tobytes(), LOWER[data].tobytes()
            rows, langs = [], batch["lang"].to_pylist()
            for i in range(batch.num_rows):
                a, b, n = offs[i], offs[i + 1], int(at[i + 1] - at[i])
                repeat = repeated_positions(hashes[at[i] : at[i + 1]])
                failed = n < 10 or 100 * repeat > 20 * n
                chars = words = 0.0
                if refs and n >= MIN_WORDS and (langs[i] is None or langs[i] in known):
                    every = [x.distances(counts[i], low[a:b], n) for x in refs]
                    chars, words = min(x for x, _ in every), min(x for _, x in every)
                kept = not failed and (n < MIN_WORDS or (chars <= CHAR_LIMIT + CHAR_SLACK / n and words <= WORD_LIMIT + WORD_SLACK / n))
                rows.append((n, int(points[b] - points[a]), int(symbols[b] - symbols[a]), duplicate_lines(raw[a:b]), repeat, failed, kept, chars, words))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=_NAMES)

    return run


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]


def judge_quality(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the two distances.

    Null and empty texts have no words and fail the base rule. A table with
    no labelled language has no references: then only the base rule decides.
    It also decides alone for a row whose lang is named but not in the given
    refs; a row without lang is compared with every language.
    Null ids are kept as they are, repeated rows are judged alike, other
    columns are ignored.
    """
    refs = learn_references(docs) if refs is None else refs
    sent = [docs.sparkSession.sparkContext.broadcast(x) for x in refs.blocks()]
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang"))
    return docs.mapInArrow(_judge(sent), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double")
