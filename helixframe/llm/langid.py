"""Language identification with averaged hashed subword embeddings.

Subwords are the byte 2-, 3- and 4-grams of words, blanks marking where words
begin and end, hashed into BUCKETS rows of an embedding table. A text is the
mean of its rows, a linear softmax on top gives the language. Table and
softmax are trained by stochastic gradient descent in numpy on the driver,
on windows of words from a sample of labelled rows (about SAMPLE_ROWS rows, but
LEAST_ROWS of every language, WINDOWS windows of WINDOW_WORDS words each). A temperature fitted on held-back
windows calibrates the score, and the score under which REJECT of the
held-back windows fall is the rejection threshold. Short texts score lower
and scatter, so windows are also held back cut to their first CUTS words, and
each power of two of subwords has a threshold of its own; texts longer than
all windows have that of the longest.

Prediction sums the table over every subword of the whole text; up to DIMS
languages softmax and table are folded into one table before, with more the
softmax comes after, so the table doesn't grow with the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from helixframe.llm.names import Named
from helixframe.llm.text import LOWER, SPACE, bytes_of, chunks, mix

BUCKETS, DIMS = 1 << 16, 16
SIZES = (2, 3, 4)
SAMPLE_ROWS, LEAST_ROWS, WINDOWS, WINDOW_WORDS, WINDOW_BYTES = 6000, 20, 2, 24, 4096
#: Bytes of sampled text whose subwords the driver holds at once.
RUN_BYTES = 1 << 16
EPOCHS, BATCH, RATE = 6, 64, 0.5
#: Step sizes of the softmax and of table rows against RATE, and the most that a row moves in a step.
TOP_STEP, ROW_STEP, MOST_STEP = 3.0, 5.0, 1.0
#: Share of held-back windows under the threshold, words to which they are cut, and classes of length.
REJECT, CUTS, LENGTHS = 0.002, (1, 2, 4, 8, 16), 12
UNKNOWN = "und"
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def subwords(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the rows of all subwords and, for each text, the index of its first one (and the count)."""
    solid = ~SPACE[data]
    code = _BYTE[np.where(solid, LOWER[data], 32)]
    for n in SIZES:
        size = len(data) - n + 1
        if size <= 0:
            yield np.empty(0, np.int64), np.zeros(len(offs), np.int64)
            continue
        good = solid[:size] | solid[n - 1 :]
        for j in range(1, n - 1):
            good &= solid[j : j + size]
        for j in range(1, n):
            cut = offs[1:-1] - j
            good[cut[(cut >= 0) & (cut < size)]] = False
        spots = np.flatnonzero(good)
        total = np.full(len(spots), n, np.uint64)
        for j in range(n):
            total += code[spots + j] * _STEP[j]
        yield (mix(total) >> np.uint64(48)).astype(np.int64), np.searchsorted(spots, offs)


def _runs(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts of the bounded sample by runs of about RUN_BYTES: all at once their subwords take a hundred times their bytes of the driver."""
    for batch in chunks([pa.RecordBatch.from_arrays([texts], names=["t"])], "t", most=RUN_BYTES):
        yield batch["t"]


def bags(texts: pa.Array) -> list[np.ndarray]:
    """The subword rows of each text, in as few bytes as BUCKETS allows; only for the bounded sample."""
    out = []
    for run in _runs(texts):
        data, offs = bytes_of(run)
        parts = [(rows.astype(np.min_scalar_type(BUCKETS - 1)), at) for rows, at in subwords(data, offs)]
        out += [np.concatenate([rows[at[i] : at[i + 1]] for rows, at in parts]) for i in range(len(offs) - 1)]
    return out


def _segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows at[i] to at[i + 1]; zero for empty runs."""
    out = np.zeros((len(at) - 1, values.shape[1]))
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, at[full], axis=0)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    thresholds: np.ndarray
    #: The softmax where it is not folded into the table.
    top: np.ndarray | None = None

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text the logits and the class of its length."""
        data, offs = bytes_of(texts)
        total, count = np.zeros((len(offs) - 1, self.table.shape[1])), np.zeros(len(offs) - 1)
        for rows, at in subwords(data, offs):
            total += _segment_sums(self.table[rows], at)
            count += np.diff(at)
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if self.top is None else mean @ self.top) + self.bias, np.minimum(np.log2(np.maximum(count, 1)).astype(int), LENGTHS - 1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, length = self.logits(texts)
        p = _softmax(logits * self.temperature)
        best = p.argmax(axis=1)
        score = p[np.arange(len(best)), best]
        data, offs = bytes_of(texts)
        run = np.concatenate([[0], np.cumsum(_LETTER[data])])
        lettered = run[offs[1:]] > run[offs[:-1]]
        for i in np.flatnonzero(~lettered):
            lettered[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, score, 0.0), ~lettered | (score < self.thresholds[length])


def fit(examples: list[tuple[str, str]], seed: int = 1) -> Model:
    """A model of (text, language) examples; every fifth is held back for calibration."""
    languages = sorted({lang for _, lang in examples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, np.zeros(LENGTHS))
    rng = np.random.Generator(np.random.PCG64(seed))
    examples = sorted(examples)
    rng.shuffle(examples)
    rows = bags(pa.array([t for t, _ in examples], pa.string()))
    number = {lang: i for i, lang in enumerate(languages)}
    want = np.array([number[lang] for _, lang in examples])
    used = [i for i in range(len(rows)) if len(rows[i])]
    held = used[::5] if len(used) >= 50 else used
    train = [i for j, i in enumerate(used) if j % 5] if len(used) >= 50 else used
    table = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    top, bias = np.zeros((DIMS, len(languages))), np.zeros(len(languages))
    steps, step = EPOCHS * max(1, -(-len(train) // BATCH)), 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for b in range(0, len(train), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            own = train[b : b + BATCH]
            flat = np.concatenate([rows[i] for i in own])
            size = np.array([len(rows[i]) for i in own])
            at = np.concatenate([[0], np.cumsum(size)])
            hidden = _segment_sums(table[flat], at) / size[:, None]
            error = _softmax(hidden @ top + bias)
            error[np.arange(len(own)), want[own]] -= 1
            back = (error @ top.T) / size[:, None]
            top -= TOP_STEP * rate * hidden.T @ error / len(own)
            bias -= rate * error.mean(axis=0)
            order = np.argsort(flat, kind="stable")
            ids, first = np.unique(flat[order], return_index=True)
            moved = ROW_STEP * rate * np.add.reduceat(np.repeat(back, size, axis=0)[order], first, axis=0)
            table[ids] -= moved.clip(-MOST_STEP, MOST_STEP).astype(np.float32)
    wide = len(languages) > DIMS
    folded = table.astype(np.float64) if wide else table.astype(np.float64) @ top
    raw = np.array([folded[rows[i]].mean(axis=0) for i in held])
    raw = (raw @ top if wide else raw) + bias
    truth = want[held]
    grid = 2.0 ** np.arange(-3, 6, 0.25)
    loss = [-np.log(np.maximum(_softmax(raw * t)[np.arange(len(held)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    model = Model(languages, folded, bias, temperature, np.zeros(LENGTHS), top if wide else None)
    model.thresholds = _thresholds(model, [examples[i][0] for i in held])
    return model


def _thresholds(model: Model, texts: list[str]) -> np.ndarray:
    """Per class of length the score under which REJECT of the texts, whole and cut, fall.

    So small a share needs 1 / REJECT texts: of fewer the least score would be
    the limit, however high, and turn away texts that are as clear. A class
    with fewer takes in shorter ones until it has them, then longer ones.
    """
    cut = [" ".join(t.split()[:n]) for n in CUTS for t in texts if len(t.split()) > n]
    parts = [model.logits(run) for run in _runs(pa.array([*texts, *cut], pa.string()))]
    score = np.concatenate([_softmax(logits * model.temperature).max(axis=1) for logits, _ in parts])
    length = np.concatenate([x for _, x in parts])
    number = np.bincount(length, minlength=LENGTHS)
    found = np.zeros(LENGTHS)
    for c in range(LENGTHS):
        low, high = c, c
        while number[low : high + 1].sum() < 1 / REJECT and (low > 0 or high < LENGTHS - 1):
            low, high = (low - 1, high) if low else (low, high + 1)
        own = np.sort(score[(length >= low) & (length <= high)])
        if len(own):
            found[c] = own[int(REJECT * len(own))]
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS windows of each row: words of at most WINDOW_BYTES bytes, from a place that the row's number picks."""
    for batch in batches:
        out = []
        for text, lang, pick in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), batch["pick"].to_pylist(), strict=True):
            words = text.split()
            for w in range(WINDOWS if words else 0):
                at = (pick * (2 * w + 1) * 2654435761 >> 7) % max(1, len(words) - WINDOW_WORDS + 1)
                out.append((" ".join(words[at : at + WINDOW_WORDS]).encode()[:WINDOW_BYTES].decode(errors="ignore"), lang, pick))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["text", "lang", "pick"])


def train(docs: DataFrame, usable: Column) -> Model:
    """A model of every language, learnt from the text and lang of usable rows.

    The sample has windows of at most max(LEAST_ROWS, SAMPLE_ROWS / languages)
    rows of each language, those of the smallest hashes of id and text; ties
    and repeated rows are cut at that number, too.
    """
    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("doc_id").alias("id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    per = max(LEAST_ROWS, SAMPLE_ROWS // len(counts))
    # first a share of twice as many rows as are wanted, so that few texts are ordered; the order then bounds the rows
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 2 * per / n + 1e-4)) for lang, n in counts.items()], "lang string, share double")
    rows = rows.withColumn("pick", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20))).join(F.broadcast(shares), "lang").where(F.col("pick") <= F.col("share") * (1 << 20))
    cut = rows.select("text", "lang", "pick").mapInArrow(_cut, "text string, lang string, pick long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("pick", F.xxhash64("text")))
    return fit([(r["text"], r["lang"]) for r in cut.withColumn("place", place).where(F.col("place") <= WINDOWS * per).select("text", "lang").collect()])


def _predict(model):
    """The columns but the last, the text, with lang_pred, score and rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t", most=1 << 20):
            names, score, rejected = model.value.predict(batch["t"])
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def _judged(own: Named, model: Model, keep: list[str]) -> DataFrame:
    """The renamed columns keep with lang_pred, score and rejected."""
    sent = own.df.sparkSession.sparkContext.broadcast(model)
    rows = own.df.select(*(own.name(c) for c in keep), own["text"].cast("string").alias("t"))
    schema = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return rows.mapInArrow(_predict(sent), schema)


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep of docs with lang_pred, score and rejected.

    A null text or one without a letter is `und` with score 0 and rejected.
    Of languages with equal scores the first in code point order is
    predicted. Texts of any length count whole. Empty tables give empty
    results; repeated rows are judged alike. docs may have any other columns;
    those of keep named like the added ones are replaced.
    """
    own = Named(docs)
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score", "rejected")]
    return own.back(_judged(own, model, keep), keep, lang_pred=F.col("lang_pred"), score=F.col("score"), rejected=F.col("rejected"))


def keep_recognised(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without the rejected rows: those of a null text, one without a letter, or a score under the threshold for its length."""
    own = Named(docs)
    return own.back(_judged(own, model, docs.columns).where(~F.col("rejected")))


def fold(column: str, parts: int) -> Column:
    """crc32 of an id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts
