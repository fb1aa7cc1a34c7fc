"""Alignment in which differences of homopolymer length cost nothing, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def align_tables(a: str, b: str, free_start: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Scores and moves of a global alignment: match 1, mismatch -1, N 0, gap -1.

    A gap opposite a base that repeats the base before it on its own side is
    free, so runs of one base may differ in length. free_start leaves the
    first bases of a unpaired at no cost.
    """
    n, m = len(a), len(b)
    score, move = np.zeros((n + 1, m + 1), int), np.zeros((n + 1, m + 1), np.int8)
    for i in range(1, n + 1):
        score[i, 0] = 0 if free_start else score[i - 1, 0] - (0 if i > 1 and a[i - 1] == a[i - 2] else 1)
        move[i, 0] = 1
    for j in range(1, m + 1):
        score[0, j] = score[0, j - 1] - (0 if j > 1 and b[j - 1] == b[j - 2] else 1)
        move[0, j] = 2
    for i in range(1, n + 1):
        up = 0 if i > 1 and a[i - 1] == a[i - 2] else 1
        for j in range(1, m + 1):
            side = 0 if j > 1 and b[j - 1] == b[j - 2] else 1
            pair = 0 if "N" in (a[i - 1], b[j - 1]) else 1 if a[i - 1] == b[j - 1] else -1
            best = (score[i - 1, j - 1] + pair, 0), (score[i - 1, j] - up, 1), (score[i, j - 1] - side, 2)
            score[i, j], move[i, j] = max(best, key=lambda x: (x[0], -x[1]))
    return score, move


def align(a: str, b: str, free_start: bool = False) -> tuple[str, str, int]:
    """Both strings with `-` at gaps, and the score."""
    score, move = align_tables(a, b, free_start)
    i, j, x, y = len(a), len(b), [], []
    while i or j:
        step = move[i, j] if i and j else 1 if i else 2
        x.append(a[i - 1] if step != 2 else "-")
        y.append(b[j - 1] if step != 1 else "-")
        i, j = i - (step != 2), j - (step != 1)
    return "".join(x[::-1]), "".join(y[::-1]), int(score[-1, -1])


def penalty(a: str, quality: str, b: str) -> int:
    """What the mismatches of an alignment cost: min(20, quality) * min(40, place) / 40 each, in whole numbers, and nothing past the qualities; gaps within runs are free."""
    x, y, _ = align(a, b)
    total, at = 0, 0
    for p, (c, d) in enumerate(zip(x, y, strict=True)):
        if c != d and "N" not in (c, d):
            run = (c == "-" and p and y[p - 1] == d) or (d == "-" and p and x[p - 1] == c)
            if not run:
                total += min(20, ord(quality[at]) - 33) * min(40, at) // 40 if at < len(quality) else 0
        at += c != "-"
    return total


def global_alignment(a: Column, b: Column) -> Column:
    """struct(a, b, score) of the alignment."""

    @F.pandas_udf("a string, b string, score int")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(p, q) for p, q in zip(x, y, strict=True)], columns=["a", "b", "score"])

    return run(a, b)


def duplicate_penalty(seq: Column, quality: Column, lead: Column) -> Column:
    @F.pandas_udf("long")
    def run(x: pd.Series, q: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0 if a == b else penalty(a, c or "", b) for a, c, b in zip(x, q, y, strict=True)], dtype="int64")

    return run(seq, quality, lead)
