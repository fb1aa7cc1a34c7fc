"""A broadcast bitmap of bounded size that tells which rows may belong to a set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 16 for each member, and never more than 16 MB in all. Beyond that more rows pass by chance; none is lost.
PER_MEMBER, LEAST, MOST = 16, 1 << 16, 1 << 27


def slot_of(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def bitmap_of(members: DataFrame, column: str) -> tuple[int, Broadcast]:
    """(bits, broadcast bytes) of a table's column. The bits are set in partial bitmaps before the shuffle."""
    spark = members.sparkSession
    bits = min(MOST, max(LEAST, 1 << (members.count() * PER_MEMBER).bit_length()))
    place = slot_of(F.col(column), bits) + 1  # buckets count from 1 and hold 32768 places each
    rows = members.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    whole = bytearray(bits // 8)
    for r in rows:
        whole[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return bits, spark.sparkContext.broadcast(bytes(whole))


def may_hold(bitmap: bytes, slots: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(bitmap, np.uint8)
    return (raw[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def may_belong(column: Column, bits: int, bitmap: Broadcast) -> Column:
    """Whether the bitmap holds a column's value; only its slots go to Python. False for null."""

    @F.pandas_udf("boolean")
    def test(slots: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bitmap.value, slots.to_numpy()))

    return column.isNotNull() & test(slot_of(column, bits))
