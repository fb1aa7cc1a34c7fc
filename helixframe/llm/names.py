"""Columns of a caller's table under names that clash with nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Named:
    """A table with its columns renamed to c0, c1 and so on, so that names with dots or like an operator's own do no harm."""

    def __init__(self, df: DataFrame):
        self.columns = df.columns
        self.df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def name(self, column: str) -> str:
        """What a column is called now; as in Spark the case doesn't matter."""
        exact = [i for i, c in enumerate(self.columns) if c == column]
        return f"c{(exact or [i for i, c in enumerate(self.columns) if c.lower() == column.lower()])[0]}"

    def __getitem__(self, column: str) -> Column:
        return F.col(self.name(column))

    def __contains__(self, column: str) -> bool:
        return column.lower() in (c.lower() for c in self.columns)

    def back(self, df: DataFrame, keep: list[str] | None = None, **added: Column) -> DataFrame:
        """The columns keep (default all) of df under their old names, without those named like the added ones, and these."""
        keep = [c for c in (self.columns if keep is None else keep) if c.lower() not in added]
        return df.select(*(F.col(self.name(c)) for c in keep), *added.values()).toDF(*keep, *added)
