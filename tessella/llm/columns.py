"""Tables whose columns pass through an operator, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Through:
    """A table with all columns but the ``known`` ones under plain names of their own, by position, and the way back.

    Dots, backticks and the names that an operator uses itself so never meet its expressions or schemas.
    """

    def __init__(self, df: DataFrame, *known: str) -> None:
        self.names = {c if c in known else f"__x{i}": c for i, c in enumerate(df.columns)}
        self.rows = df.toDF(*self.names)

    def back(self, df: DataFrame) -> DataFrame:
        """``df`` with the names given; its other columns keep theirs."""
        return df.toDF(*(self.names.get(c, c) for c in df.columns))
