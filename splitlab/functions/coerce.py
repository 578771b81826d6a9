"""Text to number, per whole column or per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _as_number(name: str):
    return F.col(f"`{name}`").try_cast("double")


def coerce_cells(df: DataFrame, columns) -> DataFrame:
    """Listed columns as DOUBLE; a cell that is not a number becomes NULL."""
    return df.withColumns({name: _as_number(name) for name in columns})


def numeric_text_columns(df: DataFrame, columns=None) -> list[str]:
    """Text columns in which every present cell is a number (one pass)."""
    text = [name for name, kind in df.dtypes if kind == "string"]
    text = [name for name in text if columns is None or name in columns]
    if not text:
        return []
    bad = df.agg(
        *[
            F.count_if(F.col(f"`{name}`").isNotNull() & _as_number(name).isNull()).alias(f"c{i}")
            for i, name in enumerate(text)
        ]
    ).first()
    return [name for i, name in enumerate(text) if bad[i] == 0]


def coerce_columns(df: DataFrame, columns=None) -> DataFrame:
    """Columns that are numbers throughout as DOUBLE, the others left as text."""
    return coerce_cells(df, numeric_text_columns(df, columns))
