"""Missing values: NaN and NULL are one thing.

Floating-point columns are normalised once, NaN to NULL, at an operator's
boundary; from there Spark's NULL-skipping aggregates do what ``skipna`` asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)


def value(df: DataFrame, name: str) -> Column:
    """Column ``name`` with NaN as NULL."""
    column = F.col(f"`{name}`")
    return F.when(~F.isnan(column), column) if isinstance(df.schema[name].dataType, FLOATS) else column


def numeric_columns(df: DataFrame, but: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def normalised(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All floating-point columns (or those named) with NaN as NULL, in one projection."""
    names = [c for c in (columns or df.columns) if isinstance(df.schema[c].dataType, FLOATS)]
    return df.withColumns({c: value(df, c) for c in names}) if names else df
