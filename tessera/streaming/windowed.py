"""Structured Streaming counterparts of grouped aggregation (batch analytics is the library's subject)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..functions.missing import value


def windowed(stream: DataFrame, on: str, width: str, ops: dict[str, tuple[str, str]], by: list[str] | None = None, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Named aggregates ``out: (column, op)`` per time window and key; state older than ``late`` is dropped."""
    held = stream.withColumn(on, F.col(on).cast("timestamp")).withWatermark(on, late)
    out = held.groupBy(F.window(on, width, slide), *(by or [])).agg(*[aggregate(op, value(stream, c)).alias(n) for n, (c, op) in ops.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), *ops)
