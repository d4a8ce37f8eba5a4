"""What the trained operators share: folds, labelled rows and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(parts: int, at: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(at).cast("string").cast("binary")), F.lit(parts)).cast("int")


def held_out(parts: int, part: int) -> Column:
    """Whether a row is in the fold that isn't learnt from; false for a null id."""
    return F.coalesce(fold(parts) == part, F.lit(False))


def training_labels(labels: DataFrame, column: str, parts: int, part: int) -> DataFrame:
    """One (doc_id, label) row per labelled document outside the held-out fold; of several labels of a document the largest holds."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(parts, part))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of a table with ``doc_id``, chosen by its hash; all where there are fewer."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def documents_text(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
