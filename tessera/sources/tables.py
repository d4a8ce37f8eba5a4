"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read_table(spark: SparkSession, folder: str, name: str, kind: str = "parquet", **options) -> DataFrame:
    """Table ``name`` of a folder; columns and filters asked for later reach the scan."""
    return spark.read.options(**options).format(kind).load(f"{folder}/{name}.{kind}")


def from_pandas(spark: SparkSession, frame, row_id: str | None = "row_id") -> DataFrame:
    """A pandas frame with its position as an explicit order key."""
    out = frame.reset_index(drop=True)
    if row_id:
        out.insert(0, row_id, range(len(out)))
    return spark.createDataFrame(out)


def write_table(df: DataFrame, folder: str, name: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*by) if by else writer).save(f"{folder}/{name}.{kind}")
