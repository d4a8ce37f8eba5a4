"""Reading tables, cutting lineage and sizing partitions."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and read it from there.

    The folder comes from the session's ``spark.checkpoint.dir``; a temporary
    one is set only where none is configured and the master is local, as in
    tests. Files go with the frame where the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast ``value`` with the classes it needs, so that workers need no copy of the package; ``opened`` gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast):
    return cloudpickle.loads(shared.value)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to a new place in the shared folder; the rows read from there, and the path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete what ``stored`` wrote."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file sizes for a scan); reads no data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame, each: int, least: int = 8) -> int:
    """How many groups of about ``each`` input bytes ``df`` makes; follows the input, without a cap.

    A frame whose size Catalyst doesn't know (it then assumes the largest there is) is measured by its ``text``.
    """
    size = input_bytes(df)
    if size > 1 << 60:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, math.ceil(size / each))
