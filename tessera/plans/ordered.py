"""Running aggregates over a whole ordered table, without one task for all rows.

An ordered window without partition keys sends every row to one task.  Here
rows are dealt by range of the order key, each part is folded on its own, and
the parts' totals (one row per part) give every part its starting value.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: name -> (aggregate, how a part's value meets what came before)
FOLDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "prod": (F.product, lambda a, b: a * b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "count": (F.count, lambda a, b: a + b),
}


def written(df: DataFrame) -> DataFrame:
    """``df`` from a copy in the session's ``spark.checkpoint.dir``, which survives lost executors; a temporary folder serves a local session without one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def parted(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` in written partitions, each a range of ``order`` in that order and numbered by ``__part``."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))


def running(df: DataFrame, order: list[str], folds: dict[str, tuple[str, Column]], parts: int | None = None) -> DataFrame:
    """``df`` with, for each ``out: (fold, column)``, the fold of all rows up to and including each row.

    ``order`` must end in a unique key.  NULLs are skipped; before the first
    value the result is NULL (0 for ``count``).  Integers stay integers.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"__v_{out}": column for out, (_, column) in folds.items()}
    # a row's part must not change between the two passes, so range boundaries are sampled once
    dealt = written(df.withColumns(values).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part").agg(*[FOLDS[fold][0](f"__v_{out}").alias(out) for out, (fold, _) in folds.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[(F.sum if fold == "count" else FOLDS[fold][0])(out).over(before).alias(f"__s_{out}") for out, (fold, _) in folds.items()])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row per part, so its size follows the number of partitions, not of rows
    both = dealt.join(F.broadcast(starts), "__part")
    out = {}
    for name, (fold, _) in folds.items():
        f, meet = FOLDS[fold]
        here, start = f(f"__v_{name}").over(inside), F.col(f"__s_{name}")
        out[name] = F.coalesce(meet(start, here), start, here)
    return both.select(*df.columns, *[c.alias(n) for n, c in out.items()])
