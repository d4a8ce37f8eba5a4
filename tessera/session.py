"""Sessions, settings, progress to a log, and a method-style facade."""

from __future__ import annotations

import logging
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def initialize(n_cpu: int | None = None, disable_pr_bar: bool = True, split_factor: int | None = None, reuse_workers: bool = True, settings: dict | None = None) -> SparkSession:
    """A session with the library's settings; callable again, when only what may change at run time does.

    ``n_cpu`` sets local cores where no master is configured, ``split_factor``
    the shuffle partitions per core.  On a cluster leave both out.
    """
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.ui.showConsoleProgress", str(not disable_pr_bar).lower()).config("spark.python.worker.reuse", str(reuse_workers).lower())
    if n_cpu:
        builder = builder.master(f"local[{n_cpu}]")
    if split_factor:
        builder = builder.config("spark.sql.shuffle.partitions", str((n_cpu or 1) * split_factor))
    for k, v in (settings or {}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def configure(spark: SparkSession, n_cpu: int | None = None, split_factor: int | None = None) -> None:
    """Shuffle partitions of a running session."""
    cores = n_cpu or spark.sparkContext.defaultParallelism
    if split_factor:
        spark.conf.set("spark.sql.shuffle.partitions", cores * split_factor)


@contextmanager
def logged_progress(spark: SparkSession, logger: logging.Logger, level: int = logging.INFO, every: float = 0.25) -> Iterator[None]:
    """While inside, write finished and running tasks of active stages to ``logger``, one record per change."""
    done, tracker = threading.Event(), spark.sparkContext.statusTracker()

    def watch() -> None:
        last = ""
        while True:
            over = done.wait(every)
            infos = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
            said = ", ".join(f"stage {i.stageId}: {i.numCompletedTasks}/{i.numTasks}" for i in infos if i)
            if over:
                logger.log(level, "done")
                return
            if said and said != last:
                logger.log(level, said)
                last = said

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


class Frame:
    """Method-style access: ``Frame(df).cumulative(...)`` calls the operator of that name on ``df``."""

    def __init__(self, df: DataFrame):
        self.df = df

    @staticmethod
    def _operators() -> dict:
        from .operators import accumulate, correlate, elementwise, ewm, grouped, joins, pivot, reduce, windows

        modules = (reduce, accumulate, correlate, elementwise, grouped, joins, pivot, windows, ewm)
        found = {n: f for m in modules for n, f in vars(m).items() if callable(f) and not n.startswith("_") and getattr(f, "__module__", "") == m.__name__}
        return found | {"aggregate": reduce.agg}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        operators = self._operators()
        if name not in operators:
            raise AttributeError(f"no operator {name!r}")
        f = operators[name]

        def call(*args, **kwargs):
            out = f(self.df, *args, **kwargs)
            return Frame(out) if isinstance(out, DataFrame) else out

        return call

    def __dir__(self):
        return sorted([*super().__dir__(), *self._operators()])
