"""Correlation matrices: Pearson, Spearman, Kendall and any function of two arrays.

Results are long: ``a, b, value`` for every ordered pair of columns, with 1 on
the diagonal.  Pairs use the rows where both are present; fewer than
``min_periods`` of them, or a constant column, give NULL.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.missing import numeric_columns, value


def pearson(a: Column, b: Column, min_periods: int = 1) -> Column:
    """Over pairwise complete rows. ``corr`` itself fails on a constant column under ANSI rules."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) >= min_periods, r)


def _square(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Both halves and the diagonal from the pairs a < b."""
    spark = pairs.sparkSession
    diagonal = spark.createDataFrame([(n, n, 1.0) for n in names], "a string, b string, value double")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).unionByName(diagonal)


def _long_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, x, y) for each pair of columns and each row that has both; one pass over the table."""
    structs = [F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), value(df, p).cast("double").alias("x"), value(df, q).cast("double").alias("y")) for p, q in combinations(names, 2)]
    return df.select(F.explode(F.array(*structs)).alias("p")).select("p.*").filter("x is not null and y is not null")


def correlation(df: DataFrame, method="pearson", columns: list[str] | None = None, min_periods: int = 1) -> DataFrame:
    """``method``: pearson, spearman, kendall, or a function of two float arrays."""
    names = columns or numeric_columns(df)
    if method == "pearson":
        pairs = list(combinations(names, 2))
        one = df.agg(*[pearson(value(df, p).cast("double"), value(df, q).cast("double"), min_periods).alias(f"c{i}") for i, (p, q) in enumerate(pairs)])
        each = F.array(*[F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"c{i}").alias("value")) for i, (p, q) in enumerate(pairs)])
        return _square(one.select(F.explode(each).alias("p")).select("p.*"), names)
    long = _long_pairs(df, names)
    if method == "spearman":
        ranked = _average_ranks(_average_ranks(long, "x"), "y")
        return _square(ranked.groupBy("a", "b").agg(pearson(F.col("x_rank"), F.col("y_rank"), min_periods).alias("value")), names)
    if method == "kendall":
        return _square(_kendall(long, min_periods), names)
    if callable(method):

        def each(key, pdf):
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            good = np.isfinite(x) & np.isfinite(y)
            r = float(method(x[good], y[good])) if good.sum() >= max(1, min_periods) else None
            return pd.DataFrame({"a": [key[0]], "b": [key[1]], "value": [r]})

        # a user's function needs all values of a pair at once
        return _square(long.groupBy("a", "b").applyInPandas(each, "a string, b string, value double"), names)
    raise ValueError(f"Unknown method {method!r}")


def _average_ranks(long: DataFrame, side: str) -> DataFrame:
    """Average rank of ``side`` within each pair, from the counts of its distinct values (rows aren't sorted)."""
    counts = long.groupBy("a", "b", side).agg(F.count("*").alias("n"))
    w = Window.partitionBy("a", "b").orderBy(side).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.select("a", "b", side, (F.sum("n").over(w) - (F.col("n") - 1) / 2).alias(f"{side}_rank"))
    return long.join(ranks, ["a", "b", side])


def _kendall(long: DataFrame, min_periods: int) -> DataFrame:
    """Tau-b in O(n log n) per pair by merge counting over the distinct value pairs."""

    def tau(key, pdf):
        n = len(pdf)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "value": [kendall_tau(x, y) if n >= max(1, min_periods) else None]})

    return long.groupBy("a", "b").applyInPandas(tau, "a string, b string, value double")


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float | None:
    """Tau-b of two arrays without missing values; None if either is constant."""
    order = np.lexsort((y, x))
    x, y = x[order], np.unique(y[order], return_inverse=True)[1]
    n = len(x)
    ties = lambda *cols: sum(c * (c - 1) // 2 for c in _runs(*cols))
    tx, ty, txy = ties(x), ties(np.sort(y)), ties(x, y)
    whole = n * (n - 1) // 2
    swaps, width = 0, 1
    block = y.copy()
    while width < n:
        for at in range(0, n, 2 * width):
            left, right = block[at : at + width], block[at + width : at + 2 * width]
            if len(right):
                swaps += int(len(left) * len(right) - np.searchsorted(left, right, side="right").sum())
                block[at : at + 2 * width] = np.sort(np.concatenate((left, right)), kind="stable")
        width *= 2
    base = float(whole - tx) * float(whole - ty)
    return (whole - tx - ty + txy - 2 * swaps) / base**0.5 if base > 0 else None


def _runs(*columns):
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.diff(np.append(np.flatnonzero(new), len(new))).tolist()
