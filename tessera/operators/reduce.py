"""Column and row reductions.

Along rows (axis 0) all asked-for statistics of all columns are one aggregation
and so one scan with partial aggregation; along columns (axis 1) they are array
expressions of one projection, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate, pick
from ..functions.missing import numeric_columns, value
from ..plans.ordered import running


def _long(df: DataFrame, names: list[str], label: str = "column") -> DataFrame:
    """One row of columns as (column, value) rows."""
    pairs = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    return df.selectExpr(f"stack({len(names)}, {pairs}) as ({label}, value)")


def reduce_columns(
    df: DataFrame, op: str, columns: list[str] | None = None, skipna: bool = True, wide: bool = False, **options
) -> DataFrame:
    """``op`` of each column, as ``(column, value)`` rows or, with ``wide``, as one row.

    With ``skipna=False`` a column with anything missing gives NULL. An empty
    table gives 0 for ``sum``, 1 for ``prod`` and NULL for the rest.
    """
    names = columns or numeric_columns(df)
    out = []
    for name in names:
        c = value(df, name)
        a = aggregate(op, c, **options)
        out.append((a if skipna else F.when(F.count(c) == F.count(F.lit(1)), a)).alias(name))
    one = df.agg(*out)
    return one if wide else _long(one, names)


def _fold(values: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.transform(values, f), F.lit(0.0), lambda s, v: s + v)


def _moment(values: Column, n: Column, mean: Column, power: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.pow(v - mean, F.lit(float(power))))


def row_expression(op: str, values: Column, ddof: int = 1, min_count: int = 0, q: float = 0.5, interpolation: str = "linear") -> Column:
    """``op`` of an array of doubles without NULLs."""
    n = F.size(values)
    nothing = F.lit(0)
    s = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    mean = s / F.nullif(n, nothing)
    if op in ("min", "max"):
        return (F.array_min if op == "min" else F.array_max)(values)
    if op == "sum":
        return F.when(n >= min_count, s)
    if op == "prod":
        return F.when(n >= min_count, F.aggregate(values, F.lit(1.0), lambda a, v: a * v))
    if op == "mean":
        return mean
    if op == "count":
        return n
    if op == "nunique":
        return F.size(F.array_distinct(values))
    if op in ("median", "quantile"):
        return pick(F.sort_array(values), 0.5 if op == "median" else q, interpolation)
    var = F.when(n > ddof, _moment(values, n, mean, 2) / F.nullif(n - ddof, nothing))
    if op == "var":
        return var
    if op == "std":
        return F.sqrt(var)
    if op == "sem":
        return F.sqrt(var) / F.sqrt(F.nullif(n, nothing))
    if op == "mad":
        return _fold(values, lambda v: F.abs(v - mean)) / F.nullif(n, nothing)
    m2, flat = _moment(values, n, mean, 2), F.array_max(values) == F.array_min(values)
    if op == "skew":
        g = F.sqrt(n.cast("double")) * _moment(values, n, mean, 3) / F.nullif(F.pow(m2, F.lit(1.5)), F.lit(0.0))
        return F.when(n >= 3, F.when(flat, 0.0).otherwise(g * F.sqrt(n * (n - 1)) / F.nullif(n - 2, nothing)))
    if op == "kurt":
        g = n * _moment(values, n, mean, 4) / F.nullif(m2 * m2, F.lit(0.0)) - 3
        return F.when(n >= 4, F.when(flat, 0.0).otherwise(((n + 1) * g + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), nothing)))
    raise ValueError(f"Unknown reduction {op!r}")


def reduce_rows(df: DataFrame, op: str, columns: list[str] | None = None, into: str = "value", skipna: bool = True, **options) -> DataFrame:
    """``df`` with ``op`` over ``columns`` of each row in a new column.

    The array of a row's values is its own projection, so it's built once.
    """
    names = columns or numeric_columns(df)
    every = F.array(*[value(df, c).cast("double") for c in names])
    held = df.withColumn("__row", every)
    out = row_expression(op, F.array_compact("__row"), **options)
    if not skipna:
        out = F.when(F.size(F.array_compact("__row")) == len(names), out)
    return held.withColumn(into, out).drop("__row")


def row_quantiles(df: DataFrame, q: list[float], columns: list[str] | None = None, interpolation: str = "linear") -> DataFrame:
    """Several quantiles of each row: one sort per row, then index arithmetic; columns ``q0``, ``q1`` ..."""
    names = columns or numeric_columns(df)
    held = df.withColumn("__row", F.sort_array(F.array_compact(F.array(*[value(df, c).cast("double") for c in names]))))
    return held.withColumns({f"q{i}": pick(F.col("__row"), x, interpolation) for i, x in enumerate(q)}).drop("__row")


def row_argext(df: DataFrame, op: str, columns: list[str] | None = None, into: str = "value") -> DataFrame:
    """Name of the first column with the row's least (``idxmin``) or greatest (``idxmax``) value."""
    names = columns or numeric_columns(df)
    every = F.array(*[value(df, c).cast("double") for c in names])
    best = (F.array_min if op == "idxmin" else F.array_max)(every)
    at = F.array_position(every, best).cast("int")
    return df.withColumn(into, F.when(best.isNotNull(), F.element_at(F.array(*map(F.lit, names)), at)))


def quantiles(df: DataFrame, q: float | list[float], columns: list[str] | None = None, interpolation: str = "linear", approximate: int | None = None) -> DataFrame:
    """Quantiles of each column: ``(column, value)`` for one q, a row ``q, columns...`` per q for a list.

    Exact unless ``approximate`` gives an accuracy for a mergeable sketch of
    fixed size, which is what to use where one column's values don't fit a task.
    """
    names = columns or numeric_columns(df)
    qs = q if isinstance(q, list) else [q]
    out = []
    for name in names:
        c = value(df, name).cast("double")
        if approximate:
            out.append(F.percentile_approx(c, [float(x) for x in qs], approximate).alias(name))
        elif interpolation == "linear":
            out.append(F.percentile(c, F.array(*[F.lit(float(x)) for x in qs])).alias(name))
        else:
            out.append(F.sort_array(F.collect_list(c)).alias(name))
    one = df.agg(*out)
    if not approximate and interpolation != "linear":
        one = one.select(*[F.array(*[pick(F.col(name), x, interpolation) for x in qs]).alias(name) for name in names])
    if not isinstance(q, list):
        return _long(one.select(*[F.get(n, F.lit(0)).alias(n) for n in names]), names)
    at = one.select(*names, F.posexplode(F.array(*map(F.lit, qs))).alias("i", "q"))
    return at.select("q", *[F.get(n, F.col("i")).alias(n) for n in names])


def mean_abs_deviation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean distance from the mean: means of all columns in one row first, then one more scan."""
    names = columns or numeric_columns(df)
    means = df.agg(*[F.avg(value(df, n)).alias(f"__m_{n}") for n in names])
    both = df.crossJoin(F.broadcast(means))  # one row
    one = both.agg(*[F.avg(F.abs(value(df, n) - F.col(f"__m_{n}"))).alias(n) for n in names])
    return _long(one, names)


def argext(df: DataFrame, op: str, label: str, order: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Label of the first row (by ``order``, else by label) with each column's least or greatest value: ``(column, label)``."""
    names, at = columns or numeric_columns(df, (label,)), order or label
    out = []
    for n in names:
        c = value(df, n)
        if op == "idxmin":
            out.append(F.min_by(label, F.when(c.isNotNull(), F.struct(c, F.col(at)))).alias(n))
        else:
            out.append(F.max_by(label, F.when(c.isNotNull(), F.struct(c, -F.col(at).cast("double")))).alias(n))
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return df.agg(*out).selectExpr(f"stack({len(names)}, {pairs}) as (column, label)")


def modes(df: DataFrame, columns: list[str], dropna: bool = True) -> DataFrame:
    """All modal values of each column, ascending: ``column, rank, value`` (value as text), ranks from 0.

    Values are counted with partial aggregation; modal values, which may be as many
    as the rows, are numbered by ranges of the value, never in one task.
    """
    found = None
    for n in columns:
        c = value(df, n)
        counts = df.select(c.alias("v")).groupBy("v").agg(F.count("*").alias("n"))
        counts = counts.filter("v is not null") if dropna else counts
        top = counts.join(F.broadcast(counts.agg(F.max("n").alias("n"))), "n").select("v")
        ranked = running(top, ["v"], {"rank": ("count", F.lit(1))})
        one = ranked.select(F.lit(n).alias("column"), (F.col("rank") - 1).cast("int").alias("rank"), F.col("v").cast("string").alias("value"))
        found = one if found is None else found.union(one)
    return found


def describe(df: DataFrame, columns: list[str] | None = None, percentiles: list[float] | None = None) -> DataFrame:
    """Count, mean, deviation, least, percentiles and greatest of numeric columns: rows ``statistic, columns...``."""
    names = columns or numeric_columns(df)
    qs = sorted({*(percentiles if percentiles is not None else [0.25, 0.5, 0.75]), 0.5})
    labels = ["count", "mean", "std", "min", *[f"{100 * x:g}%" for x in qs], "max"]
    out = []
    for n in names:
        c = value(df, n).cast("double")
        p = F.percentile(c, F.array(*[F.lit(x) for x in qs]))
        stats = [F.count(c).cast("double"), F.avg(c), aggregate("std", c), F.min(c), *[F.get(p, F.lit(i)) for i in range(len(qs))], F.max(c)]
        out.append(F.array(*stats).alias(n))
    one = df.agg(*out).select(*names, F.posexplode(F.array(*map(F.lit, labels))).alias("i", "statistic"))
    return one.select("statistic", *[F.get(n, F.col("i")).alias(n) for n in names])


def describe_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, distinct values, most frequent value (the least of several) and its frequency: ``column, count, unique, top, freq``."""
    found = None
    for n in columns:
        counts = df.filter(F.col(n).isNotNull()).groupBy(F.col(n).cast("string").alias("v")).agg(F.count("*").alias("n"))
        first = F.min_by("v", F.struct((-F.col("n")).alias("k"), F.col("v")))
        one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.count("*").alias("unique"), first.alias("top"), F.max("n").alias("freq"))
        one = one.select(F.lit(n).alias("column"), "count", "unique", "top", "freq")
        found = one if found is None else found.union(one)
    return found


def agg(df: DataFrame, func, columns: list[str] | None = None, **options) -> DataFrame:
    """Aggregate by name, list, dict or callable.

    A name gives ``(column, value)``; a list one row per function, ``function,
    columns...``; a dict ``{column: name or list}`` one wide row
    ``column_function``; a callable (Series to number) ``(column, value)`` by an
    aggregating pandas UDF.
    """
    if isinstance(func, str):
        return reduce_columns(df, func, columns, **options)
    if isinstance(func, dict):
        out = [aggregate(f, value(df, c), **options).alias(f"{c}_{f}") for c, fs in func.items() for f in ([fs] if isinstance(fs, str) else fs)]
        return df.agg(*out)
    names = columns or numeric_columns(df)
    if callable(func):
        udaf = F.pandas_udf(func, "double", F.PandasUDFType.GROUPED_AGG) if not hasattr(func, "returnType") else func
        return _long(df.agg(*[udaf(F.col(n).cast("double")).alias(n) for n in names]), names)
    one = df.agg(*[F.array(*[aggregate(f, value(df, n), **options).cast("double") for f in func]).alias(n) for n in names])
    at = one.select(*names, F.posexplode(F.array(*map(F.lit, func))).alias("i", "function"))
    return at.select("function", *[F.get(n, F.col("i")).alias(n) for n in names])


def zscore(df: DataFrame, columns: list[str] | None = None, suffix: str = "_z") -> DataFrame:
    """(x - mean) / std of each column: one aggregation to a single broadcast row, then a projection."""
    names = columns or numeric_columns(df)
    stats = df.agg(*[e for n in names for e in (F.avg(value(df, n)).alias(f"__m_{n}"), aggregate("std", value(df, n)).alias(f"__s_{n}"))])
    both = df.crossJoin(F.broadcast(stats))
    return both.select(*df.columns, *[F.try_divide(value(df, n) - F.col(f"__m_{n}"), F.col(f"__s_{n}")).alias(f"{n}{suffix}") for n in names])
