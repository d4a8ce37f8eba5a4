"""Grouped aggregate, transform and apply.

Groups with a missing key are dropped unless ``dropna=False``.  Named
aggregates are Spark's own (partial, then final); functions are aggregating
pandas UDFs, joined to the former on the keys where a call has both.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.aggregates import aggregate
from ..functions.missing import numeric_columns, value


def _keyed(df: DataFrame, keys: list[str], dropna: bool) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [value(df, k).isNotNull() for k in keys])) if dropna else df


def _spec(df: DataFrame, keys: list[str], func, columns) -> list[tuple[str, str, object]]:
    """(output, column, function) of a name, function, list, or dict by column."""
    names = columns or numeric_columns(df, keys)
    label = lambda f: f if isinstance(f, str) else getattr(f, "__name__", "apply")
    if isinstance(func, dict):
        pairs = [(c, fs) for c, fs in func.items()]
        return [(f"{c}_{label(f)}" if isinstance(fs, (list, tuple)) else c, c, f) for c, fs in pairs for f in (fs if isinstance(fs, (list, tuple)) else [fs])]
    if isinstance(func, (list, tuple)):
        return [(f"{c}_{label(f)}", c, f) for c in names for f in func]
    return [(c, c, func) for c in names]


def _reversed(c: Column, kind: T.DataType) -> Column | None:
    """``c`` in the opposite order, exactly, for types of numbers and times."""
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(c)
    if isinstance(kind, T.NumericType):
        return -c
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.bitwise_not(F.unix_micros(c.cast("timestamp")))
    return F.bitwise_not(F.unix_date(c)) if isinstance(kind, T.DateType) else None


def ordered_aggregate(name: str, c: Column, order: list[str], label: str | None, kind: T.DataType) -> Column:
    """Aggregates of a column of type ``kind`` that depend on the order of rows; missing values are skipped.

    Of equal extremes ``idxmin`` and ``idxmax`` take the first in ``order``.
    """
    at = F.struct(*order)
    if name == "first":
        return F.min_by(c, F.when(c.isNotNull(), at))
    if name == "last":
        return F.max_by(c, F.when(c.isNotNull(), at))
    if name == "idxmin":
        return F.min_by(label, F.when(c.isNotNull(), F.struct(c, at)))
    back = _reversed(c, kind)
    if back is not None:
        return F.min_by(label, F.when(c.isNotNull(), F.struct(back, at)))
    # the first of equal greatest values: compare the value, then the order backwards
    return F.max_by(label, F.when(c.isNotNull(), F.struct(c, *[-F.col(o).cast("double") for o in order])))


def group_agg(
    df: DataFrame,
    by: list[str] | str,
    func=None,
    columns: list[str] | None = None,
    order: list[str] | None = None,
    label: str | None = None,
    dropna: bool = True,
    sort: bool = False,
    args: tuple = (),
    options: dict | None = None,
    **named: tuple[str, object],
) -> DataFrame:
    """Aggregate groups: ``func`` is a name, function, list or ``{column: ...}``; or give ``out=(column, name or function)``.

    ``first last idxmin idxmax`` need ``order`` (ending in a unique key), the
    latter two ``label``.
    """
    keys = [by] if isinstance(by, str) else list(by)
    held = _keyed(df, keys, dropna)
    spec = [(out, c, f) for out, (c, f) in named.items()] if named else _spec(df, keys, func, columns)
    native, users = [], []
    for out, c, f in spec:
        if isinstance(f, str):
            v = value(df, c)
            native.append((ordered_aggregate(f, v, order, label, held.schema[c].dataType) if f in ("first", "last", "idxmin", "idxmax") else aggregate(f, v, **(options or {}))).alias(out))
        else:
            users.append(_udaf(f, args)(F.col(c)).alias(out))
    parts = [held.groupBy(*keys).agg(*some) for some in (native, users) if some]
    found = parts[0]
    if len(parts) == 2:
        other = parts[1].withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        found = found.join(other, same).select(*keys, *[out for out, *_ in spec])
    return found.orderBy(*keys) if sort else found


def _udaf(func: Callable, args: tuple, returns: str = "double"):
    def run(s: pd.Series) -> float:
        out = func(s, *args)
        return float(out) if out is not None else None

    return F.pandas_udf(run, returns, F.PandasUDFType.GROUPED_AGG)


def group_transform(
    df: DataFrame,
    by: list[str] | str,
    func,
    columns: list[str] | None = None,
    suffix: str = "_t",
    order: list[str] | None = None,
    args: tuple = (),
    **kwargs,
) -> DataFrame:
    """All rows of ``df`` with, per column, ``func`` of its group.

    A name is a window aggregate; a function from Series to Series or to one
    value runs once per group and column.  Rows with a missing key get NULL.
    """
    keys = [by] if isinstance(by, str) else list(by)
    names = columns or numeric_columns(df, keys)
    present = reduce(lambda a, b: a & b, [value(df, k).isNotNull() for k in keys])
    if isinstance(func, str):
        w = Window.partitionBy(*keys)
        whole = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if order else w
        make = {"first": lambda c: F.first(c, True).over(whole), "last": lambda c: F.last(c, True).over(whole)}.get(func, lambda c: aggregate(func, c, w, **kwargs))
        return df.select("*", *[F.when(present, make(value(df, n))).alias(f"{n}{suffix}") for n in names])
    if func is zscore:
        w = Window.partitionBy(*keys)
        return df.select("*", *[F.when(present, F.try_divide(value(df, n) - F.avg(value(df, n)).over(w), aggregate("std", value(df, n), w))).alias(f"{n}{suffix}") for n in names])
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, {', '.join(f'`{n}{suffix}` double' for n in names)}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if order:
            pdf = pdf.sort_values(order, kind="stable")
        out = {}
        for n in names:
            made = func(pdf[n], *args, **kwargs)
            out[f"{n}{suffix}"] = made.to_numpy() if isinstance(made, pd.Series) else made
        return pdf.assign(**out)

    some = df.filter(present).groupBy(*keys).applyInPandas(run, schema)
    rest = df.filter(~F.coalesce(present, F.lit(False))).select("*", *[F.lit(None).cast("double").alias(f"{n}{suffix}") for n in names])
    return some.unionByName(rest)


def zscore(s: pd.Series) -> pd.Series:
    """(x - mean) / std; ``group_transform`` recognises it and stays in the JVM."""
    return (s - s.mean()) / s.std()


def group_apply(df: DataFrame, by: list[str] | str, func: Callable, schema: str, include_groups: bool = True, dropna: bool = True, order: list[str] | None = None, column: str | None = None, args: tuple = (), **kwargs) -> DataFrame:
    """``func`` of each group's frame (or of one ``column`` as a Series).

    A frame is returned as it is; a Series or a value becomes one row, after the
    keys.  A function whose first argument is called ``key`` also gets the key.
    """
    keys = [by] if isinstance(by, str) else list(by)
    wants_key = next(iter(inspect.signature(func).parameters), "") == "key"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if order:
            pdf = pdf.sort_values(order, kind="stable")
        given = pdf[column] if column else pdf if include_groups else pdf.drop(columns=keys)
        out = func(key, given, *args, **kwargs) if wants_key else func(given, *args, **kwargs)
        if isinstance(out, pd.DataFrame):
            return out
        row = list(out) if isinstance(out, pd.Series) else [out]
        return pd.DataFrame([[*key, *row]])

    return _keyed(df, keys, dropna).groupBy(*keys).applyInPandas(run, schema)
