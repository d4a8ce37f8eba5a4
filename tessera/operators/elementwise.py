"""Element-wise operators and user functions on cells, rows, columns and partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import value


def isin(df: DataFrame, values, columns: list[str] | None = None) -> DataFrame:
    """Whether each cell is among ``values``: a list for all columns, a dict of lists by column, or a DataFrame's first column.

    Missing cells give false, or true if the list has a missing value.  Lists
    stand in the plan as a hashed set; long ones are better given as a DataFrame,
    which is joined.
    """
    names = columns or df.columns
    if isinstance(values, DataFrame):
        known = values.select(F.col(values.columns[0]).alias("__k")).distinct().withColumn("__in", F.lit(True))
        out = df
        for n in names:
            out = out.join(known, F.col(n).eqNullSafe(F.col("__k")), "left").withColumn(n, F.coalesce("__in", F.lit(False))).drop("__k", "__in")
        return out
    tests = {}
    for n in names:
        given = values.get(n, []) if isinstance(values, dict) else list(values)
        present = [v for v in given if v is not None and v == v]
        c = value(df, n)
        hit = c.isin(present) if present else F.lit(False)
        tests[n] = F.when(c.isNull(), F.lit(len(present) < len(given))).otherwise(hit)
    return df.withColumns(tests)


def replace(df: DataFrame, to_replace, new=None, columns: list[str] | None = None, regex: bool = False) -> DataFrame:
    """Replace a scalar, a list, a dict ``{old: new}`` or a dict ``{column: {old: new}}``; ``regex`` gives patterns for string columns.

    All replacements look at the original cell; of several that match the first
    in order holds.  Group references in a replacement may be written ``\\1``.
    """
    names = columns or df.columns
    nested = isinstance(to_replace, dict) and any(isinstance(v, dict) for v in to_replace.values())
    if isinstance(to_replace, dict):
        rules = to_replace if nested else {n: to_replace for n in names}
    else:
        olds = to_replace if isinstance(to_replace, (list, tuple)) else [to_replace]
        news = new if isinstance(new, (list, tuple)) else [new] * len(olds)
        rules = {n: dict(zip(olds, news, strict=True)) for n in names}
    kinds, out = dict(df.dtypes), {}
    for n, pairs in rules.items():
        c = value(df, n)
        if n not in kinds:
            continue
        if regex:
            if kinds[n] == "string":
                for old, fresh in pairs.items():
                    c = F.regexp_replace(c, old, _java(fresh))
                out[n] = c
            continue
        pairs = {k: v for k, v in pairs.items() if _fits(k, kinds[n])}
        if pairs:
            chain = None
            for old, fresh in pairs.items():
                test = c.isNull() if old is None else c == F.lit(old)
                chain = (F if chain is None else chain).when(test, F.lit(fresh))
            out[n] = chain.otherwise(c)
    return df.withColumns(out) if out else df


def _java(replacement: str) -> str:
    import re

    return re.sub(r"\\(\d)", r"$\1", replacement)


def _fits(old, kind: str) -> bool:
    if old is None:
        return True
    if isinstance(old, bool):
        return kind == "boolean"
    if isinstance(old, str):
        return kind == "string"
    return kind not in ("string", "boolean") and not kind.startswith(("timestamp", "date", "array", "map", "struct"))


def map_cells(df: DataFrame, func: Callable, returns: str, columns: list[str] | None = None, na_action: str | None = None, **kwargs) -> DataFrame:
    """``func`` of every cell: a Column expression stays in the JVM, any other function runs in Arrow batches."""
    names, out = columns or df.columns, {}
    for n in names:
        out[n] = _apply(value(df, n), func, returns, na_action, kwargs)
    return df.withColumns(out)


def _apply(c: Column, func: Callable, returns: str, na_action: str | None, kwargs: dict) -> Column:
    tried = None
    if getattr(func, "native", False):
        tried = func(c, **kwargs)
    else:
        f = partial(func, **kwargs)

        def cells(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore" if na_action == "ignore" else None)

        tried = F.pandas_udf(cells, returns)(c)
    return F.when(c.isNotNull(), tried) if na_action == "ignore" else tried


def native(func: Callable) -> Callable:
    """Mark a function as one from Column to Column."""
    func.native = True
    return func


def map_column(df: DataFrame, column: str, arg, returns: str = "string", into: str | None = None, na_action: str | None = None) -> DataFrame:
    """``arg``: a function, a dict, or a two-column DataFrame (key, value). Keys that aren't found give NULL."""
    into, c = into or column, value(df, column)
    if isinstance(arg, DataFrame):
        known = arg.select(F.col(arg.columns[0]).alias("__k"), F.col(arg.columns[1]).alias("__v")).dropDuplicates(["__k"])
        joined = df.join(known, c == F.col("__k"), "left")
        return joined.withColumn(into, F.col("__v")).drop("__k", "__v")
    if isinstance(arg, dict):
        table = F.create_map(*[F.lit(x) for pair in arg.items() for x in pair])
        return df.withColumn(into, F.when(c.isNotNull(), F.try_element_at(table, c)))
    return df.withColumn(into, _apply(c, arg, returns, na_action, {}))


def apply_rows(df: DataFrame, func: Callable, returns: str, into: str = "value", columns: list[str] | None = None, args: tuple = (), expand: bool = False, raw: bool = False, **kwargs) -> DataFrame:
    """``func`` of each row (a Series, or an array with ``raw``): a value, or a struct whose fields become columns with ``expand``."""
    names = columns or df.columns

    def rows(frame: pd.DataFrame) -> pd.Series:
        return frame.apply(func, axis=1, raw=raw, args=args, **kwargs)

    def records(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame.apply(func, axis=1, raw=raw, args=args, result_type="expand", **kwargs)
        return out

    made = F.pandas_udf(records if expand else rows, returns)(F.struct(*[F.col(n) for n in names]))
    if not expand:
        return df.withColumn(into, made)
    return df.withColumn("__r", made).select(*df.columns, "__r.*")


def apply_columns(df: DataFrame, func: Callable, columns: list[str], returns: str = "double") -> DataFrame:
    """``func`` of each whole column (Series to a value) as ``(column, value)``; a column is one task's group."""

    def whole(s: pd.Series) -> float:
        return func(s)

    udaf = F.pandas_udf(whole, returns, F.PandasUDFType.GROUPED_AGG)
    one = df.agg(*[udaf(F.col(n)).alias(n) for n in columns])
    pairs = ", ".join(f"'{n}', `{n}`" for n in columns)
    return one.selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)")


def transform_column(df: DataFrame, func: Callable, column: str, order: list[str], into: str, returns: str = "double", by: list[str] | None = None) -> DataFrame:
    """``func`` from a whole column, in order, to one of the same length.

    Without ``by`` one task holds the whole column, which is what such a function asks for.
    """
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, `{into}` {returns}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(**{into: pd.Series(func(pdf[column]).to_numpy(), index=pdf.index)})

    return df.groupBy(*(by or [F.lit(0)])).applyInPandas(run, schema)


def chunk_apply(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: list[str] | None = None, whole: bool = False, args: tuple = (), **kwargs) -> DataFrame:
    """``func`` of sub-frames: Arrow batches, whole partitions (``whole``), or chunks that keep every key of ``by`` together."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield func(frame, *args, **kwargs)

    def partitions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            yield func(pd.concat(held, ignore_index=True), *args, **kwargs)

    if by:
        return df.groupBy(*by).applyInPandas(lambda pdf: func(pdf, *args, **kwargs), schema)
    return df.mapInPandas(partitions if whole else batches, schema)
