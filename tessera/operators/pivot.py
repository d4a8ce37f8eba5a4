"""Pivot tables with several values and functions, fill values and margins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..functions.missing import numeric_columns, value
from .grouped import _udaf


def pivot_table(
    df: DataFrame,
    values: list[str] | str | None = None,
    index: list[str] | str = (),
    columns: str | None = None,
    aggfunc="mean",
    fill_value=None,
    margins: bool = False,
    margins_name: str = "All",
    dropna: bool = True,
    labels: list | None = None,
    sort: bool = False,
) -> DataFrame:
    """One row per ``index`` key; columns ``{column value}_{value}_{function}``, shortened where only one value or function is asked for.

    ``labels`` are the column values; without them they are read first, which is
    one small aggregation.  Cells are aggregated before they are spread, so a
    user's function works as a built-in one does.  With ``margins`` all totals
    come from the same grouping sets over the rows, not from the cells.
    """
    keys = [index] if isinstance(index, str) else list(index)
    names = [values] if isinstance(values, str) else list(values or numeric_columns(df, (*keys, columns or "")))
    funcs = aggfunc if isinstance(aggfunc, dict) else {n: aggfunc for n in names}
    spec = []
    for n in names:
        fs = funcs.get(n, [])
        many = isinstance(fs, (list, tuple))
        for f in fs if many else [fs]:
            label = f if isinstance(f, str) else getattr(f, "__name__", "apply")
            spec.append((n, f, "_".join(x for x, wanted in ((n, len(names) > 1 or many), (label, many)) if wanted)))
    held = df
    for k in [*keys, *([columns] if columns else [])]:
        held = held.filter(value(df, k).isNotNull())
    users = [not isinstance(f, str) for _, f, _ in spec]
    if any(users) and not all(users):
        raise ValueError("pivot_table takes either names or functions, not both")
    made = [(_udaf(f, ())(F.col(n)) if not isinstance(f, str) else aggregate(f, value(df, n))).alias(f"__v{i}") for i, (n, f, _) in enumerate(spec)]
    if columns is None:
        cells = held.groupBy(*keys).agg(*made)
        out = cells.select(*keys, *[F.col(f"__v{i}").alias(label or n) for i, (n, _, label) in enumerate(spec)])
        return _finish(out, keys, fill_value, sort)
    if labels is None:
        labels = [r[0] for r in held.select(columns).distinct().orderBy(columns).collect()]
    held = held.filter(F.col(columns).isin(labels)) if dropna else held
    if margins:
        if any(users):
            raise ValueError("margins take names only")
        text = held.withColumns({k: F.col(k).cast("string") for k in [*keys, columns]})
        cube = text.cube(*keys, columns).agg(*made, F.grouping_id().alias("__g"))
        full = (1 << len(keys)) - 1
        # keep full keys or no keys; each with a column value or without
        kept = cube.filter(F.shiftright("__g", 1).isin(0, full))
        cells = kept.select(*[F.when(F.shiftright("__g", 1) == 0, F.col(k)).otherwise(margins_name).alias(k) for k in keys], F.when(F.col("__g").bitwiseAND(1) == 0, F.col(columns)).otherwise(margins_name).alias(columns), *[f"__v{i}" for i in range(len(spec))])
        labels = [*map(str, labels), margins_name]
    else:
        cells = held.groupBy(*keys, columns).agg(*made)
    spread = cells.groupBy(*keys).agg(*[F.first(F.when(F.col(columns) == F.lit(x), F.col(f"__v{i}")), True).alias(f"{x}_{label}" if label else f"{x}") for i, (_, _, label) in enumerate(spec) for x in labels])
    return _finish(spread, keys, fill_value, sort)


def _finish(out: DataFrame, keys, fill_value, sort):
    if fill_value is not None:
        out = out.na.fill(fill_value, [c for c in out.columns if c not in keys])
    return out.orderBy(*keys) if sort else out
