"""Cumulative aggregates, ranks and relative changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.missing import numeric_columns, value
from ..plans.ordered import running

CUMULATIVE = {"cumsum": (F.sum, "sum"), "cumprod": (F.product, "prod"), "cummin": (F.min, "min"), "cummax": (F.max, "max")}


def cumulative(
    df: DataFrame, op: str, order: list[str], by: list[str] | None = None, columns: list[str] | None = None, skipna: bool = True, suffix: str | None = None
) -> DataFrame:
    """``op`` (``cumsum cumprod cummin cummax``) down the rows in ``order``, per group of ``by`` if given.

    Missing values stay missing and are skipped; with ``skipna=False`` the first
    one makes all that follow NULL.  Without ``by`` the table is folded by ranges
    of the order key (see ``plans.ordered``), never in one task.
    """
    names, end = columns or numeric_columns(df, (*order, *(by or []))), suffix if suffix is not None else f"_{op}"
    f, fold = CUMULATIVE[op]
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = []
        for n in names:
            c = value(df, n)
            ok = c.isNotNull() if skipna else F.count(c).over(w) == F.count(F.lit(1)).over(w)
            out.append(F.when(ok, f(c).over(w)).alias(f"{n}{end}"))
        return df.select("*", *out)
    folds = {f"{n}{end}": (fold, value(df, n)) for n in names}
    if not skipna:
        folds |= {f"__missing_{n}": ("sum", value(df, n).isNull().cast("int")) for n in names}
    out = running(df, order, folds)
    for n in names:
        ok = value(df, n).isNotNull() if skipna else F.col(f"__missing_{n}") == 0
        out = out.withColumn(f"{n}{end}", F.when(ok, F.col(f"{n}{end}")))
    return out.select(*df.columns, *[f"{n}{end}" for n in names])


def cumulative_rows(df: DataFrame, op: str, columns: list[str] | None = None, skipna: bool = True, suffix: str | None = None) -> DataFrame:
    """``op`` from left to right over the columns of each row: a prefix expression per column."""
    names, end = columns or numeric_columns(df), suffix if suffix is not None else f"_{op}"
    meet = {"cumsum": lambda a, b: a + b, "cumprod": lambda a, b: a * b, "cummin": F.least, "cummax": F.greatest}[op]
    out, so_far = [], None
    for n in names:
        c = value(df, n).cast("double")
        if so_far is None:
            so_far = c
        elif skipna:
            so_far = F.coalesce(meet(so_far, c), so_far, c)
        else:
            so_far = F.when(so_far.isNotNull() & c.isNotNull(), meet(so_far, c))
        out.append((F.when(c.isNotNull(), so_far) if skipna else so_far).alias(f"{n}{end}"))
    return df.select("*", *out)


def rank(
    df: DataFrame,
    column: str,
    method: str = "average",
    order: list[str] | None = None,
    by: list[str] | None = None,
    na_option: str = "keep",
    ascending: bool = True,
    pct: bool = False,
    into: str = "rank",
) -> DataFrame:
    """Rank of ``column`` (per group of ``by``): average, min, max, dense or first (ties by ``order``).

    Ranks come from the counts of distinct values, not from ordering all rows in
    one window: equal values are counted first (partial aggregation), counts are
    accumulated by ranges of the value, and rows look their value up.  ``first``
    numbers ties within each value.
    """
    if method == "first" and not order:
        raise ValueError("method 'first' needs an order")
    c = value(df, column)
    names = by or []
    if by:
        return _rank_window(df, c, method, order, names, na_option, ascending, pct, into)
    # a missing value has its own place: none, before or behind all others
    counts = df.select(c.alias("__v")).groupBy("__v").agg(F.count("*").alias("__n"))
    present = counts.filter("__v is not null")
    sums = running(present, ["__v"], {"__upto": ("sum", F.col("__n")), "__dense": ("count", F.col("__n"))})
    ends = present.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__all"), F.count("*").alias("__distinct"))
    missing = counts.filter("__v is null").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__missing"))
    held = df.withColumn("__v", c).join(sums.select("__v", "__n", "__upto", "__dense"), "__v", "left").crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(missing))
    if not ascending:
        # what isn't smaller than a value, from what isn't larger: holds for any type that can be ordered
        held = held.withColumns({"__upto": F.col("__all") - F.col("__upto") + F.col("__n"), "__dense": F.col("__distinct") - F.col("__dense") + 1})
    gone = F.col("__v").isNull()
    n = F.when(gone, F.col("__missing")).otherwise(F.col("__n"))
    shift = F.col("__missing") if na_option == "top" else F.lit(0)
    upto = F.when(gone, F.col("__missing") if na_option == "top" else F.col("__all") + F.col("__missing")).otherwise(F.col("__upto") + shift)
    has = F.when(F.col("__missing") > 0, 1).otherwise(0)
    dense = F.when(gone, F.lit(1) if na_option == "top" else F.col("__distinct") + 1).otherwise(F.col("__dense") + (has if na_option == "top" else F.lit(0)))
    if method == "first":
        inside = Window.partitionBy("__v").orderBy(*order)
        r = upto - n + F.row_number().over(inside)
    else:
        r = {"average": upto - (n - 1) / 2, "min": upto - n + 1, "max": upto, "dense": dense}[method]
    size = (F.col("__distinct") if method == "dense" else F.col("__all")) + (F.lit(0) if na_option == "keep" else (has if method == "dense" else F.col("__missing")))
    r = r.cast("double")
    r = r / F.nullif(size, F.lit(0)) if pct else r
    r = F.when(~gone, r) if na_option == "keep" else r
    return held.select(*df.columns, r.alias(into))


def _rank_window(df, c, method, order, by, na_option, ascending, pct, into):
    key = F.when(c.isNull(), F.lit(1 if na_option != "top" else -1)).otherwise(F.lit(0))
    held = df.withColumn("__v", c).withColumn("__k", key)
    value_order = F.col("__v").asc() if ascending else F.col("__v").desc()
    w = Window.partitionBy(*by).orderBy("__k", value_order)
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, "__k", "__v"))
    whole = Window.partitionBy(*by)
    if method == "first":
        r = F.row_number().over(Window.partitionBy(*by).orderBy("__k", value_order, *order))
    elif method == "dense":
        r = F.dense_rank().over(w)
    else:
        r = F.rank().over(w) + {"min": F.lit(0), "max": peers - 1, "average": (peers - 1) / 2}[method]
    ranked = held.withColumn("__r", r.cast("double"))
    used = F.when(F.col("__v").isNotNull() | F.lit(na_option != "keep"), F.col("__r"))
    size = F.max(used).over(whole) if method == "dense" else F.count(used).over(whole)
    return ranked.select(*df.columns, (used / size if pct else used).alias(into))


def rank_rows(df: DataFrame, columns: list[str] | None = None, method: str = "average", ascending: bool = True, suffix: str = "_rank") -> DataFrame:
    """Rank of each value among the row's values."""
    names = columns or numeric_columns(df)
    held = df.withColumn("__row", F.array_compact(F.array(*[value(df, n).cast("double") for n in names])))
    out = {}
    for n in names:
        c = value(df, n).cast("double")
        before = F.size(F.filter("__row", lambda v: (v < c) if ascending else (v > c)))
        same = F.size(F.filter("__row", lambda v: v == c))
        dense = F.size(F.array_distinct(F.filter("__row", lambda v: (v < c) if ascending else (v > c)))) + 1
        r = {"average": before + (same + 1) / 2, "min": before + 1, "max": before + same, "dense": dense}[method]
        out[f"{n}{suffix}"] = F.when(c.isNotNull(), r.cast("double"))
    return held.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def pct_change(df: DataFrame, order: list[str], by: list[str], columns: list[str] | None = None, periods: int = 1, fill: bool = True, limit: int | None = None, suffix: str = "_pct") -> DataFrame:
    """x(t) / x(t - periods) - 1 after filling forward (at most ``limit`` rows); after a zero infinite, or NaN from zero to zero."""
    names = columns or numeric_columns(df, (*order, *by))
    w = Window.partitionBy(*by).orderBy(*order)
    back = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    filled = df.withColumns({f"__f_{n}": F.last(value(df, n), True).over(back) if fill else value(df, n) for n in names})
    kept = filled.withColumns({f"__b_{n}": F.lag(f"__f_{n}", periods).over(w) for n in names})
    return kept.select(*df.columns, *[(_ratio(kept, f"__f_{n}", f"__b_{n}") - 1).alias(f"{n}{suffix}") for n in names])


def _ratio(df: DataFrame, a: str, b: str) -> Column:
    """a / b as floating-point numbers divide, where Spark has NULL or an error for a zero; decimals, which have no infinity, give NULL."""
    over = F.try_divide(a, b)
    if isinstance(df.schema[a].dataType, T.DecimalType):
        return over
    infinite = F.when(F.col(b).cast("double").cast("string") == "-0.0", F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(F.col(b) == 0, F.col(a).cast("double") * infinite).otherwise(over)


def filled(df: DataFrame, order: list[str], by: list[str], columns: list[str], method: str = "ffill", limit: int | None = None) -> DataFrame:
    """Missing values replaced by the last (``ffill``) or next (``bfill``) known one."""
    w = Window.partitionBy(*by).orderBy(*order)
    back = method == "ffill"
    frame = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0) if back else w.rowsBetween(0, Window.unboundedFollowing if limit is None else limit)
    f: Column = F.last if back else F.first
    return df.withColumns({n: f(value(df, n), True).over(frame) for n in columns})
