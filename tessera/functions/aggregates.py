"""Aggregate expressions by name, for whole tables, groups, pivots and window frames.

Every builder takes a NULL-normalised column and returns an aggregate Column;
``over`` puts each Spark aggregate inside it onto a window, so one definition
serves ``groupBy`` and frames alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

Over = Callable[[Column], Column]


def framed(window: WindowSpec | None) -> Over:
    return (lambda c: c.over(window)) if window is not None else (lambda c: c)


def total(c: Column, over: Over, min_count: int = 0) -> Column:
    """Sum; 0 for nothing unless ``min_count`` values are asked for."""
    s = over(F.sum(c))
    return F.coalesce(s, F.lit(0)) if min_count <= 0 else F.when(over(F.count(c)) >= min_count, s)


def product(c: Column, over: Over, min_count: int = 0) -> Column:
    p = F.coalesce(over(F.product(c.cast("double"))), F.lit(1.0))
    return p if min_count <= 0 else F.when(over(F.count(c)) >= min_count, p)


def variance(c: Column, over: Over, ddof: int = 1) -> Column:
    """Sum of squared deviations over count - ddof; NULL where that isn't positive."""
    if ddof == 0:
        return over(F.var_pop(c))
    n = over(F.count(c))
    if ddof == 1:
        return F.when(n > 1, over(F.var_samp(c)))
    return F.when(n > ddof, over(F.var_pop(c)) * n / F.nullif(n - ddof, F.lit(0)))


def deviation(c: Column, over: Over, ddof: int = 1) -> Column:
    return F.sqrt(variance(c, over, ddof))


def standard_error(c: Column, over: Over, ddof: int = 1, rolling: bool = False) -> Column:
    """Deviation over sqrt(n); frames divide the ddof=1 deviation by sqrt(n - ddof), as the rolling definition has it."""
    n = over(F.count(c))
    if rolling:
        return F.when(n > ddof, deviation(c, over, 1) / F.sqrt(F.nullif(n - ddof, F.lit(0))))
    return F.when(n > 0, deviation(c, over, ddof) / F.sqrt(F.nullif(n, F.lit(0))))


def skew(c: Column, over: Over, constant: float = 0.0) -> Column:
    """Bias-corrected skewness; ``constant`` where all values are equal, NULL below three."""
    n = over(F.count(c))
    s = over(F.skewness(c)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when(n >= 3, F.when(over(F.max(c)) == over(F.min(c)), F.lit(constant)).otherwise(s))


def kurt(c: Column, over: Over, constant: float = 0.0) -> Column:
    """Bias-corrected excess kurtosis; ``constant`` where all values are equal, NULL below four."""
    n = over(F.count(c))
    k = ((n + 1) * over(F.kurtosis(c)) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))
    return F.when(n >= 4, F.when(over(F.max(c)) == over(F.min(c)), F.lit(constant)).otherwise(k))


def quantile(c: Column, over: Over, q: float = 0.5, interpolation: str = "linear") -> Column:
    """Exact quantile. ``linear`` is Spark's ``percentile``; the others pick from the sorted values at h = (n - 1) q."""
    if interpolation == "linear":
        return over(F.percentile(c.cast("double"), F.lit(q)))
    return pick(F.sort_array(over(F.collect_list(c))), q, interpolation)


def pick(values: Column, q: float, interpolation: str) -> Column:
    """The quantile of a sorted array without NULLs."""
    h = (F.size(values) - 1) * F.lit(float(q))
    low, high = F.get(values, F.floor(h).cast("int")), F.get(values, F.ceil(h).cast("int"))
    if interpolation == "linear":
        return low + (high - low) * (h - F.floor(h))
    if interpolation == "midpoint":
        return (low + high) / 2
    if interpolation == "nearest":
        return F.get(values, F.rint(h).cast("int"))
    if interpolation not in ("lower", "higher"):
        raise ValueError(f"Unknown interpolation {interpolation!r}")
    return low if interpolation == "lower" else high


def distinct(c: Column, over: Over, dropna: bool = True) -> Column:
    """Distinct values; a frame has no distinct count, so it collects its set."""
    n = F.size(over(F.collect_set(c)))
    return n if dropna else n + F.when(over(F.count(F.lit(1))) > over(F.count(c)), 1).otherwise(0)


def _simple(function: Callable[[Column], Column]):
    return lambda c, over: over(function(c))


AGGREGATES: dict[str, Callable[..., Column]] = {
    "min": _simple(F.min),
    "max": _simple(F.max),
    "mean": _simple(F.avg),
    "count": _simple(F.count),
    "size": lambda c, over: over(F.count(F.lit(1))),
    "sum": total,
    "prod": product,
    "var": variance,
    "std": deviation,
    "sem": standard_error,
    "skew": skew,
    "kurt": kurt,
    "median": partial(quantile, q=0.5),
    "quantile": quantile,
    "nunique": distinct,
    "any": lambda c, over: F.coalesce(over(F.bool_or(c.cast("boolean"))), F.lit(False)),
    "all": lambda c, over: F.coalesce(over(F.bool_and(c.cast("boolean"))), F.lit(True)),
}
ALIASES = {"average": "mean", "product": "prod", "kurtosis": "kurt"}


def aggregate(name: str, c: Column, window: WindowSpec | None = None, **options) -> Column:
    """The aggregate called ``name`` of a NULL-normalised column, optionally over a window."""
    name = ALIASES.get(name, name)
    if name not in AGGREGATES:
        raise ValueError(f"Unknown aggregate {name!r}; known: {', '.join(sorted(AGGREGATES))}")
    if name == "nunique" and window is None:
        n = F.count_distinct(c)
        return n if options.get("dropna", True) else n + F.when(F.count(F.lit(1)) > F.count(c), 1).otherwise(0)
    return AGGREGATES[name](c, framed(window), **options)
