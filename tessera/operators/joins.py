"""Equi-joins with the suffixes, indicator, validation and NULL matching of dataframe merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "cross": "cross"}


def merge(
    left: DataFrame,
    right: DataFrame,
    how: str = "inner",
    on: list[str] | None = None,
    left_on: list[str] | None = None,
    right_on: list[str] | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    indicator: bool = False,
    validate: str | None = None,
    sort: bool = False,
) -> DataFrame:
    """Join ``left`` and ``right``; missing keys match each other.

    No side is forced to be broadcast: Spark does so by size, and beyond that
    shuffles, splitting skewed keys at run time.  ``validate`` (``1:1``, ``1:m``,
    ``m:1``) fails at run time with the number of repeated keys.
    """
    if how not in HOW:
        raise ValueError(f"Unknown join {how!r}")
    lk, rk = left_on or on or [], right_on or on or []
    if how != "cross" and not lk:
        lk = rk = [c for c in left.columns if c in right.columns]
    same = [a for a, b in zip(lk, rk, strict=True) if a == b]
    clash = {c for c in left.columns if c in right.columns} - set(same)
    for side, keys, rule in ((left, lk, ("1:1", "1:m", "one_to_one", "one_to_many")), (right, rk, ("1:1", "m:1", "one_to_one", "many_to_one"))):
        if validate in rule and (n := side.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").count()):
            raise ValueError(f"merge keys aren't unique: {n} of them repeat")
    rename = lambda c, suffix: f"{c}{suffix}" if c in clash else c
    l = left.select(*[F.col(f"`{c}`").alias(f"l_{i}") for i, c in enumerate(left.columns)], F.lit(True).alias("__l"))
    r = right.select(*[F.col(f"`{c}`").alias(f"r_{i}") for i, c in enumerate(right.columns)], F.lit(True).alias("__r"))
    at = lambda df, c, p: F.col(f"{p}_{df.columns.index(c)}")
    if how == "cross":
        both = l.crossJoin(r)
    else:
        condition = reduce(lambda a, b: a & b, [at(left, a, "l").eqNullSafe(at(right, b, "r")) for a, b in zip(lk, rk, strict=True)])
        both = l.join(r, condition, HOW[how])
    out = [(F.coalesce(at(left, c, "l"), at(right, c, "r")) if c in same else at(left, c, "l")).alias(rename(c, suffixes[0])) for c in left.columns]
    out += [at(right, c, "r").alias(rename(c, suffixes[1])) for c in right.columns if c not in same]
    if indicator:
        out.append(F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only").alias("_merge"))
    found = both.select(*out)
    return found.orderBy(*[rename(c, suffixes[0]) for c in lk]) if sort else found
