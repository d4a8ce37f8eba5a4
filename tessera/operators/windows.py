"""Rolling, expanding and weighted windows, plain and per group.

A window is declared once (``Frame``) and turned into a Spark window per call:
row frames for integer sizes, range frames over microseconds for durations.
Without group keys the ordered rows are cut into blocks that also hold the rows
their frames reach into, and each block is a group of its own.  Results need ``min_periods`` values in the frame and are NULL with fewer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.aggregates import aggregate, pick
from ..functions.missing import numeric_columns, value
from ..plans.ordered import running

#: Rows of a block of an ordered table without group keys, at least; a block of a duration spans ``SPANS`` durations.
BLOCK, SPANS = 1 << 16, 4
HELPERS = ("__n", "__t", "__home", "__block")
#: Sums of powers that an aggregate of all rows so far is made of.
POWERS = {"var": 2, "std": 2, "sem": 2, "skew": 3, "kurt": 4}
#: Folds that add up, and those that an aggregate over a duration is made of.
PARTS = {
    "c": F.count, "t": F.sum, "l": F.min, "g": F.max, "m": lambda c: F.avg(c.cast("double")),
    "v": lambda c: F.var_pop(c.cast("double")), "s": lambda c: F.skewness(c.cast("double")), "k": lambda c: F.kurtosis(c.cast("double")),
}
NEEDED = {"sum": "ct", "mean": "ct", "min": "cl", "max": "cg", "var": "clgmv", "std": "clgmv", "sem": "clgmv", "skew": "clgmvs", "kurt": "clgmvsk"}
FROM_START = {*POWERS, "mean", "sum", "min", "max", "count", "prod"}
OPS = ("mean", "sum", "min", "max", "std", "var", "median", "skew", "kurt", "sem", "quantile", "rank", "count", "nunique", "prod")


@dataclass(frozen=True)
class Frame:
    """``size`` rows, or a ``duration`` in microseconds over the timestamp ``on``; neither: all rows up to the current one.

    ``order`` must end in a unique key.  ``by`` are the group keys; without them
    all rows are one ordered sequence.  Only frames of all rows so far whose
    aggregate doesn't add up (median, quantile, rank, distinct values, a user's
    function) then take a single partition.
    """

    order: tuple[str, ...]
    by: tuple[str, ...] = ()
    size: int | None = None
    duration: int | None = None
    on: str | None = None
    min_periods: int | None = None
    center: bool = False
    closed: str = "right"
    step: int = 1
    weights: tuple[float, ...] = field(default=())

    @property
    def least(self) -> int:
        if self.min_periods is not None:
            return self.min_periods
        return self.size if self.size is not None else 1

    @property
    def bounded(self) -> bool:
        return self.size is not None or self.duration is not None

    def rows(self) -> WindowSpec:
        if self.duration is not None:
            raise ValueError("a duration has no number of rows")
        w = Window.partitionBy(*self.by).orderBy(*self.order)
        return w.rowsBetween(*self.bounds()) if self.size is not None else w.rowsBetween(Window.unboundedPreceding, 0)

    def bounds(self) -> tuple[int, int]:
        """First and last row of the frame, counted from the current one."""
        shift = (self.size - 1) // 2 if self.center else 0
        low, high = shift - (self.size - 1), shift
        if self.closed in ("both", "left"):
            low -= 1
        if self.closed in ("left", "neither"):
            high -= 1
        return low, high

    def spans(self) -> list[WindowSpec]:
        """The Spark windows, over ``__t``, that make up a duration: strictly earlier times within reach and the same time up to the current row; centred, one."""
        by, reach = Window.partitionBy(*self.by), self.duration
        if self.center:
            half = reach // 2
            return [by.orderBy("__t").rangeBetween(-half + (self.closed not in ("both", "left")), half - (self.closed not in ("both", "right")))]
        past = by.orderBy("__t").rangeBetween(-reach if self.closed in ("both", "left") else -(reach - 1), -1)
        peers = Window.partitionBy(*self.by, "__t").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        return [past, peers] if self.closed in ("right", "both") else [past]

    def timed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__t", F.unix_micros(F.col(self.on).cast("timestamp")))


def rolling(order, size=None, duration=None, by=(), **kw) -> Frame:
    """A moving window of ``size`` rows or of a ``duration`` ('2h', '30min', '1d' or microseconds) over ``on``."""
    return Frame(tuple(order), tuple(by), size, microseconds(duration) if duration is not None else None, **kw)


def expanding(order, by=(), min_periods: int = 1) -> Frame:
    return Frame(tuple(order), tuple(by), min_periods=min_periods)


def microseconds(duration) -> int:
    return duration if isinstance(duration, int) else int(pd.Timedelta(duration) / pd.Timedelta(microseconds=1))


def _dealt(df: DataFrame, frame: Frame) -> DataFrame:
    """Rows in blocks of the order (``__block``, by place or time), copied to a neighbour where its frames reach them; ``__home`` is a row's own block."""
    held = df
    if frame.duration is None or frame.step > 1:
        held = running(df, list(frame.order), {"__n": ("count", F.lit(1))}).withColumn("__n", F.col("__n") - 1)
    if frame.duration is not None:
        held, at = frame.timed(held), "__t"
        before, after = (frame.duration // 2,) * 2 if frame.center else (frame.duration, 0)
        width = SPANS * frame.duration
    else:
        low, high = frame.bounds()
        at, before, after = "__n", max(0, -low), max(0, high)
        width = max(BLOCK, before + after)
    inside = F.pmod(F.col(at), F.lit(width))
    home = F.col(at) - inside
    blocks = F.array(home, F.when(inside >= width - before, home + width), F.when(inside < after, home - width))
    # rows without a time stay, as a block of their own
    return held.withColumn("__home", home).withColumn("__block", F.explode_outer(F.array_compact(blocks)))


def in_blocks(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``run(df, frame, ...)`` with blocks for group keys where a bounded frame has none."""

    @wraps(run)
    def dealt(df: DataFrame, frame: Frame, *args, **kwargs) -> DataFrame:
        if frame.by or not frame.bounded:
            return run(df, frame, *args, **kwargs)
        found = run(_dealt(df, frame), replace(frame, by=("__block",), step=1), *args, **kwargs)
        found = found.filter(F.col("__home").eqNullSafe(F.col("__block")))
        if frame.step > 1:
            found = found.filter(F.col("__n") % frame.step == 0)
        return found.drop(*HELPERS)

    return dealt


def _from_start(df: DataFrame, frame: Frame, out: dict, ddof: int) -> DataFrame:
    """Frames of all rows so far, from running counts, extremes and sums of powers about the columns' means (one row)."""
    names = sorted({n for n, _ in out.values()})
    centre = df.agg(*[F.avg(value(df, n)).cast("double") for n in names]).first()
    folds, made = {"__rows": ("count", F.lit(1))}, {}
    for i, n in enumerate(names):
        c, asked = value(df, n), {o for m, o in out.values() if m == n}
        powers = max(POWERS.get(o, 0) for o in asked)
        off = (c - F.lit(centre[i])).cast("double")
        folds |= {f"__c{i}": ("count", c)} | {f"__p{i}_{k}": ("sum", F.pow(off, F.lit(float(k)))) for k in range(1, powers + 1)}
        folds |= {f"__{o}{i}": (o, c) for o in ("min", "max") if o in asked or powers}
        folds |= {f"__sum{i}": ("sum", c)} if asked & {"sum", "mean"} else {}
        folds |= {f"__prod{i}": ("prod", c.cast("double"))} if "prod" in asked else {}
    held = running(df, list(frame.order), folds)
    for name, (n, o) in out.items():
        i = names.index(n)
        count = F.col(f"__c{i}")
        v = count if o == "count" else _moment(o, i, count, ddof) if o in POWERS else F.col(f"__sum{i}") / F.nullif(count, F.lit(0)) if o == "mean" else F.col(f"__{o}{i}")
        made[name] = F.when((F.col("__rows") if o == "count" else count) >= max(frame.least, o != "count"), v)
    return held.withColumns(made).select(*df.columns, *made)


def _moment(o: str, i: int, count: Column, ddof: int) -> Column:
    n = F.nullif(count.cast("double"), F.lit(0.0))
    e = [F.lit(1.0), *[F.col(f"__p{i}_{k}") / n for k in range(1, POWERS[o] + 1)]]
    flat = F.col(f"__min{i}") == F.col(f"__max{i}")
    m2 = F.greatest(e[2] - e[1] * e[1], F.lit(0.0))
    m3 = e[3] - 3 * e[1] * e[2] + 2 * F.pow(e[1], F.lit(3.0)) if POWERS[o] > 2 else None
    m4 = e[4] - 4 * e[1] * e[3] + 6 * e[1] * e[1] * e[2] - 3 * F.pow(e[1], F.lit(4.0)) if POWERS[o] > 3 else None
    return _of_moments(o, count, flat, m2, m3, m4, ddof)


def _of_moments(o: str, count: Column, flat: Column, m2: Column, m3: Column | None, m4: Column | None, ddof: int) -> Column:
    """A statistic from means of powers about the mean; ``flat`` where all values are equal."""
    n = F.nullif(count.cast("double"), F.lit(0.0))
    m2 = F.when(flat, 0.0).otherwise(m2)
    if o in ("var", "std", "sem"):
        over = F.when(count > ddof, m2 * n / F.nullif(n - ddof, F.lit(0.0)))
        if o == "sem":
            return F.when(count > ddof, F.sqrt(F.when(count > 1, m2 * n / F.nullif(n - 1, F.lit(0.0))) / F.nullif(n - ddof, F.lit(0.0))))
        return F.sqrt(over) if o == "std" else over
    if o == "skew":
        v = F.try_divide(m3, F.pow(m2, F.lit(1.5))) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
        return F.when(count >= 3, F.when(flat, 0.0).otherwise(v))
    v = ((n + 1) * (F.try_divide(m4, m2 * m2) - 3) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(count >= 4, F.when(flat, -3.0).otherwise(v))


def _rank(c: Column, w: WindowSpec, method: str = "average", ascending: bool = True, pct: bool = False) -> Column:
    """Rank of the frame's last value within the frame."""
    values = F.collect_list(c).over(w)
    before = F.size(F.filter(values, lambda v: (v < c) if ascending else (v > c)))
    same = F.size(F.filter(values, lambda v: v == c))
    r = {"average": before + (same + 1) / 2, "min": before + 1, "max": before + same}[method]
    r = F.when(c.isNotNull(), r.cast("double"))
    return r / F.size(values) if pct else r


def _one(op: str, c: Column, w: WindowSpec, options: dict) -> Column:
    if op == "rank":
        return _rank(c, w, **options)
    if op == "sem":
        return aggregate("sem", c, w, rolling=True, **options)
    if op == "kurt":
        return aggregate("kurt", c, w, constant=-3.0)
    if op == "sum":
        return F.sum(c).over(w)
    return aggregate(op, c, w, **options)


@in_blocks
def roll(df: DataFrame, frame: Frame, op, columns: list[str] | None = None, suffix: str | None = None, **options) -> DataFrame:
    """``df`` with ``op`` over the frame for each column: a name, a list of names, or ``{column: names}``."""
    names = columns or numeric_columns(df, (*frame.order, *frame.by, *HELPERS))
    asked = op if isinstance(op, dict) else {n: op for n in names}
    out = {}
    held = df
    for k in frame.by:
        if k not in HELPERS:
            held = held.filter(value(df, k).isNotNull())
    for n, ops in asked.items():
        for o in ops if isinstance(ops, (list, tuple)) else [ops]:
            end = suffix if suffix is not None else f"_{o}"
            out[f"{n}{end}"] = (n, o)
    if not frame.by and not frame.bounded and frame.step == 1 and {o for _, o in out.values()} <= FROM_START and set(options) <= {"ddof"}:
        return _from_start(held, frame, out, options.get("ddof", 1))
    if frame.duration is not None:
        return _stepped(_over_time(held, frame, out, options), frame, df.columns, list(out))
    w = frame.rows()
    # a count asks for so many rows, all else for so many values
    enough = lambda n, o: F.count(F.lit(1) if o == "count" else value(df, n)).over(w) >= max(frame.least, o != "count")
    made = {name: F.when(enough(n, o), _one(o, value(df, n), w, options)) for name, (n, o) in out.items()}
    return _stepped(held.withColumns(made), frame, df.columns, list(out))


def _stepped(df: DataFrame, frame: Frame, columns: list[str], made: list[str]) -> DataFrame:
    if frame.step == 1:
        return df.select(*columns, *made)
    at = F.row_number().over(Window.partitionBy(*frame.by).orderBy(*frame.order))
    return df.withColumn("__at", at).filter((F.col("__at") - 1) % frame.step == 0).select(*columns, *made)


def _over_time(df: DataFrame, frame: Frame, out: dict, options: dict) -> DataFrame:
    """Duration frames. Rows that tie with the current one but come later stay out, which a range frame alone would let in.

    What adds up is folded in two parts of the frame, which meet; for the rest
    (median, quantile, rank, distinct values, product) the frame is collected.
    """
    held, names = frame.timed(df), sorted({n for n, _ in out.values()})
    folds = {f"__{k}{names.index(n)}": (PARTS[k], n) for n, o in out.values() for k in NEEDED.get(o, "c")}
    if frame.center:
        held, sides = held.withColumns({f"{k}_0": f(value(df, n)).over(frame.spans()[0]) for k, (f, n) in folds.items()}), (0,)
    else:
        held, sides = _sides(held, frame, folds), (0, 1)
    powers = {names.index(n): max(POWERS.get(o, 0) for m, o in out.values() if m == n) for n in names}
    held = _moments(held, {i: most for i, most in powers.items() if most}, sides)
    made = {}
    for name, (n, o) in out.items():
        i = names.index(n)
        both = lambda k: [F.col(f"__{k}{i}_{j}") for j in sides]  # noqa: B023, E731
        count = _total(both("c"))
        if o == "count":
            made[name] = count
            continue
        if o in ("sum", "mean"):
            total = _total(both("t"))
            v = total if o == "sum" else total / F.nullif(count, F.lit(0))
        elif o in ("min", "max"):
            v = F.array_min(F.array(*both("l"))) if o == "min" else F.array_max(F.array(*both("g")))
        elif o in POWERS:
            v = _of_moments(o, count, F.col(f"__flat{i}"), *[F.col(f"__mean{i}_{k}") if k <= powers[i] else None for k in (2, 3, 4)], options.get("ddof", 1))
        else:
            from .reduce import row_expression

            c = value(df, n)
            values = F.concat(*[F.collect_list(c).over(w) for w in frame.spans()]).cast("array<double>")
            v = _list_op(o, values, c, row_expression, options)
        made[name] = F.when(count >= frame.least, v)
    return held.withColumns(made)


def _sides(df: DataFrame, frame: Frame, folds: dict[str, tuple[Callable, str]]) -> DataFrame:
    """``df`` with each fold over two parts of its frame: in the cell before (``_0``) and in the row's own cell (``_1``).

    Time is cut into cells as long as the duration, so that a frame is the end
    of one cell and the start of the next one up to the current row.  Both are
    running folds, one of them backwards, and the work doesn't grow with the
    rows in a frame.  Where a frame starts, a row without values is put into
    the cell before; the current row gets what was folded there.
    """
    values = {n: f"__x{i}" for i, n in enumerate(sorted({n for _, n in folds.values()}))}
    t, reach, from_start = F.col("__t"), F.lit(frame.duration), Window.unboundedPreceding
    end = lambda back, start: F.struct((F.col("__own") - back).alias("cell"), (t - back).alias("at"), F.lit(start).alias("start"))
    # dealt by the group before rows double, which serves all windows of its cells
    held = df.repartition(*frame.by).withColumns({"__own": t - F.pmod(t, reach), **{x: value(df, n) for n, x in values.items()}})
    held = held.withColumn("__end", F.explode(F.array_compact(F.array(end(F.lit(0), False), F.when(t.isNotNull(), end(reach, True))))))
    start, kept = F.col("__end.start"), {*frame.by, *frame.order, "__t", "__own", "__end"}
    held = held.withColumns({n: F.when(~start, F.col(f"`{n}`")) for n in held.columns if n not in kept})
    # backwards in time; a closed start comes after the rows of its own time
    back = Window.partitionBy(*frame.by, "__end.cell").orderBy(F.col("__end.at").desc(), start.asc() if frame.closed in ("both", "left") else start.desc()).rowsBetween(from_start, 0)
    held = held.withColumns({f"{k}_0": f(F.col(values[n])).over(back) for k, (f, n) in folds.items()})
    own = Window.partitionBy(*frame.by, "__own")
    upto = last = own.orderBy("__t", *frame.order, start.desc()).rowsBetween(from_start, 0)
    if frame.closed in ("left", "neither"):
        upto = own.orderBy("__t").rangeBetween(from_start, -1)
    before = F.last(F.when(start, F.struct(*[f"{k}_0" for k in folds])), True).over(last)
    held = held.withColumns({"__before": before, **{f"{k}_1": f(F.col(values[n])).over(upto) for k, (f, n) in folds.items()}}).filter(~start)
    return held.withColumns({f"{k}_0": F.col(f"__before.{k}_0") for k in folds})


def _moments(df: DataFrame, powers: dict[int, int], sides: tuple[int, ...]) -> DataFrame:
    """``df`` with, for each column i, means of powers about its mean (``__mean{i}_2`` to ``_4``) and whether all values are equal (``__flat{i}``), of all sides together.

    Each side's are Spark's aggregates about the side's own mean; they meet by
    the distance of the means, not as differences of large sums.
    """
    zero, sums, made = F.lit(0.0), {}, {}
    for i, most in powers.items():
        for j in sides:
            n, m, v, s, k = (F.col(f"__{x}{i}_{j}") for x in "cmvsk")
            # a side of equal values has no skewness, one without values nothing
            found = [n.cast("double"), m, v * n, *([s * F.pow(v, F.lit(1.5)) * n] if most > 2 else []), *([(k + 3) * v * v * n] if most > 3 else [])]
            sums |= {f"__sum{i}_{j}_{p}": F.coalesce(x, zero) for p, x in enumerate(found)}
    held = df.withColumns(sums) if sums else df
    for i, most in powers.items():
        a, b = ([F.col(f"__sum{i}_{j}_{p}") if j in sides else zero for p in range(5)] for j in (0, 1))
        n = F.nullif(a[0] + b[0], zero)
        # shares of the sides, and how far their means are apart
        p, q, d = a[0] / n, b[0] / n, F.when((a[0] > 0) & (b[0] > 0), b[1] - a[1]).otherwise(0.0)
        low, high = F.array_min(F.array(*[F.col(f"__l{i}_{j}") for j in sides])), F.array_max(F.array(*[F.col(f"__g{i}_{j}") for j in sides]))
        made[f"__flat{i}"] = high.cast("double") - low.cast("double") == 0
        made[f"__mean{i}_2"] = (a[2] + b[2]) / n + d * d * p * q
        if most > 2:
            made[f"__mean{i}_3"] = (a[3] + b[3]) / n + d * d * d * p * q * (p - q) + 3 * d * (p * b[2] - q * a[2]) / n
        if most > 3:
            made[f"__mean{i}_4"] = (a[4] + b[4]) / n + d * d * d * d * p * q * (p * p - p * q + q * q) + 6 * d * d * (p * p * b[2] + q * q * a[2]) / n + 4 * d * (p * b[3] - q * a[3]) / n
    return held.withColumns(made) if made else held


def _total(parts: list[Column]) -> Column:
    """Sum of what each window gives, an empty one nothing."""
    return sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))


def _list_op(op: str, values: Column, c: Column, expression, options: dict) -> Column:
    if op == "rank":
        before, same = F.size(F.filter(values, lambda v: v < c)), F.size(F.filter(values, lambda v: v == c))
        return F.when(c.isNotNull(), before + (same + 1) / 2)
    if op == "quantile":
        return pick(F.sort_array(values), options.get("q", 0.5), options.get("interpolation", "linear"))
    return expression(op, values, **({"ddof": options["ddof"]} if "ddof" in options else {}))


@in_blocks
def roll_cov(df: DataFrame, frame: Frame, a: str, b: str, into: str = "cov", ddof: int = 1, correlate: bool = False) -> DataFrame:
    """Covariance (or correlation) of two columns over the frame, of the rows that have both."""
    if frame.duration is not None:
        return _cov_over_time(df, frame, a, b, into, ddof, correlate)
    w = frame.rows()
    x, y = F.when(value(df, b).isNotNull(), value(df, a)), F.when(value(df, a).isNotNull(), value(df, b))
    n = F.count(x).over(w)
    cov = F.covar_pop(x, y).over(w)
    if correlate:
        v = F.try_divide(cov, F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
    else:
        v = cov * n / F.nullif(n - ddof, F.lit(0))
    return df.withColumn(into, F.when(n >= frame.least, v))


def _cov_over_time(df: DataFrame, frame: Frame, a: str, b: str, into: str, ddof: int, correlate: bool) -> DataFrame:
    """From counts, sums and sums of products about the group's means, which add up over the parts of a duration."""
    whole = Window.partitionBy(*frame.by)
    x, y = F.when(value(df, b).isNotNull(), value(df, a)), F.when(value(df, a).isNotNull(), value(df, b))
    held = frame.timed(df).withColumns({"__x": (x - F.avg(x).over(whole)).cast("double"), "__y": (y - F.avg(y).over(whole)).cast("double")})
    add = lambda c: _total([F.sum(c).over(w) for w in frame.spans()])
    sums = {"__n": add((F.col("__x") * 0 + 1)), "__sx": add(F.col("__x")), "__sy": add(F.col("__y")), "__sxy": add(F.col("__x") * F.col("__y")), "__sxx": add(F.col("__x") ** 2), "__syy": add(F.col("__y") ** 2)}
    held, n = held.withColumns(sums), F.nullif(F.col("__n"), F.lit(0.0))
    about = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / n
    if correlate:
        v = F.try_divide(about("__sx", "__sy", "__sxy"), F.sqrt(about("__sx", "__sx", "__sxx") * about("__sy", "__sy", "__syy")))
    else:
        v = about("__sx", "__sy", "__sxy") / F.nullif(n - ddof, F.lit(0.0))
    return held.withColumn(into, F.when(F.col("__n") >= frame.least, v)).select(*df.columns, into)


@in_blocks
def roll_apply(df: DataFrame, frame: Frame, func: Callable, column: str, into: str, raw: bool = False, args: tuple = (), **kwargs) -> DataFrame:
    """A user's function (Series, or array with ``raw``, to a number) of the frame's values."""

    def run(s: pd.Series) -> float:
        s = s.dropna()
        return float(func(s.to_numpy() if raw else s, *args, **kwargs)) if len(s) else None

    c = value(df, column)
    if frame.duration is not None:
        each = F.pandas_udf(lambda lists: lists.map(lambda x: run(pd.Series(x, dtype="float64"))).astype("float64"), "double")
        values = F.concat(*[F.collect_list(c.cast("double")).over(w) for w in frame.spans()])
        made = frame.timed(df).withColumn("__list", values).withColumn(into, each("__list"))
        return made.withColumn(into, F.when((F.size("__list") >= max(1, frame.least)) & ~F.isnan(into), F.col(into))).select(*df.columns, into)
    w = frame.rows()
    udaf = F.pandas_udf(run, "double", F.PandasUDFType.GROUPED_AGG)
    made = df.withColumn("__v", c.cast("double")).withColumn("__n", F.count("__v").over(w)).withColumn(into, udaf("__v").over(w))
    return made.withColumn(into, F.when(F.col("__n") >= frame.least, F.col(into))).select(*df.columns, into)


def weights(kind: str, n: int, **options: float) -> tuple[float, ...]:
    """Symmetric window weights by name."""
    if n == 1:
        return (1.0,)
    i = np.arange(n)
    x = (2 * i - (n - 1)) / (n - 1)
    turn = 2 * np.pi * i / (n - 1)
    cosines = {  # fixed values: coefficients of alternating cosine sums
        "hann": (0.5, 0.5),
        "hamming": (0.54, 0.46),
        "blackman": (0.42, 0.5, 0.08),
        "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
        "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
        "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
    }
    if kind in cosines:
        w = sum((-1) ** k * a * np.cos(k * turn) for k, a in enumerate(cosines[kind]))
    elif kind == "boxcar":
        w = np.ones(n)
    elif kind == "triang":
        w = 1 - np.abs(2 * i - (n - 1)) / (n + n % 2)
    elif kind == "bartlett":
        w = 1 - np.abs(x)
    elif kind == "cosine":
        w = np.sin(np.pi * (i + 0.5) / n)
    elif kind == "parzen":
        y = np.abs(2 * i - (n - 1)) / n
        w = np.where(y <= 0.5, 1 - 6 * y**2 * (1 - y), 2 * (1 - y) ** 3)
    elif kind == "bohman":
        y = np.abs(x)
        w = (1 - y) * np.cos(np.pi * y) + np.sin(np.pi * y) / np.pi
        w[[0, -1]] = 0
    elif kind == "barthann":
        y = np.abs(i / (n - 1) - 0.5)
        w = 0.62 - 0.48 * y + 0.38 * np.cos(2 * np.pi * y)
    elif kind == "gaussian":
        w = np.exp(-0.5 * ((i - (n - 1) / 2) / options["std"]) ** 2)
    elif kind == "general_gaussian":
        w = np.exp(-0.5 * np.abs((i - (n - 1) / 2) / options["sig"]) ** (2 * options["p"]))
    elif kind == "exponential":
        w = np.exp(-np.abs(i - (n - 1) / 2) / options.get("tau", 1.0))
    elif kind == "kaiser":
        w = np.i0(options["beta"] * np.sqrt(np.maximum(0, 1 - x**2))) / np.i0(options["beta"])
    elif kind == "tukey":
        a = options.get("alpha", 0.5)
        edge = np.minimum(i, n - 1 - i) / (n - 1)
        w = np.where(edge < a / 2, 0.5 * (1 - np.cos(2 * np.pi * edge / a)), 1.0) if a > 0 else np.ones(n)
    else:
        raise ValueError(f"Unknown window {kind!r}")
    return tuple(map(float, w))


@in_blocks
def roll_weighted(df: DataFrame, frame: Frame, op: str, column: str, into: str, ddof: int = 1) -> DataFrame:
    """``mean sum std var`` of the frame's values times ``frame.weights`` (as many as rows, so not of a duration). Missing values count nothing.

    The frame's rows are collected with their places (it has ``size`` of them at
    most) and weighted by array expressions.
    """
    w, c = frame.rows(), value(df, column).cast("double")
    n = len(frame.weights)
    place = Window.partitionBy(*frame.by).orderBy(*frame.order)
    shift = (n - 1) // 2 if frame.center else 0
    held = df.withColumn("__i", F.row_number().over(place)).withColumn("__v", c)
    held = held.withColumn("__rows", F.collect_list(F.struct("__i", "__v")).over(w))
    ws = F.array(*map(F.lit, frame.weights))
    # the last row of a full frame has the last weight
    terms = F.transform("__rows", lambda r: F.struct(r["__v"].alias("x"), F.element_at(ws, (r["__i"] - F.col("__i") - shift + n).cast("int")).alias("w")))
    held = held.withColumn("__terms", F.filter(terms, lambda t: t["x"].isNotNull()))
    add = lambda f: F.aggregate("__terms", F.lit(0.0), lambda s, t: s + f(t))
    count, weight = F.size("__terms"), add(lambda t: t["w"])
    total = add(lambda t: t["w"] * t["x"])
    held = held.withColumn("__m", F.try_divide(total, weight))
    var = F.try_divide(add(lambda t: t["w"] * F.pow(t["x"] - F.col("__m"), F.lit(2.0))) * count, F.nullif((count - ddof) * weight, F.lit(0.0)))
    v = {"sum": total, "mean": F.col("__m"), "var": var, "std": F.sqrt(var)}[op]
    return held.withColumn(into, F.when(count >= frame.least, v)).select(*df.columns, into)
