"""Exponentially weighted mean, sum, variance and deviation, per group or of a whole ordered table.

A recurrence over ordered rows, so each group's column goes to one Arrow call,
in O(n).  Of a whole table the adjusted sums add up: parts of the order are
folded each on its own and take over what earlier parts left, faded.  ``ewm_native`` folds short groups inside the JVM instead.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.missing import value
from ..plans.ordered import parted


def decay(com: float | None = None, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> float:
    """The smoothing factor alpha from any one of the four parameters."""
    given = [x for x in (com, span, halflife, alpha) if x is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of com, span, halflife, alpha")
    if com is not None:
        return 1 / (1 + com)
    if span is not None:
        return 2 / (span + 1)
    return alpha if alpha is not None else 1 - math.exp(-math.log(2) / halflife)


def ewm(
    df: DataFrame,
    op: str,
    order: list[str],
    columns: list[str],
    by: list[str] = (),
    min_periods: int = 0,
    adjust: bool = True,
    ignore_na: bool = False,
    bias: bool = False,
    times: str | None = None,
    suffix: str | None = None,
    **decayed,
) -> DataFrame:
    """``op`` (``mean sum std var``) down the rows in ``order``; ``times`` decays by time with a ``halflife`` duration.

    Without ``by`` the rows are one sequence, in parts; only there, with
    ``times`` or without ``adjust``, one task takes them all.
    """
    end = suffix if suffix is not None else f"_ewm_{op}"
    if not by and adjust and times is None:
        return _whole(df, op, list(order), list(columns), end, max(1, min_periods), ignore_na, bias, 1 - decay(**decayed))
    held = df
    for k in by:
        held = held.filter(value(df, k).isNotNull())
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, {', '.join(f'`{n}{end}` double' for n in columns)}"
    options = {"min_periods": min_periods, "adjust": adjust, "ignore_na": ignore_na, **decayed}
    extra = {"bias": bias} if op in ("std", "var") else {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        more = {"times": pd.to_datetime(pdf[times])} if times else {}
        window = pdf[columns].astype("float64").ewm(**options, **more)
        made = getattr(window, op)(**extra)
        return pdf.assign(**{f"{n}{end}": made[n] for n in columns})

    return held.groupBy(*(by or [F.lit(0)])).applyInPandas(run, schema)


def _sums(pdf: pd.DataFrame, columns: list[str], centre: list[float], g: float, ignore_na: bool, state: np.ndarray) -> np.ndarray:
    """Per column and row: weights, values, squared values and squared weights so far, the number of values, and the state to go on from (last row)."""
    out = np.empty((len(columns), 5, len(pdf)))
    for i, n in enumerate(columns):
        v = pdf[n].astype("float64").reset_index(drop=True)
        seen = v.notna()
        x, one = v - centre[i], v.where(~seen, 1.0)
        age = seen.cumsum().to_numpy() if ignore_na else np.arange(1, len(v) + 1)
        for j, (part, fade) in enumerate(((one, g), (x, g), (x * x, g), (one, g * g))):
            # nothing is left of what came before where every value has weight 1 alone
            here = part.ewm(alpha=1 - fade, adjust=True, ignore_na=ignore_na).sum().fillna(0.0).to_numpy() if fade > 0 else part.fillna(0.0).to_numpy()
            out[i, j] = here + state[i, j] * fade**age
        out[i, 4] = state[i, 4] + seen.cumsum().to_numpy()
    return out


def _whole(df: DataFrame, op: str, order: list[str], columns: list[str], end: str, least: int, ignore_na: bool, bias: bool, g: float) -> DataFrame:
    """Two passes over the sorted parts, batch by batch: what each part leaves (one row a part), then the rows from what came before.

    Missing values so many in a row that all weights before them fade to zero give NULL.
    """
    means = df.agg(*[F.avg(value(df, n)).cast("double") for n in columns]).first()
    centre = [m or 0.0 for m in means] if op in ("std", "var") else [0.0] * len(columns)
    dealt = parted(df, order)
    none = np.zeros((len(columns), 5))

    def leave(batches):
        state, rows, seen, part = none, 0, np.zeros(len(columns)), None
        for pdf in batches:
            if len(pdf):
                part, rows, seen = int(pdf["__part"].iloc[0]), rows + len(pdf), seen + pdf[columns].notna().sum().to_numpy()
                state = _sums(pdf, columns, centre, g, ignore_na, state)[:, :, -1]
        if part is not None:
            yield pd.DataFrame({"part": [part], "rows": [rows], "seen": [seen.tolist()], "state": [state.ravel().tolist()]})

    starts, state = {}, none
    left = dealt.select("__part", *[value(df, n).cast("double").alias(n) for n in columns]).mapInPandas(leave, "part int, rows long, seen array<double>, state array<double>")
    for r in sorted(left.collect()):  # as many as parts
        starts[r["part"]] = state
        age = np.array(r["seen"]) if ignore_na else np.full(len(columns), float(r["rows"]))
        fade = np.stack([g**age, g**age, g**age, (g * g) ** age, np.ones(len(columns))], axis=1)
        state = np.array(r["state"]).reshape(none.shape) + state * fade

    def run(batches):
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = starts[batch.column("__part")[0].as_py()] if now is None else now
            pdf = batch.select(columns).to_pandas()
            sums = _sums(pdf, columns, centre, g, ignore_na, now)
            now = sums[:, :, -1]
            made = {}
            with np.errstate(divide="ignore", invalid="ignore"):
                for n, (w, s, q, ww, k) in zip(columns, sums, strict=True):
                    if op in ("mean", "sum"):
                        y = s / w if op == "mean" else s
                    else:
                        y = np.maximum(q / w - (s / w) ** 2, 0.0)
                        y = np.where(k > 1, y, 0.0) if bias else np.where((k > 1) & (w * w > ww), y * (w * w) / (w * w - ww), np.nan)
                        y = np.sqrt(y) if op == "std" else y
                    made[f"{n}{end}"] = np.where((k >= least) & (w > 0 if op != "sum" else True), y, np.nan)
            kept = [i for i, n in enumerate(batch.schema.names) if n != "__part"]
            arrays = [*(batch.column(i) for i in kept), *(pa.array(y, pa.float64(), from_pandas=True) for y in made.values())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(batch.schema.names[i] for i in kept), *made])

    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, {', '.join(f'`{n}{end}` double' for n in columns)}"
    return dealt.mapInArrow(run, schema)


def ewm_native(df: DataFrame, order: list[str], column: str, by: list[str], into: str, ignore_na: bool = False, **decayed) -> DataFrame:
    """Adjusted mean as a fold over each row's prefix: no Python, but quadratic in a group's length, so for short groups."""
    g = 1 - decay(**decayed)
    c = value(df, column).cast("double")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))

    def step(s, x):
        gone = x["v"].isNull()
        fade = F.when(gone, 1.0 if ignore_na else g).otherwise(g)
        return F.struct((s["n"] * fade + F.coalesce(x["v"], F.lit(0.0))).alias("n"), (s["d"] * fade + F.when(gone, 0.0).otherwise(1.0)).alias("d"))

    made = F.aggregate(F.collect_list(F.struct(c.alias("v"))).over(w), start, step, lambda s: F.try_divide(s["n"], s["d"]))
    return df.withColumn(into, made)
