"""Operators against pandas on the same frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import accumulate as ac
from tessera.operators import correlate as co
from tessera.operators import elementwise as el
from tessera.operators import ewm as ew
from tessera.operators import grouped as gr
from tessera.operators import joins as jo
from tessera.operators import pivot as pv
from tessera.operators import reduce as rd
from tessera.operators import windows as wi

COLS = [f"c{i}" for i in range(4)]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(42)
    frame = pd.DataFrame(rng.standard_normal((120, 4)), columns=COLS)
    frame[COLS[1:]] = frame[COLS[1:]].mask(rng.random((120, 3)) < 0.15)
    frame["c3"] = frame["c3"].round(0)
    frame.insert(0, "row", range(120))
    frame["k"] = rng.integers(0, 5, 120)
    return frame


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).repartition(3).cache()


def same(got, want, digits=9):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert got.shape == want.shape
    np.testing.assert_allclose(got, want, rtol=10**-digits, atol=10**-digits)


def rows(df, *columns):
    return df.orderBy("row").select(*columns).toPandas()


def test_reductions(df, pdf):
    ops = ["min", "max", "mean", "median", "skew", "kurt", "std", "var", "sem", "sum", "prod", "nunique"]
    for op in ops:
        got = {r["column"]: r["value"] for r in rd.reduce_columns(df, op, COLS).collect()}
        same([got[c] for c in COLS], getattr(pdf[COLS], op)())
    got = {r["column"]: r["value"] for r in rd.reduce_columns(df, "mean", COLS, skipna=False).collect()}
    same([got[c] if got[c] is not None else np.nan for c in COLS], pdf[COLS].mean(skipna=False))
    same(rd.reduce_columns(df, "sum", COLS, min_count=110, wide=True).toPandas()[COLS].iloc[0].astype(float), pdf[COLS].sum(min_count=110))
    same(rd.reduce_columns(df, "var", COLS, ddof=2, wide=True).toPandas()[COLS].iloc[0], pdf[COLS].var(ddof=2))


def test_row_reductions(df, pdf):
    for op in ["min", "max", "mean", "median", "skew", "kurt", "std", "var", "sem", "sum", "prod", "nunique"]:
        got = rows(rd.reduce_rows(df, op, COLS), "value")["value"].astype(float)
        same(got, getattr(pdf[COLS], op)(axis=1))
    same(rows(rd.row_quantiles(df, [0.25, 0.9], COLS), "q0", "q1"), pdf[COLS].quantile([0.25, 0.9], axis=1).T)
    for op in ("idxmin", "idxmax"):
        assert rows(rd.row_argext(df, op, COLS), "value")["value"].tolist() == getattr(pdf[COLS], op)(axis=1).tolist()


def test_degenerate_columns(spark):
    table = spark.createDataFrame([(i, 5.0, None, float("nan")) for i in range(5)], "row int, flat double, none double, nan double")
    got = {r["column"]: r["value"] for r in rd.reduce_columns(table, "skew", ["flat", "none", "nan"]).collect()}
    assert got == {"flat": 0.0, "none": None, "nan": None}
    got = {r["column"]: r["value"] for r in rd.reduce_columns(table, "sum", ["none", "nan"]).collect()}
    assert got == {"none": 0.0, "nan": 0.0}
    one = table.limit(1)
    assert {r["value"] for op in ("std", "var", "sem", "skew", "kurt") for r in rd.reduce_columns(one, op, ["flat"]).collect()} == {None}
    assert {r["value"] for r in rd.reduce_columns(table.limit(0), "mean", ["flat"]).collect()} == {None}
    assert {(r["a"], r["value"]) for r in co.correlation(table, "pearson", ["flat", "none"]).filter("a <> b").collect()} == {("flat", None), ("none", None)}


def test_quantiles_modes_describe(df, pdf):
    for how in ("linear", "lower", "higher", "nearest", "midpoint"):
        got = rd.quantiles(df, [0.1, 0.4, 0.77], COLS, how).orderBy("q").toPandas()[COLS]
        same(got, pdf[COLS].quantile([0.1, 0.4, 0.77], interpolation=how))
    want = pdf[["c3"]].mode()["c3"].dropna().tolist()
    assert [float(r["value"]) for r in rd.modes(df, ["c3"]).orderBy("rank").collect()] == want
    got = rd.describe(df, COLS).toPandas().set_index("statistic")
    want = pdf[COLS].describe()
    same(got.loc[want.index, COLS], want)
    for op in ("idxmin", "idxmax"):
        got = {r["column"]: r["label"] for r in rd.argext(df, op, "row", columns=COLS).collect()}
        assert got == getattr(pdf.set_index("row")[COLS], op)().to_dict()
    mad = {r["column"]: r["value"] for r in rd.mean_abs_deviation(df, COLS).collect()}
    same([mad[c] for c in COLS], (pdf[COLS] - pdf[COLS].mean()).abs().mean())
    got = rd.agg(df, ["mean", "max"], COLS).toPandas().set_index("function")[COLS]
    same(got, pdf[COLS].agg(["mean", "max"]))
    same(rows(rd.zscore(df, COLS), *[f"{c}_z" for c in COLS]), (pdf[COLS] - pdf[COLS].mean()) / pdf[COLS].std())


@pytest.mark.parametrize("op", ["cumsum", "cumprod", "cummin", "cummax"])
def test_cumulative(df, pdf, op):
    for skipna in (True, False):
        same(rows(ac.cumulative(df, op, ["row"], columns=COLS, skipna=skipna, suffix="_y"), *[f"{c}_y" for c in COLS]), getattr(pdf[COLS], op)(skipna=skipna))
        want = pdf.groupby("k")[COLS].transform(lambda s: getattr(s, op)(skipna=skipna))
        same(rows(ac.cumulative(df, op, ["row"], ["k"], COLS, skipna=skipna, suffix="_y"), *[f"{c}_y" for c in COLS]), want)
    same(rows(ac.cumulative_rows(df, op, COLS, suffix="_y"), *[f"{c}_y" for c in COLS]), getattr(pdf[COLS], op)(axis=1))


@pytest.mark.parametrize("method", ["average", "min", "max", "dense", "first"])
def test_rank(df, pdf, method):
    for kw in ({}, {"ascending": False}, {"na_option": "top"}, {"na_option": "bottom", "pct": True}, {"pct": True}):
        want = pdf["c3"].rank(method=method, **kw)
        same(rows(ac.rank(df, "c3", method, ["row"], **kw), "rank")["rank"], want)
        want = pdf.groupby("k")["c3"].rank(method=method, **kw)
        same(rows(ac.rank(df, "c3", method, ["row"], ["k"], **kw), "rank")["rank"], want)
    if method != "first":
        same(rows(ac.rank_rows(df, COLS, method), *[f"{c}_rank" for c in COLS]), pdf[COLS].rank(axis=1, method=method))


def test_pct_change_and_fill(df, pdf):
    want = pdf.groupby("k")["c1"].transform(lambda s: s.ffill().pct_change(2, fill_method=None))
    same(rows(ac.pct_change(df, ["row"], ["k"], ["c1"], 2), "c1_pct")["c1_pct"], want)
    same(rows(ac.filled(df, ["row"], ["k"], ["c1"], "bfill", 1), "c1")["c1"], pdf.groupby("k")["c1"].transform(lambda s: s.bfill(limit=1)))


def test_pct_change_after_zero(spark):
    pdf = pd.DataFrame({"row": range(9), "k": 0, "x": [0.0, 0.0, 5.0, 0.0, -3.0, -0.0, 2.0, np.nan, 4.0], "n": [0, 0, 5, 0, -3, 0, 2, 2, 4]})
    df = spark.createDataFrame(pdf).withColumn("d", F.col("n").cast("decimal(9, 2)"))
    got = ac.pct_change(df, ["row"], ["k"], ["x", "n", "d"]).orderBy("row")
    for n in ("x", "n"):
        got_n = [r[0] for r in got.select(f"{n}_pct").collect()]
        want = pdf[n].ffill().pct_change(fill_method=None)
        # zero to zero is NaN, not missing as the first row is
        assert got_n[0] is None and None not in got_n[1:] and np.isnan(got_n[1])
        np.testing.assert_array_equal(got_n[1:], want[1:])
    assert [r[0] is None for r in got.select("d_pct").collect()] == [True, True, True, False, True, False, True, False, False]


def test_correlation(df, pdf):
    for method in ("pearson", "spearman"):
        got = co.correlation(df, method, COLS).toPandas().pivot(index="a", columns="b", values="value")
        same(got.loc[COLS, COLS], pdf[COLS].corr(method))
    x, y = pdf["c2"], pdf["c3"]
    good = x.notna() & y.notna()
    a, b = x[good].to_numpy(), y[good].to_numpy()
    s, t = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    want = (s * t).sum() / np.sqrt((s**2).sum() * (t**2).sum())
    got = {(r["a"], r["b"]): r["value"] for r in co.correlation(df, "kendall", ["c2", "c3"]).collect()}
    same([got["c2", "c3"], got["c3", "c2"], got["c2", "c2"]], [want, want, 1])
    got = {(r["a"], r["b"]): r["value"] for r in co.correlation(df, lambda p, q: float(np.abs(p - q).max()), ["c0", "c1"]).collect()}
    same(got["c0", "c1"], (pdf["c0"] - pdf["c1"]).abs().max())
    assert co.correlation(df, "pearson", ["c0", "c1"], min_periods=119).filter("a <> b").first()["value"] is None
    with pytest.raises(ValueError):
        co.correlation(df, "other", COLS)


def test_groups(df, pdf):
    g = pdf.groupby("k")
    got = gr.group_agg(df, "k", ["mean", "std", "sem", "skew", "median", "nunique"], ["c1"], sort=True).toPandas().set_index("k")
    same(got, g["c1"].agg(["mean", "std", "sem", "skew", "median", "nunique"]))
    got = gr.group_agg(df, "k", order=["row"], label="row", a=("c2", "first"), b=("c2", "last"), c=("c3", "idxmax"), d=("c3", "idxmin"), e=("c0", lambda s: s.max() - s.min()), sort=True).toPandas()
    same(got["a"], g["c2"].first())
    same(got["b"], g["c2"].last())
    assert got["c"].tolist() == pdf.set_index("row").groupby("k")["c3"].idxmax().tolist() and got["d"].tolist() == pdf.set_index("row").groupby("k")["c3"].idxmin().tolist()
    same(got["e"], g["c0"].agg(lambda s: s.max() - s.min()))
    same(rows(gr.group_transform(df, "k", gr.zscore, ["c0"]), "c0_t")["c0_t"], g["c0"].transform(lambda s: (s - s.mean()) / s.std()))
    same(rows(gr.group_transform(df, "k", lambda s: s.max(), ["c1"]), "c1_t")["c1_t"], g["c1"].transform("max"))
    holes = df.withColumn("k", F.when(F.col("row") % 7 > 0, F.col("k")))
    pholes = pdf.assign(k=pdf["k"].where(pdf["row"] % 7 > 0))
    for f in ("sum", lambda s: s - s.mean()):
        same(rows(gr.group_transform(holes, "k", f, ["c0"]), "c0_t")["c0_t"], pholes.groupby("k")["c0"].transform(f))
    assert gr.group_agg(holes, "k", "size", ["c0"]).count() == 5 and gr.group_agg(holes, "k", "size", ["c0"], dropna=False).count() == 6
    got = gr.group_apply(df, "k", lambda key, p: pd.Series([p["c0"].sum(), float(len(p))]), "k long, s double, n double").toPandas().sort_values("k")
    same(got["s"], g["c0"].sum())


def test_first_of_equal_extremes(spark):
    # keys that a double can't tell apart, and texts
    big = 1 << 60
    pdf = pd.DataFrame({"k": 0, "row": [big + 3, big + 1, big + 2, big + 4], "name": ["d", "b", "c", "a"], "x": [2.0, 2.0, 2.0, 1.0], "n": [7, 7, 7, -(1 << 63)]})
    pdf["t"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["n"].clip(0), unit="us")
    df = spark.createDataFrame(pdf).repartition(3).withColumn("d", F.col("x").cast("decimal(9, 2)")).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("x").cast("int")))
    for order, first in ((["row"], big + 1), (["name"], big + 1)):
        got = gr.group_agg(df, "k", order=order, label="row", **{c: (c, "idxmax") for c in ("x", "n", "d", "t", "day")}, low=("x", "idxmin")).first()
        assert [got[c] for c in ("x", "n", "d", "t", "day")] == [first] * 5 and got["low"] == big + 4


def test_pivot(df, pdf):
    pdf, df = pdf.assign(p=np.where(pdf["row"] % 3 == 0, "x", "y")), df.withColumn("p", F.when(F.col("row") % 3 == 0, "x").otherwise("y"))
    got = pv.pivot_table(df, ["c0", "c1"], "k", "p", ["mean", "max"], sort=True).toPandas().set_index("k")
    want = pdf.pivot_table(["c0", "c1"], "k", "p", ["mean", "max"])
    want.columns = [f"{p}_{v}_{f}" for f, v, p in want.columns]
    same(got[want.columns], want)
    got = pv.pivot_table(df, "c0", "k", "p", "sum", margins=True).toPandas().set_index("k")
    want = pdf.pivot_table("c0", "k", "p", "sum", margins=True)
    same(got.loc[[str(i) for i in want.index], ["x", "y", "All"]], want)
    got = pv.pivot_table(df, "c0", "k", "p", lambda s: s.iloc[:].abs().sum(), sort=True).toPandas().set_index("k")
    same(got[["x", "y"]], pdf.pivot_table("c0", "k", "p", lambda s: s.abs().sum()))


@pytest.mark.parametrize("op", ["mean", "sum", "min", "max", "std", "var", "median", "skew", "kurt", "sem", "quantile", "rank"])
def test_rolling_and_expanding(df, pdf, op):
    kw, pkw = ({"q": 0.3}, {"q": 0.3}) if op == "quantile" else ({}, {})
    frames = [(wi.rolling(["row"], 6, by=["k"], min_periods=3), lambda s: s.rolling(6, min_periods=3)), (wi.expanding(["row"], ["k"], 4), lambda s: s.expanding(4))]
    if op in ("mean", "max"):
        frames += [(wi.rolling(["row"], 5, by=["k"], min_periods=2, center=True), lambda s: s.rolling(5, min_periods=2, center=True)), (wi.rolling(["row"], 4, by=["k"], min_periods=2, closed="both"), lambda s: s.rolling(4, min_periods=2, closed="both")), (wi.rolling(["row"], 4, by=["k"], min_periods=1, closed="neither"), lambda s: s.rolling(4, min_periods=1, closed="neither"))]
    for frame, pandas in frames:
        want = pdf.groupby("k")["c3"].transform(lambda s: getattr(pandas(s), op)(**pkw))  # noqa: B023
        same(rows(wi.roll(df, frame, op, ["c3"], suffix="_y", **kw), "c3_y")["c3_y"].astype(float), want, 6)


@pytest.mark.parametrize("closed", ["right", "both", "left", "neither"])
def test_time_windows_with_ties(spark, closed):
    rng = np.random.default_rng(3)
    times = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 40, 90)), unit="min")
    pdf = pd.DataFrame({"row": range(90), "g": rng.integers(0, 2, 90), "ts": times, "v": rng.standard_normal(90)})
    pdf.loc[::9, "v"] = np.nan
    df = spark.createDataFrame(pdf)
    for op in ("sum", "mean", "min", "max", "count", "std", "median"):
        frame = wi.rolling(["ts", "row"], duration="7min", by=["g"], on="ts", closed=closed)
        want = pdf.set_index("ts").groupby("g")[["row", "v"]].apply(lambda p: p.assign(y=getattr(p["v"].rolling("7min", closed=closed), op)())).sort_values("row")["y"]  # noqa: B023
        got = rows(wi.roll(df, frame, op, ["v"], suffix="_y"), "v_y")["v_y"]
        same(got.astype(float).fillna(0) if op == "count" else got.astype(float), want.fillna(0) if op == "count" else want, 7)


def test_other_windows(df, pdf):
    got = rows(wi.roll_cov(df, wi.rolling(["row"], 7, by=["k"], min_periods=3), "c0", "c1", "y"), "y")["y"]
    want = pdf.groupby("k")[["c0", "c1"]].apply(lambda p: p["c0"].rolling(7, min_periods=3).cov(p["c1"])).droplevel(0).sort_index()
    same(got.astype(float)[want.notna().to_numpy()], want.dropna(), 6)
    got = rows(wi.roll_apply(df, wi.rolling(["row"], 5, by=["k"]), lambda s: s.iloc[-1] - s.iloc[0], "c0", "y"), "y")["y"]
    same(got.astype(float), pdf.groupby("k")["c0"].transform(lambda s: s.rolling(5).apply(lambda x: x.iloc[-1] - x.iloc[0])))
    assert wi.roll(df, wi.rolling(["row"], 5, by=["k"], step=3), "mean", ["c0"]).count() == pdf.groupby("k").size().add(2).floordiv(3).sum()
    for kind, options in (("triang", {}), ("gaussian", {"std": 1.5}), ("kaiser", {"beta": 3.0}), ("blackman", {}), ("parzen", {}), ("bohman", {}), ("hamming", {}), ("nuttall", {}), ("barthann", {}), ("exponential", {"tau": 2.0}), ("cosine", {}), ("tukey", {})):
        w = np.array(wi.weights(kind, 7, **options))
        assert len(w) == 7 and np.allclose(w, w[::-1]) and abs(w.max() - 1) < 0.1
    w = np.array(wi.weights("triang", 4))
    frame = wi.rolling(["row"], 4, by=["k"], weights=tuple(w))
    for op, f in {"mean": lambda x: (w * x).sum() / w.sum(), "sum": lambda x: (w * x).sum(), "var": lambda x: (w * (x - (w * x).sum() / w.sum()) ** 2).sum() * 4 / (3 * w.sum())}.items():
        want = pdf.groupby("k")["c0"].transform(lambda s: s.rolling(4).apply(f, raw=True))  # noqa: B023
        same(rows(wi.roll_weighted(df, frame, op, "c0", "y"), "y")["y"].astype(float), want)


def test_ewm(df, pdf):
    for op in ("mean", "sum", "std", "var"):
        for ignore in (False, True):
            want = pdf.groupby("k")["c1"].transform(lambda s: getattr(s.ewm(com=2, ignore_na=ignore), op)())  # noqa: B023
            same(rows(ew.ewm(df, op, ["row"], ["c1"], ["k"], ignore_na=ignore, com=2, suffix="_y"), "c1_y")["c1_y"], want)
    want = pdf.groupby("k")["c1"].transform(lambda s: s.ewm(halflife=2, ignore_na=True).mean())
    same(rows(ew.ewm_native(df, ["row"], "c1", ["k"], "y", ignore_na=True, halflife=2), "y")["y"], want)


def test_windows_without_groups(df, pdf, monkeypatch):
    """Many small blocks give what pandas gives of the whole table, and no frame takes all rows into one partition."""
    monkeypatch.setattr(wi, "BLOCK", 16)
    for n in ("c0", "c1", "c3"):
        for op in ("mean", "sum", "min", "max", "std", "median", "skew", "kurt", "count", "rank"):
            for size, kw in ((5, {}), (5, {"min_periods": 2, "center": True}), (30, {"min_periods": 3, "closed": "both"}), (4, {"closed": "left", "min_periods": 1})):
                if op == "rank" and kw:  # the last row of a frame is ranked, not the current one
                    continue
                want = getattr(pdf[n].rolling(size, **kw), op)()
                same(rows(wi.roll(df, wi.rolling(["row"], size, **kw), op, [n], suffix="_y"), f"{n}_y")[f"{n}_y"].astype(float), want, 6)
            if n == "c1" and op not in ("mean", "sum"):
                break
    for op in ("mean", "sum", "min", "max", "std", "var", "skew", "kurt", "count"):
        want = getattr(pdf["c3"].expanding(4), op)()
        same(rows(wi.roll(df, wi.expanding(["row"], min_periods=4), op, ["c3"], suffix="_y"), "c3_y")["c3_y"].astype(float), want, 6)
    got = rows(wi.roll(df, wi.rolling(["row"], 5, step=7), "mean", ["c0"], suffix="_y"), "row", "c0_y")
    assert got["row"].tolist() == list(range(0, 120, 7))
    plan = wi.roll(df, wi.rolling(["row"], 5), "mean", ["c0"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # the parts' totals, a row for each


def test_time_windows_without_groups(spark):
    frame = pd.DataFrame({"row": range(60), "v": np.arange(60) % 7 * 1.0})
    frame["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(np.arange(60) * 13 % 11), unit="min")
    df = spark.createDataFrame(frame).repartition(3)
    for closed in ("right", "both", "left", "neither"):
        for op in ("sum", "max", "std"):
            want = getattr(frame.rolling("20min", on="ts", closed=closed)["v"], op)()
            got = rows(wi.roll(df, wi.rolling(["ts", "row"], duration="20min", on="ts", closed=closed), op, ["v"], suffix="_y"), "v_y")["v_y"].astype(float)
            if closed in ("left", "neither"):  # rows of one time don't see each other there
                later = ~frame["ts"].duplicated().to_numpy()
                got, want = got[later], want[later]
            same(got, want)
    got = rows(wi.roll(df, wi.rolling(["ts", "row"], duration="20min", on="ts", center=True, min_periods=1), "sum", ["v"], suffix="_y"), "v_y")["v_y"]
    same(got.astype(float), frame.rolling("20min", on="ts", center=True)["v"].sum())


def test_time_windows_of_moments(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"row": range(160), "v": rng.standard_normal(160).cumsum() ** 2 + 1e6, "n": rng.integers(0, 3, 160)})
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 200, 160)), unit="min")
    pdf.loc[::7, "v"] = np.nan
    pdf.loc[60:90, "v"] = 0.1
    df = spark.createDataFrame(pdf).repartition(3)
    for closed in ("right", "both", "left"):
        frame = wi.rolling(["ts", "row"], duration="25min", on="ts", closed=closed)
        held = wi.roll(df, frame, ["var", "std", "sem", "skew", "kurt"], ["v", "n"])
        # a frame's values need not be collected, which takes as much as all frames together
        plan = held._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan
        # nor is a frame folded anew for each of its rows: both sides are running folds
        assert "specifiedwindowframe(RangeFrame, -" not in plan and "specifiedwindowframe(RowFrame, -" not in plan
        got = held.orderBy("row").toPandas()
        for i, t in enumerate(pdf["ts"]):
            since = t - pd.Timedelta("25min")
            past = (pdf["ts"] >= since if closed != "right" else pdf["ts"] > since) & ((pdf["ts"] < t) | ((pdf["ts"] == t) & (pdf["row"] <= i) & (closed != "left")))
            for c in ("v", "n"):
                x = pdf.loc[past, c].dropna()
                for op in ("var", "std", "skew", "kurt"):
                    # a frame's excess kurtosis of equal values is -3, as pandas' rolling has it
                    want = {"kurt": -3.0 if len(x) > 3 else np.nan, "skew": 0.0 if len(x) > 2 else np.nan}.get(op, 0.0 if len(x) > 1 else np.nan) if x.nunique() == 1 else getattr(x, op)()
                    same([got[f"{c}_{op}"].astype(float)[i]], [want], 6)
                same([got[f"{c}_sem"].astype(float)[i]], [got[f"{c}_std"].astype(float)[i] / np.sqrt(len(x) - 1) if len(x) > 1 else np.nan], 6)


def test_time_windows_across_cells(spark):
    # times before 1970 and on both ends of a duration, rows without a time, keys that repeat
    at = [-40, -20, -20, -1, 0, 19, 20, 20, 40, 60, 61]
    pdf = pd.DataFrame({"row": [0, 1, 2, 3, 4, 5, 6, 6, 8, 9, 10], "v": [2.0**i for i in range(11)]})
    pdf["ts"] = pd.Timestamp("1970-01-01") + pd.to_timedelta(at, unit="min")
    df = spark.createDataFrame(pdf).withColumn("g", F.lit(1)).repartition(3)
    lost = spark.createDataFrame([(11, float("nan"), 1)], "row long, v double, g int").selectExpr("row", "v", "CAST(NULL AS timestamp) AS ts", "g")
    for closed in ("right", "both", "left", "neither"):
        for by in ([], ["g"]):
            got = wi.roll(df.unionByName(lost), wi.rolling(["ts", "row"], duration="20min", on="ts", by=by, closed=closed), ["sum", "count", "max"], ["v"]).toPandas()
            assert len(got) == 12 and got["v"].sum() == 2**11 - 1
            for i, t in enumerate(at):
                past = [2.0**j for j, u in enumerate(at) if (t - 20 <= u if closed in ("both", "left") else t - 20 < u) and (u < t or (closed in ("right", "both") and u == t and pdf["row"][j] <= pdf["row"][i]))]
                row = got[got["v"] == 2.0**i].iloc[0]
                if i in (6, 7) and closed in ("right", "both"):  # either may come first
                    assert row["v_sum"] in (sum(past), sum(past) - 2.0**6, sum(past) - 2.0**7)
                else:
                    assert row["v_count"] == len(past) and (row["v_sum"], row["v_max"]) == (sum(past), max(past)) if past else np.isnan(row["v_sum"])


def test_ewm_without_groups(df, pdf):
    for op in ("mean", "sum", "std", "var"):
        for ignore in (False, True):
            want = getattr(pdf["c1"].ewm(com=2, ignore_na=ignore, min_periods=3), op)()
            same(rows(ew.ewm(df, op, ["row"], ["c1"], ignore_na=ignore, com=2, min_periods=3, suffix="_y"), "c1_y")["c1_y"], want)
    same(rows(ew.ewm(df, "var", ["row"], ["c0"], alpha=0.3, bias=True, suffix="_y"), "c0_y")["c0_y"], pdf["c0"].ewm(alpha=0.3).var(bias=True))


def test_elementwise(spark, df, pdf):
    table = spark.createDataFrame([(0, "a", 1.0), (1, None, float("nan")), (2, "b", 2.0), (3, "a1", None)], "row int, s string, x double")
    got = rows(el.isin(table, ["a", None], ["s"]), "s")["s"].tolist()
    assert got == [True, True, False, False]
    assert rows(el.isin(table, [1.0, 2.0], ["x"]), "x")["x"].tolist() == [True, False, True, False]
    assert rows(el.replace(table, "a", "z", ["s"]), "s")["s"].tolist() == ["z", None, "b", "a1"]
    assert rows(el.replace(table, {"s": {r"^([a-z])(\d)$": r"\2\1"}}, regex=True), "s")["s"].tolist() == ["a", None, "b", "1a"]
    assert rows(el.map_column(table, "s", {"a": "A"}), "s")["s"].tolist() == ["A", None, None, None]
    assert rows(el.map_cells(table, lambda v: v + 1, "double", ["x"], "ignore"), "x")["x"].fillna(-1).tolist() == [2.0, -1, 3.0, -1]
    got = rows(el.apply_rows(df, lambda r: r["c0"] * 2, "double", "y", ["c0", "c1"]), "y")["y"]
    same(got, pdf["c0"] * 2)
    assert el.chunk_apply(df, lambda p: p[p["c0"] > 0][["row"]], "row long").count() == (pdf["c0"] > 0).sum()


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_merge(spark, how):
    left = pd.DataFrame({"k": ["a", "b", None, "b", "z"], "v": range(5)})
    right = pd.DataFrame({"k": ["b", None, "q", "b"], "v": range(10, 14)})
    want = left.merge(right, how=how, on="k", indicator=True)
    kind = "k string, v long"
    got = jo.merge(spark.createDataFrame(left.where(left.notna(), None).values.tolist(), kind), spark.createDataFrame(right.where(right.notna(), None).values.tolist(), kind), how, ["k"], indicator=True).toPandas()
    key = lambda f: sorted(map(str, f.astype(object).where(f.notna(), "-").values.tolist()))
    assert key(got[want.columns].assign(v_x=got["v_x"].astype(float), v_y=got["v_y"].astype(float))) == key(want.assign(v_x=want["v_x"].astype(float), v_y=want["v_y"].astype(float), _merge=want["_merge"].astype(str)))
    with pytest.raises(ValueError):
        jo.merge(spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,)], "k int"), validate="1:1")


def test_time_windows_of_apply_cov_and_centre(spark):
    """Durations against pandas, also where several rows share a time."""
    rng = np.random.default_rng(8)
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 600, 80)), unit="min")
    pdf = pd.DataFrame({"id": range(80), "t": t, "x": rng.normal(size=80), "y": rng.normal(size=80)})
    pdf.loc[::9, "x"] = np.nan
    df = spark.createDataFrame(pdf.assign(g=1))
    roll, times = wi, pdf.set_index("t")
    for closed in ("right", "both", "left", "neither"):
        frame = roll.rolling(["t", "id"], duration="90min", by=["g"], on="t", closed=closed, min_periods=2)
        moving = times[["x", "y"]].rolling("90min", closed=closed, min_periods=2)
        got = roll.roll_apply(df, frame, lambda s: s.max() - s.min(), "x", "z").orderBy("id").toPandas()["z"]
        if closed in ("right", "both"):
            # pandas lets later rows of the same time in where the end is open, so only closed ends are compared
            assert np.allclose(got.astype(float), moving["x"].apply(lambda s: np.nanmax(s) - np.nanmin(s)), equal_nan=True)
            both = times.where(times["x"].notna())
            want = both["x"].rolling("90min", closed=closed, min_periods=2).cov(both["y"])
            cov = roll.roll_cov(df, frame, "x", "y").orderBy("id").toPandas()["cov"]
            assert np.allclose(cov.astype(float), want, equal_nan=True)
    for op in ("sum", "mean", "max", "median", "std"):
        frame = roll.rolling(["t", "id"], duration="2h", by=["g"], on="t", center=True)
        got = roll.roll(df, frame, op, ["x"]).orderBy("id").toPandas()[f"x_{op}"]
        assert np.allclose(got.astype(float), getattr(times["x"].rolling("2h", center=True), op)(), equal_nan=True)
    with pytest.raises(ValueError, match="duration"):
        roll.roll_weighted(df, roll.rolling(["t", "id"], duration="2h", on="t", weights=(1.0, 1.0)), "sum", "x", "z").collect()


def test_ranks_of_strings_and_running_longs(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "b"), (5, None)], "id long, s string")
    got = {r["id"]: r["rank"] for r in ac.rank(df, "s", ascending=False).collect()}
    assert got == {1: 2.5, 2: 4.0, 3: 1.0, 4: 2.5, 5: None}
    with pytest.raises(ValueError, match="order"):
        ac.rank(df, "s", method="first")
    from tessera.plans.ordered import running

    big = spark.createDataFrame([(i, 2**60 + i) for i in range(6)], "id long, v long")
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    rows = running(big, ["id"], {"top": ("max", F.col("v")), "low": ("min", F.col("v")), "n": ("count", F.col("v"))}, parts=3).collect()
    assert {r["id"]: (r["top"], r["low"], r["n"]) for r in rows} == {i: (2**60 + i, 2**60, i + 1) for i in range(6)}
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held
