"""One query per operator over the driver's tables, each with its SQL.

Doubles are rounded on both sides, since sums in another order differ in their
last bits.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import datetimes as dt
from .functions import strings as st
from .operators import accumulate as ac
from .operators import correlate as co
from .operators import elementwise as el
from .operators import ewm as ew
from .operators import grouped as gr
from .operators import joins as jo
from .operators import pivot as pv
from .operators import reduce as rd
from .operators import windows as wi
from .sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS, SHIFT = 6, 0.0123


def query(name: str, table: str, sql: str | None = None):
    """Register ``f(df)`` over ``table`` (or ``f(*dfs)`` over several) under ``name``."""

    def add(f):
        QUERIES[name] = lambda spark, d: f(*[read_table(spark, d, t) for t in table.split()])
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """All doubles rounded, negative zero made zero. A small shift keeps exact halves from falling to either side."""
    return df.withColumns({n: F.round(F.col(n) + SHIFT / 10**digits, digits) + 0.0 for n, t in df.dtypes if t == "double"})


def r(x: str, digits: int = DIGITS) -> str:
    return f"round(CAST({x} AS DOUBLE) + {SHIFT / 10**digits!r}, {digits}) + 0.0"


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EV = ["ts", "event_id"]
HOLES = "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END"
GAPPY = f"(SELECT *, {HOLES} AS x FROM events)"
ORDER = "ORDER BY ts, event_id"
BY_USER = f"PARTITION BY user_id {ORDER}"


def gappy(events: DataFrame) -> DataFrame:
    return events.withColumn("x", F.expr(HOLES))


def _union(columns, expression):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(expression.format(c=c))} AS value FROM lineitem" for c in columns)


# reductions down the columns
@query("zscore", "lineitem", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{r(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()')} AS {c}_z" for c in LI) + " FROM lineitem")
def _(df):
    return rounded(rd.zscore(df, LI).select("l_orderkey", "l_linenumber", *[f"{c}_z" for c in LI]))


for _op, _sql in {
    "min": "min({c})", "max": "max({c})", "mean": "avg({c})", "sum": "sum({c})", "std": "stddev_samp({c})", "var": "var_samp({c})",
    "sem": "stddev_samp({c}) / sqrt(count({c}))", "skew": "skewness({c})", "kurt": "kurtosis({c})", "median": "median({c})", "nunique": "count(DISTINCT {c})", "count": "count({c})",
}.items():
    query(f"reduce_{_op}", "lineitem", _union(LI, _sql))(lambda df, op=_op: rounded(rd.reduce_columns(df, op, LI)))

query("reduce_std_ddof0", "lineitem", _union(LI, "stddev_pop({c})"))(lambda df: rounded(rd.reduce_columns(df, "std", LI, ddof=0)))
query("reduce_var_ddof3", "lineitem", _union(LI, "var_pop({c}) * count({c}) / (count({c}) - 3)"))(lambda df: rounded(rd.reduce_columns(df, "var", LI, ddof=3)))
query("mad", "lineitem", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(f'avg(abs({c} - m))')} AS value FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)" for c in LI))(lambda df: rounded(rd.mean_abs_deviation(df, LI)))
query("reduce_prod", "part", f"SELECT 'f' AS \"column\", {r('product(1 + p_size / 100000.0)', 4)} AS value FROM part")(lambda df: rounded(rd.reduce_columns(df.select((1 + F.col("p_size") / 100000).alias("f")), "prod"), 4))


@query("reduce_skipna", "events", f"SELECT 'x' AS \"column\", CAST(NULL AS DOUBLE) AS value UNION ALL SELECT 'value', {r('sum(value)')} FROM events")
def _(df):
    return rounded(rd.reduce_columns(gappy(df), "sum", ["x", "value"], skipna=False))


@query("reduce_mincount", "events", f"SELECT 'x' AS \"column\", CASE WHEN count(x) >= 9000 THEN {r('sum(x)')} END AS value FROM {GAPPY} UNION ALL SELECT 'value', CASE WHEN count(value) >= 9000 THEN {r('sum(value)')} END FROM events")
def _(df):
    return rounded(rd.reduce_columns(gappy(df), "sum", ["x", "value"], min_count=9000))


@query("nunique_missing", "events", f"SELECT 'x' AS \"column\", CAST(count(DISTINCT x) + max(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS DOUBLE) AS value FROM {GAPPY}")
def _(df):
    return rd.reduce_columns(gappy(df), "nunique", ["x"], dropna=False)


_qs = [0.25, 0.5, 0.95]
query("reduce_quantile", "lineitem", " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, " + ", ".join(f"{r(f'quantile_cont({c}, {q})')} AS {c}" for c in LI) + " FROM lineitem" for q in _qs))(lambda df: rounded(rd.quantiles(df, _qs, LI)))
for _how, _at in {"lower": "floor", "higher": "ceil", "nearest": "round_even", "midpoint": ""}.items():
    _pick = lambda f, q: f"list_sort(list(p_retailprice))[CAST({f}((count(*) - 1) * {q}{', 0' if f == 'round_even' else ''}) AS BIGINT) + 1]"
    _each = lambda q: _pick(_at, q) if _at else f"({_pick('floor', q)} + {_pick('ceil', q)}) / 2"  # noqa: B023, E731
    query(f"quantile_{_how}", "part", " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, {r(_each(q))} AS p_retailprice FROM part" for q in (0.1, 0.333, 0.77)))(
        lambda df, how=_how: rounded(rd.quantiles(df, [0.1, 0.333, 0.77], ["p_retailprice"], how))
    )

for _op, _f in (("idxmax", "value DESC"), ("idxmin", "value")):
    query(_op, "events", f"SELECT 'value' AS \"column\", (SELECT event_id FROM events ORDER BY {_f}, event_id LIMIT 1) AS label")(lambda df, op=_op: rd.argext(df, op, "event_id", columns=["value"]))


@query("mode", "lineitem", """
WITH c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'l_quantity' AS "column", CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS rank, CAST(v AS VARCHAR) AS value FROM c WHERE n = (SELECT max(n) FROM c)
UNION ALL SELECT 'l_linenumber', CAST(row_number() OVER (ORDER BY v) - 1 AS INT), CAST(v AS VARCHAR) FROM d WHERE n = (SELECT max(n) FROM d)""")
def _(df):
    return rd.modes(df, ["l_quantity", "l_linenumber"])


@query("describe", "lineitem", " UNION ALL ".join(
    f"SELECT '{s}' AS statistic, " + ", ".join(f"{r(f.format(c=c))} AS {c}" for c in LI) + " FROM lineitem"
    for s, f in (("count", "count({c})"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"), ("25%", "quantile_cont({c}, 0.25)"), ("50%", "median({c})"), ("75%", "quantile_cont({c}, 0.75)"), ("max", "max({c})"))))
def _(df):
    return rounded(rd.describe(df, LI))


@query("describe_text", "orders", """
WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT 'o_orderpriority' AS "column", CAST(sum(n) AS BIGINT) AS "count", count(*) AS "unique", (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS top, max(n) AS freq FROM c""")
def _(df):
    return rd.describe_text(df, ["o_orderpriority"])


query("agg_list", "lineitem", " UNION ALL ".join(f"SELECT '{s}' AS \"function\", {r(f.format(c='l_quantity'))} AS l_quantity, {r(f.format(c='l_tax'))} AS l_tax FROM lineitem" for s, f in (("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("max", "max({c})"))))(
    lambda df: rounded(rd.agg(df, ["mean", "std", "max"], ["l_quantity", "l_tax"]))
)
query("agg_dict", "lineitem", f"SELECT {r('sum(l_quantity)')} AS l_quantity_sum, {r('min(l_tax)')} AS l_tax_min, {r('max(l_tax)')} AS l_tax_max FROM lineitem")(lambda df: rounded(rd.agg(df, {"l_quantity": "sum", "l_tax": ["min", "max"]})))
query("agg_callable", "part", f"SELECT 'p_retailprice' AS \"column\", {r('max(p_retailprice) - min(p_retailprice)')} AS value FROM part")(lambda df: rounded(rd.agg(df, lambda s: float(s.max() - s.min()), ["p_retailprice"])))

# along the columns of a row
_row = "[" + ", ".join(LI) + "]"
for _op, _sql in {
    "min": f"list_min({_row})", "max": f"list_max({_row})", "mean": f"list_avg({_row})", "sum": f"list_sum({_row})", "prod": f"list_product({_row})", "median": f"list_median({_row})",
    "std": f"list_stddev_samp({_row})", "var": f"list_var_samp({_row})", "sem": f"list_stddev_samp({_row}) / 2", "skew": f"list_skewness({_row})", "kurt": f"list_kurtosis({_row})", "nunique": f"len(list_distinct({_row}))",
    "mad": f"list_avg(list_transform({_row}, lambda v: abs(v - list_avg({_row}))))",
}.items():
    query(f"row_{_op}", "lineitem", f"SELECT l_orderkey, l_linenumber, {r(_sql, 4)} AS value FROM lineitem")(
        lambda df, op=_op: rounded(rd.reduce_rows(df, op, LI).select("l_orderkey", "l_linenumber", F.col("value").cast("double").alias("value")), 4)
    )
query("row_quantile", "lineitem", f"SELECT l_orderkey, l_linenumber, " + ", ".join(f"{r(f'list_aggregate({_row}, {chr(39)}quantile_cont{chr(39)}, {q})')} AS q{i}" for i, q in enumerate(_qs)) + " FROM lineitem")(
    lambda df: rounded(rd.row_quantiles(df, _qs, LI).select("l_orderkey", "l_linenumber", "q0", "q1", "q2"))
)
for _op, _f in (("idxmax", "list_max"), ("idxmin", "list_min")):
    query(f"row_{_op}", "lineitem", f"SELECT l_orderkey, l_linenumber, ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'][list_position({_row}, {_f}({_row}))] AS value FROM lineitem")(
        lambda df, op=_op: rd.row_argext(df, op, LI).select("l_orderkey", "l_linenumber", "value")
    )

# cumulative, rank, relative change
_upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
for _op, _f in {"cumsum": "sum({c})", "cumprod": "product({c} / 250)", "cummin": "min({c})", "cummax": "max({c})"}.items():
    _scaled = "x / 250" if _op == "cumprod" else "x"
    query(_op, "events", f"SELECT event_id, CASE WHEN x IS NOT NULL THEN {r(_f.format(c='x') + f' OVER ({BY_USER} {_upto})')} END AS y FROM {GAPPY}")(
        lambda df, op=_op, e=_scaled: rounded(ac.cumulative(gappy(df).withColumn("y", F.expr(e)), op, EV, ["user_id"], ["y"], suffix="_").select("event_id", F.col("y_").alias("y")))
    )
query("cumsum_whole", "events", f"SELECT event_id, CASE WHEN x IS NOT NULL THEN {r(f'sum(x) OVER ({ORDER} {_upto})', 4)} END AS y FROM {GAPPY}")(
    lambda df: rounded(ac.cumulative(gappy(df), "cumsum", EV, columns=["x"], suffix="_y").select("event_id", F.col("x_y").alias("y")), 4)
)
query("cumsum_poisoned", "events", f"SELECT event_id, CASE WHEN count(x) OVER w = count(*) OVER w THEN {r('sum(x) OVER w')} END AS y FROM {GAPPY} WINDOW w AS ({BY_USER} {_upto})")(
    lambda df: rounded(ac.cumulative(gappy(df), "cumsum", EV, ["user_id"], ["x"], skipna=False, suffix="_y").select("event_id", F.col("x_y").alias("y")))
)
query("cum_axis1", "lineitem", f"SELECT l_orderkey, l_linenumber, {r('l_quantity')} AS l_quantity_s, {r('l_quantity + l_discount')} AS l_discount_s, {r('l_quantity + l_discount + l_tax')} AS l_tax_s FROM lineitem")(
    lambda df: rounded(ac.cumulative_rows(df, "cumsum", ["l_quantity", "l_discount", "l_tax"], suffix="_s").select("l_orderkey", "l_linenumber", "l_quantity_s", "l_discount_s", "l_tax_s"))
)
_ranks = {"min": "rank() OVER (ORDER BY value)", "average": "rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0", "max": "rank() OVER (ORDER BY value) + count(*) OVER (PARTITION BY value) - 1",
          "dense": "dense_rank() OVER (ORDER BY value)", "first": "row_number() OVER (ORDER BY value, event_id)"}
for _m, _f in _ranks.items():
    query(f"rank_{_m}", "events", f"SELECT event_id, CAST({_f} AS DOUBLE) AS rank FROM events")(lambda df, m=_m: ac.rank(df, "value", m, ["event_id"]).select("event_id", "rank"))
query("rank_pct", "events", f"SELECT event_id, CASE WHEN x IS NOT NULL THEN {r('(rank() OVER (ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(x) OVER ()')} END AS rank FROM {GAPPY}")(
    lambda df: rounded(ac.rank(gappy(df), "x", pct=True).select("event_id", "rank"))
)
query("rank_na_top_desc", "events", f"SELECT event_id, CAST(rank() OVER (ORDER BY x DESC NULLS FIRST) AS DOUBLE) AS rank FROM {GAPPY}")(
    lambda df: ac.rank(gappy(df), "x", "min", na_option="top", ascending=False).select("event_id", "rank")
)
query("rank_grouped", "events", "SELECT event_id, CAST(rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS DOUBLE) AS rank FROM events")(
    lambda df: ac.rank(df, "value", by=["user_id"]).select("event_id", "rank")
)
query("rank_rows", "lineitem", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST(len(list_filter({_row}, lambda v: v < {c})) + (len(list_filter({_row}, lambda v: v = {c})) + 1) / 2.0 AS DOUBLE) AS {c}_rank" for c in LI) + " FROM lineitem")(
    lambda df: ac.rank_rows(df, LI).select("l_orderkey", "l_linenumber", *[f"{c}_rank" for c in LI])
)
query("pct_change", "events", f"SELECT event_id, {r('f / lag(f) OVER (' + BY_USER + ') - 1')} AS p FROM (SELECT *, last_value(x IGNORE NULLS) OVER ({BY_USER} {_upto}) AS f FROM {GAPPY})")(
    lambda df: rounded(ac.pct_change(gappy(df), EV, ["user_id"], ["x"]).select("event_id", F.col("x_pct").alias("p")))
)
query("replace_ffill", "events", f"SELECT event_id, last_value(x IGNORE NULLS) OVER ({BY_USER} {_upto}) AS x FROM {GAPPY}")(lambda df: ac.filled(gappy(df), EV, ["user_id"], ["x"]).select("event_id", "x"))

# correlation
_pairs3 = [(a, b) for a in LI for b in LI]
query("corr_pearson", "lineitem", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})' if a != b else '1')} AS value {'FROM lineitem' if a != b else ''}" for a, b in _pairs3))(lambda df: rounded(co.correlation(df, "pearson", LI)))
query("corr_pearson_missing", "events", f"WITH c AS (SELECT {r('corr(x, y)')} AS v FROM (SELECT {HOLES} AS x, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS y FROM events)) SELECT 'x' AS a, 'y' AS b, v AS value FROM c UNION ALL SELECT 'y', 'x', v FROM c UNION ALL SELECT 'x', 'x', 1.0 UNION ALL SELECT 'y', 'y', 1.0")(
    lambda df: rounded(co.correlation(df.select(F.expr(HOLES).alias("x"), F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END").alias("y")), "pearson", ["x", "y"]))
)
query("corr_spearman", "lineitem", f"""
WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem),
c AS (SELECT {r('corr(x, y)')} AS v FROM k)
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, v AS value FROM c UNION ALL SELECT 'l_extendedprice', 'l_quantity', v FROM c UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0""")(
    lambda df: rounded(co.correlation(df, "spearman", ["l_quantity", "l_extendedprice"]))
)
query("corr_kendall", "supplier", f"""
WITH t AS (SELECT CAST(s_nationkey AS DOUBLE) AS x, s_acctbal AS y, s_suppkey AS i FROM supplier),
c AS (SELECT {r('sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y))))')} AS v FROM t a JOIN t b ON a.i < b.i)
SELECT 's_nationkey' AS a, 's_acctbal' AS b, v AS value FROM c UNION ALL SELECT 's_acctbal', 's_nationkey', v FROM c UNION ALL SELECT 's_nationkey', 's_nationkey', 1.0 UNION ALL SELECT 's_acctbal', 's_acctbal', 1.0""")(
    lambda df: rounded(co.correlation(df, "kendall", ["s_nationkey", "s_acctbal"]))
)
query("corr_callable", "part", f"WITH c AS (SELECT {r('avg(abs(p_size - p_retailprice))')} AS v FROM part) SELECT 'p_size' AS a, 'p_retailprice' AS b, v AS value FROM c UNION ALL SELECT 'p_retailprice', 'p_size', v FROM c UNION ALL SELECT 'p_size', 'p_size', 1.0 UNION ALL SELECT 'p_retailprice', 'p_retailprice', 1.0")(
    lambda df: rounded(co.correlation(df, lambda x, y: float(abs(x - y).mean()), ["p_size", "p_retailprice"]))
)

# element-wise
query("isin", "orders", "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS o_orderstatus, o_orderpriority IN ('F', 'O') AS o_orderpriority FROM orders")(
    lambda df: el.isin(df.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["F", "O"], ["o_orderstatus", "o_orderpriority"])
)
query("isin_dict", "orders", "SELECT o_orderkey, o_orderstatus IN ('P') AS o_orderstatus, false AS o_orderpriority FROM orders")(
    lambda df: el.isin(df.select("o_orderkey", "o_orderstatus", "o_orderpriority"), {"o_orderstatus": ["P"]}, ["o_orderstatus", "o_orderpriority"])
)
query("isin_table", "orders customer", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS o_custkey FROM orders")(
    lambda o, c: el.isin(o.select("o_orderkey", "o_custkey"), c.filter("c_acctbal < 0").select("c_custkey"), ["o_custkey"])
)
query("replace", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")(
    lambda df: el.replace(df.select("o_orderkey", "o_orderstatus"), {"F": "done", "O": "open"})
)
query("replace_nested", "lineitem", "SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 100 ELSE l_linenumber END AS l_linenumber, CASE l_returnflag WHEN 'R' THEN 'back' ELSE l_returnflag END AS l_returnflag FROM lineitem")(
    lambda df: el.replace(df.select("l_orderkey", "l_linenumber", "l_returnflag"), {"l_linenumber": {1: 100}, "l_returnflag": {"R": "back"}})
)
query("replace_regex", "orders", r"SELECT o_orderkey, regexp_replace(o_orderpriority, '^(\d)-(.*)$', '\2 (\1)', 'g') AS o_orderpriority FROM orders")(
    lambda df: el.replace(df.select("o_orderkey", "o_orderpriority"), {r"^(\d)-(.*)$": r"\2 (\1)"}, regex=True)
)
query("map_dict", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 2.0::DOUBLE END AS code FROM orders")(lambda df: el.map_column(df.select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": 1.0, "O": 2.0}, into="code").select("o_orderkey", "code"))
query("map_series", "customer nation", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")(
    lambda c, n: el.map_column(c, "c_nationkey", n.select("n_nationkey", "n_name"), into="nation").select("c_custkey", "nation")
)
query("map_udf", "orders", f"SELECT o_orderkey, {r('o_totalprice * 2 + 1')} AS o_totalprice FROM orders")(lambda df: rounded(el.map_column(df.select("o_orderkey", "o_totalprice"), "o_totalprice", lambda v: v * 2 + 1, "double")))
query("map_ignore", "events", f"SELECT event_id, {r('x + 1')} AS x FROM {GAPPY}")(lambda df: rounded(el.map_cells(gappy(df).select("event_id", "x"), lambda v: v + 1, "double", ["x"], na_action="ignore")))
query("applymap", "lineitem", f"SELECT l_orderkey, l_linenumber, {r('l_discount * 100')} AS l_discount, {r('l_tax * 100')} AS l_tax FROM lineitem")(
    lambda df: rounded(el.map_cells(df.select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), el.native(lambda c: c * 100), "double", ["l_discount", "l_tax"]))
)
query("series_apply", "part", f"SELECT p_partkey, {r('p_size * 3 + 2')} AS y FROM part")(lambda df: rounded(el.map_column(df.select("p_partkey", F.col("p_size").cast("double").alias("p_size")), "p_size", lambda v, k=3: v * k + 2, "double", into="y").select("p_partkey", "y")))
query("apply_rows", "part", f"SELECT p_partkey, {r('p_size * p_retailprice')} AS y FROM part")(
    lambda df: rounded(el.apply_rows(df, lambda row: float(row["p_size"] * row["p_retailprice"]), "double", "y", ["p_size", "p_retailprice"]).select("p_partkey", "y"))
)
query("apply_rows_expand", "part", f"SELECT p_partkey, {r('p_size + p_retailprice')} AS total, {r('p_retailprice - p_size')} AS gap FROM part")(
    lambda df: rounded(el.apply_rows(df, lambda row: pd.Series({"total": row["p_size"] + row["p_retailprice"], "gap": row["p_retailprice"] - row["p_size"]}), "total double, gap double", columns=["p_size", "p_retailprice"], expand=True).select("p_partkey", "total", "gap"))
)
query("apply_columns", "part", f"SELECT 'p_size' AS \"column\", {r('max(p_size) - min(p_size)')} AS value FROM part UNION ALL SELECT 'p_retailprice', {r('max(p_retailprice) - min(p_retailprice)')} FROM part")(
    lambda df: rounded(el.apply_columns(df, lambda s: float(s.max() - s.min()), ["p_size", "p_retailprice"]))
)
query("transform_column", "events", f"SELECT event_id, {r(f'value - coalesce(lag(value) OVER ({BY_USER}), 0)')} AS d FROM events")(
    lambda df: rounded(el.transform_column(df.select("event_id", "user_id", "ts", "value"), lambda s: s - s.shift(1, fill_value=0), "value", EV, "d", by=["user_id"]).select("event_id", "d"))
)
query("chunk_apply", "lineitem", f"SELECT l_orderkey, {r('l_quantity * l_extendedprice')} AS y FROM lineitem WHERE l_quantity > 25")(
    lambda df: rounded(el.chunk_apply(df.select("l_orderkey", "l_quantity", "l_extendedprice"), lambda p: p[p.l_quantity > 25].assign(y=p.l_quantity * p.l_extendedprice)[["l_orderkey", "y"]], "l_orderkey long, y double"))
)
query("chunk_apply_bykey", "events", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")(
    lambda df: el.chunk_apply(df.select("user_id", "event_id"), lambda p: p.groupby("user_id", as_index=False).agg(n=("event_id", "size")), "user_id long, n long", by=["user_id"])
)

# joins
# whole tables with keys that the other side lacks: every third customer of an order, and every second customer, has another number
_ok, _ck = "CASE WHEN o_custkey % 3 = 0 THEN -o_custkey ELSE o_custkey END", "CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000000 END"
for _how, _join in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}.items():
    query(f"merge_{_how}", "orders customer", f"SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, coalesce(o.k, c.k) AS k, c_name FROM (SELECT o_orderkey, {_ok} AS k FROM orders) o {_join} (SELECT {_ck} AS k, c_name FROM customer) c ON o.k = c.k")(
        lambda o, c, how=_how: jo.merge(o.select("o_orderkey", F.expr(_ok).alias("k")), c.select(F.expr(_ck).alias("k"), "c_name"), how, ["k"]).withColumn("o_orderkey", F.col("o_orderkey").cast("double"))
    )
query("merge_indicator", "orders customer", f"SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(ok AS DOUBLE) AS o_custkey, CAST(ck AS DOUBLE) AS c_custkey, CASE WHEN o_orderkey IS NULL THEN 'right_only' WHEN ck IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM (SELECT o_orderkey, {_ok} AS ok FROM orders) FULL JOIN (SELECT {_ck} AS ck FROM customer) ON ok = ck")(
    lambda o, c: jo.merge(o.select("o_orderkey", F.expr(_ok).alias("o_custkey")), c.select(F.expr(_ck).alias("c_custkey")), "outer", left_on=["o_custkey"], right_on=["c_custkey"], indicator=True).select(*[F.col(c).cast("double").alias(c) for c in ("o_orderkey", "o_custkey", "c_custkey")], "_merge")
)
query("merge_suffixes", "nation region", "SELECT n_regionkey AS k, n_name AS name_n, r_name AS name_r FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda n, r_: jo.merge(n.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name")), r_.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), on=["k"], suffixes=("_n", "_r"), validate="m:1")
)
query("merge_cross", "region", "SELECT a.r_name AS r_name_x, b.r_name AS r_name_y FROM region a, region b")(lambda df: jo.merge(df.select("r_name"), df.select("r_name"), "cross"))

# pivots
_st, _pr = ["F", "O", "P"], "o_orderpriority"
_piv = lambda f: ", ".join(f"{r(f + f' FILTER (o_orderstatus = {chr(39)}{s}{chr(39)})')} AS {s}" for s in _st)
for _op, _f in {"mean": "avg(o_totalprice)", "sum": "sum(o_totalprice)", "count": "count(o_totalprice)", "max": "max(o_totalprice)", "min": "min(o_totalprice)", "std": "stddev_samp(o_totalprice)"}.items():
    query(f"pivot_{_op}", "orders", f"SELECT {_pr}, {_piv(_f)} FROM orders GROUP BY 1")(
        lambda df, op=_op: rounded(pv.pivot_table(df, "o_totalprice", _pr, "o_orderstatus", op, labels=_st).select(_pr, *[F.col(s).cast("double").alias(s) for s in _st]))
    )
query("pivot_multi", "orders", f"SELECT {_pr}, " + ", ".join(f"{r(f'{f}(o_totalprice) FILTER (o_orderstatus = {chr(39)}{s}{chr(39)})')} AS {s}_o_totalprice_{n}" for n, f in (("mean", "avg"), ("max", "max")) for s in _st) + " FROM orders GROUP BY 1")(
    lambda df: rounded(pv.pivot_table(df, "o_totalprice", _pr, "o_orderstatus", ["mean", "max"], labels=_st))
)
query("pivot_fill", "orders", "SELECT o_custkey, " + ", ".join(f"coalesce({r(f'sum(o_totalprice) FILTER (o_orderstatus = {chr(39)}{s}{chr(39)})')}, 0) AS {s}" for s in _st) + " FROM orders GROUP BY 1")(
    lambda df: rounded(pv.pivot_table(df, "o_totalprice", "o_custkey", "o_orderstatus", "sum", fill_value=0, labels=_st))
)
query("pivot_margins", "orders", f"SELECT coalesce({_pr}, 'All') AS {_pr}, {_piv('avg(o_totalprice)')}, {r('avg(o_totalprice)')} AS \"All\" FROM orders GROUP BY ROLLUP ({_pr})")(
    lambda df: rounded(pv.pivot_table(df, "o_totalprice", _pr, "o_orderstatus", "mean", margins=True, labels=_st))
)
_span = lambda s: f"max(o_totalprice) FILTER (o_orderstatus = '{s}') - min(o_totalprice) FILTER (o_orderstatus = '{s}')"
query("pivot_callable", "orders", f"SELECT {_pr}, " + ", ".join(f"{r(_span(s))} AS {s}" for s in _st) + " FROM orders GROUP BY 1")(
    lambda df: rounded(pv.pivot_table(df, "o_totalprice", _pr, "o_orderstatus", lambda s: s.max() - s.min(), labels=_st))
)
query("pivot_nocolumns", "orders", f"SELECT {_pr}, {r('avg(o_totalprice)')} AS o_totalprice FROM orders GROUP BY 1")(lambda df: rounded(pv.pivot_table(df, "o_totalprice", _pr)))

# groups
query("group_agg_str", "lineitem", f"SELECT l_returnflag, {r('avg(l_quantity)')} AS l_quantity, {r('avg(l_tax)')} AS l_tax FROM lineitem GROUP BY 1")(lambda df: rounded(gr.group_agg(df, "l_returnflag", "mean", ["l_quantity", "l_tax"])))
query("group_agg_list", "lineitem", f"SELECT l_returnflag, {r('sum(l_quantity)')} AS l_quantity_sum, {r('stddev_samp(l_quantity)')} AS l_quantity_std, {r('median(l_quantity)')} AS l_quantity_median FROM lineitem GROUP BY 1")(
    lambda df: rounded(gr.group_agg(df, "l_returnflag", ["sum", "std", "median"], ["l_quantity"]))
)
query("group_agg_dict", "lineitem", f"SELECT l_returnflag, {r('sum(l_quantity)')} AS l_quantity, {r('min(l_tax)')} AS l_tax_min, {r('max(l_tax)')} AS l_tax_max FROM lineitem GROUP BY 1")(
    lambda df: rounded(gr.group_agg(df, "l_returnflag", {"l_quantity": "sum", "l_tax": ["min", "max"]}))
)
query("group_agg_named", "lineitem", f"SELECT l_returnflag, l_linestatus, {r('sum(l_extendedprice * 1)', 4)} AS revenue, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2")(
    lambda df: rounded(gr.group_agg(df, ["l_returnflag", "l_linestatus"], revenue=("l_extendedprice", "sum"), n=("l_suppkey", "size"), suppliers=("l_suppkey", "nunique")), 4)
)
query("group_agg_callable", "events", f"SELECT user_id, {r('max(value) - min(value)')} AS value FROM events GROUP BY 1")(lambda df: rounded(gr.group_agg(df, "user_id", lambda s: s.max() - s.min(), ["value"])))
query("group_agg_mixed", "events", f"SELECT user_id, {r('avg(value)')} AS m, {r('max(value) - min(value)')} AS span FROM events GROUP BY 1")(
    lambda df: rounded(gr.group_agg(df, "user_id", m=("value", "mean"), span=("value", lambda s: s.max() - s.min())))
)
query("group_agg_ordered", "events", f"SELECT user_id, first(value {ORDER}) AS first_value, last(value {ORDER}) AS last_value, arg_max(event_id, value) AS top, arg_min(event_id, value) AS low FROM events GROUP BY 1")(
    lambda df: _ordered_groups(df)
)


def _ordered_groups(df):
    held = df.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return gr.group_agg(held, "user_id", first_value=("value", "first"), last_value=("value", "last"), top=("value", "idxmax"), low=("value", "idxmin"), order=["t", "event_id"], label="event_id")


for _op, _f in {"mean": "avg(x) OVER w", "sum": "coalesce(sum(x) OVER w, 0)", "std": "stddev_samp(x) OVER w", "max": "max(x) OVER w", "count": "count(x) OVER w"}.items():
    query(f"group_transform_{_op}", "events", f"SELECT event_id, {r(_f)} AS y FROM {GAPPY} WINDOW w AS (PARTITION BY user_id)")(
        lambda df, op=_op: rounded(gr.group_transform(gappy(df), "user_id", op, ["x"]).select("event_id", F.col("x_t").cast("double").alias("y")))
    )
query("group_transform_zscore", "events", f"SELECT event_id, {r('(value - avg(value) OVER w) / stddev_samp(value) OVER w')} AS y FROM events WINDOW w AS (PARTITION BY user_id)")(
    lambda df: rounded(gr.group_transform(df, "user_id", gr.zscore, ["value"]).select("event_id", F.col("value_t").alias("y")))
)
query("group_transform_callable", "events", f"SELECT event_id, {r('value - min(value) OVER (PARTITION BY user_id)')} AS y FROM events")(
    lambda df: rounded(gr.group_transform(df.select("event_id", "user_id", "value"), "user_id", lambda s: s - s.min(), ["value"]).select("event_id", F.col("value_t").alias("y")))
)
query("group_transform_missing_key", "events", f"SELECT event_id, CASE WHEN k IS NOT NULL THEN {r('avg(value) OVER (PARTITION BY k)')} END AS y FROM (SELECT *, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS k FROM events)")(
    lambda df: rounded(gr.group_transform(df.withColumn("k", F.expr("CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END")), "k", "mean", ["value"]).select("event_id", F.col("value_t").alias("y")))
)
query("group_apply", "events", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 2")(
    lambda df: gr.group_apply(df.select("user_id", "event_id", "value"), "user_id", lambda p: p.sort_values(["value", "event_id"], ascending=[False, True]).head(2)[["user_id", "event_id"]], "user_id long, event_id long")
)
query("group_apply_series", "events", f"SELECT user_id, {r('quantile_cont(value, 0.9)')} AS q FROM events GROUP BY 1")(
    lambda df: rounded(gr.group_apply(df.select("user_id", "value"), "user_id", lambda s: s.quantile(0.9), "user_id long, q double", column="value"))
)

# windows
_w5 = f"WINDOW w AS ({BY_USER} ROWS 4 PRECEDING)"
_need = lambda f, n=5, c="value": f"CASE WHEN count({c}) OVER w >= {n} THEN {f} END"
_rolled = {"mean": "avg(value) OVER w", "sum": "sum(value) OVER w", "min": "min(value) OVER w", "max": "max(value) OVER w", "std": "stddev_samp(value) OVER w", "var": "var_samp(value) OVER w", "median": "median(value) OVER w",
           "sem": "stddev_samp(value) OVER w / sqrt(count(value) OVER w - 1)", "skew": "skewness(value) OVER w", "kurt": "kurtosis(value) OVER w", "quantile": "quantile_cont(value, 0.3) OVER w",
           "rank": "len(list_filter(list(value) OVER w, lambda v: v < value)) + (len(list_filter(list(value) OVER w, lambda v: v = value)) + 1) / 2.0"}
for _op, _f in _rolled.items():
    if _op == "rank":
        _text = f"SELECT event_id, CASE WHEN len(l) >= 5 THEN {r('len(list_filter(l, lambda v: v < value)) + (len(list_filter(l, lambda v: v = value)) + 1) / 2.0', 4)} END AS y FROM (SELECT event_id, value, list(value) OVER w AS l FROM events {_w5})"
    else:
        _text = f"SELECT event_id, {_need(r(_f, 4))} AS y FROM events {_w5}"
    query(f"rolling_{_op}", "events", _text)(
        lambda df, op=_op: rounded(wi.roll(df, wi.rolling(EV, 5, by=["user_id"]), op, ["value"], suffix="_y", **({"q": 0.3} if op == "quantile" else {})).select("event_id", F.col("value_y").cast("double").alias("y")), 4)
    )
    if _op not in ("rank", "quantile", "kurt"):
        query(f"expanding_{_op}", "events", f"SELECT event_id, {_need(r(_f, 4), 3)} AS y FROM events WINDOW w AS ({BY_USER} {_upto})")(
            lambda df, op=_op: rounded(wi.roll(df, wi.expanding(EV, ["user_id"], 3), op, ["value"], suffix="_y").select("event_id", F.col("value_y").cast("double").alias("y")), 4)
        )
for _name, _frame, _kw in (
    ("center", "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING", {"center": True}), ("closed_both", "ROWS BETWEEN 5 PRECEDING AND CURRENT ROW", {"closed": "both"}),
    ("closed_left", "ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING", {"closed": "left"}), ("closed_neither", "ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING", {"closed": "neither", "min_periods": 2}),
):
    query(f"rolling_{_name}", "events", f"SELECT event_id, {_need(r('avg(value) OVER w'), _kw.get('min_periods', 5))} AS y FROM events WINDOW w AS ({BY_USER} {_frame})")(
        lambda df, kw=_kw: rounded(wi.roll(df, wi.rolling(EV, 5, by=["user_id"], **kw), "mean", ["value"], suffix="_y").select("event_id", F.col("value_y").alias("y")))
    )
query("rolling_step", "events", f"SELECT event_id, y FROM (SELECT event_id, {_need(r('avg(value) OVER w'))} AS y, row_number() OVER ({BY_USER}) AS n FROM events {_w5}) WHERE (n - 1) % 3 = 0")(
    lambda df: rounded(wi.roll(df, wi.rolling(EV, 5, by=["user_id"], step=3), "mean", ["value"], suffix="_y").select("event_id", F.col("value_y").alias("y")))
)
query("rolling_agg", "events", f"SELECT event_id, {_need(r('avg(x) OVER w'), 2, 'x')} AS x_mean, {_need(r('max(x) OVER w'), 2, 'x')} AS x_max FROM {GAPPY} {_w5}")(
    lambda df: rounded(wi.roll(gappy(df), wi.rolling(EV, 5, by=["user_id"], min_periods=2), ["mean", "max"], ["x"]).select("event_id", "x_mean", "x_max"))
)
query("rolling_apply", "events", f"SELECT event_id, {_need(r('max(value) OVER w - min(value) OVER w'))} AS y FROM events {_w5}")(
    lambda df: rounded(wi.roll_apply(df, wi.rolling(EV, 5, by=["user_id"]), lambda s: s.max() - s.min(), "value", "y").select("event_id", "y"))
)
for _closed, _lo, _hi in (("right", "3599.999999 seconds", "CURRENT ROW"), ("both", "1 hour", "CURRENT ROW"), ("left", "1 hour", "INTERVAL '0.000001 seconds' PRECEDING"), ("neither", "3599.999999 seconds", "INTERVAL '0.000001 seconds' PRECEDING")):
    for _op, _f in (("sum", "sum(value)"), ("max", "max(value)"), ("std", "stddev_samp(value)")):
        query(f"rolling_time_{_closed}_{_op}", "events", f"SELECT event_id, {r(f'{_f} OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {chr(39)}{_lo}{chr(39)} PRECEDING AND {_hi})', 4)} AS y FROM events")(
            lambda df, c=_closed, op=_op: rounded(wi.roll(df, wi.rolling(EV, duration="1h", by=["user_id"], on="ts", closed=c), op, ["value"], suffix="_y").select("event_id", F.col("value_y").alias("y")), 4)
        )
query("rolling_cov", "events", f"SELECT event_id, {_need(r('covar_samp(value, CAST(event_id AS DOUBLE)) OVER w', 2))} AS y FROM events {_w5}")(
    lambda df: rounded(wi.roll_cov(df.withColumn("e", F.col("event_id").cast("double")), wi.rolling(EV, 5, by=["user_id"]), "value", "e", "y").select("event_id", "y"), 2)
)
_tri = [1 / 3, 2 / 3, 1.0, 2 / 3, 1 / 3]
for _op, _f in (("mean", "s / 3.0"), ("sum", "s")):
    query(f"window_triang_{_op}", "events", f"SELECT event_id, CASE WHEN len(l) = 5 THEN {r(_f)} END AS y FROM (SELECT event_id, l, " + " + ".join(f"l[{i + 1}] * {w!r}" for i, w in enumerate(_tri)) + f" AS s FROM (SELECT event_id, list(value) OVER w AS l FROM events {_w5}))")(
        lambda df, op=_op: rounded(wi.roll_weighted(df, wi.rolling(EV, 5, by=["user_id"], weights=wi.weights("triang", 5)), op, "value", "y").select("event_id", "y"))
    )
_lst = f"(SELECT event_id, list(value) OVER (PARTITION BY user_id {ORDER} {_upto}) AS l FROM events)"
_wt = "list_transform(l, lambda v, i: {e} * pow(2 / 3.0, len(l) - i))"
_den = "list_sum(" + _wt.format(e="1.0") + ")"
query("ewm_mean", "events", f"SELECT event_id, {r('list_sum(' + _wt.format(e='v') + ') / ' + _den)} AS y FROM {_lst}")(lambda df: rounded(ew.ewm(df.select("event_id", "user_id", "ts", "value"), "mean", EV, ["value"], ["user_id"], span=5, suffix="_y").select("event_id", F.col("value_y").alias("y"))))
query("ewm_sum", "events", f"SELECT event_id, {r('list_sum(' + _wt.format(e='v') + ')')} AS y FROM {_lst}")(lambda df: rounded(ew.ewm(df.select("event_id", "user_id", "ts", "value"), "sum", EV, ["value"], ["user_id"], span=5, suffix="_y").select("event_id", F.col("value_y").alias("y"))))
for _op in ("var", "std"):
    _m = "(list_sum(" + _wt.format(e="v") + ") / " + _den + ")"
    _v = "list_sum(list_transform(l, lambda v, i: pow(v - m, 2) * pow(2 / 3.0, len(l) - i))) / d * (d * d) / (d * d - list_sum(list_transform(l, lambda v, i: pow(2 / 3.0, 2 * (len(l) - i)))))"
    _v = f"sqrt({_v})" if _op == "std" else _v
    query(f"ewm_{_op}", "events", f"SELECT event_id, CASE WHEN len(l) > 1 THEN {r(_v, 4)} END AS y FROM (SELECT event_id, l, {_m} AS m, {_den} AS d FROM {_lst})")(
        lambda df, op=_op: rounded(ew.ewm(df.select("event_id", "user_id", "ts", "value"), op, EV, ["value"], ["user_id"], span=5, suffix="_y").select("event_id", F.col("value_y").alias("y")), 4)
    )

# the same of the whole table, without group keys
_all5 = f"WINDOW w AS ({ORDER} ROWS 4 PRECEDING)"
for _op in ("mean", "sum", "max", "std", "median", "sem", "skew", "kurt", "quantile"):
    query(f"rolling_whole_{_op}", "events", f"SELECT event_id, {_need(r(_rolled[_op], 4))} AS y FROM events {_all5}")(
        lambda df, op=_op: rounded(wi.roll(df, wi.rolling(EV, 5), op, ["value"], suffix="_y", **({"q": 0.3} if op == "quantile" else {})).select("event_id", F.col("value_y").cast("double").alias("y")), 4)
    )
query("rolling_whole_center", "events", f"SELECT event_id, {_need(r('avg(value) OVER w'))} AS y FROM events WINDOW w AS ({ORDER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")(
    lambda df: rounded(wi.roll(df, wi.rolling(EV, 5, center=True), "mean", ["value"], suffix="_y").select("event_id", F.col("value_y").alias("y")))
)
query("rolling_whole_step", "events", f"SELECT event_id, y FROM (SELECT event_id, {_need(r('avg(value) OVER w'))} AS y, row_number() OVER ({ORDER}) AS n FROM events {_all5}) WHERE (n - 1) % 3 = 0")(
    lambda df: rounded(wi.roll(df, wi.rolling(EV, 5, step=3), "mean", ["value"], suffix="_y").select("event_id", F.col("value_y").alias("y")))
)
query("rolling_whole_cov", "events", f"SELECT event_id, {_need(r('covar_samp(value, CAST(user_id AS DOUBLE)) OVER w', 2))} AS y FROM events {_all5}")(
    lambda df: rounded(wi.roll_cov(df.withColumn("e", F.col("user_id").cast("double")), wi.rolling(EV, 5), "value", "e", "y").select("event_id", "y"), 2)
)
query("rolling_whole_apply", "events", f"SELECT event_id, {_need(r('max(value) OVER w - min(value) OVER w'))} AS y FROM events {_all5}")(
    lambda df: rounded(wi.roll_apply(df, wi.rolling(EV, 5), lambda s: s.max() - s.min(), "value", "y").select("event_id", "y"))
)
query("window_whole_triang_mean", "events", f"SELECT event_id, CASE WHEN len(l) = 5 THEN {r('s / 3.0')} END AS y FROM (SELECT event_id, l, " + " + ".join(f"l[{i + 1}] * {w!r}" for i, w in enumerate(_tri)) + f" AS s FROM (SELECT event_id, list(value) OVER w AS l FROM events {_all5}))")(
    lambda df: rounded(wi.roll_weighted(df, wi.rolling(EV, 5, weights=wi.weights("triang", 5)), "mean", "value", "y").select("event_id", "y"))
)
# rows of one time count up to the current one: all of earlier times within reach, then those of the same time
for _op, _f in (("sum", "sum(b.value)"), ("max", "max(b.value)"), ("std", "stddev_samp(b.value)")):
    query(f"rolling_whole_time_{_op}", "events", f"SELECT a.event_id, {r(_f, 4)} AS y FROM events a JOIN events b ON b.ts > a.ts - INTERVAL '1 hour' AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id)) GROUP BY a.event_id")(
        lambda df, op=_op: rounded(wi.roll(df, wi.rolling(EV, duration="1h", on="ts"), op, ["value"], suffix="_y").select("event_id", F.col("value_y").alias("y")), 4)
    )
for _op in ("mean", "sum", "min", "max", "std", "var", "sem", "skew", "kurt"):
    query(f"expanding_whole_{_op}", "events", f"SELECT event_id, {_need(r(_rolled[_op], 4), 4)} AS y FROM events WINDOW w AS ({ORDER} {_upto})")(
        lambda df, op=_op: rounded(wi.roll(df, wi.expanding(EV, min_periods=4), op, ["value"], suffix="_y").select("event_id", F.col("value_y").cast("double").alias("y")), 4)
    )
# what is over 300 rows back has a weight below 1e-52
_lst = f"(SELECT event_id, list(value) OVER ({ORDER} ROWS 300 PRECEDING) AS l FROM events)"
for _op, _f in (("mean", r("list_sum(" + _wt.format(e="v") + ") / " + _den)), ("sum", r("list_sum(" + _wt.format(e="v") + ")"))):
    query(f"ewm_whole_{_op}", "events", f"SELECT event_id, {_f} AS y FROM {_lst}")(
        lambda df, op=_op: rounded(ew.ewm(df.select("event_id", "ts", "value"), op, EV, ["value"], span=5, suffix="_y").select("event_id", F.col("value_y").alias("y")))
    )
query("ewm_whole_std", "events", f"SELECT event_id, CASE WHEN len(l) > 1 THEN {r(_v, 4)} END AS y FROM (SELECT event_id, l, {_m} AS m, {_den} AS d FROM {_lst})")(
    lambda df: rounded(ew.ewm(df.select("event_id", "ts", "value"), "std", EV, ["value"], span=5, suffix="_y").select("event_id", F.col("value_y").alias("y")), 4)
)

query("ewm_native", "events", SQL["ewm_mean"])(lambda df: rounded(ew.ewm_native(df, EV, "value", ["user_id"], "y", span=5).select("event_id", "y")))

# strings


def _strings(name, made: Callable[[], dict], sql: dict, table="documents", key="doc_id"):
    query(f"str_{name}", table, f"SELECT {key}, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + f" FROM {table}")(lambda df: df.select(key, *[c.alias(n) for n, c in made().items()]))


_strings("case", lambda: {"a": st.lower("c_name"), "b": st.upper("c_mktsegment"), "c": st.capitalize("c_mktsegment"), "d": st.swapcase("c_name"), "e": st.title("c_mktsegment"), "f": st.casefold("c_name")},
         {"a": "lower(c_name)", "b": "upper(c_mktsegment)", "c": "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])", "d": "array_to_string(list_transform(string_split(c_name, ''), lambda x: CASE WHEN x = upper(x) THEN lower(x) ELSE upper(x) END), '')", "e": "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])", "f": "lower(c_name)"}, "customer", "c_custkey")
_strings("len", lambda: {"n": st.len_("text")}, {"n": "CAST(length(text) AS INT)"})
_strings("strip", lambda: {"a": st.strip("p_name"), "b": st.lstrip("p_name", "abc"), "c": st.rstrip("p_name", "xyz1"), "d": st.removeprefix("p_type", "S"), "e": st.removesuffix("p_type", "L")},
         {"a": "trim(p_name)", "b": "ltrim(p_name, 'abc')", "c": "rtrim(p_name, 'xyz1')", "d": "regexp_replace(p_type, '^S', '')", "e": "regexp_replace(p_type, 'L$', '')"}, "part", "p_partkey")
_strings("pad", lambda: {"a": st.ljust("p_brand", 12, "."), "b": st.rjust("p_brand", 12), "c": st.pad("p_brand", 12, "left", "0"), "d": st.repeat("p_brand", 2)},
         {"a": "CASE WHEN length(p_brand) < 12 THEN rpad(p_brand, 12, '.') ELSE p_brand END", "b": "CASE WHEN length(p_brand) < 12 THEN lpad(p_brand, 12, ' ') ELSE p_brand END", "c": "CASE WHEN length(p_brand) < 12 THEN lpad(p_brand, 12, '0') ELSE p_brand END", "d": "repeat(p_brand, 2)"}, "part", "p_partkey")
_strings("zfill", lambda: {"a": st.zfill(F.col("s_acctbal").cast("int").cast("string"), 7)}, {"a": "CASE WHEN trunc(s_acctbal) < 0 THEN '-' || lpad(CAST(-CAST(trunc(s_acctbal) AS INT) AS VARCHAR), 6, '0') ELSE lpad(CAST(CAST(trunc(s_acctbal) AS INT) AS VARCHAR), 7, '0') END"}, "supplier", "s_suppkey")
_strings("contains", lambda: {"a": st.contains("text", "token", regex=False), "b": st.contains("text", "[0-9]{4}"), "c": st.startswith("text", ("The", "A")), "d": st.endswith("text", "."), "e": st.match("text", "[A-Z]"), "f": st.fullmatch("source", "src[0-9]+")},
         {"a": "contains(text, 'token')", "b": "regexp_matches(text, '[0-9]{4}')", "c": "starts_with(text, 'The') OR starts_with(text, 'A')", "d": "ends_with(text, '.')", "e": "regexp_matches(text, '^[A-Z]')", "f": "regexp_full_match(source, 'src[0-9]+')"})
_strings("count", lambda: {"n": st.count("text", "th")}, {"n": "CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS INT)"})
_strings("find", lambda: {"a": st.find("text", "the"), "b": st.rfind("text", "e")}, {"a": "CAST(instr(text, 'the') - 1 AS INT)", "b": "CAST(CASE WHEN NOT contains(text, 'e') THEN -1 ELSE length(regexp_extract(text, '^(.*)e', 1, 's')) END AS INT)"})
_strings("replace", lambda: {"a": st.replace("source", "src", "s"), "b": st.replace("source", "([a-z]+)([0-9]+)", r"\2\1", regex=True), "c": st.translate("source", {"s": "S", "r": None})},
         {"a": "replace(source, 'src', 's')", "b": r"regexp_replace(source, '([a-z]+)([0-9]+)', '\2\1', 'g')", "c": "translate(source, 'sr', 'S')"})
_strings("slice", lambda: {"a": st.slice("text", 2, 9), "b": st.slice("text", -5), "c": st.get("text", 3), "d": st.get("text", -1), "e": st.slice_replace("source", 1, 2, "_")},
         {"a": "substr(text, 3, 7)", "b": "right(text, 5)", "c": "nullif(substr(text, 4, 1), '')", "d": "nullif(right(text, 1), '')", "e": "substr(source, 1, 1) || '_' || substr(source, 3)"})
_strings("split", lambda: {"n": F.size(st.split("text", " ")), "a": F.get(st.split("source", "r"), F.lit(1)), "b": F.get(st.rsplit("source", "r", 1), F.lit(0))},
         {"n": "CAST(len(string_split(text, ' ')) AS INT)", "a": "string_split(source, 'r')[2]", "b": "string_split(source, 'r')[1]"})
_strings("partition", lambda: {"a": st.partition("source", "r")["before"], "b": st.partition("source", "r")["after"], "c": st.rpartition("source", "c")["before"]},
         {"a": "string_split(source, 'r')[1]", "b": "string_split(source, 'r')[2]", "c": "string_split(source, 'c')[1]"})
_strings("extract", lambda: {"host": st.extract("url", "https?://([^/]+)"), "none": st.extract("url", "(never-there)")}, {"host": "nullif(regexp_extract(url, 'https?://([^/]+)', 1), '')", "none": "CAST(NULL AS VARCHAR)"}, "pages", "page_id")
_strings("findall", lambda: {"n": F.size(st.findall("text", "[A-Z][a-z]+")), "first": F.get(st.findall("text", "[A-Z][a-z]+"), F.lit(0))}, {"n": "CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS INT)", "first": "regexp_extract_all(text, '[A-Z][a-z]+')[1]"})
_strings("predicates", lambda: {"a": st.isalpha("lang"), "b": st.isdigit("source"), "c": st.isalnum("source"), "d": st.islower("source"), "e": st.isupper("lang"), "f": st.isspace("lang"), "g": st.isnumeric("source"), "h": st.isdecimal("source"), "i": st.istitle("lang")},
         {"a": "regexp_full_match(lang, '[a-z]+')", "b": "false", "c": "regexp_full_match(source, '[a-z0-9]+')", "d": "true", "e": "false", "f": "false", "g": "false", "h": "false", "i": "false"})
_strings("cat", lambda: {"a": st.cat("lang", "source", sep="-"), "b": st.join(F.array("lang", "source"), "+"), "c": F.hex(st.encode("lang")), "d": st.decode(F.encode("source", "UTF-8"))},
         {"a": "lang || '-' || source", "b": "lang || '+' || source", "c": "hex(encode(lang))", "d": "source"})
query("str_extractall", "pages", "SELECT page_id, CAST(i - 1 AS INT) AS \"match\", m[i] AS g1 FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS m FROM pages))")(
    lambda df: st.extractall(df.select("page_id", "html"), "html", 'href="([^"]*)"').select("page_id", "match", "g1")
)
query("str_get_dummies", "orders", "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{s}' AS INT) AS \"{s}\"" for s in _st) + " FROM orders")(lambda df: st.get_dummies(df.select("o_orderkey", "o_orderstatus"), "o_orderstatus", tokens=_st).drop("o_orderstatus"))


# datetimes
def _dates(name, made: Callable[[], dict], sql: dict):
    query(f"dt_{name}", "events", "SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + " FROM events")(lambda df: df.select("event_id", *[c.alias(n) for n, c in made().items()]))


_dates("fields", lambda: {"y": dt.year("ts"), "m": dt.month("ts"), "d": dt.day("ts"), "h": dt.hour("ts"), "mi": dt.minute("ts"), "s": dt.second("ts"), "q": dt.quarter("ts"), "doy": dt.dayofyear("ts"), "us": dt.microsecond("ts"), "dim": dt.days_in_month("ts"), "ns": dt.nanosecond("ts")},
       {"y": "CAST(year(ts) AS INT)", "m": "CAST(month(ts) AS INT)", "d": "CAST(day(ts) AS INT)", "h": "CAST(hour(ts) AS INT)", "mi": "CAST(minute(ts) AS INT)", "s": "CAST(second(ts) AS INT)", "q": "CAST(quarter(ts) AS INT)", "doy": "CAST(dayofyear(ts) AS INT)", "us": "CAST(microsecond(ts) % 1000000 AS BIGINT)", "dim": "CAST(day(last_day(ts)) AS INT)", "ns": "0"})
_dates("weekday", lambda: {"a": dt.dayofweek("ts"), "w": dt.week("ts")}, {"a": "CAST(isodow(ts) - 1 AS INT)", "w": "CAST(weekofyear(ts) AS INT)"})
_dates("month_ends", lambda: {"a": dt.is_month_start("ts"), "b": dt.is_month_end("ts"), "c": dt.is_quarter_start("ts"), "d": dt.is_quarter_end("ts"), "e": dt.is_year_start("ts"), "f": dt.is_year_end("ts"), "g": dt.is_leap_year("ts")},
       {"a": "day(ts) = 1", "b": "CAST(ts AS DATE) = last_day(ts)", "c": "day(ts) = 1 AND month(ts) IN (1, 4, 7, 10)", "d": "CAST(ts AS DATE) = last_day(ts) AND month(ts) % 3 = 0", "e": "dayofyear(ts) = 1", "f": "month(ts) = 12 AND day(ts) = 31", "g": "day(last_day(make_date(year(ts), 2, 1))) = 29"})
_us = lambda c: F.unix_micros(c.cast("timestamp"))
_dates("floor_ceil", lambda: {"a": _us(dt.floor("ts", "15min")), "b": _us(dt.ceil("ts", "h")), "c": _us(dt.round("ts", "10min")), "d": _us(dt.normalize("ts"))},
       {"a": "epoch_us(ts) - epoch_us(ts) % 900000000", "b": "epoch_us(date_trunc('hour', ts + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND))", "c": "CAST(round_even(epoch_us(ts) / 600000000.0, 0) AS BIGINT) * 600000000", "d": "epoch_us(date_trunc('day', ts))"})
_dates("strftime", lambda: {"a": dt.strftime("ts", "%Y-%m-%d %H:%M:%S"), "b": dt.time("ts"), "c": dt.to_period("ts", "Q"), "d": dt.to_period("ts", "M")},
       {"a": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "b": "strftime(ts, '%H:%M:%S.%f')", "c": "year(ts) || 'Q' || quarter(ts)", "d": "strftime(ts, '%Y-%m')"})
_dates("day_name", lambda: {"a": dt.day_name("ts"), "b": dt.month_name("ts")}, {"a": "dayname(ts)", "b": "monthname(ts)"})
_dates("isocalendar", lambda: {"y": dt.isocalendar("ts")["year"], "w": dt.isocalendar("ts")["week"], "d": dt.isocalendar("ts")["day"]}, {"y": "CAST(isoyear(ts) AS INT)", "w": "CAST(weekofyear(ts) AS INT)", "d": "CAST(isodow(ts) AS INT)"})
_dates("tz_convert", lambda: {"a": dt.strftime(dt.tz_convert("ts", "+05:30"), "%Y-%m-%d %H:%M:%S")}, {"a": "strftime(ts + INTERVAL '5 hours 30 minutes', '%Y-%m-%d %H:%M:%S')"})
_dates("period", lambda: {"a": _us(dt.period_start("ts", "Q")), "b": _us(dt.period_end("ts", "M"))}, {"a": "epoch_us(date_trunc('quarter', ts))", "b": "epoch_us(date_trunc('month', ts) + INTERVAL 1 MONTH) - 1"})
_since = "ts - timestamp_ntz'2020-01-01 00:00:00'"
_dates("timedelta", lambda: {"d": dt.interval_days(F.expr(_since)), "s": dt.interval_seconds(F.expr(_since)), "t": F.round(dt.total_seconds(F.expr(_since)), 3)},
       {"d": "(epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) // 86400000000", "s": "((epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) % 86400000000) // 1000000", "t": "round((epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) / 1000000.0, 3)"})
