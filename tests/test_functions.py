"""String and datetime functions against pandas on edge values."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import datetimes as dt
from tessera.functions import strings as st

TEXTS = ["Alpha", "beta", "GAMMA", "delta42", "Eps-ilon", "zeta ", " \tpad\n", "-12", "+7", "", None, "straße", "É été", "they're a-b", "aXaXa", "日本語", "42", "½", "²"]
TIMES = ["2020-02-29 23:59:59.999999", "2021-01-01 00:00:00", "2019-12-31 12:30:45.5", "1969-12-31 23:00:00", "2024-03-31 07:05:00", "2000-06-30 00:00:00.000001", None]


def strings(spark, column):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "i int, s string")
    return [r["y"] for r in table.select("i", column.alias("y")).orderBy("i").collect()]


CASES = {
    "lower": (lambda: st.lower("s"), lambda s: s.lower()),
    "upper": (lambda: st.upper("s"), lambda s: s.upper()),
    "capitalize": (lambda: st.capitalize("s"), lambda s: s.capitalize()),
    "title": (lambda: st.title("s"), lambda s: s.title()),
    "swapcase": (lambda: st.swapcase("s"), lambda s: s.swapcase()),
    "casefold": (lambda: st.casefold("s"), lambda s: s.casefold()),
    "len": (lambda: st.len_("s"), lambda s: s.len()),
    "strip": (lambda: st.strip("s"), lambda s: s.strip()),
    "lstrip": (lambda: st.lstrip("s", "Ab"), lambda s: s.lstrip("Ab")),
    "rstrip": (lambda: st.rstrip("s"), lambda s: s.rstrip()),
    "contains": (lambda: st.contains("s", "A.", case=False), lambda s: s.contains("A.", case=False)),
    "match": (lambda: st.match("s", "[a-z]"), lambda s: s.match("[a-z]")),
    "fullmatch": (lambda: st.fullmatch("s", "[a-z]+[0-9]*"), lambda s: s.fullmatch("[a-z]+[0-9]*")),
    "startswith": (lambda: st.startswith("s", ("A", "b")), lambda s: s.startswith(("A", "b"))),
    "count": (lambda: st.count("s", "[aA]"), lambda s: s.count("[aA]")),
    "find": (lambda: st.find("s", "a"), lambda s: s.find("a")),
    "rfind": (lambda: st.rfind("s", "Xa"), lambda s: s.rfind("Xa")),
    "replace": (lambda: st.replace("s", "a", "[$1]"), lambda s: s.replace("a", "[$1]")),
    "replace_regex": (lambda: st.replace("s", "([a-z])([A-Z])", r"\2\1", regex=True), lambda s: s.replace("([a-z])([A-Z])", r"\2\1", regex=True)),
    "replace_n": (lambda: st.replace("s", "a", "_", n=1), lambda s: s.replace("a", "_", n=1)),
    "removeprefix": (lambda: st.removeprefix("s", "a"), lambda s: s.removeprefix("a")),
    "removesuffix": (lambda: st.removesuffix("s", "a"), lambda s: s.removesuffix("a")),
    "slice": (lambda: st.slice("s", -3, -1), lambda s: s.slice(-3, -1)),
    "slice_step": (lambda: st.slice("s", None, None, 2), lambda s: s.slice(None, None, 2)),
    "slice_replace": (lambda: st.slice_replace("s", 1, -1, "*"), lambda s: s.slice_replace(1, -1, "*")),
    "get": (lambda: st.get("s", -2), lambda s: s.get(-2)),
    "split": (lambda: st.split("s"), lambda s: s.split()),
    "split_sep": (lambda: st.split("s", "a", 1), lambda s: s.split("a", n=1)),
    "rsplit": (lambda: st.rsplit("s", "a", 1), lambda s: s.rsplit("a", n=1)),
    "findall": (lambda: st.findall("s", "[a-z]a"), lambda s: s.findall("[a-z]a")),
    "ljust": (lambda: st.ljust("s", 8, "."), lambda s: s.ljust(8, ".")),
    "rjust": (lambda: st.rjust("s", 8), lambda s: s.rjust(8)),
    "center": (lambda: st.center("s", 8, "*"), lambda s: s.center(8, "*")),
    "center_odd": (lambda: st.center("s", 9, "*"), lambda s: s.center(9, "*")),
    "zfill": (lambda: st.zfill("s", 6), lambda s: s.zfill(6)),
    "repeat": (lambda: st.repeat("s", 2), lambda s: s.repeat(2)),
    "translate": (lambda: st.translate("s", str.maketrans({"a": "4", "e": None})), lambda s: s.translate(str.maketrans({"a": "4", "e": None}))),
    "normalize": (lambda: st.normalize("s", "NFKD"), lambda s: s.normalize("NFKD")),
    "wrap": (lambda: st.wrap("s", 5), lambda s: s.wrap(5)),
    "join": (lambda: st.join_letters("s", "-"), lambda s: s.join("-")),
    **{n: ((lambda n=n: getattr(st, n)("s")), (lambda s, n=n: getattr(s, n)())) for n in ("isalpha", "isdigit", "isalnum", "isspace", "islower", "isupper", "istitle", "isnumeric", "isdecimal")},
}


@pytest.mark.parametrize("name", CASES)
def test_string(spark, name):
    made, pandas = CASES[name]
    want = [None if x is None or x != x else x for x in pandas(pd.Series(TEXTS, dtype=object).str)]
    assert [list(x) if isinstance(x, list) else x for x in strings(spark, made())] == want


def test_partition_extract_dummies(spark):
    table = spark.createDataFrame([(0, "a-b-c"), (1, "none"), (2, None)], "i int, s string")
    got = table.orderBy("i").select(st.partition("s", "-").alias("p"), st.rpartition("s", "-").alias("r"), st.extract("s", "([a-z])-([a-z])", 2).alias("e")).collect()
    assert [tuple(r["p"]) if r["p"] else None for r in got] == [("a", "-", "b-c"), ("none", "", ""), None]
    assert [tuple(r["r"]) if r["r"] else None for r in got] == [("a-b", "-", "c"), ("", "", "none"), None]
    assert [r["e"] for r in got] == ["b", None, None]
    assert st.extractall(table, "s", "([a-z])(-|$)", 2).count() == 4
    assert st.get_dummies(table, "s", "-").columns == ["i", "s", "a", "b", "c", "none"]
    assert st.expand(table, st.split("s", "-"), 2).orderBy("i").first()["c1"] == "b"
    with pytest.raises(Exception, match="substring not found"):
        table.select(st.index("s", "zz")).collect()


FIELDS = "year month day hour minute second quarter dayofyear dayofweek days_in_month microsecond is_month_start is_month_end is_quarter_start is_quarter_end is_year_start is_year_end is_leap_year day_name month_name".split()


def test_datetimes(spark):
    series = pd.Series(pd.to_datetime(TIMES, format="ISO8601"))
    table = spark.createDataFrame(list(enumerate(TIMES)), "i int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    made = {n: getattr(dt, n)("t") for n in FIELDS}
    for n, f in (("floor", "15min"), ("ceil", "h"), ("round", "10s"), ("floor", "D")):
        made[f"{n} {f}"] = F.unix_micros(getattr(dt, n)("t", f).cast("timestamp"))
    made["strftime"] = dt.strftime("t", "%Y/%m/%d %H:%M:%S.%f 'at' %j")
    got = table.orderBy("i").select(*[c.alias(n) for n, c in made.items()]).collect()
    for n in made:
        if n == "strftime":
            want = series.dt.strftime("%Y/%m/%d %H:%M:%S.%f 'at' %j")
        elif " " in n:
            want = getattr(series.dt, n.split()[0])(n.split()[1]).astype("int64") // 1000
        else:
            want = getattr(series.dt, n)() if n.endswith("_name") else getattr(series.dt, n)
        for row, w in list(zip(got, want))[:-1]:
            assert row[n] == w, n
        assert got[-1][n] is None or n.startswith("is_")
    iso = table.orderBy("i").select(dt.isocalendar("t").alias("c")).collect()
    assert [tuple(r["c"]) for r in iso[:-1]] == [tuple(x) for x in series.dt.isocalendar().to_numpy().tolist()[:-1]]


def test_intervals(spark):
    row = spark.sql("select interval '-1 02:03:04.5' day to second as i").select(dt.interval_days("i").alias("d"), dt.interval_seconds("i").alias("s"), dt.total_seconds("i").alias("t"), dt.interval_components("i").alias("c")).first()
    t = -pd.Timedelta(days=1, hours=2, minutes=3, seconds=4.5)
    assert (row["d"], row["s"], row["t"]) == (t.days, t.seconds, t.total_seconds())
    assert tuple(row["c"]) == tuple(t.components)
