import logging

import pytest
from pyspark.sql import functions as F

from tessera import queries, session
from tessera.sources.tables import from_pandas, read_table, write_table
from tessera.streaming.windowed import windowed

SF = "/root/testdata/sf0.001"


def test_facade(spark):
    frame = session.Frame(spark.range(5).withColumn("x", F.col("id") * 2.0))
    assert frame.reduce_columns("sum", ["x"]).df.first()["value"] == 20.0
    assert "group_agg" in dir(frame) and frame.aggregate("max", ["x"]).df.first()["value"] == 8.0
    with pytest.raises(AttributeError):
        frame.nothing_like_this


def test_logged_progress(spark, caplog):
    log = logging.getLogger("progress")
    with caplog.at_level(logging.INFO, "progress"), session.logged_progress(spark, log):
        spark.range(1000).count()
    assert caplog.records[-1].message == "done"


def test_tables(spark, tmp_path):
    import pandas as pd

    df = from_pandas(spark, pd.DataFrame({"a": [3.0, 1.0]}))
    write_table(df, str(tmp_path), "t")
    assert sorted(map(tuple, read_table(spark, str(tmp_path), "t").collect())) == [(0, 3.0), (1, 1.0)]


def test_streaming(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events*.parquet")
    q = windowed(stream, "ts", "1 day", {"n": ("value", "count"), "s": ("value", "sum")}, ["event_type"]).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize("name", ["zscore", "cumsum_whole", "pivot_margins", "rolling_mean", "str_extract"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    key = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist()))
    assert key(got) == key(want)


def test_queries_without_the_optional_folders(tmp_path):
    """A copy without the text subpackage registers the other queries, with and without the pipeline's file."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root, copy = pathlib.Path(__file__).resolve().parent.parent, tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    for _ in range(2):
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0, said.stderr
        assert said.stdout.split()[1:] == ["True", "False"] and int(said.stdout.split()[0]) > 190
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
