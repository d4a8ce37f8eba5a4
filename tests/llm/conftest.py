import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, hash string, node int, component string, k int, g string, gone string, label int, n string"


def frame(spark, texts, lang=None, first=0):
    """Documents with clashing extra columns; ids count from ``first``."""
    rows = [(first + i, t, (lang[i] if lang else "en"), "s", len(t or ""), "h", 1, "c", 2, "g", "x", 3, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="session")
def real(spark):
    """A few hundred of the synthetic documents, with edge cases."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    return [r["text"] for r in rows] + edges()


def edges():
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(30000))
    return [None, "", " ", "\n", "\n\n\n", "one", "two words", "tab\tand\x0bmore\x0c\r\n", "ß é 日本語 🙂 ́", "!!! ???", long, long + " tail", "same text here " * 20, "same text here " * 20]


@pytest.fixture
def make(spark):
    return lambda texts, **kw: frame(spark, texts, **kw)
