"""From raw documents to token ids: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of ``documents``; the last returns token ids.
``ORACLE_SQL`` is None: SQL can express neither trained filters, nor merge
ranks; stages are tested one by one against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, language, lines, near
from tessera.llm.tables import discard, stored, table

ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, or whose n-grams mostly belong to no language learnt from these documents."""
    return language.keep_known(docs, language.train(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages of two or more lines from the texts; a document stays, with fewer lines."""
    found = lines.dedup_lines(docs, whole=True)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    found = near.near_duplicates(docs, n_words=5, threshold=80)
    return docs.join(found.filter(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a window of a benchmark item."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text: ``doc_id, n_tokens, ids_sha256, ids`` and whether decoding gives the text again."""
    found = bpe.encode(docs, bpe.vocabulary_path(), with_ids=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", known_language),
    ("lines", repeated_lines),
    ("near", near_copies),
    ("benchmark", benchmark_passages),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if written:
            discard(spark, written)
        written = path
    return STAGES[-1][1](spark, docs, sf_dir)
