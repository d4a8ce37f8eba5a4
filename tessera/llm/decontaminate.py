"""Benchmark decontamination by winnowing.

Every window of ``WINDOW`` benchmark words keeps the least hash of the
``KGRAM``-grams inside it, its fingerprint.  A document window with the same
words has the same fingerprint, so joining fingerprints finds every shared span
of ``WINDOW`` words; each hit is then extended to the full window by two
independent 64-bit hashes of all its words.  Items of fewer words form one
window of their own length, which is its own fingerprint.

Both sides are tables dealt by hash.  Only a bitmap of the benchmark's
fingerprints, of ``MOST_BITS`` bits at most, goes to the executors: it keeps
document windows that can't meet any from being dealt out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .learn import documents_text
from .tables import cut, opened, share, table
from .words import Words, grams, joined, least, lowered, row_grams, slices

WINDOW, KGRAM = 10, 5
#: Bits of the bitmap a fingerprint, and the least and most bits in all, as powers of two; a byte row packs 2**15.
BITS, LEAST_BITS, MOST_BITS, ROW = 16, 16, 26, 15


def _item_windows(window: int, kgram: int):
    def run(batches):
        for piece in slices(batches):
            words = Words(*_lower(piece.column("text")), "alnum")
            ids, out = piece.column("item_id").to_pylist(), []
            for item, a, b in zip(ids, words.first[:-1], words.first[1:], strict=True):
                if item is None or a == b:
                    continue
                h, n = words.hash[a:b], int(min(window, b - a))
                one, two = grams(h, n, 31), grams(h, n, 32)
                kept = least(grams(h, kgram, 33), n - kgram + 1) if n == window else one
                out.append((np.full(len(one), n), one, two, kept, np.full(len(one), item)))
            if out:
                size, one, two, kept, item = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(size, pa.int64()), *(pa.array(x.view(np.int64)) for x in (one, two, kept)), pa.array(item, pa.int64())],
                    names=["size", "one", "two", "kept", "item_id"],
                )

    return run


def _lower(texts):
    buffer, offsets = joined(texts)
    return lowered(buffer), offsets


def _packed(pdf):
    bits = np.zeros(1 << ROW, dtype=bool)
    bits[pdf["place"].to_numpy() & ((1 << ROW) - 1)] = True
    return pd.DataFrame({"row": pdf["row"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _bitmap(items: DataFrame, bits: int | None) -> tuple[int, np.ndarray]:
    """Bits, as a power of two, and the bitmap over the leading bits of all fingerprints; rows of it are packed by executors."""
    known = items.select("kept").distinct()
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, known.count()) * BITS))))
    known = known.select(F.shiftrightunsigned("kept", 64 - bits).alias("place")).distinct().withColumn("row", F.shiftright("place", ROW))
    out = np.zeros(((1 << max(bits, ROW)) + 7) // 8, dtype=np.uint8)
    for r in known.groupBy("row").applyInPandas(_packed, "row long, bits binary").toLocalIterator():
        at = r["row"] << (ROW - 3)
        out[at : at + (1 << (ROW - 3))] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits, out


def _scan(shared, window: int, kgram: int):
    """Number of words of each text, and its windows whose fingerprints the bitmap has."""

    def run(batches):
        sizes, bits, bitmap = opened(shared)
        shift = np.uint64(64 - bits)
        for piece in slices(batches):
            words = Words(*_lower(piece.column("text")), "alnum")
            parts = []
            for size in sizes:
                if len(words.hash) < size:
                    continue
                mine = least(grams(words.hash, kgram, 33), size - kgram + 1) if size == window else grams(words.hash, size, 31)
                place = mine >> shift
                at = np.flatnonzero(((bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0) & words.windows(size)[: len(mine)])
                spans = words.hash[at[:, None] + np.arange(size)]
                parts.append((at, np.full(len(at), size), mine[at].view(np.int64), *(row_grams(spans, salt).view(np.int64) for salt in (31, 32))))
            at, *columns = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0, np.int64)] * 5
            order = np.argsort(at, kind="stable")
            at, doc = at[order], np.searchsorted(words.first, at[order], side="right") - 1
            ends = np.searchsorted(doc, np.arange(len(piece) + 1))
            hits = pa.StructArray.from_arrays([pa.array(at - words.first[doc]), *(pa.array(c[order]) for c in columns)], names=["at", "size", "kept", "one", "two"])
            columns = [piece.column(c) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words.count, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)], names=["doc_id", "k1", "k2", "n_words", "hits"])

    return run


def _keyed(documents: DataFrame, one: str, two: str) -> DataFrame:
    """Two hashes of id and text: rows that have both in common have the same hits."""
    return documents.withColumn(one, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).withColumn(two, F.xxhash64(F.col("text").cast("string"), F.col("doc_id").cast("long"), F.lit(7)))


def _search(documents: DataFrame, benchmark: DataFrame, window: int, kgram: int, bits: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, n_words), the windows found (k1, k2, at, size, one, two), and the items' windows."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = cut(items.mapInArrow(_item_windows(window, kgram), "size long, one long, two long, kept long, item_id long").distinct())
    windows = cut(items.select("kept", "size", "one", "two").distinct())
    # a window has at most ``window`` words, so there are no more sizes
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    shared = share(documents.sparkSession, (sizes, *_bitmap(windows, bits)))
    schema = "doc_id long, k1 long, k2 long, n_words long, hits array<struct<at:long,size:long,kept:long,one:long,two:long>>"
    rows = cut(_keyed(documents_text(documents), "k1", "k2").mapInArrow(_scan(shared, window, kgram), schema))
    hits = rows.select("k1", "k2", F.explode("hits").alias("h")).select("k1", "k2", "h.*")
    found = cut(hits.join(windows, ["kept", "size", "one", "two"]).select("k1", "k2", "at", "size", "one", "two"))
    return rows.drop("hits"), found, items


def contaminated_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, kgram: int = KGRAM, bits: int | None = None) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, n_words, runs, items``.

    ``runs`` holds word positions start, end, start, end ... covered by benchmark
    windows, ``items`` the ids of the items they belong to.  Null and empty texts
    have no words and no hits; benchmark rows without text or id are ignored;
    repeated items count each.  Each row of ``documents`` has its own hits, also
    where ids are null or repeated; long texts are searched whole.  ``bits`` sets
    the size of the bitmap, which changes no result.
    """
    rows, found, items = _search(documents, benchmark, window, kgram, bits)
    key = ["k1", "k2"]
    each = Window.partitionBy(*key).orderBy("at", "end")
    spans = found.select(*key, "at", (F.col("at") + F.col("size")).alias("end")).distinct()
    spans = spans.withColumn("new", F.coalesce(F.col("at") > F.max("end").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    spans = spans.withColumn("run", F.sum("new").over(each.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy(*key, "run").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    runs = runs.groupBy(*key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "end"))), lambda r: F.array(r["at"], r["end"]))).alias("runs"))
    named = found.select(*key, "size", "one", "two").distinct().join(items.select("size", "one", "two", "item_id"), ["size", "one", "two"])
    named = named.groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<long>")
    out = rows.join(runs, key, "left").join(named, key, "left")
    return out.select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"), F.coalesce("items", none).alias("items"))


def without_benchmark(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, kgram: int = KGRAM) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that contain no window of an item."""
    _, found, _ = _search(documents, benchmark, window, kgram, None)
    hit = found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    return _keyed(documents, "__k1", "__k2").join(hit, ["__k1", "__k2"], "left_anti").select(*documents.columns)


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``contaminated_spans``: ``n_hit, n_items, items_sha256, contaminated``."""
    hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated")
    )


def op6_decontaminate(spark, sf_dir):
    return report(contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: The same windows by plain string equality.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS s
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0 AND item_id IS NOT NULL)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
