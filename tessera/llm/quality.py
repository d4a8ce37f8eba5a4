"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each document is reduced to a short vector of statistics.  A random Fourier map
of the standardised vector approximates a Gaussian kernel; partitions sum the
normal equations of all labelled rows, whose sums are added in groups, and the
driver solves one small system.  Binned scores of the labelled rows are
made monotone by pooling adjacent violators, which turns a score into a
probability.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import documents_text, held_out, training_labels
from .tables import cut, opened, share, table
from .words import Words, grams, joined, lowered, slices

FEATURES, WIDTH, RIDGE, BINS = 160, 4.0, 1e-4, 1000
THRESHOLD = 0.3
NAMES = (
    "log_bytes log_words log_lines word_mean word_std upper lower digit mark space high bang bar distinct_words distinct_pairs distinct_fives "
    "top_word repeated_lines ends_marked starts_upper runs byte_entropy stop_rate short_words long_words"
).split()


def statistics(texts) -> np.ndarray:
    """One row of ``NAMES`` per text; an empty text has zeros."""
    buffer, offsets = joined(texts)
    words = Words(buffer, offsets, "spaced")
    n, size, count = len(texts), np.diff(offsets) - 1, words.count
    owner = np.repeat(np.arange(n), size + 1)
    per = lambda mask: np.bincount(owner, weights=mask.astype(np.float64), minlength=n)
    upper, lower = (buffer >= 0x41) & (buffer <= 0x5A), (buffer >= 0x61) & (buffer <= 0x7A)
    digit, high, space = (buffer >= 0x30) & (buffer <= 0x39), buffer >= 0x80, ~(buffer > 0x20)
    mark = (buffer > 0x20) & ~upper & ~lower & ~digit & ~high
    line = np.zeros(len(buffer), dtype=bool)
    line[:] = buffer == 0x0A
    same = np.concatenate(([False], (buffer[1:] == buffer[:-1]) & ~space[1:]))
    doc, length = words.doc(), (words.end - words.start).astype(np.float64)
    in_words = lambda x: np.bincount(doc, weights=x, minlength=n)
    w, b = np.maximum(count, 1).astype(np.float64), np.maximum(size, 1).astype(np.float64)
    mean = in_words(length) / w
    out = np.zeros((n, len(NAMES)))
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(count), np.log1p(per(line))
    out[:, 3], out[:, 4] = mean, np.sqrt(np.maximum(in_words(length**2) / w - mean**2, 0))
    for k, mask in enumerate((upper, lower, digit, mark, space, high, buffer == 0x21, buffer == 0x7C)):
        out[:, 5 + k] = (per(mask) - (mask[offsets[1:] - 1])) / b
    distinct = lambda h, owner: np.bincount(_distinct(h, owner), minlength=n)
    low = Words(lowered(buffer), offsets, "spaced").hash
    out[:, 13] = distinct(low, doc) / w
    for k, g in ((14, 2), (15, 5)):
        good = words.windows(g)[: max(0, len(low) - g + 1)]
        have = grams(low, g, 41)[good] if len(low) >= g else np.empty(0, np.uint64)
        out[:, k] = distinct(have, doc[: len(good)][good]) / np.maximum(count - g + 1, 1)
    out[:, 16] = _top(low, doc, n) / w
    lines = Words(np.where(buffer == 0x0A, 0x20, np.where(space, 0x5F, buffer)).astype(np.uint8), offsets, "spaced")
    out[:, 17] = 1 - np.bincount(_distinct(lines.hash, lines.doc()), minlength=n) / np.maximum(lines.count, 1)
    last, first = buffer[words.end - 1], buffer[words.start]
    out[:, 18] = in_words(mark[words.end - 1].astype(float)) / w
    out[:, 19] = in_words(((first >= 0x41) & (first <= 0x5A)).astype(float)) / w
    out[:, 20] = per(same) / b
    out[:, 21] = _entropy(buffer, owner, offsets, n)
    out[:, 22] = in_words((length <= 3).astype(float) * (last >= 0x61)) / w
    out[:, 23], out[:, 24] = in_words((length <= 2).astype(float)) / w, in_words((length >= 14).astype(float)) / w
    out[size <= 0] = 0
    return out


def _distinct(values, owner):
    """Owners of the distinct (owner, value) pairs."""
    if not len(values):
        return np.empty(0, np.int64)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    return o[np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])))]


def _top(values, owner, n):
    """How often each owner's most frequent value occurs."""
    out = np.zeros(n)
    if len(values):
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        new = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1]))))
        np.maximum.at(out, o[new], np.diff(np.append(new, len(v))))
    return out


def _entropy(buffer, owner, offsets, n):
    out = np.zeros(n)
    for at in range(0, n, 4096):
        to = min(n, at + 4096)
        part = slice(offsets[at], offsets[to])
        table = np.bincount((owner[part] - at) * 256 + buffer[part], minlength=(to - at) * 256).reshape(-1, 256).astype(np.float64)
        share = table / np.maximum(table.sum(1, keepdims=True), 1)
        out[at:to] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    return out


def _measure(batches):
    for piece in slices(batches):
        rows = statistics(piece.column("text"))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), flat], names=["doc_id", "stats"])


def measure(documents: DataFrame) -> DataFrame:
    """``doc_id, stats``: the statistics of each whole text, however long; null counts as empty. Repeated ids and rows each give their own row."""
    return documents_text(documents).mapInArrow(_measure, "doc_id long, stats array<double>")


class Model:
    def __init__(self, mean, scale):
        rng = np.random.default_rng(17)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.turn = rng.normal(0, 1 / WIDTH, (len(NAMES), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weight, self.edges, self.values = np.zeros(FEATURES + 1), np.array([0.5]), np.array([0.5])

    def features(self, stats):
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack((np.cos(z @ self.turn + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))))

    def raw(self, stats):
        return self.features(stats) @ self.weight

    def score(self, stats):
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0.0, 1.0)


def _stats(batch):
    lists = batch.column("stats")
    return np.asarray(lists.flatten()).reshape(-1, len(NAMES))


def pooled(count, total):
    """Isotonic means of neighbouring bins (pool adjacent violators)."""
    blocks = []
    for n, s in zip(count, total, strict=True):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n1, s1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n1, blocks[-1][1] + s1, blocks[-1][2] + k1]
    return np.concatenate([np.full(k, s / n) for n, s, k in blocks])


def _added(pdf):
    return pd.DataFrame({"total": [sum(np.frombuffer(x) for x in pdf["total"]).tobytes()]})


def train(measured: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0) -> Model:
    """Fit on all labelled rows outside the held-out fold. Without any, every score is 0.5."""
    rows = measured.join(training_labels(labels, "quality", parts, part), "doc_id").select("stats", F.col("label").cast("double").alias("label"))
    rows = cut(rows)
    moments = rows.select(*[F.col("stats")[i].alias(f"s{i}") for i in range(len(NAMES))]).agg(
        F.count("*").alias("n"), *[F.avg(f"s{i}").alias(f"m{i}") for i in range(len(NAMES))], *[F.stddev_pop(f"s{i}").alias(f"d{i}") for i in range(len(NAMES))]
    ).first()
    if not moments["n"]:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    model = Model(np.array([moments[f"m{i}"] for i in range(len(NAMES))]), np.array([moments[f"d{i}"] for i in range(len(NAMES))]))

    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = model.features(_stats(batch))
            total += x.T @ np.column_stack((x, np.asarray(batch.column("label"))))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "total"])

    # one sum of fixed size a task; of n tasks about sqrt(n) sums reach the driver
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    partial = rows.mapInArrow(sums, "g int, total binary")
    partial = partial.withColumn("g", F.pmod("g", F.lit(groups))).groupBy("g").applyInPandas(_added, "total binary").collect()
    total = sum(np.frombuffer(r["total"]).reshape(FEATURES + 1, FEATURES + 2) for r in partial)
    model.weight = np.linalg.solve(total[:, :-1] + RIDGE * moments["n"] * np.eye(FEATURES + 1), total[:, -1])

    def scored(batches):
        for batch in batches:
            place = np.clip((model.raw(_stats(batch)) + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("label")], names=["place", "label"])

    bins = rows.mapInArrow(scored, "place int, label double").groupBy("place").agg(F.count("*").alias("n"), F.sum("label").alias("s")).orderBy("place").collect()
    place, n, s = (np.array(x, dtype=float) for x in zip(*[(r["place"], r["n"], r["s"]) for r in bins], strict=True))
    model.edges, model.values = (place + 0.5) * 2 / BINS - 0.5, pooled(n, s)
    return model


def score(measured: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` (the calibrated probability of label 1)."""
    shared = share(measured.sparkSession, model)

    def run(batches):
        known = opened(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(known.score(_stats(batch)))], names=["doc_id", "score"])

    return measured.select(F.col("doc_id").cast("long"), "stats").mapInArrow(run, "doc_id long, score double")


def op10_quality(spark, sf_dir):
    measured = cut(measure(table(spark, sf_dir, "documents")))
    found = score(measured, train(measured, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
