"""Toxicity scores by a factorization machine over hashed terms.

Terms are lower-cased words and the first ``STEMS`` bytes of longer ones, each
once more for every further occurrence up to ``TIMES``, hashed to ``2**BITS``
places.  Places in ``FLOOR`` documents or more whose presence tells the classes
apart (by the likelihood ratio of their document counts, which holds where a
count is zero) enter a second-order factorization machine: a bias, a weight a
term, and the inner product of two terms' vectors for each pair that occurs
together.  So do both places of a pair that tells them apart only when both
occur, looked for among the ``PAIRED`` most frequent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import bounded, documents_text, held_out, training_labels
from .tables import cut, opened, share, table
from .words import Words, joined, lowered, mix, slices

BITS, STEMS, TIMES, FACTORS = 24, (4, 5, 6), 3, 8
#: Documents a term must occur in, the least likelihood ratio (chi-square of one degree) of a term, and of a pair among millions.
FLOOR, RATIO, PAIR_RATIO = 3, 8.0, 40.0
#: Most frequent terms whose pairs are counted.
PAIRED = 2000
#: Labelled documents learnt from, and their terms, at most (chosen by a hash of the id).
ROWS, TERMS = 8000, 20_000_000
THRESHOLD = 0.7


def terms(texts, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hashed term) pairs, sorted by text; with ``wanted`` only those whose word or stem it marks.

    A place is the hash of a word or stem (``BITS - 2`` bits) and how often it has occurred (the last two bits).
    """
    buffer, offsets = joined(texts)
    words = Words(lowered(buffer), offsets, "alnum")
    doc, size, shift = words.doc(), words.end - words.start, np.uint64(66 - BITS)
    docs, places, code, at = [doc], [words.hash >> shift], np.zeros(len(doc), dtype=np.uint64), 0
    for n in STEMS:
        # a stem is short enough to be a number; shorter words are left out below
        for i in range(at, n):
            code |= words.buffer[np.minimum(words.start + i, len(buffer) - 1)].astype(np.uint64) << np.uint64(8 * i)
        long, at = size > n, n
        docs.append(doc[long])
        places.append(mix(code[long] + (np.uint64(n) << np.uint64(56))) >> shift)
    doc, place = np.concatenate(docs), np.concatenate(places).astype(np.int64)
    if wanted is not None:
        found = wanted[place]
        doc, place = doc[found], place[found]
    key, n = np.unique((doc << (BITS - 2)) | place, return_counts=True)
    key = np.sort(np.concatenate([(key[n > k] << 2) | k for k in range(TIMES)]))
    return key >> BITS, key & ((1 << BITS) - 1)


class Machine:
    """A trained factorization machine: ``place`` of its terms (sorted), bias, weights, factor vectors."""

    def __init__(self, place, bias=0.0, weight=None, factor=None):
        self.place, self.bias = place, bias
        self.weight = np.zeros(len(place)) if weight is None else weight
        self.factor = np.random.default_rng(3).normal(0, 0.02, (len(place), FACTORS)) if factor is None else factor

    def known(self, doc, term):
        at = np.minimum(np.searchsorted(self.place, term), max(0, len(self.place) - 1))
        good = self.place[at] == term if len(self.place) else np.zeros(len(term), dtype=bool)
        return doc[good], at[good]

    def sums(self, n, doc, at):
        total = np.zeros((n, FACTORS))
        square = np.bincount(doc, weights=(self.factor[at] ** 2).sum(1), minlength=n).astype(float)
        for k in range(FACTORS):
            total[:, k] = np.bincount(doc, weights=self.factor[at, k], minlength=n)
        linear = np.bincount(doc, weights=self.weight[at], minlength=n).astype(float)
        return self.bias + linear + 0.5 * ((total**2).sum(1) - square), total

    def score(self, texts) -> np.ndarray:
        wanted = np.zeros(1 << (BITS - 2), dtype=bool)
        wanted[self.place >> 2] = True
        doc, at = self.known(*terms(texts, wanted))
        return 1 / (1 + np.exp(-np.clip(self.sums(len(texts), doc, at)[0], -30, 30)))

    def fit(self, n, doc, at, label, steps=300, rate=0.05, decay=1e-3):
        """Adam on the mean logistic loss over all rows at once; without terms there is only the bias."""
        self.bias = float(np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3)))
        if not len(self.place):
            return self
        moments = [[0.0, 0.0] for _ in range(3)]
        for t in range(1, steps + 1):
            z, total = self.sums(n, doc, at)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / n
            pull = error[doc]
            weight = np.bincount(at, weights=pull, minlength=len(self.place)) + decay * self.weight / len(self.place)
            factor = np.stack([np.bincount(at, weights=pull * (total[doc, k] - self.factor[at, k]), minlength=len(self.place)) for k in range(FACTORS)], axis=1)
            factor += decay * self.factor / len(self.place)
            for i, slope in enumerate((error.sum(), weight, factor)):
                moments[i][0] = 0.9 * moments[i][0] + 0.1 * slope
                moments[i][1] = 0.999 * moments[i][1] + 0.001 * slope**2
                step = rate * (moments[i][0] / (1 - 0.9**t)) / (np.sqrt(moments[i][1] / (1 - 0.999**t)) + 1e-8)
                if i == 0:
                    self.bias -= float(step)
                elif i == 1:
                    self.weight -= step
                else:
                    self.factor -= step
        return self


def _gain(seen, expected):
    """``seen * log(seen / expected)``, 0 where nothing is seen."""
    return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)


def interacting(code, doc, label, all_, one):
    """Numbers of terms in pairs whose toxic share differs from what the odds of both terms give. ``all_``, ``one``: documents, toxic ones of each term."""
    often = np.sort(np.argsort(-all_, kind="stable")[:PAIRED])
    often = often[all_[often] >= FLOOR]
    at = np.full(len(all_), -1)
    at[often] = np.arange(len(often))
    found = at[code] >= 0
    has = np.zeros((len(label), len(often)), dtype=np.float32)
    has[doc[found], at[code[found]]] = 1
    n, n1 = len(label), label.sum()
    base = np.log((n1 + 0.5) / (n - n1 + 0.5))
    odds = np.log((one[often] + 0.5) / (all_[often] - one[often] + 0.5)) - base
    toxic, good = has[label > 0], np.zeros(len(often), dtype=bool)
    for i in range(0, len(often), 250):
        both, bad = (has[:, i : i + 250].T @ has).astype(float), (toxic[:, i : i + 250].T @ toxic).astype(float)
        expected = both / (1 + np.exp(-np.clip(base + odds[i : i + 250, None] + odds, -30, 30)))
        ratio = 2 * (_gain(bad, expected) + _gain(both - bad, both - expected))
        # a pair that always occurs together is one term counted twice
        apart = both < 0.9 * np.minimum(all_[often][i : i + 250, None], all_[often])
        x, y = np.nonzero((ratio >= PAIR_RATIO) & apart & (both >= FLOOR))
        good[x + i] = good[y] = True
    return often[good]


def screen(doc, term, label):
    """Places that tell the classes apart alone, and those that do in pairs."""
    if not len(term):
        return np.empty(0, np.int64)
    place, code = np.unique(term, return_inverse=True)
    n, n1 = len(label), label.sum()
    all_ = np.bincount(code, minlength=len(place)).astype(float)
    one = np.bincount(code, weights=label[doc], minlength=len(place))
    share = n1 / n
    ratio = 2 * (_gain(one, all_ * share) + _gain(all_ - one, all_ * (1 - share)) + _gain(n1 - one, (n - all_) * share) + _gain(n - all_ - n1 + one, (n - all_) * (1 - share)))
    keep = np.flatnonzero((all_ >= FLOOR) & (ratio >= RATIO))
    return place[np.union1d(keep, interacting(code, doc, label, all_, one))]


def _terms(batches):
    for piece in slices(batches):
        doc, term = terms(piece.column("text"))
        ends = np.searchsorted(doc, np.arange(len(piece) + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term, pa.int32()))
        yield pa.RecordBatch.from_arrays([piece.column("label"), lists], names=["label", "terms"])


def train(documents: DataFrame, labels: DataFrame, rows: int = ROWS, parts: int = 3, part: int = 1) -> Machine:
    """Fit on at most about ``rows`` labelled documents, of ``TERMS`` terms in all, outside the held-out fold.

    Without any document every score is 0.5; without a term that tells the classes apart it is the share of label 1.
    """
    chosen = bounded(training_labels(labels, "toxic", parts, part), rows)
    # the sample has a bound, so it may be broadcast
    texts = documents_text(documents).join(F.broadcast(chosen), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text"))
    found = cut(texts.mapInArrow(_terms, "label int, terms array<int>"))
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    if total > TERMS:
        found = found.filter(F.pmod(F.xxhash64("terms"), F.lit(1 << 30)) < int((1 << 30) * TERMS / total))
    found = found.toArrow()
    label = np.array(found.column("label").to_pylist(), dtype=float)
    if not len(label):
        return Machine(np.empty(0, np.int64))
    lists = found.column("terms").combine_chunks()
    term = lists.flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(label)), np.asarray(lists.value_lengths()))
    machine = Machine(screen(doc, term, label))
    doc, at = machine.known(doc, term)
    return machine.fit(len(label), doc, at, label)


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` of each whole text, however long; null counts as empty. Repeated ids and rows each give their own row."""
    shared = share(documents.sparkSession, machine)

    def run(batches):
        known = opened(shared)
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(known.score(piece.column("text")), pa.float64())], names=["doc_id", "score"])

    return documents_text(documents).mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
