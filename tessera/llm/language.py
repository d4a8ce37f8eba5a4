"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each of its positions, one bit per
language.  An n-gram sets its language's bit at ``HASHES`` positions; ANDing
those positions returns at once every language that (nearly surely) has the
n-gram.  A text's per-language popcounts, corrected for each slice's false
positives, decide; the score is the corrected share of n-grams the language has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import documents_text, held_out
from .tables import opened, share, table
from .words import byte_class, joined, lowered, mix, slices

NGRAM, HASHES, BITS = 4, 3, 20
#: Documents a language is learnt from, at most (chosen by a hash of the id).
ROWS = 4000
#: An n-gram belongs to a language if at least this share of its sampled documents have it.
LEAST = 5e-4
#: A text below this score, or of no language, is rejected by ``keep_known``.
ACCEPT = 0.3


def ngrams(texts) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram code, text) of all n-grams of lower-cased bytes around letters; anything but letters is a gap."""
    buffer, offsets = joined(texts)
    low = lowered(buffer)
    letter = byte_class("alnum")[low] & ~((low >= 0x30) & (low <= 0x39))
    plain = np.concatenate(([0x20], np.where(letter, low, 0x20))).astype(np.uint32)
    inside = np.concatenate(([False], letter))
    n = len(plain) - NGRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = np.zeros(n, dtype=np.uint64)
    for i in range(NGRAM):
        code = (code << np.uint64(8)) | plain[i : i + n].astype(np.uint64)
    at = np.flatnonzero(inside[1 : 1 + n] & inside[2 : 2 + n])
    return code[at], np.searchsorted(offsets, at, side="right") - 1


def _count(batches):
    for piece in slices(batches):
        code, doc = ngrams(piece.column("text"))
        lang = np.array(piece.column("lang").to_pylist(), dtype=object)
        pair = np.unique((doc.astype(np.uint64) << np.uint64(32)) | code)
        frame = pd.DataFrame({"lang": lang[(pair >> np.uint64(32)).astype(np.int64)], "code": (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)})
        frame = frame.value_counts().reset_index(name="n")
        yield pa.RecordBatch.from_arrays([pa.array(frame["lang"], pa.string()), pa.array(frame["code"], pa.int64()), pa.array(frame["n"], pa.int64())], names=["lang", "code", "n"])


class Filters:
    """Masks of shape (words of 64 languages, positions); ``rate``: each language's false-positive rate."""

    def __init__(self, languages: list[str], grams: pd.DataFrame):
        self.languages = languages
        self.mask = np.zeros((max(1, -(-len(languages) // 64)), 1 << BITS), dtype=np.uint64)
        index = {x: i for i, x in enumerate(languages)}
        fill = []
        for lang, codes in grams.groupby("lang")["code"]:
            i = index[lang]
            for place in self.places(codes.to_numpy().view(np.uint64)):
                self.mask[i // 64, place] |= np.uint64(1 << (i % 64))
        for i in range(len(languages)):
            fill.append(float(((self.mask[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()))
        self.rate = np.array(fill) ** HASHES

    @staticmethod
    def places(code):
        h = mix(code)
        return [(h >> np.uint64(1 + 21 * k)) & np.uint64((1 << BITS) - 1) for k in range(HASHES)]

    def decide(self, texts) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        code, doc = ngrams(texts)
        n = np.bincount(doc, minlength=len(texts)).astype(float)
        places, share = self.places(code), np.zeros((len(self.languages), len(texts)))
        for w, row in enumerate(self.mask):
            mask = row[places[0]]
            for place in places[1:]:
                mask &= row[place]
            for i in range(w * 64, min(w * 64 + 64, len(self.languages))):
                count = np.bincount(doc, weights=((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.float64), minlength=len(texts))
                free = 1 - self.rate[i]
                share[i] = np.clip((count - n * self.rate[i]) / np.maximum(n, 1) / free, 0, 1) if free > 0 else 0
        lettered = [any(c.isalpha() for c in t) if t else False for t in texts.to_pylist()]
        best = share.argmax(0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, share.max(0), 0.0)


def train(documents: DataFrame, rows: int = ROWS, parts: int = 4, part: int = 2) -> Filters:
    """Learn from at most about ``rows`` documents of each language outside the held-out fold.

    The driver holds one filter slice and the sampled n-grams per distinct value of ``lang``, a closed set of names.
    Repeated rows count as often as they occur.
    """
    known = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(parts, part))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Filters([], pd.DataFrame({"lang": [], "code": []}))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int((1 << 30) * min(1.0, rows / n)))])
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < share[F.col("lang")])
    grams = sample.select("lang", "text").mapInArrow(_count, "lang string, code long, n long")
    grams = grams.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    needed = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, LEAST * min(rows, n))])
    return Filters(sorted(counts), grams.filter(F.col("n") >= needed[F.col("lang")]).select("lang", "code").toPandas())


def identify(documents: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id, lang_pred, score``. Null texts and texts without a letter are ``und`` with score 0; ties go to the first language in order.

    Every n-gram of a text counts, however long it is; each row is judged by itself, so repeated ids and rows each give their own row.
    """
    shared = share(documents.sparkSession, filters)

    def run(batches):
        known = opened(shared)
        for piece in slices(batches):
            lang, score = known.decide(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents_text(documents).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(documents: DataFrame, filters: Filters, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``documents``, all columns as they are, whose text has a language with at least ``accept``."""
    shared = share(documents.sparkSession, filters)

    def run(batches):
        known = opened(shared)
        for piece in slices(batches):
            text = piece.column("text")
            lang, score = known.decide(text)
            yield piece.filter(pa.array([x != "und" and s >= accept for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op7_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, train(documents))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
