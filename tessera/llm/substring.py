"""Substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of a document.  Its minimiser is the
least hash of its ``CORE``-word grams; consecutive windows with the same
minimiser form a super-k-mer, which travels as one packed string.

Documents are dealt once by id into groups of about ``GROUP_BYTES`` input bytes.

1. Each group sends the distinct minimisers of its documents to buckets, which
   return those that occur in two or more documents. Equal windows have equal
   minimisers, so all other windows are unique.
2. Each group sends its distinct windows with such minimisers as super-k-mers,
   with the least document that has each. A bucket unpacks the windows and sorts their
   words, byte by byte, which counts them exactly and finds each one's least
   document. It returns that for repeated windows.
3. Each group removes words covered by windows whose least document is not
   the document itself.

A passage that a third of all documents share is sent once per group, not once
per document, so no bucket grows with the number of copies.  A minimiser that
``HOT`` groups have is one of many different windows: those are dealt by a second
minimiser, of another hash, as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import documents_text
from .tables import pieces, table
from .words import U, Words, grams, joined, least, mix

WINDOW, CORE = 13, 6
GROUP_BYTES, BUCKET_BYTES = 4_000_000, 4_000_000
#: Groups that have a minimiser, from which on its windows are dealt by a second one too.
HOT = 32


class Windows:
    """Windows of a group of texts: minimiser, hashes and documents."""

    def __init__(self, texts, window: int, core: int):
        self.n, self.core = window, core
        self.words = Words(*joined(pa.array(texts, pa.large_string())), "spaced")
        size = len(self.words.hash) - window + 1
        good = self.words.windows(window)[: max(0, size)]
        self.at = np.flatnonzero(good)
        self.least = self._least(61)

    def _least(self, salt):
        if len(self.words.hash) < self.n:
            return np.empty(0, U)
        return least(grams(self.words.hash, self.core, salt), self.n - self.core + 1)[self.at]

    def buckets(self, hot, buckets):
        """Each window's bucket: by its minimiser, for hot ones by a second minimiser too, so that equal windows meet."""
        value = np.where(hot, mix(self.least ^ self._least(64)), self.least) if hot.any() else self.least
        return (value % U(buckets)).astype(np.int64)

    def doc(self):
        return np.searchsorted(self.words.first, self.at, side="right") - 1

    def hashes(self, chosen):
        """Two independent hashes of the chosen windows (indices into ``at``)."""
        one, two = (np.empty(0, U), np.empty(0, U)) if not len(chosen) else (grams(self.words.hash, self.n, salt)[self.at[chosen]] for salt in (62, 63))
        return one, two

    def distinct(self, chosen):
        """The first of equal chosen windows; one word repeated a thousand times makes a thousand of them."""
        one, two = self.hashes(chosen)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))[: len(chosen)]
        return np.sort(chosen[order[new]])

    def runs(self, chosen, bucket):
        """(first window, last window, bucket) of each super-k-mer among the chosen windows."""
        if not len(chosen):
            return [np.empty(0, np.int64)] * 3
        place, low, bucket = self.at[chosen], self.least[chosen], bucket[chosen]
        new = np.concatenate(([True], (place[1:] != place[:-1] + 1) | (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(chosen)) - 1
        return place[first], place[last], bucket[first]


def _within(values, known):
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values


def _blob(x) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _minimisers(window, core, buckets):
    def run(pdf):
        g, pdf = int(pdf["g"].iloc[0]), pdf[pdf["named"]]
        w = Windows(pdf["text"], window, core)
        doc, low = w.doc(), w.least
        order = np.lexsort((doc, low))
        doc, low = doc[order], low[order]
        new = np.concatenate(([True], low[1:] != low[:-1]))[: len(low)]
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(low)) - 1
        # a bit says whether the group alone has it in two documents
        value, twice = low[start], doc[start] != doc[last[: len(start)]]
        bucket = (value % U(buckets)).astype(np.int64)
        rows = []
        for b in np.unique(bucket).tolist():
            mine = bucket == b
            rows.append((b, g, _blob(value[mine]), _blob(twice[mine])))
        return pd.DataFrame(rows, columns=["bucket", "g", "value", "twice"])

    return run


def _shared(pdf):
    """To each group, those of its minimisers that two documents have, and whether so many groups have them that they are dealt by a second minimiser too."""
    values = [np.frombuffer(x, dtype=U) for x in pdf["value"]]
    if not values:
        return pd.DataFrame({"h": [], "shared": [], "hot": []})
    flat, twice = np.concatenate(values), np.concatenate([np.frombuffer(x, dtype=bool) for x in pdf["twice"]])
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])
    count = np.diff(np.append(start, len(ordered)))
    common = (count > 1) | np.logical_or.reduceat(twice[order], start) if len(start) else np.empty(0, bool)
    known, often = ordered[start][common], ordered[start][count >= HOT]
    shared = [v[_within(v, known)] for v in values]
    return pd.DataFrame({"h": pdf["g"], "shared": [_blob(v) for v in shared], "hot": [_blob(v[_within(v, often)]) for v in shared]})


def _union(frame, column):
    parts = [np.frombuffer(x, dtype=U) for x in frame[column]]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, U)


def _packed(window, core, buckets):
    def run(pdf, reply):
        names = ["bucket", "g", "strings", "docs"]
        if not len(pdf):
            return pd.DataFrame(columns=names)
        g, pdf = int(pdf["g"].iloc[0]), pdf[pdf["named"]].sort_values("doc_id", kind="stable")
        w = Windows(pdf["text"], window, core)
        chosen = w.distinct(np.flatnonzero(_within(w.least, _union(reply, "shared"))))
        first, last, bucket = w.runs(chosen, w.buckets(_within(w.least, _union(reply, "hot")), buckets))
        ids, raw = pdf["doc_id"].to_numpy(), w.words.buffer.tobytes()
        starts, ends = w.words.start, w.words.end
        doc = np.searchsorted(w.words.first, first, side="right") - 1
        found: dict[int, dict[bytes, int]] = {}
        for b, d, a, z in zip(bucket.tolist(), doc.tolist(), first.tolist(), (last + window - 1).tolist(), strict=True):
            packed = b" ".join(raw[starts[a] : ends[z]].split())
            # documents come in ascending order: the first holds
            found.setdefault(b, {}).setdefault(packed, int(ids[d]))
        return pd.DataFrame([(b, g, b"\n".join(x), _blob(np.fromiter(x.values(), np.int64, len(x)))) for b, x in found.items()], columns=names)

    return run


def _owners(window):
    """Sort all windows of a bucket by their words; return, to each group, its repeated windows and their least documents."""

    def run(pdf):
        texts, groups, docs = [], [], []
        for g, strings, ids in zip(pdf["g"], pdf["strings"], pdf["docs"], strict=True):
            part = strings.split(b"\n")
            texts += part
            groups += [g] * len(part)
            docs.append(np.frombuffer(ids, dtype=np.int64))
        docs = np.concatenate(docs)
        buffer = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        words = Words(buffer, offsets, "spaced")
        at = np.flatnonzero(words.windows(window))
        owner = np.searchsorted(words.first, at, side="right") - 1
        raw = buffer.tobytes()
        keys = [raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at + window - 1].tolist(), strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        low = np.empty(len(keys), np.int64)
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and keys[order[j]] == keys[order[i]]:
                j += 1
            same = order[i:j]
            low[same] = docs[owner[same]].min()
            i = j
        one = grams(words.hash, window, 62)[at] if len(at) else np.empty(0, U)
        two = grams(words.hash, window, 63)[at] if len(at) else np.empty(0, U)
        rows, group = [], np.array(groups, dtype=np.int64)[owner] if len(at) else np.empty(0, np.int64)
        for g in np.unique(group).tolist():
            mine = group == g
            rows.append((g, _blob(one[mine]), _blob(two[mine]), _blob(low[mine])))
        return pd.DataFrame(rows, columns=["h", "one", "two", "low"])

    return run


def _clean(window, core, digest):
    def run(pdf, reply):
        names = ["doc_id", "named", "n_words", "n_removed", "kept_sha256" if digest else "text"]
        if not len(pdf):
            return pd.DataFrame(columns=names)
        w = Windows(pdf["text"], window, core)
        words, n = w.words, len(pdf)
        one, two = _union_pair(reply)
        cover = np.zeros(len(words.start) + 1, dtype=np.int64)
        if len(one[0]):
            mine = grams(words.hash, window, 62)[w.at] if len(w.at) else np.empty(0, U)
            chosen = np.flatnonzero(_within(mine, one[0]))
            a, b = w.hashes(chosen)
            place = np.searchsorted(one[0], a)
            low = np.full(len(chosen), np.iinfo(np.int64).max)
            for step in range(one[1]):
                at = np.minimum(place + step, len(one[0]) - 1)
                good = (one[0][at] == a) & (two[0][at] == b)
                low[good] = np.minimum(low[good], two[1][at][good])
            ids = pdf["doc_id"].to_numpy(dtype=np.int64)[w.doc()[chosen]]
            named = pdf["named"].to_numpy(dtype=bool)[w.doc()[chosen]]
            hit = w.at[chosen[(low < ids) & named]]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed = np.bincount(words.doc(), weights=gone, minlength=n).astype(np.int64)
        keep = np.zeros(len(words.buffer) + 1, dtype=np.int8)
        np.add.at(keep, words.start[~gone], 1)
        np.add.at(keep, words.end[~gone] + 1, -1)
        mask = np.cumsum(keep[:-1]) > 0
        plain = words.buffer.copy()
        plain[words.end] = 0x20
        kept, size = plain[mask].tobytes(), np.concatenate(([0], np.cumsum(mask)))[words.offsets]
        texts = [kept[a : max(a, b - 1)] for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
        last = [hashlib.sha256(t).hexdigest() if digest else t.decode() for t in texts]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "named": pdf["named"], "n_words": words.count.astype(np.int64), "n_removed": removed, names[4]: last})

    return run


def _union_pair(reply):
    """Sorted hashes, the longest run of equal ones, and the second hash and least document of each."""
    if not len(reply):
        return (np.empty(0, U), 0), (np.empty(0, U), np.empty(0, np.int64))
    one = np.concatenate([np.frombuffer(x, dtype=U) for x in reply["one"]])
    two = np.concatenate([np.frombuffer(x, dtype=U) for x in reply["two"]])
    low = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in reply["low"]])
    key = np.lexsort((low, two, one))
    one, two, low = one[key], two[key], low[key]
    first = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    one, two, low = one[first], two[first], low[first]
    runs = np.diff(np.append(np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1]))), len(one)))
    return (one, int(runs.max())), (two, low)


def remove_repeats(documents: DataFrame, window: int = WINDOW, core: int = CORE, digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` (or ``kept_sha256``) of each document.

    A word goes if it is covered by a window whose word sequence also starts in
    a document with a smaller id, judged on the input.  Null texts have no words.
    Rows with a null id are kept unchanged apart from white space and remove
    nothing: neither is smaller than a null, nor a null than anything.  Rows that
    repeat an id are one document to each other.
    """
    docs = documents_text(documents)
    groups, buckets = pieces(documents, GROUP_BYTES), pieces(documents, BUCKET_BYTES)
    docs = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), F.coalesce("text", F.lit("")).alias("text")
    )
    # about one group, or bucket, a partition: Spark would deal them to fewer unevenly
    by_group = lambda: docs.repartition(groups, "g").groupBy("g")
    sent = by_group().applyInPandas(_minimisers(window, core, buckets), "bucket long, g long, value binary, twice binary")
    shared = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_shared, "h long, shared binary, hot binary")
    packed = by_group().cogroup(shared.groupBy("h")).applyInPandas(_packed(window, core, buckets), "bucket long, g long, strings binary, docs binary")
    owners = packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_owners(window), "h long, one binary, two binary, low binary")
    last = "kept_sha256 string" if digest else "text string"
    found = by_group().cogroup(owners.groupBy("h")).applyInPandas(_clean(window, core, digest), f"doc_id long, named boolean, n_words long, n_removed long, {last}")
    return found.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", last.split()[0])


def op8_substring(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
low AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (s) WHERE d < doc_id),
flat AS (SELECT w.doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM flat ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
