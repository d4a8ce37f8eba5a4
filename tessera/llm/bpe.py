"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand next to each other in no vocabulary token can
never end up in one token, so a piece of text may be cut between them with no
effect on its ids.  Pieces of the pre-tokeniser are cut there, fragments are
encoded independently by merge rank, and their ids concatenated.  Fragment
results are kept in a cache bounded by bytes that ends with the task; it only saves time.

The vocabulary is read on the driver (its path is a parameter) and sent to the
executors; its size doesn't depend on the data.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import opened, share, table
from .words import slices

#: The public pre-tokenisation pattern of byte-level BPE vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of the cache of pieces (an estimate by their length), characters encoded at a time.
CACHE_BYTES, SEGMENT = 64_000_000, 2_000_000
NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a vocabulary file: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge ranks, token bytes, added tokens and forced cuts of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.single = [ids.get(bytes([b])) for b in range(256)]
        self.merges = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.bytes_of = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.joins = {t[i : i + 2] for t in ids for i in range(len(t) - 1)}

    def fragment_ids(self, fragment: bytes) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        ids = [self.single[b] for b in fragment]
        if len(ids) > 400:
            return self._long(ids)
        merges = self.merges
        while len(ids) > 1:
            best, at, made = 1 << 60, -1, 0
            for i in range(len(ids) - 1):
                found = merges.get((ids[i], ids[i + 1]))
                if found is not None and found[0] < best:
                    best, made = found
                    at = i
            if at < 0:
                break
            ids[at : at + 2] = [made]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for very long fragments."""
        import heapq

        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        heap = [(rank, i, made, pair) for rank, made, i, pair in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = made, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (found := merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, found[1], (ids[a], ids[b])))
        return [i for i in ids if i is not None]


class Encoder:
    """Encodes and decodes whole texts; lives as long as a task, its cache of pieces bounded by bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split, self.gap = regex.compile(PATTERN).findall, regex.compile(r"\S(?=\s)")
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.text_of = {i: str(i) for i in vocabulary.bytes_of}
        self.bytes_of = vocabulary.bytes_of
        keys = np.array([(a << 32) | b for a, b in vocabulary.merges], dtype=np.int64)
        rank, made = np.array(list(vocabulary.merges.values()), dtype=np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], rank[order], np.zeros(len(keys), dtype=np.int64)
        self.made[rank] = made
        self.single = np.array([-1 if i is None else i for i in vocabulary.single], dtype=np.int64)
        self.joins = np.zeros((256, 256), dtype=bool)
        for pair in vocabulary.joins:
            self.joins[pair[0], pair[1]] = True
        self.forget()

    def forget(self):
        """Empty the cache of pieces and their ids, but for the added tokens."""
        self.known, self.old, self.held = {t: (i,) for t, i in self.v.added.items()}, {}, 0

    def pieces(self, text: str) -> list[str]:
        """Added tokens and pre-tokens, in order; an added token never equals a pre-token (it would have been cut out)."""
        if self.special is None or not self.special.search(text):
            return self.split(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.split(part)
        return out

    def segments(self, text: str):
        """Parts of a long text, cut where white space follows something else: no pre-token or added token spans that, nor looks across it from the left."""
        at = 0
        while len(text) - at > SEGMENT and (gap := self.gap.search(text, at + SEGMENT)):
            yield text[at : gap.end()]
            at = gap.end()
        yield text[at:]

    def blocks(self, texts):
        """Lists of (row, segment) of about ``SEGMENT`` characters, so that pieces of many short texts are encoded side by side."""
        block, size = [], 0
        for row, text in enumerate(texts):
            for part in self.segments(text):
                if block and size + len(part) > SEGMENT:
                    yield block
                    block, size = [], 0
                block.append((row, part))
                size += len(part)
        if block:
            yield block

    def learn(self, cut: list[list[str]]):
        """Have the ids of every distinct piece at hand; of two generations of pieces the older one goes when the younger is full."""
        if self.held > CACHE_BYTES // 2:
            old = self.known
            self.forget()
            self.old = old
        new, old = set(chain.from_iterable(cut)).difference(self.known), self.old
        again = {p: old[p] for p in new if p in old}
        new = list(new.difference(again))
        self.known.update(again)
        self.known.update(zip(new, self._fresh(new), strict=True))
        self.held += 200 * (len(new) + len(again)) + 9 * (sum(map(len, new)) + sum(map(len, again)))

    def encoded(self, texts):
        """(row, ids) of each segment, in order; a text's ids are the concatenation."""
        for block in self.blocks(texts):
            cut = [self.pieces(part) for _, part in block]
            self.learn(cut)
            for (row, _), pieces in zip(block, cut, strict=True):
                yield row, list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        out = [[] for _ in texts]
        for row, ids in self.encoded(texts):
            out[row] += ids
        return out

    def listed(self, ids: list[int]) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _fresh(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of pieces that aren't cached: fragments between forced cuts, encoded side by side and concatenated."""
        if not pieces:
            return []
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        buffer = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        cut = np.ones(len(buffer) + 1, dtype=bool)
        cut[1:-1] = ~self.joins[buffer[:-1], buffer[1:]]
        cut[ends] = True
        start = np.flatnonzero(cut[:-1])
        length = np.diff(np.append(start, len(buffer)))
        found: list = [None] * len(start)
        for low, high in pairwise((0, 1, 3, 5, 7, 9, 11, 13, 16, 20, 26, 36, 64)):
            rows = np.flatnonzero((length > low) & (length <= high))
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                for r, ids in zip(part.tolist(), self._merge(buffer, start[part], length[part], high), strict=True):
                    found[r] = ids
        for r in np.flatnonzero(length > 64).tolist():
            found[r] = self.v.fragment_ids(buffer[start[r] : start[r] + length[r]].tobytes())
        first = np.searchsorted(start, np.concatenate(([0], ends)))
        return [tuple(found[a]) if b - a == 1 else tuple(chain.from_iterable(found[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def _ranks(self, left, right):
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.rank[at], NONE)

    def _merge(self, buffer, start, length, width):
        """Merge rounds over a matrix of fragments: in each round every row merges its pair of least rank, leftmost first."""
        column = np.arange(width)
        inside = column < length[:, None]
        ids = np.where(inside, self.single[buffer[np.minimum(start[:, None] + column, len(buffer) - 1)]], -1)
        ids = np.hstack((ids, np.full((len(ids), 1), -1)))
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(ids))
        while len(live):
            at = rank[live].argmin(1)
            best = rank[live, at]
            live, at, best = (x[best < NONE] for x in (live, at, best))
            if not len(live):
                break
            row, r, i = np.arange(len(live)), rank[live], ids[live]
            left = column <= at[:, None]
            i[:, :-1] = np.where(left, i[:, :-1], i[:, 1:])
            r[:, :-1] = np.where(left[:, :-1], r[:, :-1], r[:, 1:])
            r[:, -1] = np.where(left[:, -1], r[:, -1], NONE)
            i[row, at] = self.made[best]
            r[row, at] = self._ranks(i[row, at], i[row, at + 1])
            back = np.maximum(at - 1, 0)
            r[row, back] = np.where(at > 0, self._ranks(i[row, back], i[row, at]), r[row, back])
            ids[live], rank[live] = i, r
        n = (ids >= 0).sum(1)
        flat = ids[ids >= 0].tolist()
        ends = np.cumsum(n).tolist()
        return [flat[b - k : b] for b, k in zip(ends, n.tolist(), strict=True)]


def _digests(encoder: Encoder, texts):
    """Per text: number of ids and the digests of its ids and of its decoded text, segment by segment."""
    n, ids_sha, text_sha = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
    for row, ids in encoder.encoded(texts):
        if ids:
            ids_sha[row].update((("," if n[row] else "") + encoder.listed(ids)).encode())
            n[row] += len(ids)
            text_sha[row].update(encoder.decode(ids).encode())
    return n, [x.hexdigest() for x in ids_sha], [x.hexdigest() for x in text_sha]


def _whole(encoder: Encoder, texts):
    """Per text: number of ids, the digest of the ids, the decoded text and the ids."""
    lists = encoder.encode_batch(texts)
    digests = [hashlib.sha256(encoder.listed(ids).encode()).hexdigest() for ids in lists]
    return [len(x) for x in lists], digests, [encoder.decode(ids) for ids in lists], [np.array(ids, dtype=np.int32) for ids in lists]


def _codec(shared, with_ids: bool):
    def run(batches):
        encoder = Encoder(opened(shared))
        for piece in slices(batches):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            n, digests, last, *ids = (_whole if with_ids else _digests)(encoder, texts)
            columns, names = [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(last, pa.string())], ["n_tokens", "ids_sha256", "decoded" if with_ids else "decoded_sha256"]
            if with_ids:
                ends = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids[0]), pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], names=["doc_id", *names])

    return run


def encode(documents: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """Encode each whole text and decode it again.

    Returns ``doc_id, n_tokens, ids_sha256`` and, with ``with_ids``, the decoded
    text and the ids, else ``decoded_sha256``.  A null text counts as empty and
    has no tokens; rows that repeat an id or a text each give their own row, a
    null id stays null; any other column is left out.  Long texts are encoded in
    segments, so memory follows ``SEGMENT`` beside the text itself.  One narrow
    stage, no shuffle.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = share(documents.sparkSession, Vocabulary(vocabulary))
    schema = "doc_id long, n_tokens long, ids_sha256 string, " + ("decoded string, ids array<int>" if with_ids else "decoded_sha256 string")
    return docs.mapInArrow(_codec(shared, with_ids), schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)
