"""Vectorised word splitting and hashing over UTF-8 bytes.

Texts are joined with a separator byte into one buffer; word borders, word
hashes and n-gram hashes are NumPy operations on that buffer.  All hashes are
64-bit, seeded and equal on every executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
GAP = 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(salt)) | U(1)


def byte_class(kind: str) -> np.ndarray:
    """Which bytes belong to words. ``spaced``: all but ASCII white space; ``alnum``: lower-case letters, digits, non-ASCII."""
    b = np.arange(256)
    if kind == "spaced":
        return ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    return ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)


def slices(batches, most: int = 2_000_000):
    """Cut Arrow batches with a ``text`` column into pieces of about ``most`` bytes, one row at least."""
    for batch in batches:
        sizes = batch.column("text")
        lengths = np.zeros(len(sizes), dtype=np.int64)
        for i, n in enumerate(pa.compute.binary_length(sizes).to_pylist()):
            lengths[i] = n or 0
        ends, at = np.cumsum(lengths), 0
        while at < len(lengths):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer with a gap after each text, and the offset of each text (one more at the end); null counts as empty."""
    parts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.cast(pa.large_string())]
    offsets = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).astype(np.int64)
    return np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8), offsets


def lowered(buffer: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((buffer >= 0x41) & (buffer <= 0x5A), buffer | 0x20, buffer)


class Words:
    """Words of a buffer: byte spans ``start``/``end``, 64-bit ``hash``, and ``first``: each text's first word (one more at the end)."""

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray, kind: str):
        inside = byte_class(kind)[buffer]
        inside[offsets[1:] - 1] = False
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.buffer, self.offsets = buffer, offsets
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, offsets)
        self.hash = span_hash(buffer, self.start, self.end)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.count)

    def windows(self, n: int) -> np.ndarray:
        """Whether ``n`` words of one text start at each word."""
        at = np.arange(len(self.start))
        return at + n <= np.repeat(self.first[1:], self.count)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hash(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each byte span; spans are ascending and don't overlap. Memory follows ``block``, not the buffer."""
    out, at = np.empty(len(start), dtype=U), 0
    letter, prime = seeds(256, 11), 0x9E3779B97F4A7C15 | 1
    back = pow(prime, -1, 1 << 64)
    power = np.ones(1, dtype=U)
    inverse = power
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + block, side="right")))
        base, top = int(start[at]), int(end[to - 1])
        if len(power) < top - base + 1:
            n = max(top - base + 1, min(block, int(end[-1]) + 1))
            power, inverse = powers(prime, n + 1), powers(back, n + 1)
        sums = np.zeros(top - base + 1, dtype=U)
        np.cumsum(letter[buffer[base:top]] * power[: top - base], out=sums[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        at = to
    return out


def grams(hashes: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """Hash of each run of ``n`` hashes (also across texts: mask with ``Words.windows``)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=U)
    factor = seeds(1, salt)[0]
    total = np.full(size, U(n))
    for i in range(n):
        total = total * factor + hashes[i : i + size]
    return mix(total)


def row_grams(spans: np.ndarray, salt: int) -> np.ndarray:
    """``grams`` of whole rows of a matrix of hashes."""
    factor, total = seeds(1, salt)[0], np.full(len(spans), U(spans.shape[1]))
    for i in range(spans.shape[1]):
        total = total * factor + spans[:, i]
    return mix(total)


def least(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of ``n`` values, by doubling."""
    width, low = 1, values
    while width * 2 <= n:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = n - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def shingle_sets(words: Words, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct ``n``-word shingles of each text, and their numbers.

    A text of fewer words, but not none, has its whole sequence as its only shingle.
    """
    whole = grams(words.hash, n, salt=21)
    sets = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            sets.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            sets.append(grams(words.hash[a:b], int(b - a), salt=21))
        else:
            sets.append(np.empty(0, dtype=U))
    return sets, np.array([len(s) for s in sets], dtype=np.int64)
