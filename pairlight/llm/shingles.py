"""Distinct word shingles of whole batches, and their b-bit MinHash sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pairlight.llm.text import Words, grams, mix

SHINGLE = 5


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of text i are hashes[first[i]:first[i + 1]].

    A text of 1 to k - 1 words has its whole word sequence as one shingle.
    """
    words = Words(column, lower=True)
    hashes = words.hashes()
    counts = np.diff(words.first)
    n = len(hashes) - k + 1
    full = np.flatnonzero(words.row[: max(n, 0)] == words.row[k - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
    values, rows = [grams(hashes, k)[full] if n > 0 else np.zeros(0, dtype=np.uint64)], [words.row[full]]
    for short in range(1, k):
        own = np.flatnonzero(counts == short)
        if len(own):
            values.append(grams(hashes, short)[words.first[own]])
            rows.append(own)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))


class Sketcher:
    """MinHash with ``bands`` bands of ``rows`` minima; ``bits`` low bits of each minimum are kept."""

    def __init__(self, bands: int, rows: int, bits: int = 4, seed: int = 9) -> None:
        self.bands, self.rows, self.bits = bands, rows, bits
        rng = np.random.Generator(np.random.Philox(key=seed))
        self.mul = (rng.integers(0, 2**63, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2)

    def minima(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(hash functions, texts that have shingles)."""
        starts = first[:-1][np.diff(first) > 0]
        out = np.empty((len(self.mul), len(starts)), dtype=np.uint64)
        scratch = np.empty_like(values)
        for j, (a, b) in enumerate(zip(self.mul, self.add, strict=True)):
            np.multiply(values, a, out=scratch)
            np.add(scratch, b, out=scratch)
            out[j] = np.minimum.reduceat(scratch, starts) if len(starts) else 0
        return out

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """Low bits of the minima, two to a byte: (texts, bytes)."""
        low = (minima & np.uint64(2**self.bits - 1)).astype(np.uint8).T
        if low.shape[1] % 2:
            low = np.pad(low, ((0, 0), (0, 1)))
        return np.ascontiguousarray(low[:, 0::2] << 4 | low[:, 1::2])

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """(texts, bands): a band's key, from its whole minima."""
        out = np.empty((self.bands, minima.shape[1]), dtype=np.uint64)
        for band in range(self.bands):
            key = np.full(minima.shape[1], band + 1, dtype=np.uint64)
            for j in range(band * self.rows, (band + 1) * self.rows):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + minima[j])
            out[band] = key
        return out.T

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarity of packed signatures, by counting equal low bits, corrected for chance collisions."""
        equal = SAME[a ^ b].sum(axis=-1, dtype=np.int64)
        n = self.bands * self.rows
        equal -= a.shape[-1] * 2 - n  # padding always matches
        chance = 2.0**-self.bits
        return (equal / n - chance) / (1 - chance)


#: Equal 4-bit halves in the XOR of two bytes.
SAME = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], dtype=np.uint8)
