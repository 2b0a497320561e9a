"""Words and word hashes of whole batches of texts, over the Arrow buffers.

A batch's texts lie one behind the other in one UTF-8 buffer. All functions
here work on that buffer at once with numpy; nothing loops over characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_RNG = np.random.Generator(np.random.Philox(key=20260101))
#: One odd 64-bit number for each byte value.
_BYTE = (_RNG.integers(0, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = {"up": _powers(_BASE, 1 << 16), "down": _powers(_BASE_INV, 1 << 16)}


def _table(kind: str, n: int) -> np.ndarray:
    if len(_POW[kind]) < n:
        _POW[kind] = _powers(_BASE if kind == "up" else _BASE_INV, max(n, 2 * len(_POW[kind])))
    return _POW[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 8 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and ``limit`` bytes of text, or one row; keeps a worker's tables small."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        upto = min(max(at + 1, int(np.searchsorted(ends, done + limit, side="right"))), at + rows)
        yield batch.slice(at, upto - at)
        at = upto


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker gives the memory it no longer uses back: workers live on, and later stages share the executor with them."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()  # what another operator's task left
        try:
            yield from run(batches)
        finally:
            _give_back()

    return whole


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no frame has a column of that name, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch.

    start, end: byte ranges in the buffer; row: the text of each word;
    first: n + 1 positions of each text's first word; hash: 64 bits a word.
    """

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        self.bytes, self.offsets = buffer_of(column)
        if lower:
            self.bytes = _LOWER[self.bytes]
        n = len(self.bytes)
        inside = np.zeros(n + 1, dtype=bool)
        np.logical_not(_SPACE[self.bytes], out=inside[:n])
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        if n:
            cut = self.offsets[:-1]  # a word never runs on into the next text
            cut = cut[cut < n]
            begins[cut] = inside[cut]
            back = cut[cut > 0] - 1
            ends[back] = inside[back]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64 bits for each word: a polynomial over its bytes, the same wherever it stands."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        out = np.empty(len(self.start), dtype=np.uint64)
        step = 1 << 22  # bytes at a time, so that a batch's tables stay small
        at = 0
        while at < len(self.start):
            base = self.start[at]
            upto = max(int(np.searchsorted(self.start, base + step)), at + 1)
            stop = self.end[upto - 1]
            terms = _BYTE[self.bytes[base:stop]]
            terms *= _table("up", stop - base)[: stop - base]
            sums = np.zeros(stop - base + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])
            s, e = self.start[at:upto] - base, self.end[at:upto] - base
            out[at:upto] = (sums[e] - sums[s]) * _table("down", stop - base)[s]
            at = upto
        return mix(out + np.uint64(1))


def grams(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of k consecutive words, for each start that has k words after it in the array."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(seed) + np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out)
