"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items are built into suffix automata, in blocks
of ``BLOCK_WORDS`` words, about 70 MB of a worker's memory each. The driver builds
one at a time and writes it to the shared folder; a worker holds one at a time,
and takes each batch of documents through all of them before the next batch. So
memory doesn't grow with the benchmark; time does, block by block. Every document
is streamed through an automaton once; it keeps the length of
the longest suffix of the words read that occurs in some item. Wherever that
length reaches an item's window, the words of the window are hit.

Normalisation: A-Z becomes a-z, every other ASCII byte outside 0-9 and a-z
separates words, bytes of non-ASCII characters belong to words. A window is 13
consecutive item words; an item of 1 to 12 words is one window.

Null or empty text: no words, no hits, never contaminated. Null item text or an
item without words: no window. An item without an item_id hits words like any
other, and is neither counted nor listed among the items. Repeated documents: one
result a row. Items that share an item_id count once. Very long texts are read in
one piece. Empty tables: an empty result, or no hits.
Columns besides the named ones pass through ``decontaminate`` untouched, except
that its own output columns replace columns of the same name.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.llm.text import slices, tidy
from pairlight.session import fresh_dir

WINDOW = 13
#: Words of items in one automaton; more items make more blocks.
BLOCK_WORDS = 100_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_WORD = re.compile(rb"[^ ]+")


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over words, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(key, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]) for key, words in items if words]
        self.least = min([window, *(len(codes) for _, codes in coded)])
        for _, codes in coded:
            self._add(codes)
        #: Items by the state that holds one of their full windows.
        self.full: dict[int, set[str]] = {}
        #: (length, item) of short items by the state that holds the whole item.
        self.short: dict[int, set[tuple[int, str]]] = {}
        for key, codes in coded:
            if len(codes) < window:
                state = 0
                for c in codes:
                    state = self.next[state][c]
                self.short.setdefault(state, set()).add((len(codes), key))
            else:
                state = length = 0
                for c in codes:
                    state, length = self.step(state, length, c)
                    if length >= window:
                        self.full.setdefault(self._holding(state), set()).add(key)
        self._shorts: dict[int, tuple[tuple[int, str], ...]] = {}

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, above: int, code: int, old: int) -> int:
        """Give the strings of ``old`` that are at most len(above) + 1 long a state of their own."""
        copy = self._state(self.len[above] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = copy
        while above >= 0 and self.next[above].get(code) == old:
            self.next[above][code] = copy
            above = self.link[above]
        return copy

    def _add(self, codes: list[int]) -> None:
        last = 0
        for c in codes:
            old = self.next[last].get(c)
            if old is not None:  # an earlier item has this prefix
                last = old if self.len[old] == self.len[last] + 1 else self._split(last, c, old)
                continue
            new, at = self._state(self.len[last] + 1, {}, 0), last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = new
                at = self.link[at]
            if at >= 0:
                old = self.next[at][c]
                self.link[new] = old if self.len[old] == self.len[at] + 1 else self._split(at, c, old)
            last = new

    def step(self, state: int, length: int, code: int) -> tuple[int, int]:
        """The longest suffix of (match + code) that occurs in an item."""
        while state and code not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        following = self.next[state].get(code)
        return (0, 0) if following is None else (following, length + 1)

    def _holding(self, state: int) -> int:
        """The state of the match's last ``window`` words."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _short_at(self, state: int) -> tuple[tuple[int, str], ...]:
        """Short items that are suffixes of the state's strings."""
        if state not in self._shorts:
            found, at = set(), state
            while at > 0:
                found |= self.short.get(at, set())
                at = self.link[at]
            self._shorts[state] = tuple(found)
        return self._shorts[state]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit word ranges (begin, end), the items found, the longest match."""
        get = self.vocab.get
        codes = [get(w, 0) for w in words]
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        known = np.flatnonzero(np.diff(np.concatenate(([0], np.array(codes, dtype=np.int64) > 0, [0]))))
        for begin, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - begin < self.least:  # too short for any window
                continue
            state = length = 0
            for i in range(begin, end):
                state, length = self.step(state, length, codes[i])
                if length > longest:
                    longest = length
                if length >= self.window:
                    ranges.append((i + 1 - self.window, i + 1))
                    items |= self.full.get(self._holding(state), set())
                if self.short:
                    for n, key in self._short_at(state):
                        if n <= length:
                            ranges.append((i + 1 - n, i + 1))
                            items.add(key)
        return ranges, items, longest


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of at most ``block_words`` words (one item at least), streamed to the driver a partition at a time."""
    block, n = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        words = normalised(bytes(row.t))
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((row.k, words))
        n += len(words)
    if block:
        yield block


HIT_FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, kept string"


@functools.lru_cache(maxsize=1)
def _automaton(path: str) -> Automaton:
    """The automaton written under ``path``; a worker keeps the last one."""
    system, where = fs.FileSystem.from_uri(path)
    with system.open_input_stream(where) as f:
        return pickle.loads(f.read())


def written(spark: SparkSession, blocks: Iterator[list[tuple[str | None, list[bytes]]]], window: int) -> list[str]:
    """Paths of the blocks' automata in the shared folder, which are built and written one after the other."""
    paths: list[str] = []
    system, folder = None, fresh_dir(spark, "automata")
    for i, block in enumerate(blocks):
        if system is None:
            system, where = fs.FileSystem.from_uri(folder)
            system.create_dir(where, recursive=True)
        with system.open_output_stream(f"{where}/{i}") as f:
            f.write(pickle.dumps(Automaton(block, window), pickle.HIGHEST_PROTOCOL))
        paths.append(f"{folder}/{i}")
    return paths


def _scan(paths: list[str], with_text: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "__text", 16 << 20, 10_000)):
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "kept")}
            all_hits: list[tuple[list[tuple[int, int]], set[str | None], int]] = [([], set(), 0)] * len(texts)
            for path in paths:
                automaton = _automaton(path)
                for i, text in enumerate(texts):
                    r, found, most = automaton.hits(normalised(text or b""))
                    ranges, items, longest = all_hits[i]
                    if r or most > longest:
                        all_hits[i] = (ranges + r, items | found, max(longest, most))
            for text, (ranges, items, longest) in zip(texts, all_hits, strict=True):
                words = normalised(text or b"")
                items = items - {None}  # an item without an id hits words, but is not listed
                hit = np.zeros(len(words) + 1, dtype=np.int64)
                for begin, end in ranges:
                    hit[begin] += 1
                    hit[end] -= 1
                n_hit = int(np.count_nonzero(np.cumsum(hit)[:-1])) if ranges else 0
                out["n_words"].append(len(words))
                out["n_hit"].append(n_hit)
                out["n_items"].append(len(items))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
                out["contaminated"].append(n_hit > 0 and 20 * n_hit >= len(words))
                out["longest_match"].append(longest)
                out["kept"].append(_without(text, np.cumsum(hit)[:-1] > 0) if with_text and n_hit else None)
            keep = [i for i, name in enumerate(batch.schema.names) if name != "__text"]
            made = [pa.array(v, type={"items_sha256": pa.string(), "contaminated": pa.bool_(), "kept": pa.string()}.get(k, pa.int64())) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], names=[*(batch.schema.names[i] for i in keep), *out])

    return scan


def _without(text: bytes, hit: np.ndarray) -> str:
    """The text less its hit words; what separates the others stays."""
    parts, at = [], 0
    for i, m in enumerate(_WORD.finditer(text.translate(_TABLE))):
        if hit[i]:
            parts.append(text[at : m.start()])
            at = m.end()
    parts.append(text[at:])
    return b"".join(parts).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, with_text: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, longest_match and, on request, the text less its hit words (``kept``; null where nothing was hit)."""
    spark: SparkSession = docs.sparkSession
    paths = written(spark, item_blocks(benchmark, item_id, item_text, block_words), window)
    made = T.StructType.fromDDL(HIT_FIELDS)
    kept = [c for c in docs.columns if c not in made.names]
    frame = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = T.StructType([*(docs.schema[c] for c in kept), *made.fields])
    out = frame.mapInArrow(tidy(_scan(paths, with_text)), schema)
    return out if with_text else out.drop("kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


# DuckDB: windows by position; an item's window occurs where the document has the same words.
ORACLE = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
