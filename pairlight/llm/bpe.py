"""Byte-level BPE encoding and decoding over a contiguous rank array.

A text is cut into pretokens by the tokenizer's pattern. A pretoken that is not
itself a token is merged by scanning: part boundaries and the ranks of adjacent
parts lie in two plain lists; the smallest rank is found by a scan, its
boundary deleted, and the two neighbouring ranks looked up again, until no
adjacent parts form a token. For words of a few dozen bytes a scan beats a heap.
Pretokens over ``LONG`` bytes take a heap over linked parts instead, as the scan
is quadratic; both give the same ids.

Null text: as empty, no ids, decoded to "". Texts that spell a special token get
its id, as the library does by default. Texts that aren't valid Unicode don't
occur in Arrow strings. Repeated rows: one result each. Empty tables: empty.
Extra columns pass through ``encode``; its output columns replace those of the
same name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.llm.text import tidy

#: Pretokens longer than this many bytes are merged with a heap.
LONG = 256
#: Pretokens whose ids a worker remembers; beyond, it starts afresh.
CACHE = 250_000
#: Marks that stand alone behind a word.
MARKS = frozenset(".,;:!?")


def byte_letters() -> dict[str, int]:
    """Byte-level BPE's printable letter for each byte: itself if printable in Latin-1, else the next free code point from 256."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    letters = {chr(b): b for b in printable}
    hidden = (b for b in range(256) if b not in printable)
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Ids of texts and texts of ids, for a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: str, pattern: str) -> None:
        import regex

        model = json.loads(spec)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        raw = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.ids = raw
        self.bytes = {i: token for token, i in raw.items()} | {i: s.encode() for s, i in special.items()}
        self.size = max(self.bytes) + 1
        self.table = [self.bytes.get(i, b"") for i in range(self.size)]
        # A merge's rank is its place in the file; parts are ids, a pair is left * 2**32 + right.
        self.none = len(model["model"]["merges"])
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, merge in enumerate(model["model"]["merges"]):
            a, b = (bytes(letters[c] for c in side) for side in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[raw[a] << 32 | raw[b]] = r
            self.made.append(raw[a + b])
        self.byte_id = [raw[bytes([b])] for b in range(256)]
        #: Ranks of two adjacent bytes, the starting row of every word.
        self.start = {bytes([a, b]): r for a in range(256) for b in range(256) if (r := self.rank.get(self.byte_id[a] << 32 | self.byte_id[b])) is not None}
        self.find = regex.compile(pattern).findall
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.cache: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pretoken."""
        n = len(word)
        if n > LONG:
            return self._merge_long(word)
        none, get, made = self.none, self.rank.get, self.made
        start, byte_id = self.start.get, self.byte_id
        parts = [byte_id[b] for b in word]
        ranks = [start(word[i : i + 2], none) for i in range(n - 1)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i] = new = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 32 | parts[i + 1], none)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        n = len(word)
        parts = [self.byte_id[b] for b in word]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or self.rank.get(parts[i] << 32 | parts[j]) != r:
                continue  # a part has changed since
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (r := self.rank.get(parts[left] << 32 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        """Little-endian ids of a pretoken."""
        got = self.cache.get(word)
        if got is None:
            got = array("I", self.merge(word.encode())).tobytes()
            if len(word) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[word] = got
        return got

    def _stretch(self, text: str) -> bytes:
        """Ids of a stretch that the pattern cuts by itself: a space and letters, perhaps with a mark behind them, needs no pattern."""
        if text.isspace() or not text:
            return b"".join([self._word(w) for w in self.find(text)])
        body = text[1:]
        if text[0] == " ":
            if body.isalpha():
                return self._word(text)
            if body[-1] in MARKS and body[:-1].isalpha():
                return self._word(text[:-1]) + self._word(body[-1])
        return b"".join([self._word(w) for w in self.find(text)])

    def _plain(self, text: str) -> bytes:
        """A space followed by no white space always starts a pretoken: the text is cut there. A stretch that is a known pretoken is coded already, as the pattern leaves a pretoken whole."""
        out, known, stretch = [], self.cache.get, self._stretch
        pieces = text.split(" ")
        pending = pieces[0]
        for piece in pieces[1:]:
            if piece and not piece[0].isspace():
                out.append(known(pending) or stretch(pending))
                pending = " " + piece
            else:  # this space is part of a longer run of white space
                pending += " " + piece
        out.append(stretch(pending))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = [array("I", [self.special[part]]).tobytes() if part in self.special else self._plain(part) for part in self.cut.split(text) if part]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table = self.table
        return b"".join([table[i] for i in array("I", ids)]).decode("utf-8", "replace")


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(spec: str, pattern: str) -> Codec:
    """The worker's codec; tasks of one worker share it."""
    key = (hash(spec), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(spec, pattern)
    return _CODECS[key]


FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"


def encode(docs: DataFrame, tokenizer_path: str, pattern: str, text_col: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """``docs`` with the ids of each text (little-endian unsigned 32-bit), their number and digest, and what they decode to.

    ``tokenizer_path`` is read on the driver; its text (bounded by the vocabulary) is broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    made = [f for f in T.StructType.fromDDL(FIELDS).fields if (f.name != "ids" or with_ids) and (f.name != "decoded" or with_text)]
    kept = [c for c in docs.columns if c not in {f.name for f in made}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value, pattern)
        for batch in batches:
            # Few rows at a time, so that the ids of very long texts never pile up.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(part.schema.get_field_index("__text")).to_pylist()
                ids = [own.encode(t or "") for t in texts]
                decoded = [own.decode(x) for x in ids]
                made_columns = {
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                }
                if with_ids:
                    made_columns["ids"] = pa.array(ids, pa.binary())
                if with_text:
                    made_columns["decoded"] = pa.array(decoded, pa.string())
                keep = [i for i, n in enumerate(part.schema.names) if n != "__text"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *made_columns.values()], names=[*(part.schema.names[i] for i in keep), *made_columns])

    frame = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return frame.mapInArrow(tidy(run), T.StructType([*(docs.schema[c] for c in kept), *made]))


def public_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, *public_tokenizer(), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
