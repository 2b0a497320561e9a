"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens: its documents one behind the other, each closed by an end token. A window takes from
each queue what its quantum (the window's size times the queue's share) and the deficit carried from earlier windows
allow, so that after any number of windows every queue is within a token of its target, and every window is full.

Queues don't wait for each other, as documents may be cut freely. So the deficit with which a queue enters a window
follows from the window's number, in whole numbers: a task that holds a stretch of a queue starts at that window with
the deficit carried there and goes on window by window. No task sees a whole queue, no text or id is shuffled, and the
driver sees one row for each queue.

A source that would earn less than one token a window shares one queue with all such sources; hence there are at most as
many queues as a window has tokens. Given weights, a queue that runs dry leaves its turn to the others. What doesn't
fill a last window is cut into windows of powers of two, so that nothing is padded.

Null texts and empty ones: the end token alone. Null sources are a source. Repeated rows, and rows that share an id or
have none: each is packed by itself. Empty tables: no rows. Very long texts: cut like all others. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.llm.text import slices, tidy
from pairlight.session import stored, table

WINDOW, END = 2048, 1
#: Chunks whose ids a worker remembers at least; twice as many at most.
CACHE = 450_000
#: Marks that stand alone behind a word.
MARKS = frozenset(".,;:!?")
#: Fixed value: the tokenizer's own words, as its file states them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordIds:
    """Ids of texts as the tokenizers library gives them, with the library asked once for each word.

    The tokenizer lower-cases, and no token reaches over white space: a text's ids are those of its chunks. Characters
    from U+0250 on (whose normal forms and cases depend on their neighbours), the separators U+001C to U+001F and
    special tokens need the library itself; a text with any of them is encoded by it as a whole.
    """

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import regex
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.kind, self.dtype = ("H", "<u2") if self.whole.get_vocab_size() <= 1 << 16 else ("I", "<u4")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.hard = re.compile("[^\x00-\x1b\x20-ɏ]").search
        self.find = regex.compile(pattern).findall
        printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
        letters = {b: chr(b) for b in printable}
        self.letters = letters | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
        self.known: dict[str, bytes] = {}  # a chunk that is one word has the word's ids
        self.older: dict[str, bytes] = {}

    def _keep(self, key: str, ids: bytes) -> bytes:
        if len(key) <= 64:
            if len(self.known) >= CACHE:
                self.older, self.known = self.known, {}
            self.known[key] = ids
        return ids

    def _word(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            shown = word if word.isascii() else word.encode().decode("latin-1")
            got = array(self.kind, [t.id for t in self.whole.model.tokenize(shown.translate(self.letters))]).tobytes()
        return self._keep(word, got)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk)
        known, word, body = self.known.get, self._word, chunk[:-1]
        if chunk[-1] in MARKS and body.isalpha():  # too many to be remembered
            return (known(body) or word(body)) + (known(chunk[-1]) or word(chunk[-1]))
        return self.older.get(chunk) or self._keep(chunk, b"".join([known(w) or word(w) for w in self.find(chunk)]))

    def __call__(self, text: str) -> bytes:
        if self.hard(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        known, chunk = self.known.get, self._chunk
        return b"".join([known(c) or chunk(c) for c in text.lower().split()])


_OWN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer; tasks of one worker share it."""
    if path not in _OWN:
        _OWN[path] = WordIds(path)
    return _OWN[path]


def apportion(total: int, weights: list[int]) -> list[int]:
    """``total`` in whole parts by ``weights``, each within one of its exact share."""
    whole, at, out = sum(weights), 0, []
    for w in weights:
        out.append((total * (at + w)) // whole - (total * at) // whole)
        at += w
    return out


def plan(totals: list[int], weights: list[int] | None = None, window: int = WINDOW) -> list[tuple[int, int, int, list[int]]]:
    """Phases (first window, how many, their size, tokens of each queue in them) in which all shares are fixed.

    A phase ends where a queue runs dry; the window in which that happens is a phase of its own. Queues of weight 0
    come when all others are dry. Without weights the shares are the queues' own, and there is one phase and the tail.
    """
    left, phases, first = list(totals), [], 0
    while sum(left) >= window:
        turn = [w if n else 0 for w, n in zip(weights or left, left, strict=True)]
        turn = turn if any(turn) else left
        whole = sum(turn)
        many = min(n * whole // (w * window) for n, w in zip(left, turn, strict=True) if w)
        if many:
            if many > 1 and any(0 < w * window < whole for w in turn):
                raise ValueError(f"a queue has less than a token of {window}")
            took = apportion(many * window, turn)
        else:
            took, many = [0] * len(left), 1
            while sum(took) < window:
                room = [w if n > t else 0 for w, n, t in zip(turn, left, took, strict=True)]
                room = room if any(room) else [n - t for n, t in zip(left, took, strict=True)]
                more = apportion(window - sum(took), room)
                took = [min(n, t + m) for n, t, m in zip(left, took, more, strict=True)]
        phases.append((first, many, window, took))
        first += many
        left = [n - t for n, t in zip(left, took, strict=True)]
    size = 1 << max(0, window.bit_length())
    while size:
        if sum(left) >= size:
            took = apportion(size, left)
            phases.append((first, 1, size, took))
            first += 1
            left = [n - t for n, t in zip(left, took, strict=True)]
        size >>= 1
    return phases


def rounds(quantum: int, windows: int, at: int, n: int) -> np.ndarray:
    """What a queue whose quantum is ``quantum / windows`` a window has been given before the windows ``at`` to ``at + n``.

    It enters window ``at`` with the deficit that all windows before it have left, and carries it on from there.
    """
    whole, part = divmod(quantum, windows)
    given, deficit = divmod(at * quantum, windows)
    i = np.arange(n + 1, dtype=np.int64)
    return given + i * whole + (deficit + i * part) // windows


class Dealer:
    """Places of stretches of queues in windows."""

    def __init__(self, phases: list[tuple[int, int, int, list[int]]], queues: int) -> None:
        self.phases = []
        before = [0] * queues
        for first, many, _, took in phases:
            ahead = np.concatenate([[0], np.cumsum(took)]).tolist()
            self.phases.append((first, many, took, ahead, list(before)))
            before = [b + t for b, t in zip(before, took, strict=True)]

    def places(self, queue: int, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        """(from, to, window, offset there) of the tokens ``low`` to ``high`` of a queue, as arrays a phase."""
        for first, many, took, ahead, before in self.phases:
            n, a, b = took[queue], max(0, low - before[queue]), high - before[queue]
            b = min(b, n)
            if a >= b:
                continue
            at = max(0, (a - 1) * many // n)
            to = min(many, -(-(b + 1) * many // n))
            under = rounds(ahead[queue], many, at, to - at)
            own = rounds(ahead[queue + 1], many, at, to - at) - under
            begin, end = np.maximum(own[:-1], a), np.minimum(own[1:], b)
            met = begin < end
            where = np.diff(under) + begin - own[:-1]
            yield begin[met] + before[queue], end[met] + before[queue], (first + at + np.arange(to - at))[met], where[met]


TOKENS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ahead", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end: int = END) -> DataFrame:
    """doc_id, source, part (the task), ahead (tokens of the source before it there), doc_tokens, ids (little-endian, two bytes each in a vocabulary of 65,536 or fewer, else four; end token last)."""
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(tokenizer_path)
        close = np.array([end], own.dtype).tobytes()
        width, part, so_far = len(close), TaskContext.get().partitionId(), {}
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20, 500):
                ids = [own(t or "") + close for t in piece.column(2).to_pylist()]
                ahead = []
                for source, x in zip(piece.column(1).to_pylist(), ids, strict=True):
                    ahead.append(so_far.get(source, 0))
                    so_far[source] = ahead[-1] + len(x) // width
                made = [pa.array([part] * len(ids), pa.int32()), pa.array(ahead, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *made], names=["doc_id", "source", *TOKENS.names])

    return frame.mapInArrow(tidy(run), T.StructType([*frame.schema.fields[:2], *TOKENS.fields]))


PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, weights: dict[str | None, float] | None = None, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source; ``with_ids`` its ids too.

    ``weights`` give sources their shares of every window (null is a source); sources it doesn't name come last. Without
    weights, every window has the sources' shares of the whole corpus. A weight that earns less than a token of a
    window raises ValueError.
    """
    spark: SparkSession = docs.sparkSession
    coded = stored(tokenized(docs, tokenizer_path, id_col, text_col, source_col, end), "packing-ids")
    counts = coded.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n"))
    sums = counts.groupBy("source").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    # A row for each queue: at most ``window`` sources have a token in each window.
    named = [(r["source"], r["n"]) for r in (sums.where(F.col("n") * window >= total) if weights is None else sums.where(F.coalesce("source", F.lit("\0null")).isin([s if s is not None else "\0null" for s in weights]))).collect()]
    named.sort(key=lambda x: (-x[1], x[0] is None, x[0] or ""))
    rest = total - sum(n for _, n in named)
    totals = [n for _, n in named]
    shared = len(named)
    if rest:
        if weights is None and named and rest * window < total:
            shared -= 1  # too few for a token in each window: they go along with the smallest
            totals[-1] += rest
        else:
            totals.append(rest)
    scaled = None
    if weights is not None:
        exact = [Fraction(weights[s]) for s, _ in named] + [Fraction(0)] * (len(totals) - len(named))
        down = int(np.lcm.reduce([f.denominator for f in exact], dtype=object)) if exact else 1
        scaled = [int(f * down) for f in exact]
    dealer = spark.sparkContext.broadcast(Dealer(plan(totals, scaled, window), len(totals)))  # some numbers a queue and phase
    own = F.lit(shared)
    for i, (source, _) in enumerate(named):
        own = F.when(F.col("source").eqNullSafe(F.lit(source)), i).otherwise(own)
    over = W.partitionBy("queue").orderBy("source", "part")
    starts = stored(counts.withColumn("queue", own).select("source", "part", "queue", (F.sum("n").over(over) - F.col("n")).alias("begin")), "packing-starts")
    by = starts.select(F.col("source").alias("s"), F.col("part").alias("p"), "queue", "begin")
    # Spark broadcasts the starts (a row a task and source) while they are small, and else shuffles both.
    placed = coded.join(by, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("doc_id", "source", "queue", (F.col("begin") + F.col("ahead")).alias("begin"), "doc_tokens", "ids")
    fields = [placed.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in PIECES), placed.schema["source"], *([T.StructField("ids", T.BinaryType())] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids", 2 << 20, 1000):
                yield from _cut(part, dealer.value, with_ids)

    return placed.mapInArrow(tidy(run), T.StructType(fields))


def _cut(part: pa.RecordBatch, dealer: Dealer, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents of a batch; those that follow each other in a queue are dealt at once."""
    queue, begin, n = (part.column(i).to_numpy() for i in (2, 3, 4))
    ids = part.column(5).to_pylist()
    order = np.lexsort((begin, queue))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (queue[order][1:] != queue[order][:-1]) | (begin[order][1:] != (begin + n)[order][:-1])
    for rows in np.split(order, np.flatnonzero(new)[1:]):
        low, high = int(begin[rows[0]]), int(begin[rows[-1]] + n[rows[-1]])
        raw = b"".join([ids[i] for i in rows])
        wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * (high - low) else "<u4").astype("<u4").tobytes()
        for a, b, window, offset in dealer.places(int(queue[rows[0]]), low, high):
            # Cut what a window holds where documents end, too.
            firsts = begin[rows]
            edges = np.union1d(a, firsts[(firsts >= a[0]) & (firsts < b[-1])])
            ends = np.append(edges[1:], b[-1])
            w = np.searchsorted(a, edges, side="right") - 1
            d = np.searchsorted(firsts, edges, side="right") - 1
            cut = [wide[4 * (x - low) : 4 * (y - low)] for x, y in zip(edges.tolist(), ends.tolist(), strict=True)]
            doc = pa.array(rows[d])
            columns = [part.column(0).take(doc), pa.array(edges - firsts[d]), pa.array(ends - edges), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[rows][d]), pa.array(window[w]), pa.array(offset[w] + edges - a[w]), part.column(1).take(doc)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
            if with_ids:
                columns, names = [*columns, pa.array(cut, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id, n_tokens, padding, ids: the packed windows, from pieces ``with_ids``. A group is one window at most."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))), lambda x: x["h"]), "")
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(joined).alias("ids"))
    n = F.col("n_tokens")
    return whole.select("sequence_id", "n_tokens", F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(window - n).alias("padding"), "ids")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), public_tokenizer())
