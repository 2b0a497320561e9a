"""Substring dedup by relative Lempel-Ziv parsing.

Every document is parsed against all documents with a smaller doc_id: at each
place the longest factor is taken that a reference holds from the place its
window points to, and the parse goes on at the factor's boundary. Factors have at
least ``WINDOW`` words; they are the duplicate spans. The windows that straddle a
boundary are looked up on their own, so that a word is removed exactly if some
window of 13 words over it also starts in a smaller document.

The references are indexed in blocks:

1. Each window elects an anchor, the least hash of its 4-word runs. Equal windows
   elect equal anchors, and neighbours mostly the same one, so there is about
   one anchor for five windows. Only anchors go through the first shuffle.
2. Anchors that two documents share are sent back to their documents. Only the
   stretches around them can be copies; about a quarter of a corpus with copies.
3. Stretches with one anchor meet in one reference block, smallest doc_id first.
   A stretch is factored against the block's words and then joins the block.
4. The factors go back to their documents, where those that continue each other
   are one, and the document's greedy parse decides what is removed.

An anchor in ``HOT`` documents or more would make a huge block. Its windows are
dealt out by their own hashes instead, 128 bits each, in two levels: first each
batch of documents settles which of its documents is the smallest to hold a
window, then those meet. A batch in which ``CROWD`` documents share an anchor
doesn't send these to the anchor's block either. So a key gets at most CROWD
rows from each batch of 10,000 documents, and a hot window one, whatever the
group's size; no task holds a key's rows.

Words are ``[^\\x20\\x09-\\x0D]+``. Null or empty text: no words, nothing removed.
Null doc_id: later than all others. Repeated doc_ids: neither row is smaller, each
is judged by itself. Texts of fewer than 13 words lose nothing. A very long text
is one row and is read in one piece, at some ten times its size. Empty table:
empty result. Extra columns pass through; output columns replace their likes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.llm.text import Words, grams, slices, tidy

WINDOW, RUN = 13, 4
#: An anchor in so many documents is dealt out by whole windows; also if a batch alone has CROWD of them.
HOT, CROWD = 128, 16
#: Bytes of text, anchors and hot windows that a worker looks at together.
SLICE, HELD = 2 << 20, 400_000
LAST = 2**63 - 1
_ANCHORS = "anchor long, did long, weight int"
_SHARED = "did long, anchor long, hot boolean"
#: kind: a stretch around an anchor (key), a hot window (key, key2: its hash), or a settled factor.
STRETCH, HOT_WINDOW, SETTLED = 0, 1, 2
_PIECE = "kind int, key long, key2 long, did long, at long, text binary"
_FACTOR = "did long, th int, start int, n int, ref long, ref_at int"


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of each window, its first word and the word hashes."""
    hashes = words.hashes()
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), hashes
    runs = grams(hashes, RUN)
    least = runs[:n].copy()
    for j in range(1, WINDOW - RUN + 1):
        np.minimum(least, runs[j : j + n], out=least)
    at = np.flatnonzero(words.row[:n] == words.row[WINDOW - 1 :])
    return least[at], at, hashes


def _runs(*same: np.ndarray) -> np.ndarray:
    """Starts of runs in which all the arrays stay equal."""
    n = len(same[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = False
        for x in same:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _emit_anchors(batches: Iterator[pa.RecordBatch], hot_at: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """Distinct (anchor, document) of a batch; weight -1: settled here as shared and hot; else the documents it stands for."""

    def settle(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        anchor, did = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((did, anchor))
        anchor, did = anchor[order], did[order]
        first = _runs(anchor, did)
        anchor, did = anchor[first], did[first]
        starts = _runs(anchor)
        sizes = np.diff(np.append(starts, len(anchor)))
        weight = np.where(np.repeat(sizes, sizes) >= crowd, -1, 1).astype(np.int32)
        crowded = sizes >= crowd
        speaks = starts[crowded]  # one row of each settled anchor tells the others
        out = [np.concatenate(x) for x in ((anchor, anchor[speaks]), (did, did[speaks]), (weight, np.maximum(sizes[crowded], hot_at).astype(np.int32)))]
        for i in range(0, len(out[0]), 200_000):
            a, d, w = (x[i : i + 200_000] for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(d), pa.array(w)], names=["anchor", "did", "weight"])

    for whole in batches:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(whole, limit=SLICE):
            words = Words(batch.column("text"))
            anchor, at, _ = _windows(words)
            did = batch.column("did").to_numpy()[words.row[at]]
            first = _runs(anchor, did)
            held.append((anchor[first], did[first]))
            if sum(len(a) for a, _ in held) >= HELD:
                yield from settle(held)
                held = []
        if held:
            yield from settle(held)


def _share(batches: Iterator[pa.RecordBatch], hot_at: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: keep those of anchors that two documents share. At most ``hot_at`` rows of an anchor are held."""
    kept = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    told = None  # the anchor at hand, once it is known to be hot

    def settle(a: np.ndarray, d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = _runs(a)
        if not len(starts):
            return d, a, np.zeros(0, dtype=bool)
        sizes = np.diff(np.append(starts, len(a)))
        hot = np.add.reduceat(w, starts) >= hot_at
        shared = hot | (np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts))
        keep = np.repeat(shared, sizes)
        return d[keep], a[keep], np.repeat(hot, sizes)[keep]

    def batch_of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["did", "anchor", "hot"])

    for batch in batches:
        a, d, w = (batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "did", "weight"))
        done = w < 0
        parts = [(d[done], a[done], np.ones(int(done.sum()), dtype=bool))]
        a, d, w = (np.concatenate([k, x[~done]]) for k, x in zip(kept, (a, d, w), strict=True))
        if told is not None and len(a):
            n = int(np.searchsorted(a, told, side="right"))
            parts.append((d[:n], a[:n], np.ones(n, dtype=bool)))
            a, d, w = a[n:], d[n:], w[n:]
        if len(a):
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
            told = a[-1] if w[cut:].sum() >= hot_at else None
            end = len(a) if told is not None else cut
            parts.append(settle(a[:end], d[:end], w[:end]))
            kept = a[end:], d[end:], w[end:]
        else:
            kept = a, d, w
        yield batch_of(parts)
    if len(kept[0]):
        yield batch_of([settle(*kept)])


def _joined(th: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A row's text hash and a place in it, in one long."""
    return th.astype(np.int64) << 32 | start.astype(np.int64)


def _pieces(kind: int, key: np.ndarray, key2: np.ndarray, did: np.ndarray, at: np.ndarray, texts: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), 20_000):
        s = slice(i, i + 20_000)
        n = len(key[s])
        text = pa.nulls(n, pa.binary()) if texts is None else pa.array(texts[s], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(x[s].astype(np.int64, copy=False)) for x in (key, key2, did, at)), text], names=["kind", "key", "key2", "did", "at", "text"])


def _settle_windows(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Hot windows of a batch: only its smallest document's go on, the others point to these."""
    h1, h2, did, th, place, row = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((place, row, did, h2, h1))
    firsts = _runs(h1[order], h2[order])
    owner = np.empty(len(h1), dtype=np.int64)
    owner[order] = np.repeat(order[firsts], np.diff(np.append(firsts, len(order))))
    least = did[owner]
    # Of a row's equal windows the first goes on; the others repeat it, whatever becomes of it.
    twin = _runs(h1[order], h2[order], row[order])
    head = np.empty(len(h1), dtype=np.int64)
    head[order] = np.repeat(order[twin], np.diff(np.append(twin, len(order))))
    first = head == np.arange(len(h1))
    goes = np.flatnonzero((did == least) & first)
    yield from _pieces(HOT_WINDOW, h1[goes].view(np.int64), h2[goes].view(np.int64), did[goes], _joined(th[goes], place[goes]))
    known, repeats = np.flatnonzero(did > least), np.flatnonzero((did == least) & ~first)
    which = np.concatenate([known, repeats])
    ref = np.concatenate([least[known], did[repeats]])
    ref_at = np.concatenate([place[owner[known]], place[head[repeats]]])
    sign = np.concatenate([np.ones(len(known), dtype=np.int64), -np.ones(len(repeats), dtype=np.int64)])
    starts = _runs(row[which], place[which] - np.arange(len(which)), ref, ref_at - np.arange(len(which)), sign)
    n = np.diff(np.append(starts, len(which))) * sign[starts]
    own = which[starts]
    yield from _pieces(SETTLED, n << 32 | ref_at[starts], ref[starts], did[own], _joined(th[own], place[own]))


def _emit_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches around shared anchors, hot windows, and the factors that a batch has settled."""
    for whole in batches:
        held: list[list[np.ndarray]] = []
        seen = 0
        for batch in slices(whole, limit=SLICE):
            words = Words(batch.column("text"))
            anchor, at, hashes = _windows(words)
            lists = {c: np.unique(batch.column(c).flatten().to_numpy().view(np.uint64)) for c in ("shared", "hot")}
            took = np.isin(anchor, lists["shared"])
            anchor, at = anchor[took], at[took]
            is_hot = np.isin(anchor, lists["hot"])
            did_of, th_of = batch.column("did").to_numpy(), batch.column("th").to_numpy()
            row = words.row[at]
            place = at - words.first[row]
            # Anchors of few documents: a run of windows with one anchor is one stretch.
            cold = np.flatnonzero(~is_hot)
            starts = _runs(anchor[cold], at[cold] - np.arange(len(cold)), row[cold])
            sizes = np.diff(np.append(starts, len(cold)))
            head = cold[starts]
            raw = words.bytes.tobytes()
            texts = [raw[a:b] for a, b in zip(words.start[at[head]].tolist(), words.end[at[head] + sizes + WINDOW - 2].tolist(), strict=True)]
            yield from _pieces(STRETCH, anchor[head].view(np.int64), np.zeros(len(head), dtype=np.int64), did_of[row[head]], _joined(th_of[row[head]], place[head]), texts)
            hot = np.flatnonzero(is_hot)
            if len(hot):
                held.append([grams(hashes, WINDOW, 1)[at[hot]], grams(hashes, WINDOW, 2)[at[hot]], did_of[row[hot]], th_of[row[hot]], place[hot], row[hot] + seen])
            seen += batch.num_rows
            if sum(len(x[0]) for x in held) >= HELD:
                yield from _settle_windows(held)
                held = []
        if held:
            yield from _settle_windows(held)


class Block:
    """The stretches around one anchor, smallest document first: what they say, and the first place of each window."""

    __slots__ = ("index", "whole", "held")

    def __init__(self) -> None:
        self.index: dict[bytes, tuple[int, int]] = {}
        self.whole: dict[bytes, tuple[int, int, int]] = {}
        #: (document, place, words) of each stretch that brought a new window.
        self.held: list[tuple[int, int, list[bytes]]] = []

    def factors(self, did: int, start: int, text: bytes) -> list[tuple[int, int, int, int]]:
        """(start, windows, reference, place): the stretch's greedy parse against the block, which it then joins."""
        seen = self.whole.get(text)
        if seen is not None and seen[0] < did:
            return [(start, seen[2], seen[0], seen[1])]
        words = text.split()
        n = len(words) - WINDOW + 1
        out, own, at, index, held = [], len(self.held), 0, self.index, self.held
        while at < n:
            window = b" ".join(words[at : at + WINDOW])
            found = index.setdefault(window, (own, at))
            ref, place = found
            if ref == own or held[ref][0] >= did:
                at += 1
                continue
            ref_did, ref_start, ref_words = held[ref]
            most, length = min(len(words) - at, len(ref_words) - place), WINDOW
            while length < most and words[at + length] == ref_words[place + length]:
                length += 1
            out.append((start + at, length - WINDOW + 1, ref_did, ref_start + place))
            at += length - WINDOW + 1  # the next window straddles the factor's boundary
        if n > sum(f[1] for f in out):
            held.append((did, start, words))
        self.whole.setdefault(text, (did, start, n))
        return out


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, key, key2, did, at): the factors of stretches, hot windows and what batches settled."""
    now, block = None, Block()
    hot: tuple | None = None  # the window at hand and its smallest document
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        key, key2, did, at = (batch.column(c).to_numpy() for c in ("key", "key2", "did", "at"))
        parts: list[list[np.ndarray]] = []
        cold, settled = int(np.searchsorted(kind, HOT_WINDOW)), int(np.searchsorted(kind, SETTLED))
        for lo in range(0, cold, 2000):
            s = slice(lo, min(cold, lo + 2000))
            rows, own = [], []
            for i, (k, d, a, text) in enumerate(zip(key[s].tolist(), did[s].tolist(), at[s].tolist(), batch.column("text").slice(lo, s.stop - lo).to_pylist(), strict=True)):
                if k != now:
                    now, block = k, Block()
                found = block.factors(d, a & 0xFFFFFFFF, text)
                rows += found
                own += [lo + i] * len(found)
            if rows:
                own = np.array(own)
                start, n, ref, place = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
                parts.append([did[own], at[own] >> 32, start, n, ref, place])
        if settled > cold:
            s = slice(cold, settled)
            a, b, d, p = key[s], key2[s], did[s], at[s]
            starts = _runs(a, b)
            sizes = np.diff(np.append(starts, len(a)))
            least, place = d[starts].copy(), (p[starts] & 0xFFFFFFFF).copy()
            if hot is not None and hot[:2] == (a[0], b[0]):
                least[0], place[0] = hot[2:]
            hot = (a[-1], b[-1], least[-1], place[-1])
            least, place = np.repeat(least, sizes), np.repeat(place, sizes)
            more = d > least
            parts.append([d[more], p[more] >> 32, p[more] & 0xFFFFFFFF, np.ones(int(more.sum()), dtype=np.int64), least[more], place[more]])
        s = slice(settled, None)
        parts.append([did[s], at[s] >> 32, at[s] & 0xFFFFFFFF, key[s] >> 32, key2[s], key[s] & 0xFFFFFFFF])
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        kinds = [np.int64, np.int32, np.int32, np.int32, np.int64, np.int32]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], names=["did", "th", "start", "n", "ref", "ref_at"])


def parse(n_words: int, pointers: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """The greedy parse into factors (start, words, reference, place), and the words that they cover, which are removed.

    ``pointers``: (start, windows, reference, place); each covers windows + 12 words. A negative number of windows
    says that they repeat the document's own windows at ``place``, and share their fate. A factor that begins in the
    last words of the one before is listed from where that ends.
    """
    repeats = [p for p in pointers if p[1] < 0]
    if repeats:
        pointers = [p for p in pointers if p[1] > 0]
        source = {start + i: (ref, place + i) for start, n, ref, place in pointers for i in range(n)}
        pointers = pointers + [(start + i, 1, *source[place + i]) for start, n, _, place in repeats for i in range(-n) if place + i in source]
    joined: list[list[int]] = []  # pointers that continue each other
    for start, n, ref, place in sorted(pointers, key=lambda p: (p[2], p[3] - p[0], p[0])):
        last = joined[-1] if joined else None
        if last and last[2] == ref and last[3] - last[0] == place - start and start <= last[1]:
            last[1] = max(last[1], start + n)
        else:
            joined.append([start, start + n, ref, place])
    joined.sort()
    removed = np.zeros(n_words, dtype=bool)
    factors: list[tuple[int, int, int, int]] = []
    at = nth = covered = 0
    best = (0, 0, 0, 0)  # of the copies that hold the window at hand, the one that goes furthest
    while True:
        while nth < len(joined) and joined[nth][0] <= at:
            if joined[nth][1] > best[1]:
                best = tuple(joined[nth])
            nth += 1
        start, stop, ref, place = best
        if stop > at:
            end = stop + WINDOW - 1
            removed[at:end] = True
            begin = max(at, covered)
            factors.append((begin, end - begin, ref, place + begin - start))
            at, covered = stop, end
        elif nth < len(joined):
            at = joined[nth][0]
        else:
            return factors, removed


_RESULT = "n_words long, n_removed long, kept_sha256 string, kept string, factors array<struct<start:int,words:int,ref_doc_id:long,ref_start:int>>"


def _finish(with_text: bool, with_factors: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int32())]))
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                names = batch.schema.names
                texts = batch.column(names.index("text")).cast(pa.binary()).to_pylist()
                ths = batch.column(names.index("th")).to_pylist()
                found = batch.column(names.index("pointers"))
                flat = found.flatten()
                fields = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("th", "start", "n", "ref", "ref_at")]
                ends = np.cumsum(pc.fill_null(found.value_lengths(), 0).to_numpy(zero_copy_only=False))
                n_words, n_removed, digests, kept, factors = [], [], [], [], []
                for text, th, begin, end in zip(texts, ths, [0, *ends.tolist()], ends.tolist(), strict=False):
                    words = (text or b"").split()
                    own = [p[1:] for p in zip(*(f[begin:end].tolist() for f in fields), strict=True) if p[0] == th] if end > begin else ()
                    if own:
                        parsed, gone = parse(len(words), own)
                        left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                        lost = int(gone.sum())
                    else:
                        parsed, left, lost = [], b" ".join(words), 0
                    n_words.append(len(words))
                    n_removed.append(lost)
                    digests.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        kept.append(left.decode() if lost else None)
                    if with_factors:
                        factors.append([dict(zip(("start", "words", "ref_doc_id", "ref_start"), f, strict=True)) for f in parsed])
                made = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
                if with_text:
                    made["kept"] = pa.array(kept, pa.string())
                if with_factors:
                    made["factors"] = pa.array(factors, kind)
                keep = [i for i, c in enumerate(names) if c.startswith("__c")]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made.values()], names=[*(names[i] for i in keep), *made])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, with_factors: bool = False, hot: int = HOT) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256; on request the kept text (null where nothing was removed) and the factors."""
    spark: SparkSession = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = [f for f in T.StructType.fromDDL(_RESULT).fields if (f.name != "kept" or with_text) and (f.name != "factors" or with_factors)]
    kept = [c for c in docs.columns if c not in {f.name for f in made}]
    text = F.col(f"`{text_col}`").cast("string")
    carried = [(i, c) for i, c in enumerate(kept) if c not in (id_col, text_col)]
    base = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("did"),
        F.hash(text).alias("th"),
        text.alias("text"),
        *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in carried),
    )
    anchors = base.select("did", "text").mapInArrow(tidy(lambda batches: _emit_anchors(batches, hot, min(hot, CROWD))), _ANCHORS)
    shared = (
        anchors.repartition(parts, F.when(F.col("weight") < 0, F.col("did")).otherwise(F.col("anchor")))
        .sortWithinPartitions("anchor")
        .mapInArrow(tidy(lambda batches: _share(batches, hot)), _SHARED)
    )
    lists = shared.groupBy("did").agg(F.collect_list("anchor").alias("shared"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    # One shuffle of the texts serves both joins.
    placed = base.repartition(parts, "did")
    stretches = placed.join(lists, "did").select("did", "th", "text", "shared", "hot").mapInArrow(tidy(_emit_stretches), _PIECE)
    factors = (
        stretches.repartition(parts, F.when(F.col("kind") == SETTLED, F.col("did")).otherwise(F.col("key")))
        .sortWithinPartitions("kind", "key", "key2", "did", "at")
        .mapInArrow(tidy(_factor), _FACTOR)
    )
    pointers = factors.groupBy("did").agg(F.collect_list(F.struct("th", "start", "n", "ref", "ref_at")).alias("pointers"))
    own = {id_col: F.when(F.col("did") != LAST, F.col("did")).cast(docs.schema[id_col].dataType), text_col: F.col("text")}
    columns = [(own[c] if c in own else F.col(f"__c{i}")).alias(f"__c{i}") for i, c in enumerate(kept)]
    types = [T.StringType() if c == text_col else docs.schema[c].dataType for c in kept]
    schema = T.StructType([*(T.StructField(f"__c{i}", kind) for i, kind in enumerate(types)), *made])
    out = placed.join(pointers, "did", "left").select("th", "text", "pointers", *columns).mapInArrow(tidy(_finish(with_text, with_factors)), schema)
    return out.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)), *(f.name for f in made))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE doc_id > least),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(k.t, '') END) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w WHERE doc_id IN (SELECT doc_id FROM lost)) a
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id) k USING (doc_id)
"""
