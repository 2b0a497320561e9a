"""Words, offsets and seeded edits, a slice of texts at a time: no shuffle, memory bounded by the slice, any text length.

Words are maximal runs of ASCII letters; they are found for a whole Arrow slice at once in its UTF-8 buffer. Python
looks at editable words alone. Null texts are empty; columns that an operator adds replace columns of their names.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.functions.dims import EDITABLE, KEYBOARD, KINDS, TYPO_SEED

EDIT = "struct<start:int,end:int,before:string,after:string,word_start:int,word_end:int,original_word:string>"
#: Bytes of text and rows that are looked at together.
SLICE, ROWS = 1 << 18, 500
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Words:
    """All words of an array of texts: row, nth (in its text), start and end in code points, and the words themselves."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] if len(texts) else 0
        raw = raw[at : at + ends[-1]]
        letter = np.append(_LETTER[raw], False)
        new, last = letter.copy(), letter.copy()
        new[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        cut = ends[(ends > 0) & (ends < len(raw))]  # a word never runs on into the next text
        new[cut] |= letter[cut]
        last[cut - 1] |= letter[cut - 1]
        begin = np.flatnonzero(new)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        length = np.flatnonzero(last) + 1 - begin
        self.row = np.searchsorted(ends, begin, side="right") - 1
        self.start = points[begin] - points[ends[:-1]][self.row]
        self.end = self.start + length
        self.count = np.bincount(self.row, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.nth = np.arange(len(begin)) - self.first[self.row]
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        self.text = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw[letter[:-1]].tobytes()))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value of each word, by text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def among(self, chosen: tuple[str, ...]) -> np.ndarray:
        """Whether each word is one of ``chosen``, in any case."""
        return pc.is_in(pc.ascii_lower(self.text), value_set=pa.array(chosen, pa.large_string())).to_numpy(zero_copy_only=False)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            upto = int(np.searchsorted(ends, ends[at] - sizes[at] + SLICE, side="right"))
            upto = min(max(upto, at + 1), at + ROWS)
            yield batch.slice(at, upto - at)
            at = upto


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose worker gives the memory it no longer uses back now and then and at its end: workers live on from task to task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for i, part in enumerate(run(batches)):
                yield part
                if i % 32 == 31:
                    _give_back()
        finally:
            _give_back()

    return whole


def _per_slice(df: DataFrame, hidden: dict[str, Column], added: str, work: Callable, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``added`` columns. ``work`` gets a slice with the ``hidden`` columns (``__text`` among them) and returns the rows to keep (None: all) and the new columns."""
    new = T.StructType.fromDDL(added)
    kept = [c for c in df.columns if c not in new.names and c not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "__text"):
            rows, columns = work(part)
            old = [part.column(i) if rows is None else part.column(i).take(rows) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*old, *columns], names=[*kept, *new.names])

    inner = df.select(*(F.col(f"`{c}`") for c in kept), *(c.alias(n) for n, c in hidden.items()))
    return inner.mapInArrow(tidy(run), T.StructType([*(df.schema[c] for c in kept), *new.fields]))


def _text(name: str) -> dict[str, Column]:
    return {"__text": F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))}


def word_offsets(df: DataFrame, text: str) -> DataFrame:
    """A row for each word, in place of the text: start, end and word."""

    def work(part: pa.RecordBatch):
        found = Words(part.column("__text"))
        return pa.array(found.row), [pa.array(found.start, pa.int64()), pa.array(found.end, pa.int64()), found.text.cast(pa.string())]

    return _per_slice(df, _text(text), "start long, end long, word string", work, (text,))


def offset_sums(df: DataFrame, text: str, chosen: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with words, letters, the sum of word starts, and how many words are among ``chosen``."""

    def work(part: pa.RecordBatch):
        found = Words(part.column("__text"))
        values = [found.count, found.sums(found.end - found.start), found.sums(found.start), found.sums(found.among(chosen))]
        return None, [pa.array(v, pa.int64()) for v in values]

    return _per_slice(df, _text(text), "words long, letters long, starts long, chosen long", work)


# Edits. ``pick(label, options)`` draws one of the options; what draws is the caller's affair.


def _transpose(word: str, pick: Callable) -> tuple[int, str, str] | None:
    unlike = [i for i in range(len(word) - 1) if word[i] != word[i + 1]]
    if not unlike:
        return None
    at = pick("at", unlike)
    return at, word[at : at + 2], word[at + 1] + word[at]


def _delete(word: str, pick: Callable) -> tuple[int, str, str]:
    at = pick("at", range(len(word)))
    return at, word[at], ""


def _keyboard(word: str, pick: Callable) -> tuple[int, str, str]:
    at = pick("at", range(len(word)))
    key = pick("key", KEYBOARD[word[at].lower()])
    return at, word[at], key if word[at].islower() else key.upper()


CHANGES = dict(zip(KINDS, (_transpose, _delete, _keyboard), strict=True))


class Hashed:
    """Draws that any engine can repeat: eight hex digits of an MD5 of (seed, id, kind, run of the text, label)."""

    def __init__(self, seed: int, row: str | None, kind: str) -> None:
        self.head = ":".join([str(seed), *([] if row is None else [row]), kind]) + ":"

    def draw(self, *more: object) -> int:
        return int.from_bytes(hashlib.md5((self.head + ":".join(map(str, more))).encode()).digest()[:4])

    def order(self, runs: list[int]) -> list[int]:
        """The runs by their draws."""
        head, md5 = self.head, hashlib.md5
        return [i for _, i in sorted([(md5(f"{head}{i}".encode()).digest()[:4], i) for i in runs])]

    def picker(self, run: int) -> Callable:
        return lambda label, options: options[self.draw(run, label) % len(options)]


class Twister:
    """Draws of the Mersenne Twister, one after the other, for runs that were frozen with it."""

    def __init__(self, seed: int, row: str | None, kind: str) -> None:
        self.source = random.Random(int(hashlib.sha256(f"{seed}:{row}:{kind}".encode()).hexdigest(), 16))

    def order(self, runs: list[int]) -> list[int]:
        self.source.shuffle(runs)
        return runs

    def picker(self, run: int) -> Callable:
        return lambda label, options: self.source.choice(options)


def _edited(found: Words, texts: list[str], keys: list[str | None], kinds: list[str | None], levels: list[float], chosen: tuple[str, ...], seed: int, draws: type) -> tuple[list[tuple], list[int], list[str]]:
    """Of texts whose words are found: all edits, how many there are up to each text (from 0), and the altered texts."""
    own = np.flatnonzero(found.among(chosen))
    spots, words, rows = found.start[own].tolist(), found.text.take(pa.array(own)).to_pylist(), found.row[own]
    bounds, nth = np.searchsorted(rows, np.arange(len(texts) + 1)).tolist(), found.nth[own].tolist()
    edits, counts, altered = [], [0], []
    for r, text in enumerate(texts):
        lo, hi = bounds[r], bounds[r + 1]
        change = CHANGES.get(kinds[r])
        made = []
        if change and hi > lo:
            # Words and what stands between them alternate, so a word's run follows from its number.
            lead = 0 if text[0].isascii() and text[0].isalpha() else 1
            source = draws(seed, keys[r], kinds[r])
            at = {2 * nth[i] + lead: i for i in range(lo, hi)}
            for run in source.order(list(at))[: math.ceil(levels[r] * (hi - lo))]:
                one = change(words[at[run]], source.picker(run))
                if one:
                    made.append((at[run], *one))
        made.sort()
        pieces, done = [], 0
        for i, shift, before, after in made:
            start = spots[i] + shift
            pieces += [text[done:start], after]
            done = start + len(before)
            edits.append((start, done, before, after, spots[i], spots[i] + len(words[i]), words[i]))
        counts.append(len(edits))
        altered.append("".join([*pieces, text[done:]]))
    return edits, counts, altered


def perturb(df: DataFrame, id_col: str, text_col: str, kind: str | Column, level: float | Column, editable: tuple[str, ...] = EDITABLE, seed: int = TYPO_SEED, exact: bool = False) -> DataFrame:
    """Adds total_words, eligible_words, edits and altered.

    Of the words in ``editable`` the first ceil(level * n) in drawn order get one edit each; a word that offers none is
    passed over. The level is no key of the draws, so a lower level's edits are among a higher one's. ``kind`` and
    ``level`` may be columns; the kind ``clean`` edits nothing. ``exact`` draws as frozen runs did.
    """
    if isinstance(kind, str) and kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    draws = Twister if exact else Hashed
    chosen = tuple(w.lower() for w in editable)
    edit_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("word_start", pa.int32()), ("word_end", pa.int32()), ("original_word", pa.string())])

    def work(part: pa.RecordBatch):
        found = Words(part.column("__text"))
        texts, *asked = (part.column(c).to_pylist() for c in ("__text", "__id", "__kind", "__level"))
        edits, counts, altered = _edited(found, texts, *asked, chosen, seed, draws)
        fields = zip(*edits, strict=True) if edits else ([] for _ in edit_type)
        flat = pa.StructArray.from_arrays([pa.array(list(v), f.type) for v, f in zip(fields, edit_type, strict=True)], fields=list(edit_type))
        return None, [pa.array(found.count, pa.int64()), pa.array(found.sums(found.among(chosen)), pa.int64()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat), pa.array(altered, pa.string())]

    hidden = _text(text_col) | {"__id": F.col(f"`{id_col}`").cast("string"), "__kind": F.lit(kind) if isinstance(kind, str) else kind, "__level": (level if isinstance(level, Column) else F.lit(float(level))).cast("double")}
    return _per_slice(df, hidden, f"total_words long, eligible_words long, edits array<{EDIT}>, altered string", work)


def measures(text: str, level: float | Column) -> dict[str, Column]:
    """What the edits of a row amount to."""
    changed = F.size("edits").cast("long")
    share = lambda n: F.when(n > 0, changed / n).otherwise(F.lit(0.0))
    return {
        "target_eligible_word_rate": level if isinstance(level, Column) else F.lit(float(level)),
        "changed_words": changed,
        "realized_eligible_word_rate": share(F.col("eligible_words")),
        "realized_all_word_rate": share(F.col("total_words")),
        "character_edit_operations": changed,
        "touched_original_characters": F.aggregate("edits", F.lit(0), lambda a, e: a + e["end"] - e["start"]).cast("long"),
        "unchanged": F.col("altered") == F.col(text),
        "possible_meaning_change": changed > 0,
        "semantic_review": F.when(changed > 0, "unreviewed_optional_word_edits").otherwise("unchanged"),
    }


def _spliced(texts: list[str | None], starts: list[int], ends: list[int], befores: list[str], afters: list[str | None], bounds: list[int]) -> Iterator[str | None]:
    """Each text with its edits (those between two bounds) in, by one pass over the text."""
    for r, text in enumerate(texts):
        lo, hi = bounds[r], bounds[r + 1]
        pieces, done = [], 0
        for i in sorted(range(lo, hi), key=lambda i: (starts[i], ends[i])):
            start, end = starts[i], ends[i]
            if text is None or not done <= start <= end or text[start:end] != befores[i]:
                raise ValueError("overlapping or invalid edit")
            pieces += [text[done:start], afters[i]]
            done = end
        yield None if text is None or None in pieces else "".join([*pieces, text[done:]])


@F.arrow_udf(returnType=T.StringType())
def _splice(text: pa.Array, edits: pa.Array) -> pa.Array:
    if edits.null_count:
        raise ValueError("overlapping or invalid edit")
    out = []
    for part in _slices(iter([pa.RecordBatch.from_arrays([text, edits], names=["text", "edits"])]), "text"):
        own = part.column("edits")
        flat = own.flatten()
        bounds = [0, *np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64).tolist()]
        fields = (pc.struct_field(flat, c).to_pylist() for c in ("start", "end", "before", "after"))
        out.append(pa.array(_spliced(part.column("text").to_pylist(), *fields, bounds), pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def apply_edits(text: Column, edits: Column) -> Column:
    """Splice edits in; overlapping edits or a differing ``before`` fail the query. Time and memory grow with a text and its edits, not with their product."""
    return _splice(text, edits)


def nested_check(df: DataFrame, id_col: str, text_col: str, low: float, high: float, kinds: tuple[str, ...] = KINDS, editable: tuple[str, ...] = EDITABLE, seed: int = TYPO_SEED) -> DataFrame:
    """kind, documents, not_nested (an edit of the lower level isn't among the higher's) and not_spliced (the edits, spliced in, don't give the altered text).

    Texts pass once for all kinds and both levels; a slice leaves one row a kind.
    """
    chosen = tuple(w.lower() for w in editable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "__text"):
            texts, keys = part.column("__text").to_pylist(), part.column("__id").to_pylist()
            found, n = Words(part.column("__text")), len(texts)
            rows = []
            for kind in kinds:
                less, l_ends, _ = _edited(found, texts, keys, [kind] * n, [low] * n, chosen, seed, Hashed)
                more, ends, altered = _edited(found, texts, keys, [kind] * n, [high] * n, chosen, seed, Hashed)
                stray = sum(not set(less[l_ends[r] : l_ends[r + 1]]) <= set(more[ends[r] : ends[r + 1]]) for r in range(n))
                spliced = _spliced(texts, *([e[i] for e in more] for i in range(4)), ends)
                rows.append((kind, n, stray, sum(a != b for a, b in zip(spliced, altered, strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "n", "stray", "unlike"])

    counts = df.select(F.col(f"`{id_col}`").cast("string").alias("__id"), *(c.alias(n) for n, c in _text(text_col).items())).mapInArrow(tidy(run), "kind string, n long, stray long, unlike long")
    return counts.groupBy("kind").agg(F.sum("n").alias("documents"), F.sum("stray").alias("not_nested"), F.sum("unlike").alias("not_spliced"))
