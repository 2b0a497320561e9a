"""Stored token ids against the texts they belong to, both ways, by a tokenizer file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that are encoded at once; their ids are all that a task holds beside its batch.
AT_ONCE = 64
_OWN: dict[str, object] = {}


def _tokenizer(path: str):
    """The worker's tokenizer; tasks of one worker share it."""
    if path not in _OWN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import tokenizers

        own = tokenizers.Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _OWN[path] = own
    return _OWN[path]


def with_ids(rows: DataFrame, text: str, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the token ids of a text column; null texts have none (an empty list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = [e.ids for e in own.encode_batch_fast([t or "" for t in part.column(part.num_columns - 1).to_pylist()], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=[*part.schema.names[:-1], ids])

    kept = [c for c in rows.columns if c != ids]
    frame = rows.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(f"{text}_"))
    return frame.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def verify_tokens(rows: DataFrame, key: str, text: str, ids: str, path: str, decoded: str | None = None) -> DataFrame:
    """key, encodes, first_wrong, decodes: are the stored ids those of the text, from which id on not, and what they decode to ``decoded``'s text.

    ``first_wrong`` is the first position at which the ids differ, the shorter list's length where one begins with the
    other, and null where none does. Ids are decoded with special tokens kept; without ``decoded``, what the text's own
    ids decode to is the measure. A null text is empty; null ids, or ids outside the vocabulary, are wrong.
    """
    names = ("encodes", "first_wrong", "decodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        top = own.get_vocab_size()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                fresh = [e.ids for e in own.encode_batch_fast([t or "" for t in part.column(1).to_pylist()], add_special_tokens=False)]
                kept = part.column(2).to_pylist()
                shown = part.column(3).to_pylist() if decoded else [None] * len(fresh)
                wrong = [None if a == b else next((i for i, (x, y) in enumerate(zip(a, b or [], strict=False)) if x != y), min(len(a), len(b or []))) for a, b in zip(fresh, kept, strict=True)]
                sound = [b is not None and all(x is not None and 0 <= x < top for x in b) for b in kept]
                read = [own.decode(b, skip_special_tokens=False) if good else None for b, good in zip(kept, sound, strict=True)]
                meant = [s if decoded else own.decode(a, skip_special_tokens=False) for a, s in zip(fresh, shown, strict=True)]
                made = [pa.array([w is None and b is not None for w, b in zip(wrong, kept, strict=True)]), pa.array(wrong, pa.int64()), pa.array([r is not None and r == (m or "") for r, m in zip(read, meant, strict=True)])]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=[key, *names])

    frame = rows.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{ids}`").cast("array<int>").alias("i"), *([F.col(f"`{decoded}`").cast("string").alias("d")] if decoded else []))
    return frame.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("encodes", T.BooleanType()), T.StructField("first_wrong", T.LongType()), T.StructField("decodes", T.BooleanType())]))
