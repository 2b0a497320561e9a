"""Canonical JSON of whole columns: sorted keys, no spaces, nulls kept, characters beyond ASCII as they are.

The form is that of Python's ``json.dumps(sort_keys=True, ensure_ascii=False, separators=(",", ":"))``: control characters
as ``\\u001f``, numbers by their shortest digits that read back the same. Columns of strings, whole numbers and booleans
are built of Spark's own expressions; the engine's number formats differ, so columns of doubles or nested values, and
no others of the row, go through an Arrow encoder: a slice of a column at a time, nested values as one flat column.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters with an escape of their own.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
ESCAPES = SHORT | {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in SHORT}
NATIVE = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


COMMON = ("\\", '"', "\n", "\r", "\t")


def quoted(text: Column) -> Column:
    """A JSON string; texts without a character to escape pass in one look, those with common ones alone in few."""

    def escaped(out: Column, raws) -> Column:
        for raw in raws:
            out = F.replace(out, F.lit(raw), F.lit(ESCAPES[raw]))
        return out

    common, rare = escaped(text, COMMON), escaped(text, ESCAPES)
    out = F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), rare).when(text.rlike(r'[\n\r\t"\\]'), common).otherwise(text)
    return F.concat(F.lit('"'), out, F.lit('"'))


def _number(x: float) -> str:
    return repr(x) if x - x == 0 else "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"


def _bounds(column: pa.Array) -> tuple[int, list[int]]:
    """Where a slice's values begin, and where each row's begin and end from there on."""
    ends = column.offsets.to_pylist()
    return ends[0], [e - ends[0] for e in ends]


def encoded(column: pa.Array) -> list[str]:
    """The JSON of every value of a column."""
    kind = column.type
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_struct(kind):
        order = sorted(range(kind.num_fields), key=lambda i: kind.field(i).name)
        keys = [encode_basestring(kind.field(i).name) + ":" for i in order]
        parts = [encoded(f) for f in (column.field(i) for i in order)] if column.offset == 0 else [encoded(f) for f in (column.flatten()[i] for i in order)]
        rows = ["{" + ",".join([k + v for k, v in zip(keys, row, strict=True)]) + "}" for row in zip(*parts, strict=True)] if parts else ["{}"] * len(column)
    elif pa.types.is_map(kind):
        first, ends = _bounds(column)
        keys, items = column.keys.slice(first, ends[-1]), encoded(column.items.slice(first, ends[-1]))
        names = keys.to_pylist()
        quotes = [encode_basestring(str(k)) for k in names]
        rows = ["{" + ",".join([f"{quotes[i]}:{items[i]}" for i in sorted(range(a, b), key=names.__getitem__)]) + "}" for a, b in pairwise(ends)]
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        first, ends = _bounds(column)
        values = encoded(column.values.slice(first, ends[-1]))
        rows = ["[" + ",".join(values[a:b]) + "]" for a, b in pairwise(ends)]
    elif pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return ["null" if v is None else encode_basestring(v) for v in column.to_pylist()]
    elif pa.types.is_boolean(kind):
        return ["null" if v is None else "true" if v else "false" for v in column.to_pylist()]
    elif pa.types.is_integer(kind):
        return ["null" if v is None else str(v) for v in column.to_pylist()]
    elif pa.types.is_floating(kind):
        return ["null" if v is None else _number(v) for v in column.to_pylist()]
    elif pa.types.is_null(kind):
        return ["null"] * len(column)
    else:
        raise TypeError(f"{kind} has no canonical JSON")
    return ["null" if gone else row for gone, row in zip(column.is_null().to_pylist(), rows, strict=True)] if column.null_count else rows


#: Bytes of a column that are encoded at once, unless one value is longer.
SLICE = 1 << 20


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    if len(column) > 1 and column.nbytes > SLICE:
        middle = len(column) // 2
        yield from _slices(column.slice(0, middle))
        yield from _slices(column.slice(middle))
    else:
        yield column


@F.arrow_udf(returnType=T.StringType())
def _encoded(column: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array(encoded(part), pa.string()) for part in _slices(column)])


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """The canonical JSON object of ``columns``, one for each row."""
    names = sorted(columns)
    kinds = {f.name: f.dataType for f in df.schema}

    def value(name: str) -> Column:
        column, kind = F.col(f"`{name}`"), kinds[name]
        return quoted(column) if isinstance(kind, T.StringType) else column.cast("string") if isinstance(kind, NATIVE) else _encoded(column)

    pairs = [F.concat(F.lit(encode_basestring(c) + ":"), F.coalesce(value(c), F.lit("null"))) for c in names]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
