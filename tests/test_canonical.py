"""Canonical JSON against the standard library, seals, stored token ids, and the valid prefixes of runs."""

import hashlib
import json
import math
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlight.functions import canonical
from pairlight.functions.canonical import canonical_json
from pairlight.operators import integrity, tokens
from pairlight.streaming import runlog

DEEP = "a double, b array<double>, c map<string,array<double>>, `d e` struct<z:string,y:array<struct<k:bigint,j:boolean>>>, f string, g float"


def text(r):
    return None if r.random() < 0.1 else "".join(r.choice("aé\"\\/\b\f\n\r\t\x00\x01\x1f\x7f 漢😀") for _ in range(r.randrange(6)))


def number(r):
    return r.choice([None, 0.0, -0.0, 1e16, 1e-5, 0.1, 1 / 3, 2.0**-44, 2e23, 5e-324, 1.7976931348623157e308, float("nan"), float("inf"), -float("inf"), r.uniform(-1, 1) * 10 ** r.randrange(-30, 30), struct.unpack("d", r.randbytes(8))[0]])


def standard(row):
    return json.dumps(row, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_nested_rows_are_the_standard_librarys(spark):
    r = random.Random(4)
    rows = []
    for _ in range(1500):
        some = lambda make: None if r.random() < 0.1 else [make(r) for _ in range(r.randrange(4))]
        names = lambda: {t: some(number) for t in (text(r) for _ in range(r.randrange(4))) if t is not None}
        rows.append((number(r), some(number), None if r.random() < 0.1 else names(), None if r.random() < 0.1 else {"z": text(r), "y": some(lambda r: r.choice([None, {"k": r.choice([None, -(2**63), 7]), "j": r.choice([None, True, False])}]))}, text(r), r.choice([None, 0.5, 3.0])))
    df = spark.createDataFrame(rows, DEEP)
    names = ["a", "b", "c", "d e", "f", "g"]
    got = df.select(canonical_json(df, names).alias("j"), *(f"`{n}`" for n in names)).collect()
    assert len(got) == len(rows)
    for line, row in zip(got, rows, strict=True):  # one file a slice: Spark keeps the order
        assert line.j == standard(dict(zip(names, row, strict=True)))


def test_plain_rows_need_no_python(spark):
    r = random.Random(5)
    rows = [(text(r), r.choice([None, -1, 2**62]), r.choice([None, True, False])) for _ in range(800)] + [(chr(c), 1, True) for c in range(256)]
    df = spark.createDataFrame(rows, "`q\"x` string, n long, b boolean").coalesce(1)
    made = df.select(canonical_json(df, df.columns).alias("j"))
    assert "Arrow" not in made._jdf.queryExecution().toString()
    assert [x.j for x in made.collect()] == [standard(dict(zip(df.columns, row, strict=True))) for row in rows]


def test_only_other_columns_go_to_python(spark):
    """Texts beside a double or a list stay in the engine; they went to the workers with the whole row."""
    df = spark.createDataFrame([(1, "a\n\"b", 0.1, ["x", None]), (2, None, None, None)], "id long, long_text string, score double, words array<string>")
    line = df.select(canonical_json(df, df.columns).alias("line"))
    calls = [x for x in line._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ArrowEvalPython" in x]
    assert calls and not any("long_text" in x.split("], [")[0] for x in calls)
    assert [json.loads(r.line) for r in line.collect()] == [r.asDict() for r in df.collect()]


def test_columns_in_slices(monkeypatch):
    kind = pa.struct([("m", pa.map_(pa.string(), pa.float64())), ("l", pa.list_(pa.list_(pa.string())))])
    values = [None if i % 7 == 0 else {"m": None if i % 5 == 0 else [(f"k{j}", j / 3) for j in range(i % 4)], "l": [["x" * i, None], None, []][: i % 3 + 1]} for i in range(300)]
    column = pa.array(values, kind)
    whole = canonical.encoded(column)
    monkeypatch.setattr(canonical, "SLICE", 500)
    parts = list(canonical._slices(column))
    assert len(parts) > 20 and [x for p in parts for x in canonical.encoded(p)] == whole
    assert whole[11] == json.dumps({"m": dict(values[11]["m"]), "l": values[11]["l"]}, sort_keys=True, separators=(",", ":"))


def test_seals_with_doubles(spark):
    rows = [(i, math.pi * 10.0**i, None if i % 3 == 0 else f"t\x1f{i}") for i in range(-20, 20)]
    df = spark.createDataFrame(rows, "id long, x double, t string")
    sealed = df.withColumn("record_sha256", integrity.seal(canonical_json(df, df.columns)))
    lines = sealed.select("record_sha256", canonical_json(sealed, sealed.columns).alias("line")).withColumn("ok", integrity.sealed_line_ok(F.col("line"))).collect()
    assert all(x.ok for x in lines)
    for x in lines:
        row = json.loads(x.line)
        assert row.pop("record_sha256") == hashlib.sha256(standard(row).encode()).hexdigest() == x.record_sha256


def test_no_canonical_form(spark):
    df = spark.sql("SELECT date'2024-01-01' AS d")
    with pytest.raises(Exception, match="no canonical JSON"):
        df.select(canonical_json(df, ["d"])).collect()


def test_stored_ids(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Hello there, you!"), (2, None), (3, ""), (4, "naïve <|endoftext|> x"), (5, "a " * 3000), (6, "short"), (7, "x y z"), (8, "same"), (8, "same")]
    coded = tokens.with_ids(spark.createDataFrame(rows, "id long, text string"), "text", path)
    ids = {r.id: r.ids for r in coded.collect()}
    stored = [(i, t, ids[i], "clash") for i, t in rows]
    stored[0] = (1, rows[0][1], ids[1][:-1], "")
    stored[2] = (3, "", None, "")
    stored[5] = (6, "short", [ids[6][0], 10**6], "")
    stored[6] = (7, "x y z", [ids[7][0], 5, *ids[7][2:]], "")
    frame = spark.createDataFrame(stored, "id long, text string, ids array<int>, t string")
    got = {r.id: (r.encodes, r.first_wrong, r.decodes) for r in tokens.verify_tokens(frame, "id", "text", "ids", path).collect()}
    good = (True, None, True)
    assert got == {1: (False, len(ids[1]) - 1, False), 2: good, 3: (False, 0, False), 4: good, 5: good, 6: (False, min(1, len(ids[6])), False), 7: (False, 1, False), 8: good}
    told = tokens.verify_tokens(frame.withColumn("raw", F.when(F.col("id") == 4, "other").otherwise(F.col("text"))), "id", "text", "ids", path, decoded="raw")
    assert {r.id for r in told.where("not decodes").collect()} == {1, 3, 4, 6, 7}
    assert tokens.verify_tokens(frame.limit(0), "id", "text", "ids", path).count() == 0


def prefix(records, expected):
    """(records, expected, prefix, place, cause) of one run, one place after the other."""
    last = max([*expected, *(p for p, *_ in records if p is not None)], default=-1)
    for at in range(last + 1):
        met = [r for r in records if r[0] == at]
        cause = "gap" if not met else "extra" if at not in expected else "repeated" if len(met) > 1 else "wrong_id" if met[0][1] != expected[at] else "broken_seal" if not met[0][2] else None
        if cause:
            return len(records), len(expected), at, at, cause
    return len(records), len(expected), len(expected), None, None


def test_valid_prefixes(spark):
    r = random.Random(9)
    records, expected = [], []
    for run in [*range(120), None]:
        n = r.randrange(1, 9)
        expected += [(run, i, 100 + i) for i in range(n)]
        for i in range(n + r.randrange(2)):
            if r.random() < 0.9:
                records += [(run, i, 100 + i + (r.random() < 0.05), r.choice([True] * 20 + [False, None]))] * (1 + (r.random() < 0.05))
    records.append((7, None, 1, True))
    got = runlog.valid_prefixes(spark.createDataFrame(records, "run long, at long, id long, ok boolean").repartition(4), spark.createDataFrame(expected, "run long, at long, id long"), "run", "at", "id", "ok").collect()
    assert len(got) == 121
    for x in got:
        want = prefix([t[1:] for t in records if t[0] == x.run], {p: i for q, p, i in expected if q == x.run})
        assert tuple(x)[1:] == want, x


def test_inputs_made_anew(spark):
    made = spark.createDataFrame([(1, "a", "h"), (2, "a", "h"), (3, None, "h"), (4, "b", "h"), (4, "b", "h")], "k long, c string, d string")
    audit = lambda rows: tuple(integrity.audit_inputs(spark.createDataFrame(rows, made.schema), made, ["k", "c"], "d").first())
    assert audit([tuple(r) for r in made.collect()]) == (5, 5, 0, 0, 0, True)
    assert audit([(1, "a", "x"), (3, None, None), (4, "b", "h"), (4, "b", "y"), (9, "a", "h")]) == (5, 5, 1, 1, 4, False)
    assert audit([(1, "a", "h"), (2, "a", "h"), (3, None, "h"), (4, "b", "h")]) == (4, 5, 0, 0, 1, False)
    assert audit([]) == (0, 5, 5, 0, 0, False)
