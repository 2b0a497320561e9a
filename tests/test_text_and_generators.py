import hashlib
import json
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlight.functions import textops
from pairlight.functions.dims import CONDITIONS, FAMILIES, KINDS
from pairlight.operators import generate

TEXTS = [(1, "Please carefully do the following simple sum below, PLEASE."), (2, "no words here"), (3, ""), (4, "below below aa"), (5, None), (6, "Simple: é please-carefully; 12 below")]


def test_edits_are_legal_and_nested(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    for kind in KINDS:
        low = {r.id: r for r in textops.perturb(df, "id", "text", kind, 0.2).collect()}
        high = {r.id: r for r in textops.perturb(df, "id", "text", kind, 0.4).collect()}
        for i, text in TEXTS:
            text = text or ""
            assert set(low[i].edits) <= set(high[i].edits)
            out = text
            for e in sorted(high[i].edits, key=lambda e: -e.start):
                assert text[e.start : e.end] == e.before and text[e.word_start : e.word_end] == e.original_word
                out = out[: e.start] + e.after + out[e.end :]
            assert out == high[i].altered
    assert high[2].altered == "no words here"


def test_overlapping_edits_fail(spark):
    e = "array(named_struct('start',0,'end',2,'before','ab','after','x'), named_struct('start',1,'end',3,'before','bc','after','y'))"
    with pytest.raises(Exception, match="overlapping"):
        spark.range(1).select(textops.apply_edits(F.lit("abc"), F.expr(e))).collect()


def test_splicing_long_texts(spark):
    """Splicing is linear: a text of 120,000 words with 96,000 edits took minutes when each edit copied the text."""
    df = spark.createDataFrame([(1, "the cat " * 60_000), (2, "é the"), (3, "")], "id long, text string")
    made = textops.perturb(df, "id", "text", "delete", 0.8, ("the", "cat")).localCheckpoint()
    began = time.perf_counter()
    rows = made.select("altered", textops.apply_edits(F.col("text"), F.col("edits")).alias("again"), F.size("edits").alias("n")).collect()
    assert time.perf_counter() - began < 15
    assert all(r.altered == r.again for r in rows) and max(r.n for r in rows) == 96_000


def test_nested_check(spark):
    df = spark.createDataFrame([(1, "the cat and the dog for that was with the end " * 50), (2, None), (None, "the end")], "id long, text string")
    rows = textops.nested_check(df, "id", "text", 0.2, 0.4, editable=("the", "and", "for")).collect()
    assert sorted(map(tuple, rows)) == [(k, 3, 0, 0) for k in sorted(KINDS)]
    # Levels the wrong way round aren't nested; edits that don't fit are refused.
    assert all(r.not_nested > 0 for r in textops.nested_check(df, "id", "text", 0.8, 0.2, editable=("the", "and", "for")).collect())
    for bad in ([(0, 1, "x", "")], [(0, 2, "ab", ""), (1, 3, "bc", "")]):
        with pytest.raises(ValueError, match="overlapping or invalid"):
            list(textops._spliced(["abc"], *zip(*bad, strict=True), [0, len(bad)]))


def test_slices_are_small():
    """What a worker holds beside its batch: the tables of one slice, some 25 bytes a byte of text."""
    texts = pa.array(["word " * 2000] * 400 + [None, "", "x" * 3_000_000])
    batch = pa.RecordBatch.from_arrays([texts], names=["__text"])
    parts = list(textops._slices(iter([batch]), "__text"))
    assert pa.Table.from_batches(parts).column(0).combine_chunks() == texts
    assert all(p.num_rows == 1 or p.num_rows <= 500 and sum(len(t or "") for t in p.column(0).to_pylist()) <= 1 << 18 for p in parts)


def test_question_sets(spark):
    first, second = generate.first_questions(spark).collect(), generate.reserved_questions(spark).collect()
    assert len(first) == 240 and len(second) == 252
    assert all(r.answer == r.oracle_answer for r in first + second)
    ids = lambda rows: {(r.family, tuple(sorted(r.operands))) for r in rows}
    assert len(ids(first)) == 240 and not ids(first) & ids(second)


def test_word_offsets(spark):
    df = spark.createDataFrame([(1, "ab  c, dé")], "id long, text string")
    assert sorted((r.start, r.end, r.word) for r in textops.word_offsets(df, "text").collect()) == [(0, 2, "ab"), (4, 5, "c"), (7, 8, "d")]


def lines_hash(rows):
    lines = "".join(json.dumps(r, sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n" for r in rows)
    return hashlib.sha256(lines.encode()).hexdigest()


def test_exact_questions_keep_their_frozen_hash(spark):
    """The file hash of the first development set is a published constant."""
    rows = [r.asDict() for r in generate.exact_questions(spark, "dev").collect()]
    order = {f: i for i, f in enumerate(FAMILIES)}
    rows.sort(key=lambda r: (order[r["family"]], r["question_id"]))
    assert lines_hash(rows) == "c70c981942c7afdb20ed2f3a9be08be1629cae589970f5deac8e30aa0c05e753"


#: The published hashes of all first-version cases, by split.
FROZEN = {"dev": "92ae5f161b3812dfea5d7ac672c45eae9b9c990c4a0c50f9bf7657a1785c3b6b", "eval": "9bb94cdfd0f19acd4d142312f58d1f26acba04c1cbacbb65fe309dc14fc4470b"}


def test_exact_cases_keep_their_frozen_hashes(spark):
    for split, want in FROZEN.items():
        cases = generate.case_table(generate.exact_questions(spark, split), exact=True).orderBy("ordinal")
        rows = [r.asDict(recursive=True) for r in cases.drop("ordinal", "split", "operands", "expression", "oracle_answer").collect()]
        assert [r["case_id"].rsplit(":")[1] for r in rows[:7]] == list(CONDITIONS)
        assert lines_hash(rows) == want


def test_formatted_cases(spark):
    qs = generate.reserved_questions(spark)
    pilot = generate.case_table(qs, "dev").orderBy("ordinal").collect()
    assert [r.ordinal for r in pilot] == list(range(126)) and {r.condition for r in pilot} == {"clean"}
    run = generate.case_table(qs, "eval", "label").orderBy("ordinal").collect()
    assert [r.ordinal for r in run] == list(range(70 * 3 * 7)) and {r.format for r in run} == {"label"}
    assert len({r.case_id for r in run}) == len(run) and all(r.unchanged == (r.prompt_sha256 == r.clean_prompt_sha256) for r in run)
    with pytest.raises(ValueError, match="selected format"):
        generate.case_table(qs, "eval")
