import re

import pytest
from pyspark.sql import functions as F

from pairlight.functions.scoring import grammar_score, strict_score
from pairlight.operators.integrity import violations

STRICT = [("42", 42, "valid"), (" 42\n", 42, "valid"), ("+42", 42, "valid"), ("-42", -42, "valid"), ("0042", 42, "valid"), ("42.", None, "invalid_format"), ("4 2", None, "invalid_format"), ("", None, "invalid_format"), ("\x0042", None, "invalid_format"), ("　42 ", 42, "valid"), ("forty", None, "invalid_format"), ("9" * 99, None, "valid"), ("9" * 100, None, "invalid_format")]


def test_strict(spark):
    df = spark.createDataFrame([(t, i) for i, (t, _, _) in enumerate(STRICT)], "t string, i int")
    rows = {r.i: r for r in df.select("i", *(c.alias(n) for n, c in strict_score(F.col("t"), F.lit(42).cast("long"), F.lit(False)).items())).collect()}
    for i, (_, parsed, status) in enumerate(STRICT):
        assert (rows[i].parsed_answer, rows[i].status, rows[i].correct) == (parsed, status, status == "valid" and parsed == 42)


def test_truncated_keeps_the_strict_value(spark):
    row = spark.range(1).select(*(c.alias(n) for n, c in strict_score(F.lit("42"), F.lit(42).cast("long"), F.lit(True)).items())).first()
    assert (row.parsed_answer, row.status, row.correct) == (42, "truncated", False)


def by_hand(text, expression, answer, form, truncated):
    """A second reader, without the grammars' regular expressions."""
    t = text.strip()

    def number(x):
        body = x[1:] if x[:1] in "+-" and x else x
        return int(x) if body.isascii() and body.isdigit() and len(body) <= 9 else None

    def dotless(x):
        return x[:-1] if x.endswith(".") else x

    kind, value = "unsupported", number(t)
    blank = " \t\n\r\f\v"
    if value is not None:
        kind = "integer"
    elif t.lower().startswith("answer:") and (v := number(dotless(t[7:]).lstrip(blank))) is not None:
        kind, value = "label", v
    elif t.lower().startswith("the answer is") and t[13:14] in blank and (v := number(dotless(t[13:]).lstrip(blank))) is not None:
        kind, value = "sentence", v
    elif t.count("=") == 1:
        left, right = t.split("=")
        a, op, b = expression.split()
        parts = left.partition(op)
        if parts[1] and parts[0].rstrip(blank) == a and parts[2].strip(blank) == b and (v := number(dotless(right).lstrip(blank))) is not None:
            kind, value = "equation", v
    extracted = value is not None and not truncated
    loose = sum(bool(re.fullmatch("[0-9]+", r)) for r in re.findall(r"[A-Za-z0-9_.]+", t))
    diagnostic = "truncated" if truncated else "unambiguous" if extracted else "potentially_ambiguous" if loose > 1 else "unsupported_format"
    return kind, value, extracted, extracted and kind == form, extracted and value == answer, diagnostic


TEXTS = ["13", "+13", "-13", " 13\t", "13.", "Answer: 13", "answer:13.", "ANSWER:\n 13", "Answer 13", "The answer is 13.", "the answer is13", "The answer is  12", "4 + 9 = 13", "4+9=13.", "9 + 4 = 13", "4 + 9 = 14", "4 - 9 = 13", "13 or 14", "thirteen", "", "1234567890", "123456789", "13 13", "Answer: 13 14", "\x0b13\x0b", "3.5", "x13", "the anſwer is 13", "1 2 3", "4 + 9 = 13 = 13"]


@pytest.mark.parametrize("truncated", [False, True])
def test_grammar_against_a_second_reader(spark, truncated):
    df = spark.createDataFrame([(t, i) for i, t in enumerate(TEXTS)], "t string, i int")
    out = grammar_score(F.col("t"), F.lit("4 + 9"), F.lit(13).cast("long"), F.lit("label"), F.lit(truncated))
    for r in df.withColumns(out).collect():
        want = by_hand(TEXTS[r.i], "4 + 9", 13, "label", truncated)
        assert (r.extraction_kind, r.candidate_answer, r.extracted, r.strict_compliant, r.correct, r.diagnostic) == want, TEXTS[r.i]


def test_grammars_of_any_expression(spark):
    """The one pattern for all grammars against a pattern for each, on usual and odd expressions."""
    numbers = ["13", "+13", "-13", "0000000013", "1234567890", "", "1 3"]
    lefts = ["4 + 9", "4+9", "04 + 9", "4 + 09", "-3 + 1", "-3+1", "4 ** 2", "(a) + b", "(A)\t+ B", "4 - 9", "4 + 9 + 1"]
    texts = [f for n in numbers for f in (n, f"answer:\t{n}.", f"Answer:{n}..", f"the answer is {n}", f"The answer is{n}.", *(f"{x}{gap}={gap}{n}." for x in lefts for gap in ("", " ", "\n")))] + [",,,  ,", "\t1,2,3,4 + 9,5", "a,13", None]
    expressions = ["4 + 9", "04 + 9", "-3 + 1", "4 ** 2", "(a) + b", "4 + 9 + 1", None]
    df = spark.createDataFrame([(t, e) for t in texts for e in expressions], "t string, e string")
    got = grammar_score(F.col("t"), F.col("e"), F.lit(13).cast("long"), F.lit("label"), F.lit(False))
    space, number = r"[ \t\n\r\f\x0b]", r"([+-]?[0-9]{1,9})"
    for r in df.select("t", "e", *(got[c].alias(c) for c in ("candidate_answer", "extraction_kind"))).collect():
        tries = [("integer", number), ("label", rf"Answer:{space}*{number}\.?"), ("sentence", rf"The answer is{space}+{number}\.?")]
        if r.e is not None:
            tries.append(("equation", f"{space}*".join([*map(re.escape, r.e.split(" ")[:3]), "=", rf"{number}\.?"])))
        hits = [(kind, int(m[1])) for kind, p in tries if r.t is not None and (m := re.fullmatch(p, r.t.strip(), re.I | re.A))]
        assert (r.extraction_kind, r.candidate_answer) == (hits[0] if hits else ("unsupported", None)), r


def test_grammars_share_one_reading(spark):
    """Rules over a whole score run outside higher-order functions, which would interpret them and read a text anew for each."""
    text = "".join(violations({"a": F.col("id") > 1, "b": F.col("id") > 2})._jc.toString())
    assert "array_except" in text
    assert [r.v for r in spark.range(4).select(violations({"a": F.col("id") > 1, "b": F.col("id") > 2, "c": F.lit(None).cast("boolean")}).alias("v")).collect()] == [["a", "b", "c"], ["a", "b", "c"], ["b", "c"], ["c"]]
    assert [r.v for r in spark.range(2).select(violations({}).alias("v")).collect()] == [[], []]
    kinds = spark.range(1).select(*(c.alias(n) for n, c in grammar_score(F.lit("4 + 9 = 13"), F.lit("4 + 9"), F.lit(13).cast("long"), F.lit("equation"), F.lit(False)).items())).first()
    assert kinds.strict_correct and kinds.candidate_answer == 13
