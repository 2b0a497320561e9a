"""Response grammars as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() knows it.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SPACE = r"[ \t\n\r\f\x0B]"
_NUMBER = r"([+-]?[0-9]{1,9})"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_BLANK}|{_BLANK}\z", "")


def strict_score(text: Column, answer: Column, truncated: Column) -> dict[str, Column]:
    """The whole response is an integer of fewer than 100 characters; its value is kept even when truncated.

    ``parsed_answer`` is a long, null beyond 64 bits; ``parsed_digits`` has the value as plain digits whatever its length.
    """
    t = strip(text)
    whole = t.rlike(r"\A[+-]?[0-9]+\z") & (F.length(t) < 100)
    parsed = F.when(whole, t.try_cast("long"))
    digits = F.regexp_replace(t, "^[+-]?0*", "")
    plain = F.when(digits == "", "0").otherwise(F.concat(F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit("")), digits))
    status = F.when(truncated, "truncated").when(whole, "valid").otherwise("invalid_format")
    return {"parsed_answer": parsed, "parsed_digits": F.when(whole, plain), "status": status, "correct": F.coalesce((status == "valid") & (parsed == answer), F.lit(False))}


#: All grammars at once, with the equation of any two numbers; no text satisfies two of them.
_ANY = rf"(?i)\A(?:{_NUMBER}|Answer:{_SPACE}*{_NUMBER}\.?|The answer is{_SPACE}+{_NUMBER}\.?|([0-9]+){_SPACE}*([+*-]){_SPACE}*([0-9]+){_SPACE}*={_SPACE}*{_NUMBER}\.?)\z"


def _equation(expression: Column) -> Column:
    """The pattern of an expression's own equation, whatever its parts are."""
    a, op, b = (F.split(expression, " ")[i] for i in range(3))
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    gap = F.lit(f"{_SPACE}*")
    return F.concat(F.lit(r"(?i)\A"), quoted(a), gap, quoted(op), gap, quoted(b), gap, F.lit("="), gap, F.lit(rf"{_NUMBER}\.?\z"))


def _read(t: Column, expression: Column) -> tuple[Column, Column]:
    """The kind and the candidate answer of a stripped text.

    One fixed pattern reads all grammars; a text that it fits becomes its parts behind a tab, with which no stripped text
    begins. Only equations of other expressions than two numbers take a pattern of their own, which each row compiles.
    """
    found = F.regexp_replace(t, _ANY, "\t$1,$2,$3,$4 $5 $6,$7")
    parts = F.when(found.startswith("\t"), F.split(F.substring(found, 2, 1 << 30), ","))
    at = lambda i: F.get(parts, F.lit(i))
    usual = expression.rlike(r"\A[0-9]+ [+*-] [0-9]+\z")
    own = _equation(expression)
    hits = [("integer", at(0) != "", at(0)), ("label", at(1) != "", at(1)), ("sentence", at(2) != "", at(2))]
    hits.append(("equation", F.when(usual, at(3) == expression).otherwise(F.rlike(t, own)), F.when(usual, at(4)).otherwise(F.call_function("regexp_extract", t, own, F.lit(1)))))
    kind, digits = F.lit("unsupported"), F.lit(None).cast("string")
    for name, hit, value in reversed(hits):
        kind, digits = F.when(hit, name).otherwise(kind), F.when(hit, value).otherwise(digits)
    return kind, digits.try_cast("long")


def standalone_integers(text: Column) -> Column:
    """How many integers stand by themselves: maximal runs of word characters and dots that are all digits."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(r"[\w.]+"), F.lit(0)), lambda r: r.rlike(r"\A[0-9]+\z")))


def grammar_score(text: Column, expression: Column, answer: Column, form: Column, truncated: Column) -> dict[str, Column]:
    """The first grammar that the whole response satisfies; the expected answer plays no part in reading it."""
    t = strip(text)
    kind, candidate = _read(t, expression)
    extracted = candidate.isNotNull() & ~truncated
    right = F.coalesce(candidate == answer, F.lit(False))
    strict = extracted & (kind == form)
    diagnostic = F.when(truncated, "truncated").when(extracted, "unambiguous").when(standalone_integers(t) > 1, "potentially_ambiguous").otherwise("unsupported_format")
    return {
        "candidate_answer": candidate, "parsed_answer": F.when(extracted, candidate), "extraction_kind": kind, "extracted": extracted,
        "strict_compliant": strict, "correct": extracted & right, "strict_correct": strict & right, "diagnostic": diagnostic,
    }


def render_chat(messages: Column) -> Column:
    """array<struct<role, text>> -> the chat template with the assistant's header."""
    lines = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(lines, ""), F.lit("<|im_start|>assistant\n"))
