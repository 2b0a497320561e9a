"""Evaluation-shaped views of the provided tables, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.functions.dims import CONDITIONS, FAMILIES, FORMATS
from pairlight.functions.scoring import grammar_score, strict_score
from pairlight.operators.integrity import ids_json, rendered
from pairlight.session import table

#: The words that may be edited in ``documents``.
EDITABLE = ("the", "and", "that", "for", "was", "with")


def _nth(values: tuple[str, ...], n):
    return F.element_at(F.array(*(F.lit(v) for v in values)), n.cast("int"))


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a record: parts are questions, line numbers conditions."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber").between(1, len(CONDITIONS)))
    truncated = (F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.08)
    return li.select(
        F.col("l_partkey").alias("question_id"), _nth(FAMILIES, F.col("l_partkey") % 3 + 1).alias("family"), _nth(CONDITIONS, F.col("l_linenumber")).alias("condition"),
        (F.col("l_returnflag") == "A").alias("correct"), truncated.alias("truncated"),
        F.when(truncated, "truncated").when(F.col("l_returnflag") == "R", "invalid_format").otherwise("valid").alias("status"),
        F.col("l_quantity").cast("long").alias("tokens"), F.col("l_tax").alias("seconds"),
        F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_orderkey") % 5).cast("long").alias("changed_words"), F.when(F.col("l_linenumber") == 1, 0.0).otherwise((F.col("l_orderkey") % 5) / 5).alias("realized_rate"), (F.col("l_suppkey") % 50).alias("input_tokens"), F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_extendedprice"),
    )


ORDER = ("l_orderkey", "l_suppkey", "l_extendedprice", "tokens", "status", "seconds", "correct")


#: Order numbers of a range within which lines are numbered.
RANGE = 1 << 14


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a record: a part's k-th lines of each number make up its k-th question.

    Lines are numbered within ranges of orders, after the lines of the ranges before, so that no task
    holds all lines of a part.
    """
    raw = raw_runs(spark, sf_dir)
    key = ["question_id", "condition", "part"]
    lines = raw.withColumn("part", F.floor(F.col("l_orderkey") / RANGE))
    before = F.sum("c").over(W.partitionBy("question_id", "condition").orderBy(F.asc_nulls_last("part")).rowsBetween(W.unboundedPreceding, -1))
    counts = lines.groupBy(*key).agg(F.count("*").alias("c")).select(*(F.col(k).alias(f"_{k}") for k in key), F.coalesce(before, F.lit(0)).alias("before"))
    own = lines.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy(*ORDER)))
    numbered = own.join(counts, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    question = F.concat_ws("-", F.col("question_id").cast("string"), (F.col("before") + F.col("n")).cast("string"))
    return numbered.withColumn("question_id", question).select(raw.columns)


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RAW_RUNS = f"""raw_runs AS (SELECT l_partkey AS question_id, {_sql_list(FAMILIES)}[l_partkey % 3 + 1] AS family, {_sql_list(CONDITIONS)}[l_linenumber] AS condition,
  l_returnflag = 'A' AS correct, l_linestatus = 'F' AND l_discount > 0.08 AS truncated,
  CASE WHEN l_linestatus = 'F' AND l_discount > 0.08 THEN 'truncated' WHEN l_returnflag = 'R' THEN 'invalid_format' ELSE 'valid' END AS status,
  CAST(l_quantity AS BIGINT) AS tokens, l_tax AS seconds,
  CASE WHEN l_linenumber = 1 THEN 0 ELSE l_orderkey % 5 END AS changed_words, CASE WHEN l_linenumber = 1 THEN 0 ELSE (l_orderkey % 5) / 5 END AS realized_rate, l_suppkey % 50 AS input_tokens, l_orderkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_linenumber BETWEEN 1 AND {len(CONDITIONS)})"""
RUNS = f"""{RAW_RUNS},
runs AS (SELECT * REPLACE (concat_ws('-', question_id, row_number() OVER (PARTITION BY question_id, condition ORDER BY {', '.join(ORDER)})) AS question_id) FROM raw_runs)"""
PAIRED = f"""{RUNS},
pairs AS (SELECT * FROM (SELECT *, max(CASE WHEN condition = 'clean' THEN CAST(correct AS INT) END) OVER (PARTITION BY question_id) AS clean_correct,
  count(*) OVER (PARTITION BY question_id) AS n FROM runs) WHERE n = {len(CONDITIONS)})"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as free-text responses of eight shapes."""
    li = table(spark, sf_dir, "lineitem")
    answer = F.col("l_quantity").cast("long")
    text, less = answer.cast("string"), (answer - 1).cast("string")
    shapes = [text, F.concat(F.lit(" +"), text, F.lit("\t")), F.concat(F.lit("Answer: "), text, F.lit(".")), F.concat(F.lit("\nthe answer is  "), text), F.concat(less, F.lit("+1 = "), text, F.lit(".")), F.concat(less, F.lit(" + 1="), (answer + 1).cast("string")), F.concat(F.lit("between "), text, F.lit(" and "), (answer + 1).cast("string")), F.concat(text, F.lit(".5"))]
    completion = shapes[-1]
    for i, s in enumerate(shapes[:-1]):
        completion = F.when(F.col("l_orderkey") % 8 == i, s).otherwise(completion)
    return li.select(
        "l_orderkey", "l_linenumber", "l_suppkey", answer.alias("answer"), F.concat(less, F.lit(" + 1")).alias("expression"), completion.alias("completion"),
        _nth(FORMATS, F.col("l_linenumber") % 3 + 1).alias("format"), ((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.08)).alias("truncated"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir)
    return r.withColumns(grammar_score(F.col("completion"), F.col("expression"), F.col("answer"), F.col("format"), F.col("truncated")))


#: End of sequence, cap and vocabulary of the three versions' outputs.
VERSIONS = {1: (2, 64, None), 2: (2, 64, None), 3: (3, 32, 200)}


def outputs(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Every line as a whole output record of a version, with its prompt, token ids, hashes and scores; some are broken by their order's number."""
    eos, cap, top = VERSIONS[version]
    k = F.col("l_orderkey")
    r = responses(spark, sf_dir).withColumn("prompt", F.concat(F.lit("Calculate "), F.col("expression")))
    n = F.when(F.col("truncated"), cap).otherwise(k % 20 + 2).cast("int")
    wrong = F.when(k % 47 == 0, -5 if top is None else top).otherwise(1).cast("int")
    r = r.withColumns({
        "rendered_prompt": rendered(F.col("prompt")), "input_token_ids": F.array(wrong, F.col("answer").cast("int"), F.col("l_linenumber").cast("int")), "output_tokens": n,
        "output_token_ids": F.concat(F.array_repeat(F.lit(7), n - 1), F.array(F.when(F.col("truncated"), 7).otherwise(eos))),
        "ended_with_eos": F.col("truncated") == (k % 43 == 0), "elapsed_seconds": F.when(k % 31 == 0, -1.0).otherwise(k % 100 / 10),
    })
    score = strict_score(F.col("completion"), F.col("answer"), F.col("truncated")) if version == 1 else grammar_score(F.col("completion"), F.col("expression"), F.col("answer"), F.col("format"), F.col("truncated"))
    r = r.withColumns({
        "rendered_prompt_sha256": F.when(k % 41 == 0, "").otherwise(F.sha2("rendered_prompt", 256)), "input_token_sha256": F.sha2(ids_json(F.col("input_token_ids")), 256),
        "input_tokens": F.size("input_token_ids") + F.when(k % 37 == 0, 1).otherwise(0), **score,
    })
    return r.withColumn("correct", F.col("correct") != (k % 53 == 0))


_S = r"[ \t\n\r\f\x0B]"
_N = r"([+-]?[0-9]{1,9})"
RESPONSES = f"""base AS (SELECT *, CAST(l_quantity AS BIGINT) AS answer FROM lineitem),
responses AS (SELECT l_orderkey, l_linenumber, l_suppkey, answer, (answer - 1) || ' + 1' AS expression,
  CASE l_orderkey % 8 WHEN 0 THEN CAST(answer AS VARCHAR) WHEN 1 THEN ' +' || answer || chr(9) WHEN 2 THEN 'Answer: ' || answer || '.' WHEN 3 THEN chr(10) || 'the answer is  ' || answer
    WHEN 4 THEN (answer - 1) || '+1 = ' || answer || '.' WHEN 5 THEN (answer - 1) || ' + 1=' || (answer + 1) WHEN 6 THEN 'between ' || answer || ' and ' || (answer + 1) ELSE answer || '.5' END AS completion,
  {_sql_list(FORMATS)}[l_linenumber % 3 + 1] AS format, l_linestatus = 'F' AND l_discount > 0.08 AS truncated FROM base)"""
SCORED = f"""{RESPONSES},
stripped AS (SELECT *, regexp_replace(completion, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS t, (answer - 1) AS a FROM responses),
read AS (SELECT *, regexp_extract(t, '^{_N}$', 1) AS n1, regexp_extract(t, '(?i)^Answer:{_S}*{_N}\\.?$', 1) AS n2, regexp_extract(t, '(?i)^The answer is{_S}+{_N}\\.?$', 1) AS n3,
  regexp_extract(t, '^([0-9]+){_S}*\\+{_S}*1{_S}*={_S}*{_N}\\.?$', 1) AS lhs, regexp_extract(t, '^([0-9]+){_S}*\\+{_S}*1{_S}*={_S}*{_N}\\.?$', 2) AS rhs FROM stripped),
kinds AS (SELECT *, CASE WHEN n1 <> '' THEN 'integer' WHEN n2 <> '' THEN 'label' WHEN n3 <> '' THEN 'sentence' WHEN lhs = CAST(a AS VARCHAR) AND rhs <> '' THEN 'equation' ELSE 'unsupported' END AS extraction_kind FROM read),
parsed AS (SELECT *, TRY_CAST(CASE extraction_kind WHEN 'integer' THEN n1 WHEN 'label' THEN n2 WHEN 'sentence' THEN n3 WHEN 'equation' THEN rhs END AS BIGINT) AS candidate_answer FROM kinds),
scored AS (SELECT *, candidate_answer IS NOT NULL AND NOT truncated AS extracted, CASE WHEN NOT truncated THEN candidate_answer END AS parsed_answer,
  candidate_answer IS NOT NULL AND NOT truncated AND extraction_kind = format AS strict_compliant,
  candidate_answer IS NOT NULL AND NOT truncated AND candidate_answer = answer AS correct,
  candidate_answer IS NOT NULL AND NOT truncated AND extraction_kind = format AND candidate_answer = answer AS strict_correct,
  CASE WHEN truncated THEN 'truncated' WHEN candidate_answer IS NOT NULL THEN 'unambiguous'
    WHEN len(list_filter(regexp_extract_all(t, '[A-Za-z0-9_.]+'), lambda x: regexp_full_match(x, '[0-9]+'))) > 1 THEN 'potentially_ambiguous' ELSE 'unsupported_format' END AS diagnostic FROM parsed)"""
