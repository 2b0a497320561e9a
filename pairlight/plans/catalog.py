"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.functions import counts, textops
from pairlight.functions.dims import BOOTSTRAP_SEED, CONDITIONS, DATA_SEED, FAMILIES, FORMATS, KEYBOARD, KINDS, PREFIX, PROMPT, RESERVED_SEED, SUFFIXES, TYPO_SEED, Z95
from pairlight.functions.dims import EDITABLE as PROMPT_WORDS
from pairlight.functions.scoring import render_chat, strict_score
from pairlight.operators import gate, generate, integrity, paired, provenance, tokens
from pairlight.plans import views
from pairlight.plans.views import EDITABLE, PAIRED, RAW_RUNS, RESPONSES, RUNS, SCORED
from pairlight.session import fresh_dir, stored, table
from pairlight.sources.shared import tree_files
from pairlight.streaming import runlog, runstate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
REPLICATES = 10_000


def register(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _draw(*keys: str) -> str:
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(keys) + "), 1, 8) AS BIGINT)"


FAMILY_SQL = "(VALUES " + ", ".join(f"('{f}')" for f in FAMILIES) + ") f(family)"
SPACE = f"space AS (SELECT family, a, b FROM {FAMILY_SQL}, range(21) x(a), range(21) y(b) WHERE a <= b)"


def _split_sql(source: str, name: str, seed: int, dev: int, both: int) -> str:
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_draw(f"'{seed}'", 'family', 'a', 'b')}, a, b) - 1 AS n FROM {source}),
{name} AS (SELECT family, a, b, CASE WHEN n < {dev} THEN 'dev' ELSE 'eval' END AS split, CASE WHEN n < {dev} THEN n ELSE n - {dev} END AS position FROM {name}_n WHERE n < {both})"""


FIRST = f"{SPACE}, {_split_sql('space', 'first', DATA_SEED, 10, 80)}"
RESERVED = f"{FIRST}, unused AS (SELECT * FROM space ANTI JOIN first USING (family, a, b)), {_split_sql('unused', 'reserved', RESERVED_SEED, 14, 84)}"
_VALUE = "CASE family WHEN 'addition' THEN a + b WHEN 'subtraction' THEN b - a ELSE a * b END"
_EXPR = "CASE family WHEN 'addition' THEN a || ' + ' || b WHEN 'subtraction' THEN b || ' - ' || a ELSE a || ' * ' || b END"
_HEAD, _TAIL = (p.replace("\n", "' || chr(10) || '") for p in PROMPT.split("{expression}"))


# Generators.


@register(f"WITH {SPACE} SELECT * FROM space")
def pair_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.pair_space(spark)


@register(f"WITH {FIRST} SELECT * FROM first")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.assign_splits(generate.pair_space(spark), DATA_SEED, 10, 70)


@register(f"SELECT family, a, b, CASE family WHEN 'addition' THEN a + b WHEN 'subtraction' THEN greatest(a - b, 0) ELSE a * b END AS counted FROM {FAMILY_SQL}, range(21) x(a), range(21) y(b)")
def counting_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = generate.pair_space(spark)
    both = space.unionByName(space.where("a < b").select("family", F.col("b").alias("a"), F.col("a").alias("b")))
    return both.withColumn("counted", generate.counting_oracle(F.col("family"), F.col("a"), F.col("b")))


@register(f"WITH {FIRST} SELECT split || '-' || family || '-' || lpad(CAST(position AS VARCHAR), 3, '0') AS question_id, {_EXPR} AS expression, {_VALUE} AS answer, {_VALUE} AS oracle_answer, sha256('{_HEAD}' || {_EXPR} || '{_TAIL}') AS prompt_sha256 FROM first")
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.first_questions(spark).select("question_id", "expression", "answer", "oracle_answer", "prompt_sha256")


@register(f"WITH {RESERVED} SELECT 'v2-' || split || '-' || family || '-' || lpad(CAST(position AS VARCHAR), 3, '0') AS question_id, {_EXPR} AS expression, {_VALUE} AS answer FROM reserved")
def reserved_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.reserved_questions(spark).select("question_id", "expression", "answer")


@register(f"WITH {RESERVED} SELECT (SELECT count(*) FROM first) AS first_rows, (SELECT count(*) FROM reserved) AS reserved_rows, (SELECT count(*) FROM first JOIN reserved USING (family, a, b)) AS shared")
def set_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda d: d.select("family", F.array_sort("operands").alias("o"))
    a, b = key(generate.first_questions(spark)), key(generate.reserved_questions(spark))
    return a.agg(F.count("*").alias("first_rows")).crossJoin(b.agg(F.count("*").alias("reserved_rows"))).crossJoin(a.intersect(b).agg(F.count("*").alias("shared")))


# Text and perturbation, over whole documents.

_WORDS = f"({', '.join(repr(w) for w in EDITABLE)})"
_RUNS_SQL = "r AS (SELECT doc_id, unnest(x) AS w, unnest(range(0, len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]+') AS x FROM documents))"


@register(f"WITH {_RUNS_SQL}, o AS (SELECT *, coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r) SELECT doc_id, count(*) AS words, CAST(sum(length(w)) AS BIGINT) AS letters, CAST(sum(start) AS BIGINT) AS starts FROM o WHERE regexp_matches(w, '^[A-Za-z]') GROUP BY doc_id UNION ALL SELECT doc_id, 0, 0, 0 FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[A-Za-z]')")
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = textops.offset_sums(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return sums.select("doc_id", "words", "letters", "starts")


@register(f"WITH {_RUNS_SQL} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(w, '^[A-Za-z]')) AS total_words, count(*) FILTER (WHERE lower(w) IN {_WORDS}) AS eligible_words FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id")
def eligible_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = textops.offset_sums(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", EDITABLE)
    return sums.select("doc_id", F.col("words").alias("total_words"), F.col("chosen").alias("eligible_words"))


def _edits_sql(kind: str, level: float) -> str:
    key = [f"'{TYPO_SEED}'", "doc_id", f"'{kind}'", "i"]
    pick = _draw(*key, "'at'")
    if kind == "transpose":
        at = f"CASE WHEN len(places) > 0 THEN places[{pick} % len(places) + 1] - 1 ELSE -1 END"
        places, width, after = "list_filter(range(1, length(w)), lambda j: substr(w, CAST(j AS INT), 1) <> substr(w, CAST(j + 1 AS INT), 1))", 2, "reverse(before)"
    else:
        at, places, width = f"{pick} % length(w)", "[1]", 1
        near = "CASE lower(before) " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in KEYBOARD.items()) + " END"
        letter = f"substr({near}, CAST({_draw(*key, repr('key'))} % length({near}) + 1 AS INT), 1)"
        after = "''" if kind == "delete" else f"CASE WHEN before = upper(before) THEN upper({letter}) ELSE {letter} END"
    return f"""{_RUNS_SQL},
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_draw(*key)}, i) AS rk, count(*) OVER (PARTITION BY doc_id) AS n FROM r WHERE lower(w) IN {_WORDS}),
p AS (SELECT *, {places} AS places FROM e WHERE rk <= ceil(CAST({level} AS DOUBLE) * n)),
q AS (SELECT *, {at} AS spot FROM p),
b AS (SELECT *, substr(w, CAST(spot + 1 AS INT), {width}) AS before FROM q WHERE spot >= 0),
x AS (SELECT doc_id, i, before, substr(w, 1, CAST(spot AS INT)) || {after} || substr(w, CAST(spot + {width} + 1 AS INT)) AS new FROM b),
z AS (SELECT doc_id, sha256(coalesce(string_agg(coalesce(new, w), '' ORDER BY i), '')) AS altered_sha256, count(new) AS changed_words, CAST(coalesce(sum(length(before)), 0) AS BIGINT) AS touched,
  count(*) FILTER (WHERE lower(w) IN {_WORDS}) AS eligible_words, count(*) FILTER (WHERE regexp_matches(w, '^[A-Za-z]')) AS total_words FROM (SELECT doc_id FROM documents) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id, i) GROUP BY doc_id)"""


def _perturbed(spark: SparkSession, sf_dir: str, kind: str, level: float) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return textops.perturb(docs, "doc_id", "text", kind, level, EDITABLE)


def _perturb_query(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _perturbed(spark, sf_dir, kind, 0.4).select("doc_id", F.sha2("altered", 256).alias("altered_sha256"), F.size("edits").cast("long").alias("changed_words"))

    query.__name__ = f"perturb_{kind}"
    register(f"WITH {_edits_sql(kind, 0.4)} SELECT doc_id, altered_sha256, changed_words FROM z")(query)


for _kind in KINDS:
    _perturb_query(_kind)


@register(f"WITH {_edits_sql('transpose', 0.2)} SELECT doc_id, changed_words, touched AS touched_original_characters, round(CASE WHEN eligible_words > 0 THEN changed_words / eligible_words ELSE 0 END, 9) AS realized_eligible_word_rate, round(CASE WHEN total_words > 0 THEN changed_words / total_words ELSE 0 END, 9) AS realized_all_word_rate, changed_words = 0 AS unchanged, CASE WHEN changed_words > 0 THEN 'unreviewed_optional_word_edits' ELSE 'unchanged' END AS semantic_review FROM z")
def edit_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _perturbed(spark, sf_dir, "transpose", 0.2).withColumns(textops.measures("text", 0.2))
    return m.select("doc_id", "changed_words", "touched_original_characters", F.round("realized_eligible_word_rate", 9).alias("realized_eligible_word_rate"), F.round("realized_all_word_rate", 9).alias("realized_all_word_rate"), "unchanged", "semantic_review")


@register("SELECT kind, count(*) AS documents, CAST(0 AS BIGINT) AS not_nested, CAST(0 AS BIGINT) AS not_spliced FROM documents, (VALUES ('transpose'), ('delete'), ('keyboard')) k(kind) GROUP BY kind")
def nested_edits_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of the lower level are among those of the higher, and splicing the edits gives the altered text."""
    return textops.nested_check(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 0.2, 0.4, KINDS, EDITABLE)


@register("SELECT doc_id || ':' || condition AS case_id, doc_id, condition, n AS condition_no FROM documents, (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(CONDITIONS)) + ") c(condition, n)")
def case_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.expand_cases(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("case_id", "doc_id", "condition", "condition_no")


@register("SELECT conv_id, sha256(string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) || '<|im_start|>assistant' || chr(10)) AS rendered_sha256 FROM conversations GROUP BY conv_id")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {c: F.coalesce(c, F.lit("")) for c in ("role", "text")}  # a turn without a role or text is still a turn
    turns = table(spark, sf_dir, "conversations").withColumns(known).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return turns.select("conv_id", F.sha2(render_chat(F.col("m")), 256).alias("rendered_sha256"))


# Case tables: every question under its conditions, altered.

_DRAWN = [f"'{TYPO_SEED}'", "question_id", "kind", "i"]
_NEAR = "CASE lower(before) " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in KEYBOARD.items()) + " END"
_PROMPT_WORDS = f"({', '.join(repr(w) for w in PROMPT_WORDS)})"
_LEVEL = "CASE WHEN condition LIKE '%-20' THEN CAST(0.2 AS DOUBLE) WHEN condition LIKE '%-40' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
_CASE_COLUMNS = ("case_id", "ordinal", "prompt_sha256", "clean_prompt_sha256", "total_words", "eligible_words", "changed_words", "touched_original_characters", "target_eligible_word_rate", "realized_eligible_word_rate", "realized_all_word_rate", "unchanged", "possible_meaning_change", "semantic_review")


def _case_sql(base: str) -> str:
    """The twin of a case table; ``base`` is SQL for (case_id, question_id, condition, ordinal, prompt)."""
    pick = _draw(*_DRAWN, "'at'")
    letter = f"substr({_NEAR}, CAST({_draw(*_DRAWN, repr('key'))} % length({_NEAR}) + 1 AS INT), 1)"
    return f"""cs AS (SELECT *, split_part(condition, '-', 1) AS kind, {_LEVEL} AS level FROM ({base})),
cr AS (SELECT case_id, question_id, kind, level, unnest(x) AS w, unnest(range(0, len(x))) AS i FROM (SELECT *, regexp_extract_all(prompt, '[A-Za-z]+|[^A-Za-z]+') AS x FROM cs)),
ce AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {_draw(*_DRAWN)}, i) AS rk, count(*) OVER (PARTITION BY case_id) AS n FROM cr WHERE lower(w) IN {_PROMPT_WORDS}),
cp AS (SELECT *, list_filter(range(1, length(w)), lambda j: substr(w, CAST(j AS INT), 1) <> substr(w, CAST(j + 1 AS INT), 1)) AS places FROM ce WHERE rk <= ceil(level * n)),
cq AS (SELECT *, CASE WHEN kind <> 'transpose' THEN {pick} % length(w) WHEN len(places) > 0 THEN places[{pick} % len(places) + 1] - 1 ELSE -1 END AS spot, CASE WHEN kind = 'transpose' THEN 2 ELSE 1 END AS width FROM cp),
cb AS (SELECT *, substr(w, CAST(spot + 1 AS INT), width) AS before FROM cq WHERE spot >= 0),
cx AS (SELECT case_id, i, before, substr(w, 1, CAST(spot AS INT)) || CASE kind WHEN 'transpose' THEN reverse(before) WHEN 'delete' THEN '' ELSE CASE WHEN before = upper(before) THEN upper({letter}) ELSE {letter} END END || substr(w, CAST(spot + width + 1 AS INT)) AS new FROM cb),
cz AS (SELECT case_id, string_agg(coalesce(new, w), '' ORDER BY i) AS altered, count(new) AS changed_words, CAST(coalesce(sum(length(before)), 0) AS BIGINT) AS touched_original_characters, count(*) FILTER (WHERE lower(w) IN {_PROMPT_WORDS}) AS eligible_words, count(*) FILTER (WHERE regexp_matches(w, '^[A-Za-z]')) AS total_words FROM cr LEFT JOIN cx USING (case_id, i) GROUP BY case_id)
SELECT case_id, CAST(ordinal AS BIGINT) AS ordinal, sha256(altered) AS prompt_sha256, sha256(prompt) AS clean_prompt_sha256, total_words, eligible_words, changed_words, touched_original_characters, level AS target_eligible_word_rate,
  CASE WHEN eligible_words > 0 THEN changed_words / eligible_words ELSE 0 END AS realized_eligible_word_rate, CASE WHEN total_words > 0 THEN changed_words / total_words ELSE 0 END AS realized_all_word_rate,
  altered = prompt AS unchanged, changed_words > 0 AS possible_meaning_change, CASE WHEN changed_words > 0 THEN 'unreviewed_optional_word_edits' ELSE 'unchanged' END AS semantic_review FROM cs JOIN cz USING (case_id)"""


_FAMILY_NO = f"list_position({views._sql_list(FAMILIES)}, family) - 1"
_CONDITION_SQL = "(VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(CONDITIONS)) + ") c(condition, inner_no)"
_FORMAT_HEAD, _ = PREFIX.split("{expression}")
_SUFFIX = "CASE format " + " ".join(f"WHEN '{f}' THEN '{t}'" for f, t in SUFFIXES.items()) + " END"
_FIRST_CASES = f"SELECT split || '-' || family || '-' || lpad(CAST(position AS VARCHAR), 3, '0') AS question_id, question_id || ':' || condition AS case_id, condition, ({_FAMILY_NO}) * CASE WHEN split = 'dev' THEN 70 ELSE 490 END + position * 7 + inner_no AS ordinal, '{_HEAD}' || {_EXPR} || '{_TAIL}' AS prompt FROM first, {_CONDITION_SQL}"


def _formatted_sql(split: str, forms: tuple[str, ...], each: int, inner: str, size: int, where: str = "true") -> str:
    asked = f"'v2-{split}-' || family || '-' || lpad(CAST(position AS VARCHAR), 3, '0')"
    return f"SELECT {asked} AS question_id, {asked} || ':' || condition || ':' || format AS case_id, condition, (({_FAMILY_NO}) * {size} + position) * {each} + {inner} AS ordinal, '{_FORMAT_HEAD}' || {_EXPR} || chr(10) || {_SUFFIX} AS prompt FROM reserved, {_CONDITION_SQL}, (VALUES {', '.join(f'({f!r}, {i})' for i, f in enumerate(forms))}) f(format, format_no) WHERE split = '{split}' AND {where}"


@register(f"WITH {FIRST}, {_case_sql(_FIRST_CASES)}")
def cases_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version's cases, both splits."""
    return generate.case_table(generate.first_questions(spark)).select(*_CASE_COLUMNS)


@register(f"WITH {RESERVED}, {_case_sql(_formatted_sql('dev', FORMATS, 3, 'format_no', 14, repr('clean') + ' = condition'))}")
def cases_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version's pilot: unaltered prompts in every format."""
    return generate.case_table(generate.reserved_questions(spark), "dev").select(*_CASE_COLUMNS)


@register(f"WITH {RESERVED}, {_case_sql(_formatted_sql('eval', ('integer',), 7, 'inner_no', 70))}")
def cases_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation in the format that the third version selected."""
    return generate.case_table(generate.reserved_questions(spark), "eval", "integer").select(*_CASE_COLUMNS)


@register(f"WITH {RESERVED}, e AS (SELECT * FROM ({_formatted_sql('eval', ('integer',), 7, 'inner_no', 70)})) SELECT case_id, condition FROM e WHERE CAST(split_part(question_id, '-', 4) AS INT) < 2")
def cases_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is replayed of the evaluation: the first two questions of each family."""
    return gate.replay_subset(generate.case_table(generate.reserved_questions(spark), "eval", "integer"), "eval").select("case_id", "condition")


# Scoring.

_STRIP = "regexp_replace(completion, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"


@register(f"WITH {RESPONSES}, s AS (SELECT *, regexp_full_match({_STRIP}, '[+-]?[0-9]+') AS whole, TRY_CAST({_STRIP} AS BIGINT) AS v FROM responses) SELECT l_orderkey, l_linenumber, CASE WHEN whole THEN v END AS parsed_answer, CASE WHEN whole THEN (CASE WHEN ltrim({_STRIP}, '+-0') = '' THEN '0' ELSE (CASE WHEN {_STRIP} LIKE '-%' THEN '-' ELSE '' END) || ltrim(ltrim({_STRIP}, '+-'), '0') END) END AS parsed_digits, CASE WHEN truncated THEN 'truncated' WHEN whole THEN 'valid' ELSE 'invalid_format' END AS status, NOT truncated AND whole AND v = answer AS correct FROM s")
def strict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.responses(spark, sf_dir)
    return r.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in strict_score(F.col("completion"), F.col("answer"), F.col("truncated")).items()))


_SCORE_COLUMNS = ("candidate_answer", "parsed_answer", "extraction_kind", "extracted", "strict_compliant", "correct", "strict_correct", "diagnostic")


@register(f"WITH {SCORED} SELECT l_orderkey, l_linenumber, {', '.join(_SCORE_COLUMNS)} FROM scored")
def grammar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scored(spark, sf_dir).select("l_orderkey", "l_linenumber", *_SCORE_COLUMNS)


@register(f"WITH {SCORED} SELECT format, diagnostic, count(*) AS n FROM scored GROUP BY ALL")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.diagnostics(views.scored(spark, sf_dir))


_SUMMARY = "SELECT format, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {k}) AS {k}" for k in gate.FLAGS) + " FROM scored GROUP BY format"


@register(f"WITH {SCORED} {_SUMMARY}")
def format_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.format_summary(views.scored(spark, sf_dir))


# Each supplier's responses as a pilot, whole: none is cut to the gate's size.
_PILOTS = _SUMMARY.replace("SELECT format", "SELECT l_suppkey AS pilot, format").replace("GROUP BY format", "GROUP BY l_suppkey, format")


def _pilots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scored(spark, sf_dir).withColumn("pilot", F.col("l_suppkey"))


@register(f"WITH {SCORED}, g AS ({_PILOTS}), b AS (SELECT pilot, count(*) = 3 AND min(n) = 42 AND max(n) = 42 AS complete, first(format ORDER BY correct DESC, extracted DESC, list_position({views._sql_list(FORMATS)}, format)) FILTER (WHERE correct >= 11 AND extracted >= 34) AS best FROM g GROUP BY pilot) SELECT pilot, complete, CASE WHEN complete THEN best END AS selected, CASE WHEN NOT complete THEN 'incomplete' WHEN best IS NOT NULL THEN 'pass' ELSE 'fail' END AS decision FROM b")
def gate_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate at its own 11 correct and 34 extracted of 42."""
    return gate.select_format(gate.format_summary(_pilots(spark, sf_dir), by=("pilot",)), by=("pilot",))


@register(f"WITH {SCORED}, g AS ({_PILOTS}) SELECT pilot, n, correct, extracted, n = 42 AND correct >= 34 AND extracted >= 38 AS passed FROM g WHERE format = 'integer'")
def gate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.threshold_gate(_pilots(spark, sf_dir).where("format = 'integer'"), by=("pilot",))


@register(f"WITH {RESERVED}, q AS (SELECT 'v2-dev-' || family || '-' || lpad(CAST(position AS VARCHAR), 3, '0') AS question_id, position, unnest({views._sql_list(FORMATS)}) AS format FROM reserved WHERE split = 'dev') SELECT question_id, format FROM q WHERE format = {views._sql_list(FORMATS)}[position % 3 + 1]")
def replay_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = generate.with_formats(generate.reserved_questions(spark).where("split = 'dev'"))
    return gate.replay_subset(cases, "dev").select("question_id", "format")


# Paired evaluation.


@register(f"WITH {RAW_RUNS} SELECT question_id, condition, count(*) AS n FROM raw_runs GROUP BY ALL HAVING count(*) > 1")
def duplicate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.duplicates(views.raw_runs(spark, sf_dir))


@register(f"WITH {RUNS} SELECT question_id, count(*) AS records, count(DISTINCT condition) = {len(CONDITIONS)} AS complete FROM runs GROUP BY question_id")
def complete_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.complete_clusters(views.runs(spark, sf_dir))


@register(f"WITH {PAIRED} SELECT condition, sum(CAST(correct AS INT)) AS correct, count(*) AS denominator, round(avg(CAST(correct AS INT)), 9) AS accuracy, round(avg(CAST(correct AS INT) - clean_correct), 9) AS paired_delta FROM pairs GROUP BY condition".replace("sum(CAST(correct AS INT))", "CAST(sum(CAST(correct AS INT)) AS BIGINT)", 1))
def paired_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.paired(views.runs(spark, sf_dir)).groupBy("condition").agg(*paired.accuracy())


_CELLS = ", ".join(f"count(*) FILTER (WHERE clean_correct = {x} AND CAST(correct AS INT) = {y}) AS {n}" for n, x, y in (("both_correct", 1, 1), ("clean_correct_to_incorrect", 1, 0), ("clean_incorrect_to_correct", 0, 1), ("both_incorrect", 0, 0)))


@register(f"WITH {PAIRED} SELECT condition, {_CELLS} FROM pairs GROUP BY condition")
def paired_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.paired(views.runs(spark, sf_dir)).groupBy("condition").agg(*paired.contingency())


@register(f"WITH {PAIRED}, c AS (SELECT family, condition, {_CELLS} FROM pairs GROUP BY ALL) SELECT family, condition, both_correct + clean_correct_to_incorrect AS clean_correct_denominator, round(CASE WHEN both_correct + clean_correct_to_incorrect > 0 THEN clean_correct_to_incorrect / (both_correct + clean_correct_to_incorrect) END, 9) AS break_rate FROM c")
def break_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = paired.paired(views.runs(spark, sf_dir)).groupBy("family", "condition").agg(*paired.contingency())
    n = F.col("both_correct") + F.col("clean_correct_to_incorrect")
    return cells.select("family", "condition", n.alias("clean_correct_denominator"), F.round(F.when(n > 0, F.col("clean_correct_to_incorrect") / n), 9).alias("break_rate"))


@register(f"WITH {PAIRED} SELECT condition, family, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, count(*) AS denominator FROM pairs GROUP BY GROUPING SETS ((condition), (condition, family))")
def family_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paired.paired(views.runs(spark, sf_dir))
    return p.groupingSets([[F.col("condition")], [F.col("condition"), F.col("family")]], "condition", "family").agg(F.sum(paired.ok()).alias("correct"), F.count("*").alias("denominator")).select("condition", "family", "correct", "denominator")


@register(f"WITH {PAIRED} SELECT condition, count(*) FILTER (WHERE status = 'invalid_format') AS invalid, count(*) FILTER (WHERE truncated) AS truncated, round(avg(tokens), 9) AS mean_output_tokens, round(sum(seconds), 6) AS total_generation_seconds FROM pairs GROUP BY condition")
def counters_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paired.paired(views.runs(spark, sf_dir))
    return p.groupBy("condition").agg(F.count_if(F.col("status") == "invalid_format").alias("invalid"), F.count_if("truncated").alias("truncated"), F.round(F.avg("tokens"), 9).alias("mean_output_tokens"), F.round(F.sum("seconds"), 6).alias("total_generation_seconds"))


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    z2 = Z95 * Z95
    middle = f"(({k} / {n}) + {z2!r} / (2 * {n})) / (1 + {z2!r} / {n})"
    half = f"{Z95!r} * sqrt(({k} / {n}) * (1 - ({k} / {n})) / {n} + {z2!r} / (4 * {n} * {n})) / (1 + {z2!r} / {n})"
    return f"round(CASE WHEN {n} > 0 THEN greatest(CAST(0 AS DOUBLE), {middle} - {half}) END, 9)", f"round(CASE WHEN {n} > 0 THEN least(CAST(1 AS DOUBLE), {middle} + {half}) END, 9)"


_LOW, _HIGH = _wilson_sql("k", "n")


@register(f"WITH {PAIRED}, c AS (SELECT condition, family, CAST(sum(CAST(correct AS INT)) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY ALL) SELECT condition, family, {_LOW} AS low, {_HIGH} AS high FROM c")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = paired.paired(views.runs(spark, sf_dir)).groupBy("condition", "family").agg(F.sum(paired.ok()).cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = paired.wilson(F.col("k"), F.col("n"))
    return c.select("condition", "family", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_WIDE = ", ".join(f"max(CASE WHEN condition = '{c}' THEN CAST(correct AS INT) END) AS c{i}" for i, c in enumerate(CONDITIONS))
_LONG = f"""long AS ({' UNION ALL '.join(f"SELECT '{c}' AS condition, s_{i} AS s, b_{i} AS b, s_0 AS clean, total FROM boot" for i, c in enumerate(CONDITIONS))})"""
_M = f"""{PAIRED},
m AS (SELECT family, question_id, {_WIDE} FROM pairs GROUP BY family, question_id)"""
_BOOT = f"""{_M},
cells AS MATERIALIZED (SELECT family, CAST(code AS BIGINT) AS code, hits, row_number() OVER (PARTITION BY family ORDER BY hits DESC, code) AS j, CAST(sum(hits) OVER (PARTITION BY family ORDER BY hits DESC, code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS of_
  FROM (SELECT family, {' + '.join(f'{1 << i} * c{i}' for i in range(len(CONDITIONS)))} AS code, count(*) AS hits FROM m GROUP BY ALL)),
{counts.multinomial_sql('cells', REPLICATES, BOOTSTRAP_SEED)},
boot AS (SELECT replicate, sum(times) AS total, {', '.join(f'sum(times * (code >> {i} & 1)) AS s_{i}, sum(times * (code & 1) * (1 - (code >> {i} & 1))) AS b_{i}' for i in range(len(CONDITIONS)))} FROM walk WHERE j > 0 GROUP BY replicate),
{_LONG}"""
# Every cluster of every replicate is drawn: four draws from an MD5.
_EACH = f"""{PAIRED},
m AS (SELECT family, question_id, {_WIDE}, row_number() OVER (PARTITION BY family ORDER BY {_draw("'part'", 'question_id')} % {paired.PARTS}, question_id) - 1 AS idx FROM pairs GROUP BY family, question_id),
sizes AS (SELECT family, count(*) AS n FROM m GROUP BY family),
hashed AS (SELECT family, n, replicate, block, md5('{BOOTSTRAP_SEED}:' || replicate || ':' || family || ':' || block) AS h FROM (SELECT family, n, replicate, unnest(range((n + 3) // 4)) AS block FROM sizes, range({REPLICATES}) r(replicate))),
draws AS ({' UNION ALL '.join(f"SELECT family, replicate, CAST('0x' || substr(h, {8 * j + 1}, 8) AS BIGINT) % n AS idx FROM hashed WHERE 4 * block + {j} < n" for j in range(4))}),
boot AS (SELECT replicate, count(*) AS total, {', '.join(f'sum(c{i}) AS s_{i}, sum(c0 * (1 - c{i})) AS b_{i}' for i in range(len(CONDITIONS)))} FROM draws JOIN m USING (family, idx) GROUP BY replicate),
{_LONG}"""


def _boot_sql(value: str, name: str, boot: str = f"RECURSIVE {_BOOT}") -> str:
    return f"WITH {boot} SELECT condition, round(quantile_cont({value}, 0.025), 9) AS {name}_low, round(quantile_cont({value}, 0.975), 9) AS {name}_high FROM long GROUP BY condition"


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.bootstrap_intervals(paired.bootstrap(paired.paired(views.runs(spark, sf_dir)), REPLICATES))


def _drawn_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.bootstrap_intervals(paired.drawn_bootstrap(paired.paired(views.runs(spark, sf_dir)), REPLICATES))


@register(_boot_sql("s / total", "accuracy"))
def bootstrap_accuracy_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir).select("condition", "accuracy_low", "accuracy_high")


@register(_boot_sql("(s - clean) / total", "delta", _EACH))
def bootstrap_delta_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn_intervals(spark, sf_dir).select("condition", "delta_low", "delta_high")


@register(_boot_sql("CASE WHEN clean > 0 THEN b / clean END", "break", _EACH).replace(" FROM long", ", count(*) FILTER (WHERE clean = 0) AS zero_clean_replicates FROM long"))
def break_rate_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn_intervals(spark, sf_dir).select("condition", "break_low", "break_high", "zero_clean_replicates")


@register("SELECT unnest(" + views._sql_list(CONDITIONS) + ") AS condition, '' AS differing UNION ALL SELECT 'planted', 'delta_high'")
def interval_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals against ones selected by rank from counted values, to 1e-12 of their nine digits; a planted row is off by 1e-8."""
    boot = paired.bootstrap(paired.paired(views.runs(spark, sf_dir)), REPLICATES)
    ends = [f"{r}_{end}" for r in paired.RATES for end in ("low", "high")]
    kept = stored(boot, "replicates")
    second = paired.ranked_intervals(kept).select("condition", *(F.round(e, 9).alias(e) for e in ends))
    planted = second.where("condition = 'clean'").withColumn("condition", F.lit("planted"))
    first = paired.bootstrap_intervals(kept).select("condition", *ends).unionByName(planted.withColumn("delta_high", F.col("delta_high") + 1e-8))
    return provenance.same_figures(first, second.unionByName(planted), "condition", 1e-12).select("condition", F.array_join("differing", ",").alias("differing"))


@register(f"WITH {_M}, d AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, c{2 * i + 2} - c{2 * i + 1} AS d FROM m" for i, k in enumerate(KINDS)) + ") SELECT kind, round(avg(d), 9) AS paired_delta, count(*) AS clusters FROM d GROUP BY kind")
def high_minus_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.high_minus_low(paired.paired(views.runs(spark, sf_dir)))


_KINDS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS kind, (s_{2 * i + 2} - s_{2 * i + 1}) / total AS d FROM boot" for i, k in enumerate(KINDS))


@register(f"WITH RECURSIVE {_BOOT}, d AS ({_KINDS_SQL}) SELECT kind, round(quantile_cont(d, 0.025), 9) AS delta_low, round(quantile_cont(d, 0.975), 9) AS delta_high FROM d GROUP BY kind")
def high_minus_low_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.high_minus_low_intervals(paired.bootstrap(paired.paired(views.runs(spark, sf_dir)), REPLICATES))


@register()
def exact_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.exact_bootstrap(paired.paired(views.runs(spark, sf_dir)), REPLICATES)


_BREAK_LOW, _BREAK_HIGH = _wilson_sql("x", "y")
_POINTS = f"""WITH {PAIRED}, c AS (SELECT condition, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, count(*) AS denominator, round(avg(CAST(correct AS INT)), 9) AS accuracy, round(avg(CAST(correct AS INT) - clean_correct), 9) AS paired_delta, {_CELLS},
  count(*) FILTER (WHERE status = 'invalid_format') AS invalid, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE changed_words = 0) AS unchanged, count(*) FILTER (WHERE changed_words > 0) AS possible_meaning_change,
  round(avg(realized_rate), 9) AS mean_realized_rate, round(avg(input_tokens), 9) AS mean_input_tokens, round(avg(tokens), 9) AS mean_output_tokens, round(sum(seconds), 6) AS total_seconds FROM pairs GROUP BY condition),
w AS (SELECT *, CAST(correct AS DOUBLE) AS k, CAST(denominator AS DOUBLE) AS n, CAST(clean_correct_to_incorrect AS DOUBLE) AS x, CAST(both_correct + clean_correct_to_incorrect AS DOUBLE) AS y FROM c)
SELECT * EXCLUDE (k, n, x, y), round(CASE WHEN y > 0 THEN x / y END, 9) AS break_rate, {_LOW} AS accuracy_wilson_low, {_HIGH} AS accuracy_wilson_high, {_BREAK_LOW} AS break_wilson_low, {_BREAK_HIGH} AS break_wilson_high FROM w"""


@register(_POINTS)
def condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.point_summary(paired.paired(views.runs(spark, sf_dir)))


_ENDS = {"accuracy": "s / total", "delta": "(s - clean) / total", "break": "CASE WHEN clean > 0 THEN b / clean END"}
_CI = ", ".join(f"round(quantile_cont({v}, {q}), 9) AS {n}_{end}" for n, v in _ENDS.items() for end, q in (("low", 0.025), ("high", 0.975)))
_HEAD_SQL, _POINTS_SQL = _POINTS.removeprefix(f"WITH {PAIRED}").split("\nSELECT ", 1)


@register(f"WITH RECURSIVE {_BOOT}{_HEAD_SQL}, points AS (SELECT {_POINTS_SQL}), ends AS (SELECT condition, {_CI}, count(*) FILTER (WHERE clean = 0) AS zero_clean_replicates FROM long GROUP BY condition) SELECT * FROM points JOIN ends USING (condition)")
def whole_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, Wilson bounds and the intervals of all replicates together, over guarded runs."""
    return paired.summarize(views.runs(spark, sf_dir), REPLICATES)


@register(f"WITH {RUNS}, c AS (SELECT question_id, count(*) AS records, count(DISTINCT condition) = {len(CONDITIONS)} AS complete FROM runs GROUP BY question_id) SELECT count(*) FILTER (WHERE complete) AS clusters, count(*) FILTER (WHERE NOT complete) AS excluded_clusters, CAST(coalesce(sum(records) FILTER (WHERE NOT complete), 0) AS BIGINT) AS excluded_records FROM c")
def excluded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.excluded(views.runs(spark, sf_dir))


@register(f"WITH {SCORED} SELECT format, CASE WHEN extracted THEN 'valid' ELSE 'invalid_format' END AS status, count(*) AS n, count(*) FILTER (WHERE extracted) AS extracted, count(*) FILTER (WHERE strict_compliant) AS strict_compliant, count(*) FILTER (WHERE strict_correct) AS strict_correct, CAST(sum(answer) AS BIGINT) AS tokens FROM scored GROUP BY ALL")
def remapped_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grammar scores as the first version's statuses, with the sums that go with them."""
    remapped = F.when(F.col("extracted"), "valid").otherwise("invalid_format")
    return views.scored(spark, sf_dir).groupBy("format", remapped.alias("status")).agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("extracted", "strict_compliant", "strict_correct")), F.sum("answer").alias("tokens"))


# Validation and audit of output records.

_LATE = "l_linestatus = 'F' AND l_discount > 0.08"
_BROKEN = {
    "score_correct": "l_orderkey % 53 = 0", "prompt_hash": "l_orderkey % 41 = 0", "input_count": "l_orderkey % 37 = 0", "timing": "l_orderkey % 31 = 0", "token_range": "l_orderkey % 47 = 0",
    "eos": "l_orderkey % 43 = 0", "truncation": f"l_orderkey % 43 = 0 AND {_LATE}", "finished": f"l_orderkey % 43 = 0 AND NOT ({_LATE})",
}


def _validation(version: int) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        eos, cap, top = views.VERSIONS[version]
        rules = integrity.output_rules(version, eos, cap, top)
        return views.outputs(spark, sf_dir, version).select("l_orderkey", "l_linenumber", F.array_join(integrity.violations(rules), ",").alias("broken"))

    query.__name__ = f"validate_v{version}"
    query.__doc__ = f"Every rule of a version-{version} record over every line: the rules it breaks."
    own = {n: c for n, c in _BROKEN.items() if version > 1 or n in ("score_correct", "prompt_hash", "input_count", "timing")}
    register("SELECT l_orderkey, l_linenumber, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in own.items()) + ") AS broken FROM lineitem")(query)


for _version in views.VERSIONS:
    _validation(_version)


@register("SELECT count(*) FILTER (WHERE l_orderkey % 29 <> 0) + count(*) FILTER (WHERE l_orderkey % 97 = 0) AS records, count(*) AS expected, count(*) FILTER (WHERE l_orderkey % 29 = 0) AS missing, count(*) FILTER (WHERE l_orderkey % 97 = 0) AS unexpected, count(*) FILTER (WHERE l_orderkey % 29 <> 0 AND l_orderkey % 31 = 0) AS changed, false AS complete FROM lineitem")
def audit_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored prompts against ones made anew from the table: records that are missing, that nothing asked for, or whose prompt differs."""
    made = views.responses(spark, sf_dir).select("l_orderkey", "l_linenumber", F.sha2(integrity.rendered(F.concat(F.lit("Calculate "), F.col("expression"))), 256).alias("prompt_sha256"))
    held = made.where("l_orderkey % 29 <> 0").withColumn("prompt_sha256", F.when(F.col("l_orderkey") % 31 == 0, "changed").otherwise(F.col("prompt_sha256")))
    more = made.where("l_orderkey % 97 = 0").withColumn("l_orderkey", -1 - F.col("l_orderkey"))
    return integrity.audit_inputs(held.unionByName(more), made, ["l_orderkey", "l_linenumber"], "prompt_sha256")


# Runs against runs, integrity.


@register("WITH l AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderkey % 11 = 0 AS gone, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s2, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS p2 FROM orders) SELECT o_orderkey, NOT gone AS found, CASE WHEN NOT gone THEN concat_ws(',', CASE WHEN o_orderpriority IS DISTINCT FROM p2 THEN 'o_orderpriority' END, CASE WHEN o_orderstatus IS DISTINCT FROM s2 THEN 'o_orderstatus' END) END AS differing FROM l")
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    again = run.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    return integrity.compare(run, again, "o_orderkey", exclude=("o_totalprice",)).withColumn("differing", F.array_join(F.array_sort("differing"), ","))


@register(f"""WITH e AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p, o_orderkey AS id FROM orders),
r AS (SELECT run, p, id + (id % 19 = 0)::INT AS got, id % 17 <> 0 AS ok FROM e WHERE id % 23 <> 0 UNION ALL SELECT run, p, id, true FROM e WHERE id % 29 = 0 AND id % 23 <> 0 UNION ALL SELECT run, max(p) + 1, 0, true FROM e WHERE run % 3 = 0 GROUP BY run),
g AS (SELECT run, p, count(*) AS n, min(got) AS got, bool_and(ok) AS ok FROM r GROUP BY ALL),
j AS (SELECT coalesce(e.run, g.run) AS run, coalesce(e.p, g.p) AS p, e.p AS ep, n, CASE WHEN n IS NULL THEN 'gap' WHEN e.p IS NULL THEN 'extra' WHEN n > 1 THEN 'repeated' WHEN id <> got THEN 'wrong_id' WHEN NOT ok THEN 'broken_seal' END AS cause FROM e FULL JOIN g ON g.run = e.run AND g.p = e.p)
SELECT run, CAST(coalesce(sum(n), 0) AS BIGINT) AS records, count(ep) AS expected, coalesce(min(p) FILTER (WHERE cause IS NOT NULL), count(ep)) AS prefix, min(p) FILTER (WHERE cause IS NOT NULL) AS place, arg_min(cause, p) FILTER (WHERE cause IS NOT NULL) AS cause FROM j GROUP BY run""")
def valid_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as runs with gaps, repeats, wrong ids, broken seals and extra records: how far each is valid, and why not further."""
    at = F.row_number().over(W.partitionBy("run").orderBy("id")) - 1
    expected = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("id")).withColumn("at", at.cast("long"))
    id_ = F.col("id")
    kept = expected.where(id_ % 23 != 0)
    records = kept.select("run", "at", (id_ + F.when(id_ % 19 == 0, 1).otherwise(0)).alias("id"), (id_ % 17 != 0).alias("intact"))
    again = kept.where(id_ % 29 == 0).select("run", "at", "id", F.lit(True).alias("intact"))
    extra = expected.where("run % 3 = 0").groupBy("run").agg((F.max("at") + 1).alias("at")).select("run", "at", F.lit(0).cast("long").alias("id"), F.lit(True).alias("intact"))
    return runlog.valid_prefixes(records.unionByName(again).unionByName(extra), expected, "run", "at", "id", "intact")


_WRONG = "((coalesce(text, '') <> '' AND (conv_id + turn) % 7 = 0) OR (conv_id + turn) % 11 = 0)"


@register(f"SELECT conv_id || ':' || turn AS turn_id, NOT {_WRONG} AS encodes, NOT {_WRONG} AS decodes FROM conversations")
def token_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored ids of every turn, some without their last, some with one too many, against the texts, both ways."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), (F.col("conv_id") + F.col("turn")).alias("n"), "text")
    n, size = F.col("n"), F.size("ids")
    hurt = F.when(n % 11 == 0, F.concat("ids", F.array(F.lit(0)))).when((n % 7 == 0) & (size > 0), F.slice("ids", F.lit(1), F.greatest(size - 1, F.lit(0)))).otherwise(F.col("ids"))
    kept = stored(tokens.with_ids(turns, "text", path).withColumn("ids", hurt), "stored-ids")
    return tokens.verify_tokens(kept, "turn_id", "text", "ids", path).select("turn_id", "encodes", "decodes")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def resume_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("ordinal"))
    return runlog.remainder(expected, expected.where("o_orderkey % 3 = 0"), "o_orderkey").select("o_orderkey")


def _escaped(text: str) -> str:
    """A JSON string in DuckDB; the documents' control characters are white space."""
    out = text
    for raw, escape in (("chr(92)", "chr(92) || chr(92)"), ("'\"'", "chr(92) || '\"'"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'"), ("chr(12)", "chr(92) || 'f'"), ("chr(11)", "chr(92) || 'u000b'")):
        out = f"replace({out}, {raw}, {escape})"
    return f"coalesce('\"' || {out} || '\"', 'null')"


_SEALED = f"""'{{"doc_id":' || doc_id || ',"lang":' || {_escaped('lang')} || ',"score":' || coalesce(CAST(n_chars / 7 AS VARCHAR), 'null') || ',"text":' || {_escaped('text')} || ',"words":[' || array_to_string(list_transform(string_split(lang, 'e'), lambda x: '"' || x || '"'), ',') || ']}}'"""


@register(f"SELECT doc_id, sha256({_SEALED}) AS record_sha256, true AS intact, false AS tampered_intact FROM documents")
def record_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sealed canonical line, with a double, a list and null texts; the line is judged as it stands, and again with its id changed."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") / 7).alias("score"), "text", F.split("lang", "e").alias("words"))
    sealed = rows.withColumn("record_sha256", integrity.seal(integrity.canonical_json(rows, rows.columns)))
    lines = sealed.select("doc_id", "record_sha256", integrity.canonical_json(sealed, sealed.columns).alias("line"))
    return lines.select("doc_id", "record_sha256", integrity.sealed_line_ok(F.col("line")).alias("intact"), integrity.sealed_line_ok(F.replace("line", F.lit('{"doc_id":'), F.lit('{"doc_id":1'))).alias("tampered_intact"))


@register("SELECT doc_id, concat_ws(',', CASE WHEN coalesce(n_chars = length(text), false) THEN NULL ELSE 'n_chars' END, CASE WHEN coalesce(lang IN ('en', 'fr'), false) THEN NULL ELSE 'lang' END, CASE WHEN coalesce(length(text) > 100, false) THEN NULL ELSE 'length' END) AS broken FROM documents")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"n_chars": F.col("n_chars") == F.length("text"), "lang": F.col("lang").isin("en", "fr"), "length": F.length("text") > 100}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(integrity.violations(rules), ",").alias("broken"))


_FILES = "SELECT CAST(doc_id AS VARCHAR) AS name, coalesce(n_chars, 0) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents"


@register(f"WITH f AS ({_FILES}) SELECT name, CASE WHEN CAST(name AS BIGINT) % 9 = 0 THEN 'missing' WHEN CAST(name AS BIGINT) % 8 = 0 THEN 'size' WHEN CAST(name AS BIGINT) % 7 = 0 THEN 'hash' END AS problem FROM f")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.coalesce("n_chars", F.lit(0)).alias("bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    n = F.col("name").cast("long")
    files = manifest.where(n % 9 != 0).withColumn("bytes", F.when(n % 8 == 0, F.col("bytes") + 1).otherwise(F.col("bytes"))).withColumn("sha256", F.when(n % 7 == 0, F.lit("")).otherwise(F.col("sha256")))
    return integrity.manifest_check(manifest, files)


@register("SELECT count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS records, count(*) AS expected, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS missing, CAST(0 AS BIGINT) AS unexpected, count(*) FILTER (WHERE o_orderkey % 4 <> 0 AND NOT o_totalprice > 50000) AS broken, coalesce(max(o_orderkey) FILTER (WHERE o_orderkey % 4 <> 0) + 1 = count(*) FILTER (WHERE o_orderkey % 4 <> 0), true) AS prefix, false AS complete FROM orders")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").withColumn("ordinal", F.col("o_orderkey"))
    return integrity.audit(expected.where("o_orderkey % 4 <> 0"), expected, "o_orderkey", {"price": F.col("o_totalprice") > 50000})


@register("SELECT event_type, count(*) AS sessions, round(sum(value), 6) AS wall_seconds, max(value) AS peak FROM events GROUP BY event_type")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("sessions"), F.round(F.sum("value"), 6).alias("wall_seconds"), F.max("value").alias("peak"))


@register(f"WITH {SCORED} SELECT CASE WHEN truncated THEN 'truncated' WHEN extraction_kind = 'integer' THEN 'valid' ELSE 'invalid_format' END AS original_status, CASE WHEN truncated THEN 'truncated' WHEN NOT extracted THEN 'unsupported' WHEN correct THEN 'right' ELSE 'wrong' END AS category, count(*) AS n FROM scored GROUP BY ALL")
def diagnosis_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scored(spark, sf_dir)
    status = strict_score(F.col("completion"), F.col("answer"), F.col("truncated"))["status"]
    # What is right is never truncated; asked first, the reading is made for every row once, not in each branch anew.
    category = F.when(F.col("correct"), "right").when(F.col("truncated"), "truncated").when(~F.col("extracted"), "unsupported").otherwise("wrong")
    return s.groupBy(status.alias("original_status"), category.alias("category")).agg(F.count("*").alias("n"))


@register(f"WITH f AS ({_FILES}) SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS total_bytes, max(bytes) AS largest, count(*) <= 1000 AND max(bytes) <= 10485760 AND sum(bytes) <= 33554432 AS within FROM f")
def artifact_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.tree_limits(table(spark, sf_dir, "documents").select(F.coalesce("n_chars", F.lit(0)).alias("bytes")))


# Provenance.

_ORDERS_NOW = "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0"


def _sealed_sql(t: str) -> str:
    return f"sha256('{{\"o_orderkey\":' || {t}.o_orderkey || ',\"o_orderpriority\":\"' || {t}.o_orderpriority || '\",\"o_orderstatus\":\"' || {t}.o_orderstatus || '\"}}')"


@register(f"WITH now AS ({_ORDERS_NOW}) SELECT f.o_orderkey, {_sealed_sql('f')} AS frozen_sha256, CASE WHEN now.o_orderkey IS NULL THEN 'missing' WHEN {_sealed_sql('now')} <> {_sealed_sql('f')} THEN 'drifted' ELSE 'same' END AS state FROM orders f LEFT JOIN now ON now.o_orderkey = f.o_orderkey")
def freeze_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    now = frozen.where("o_orderkey % 17 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return provenance.drift(provenance.frozen(frozen, "o_orderkey"), now, "o_orderkey")


@register("SELECT o_orderkey, concat_ws(',', CASE WHEN min(l_shipdate) > o_orderdate THEN NULL ELSE 'order<ship' END, CASE WHEN max(l_shipdate) >= min(l_shipdate) THEN NULL ELSE 'first<=last' END) AS broken FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (freezes) before their first shipment (run), and that not after their last (evaluation); a missing time breaks."""
    ships = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    both = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(ships, "o_orderkey", "left")
    return provenance.chronology(both, [("o_orderdate", "first", True), ("first", "last", False)], {"o_orderdate": "order", "first": "first", "last": "last"}, {0: "order<ship"}).select("o_orderkey", F.array_join("broken", ",").alias("broken"))


@register("WITH s AS (SELECT o_orderkey + (CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END) AS ordinal, o_orderkey AS id FROM orders WHERE o_orderkey % 23 <> 0), j AS (SELECT s.ordinal, s.id, e.o_orderkey AS e FROM s LEFT JOIN orders e ON e.o_orderkey = s.ordinal) SELECT count(*) AS records, count(*) FILTER (WHERE e IS NULL) AS extra, count(*) FILTER (WHERE e <> id) AS wrong_id, count(*) - count(DISTINCT ordinal) AS repeated, max(ordinal) + 1 = count(*) AND count(DISTINCT ordinal) = count(*) AND count(*) FILTER (WHERE e IS NULL OR e <> id) = 0 AS valid_prefix FROM j")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("ordinal"))
    records = expected.where("o_orderkey % 23 <> 0").withColumn("ordinal", F.col("ordinal") + F.when(F.col("o_orderkey") % 19 == 0, 1).otherwise(0))
    return provenance.positional(records, expected, "o_orderkey")


@register(f"WITH {SCORED}, s AS (SELECT o_orderpriority, diagnostic, l_orderkey, l_linenumber, l_suppkey, completion FROM scored JOIN orders ON o_orderkey = l_orderkey) SELECT o_orderpriority, diagnostic, l_orderkey, l_linenumber, completion FROM s QUALIFY row_number() OVER (PARTITION BY o_orderpriority, diagnostic ORDER BY l_orderkey, l_linenumber, l_suppkey, completion) <= 12")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs with their questions; of each category the first twelve, which is the report."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    both = views.scored(spark, sf_dir).join(asked, "l_orderkey")
    return provenance.first_of(both, ["o_orderpriority", "diagnostic"], ["l_orderkey", "l_linenumber", "l_suppkey", "completion"], 12).select("o_orderpriority", "diagnostic", "l_orderkey", "l_linenumber", "completion")


@register(f"WITH {SCORED} SELECT format, count(*) AS n, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE extracted AND NOT correct) AS extracted_wrong, count(*) FILTER (WHERE NOT truncated AND NOT extracted) AS unsupported_nontruncated FROM scored GROUP BY format")
def recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format summary once more, by a reader that shares no grammar with the scorer."""
    return provenance.recount(views.responses(spark, sf_dir))


@register(f"WITH {SCORED}, g AS ({_PILOTS}), b AS (SELECT pilot, count(*) = 3 AND min(n) = 42 AND max(n) = 42 AS complete, first(format ORDER BY correct DESC, extracted DESC, list_position({views._sql_list(FORMATS)}, format)) FILTER (WHERE correct >= 11 AND extracted >= 34) AS best FROM g GROUP BY pilot), d AS (SELECT pilot, CASE WHEN complete THEN best END AS selected, CASE WHEN NOT complete THEN 'incomplete' WHEN best IS NOT NULL THEN 'pass' ELSE 'fail' END AS decision FROM b) SELECT pilot, decision = 'pass' AS allowed, sha256('{{\"decision\":\"' || decision || '\",\"pilot\":' || pilot || ',\"selected\":' || CASE WHEN selected IS NULL THEN 'null' ELSE '\"' || selected || '\"' END || '}}') AS evidence_sha256 FROM d")
def evaluation_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation is blocked unless its pilot passed; the decision's hash goes into the evaluation's record."""
    decisions = gate.select_format(gate.format_summary(_pilots(spark, sf_dir), by=("pilot",)), by=("pilot",))
    return provenance.allowed(decisions, ["pilot", "selected", "decision"]).select("pilot", "allowed", "evidence_sha256")


@register("WITH f AS (SELECT user_id, min(ts) AS started FROM events GROUP BY user_id) SELECT event_id, epoch(ts - started) <= 43200 AS within_budget FROM events JOIN f USING (user_id)")
def wall_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions against a budget that counts from a run's first start, whatever restarts there were."""
    return provenance.within_budget(table(spark, sf_dir, "events"), "user_id", "ts", 43_200).select("event_id", "within_budget")


@register("WITH l AS (SELECT *, l_orderkey % 3 <> 0 AS ended FROM lineitem), " + SCORED.replace("FROM lineitem)", "FROM l)").replace("l_linestatus = 'F' AND l_discount > 0.08 AS truncated FROM base", "answer >= 40 AND NOT ended AS truncated FROM base") + " SELECT l_orderkey, l_linenumber, truncated, extracted, correct FROM scored")
def capped_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs under a cap of 40 tokens: truncation and scores recomputed."""
    r = views.responses(spark, sf_dir).withColumn("output_tokens", F.col("answer")).withColumn("ended_with_eos", F.col("l_orderkey") % 3 != 0)
    return runlog.capped(r, 40).select("l_orderkey", "l_linenumber", "truncated", "extracted", "correct")


@register(f"WITH {PAIRED}, p AS (SELECT condition, avg(CAST(correct AS INT)) AS accuracy, count(*) AS n FROM pairs GROUP BY condition) SELECT condition, CASE WHEN condition = 'delete-40' THEN 'accuracy' ELSE '' END AS differing FROM p")
def stored_summary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored summary against one computed anew, to 1e-12; one stored figure is off by 1e-9."""
    fresh = paired.paired(views.runs(spark, sf_dir)).groupBy("condition").agg(F.avg(paired.ok()).alias("accuracy"), F.count("*").alias("n"))
    stored_rows = fresh.withColumn("accuracy", F.col("accuracy") + F.when(F.col("condition") == "delete-40", 1e-9).otherwise(0.0))
    return provenance.same_figures(stored_rows, fresh, "condition", 1e-12).select("condition", F.array_join("differing", ",").alias("differing"))


@register("SELECT coalesce(lang, '') AS suffix, count(*) AS files, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def artifact_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat_ws(".", F.col("doc_id").cast("string"), F.col("lang")).alias("name"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return provenance.sizes_by_suffix(files)


# Stages without a SQL twin.


@register()
def stub_engine_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases through an engine, then the native scorer."""
    cases = generate.with_formats(generate.reserved_questions(spark)).select("question_id", "family", "format", "answer", "prompt")
    out = runlog.generate(cases)
    return out.withColumns(strict_score(F.col("completion"), F.col("answer"), F.col("truncated"))).drop("prompt")


@register()
def exact_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textops.perturb(generate.first_questions(spark), "question_id", "prompt", "keyboard", 0.4, exact=True).select("question_id", "altered", "edits")


@register()
def streaming_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended by a checkpointed stream, run twice; the second run finds nothing new."""
    out, mark = fresh_dir(spark, "append"), fresh_dir(spark, "append-state")
    schema = table(spark, sf_dir, "documents").schema
    for _ in range(2):
        source = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
        runlog.append_available(source, out, mark, lambda d: d.select("doc_id", F.sha2("text", 256).alias("text_sha256")))
    return spark.read.schema("doc_id long, text_sha256 string").parquet(out)


def _torn_logs(spark: SparkSession, sf_dir: str) -> str:
    """Logs of all ``events``; beside the whole ones, each thousandth event (and null ids) has a log of two whole lines and half a third."""
    path = fresh_dir(spark, "log")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    e = table(spark, sf_dir, "events").select(line.alias("value"), F.coalesce(F.col("event_id") % 1000 == 0, F.lit(True)).alias("torn"))
    e.where(~F.col("torn")).select("value").write.text(path)
    cut = F.expr("concat(value, '\n', value, '\n', substr(value, 1, length(value) div 2))")
    e.where("torn").select(cut).write.mode("append").option("lineSep", "|").option("maxRecordsPerFile", 1).text(path)
    return path


@register()
def torn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of all events, a thousandth of them torn: what is kept and what is cut of each torn one."""
    return runlog.torn_tails(spark, _torn_logs(spark, sf_dir)).where("tail_bytes > 0").select("complete_lines", "tail_bytes", "tail_sha256")


@register()
def recovered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of those logs without the torn ones, which are kept as evidence."""
    return runlog.recovered(spark, _torn_logs(spark, sf_dir), "event_id long, user_id long, event_type string, value double", fresh_dir(spark, "evidence"))


@register()
def release_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of all documents (a file for each language and 1,000 ids) against its manifest, with a row for each file.

    Behind the manifest's back one more file comes for ids divisible by 7,000; of the manifest's entries, those of blocks
    1 and 2 of each seven have another size and another hash, and those of block 3 are entered under a second name too.
    """
    root = fresh_dir(spark, "tree")
    block = F.floor(F.col("doc_id") / 1000).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", block.alias("block"))
    write = lambda d, b: d.withColumn("block", b).repartition("lang", "block").sortWithinPartitions("lang", "block", "doc_id").write.partitionBy("lang", "block").mode("append").json(root)
    write(docs, F.col("block"))
    k = F.pmod(F.regexp_extract("name", r"block=(\d+)/", 1).cast("long"), F.lit(7))
    made = stored(tree_files(spark, root).select("name", "bytes", "sha256"), "manifest")
    wrong = made.withColumn("bytes", F.col("bytes") + F.when(k == 1, 1).otherwise(0)).withColumn("sha256", F.when(k == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    manifest = wrong.union(made.where(k == 3).withColumn("name", F.concat("name", F.lit(".lost"))))
    write(docs.where("doc_id % 7000 = 0"), F.concat(F.lit("late-"), "block"))
    found = integrity.tree_check(manifest, tree_files(spark, root))
    return found.select(F.regexp_extract("name", "lang=([^/]*)/", 1).alias("lang"), F.regexp_extract("name", "block=([^/]*)/", 1).alias("block"), "problem")


@register()
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs of 20 records within two days, over a stream of all events that is stopped and taken up three times."""
    source, out, mark = (fresh_dir(spark, n) for n in ("run-events", "run-states", "run-state-marks"))
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    # A log grows in the order of time; its quarters are bounded by the span of the times.
    span = events.agg(F.unix_micros(F.min("ts")).alias("low"), F.unix_micros(F.max("ts")).alias("high")).first()
    low, high = span.low or 0, span.high or 0
    quarter = F.coalesce(F.least(F.lit(3), F.floor((F.unix_micros("ts") - low) * 4 / max(high - low, 1))), F.lit(0)).cast("int")
    for q in range(4):
        events.where(quarter == q).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        runstate.append_states(runstate.run_states(stream, "user_id", "ts", 2 * 86_400, 20), out, mark)
    return runstate.latest_states(spark, out, "user_id", table(spark, sf_dir, "events").schema["user_id"].dataType.simpleString())
