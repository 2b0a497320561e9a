import pytest
from pyspark.sql import functions as F

from pairlight.functions.dims import CONDITIONS, FAMILIES
from pairlight.operators import gate, integrity, paired


def records(spark, pairs):
    """(clean, noisy) for each question."""
    rows = [(f"q{i}", FAMILIES[i % 3], c, bool(clean if c == "clean" else noisy)) for i, (clean, noisy) in enumerate(pairs) for c in CONDITIONS]
    return spark.createDataFrame(rows, "question_id string, family string, condition string, correct boolean")


def test_the_four_cells(spark):
    p = paired.paired(records(spark, [(1, 1), (1, 0), (0, 1), (0, 0)]))
    r = p.where("condition = 'delete-20'").groupBy("condition").agg(*paired.contingency(), *paired.accuracy()).first()
    assert (r.both_correct, r.clean_correct_to_incorrect, r.clean_incorrect_to_correct, r.both_incorrect, r.paired_delta) == (1, 1, 1, 1, 0.0)


def test_all_wrong_and_all_broken(spark):
    wrong = paired.bootstrap_intervals(paired.bootstrap(paired.paired(records(spark, [(0, 0)] * 6)), 50)).where("condition = 'delete-40'").first()
    assert wrong.break_low is None and wrong.zero_clean_replicates == 50 and wrong.accuracy_high == 0
    broken = paired.bootstrap_intervals(paired.bootstrap(paired.paired(records(spark, [(1, 0)] * 6)), 50)).where("condition = 'delete-40'").first()
    assert (broken.delta_low, broken.delta_high, broken.break_low) == (-1, -1, 1)


def test_duplicates_fail_and_incomplete_clusters_go(spark):
    runs = records(spark, [(1, 1), (0, 0)])
    with pytest.raises(Exception, match="duplicate condition"):
        paired.guarded(runs.unionByName(runs.limit(1))).collect()
    partial = runs.where("not (question_id = 'q1' and condition = 'clean')")
    assert paired.paired(partial).select("question_id").distinct().count() == 1
    assert {r.question_id: r.complete for r in paired.complete_clusters(partial).collect()} == {"q0": True, "q1": False}
    odd = runs.unionByName(spark.createDataFrame([("q0", "addition", "other", True)], runs.schema))
    assert {r.question_id for r in paired.paired(odd).collect()} == {"q1"}


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 210.0), (210.0, 210.0)], "k double, n double")
    low, high = paired.wilson(F.col("k"), F.col("n"))
    rows = df.select("k", "n", low.alias("l"), high.alias("h")).collect()
    assert (rows[0].l, rows[0].h) == (None, None)
    assert rows[1].l == 0 and abs(rows[1].h - 0.01796) < 1e-5 and rows[2].h == 1


def test_exact_bootstrap_brackets_the_mean(spark):
    r = paired.exact_bootstrap(paired.paired(records(spark, [(1, 0), (1, 1), (0, 1)] * 4)), 200).where("condition = 'clean'").first()
    assert r.accuracy_low <= 2 / 3 <= r.accuracy_high and r.delta_low == 0


def gate_rows(spark, correct, extracted, n=42):
    rows = [(f, i < correct, i < extracted, i < extracted, i < correct, False) for f in ("integer", "label", "equation") for i in range(n)]
    return spark.createDataFrame(rows, "format string, correct boolean, extracted boolean, strict_compliant boolean, strict_correct boolean, truncated boolean")


def test_gates(spark):
    select = lambda *a: tuple(gate.select_format(gate.format_summary(gate_rows(spark, *a))).first())
    assert select(11, 34) == (True, "integer", "pass")
    assert select(10, 34) == (True, None, "fail")
    assert select(11, 33) == (True, None, "fail")
    assert select(11, 34, 41) == (False, None, "incomplete")
    assert gate.threshold_gate(gate_rows(spark, 34, 38).where("format = 'label'")).first().passed
    assert not gate.threshold_gate(gate_rows(spark, 33, 38).where("format = 'label'")).first().passed


def test_rules_and_compare(spark):
    row = spark.range(1).select(F.lit("42").alias("completion"), F.lit(42).cast("long").alias("answer"), F.lit(False).alias("truncated"), F.lit(42).cast("long").alias("parsed_answer"), F.lit("valid").alias("status"), F.lit(True).alias("correct"), F.lit("p").alias("rendered_prompt"), F.sha2(F.lit("p"), 256).alias("rendered_prompt_sha256"), F.array(F.lit(1), F.lit(2)).alias("input_token_ids"), F.sha2(F.lit("[1,2]"), 256).alias("input_token_sha256"), F.lit(2).alias("input_tokens"), F.array(F.lit(5)).alias("output_token_ids"), F.lit(1).alias("output_tokens"), F.lit(1.0).alias("elapsed_seconds"))
    broken = lambda d: d.select(integrity.violations(integrity.output_rules()).alias("v")).first().v
    assert broken(row) == []
    assert broken(row.withColumn("output_tokens", F.lit(2)).withColumn("status", F.lit("truncated"))) == ["score_status", "output_count"]
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "q", 2)], "k int, s string, n int")
    assert {r.k: (r.found, r.differing) for r in integrity.compare(a, b, "k").collect()} == {1: (True, []), 2: (True, ["s", "n"]), 3: (False, None)}
