"""Format summaries and threshold gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.functions.dims import FORMATS

FLAGS = ("correct", "extracted", "strict_compliant", "strict_correct", "truncated")


def format_summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, "format").agg(F.count("*").alias("n"), *(F.count_if(F.col(k)).alias(k) for k in FLAGS))


def diagnostics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("format", "diagnostic").agg(F.count("*").alias("n"))


def select_format(summary: DataFrame, n: int = 42, correct: int = 11, extracted: int = 34, formats: tuple[str, ...] = FORMATS, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each ``by``: complete, selected, decision. The best passing format by correct, then extracted, then order."""
    order = F.array_position(F.array(*(F.lit(f) for f in formats)), F.col("format"))
    passing = (F.col("correct") >= correct) & (F.col("extracted") >= extracted)
    best = F.max_by(F.when(passing, F.col("format")), F.when(passing, F.struct("correct", "extracted", -order)))
    whole = (F.count("*") == len(formats)) & (F.min("n") == n) & (F.max("n") == n)
    out = summary.where(F.col("format").isin(*formats)).groupBy(*by).agg(F.coalesce(whole, F.lit(False)).alias("complete"), best.alias("best"))
    selected = F.when(F.col("complete"), F.col("best"))
    return out.select(*by, "complete", selected.alias("selected"), F.when(~F.col("complete"), "incomplete").when(selected.isNotNull(), "pass").otherwise("fail").alias("decision"))


def threshold_gate(rows: DataFrame, n: int = 42, correct: int = 34, extracted: int = 38, by: tuple[str, ...] = ()) -> DataFrame:
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.count_if("extracted").alias("extracted"))
    return counts.withColumn("passed", (F.col("n") == n) & (F.col("correct") >= correct) & (F.col("extracted") >= extracted))


def replay_subset(cases: DataFrame, split: str, id_col: str = "question_id", formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """Development: one format a question, in turn; evaluation: the first two questions of each family."""
    index = F.element_at(F.split(F.col(id_col), "-"), -1).cast("int")
    return cases.where(F.col("format") == F.element_at(F.array(*(F.lit(f) for f in formats)), index % len(formats) + 1) if split == "dev" else index < 2)
