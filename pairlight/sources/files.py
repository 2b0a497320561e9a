"""JSON documents, JSON lines, raw bytes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions.canonical import canonical_json
from pairlight.sources.shared import tree_files as file_stats  # noqa: F401  part of this module's interface
from pairlight.sources.shared import write_document as write_json  # noqa: F401


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file; a glob reads many."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Declared schema, no inference; a bad line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Canonical lines: sorted keys, nulls kept."""
    df.select(canonical_json(df, df.columns).alias("value")).write.text(path)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows either side has that the other hasn't."""
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))


def markdown(rows: DataFrame) -> str:
    """A Markdown table of a small result, in order of its first column."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    cell = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join([head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows.orderBy(rows.columns[0]).collect())]) + "\n"


def report(summary: DataFrame, title: str = "Summary", sections: dict[str, DataFrame] | None = None) -> str:
    """A Markdown table of a per-condition summary (a row a condition), and one of each section under its heading."""
    return f"# {title}\n\n{markdown(summary)}" + "".join(f"\n## {name}\n\n{markdown(rows)}" for name, rows in (sections or {}).items())


def families(rows: DataFrame, names: list[str], correct: str = "correct") -> DataFrame:
    """condition, and for each family ``correct/all``; a family without rows has 0/0, a null counts as incorrect."""
    of = lambda n: F.col("family") == n
    ratio = lambda n: F.concat_ws("/", F.count_if(of(n) & F.col(correct)), F.count_if(of(n)))
    return rows.groupBy("condition").agg(*(ratio(n).alias(n) for n in names))


def realized(rows: DataFrame) -> DataFrame:
    """condition, mean rates of edited words, unchanged and possibly changed in meaning out of all; nulls are left out of means."""
    out = lambda c: F.concat_ws("/", F.count_if(c), F.count("*"))
    return rows.groupBy("condition").agg(
        F.avg("eligible_word_rate").alias("eligible_word_rate"), F.avg("all_word_rate").alias("all_word_rate"),
        out(F.col("unchanged")).alias("unchanged"), out(F.col("possible_meaning_change")).alias("possible_meaning_change"), F.avg("input_tokens").alias("input_tokens"),
    )


def runtime(sessions: DataFrame) -> DataFrame:
    """One row: sessions, the sum of their wall seconds, and the largest process; zero sessions have zero seconds."""
    return sessions.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("wall_seconds"), F.lit(0.0)).alias("wall_seconds"), F.max("peak_process_rss_kib").alias("peak_process_rss_kib"))
