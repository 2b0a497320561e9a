"""What was frozen, in which order things happened, and whether stored figures still hold."""

from __future__ import annotations

import json
import os
import platform

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.operators.integrity import canonical_json, seal
from pairlight.sources.files import write_json


def frozen(config: DataFrame, key: str) -> DataFrame:
    """key and the hash of each row's canonical form: what later rows are held against."""
    return config.select(key, seal(canonical_json(config, config.columns)).alias("frozen_sha256"))


def drift(freeze: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """key, frozen_sha256, state: same, drifted or missing."""
    seen = frozen(now, key).withColumnRenamed("frozen_sha256", "now_sha256")
    state = F.when(F.col("now_sha256").isNull(), "missing").when(F.col("now_sha256") != F.col("frozen_sha256"), "drifted").otherwise("same")
    return freeze.join(seen, key, "left").select(key, "frozen_sha256", state.alias("state"))


def materialise(inputs: DataFrame, path: str, exists: bool) -> DataFrame:
    """Write the inputs once; where they exist already they must hold the same rows, or nothing goes on."""
    if not exists:
        inputs.write.parquet(path)
    there = inputs.sparkSession.read.schema(inputs.schema).parquet(path)
    if exists and (there.exceptAll(inputs).limit(1).count() or inputs.exceptAll(there).limit(1).count()):
        raise ValueError(f"the inputs under {path} differ from those of this run")
    return there


def chronology(rows: DataFrame, pairs: list[tuple[str, str, bool]], names: dict[str, str] | None = None, labels: dict[int, str] | None = None) -> DataFrame:
    """Adds ``broken``: for each (earlier, later, strictly) the rule's name where the order doesn't hold or a time is missing."""
    names, labels = names or {}, labels or {}
    rules = []
    for i, (a, b, strictly) in enumerate(pairs):
        holds = F.col(a) < F.col(b) if strictly else F.col(a) <= F.col(b)
        label = labels.get(i, f"{names.get(a, a)}{'<' if strictly else '<='}{names.get(b, b)}")
        rules.append(F.when(F.coalesce(holds, F.lit(False)), F.lit(None)).otherwise(F.lit(label)))
    return rows.withColumn("broken", F.array_compact(F.array(*rules)))


def positional(records: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: records that stand at no expected ordinal or at another case's, repeats, and whether they are a valid prefix."""
    met = records.select("ordinal", F.col(key).alias("own")).join(expected.select("ordinal", F.col(key).alias("due")), "ordinal", "left")
    n, distinct = F.count("*"), F.countDistinct("ordinal")
    wrong = F.count_if(F.col("due").isNull() | (F.col("due") != F.col("own")))
    prefix = (F.coalesce(F.max("ordinal") + 1, F.lit(0)) == n) & (distinct == n) & (wrong == 0)
    return met.agg(n.alias("records"), F.count_if(F.col("due").isNull()).alias("extra"), F.count_if(F.col("due") != F.col("own")).alias("wrong_id"), (n - distinct).alias("repeated"), prefix.alias("valid_prefix"))


def first_of(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each category: a report of bounded size, found by a limited window."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def _number(text: Column) -> Column:
    """An integer of one to nine digits with an optional sign, read without a grammar; null otherwise."""
    sign = F.substring(text, 1, 1).isin("+", "-")
    digits = F.when(sign, F.substring(text, 2, 1000)).otherwise(text)
    whole = F.length(digits).between(1, 9) & (F.length(F.translate(digits, "0123456789", "")) == 0)
    return F.when(whole, F.concat(F.when(sign & text.startswith("-"), F.lit("-")).otherwise(F.lit("")), digits).try_cast("long"))


def read_plainly(text: Column, expression: Column) -> Column:
    """The candidate answer by prefixes and splits: a second reading to hold the scorer's grammar against."""
    blank = " \t\n\r\f\x0b"
    t = F.btrim(text, F.lit(blank))
    spare = F.when(t.endswith("."), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    low = F.lower(spare)
    label = F.when(low.startswith("answer:"), _number(F.ltrim(F.substring(spare, 8, 1000), F.lit(blank))))
    said = F.substring(spare, 14, 1000)
    sentence = F.when(low.startswith("the answer is") & (F.ltrim(said, F.lit(blank)) != said), _number(F.ltrim(said, F.lit(blank))))
    sides = F.split(spare, "=", -1)
    left = F.translate(F.get(sides, 0), blank, "")
    equal = F.when((F.size(sides) == 2) & (left == F.translate(expression, " ", "")) & ~F.get(sides, 0).rlike(r"[0-9][ \t\n\r\f\x0b]+[0-9]"), _number(F.ltrim(F.get(sides, 1), F.lit(blank))))
    return F.coalesce(_number(t), label, sentence, equal)


def recount(responses: DataFrame) -> DataFrame:
    """format, n, correct, extracted_wrong, unsupported_nontruncated, by the plain reading."""
    told = responses.withColumn("v", read_plainly(F.col("completion"), F.col("expression"))).withColumn("got", F.col("v").isNotNull() & ~F.col("truncated"))
    right = F.col("got") & (F.col("v") == F.col("answer"))
    return told.groupBy("format").agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(F.col("got") & ~right).alias("extracted_wrong"), F.count_if(~F.col("truncated") & ~F.col("got")).alias("unsupported_nontruncated"))


def allowed(decisions: DataFrame, evidence: list[str]) -> DataFrame:
    """Adds allowed and evidence_sha256, the hash of the decision's canonical form."""
    return decisions.withColumn("evidence_sha256", seal(canonical_json(decisions, evidence))).withColumn("allowed", F.col("decision") == "pass")


def within_budget(sessions: DataFrame, run: str, start: str, seconds: float) -> DataFrame:
    """Adds within_budget: whether a session began no later than ``seconds`` after its run's first."""
    first = sessions.groupBy(run).agg(F.min(start).alias("__first"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    took = (micros(start) - micros("__first")) / F.lit(1e6)
    return sessions.join(first, run).withColumn("within_budget", took <= seconds).drop("__first")


def same_figures(stored: DataFrame, fresh: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key and the columns in which a stored summary differs from a fresh one by more than ``tolerance``; nulls are equal."""
    columns = [c for c in stored.columns if c != key]
    other = fresh.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    near = lambda c: (F.col(c).isNull() & F.col(f"__{c}").isNull()) | F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance, F.lit(False))
    return stored.join(other, key, "left").select(key, F.array_compact(F.array(*(F.when(near(c), F.lit(None)).otherwise(F.lit(c)) for c in columns))).alias("differing"))


def sizes_by_suffix(files: DataFrame) -> DataFrame:
    """suffix, files, bytes of (name, bytes)."""
    suffix = F.when(F.col("name").contains("."), F.substring_index("name", ".", -1)).otherwise(F.lit(""))
    return files.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def environment(spark: SparkSession) -> dict:
    """What a run ran on."""
    return {"spark": spark.version, "python": platform.python_version(), "platform": platform.platform(), "master": spark.sparkContext.master, "cpus": os.cpu_count(), "application": spark.sparkContext.applicationId}


def write_session(spark: SparkSession, folder: str, at: int, state: str, records: int, more: dict) -> str:
    """Metadata of one session, and the run's status beside it, each replaced in one step on the shared file system."""
    name = f"{folder}/session-{at}.json"
    write_json(spark, name, {"state": state, "records": records, **more})
    write_json(spark, f"{folder}/status.json", {"state": state, "records": records, "session": f"session-{at}.json"})
    return name


def sessions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All sessions of a folder with their file names, in order of name."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/session-*.json").withColumn("file", name).orderBy("file")


def print_result(rows: DataFrame) -> None:
    """A small result as one canonical JSON line each."""
    for r in rows.collect():
        print(json.dumps(r.asDict(recursive=True), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str))
