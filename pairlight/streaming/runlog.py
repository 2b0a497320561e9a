"""Append logs: engines, resume, torn tails and incremental scoring.

A run is a table of output rows. The unit of durability is a batch: a micro-batch
is committed whole or not at all, so nothing half-written is ever counted.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions.scoring import grammar_score
from pairlight.operators.integrity import canonical_json, seal, violations
from pairlight.session import stored
from pairlight.sources.linelog import recovered, torn_tails  # noqa: F401  part of this module's interface
from pairlight.sources.shared import file_system
from pairlight.streaming.lease import Lease, single_writer  # noqa: F401

STUB_FIELDS = "completion string, output_tokens int, truncated boolean, elapsed_seconds double"


class StubEngine:
    """Answers by a hash of the prompt; stands in for a model where none is at hand."""

    def run(self, prompt: str) -> dict:
        n = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)
        return {"completion": str(n % 50), "output_tokens": n % 23 + 1, "truncated": n % 23 == 22, "elapsed_seconds": 0.0}


def generate(cases: DataFrame, engine_factory: Callable[[], object] = StubEngine, prompt: str = "prompt", fields: str = STUB_FIELDS) -> DataFrame:
    """``cases`` with what an engine answers. An engine is made once a task and keeps its model there."""
    names = [f.strip().split()[0] for f in fields.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = engine_factory()
        for batch in batches:
            answers = [engine.run(p) for p in batch[prompt]]
            yield batch.assign(**{n: [a[n] for a in answers] for n in names})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema if f.name not in names)
    return cases.select(*(c for c in cases.columns if c not in names)).mapInPandas(run, f"{schema}, {fields}")


def remainder(expected: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Cases without a record yet, in order; at most ``limit`` of them where a checkpoint is asked for."""
    left = expected.join(done.select(key), key, "left_anti")
    return left if limit is None else left.orderBy("ordinal").limit(limit)


def valid_prefix(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row: records, and whether they are the first so many of the expected ones."""
    met = done.select(key).join(expected.select(key, "ordinal"), key, "left")
    return met.agg(F.count("*").alias("records"), ((F.count("ordinal") == F.count("*")) & (F.coalesce(F.max("ordinal") + 1, F.lit(0)) == F.count("*")) & (F.countDistinct("ordinal") == F.count("*"))).alias("prefix"))


def valid_prefixes(records: DataFrame, expected: DataFrame, run: str, ordinal: str, key: str, intact: str) -> DataFrame:
    """A row a run: records, expected, prefix (how many records from the first on are valid), place and cause of the end.

    Causes: a gap, a repeated place, a wrong id, a broken seal, an extra record behind the last that is expected; null
    where a run is complete. Records are counted by place before they meet the expected ones, and a run's end is the
    least bad place, so neither a long run nor one place with many records meets in one task. Null runs are a run;
    records without an ordinal count as records and have no place. A null ``intact`` counts as broken.
    """
    r, o = F.col(f"`{run}`"), F.col(f"`{ordinal}`")
    seen = records.groupBy(r.alias("run_"), o.alias("at_")).agg(F.count("*").alias("n_"), F.min(F.col(f"`{key}`")).alias("id_"), F.min(F.coalesce(F.col(f"`{intact}`"), F.lit(False)).cast("int")).alias("ok_"))
    want = expected.select(r.alias("run"), o.alias("at"), F.col(f"`{key}`").alias("id"))
    both = want.join(seen, F.col("run").eqNullSafe(F.col("run_")) & (F.col("at") == F.col("at_")), "full")
    cause = F.when(F.col("n_").isNull(), "gap").when(F.col("at").isNull(), "extra").when(F.col("n_") > 1, "repeated").when(~F.col("id").eqNullSafe(F.col("id_")), "wrong_id").when(F.col("ok_") == 0, "broken_seal")
    place = F.coalesce("at", "at_")
    judged = both.select(F.when(F.col("n_").isNull() | F.col("at").isNotNull(), F.col("run")).otherwise(F.col("run_")).alias(run), place.alias("p"), cause.alias("c"), "n_", "at")
    bad = F.min(F.when(F.col("c").isNotNull() & F.col("p").isNotNull(), F.struct("p", "c")))
    out = judged.groupBy(run).agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("records"), F.count("at").alias("expected"), bad.alias("bad"), F.min("at").alias("first"))
    return out.select(run, "records", "expected", F.when(F.col("bad").isNull(), F.col("expected")).otherwise(F.greatest(F.col("bad.p") - F.coalesce(F.col("first"), F.col("bad.p")), F.lit(0))).alias("prefix"), F.col("bad.p").alias("place"), F.col("bad.c").alias("cause"))


def append_available(source: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Append what a streaming source has that the checkpoint hasn't seen, then stop: a resumed run does no work twice."""
    query = transform(source).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def write_run(cases: DataFrame, path: str, key: str, step: int, engine_factory: Callable[[], object] = StubEngine, rules: dict | None = None, started: float | None = None, budget: float | None = None, stop: Callable[[], bool] = lambda: False, limit: int | None = None, clock: Callable[[], float] = time.time, lease: Lease | None = None) -> tuple[str, int]:
    """Answer what ``path`` hasn't answered yet, ``step`` cases at a time, and append each part sealed and validated.

    ``cases`` have an ordinal. Before each part it is asked whether to stop, whether ``budget`` seconds have passed
    since ``started`` (the run's first start, so a restart gains no time) and whether ``limit`` new records are made. A
    part is committed whole or not at all; one that breaks a rule fails and isn't appended. A ``lease`` is renewed right
    before each commit, and a part whose writer lost it is refused. Returns state and exit code.
    """
    spark = cases.sparkSession
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema), STUB_FIELDS, "record_sha256 string"])
    done = lambda: spark.read.schema(fields).parquet(path)
    if not there(path):
        spark.createDataFrame([], fields).write.parquet(path)
    expected, made = cases.count(), 0
    completed = done().count()
    while completed < expected:
        late = budget is not None and started is not None and clock() - started >= budget
        if stop() or late or (limit is not None and made >= limit):
            return run_state(completed, expected, cancelled=stop(), deadline_passed=late)
        wanted = step if limit is None else min(step, limit - made)
        part = stored(generate(remainder(cases, done(), key, wanted), engine_factory), "run-part")
        sealed = part.withColumn("record_sha256", seal(canonical_json(part, [c for c in part.columns if c != "elapsed_seconds"])))
        broken = part.where(F.size(violations(rules or {})) > 0).count()
        if broken:
            raise ValueError(f"{broken} records break a rule")
        if lease is not None:
            lease.check()
        sealed.write.mode("append").parquet(path)
        n = part.count()
        made, completed = made + n, completed + n
    return run_state(completed, expected)


def there(path: str) -> bool:
    """Whether a folder has been written, on any file system that Spark's shared folder may be on."""
    system, where = file_system(path)
    return system.get_file_info(where).type != fs.FileType.NotFound


def capped(outputs: DataFrame, cap: int, eos: str = "ended_with_eos") -> DataFrame:
    """Outputs under a cap of ``cap`` tokens: truncated and scores are recomputed, whatever the engine said."""
    judged = outputs.withColumn("truncated", (F.col("output_tokens") >= cap) & ~F.col(eos))
    return judged.withColumns(grammar_score(F.col("completion"), F.col("expression"), F.col("answer"), F.col("format"), F.col("truncated")))


def run_state(completed: int, expected: int, cancelled: bool = False, deadline_passed: bool = False, failed: bool = False) -> tuple[str, int]:
    """State and exit code of a run."""
    if failed:
        return "error", 1
    if completed == expected:
        return "complete", 0
    return "cancelled" if cancelled else "budget_exhausted" if deadline_passed else "checkpoint", 2
