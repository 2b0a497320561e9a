"""States of many runs over a stream of their records.

A run begins with the earliest record of its first micro-batch. It is ``complete`` once ``expected`` records have come
within its budget, ``budget_exhausted`` once a record comes later, or the watermark passes its deadline, before that,
and ``checkpoint`` while neither holds. Both ends are final: what comes afterwards is counted in ``records`` alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "started long, records long, within long, state string, version long"


def advance(start: int | None, within: int, state: str, times: np.ndarray, budget: int, expected: int) -> tuple[int | None, int, str]:
    """A run's start, records within its budget, and state after more records, in microseconds, in any order."""
    if not len(times) or state != "checkpoint":
        return start, within, state
    start = int(times.min()) if start is None else start
    inside = int((times <= start + budget).sum())
    within = min(within + inside, expected)
    return start, within, "complete" if within >= expected else "budget_exhausted" if inside < len(times) else state


def run_states(records: DataFrame, run: str, at: str, budget: int, expected: int, lateness: str = "1 hour") -> DataFrame:
    """Streaming (run, started, records, within, state, version): a row for each micro-batch that touches a run, the highest version last.

    ``budget`` in seconds. Times are microseconds. A null run is a run; a record without a time counts in ``records``
    alone. Records older than the watermark are dropped by Spark. State is four numbers and a word a run; a task holds 8
    bytes for each record that one run has in one micro-batch, so the source's limit a trigger bounds it.
    """
    kind = records.schema[run].dataType.simpleString()
    limit = budget * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, seen, within, word, version = state.get if state.exists else (None, 0, 0, "checkpoint", 0)
        if state.hasTimedOut:
            word = "budget_exhausted"
        else:
            found = []
            for batch in batches:
                seen += len(batch)
                found.append(batch["micros"].dropna().to_numpy(dtype="int64"))
            start, within, word = advance(start, within, word, np.concatenate(found) if found else np.empty(0, "int64"), limit, expected)
        mark = state.getCurrentWatermarkMs()
        if word == "checkpoint" and start is not None:
            # The first whole millisecond behind the deadline.
            deadline = (start + limit) // 1000 + 1
            if deadline <= mark:
                word = "budget_exhausted"
            else:
                state.setTimeoutTimestamp(deadline)
        version += 1
        state.update((start, seen, within, word, version))
        yield pd.DataFrame({run: [key[0]], "started": pd.array([start], "Int64"), "records": [seen], "within": [within], "state": [word], "version": [version]})

    timed = records.select(F.col(f"`{run}`").alias(run), F.unix_micros(F.col(f"`{at}`").cast("timestamp")).alias("micros"), F.col(f"`{at}`").cast("timestamp").alias("at_"))
    out = f"`{run}` {kind}, started long, records long, within long, state string, version long"
    return timed.withWatermark("at_", lateness).groupBy(run).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def append_states(states: DataFrame, path: str, checkpoint: str) -> None:
    """Append what has changed since the checkpoint, then stop; a run of this that was cut off is taken up where its checkpoint ends."""
    states.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_states(spark: SparkSession, path: str, run: str, kind: str = "long") -> DataFrame:
    """The last row of each run."""
    columns = ["started", "records", "within", "state"]
    rows = spark.read.schema(f"`{run}` {kind}, started long, records long, within long, state string, version long").parquet(path)
    return rows.groupBy(run).agg(F.max(F.struct("version", *columns)).alias("last")).select(run, *(f"last.{c}" for c in columns))
