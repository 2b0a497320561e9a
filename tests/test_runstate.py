"""Run states over a stream, against a plain pass over the same batches."""

from collections import defaultdict
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow.parquet as pq

from pairlight.plans import catalog
from pairlight.streaming import runstate

DAY = 86_400_000_000


def test_advance():
    at = lambda *t: np.array(t, "int64")
    assert runstate.advance(None, 0, "checkpoint", at(), 10, 3) == (None, 0, "checkpoint")
    assert runstate.advance(None, 0, "checkpoint", at(7, 5), 10, 3) == (5, 2, "checkpoint")
    assert runstate.advance(5, 2, "checkpoint", at(15, 99), 10, 3) == (5, 3, "complete")
    assert runstate.advance(5, 2, "checkpoint", at(16), 10, 3) == (5, 2, "budget_exhausted")
    assert runstate.advance(5, 2, "budget_exhausted", at(6), 10, 3) == (5, 2, "budget_exhausted")


def test_restarts_nulls_and_timers(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    t0 = datetime(2024, 1, 1, tzinfo=UTC)
    hour = lambda h: t0 + timedelta(hours=h)
    schema = "run long, at timestamp, state string"
    batches = [
        [(1, hour(0), "x"), (1, hour(0), "x"), (2, hour(1), "x"), (None, hour(1), "x"), (4, None, "x")],
        [(1, hour(5), "x"), (2, hour(30), "x"), (None, None, "x"), (3, hour(30), "x")],
        [(5, hour(200), "x"), (1, hour(200), "x")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):  # a start that finds nothing new changes nothing
            runstate.append_states(runstate.run_states(spark.readStream.schema(schema).parquet(src), "run", "at", 86_400, 3), out, mark)
    micros = lambda h: int(hour(h).timestamp()) * 1_000_000
    assert {r.run: tuple(r)[1:] for r in runstate.latest_states(spark, out, "run").collect()} == {
        1: (micros(0), 4, 3, "complete"),
        2: (micros(1), 2, 1, "budget_exhausted"),  # by a late record
        3: (micros(30), 1, 1, "budget_exhausted"),  # by the timer alone
        None: (micros(1), 2, 1, "budget_exhausted"),
        4: (None, 1, 0, "checkpoint"),  # no time, no start
        5: (micros(200), 1, 1, "checkpoint"),
    }


def test_the_query_against_the_table(spark):
    sf = "/root/testdata/sf0.001"
    runs = defaultdict(list)
    for e in pq.read_table(f"{sf}/events.parquet", columns=["user_id", "ts"]).to_pylist():
        runs[e["user_id"]].append(round(e["ts"].replace(tzinfo=UTC).timestamp() * 1e6))
    last, want = max(t for times in runs.values() for t in times), {}
    for run, times in runs.items():
        start = min(times)
        inside = sum(t <= start + 2 * DAY for t in times)
        over = inside < len(times) or start + 2 * DAY < last - 3_600_000_000
        want[run] = (start, len(times), min(inside, 20), "complete" if inside >= 20 else "budget_exhausted" if over else "checkpoint")
    got = {r.user_id: tuple(r)[1:] for r in catalog.QUERIES["run_states"](spark, sf).collect()}
    assert got == want
