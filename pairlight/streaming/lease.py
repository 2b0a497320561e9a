"""One writer a run, by a lease with a fencing number.

A run's leases are documents ``1.json``, ``2.json``, .. in the shared folder; each can be created once only, and the
highest number is the writer's. It says until when it holds; its holder renews it. A lease that ran out is taken over by
the next number, without handwork, and a holder that was too late finds a higher number than its own and is refused.
Clocks of drivers must agree to within a lease's length.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from pairlight.session import shared_dir
from pairlight.sources.shared import create_once, names, read_document, write_document


class Lease:
    """``take`` it, ``check`` it right before each commit, ``release`` it."""

    def __init__(self, spark: SparkSession, run: str, seconds: float = 600, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.run, self.seconds, self.clock = spark, run, seconds, clock
        self.folder, self.number = f"{shared_dir(spark)}/{run}.leases", 0

    def _entry(self, number: int) -> str:
        return f"{self.folder}/{number}.json"

    def highest(self) -> int:
        return max((int(n.removesuffix(".json")) for n in names(self.folder)), default=0)

    def _terms(self, until: float) -> dict:
        return {"owner": self.spark.sparkContext.applicationId, "until": until}

    def take(self) -> Lease:
        last = self.highest()
        held = read_document(self._entry(last)) if last else None
        if held is not None and held["until"] > self.clock():
            raise ValueError(f"run {self.run} is being written by {held['owner']}, whose lease {last} holds on")
        if not create_once(self.spark, self._entry(last + 1), self._terms(self.clock() + self.seconds)):
            raise ValueError(f"run {self.run} is being written: another writer took lease {last + 1}")
        self.number = last + 1
        return self

    def check(self) -> None:
        """Renew the lease; an error where it ran out or another writer has a higher number."""
        last, now = self.highest(), self.clock()
        held = read_document(self._entry(self.number)) if self.number else None
        if held is None or last != self.number or held["until"] <= now:
            raise ValueError(f"run {self.run}: lease {self.number} is lost, the last one is {last}")
        write_document(self.spark, self._entry(self.number), self._terms(now + self.seconds))

    def release(self) -> None:
        if self.number and self.highest() == self.number:
            write_document(self.spark, self._entry(self.number), self._terms(0.0))
        self.number = 0


@contextmanager
def single_writer(spark: SparkSession, run: str, seconds: float = 600, clock: Callable[[], float] = time.time) -> Iterator[Lease]:
    """The lease of a run for the time of a block."""
    lease = Lease(spark, run, seconds, clock).take()
    try:
        yield lease
    finally:
        lease.release()
