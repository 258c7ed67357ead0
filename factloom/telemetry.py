"""Counters and timings of runs: observed while facts are written, so counting costs no job of its own."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factloom.sources.workspace import local


class Telemetry:
    """``counters``: numbers by name; ``spans``: (name, subject, seconds)."""

    def __init__(self) -> None:
        self.spans: list[tuple[str, str, float]] = []
        self._observed: list[Observation] = []
        self._runs: list[DataFrame] = []
        self._lock = threading.Lock()

    def observed(self, merged: DataFrame) -> DataFrame:
        """The frame, which counts its facts and those whose last change is an addition when it is written."""
        seen = Observation()
        self._observed.append(seen)
        return merged.observe(seen, F.count(F.lit(1)).alias("facts"), F.count_if(F.col("updated_rev") > F.col("added_rev")).alias("updated"))

    def count_runs(self, log: DataFrame) -> None:
        """Remembers a step's run log; it is counted when somebody asks."""
        self._runs.append(log)

    @contextmanager
    def timed(self, name: str, subject: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            with self._lock:
                self.spans.append((name, subject, time.monotonic() - began))

    def counters(self) -> dict[str, int]:
        """Facts after each merge's last, how many were refreshed, merges, and runs by operator and outcome."""
        out: Counter = Counter(merges=len(self._observed))
        if self._observed:
            last = self._observed[-1].get
            out["facts"], out["facts_updated"] = last["facts"], last["updated"]
        for log in self._runs:
            for r in log.groupBy("operator_id", "outcome").count().collect():  # a few for each operator
                out[f"runs.{r['operator_id']}.{r['outcome']}"] += r["count"]
        return dict(out)

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, value) of all counters."""
        return local(spark, sorted(self.counters().items()), "name string, value bigint")
