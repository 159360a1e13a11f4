"""Runtime statistics of a scorer: calls, total, largest and average time, by stage."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Stats:
    """Counters that any thread may add to.  A stage's share is of all stages' time."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.reset()

    def reset(self) -> None:
        with self._lock:
            self._stages: dict[str, list[float]] = {}
            self.counts: dict[str, int] = {}

    def add(self, stage: str, ms: float) -> None:
        with self._lock:
            s = self._stages.setdefault(stage, [0, 0.0, 0.0])
            s[0], s[1], s[2] = s[0] + 1, s[1] + ms, max(s[2], ms)

    def count(self, **rows: int) -> None:
        with self._lock:
            for name, n in rows.items():
                self.counts[name] = self.counts.get(name, 0) + int(n or 0)

    @contextmanager
    def timed(self, stage: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.add(stage, 1000 * (time.perf_counter() - start))

    def snapshot(self) -> dict[str, dict[str, float]]:
        """{stage: calls, total_ms, max_ms, average_ms, share}."""
        with self._lock:
            whole = sum(s[1] for s in self._stages.values()) or 1.0
            return {k: {"calls": n, "total_ms": t, "max_ms": m, "average_ms": t / n, "share": 100 * t / whole} for k, (n, t, m) in self._stages.items()}

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, *v.values()) for k, v in self.snapshot().items()]
        return spark.createDataFrame(rows, "stage string, calls long, total_ms double, max_ms double, average_ms double, share double")


class ProgressStats(StreamingQueryListener):
    """Adds the phases of each micro-batch that Spark itself reports to ``stats``."""

    def __init__(self, stats: Stats) -> None:
        self.stats = stats

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.stats.count(batches=1, input_rows=event.progress.numInputRows)
        for phase, ms in (event.progress.durationMs or {}).items():
            if phase != "triggerExecution":  # the sum of the others
                self.stats.add(phase, float(ms))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
