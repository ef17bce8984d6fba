"""Sweeps of checks that stand on their own: each is a Spark job, all run side by side, and one that fails spoils no other."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

RESULT = "stage string, ok boolean, value long, error string, status string"


class Sweep:
    """Registered stages, each a function that returns how many rows it reconciled; a sweep doesn't begin before the last has
    ended."""

    def __init__(self, spark: SparkSession, side_by_side: int = 4):
        self.spark, self.side_by_side = spark, side_by_side
        self._stages: dict[str, Callable[[], int]] = {}
        self._busy = threading.Lock()
        self.last_status: str | None = None

    def register(self, stage: str, run: Callable[[], int]) -> None:
        if stage in self._stages:
            raise ValueError(f"stage {stage} is registered already")
        self._stages[stage] = run

    def run(self) -> DataFrame | None:
        """A row for each stage: whether it went through, its value or its error, and the status of the whole: ok, partial, failed.
        None where another sweep is under way."""
        if not self._busy.acquire(blocking=False):
            return None
        try:
            with ThreadPoolExecutor(self.side_by_side) as pool:
                ends = [(stage, pool.submit(run)) for stage, run in self._stages.items()]
            rows = [(stage, e.exception() is None, None if e.exception() else int(e.result()), type(e.exception()).__name__ if e.exception() else None) for stage, e in ends]
            fine = sum(r[1] for r in rows)
            self.last_status = "ok" if fine == len(rows) else "partial" if fine else "failed"
            return self.spark.createDataFrame([(*r, self.last_status) for r in rows], RESULT)
        finally:
            self._busy.release()
