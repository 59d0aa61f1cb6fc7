"""How often and how long each event ran, in all and at each step."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Timers:
    def __init__(self):
        self.rows: list[tuple[str, int | None, float]] = []

    @contextmanager
    def event(self, name: str, step: int | None = None):
        """Time a block; it counts if it fails, too."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, step, time.perf_counter() - began))

    def discrete(self, spark: SparkSession) -> DataFrame:
        """(event, step, seconds): every run of every event."""
        return spark.createDataFrame(self.rows, "event string, step int, seconds double")

    def totals(self, spark: SparkSession) -> DataFrame:
        """(event, runs, seconds, longest) of each event."""
        return self.discrete(spark).groupBy("event").agg(F.count("*").alias("runs"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"))
