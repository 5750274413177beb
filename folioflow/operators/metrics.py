"""Rows and milliseconds of each stage of a running search, by observations on what is written, for profiling rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.scratch import kept


class Stages:
    """A log of stages: kept() writes a stage's rows as sources.scratch.kept() does and notes how many they were and how long it took."""

    def __init__(self):
        self.events: list[tuple[str, int, float]] = []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        seen, start = Observation(f"{name}-{len(self.events)}"), time.perf_counter()
        out = kept(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        self.events.append((name, int(seen.get.get("rows", 0)), round((time.perf_counter() - start) * 1000, 1)))
        return out

    def rows(self, spark: SparkSession, search_id: str) -> DataFrame:
        """Rows (job_id, event_index, name, ms, details) as jobs.profiling_rows() has them."""
        given = [(search_id, i, name, ms, {"rows": str(n)}) for i, (name, n, ms) in enumerate(self.events)]
        return spark.createDataFrame(given, "job_id string, event_index int, name string, ms double, details map<string,string>")
