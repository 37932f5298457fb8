"""Wall time by stage, as a context manager and a small table."""

from __future__ import annotations

import resource
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Seconds of each named stage, the driver's peak memory and the executors'."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    @property
    def peak_mb(self) -> float:
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024

    def executors(self, spark: SparkSession) -> DataFrame:
        """(executor, heap_mb, python_mb): each executor's peaks so far, as Spark's own metrics have them (python_mb: 0 unless
        spark.executor.processTreeMetrics.enabled is set); the driver is one of them."""
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        rows = []
        for i in range(found.size()):
            peak = found.apply(i).peakMemoryMetrics()
            heap, python = (peak.get().getMetricValue(k) / 2**20 if peak.isDefined() else 0.0 for k in ("JVMHeapMemory", "ProcessTreePythonRSSMemory"))
            rows.append((found.apply(i).id(), float(heap), float(python)))
        return spark.createDataFrame(rows, "executor string, heap_mb double, python_mb double")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, 1000 * v) for k, v in self.seconds.items()], "stage string, ms double")
