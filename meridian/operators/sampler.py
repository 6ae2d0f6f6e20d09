"""Runtime samples of the driver: one at the start, one each interval, one at the end."""

from __future__ import annotations

import datetime as dt
import os
import threading
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SAMPLE = "ts timestamp, elapsed_seconds double, heap_alloc bigint, heap_sys bigint, heap_inuse bigint, stack_inuse bigint, sys bigint, num_gc int, process_rss_bytes bigint, cpu_percent double, num_goroutine int"


class Sampler:
    """Reads the JVM's and this process's gauges on a thread, between start and stop."""

    def __init__(self, spark: SparkSession, interval: float = 1.0):
        self.spark, self.interval, self.rows = spark, interval, []
        self.ended, self.thread = threading.Event(), None

    def start(self) -> Sampler:
        self.began, self.cpu = time.monotonic(), (time.monotonic(), time.process_time())
        self.sample()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def _run(self) -> None:
        while not self.ended.wait(self.interval):
            self.sample()

    def sample(self) -> None:
        jvm = self.spark._jvm.java.lang.management.ManagementFactory
        heap, other = jvm.getMemoryMXBean().getHeapMemoryUsage(), jvm.getMemoryMXBean().getNonHeapMemoryUsage()
        gcs = jvm.getGarbageCollectorMXBeans()
        now, used = time.monotonic(), time.process_time()
        wall, self.cpu = max(now - self.cpu[0], 1e-9), (now, used) if (busy := used - self.cpu[1]) >= 0 else self.cpu
        with open("/proc/self/statm") as f:
            rss = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
        self.rows.append((dt.datetime.now(), now - self.began, heap.getUsed(), heap.getCommitted(), heap.getUsed(), other.getUsed(), heap.getCommitted() + other.getCommitted(), sum(gcs.get(i).getCollectionCount() for i in range(gcs.size())), rss, 100 * busy / wall, jvm.getThreadMXBean().getThreadCount()))

    def stop(self) -> DataFrame:
        """The samples; a last one is taken first."""
        self.ended.set()
        if self.thread is not None:
            self.thread.join()
        self.sample()
        return self.spark.createDataFrame(self.rows, SAMPLE)


def observed(rows: DataFrame, name: str, **values) -> tuple[DataFrame, Observation]:
    """The rows as they are, with counters that are filled while they are first computed."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in values.items()]), seen


def partitions_for(n: int, rows_each: int, cores: int) -> int:
    """How many parts a batch of n rows is worth: at least two, at most half the cores."""
    if rows_each <= 0:
        raise ValueError("rows_each must be positive")
    return max(1, min(max(2, n // rows_each), max(1, cores // 2)))
