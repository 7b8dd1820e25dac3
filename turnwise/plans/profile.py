"""What a query takes, by Spark's own metrics of its tasks."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """Figures of one run; bytes and seconds, sums over tasks but for the peaks, which are the largest task's."""

    rows: int
    seconds: float
    stages: int
    tasks: int
    task_seconds: float
    cpu_seconds: float
    gc_seconds: float
    peak_memory: int
    shuffled: int
    spilled: int

    def projected(self, times: float, construction: float = 0.0) -> float:
        """Seconds for ``times`` as many rows, and ``construction`` that doesn't grow."""
        return round(self.seconds * times + construction, 6)

    def per_row(self) -> float:
        return self.task_seconds / self.rows if self.rows else 0.0


def measure(df: DataFrame) -> Profile:
    """Run ``df`` to its end, keeping nothing, and tell what its tasks took.

    Rows are counted by an observation on the way; the other figures are those of
    the stages of the jobs that this run began. What was done while ``df`` was made
    (tables written between steps) isn't part of it: use ``measure_made`` for that.
    """
    return measure_made(df.sparkSession, lambda: df)


def measure_made(spark: SparkSession, make) -> Profile:
    """``measure`` of what ``make`` returns, with the jobs that making it begins."""
    context, group = spark.sparkContext, f"profile-{uuid.uuid4().hex}"
    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, "profile")
    began = time.monotonic()
    try:
        seen = Observation()
        make().observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        seconds = time.monotonic() - began
    finally:
        context.setLocalProperty("spark.jobGroup.id", before)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    told, store = context.statusTracker(), context._jsc.sc().statusStore()
    largest = context._gateway.new_array(context._jvm.double, 1)
    largest[0] = 1.0
    stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds if told.getStageInfo(s) is not None}
    run = [d for d in (store.lastStageAttempt(s) for s in sorted(stages)) if d.numCompleteTasks()]
    peak = 0
    for d in run:
        of = store.taskSummary(d.stageId(), d.attemptId(), largest)
        if of.isDefined():
            peak = max(peak, int(of.get().peakExecutionMemory().apply(0)))
    total = lambda f: sum(f(d) for d in run)
    return Profile(
        rows=seen.get["rows"], seconds=round(seconds, 6), stages=len(run), tasks=total(lambda d: d.numCompleteTasks()),
        task_seconds=total(lambda d: d.executorRunTime()) / 1e3, cpu_seconds=total(lambda d: d.executorCpuTime()) / 1e9,
        gc_seconds=total(lambda d: d.jvmGcTime()) / 1e3, peak_memory=peak, shuffled=total(lambda d: d.shuffleWriteBytes()),
        spilled=total(lambda d: d.memoryBytesSpilled() + d.diskBytesSpilled()),
    )
