"""Counters of a stage, gathered while it runs, and the times and bytes of the stages of a job."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def metered(frame: DataFrame, name: str, payload: str | None = None) -> tuple[DataFrame, Observation]:
    """The frame and an observation of its rows and, for a binary column, bytes; read it after an action."""
    seen = Observation(name)
    sums = [F.count(F.lit(1)).alias("rows")]
    if payload:
        sums.append(F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).alias("bytes"))
    return frame.observe(seen, *sums), seen


def discard(frame: DataFrame) -> None:
    """Run a plan to its end and keep nothing."""
    frame.write.format("noop").mode("overwrite").save()


@dataclass
class Stage:
    """What Spark counted for one stage; times of tasks are summed over tasks, in seconds."""

    id: int
    name: str
    tasks: int
    seconds: float
    task_seconds: float
    cpu_seconds: float
    rows_in: int
    bytes_in: int
    shuffle_read: int
    shuffle_written: int
    bytes_out: int


@dataclass
class Timing:
    seconds: float = 0.0
    stages: list[Stage] = field(default_factory=list)

    def total(self, name: str) -> float:
        return sum(getattr(s, name) for s in self.stages)


def _stages(spark: SparkSession) -> list:
    jvm = spark.sparkContext._jvm
    found = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


@contextmanager
def timed(spark: SparkSession) -> Iterator[Timing]:
    """Wall time of a block and its finished stages, from the counters that Spark keeps; the driver gets sums only.

    Where several threads share a session, stages of all of them are counted.
    """
    out, known, began = Timing(), {s.stageId() for s in _stages(spark)}, time.monotonic()
    yield out
    out.seconds = time.monotonic() - began
    for s in sorted(_stages(spark), key=lambda s: s.stageId()):
        if s.stageId() in known or s.status().toString() != "COMPLETE":
            continue
        ran = (s.completionTime().get().getTime() - s.submissionTime().get().getTime()) / 1e3
        out.stages.append(
            Stage(s.stageId(), s.name(), s.numTasks(), ran, s.executorRunTime() / 1e3, s.executorCpuTime() / 1e9, s.inputRecords(), s.inputBytes(), s.shuffleReadBytes(), s.shuffleWriteBytes(), s.outputBytes())
        )
