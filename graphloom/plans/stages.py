"""What the stages of a session did: for each a row, with the spread of its tasks' times and bytes, out of Spark's own status store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..functions.scalar import size_text, time_text

QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
SCHEMA = "stage int, attempt int, name string, tasks int, failed int, run_ms long, gc_ms long, shuffle_read long, shuffle_write long, spilled long, run_ms_spread array<double>, shuffle_read_spread array<double>"


def stage_rows(spark: SparkSession, quantiles: Sequence[float] = QUANTILES) -> list[tuple]:
    """A tuple of SCHEMA for each stage that ran and that the store still has (spark.ui.retainedStages)."""
    sc = spark.sparkContext
    store, places = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, len(quantiles))
    for k, q in enumerate(quantiles):
        places[k] = q
    stages, out = sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, places, sc._jvm.java.util.ArrayList())), []
    for s in stages:
        if s.numCompleteTasks() + s.numFailedTasks() == 0:
            continue
        spread = store.taskSummary(s.stageId(), s.attemptId(), places)
        each = [[], []]
        if spread.isDefined():
            d = spread.get()
            each = [[float(x) for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(c)] for c in (d.executorRunTime(), d.shuffleReadMetrics().readBytes())]
        out.append((s.stageId(), s.attemptId(), s.name(), s.numTasks(), s.numFailedTasks(), s.executorRunTime(), s.jvmGcTime(), s.shuffleReadBytes(), s.shuffleWriteBytes(), s.diskBytesSpilled(), *each))
    return sorted(out)


def stage_report(spark: SparkSession) -> str:
    """The same as lines of text."""
    lines = []
    for stage, attempt, name, tasks, failed, ms, gc, read, wrote, spilled, spread, _ in stage_rows(spark):
        lines.append(f"stage {stage}.{attempt} {name}: {tasks} tasks, {failed} failed, {time_text(ms)} (collecting garbage {time_text(gc)}), read {size_text(read)}, wrote {size_text(wrote)}, spilled {size_text(spilled)}")
        if spread:
            lines.append("  a task: " + ", ".join(f"{q:.0%} {time_text(x)}" for q, x in zip(QUANTILES, spread)))
    return "\n".join(lines)
