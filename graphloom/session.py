"""Session helpers: the shared folder of the cluster, lineage cuts, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


@contextmanager
def opened_session(name: str, **settings: str) -> Iterator[SparkSession]:
    """The session of the thread, or a new one, which is stopped at the end."""
    there = SparkSession.getActiveSession()
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    spark = there or builder.config(map=settings).getOrCreate()
    try:
        yield spark
    finally:
        if there is None:
            spark.stop()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: `spark.checkpoint.dir`; a local one only where that is unset and there is but one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(f"/tmp/graphloom-{uuid.uuid4().hex[:8]}")
            found = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: the lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def file_system(spark: SparkSession, path: str):
    """A path and its file system, as the JVM has them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The sorted names in a folder; none if it isn't there."""
    path, fs = file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    hadoop, fs = file_system(spark, path)
    fs.delete(hadoop, True)


def cut(df: DataFrame) -> DataFrame:
    """End the lineage with a reliable checkpoint, which keeps how the rows are partitioned."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def renewed(df: DataFrame) -> DataFrame:
    """End the lineage in a loop. A checkpoint passes estimates of its plan on, and the size of a join is the product of its sides', so that
    the digits of these numbers double with every round; here the rows alone are taken over."""
    spark, found = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(found.queryExecution().toRdd(), found.schema(), False), spark)


def observed(df: DataFrame, watch: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """`renewed`, and what aggregates over the rows came to while they were computed."""
    seen = Observation()
    out = renewed(df.observe(seen, *(c.alias(n) for n, c in watch.items())))
    return out, seen.get
