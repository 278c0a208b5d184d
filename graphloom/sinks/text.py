"""One text file from ordered parts, on any file system that the cluster reaches. Executors write the parts; the driver only joins them,
and where the file system can join files itself, no byte passes through it."""

from __future__ import annotations

import uuid

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession

from ..session import file_system, listed


def merge_files(spark: SparkSession, parts: list[str], target: str) -> None:
    """Files, in order, as one file; replaces the target."""
    path, fs = file_system(spark, target)
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    temporary = of(f"{target}.{uuid.uuid4().hex[:8]}.tmp")
    if parts:
        fs.rename(of(parts[0]), temporary)
    else:
        fs.create(temporary).close()
    if len(parts) > 1:
        rest = spark.sparkContext._gateway.new_array(of, len(parts) - 1)
        for k, part in enumerate(parts[1:]):
            rest[k] = of(part)
        try:
            fs.concat(temporary, rest)
        except UnsupportedOperationException:
            _copied(spark, fs, temporary, rest)
    fs.delete(path, False)
    if not fs.rename(temporary, path):
        raise OSError(f"{target} can't be written")


def _copied(spark: SparkSession, fs, first, rest) -> None:
    """The first file followed by the others, byte by byte."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    whole = jvm.org.apache.hadoop.fs.Path(f"{first.toString()}.whole")
    out = fs.create(whole, True)
    try:
        for part in [first, *rest]:
            source = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            finally:
                source.close()
    finally:
        out.close()
    fs.delete(first, False)
    fs.rename(whole, first)


def save_sections(sections: list[DataFrame | list[str]], target: str, spark: SparkSession | None = None) -> str:
    """Frames of one text column, and lists of lines, one after the other in one file. Each frame is written by the executors to a
    folder beside the target and then joined, so the order of sections never rests on the order of a union."""
    spark = spark or next(s.sparkSession for s in sections if isinstance(s, DataFrame))
    work = f"{target}.{uuid.uuid4().hex[:8]}.parts"
    root, fs = file_system(spark, work)
    parts: list[str] = []
    try:
        for k, section in enumerate(sections):
            if isinstance(section, list):
                parts.append(f"{work}/lines-{k:05d}")
                out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parts[-1]), True)
                out.write(bytearray("".join(line + "\n" for line in section).encode()))
                out.close()
            else:
                section.write.text(f"{work}/{k}")
                parts += [f"{work}/{k}/{name}" for name in listed(spark, f"{work}/{k}") if name.startswith("part-")]
        merge_files(spark, parts, target)
    finally:
        fs.delete(root, True)
    return target
