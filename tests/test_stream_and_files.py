"""Edges from a stream, files joined from parts, samples and statistics."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import statistics
from graphloom.operators.partition import input_partitioned
from graphloom.plans import adapters
from graphloom.session import file_system, listed
from graphloom.sinks.text import merge_files, save_sections
from graphloom.sources.items import sampled
from graphloom.streaming.edges import add_batch, current_edges, keep_edges

EDGES = "src long, dst long, weight long"


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), EDGES)


def got(spark, folder):
    return sorted(tuple(r) for r in current_edges(spark, folder).collect())


def test_every_micro_batch_counts_once(spark, tmp_path):
    folder = f"file:{tmp_path}/kept"
    for k in range(5):
        edges(spark, (1, 2, 1), (k, 9, 2), (k, 9, 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for _ in range(2):  # the second run finds nothing new
        keep_edges(spark.readStream.schema(EDGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), folder, f"{tmp_path}/state", compact=2).awaitTermination()
    assert got(spark, folder) == [(0, 9, 3), (1, 2, 5), (1, 9, 3), (2, 9, 3), (3, 9, 3), (4, 9, 3)]
    assert sum(n.startswith("batch=") for n in listed(spark, folder)) <= 1


def test_a_batch_that_runs_again_and_one_that_lacks(spark, tmp_path):
    folder = str(tmp_path / "kept")
    assert got(spark, folder) == []
    for k in (0, 0, 1, 1):
        add_batch(edges(spark, (1, 2, 10**k)), k, folder, compact=3)
    assert got(spark, folder) == [(1, 2, 11)]
    with pytest.raises(RuntimeError):
        add_batch(edges(spark, (1, 2, 5)), 3, folder)
    add_batch(edges(spark, (1, 2, 100)), 2, folder, compact=3)
    add_batch(edges(spark, (1, 2, 100)), 2, folder, compact=3)  # is in the base already
    assert got(spark, folder) == [(1, 2, 111)] and listed(spark, folder) == ["base=2"]
    # a table that was not written to its end does not count
    edges(spark, (1, 2, 7)).write.parquet(f"{folder}/batch=3")
    path, fs = file_system(spark, f"{folder}/batch=3/_SUCCESS")
    fs.delete(path, False)
    assert got(spark, folder) == [(1, 2, 111)]


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_sections_in_order(spark, tmp_path, scheme):
    target = f"{scheme}{tmp_path}/deep/x.txt"
    rows = spark.range(1000).repartitionByRange(4, "id").select(F.col("id").cast("string").alias("value"))
    for _ in range(2):  # replaces what is there
        assert save_sections([["head", "é"], rows, ["mid"], rows.limit(0), ["end"]], target) == target
    with open(f"{tmp_path}/deep/x.txt", encoding="utf-8") as f:
        assert f.read().splitlines() == ["head", "é", *map(str, range(1000)), "mid", "end"]
    assert [n for n in listed(spark, f"{tmp_path}/deep")] == ["x.txt"]
    merge_files(spark, [], f"{tmp_path}/deep/empty.txt")
    assert (tmp_path / "deep" / "empty.txt").read_bytes() == b""


def test_samples_are_the_same_each_time(spark, sf_dir):
    items = adapters.event_items(spark, sf_dir).select("item_id")
    one, two, other = ({r.item_id for r in sampled(items, 50, seed=k).collect()} for k in (1, 1, 2))
    assert one == two != other and len(one) == 50
    assert one != set(range(min(one), min(one) + 50))


def test_input_partitions(spark):
    df = spark.range(100).coalesce(1)
    assert input_partitioned(df, 7).rdd.getNumPartitions() == 7 and input_partitioned(df, 0).rdd.getNumPartitions() == 1


def test_histogram_without_bounds(spark):
    values = [*range(1, 200), 10_000]
    df = spark.createDataFrame(list(enumerate(values)), "id long, m long")
    parts = {r.position: r.value for r in statistics.percentiles(df, "m").collect()}
    ordered = sorted(values)
    assert parts == {k: ordered[2 * k] for k in range(100)}
    q1, q3 = parts[25], parts[75]
    low, high = q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)
    want = [0] * 10
    for v in values:
        if low <= v <= high:
            want[min(9, int((v - low) * 10 / (high - low)))] += 1
    rows = sorted(statistics.histogram(df, "m", 10).collect(), key=lambda r: r.bin)
    assert [r.n for r in rows] == want and sum(want) == 199 and rows[0].start == low
    same = spark.createDataFrame([(k, 5) for k in range(150)], "id long, m long")
    assert [r.n for r in sorted(statistics.histogram(same, "m", 3).collect(), key=lambda r: r.bin)] == [150, 0, 0]


def test_quartiles_of_a_small_graph(spark):
    from graphloom.operators import degree
    from graphloom.plans.networks import AuthorNetwork

    from .items import items

    found = statistics.quantiles(degree.degrees(AuthorNetwork().build(items(spark)), ("degree",)), "degree", 4)
    assert [r.value for r in found.orderBy("position").collect()] == [1, 3, 4, 4]
    assert statistics.quantiles(found.withColumnRenamed("position", "id"), "value", 9).count() == 0
