"""Statistics of metrics: summaries, exact quantiles with outer fences, histograms, the largest vertices and clusters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def summary(vertices: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, count, mean, max, min, variance, non_zeros), in one pass over the vertices; variance is the sample's."""
    fields = {"count": F.count, "mean": F.avg, "max": F.max, "min": F.min, "variance": F.var_samp, "non_zeros": lambda c: F.count_if(c != 0)}
    one = vertices.agg(*(f(F.col(m).cast("double")).alias(f"{m}|{n}") for m in metrics for n, f in fields.items()))
    rows = [F.struct(F.lit(m).alias("metric"), *(F.col(f"{m}|{n}").alias(n) for n in fields)) for m in metrics]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def ranked(df: DataFrame, column: str, tie: str = "id") -> DataFrame:
    """The rows with `rank`, their place from 0 in the order of a column. Ranges are ranked side by side: no task sees all rows."""
    placed = cut(df.repartitionByRange(column, tie).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(column, tie))
    # a row for each range, of which there are as many as shuffle partitions
    return placed.withColumn("_row", within).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_row") - 1).drop("_part", "_before", "_row")


def quantiles(vertices: DataFrame, metric: str, q: int) -> DataFrame:
    """(position, value): where each of q equal shares of the ordered values begins; nothing if there are fewer than q values."""
    rows = vertices.where(F.col(metric).isNotNull()).select("id", metric)
    n = rows.count()
    step = n // q
    if not step:
        return rows.limit(0).select(F.lit(0).alias("position"), F.col(metric).alias("value"))
    at = ranked(rows, metric).where((F.col("rank") % step == 0) & (F.col("rank") < step * q))
    return at.select((F.col("rank") / step).cast("int").alias("position"), F.col(metric).alias("value"))


def fences(values: DataFrame, q: int) -> DataFrame:
    """(low, high): the outer fences, three quartile distances beyond the quartiles; only where q is a multiple of four."""
    if q % 4:
        return values.limit(0).select(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    pick = {k: F.max(F.when(F.col("position") == p, F.col("value").cast("double"))) for k, p in (("q1", q // 4), ("q3", 3 * q // 4))}
    one = values.agg(*(c.alias(k) for k, c in pick.items()))
    far = 3 * F.abs(F.col("q3") - F.col("q1"))
    return one.select(F.coalesce(F.col("q1") - far, F.lit(0.0)).alias("low"), F.coalesce(F.col("q3") + far, F.lit(0.0)).alias("high"))


def percentiles(vertices: DataFrame, metric: str) -> DataFrame:
    return quantiles(vertices, metric, 100)


def histogram(vertices: DataFrame, metric: str, bins: int = 100, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, start, n) of equal bins from 1; values outside are left out, the last bin includes its end. Without bounds the outer fences
    are taken, or the least and the largest value where the fences fall together."""
    if low is None or high is None:
        f = fences(percentiles(vertices, metric), 100).head()
        low, high = (float(f["low"]), float(f["high"])) if f else (0.0, 0.0)
        if low == high:
            e = vertices.agg(F.min(metric).alias("a"), F.max(metric).alias("z")).head()
            low, high = float(e["a"] or 0), float(e["z"] or 0)
    x = F.col(metric).cast("double")
    lo, hi = F.lit(float(low)), F.lit(float(high))
    place = F.lit(1) if low == high else F.when(x == hi, bins).otherwise(F.floor((x - lo) * bins / (hi - lo)).cast("int") + 1)
    counts = vertices.where(x.between(lo, hi)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    spark = vertices.sparkSession
    all_bins = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", (lo + (F.col("bin") - 1) * (hi - lo) / bins).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def sign_counts(vertices: DataFrame, metric: str) -> DataFrame:
    """(sign, n): how many values lie below, at and above 0; vertices without a value aren't counted."""
    found = vertices.where(F.col(metric).isNotNull()).groupBy(F.signum(F.col(metric).cast("double")).cast("int").alias("sign")).agg(F.count("*").alias("n"))
    signs = vertices.sparkSession.createDataFrame([(-1,), (0,), (1,)], "sign int")
    return signs.join(found, "sign", "left").select("sign", F.coalesce("n", F.lit(0)).alias("n"))


def top_vertices(vertices: DataFrame, metric: str, k: int = 25) -> DataFrame:
    return vertices.orderBy(F.desc(metric), "id").limit(k)


def clusters(vertices: DataFrame, metric: str) -> DataFrame:
    return vertices.groupBy(F.col(metric).alias("cluster")).agg(F.count("*").alias("n"))


def top_clusters(vertices: DataFrame, metric: str, k: int = 10) -> DataFrame:
    """(cluster, n) of the largest clusters; the number of all clusters is `clusters(...).count()`."""
    return clusters(vertices, metric).orderBy(F.desc("n"), "cluster").limit(k)


def sample_quantiles(values: Sequence[float], probabilities: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> list[float]:
    """Quantiles of a few values in memory: the value at place floor(p n), the last at most."""
    ordered = sorted(values)
    return [ordered[min(int(p * len(ordered)), len(ordered) - 1)] for p in probabilities] if ordered else []


def report(vertices: DataFrame, scalars: Sequence[str], groups: Sequence[str], vertex_count: int, edge_count: int, top: int = 25) -> list[str]:
    """The text of the statistics file. What is collected is bounded: a line for each metric, bin and top entry."""
    out = [f"vertices: {vertex_count}", f"edges: {edge_count}", ""]
    known = {r["metric"]: r for r in summary(vertices, scalars).collect()} if scalars else {}
    for m, r in known.items():
        out.append(f"{m}: " + ", ".join(f"{k}={r[k]}" for k in ("count", "mean", "max", "min", "variance", "non_zeros")))
    for m in scalars:
        shares = cut(percentiles(vertices, m))
        parts = shares.orderBy("position").collect()
        edge = fences(shares, 100).head() if parts else None
        low, high = (edge["low"], edge["high"]) if edge else (0.0, 0.0)
        out += ["", f"{m} percentiles: " + " ".join(str(r["value"]) for r in parts)]
        if edge:
            out.append(f"{m} outer fences: {low} {high}")
        if low == high:
            low, high = known[m]["min"] or 0.0, known[m]["max"] or 0.0
        out.append(f"{m} histogram: " + " ".join(f"{r['start']:g}:{r['n']}" for r in histogram(vertices, m, 100, low, high).orderBy("bin").collect()))
        out.append(f"{m} top: " + " ".join(f"{r['id']}={r[m]}" for r in top_vertices(vertices, m, top).collect()))
    for m in groups:
        found = clusters(vertices, m)
        out += ["", f"{m} clusters: {found.count()}", f"{m} largest: " + " ".join(f"{r['cluster']}={r['n']}" for r in top_clusters(vertices, m).collect())]
    return out


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
