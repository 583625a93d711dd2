"""Latency histograms, percentiles and throughput as benchmark reports state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def histogram(samples: DataFrame, width: int, buckets: int, ns: str = "ns") -> DataFrame:
    """(bucket, n, total, most) of samples; the last bucket takes what lies beyond."""
    bucket = F.least(F.floor(F.col(ns) / width), F.lit(buckets - 1)).cast("long")
    return samples.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(ns).alias("total"), F.max(ns).alias("most"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """The histogram of all samples, from those of the parts."""
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))


def percentiles(hist: DataFrame, width: int, shares: list[float]) -> DataFrame:
    """(share, ns): the lower bound of the bucket that holds sample number ceil(n * share), the
    first at least. Not an interpolation."""
    # as many rows as the histogram has buckets, which its definition bounds
    run = hist.select("bucket", F.sum("n").over(Window.orderBy("bucket")).alias("run"), F.sum("n").over(Window.partitionBy()).alias("all"))
    wanted = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    reached = run.select("bucket", "run", "all", wanted).where(F.col("run") >= F.greatest(F.lit(1), F.ceil(F.col("all") * F.col("share"))))
    return reached.groupBy("share").agg((F.min("bucket") * width).cast("long").alias("ns"))


def summary(hist: DataFrame, width: int, buckets: int) -> DataFrame:
    """One row: n, mean_ns (integer division), max_ns, overflow."""
    return hist.agg(
        F.sum("n").alias("n"),
        F.expr("sum(total) div sum(n)").alias("mean_ns"),
        F.max("most").alias("max_ns"),
        (F.max("most") >= buckets * width).alias("overflow"),
    )


def ops_per_second(ops: Column, wall_ns: Column) -> Column:
    return F.when(wall_ns == 0, F.lit(0.0)).otherwise(ops * F.lit(1e9) / F.when(wall_ns != 0, wall_ns))


def ratio_words(ours: float, theirs: float, more_is_better: bool = True) -> str:
    """How much faster or slower one figure is than another, in words."""
    if not ours or not theirs:
        return "n/a"
    x = ours / theirs if more_is_better else theirs / ours
    return f"{x:.2f}x faster" if x >= 1 else f"{1 / x:.2f}x slower"


def misaligned(ours: dict, theirs: dict, keys: tuple[str, ...] = ("dim", "base", "queries", "k", "ef_search", "ef_construction", "m")) -> list[str]:
    """The parameters in which two reports differ, so that their figures can't be compared."""
    return [f"{k}: {ours.get(k)} and {theirs.get(k)}" for k in keys if ours.get(k) != theirs.get(k)]
