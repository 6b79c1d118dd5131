"""Observed false-positive rates, latency percentiles, and renderings of statistics."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import PROFILES
from .growing import ranked

PERCENTILES = (0.5, 0.9, 0.95, 0.99, 0.999)
SAMPLES = 100  # that an observed rate needs


def fp_tracker(labelled: DataFrame, expected: float) -> DataFrame:
    """Of rows (maybe, actual): counts, the share of false among positives and among absent keys, and the alert."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    maybe, actual = F.col("maybe"), F.col("actual")
    row = labelled.agg(
        F.count(F.lit(1)).alias("probes"),
        n(maybe).alias("positives"),
        n(maybe & ~actual).alias("false_positives"),
        n(~maybe & actual).alias("false_negatives"),
        n(~actual).alias("absent"),
    )
    fdr = F.when(F.col("positives") == 0, 0.0).otherwise(F.col("false_positives") / F.col("positives"))
    fpr = F.when(F.col("absent") == 0, 0.0).otherwise(F.col("false_positives") / F.col("absent"))
    return row.select(
        "*",
        fdr.alias("discovery_rate"),
        fpr.alias("fpr"),
        ((fpr - expected) / expected * 100).alias("deviation_percent"),
        (F.col("probes") >= SAMPLES).alias("enough"),
        (fpr > 1.5 * expected).alias("alert"),
    )


def sliding_fpr(labelled: DataFrame, order: str, width: int, block: int = 100_000) -> DataFrame:
    """The rate of false positives over the last ``width`` absent keys in an order without ties.

    Rows are numbered in ranges of the order and averaged in blocks; each block gets the last rows of the one before.
    """
    absent = ranked(labelled.where("not actual"), [order], "_n").withColumn("_own", F.expr(f"(_n - 1) div {max(block, width)}"))
    late = F.pmod(F.col("_n") - 1, F.lit(max(block, width))) >= max(block, width) - (width - 1)
    both = absent.withColumn("_block", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = W.partitionBy("_block").orderBy("_n").rowsBetween(1 - width, 0)
    out = both.withColumn("window_fpr", F.avg(F.col("maybe").cast("double")).over(w))
    return out.where("_block = _own").drop("_block", "_own", "_n")


def latency(df: DataFrame, value: Column | str, accuracy: int = 10_000) -> DataFrame:
    """Count, extremes, mean and percentiles; these are values of the table, their ranks exact to one in ``accuracy``.

    Sketches of bounded size are merged, so no task holds the values.
    """
    v = F.col(value) if isinstance(value, str) else value
    return df.agg(
        F.count(v).alias("n"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        *(F.percentile_approx(v, p, accuracy).alias(f"p{f'{p * 100:g}'.replace('.', '_')}") for p in PERCENTILES),
    )


def from_histogram(hist: DataFrame, buckets: int = 64, low: float = 1e-9, high: float = 60.0) -> DataFrame:
    """Percentiles of a ``log_histogram``, interpolated in the bucket's logarithm."""
    step = (math.log(high) - math.log(low)) / buckets
    before = W.partitionBy().orderBy("bucket")  # a row for each bucket
    h = hist.select("bucket", "n", F.sum("n").over(before.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(W.partitionBy()).alias("total"))
    inside = lambda p: F.exp(math.log(low) + (F.col("bucket") + (p * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")) * step)
    at = lambda p: F.min(F.when((F.col("upto") >= p * F.col("total")) & (F.col("upto") - F.col("n") < p * F.col("total")), inside(p)))
    return h.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n"), *(at(p).alias(f"p{f'{p * 100:g}'.replace('.', '_')}") for p in PERCENTILES))


def log_histogram(df: DataFrame, value: str, buckets: int = 64, low: float = 1e-9, high: float = 60.0) -> DataFrame:
    """(bucket, n) in buckets that are equal in the logarithm."""
    x = F.ln(F.greatest(F.least(F.col(value).cast("double"), F.lit(high)), F.lit(low)))
    at = F.least(F.floor((x - math.log(low)) / (math.log(high) - math.log(low)) * buckets), F.lit(buckets - 1))
    return df.where(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def to_json(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct(*row.columns)).alias("json"))


def to_prometheus(row: DataFrame, prefix: str) -> DataFrame:
    """A line ``prefix_name value`` for each numeric column."""
    lines = [F.concat(F.lit(f"# TYPE {prefix}_{c} gauge\n{prefix}_{c} "), F.coalesce(F.col(c).cast("string"), F.lit("NaN"))) for c in row.columns]
    return row.select(F.concat_ws("\n", *lines).alias("text"))


def compare_profiles(df: DataFrame, key: str) -> list[tuple[str, float]]:
    """Seconds that each hash profile takes over the keys, fastest first."""

    def timed(make: Callable[[Column, int, int], Column]) -> float:
        began = time.perf_counter()
        df.select(F.sum(make(F.col(key), 0, 1) % 2)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    return sorted(((name, timed(make)) for name, make in PROFILES.items()), key=lambda x: x[1])


class Metrics:
    """Counts rows, hits and seconds of operations as they run, by an observation of each."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.seconds: dict[str, float] = {}

    def run(self, name: str, df: DataFrame, write: Callable[[DataFrame], None], hit: Column | None = None) -> None:
        seen = Observation()
        began = time.perf_counter()
        write(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((F.lit(True) if hit is None else hit).cast("long")), F.lit(0)).alias("hits")))
        self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
        for k, v in seen.get.items():
            self.counts[f"{name}_{k}"] = self.counts.get(f"{name}_{k}", 0) + v

    def snapshot(self) -> dict[str, float]:
        rates = {f"{n}_rows_per_second": self.counts.get(f"{n}_rows", 0) / s for n, s in self.seconds.items() if s}
        return self.counts | {f"{n}_seconds": s for n, s in self.seconds.items()} | rates
