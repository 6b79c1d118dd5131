"""Buckets of at most d stored keys: exact until a bucket is full, then it answers yes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hashes

DEPTH = 3


def _bucket(key: str, m: int):
    return (hashes(F.col(key), count=1)[0] % m).alias("bucket")


def build(df: DataFrame, key: str, order: str, m: int, depth: int = DEPTH) -> DataFrame:
    """(bucket, key, slot, arrivals, kept): distinct keys by first arrival; the first ``depth`` of a bucket stay.

    Keys are aggregated before their buckets are ranked.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("arrivals"))
    slot = F.row_number().over(W.partitionBy("bucket").orderBy("_first", key))
    return first.select(key, "_first", "arrivals", _bucket(key, m)).withColumn("slot", slot.cast("long")).select(
        "bucket",
        key,
        "slot",
        "arrivals",
        (F.col("slot") <= depth).alias("kept"),
    )


def elements(chains: DataFrame, key: str) -> DataFrame:
    """(bucket, slot, key) of the stored keys; sort by bucket and slot for the order of the table."""
    return chains.where("kept").select("bucket", "slot", key)


def contains(df: DataFrame, key: str, chains: DataFrame, m: int, depth: int = DEPTH) -> DataFrame:
    """(key, stored, maybe) of distinct keys: stored, or in a full bucket."""
    keys = df.where(F.col(key).isNotNull()).select(key).distinct().select(key, _bucket(key, m))
    kept = chains.where("kept")
    full = kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {depth}").select("bucket", F.lit(True).alias("full"))
    out = keys.join(kept.select(key, F.lit(True).alias("stored")), key, "left").join(full, "bucket", "left")
    stored = F.coalesce("stored", F.lit(False))
    return out.select(key, stored.alias("stored"), (stored | F.coalesce("full", F.lit(False))).alias("maybe"))


def statistics(chains: DataFrame, m: int, depth: int = DEPTH) -> DataFrame:
    """One row: chain lengths, load, share of full buckets, discarded arrivals and whether they are too many."""
    per = chains.groupBy("bucket").agg(
        F.sum(F.col("kept").cast("long")).alias("n"),
        F.sum(F.when(~F.col("kept"), F.col("arrivals")).otherwise(0)).alias("lost"),
        F.sum("arrivals").alias("arrivals"),
    )
    return per.agg(
        F.sum("n").alias("stored"), F.avg("n").alias("avg_chain"), F.max("n").alias("max_chain"), (F.count(F.lit(1)) / m).alias("load_factor"), (
            F.sum((F.col("n") >= depth).cast("long")) / m
        ).alias("estimated_fpr"),
        F.sum("lost").alias("discarded"), (F.sum("lost") / F.sum("arrivals") > 0.2).alias("saturated"),
    )
