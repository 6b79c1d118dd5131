"""Ranks in a total order, in ranges that are literals of the plan or partitions of a table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sketchfield.operators import growing
from sketchfield.plans.slices import slice_plan


@pytest.mark.parametrize("most", [10_000, 3])
def test_ranks_are_those_of_a_sort(spark, monkeypatch, most):
    monkeypatch.setattr(growing, "RANGE_ROWS", 50)
    monkeypatch.setattr(growing, "MOST_RANGES", most)
    rows = spark.range(1_000, numPartitions=3).select(
        F.when(F.col("id") % 97 == 5, None).otherwise(F.timestamp_seconds((F.col("id") * 7919) % 503)).alias("t"), F.col("id").cast("string").alias("k")
    )
    got = {r["k"]: r["rank"] for r in growing.ranked(rows, ["t", "k"]).collect()}
    want = sorted(((r["t"] is not None, r["t"], r["k"]) for r in rows.collect()), key=lambda x: (x[0], x[1] or 0, x[2]) if x[0] else (False, 0, x[2]))
    assert got == {k: i + 1 for i, (_, _, k) in enumerate(want)}
    assert growing.ranked(rows.limit(0), ["t", "k"]).count() == 0


@pytest.mark.parametrize("before", [0, 700])
def test_slices_of_many_rows_come_of_their_first_arrivals(spark, monkeypatch, before):
    """No row is shuffled or stored to be dealt; ties that a first rank cuts are ranked."""
    rows = spark.range(1_000, numPartitions=3).select(
        F.when(F.col("id") % 97 == 5, None).otherwise(F.timestamp_seconds((F.col("id") * 7919) % 503)).alias("t"), F.col("id").cast("string").alias("k")
    )
    plan = slice_plan(40, 0.05, 1_700)
    want = {r["k"]: r["slice"] for r in growing.ranked(rows, ["t", "k"]).withColumn("slice", growing.slice_of(F.col("rank") + before, plan)).collect()}
    monkeypatch.setattr(growing, "RANGE_ROWS", 50)
    monkeypatch.setattr(growing, "_SAMPLED", 200)
    got = growing.assigned(rows, ["t", "k"], plan, before=before)
    assert {r["k"]: r["slice"] for r in got.collect()} == want
    plan_text = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan_text and "FileScan" not in plan_text
    tied = growing.assigned(rows.withColumn("t", F.lit(1)), ["t"], plan, before=before)
    assert sorted(r["slice"] for r in tied.collect()) == sorted(want.values())
