"""Slices that are too large to broadcast, and rows of many ranges: the same results, and tasks that hold no more."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchfield.operators import growing
from sketchfield.plans.slices import slice_plan
from sketchfield.sources.growing_store import GrowingStore


@pytest.fixture
def grown(spark):
    plan = slice_plan(40, 0.05, 900)
    rows = growing.assigned(spark.range(800), ["id"], plan)
    return growing.build(rows, "id", plan), plan


def test_only_slices_beyond_the_bound_are_joined(spark, grown, monkeypatch):
    words, plan = grown
    probes = spark.range(600, 1_600).select(F.when(F.col("id") % 90 != 0, F.col("id")).alias("id"))
    want = sorted(map(tuple, growing.masks(probes, "id", words, plan).collect()), key=repr)
    joined, real = [], growing._joined
    monkeypatch.setattr(growing, "_joined", lambda df, key, words, large: joined.append([s.number for s in large]) or real(df, key, words, large))
    sizes = sorted(s.spec.memory_bytes for s in plan)
    for most in (0, sizes[0], sum(sizes[:-2]), sum(sizes[:-1])):
        assert sorted(map(tuple, growing.masks(probes, "id", words, plan, broadcast_bytes=most).collect()), key=repr) == want
    assert [len(x) for x in joined] == [len(plan), len(plan) - 1, 2, 1] and joined[-1] == [plan[-1].number]
    pairs = {(k, s.number) for k, m in want for s in plan if m >> s.number & 1}
    assert {tuple(r) for r in growing.matches(probes, "id", words, plan, sum(sizes[:-1])).collect()} == pairs


def test_building_holds_no_table_of_positions(grown, monkeypatch):
    """Words come of packed positions, whatever the size of a block, and of no hash table in a task."""
    words, plan = grown
    assert "bit_or" not in words._jdf.queryExecution().toString()
    want = sorted(map(tuple, words.collect()))
    monkeypatch.setattr(growing, "_BLOCK", 8)
    rows = growing.assigned(words.sparkSession.range(800), ["id"], plan)
    assert sorted(map(tuple, growing.build(rows, "id", plan).collect())) == want


def test_rows_of_many_ranges_are_compared_with_few_cuts(spark, monkeypatch):
    monkeypatch.setattr(growing, "RANGE_ROWS", 50)
    ranks = growing.ranked(spark.range(2_000), ["id"])
    assert "lambda" not in ranks._jdf.queryExecution().toString()
    assert ranks.where("rank != id + 1").count() == 0


def test_a_lookup_asks_a_block_in_one_row(spark, grown, monkeypatch):
    """Keys of any type, null among them; rows that are shuffled don't grow with a key's positions, but with bundles and blocks."""
    words, plan = grown
    for kind in ("bigint", "string", "timestamp"):
        probes = spark.range(700, 1_200).select(F.when(F.col("id") % 90 != 0, F.col("id")).cast(kind).alias("id"))
        own = words if kind != "timestamp" else growing.build(growing.assigned(spark.range(800), ["id"], plan).withColumn("id", F.col("id").cast(kind)), "id", plan)
        want = {r["id"]: r["m"] for r in growing.masks(probes, "id", own, plan, "m").collect()}
        monkeypatch.setattr(growing.membership, "BROADCAST_BYTES", 0)
        for block in (8, 22):
            monkeypatch.setattr(growing, "_BLOCK", block)
            assert {r["k"]: r["_more"] for r in growing._joined(probes, "id", own, plan).collect()} == want
            found = growing.provenance(probes, "id", own, plan).collect()
            assert {r["id"]: r["n_slices"] for r in found} == {k: m.bit_count() for k, m in want.items()} and len(found) == len(want)
        monkeypatch.undo()
    asked, real = [], growing._missed
    monkeypatch.setattr(growing, "_missed", lambda both: asked.append(both.where("bundle >= 0").count()) or real(both))
    growing._joined(spark.range(600, 1_600).coalesce(1), "id", words, plan).collect()
    assert 0 < max(asked) <= 4 * len(plan)  # a block for each slice, of at most as many bundles as tasks


def test_traced_builds_slices_once(spark, grown):
    words, plan = grown
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    growing.traced(spark.range(100), "id", words.mapInArrow(watched, words.schema), plan).collect()
    assert seen.value == words.count()


def test_places_are_packed_by_their_gaps():
    rng = np.random.default_rng(3)
    for top, most in ((1 << 32, 5), (1 << 22, 2.5)):
        at = np.sort(rng.integers(0, top, 20_000))
        assert (growing._full(growing._thin(at)) == at).all() and len(growing._thin(at)) < most * len(at)
    assert not len(growing._full(growing._thin(at[:0])))


def test_a_store_looks_up_its_tables_as_they_are(spark, tmp_path, monkeypatch):
    """Words of large slices that batches share are neither merged nor stored again."""
    filter_ = GrowingStore.create(spark, f"{tmp_path}/f", 40, 0.05)
    for i in range(0, 800, 160):
        filter_.insert(spark.range(i, i + 160), "id", ["id"])
    probes = spark.range(600, 1_600)
    want = sorted(map(tuple, growing.provenance(probes, "id", filter_.words(), filter_.plan).collect()), key=repr)
    merged, real = [], growing.membership.merged
    monkeypatch.setattr(growing.membership, "merged", lambda words: merged.append(sorted({r[0] for r in words.select("filter_id").collect()})) or real(words))
    monkeypatch.setattr(growing.membership, "BROADCAST_BYTES", 8 * sum(growing._stride(s) for s in filter_.plan[:2]))
    assert sorted(map(tuple, filter_.provenance(probes, "id").collect()), key=repr) == want
    assert merged == [["0", "1"]]
