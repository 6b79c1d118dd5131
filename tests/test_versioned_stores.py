"""Filters that are filled batch by batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sketchfield.errors import InternalError, InvalidParameters, MaxFiltersExceeded
from sketchfield.operators import growing, membership
from sketchfield.plans import sizing
from sketchfield.plans.slices import Growth, slice_plan
from sketchfield.sources import growing_store
from sketchfield.sources.growing_store import GrowingStore
from sketchfield.sources.versions import Versions
from sketchfield.streaming.merge import FilterSink, deduplicated


def rows(df):
    return sorted(map(tuple, df.collect()))


def arrivals(spark, n):
    return spark.range(n).selectExpr("id AS t", "CAST(id % 301 AS STRING) AS k")


@pytest.mark.parametrize("cuts", [[100, 200, 300, 400, 500, 600, 700, 800, 900], [1, 2, 3, 60, 61, 400, 999], []])
def test_batches_are_one_batch(spark, tmp_path, cuts, monkeypatch):
    monkeypatch.setattr(growing_store, "MOST_TABLES", 4)  # tables are merged on the way
    every, plan = arrivals(spark, 1_000), slice_plan(60, 0.01, 1_000)
    store = GrowingStore.create(spark, str(tmp_path / "f"), 60, 0.01, count_unique=True)
    bounds = [0, *cuts, 1_000]
    for number, (a, z) in enumerate(zip(bounds, bounds[1:])):
        part = every.where(f"t >= {a} and t < {z}").unionByName(spark.createDataFrame([(a, None)], "t long, k string"))
        assert store.insert(part, "k", ["t"], number)
        assert not store.insert(part, "k", ["t"], number)  # it was committed before
        store = GrowingStore.open(spark, str(tmp_path / "f"))
        assert (store.items, store.batch) == (z, number)
    whole = growing.build(growing.assigned(every, ["t"], plan), "k", plan)
    assert store.plan == plan and rows(store.words()) == rows(whole)
    assert rows(store.provenance(every, "k")) == rows(growing.provenance(every, "k", whole, plan))
    assert store.contains(every, "k").where("not maybe").count() == 0
    assert abs(store.unique_count().first()[0] - 301) < 10
    store.compact()
    assert rows(store.words()) == rows(whole) and len(list((tmp_path / "f/tables").iterdir())) == 2 and len(list((tmp_path / "f/manifests").glob("*.json"))) == 1


def test_growing_by_hand_and_clearing(spark, tmp_path):
    store = GrowingStore.create(spark, str(tmp_path / "f"), 100, 0.01, Growth("constant"), max_slices=5)
    store.insert(arrivals(spark, 10), "k", ["t"])
    store.grow()
    store.insert(arrivals(spark, 20).where("t >= 10"), "k", ["t"])
    assert [(s.number, s.first) for s in store.plan] == [(0, 1), (1, 11)] and store.items == 20
    assert {r["slice"] for r in store.provenance(arrivals(spark, 20).where("t >= 10"), "k", newest_first=True).collect()} == {1}
    store.set_fill_threshold(0.9)
    store.insert(arrivals(spark, 101).where("t > 19"), "k", ["t"])
    assert [(s.number, s.first) for s in store.plan] == [(0, 1), (1, 11), (2, 101)]
    before = store.batch
    store.clear()
    assert store.items == 0 and len(store.plan) == 1 and store.words().count() == 0 and not store.insert(arrivals(spark, 5), "k", ["t"], before)
    assert store.insert(arrivals(spark, 5).limit(0), "k", ["t"]) and store.items == 0


def test_a_strict_store_is_left_as_it_was(spark, tmp_path):
    store = GrowingStore.create(spark, str(tmp_path / "f"), 100, 0.01, Growth("constant"), max_slices=2, strict=True)
    store.insert(arrivals(spark, 90), "k", ["t"])
    with pytest.raises(MaxFiltersExceeded):
        store.insert(arrivals(spark, 200).where("t >= 90"), "k", ["t"])
    assert GrowingStore.open(spark, str(tmp_path / "f")).items == 90
    loose = GrowingStore.create(spark, str(tmp_path / "g"), 100, 0.01, Growth("constant"), max_slices=2)
    loose.insert(arrivals(spark, 500), "k", ["t"])
    assert loose.items == 500 and len(loose.plan) == 2
    with pytest.raises(InvalidParameters):
        GrowingStore.create(spark, str(tmp_path / "g"), 100, 0.01)
    with pytest.raises(InvalidParameters):
        GrowingStore.open(spark, str(tmp_path / "none"))


def test_one_of_two_writers_fails(spark, tmp_path):
    GrowingStore.create(spark, str(tmp_path / "f"), 100, 0.01)
    one, two = (GrowingStore.open(spark, str(tmp_path / "f")) for _ in range(2))
    one.insert(arrivals(spark, 10), "k", ["t"])
    with pytest.raises(InternalError):
        two.insert(arrivals(spark, 20), "k", ["t"])
    assert GrowingStore.open(spark, str(tmp_path / "f")).items == 10
    # what the failed writer has written is dropped
    assert Versions(spark, str(tmp_path / "f")).vacuum() == 1


def test_growing_follows_a_stream(spark, tmp_path):
    for i in range(3):
        arrivals(spark, 300).where(f"t div 100 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = GrowingStore.create(spark, str(tmp_path / "f"), 60, 0.01)
    stream = spark.readStream.schema("t long, k string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(store.merge("k", ["t"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    again = GrowingStore.open(spark, str(tmp_path / "f"))
    assert again.items == 300 and again.contains(arrivals(spark, 300), "k").where("not maybe").count() == 0


def test_a_sink_keeps_few_tables(spark, tmp_path):
    spec = sizing.standard(2_000, 0.01)
    sink = FilterSink(str(tmp_path / "s"), "id", spec, most=3)
    for i in range(9):
        for _ in range(2):  # a batch that comes again changes nothing
            sink.merge(spark.range(i * 100, i * 100 + 100), i)
        for batch, n in ((i, 100 * i + 100), (i - 1, 100 * i)):
            if batch >= 0:
                assert rows(sink.words(spark, batch)) == rows(membership.build(spark.range(n), "id", spec))
    assert len(list((tmp_path / "s/tables").iterdir())) <= 6 and len(list((tmp_path / "s/manifests").glob("*.json"))) <= 4


def test_deduplication_across_restarts(spark, tmp_path):
    spec, out = sizing.standard(2_000, 0.0001), {}
    for i in range(4):
        spark.range(i * 60, i * 60 + 100).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = FilterSink(str(tmp_path / "s"), "id", spec, most=2)
    for _ in range(2):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = deduplicated(stream, "id", sink, lambda df, n: out.update({n: [r["id"] for r in df.collect()]}))
        q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        spark.range(250, 300).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = [x for ids in out.values() for x in ids]
    assert len(found) == len(set(found)) and len(set(range(300)) - set(found)) <= 1


def test_counts_by_slice(spark, tmp_path):
    store = GrowingStore.create(spark, str(tmp_path / "f"), 60, 0.01)
    store.insert(arrivals(spark, 200), "k", ["t"])
    assert store.statistics().agg(F.sum("set_bits")).first()[0] == store.words().agg(F.sum(F.bit_count("bits"))).first()[0]
