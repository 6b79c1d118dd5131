"""Sketches as a binary value for each group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sketchfield.errors import InvalidFilterSize, SerializationError, UnsupportedOperation
from sketchfield.operators import cardinality, membership, packed
from sketchfield.plans import sizing
from sketchfield.sources import store

SPECS = [sizing.standard(500, 0.01), sizing.partitioned(500, 0.01), sizing.blocked(500, 0.01, profile="fast"), sizing.sharded(500, 0.01, 3), sizing.rehashed(300, 0.05), sizing.standard(300, 0.01, strategy="triple", seed=4)]


def keyed(spark, n=1_500):
    """A third of the rows in one group, null keys and a null group."""
    return spark.range(n, numPartitions=5).selectExpr("CASE WHEN id % 11 = 0 THEN NULL ELSE id END AS k", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 5 AS STRING) END AS g")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: f"{s.layout}-{s.strategy}-{s.profile}")
def test_packed_filters_are_the_words(spark, spec, monkeypatch):
    df = keyed(spark)
    want = rows(membership.build(df, "k", spec, by=F.col("g")).select("filter_id", "grp", "word", "bits"))
    for held in (64 << 20, 1):  # a task hands on each group at once, too
        monkeypatch.setattr(packed, "HELD_BYTES", held)
        filters = packed.build(df, "k", "g", spec)
        assert rows(packed.to_words(filters, spec)) == want
        assert filters.count() == 7
    some = membership.build(df, "k", spec, by=F.col("g")).where("filter_id = 'hot'")
    chunks = store.to_bytes(some, spec).orderBy("grp", "chunk").collect()
    assert b"".join(bytes(r["bytes"]) for r in chunks) == bytes(filters.where("filter_id = 'hot'").first()["packed"])


def test_union_statistics_and_lookups(spark):
    spec, df = SPECS[0], keyed(spark)
    filters = packed.build(df, "k", "g", spec)
    whole = packed.union(filters.withColumn("filter_id", F.lit("all")), spec)
    words = membership.build(df, "k", spec)
    assert rows(packed.to_words(whole, spec).select("word", "bits")) == rows(words.select("word", "bits"))
    s = packed.statistics(whole, spec).first()
    assert s["set_bits"] == membership.statistics(words, spec).first()["set_bits"]
    keys = spark.createDataFrame([(3,), (6,), (3,), (None,), (10**9,)], "k long")
    want = {}
    for r in membership.matching(keys, "k", packed.to_words(filters.where("filter_id is not null"), spec), spec).collect():
        want[r["filter_id"]] = want.get(r["filter_id"], 0) + 1
    found = {r["filter_id"]: r["n_keys"] for r in packed.holding(filters.where("filter_id is not null"), keys, "k", spec).collect()}
    assert found == want and found["hot"] >= 2
    assert packed.holding(filters, keys.limit(0), "k", spec).count() == 0


def test_what_is_not_packed_raises(spark, monkeypatch):
    bad = spark.createDataFrame([("a", bytearray(b"123"))], "filter_id string, packed binary")
    with pytest.raises(Exception, match=InvalidFilterSize.__name__):
        packed.statistics(bad, SPECS[0]).count()
    for data in (b"", b"\2", b"\0ab", b"\1abc", b"\0" + (cardinality.REGISTERS << 8).to_bytes(4, "little")):
        with pytest.raises(SerializationError):
            packed.bytes_to_ranks(data)
    monkeypatch.setattr(packed, "MOST_KEYS", 3)
    with pytest.raises(UnsupportedOperation):
        packed.holding(packed.build(keyed(spark), "k", "g", SPECS[0]), spark.range(10), "id", SPECS[0])


def test_registers_are_those_of_the_table(spark):
    """Few and many distinct keys: sparse and dense sketches."""
    df = spark.range(60_000, numPartitions=4).selectExpr("id AS k", "CASE WHEN id % 2 = 0 THEN 'many' WHEN id % 201 = 1 THEN 'some' ELSE CAST(id % 3 AS STRING) END AS g")
    sketches = packed.registers(df, "k", "g")
    sizes = {r["filter_id"]: len(r["packed"]) for r in sketches.collect()}
    assert sizes["many"] == 1 + cardinality.REGISTERS and sizes["some"] < 2_000
    got = {r["filter_id"]: (r["used"], r["estimate"]) for r in packed.estimates(sketches).collect()}
    want = {r["filter_id"]: (r["used"], r["estimate"]) for r in cardinality.estimate(cardinality.registers(df, "k", "g"), by=True).collect()}
    assert got == want
    merged = packed.merged_registers(sketches.withColumn("filter_id", F.lit("all")))
    assert packed.estimates(merged).first()["estimate"] == cardinality.estimate(cardinality.registers(df, "k")).first()["estimate"]


def test_the_correction_for_large_numbers(spark):
    """Registers as some hundred millions of keys leave them, beyond a thirtieth of 2^32."""
    rng = np.random.default_rng(1)
    ranks = np.minimum(47, 1 + np.floor(-np.log2(rng.random(cardinality.REGISTERS))) + 14).astype(np.uint8)
    one = spark.createDataFrame([("x", bytearray(packed.ranks_to_bytes(ranks)))], "filter_id string, packed binary")
    s = float(np.sum(2.0 ** -ranks.astype(float)))
    raw = 0.7213 / (1 + 1.079 / 16384) * 16384.0**2 / s
    assert raw > 2**32 / 30
    assert packed.estimates(one).first()["estimate"] == int(np.floor(-(2.0**32) * np.log(1 - raw / 2.0**32)))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, cardinality.REGISTERS - 1), st.integers(1, 47), max_size=200), st.booleans())
def test_sketches_come_back(cells, dense):
    ranks = np.zeros(cardinality.REGISTERS, np.uint8)
    ranks[list(cells)] = list(cells.values())
    if dense:
        ranks[:5_000] = 9
    assert (packed.bytes_to_ranks(packed.ranks_to_bytes(ranks)) == ranks).all()


def test_a_strategy_of_ones_own(spark):
    """Registered by the driver only: tasks get it with their function."""
    from sketchfield.errors import InvalidParameters
    from sketchfield.functions import hashing

    with pytest.raises(InvalidParameters):
        membership.build(spark.range(1), "id", sizing.standard(100, 0.01, strategy="cubic"))
    hashing.register_strategy("cubic", 3, lambda h, i: h[0] + i * h[1] + i * i * i * h[2])
    try:
        spec = sizing.standard(400, 0.01, strategy="cubic")
        df = spark.range(400)
        words = membership.build(df, "id", spec)
        by_positions = membership.build(df, "id", spec, by=F.lit(""))
        assert rows(words) == rows(by_positions) != rows(membership.build(df, "id", sizing.standard(400, 0.01)))
        probes = spark.range(800)
        for size in (membership.BROADCAST_BYTES, 0):
            assert membership.probe(probes, "id", words, spec, broadcast_bytes=size).where("not maybe and id < 400").count() == 0
        assert rows(packed.to_words(packed.build(df, "id", F.lit("x"), spec), spec).select("grp", "word", "bits")) == rows(words.select("grp", "word", "bits"))
        with pytest.raises(InvalidParameters):
            hashing.register_strategy("one", 1, lambda h, i: h[0] + i)
    finally:
        del hashing.STRATEGIES["cubic"]


def test_many_small_groups_go_in_few_batches_and_few_bytes():
    """A row of a group takes bytes for what it sets, not an array of the sketch's size, and values go out together."""
    rows = [pa.RecordBatch.from_arrays([pa.array([str(i % 2_000) for i in range(3_000)]), pa.array(np.arange(3_000, dtype=np.int64) << 20)], names=["_by", "h0"])]
    (cells,) = packed._cells(rows, packed._REGISTERS)
    assert cells.num_rows == 2_000 and cells.column(1).nbytes < 40_000
    assert [b.num_rows for b in packed._rows((str(i), b"x") for i in range(3_000))] == [3_000]
