"""A counting filter in the state store against a plain replay."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from sketchfield.errors import UnsupportedOperation
from sketchfield.operators import membership
from sketchfield.plans import sizing
from sketchfield.streaming import counting_state

SPEC = sizing.blocked(400, 0.01)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(counting_state.PROVIDER, counting_state.ROCKSDB)
    yield spark
    spark.conf.unset(counting_state.PROVIDER)


def plain(ops, at, most, ttl):
    """(n, ok, overflow) of operations in order, and the counters, with inserts taken off when their time is over."""
    c, live, out = Counter(), [], []
    for n, t, key, d in ops:
        if ttl is not None:
            for x in [x for x in live if x[0] <= t]:
                live.remove(x)
                c.subtract(at[x[1]])
        if d > 0:
            full = sum(c[p] >= most for p in at[key])
            c.update(p for p in at[key] if c[p] < most)
            if ttl is not None:
                live.append((t + ttl, key))
            out.append((n, full < len(at[key]), full))
        else:
            ok = all(c[p] > 0 for p in at[key])
            if ok:
                c.subtract(at[key])
                own = [x for x in live if x[1] == key]
                if own:
                    live.remove(min(own))
            out.append((n, ok, 0))
    return out, {p: x for p, x in c.items() if x}


@pytest.mark.parametrize("ttl", [None, 40_000])
def test_stream_equals_replay_across_restarts(rocksdb, tmp_path, ttl):
    spark, rng = rocksdb, random.Random(3)
    keys = [f"k{i}" for i in range(60)]
    table = spark.createDataFrame([(k,) for k in keys], "key string")
    at: dict = {}
    for r in membership.positions(table, "key", SPEC, ["key"]).collect():
        at.setdefault(r["key"], []).append((r["grp"], r["pos"]))
    ops = [(i, 1_000_000 + i * 500, rng.choice(keys), rng.choice([1, 1, -1])) for i in range(600)]
    got = []
    for part in range(3):  # each part is a query of its own, from the same checkpoint
        own = [(i, t / 1000, k, d) for i, t, k, d in ops[part * 200 : part * 200 + 200]]
        rows = spark.createDataFrame([*own, (9_999, own[-1][1], None, 1)], "n long, s double, key string, d int").selectExpr("n", "timestamp_millis(CAST(s * 1000 AS BIGINT)) AS ts", "key", "d")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("n long, ts timestamp, key string, d int").parquet(str(tmp_path / "in"))
        out = counting_state.operations(stream, "key", "n", "ts", "d", SPEC, ttl_ms=ttl)
        q = out.writeStream.foreachBatch(lambda df, _: got.extend((r["n"], r["ok"], r["overflow"]) for r in df.collect()))
        q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want, left = plain(ops, at, 255, ttl)
    assert sorted(got) == want
    held = {(r["grp"], r["pos"]): r["cnt"] for r in counting_state.counters(spark, str(tmp_path / "c")).collect()}
    if ttl is None:
        assert held == left
    else:  # timers have taken off what was over before the watermark
        end = plain([*ops, (9_999, 1_000_000 + 599 * 500 - 1, "k0", 1)], at, 255, ttl)[1]
        end = {p: x - (p in at["k0"]) for p, x in end.items()}
        assert held == {p: x for p, x in end.items() if x}


def test_only_blocks_and_rocksdb(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS n", "timestamp AS ts", "value AS key", "1 AS d")
    with pytest.raises(UnsupportedOperation):
        counting_state.operations(stream, "key", "n", "ts", "d", SPEC)
    with pytest.raises(UnsupportedOperation):
        counting_state.operations(stream, "key", "n", "ts", "d", sizing.standard(100, 0.01))


def test_a_block_keeps_its_value():
    block = counting_state.Block(3, 65_535)
    block.insert(7, (1, 2, 511), 50)
    block.insert(-8, (1, 4, 6), 60)
    again = counting_state.Block(3, 65_535, block.value())
    assert again.live == block.live and (again.counters == block.counters).all()
    again.expire(50)
    assert again.counters[1] == 1 and again.counters[2] == 0 and again.delete(-8, (1, 4, 6)) and not again.live and not again.delete(-8, (1, 4, 6))
