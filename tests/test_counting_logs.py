"""Counting filters under operations one after the other, against plain replays."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sketchfield.errors import CounterOverflow, CounterUnderflow, IncompatibleFilters
from sketchfield.operators import counting, ledger, membership
from sketchfield.plans import sizing


def positions_of(spark, keys, spec) -> dict:
    out: dict = {}
    table = spark.createDataFrame([(k,) for k in keys], "key string")
    for r in membership.positions(table, "key", spec, ["key"]).collect():
        out.setdefault(r["key"], []).append(r["pos"])
    return out


def plain_log(ops, at, most, start=None):
    """Counters, overflow events, and whether each operation counted."""
    c, lost, counted = Counter(start or {}), Counter(), []
    for _, key, d in ops:
        ok = []
        for p in at[key]:
            good = c[p] < most if d > 0 else c[p] > 0
            ok.append(good)
            c[p] += d if good else 0
            lost[p] += d > 0 and not good
        counted.append(any(ok) if d > 0 else all(ok))
    return c, lost, counted


@pytest.mark.parametrize(("n", "chunk", "keys", "started"), [(600, 1 << 20, 25, False), (600, 50, 25, True), (900, 7, 3, True), (400, 1, 40, False)])
def test_log_against_replay(spark, n, chunk, keys, started):
    rng = random.Random(n + chunk)
    spec = sizing.with_params(97, 4)
    ops = [(i, f"k{rng.randrange(keys)}", rng.choice([1, 1, 1, -1, -1])) for i in range(n)]
    at = positions_of(spark, [f"k{i}" for i in range(keys)], spec)
    start = {3: 15, 8: 2, 96: 1, 50: 7} if started else None
    log = spark.createDataFrame([*ops, (n, None, 1), (n + 1, "k1", 0), (n + 2, "k1", None)], "t long, key string, d int").repartition(3)
    counters = spark.createDataFrame(list(start.items()), "pos long, cnt long") if started else None
    found = ledger.replay(log, "key", "t", "d", spec, 4, counters, chunk)
    c, lost, counted = plain_log(ops, at, 15, start)
    assert sorted((r["t"], r["key"], r["delta"], r["counted"]) for r in found.operations().collect()) == [(*o, x) for o, x in zip(ops, counted)]
    assert {r["pos"]: (r["cnt"], r["overflow"]) for r in found.counters().collect()} == {p: (c[p], lost[p]) for p in {*c, *lost} if c[p] or lost[p]}
    row = found.totals().first()
    assert row["operations"] == n and row["overflow_events"] == lost.total() and row["items"] == sum(d for (_, _, d), x in zip(ops, counted) if x)
    assert row["rejected_inserts"] == sum(d > 0 and not x for (_, _, d), x in zip(ops, counted))


def test_repeated_positions_and_ties(spark):
    """Of one order value deletes come first; a position that a key has twice goes up twice."""
    spec = sizing.with_params(2, 5)
    log = spark.createDataFrame([(1, "a", 1), (1, "a", -1), (1, "b", 1), (2, "b", -1)], "t long, key string, d int")
    at = positions_of(spark, ["a", "b"], spec)
    ops = [(1, "a", -1), (1, "a", 1), (1, "b", 1), (2, "b", -1)]
    c, _, counted = plain_log(ops, at, 255)
    found = ledger.replay(log, "key", "t", "d", spec, 8)
    assert {r["pos"]: r["cnt"] for r in found.counters().collect()} == {p: n for p, n in c.items() if n}
    assert sorted(map(tuple, found.operations().collect())) == sorted((*o, x) for o, x in zip(ops, counted))
    assert ledger.replay(log.limit(0), "key", "t", "d", spec).totals().first()["operations"] == 0


def test_checked_logs_raise(spark):
    spec = sizing.standard(10, 0.01)
    log = lambda *rows: spark.createDataFrame([(i, "a", d) for i, d in enumerate(rows)], "t long, key string, d int")
    assert ledger.replay_checked(log(1, 1, -1), "key", "t", "d", spec).totals().first()["items"] == 1
    with pytest.raises(CounterUnderflow):
        ledger.replay_checked(log(1, -1, -1), "key", "t", "d", spec)
    with pytest.raises(CounterOverflow):
        ledger.replay_checked(log(*[1] * 16), "key", "t", "d", spec)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([1, -1])), min_size=1, max_size=60), st.integers(1, 5))
def test_compositions_are_replays(ops, most):
    ops.sort(key=lambda o: o[0])
    owner, d = np.array([o for o, _ in ops]), np.array([x for _, x in ops])
    s, low, high = ledger.prefixes(owner, (d, np.zeros(len(d), int), np.full(len(d), most)))
    for x0 in range(most + 1):
        x, now = x0, None
        for i, (o, step) in enumerate(ops):
            x = min(max((x0 if o != now else x) + step, 0), most)
            now = o
            assert min(max(x0 + s[i], low[i]), high[i]) == x


def plain_deletes(rows, at, start):
    c, out = Counter(start), []
    for n, key in rows:
        need = Counter(at[key])
        ok = all(c[p] >= w for p, w in need.items())
        if ok:
            c.subtract(need)
        out.append((n, key, ok))
    return out, {p: n for p, n in c.items() if n}


@pytest.mark.parametrize("task", [500_000, 40, 3])
def test_deletes_against_replay(spark, task):
    """All in one task, enclosed first, and a few at a time."""
    rng = random.Random(task)
    spec = sizing.with_params(300, 5)
    keys = [f"k{i}" for i in range(60)]
    at = positions_of(spark, keys, spec)
    start = Counter(p for k in keys[:45] for p in at[k] for _ in range(rng.randrange(1, 3)))
    rows = [(i, rng.choice(keys)) for i in range(200)]
    deletes = spark.createDataFrame([*rows, (1_000, None)], "n long, key string").repartition(3)
    counters = spark.createDataFrame([(p, n) for p, n in start.items()], "pos long, cnt long")
    got = counting.delete_batch(deletes, "key", "n", counters, spec, task=task)
    want, left = plain_deletes(rows, at, start)
    assert sorted(map(tuple, got.collect())) == want
    assert {r["pos"]: r["cnt"] for r in counting.after_deletes(counters, got, "key", spec).collect()} == left
    assert counting.deleted_count(got).first().asDict() == {"deletes": 200, "deleted": sum(x[2] for x in want), "failed": 200 - sum(x[2] for x in want)}


def test_a_key_deleted_very_often(spark):
    """A third of all deletes have one key; only as many as a counter holds are looked at."""
    spec = sizing.standard(100, 0.01)
    counters = counting.build(spark.range(100).select(F.col("id").cast("string").alias("key")), "key", spec, 8)
    deletes = spark.range(30_000).selectExpr("id AS n", "CASE WHEN id % 3 = 0 THEN '7' ELSE CAST(id % 200 AS STRING) END AS key")
    got = counting.delete_batch(deletes, "key", "n", counters, spec)
    assert got.where("deleted is null").count() == 0 and got.where("deleted and key = '7'").count() == 1
    assert counting.delete_batch(deletes.limit(0), "key", "n", counters, spec).count() == 0


def test_a_chain_of_ten_thousand(spark, monkeypatch):
    """Each delete shares one counter with the next, so each hangs on all before it."""
    spec, n = sizing.with_params(1 << 20, 2), 10_000
    links = spark.range(n).selectExpr("CAST(id AS STRING) AS key", "id AS n")
    monkeypatch.setattr(counting, "positions", lambda df, key, spec, by=(): df.select(*by, F.explode(F.array(F.col("n"), F.col("n") + 1)).alias("pos")) if "n" in df.columns else None)
    counters = spark.range(n + 1).selectExpr("id AS pos", "CAST(1 AS BIGINT) AS cnt")
    # every counter holds one, so every second delete succeeds
    for task in (500_000, 2_500):
        got = counting.delete_batch(links, "key", "n", counters, spec, task=task)
        assert got.where("deleted is null").count() == 0
        assert got.where("deleted != (n % 2 = 0)").count() == 0


def test_counters_know_their_size(spark):
    """A table of 16-bit counters stays one, whatever is done to it without saying so again."""
    spec = sizing.with_params(64, 1)
    many = spark.range(1_000).selectExpr("'a' AS key", "id AS n")
    made = counting.build(many, "key", spec, 16)
    assert counting.size_of(made) == 16 and made.first()["cnt"] == 1_000
    left = counting.apply(made, many.limit(300), "key", spec, delete=True)
    assert left.first()["cnt"] == 700 and counting.size_of(left) == 16
    got = counting.delete_batch(many, "key", "n", left, spec)
    assert got.where("deleted").count() == 700 and counting.first_failure(many, "key", "n", left, spec).first()[0] == 700
    assert counting.remove(many.limit(400), "key", "n", left, spec).first()["cnt"] == 300
    assert counting.distribution(left, spec).first()["saturated"] == 0 and counting.histogram(left, spec).count() == 65_536
    with pytest.raises(IncompatibleFilters):
        counting.apply(made, many, "key", spec, 8)
    # a table that doesn't tell is taken for the largest where deletes are counted
    plain = spark.createDataFrame([tuple(r) for r in left.select("pos", "cnt").collect()], "pos long, cnt long")
    assert counting.size_of(plain) == 16 and counting.delete_batch(many, "key", "n", plain, spec).where("deleted").count() == 700
