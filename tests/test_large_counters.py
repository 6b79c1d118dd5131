"""Counts of a filter that takes more than one task."""

from __future__ import annotations

from collections import Counter

import pytest

from sketchfield import queries
from sketchfield.operators import counting, membership
from sketchfield.operators.scratch import shared_folder
from sketchfield.plans import sizing


def test_hits_in_as_many_tasks_as_counters_need(spark, monkeypatch):
    """A key with a third of all rows, null keys and repeated keys."""
    spec = sizing.standard(300, 0.01)
    rows = spark.range(1_200).selectExpr("CASE WHEN id % 13 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 ELSE id % 400 END AS k")
    want = sorted(map(tuple, counting.hits(rows, "k", spec).collect()))
    monkeypatch.setattr(counting, "TASK_COUNTERS", 200)
    dealt = counting.hits(rows, "k", spec)
    assert sorted(map(tuple, dealt.collect())) == want
    assert dealt.rdd.getNumPartitions() == -(-spec.m // 200)


@pytest.mark.parametrize("task", [3, 500_000])
def test_only_deletes_of_contested_counters_are_ranked(spark, monkeypatch, task):
    """Null, equal and repeated deletes, of text keys that have a position twice, one after the other."""
    spec = sizing.with_params(500, 6)
    made = counting.build(spark.range(120).selectExpr("concat('k', id % 90) AS k"), "k", spec, 4)
    deletes = spark.range(240).selectExpr("CASE WHEN id % 31 = 5 THEN NULL ELSE concat('k', id * 7 % 110) END AS k", "CASE WHEN id % 40 = 9 THEN NULL ELSE id * 13 % 83 END AS n")
    deletes = deletes.union(deletes.limit(20))
    held = {r["pos"]: r["cnt"] for r in made.collect()}
    once: dict[str, Counter] = {}
    for r in membership.positions(deletes.select("k").distinct(), "k", spec, ["k"]).collect():
        once.setdefault(r["k"], Counter())[r["pos"]] += 1
    assert any(w > 1 for x in once.values() for w in x.values())
    want = []
    rows = [r for r in deletes.collect() if r["k"] is not None]
    for r in sorted(rows, key=lambda r: (r["n"] is not None, r["n"] or 0, r["k"])):
        ok = all(held.get(p, 0) >= w for p, w in once[r["k"]].items())
        for p, w in once[r["k"]].items():
            held[p] = held.get(p, 0) - w * ok
        want.append((r["n"], r["k"], ok))
    ranks, real = [], counting.ranked
    monkeypatch.setattr(counting, "ranked", lambda df, *more: ranks.append(df.count()) or real(df, *more))
    out = counting.delete_batch(deletes, "k", "n", made, spec, task=task)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert 0 < sum(ranks) < len(want) // 2


def test_deletes_beyond_what_a_counter_holds_stay(spark):
    """A key has more deletes than a counter holds, many of them equal and some of a null order."""
    spec = sizing.standard(100, 0.01)
    made = counting.build(spark.range(100).selectExpr("id % 50 AS k"), "k", spec, 4)
    deletes = spark.range(300).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 40 END AS k", "CASE WHEN id % 5 = 0 THEN NULL ELSE id % 7 END AS n")
    out = counting.delete_batch(deletes, "k", "n", made, spec)
    assert out.select("k", "n").exceptAll(deletes).count() == 0 and out.count() == 300
    won = out.where("deleted and k = 7").collect()
    assert [r["n"] for r in won] == [None, None]


def test_counters_around_deletes_are_built_once(spark):
    """What is left after the deletes comes of stored counters, not of the orders again; and they still know their size."""
    orders = spark.range(60).selectExpr("id AS o_orderkey", "CASE WHEN id % 2 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus")
    folder = shared_folder(spark, "tables")
    orders.write.parquet(f"{folder}/orders.parquet")
    left = queries.counting_after_delete_batch(spark, folder)
    assert "orders.parquet" not in left._jdf.queryExecution().toString()
    assert counting.size_of(left) == 8 and left.where("cnt > 0").count() == left.count()
