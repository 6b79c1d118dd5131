"""Framed files through Spark's data source interface."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchfield.errors import IncompatibleFilters, SerializationError
from sketchfield.operators import counting, growing, membership, trees
from sketchfield.plans import sizing
from sketchfield.plans.slices import TreePlan, slice_plan
from sketchfield.sources import framed


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


WORDS = ("filter_id", "grp", "word", "bits")


def test_every_kind_comes_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(framed, "CHUNK", 4)
    keys = spark.range(500).withColumn("g", F.col("id") % 3)
    for spec in (sizing.standard(500, 0.01), sizing.partitioned(500, 0.01, profile="fast"), sizing.sharded(500, 0.01, 4, strategy="triple")):
        words = membership.build(keys, "id", spec, by="g")
        for _ in range(2):  # a second save replaces the first
            framed.save(words, spec, str(tmp_path / "f"), 500)
        back, spec_back, items = framed.load(spark, f"file:{tmp_path}/f", spec)
        assert rows(back, *WORDS) == rows(words, *WORDS) and (spec_back, items) == (spec, 500)
    counters = counting.build(keys, "id", spec := sizing.standard(500, 0.01), 8)
    framed.save_counters(counters, spec, 8, str(tmp_path / "c"), 500)
    back, *more = framed.load_counters(spark, str(tmp_path / "c"), spec)
    assert rows(back, "pos", "cnt") == rows(counters, "pos", "cnt") and more == [spec, 8, 500]
    plan = slice_plan(60, 0.01, 500)
    words = growing.build(growing.assigned(keys, ["id"], plan), "id", plan)
    framed.save_slices(words, plan, str(tmp_path / "s"), 500)
    back, *more = framed.load_slices(spark, str(tmp_path / "s"))
    assert rows(back, *WORDS) == rows(words, *WORDS) and more == [plan, 500]
    tree = TreePlan(50, 0.01, (3, 2))
    words = trees.build(keys.withColumn("path", trees.route(F.col("id"), tree)), "id", "path", tree)
    framed.save_tree(words, tree, str(tmp_path / "t"))
    back, tree_back = framed.load_tree(spark, str(tmp_path / "t"))
    assert rows(back, *WORDS, "level") == rows(words, *WORDS, "level") and tree_back == tree


def test_what_differs_raises(spark, tmp_path):
    spec, path = sizing.standard(50, 0.01), str(tmp_path / "f")
    framed.save(membership.build(spark.range(50), "id", spec), spec, path)
    with pytest.raises(IncompatibleFilters):
        framed.load(spark, path, sizing.standard(50, 0.01, strategy="double"))
    with pytest.raises(IncompatibleFilters):
        framed.load_counters(spark, path)
    with pytest.raises(SerializationError):
        framed.load(spark, str(tmp_path / "none"))
    for what, value in (("strategy", "double"), ("profile", "fast"), ("kind", "tree")):
        with pytest.raises(Exception, match=f"the {what} is"):
            spark.read.format("sketch").option(what, value).load(path).count()
    file = next((tmp_path / "f").glob("*.skf"))
    good = file.read_bytes()
    for bad, says in ((good[:-1], "cut"), (good[:3] + b"\2" + good[4:], "version 2"), (b"XYZ" + good[3:], "no frame"), (good[:-9] + bytes([good[-9] ^ 1]) + good[-8:], "changed")):
        file.write_bytes(bad)
        with pytest.raises(Exception, match=says):
            spark.read.format("sketch").load(path).count()
    file.write_bytes(good)
    assert spark.read.format("sketch").load(path).count() > 0


def test_empty_filters(spark, tmp_path):
    spec = sizing.standard(50, 0.01)
    framed.save(membership.empty(membership.build(spark.range(5), "id", spec)), spec, str(tmp_path / "f"))
    back, _, _ = framed.load(spark, str(tmp_path / "f"))
    assert back.count() == 0 and list(framed.frames(b"")) == []
    one = framed.frame({"kind": "filter", "profile": "fast", "strategy": "double", "n": 1}, np.array([1, 5]), np.array([-1, 1 << 62]))
    (header, at, values), (again, _, _) = framed.frames(one + one)
    assert header == again and header["cells"] == 2 and at.tolist() == [1, 5] and values.tolist() == [-1, 1 << 62]
