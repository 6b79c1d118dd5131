from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sketchfield import errors
from sketchfield.operators import cardinality, chains, counting, growing, membership, reports, trees
from sketchfield.plans import sizing
from sketchfield.plans.slices import TreePlan, slice_plan
from sketchfield.sources import store
from sketchfield.streaming.merge import FilterSink

SPECS = {
    "standard": sizing.standard(2_000, 0.01),
    "fast": sizing.standard(2_000, 0.01, profile="fast"),
    "seeded": sizing.standard(2_000, 0.01, seed=9),
    "double": sizing.standard(2_000, 0.01, strategy="double"),
    "triple": sizing.standard(2_000, 0.01, strategy="triple"),
    "partitioned": sizing.partitioned(2_000, 0.01),
    "block": sizing.blocked(2_000, 0.01),
    "rehash": sizing.rehashed(2_000, 0.01),
    "sharded": sizing.sharded(2_000, 0.01, 8),
}


@pytest.mark.parametrize("name", SPECS)
def test_no_false_negatives_and_few_false_positives(spark, name):
    spec = SPECS[name]
    keys = spark.range(2_000).withColumnRenamed("id", "k")
    words = membership.build(keys, "k", spec)
    for limit in (membership.BROADCAST_BYTES, 0):
        assert membership.probe(keys, "k", words, spec, broadcast_bytes=limit).where("not maybe").count() == 0
    absent = spark.range(1_000_000, 1_020_000).withColumnRenamed("id", "k")
    hits = membership.probe(absent, "k", words, spec).where("maybe").count()
    assert hits < 20_000 * 0.03
    assert hits == membership.probe(absent, "k", words, spec, broadcast_bytes=0).where("maybe").count()


def test_null_keys_and_empty_tables(spark):
    spec = SPECS["standard"]
    keys = spark.createDataFrame([(1,), (None,)], "k long")
    words = membership.build(keys, "k", spec)
    assert sorted(map(tuple, membership.probe(keys, "k", words, spec).collect()), key=str) == [(1, True), (None, False)]
    none = membership.build(keys.limit(0), "k", spec)
    assert none.count() == 0
    row = membership.statistics(none, spec).first()
    assert (row["set_bits"], row["fill_rate"], row["estimated_fpr"], row["estimated_items"]) == (0, 0, 0, 0)
    assert membership.anti_join(keys, "k", none, spec).count() == 2
    assert membership.compare(none, none, spec, spec).first()["jaccard"] == 1.0


def test_one_filter_from_any_number_of_partitions(spark):
    spec, keys = SPECS["standard"], spark.range(500).withColumnRenamed("id", "k")
    a, b = membership.build(keys.repartition(1), "k", spec), membership.build(keys.repartition(16), "k", spec)
    assert membership.compare(a, b, spec, spec).first()["equal"]


def test_algebra(spark):
    spec = SPECS["standard"]
    a, b = membership.build(spark.range(300), "id", spec), membership.build(spark.range(200, 500), "id", spec)
    both = membership.union(a, b, spec, spec)
    assert membership.compare(a, both, spec, spec).first()["a_in_b"]
    common = membership.intersect(a, b, spec, spec)
    assert membership.probe(spark.range(200, 300), "id", common, spec).where("not maybe").count() == 0
    n = lambda w: membership.set_positions(w).count()
    assert n(membership.xor(a, b, spec, spec)) == n(both) - n(common)
    with pytest.raises(errors.IncompatibleFilters):
        membership.union(a, b, spec, SPECS["seeded"])


def test_bit_ranges(spark):
    words = membership.set_range(membership.build(spark.range(0), "id", SPECS["standard"]), 300, 60, 200)
    assert sorted(r["pos"] for r in membership.set_positions(words).collect()) == list(range(60, 200))
    for start, stop in ((63, 64), (0, 63), (64, 127), (5, 5)):
        own = membership.set_range(membership.empty(words), 300, start, stop)
        assert sorted(r["pos"] for r in membership.set_positions(own).collect()) == list(range(start, stop))
    assert membership.get_bit(words, 300, 63).first()["bit"] and not membership.get_bit(words, 300, 200).first()["bit"]
    with pytest.raises(errors.IndexOutOfBounds):
        membership.get_bit(words, 300, 300)
    with pytest.raises(errors.InvalidRange):
        membership.set_range(words, 300, 5, 301)
    assert membership.empty(words).count() == 0


def test_health_levels(spark):
    spec = sizing.standard(100, 0.01)
    state = lambda n: membership.health(membership.build(spark.range(n), "id", spec), spec).first()["state"]
    assert state(50) == "Healthy" and state(1_000) == "Critical"


def test_counters_saturate_and_count_down(spark):
    spec = sizing.standard(100, 0.01)
    twenty = spark.range(20).select(F.lit("x").alias("k"), F.col("id").alias("n"))
    made = counting.build(twenty, "k", spec)
    assert made.agg(F.max("cnt")).first()[0] == 15 and made.agg(F.min("overflow")).first()[0] == 5
    assert sorted(r["n"] for r in counting.rejected(twenty, "k", "n", spec).collect()) == [15, 16, 17, 18, 19]
    with pytest.raises(errors.CapacityExceeded):
        counting.build_checked(twenty, "k", "n", spec)
    assert counting.equal(counting.build_checked(twenty.where("n < 15"), "k", "n", spec), made).first()["equal"]
    left = counting.apply(made, twenty.limit(14), "k", spec, delete=True)
    assert counting.contains(twenty, "k", left, spec).first()["least"] == 1
    assert counting.apply(left, twenty, "k", spec, delete=True).count() == 0
    assert counting.estimated_fpr(0, spec) == 0.01
    assert counting.histogram(made, spec).agg(F.sum("counters")).first()[0] == spec.m
    assert counting.cleared(made).count() == 0 and not counting.equal(made, left).first()["equal"]


class _Plain:
    """A counting filter, one operation after the other."""

    def __init__(self, spark, keys, spec, most):
        rows = membership.positions(spark.createDataFrame([(k,) for k in sorted(set(keys))], "k string"), "k", spec, [F.col("k").alias("key")]).collect()
        self.at, self.count, self.most = {}, {}, most
        for r in rows:
            self.at.setdefault(r["key"], []).append(r["pos"])

    def insert(self, key):
        full = all(self.count.get(p, 0) >= self.most for p in self.at[key])
        for p in self.at[key]:
            self.count[p] = min(self.most, self.count.get(p, 0) + 1)
        return not full

    def delete(self, key):
        if any(self.count.get(p, 0) < self.at[key].count(p) for p in self.at[key]):
            return False
        for p in self.at[key]:
            self.count[p] -= 1
        return True


@pytest.mark.parametrize("m", [40, 200, 4_000])
def test_ordered_inserts_and_deletes_against_a_plain_filter(spark, m):
    """Repeated keys, shared and repeated positions, and saturated counters."""
    random.seed(m)
    spec, keys = sizing.with_params(m, 4), [f"k{random.randrange(40)}" for _ in range(300)]
    plain = _Plain(spark, keys + ["absent"], spec, 15)
    inserts = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "n long, k string")
    refused = [i for i, k in enumerate(keys) if not plain.insert(k)]
    assert sorted(r["n"] for r in counting.rejected(inserts, "k", "n", spec).collect()) == refused
    counters = counting.build(inserts, "k", spec)
    assert {r["pos"]: r["cnt"] for r in counters.collect()} == plain.count
    # from counters that are there already
    more = [(1_000 + i, random.choice(keys)) for i in range(80)]
    again = counting.rejected(spark.createDataFrame(more, "n long, k string"), "k", "n", spec, counters=counters)
    deletes = [(i, random.choice([*keys, "absent"])) for i in range(200)]
    frame = spark.createDataFrame(deletes, "n long, k string")
    before = dict(plain.count)
    want = [plain.delete(k) for _, k in deletes]
    assert [r["deleted"] for r in counting.delete_batch(frame, "k", "n", counters, spec, 4).orderBy("n").collect()] == want
    first = counting.first_failure(frame, "k", "n", counters, spec, 4).first()[0]
    assert first == (want.index(False) if False in want else None)
    plain.count = before
    assert sorted(r["n"] for r in again.collect()) == [i for i, k in more if not plain.insert(k)]


def test_repeated_deletes_fail_in_turn(spark):
    spec = sizing.standard(100, 0.001)
    made = counting.build(spark.createDataFrame([("a",), ("b",)], "k string"), "k", spec, 8)
    deletes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n long, k string")
    assert counting.first_failure(deletes, "k", "n", made, spec).first()[0] == 1
    assert [r["deleted"] for r in counting.delete_batch(deletes, "k", "n", made, spec).orderBy("n").collect()] == [True, False, True]
    with pytest.raises(errors.CounterUnderflow):
        counting.remove(deletes, "k", "n", made, spec)
    assert counting.remove(deletes.where("n != 2"), "k", "n", made, spec).count() == 0
    assert {r["k"]: r["can_remove"] for r in counting.can_remove(spark.createDataFrame([("a",), ("c",)], "k string"), "k", made, spec).collect()} == {"a": True, "c": False}
    assert counting.first_failure(deletes.limit(0), "k", "n", made, spec).first()[0] is None
    assert counting.delete_batch(deletes.limit(0), "k", "n", made, spec).count() == 0


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_raw_counters(spark, bits):
    spec = sizing.with_params(301, 3)
    made = counting.build(spark.range(5_000).select((F.col("id") % 40).alias("k")), "k", spec, bits)
    raw = counting.raw_counters(made, spec, bits, chunk=64)
    assert counting.equal(made, counting.from_raw(raw, spec, bits, chunk=64)).first()["equal"]
    data = b"".join(bytes(r["bytes"]) for r in raw.orderBy("chunk").collect())
    width = 2 if bits == 16 else 1
    assert len(data) == 301 * width and {i: v for i in range(301) if (v := int.from_bytes(data[i * width : (i + 1) * width], "little"))} == {r["pos"]: r["cnt"] for r in made.collect()}
    with pytest.raises(errors.InvalidFilterSize):
        counting.from_raw(raw, sizing.with_params(300, 3), bits, chunk=64)
    if bits == 4:
        with pytest.raises(Exception, match="beyond its size"):
            counting.from_raw(spark.createDataFrame([(0, bytearray([16] * 301))], "chunk long, bytes binary"), spec).collect()


def test_slices_follow_ranks(spark):
    plan = slice_plan(100, 0.01, 400)
    rows = spark.range(300).select("id", (-F.col("id")).alias("t"))
    out = {r["id"]: r["slice"] for r in growing.assigned(rows, ["t"], plan).collect()}
    assert [out[299], out[250], out[249], out[150], out[149]] == [0, 0, 1, 1, 2]
    with pytest.raises(errors.MaxFiltersExceeded):
        growing.assigned(rows, ["t"], slice_plan(10, 0.01, 10, max_slices=1), strict=True)
    words = growing.build(growing.assigned(rows, ["t"], plan), "id", plan)
    assert growing.provenance(rows, "id", words, plan).where("slice is null").count() == 0


def test_cardinality_is_close(spark):
    keys = spark.range(30_000).select((F.col("id") % 20_000).alias("k"), (F.col("id") % 3).alias("g"))
    one = cardinality.estimate(cardinality.registers(keys, "k")).first()["estimate"]
    assert abs(one - 20_000) < 3 * cardinality.ERROR_BOUND * 20_000
    assert cardinality.estimate(cardinality.merge(cardinality.registers(keys, "k", "g"))).first()["estimate"] == one


def test_chains_answer_yes_when_full(spark):
    rows = spark.createDataFrame([(i, f"k{i % 5}") for i in range(20)], "n int, k string")
    made = chains.build(rows, "k", "n", 1, 2)
    assert sorted(r["k"] for r in made.where("kept").collect()) == ["k0", "k1"]
    assert chains.contains(rows, "k", made, 1, 2).where("not maybe").count() == 0
    row = chains.statistics(made, 1, 2).first()
    assert (row["stored"], row["discarded"], row["saturated"]) == (2, 12, True)


def test_tree_locates_and_clears(spark):
    plan = TreePlan(100, 0.001, (3, 2))
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), trees.route(F.col("id"), plan).alias("path"))
    words = trees.build(rows, "k", "path", plan)
    own = rows.select("k", trees.node(F.col("path"), 2).alias("node"))
    assert own.join(trees.locate(rows, "k", words, plan), ["k", "node"], "left_anti").count() == 0
    cleared = trees.clear_subtree(words, (1,))
    assert trees.locate(rows, "k", cleared, plan).where("node like '1/%'").count() == 0
    assert trees.contains(rows, "k", cleared, plan).count() == 200
    assert trees.union(words, words, plan, plan).count() == words.count() == trees.intersect(words, words, plan, plan).count()
    with pytest.raises(errors.IncompatibleFilters):
        trees.union(words, words, plan, TreePlan(101, 0.001, (3, 2)))
    left = {(r["level"], r["node"]): r["items"] for r in trees.counts_after_clear(trees.counts(rows, "path", plan), (1,)).collect()}
    kept = {(r["level"], r["node"]): r["items"] for r in trees.counts(rows.where("path[0] != 1"), "path", plan).collect()}
    assert left == kept
    assert trees.invalid_nodes(words, plan).count() == 0
    trees.validate(words, plan)
    with pytest.raises(errors.InternalError, match="parent"):
        trees.validate(words.where("filter_id != '2'"), plan)
    broken = words.where("filter_id != '2'").union(spark.createDataFrame([("7", 0, 0, 1, 1), ("0/1", 0, 10**6, 1, 2), ("0", 0, 0, 1, 2)], words.schema))
    assert {(r["node"], r["problem"]) for r in trees.invalid_nodes(broken, plan).collect()} >= {("7", "node"), ("0/1", "word"), ("0", "level"), ("2/0", "parent"), ("2/1", "parent")}
    wider, wide = trees.resized(rows, "k", "path", plan, 500)
    assert wide.capacity == 500 and trees.locate(rows, "k", wider, wide).count() >= 200
    assert trees.query_any(rows, "k", words, plan).first()["any"] and not trees.query_any(rows.limit(0), "k", words, plan).first()["any"]
    stats = trees.statistics(words, trees.counts(rows, "path", plan), plan)
    assert trees.health(stats).first()["state"] == "Healthy"
    with pytest.raises(Exception, match="no path to a leaf"):
        trees.build(rows.limit(1).withColumn("path", F.array(F.lit(5), F.lit(0))), "k", "path", plan).collect()


def test_trees_in_a_bitmap_and_by_joins(spark, monkeypatch):
    plan = TreePlan(20, 0.05, (4, 3, 2))
    rows = spark.range(400).select(F.col("id").alias("k"), trees.route(F.col("id"), plan).alias("path"))
    words = trees.build(rows, "k", "path", plan)
    probes = spark.range(300, 900).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("k"))
    asked = [lambda: trees.locate(probes, "k", words, plan), lambda: trees.locate(probes, "k", words, plan, (2, 1)), lambda: trees.contains(probes, "k", words, plan), lambda: trees.contains_in(probes, "k", words, plan, (3, 0, 1))]
    small = [sorted(map(tuple, f().collect())) for f in asked]
    monkeypatch.setattr(membership, "BROADCAST_BYTES", 0)
    assert small == [sorted(map(tuple, f().collect())) for f in asked] and all(small)


def test_words_are_the_same_by_bitmaps_and_by_aggregation(spark, monkeypatch):
    keys = spark.createDataFrame([(f"key{i % 700}" if i % 9 else None,) for i in range(2_000)], "k string").repartition(5)
    for name, spec in SPECS.items():
        made = [tuple(r) for r in membership.build(keys, "k", spec).orderBy("grp", "word").collect()]
        monkeypatch.setattr(membership, "TASK_BYTES", 0)
        assert made == [tuple(r) for r in membership.build(keys, "k", spec).orderBy("grp", "word").collect()], name
        monkeypatch.undo()


def test_check_then_insert_in_order(spark):
    random.seed(3)
    spec = sizing.with_params(600, 3)
    rows = [(i, f"u{random.randrange(250)}") for i in range(500)]
    at = {}
    for r in membership.positions(spark.createDataFrame(sorted({(k,) for _, k in rows}), "k string"), "k", spec, [F.col("k").alias("key")]).collect():
        at.setdefault(r["key"], set()).add(r["pos"])
    known, want = set(), []
    for i, k in rows:
        if not at[k] <= known:
            want.append((k, i))
            known |= at[k]
    frame = spark.createDataFrame([*rows, (1_000, None)], "n long, k string")
    got = sorted(map(tuple, membership.first_seen(frame, "k", "n", spec).collect()))
    assert got == sorted(want) and len(want) < len({k for _, k in rows})


def test_single_bits_and_ranges_read_back(spark):
    words = membership.set_bit(membership.build(spark.range(0), "id", SPECS["standard"]), 300, 130)
    assert membership.is_empty(membership.empty(words)).first()["is_empty"] and not membership.is_empty(words).first()["is_empty"]
    assert [r["pos"] for r in membership.get_range(words, 300, 100, 200).where("bit").collect()] == [130]
    assert membership.get_range(words, 300, 60, 70).count() == 10 and membership.get_range(words, 300, 5, 5).count() == 0
    assert membership.is_empty(membership.set_bit(words, 300, 130, value=False)).first()["is_empty"]
    with pytest.raises(errors.IndexOutOfBounds):
        membership.set_bit(words, 300, 300)


def test_ranks_in_many_ranges(spark, monkeypatch):
    """Ties of the first column, nulls, times, and more ranges than fit one step."""
    monkeypatch.setattr(growing, "RANGE_ROWS", 40)
    random.seed(2)
    rows = [(random.choice([None, 1, 2, 3]), i, random.random()) for i in range(1_500)]
    frame = spark.createDataFrame(rows, "lead int, n long, x double").withColumn("t", F.timestamp_seconds("n"))
    for order, key in ((["lead", "n"], lambda r: (r[0] is not None, r[0] or 0, r[1])), (["x"], lambda r: r[2]), (["lead", "t"], lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        got = {r["n"]: r["rank"] for r in growing.ranked(frame, order).collect()}
        assert got == {r[1]: i for i, r in enumerate(sorted(rows, key=key), 1)}
    assert growing.ranked(frame.limit(0), ["n"]).count() == 0


def test_slices_in_a_bitmap_and_by_joins(spark, monkeypatch):
    plan = slice_plan(50, 0.05, 700)
    rows = growing.assigned(spark.range(600), ["id"], plan)
    words = growing.build(rows, "id", plan)
    probes = spark.range(500, 1_500).select(F.when(F.col("id") % 100 != 0, F.col("id")).alias("id"))
    small = sorted(map(tuple, growing.masks(probes, "id", words, plan).collect()), key=repr)
    joined = {}
    for k, s in growing.matches(probes, "id", words, plan).collect():
        joined[k] = joined.get(k, 0) | 1 << s
    assert {k: m for k, m in small if m} == joined and joined
    newest = {r["id"]: r["slice"] for r in growing.provenance(probes, "id", words, plan, newest_first=True).collect()}
    assert newest == {k: m.bit_length() - 1 if m else None for k, m in small}
    monkeypatch.setattr(membership, "BROADCAST_BYTES", 0)
    assert small == sorted(map(tuple, growing.masks(probes, "id", words, plan).collect()), key=repr)


def test_growing_by_hand(spark):
    plan = slice_plan(100, 0.01, 30)
    grown = growing.grow(plan, 100, 0.01, arrivals=20)
    assert [(s.number, s.first, s.threshold) for s in grown] == [(0, 1, 20), (1, 21, 100)] and grown[1].rate == 0.005
    later = growing.grow(plan, 100, 0.01)
    assert later[1].first == 51
    with pytest.raises(errors.MaxFiltersExceeded):
        growing.grow(plan, 100, 0.01, max_slices=1)
    with pytest.raises(errors.InvalidParameters):
        growing.grow(plan, 100, 0.01, arrivals=80)
    assert growing.with_threshold(plan, 0.8)[-1].threshold == 80
    for bad in (0.4, 1.0):
        with pytest.raises(errors.InvalidParameters):
            growing.with_threshold(plan, bad)
        with pytest.raises(errors.InvalidParameters):
            slice_plan(100, 0.01, 10, fill=bad)
    rows = growing.assigned(spark.range(300), ["id"], slice_plan(100, 0.01, 300))
    empty, first = growing.cleared(growing.build(rows, "id", plan), slice_plan(100, 0.01, 300))
    assert empty.count() == 0 and len(first) == 1
    assert abs(growing.unique_count(rows, "id", plan).first()[0] - 300) < 10 and growing.unique_count(rows, "id", plan, total=77).first()[0] == 77


def test_stores_of_counters_slices_and_trees(spark, tmp_path):
    spec = sizing.standard(100, 0.01)
    made = counting.build(spark.range(50), "id", spec, 8)
    store.save_counting(made, spec, 8, str(tmp_path / "c"), items=50)
    back, own, bits, items = store.load_counting(spark, str(tmp_path / "c"))
    assert (own, bits, items) == (spec, 8, 50) and counting.equal(made, back).first()["equal"]
    plan = slice_plan(50, 0.05, 200)
    words = growing.build(growing.assigned(spark.range(200), ["id"], plan), "id", plan)
    store.save_growing(words, plan, str(tmp_path / "g"))
    again, same = store.load_growing(spark, str(tmp_path / "g"))
    assert same == plan and growing.provenance(spark.range(200), "id", again, same).where("slice is null").count() == 0
    tree = TreePlan(100, 0.001, (3, 2))
    rows = spark.range(60).select(F.col("id").alias("k"), trees.route(F.col("id"), tree).alias("path"))
    store.save_tree(trees.build(rows, "k", "path", tree), tree, str(tmp_path / "t"))
    nodes, planned = store.load_tree(spark, str(tmp_path / "t"))
    assert planned == tree and trees.locate(rows, "k", nodes, planned).select("k").distinct().count() == 60
    with pytest.raises(errors.SerializationError):
        store.load_tree(spark, str(tmp_path / "g"))


def test_raw_words(spark):
    for name in ("standard", "partitioned", "block"):
        spec = SPECS[name]
        words = membership.build(spark.range(700), "id", spec)
        raw = store.to_bytes(words, spec, chunk=7)
        assert membership.compare(words, store.from_bytes(raw, spec, chunk=7), spec, spec).first()["equal"]
        assert raw.agg(F.sum(F.octet_length("bytes"))).first()[0] == store.estimate_size(spec) == spec.memory_bytes
    spec = sizing.with_params(70, 2)
    full = spark.createDataFrame([("", 0, 0, bytearray(b"\xff" * 16))], "filter_id string, grp long, chunk long, bytes binary")
    assert membership.set_positions(store.from_bytes(full, spec)).count() == 70
    with pytest.raises(errors.InvalidFilterSize):
        store.from_bytes(full, sizing.with_params(129, 2))
    with pytest.raises(errors.InvalidFilterSize):
        store.from_parts(membership.build(spark.range(700), "id", SPECS["standard"]), 64, 2)
    words, own = store.from_parts(membership.build(spark.range(9), "id", spec), 70, 2, items=9)
    assert own.expected_items == 9 and store.estimate_size(own, "json") > 48


def test_save_load_and_json(spark, tmp_path):
    spec = SPECS["partitioned"]
    words = membership.build(spark.range(100), "id", spec)
    store.save(words, spec, str(tmp_path / "f"))
    back, own = store.load(spark, str(tmp_path / "f"), spec)
    assert own == spec and membership.compare(words, back, spec, own).first()["equal"]
    with pytest.raises(errors.IncompatibleFilters):
        store.load(spark, str(tmp_path / "f"), SPECS["standard"])
    with pytest.raises(errors.SerializationError):
        store.spec_from_json('{"layout": 1}')
    again = store.from_json(store.to_json(words, spec))
    assert membership.compare(words, again, spec, spec).first()["equal"]


def test_stream_merges_by_or(spark, tmp_path):
    spec = SPECS["standard"]
    sink = FilterSink(str(tmp_path / "s"), "id", spec)
    sink.merge(spark.range(100), 0)
    for _ in range(2):  # a replay changes nothing
        sink.merge(spark.range(100, 150), 1)
    whole = membership.build(spark.range(150), "id", spec)
    assert membership.compare(whole, sink.words(spark, 1), spec, spec).first()["equal"]


def test_reports(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "maybe boolean, actual boolean")
    row = reports.fp_tracker(rows, 0.01).first()
    assert (row["false_positives"], row["false_negatives"], row["alert"]) == (1, 0, True) and abs(row["fpr"] - 1 / 3) < 1e-12
    text = reports.to_prometheus(spark.range(1), "x").first()["text"]
    assert text == "# TYPE x_id gauge\nx_id 0"
    assert reports.to_json(spark.range(1)).first()["json"] == '{"id":0}'
    assert {n for n, _ in reports.compare_profiles(spark.range(10), "id")} >= {"portable", "fast"}
    assert reports.log_histogram(spark.createDataFrame([(0.5,), (1e9,)], "v double"), "v").agg(F.sum("n")).first()[0] == 2


def test_sliding_rates_in_blocks(spark):
    random.seed(1)
    rows = [(i, random.random() < 0.3, random.random() < 0.2) for i in range(700)]
    frame = spark.createDataFrame(rows, "n long, maybe boolean, actual boolean")
    absent = [(i, m) for i, m, a in rows if not a]
    want = {i: sum(m for _, m in absent[max(0, k - 9) : k + 1]) / len(absent[max(0, k - 9) : k + 1]) for k, (i, _) in enumerate(absent)}
    for block in (10, 64, 100_000):
        got = {r["n"]: r["window_fpr"] for r in reports.sliding_fpr(frame, "n", 10, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - x) < 1e-12 for i, x in want.items())


def test_percentiles(spark):
    values = spark.range(1, 10_001).select((F.col("id") / 1000.0).alias("v"))
    row = reports.latency(values, "v").first()
    assert abs(row["p50"] - 5) < 0.01 and abs(row["p99_9"] - 9.99) < 0.01 and row["n"] == 10_000
    own = reports.from_histogram(reports.log_histogram(values, "v", 256), 256).first()
    assert abs(own["p50"] - 5) < 0.3 and abs(own["p99"] - 9.9) < 0.7  # a bucket is a tenth wide
    assert reports.from_histogram(reports.log_histogram(values.limit(0), "v")).first()["n"] == 0


def test_few_registers_count_themselves(spark):
    assert cardinality.estimate(cardinality.registers(spark.range(30), "id")).first()["estimate"] in (29, 30)


def test_metrics_and_adaptive_growth(spark):
    counted = reports.Metrics()
    counted.run("probe", spark.range(10), lambda df: df.write.format("noop").mode("overwrite").save(), F.col("id") < 4)
    assert counted.snapshot()["probe_rows"] == 10 and counted.snapshot()["probe_hits"] == 4
    rows = spark.range(300)
    words, plan = growing.adaptive_build(rows, "id", ["id"], 100, 0.01)
    assert [s.first for s in plan] == [1, 51, 151] and plan[1].rate < plan[0].rate
    assert growing.provenance(rows, "id", words, plan).where("slice is null").count() == 0
    assert growing.traced(rows, "id", words, plan).where("id = 0").first()["trace"][0]["matched"]
