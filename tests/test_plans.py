from __future__ import annotations

import pytest

from sketchfield import errors
from sketchfield.operators import counting
from sketchfield.plans import sizing, slices
from sketchfield.plans.slices import Growth, TreePlan, next_ratio, predict_fpr, slice_plan, slices_for_capacity


def test_sizes_by_the_closed_form():
    assert sizing.filter_params(1_000, 0.01) == (9_586, 7)
    assert sizing.optimal_bit_count(1, 0.5) == sizing.MIN_BITS
    assert sizing.optimal_hash_count(10**9, 1) == 32 and sizing.optimal_hash_count(8, 1_000) == 1
    assert sizing.expected_fp_rate(9_586, 0, 7) == 0 and abs(sizing.expected_fp_rate(9_586, 1_000, 7) - 0.01) < 2e-4
    assert sizing.optimal_k(1_000, 9_586) == 7


@pytest.mark.parametrize("p", [0, 1, -0.1, 1.5, 0.9999])
def test_rates_out_of_bounds(p):
    with pytest.raises(errors.FalsePositiveRateOutOfBounds):
        sizing.optimal_bit_count(10, p)


def test_other_parameters_out_of_bounds():
    for bad, kind in ((lambda: sizing.standard(0, 0.1), errors.InvalidItemCount), (lambda: sizing.with_params(100, 33), errors.InvalidHashCount), (lambda: sizing.validate_params(5, 10, 7), errors.InvalidParameters), (lambda: sizing.validate_params(100, 201, 7), errors.InvalidParameters), (lambda: sizing.partitioned(10, 0.1, 3), errors.InvalidParameters), (lambda: sizing.StandardBuilder().build(), errors.InvalidParameters), (lambda: Growth("geometric", 1.0), errors.InvalidParameters), (lambda: TreePlan(10, 0.1, ()), errors.InvalidParameters), (lambda: TreePlan(10, 0.1, (2, 2)).check_path((0, 2)), errors.InvalidRange), (lambda: counting.counter_bits(70_000), errors.InvalidParameters)):
        with pytest.raises(kind):
            bad()


def test_layouts_are_rounded_up():
    assert sizing.partitioned(1_000, 0.01).m % 512 == 0
    block = sizing.blocked(100_000, 0.01)
    assert block.groups == 4_096 and 2 <= block.k <= 16
    assert sizing.chain_buckets(100_000, 0.01) == 100
    assert not sizing.standard(10, 0.1).compatible(sizing.standard(10, 0.1, seed=3))


def test_builders_give_metadata():
    made = sizing.CountingBuilder().counter_max(200).expected_items(100).false_positive_rate(0.01)
    assert counting.counter_bits(made.max_count) == 8 and made.metadata()["hashes"] == 7


def test_slices():
    plan = slice_plan(100, 0.01, 160)
    assert [(s.capacity, s.threshold, s.first) for s in plan] == [(100, 50, 1), (200, 100, 51), (400, 200, 151)]
    assert [s.capacity for s in slice_plan(100, 0.01, 10**9, Growth("bounded", 2, 300), max_slices=4)] == [100, 200, 300, 300]
    assert slices_for_capacity(100, 650) == 3
    assert abs(predict_fpr(100, 0.01, 10) - 0.01) < 1e-12
    assert next_ratio(0.5, 0.7) == 0.45 and next_ratio(0.5, 0.1) == 0.55 and next_ratio(0.5, 0.5) == 0.5


def test_tree_plan():
    plan = TreePlan(10, 0.01, (2, 3))
    assert (plan.nodes, plan.leaves, plan.depth) == (9, 6, 2) and plan.spec(0).m > plan.spec(1).m > plan.spec(2).m
    assert "9 nodes" in plan.report()


def test_builder_of_growing_filters():
    b = slices.ScalableBuilder().initial_capacity(100).false_positive_rate(0.02).growth_factor(3).tightening_ratio(0.8)
    assert (b.slice_capacity(2), b.total_capacity(3), b.slices_for(1_000)) == (900, 1_300, 3)
    assert abs(b.rate_bound - 0.1) < 1e-12 and abs(b.slice_rate(1) - 0.016) < 1e-12 and len(b.build(400)) == 3
    for wrong in (lambda: b.growth_factor(1), lambda: b.growth_factor(11), lambda: b.tightening_ratio(1), lambda: b.initial_capacity(0), lambda: b.false_positive_rate(1)):
        with pytest.raises(errors.InvalidParameters):
            wrong()
    assert slices.next_slice(b.build(1), 100, 0.02, b.growth, 0.8) == (300, 0.016) and slices.growing_shards(99) == 16
    assert slices.predict_fpr(100, 0.01, 5, items=7, current=0.3) == 0.3


def test_advice():
    assert [sizing.next_power_of_two(n) for n in (0, 1, 5, 64)] == [1, 1, 8, 64] and sizing.previous_power_of_two(100) == 64 and sizing.rounded_up(5, 4) == 8
    assert sizing.stripe_count(1) == 16 and sizing.stripe_count(10) == 64 and sizing.stripe_count(5_000) == 4096
    assert sizing.recommended_profile() == "fast" and sizing.recommended_profile(portable=True) == "portable"
    assert sizing.implied_items(sizing.with_params(1_000, 7)) == 99
    spec = sizing.standard(10**9, 0.01)
    assert sizing.advised_partitions(spec, 100) == 1 and 1 < sizing.advised_partitions(spec, 10**9) <= 120
