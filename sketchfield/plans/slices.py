"""Slices of filters that grow, and nodes of trees of filters."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import product

from ..errors import InvalidParameters, InvalidRange
from .sizing import Spec, check_items, check_rate, filter_params, sharded, standard

MAX_SLICES = 64
LEAST_RATE = 1e-15


@dataclass(frozen=True)
class Growth:
    """How capacities go on: constant, geometric (scale), bounded (scale, cap)."""

    kind: str = "geometric"
    scale: float = 2.0
    cap: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("constant", "geometric", "bounded", "adaptive"):
            raise InvalidParameters(f"unknown growth {self.kind}")
        if self.kind in ("geometric", "bounded") and not self.scale > 1:
            raise InvalidParameters("capacities grow by a factor over 1")
        if self.kind == "bounded" and not self.cap:
            raise InvalidParameters("bounded growth needs a cap")

    def capacity(self, first: int, i: int) -> int:
        if self.kind == "constant" or i == 0:
            return first
        grown = int(first * (2.0 if self.kind == "adaptive" else self.scale) ** i)
        return min(grown, self.cap) if self.kind == "bounded" else grown


@dataclass(frozen=True)
class Slice:
    number: int
    capacity: int
    rate: float
    spec: Spec
    threshold: int  # arrivals that it takes before the next one opens
    first: int  # rank of its first arrival, from 1


def slice_plan(
    capacity: int,
    rate: float,
    arrivals: int,
    growth: Growth = Growth(),
    ratio: float = 0.5,
    fill: float = 0.5,
    max_slices: int = MAX_SLICES,
    floor: bool = False,
) -> list[Slice]:
    """The slices that so many arrivals open. ``floor``: thresholds round down, as the concurrent form has them."""
    check_items(capacity)
    check_rate(rate)
    if not 0 < ratio < 1 or not 0.45 <= fill < 1:
        raise InvalidParameters("a ratio is in (0, 1) and a fill threshold in [0.45, 1)")
    out, first = [], 1
    for i in range(max_slices):
        own = growth.capacity(capacity, i)
        p = min(1.0, max(LEAST_RATE, rate * ratio**i))
        t = max(1, math.floor(own * fill) if floor else math.ceil(own * fill))
        out.append(Slice(i, own, p, standard(own, p), t, first))
        first += t
        if first > arrivals:
            break
    return out


def next_ratio(ratio: float, fill: float, least: float = 0.3, most: float = 0.9, threshold: float = 0.5) -> float:
    """Adaptive tightening after a slice was filled so far, if that is over a fifth off the threshold."""
    return max(0.9 * ratio, least) if fill > 1.2 * threshold else min(1.1 * ratio, most) if fill < 0.8 * threshold else ratio


def predict_fpr(
    capacity: int,
    rate: float,
    n: int,
    growth: Growth = Growth(),
    ratio: float = 0.5,
    fill: float = 0.5,
    items: int = 0,
    current: float = 0.0,
) -> float:
    """The compound rate with the slices that n items open; the current one if a filter has so many items already."""
    if n <= items:
        return current
    slices = slice_plan(capacity, rate, n, growth, ratio, fill, floor=True)
    return 1 - math.prod(1 - s.rate for s in slices)


def union_bound(rate: float, ratio: float) -> float:
    return rate / (1 - ratio)


def slices_for_capacity(capacity: int, total: int, growth: Growth = Growth()) -> int:
    have = n = 0
    while have < total and n < MAX_SLICES:
        have += growth.capacity(capacity, n)
        n += 1
    return n


def next_slice(plan: list[Slice], capacity: int, rate: float, growth: Growth = Growth(), ratio: float = 0.5) -> tuple[int, float]:
    """Capacity and rate of the slice that opens after a plan's last one."""
    i = len(plan)
    return growth.capacity(capacity, i), max(LEAST_RATE, rate * ratio**i)


def growing_shards(threads: int) -> int:
    return max(1, min(16, threads))


def sharded_plan(plan: list[Slice], shards: int) -> list[Slice]:
    """The same slices, each dealt to so many shards."""
    return [replace(s, spec=sharded(s.capacity, s.rate, shards)) for s in plan]


@dataclass(frozen=True)
class ScalableBuilder:
    """Collects what a growing filter needs; every step validates."""

    first: int = 1_000
    rate: float = 0.01
    factor: float = 2.0
    ratio: float = 0.5
    fill: float = 0.5

    def initial_capacity(self, n: int) -> ScalableBuilder:
        check_items(n)
        return replace(self, first=n)

    def false_positive_rate(self, p: float) -> ScalableBuilder:
        check_rate(p)
        return replace(self, rate=p)

    def growth_factor(self, factor: float) -> ScalableBuilder:
        if not 1 < factor <= 10:
            raise InvalidParameters(f"a growth factor is in (1, 10], not {factor}")
        return replace(self, factor=factor)

    def tightening_ratio(self, ratio: float) -> ScalableBuilder:
        if not 0 < ratio < 1:
            raise InvalidParameters(f"a ratio is in (0, 1), not {ratio}")
        return replace(self, ratio=ratio)

    @property
    def growth(self) -> Growth:
        return Growth("geometric", self.factor)

    @property
    def rate_bound(self) -> float:
        return union_bound(self.rate, self.ratio)

    def slice_capacity(self, i: int) -> int:
        return self.growth.capacity(self.first, i)

    def slice_rate(self, i: int) -> float:
        return max(LEAST_RATE, self.rate * self.ratio**i)

    def total_capacity(self, slices: int) -> int:
        return sum(map(self.slice_capacity, range(slices)))

    def slices_for(self, total: int) -> int:
        return slices_for_capacity(self.first, total, self.growth)

    def build(self, arrivals: int) -> list[Slice]:
        return slice_plan(self.first, self.rate, arrivals, self.growth, self.ratio, self.fill)


@dataclass(frozen=True)
class TreePlan:
    """A tree of filters: a node at level l holds what its leaves may hold."""

    capacity: int
    rate: float
    branching: tuple[int, ...]

    def __post_init__(self) -> None:
        check_items(self.capacity)
        check_rate(self.rate)
        if not self.branching or len(self.branching) > 256 or min(self.branching) < 1:
            raise InvalidParameters("a tree has from 1 to 256 levels with at least one child each")
        if self.nodes > 10_000_000:
            raise InvalidParameters("a tree has at most 10 million nodes")

    @property
    def depth(self) -> int:
        return len(self.branching)

    @property
    def leaves(self) -> int:
        return math.prod(self.branching)

    @property
    def nodes(self) -> int:
        return sum(math.prod(self.branching[:i]) for i in range(len(self.branching) + 1))

    def spec(self, level: int) -> Spec:
        m, k = filter_params(self.capacity * math.prod(self.branching[level:]), self.rate)
        return Spec("standard", m, k, expected_items=self.capacity, target_fpr=self.rate)

    def check_path(self, path: tuple[int, ...]) -> None:
        if len(path) != self.depth or any(not 0 <= x < b for x, b in zip(path, self.branching)):
            raise InvalidRange(f"{path} is no path to a leaf")

    def paths(self, level: int) -> list[tuple[int, ...]]:
        return list(product(*(range(b) for b in self.branching[:level])))

    def report(self) -> str:
        rows = [f"level {i}: {math.prod(self.branching[:i])} nodes of {self.spec(i).m} bits and {self.spec(i).k} hashes" for i in range(self.depth + 1)]
        return "\n".join([f"tree {list(self.branching)}: {self.nodes} nodes, {self.leaves} leaves", *rows])
