"""Sizes of filters from item counts and false-positive rates, in closed form."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from ..errors import FalsePositiveRateOutOfBounds, InvalidFilterSize, InvalidHashCount, InvalidItemCount, InvalidParameters

MIN_BITS = 8
MIN_HASHES, MAX_HASHES = 1, 32
MAX_LOAD = 2.0  # items for each bit
LN2_SQUARED = math.log(2) ** 2


def check_rate(p: float) -> None:
    if not 0 < p < 0.9999:
        raise FalsePositiveRateOutOfBounds(f"a false-positive rate must be in (0, 0.9999), not {p}")


def check_items(n: int) -> None:
    if n < 1:
        raise InvalidItemCount(f"at least one item must be expected, not {n}")


def check_hashes(k: int) -> None:
    if not MIN_HASHES <= k <= MAX_HASHES:
        raise InvalidHashCount(f"from {MIN_HASHES} to {MAX_HASHES} hashes are possible, not {k}")


def bits_per_element(p: float) -> float:
    check_rate(p)
    return -math.log(p) / LN2_SQUARED


def optimal_bit_count(n: int, p: float) -> int:
    check_items(n)
    check_rate(p)
    m = max(MIN_BITS, math.ceil(-n * math.log(p) / LN2_SQUARED))
    if m > 2**62:
        raise InvalidFilterSize(f"{m} bits are too many")
    return m


def optimal_hash_count(m: int, n: int) -> int:
    if m < 1:
        raise InvalidFilterSize("a filter has at least one bit")
    check_items(n)
    return min(MAX_HASHES, max(MIN_HASHES, math.floor(m / n * math.log(2) + 0.5)))


def optimal_k(n: int, m: int) -> int:
    """``optimal_hash_count`` with items first."""
    return optimal_hash_count(m, n)


optimal_m = optimal_bit_count


def expected_fp_rate(m: int, n: int, k: int) -> float:
    check_hashes(k)
    if m < 1:
        raise InvalidFilterSize("a filter has at least one bit")
    return 0.0 if n == 0 else min(1.0, max(0.0, (1 - math.exp(-k * n / m)) ** k))


def filter_params(n: int, p: float) -> tuple[int, int]:
    m = optimal_bit_count(n, p)
    return m, optimal_hash_count(m, n)


def validate_params(m: int, n: int, k: int) -> None:
    if m < 1:
        raise InvalidFilterSize("a filter has at least one bit")
    check_items(n)
    check_hashes(k)
    if m < k:
        raise InvalidParameters(f"{m} bits are fewer than {k} hashes")
    if n / m > MAX_LOAD:
        raise InvalidParameters(f"{n} items in {m} bits are more than {MAX_LOAD} an each")


@dataclass(frozen=True)
class Spec:
    """What decides the bits of a key, and so which filters can be combined."""

    layout: str  # standard, partitioned, block, rehash, sharded
    m: int  # bits of each group
    k: int
    groups: int = 1
    strategy: str = "enhanced"  # double, enhanced, triple
    profile: str = "portable"  # portable (md5) or fast (xxhash64)
    seed: int = 0
    expected_items: int | None = None
    target_fpr: float | None = None

    def __post_init__(self) -> None:
        check_hashes(self.k)
        if self.m < 1 or self.groups < 1:
            raise InvalidFilterSize("a filter has at least one bit")

    @property
    def bits(self) -> int:
        return self.m * self.groups

    @property
    def memory_bytes(self) -> int:
        return 8 * self.groups * -(-self.m // 64)

    def compatible(self, other: Spec) -> bool:
        own = replace(self, expected_items=None, target_fpr=None)
        return own == replace(other, expected_items=None, target_fpr=None)


def standard(n: int, p: float, **more: object) -> Spec:
    m, k = filter_params(n, p)
    return Spec("standard", m, k, expected_items=n, target_fpr=p, **more)


def with_params(m: int, k: int, **more: object) -> Spec:
    return Spec("standard", m, k, **more)


def rehashed(n: int, p: float, **more: object) -> Spec:
    """k independent hashes of the key."""
    m, k = filter_params(n, p)
    return Spec("rehash", m, k, expected_items=n, target_fpr=p, **more)


def partitioned(n: int, p: float, alignment: int = 64, **more: object) -> Spec:
    """One aligned part of the bits for each hash."""
    if alignment < 1 or alignment & (alignment - 1):
        raise InvalidParameters("an alignment is a power of two")
    m, k = filter_params(n, p)
    unit = 8 * alignment
    size = max(512, -(-(-(-m // k)) // unit) * unit)
    return Spec("partitioned", size, k, groups=k, expected_items=n, target_fpr=p, **more)


def blocked(n: int, p: float, **more: object) -> Spec:
    """512-bit blocks, all bits of a key in one; sized for a stricter rate, as blocks fill unevenly."""
    m = optimal_bit_count(n, p / 2.5)
    blocks = 1 << (max(1, -(-m // 512)) - 1).bit_length()
    k = min(16, max(2, math.floor(blocks * 512 / n * math.log(2) + 0.5)))
    return Spec("block", 512, k, groups=blocks, expected_items=n, target_fpr=p, **more)


def sharded(n: int, p: float, shards: int, **more: object) -> Spec:
    if not 1 <= shards <= 4096:
        raise InvalidParameters("from 1 to 4096 shards are possible")
    m, k = filter_params(-(-n // shards), p)
    return Spec("sharded", m, k, groups=shards, expected_items=n, target_fpr=p, **more)


def stripe_count(cores: int) -> int:
    """Stripes for so many writers: a power of two from 16 to 4096."""
    return min(4096, next_power_of_two(max(16, 4 * cores)))


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def previous_power_of_two(n: int) -> int:
    if n < 1:
        raise InvalidParameters(f"no power of two is at most {n}")
    return 1 << (n.bit_length() - 1)


def rounded_up(n: int, unit: int) -> int:
    return -(-n // unit) * unit


def implied_items(spec: Spec) -> int:
    """Items that fill half of a filter's bits, for filters made of bits and hashes."""
    return math.floor(spec.bits * math.log(2) / spec.k)


def advised_partitions(spec: Spec, rows: int, row_bytes: int = 16, partition_bytes: int = 128 << 20) -> int:
    """Partitions for building a filter of so many keys: of about ``partition_bytes`` of hashes, and not more than the words can fill."""
    by_keys = -(-rows * row_bytes // partition_bytes)
    return max(1, min(by_keys, -(-spec.memory_bytes * 24 // 8 // (1 << 20)) + by_keys // 2))


def recommended_profile(portable: bool = False) -> str:
    """The fastest hash family, unless other engines must find the same bits."""
    return "portable" if portable else "fast"


def adaptive_shards(n: int, cores: int) -> int:
    return max(1, min(2 * cores, n // 10_000, 256))


def chain_buckets(n: int, p: float) -> int:
    """Buckets of a chained table of stored keys."""
    check_items(n)
    check_rate(p)
    load = -math.log(p) / 2 if p < 0.01 else max(1.0, math.sqrt(0.1 * n / p))
    return max(1, math.ceil(n / load))


@dataclass(frozen=True)
class StandardBuilder:
    """Collects what a standard filter needs; ``build`` validates."""

    items: int | None = None
    rate: float | None = None
    profile: str = "portable"
    seed: int = 0

    def expected_items(self, n: int) -> StandardBuilder:
        check_items(n)
        return replace(self, items=n)

    def false_positive_rate(self, p: float) -> StandardBuilder:
        check_rate(p)
        return replace(self, rate=p)

    def hasher(self, profile: str, seed: int = 0) -> StandardBuilder:
        return replace(self, profile=profile, seed=seed)

    def build(self) -> Spec:
        if self.items is None or self.rate is None:
            raise InvalidParameters("expected items and a false-positive rate are needed")
        return standard(self.items, self.rate, profile=self.profile, seed=self.seed)

    def metadata(self) -> dict[str, object]:
        s = self.build()
        return {
            "expected_items": self.items,
            "target_fpr": self.rate,
            "bits": s.m,
            "hashes": s.k,
            "bits_per_item": s.m / self.items,
            "memory_bytes": s.memory_bytes,
        }


@dataclass(frozen=True)
class CountingBuilder(StandardBuilder):
    max_count: int = 15

    def counter_max(self, n: int) -> CountingBuilder:
        if n < 1:
            raise InvalidParameters("a counter counts to one at least")
        return replace(self, max_count=n)
