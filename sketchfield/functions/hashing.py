"""Keys to hashes and bit positions, as column expressions that stay in the JVM.

Two profiles: ``portable`` takes 60-bit halves of the MD5 digest, which any SQL engine can
recompute, and ``fast`` takes seeded xxhash64 values.  Every term is reduced before it is
multiplied, so nothing overflows for fewer than 2^57 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParameters
from ..plans.sizing import Spec

#: Registered profiles: (key, seed, number) -> a non-negative BIGINT; numbers 1, 2 and 3 are independent.
PROFILES: dict[str, Callable[[Column, int, int], Column]] = {}


def register_profile(name: str, make: Callable[[Column, int, int], Column]) -> None:
    """Add a hash family of one's own."""
    PROFILES[name] = make


def composite(*columns: Column | str) -> Column:
    """One key of several columns, with lengths, so that no two tuples meet; null if one is null."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    texts = [p.cast("string") for p in parts]
    return F.concat(*(x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)))


def _portable(key: Column, seed: int, number: int) -> Column:
    text = key.cast("string") if not seed else F.concat(F.lit(f"{seed}|"), key.cast("string"))
    if number == 3:
        text = F.concat(text, F.lit("|3"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 17 if number == 2 else 1, 15), 16, 10).cast("long")


def _fast(key: Column, seed: int, number: int) -> Column:
    return F.xxhash64(key, F.lit(seed * 4 + number)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


register_profile("portable", _portable)
register_profile("fast", _fast)


def hashes(key: Column, profile: str = "portable", seed: int = 0, count: int = 2) -> list[Column]:
    if profile not in PROFILES:
        raise InvalidParameters(f"unknown hash profile {profile}")
    return [PROFILES[profile](key, seed, i + 1) for i in range(count)]


def rehash(key: Column, i: int, profile: str = "portable", seed: int = 0) -> Column:
    """The i-th of independent hashes of a key."""
    return PROFILES[profile](F.concat(key.cast("string"), F.lit(f"#{i}")), seed, 1)


@dataclass(frozen=True)
class Strategy:
    """How k positions follow from so many hashes: ``position(h, i)`` of reduced hashes, before it is reduced itself.

    It is applied to columns and to arrays of 64-bit numbers alike, so it has only sums, differences and products, below 2^63.
    """

    hashes: int
    position: Callable[[list[Any], int], Any]


#: Registered index strategies.
STRATEGIES: dict[str, Strategy] = {
    "double": Strategy(2, lambda h, i: h[0] + i * h[1]),
    "enhanced": Strategy(2, lambda h, i: h[0] + i * h[1] + i * (i + 1) // 2),
    "triple": Strategy(3, lambda h, i: h[0] + i * h[1] + i * i * h[2]),
}


def register_strategy(name: str, hashes: int, position: Callable[[list[Any], int], Any]) -> None:
    """Add an index strategy of one's own, of two or three hashes."""
    if not 2 <= hashes <= 3:
        raise InvalidParameters("a strategy has two or three hashes")
    STRATEGIES[name] = Strategy(hashes, position)


def strategy_of(spec: Spec) -> Strategy:
    """The strategy of a spec; the partitioned layout always has the double one."""
    for name in (spec.strategy, "double"):
        if name not in STRATEGIES:
            raise InvalidParameters(f"unknown index strategy {name}")
    return STRATEGIES["double" if spec.layout == "partitioned" else spec.strategy]


def hash_count(spec: Spec) -> int:
    """Hashes that a key has: one for each position of the rehash layout, else those of the strategy."""
    return spec.k if spec.layout == "rehash" else strategy_of(spec).hashes


def indices(h: list[Any], m: int, k: int, strategy: Strategy) -> Iterator[Any]:
    """k positions below m, of columns or arrays."""
    reduced = [x % m for x in h[: strategy.hashes]]
    return (strategy.position(reduced, i) % m for i in range(k))


def _div(a: Column, n: int) -> Column:
    """Integer division without doubles."""
    return F.call_function("div", a, F.lit(n).cast("long"))


def place(spec: Spec) -> tuple[Callable[[Column], list[Column]], Callable[[list[Column]], list[tuple[Column, Column]]]]:
    """Two steps from a key to its (group, position) pairs: hashes, which are worth a projection of their own, and arithmetic on them."""
    zero = F.lit(0).cast("long")
    if spec.layout == "rehash":
        return (lambda key: [rehash(key, i, spec.profile, spec.seed) for i in range(spec.k)]), (lambda h: [(zero, x % spec.m) for x in h])
    count, how = hash_count(spec), strategy_of(spec)
    first = lambda key: hashes(key, spec.profile, spec.seed, count)
    if spec.layout == "standard":
        return first, lambda h: [(zero, x) for x in indices(h, spec.m, spec.k, how)]
    if spec.layout == "partitioned":
        return first, lambda h: [(F.lit(i).cast("long"), x) for i, x in enumerate(indices(h, spec.m, spec.k, how))]
    if spec.layout == "block":
        return first, lambda h: [(h[0] % spec.groups, (h[1] % 512 + i * (_div(h[1], 512) % 256 * 2 + 1)) % 512) for i in range(spec.k)]
    if spec.layout == "sharded":
        return first, lambda h: [(h[0] % spec.groups, x) for x in indices([_div(h[0], spec.groups), *h[1:]], spec.m, spec.k, how)]
    raise InvalidParameters(f"unknown layout {spec.layout}")
