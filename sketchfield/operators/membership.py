"""Build, probe, combine and measure filters.

A filter is a table of words (filter_id, grp, word, bits): 64 bits each, words without a bit left
out.  Building is one partial and final aggregation by OR; the partial one of a small filter sets bits
of a bitmap.  A probe either tests an Arrow batch of
hashes against the words as a broadcast bitmap, if the filter is known to be small, or looks the
words up in a join.  Null keys are not built in and probe to false.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IncompatibleFilters, IndexOutOfBounds, InvalidRange
from ..functions.hashing import Strategy, hash_count, indices, place, strategy_of
from ..plans.sizing import Spec

#: Filters of up to so many bytes are broadcast for a probe; larger ones are joined.
BROADCAST_BYTES = 32 << 20
#: Filters of up to so many bytes are built as a bitmap in each task.
TASK_BYTES = 8 << 20
_WORD = ["filter_id", "grp", "word"]
WORDS = "filter_id string, grp long, word long, bits long"


def _key(key: Column | str) -> Column:
    return F.col(key) if isinstance(key, str) else key


def positions(df: DataFrame, key: Column | str, spec: Spec, by: Sequence[Column | str] = (), distinct: bool = False) -> DataFrame:
    """The columns ``by`` with grp and pos: a row for each of a key's k positions (distinct ones only, if asked)."""
    first, second = place(spec)
    keyed = df.select(*by, _key(key).alias("_key")).where("_key is not null")
    hashed = keyed.withColumn("_h", F.array(*first(F.col("_key"))))
    at = second([F.col("_h")[i] for i in range(hash_count(spec))])
    pairs = F.array(*(F.struct(g.cast("long").alias("grp"), p.cast("long").alias("pos")) for g, p in at))
    names = [c for c in hashed.columns if c not in ("_key", "_h")]
    return hashed.select(*names, F.explode(F.array_distinct(pairs) if distinct else pairs).alias("_p")).select(*names, "_p.grp", "_p.pos")


def build(df: DataFrame, key: Column | str, spec: Spec, by: Column | str | None = None) -> DataFrame:
    """The words of one filter, or of one for each value of ``by``.

    One filter of at most ``TASK_BYTES`` is set bit by bit in each task and its words are merged; else
    positions are aggregated by word.
    """
    if by is None and spec.memory_bytes <= TASK_BYTES:
        return _merged_parts(_partial(df, key, spec))
    owner = F.lit("") if by is None else _key(by).cast("string")
    at = positions(df, key, spec, [owner.alias("filter_id")])
    bit = F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")
    return at.groupBy("filter_id", "grp", F.expr("pos div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))


def _merged_parts(parts: DataFrame) -> DataFrame:
    words = parts.groupBy("grp", "word").agg(F.bit_or("bits").alias("bits"))
    return words.select(F.lit("").alias("filter_id"), "grp", "word", "bits")


def _partial(df: DataFrame, key: Column | str, spec: Spec) -> DataFrame:
    """(grp, word, bits): what each task's keys set."""
    first, _ = place(spec)
    hashed = df.select(_key(key).alias("_key")).where("_key is not null").select(*(h.alias(f"h{i}") for i, h in enumerate(first(F.col("_key")))))
    stride, how = -(-spec.m // 64), strategy_of(spec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = None
        for batch in batches:
            if on is None:
                on = np.zeros(spec.groups * stride * 64, bool)
            for g, pos in slots([c.to_numpy() for c in batch.columns], spec, how):
                on[g * (stride * 64) + pos] = True
        if on is not None:
            words = np.packbits(on, bitorder="little").view(np.int64)
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at // stride), pa.array(at % stride), pa.array(words[at])], names=["grp", "word", "bits"])

    return hashed.mapInArrow(run, "grp long, word long, bits long")


def slots(h: list[np.ndarray], spec: Spec, how: Strategy | None = None) -> Iterator[tuple[np.ndarray | int, np.ndarray]]:
    """The k (group, position) pairs of keys with these hashes: ``hashing.place`` on arrays.

    ``how`` is the spec's strategy, looked up by the driver if it may be one that only the driver has registered.
    """
    m, k = spec.m, spec.k
    if spec.layout == "rehash":
        yield from ((0, x % m) for x in h)
        return
    if spec.layout == "block":
        g, start, step = h[0] % spec.groups, h[1] % 512, h[1] // 512 % 256 * 2 + 1
        yield from ((g, (start + i * step) % 512) for i in range(k))
        return
    g, lead = (h[0] % spec.groups, h[0] // spec.groups) if spec.layout == "sharded" else (0, h[0])
    for i, at in enumerate(indices([lead, *h[1:]], m, k, how or strategy_of(spec))):
        yield (i if spec.layout == "partitioned" else g), at


def bitmap(words: DataFrame, size: int, at: Column | None = None) -> np.ndarray:
    """Words as one array of ``size`` 64-bit numbers, each at its place; the caller has checked the size."""
    out = np.zeros(size, np.int64)
    got = words.select((F.col("word") if at is None else at).cast("long").alias("at"), "bits").toArrow()
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out


def probe(df: DataFrame, key: Column | str, words: DataFrame, spec: Spec, out: str = "maybe", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a boolean column: whether the key may be in the filter. False is certain."""
    if spec.memory_bytes <= broadcast_bytes:
        return _probe_bitmap(df, key, words, spec, out)
    return _probe_join(df, key, words, out, spec)


def _probe_bitmap(df: DataFrame, key: Column | str, words: DataFrame, spec: Spec, out: str) -> DataFrame:
    stride = -(-spec.m // 64)
    bits = df.sparkSession.sparkContext.broadcast(bitmap(words, spec.groups * stride, F.col("grp") * stride + F.col("word")))
    first, how = place(spec)[0], strategy_of(spec)

    @F.pandas_udf("boolean")
    def test(*h: pd.Series) -> pd.Series:
        a = [x.to_numpy() for x in h]
        w, ok = bits.value, a[0] >= 0
        for g, pos in slots(a, spec, how):
            ok &= (w[g * stride + (pos >> 6)] >> (pos & 63)) & 1 == 1
        return pd.Series(ok)

    # a null would make doubles of the batch's numbers, so it goes as -1
    return df.withColumn(out, test(*(F.coalesce(h, F.lit(-1).cast("long")) for h in first(_key(key)))))


def matching(keys: DataFrame, key: str, words: DataFrame, spec: Spec, by: Sequence[str] = ("filter_id",)) -> DataFrame:
    """(key, by): the filters that each distinct key may be in, looked up by joins.

    ``words`` may have more columns that tell filters apart; name them in ``by``.
    """
    distinct = keys.select(F.col(key).alias("k")).where("k is not null").distinct()
    at = positions(distinct, "k", spec, ["k"], distinct=True).select(
        "k",
        "grp",
        F.expr("pos div 64").alias("word"),
        F.expr("shiftleft(1L, CAST(pos % 64 AS INT))").alias("bit"),
    )
    need = at.groupBy("k", "grp", "word").agg(F.bit_or("bit").alias("need"))
    total = F.count(F.lit(1)).alias("n")
    have = need.join(words.select(*by, "grp", "word", "bits"), ["grp", "word"]).where(F.col("bits").bitwiseAND(F.col("need")) == F.col("need"))
    return have.groupBy("k", *by).agg(total).join(need.groupBy("k").agg(total), ["k", "n"]).select(F.col("k").alias(key), *by)


def _probe_join(df: DataFrame, key: Column | str, words: DataFrame, out: str, spec: Spec) -> DataFrame:
    own = df.withColumn("_probe", _key(key))
    keys = own.select(F.col("_probe").alias("k")).where("k is not null").distinct()
    need = F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")
    at = positions(keys, "k", spec, ["k"]).select("k", "grp", F.expr("pos div 64").alias("word"), need.alias("need"))
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("need")) != 0, F.lit(False))
    hits = at.join(words.select("grp", "word", "bits"), ["grp", "word"], "left").groupBy("k").agg(F.bool_and(hit).alias(out))
    return own.join(hits.withColumnRenamed("k", "_probe"), "_probe", "left").withColumn(out, F.coalesce(F.col(out), F.lit(False))).drop("_probe")


def semi_join(df: DataFrame, key: Column | str, words: DataFrame, spec: Spec) -> DataFrame:
    """Rows whose key may be in the filter."""
    return probe(df, key, words, spec, "_maybe").where("_maybe").drop("_maybe")


def anti_join(df: DataFrame, key: Column | str, words: DataFrame, spec: Spec) -> DataFrame:
    """Rows whose key is certainly not in the filter."""
    return probe(df, key, words, spec, "_maybe").where("not _maybe").drop("_maybe")


def first_seen(df: DataFrame, key: str, order: str, spec: Spec) -> DataFrame:
    """(key, order) of keys that a filter certainly didn't hold when they first came: check, then insert, in order.

    A position is set from its first arrival on, and a key that is taken for known sets nothing new.  So a
    key is new unless each of its positions has an earlier arrival than the key's first.
    """
    arrivals = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_n"))
    at = positions(arrivals, "_k", spec, ["_k", "_n"])
    since = at.groupBy("grp", "pos").agg(F.min("_n").alias("_since"))
    seen = at.join(since, ["grp", "pos"]).groupBy("_k", "_n").agg(F.bool_and(F.col("_since") < F.col("_n")).alias("_seen"))
    return seen.where("not _seen").select(F.col("_k").alias(key), F.col("_n").alias(order))


def _check(a: Spec, b: Spec) -> None:
    if not a.compatible(b):
        raise IncompatibleFilters(f"{a} and {b} have different bits for a key")


def union(a: DataFrame, b: DataFrame, a_spec: Spec, b_spec: Spec) -> DataFrame:
    _check(a_spec, b_spec)
    return merged(a.unionByName(b))


def merged(words: DataFrame) -> DataFrame:
    """Words of the same filters from several tables, in one."""
    return words.groupBy(*_WORD).agg(F.bit_or("bits").alias("bits"))


def union_many(words: DataFrame) -> DataFrame:
    """All filters of a table in one, in one aggregation."""
    return words.groupBy("grp", "word").agg(F.bit_or("bits").alias("bits")).select(F.lit("").alias("filter_id"), "grp", "word", "bits")


def intersect_many(words: DataFrame, filters: int) -> DataFrame:
    """The bits that all of so many filters have."""
    both = words.groupBy("grp", "word").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return both.where(f"n = {filters} and bits != 0").select(F.lit("").alias("filter_id"), "grp", "word", "bits")


def intersect(a: DataFrame, b: DataFrame, a_spec: Spec, b_spec: Spec) -> DataFrame:
    _check(a_spec, b_spec)
    both = a.join(b.withColumnRenamed("bits", "other"), _WORD)
    return both.select(*_WORD, F.col("bits").bitwiseAND(F.col("other")).alias("bits")).where("bits != 0")


def xor(a: DataFrame, b: DataFrame, a_spec: Spec, b_spec: Spec) -> DataFrame:
    _check(a_spec, b_spec)
    return a.unionByName(b).groupBy(*_WORD).agg(F.bit_xor("bits").alias("bits")).where("bits != 0")


def compare(a: DataFrame, b: DataFrame, a_spec: Spec, b_spec: Spec) -> DataFrame:
    """One row: bits of the union, intersection and difference, Jaccard, subset, disjoint, equal."""
    _check(a_spec, b_spec)
    both = a.select("grp", "word", F.col("bits").alias("x")).join(b.select("grp", "word", F.col("bits").alias("y")), ["grp", "word"], "full")
    x, y = F.coalesce("x", F.lit(0).cast("long")), F.coalesce("y", F.lit(0).cast("long"))
    n = lambda c: F.coalesce(F.sum(F.bit_count(c).cast("long")), F.lit(0).cast("long"))
    row = both.agg(
        n(x.bitwiseOR(y)).alias("union_bits"),
        n(x.bitwiseAND(y)).alias("common_bits"),
        n(x.bitwiseXOR(y)).alias("hamming"),
        n(x).alias("a_bits"),
        n(y).alias("b_bits"),
    )
    c, u = F.col("common_bits"), F.col("union_bits")
    return row.select(
        "*",
        F.when(u == 0, 1.0).otherwise(c / u).alias("jaccard"),
        (c == F.col("a_bits")).alias("a_in_b"),
        (c == 0).alias("disjoint"),
        (F.col("hamming") == 0).alias("equal"),
    )


def set_range(words: DataFrame, m: int, start: int, stop: int, value: bool = True) -> DataFrame:
    """Bits [start, stop) of an ungrouped filter set or cleared."""
    if not 0 <= start <= stop <= m:
        raise InvalidRange(f"[{start}, {stop}) is not in [0, {m})")
    w = F.col("id")
    low, high = F.greatest(F.lit(start) - w * 64, F.lit(0)), F.least(F.lit(stop) - w * 64, F.lit(64))
    ones = lambda n: F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - n).cast("int")))
    mask = words.sparkSession.range(start // 64, max(start // 64, -(-stop // 64))).where(high > low).select(
        F.lit("").alias("filter_id"),
        F.lit(0).cast("long").alias("grp"),
        w.alias("word"),
        ones(high).bitwiseXOR(ones(low)).alias("mask"),
    )
    both = words.join(mask, _WORD, "full").select(
        *_WORD,
        F.coalesce("bits", F.lit(0).cast("long")).alias("b"),
        F.coalesce("mask", F.lit(0).cast("long")).alias("k"),
    )
    changed = F.col("b").bitwiseOR(F.col("k")) if value else F.col("b").bitwiseAND(F.bitwise_not(F.col("k")))
    return both.select(*_WORD, changed.alias("bits")).where("bits != 0")


def get_bit(words: DataFrame, m: int, pos: int) -> DataFrame:
    if not 0 <= pos < m:
        raise IndexOutOfBounds(f"{pos} is not in [0, {m})")
    return words.where(f"word = {pos // 64}").agg(F.coalesce(F.max(F.getbit("bits", F.lit(pos % 64))) == 1, F.lit(False)).alias("bit"))


def set_bit(words: DataFrame, m: int, pos: int, value: bool = True) -> DataFrame:
    """One bit set, or cleared."""
    if not 0 <= pos < m:
        raise IndexOutOfBounds(f"{pos} is not in [0, {m})")
    return set_range(words, m, pos, pos + 1, value)


def get_range(words: DataFrame, m: int, start: int, stop: int) -> DataFrame:
    """(pos, bit) for each of the bits [start, stop) of an ungrouped filter."""
    if not 0 <= start <= stop <= m:
        raise InvalidRange(f"[{start}, {stop}) is not in [0, {m})")
    own = words.where(F.col("word").between(start // 64, max(start, stop - 1) // 64)).select("word", "bits")
    at = words.sparkSession.range(start, stop).select(F.col("id").alias("pos"), F.expr("id div 64").alias("word"))
    bit = F.coalesce(F.expr("shiftright(bits, CAST(pos % 64 AS INT)) & 1"), F.lit(0).cast("long"))
    return at.join(own, "word", "left").select("pos", (bit == 1).alias("bit"))


def is_zero_range(words: DataFrame, m: int, start: int, stop: int) -> DataFrame:
    """One row: whether none of the bits [start, stop) is set."""
    return get_range(words, m, start, stop).agg((F.count(F.when(F.col("bit"), 1)) == 0).alias("is_zero"))


def rotated(bits: Column, n: int) -> Column:
    """A word with its bits moved n places up, those beyond the top at the bottom."""
    n %= 64
    return bits if not n else F.shiftleft(bits, n).bitwiseOR(F.shiftrightunsigned(bits, 64 - n))


def hamming(a: Column, b: Column) -> Column:
    """In how many bits two words differ."""
    return F.bit_count(a.bitwiseXOR(b))


def is_empty(words: DataFrame) -> DataFrame:
    """One row: whether no bit is set."""
    return words.where("bits != 0").agg((F.count(F.lit(1)) == 0).alias("is_empty"))


def set_positions(words: DataFrame) -> DataFrame:
    """(filter_id, grp, pos) of the bits that are set."""
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.getbit(F.col("bits"), i) == 1, i)), lambda i: i.isNotNull())
    return words.select("filter_id", "grp", "word", F.explode(bits).alias("i")).select("filter_id", "grp", (F.col("word") * 64 + F.col("i")).alias("pos"))


def empty(words: DataFrame) -> DataFrame:
    """A cleared filter."""
    return words.limit(0)


def statistics(words: DataFrame, spec: Spec, by: Iterable[str] = ()) -> DataFrame:
    """Set bits, fill, estimated rate and cardinality; one row, or one for each value of ``by``."""
    m, k, by = spec.bits, spec.k, list(by)
    set_bits = F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0).cast("long"))
    size = spec.m if "grp" in by else m
    rows = words.groupBy(*by).agg(set_bits.alias("set_bits"))
    fill = F.col("set_bits") / F.lit(float(size))
    estimate = F.when(F.col("set_bits") == 0, F.lit(0).cast("long")).when(F.col("set_bits") < size, F.floor(-(size / k) * F.ln(1 - fill)).cast("long"))
    return rows.select(
        *by,
        "set_bits",
        fill.alias("fill_rate"),
        F.pow(fill, F.lit(float(k))).alias("estimated_fpr"),
        estimate.alias("estimated_items"),
        (fill > 0.5).alias("saturated"),
    )


def imbalance(groups: DataFrame, level: float = 0.2) -> DataFrame:
    """``statistics`` by group with whether one is off the mean by more than a share of it."""
    mean = groups.agg(F.avg("set_bits").alias("_mean"))
    # one row is broadcast
    return groups.crossJoin(F.broadcast(mean)).withColumn("imbalanced", F.abs(F.col("set_bits") - F.col("_mean")) > level * F.col("_mean")).drop("_mean")


def stripes(words: DataFrame, spec: Spec, count: int = 256) -> DataFrame:
    """(stripe, set_bits) of so many equal ranges of bits."""
    return set_positions(words).groupBy(F.expr(f"pos * {count} div {spec.m}").alias("stripe")).agg(F.count(F.lit(1)).alias("set_bits"))


def health(words: DataFrame, spec: Spec, levels: tuple[float, float] = (0.5, 0.7)) -> DataFrame:
    """The statistics with Healthy, Degraded or Critical, by fill and by the rate against its target."""
    s = statistics(words, spec)
    ratio = F.col("estimated_fpr") / spec.target_fpr if spec.target_fpr else F.lit(1.0)
    state = F.when((F.col("fill_rate") < levels[0]) & (ratio < 2), "Healthy").when(
        (F.col("fill_rate") < levels[1]) & (ratio < 5),
        "Degraded",
    ).otherwise("Critical")
    return s.select("*", ratio.alias("fpr_ratio"), state.alias("state"))


def group_health(words: DataFrame, spec: Spec, levels: tuple[float, float] = (0.7, 0.9)) -> DataFrame:
    """One row over a filter's groups: their mean and largest fill, the rate, a warning if it is over twice its target, and Healthy, Degraded or Critical."""
    groups = words.sparkSession.range(spec.groups).withColumnRenamed("id", "grp").join(
        statistics(words, spec, ["grp"]).select("grp", "fill_rate"),
        "grp",
        "left",
    )
    row = groups.agg(F.avg(F.coalesce("fill_rate", F.lit(0.0))).alias("mean_fill"), F.max(F.coalesce("fill_rate", F.lit(0.0))).alias("max_fill"))
    rate = F.pow("mean_fill", F.lit(float(spec.k)))
    state = F.when(F.col("max_fill") < levels[0], "Healthy").when(F.col("max_fill") < levels[1], "Degraded").otherwise("Critical")
    return row.select(
        "mean_fill",
        "max_fill",
        rate.alias("estimated_fpr"),
        (rate > 2 * spec.target_fpr if spec.target_fpr else F.lit(False)).alias("warning"),
        state.alias("state"),
    )


def item_estimates(words: DataFrame, spec: Spec, items: int) -> DataFrame:
    """One row: the rate by item count with and without collisions of groups, and the item estimate, exact while the fill is under 1 %."""
    by_bits, by_group = (1 - exp(-spec.k * items / spec.bits)) ** spec.k, (1 - exp(-items / spec.m)) ** spec.k
    s = statistics(words, spec)
    guess = F.when(F.col("fill_rate") < 0.01, F.lit(items).cast("long")).otherwise(F.col("estimated_items"))
    return s.select(
        F.lit(by_bits).alias("fpr_by_items"),
        F.lit(by_group).alias("fpr_by_partition"),
        guess.alias("estimated_items"),
        (F.col("fill_rate") > 0.7).alias("should_resize"),
    )
