"""Filters that grow in slices, by order of arrival.

Which slice an arrival goes to depends only on its rank, so a batch is assigned by comparing rows
with the slices' first arrivals.  Where ranks themselves are wanted, they are counted in two levels, in ranges of
the order columns and then inside each range, so no task sorts the whole input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParameters, MaxFiltersExceeded
from ..functions.hashing import Strategy, place, strategy_of
from ..plans.sizing import standard
from ..plans.slices import LEAST_RATE, MAX_SLICES, Growth, Slice, next_ratio, slice_plan
from . import cardinality, membership
from .scratch import drop_folder, shared_folder, stored

RANGE_ROWS = 100_000  # about so many rows are ranked in a task
MOST_RANGES = 4  # that are cut by literals
_BLOCK = 22  # bits of a position in a block of a slice
_PACK_ROWS = 1 << 17  # rows, or keys, whose positions a task packs together
_LEAD = 2  # positions of a key that are looked up first
_SAMPLES = 40  # for each range
_SAMPLED = 40_000  # rows that a round of the search for first arrivals takes, and how many rounds it has
_ROUNDS = 8


def _ordered(df: DataFrame, order: Sequence[str]) -> Column:
    """The order columns as one value; times as numbers, so that a sampled one can be a literal."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    own = [F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith("timestamp") or kinds[c] == "date" else F.col(c) for c in order]
    return F.struct(*(x.alias(f"o{i}") for i, x in enumerate(own)))


def _literal(row: object, kind: str) -> Column:
    return F.struct(*(F.lit(x) for x in row)).cast(kind)  # type: ignore[attr-defined]


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank", rows: int | None = None) -> DataFrame:
    """``df`` with each row's rank, from 1, in a total order of the columns, nulls first.

    Rows of more than ``MOST_RANGES`` ranges are dealt by Spark's range partitioning and stored in order, so that no row is compared
    with more cuts than a binary search takes.  Fewer ranges are cut at sampled values of all order columns, which are literals
    of the plan, so a repeated task deals rows alike; both give the same ranks.
    """
    rows = df.count() if rows is None else rows
    ranges = -(-rows // RANGE_ROWS)
    if ranges > MOST_RANGES:
        return _ranked_in_table(df, order, name, ranges)
    key = _ordered(df, order)
    if ranges > 1:
        share = min(1.0, ranges * _SAMPLES / rows)
        chosen = df.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30)))
        kind = chosen.schema["k"].dataType.simpleString()
        values = [r["k"] for r in chosen.orderBy("k").collect()]  # about _SAMPLES * MOST_RANGES rows at most
        cuts = list(dict.fromkeys(values[i * len(values) // ranges] for i in range(1, ranges))) if values else []
        width = max(1, math.isqrt(len(cuts)))
        groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    else:
        groups = []
    if groups:
        lead = F.array(*(_literal(g[0], kind) for g in groups))
        inner = F.array(*(F.array(*(_literal(x, kind) for x in g)) for g in groups))
        below = lambda cut: cut <= key
        at = F.size(F.filter(lead, below))
        part = F.when(at == 0, F.lit(0)).otherwise((at - 1) * width + F.size(F.filter(F.get(inner, at - 1), below)))
    else:
        part = F.lit(0)
    parts = df.withColumn("_part", part.cast("int"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if groups:  # a range is a task, whatever the number of shuffle partitions
        parts = parts.repartitionById(len(cuts) + 1, "_part")
    parts = parts.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    # MOST_RANGES rows at most
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def _ranked_in_table(df: DataFrame, order: Sequence[str], name: str, ranges: int) -> DataFrame:
    """Rows in order as a table in the shared folder, each with its partition and place there, and the rows before its partition."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "ranked")
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the lower bits count the rows of a partition
    dealt.withColumn("_part", F.spark_partition_id()).withColumn("_in", place + 1).write.parquet(path)
    parts = spark.read.parquet(path)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # a row for each range
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def slice_of(rank: Column, plan: list[Slice]) -> Column:
    """The slice of an arrival; the last takes what is beyond the plan."""
    return reduce(lambda found, s: F.when(rank >= s.first, F.lit(s.number)).otherwise(found), plan, F.lit(0))


def assigned(df: DataFrame, order: Sequence[str], plan: list[Slice], strict: bool = False, rows: int | None = None, before: int = 0) -> DataFrame:
    """``df`` with its slice, of arrivals after so many ``before``. ``strict``: more arrivals than the plan holds are an error.

    Beyond ``MOST_RANGES`` ranges only the first arrivals of slices are looked for, and rows are compared with them: no row moves.
    """
    rows = df.count() if rows is None else rows
    if strict and before + rows >= plan[-1].first + plan[-1].threshold:
        raise MaxFiltersExceeded("more arrivals than the slices hold")
    opened = [s for s in plan if 1 < s.first - before <= rows]
    if rows > MOST_RANGES * RANGE_ROWS:
        firsts = _first_values(df, order, [s.first - before for s in opened], rows)
        if firsts is not None:
            open_before = [0, *(s.number for s in plan if s.first - before <= 1)][-1]
            return df.withColumn("slice", _dealt(_ordered(df, order), firsts, [open_before, *(s.number for s in opened)]))
    out = ranked(df, order, "_rank", rows)
    return out.withColumn("slice", slice_of(F.col("_rank") + F.lit(before), plan)).drop("_rank")


def _dealt(key: Column, cuts: list[Column], numbers: Sequence[int]) -> Column:
    """The number of the range that a key is in, from rising first values of all but the first range: a binary search in which each value is named once."""
    if not cuts:
        return F.lit(numbers[0])
    mid = len(cuts) // 2
    return F.when(cuts[mid] <= key, _dealt(key, cuts[mid + 1 :], numbers[mid + 1 :])).otherwise(_dealt(key, cuts[:mid], numbers[: mid + 1]))


def _first_values(df: DataFrame, order: Sequence[str], firsts: list[int], rows: int) -> list[Column] | None:
    """The order columns' values at these ranks as literals; None if a row before has the same value, so that ranks cut ties.

    Around each rank, a range between two sampled values is counted and sampled again until it has at most ``RANGE_ROWS`` rows.
    Only the rows of these ranges are sorted, a range in a task.
    """
    if not firsts:
        return []
    keys = df.select(_ordered(df, order).alias("_k"))
    kind = keys.schema["_k"].dataType.simpleString()
    ranks = sorted({r for first in firsts for r in (first - 1, first)})
    cuts: list[object] = []
    counts = {0: rows}
    for _ in range(_ROUNDS):
        start = np.cumsum([0, *(counts.get(p, 0) for p in range(len(cuts) + 1))]).tolist()
        at = {r: int(np.searchsorted(start, r)) - 1 for r in ranks}
        parted = keys.select("_k", _dealt(F.col("_k"), [_literal(c, kind) for c in cuts], range(len(cuts) + 1)).alias("_p"))
        parted = parted.where(F.col("_p").isin(sorted(set(at.values()))))
        wide = {p for p in at.values() if counts[p] > RANGE_ROWS}
        if not wide:
            break
        share = min(1.0, _SAMPLED / sum(counts[p] for p in wide))
        chosen = parted.where(F.col("_p").isin(sorted(wide)) & (F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) < int(share * (1 << 30))))
        values: dict[int, list[object]] = {}
        for r in chosen.orderBy("_k").collect():  # about _SAMPLED rows
            values.setdefault(r["_p"], []).append(r["_k"])
        new: list[object] = []
        for p in sorted(set(at.values())):
            own, near = values.get(p, []), set()
            for r in (r for r in ranks if at[r] == p and p in wide):
                share_ = (r - start[p]) / counts[p]
                off = 4 * math.sqrt(len(own) * share_ * (1 - share_)) + 4
                near |= {math.floor(share_ * len(own) - off), math.ceil(share_ * len(own) + off)}
            for c in [*cuts[max(0, p - 1) : p], *(own[i] for i in sorted(near) if 0 <= i < len(own)), *cuts[p : p + 1]]:
                if not new or not _same(new[-1], c):
                    new.append(c)
        if len(new) == len(cuts) and all(map(_same, new, cuts)):  # rows of one value
            return None
        cuts = new
        own_part = _dealt(F.col("_k"), [_literal(c, kind) for c in cuts], range(len(cuts) + 1))
        counts = {r["_p"]: r["count"] for r in keys.groupBy(own_part.alias("_p")).count().collect()}  # a few for each slice
    else:
        return None
    ranked_in = parted.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy("_k")))
    wanted = [(F.col("_p") == at[r]) & (F.col("_n") == r - start[at[r]]) for r in ranks]
    got = {start[r["_p"]] + r["_n"]: r["_k"] for r in ranked_in.where(reduce(Column.__or__, wanted, F.lit(False))).collect()}  # two for each slice
    if any(_same(got[first - 1], got[first]) for first in firsts):
        return None
    return [_literal(got[first], kind) for first in firsts]


def _same(a: object, b: object) -> bool:
    return a == b or repr(a) == repr(b)  # a NaN is the same as another


def _stride(s: Slice) -> int:
    """Words of a shard."""
    return -(-s.spec.m // 64)


def _hashed(df: DataFrame, key: str, plan: list[Slice], *more: str) -> DataFrame:
    """The columns ``more`` and the hashes, of rows with a key."""
    first, _ = place(plan[0].spec)
    return df.where(F.col(key).isNotNull()).select(*more, *(h.alias(f"_h{i}") for i, h in enumerate(first(F.col(key)))))


def _slots(h: list[np.ndarray], s: Slice, how: Strategy) -> Iterator[np.ndarray]:
    """The k positions of keys with these hashes in a slice, shard after shard."""
    wide = 64 * _stride(s)
    return (g * wide + pos for g, pos in membership.slots(h, s.spec, how))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``_PACK_ROWS``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _PACK_ROWS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _thin(at: np.ndarray) -> bytes:
    """Rising numbers below 2^32: their gaps, compressed, the bytes of one weight together; the denser they are, the fewer bytes."""
    gaps = np.diff(at, prepend=0).astype("<u4")
    return len(at).to_bytes(4, "little") + pa.compress(gaps.view("u1").reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _full(thin: bytes) -> np.ndarray:
    n = int.from_bytes(thin[:4], "little")
    gaps = np.frombuffer(pa.decompress(thin[4:], 4 * n, "zstd", asbytes=True), "u1").reshape(4, n)
    return np.cumsum(np.ascontiguousarray(gaps.T).view("<u4")[:, 0], dtype=np.int64)


def _by_block(at: np.ndarray, wide: int) -> Iterator[tuple[int, slice]]:
    """Each block that sorted positions fall in, with where they are."""
    block = at >> wide
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(at) else []
    for i, z in zip(start, [*start[1:], len(at)]):
        yield int(block[i]), slice(i, z)


def _packed(number: int, at: np.ndarray, wide: int) -> pa.RecordBatch:
    """(slice, block, at): distinct positions by block, as thinned places there."""
    at = np.sort(at)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    rows = [(number, block, _thin(at[own] & ((1 << wide) - 1))) for block, own in _by_block(at, wide)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["slice", "block", "at"])


def build(df: DataFrame, key: str, plan: list[Slice]) -> DataFrame:
    """Words of all slices, slice as filter_id, of rows that have a slice: one pass over the rows.

    A task packs the positions of ``_PACK_ROWS`` rows by blocks of 4 million bits, and blocks are set one after the other, in as many
    tasks as the slices' bits need: what a task holds depends neither on the rows nor on the size of a slice.
    """
    how, wide = [strategy_of(s.spec) for s in plan], _BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            number, h = batch.column(0).to_numpy(), [c.to_numpy() for c in batch.columns[1:]]
            for s, strategy in zip(plan, how):
                own = np.flatnonzero(number == s.number)
                if len(own):
                    yield _packed(s.number, np.concatenate(list(_slots([x[own] for x in h], s, strategy))), wide)

    def words(on: np.ndarray, number: int, block: int) -> pa.RecordBatch:
        bits = np.packbits(on, bitorder="little").view("<i8")
        at = np.flatnonzero(bits)
        columns = [pa.array([str(number)] * len(at)), pa.array(np.zeros(len(at), np.int64)), pa.array(at + (block << wide - 6)), pa.array(bits[at])]
        return pa.RecordBatch.from_arrays(columns, names=["filter_id", "grp", "word", "bits"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, on = None, np.zeros(1 << wide, bool)
        for batch in batches:
            for *own, at in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last != own:
                    yield words(on, *last)
                    on[:] = False
                last = own
                on[_full(at)] = True
        if last is not None:
            yield words(on, *last)

    parts = _hashed(df, key, plan, "slice").mapInArrow(pack, "slice int, block long, at binary")
    tasks = sum(-(-64 * s.spec.groups * _stride(s) >> wide) for s in plan)
    return parts.repartition(max(1, -(-tasks // 4)), "slice", "block").sortWithinPartitions("slice", "block").mapInArrow(put, membership.WORDS)


def _split(plan: list[Slice], most: int) -> tuple[list[Slice], list[Slice]]:
    """The smallest slices whose words are at most so many bytes together, and the others."""
    small, room = set(), most
    for s in sorted(plan, key=lambda s: s.spec.groups * _stride(s)):
        room -= 8 * s.spec.groups * _stride(s)
        if room < 0:
            break
        small.add(s.number)
    return [s for s in plan if s.number in small], [s for s in plan if s.number not in small]


def masks(df: DataFrame, key: str, words: DataFrame, plan: list[Slice], out: str = "mask", broadcast_bytes: int | None = None, parts: bool = False) -> DataFrame:
    """``df`` with a number whose bit i says that the key may be in slice i; null keys are in none.

    The smallest slices are one broadcast bitmap of at most ``broadcast_bytes`` (``membership.BROADCAST_BYTES`` by default), as
    the plan tells; only larger ones are joined.  Of slices that grow geometrically these are the last few.  ``parts``: the words
    are read from stored tables that may share some, and only those of the smallest slices are merged.
    """
    if max(s.number for s in plan) >= MAX_SLICES:
        raise MaxFiltersExceeded(f"a plan has at most {MAX_SLICES} slices")
    small, large = _split(plan, membership.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)
    if not large:
        return _masks_bitmap(df, key, words, small, out, parts)
    words = words if parts else stored(words, shared_folder(words.sparkSession, "slices"))  # read more than once
    found = _masks_bitmap(df, key, words, small, out, parts) if small else df.withColumn(out, F.lit(0).cast("long"))
    own = _joined(df, key, words, large).withColumnRenamed("k", "_k")
    return found.join(own, found[key] == own["_k"], "left").withColumn(out, F.col(out).bitwiseOR(F.coalesce("_more", F.lit(0).cast("long")))).drop("_k", "_more")


def _key_masks(df: DataFrame, key: str, words: DataFrame, plan: list[Slice], out: str, broadcast_bytes: int | None = None, parts: bool = False) -> DataFrame:
    """(key, out): ``masks`` of the distinct keys, null among them, without a join of these keys with themselves."""
    small, large = _split(plan, membership.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)
    if not large or max(s.number for s in plan) >= MAX_SLICES:
        return masks(df.select(key).distinct(), key, words, plan, out, broadcast_bytes, parts)
    words = words if parts else stored(words, shared_folder(words.sparkSession, "slices"))  # read more than once
    own = _joined(df, key, words, large).withColumnRenamed("k", key)
    found = _masks_bitmap(own, key, words, small, out, parts) if small else own.withColumn(out, F.lit(0).cast("long"))
    return found.select(key, F.col(out).bitwiseOR(F.col("_more")).alias(out))


def _masks_bitmap(df: DataFrame, key: str, words: DataFrame, plan: list[Slice], out: str, parts: bool = False) -> DataFrame:
    stride = [s.spec.groups * _stride(s) for s in plan]
    start = np.concatenate([[0], np.cumsum(stride)]).tolist()
    base = F.get(F.array(*(F.lit(x).cast("long") for x in _by_number(plan, start))), F.col("filter_id").cast("int"))
    own = words.where(F.col("filter_id").isin([str(s.number) for s in plan]))
    own = membership.merged(own) if parts else own
    bits = df.sparkSession.sparkContext.broadcast(membership.bitmap(own, start[-1], base + F.col("word")))
    first, _ = place(plan[0].spec)

    @F.pandas_udf("long")
    def test(*h: pd.Series) -> pd.Series:
        a = [x.to_numpy() for x in h]
        w, found = bits.value, np.zeros(len(a[0]), np.int64)
        for s, at in zip(plan, start):
            ok = a[0] >= 0
            for g, pos in membership.slots(a, s.spec):
                ok &= (w[at + g * _stride(s) + (pos >> 6)] >> (pos & 63)) & 1 == 1
            found |= ok.astype(np.int64) << s.number
        return pd.Series(found)

    return df.withColumn(out, test(*(F.coalesce(h, F.lit(-1).cast("long")) for h in first(F.col(key)))))


def _by_number(plan: list[Slice], start: list[int]) -> list[int]:
    """Each slice's place in the bitmap, by its number."""
    out = [0] * (max(s.number for s in plan) + 1)
    for s, at in zip(plan, start):
        out[s.number] = at
    return out


def _joined(df: DataFrame, key: str, words: DataFrame, plan: list[Slice]) -> DataFrame:
    """(k, _more): each distinct key, null among them, with a mask of the slices that it may be in.

    Keys are stored as bundles of ``_PACK_ROWS``, in which all slices are open first.  A bundle asks each block of a slice in one row
    for all places that it needs there, sorted and thinned, and gets a bit for each back, whether it misses; which key asked for which
    place is found by hashing the bundle's keys again.  The first ``_LEAD`` positions close a slice for nearly all keys that it doesn't
    hold, and the others are looked up for the rest.
    """
    keys = df.select(F.col(key).alias("k")).distinct()
    folder = shared_folder(df.sparkSession, "lookup")
    every = sum(1 << s.number for s in plan)
    state = stored(_bundled(keys), f"{folder}/first")
    state = state.withColumn("mask", F.transform("k", lambda x: F.when(x.isNull(), F.lit(0)).otherwise(F.lit(every - (every >> 63 << 64))).cast("long")))
    blocks = sum(-(-64 * s.spec.groups * _stride(s) >> _BLOCK) for s in plan)
    have = _word_blocks(words.where(F.col("filter_id").isin([str(s.number) for s in plan])))
    for lo, hi in ((0, _LEAD), (_LEAD, None)):
        both = _asked(_rehashed(state, plan), plan, lo, hi).union(have).repartition(max(1, -(-blocks // 4)), "slice", "block")
        misses = _missed(both.sortWithinPartitions("slice", "block", "bundle"))
        told = misses.groupBy("bundle").agg(F.collect_list(F.struct("slice", "block", "missed")).alias("told"))
        state = _closed(_rehashed(state.join(told, "bundle", "left"), plan), state, plan, lo, hi)
        if hi:
            state = stored(state, f"{folder}/open")  # read twice
            drop_folder(df.sparkSession, f"{folder}/first")
    return state.select(F.explode(F.arrays_zip("k", "mask")).alias("_x")).select("_x.k", F.col("_x.mask").alias("_more"))


def _bundled(keys: DataFrame) -> DataFrame:
    """(bundle, k): about ``_PACK_ROWS`` keys in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33  # type: ignore[union-attr]
        for batch in _gathered(batches):
            if batch.num_rows:
                k = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([number]), k], names=["bundle", "k"])
                number += 1

    kind = T.StructType([T.StructField("bundle", T.LongType()), T.StructField("k", T.ArrayType(keys.schema["k"].dataType))])
    return keys.mapInArrow(run, kind)


def _rehashed(state: DataFrame, plan: list[Slice]) -> DataFrame:
    """Bundles with an array of each hash of their keys, -1 for null."""
    first, _ = place(plan[0].spec)

    def hashed(i: int) -> Column:
        return F.transform("k", lambda x: F.coalesce(first(x)[i], F.lit(-1).cast("long")))

    return state.select("*", *(hashed(i).alias(f"_h{i}") for i in range(len(first(F.lit(None))))))


def _wanted(mask: np.ndarray, h: list[np.ndarray], s: Slice, how: Strategy, lo: int, hi: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The positions from ``lo`` to ``hi`` of keys for which a slice is open, one after the other, and these keys' numbers."""
    rows = np.flatnonzero(mask >> s.number & 1)
    slots = list(islice(_slots([x[rows] for x in h], s, how), lo, hi)) if len(rows) else []
    return (np.concatenate(slots), np.tile(rows, len(slots))) if slots else (np.zeros(0, np.int64), rows)


_ASKED = "slice int, block long, bundle long, at binary, value binary"
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _cells(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=["slice", "block", "bundle", "at", "value"])


def _asked(state: DataFrame, plan: list[Slice], lo: int, hi: int | None) -> DataFrame:
    """``_ASKED`` of bundles: the sorted positions from ``lo`` to ``hi`` of keys in slices that are open, by block."""
    how, wide = [strategy_of(s.spec) for s in plan], _BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, bundle in enumerate(batch.column("bundle").to_pylist()):
                mask, *h = (batch.column(c)[i].values.to_numpy() for c in ["mask", *(n for n in batch.schema.names if n.startswith("_h"))])
                for s, strategy in zip(plan, how):
                    at = np.sort(_wanted(mask, h, s, strategy, lo, hi)[0])
                    if len(at):
                        yield _cells([(s.number, block, bundle, _thin(at[own] & ((1 << wide) - 1)), b"") for block, own in _by_block(at, wide)])

    return state.mapInArrow(run, _ASKED)


def _word_blocks(words: DataFrame) -> DataFrame:
    """``_ASKED`` of words: their places and bits, as a bundle of -1, which comes first in a block."""
    wide = _BLOCK - 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            number, word, bits = (c.to_numpy() for c in batch.columns)
            for n in np.unique(number).tolist():
                own = np.flatnonzero(number == n)
                own = own[np.argsort(word[own], kind="stable")]
                at, value = word[own], bits[own].astype("<i8")
                yield _cells([(n, block, -1, _thin(at[x] & ((1 << wide) - 1)), value[x].tobytes()) for block, x in _by_block(at, wide)])

    return words.select(F.col("filter_id").cast("int"), "word", "bits").mapInArrow(run, _ASKED)


def _missed(both: DataFrame) -> DataFrame:
    """(bundle, slice, block, missed): a bit for each place that a bundle asks for, set if the block's bit isn't; of rows that are ordered by slice, block and bundle."""
    wide = _BLOCK - 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, on = None, np.zeros(1 << wide, np.int64)
        for batch in batches:
            found: list[tuple[int, int, int, bytes]] = []
            for *own, who, at, value in zip(*(c.to_pylist() for c in batch.columns)):
                if own != last:
                    last = own
                    on[:] = 0
                place_ = _full(at)
                if who < 0:
                    np.bitwise_or.at(on, place_, np.frombuffer(value, "<i8"))
                else:
                    found.append((who, *own, np.packbits(on[place_ >> 6] >> (place_ & 63) & 1 == 0).tobytes()))
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["bundle", "slice", "block", "missed"])

    return both.mapInArrow(run, "bundle long, slice int, block long, missed binary")


def _closed(left: DataFrame, state: DataFrame, plan: list[Slice], lo: int, hi: int | None) -> DataFrame:
    """Bundles with the slices closed of which keys miss a position from ``lo`` to ``hi``, as they are ``told``."""
    names, how, wide = state.columns, [strategy_of(s.spec) for s in plan], _BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks_ = []
            for i in range(batch.num_rows):
                mask, *h = (batch.column(c)[i].values.to_numpy() for c in ["mask", *(n for n in batch.schema.names if n.startswith("_h"))])
                own, told = mask.copy(), {(x["slice"], x["block"]): x["missed"] for x in batch.column("told")[i].as_py() or []}
                for s, strategy in zip(plan, how):
                    at, rows = _wanted(mask, h, s, strategy, lo, hi)
                    order = np.argsort(at)
                    for block, x in _by_block(at[order], wide):
                        lost = np.unpackbits(np.frombuffer(told[s.number, block], "u1"), count=x.stop - x.start) == 1
                        own[rows[order[x][lost]]] &= ~np.left_shift(np.int64(1), np.int64(s.number))
                masks_.append(own)
            ends = pa.array(np.cumsum([0, *map(len, masks_)]), pa.int32())
            new = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(masks_) if masks_ else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([new if c == "mask" else batch.column(c) for c in names], names=names)

    return left.mapInArrow(run, state.schema)


def matches(df: DataFrame, key: str, words: DataFrame, plan: list[Slice], broadcast_bytes: int | None = None) -> DataFrame:
    """(key, slice) for each slice that a distinct key may be in: ``masks`` as rows."""
    found = _key_masks(df.where(F.col(key).isNotNull()), key, words, plan, "_mask", broadcast_bytes)
    return found.select(key, F.explode(_bits(F.col("_mask"), plan)).alias("slice"))


def _bits(mask: Column, plan: list[Slice]) -> Column:
    """The numbers of the slices in a mask, rising."""
    return F.filter(F.array(*(F.when(F.getbit(mask, F.lit(s.number)) == 1, F.lit(s.number)) for s in plan)), lambda x: x.isNotNull())


def provenance(df: DataFrame, key: str, words: DataFrame, plan: list[Slice], newest_first: bool = False, parts: bool = False) -> DataFrame:
    """(key, slice): the first slice, or the last, that each distinct key may be in; null if none. ``parts``: see ``masks``."""
    found = _key_masks(df, key, words, plan, "_mask", parts=parts)
    own = _bits(F.col("_mask"), plan)
    return found.select(key, (F.array_max(own) if newest_first else F.array_min(own)).alias("slice"), F.bit_count("_mask").cast("long").alias("n_slices"))


def contains(df: DataFrame, key: str, words: DataFrame, plan: list[Slice], out: str = "maybe", parts: bool = False) -> DataFrame:
    """``df`` with whether the key may be in any slice. ``parts``: see ``masks``."""
    return masks(df, key, words, plan, "_mask", parts=parts).withColumn(out, F.col("_mask") != 0).drop("_mask")


def slice_statistics(words: DataFrame, plan: list[Slice]) -> DataFrame:
    """Per slice: set bits, fill, estimated rate and its share of the sum of rates."""
    spark = words.sparkSession
    table = spark.createDataFrame(
        [(str(s.number), s.number, s.capacity, s.rate, s.spec.bits, s.spec.k) for s in plan],
        "filter_id string, slice int, capacity long, rate double, m long, k int",
    )
    bits = words.groupBy("filter_id").agg(F.sum(F.bit_count("bits").cast("long")).alias("set_bits"))
    out = table.join(bits, "filter_id", "left").withColumn("set_bits", F.coalesce("set_bits", F.lit(0).cast("long")))
    out = out.withColumn("fill_rate", F.col("set_bits") / F.col("m")).withColumn("estimated_fpr", F.pow("fill_rate", F.col("k").cast("double")))
    total = F.sum("estimated_fpr").over(W.partitionBy())
    return out.withColumn("share", F.when(total == 0, 0.0).otherwise(F.col("estimated_fpr") / total)).drop("filter_id")


def shard_statistics(words: DataFrame, plan: list[Slice]) -> DataFrame:
    """Per slice of shards: set bits, and the mean, least and largest rate of its shards."""
    spark = words.sparkSession
    table = spark.createDataFrame(
        [(str(s.number), s.number, s.spec.m, s.spec.k, _stride(s), g) for s in plan for g in range(s.spec.groups)],
        "filter_id string, slice int, m long, k int, stride long, shard long",
    )
    shard = words.join(F.broadcast(table.where("shard = 0").drop("shard")), "filter_id").withColumn("shard", F.expr("word div stride"))
    bits = shard.groupBy("filter_id", "shard").agg(F.sum(F.bit_count("bits").cast("long")).alias("n"))
    own = table.join(bits, ["filter_id", "shard"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    rate = F.pow(F.col("n") / F.col("m"), F.col("k").cast("double"))
    return own.groupBy("slice").agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("n").alias("set_bits"),
        F.avg(rate).alias("estimated_fpr"),
        F.min(rate).alias("least_fpr"),
        F.max(rate).alias("largest_fpr"),
    )


def compound_fpr(stats: DataFrame) -> DataFrame:
    """One row of the rates of slices: the compound one, accurate for tiny ones."""
    return stats.agg((-F.expm1(F.sum(F.log1p(-F.col("estimated_fpr"))))).alias("compound_fpr"))


def growth_health(stats: DataFrame) -> DataFrame:
    """One row over the slices: compound and largest rate, aggregate fill, capacity."""
    return stats.agg(
        F.count(F.lit(1)).alias("slices"), F.sum("capacity").alias("total_capacity"), F.sum("set_bits").alias("set_bits"), (
            F.sum("set_bits") / F.sum("m")
        ).alias("aggregate_fill"),
        (
            1 - F.exp(F.sum(F.log1p(-F.col("estimated_fpr"))))
        ).alias("compound_fpr"), F.sum("estimated_fpr").alias("max_fpr"), F.max_by("fill_rate", "slice").alias("current_fill"),
    )


def traced(df: DataFrame, key: str, words: DataFrame, plan: list[Slice]) -> DataFrame:
    """(key, trace): for each distinct key the slices in order, with whether they match, hashes, bits and fill, and the bits tested until the first match."""
    words = stored(words, shared_folder(words.sparkSession, "slices"))  # read more than once
    fills = {r["slice"]: r["fill_rate"] for r in slice_statistics(words, plan).collect()}  # a row for each slice
    found = _key_masks(df, key, words, plan, "_mask")
    steps = F.array(
        *(
            F.struct(
                F.lit(s.number).alias("slice"),
                (F.getbit("_mask", F.lit(s.number)) == 1).alias("matched"),
                F.lit(s.spec.k).alias("hashes"),
                F.lit(s.spec.m).alias("bits"),
                F.lit(float(fills[s.number])).alias("fill_rate"),
            ) for s in plan
        )
    )
    return found.select(key, steps.alias("trace"))


def unique_count(df: DataFrame, key: str, plan: list[Slice], total: int | None = None) -> DataFrame:
    """The estimated number of distinct keys over all slices: their sketches, merged.

    ``df`` has a slice for each row.  Without tracking, that is with ``total`` given, it is the number of insertions.
    """
    if total is not None:
        return df.sparkSession.createDataFrame([(total,)], "estimate long")
    own = cardinality.registers(df, key, "slice")
    return cardinality.estimate(cardinality.merge(own)).select("estimate")


def grow(
    plan: list[Slice],
    capacity: int,
    rate: float,
    growth: Growth = Growth(),
    ratio: float = 0.5,
    fill: float = 0.5,
    arrivals: int | None = None,
    max_slices: int = MAX_SLICES,
) -> list[Slice]:
    """The plan with one slice more, which takes arrivals from now on: after ``arrivals``, or where the last one is full."""
    if len(plan) >= max_slices:
        raise MaxFiltersExceeded(f"{max_slices} slices are open already")
    last = plan[-1]
    first = last.first + last.threshold if arrivals is None else arrivals + 1
    if not last.first <= first <= last.first + last.threshold:
        raise InvalidParameters(f"{arrivals} arrivals are not in the last slice")
    new = slice_plan(capacity, rate, 1 << 62, growth, ratio, fill, max_slices=len(plan) + 1)[-1]
    closed = Slice(last.number, last.capacity, last.rate, last.spec, max(1, first - last.first), last.first)
    return [*plan[:-1], closed, Slice(new.number, new.capacity, new.rate, new.spec, new.threshold, first)]


def cleared(words: DataFrame, plan: list[Slice]) -> tuple[DataFrame, list[Slice]]:
    """Without a bit, and back to the first slice at its initial rate."""
    return membership.empty(words), plan[:1]


def with_threshold(plan: list[Slice], fill: float) -> list[Slice]:
    """A fill threshold for slices that open from now on: all but the last keep theirs."""
    if not 0.45 <= fill < 1:
        raise InvalidParameters("a fill threshold that is set later is in [0.45, 1)")
    last = plan[-1]
    return [*plan[:-1], Slice(last.number, last.capacity, last.rate, last.spec, max(1, math.ceil(last.capacity * fill)), last.first)]


def health(words: DataFrame, plan: list[Slice], arrivals: int, target: float, growth: Growth = Growth(), unique: int | None = None) -> DataFrame:
    """One row: thirteen fields over the slices."""
    row = growth_health(slice_statistics(words, plan))
    last = plan[-1]
    room = max(0, last.first + last.threshold - 1 - arrivals)
    return row.select(
        "slices", "total_capacity", F.lit(arrivals).cast("long").alias("items"), F.lit(
            arrivals if unique is None else unique
        ).cast("long").alias("unique_items"), "set_bits", "aggregate_fill", "current_fill",
        "compound_fpr", "max_fpr", F.lit(target).alias("target_fpr"), (
            F.col("compound_fpr") / target
        ).alias("fpr_ratio"), F.lit(room).cast("long").alias("room_before_growth"), F.lit(growth.kind).alias("growth"),
    )


def adaptive_build(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    capacity: int,
    rate: float,
    ratio: float = 0.5,
    fill: float = 0.5,
    max_slices: int = 64,
) -> tuple[DataFrame, list[Slice]]:
    """Slices whose rates tighten by how full the one before became; as many slices as the logarithm of the arrivals.

    Which slice an arrival goes to depends on its rank alone, so arrivals are ranked once and stored by slice.  Each slice is
    then built from its own part of that table, and its words are stored: a row is read twice, however many slices there are.
    """
    spark, total = df.sparkSession, df.count()
    plan, first, p = [], 1, rate
    for i in range(max_slices):
        own = capacity * 2**i
        take = max(1, math.ceil(own * fill))
        plan.append(Slice(i, own, p, standard(own, p), take, first))  # rates follow
        first += take
        if first > total:
            break
    folder = shared_folder(spark, "adaptive")
    rows = ranked(df, order, "_rank", total).where(F.col(key).isNotNull()).select(F.col(key), slice_of(F.col("_rank"), plan).alias("slice"))
    rows.write.partitionBy("slice").parquet(f"{folder}/rows")
    kind = T.StructType([*rows.select(key).schema.fields, T.StructField("slice", T.IntegerType())])
    tables, done = [], []
    for s in plan:
        spec = standard(s.capacity, p)
        done.append(replace(s, rate=p, spec=spec))
        own = spark.read.schema(kind).parquet(f"{folder}/rows").where(F.col("slice") == s.number)
        tables.append(f"{folder}/words/{s.number}")
        membership.build(own, key, spec).withColumn("filter_id", F.lit(str(s.number))).write.parquet(tables[-1])
        ratio = next_ratio(ratio, threshold=fill, fill=membership.statistics(spark.read.schema(membership.WORDS).parquet(tables[-1]), spec).first()["fill_rate"])
        p = max(LEAST_RATE, p * ratio)
    drop_folder(spark, f"{folder}/rows")
    return spark.read.schema(membership.WORDS).parquet(*tables), done
