"""Sketches as one binary value for each group: filters and HyperLogLog registers that a table of groups carries.

Building is a grouped aggregation without a row for each position: a task turns rows of up to ``HELD_BYTES`` at once, with what
they set, into the cells of their groups, however many groups these are; cells of equal groups are then merged by OR, or by the
largest rank, over rows sorted by group, so a task holds one group at a time, however many values it has.  Groups may have any number
of rows; one with a third of all makes its cells once for each of these parts.

A filter's bytes are those of ``store.to_bytes``: bit p of group g is bit p % 8 of byte g * stride + p // 8.  A sketch of
registers is sparse (register and rank in four bytes each, in order) up to ``SPARSE`` registers and dense (a byte each) beyond.
Null keys don't count; a group of null keys only has no row.  Groups are told by their text, null is a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidFilterSize, SerializationError, UnsupportedOperation
from ..functions.hashing import place, strategy_of
from ..plans.sizing import Spec
from . import cardinality, membership

HELD_BYTES = 64 << 20
SPARSE = 4_096
#: Keys that are looked up in a table of filters at once.
MOST_KEYS = 100_000
_SCHEMA = "filter_id string, packed binary"
_CELL = np.dtype([("at", "<u4"), ("value", "u1")])
_MOST_CELLS = 4_096  # of a group in a row, so that batches of rows stay small
_OUT_BYTES = 4 << 20


@dataclass(frozen=True)
class _Kind:
    """An array of ``size`` bytes for each group, into which hashes put values by a function that is a merge, too."""

    size: int
    put: np.ufunc
    cells: Callable[[list[np.ndarray]], Iterator[tuple[np.ndarray, np.ndarray]]]
    encode: Callable[[np.ndarray], bytes]
    decode: Callable[[bytes], np.ndarray]


def _filter_kind(spec: Spec) -> _Kind:
    stride, how = 8 * -(-spec.m // 64), strategy_of(spec)

    def cells(h: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for g, pos in membership.slots(h, spec, how):
            yield g * stride + (pos >> 3), np.left_shift(1, pos & 7).astype(np.uint8)

    def decode(data: bytes) -> np.ndarray:
        if len(data) != spec.groups * stride:
            raise InvalidFilterSize(f"{len(data)} bytes are not {spec.groups} groups of {spec.m} bits")
        return np.frombuffer(data, np.uint8)

    return _Kind(spec.groups * stride, np.bitwise_or, cells, np.ndarray.tobytes, decode)


def ranks_to_bytes(ranks: np.ndarray) -> bytes:
    used = np.flatnonzero(ranks)
    if len(used) > SPARSE:
        return b"\1" + ranks.astype(np.uint8).tobytes()
    return b"\0" + (used.astype("<u4") << 8 | ranks[used].astype("<u4")).tobytes()


def bytes_to_ranks(data: bytes) -> np.ndarray:
    ranks = np.zeros(cardinality.REGISTERS, np.uint8)
    if data[:1] == b"\1" and len(data) == 1 + cardinality.REGISTERS:
        ranks[:] = np.frombuffer(data, np.uint8, offset=1)
    elif data[:1] == b"\0" and len(data) % 4 == 1 and len(data) <= 1 + 4 * SPARSE:
        cells = np.frombuffer(data, "<u4", offset=1)
        if len(cells) and int(cells.max()) >> 8 >= cardinality.REGISTERS:
            raise SerializationError("a register is beyond the sketch")
        ranks[cells >> 8] = cells & 255
    else:
        raise SerializationError("no sketch of registers")
    return ranks


def _register_cells(h: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rest = h[0] // cardinality.REGISTERS
    yield h[0] % cardinality.REGISTERS, (cardinality.RANK_BITS + 1 - np.frexp(rest.astype(np.float64))[1]).astype(np.uint8)


_REGISTERS = _Kind(cardinality.REGISTERS, np.maximum, _register_cells, ranks_to_bytes, bytes_to_ranks)


def _batch(ids: list[str | None], values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), values], names=["filter_id", "packed"])


def _rows(values: Iterator[tuple[str | None, bytes]]) -> Iterator[pa.RecordBatch]:
    """Packed values in batches of up to about ``_OUT_BYTES``."""
    ids: list[str | None] = []
    held: list[bytes] = []
    size = 0
    for name, data in values:
        ids.append(name)
        held.append(data)
        size += len(data)
        if size >= _OUT_BYTES or len(ids) >= 10_000:
            yield _batch(ids, pa.array(held, pa.binary()))
            ids, held, size = [], [], 0
    if ids:
        yield _batch(ids, pa.array(held, pa.binary()))


def _cells(rows: list[pa.RecordBatch], kind: _Kind) -> Iterator[pa.RecordBatch]:
    """(filter_id, packed): the cells that rows of groups and hashes set, by group, in rows of up to ``_MOST_CELLS``."""
    table = pa.Table.from_batches(rows)
    coded = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
    code, names = coded.indices.to_numpy().astype(np.int64) * kind.size, coded.dictionary.to_pylist()
    found = [(code + at, np.broadcast_to(value, len(code))) for at, value in kind.cells([c.to_numpy() for c in table.columns[1:]])]
    at, value = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at)
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    group, cell = np.divmod(at[first], kind.size)
    own = np.empty(len(first), _CELL)
    own["at"], own["value"] = cell, kind.put.reduceat(value[order], first)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    start = np.union1d(start, np.arange(0, len(group), _MOST_CELLS))
    ends = (np.append(start, len(group)) * _CELL.itemsize).astype("<i4")
    packed = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(own)])
    yield _batch([names[g] for g in group[start].tolist()], packed)


def _partial(df: DataFrame, by: Column | str, hashes: Sequence[Column], kind: _Kind, per_row: int) -> DataFrame:
    """(filter_id, packed): the cells of groups that a task's rows set, at most ``HELD_BYTES`` of rows and cells at once."""
    own = df.select((F.col(by) if isinstance(by, str) else by).cast("string").alias("_by"), *(h.alias(f"h{i}") for i, h in enumerate(hashes))).where("h0 is not null")
    most = max(1, HELD_BYTES // (48 * per_row))  # indices, their order, values and copies of these

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                if n and n + part.num_rows > most:
                    yield from _cells(rows, kind)
                    rows, n = [], 0
                rows.append(part)
                n += part.num_rows
        if n:
            yield from _cells(rows, kind)

    return own.mapInArrow(run, _SCHEMA)


def _gathered(parts: DataFrame, kind: _Kind) -> DataFrame:
    """One packed value for each filter_id of ``_partial``, a group at a time."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes]]:
        last: tuple[str | None] | None = None
        sum_ = np.zeros(kind.size, np.uint8)
        for batch in batches:
            names, data = batch.column(0).to_pylist(), batch.column(1)
            ends = np.frombuffer(data.buffers()[1], "<i4", len(data) + 1, 4 * data.offset)
            cells = np.frombuffer(data.buffers()[2], _CELL, (ends[-1] - ends[0]) // _CELL.itemsize, ends[0])
            at, value, ends = cells["at"].astype(np.int64), cells["value"], ((ends - ends[0]) // _CELL.itemsize).tolist()
            i = 0
            while i < len(names):
                j = i + 1
                while j < len(names) and names[j] == names[i]:
                    j += 1
                if last is not None and last[0] != names[i]:
                    yield last[0], kind.encode(sum_)
                    sum_[:] = 0
                last = (names[i],)
                kind.put.at(sum_, at[ends[i] : ends[j]], value[ends[i] : ends[j]])
                i = j
        if last is not None:
            yield last[0], kind.encode(sum_)

    return parts.repartition("filter_id").sortWithinPartitions("filter_id").mapInArrow(lambda batches: _rows(values(b for b in batches if b.num_rows)), _SCHEMA)


def _merged(packed: DataFrame, kind: _Kind) -> DataFrame:
    """One value for each filter_id of packed values."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes]]:
        last: tuple[str | None] | None = None
        sum_ = np.zeros(kind.size, np.uint8)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if last is not None and last[0] != name:
                    yield last[0], kind.encode(sum_)
                    sum_[:] = 0
                last = (name,)
                kind.put(sum_, kind.decode(data.as_py()), out=sum_)
        if last is not None:
            yield last[0], kind.encode(sum_)

    own = packed.select("filter_id", "packed").where("packed is not null").repartition("filter_id").sortWithinPartitions("filter_id")
    return own.mapInArrow(lambda batches: _rows(values(batches)), _SCHEMA)


def build(df: DataFrame, key: Column | str, by: Column | str, spec: Spec) -> DataFrame:
    """(filter_id, packed): a filter for each value of ``by``."""
    first, _ = place(spec)
    key = F.col(key) if isinstance(key, str) else key
    kind = _filter_kind(spec)
    return _gathered(_partial(df.where(key.isNotNull()), by, first(key), kind, spec.k), kind)


def union(filters: DataFrame, spec: Spec) -> DataFrame:
    """Filters of equal filter_id in one; give all the same to unite a table."""
    return _merged(filters, _filter_kind(spec))


def to_words(filters: DataFrame, spec: Spec) -> DataFrame:
    """The filters as words, for all other operators."""
    kind, stride = _filter_kind(spec), -(-spec.m // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = kind.decode(data.as_py()).view("<i8")
                at = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at // stride), pa.array(at % stride), pa.array(words[at])], names=["filter_id", "grp", "word", "bits"])

    return filters.select("filter_id", "packed").mapInArrow(run, membership.WORDS)


def statistics(filters: DataFrame, spec: Spec) -> DataFrame:
    """Per filter: set bits, fill, and estimated rate."""
    kind = _filter_kind(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.bitwise_count(kind.decode(x.as_py())).sum()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["filter_id", "set_bits"])

    bits = filters.select("filter_id", "packed").mapInArrow(run, "filter_id string, set_bits long")
    fill = F.col("set_bits") / F.lit(float(spec.bits))
    return bits.select("filter_id", "set_bits", fill.alias("fill_rate"), F.pow(fill, F.lit(float(spec.k))).alias("estimated_fpr"))


def holding(filters: DataFrame, keys: DataFrame, key: str, spec: Spec) -> DataFrame:
    """(filter_id, n_keys): the filters that may hold one of the keys, and how many of them; others certainly hold none.

    Few keys are looked up in any number of filters: at most ``MOST_KEYS``, whose hashes go to every task.
    """
    first, _ = place(spec)
    found = keys.select(F.col(key).alias("k")).where("k is not null").distinct().select(*(h.alias(f"h{i}") for i, h in enumerate(first(F.col("k"))))).limit(MOST_KEYS + 1).toArrow()
    if found.num_rows > MOST_KEYS:
        raise UnsupportedOperation(f"more than {MOST_KEYS} keys; probe the words of the filters with membership.matching")
    kind = _filter_kind(spec)
    cells = [(np.asarray(at), value) for at, value in kind.cells([c.to_numpy() for c in found.columns])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for data in batch.column(1):
                bits, ok = kind.decode(data.as_py()), True
                for at, value in cells:
                    ok = ok & (bits[at] & value != 0)
                n.append(int(np.sum(ok)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["filter_id", "n_keys"])

    return filters.select("filter_id", "packed").mapInArrow(run, "filter_id string, n_keys long").where("n_keys > 0")


def registers(df: DataFrame, key: str, by: Column | str) -> DataFrame:
    """(filter_id, packed): a sketch of the distinct keys for each value of ``by``, with the registers of ``cardinality``."""
    return _gathered(_partial(df, by, [cardinality.hashed(F.col(key))], _REGISTERS, 1), _REGISTERS)


def merged_registers(sketches: DataFrame) -> DataFrame:
    """Sketches of equal filter_id in one."""
    return _merged(sketches, _REGISTERS)


def estimates(sketches: DataFrame) -> DataFrame:
    """(filter_id, used, estimate), as ``cardinality.estimate`` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = [r[r > 0] for r in (bytes_to_ranks(x.as_py()) for x in batch.column(1))]
            sums = [float(np.ldexp(1.0, -r.astype(int)).sum()) for r in ranks]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in ranks], pa.int64()), pa.array(sums)], names=["filter_id", "used", "s"])

    sums = sketches.select("filter_id", "packed").mapInArrow(run, "filter_id string, used long, s double")
    return sums.select("filter_id", "used", cardinality.estimate_of(F.col("used"), F.col("s")).alias("estimate"))
