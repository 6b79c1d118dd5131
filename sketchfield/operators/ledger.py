"""Counting filters under a log of inserts and deletes, one after the other.

An operation adds one to the counters of its key, or takes one off, each within [0, largest].  So what a run of
operations does to a counter is x -> min(max(x + shift, low), high), and two such functions in a row are another one:
counters need no replay in one place.  The log is cut into chunks of ``CHUNK`` operations, and a counter's operations
of one chunk are composed in order by one task; then a counter's chunks are composed, a row for each; then every
operation knows what it found.  A key with a third of the log makes a third of each chunk, never a task of its own.

An insert counts as an item if one of its counters went up, and fails (``counted`` is false) if all were full; each counter that was full is
an overflow event.  An unchecked delete takes its item off if all its counters went down.  Repeated positions of a
key count twice, one after the other.  Operations of one order value go by key, deletes first.  Null keys and
deltas other than 1 and -1 are no operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CounterOverflow, CounterUnderflow
from ..plans.sizing import Spec
from .counting import SIZES, size_of
from .growing import ranked
from .membership import positions
from .scratch import checkpointed

#: Operations whose effects on one counter are composed in one task.
CHUNK = 1 << 20

_F = ("shift", "low", "high")


def composed(first: Sequence[np.ndarray], then: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shift, low, high) of one function after another."""
    (s, a, b), (t, c, d) = first, then
    return s + t, np.minimum(np.maximum(a + t, c), d), np.minimum(np.maximum(b + t, c), d)


def prefixes(owner: np.ndarray, f: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each function the composition of those of its owner up to it; owners stand together."""
    f = tuple(x.copy() for x in f)
    place = np.arange(len(owner))
    start = np.maximum.accumulate(np.where(np.concatenate([[True], owner[1:] != owner[:-1]]), place, 0)) if len(owner) else place
    step, longest = 1, int((place - start).max(initial=0))
    while step <= longest:
        at = np.flatnonzero(place - start >= step)
        new = composed([x[at - step] for x in f], [x[at] for x in f])
        for x, y in zip(f, new):
            x[at] = y
        step *= 2
    return f


def _scanned(df: DataFrame, owner: Sequence[str], order: Sequence[str], most: int, more: str) -> DataFrame:
    """``df`` with what stood before each row of an owner, as a function of the value before the first: (_shift, _low, _high), and the row's number (_j).

    ``df`` has an owner's functions as (shift, low, high); ``more`` is its schema.
    """
    dealt = df.repartition(*owner).sortWithinPartitions(*owner, *order)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # owner, number of its rows so far, function of these
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(names.index(c)).to_numpy() for c in owner]
            f = [batch.column(names.index(c)).to_numpy().astype(np.int64) for c in _F]
            fresh = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
            number, first = np.cumsum(fresh), np.flatnonzero(fresh)
            lead = tuple(k[0].item() for k in keys)
            goes_on = last is not None and last[0] == lead
            if goes_on:
                for x, y in zip(f, composed([np.array([v]) for v in last[2]], [x[:1] for x in f])):
                    x[0] = y[0]
            after = prefixes(number, f)
            before = [np.concatenate([[e], x[:-1]]) for e, x in zip((0, 0, most), after)]
            for x, e in zip(before, (0, 0, most)):
                x[first] = e
            j = np.arange(len(number)) - first[number - 1]
            if goes_on:
                own = number == 1
                j[own] += last[1]
                for x, v in zip(before, last[2]):
                    x[0] = v
            last = tuple(k[-1].item() for k in keys), int(j[-1]) + 1, tuple(int(x[-1]) for x in after)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in (*before, j))], names=[*names, *(f"_{c}" for c in _F), "_j"])

    return dealt.mapInArrow(run, f"{more}, _shift long, _low long, _high long, _j long")


def _applied(x: Column, shift: str, low: str, high: str) -> Column:
    return F.least(F.greatest(x + F.col(shift), F.col(low)), F.col(high))


@dataclass(frozen=True)
class Ledger:
    """``hits`` has a row for each counter that an operation asks for: pos, n (the operation's rank), delta, before, ok, and its order and key."""

    hits: DataFrame
    order: str
    key: str
    most: int
    started: DataFrame | None

    def operations(self) -> DataFrame:
        """(order, key, delta, counted) of every operation: whether it put an item in, or took one off."""
        counted = F.when(F.col("delta") > 0, F.bool_or("ok")).otherwise(F.bool_and("ok"))
        found = self.hits.groupBy("n", "_order", "_key", "delta").agg(counted.alias("counted"))
        return found.select(F.col("_order").alias(self.order), F.col("_key").alias(self.key), F.col("delta").cast("int").alias("delta"), "counted")

    def counters(self) -> DataFrame:
        """(pos, cnt, overflow) after the log: counters above zero or with overflow events."""
        after = F.col("before") + F.when(F.col("ok"), F.col("delta")).otherwise(F.lit(0))
        lost = F.count(F.when((F.col("delta") > 0) & ~F.col("ok"), 1))
        own = self.hits.groupBy("pos").agg(F.max_by(after, F.struct("_chunk", "_j")).cast("long").alias("cnt"), lost.alias("overflow"))
        if self.started is not None:
            still = self.started.join(own, "pos", "left_anti").select("pos", "cnt", F.lit(0).cast("long").alias("overflow"))
            own = own.unionByName(still)
        return own.where("cnt > 0 or overflow > 0")

    def totals(self) -> DataFrame:
        """One row: operations, items (inserts that count, less deletes that do), rejected inserts, failed deletes, overflow events."""
        count = lambda what: F.count(F.when(F.expr(what), 1))
        per = self.operations().agg(
            F.count(F.lit(1)).alias("operations"),
            (count("delta > 0 and counted") - count("delta < 0 and counted")).alias("items"),
            count("delta > 0 and not counted").alias("rejected_inserts"),
            count("delta < 0 and not counted").alias("failed_deletes"),
        )
        lost = self.hits.agg(count("delta > 0 and not ok").alias("overflow_events"))
        return per.crossJoin(F.broadcast(lost))  # one row each


def replay(log: DataFrame, key: str, order: str, delta: str, spec: Spec, bits: int | None = None, counters: DataFrame | None = None, chunk: int = CHUNK) -> Ledger:
    """What each operation of a log (key, order, delta) found, from ``counters`` on or from none."""
    most = SIZES[bits or 4 if counters is None else size_of(counters, bits, 4)]
    own = log.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(delta).cast("long").alias("delta")).where("_key is not null and delta in (1, -1)")
    rows = own.count()
    numbered = ranked(own, ["_order", "_key", "delta"], "n", rows)
    at = positions(numbered, "_key", spec, ["_order", F.col("_key").alias("_own"), "delta", "n"]).withColumnRenamed("_own", "_key")
    at = at.select("pos", F.expr(f"(n - 1) div {chunk}").alias("_chunk"), F.col("n").cast("long").alias("n"), "_order", "_key", "delta", F.col("delta").alias("shift"), F.lit(0).cast("long").alias("low"), F.lit(most).cast("long").alias("high"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema.fields)
    within = _scanned(at, ["pos", "_chunk"], ["n"], most, kinds).drop(*_F)
    started = counters.select("pos", F.col("cnt").cast("long").alias("cnt")) if counters is not None else None
    if rows > chunk:
        within = checkpointed(within)
        # what a chunk does to a counter: its last operation after all before it
        ends = within.groupBy("pos", "_chunk").agg(F.max_by(F.struct("_shift", "_low", "_high", "delta"), "_j").alias("e"))
        step = lambda side: F.least(F.greatest(F.col(f"e.{side}") + F.col("e.delta"), F.lit(0)), F.lit(most)).cast("long")
        ends = ends.select("pos", "_chunk", (F.col("e._shift") + F.col("e.delta")).alias("shift"), step("_low").alias("low"), step("_high").alias("high"))
        first = _scanned(ends, ["pos"], ["_chunk"], most, "pos long, _chunk long, shift long, low long, high long")
        first = first.select("pos", "_chunk", F.col("_shift").alias("s"), F.col("_low").alias("l"), F.col("_high").alias("h"))
    else:
        first = None
    start = F.lit(0).cast("long")
    if first is not None:
        if started is not None:
            first = first.join(started, "pos", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))
        else:
            first = first.withColumn("cnt", F.lit(0).cast("long"))
        first = first.select("pos", "_chunk", _applied(F.col("cnt"), "s", "l", "h").alias("_x"))
        within, start = within.join(first, ["pos", "_chunk"]), F.col("_x")
    elif started is not None:
        within, start = within.join(started.withColumnRenamed("cnt", "_x"), "pos", "left"), F.coalesce("_x", F.lit(0).cast("long"))
    before = _applied(start, "_shift", "_low", "_high")
    ok = F.when(F.col("delta") > 0, F.col("before") < most).otherwise(F.col("before") > 0)
    hits = within.withColumn("before", before).withColumn("ok", ok).select("pos", "_chunk", "_j", "n", "_order", "_key", "delta", "before", "ok")
    return Ledger(checkpointed(hits), order, key, most, started)


def replay_checked(log: DataFrame, key: str, order: str, delta: str, spec: Spec, bits: int | None = None, counters: DataFrame | None = None) -> Ledger:
    """``replay`` that raises if an insert finds all its counters full, or a delete one of its at zero."""
    found = replay(log, key, order, delta, spec, bits, counters)
    row = found.totals().first()
    if row["rejected_inserts"]:
        raise CounterOverflow(f"{row['rejected_inserts']} inserts found all counters of their keys full")
    if row["failed_deletes"]:
        raise CounterUnderflow(f"{row['failed_deletes']} deletes found a counter at zero")
    return found
