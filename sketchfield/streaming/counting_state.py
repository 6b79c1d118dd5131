"""A counting filter that a stream of inserts and deletes keeps in Spark's state store.

The filter has the block layout: all counters of a key stand in one block of 512, so the state of a block, a value of
some hundred bytes, decides the block's operations alone, verified deletes among them.  A micro-batch loads, changes and
writes the blocks that it touches.  With a time to live an insert is taken off again when its time is over, unless a
delete has taken it off before (the oldest insert of that key goes): an operation finds a filter
without the inserts whose time was over at its own, and an event-time timer clears blocks that nobody asks for.

Operations of a micro-batch go in the order of their time, then of ``order``; rows behind the watermark are dropped by Spark.
A delete that finds a counter at zero fails and changes nothing.  An insert that finds all counters full fails; each counter that is full is an
overflow.  Null keys and deltas other than 1 and -1 are no operations.  State comes back from the checkpoint, so a stream
that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import UnsupportedOperation
from ..functions.hashing import place
from ..operators.counting import SIZES
from ..plans.sizing import Spec

BLOCK = 512
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "counters binary, item binary, until binary, at binary"
_OUT = "n long, ts timestamp, delta int, ok boolean, overflow int"


class Block:
    """Counters of a block, and its inserts with the time when each is over, in milliseconds."""

    def __init__(self, k: int, most: int, value: tuple | None = None) -> None:
        self.k, self.most, self.kind = k, most, np.uint8 if most < 256 else np.uint16
        counters, item, until, at = value or (bytes(BLOCK * np.dtype(self.kind).itemsize), b"", b"", b"")
        self.counters = np.frombuffer(counters, self.kind).astype(np.int64)
        live = np.frombuffer(at, np.uint16).reshape(-1, k).tolist()
        self.live = [*zip(np.frombuffer(until, np.int64).tolist(), np.frombuffer(item, np.int64).tolist(), map(tuple, live))]

    def value(self) -> tuple:
        return (
            self.counters.astype(self.kind).tobytes(), np.array([x[1] for x in self.live], np.int64).tobytes(),
            np.array([x[0] for x in self.live], np.int64).tobytes(), np.array([x[2] for x in self.live], np.uint16).tobytes(),
        )

    def expire(self, now: int) -> None:
        """Take off the inserts whose time is over."""
        over = [x for x in self.live if x[0] <= now]
        for _, _, at in over:
            self._take(at)
        if over:
            self.live = [x for x in self.live if x[0] > now]

    def _take(self, at: tuple) -> None:
        for p in at:
            self.counters[p] = max(0, self.counters[p] - 1)

    def insert(self, item: int, at: tuple, until: int | None) -> tuple[bool, int]:
        full = 0
        for p in at:
            if self.counters[p] < self.most:
                self.counters[p] += 1
            else:
                full += 1
        if until is not None:
            self.live.append((until, item, at))
        return full < len(at), full

    def delete(self, item: int, at: tuple) -> bool:
        if any(self.counters[p] == 0 for p in at):
            return False
        self._take(at)
        own = [i for i, x in enumerate(self.live) if x[1] == item]
        if own:
            self.live.pop(min(own, key=lambda i: self.live[i][0]))
        return True


class _Counting(StatefulProcessor):
    def __init__(self, k: int, most: int, ttl: int | None) -> None:
        self.k, self.most, self.ttl = k, most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("block", _STATE)

    def _load(self) -> Block:
        return Block(self.k, self.most, tuple(bytes(x) for x in self.state.get()) if self.state.exists() else None)

    def _store(self, block: Block) -> None:
        if block.counters.any() or block.live:
            self.state.update(block.value())
        else:
            self.state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        block = self._load()
        ops = pd.concat(list(rows)).sort_values(["ms", "n", "delta"], kind="stable")
        out = []
        for ms, n, delta, item, at in zip(*(ops[c].tolist() for c in ("ms", "n", "delta", "item", "at"))):
            if self.ttl is not None:
                block.expire(ms)
            at = tuple(int(p) for p in at)
            ok, full = block.insert(item, at, None if self.ttl is None else ms + self.ttl) if delta > 0 else (block.delete(item, at), 0)
            out.append((n, delta, ok, full))
        self._store(block)
        if block.live:
            self.handle.registerTimer(min(x[0] for x in block.live))
        done = pd.DataFrame(out, columns=["n", "delta", "ok", "overflow"])
        yield pd.DataFrame({"n": done["n"], "ts": ops["ts"].to_numpy(), "delta": done["delta"].astype("int32"), "ok": done["ok"], "overflow": done["overflow"].astype("int32")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        block = self._load()
        block.expire(timerValues.getCurrentWatermarkInMs())  # a timer that is set here fires with the next batch only
        self._store(block)
        if block.live:
            self.handle.registerTimer(min(x[0] for x in block.live))
        return iter(())

    def close(self) -> None: ...


def operations(
    log: DataFrame,
    key: str,
    order: str,
    ts: str,
    delta: str,
    spec: Spec,
    bits: int = 8,
    ttl_ms: int | None = None,
    late: str = "0 seconds",
) -> DataFrame:
    """(n, ts, delta, ok, overflow) of each operation of a streaming log (key, order, ts, delta), in append mode.

    ``spec`` has the block layout; the session's state store is RocksDB's.
    """
    if spec.layout != "block":
        raise UnsupportedOperation("only in the block layout does one place know all counters of a key")
    if log.sparkSession.conf.get(PROVIDER, None) != ROCKSDB:
        raise UnsupportedOperation(f"set {PROVIDER} to {ROCKSDB}")
    first, second = place(spec)
    own = log.select(F.col(key).alias("_key"), F.col(order).cast("long").alias("n"), F.col(ts).cast("timestamp").alias("ts"), F.col(delta).cast("int").alias("delta"))
    own = own.withWatermark("ts", late).where("_key is not null and ts is not null and delta in (1, -1)").withColumn("_h", F.array(*first(F.col("_key"))))
    at = second([F.col("_h")[0], F.col("_h")[1]])
    rows = own.select("n", "ts", "delta", F.unix_millis("ts").alias("ms"), F.xxhash64(F.col("_key").cast("string")).alias("item"), at[0][0].cast("long").alias("grp"), F.array(*(p.cast("int") for _, p in at)).alias("at"))
    processor = _Counting(spec.k, SIZES[bits], ttl_ms)
    return rows.groupBy("grp").transformWithStateInPandas(processor, outputStructType=_OUT, outputMode="Append", timeMode="None" if ttl_ms is None else "EventTime")


def counters(spark: SparkSession, checkpoint: str, bits: int = 8) -> DataFrame:
    """(grp, pos, cnt) of the counters above zero, as the last finished micro-batch left them in the state store."""
    state = spark.read.format("statestore").option("stateVarName", "block").load(checkpoint)
    digits = 2 if bits < 16 else 4
    text = state.select(F.col("key.grp").alias("grp"), F.hex("value.counters").alias("h"))
    cells = text.select("grp", "h", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))).alias("pos"))
    one = F.substring("h", F.col("pos") * digits + 1, F.lit(digits))
    value = one if digits == 2 else F.concat(F.substring(one, 3, 2), F.substring(one, 1, 2))
    return cells.select("grp", "pos", F.conv(value, 16, 10).cast("long").alias("cnt")).where("cnt > 0")
