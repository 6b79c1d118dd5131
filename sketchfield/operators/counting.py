"""Counting filters: counters for positions, so keys can be taken out again.

A table of counters (pos, cnt) without zeros.  Repeated positions of a key count twice.  ``apply`` is the
unchecked batch: the net count, floored at zero and capped at the counters' largest value.  Operations one after
the other are ``rejected`` (inserts), ``delete_batch`` and ``first_failure`` (verified deletes), and
``ledger.replay`` (a log of inserts and unchecked deletes).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import CapacityExceeded, CounterUnderflow, IncompatibleFilters, InvalidFilterSize, InvalidParameters
from ..plans.sizing import Spec
from .growing import ranked
from .membership import positions
from .scratch import checkpointed

#: Largest counts of 4, 8 and 16-bit counters.
SIZES = {4: 15, 8: 255, 16: 65535}
#: Verified deletes that one task replays in order.
TASK_DELETES = 500_000
#: Counters of a filter for each task that adds up positions.
TASK_COUNTERS = 2_000_000


def counter_bits(max_count: int) -> int:
    """The narrowest counter that holds the count."""
    for bits, most in SIZES.items():
        if 1 <= max_count <= most:
            return bits
    raise InvalidParameters(f"no counter holds {max_count}")


def size_of(counters: DataFrame, bits: int | None = None, unknown: int = 16) -> int:
    """The bits of a table's counters: those that it was built with, which go with its column, or ``bits``; ``unknown`` if neither tells."""
    held = counters.schema["cnt"].metadata.get("bits")
    if bits is not None and bits not in SIZES:
        raise InvalidParameters(f"no counter has {bits} bits")
    if held is not None and bits is not None and held != bits:
        raise IncompatibleFilters(f"the counters have {held} bits, not {bits}")
    return held or bits or unknown


def _sized(cnt: Column, bits: int) -> Column:
    return cnt.cast("long").alias("cnt", metadata={"bits": bits})


def hits(df: DataFrame, key: Column | str, spec: Spec) -> DataFrame:
    """(pos, hits).  For a large filter, keys are counted first, and positions go to as many tasks as its counters need."""
    tasks = -(-spec.m // TASK_COUNTERS)
    if tasks == 1:
        return positions(df, key, spec).groupBy("pos").agg(F.count(F.lit(1)).alias("hits"))
    keys = df.select((F.col(key) if isinstance(key, str) else key).alias("_k")).where("_k is not null").groupBy("_k").agg(F.count(F.lit(1)).alias("_times"))
    return positions(keys, "_k", spec, ["_times"]).repartition(tasks, "pos").groupBy("pos").agg(F.sum("_times").alias("hits"))


def build(df: DataFrame, key: Column | str, spec: Spec, bits: int = 4) -> DataFrame:
    """(pos, cnt, overflow): saturated counts and the increments that didn't count."""
    most = SIZES[bits]
    return hits(df, key, spec).select(
        "pos",
        _sized(F.least("hits", F.lit(most)), bits),
        F.greatest(F.col("hits") - most, F.lit(0)).cast("long").alias("overflow"),
    )


def rejected(df: DataFrame, key: str, order: str, spec: Spec, bits: int | None = None, counters: DataFrame | None = None) -> DataFrame:
    """(order, key) of inserts, in an order without ties, that come when all counters of their key are saturated.

    A counter that starts at c is saturated by the (most - c)-th hit.  A rejected insert changes nothing, as
    all its counters are saturated, so hits of all earlier inserts count.
    """
    bits = bits or 4 if counters is None else size_of(counters, bits, 4)
    most = SIZES[bits]
    at = positions(df.where(F.col(order).isNotNull()), key, spec, [F.col(key).alias("_k"), F.col(order).alias("_n")])
    hit = at.withColumn("_i", F.row_number().over(W.partitionBy("pos").orderBy("_n"))).where(f"_i <= {most}")  # limited before the shuffle
    started = counters.select("pos", F.col("cnt").alias("_c")) if counters is not None else None
    hit = hit.join(started, "pos", "left") if started is not None else hit.withColumn("_c", F.lit(0))
    full = hit.where(F.col("_i") == most - F.coalesce("_c", F.lit(0))).select("pos", F.col("_n").alias("_since"))
    if started is not None:
        full = full.select("pos", F.col("_since").cast("double")).union(started.where(f"_c >= {most}").select("pos", F.lit(float("-inf"))))
    late = at.join(full, "pos", "left").groupBy("_n", "_k").agg(F.bool_and(F.coalesce(F.col("_since") < F.col("_n"), F.lit(False))).alias("_full"))
    return late.where("_full").select(F.col("_n").alias(order), F.col("_k").alias(key))


def build_checked(df: DataFrame, key: str, order: str, spec: Spec, bits: int = 4) -> DataFrame:
    """``build`` that raises if an insert comes when all counters of its key are saturated."""
    if rejected(df, key, order, spec, bits).limit(1).count():
        raise CapacityExceeded("all counters of a key are saturated")
    return build(df, key, spec, bits)


def apply(counters: DataFrame, df: DataFrame, key: Column | str, spec: Spec, bits: int | None = None, delete: bool = False) -> DataFrame:
    """Counters after a batch of inserts or deletes; of 4 bits if neither the table nor ``bits`` tells."""
    sign, bits = -1 if delete else 1, size_of(counters, bits, 4)
    both = counters.select("pos", "cnt").union(hits(df, key, spec).select("pos", (F.col("hits") * sign).alias("cnt")))
    net = F.greatest(F.least(F.sum("cnt"), F.lit(SIZES[bits])), F.lit(0))
    return both.groupBy("pos").agg(net.alias("cnt")).where("cnt > 0").select("pos", _sized(F.col("cnt"), bits))


def contains(df: DataFrame, key: str, counters: DataFrame, spec: Spec) -> DataFrame:
    """(key, maybe) of the distinct keys: whether all their counters are above zero; least: the smallest of these."""
    keys = df.select(F.col(key).alias("k")).where("k is not null").distinct()
    at = positions(keys, "k", spec, ["k"]).join(counters.select("pos", "cnt"), "pos", "left")
    least = F.min(F.coalesce("cnt", F.lit(0).cast("long")))
    return at.groupBy("k").agg(least.alias("least")).select(F.col("k").alias(key), (F.col("least") > 0).alias("maybe"), "least")


def _nth_hits(at: DataFrame, counters: DataFrame, bits: int) -> DataFrame:
    """(pos, _n) of the deletes (pos, _n; a row for each decrement) that take a counter below zero if all before succeed."""
    # limited before the shuffle
    numbered = at.select("pos", "_n").withColumn("_i", F.row_number().over(W.partitionBy("pos").orderBy("_n"))).where(f"_i <= {SIZES[bits] + 1}")
    return numbered.join(counters.select("pos", "cnt"), "pos", "left").where(F.col("_i") == F.coalesce("cnt", F.lit(0)) + 1).select("pos", "_n")


def first_failure(df: DataFrame, key: str, order: str, counters: DataFrame, spec: Spec, bits: int | None = None) -> DataFrame:
    """One row: of deletes in an order, how many precede the first that fails; null if none does.

    All deletes before the first failure succeed, so a counter of c fails at its (c + 1)-th decrement.  A
    key's repeated deletes, and its repeated positions, count each.
    """
    numbered = ranked(df.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, order])), list(dict.fromkeys([order, key])), "_n")
    at = positions(numbered, key, spec, ["_n"])
    return _nth_hits(at, counters, size_of(counters, bits)).agg((F.min("_n") - 1).cast("long").alias("deleted_before_failure"))


def delete_batch(df: DataFrame, key: str, order: str, counters: DataFrame, spec: Spec, bits: int | None = None, task: int = TASK_DELETES) -> DataFrame:
    """(order, key, deleted): verified deletes one after the other; one that fails changes nothing.

    Deletes of one order value go by key.  ``deleted`` is never null:

    1. Counters only fall, so once a key's delete fails its later ones do, and its j-th needs j times what one takes.
       Of a key with any number of deletes, as many as its counters hold may succeed.  A counter that holds enough for all that may
       succeed fails none of them, so only deletes that ask for another one, a contested one, are open; these alone get a rank.
    2. While more than ``task`` deletes are open, these are enclosed from both sides: with all earlier ones that may succeed applied, a
       delete that still finds its counters succeeds; with those only that surely succeed, one that does not find them fails.
    3. Up to ``task`` open ones are replayed in order by one task, which holds the counters that they ask for.  If enclosing
       decides few, as on a long chain of deletes that hang on each other, the rest is replayed so, a task after the other.
    """
    each, limit = W.partitionBy(key).orderBy(order), SIZES[size_of(counters, bits)]
    own = df.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, order]))
    few = own.withColumn("_j", F.row_number().over(each)).where(f"_j <= {limit}")  # limited before the shuffle
    rows = checkpointed(few.withColumn("_last", F.lead(F.lit(1)).over(each).isNull()))
    most, contested = _contested(rows.where("_last"), key, counters, spec)
    some = contested.select(F.col("_k").alias(key), "_may").distinct()
    open_ = checkpointed(rows.join(some, key).where("_j <= _may").select(*own.columns, "_j"))
    if count := open_.count():
        open_ = checkpointed(ranked(open_, list(dict.fromkeys([order, key, "_j"])), "_n", count).select("_n", F.col(key).alias("_k")))
        state = _settled(open_.join(contested, "_k").select("_n", "pos", "_w", "_c"), task)
        got = open_.join(state, "_n").groupBy("_k").agg(F.count(F.when(F.col("_ok"), 1)).alias("_got"))
        most = most.join(got, "_k", "left").select("_k", F.coalesce("_got", "_may").alias("_may"))
    out = rows.join(most.withColumnRenamed("_k", key), key).select(order, key, (F.col("_j") <= F.col("_may")).alias("deleted"))
    full = rows.where(f"_j = {limit}").select(key)
    return out if full.isEmpty() else out.union(_beyond(own, rows, full, key, order).select(order, key, F.lit(False)))


def _beyond(own: DataFrame, rows: DataFrame, full: DataFrame, key: str, order: str) -> DataFrame:
    """The deletes of ``own`` that are not in ``rows``, of keys with as many there as a counter holds."""
    names, million = own.columns, 1_000_000
    each = reduce(DataFrame.union, (t.join(full, key, "left_semi").select(*names, F.lit(sign).alias("_d")) for t, sign in ((own, 1), (rows, -1))))
    more = each.groupBy(*names).agg(F.sum("_d").alias("_d")).where("_d > 0")
    # equal deletes again as a row each, a million at a time
    chunks = more.select(*names, "_d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_d"), F.lit(million).cast("long"))).alias("_at"))
    return chunks.select(*names, F.explode(F.sequence("_at", F.least("_d", F.col("_at") + (million - 1)))).alias("_i")).select(*names)


def _contested(lasts: DataFrame, key: str, counters: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """Of each key's last delete, the _j-th: how many may succeed (_k, _may), and the counters (_k, _may, pos, _w, _c) that don't hold all that may."""
    at = positions(lasts, key, spec, [F.col(key).alias("_k"), F.col("_j").alias("_asks")]).select("pos", "_k", "_asks")
    at = at.join(counters.select("pos", F.col("cnt").cast("int").alias("_c")), "pos", "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    at = at.withColumn("_w", F.count(F.lit(1)).over(W.partitionBy("pos", "_k")).cast("int"))  # a key that has a position twice has two rows
    at = at.withColumn("_may", F.least("_asks", F.expr("int(_c div _w)")))
    wanted = F.sum("_may").over(W.partitionBy("pos"))
    at = checkpointed(at.select("_k", "pos", "_w", "_c", "_may", (wanted > F.col("_c")).alias("_short")))
    most = checkpointed(at.groupBy("_k").agg(F.min("_may").alias("_may")))
    # other counters may give a key less than this one would
    some = at.where("_short").drop("_may", "_short").join(most.where("_may > 0"), "_k").withColumn("_wanted", wanted)
    return most, checkpointed(some.where("_wanted > _c").drop("_wanted").distinct())


def _settled(at: DataFrame, task: int) -> DataFrame:
    """(_n, _ok) of open deletes (_n, pos, _w, _c)."""
    at = checkpointed(at)
    state = checkpointed(at.select("_n", F.lit(None).cast("boolean").alias("_ok")).distinct())
    open_, before = state.count(), None
    while open_ > task and (before is None or open_ < 0.8 * before):
        state = _decided(state, _enclosed(at, state))
        before, open_ = open_, state.where("_ok is null").count()
    while open_:
        rest = state.where("_ok is null").select("_n")
        until = rest.orderBy("_n").limit(task).agg(F.max("_n")).first()[0] if open_ > task else None
        state = _decided(state, _replayed(at, state, until))
        open_ = max(0, open_ - task)
    return state


def _decided(state: DataFrame, new: DataFrame) -> DataFrame:
    return checkpointed(state.join(new, "_n", "left").select("_n", F.coalesce("_ok", "_new").alias("_ok")))


def _asked(at: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of counters that an open delete asks for, with what is known of the delete."""
    now = at.join(state, "_n")
    return now.join(now.where("_ok is null").select("pos").distinct(), "pos", "left_semi")


def _left(counted: Column) -> Column:
    """What a counter has left for a delete if the counted ones before it were applied."""
    earlier = W.partitionBy("pos").orderBy("_n").rowsBetween(W.unboundedPreceding, -1)
    return F.col("_c") - F.coalesce(F.sum(F.when(counted, F.col("_w")).otherwise(0)).over(earlier), F.lit(0))


def _enclosed(at: DataFrame, state: DataFrame) -> DataFrame:
    """(_n, _new) of open deletes that a round decides: the first one of every counter at least."""
    now = _asked(at, state)
    now = now.withColumn("_least", _left(F.coalesce("_ok", F.lit(True)))).withColumn("_most", _left(F.coalesce("_ok", F.lit(False))))
    found = now.where("_ok is null").groupBy("_n").agg(F.bool_and(F.col("_least") >= F.col("_w")).alias("_sure"), F.bool_or(F.col("_most") < F.col("_w")).alias("_lost"))
    return found.where("_sure or _lost").select("_n", F.col("_sure").alias("_new"))


def _replayed(at: DataFrame, state: DataFrame, until: int | None) -> DataFrame:
    """(_n, _new) of the open deletes up to a rank, replayed in order by one task."""
    now = _asked(at, state).withColumn("_most", _left(F.coalesce("_ok", F.lit(False)))).where("_ok is null")
    now = now if until is None else now.where(F.col("_n") <= until)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: dict[int, int] = {}  # what the open ones have taken so far
        taken, rest = gone.get, None

        def decided(rows: list[np.ndarray]) -> pa.RecordBatch:
            n, (pos, need, most) = rows[0], (x.tolist() for x in rows[1:])
            first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
            ok = []
            for a, z in zip(first.tolist(), [*first[1:].tolist(), len(n)]):
                for i in range(a, z):
                    if most[i] - taken(pos[i], 0) < need[i]:
                        ok.append(False)
                        break
                else:
                    ok.append(True)
                    for i in range(a, z):
                        gone[pos[i]] = taken(pos[i], 0) + need[i]
            return pa.RecordBatch.from_arrays([pa.array(n[first]), pa.array(ok)], names=["_n", "_new"])

        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows)]
            end = int(np.searchsorted(rows[0], rows[0][-1]))  # the last delete may go on in the next batch
            rest = [x[end:] for x in rows]
            if end:
                yield decided([x[:end] for x in rows])
        if rest is not None:
            yield decided(rest)

    ordered = now.select(F.col("_n").cast("long"), F.col("pos").cast("long"), F.col("_w").cast("long"), F.col("_most").cast("long")).repartition(1).sortWithinPartitions("_n")
    return ordered.mapInArrow(run, "_n long, _new boolean")


def deleted_count(outcomes: DataFrame) -> DataFrame:
    """One row of the outcomes of ``delete_batch``: deletes, those that succeeded, and those that did not."""
    deleted = F.count(F.when(F.col("deleted"), 1))
    return outcomes.agg(F.count(F.lit(1)).alias("deletes"), deleted.alias("deleted"), (F.count(F.lit(1)) - deleted).alias("failed"))


def after_deletes(counters: DataFrame, outcomes: DataFrame, key: str, spec: Spec) -> DataFrame:
    """Counters after the deletes that succeeded; none of them can fall below zero."""
    gone = hits(outcomes.where("deleted"), key, spec).select("pos", (-F.col("hits")).alias("cnt"))
    left = counters.select("pos", "cnt").union(gone).groupBy("pos").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
    return left.select("pos", _sized(F.col("cnt"), size_of(counters)))


def can_remove(df: DataFrame, key: str, counters: DataFrame, spec: Spec) -> DataFrame:
    """(key, can_remove) of the distinct keys, each judged alone."""
    return contains(df, key, counters, spec).select(key, F.col("maybe").alias("can_remove"))


def remove(df: DataFrame, key: str, order: str, counters: DataFrame, spec: Spec, bits: int | None = None) -> DataFrame:
    """Counters after deletes that must all succeed, one after the other."""
    if first_failure(df, key, order, counters, spec, bits).first()[0] is not None:
        raise CounterUnderflow("an item is not in the filter, or a counter would fall below zero")
    return apply(counters, df, key, spec, size_of(counters, bits), delete=True)


def raw_counters(counters: DataFrame, spec: Spec, bits: int | None = None, chunk: int = 1 << 20) -> DataFrame:
    """(chunk, bytes): all counters in order, as bytes, or as little-endian pairs if they have 16 bits; a row for each ``chunk`` positions."""
    width = 2 if size_of(counters, bits, 4) == 16 else 1
    digits = 2 * width
    value = F.lpad(F.hex(F.coalesce("cnt", F.lit(0).cast("long"))), digits, "0")
    if width == 2:
        value = F.concat(F.substring(value, 3, 2), F.substring(value, 1, 2))
    every = counters.sparkSession.range(spec.m).withColumnRenamed("id", "pos").join(counters.select("pos", "cnt"), "pos", "left")
    cells = every.select((F.expr(f"pos div {chunk}")).alias("chunk"), F.struct("pos", value.alias("v")).alias("x"))
    return cells.groupBy("chunk").agg(F.unhex(F.array_join(F.sort_array(F.collect_list("x")).getField("v"), "")).alias("bytes"))


def from_raw(raw: DataFrame, spec: Spec, bits: int = 4, chunk: int = 1 << 20) -> DataFrame:
    """Counters of ``raw_counters``, with lengths and values checked; items and overflows count from zero again."""
    width = 2 if bits == 16 else 1
    length = raw.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    if length != spec.m * width:
        raise InvalidFilterSize(f"{length} bytes are not {spec.m} counters of {bits} bits")
    digits = raw.select("chunk", F.hex("bytes").alias("h"))
    cells = digits.select(
        "chunk",
        F.posexplode(
            F.transform(F.sequence(F.lit(0), F.expr(f"length(h) div {2 * width}") - 1), lambda i: F.substring(F.col("h"), i * 2 * width + 1, F.lit(2 * width)))
        ).alias("i", "v"),
    )
    value = F.concat(F.substring("v", 3, 2), F.substring("v", 1, 2)) if width == 2 else F.col("v")
    cnt = F.conv(value, 16, 10).cast("long")
    checked = F.when(cnt > SIZES[bits], F.raise_error(F.lit("a counter is beyond its size")).cast("long")).otherwise(cnt)
    return cells.select((F.col("chunk") * chunk + F.col("i")).cast("long").alias("pos"), _sized(checked, bits)).where("cnt > 0")


def cleared(counters: DataFrame) -> DataFrame:
    return counters.limit(0)


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables have the same counters."""
    both = a.select("pos", F.col("cnt").alias("x")).join(b.select("pos", F.col("cnt").alias("y")), "pos", "full")
    return both.agg((F.count(F.when(F.coalesce("x", F.lit(0)) != F.coalesce("y", F.lit(0)), 1)) == 0).alias("equal"))


def histogram(counters: DataFrame, spec: Spec, bits: int | None = None) -> DataFrame:
    """(cnt, counters) for each value from 0 to the largest."""
    found = counters.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
    values = counters.sparkSession.range(SIZES[size_of(counters, bits, 4)] + 1).withColumnRenamed("id", "cnt")
    zeros = found.agg((F.lit(spec.m) - F.coalesce(F.sum("n"), F.lit(0))).alias("n")).select(F.lit(0).cast("long").alias("cnt"), "n")
    return values.join(found.union(zeros), "cnt", "left").select("cnt", F.coalesce("n", F.lit(0)).cast("long").alias("counters"))


def distribution(counters: DataFrame, spec: Spec, bits: int | None = None) -> DataFrame:
    """One row over all m counters, zeros among them."""
    bits = size_of(counters, bits, 4)
    m, most = float(spec.m), SIZES[bits]
    row = counters.agg(*(F.coalesce(x, F.lit(0)).alias(n) for n, x in (("nonzero", F.count("cnt")), ("total", F.sum("cnt")), ("squares", F.sum(F.col("cnt") * F.col("cnt"))), ("max_count", F.max("cnt")), ("saturated", F.sum((F.col("cnt") >= int(0.9 * most)).cast("long"))), ("least", F.min("cnt")))))
    mean = F.col("total") / m
    sd = F.sqrt(F.greatest(F.col("squares") / m - mean * mean, F.lit(0.0)))
    return row.select(
        "nonzero", F.when(
            F.col("nonzero") < m,
            F.lit(0).cast("long"),
        ).otherwise(F.col("least")).alias("min_count"), "max_count", mean.alias("mean"), sd.alias("stddev"),
        F.when(F.col("nonzero") == 0, 0.0).otherwise(F.col("total") / F.col("nonzero")).alias("avg_nonzero"), "saturated",
        F.pow(
            F.col("max_count") / F.lit(float(most)),
            F.lit(2.0),
        ).alias("overflow_risk"), F.when(mean == 0, 0.0).otherwise(F.least(sd / mean, F.lit(1.0))).alias("fragmentation"),
        F.lit(spec.m * bits / 8 / (spec.m / 8)).alias("compression_ratio"),
    )


def health(counters: DataFrame, spec: Spec, items: int, overflows: int = 0, bits: int | None = None) -> DataFrame:
    """One row of eighteen fields; the four of the distribution have a column each.

    A filter of ``items`` items; a sum of overflows is not in the counters, so it is given.
    """
    bits = size_of(counters, bits, 4)
    d = distribution(counters, spec, bits)
    fill = F.col("nonzero") / F.lit(float(spec.m))
    return d.select(
        fill.alias("fill_rate"), F.lit(
            estimated_fpr(items, spec)
        ).alias("estimated_fpr"), F.lit(spec.target_fpr or 0.0).alias("target_fpr"), F.col("max_count").alias("max_counter_value"), F.col("avg_nonzero").alias("avg_counter_value"),
        F.col("saturated").alias("saturated_count"), F.lit(overflows).cast("long").alias("overflow_events"), "overflow_risk", F.lit(
            -(-spec.m * bits // 8)
        ).cast("long").alias("memory_bytes"), F.col("nonzero").alias("active_counters"),
        F.lit(spec.m).cast("long").alias("total_counters"), F.lit(
            items / spec.expected_items if spec.expected_items else 0.0
        ).alias("load_factor"), F.lit(items).cast("long").alias("estimated_item_count"),
        (
            F.col("saturated") / F.lit(float(spec.m))
        ).alias("saturation_rate"), F.col("compression_ratio").alias("memory_overhead"), F.col("min_count").alias("distribution_min"), F.col("max_count").alias("distribution_max"),
        F.col("mean").alias("distribution_mean"), F.col("stddev").alias("distribution_stddev"), (1 - fill).alias("zero_rate"), "fragmentation",
    )


def hotspots(counters: DataFrame, n: int) -> DataFrame:
    """The n largest counters, ties by position."""
    return counters.orderBy(F.desc("cnt"), "pos").select("pos", "cnt").limit(n)


def estimated_fpr(items: int, spec: Spec) -> float:
    """From the number of items; the target for an empty filter."""
    import math

    return (spec.target_fpr or 0.0) if items == 0 else (1 - math.exp(-spec.k * items / spec.m)) ** spec.k
