"""Trees of filters: a key is in the filters of all nodes on its path, from the root to a leaf.

Nodes of all levels are one table of words with the node's path ("" for the root, then "2", "2/0")
as filter_id.  Locating a key goes down level by level and looks only below nodes that matched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IncompatibleFilters, InternalError, UnsupportedOperation
from ..functions.hashing import place, rehash
from ..plans.slices import TreePlan
from . import membership


def route(key: Column, plan: TreePlan) -> Column:
    """A leaf's path for a key, uniform over the leaves: an array of child numbers."""
    return F.array(*((rehash(key.cast("string"), i) % b).cast("int") for i, b in enumerate(plan.branching)))


def node(path: Column, level: int) -> Column:
    return F.array_join(F.slice(path, 1, level).cast("array<string>"), "/")


def build(df: DataFrame, key: str, path: str, plan: TreePlan) -> DataFrame:
    """Words of all nodes, of rows with a path array: one pass over them. Rows whose path is no leaf's raise."""
    bad = reduce(lambda a, b: a | b, [F.size(path) != plan.depth, *((F.col(path)[i] < 0) | (F.col(path)[i] >= b) for i, b in enumerate(plan.branching))])
    first, _ = place(plan.spec(0))
    checked = F.when(bad, F.raise_error(F.lit("no path to a leaf")).cast("array<int>")).otherwise(F.col(path))
    hashed = df.where(F.col(key).isNotNull()).select(checked.alias("_path"), F.array(*first(F.col(key))).alias("_h"))
    levels = range(plan.depth + 1)
    at = lambda i: [p.cast("long") for _, p in place(plan.spec(i))[1]([F.col("_h")[0], F.col("_h")[1]])]
    nodes = F.array(*(F.struct(F.lit(i).alias("level"), node(F.col("_path"), i).alias("node"), F.array(*at(i)).alias("pos")) for i in levels))
    each = hashed.select(F.explode(nodes).alias("n")).select("n.level", "n.node", F.explode("n.pos").alias("pos"))
    words = each.groupBy("level", "node", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")).alias("bits"))
    return words.select(F.col("node").alias("filter_id"), F.lit(0).cast("long").alias("grp"), "word", "bits", "level")


def counts(df: DataFrame, path: str, plan: TreePlan) -> DataFrame:
    """(level, node, items)."""
    nodes = F.array(*(F.struct(F.lit(i).alias("level"), node(F.col(path), i).alias("node")) for i in range(plan.depth + 1)))
    return df.select(F.explode(nodes).alias("n")).groupBy("n.level", "n.node").agg(F.count(F.lit(1)).alias("items"))


def _at(words: DataFrame, keys: DataFrame, key: str, plan: TreePlan, level: int) -> DataFrame:
    return membership.matching(keys, key, words.where(f"level = {level}"), plan.spec(level)).withColumnRenamed("filter_id", "node")


def _strides(plan: TreePlan) -> list[int]:
    return [-(-plan.spec(i).m // 64) for i in range(plan.depth + 1)]


def _bases(plan: TreePlan) -> list[int]:
    """Where each level's words start in one bitmap of all nodes."""
    strides, nodes = _strides(plan), [math.prod(plan.branching[:i]) for i in range(plan.depth + 1)]
    return [sum(n * s for n, s in zip(nodes[:i], strides[:i])) for i in range(plan.depth + 2)]


def _bitmap(words: DataFrame, plan: TreePlan) -> np.ndarray:
    """All nodes, one after the other, level by level; the caller has checked the size."""
    base = _bases(plan)
    # a node's number in its level, from its path
    number = F.aggregate(
        F.zip_with(
            F.split("filter_id", "/"),
            F.array(*(F.lit(b) for b in plan.branching)),
            lambda x, b: F.struct(x.try_cast("long").alias("x"), b.cast("long").alias("b")),
        ),
        F.lit(0).cast("long"),
        lambda n, x: F.when(x["x"].isNull(), n).otherwise(n * x["b"] + x["x"]),
    )
    of_level = lambda values: F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("level"))
    return membership.bitmap(words, base[-1], of_level(base[:-1]) + number * of_level(_strides(plan)) + F.col("word"))


def _located(df: DataFrame, key: str, words: DataFrame, plan: TreePlan, start: tuple[int, ...], last: int) -> DataFrame:
    """(key, node) of the nodes at level ``last`` below ``start`` that match with all between: a descent in one broadcast bitmap."""
    strides, branching, base = _strides(plan), plan.branching, _bases(plan)
    bits = df.sparkSession.sparkContext.broadcast(_bitmap(words, plan))
    specs = [plan.spec(i) for i in range(plan.depth + 1)]
    first = 0
    for x, b in zip(start, branching):
        first = first * b + x
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    hashed = keys.select(key, *(h.alias(f"_h{i}") for i, h in enumerate(place(specs[0])[0](F.col(key)))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = bits.value
        for batch in batches:
            h = [batch.column(i).to_numpy() for i in range(1, batch.num_columns)]
            row, at = np.arange(batch.num_rows), np.full(batch.num_rows, first, np.int64)
            for level in range(len(start), last + 1):
                ok = np.ones(len(row), bool)
                for _, pos in membership.slots([x[row] for x in h], specs[level]):
                    ok &= (w[base[level] + at * strides[level] + (pos >> 6)] >> (pos & 63)) & 1 == 1
                row, at = row[ok], at[ok]
                if level < last:
                    row, at = np.repeat(row, branching[level]), (at[:, None] * branching[level] + np.arange(branching[level])).ravel()
            if len(row):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(_paths(at, branching[:last]))], names=[key, "node"])

    return hashed.mapInArrow(run, f"`{key}` {keys.schema[key].dataType.simpleString()}, node string")


def _paths(number: np.ndarray, branching: tuple[int, ...]) -> list[str]:
    parts: list[list[str]] = []
    for b in reversed(branching):
        parts.append((number % b).astype(str).tolist())
        number = number // b
    return ["/".join(x) for x in zip(*reversed(parts))] if parts else [""] * len(number)


def _small(plan: TreePlan) -> bool:
    strides = _strides(plan)
    return 8 * sum(s * math.prod(plan.branching[:i]) for i, s in enumerate(strides)) <= membership.BROADCAST_BYTES


def register_locate(spark: SparkSession, name: str, words: DataFrame, plan: TreePlan) -> None:
    """A table function for SQL: ``name(key, prefix)`` gives (path, pruned) for each leaf whose nodes all match.

    Joined laterally, ``SELECT ... FROM t, LATERAL name(CAST(t.k AS STRING)) AS l``.  ``pruned`` counts the nodes that were tested and did not match, so that nothing
    below them was looked at; a key without a leaf has one row with a null path.  Paths come in order, as the descent finds them.  With a ``prefix``,
    such as '2', the search starts there.  Keys are texts of the portable profile; null has no row.
    """
    if not _small(plan):
        raise UnsupportedOperation(f"a tree of more than {membership.BROADCAST_BYTES} bytes is located by joins only")
    bits, base, strides, branching = spark.sparkContext.broadcast(_bitmap(words, plan)), _bases(plan), _strides(plan), plan.branching
    sizes = [(plan.spec(i).m, plan.spec(i).k) for i in range(plan.depth + 1)]

    class Locate:
        def eval(self, key: str, prefix: str = "") -> Iterator[tuple[str | None, int]]:
            if key is None:
                return
            digest = hashlib.md5(key.encode()).hexdigest()
            h1, h2 = int(digest[:15], 16), int(digest[16:31], 16)
            start = [int(x) for x in (prefix or "").split("/") if x]
            number = 0
            for x, b in zip(start, branching):
                number = number * b + x

            def matches(level: int, at: int) -> bool:
                w, (m, k) = bits.value, sizes[level]
                a, b = h1 % m, h2 % m
                for i in range(k):
                    p = (a + i * b + i * (i + 1) // 2) % m
                    if not int(w[base[level] + at * strides[level] + (p >> 6)]) >> (p & 63) & 1:
                        return False
                return True

            found, pruned = [], 0
            open_ = [(number, start)] if matches(len(start), number) else []
            while open_:
                at, path = open_.pop()
                if len(path) == len(branching):
                    found.append("/".join(map(str, path)))
                    continue
                for child in reversed(range(branching[len(path)])):
                    below = at * branching[len(path)] + child
                    if matches(len(path) + 1, below):
                        open_.append((below, [*path, child]))
                    else:
                        pruned += 1
            yield from ((x, pruned) for x in found or [None])

    spark.udtf.register(name, F.udtf(Locate, returnType="path string, pruned int"))


def contains(df: DataFrame, key: str, words: DataFrame, plan: TreePlan) -> DataFrame:
    """The distinct keys that the root's filter may hold."""
    return (_located(df, key, words, plan, (), 0) if _small(plan) else _at(words, df, key, plan, 0)).select(key)


def locate(df: DataFrame, key: str, words: DataFrame, plan: TreePlan, prefix: tuple[int, ...] = ()) -> DataFrame:
    """(key, node): the leaves whose nodes all match, from the prefix down (its ancestors aren't tested again).

    A tree that is small, as its plan tells, is descended in a broadcast bitmap; a larger one level by level, by joins.
    """
    if _small(plan):
        return _located(df, key, words, plan, prefix, plan.depth)
    start = "/".join(map(str, prefix))
    now = _at(words, df, key, plan, len(prefix)).where(F.col("node") == start)
    for level in range(len(prefix) + 1, plan.depth + 1):
        below = _at(words, now.select(key), key, plan, level).withColumnRenamed("node", "child")
        parent = F.regexp_replace("child", "/?[0-9]+$", "")
        now = below.withColumn("node", parent).join(now, [key, "node"], "left_semi").select(key, F.col("child").alias("node"))
    return now


def contains_in(df: DataFrame, key: str, words: DataFrame, plan: TreePlan, path: tuple[int, ...]) -> DataFrame:
    """The distinct keys that all nodes of a path may hold."""
    plan.check_path(path)
    own = words.where(F.col("filter_id").isin(["/".join(map(str, path[:i])) for i in range(plan.depth + 1)]))
    return locate(df, key, own, plan).where(F.col("node") == "/".join(map(str, path))).select(key)


def query_any(df: DataFrame, key: str, words: DataFrame, plan: TreePlan) -> DataFrame:
    """One row: whether any of the keys may be in the tree."""
    return contains(df, key, words, plan).agg((F.count(F.lit(1)) > 0).alias("any"))


def _below(column: str, prefix: tuple[int, ...]) -> Column:
    start = "/".join(map(str, prefix))
    return F.lit(True) if not prefix else (F.col(column) == start) | F.col(column).startswith(start + "/")


def subtree(words: DataFrame, prefix: tuple[int, ...]) -> DataFrame:
    return words.where(_below("filter_id", prefix))


def clear_subtree(words: DataFrame, prefix: tuple[int, ...]) -> DataFrame:
    """Without the subtree's bits; those of its ancestors stay."""
    return words.where(~_below("filter_id", prefix))


def counts_after_clear(counted: DataFrame, prefix: tuple[int, ...]) -> DataFrame:
    """``counts`` without the subtree's nodes; their items go from the ancestors too, though the bits stay there."""
    top = "/".join(map(str, prefix))
    lost = counted.where(F.col("node") == top).agg(F.coalesce(F.sum("items"), F.lit(0)).alias("_lost"))
    ancestors = ["/".join(map(str, prefix[:i])) for i in range(len(prefix))]
    left = counted.where(~_below("node", prefix)).crossJoin(F.broadcast(lost))  # one row
    return left.select("level", "node", F.when(F.col("node").isin(ancestors), F.col("items") - F.col("_lost")).otherwise(F.col("items")).alias("items"))


def _check(a: TreePlan, b: TreePlan) -> None:
    if a != b:
        raise IncompatibleFilters(f"{a} and {b} are different trees")


def union(a: DataFrame, b: DataFrame, a_plan: TreePlan, b_plan: TreePlan) -> DataFrame:
    _check(a_plan, b_plan)
    return a.unionByName(b).groupBy("filter_id", "grp", "word", "level").agg(F.bit_or("bits").alias("bits"))


def intersect(a: DataFrame, b: DataFrame, a_plan: TreePlan, b_plan: TreePlan) -> DataFrame:
    _check(a_plan, b_plan)
    both = a.join(b.withColumnRenamed("bits", "other"), ["filter_id", "grp", "word", "level"])
    return both.select("filter_id", "grp", "word", "level", F.col("bits").bitwiseAND(F.col("other")).alias("bits")).where("bits != 0")


def resized(df: DataFrame, key: str, path: str, plan: TreePlan, capacity: int) -> tuple[DataFrame, TreePlan]:
    """The tree built anew from its items, for another capacity of its leaves: bits alone can't be resized."""
    new = TreePlan(capacity, plan.rate, plan.branching)
    return build(df, key, path, new), new


def health(stats: DataFrame) -> DataFrame:
    """One row over the levels: the fullest one, items, and Healthy, Degraded or Critical by the leaves' mean load."""
    row = stats.agg(
        F.max("fill_rate").alias("max_fill"),
        F.max_by("level", "fill_rate").alias("fullest_level"),
        F.max("items").alias("items"),
        F.max_by("avg_load", "level").alias("leaf_load"),
    )
    state = F.when(F.col("leaf_load") > 0.9, "Critical").when(F.col("leaf_load") > 0.7, "Degraded").otherwise("Healthy")
    return row.select("*", state.alias("state"))


def invalid_nodes(words: DataFrame, plan: TreePlan) -> DataFrame:
    """(level, node, problem): nodes that the plan doesn't have, words beyond a filter's end, and nodes whose parent lacks bits."""
    depth = F.when(F.col("filter_id") == "", 0).otherwise(F.size(F.split("filter_id", "/")))
    child = F.split("filter_id", "/")
    limit = F.get(F.array(*(F.lit(b) for b in plan.branching)), F.col("level") - 1)
    last = F.get(F.array(*(F.lit((plan.spec(i).m - 1) // 64).cast("long") for i in range(plan.depth + 1))), F.col("level"))
    problem = F.when(
        (F.col("level") < 0) | (F.col("level") > plan.depth) | (depth != F.col("level")),
        "level",
    ).when((F.col("level") > 0) & (F.element_at(child, -1).cast("int") >= limit), "node").when((F.col("word") < 0) | (F.col("word") > last), "word")
    bad = words.select("level", F.col("filter_id").alias("node"), problem.alias("problem")).where("problem is not null").distinct()
    own = words.where("bits != 0").select("level", F.col("filter_id").alias("node")).distinct()
    parent = own.where("level > 0").select("level", "node", F.regexp_replace("node", "/?[0-9]+$", "").alias("up"))
    orphan = parent.join(
        own.select(F.col("node").alias("up"), (F.col("level") + 1).alias("level")),
        ["up", "level"],
        "left_anti",
    ).select("level", "node", F.lit("parent").alias("problem"))
    return bad.union(orphan)


def validate(words: DataFrame, plan: TreePlan) -> None:
    """Raises if a node is not the plan's, a word is beyond a filter's end, or a node's parent lacks bits."""
    bad = invalid_nodes(words, plan).limit(1).collect()
    if bad:
        raise InternalError(f"node {bad[0]['node']!r} of level {bad[0]['level']}: {bad[0]['problem']}")


def statistics(words: DataFrame, counted: DataFrame, plan: TreePlan) -> DataFrame:
    """Per level: nodes with items, items, set bits and fill, and the mean load of its nodes' capacity."""
    sizes = words.sparkSession.createDataFrame(
        [
            (
                i,
                plan.spec(i).m * math.prod(plan.branching[:i]),
                math.prod(plan.branching[:i]),
                plan.capacity * math.prod(plan.branching[i:]),
            ) for i in range(plan.depth + 1)
        ],
        "level int, bits long, nodes long, capacity long",
    )
    bits = words.groupBy("level").agg(F.sum(F.bit_count("bits").cast("long")).alias("set_bits"))
    items = counted.groupBy("level").agg(F.count(F.lit(1)).alias("used_nodes"), F.sum("items").alias("items"))
    out = sizes.join(bits, "level", "left").join(items, "level", "left")
    return out.select(
        "level",
        "nodes",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("used_nodes", "items", "set_bits")),
        (F.coalesce("set_bits", F.lit(0)) / F.col("bits")).alias("fill_rate"),
        (F.coalesce("items", F.lit(0)) / (F.col("nodes") * F.col("capacity"))).alias("avg_load"),
    )


def needs_resize(stats: DataFrame, level: float = 0.7) -> DataFrame:
    return stats.agg((F.max_by("avg_load", "level") > level).alias("needs_resize"))
