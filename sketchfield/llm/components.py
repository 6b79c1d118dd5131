"""Connected components of a table of links, by alternating stars.

Each round connects larger neighbours, then smaller ones, to the smallest id near them, and
ends with a table stored in the shared folder; rounds stop when the links no longer change.
Each round's table goes when the next one is there.  Nothing is collected but a count and a
checksum, observed as the table is written.  The joins keep all rows of the busy side on
one side only, so skewed ids can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ._common import Scratch


def checksum() -> Column:
    """Of links (u, v) in any number and order."""
    return F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0).cast("long"))


def _round(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """The links, stored, with their number and checksum."""
    seen = Observation()
    state = F.count(F.lit(1)).alias("n"), checksum().alias("sum")
    table = scratch.stored(links.observe(seen, *state), "links")
    scratch.drop(keep=1)
    return table, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame, keeper: Scratch | None = None) -> DataFrame:
    """(node, component): the smallest id reachable, of every node that isn't its own smallest.

    ``links`` has two id columns of type long. Links of an id with itself, and with null, are ignored.
    The result's table goes with ``keeper``, if there is one.
    """
    a, b = (F.col(c) for c in links.columns)
    links = links.select(
        F.greatest(a, b).alias("u"),
        F.least(a, b).alias("v"),
        a.alias("a"),
        b.alias("b"),
    ).where("a is not null and b is not null and u > v").select("u", "v").distinct()
    scratch = Scratch()
    now, state = _round(links, scratch)
    while state[0]:
        both = now.union(now.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = state
        now, state = _round(small.union(least.select("u", "m")).distinct(), scratch)
        if state == before:
            break
    if keeper is not None:
        keeper.take(scratch)
    return now.toDF("node", "component")
