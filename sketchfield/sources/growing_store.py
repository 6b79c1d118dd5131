"""Growing filters that are filled batch by batch, and go on where the last batch ended.

A store holds the plan of the slices, the number of arrivals, and word tables: one for each batch, merged by OR when they
are read and into one table when there are ``MOST_TABLES``.  A batch's arrivals are ranked after those that are stored, so
any cut of an order of arrivals into batches gives the slices and words of one batch.  Each batch is committed by one new
manifest; a batch whose number is not above the last one's was committed before and changes nothing.

Rows with a null key are no arrivals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameters, MaxFiltersExceeded
from ..operators import cardinality, growing, membership
from ..plans.sizing import Spec
from ..plans.slices import MAX_SLICES, Growth, Slice, slice_plan
from .versions import Versions

MOST_TABLES = 16
_REGISTERS = "filter_id string, register long, rank int"


class GrowingStore:
    """Open or make a store; ``GrowingStore.open`` reads what there is."""

    def __init__(self, versions: Versions, head: dict[str, Any]) -> None:
        self._versions, self._head = versions, head

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        capacity: int,
        rate: float,
        growth: Growth = Growth(),
        ratio: float = 0.5,
        fill: float = 0.5,
        max_slices: int = MAX_SLICES,
        strict: bool = False,
        count_unique: bool = False,
    ) -> GrowingStore:
        """``strict``: a batch that would leave the last slice is an error, and nothing of it is stored.  ``count_unique``: keep sketches of the keys, too."""
        versions = Versions(spark, path)
        if versions.manifest() is not None:
            raise InvalidParameters(f"{path} has a filter already")
        if growth.kind == "adaptive":
            raise InvalidParameters("slices of adaptive growth depend on how full the ones before are; see growing.adaptive_build")
        plan = slice_plan(capacity, rate, 1, growth, ratio, fill, max_slices=1)
        settings = {"capacity": capacity, "rate": rate, "growth": asdict(growth), "ratio": ratio, "fill": fill, "max_slices": max_slices, "strict": strict, "count_unique": count_unique}
        content = {"batch": -1, "items": 0, "tables": {"words": [], "registers": []}, "settings": settings, "slices": [asdict(s) for s in plan]}
        return cls(versions, versions.commit(content, 0))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GrowingStore:
        versions = Versions(spark, path)
        head = versions.manifest()
        if head is None:
            raise InvalidParameters(f"{path} has no filter")
        return cls(versions, head)

    @property
    def plan(self) -> list[Slice]:
        return [Slice(**{**s, "spec": Spec(**s["spec"])}) for s in self._head["slices"]]

    @property
    def items(self) -> int:
        return self._head["items"]

    @property
    def batch(self) -> int:
        return self._head["batch"]

    def _opened(self, plan: list[Slice], arrivals: int) -> list[Slice]:
        """The plan with the slices that so many arrivals open."""
        s = self._head["settings"]
        while plan[-1].first + plan[-1].threshold <= arrivals and len(plan) < s["max_slices"]:
            plan = growing.grow(plan, s["capacity"], s["rate"], Growth(**s["growth"]), s["ratio"], s["fill"], max_slices=s["max_slices"])
        if s["strict"] and plan[-1].first + plan[-1].threshold <= arrivals:
            raise MaxFiltersExceeded(f"{arrivals} arrivals are more than {len(plan)} slices take")
        return plan

    def _commit(self, **changes: Any) -> None:
        self._head = self._versions.commit({**self._head, **changes}, self._head["version"])

    def insert(self, arrivals: DataFrame, key: str, order: Sequence[str], batch: int | None = None) -> bool:
        """Rows in an order, after all that are stored; whether the batch was new."""
        number = self.batch + 1 if batch is None else batch
        if number <= self.batch:
            return False
        own = arrivals.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, *order]))
        n = own.count()
        if not n:
            self._commit(batch=number)
            return True
        plan = self._opened(self.plan, self.items + n)
        rows = growing.assigned(own, order, plan, rows=n, before=self.items)
        full = len(self._head["tables"]["words"]) >= MOST_TABLES
        tables = self._merged() if full else {**self._head["tables"]}
        tables["words"] = [*tables["words"], self._versions.write(growing.build(rows, key, plan))]
        if self._head["settings"]["count_unique"]:
            tables["registers"] = [*tables["registers"], self._versions.write(cardinality.registers(own, key))]
        self._commit(batch=number, items=self.items + n, tables=tables, slices=[asdict(s) for s in plan])
        if full:
            self._versions.vacuum()
        return True

    def _merged(self) -> dict[str, list[str]]:
        """One table of each kind."""
        have = self._head["tables"]
        one = {"words": self.words, "registers": lambda: cardinality.merge(self._registers())}
        return {kind: [self._versions.write(one[kind]())] if len(names) > 1 else names for kind, names in have.items()}

    def words(self) -> DataFrame:
        """The words of all slices, slice as filter_id."""
        return membership.merged(self._parts())

    def _parts(self) -> DataFrame:
        """The words of all tables, which a lookup reads as they are, until a later version drops them."""
        return self._versions.read(self._head["tables"]["words"], membership.WORDS)

    def compact(self) -> None:
        """Merge the tables into one now, and drop what only older versions have."""
        self._commit(tables=self._merged())
        self._versions.vacuum(keep=1)

    def _registers(self) -> DataFrame:
        return self._versions.read(self._head["tables"]["registers"], _REGISTERS)

    def contains(self, df: DataFrame, key: str, out: str = "maybe") -> DataFrame:
        return growing.contains(df, key, self._parts(), self.plan, out, parts=True)

    def provenance(self, df: DataFrame, key: str, newest_first: bool = False) -> DataFrame:
        return growing.provenance(df, key, self._parts(), self.plan, newest_first, parts=True)

    def statistics(self) -> DataFrame:
        return growing.slice_statistics(self.words(), self.plan)

    def unique_count(self) -> DataFrame:
        """One row: the estimated number of distinct keys; without sketches the number of arrivals."""
        if not self._head["settings"]["count_unique"]:
            return self._versions.spark.createDataFrame([(self.items,)], "estimate long")
        return cardinality.estimate(cardinality.merge(self._registers())).select("estimate")

    def grow(self) -> None:
        """Open the next slice now: arrivals from here on go there."""
        s = self._head["settings"]
        plan = growing.grow(self.plan, s["capacity"], s["rate"], Growth(**s["growth"]), s["ratio"], s["fill"], self.items, s["max_slices"])
        self._commit(slices=[asdict(x) for x in plan])

    def set_fill_threshold(self, fill: float) -> None:
        """For the last slice and those to come.  A last slice that holds more already takes no further arrivals."""
        plan = growing.with_threshold(self.plan, fill)
        last = plan[-1]
        held = max(last.threshold, self.items - last.first + 1)
        plan[-1] = Slice(last.number, last.capacity, last.rate, last.spec, held, last.first)
        self._commit(slices=[asdict(x) for x in plan], settings={**self._head["settings"], "fill": fill})

    def clear(self) -> None:
        """Without an arrival, and back to the first slice as it was planned; batch numbers go on."""
        s = self._head["settings"]
        plan = slice_plan(s["capacity"], s["rate"], 1, Growth(**s["growth"]), s["ratio"], s["fill"], max_slices=1)
        self._commit(items=0, tables={"words": [], "registers": []}, slices=[asdict(x) for x in plan])

    def merge(self, key: str, order: Sequence[str]):
        """For ``foreachBatch``: a micro-batch that comes again changes nothing."""
        return lambda batch, number: self.insert(batch, key, order, number)
