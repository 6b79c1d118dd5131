"""Filters that follow a stream: micro-batches add tables of words to a versioned folder, so replays do no harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import membership
from ..plans.sizing import Spec
from ..sources.versions import Versions


class FilterSink:
    """``foreachBatch(sink.merge)``: each batch adds a table of its words and a manifest that names it.

    A batch that comes again changes nothing.  Tables are merged when there are ``most``; the tables before the last batch
    stay, as a replay of it asks for them.
    """

    def __init__(self, path: str, key: str, spec: Spec, most: int = 16) -> None:
        self.path, self.key, self.spec, self.most = path, key, spec, most

    def words(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The filter after a batch: the last one, or the one before."""
        return self._read(Versions(spark, self.path), batch_id + 1)

    def _read(self, versions: Versions, before: int) -> DataFrame:
        head = versions.manifest(before)
        return membership.merged(versions.read(head["tables"]["words"] if head else [], membership.WORDS))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        versions = Versions(batch.sparkSession, self.path)
        head = versions.manifest() or {"batch": -1, "version": 0, "tables": {"words": []}}
        if batch_id <= head["batch"]:
            return
        names = head["tables"]["words"]
        full = len(names) >= self.most
        if full:
            names = [versions.write(self._read(versions, batch_id))]
        names = [*names, versions.write(membership.build(batch, self.key, self.spec))]
        versions.commit({"batch": batch_id, "tables": {"words": names}}, head["version"])
        if full:
            versions.vacuum()


def windowed_words(events: DataFrame, key: str, ts: str, spec: Spec, width: str, late: str) -> DataFrame:
    """A filter for each time window of a stream; rows later than the watermark aren't in it."""
    at = membership.positions(events.withWatermark(ts, late), key, spec, [ts])
    bit = F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")
    return at.groupBy(F.window(ts, width), "grp", F.expr("pos div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))


def first_seen(batch: DataFrame, key: str, known: DataFrame, spec: Spec) -> DataFrame:
    """Rows of a batch whose key is certainly new, once for each key."""
    return membership.anti_join(batch.dropDuplicates([key]), key, known, spec)


def deduplicated(stream: DataFrame, key: str, sink: FilterSink, write: Callable[[DataFrame, int], None]):
    """A streaming query that passes on what the filter hasn't seen, then merges it in."""

    def each(batch: DataFrame, batch_id: int) -> None:
        fresh = first_seen(batch, key, sink.words(batch.sparkSession, batch_id - 1), sink.spec) if batch_id else batch.dropDuplicates([key])
        write(fresh, batch_id)
        sink.merge(batch, batch_id)

    return stream.writeStream.foreachBatch(each)
