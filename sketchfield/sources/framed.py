"""Filters as files of framed records: ``spark.read.format("sketch").load(path)``.

A frame holds the cells of one chunk of one group of one filter, and says what they are of: format version, kind, hash profile, index strategy
and the whole spec or plan, the number of cells, and a checksum.  A reader raises for a frame that is cut or changed, of
another version, or with another strategy, profile or kind than asked for (options ``kind``, ``strategy``, ``profile``).
Tasks write files of their own, which count when the job commits; a file is a partition when it is read.

Rows are (filter_id, level, grp, word, bits); counters have their position as word and their count as bits.  ``save`` and
``load`` turn each kind into such rows and back.  Paths are of a folder that driver and executors mount alike, as
Python data sources don't see Spark's other file systems; on those, use ``store``.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import IncompatibleFilters, SerializationError
from ..functions.hashing import PROFILES
from ..plans.sizing import Spec
from ..plans.slices import Slice, TreePlan

MAGIC, VERSION = b"SKF", 1
CHUNK = 1 << 17  # cells of a frame
KINDS = ("filter", "counters", "slices", "tree")
SCHEMA = "filter_id string, level int, grp long, word long, bits long"
_LENGTH = struct.Struct("<I")


def frame(header: dict[str, Any], offsets: np.ndarray, values: np.ndarray) -> bytes:
    """A record of cells at offsets in a chunk."""
    head = json.dumps({**header, "cells": len(offsets)}).encode()
    body = zlib.compress(offsets.astype("<u4").tobytes() + values.astype("<i8").tobytes(), 1)
    check = zlib.crc32(body, zlib.crc32(head))
    return b"".join((MAGIC, bytes([VERSION]), _LENGTH.pack(len(head)), head, _LENGTH.pack(len(body)), body, _LENGTH.pack(check)))


def frames(data: bytes, expected: dict[str, str] | None = None) -> Iterator[tuple[dict[str, Any], np.ndarray, np.ndarray]]:
    """(header, offsets, values) of each record, checked."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise SerializationError("a frame is cut")
        at += n
        return data[at - n : at]

    while at < len(data):
        if take(3) != MAGIC:
            raise SerializationError("no frame of a sketch")
        version = take(1)[0]
        if version != VERSION:
            raise SerializationError(f"a frame of version {version}, not {VERSION}")
        head = take(_LENGTH.unpack(take(4))[0])
        body = take(_LENGTH.unpack(take(4))[0])
        if _LENGTH.unpack(take(4))[0] != zlib.crc32(body, zlib.crc32(head)):
            raise SerializationError("a frame has changed")
        header = json.loads(head)
        if header["kind"] not in KINDS or header["profile"] not in PROFILES:
            raise SerializationError(f"unknown kind {header['kind']} or hash profile {header['profile']}")
        for what, value in (expected or {}).items():
            if header[what] != value:
                raise IncompatibleFilters(f"the {what} is {header[what]}, not {value}")
        cells = zlib.decompress(body)
        if len(cells) != 12 * header["cells"]:
            raise SerializationError(f"{len(cells)} bytes are not {header['cells']} cells")
        yield header, np.frombuffer(cells, "<u4", header["cells"]), np.frombuffer(cells, "<i8", header["cells"], 4 * header["cells"])


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


def _local(options: dict[str, str]) -> str:
    path = options.get("path")
    if not path:
        raise SerializationError("a sketch needs a path")
    return path.removeprefix("file://").removeprefix("file:")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = _local(options)
        self.expected = {c: options[c] for c in ("kind", "strategy", "profile") if c in options}

    def partitions(self) -> list[InputPartition]:
        files = [n for n in sorted(os.listdir(self.folder)) if n.endswith(".skf") and not n.startswith(".")]
        return [_File(f"{self.folder}/{n}") for n in files] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:  # a sketch without a cell
            return
        with open(partition.path, "rb") as f:
            data = f.read()
        for header, offsets, values in frames(data, self.expected):
            n, start = len(offsets), header["chunk"] * CHUNK
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([header["filter_id"]] * n, pa.string()), pa.array(np.full(n, header["level"], np.int32)), pa.array(np.full(n, header["grp"], np.int64)),
                    pa.array(offsets.astype(np.int64) + start), pa.array(values.astype(np.int64)),
                ],
                names=["filter_id", "level", "grp", "word", "bits"],
            )


class _Writer(DataSourceArrowWriter):
    """Files get their names when the job commits."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.overwrite, self.header = _local(options), overwrite, json.loads(options["header"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        name, now, cells = f"{uuid.uuid4().hex}.skf", None, ([], [])
        with open(f"{self.folder}/.{name}", "wb") as f:

            def put() -> None:
                owner, level, grp, chunk = now
                f.write(frame({**self.header, "filter_id": owner, "level": level, "grp": grp, "chunk": chunk}, *(np.concatenate(c) for c in cells)))

            some = False
            for batch in iterator:
                owner, level, grp, word, bits = (batch.column(c) for c in ("filter_id", "level", "grp", "word", "bits"))
                word, bits = word.to_numpy(), bits.to_numpy()
                keys = list(zip(owner.to_pylist(), level.to_pylist(), grp.to_pylist(), (word // CHUNK).tolist()))
                cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
                for a, z in zip(cuts, [*cuts[1:], len(keys)]):
                    if some and keys[a] != now:
                        put()
                        cells = ([], [])
                    now, some = keys[a], True
                    cells[0].append(word[a:z] % CHUNK)
                    cells[1].append(bits[a:z])
            if some:
                put()
        if not some:
            os.remove(f"{self.folder}/.{name}")
        return _Written(name if some else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        before = [n for n in os.listdir(self.folder) if n.endswith(".skf") and not n.startswith(".")]
        for m in messages:
            if m is not None and m.name:
                os.rename(f"{self.folder}/.{m.name}", f"{self.folder}/{m.name}")
        for n in before if self.overwrite else []:
            os.remove(f"{self.folder}/{n}")
        with open(f"{self.folder}/_header.json", "w") as f:
            json.dump(self.header, f)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None and m.name and os.path.exists(f"{self.folder}/.{m.name}"):
                os.remove(f"{self.folder}/.{m.name}")


class SketchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sketch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("sketch")`` known to a session."""
    spark.dataSource.register(SketchSource)


def _write(rows: DataFrame, kind: str, spec: Spec, path: str, meta: dict[str, Any]) -> None:
    register(rows.sparkSession)
    header = {"kind": kind, "profile": spec.profile, "strategy": spec.strategy, "meta": meta}
    chunk = F.expr(f"word div {CHUNK}")
    dealt = rows.repartition("filter_id", "level", "grp", chunk).sortWithinPartitions("filter_id", "level", "grp", "word")
    dealt.write.format("sketch").mode("overwrite").option("header", json.dumps(header)).save(path)


def save(words: DataFrame, spec: Spec, path: str, items: int | None = None) -> None:
    """A filter, or one for each filter_id."""
    _write(words.select("filter_id", F.lit(0).alias("level"), "grp", "word", "bits"), "filter", spec, path, {"spec": asdict(spec), "items": items})


def save_counters(counters: DataFrame, spec: Spec, bits: int, path: str, items: int = 0) -> None:
    rows = counters.select(F.lit("").alias("filter_id"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("grp"), F.col("pos").alias("word"), F.col("cnt").alias("bits"))
    _write(rows, "counters", spec, path, {"spec": asdict(spec), "bits": bits, "items": items})


def save_slices(words: DataFrame, plan: list[Slice], path: str, items: int = 0) -> None:
    _write(words.select("filter_id", F.lit(0).alias("level"), "grp", "word", "bits"), "slices", plan[0].spec, path, {"slices": [asdict(s) for s in plan], "items": items})


def save_tree(words: DataFrame, plan: TreePlan, path: str) -> None:
    _write(words.select("filter_id", F.col("level").cast("int").alias("level"), "grp", "word", "bits"), "tree", plan.spec(0), path, {"tree": asdict(plan)})


def _read(spark: SparkSession, path: str, kind: str, expected: Spec | None) -> tuple[DataFrame, dict[str, Any]]:
    register(spark)
    try:
        with open(f"{_local({'path': path})}/_header.json") as f:
            header = json.load(f)
    except (OSError, ValueError) as e:
        raise SerializationError(f"{path} has no sketch") from e
    if header["kind"] != kind:
        raise IncompatibleFilters(f"{path} has {header['kind']}, not {kind}")
    rows = spark.read.format("sketch").option("kind", kind).option("profile", header["profile"]).option("strategy", header["strategy"])
    if expected is not None:
        rows = rows.option("profile", expected.profile).option("strategy", expected.strategy)
        found = Spec(**header["meta"]["spec"])
        if not found.compatible(expected):
            raise IncompatibleFilters(f"{path} has a filter of {found}")
    return rows.load(path), header["meta"]


def load(spark: SparkSession, path: str, expected: Spec | None = None) -> tuple[DataFrame, Spec, int | None]:
    """Words, spec and number of items."""
    rows, meta = _read(spark, path, "filter", expected)
    return rows.drop("level"), Spec(**meta["spec"]), meta["items"]


def load_counters(spark: SparkSession, path: str, expected: Spec | None = None) -> tuple[DataFrame, Spec, int, int]:
    """Counters, spec, the counters' size in bits and the number of items."""
    rows, meta = _read(spark, path, "counters", expected)
    return rows.select(F.col("word").alias("pos"), F.col("bits").alias("cnt")), Spec(**meta["spec"]), meta["bits"], meta["items"]


def load_slices(spark: SparkSession, path: str) -> tuple[DataFrame, list[Slice], int]:
    rows, meta = _read(spark, path, "slices", None)
    return rows.drop("level"), [Slice(**{**s, "spec": Spec(**s["spec"])}) for s in meta["slices"]], meta["items"]


def load_tree(spark: SparkSession, path: str) -> tuple[DataFrame, TreePlan]:
    rows, meta = _read(spark, path, "tree", None)
    t = meta["tree"]
    return rows, TreePlan(t["capacity"], t["rate"], tuple(t["branching"]))
