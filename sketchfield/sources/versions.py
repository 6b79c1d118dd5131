"""Folders whose content is what a manifest names: tables are written first, and count once a manifest has them.

A commit puts one small file ``manifests/<version>.json`` in place by renaming.  Whoever fails before leaves tables that
nobody reads.  One writer at a time is meant; a second one that commits the same version gets an error.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import InternalError, SerializationError

FORMAT = 1


class Versions:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> tuple[Any, Any]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def _names(self, folder: str) -> list[str]:
        fs, where = self._at(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, before: int | None = None) -> dict[str, Any] | None:
        """The last one, or the last whose ``batch`` is smaller; null if there is none."""
        for version in reversed(self.versions()):
            fs, where = self._at(f"manifests/{version:012d}.json")
            stream = fs.open(where)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                found = json.loads(text)
            except ValueError as e:
                raise SerializationError(f"{where} is no manifest") from e
            if found.get("format") != FORMAT:
                raise SerializationError(f"{where} is not of format {FORMAT}")
            if before is None or found["batch"] < before:
                return found
        return None

    def commit(self, content: dict[str, Any], after: int) -> dict[str, Any]:
        """Make ``content`` the version after ``after``."""
        new = {**content, "format": FORMAT, "version": after + 1}
        fs, temporary = self._at(f"manifests/.{uuid.uuid4().hex}")
        _, final = self._at(f"manifests/{after + 1:012d}.json")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise InternalError(f"version {after + 1} of {self.path} is there already")
        return new

    def write(self, table: DataFrame) -> str:
        """The name of a table that is written and not yet named by a manifest."""
        name = uuid.uuid4().hex
        table.write.parquet(f"{self.path}/tables/{name}")
        return name

    def read(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/tables/{n}" for n in names))

    def vacuum(self, keep: int = 2) -> int:
        """Drop all but the last ``keep`` manifests, and the tables that these don't name; gives the number of tables dropped."""
        last = self.versions()[-keep:]
        named: set[str] = set()
        for version in self.versions():
            if version not in last:
                fs, where = self._at(f"manifests/{version:012d}.json")
                fs.delete(where, False)
        for version in last:
            fs, where = self._at(f"manifests/{version:012d}.json")
            named |= set(_tables(json.loads("".join(r[0] for r in self.spark.read.text(str(where)).collect()))))
        gone = [n for n in self._names("tables") if n not in named]
        for n in gone:
            fs, where = self._at(f"tables/{n}")
            fs.delete(where, True)
        return len(gone)


def _tables(manifest: dict[str, Any]) -> list[str]:
    return [n for names in manifest["tables"].values() for n in names]
