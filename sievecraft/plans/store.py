"""Versioned Parquet snapshots: a write makes new folders, then one new manifest names the current ones of all tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


class SnapshotStore:
    """Tables under ``root``, which any file system that Spark knows can hold.

    A manifest is written under a partial name and then renamed to the next number; nothing is deleted or overwritten, and
    readers take the highest number. A commit that stops at any point therefore leaves all tables as they were. Of two
    commits at once, one finds its number taken and tries the next one on top of the other. Old snapshots stay until
    ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, at = self._fs(), self._path(f"{self.root}/_manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self) -> tuple[int, dict[str, str]]:
        """The last complete manifest's number, and the version of each table in it."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._fs().open(self._path(f"{self.root}/_manifests/{numbers[-1]}"))
        try:
            return numbers[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self, name: str) -> str | None:
        return self.manifest()[1].get(name)

    def read(self, name: str) -> DataFrame:
        """The current snapshot; an empty table of the known schema if there is none. Columns added since are null."""
        schema, version = TABLES.get(name), self.current(name)
        if version is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.parquet(f"{self.root}/{name}/{version}")
        for f in schema or []:
            if f.name not in found.columns:
                found = found.withColumn(f.name, F.lit(None).cast(f.dataType))
        return found

    def commit(self, **tables: DataFrame) -> None:
        """Write all tables, then make them current together."""
        written = {}
        for name, df in tables.items():
            written[name] = f"v-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{name}/{written[name]}")
        self._publish(written)

    def _publish(self, written: dict[str, str]) -> None:
        fs = self._fs()
        fs.mkdirs(self._path(f"{self.root}/_manifests"))
        for _ in range(100):
            number, known = self.manifest()
            part, to = (self._path(f"{self.root}/_manifests/{x}") for x in (f".{uuid.uuid4().hex}.partial", str(number + 1)))
            stream = fs.create(part, True)
            stream.write(bytearray(json.dumps(known | written).encode()))
            stream.close()
            if not fs.exists(to) and fs.rename(part, to):
                return
            fs.delete(part, False)
        raise OSError("could not publish a manifest")

    def write(self, name: str, df: DataFrame) -> None:
        self.commit(**{name: df})

    def vacuum(self, name: str) -> int:
        """Delete a table's snapshots that the last manifest doesn't name, and earlier manifests; how many snapshots."""
        fs, gone, keep = self._fs(), 0, self.current(name)
        for number in self._numbers()[:-1]:
            fs.delete(self._path(f"{self.root}/_manifests/{number}"), False)
        for status in fs.listStatus(self._path(f"{self.root}/{name}")):
            at = status.getPath()
            if at.getName().startswith("v-") and at.getName() != keep:
                gone += bool(fs.delete(at, True))
        return gone
