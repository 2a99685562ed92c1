"""An archive as a folder of Parquet tables, replaced by whole versions."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.errors import ArgumentError
from quarry.schemas import TABLES


class Archive:
    """Tables under one folder: ``<path>/<table>/<version>/`` with Parquet files; the greatest version is current.

    Appends add files to the current version; updates and deletes write a new version from a query over the
    current one and so never read what they replace. Versions are listed through Spark's file system API, so the
    folder may be in any store that Spark reads.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self, table: str) -> list[str]:
        fs, where = self._fs(f"{self.path}/{table}")
        if not fs.exists(where):
            return []
        done = lambda s: fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])
        return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() and done(s))

    def read(self, table: str) -> DataFrame:
        if table not in TABLES:
            raise ArgumentError(f"no table {table}")
        found = self.versions(table)
        if not found:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}/{found[-1]}")

    def append(self, table: str, rows: DataFrame) -> None:
        found = self.versions(table)
        at = f"{self.path}/{table}/{found[-1] if found else self._new()}"
        rows.select(*[rows[f.name].cast(f.dataType) for f in TABLES[table]]).write.mode("append").parquet(at)

    def replace(self, table: str, rows: DataFrame) -> None:
        """A new version; readers see it once it is whole."""
        rows.select(*[rows[f.name].cast(f.dataType) for f in TABLES[table]]).write.parquet(f"{self.path}/{table}/{self._new()}")

    @staticmethod
    def _new() -> str:
        return f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def check_config(self, check_write: bool = False) -> bool:
        """Whether the folder is there (and can be written to)."""
        fs, where = self._fs(self.path)
        if check_write:
            probe = self._fs(f"{self.path}/_probe-{uuid.uuid4().hex}")[1]
            return fs.mkdirs(probe) and fs.delete(probe, True)
        return fs.exists(where)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder as ``(path, length, data)``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).selectExpr("path", "length", "content as data")


class ReferenceWeeks:
    """Object references as a Parquet folder with a directory per ISO week, which opens, lists and drops weeks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, week: tuple[int, int]):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/iso_year={week[0]}/iso_week={week[1]}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def create(self, weeks: list[tuple[int, int]]) -> None:
        for week in weeks:
            fs, where = self._at(week)
            fs.mkdirs(where)

    def list(self) -> list[tuple[int, int]]:
        fs, where = self._at((0, 0))
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/iso_year=*/iso_week=*")) or []
        return sorted(tuple(int(part.split("=")[1]) for part in s.getPath().toString().split("/")[-2:]) for s in found)

    def drop(self, weeks: list[tuple[int, int]]) -> None:
        for week in weeks:
            fs, where = self._at(week)
            fs.delete(where, True)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("iso_year", "iso_week").parquet(self.path)

    def read(self) -> DataFrame:
        """All weeks; filters on ``iso_year`` and ``iso_week`` read only those."""
        return self.spark.read.schema(TABLES["object_reference"]).parquet(self.path)
