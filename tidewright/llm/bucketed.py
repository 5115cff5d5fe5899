"""Persistent bucketed tables in the shared folder, listed in a manifest there.

A store is a folder of Parquet tables, each bucketed and sorted by the same keys. The manifest names the tables that
count; it is written as a new version after a table is complete, so what a lost driver left half done is not read and
is overwritten later. Opening a store by its name, in the same session or a later one, reads the newest version and
registers its tables, so a join on the keys does not shuffle them. Spark still sorts a bucket as it reads it, as
a bucket may have several files; each of these is sorted already.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewright.common import Files, shared_root


class BucketStore:
    def __init__(self, spark: SparkSession, keys: list[str], schema: str, buckets: int, name: str | None = None):
        """``buckets`` is fixed when a store is made; a store that is there keeps its own number."""
        self.spark, self.keys, self.schema = spark, keys, schema
        self.name = name or f"store_{uuid.uuid4().hex[:12]}"
        self.files = Files(spark, f"{shared_root(spark)}/tidewright/stores/{self.name}")
        self.version, self.buckets, self.made = 0, buckets, 0
        #: Table to its level, in the order in which they were written.
        self.tables: dict[str, int] = {}
        if versions := self._versions():
            held = json.loads(self.files.read(versions[-1]))
            self.version, self.buckets, self.made, self.tables = held["version"], held["buckets"], held["made"], held["tables"]
        for table in self.tables:
            self._register(table)

    def _versions(self) -> list[str]:
        return sorted(n for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json"))

    def _register(self, table: str) -> None:
        by = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        self.spark.sql(f"CREATE TABLE `{table}` ({self.schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.files.root}/{table}'")

    def record(self) -> None:
        """Makes the present list of tables the one that counts."""
        older = self._versions()
        self.version += 1
        self.files.write(f"manifest-{self.version:08d}.json", json.dumps({"version": self.version, "buckets": self.buckets, "made": self.made, "tables": self.tables}))
        for name in older:
            self.files.drop(name)

    def create(self, level: int = 0) -> str:
        """A new empty table; it counts once it is recorded."""
        self.made += 1
        table = f"{self.name}_l{level}_{self.made}"
        self.files.drop(table)
        self._register(table)
        self.tables[table] = level
        return table

    def append(self, table: str, rows: DataFrame) -> None:
        path = f"{self.files.root}/{table}"
        rows.write.mode("append").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", path).format("parquet").saveAsTable(table)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"`{name}`")

    def remove(self, tables: list[str]) -> None:
        """Tables that are recorded no more."""
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS `{t}`")
            self.files.drop(t)

    def drop(self) -> None:
        """The whole store."""
        self.remove(list(self.tables))
        self.files.drop()
        self.tables = {}
