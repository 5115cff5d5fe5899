"""Shared plumbing: sessions, shared scratch tables, joins that survive hot keys."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot when it holds more than 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 64

_OWN_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def session(app: str = "tidewright", cores: str = "*", shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings that the engine's tests and bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once an application, unless they can import it already."""
    package = Path(__file__).resolve().parent
    home, app = str(package.parent), spark.sparkContext.applicationId
    if app in _SHIPPED or home == os.getcwd() or home in os.environ.get("PYTHONPATH", "").split(":"):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tidewright-')}/tidewright", "zip", home, package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where the cluster names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _OWN_ROOTS:
            _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        root = _OWN_ROOTS[app]
    return root.rstrip("/")


def col(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(taken: list[str], stem: str) -> str:
    """A column name like ``stem`` that is not taken; Spark does not tell cases apart."""
    known = {c.lower() for c in taken}
    while stem.lower() in known:
        stem += "_"
    return stem


class Files:
    """Small files and folders in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self.system.listStatus(self._path(""))] if self.system.exists(self._path("")) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: the file gets its name once it is written."""
        part = f"{name}.{uuid.uuid4().hex[:8]}.part"
        stream = self.system.create(self._path(part))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.system.rename(self._path(part), self._path(name)):
            self.drop(part)
            raise FileExistsError(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        self.system.delete(self._path(name), True)


_SCRATCHES: list[Scratch] = []


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and outlive any executor.

    ``save`` writes a frame and returns it as read back; ``drop`` deletes tables no longer needed. What is left is
    deleted by ``release``, once the results that read it are no longer needed.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/tidewright/{label}-{uuid.uuid4().hex[:12]}"
        _SCRATCHES.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            Files(self.spark, self.root).drop(name)


def scratches() -> int:
    """A mark for ``release``: how many scratch folders there are."""
    return len(_SCRATCHES)


def release(since: int = 0) -> None:
    """Deletes the scratch folders made since the mark. Frames that read them are of no more use."""
    while len(_SCRATCHES) > since:
        _SCRATCHES.pop().drop()


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row a ``key`` and in ``weight`` the number of left rows of it.

    Keys with more than 1/HOT_SHARE of the ``total`` left rows are at most HOT_SHARE in number, so they are
    broadcast; all others meet in a sort-merge join whose partitions are then even. Null keys match nothing.
    ``weight`` is dropped. Both inputs are read twice: pass stored tables.
    """
    key, limit = [key] if isinstance(key, str) else key, max(1, total // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(weight) > limit))
    cold = right.where(F.col(weight) <= limit).drop(weight)
    near = left.join(hot.drop(weight), key, "inner")
    far = left.join(hot.select(*key), key, "left_anti").join(cold.hint("merge"), key, how)
    return near.unionByName(far)
