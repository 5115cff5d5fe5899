"""Readers of the formats that connectors meet, as frames, and a data source for paged web interfaces."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def csv_by_alias(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A CSV with a header; each wanted column is the first of its aliases that the header has, whatever the case."""
    df = spark.read.option("header", True).csv(path)
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    pick = lambda names: next((F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have), F.lit(None).cast("string"))
    return df.select(*[pick(names).alias(c) for c, names in aliases.items()])


def climate_table(spark: SparkSession, path: str, low: float = -99.0, high: float = 999.0) -> DataFrame:
    """Lines of a year and twelve monthly values; markers at or below ``low`` or at or above ``high`` are dropped.
    A month's value stands at its 15th."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).where((F.size("p") == 13) & F.col("p")[0].rlike(r"^\d{4}$"))
    tall = lines.select(F.col("p")[0].cast("int").alias("year"), F.posexplode(F.slice("p", 2, 12)).alias("m", "v"))
    tall = tall.select(F.make_timestamp_ntz("year", F.col("m") + 1, F.lit(15), F.lit(0), F.lit(0), F.lit(0)).alias("ts"), F.expr("try_cast(v as double)").alias("value"))
    return tall.where((F.col("value") > low) & (F.col("value") < high))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """title, link and published time of the items of an RSS file."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, description string").load(path)
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate"))
    return items.select("title", "link", when.alias("published"), F.trim(F.regexp_replace("description", "<[^>]*>", " ")).alias("summary"))


def gridded(df: DataFrame, variable: str, dims: list[str]) -> DataFrame:
    """Rows of a grid held as (one array a dimension, one flat array of values in row-major order); NaN is dropped."""
    flat = df.select(*dims, F.posexplode(variable).alias("k", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    out, stride = [], F.lit(1)
    for d in reversed(dims):
        out.append(F.get(d, F.floor(F.col("k") / stride).cast("int") % F.size(d)).alias(f"at_{d}"))
        stride = stride * F.size(d)
    return flat.select(*reversed(out), "value")


def fetched(call: Callable[[], list], tries: int = 3, pause: float = 1.0) -> list:
    """A call tried again after pauses that double."""
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)
    return []


class PagedSource(DataSource):
    """Records of a connector: one partition a page, read by the executors. The option ``fetch`` names a function
    module:name that takes a page number and returns tuples (source_id, ts as text, payload as JSON text)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "source_id string, ts string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.pages = options["fetch"], int(options.get("pages", 1))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from importlib import import_module

        module, name = self.fetch.split(":")
        yield from fetched(lambda: getattr(import_module(module), name)(partition.value))
