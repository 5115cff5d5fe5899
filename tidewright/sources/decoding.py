"""Decoders of the odd formats that connectors meet, as column expressions and frames.

A value that cannot be read is null, never an error; a null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Mean longitude and latitude of a ring's vertices, the closing one counted as it stands."""
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda s, v: s + v[i]) / F.nullif(F.size(ring), F.lit(0))
    return mean(0), mean(1)


def geojson_centroid(geometry: Column) -> tuple[Column, Column]:
    """Of a Polygon, or the first polygon of a MultiPolygon, as GeoJSON text: the mean of its first ring's vertices."""
    multi = F.get_json_object(geometry, "$.type") == "MultiPolygon"
    text = F.when(multi, F.get_json_object(geometry, "$.coordinates[0][0]")).otherwise(F.get_json_object(geometry, "$.coordinates[0]"))
    return ring_centroid(F.from_json(text, "array<array<double>>"))


def json_stat(df: DataFrame, column: str) -> DataFrame:
    """Rows of JSON-stat texts: the columns of ``df`` but ``column``, then ``at`` (dimension to category) and ``value``.

    A flat index is a number in the mixed radix of the dimensions' sizes, the last one moving fastest.
    """
    c = F.col(column)
    own = F.struct(F.lit(0).alias("none"), *[x for x in df.columns if x != column]).alias("own")
    read = df.select(
        own,
        F.from_json(F.get_json_object(c, "$.id"), "array<string>").alias("ids"),
        F.from_json(F.get_json_object(c, "$.size"), "array<int>").alias("sizes"),
        F.from_json(F.get_json_object(c, "$.value"), "map<string,double>").alias("sparse"),
        F.from_json(F.get_json_object(c, "$.value"), "array<double>").alias("dense"),
        F.from_json(F.get_json_object(c, "$.dimension"), "map<string,struct<category:struct<index:map<string,int>>>>").alias("dims"),
    )
    dense = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size("dense") - 1), lambda k: k.cast("string")), F.col("dense"))
    cells = F.when(F.size("dense") > 0, dense).otherwise(F.col("sparse"))
    flat = read.select("own", "ids", "sizes", "dims", F.explode(cells).alias("flat_index", "value")).where("value is not null").withColumn("flat_index", F.col("flat_index").cast("int"))
    stride = lambda i: F.aggregate(F.slice("sizes", i + 2, F.size("sizes")), F.lit(1), lambda s, n: s * n)
    place = lambda i: F.floor(F.col("flat_index") / stride(i)).cast("int") % F.get("sizes", i)
    label = lambda d, i: F.element_at(F.map_keys(F.map_filter(F.col("dims")[d]["category"]["index"], lambda _, v: v == place(i))), 1)
    return flat.select("own", F.map_from_arrays("ids", F.transform("ids", label)).alias("at"), "value").select("own.*", "at", "value").drop("none")


def position(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the first ``ddd-mm.m[NS] ddd-mm.m[EW]`` in a text."""
    pattern = r"(\d{1,3})-(\d{1,2}(?:\.\d+)?)([NS])\s+(\d{1,3})-(\d{1,2}(?:\.\d+)?)([EW])"
    at = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    degrees = lambda i, minus: (at(i).cast("double") + at(i + 1).cast("double") / 60) * F.when(at(i + 2) == minus, -1).otherwise(1)
    return degrees(1, "S"), degrees(4, "W")


def coordinate(text: Column) -> Column:
    """A number as it stands, else ``deg-min-sec`` with a hemisphere letter, else null."""
    pattern = r"^\s*(\d{1,3})-(\d{1,2})(?:-(\d{1,2}(?:\.\d+)?))?\s*([NSEWnsew])\s*$"
    at = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    parts = at(1).cast("double") + at(2).cast("double") / 60 + F.coalesce(at(3).cast("double"), F.lit(0.0)) / 3600
    return F.coalesce(text.try_cast("double"), parts * F.when(F.upper(at(4)).isin("S", "W"), -1).otherwise(1))


def zulu(text: Column) -> Column:
    """The moment of the first ``DDHHMMZ MON YYYY`` in a text."""
    pattern = rf"(?i)(\d{{2}})(\d{{2}})(\d{{2}})Z\s+({'|'.join(MONTHS)})\w*\s+(\d{{4}})"
    at = lambda i: F.regexp_extract(text, pattern, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(at(4)))
    number = lambda i: F.nullif(at(i), F.lit("")).cast("int")
    return F.try_make_timestamp_ntz(number(5), month.cast("int"), number(1), number(2), number(3), F.lit(0))


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, with map-side aggregation."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def score_means(df: DataFrame, by: list[str], indicator: str, score: str, families: dict[str, str]) -> DataFrame:
    """Mean score by group, overall and of each family of indicators (those whose name holds a text), to 2 places."""
    of = lambda text: F.round(F.avg(F.when(F.lower(indicator).contains(text.lower()), F.col(score))), 2)
    return df.groupBy(*by).agg(F.round(F.avg(score), 2).alias("overall"), *[of(text).alias(name) for name, text in families.items()])


def marked_numbers(df: DataFrame, columns: list[str], marker: str = "MM") -> DataFrame:
    """Texts as numbers, null where the marker stands, and a payload of those that are there."""
    numbers = {c: F.nullif(F.trim(c), F.lit(marker)).try_cast("double") for c in columns}
    return df.withColumns(numbers).withColumn("payload", F.to_json(F.struct(*columns)))


def sdmx_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations of an SDMX generic data message: ``at`` (dimension to code), ``value``. Name spaces do not matter."""
    schema = "`generic:ObsKey` struct<`generic:Value`: array<struct<_id:string,_value:string>>>, `generic:ObsValue` struct<_value:string>"
    rows = spark.read.format("xml").option("rowTag", "generic:Obs").schema(schema).load(path)
    keys = F.col("`generic:ObsKey`.`generic:Value`")
    pairs = F.map_from_entries(F.transform(keys, lambda v: F.struct(v["_id"], v["_value"])))
    return rows.select(pairs.alias("at"), F.col("`generic:ObsValue`._value").try_cast("double").alias("value")).where("value is not null")


def sanctioned(df: DataFrame, text: str | None = None) -> DataFrame:
    """Of records (schema, caption, names array, imo): vessels, or, given a text, those that hold it whatever the case."""
    if text is None:
        return df.where(F.col("schema") == "Vessel")
    has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    return df.where(F.coalesce(has(F.col("caption")), F.lit(False)) | F.coalesce(F.exists("names", has), F.lit(False)) | F.coalesce(has(F.col("imo")), F.lit(False)))


def region_of(text: Column, keywords: dict[str, str], default: str | None = None) -> Column:
    """The region of the longest keyword that the text holds; of keywords of one length the first in the alphabet."""
    out = F.lit(default)
    for word in sorted(keywords, key=lambda w: (len(w), [-ord(c) for c in w])):
        out = F.when(F.contains(F.lower(text), F.lit(word.lower())), keywords[word]).otherwise(out)
    return out


def vessel_lines(df: DataFrame, column: str = "line") -> DataFrame:
    """Lines that speak of a vessel, whatever the case."""
    return df.where(F.col(column).rlike(r"(?i)VESSEL|IMO|MMSI|SHIP"))


def grid_plan(spark: SparkSession, west: float, south: float, east: float, north: float, grid: int, step: float = 0.5) -> DataFrame:
    """The points at which a box is sampled: on each axis max(1, min(grid, ceil(range / step))) steps, at their starts."""
    from math import ceil

    axis = lambda low, high: max(1, min(grid, ceil((high - low) / step)))
    nx, ny = axis(west, east), axis(south, north)
    cells = spark.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    return cells.select("i", "j", (F.lit(west) + F.col("i") * ((east - west) / nx)).alias("lon"), (F.lit(south) + F.col("j") * ((north - south) / ny)).alias("lat"))
