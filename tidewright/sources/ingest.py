"""SQL and Parquet in and out, connectors with their contract and registry, and ingest of what they fetch."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import mapping as M
from tidewright.sources.connectors import fetched

Box = tuple[float, float, float, float]


def attached(spark: SparkSession, tables: dict[str, str], schema: str | None = None) -> SparkSession:
    """The session with views over stored tables; a table that is not there is passed over."""
    for name, path in tables.items():
        try:
            spark.read.parquet(path).createOrReplaceTempView(f"{schema}_{name}" if schema else name)
        except Exception as missing:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    return spark


def sql(spark: SparkSession, text: str, params: dict | list | None = None) -> DataFrame:
    """A query with named (:x) or positional (?) parameters, bound and never pasted in."""
    return spark.sql(text, args=params) if params else spark.sql(text)


def dicts(rows: list[Row]) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows]


def export(df: DataFrame, path: str) -> str:
    """Writes Parquet, replacing what is there, and returns where it is."""
    df.write.mode("overwrite").parquet(path)
    return path if "://" in path else os.path.abspath(path)


def snapshot(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Each table replaced by its rows of now; the rows written. The counts come from the written files' footers."""
    out = {}
    for name, df in tables.items():
        export(df, f"{folder}/{name}.parquet")
        out[name] = df.sparkSession.read.parquet(f"{folder}/{name}.parquet").count()
    return out


class Pace:
    """At most one call an interval."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.next = 1.0 / per_second, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.interval


@dataclass
class Connector:
    """``fetch`` takes a box (west, south, east, north), two times and options, and gives records as dicts."""

    source_name: str
    source_url: str
    update_frequency: str
    fetch: Callable[..., list[dict]]
    per_second: float = 2.0
    tries: int = 3
    economic: bool = False
    options: dict = field(default_factory=dict)

    def records(self, box: Box, start: datetime, end: datetime, pace: Pace | None = None, **options) -> list[dict]:
        """Fetched at the allowed pace, with tries again; only records in the box and the times, if they have them."""
        (pace or Pace(self.per_second)).wait()
        rows = fetched(lambda: self.fetch(box, start, end, **{**self.options, **options}), self.tries)
        west, south, east, north = box

        def fits(r: dict) -> bool:
            ts, lon, lat = r.get("timestamp"), r.get("lon"), r.get("lat")
            return (ts is None or start <= ts <= end) and (lon is None or lat is None or (west <= lon <= east and south <= lat <= north))

        return [{"source_name": self.source_name, **r} for r in rows if fits(r)]


class Registry:
    """Connectors by key."""

    def __init__(self):
        self.known: dict[str, Connector] = {}

    def add(self, key: str, connector: Connector) -> None:
        if key in self.known:
            raise ValueError(f"{key} is registered")
        self.known[key] = connector

    def __getitem__(self, key: str) -> Connector:
        if key not in self.known:
            raise KeyError(f"no connector {key}; there are {', '.join(sorted(self.known))}")
        return self.known[key]


def tabledap_url(server: str, dataset: str, variables: list[str], box: Box | None = None, start: datetime | None = None, end: datetime | None = None, newest: int | None = None) -> str:
    """The address of a table query with its constraints pushed to the server."""
    parts = [",".join(variables)]
    if start:
        parts.append(f"time>={start:%Y-%m-%dT%H:%M:%SZ}")
    if end:
        parts.append(f"time<={end:%Y-%m-%dT%H:%M:%SZ}")
    if box:
        west, south, east, north = box
        parts += [f"latitude>={south}", f"latitude<={north}", f"longitude>={west}", f"longitude<={east}"]
    if newest:
        parts.append(f'orderByLimit("{newest}")')
    return f"{server.rstrip('/')}/tabledap/{dataset}.csv?" + quote("&".join(parts), safe=",&<>=()")


def table_lines(lines: Iterator[str]) -> list[dict]:
    """Rows of a table answer: names, then units, then values; empty ones and NaN are none."""
    import csv

    rows = list(csv.reader(lines))
    if len(rows) < 2:
        return []
    return [{k: None if v in ("", "NaN") else v for k, v in zip(rows[0], r, strict=False)} for r in rows[2:]]


TYPED = {"source_name": "string", "source_id": "string", "timestamp": "timestamp_ntz", "obs_type": "string", "mmsi": "long", "lat": "double", "lon": "double", "quality": "double"}


def observations(raw: DataFrame) -> DataFrame:
    """Typed fields of raw rows by themselves, all others as a payload without NaN; an MMSI that is no number is null."""
    have = [c for c in raw.columns if c not in TYPED]
    clean = [F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in raw.dtypes if c in have]
    typed = [(F.col(c).cast("string").try_cast(kind) if c == "mmsi" else F.col(c).cast(kind) if c in raw.columns else F.lit(None).cast(kind)).alias(c) for c, kind in TYPED.items()]
    return raw.select(*typed, F.to_json(F.struct(*clean)).alias("payload") if clean else F.lit("{}").alias("payload"))


def ingested(records: DataFrame) -> dict[str, DataFrame]:
    """A batch of records (source_name, source_id, ts, payload) dealt to the domain tables; those without a mapper
    become observations. ``lineage`` has a node for each record."""
    out = {name: M.dispatch(records, name) for name in M.TABLES}
    out["observations"] = M.unmapped(records)
    out["lineage"] = records.select(F.concat_ws(":", "source_name", "source_id").alias("node"), F.lit("record").alias("kind"), F.col("source_name").isin(list(M.mappers_of(records))).alias("mapped"))
    return out


def run_all(jobs: dict[str, Callable[[], int]], at_once: int = 15, timeout: float = 600.0) -> dict[str, int | str]:
    """Each job's rows or how it failed; one that fails or is late does not touch the others."""
    pool, out = ThreadPoolExecutor(at_once), {}
    running = {name: pool.submit(job) for name, job in jobs.items()}
    for name, job in running.items():
        try:
            out[name] = job.result(timeout)
        except TimeoutError:
            out[name] = "timeout"
        except Exception as bad:  # noqa: BLE001
            out[name] = f"failed: {bad}"
    pool.shutdown(wait=False, cancel_futures=True)
    return out


def pause(interval: float, failures: int) -> float:
    """Seconds until a periodic job's next run: longer, up to an hour, once it has failed three times."""
    return interval if failures < 3 else min(5 * interval, 3600.0)


def periodic(job: Callable[[], None], interval: float, runs: int, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs a job ``runs`` times; the failures in a row at the end."""
    failures = 0
    for _ in range(runs):
        try:
            job()
            failures = 0
        except Exception:  # noqa: BLE001
            failures += 1
        sleep(pause(interval, failures))
    return failures


def feed(df: DataFrame, box: Box | None = None, kinds: list[str] | None = None, severities: list[str] | None = None) -> DataFrame:
    """What one client sees of a stream or table: in its box, of its kinds and severities."""
    if box:
        west, south, east, north = box
        df = df.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    if kinds:
        df = df.where(F.col("event_type").isin(kinds))
    return df.where(F.col("severity").isin(severities)) if severities else df
