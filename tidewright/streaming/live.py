"""Streams: live positions and events read as they come, with event time, watermarks and state in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.common import Scratch
from tidewright.operators.vessels import ALERTS, evaluate


def event_stream(spark: SparkSession, sf_dir: str, late: str = "10 minutes") -> DataFrame:
    """The events folder as a stream on event time, a file a batch; later rows than ``late`` are dropped."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def cleaned(fixes: DataFrame) -> DataFrame:
    """Fixes with a vessel, a position, and not at the origin."""
    return fixes.where("mmsi is not null and lat is not null and lon is not null and not (lat = 0 and lon = 0)")


def windowed_counts(stream: DataFrame, window: str = "1 hour") -> DataFrame:
    g = stream.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("period"), "event_type", "n", F.round("total", 6).alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's runs of events less than ``gap`` apart; one is put out once no event in time can lengthen it."""
    g = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start_ts"), F.col("w.end").cast("timestamp_ntz").alias("end_ts"), "n")


def once(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return stream.dropDuplicatesWithinWatermark([key]).select(key, F.col("ts").cast("timestamp_ntz").alias("ts"))


def latest_by_user(stream: DataFrame) -> DataFrame:
    return stream.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("x")).select("user_id", F.col("x.ts").cast("timestamp_ntz").alias("ts"), "x.event_id", "x.value")


def geofence_stream(fixes: DataFrame, zones: list[dict]) -> DataFrame:
    """Alerts of a stream of fixes: the rules of the batch, with a state of each vessel's zones kept between batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        states, out = (json.loads(state.get[0]) if state.exists else [{} for _ in zones]), []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for r in rows.itertuples():
            for zone, s in zip(zones, states, strict=True):
                if zone.get("mmsi") and r.mmsi not in zone["mmsi"]:
                    continue
                out += [(r.mmsi, zone["name"], rule, r.ts, float(x)) for rule, x in evaluate(zone, s, r.ts.timestamp(), r.lat, r.lon, r.sog)]
        state.update((json.dumps(states),))
        yield pd.DataFrame(out, columns=ALERTS.names)

    return fixes.groupBy("mmsi").applyInPandasWithState(run, ALERTS, "state string", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """Runs the stream over all that is there now and returns what it has put out: the last state of a complete
    result, or all rows of an appended one. Sink and checkpoint are in the shared folder."""
    scratch = Scratch(spark, "stream")

    # A batch that is tried again writes over its own folder.
    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(scratch.path("out/run=0" if mode == "complete" else f"out/run={batch}"))

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", scratch.path("checkpoint")).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(scratch.path("out")).select(*stream.columns)


def streamed(op: Callable[[DataFrame], DataFrame], mode: str = "complete") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: drained(op(event_stream(spark, sf_dir)), spark, mode)
