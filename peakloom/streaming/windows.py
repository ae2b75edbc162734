"""Structured Streaming forms of the time-binned operators: event-time windows with watermarks and gap sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def binned(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Sum and base peak per event-time window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.sum("value").alias("tic"), F.max("value").alias("base_peak"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "tic", "base_peak", "n")


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("apex")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "apex")


def running_targets(events: DataFrame) -> DataFrame:
    """Per user the intensity-weighted mean of values so far, kept as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        weight, moment, n = state.get if state.exists else (0.0, 0.0, 0)
        for f in frames:
            v = f["value"].to_numpy()
            weight += float((v**2).sum())
            moment += float((v**3).sum())
            n += len(v)
        state.update((weight, moment, n))
        yield pd.DataFrame({"user_id": [key[0]], "target": [moment / weight if weight else 0.0], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, target double, n long", "weight double, moment double, n long", "update", "NoTimeout")


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything available, into a memory table."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return stream.sparkSession.table(name)
