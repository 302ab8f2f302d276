"""Structured Streaming: live ingest, tumbling counts, stateful alert de-duplication, and replay on a virtual clock."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType


def read_detections(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique(stream: DataFrame, ts: str = "acq", late: str = "3 hours", key: str = "detection_id") -> DataFrame:
    """Each id once, as far as the watermark reaches back."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, width: str, ts: str = "acq", late: str = "3 hours") -> DataFrame:
    """An extension: counts and power per window and day/night flag."""
    w = F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w, "daynight").agg(F.count("*").alias("n"), F.sum("frp").alias("frp")).select(F.col("window.start").alias("start"), "daynight", "n", "frp")


def run_cycles(stream: DataFrame, checkpoint: str, cycle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls cycle for each micro-batch that holds new rows; an empty one publishes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            cycle(batch, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


class OpenAlerts(StatefulProcessor):
    """Keeps, per facility, when its last alert was created; suppressed events do not extend it."""

    def __init__(self, hours: float) -> None:
        self.gap = pd.Timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "created timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("ts")
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        created = []
        for ts in events.ts:
            opens = last is None or ts - last >= self.gap
            created.append(opens)
            last = ts if opens else last
        self.last.update((last.to_pydatetime(),))
        yield pd.DataFrame({"facility_key": key[0], "ts": events.ts.to_numpy(), "created": created})

    def close(self) -> None:
        pass


def deduped(stream: DataFrame, hours: float = 6.0) -> DataFrame:
    """facility_key, ts and created. Needs the RocksDB state store."""
    return stream.groupBy("facility_key").transformWithStateInPandas(OpenAlerts(hours), "facility_key string, ts timestamp, created boolean", "Append", "None")


def _spans(det: DataFrame, start: str, end: str, step_minutes: int, latency_hours: int, window_days: int) -> DataFrame:
    """det with the numbers _lo and _hi of its first and last tick, computed, not searched for; without ticks it is left out."""
    d = det.withColumns({"acq": F.col("acq").cast("timestamp")}).withColumn("available_at", F.col("acq") + F.expr(f"INTERVAL {latency_hours} HOURS"))
    first = F.greatest(F.col("available_at"), F.lit(start).cast("timestamp"))
    last = F.least(F.col("acq") + F.expr(f"INTERVAL {window_days} DAYS"), F.lit(end).cast("timestamp"))
    step = step_minutes * 60_000_000
    origin = F.unix_micros(F.lit(start).cast("timestamp"))
    lo, hi = F.ceil((F.unix_micros(first) - origin) / step), F.floor((F.unix_micros(last) - origin) / step)
    return d.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")


def _tick(start: str, step_minutes: int) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("_k") * step_minutes * 60_000_000)


def replay_ticks(det: DataFrame, start: str, end: str, step_minutes: int = 60, latency_hours: int = 3, window_days: int = 14) -> DataFrame:
    """tick and detection pairs of a virtual clock: a detection shows latency_hours after it was made, for window_days."""
    shown = _spans(det, start, end, step_minutes, latency_hours, window_days)
    return shown.withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("tick", _tick(start, step_minutes)).drop("_lo", "_hi", "_k")


def tick_counts(det: DataFrame, start: str, end: str, step_minutes: int = 60, latency_hours: int = 3, window_days: int = 14) -> DataFrame:
    """Per tick of replay_ticks the detections that show, and those whose id shows for the first time. Spans are counted
    where they begin and behind their end, so no detection is repeated for its ticks; the running sum has a row a tick."""
    spans = _spans(det, start, end, step_minutes, latency_hours, window_days).filter("detection_id is not null").select("detection_id", "_lo", "_hi")
    by_id = spans.groupBy("detection_id", "_lo").agg(F.count("*").alias("n")).groupBy("detection_id").agg(F.min(F.struct("_lo", "n")).alias("m"))
    fresh = by_id.groupBy(F.col("m._lo").alias("_k")).agg(F.lit(0).cast("long").alias("d"), F.sum("m.n").alias("new"))
    zero = F.lit(0).cast("long").alias("new")
    opened = spans.groupBy(F.col("_lo").alias("_k")).agg(F.count("*").alias("d"), zero)
    closed = spans.groupBy((F.col("_hi") + 1).alias("_k")).agg((-F.count("*")).alias("d"), zero)
    last = (F.unix_micros(F.lit(end).cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))) / (step_minutes * 60_000_000)
    every = det.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor(last), F.lit(0).cast("long")))).alias("_k"), F.lit(0).cast("long").alias("d"), zero)
    ticks = fresh.unionByName(opened).unionByName(closed).unionByName(every).groupBy("_k").agg(F.sum("d").alias("d"), F.sum("new").alias("new"))
    counts = ticks.withColumn("visible", F.sum("d").over(W.orderBy("_k").rowsBetween(W.unboundedPreceding, 0))).filter("visible > 0")
    return counts.select(_tick(start, step_minutes).alias("tick"), "visible", "new")


def verdict(log: DataFrame, alerts: DataFrame, classes: list[str]) -> DataFrame:
    """The class shown at the first alert, else at the end, and whether it was expected. log: clock and class."""
    first = alerts.agg(F.min("at").alias("_at"))
    j = log.join(F.broadcast(first))
    seen = F.max_by("class", F.when(F.col("_at").isNull() | (F.col("clock") <= F.col("_at")), F.col("clock")))
    shown = j.agg(F.coalesce(seen, F.min_by("class", "clock")).alias("class_shown"), F.first("_at").alias("first_alert"))
    return shown.withColumns({"class_ok": F.col("class_shown").isin(*classes), "alerted": F.col("first_alert").isNotNull()})


def change_feed(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the committed versions of a published table: what is written but not committed is never announced."""
    return spark.readStream.schema("version string, n long, at timestamp").json(f"{root}/commits")
