"""Detections: identity, physical de-duplication, history and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def instrument_parts(df: DataFrame) -> DataFrame:
    """Adds satellite, product and the UTC day."""
    parts = F.split("instrument", "_")
    return df.withColumns({"satellite": F.get(parts, F.lit(1)), "product": F.get(parts, F.lit(2)), "day": F.to_date("acq")})


def physical(det: DataFrame) -> DataFrame:
    """One row per observation (satellite, time, place to 4 decimals): low confidence dropped, SP before NRT."""
    d = instrument_parts(det.filter("confidence <> 'low'"))
    same = W.partitionBy("satellite", "acq", F.round("lat", 4), F.round("lon", 4)).orderBy((F.col("product") == "SP").desc(), "detection_id")
    return d.withColumn("_rn", F.row_number().over(same)).filter("_rn = 1").drop("_rn")


def merge_history(history: DataFrame, fresh: DataFrame, keep_days: int, ts: str = "acq") -> DataFrame:
    """Latest version of each id; rows older than keep_days before the newest are dropped."""
    both = history.withColumn("_batch", F.lit(0)).unionByName(fresh.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    last = W.partitionBy("detection_id").orderBy(F.desc("_batch"), F.desc(ts))
    kept = both.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn", "_batch")
    newest = kept.agg(F.max(ts).alias("_newest"))
    return kept.join(F.broadcast(newest), F.col(ts) >= F.col("_newest") - F.expr(f"INTERVAL {keep_days} DAYS")).drop("_newest")


def unseen(fresh: DataFrame, history: DataFrame) -> DataFrame:
    return fresh.join(history.select("detection_id"), "detection_id", "left_anti")


def dense_windows(det: DataFrame, first_day: str, days: int = 7) -> DataFrame:
    """Adds window, the number of the days-long window since first_day, and the month of its middle day."""
    number = F.floor(F.datediff(F.to_date("acq"), F.lit(first_day).cast("date")) / days).cast("int")
    start = F.date_add(F.lit(first_day).cast("date"), number * days)
    return det.withColumns({"window": number, "window_start": start, "window_month": F.month(F.date_add(start, 3))})


def weekly_units(det: DataFrame, cell: str, first_day: str) -> DataFrame:
    d = dense_windows(physical(det), first_day).filter("window >= 0")
    return d.groupBy(cell, "window").agg(
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.count("*").alias("n_detections"),
        F.countDistinct("day").alias("n_days"),
        F.max("frp").alias("frp_max"),
        F.avg((F.col("daynight") == "N").cast("double")).alias("night_fraction"),
        F.max("window_month").alias("window_month"),
    )


def coverage_gaps(det: DataFrame) -> DataFrame:
    """Calendar days between the first and the last detection without any."""
    days = det.select(F.to_date("acq").alias("day")).distinct()
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).join(days, "day", "left_anti")


def coverage_by_product(det: DataFrame) -> DataFrame:
    d = instrument_parts(det)
    return d.groupBy("satellite", "product").agg(F.min("acq").alias("first"), F.max("acq").alias("last"), F.count("*").alias("detections"))


def pick_product(days: DataFrame, available: DataFrame) -> DataFrame:
    """day, product: the SP product covering the day before the NRT one."""
    hit = days.join(available, F.col("day").between(F.col("min_day"), F.col("max_day")))
    return hit.groupBy("day", "family").agg(F.max_by("product", F.struct(F.col("product").endswith("_SP"), F.col("product"))).alias("product"))


def night(col: str = "daynight") -> Column:
    return (F.col(col) == "N").cast("double")
