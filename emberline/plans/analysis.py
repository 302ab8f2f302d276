"""The composite pipelines: one lazy plan from detections to classified, compared and explained sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import staging
from emberline.functions import geo
from emberline.operators import baseline, heat_sources, learning, spatial


def assign(det: DataFrame, facilities: DataFrame) -> DataFrame:
    match = spatial.match_facilities(det, facilities, "detection_id").select("detection_id", F.col("ref").alias("facility_id"))
    return det.join(match, "detection_id", "left").withColumn("cell_key", geo.cell_key("lat", "lon"))


def with_facility(sources: DataFrame, facilities: DataFrame) -> DataFrame:
    """The facility with the widest margin, or for context the nearest one without a prior."""
    f = facilities.select(F.col("ref").alias("_ref"), F.col("name").alias("site_name"), F.col("kind").alias("site_kind"))
    inside = spatial.match_facilities(sources, facilities, "cluster").withColumn("site_within", F.lit(True))
    rest = sources.join(inside.select("cluster"), "cluster", "left_anti")
    near = spatial.nearest_facility(rest, facilities, "cluster").withColumn("site_within", F.lit(False))
    m = inside.unionByName(near).join(f, F.col("ref") == F.col("_ref"), "left").drop("_ref")
    prior = F.create_map(*[F.lit(x) for k, (p, _) in heat_sources.KINDS.items() for x in (k, p)])
    out = sources.join(m, "cluster", "left").withColumnsRenamed({"ref": "site_ref", "distance_m": "site_distance_m"})
    return out.withColumn("site_continuous", F.when(F.col("site_within"), F.try_element_at(prior, F.col("site_kind"))).otherwise(0.0))


def analyse(det: DataFrame, facilities: DataFrame, areas: DataFrame, month: Column, window_days: int = 14, cover: DataFrame | None = None, profile: DataFrame | None = None, model: learning.Model | None = None, region: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sources and detections. Rules classify before the baseline is attached, so they never read it. Land cover,
    baseline and model are optional; without them their columns are null."""
    d = det if region is None else spatial.first_area(det, region, "detection_id").filter("area_id is not null").drop("area_id", "area_name")
    d = heat_sources.cluster(d)
    s = with_facility(staging.persisted(heat_sources.summarise(d, window_days), "sources"), facilities)
    if cover is not None:
        s = s.join(cover, "cluster", "left")
    for c, k in (("lc_crop", "double"), ("lc_vegetation", "double"), ("lc_bare", "double"), ("lc_built", "double"), ("lc_dominant", "string")):
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast(k))
    s = staging.persisted(heat_sources.classify(s, month), "classified")
    s = spatial.first_area(s, areas, "cluster").withColumnRenamed("area_name", "state").drop("area_id")
    s = heat_sources.with_stable_ids(s)
    if profile is not None:
        assigned = staging.persisted(assign(d, facilities), "assigned")  # read for the latest day and the modal cell
        s = baseline.attach(s.withColumn("cell_key", geo.cell_key("lat", "lon")), assigned, profile)
    s = learning.score(model, s)
    named = s.select("cluster", "source_id", "thermal_class")
    return s, d.join(named, "cluster", "left")


def run_summary(sources: DataFrame, det: DataFrame) -> DataFrame:
    """One row: totals, time span, alerts and the modal month (the smallest of equals)."""
    months = det.groupBy(F.month("acq").alias("m")).count()
    month = months.agg(F.min(F.struct((-F.col("count")).alias("n"), "m"))["m"].alias("month"))
    d = det.agg(F.count("*").alias("detections"), F.min("acq").alias("first"), F.max("acq").alias("last"))
    s = sources.agg(F.count("*").alias("sources"), F.count_if(F.col("alert_level").isNotNull()).alias("alerts"), F.countDistinct("thermal_class").alias("classes"))
    return s.join(d).join(month)
