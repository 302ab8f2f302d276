"""Clusters of detections, their summary, and the weighted-evidence classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import geo, ids
from emberline.operators import graph, spatial

CLUSTER_M = 1000.0


def cluster(det: DataFrame, reach_m: float = CLUSTER_M, key: str = "detection_id") -> DataFrame:
    """det with cluster: the smallest id of the component of detections at most reach_m apart."""
    return graph.with_components(det, spatial.self_edges(det.select(key, "lat", "lon"), key, reach_m), key, "cluster")


def summarise(det: DataFrame, window_days: int, now: str | None = None) -> DataFrame:
    """One row per cluster."""
    end = det.agg((F.lit(now).cast("timestamp") if now else F.max("acq")).alias("_now"))
    last = det.groupBy("cluster").agg(F.max("acq").alias("_last"))
    d = det.join(last, "cluster").withColumn("_w", F.greatest("frp", F.lit(0.1)))
    recent = F.col("acq") >= F.col("_last") - F.expr("INTERVAL 24 HOURS")
    out = d.groupBy("cluster").agg(
        (F.sum(F.col("lat") * F.col("_w")) / F.sum("_w")).alias("c_lat"), (F.sum(F.col("lon") * F.col("_w")) / F.sum("_w")).alias("c_lon"),
        F.count("*").alias("n_detections"), F.countDistinct(F.to_date("acq")).alias("n_days"), F.min("acq").alias("first_seen"), F.max("acq").alias("last_seen"),
        F.avg("frp").alias("frp_mean"), F.max("frp").alias("frp_max"), F.sum("frp").alias("frp_total"), F.max(F.when(recent, F.col("frp"))).alias("frp_recent_max"),
        F.avg((F.col("daynight") == "N").cast("double")).alias("night_fraction"), geo.extent_m("lat", "lon").alias("extent_m"),
        *([F.avg("bright_ti4").alias("ti4_mean")] if "bright_ti4" in det.columns else []),
        F.avg((F.col("confidence") == "high").cast("double")).alias("high_conf_fraction"), F.concat_ws(",", F.array_sort(F.collect_set("instrument"))).alias("instruments"),
    )
    hours = (F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 3.6e9
    return out.join(F.broadcast(end)).withColumns({"hours_since_last": hours, "window_days": F.lit(window_days)}).drop("_now").withColumnsRenamed({"c_lat": "lat", "c_lon": "lon"})


def unit_features(det: DataFrame, unit: str) -> DataFrame:
    """Per-unit features of the learned model: as summarise, with quantile and brightness columns."""
    d = det.withColumns({"_w": F.greatest("frp", F.lit(0.1)), "_day": F.to_date("acq"), "_sat": F.get(F.split("instrument", "_"), F.lit(1))})
    optional = [f(c).alias(a) for c, f, a in (("bright_ti4", F.avg, "ti4_mean"), ("bright_ti4", F.max, "ti4_max"), ("scan", F.avg, "scan_mean"), ("track", F.avg, "track_mean")) if c in det.columns]
    return d.groupBy(unit).agg(
        (F.sum(F.col("lat") * F.col("_w")) / F.sum("_w")).alias("c_lat"), (F.sum(F.col("lon") * F.col("_w")) / F.sum("_w")).alias("c_lon"), F.count("*").alias("n_detections"),
        F.countDistinct("_day").alias("n_days"), F.max("frp").alias("frp_max"), F.avg("frp").alias("frp_mean"), F.sum("frp").alias("frp_total"), F.percentile("frp", F.lit(0.9)).alias("frp_p90"),
        F.avg((F.col("daynight") == "N").cast("double")).alias("night_fraction"), *optional, geo.extent_m("lat", "lon", 110_540.0).alias("extent_m"),
        F.avg((F.col("confidence") == "high").cast("double")).alias("high_conf_fraction"), F.countDistinct("_sat").alias("n_satellites"), F.min("_day").alias("first_day"), F.max("_day").alias("last_day"),
    ).withColumnsRenamed({"c_lat": "lat", "c_lon": "lon"})


def with_stable_ids(sources: DataFrame, order: str = "cluster") -> DataFrame:
    """source_id from the centre; the n-th source of one id, in the given order, gets the suffix x<n>."""
    from pyspark.sql import Window as W

    s = sources.withColumn("_base", ids.source_base_id(F.col("lat"), F.col("lon")))
    n = F.row_number().over(W.partitionBy("_base").orderBy(order))
    return s.withColumn("_n", n).withColumn("source_id", F.when(F.col("_n") > 1, F.concat("_base", F.lit("x"), F.col("_n").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_n")


# Classes in tie order, display labels, evidence weights, season months, facility kinds with the prior
# of a continuous signature and the matching radius in metres.
CLASSES = ["industrial_persistent", "industrial_fire_candidate", "agricultural_burning", "vegetation_fire", "unmapped_persistent", "other"]
LABELS = {
    "industrial_persistent": "Persistent industrial thermal source",
    "industrial_fire_candidate": "Possible industrial fire / abnormal event",
    "agricultural_burning": "Agricultural (crop residue) burning",
    "vegetation_fire": "Forest / vegetation fire",
    "unmapped_persistent": "Persistent source, no mapped facility",
    "other": "Other / unclassified",
}
WEIGHTS = {
    "industrial_persistent": {"near_site": 2.2, "persistent": 1.4, "very_persistent": 0.6, "site_continuous": 1.0, "point_like": 0.5, "night_present": 0.5, "far_from_site": -3.0, "brief": -1.0},
    "industrial_fire_candidate": {"near_site": 2.2, "brief": 1.2, "frp_high": 0.9, "recent": 0.5, "site_episodic": 0.6, "persistent": -1.4, "far_from_site": -3.0},
    "agricultural_burning": {"lc_crop": 2.2, "agri_season_crop": 1.0, "crop_brief": 0.6, "crop_frp_small": 0.5, "persistent": -0.8, "near_site": -2.5, "night_present": -0.8},
    "vegetation_fire": {"lc_vegetation": 2.2, "veg_frp_mid": 0.5, "veg_big_extent": 0.4, "near_site": -2.5, "persistent": -0.6, "night_present": -0.5},
    "unmapped_persistent": {"unmapped_persistent": 1.8, "unmapped_very_persistent": 0.6, "unmapped_point_like": 0.8, "unmapped_night": 0.4, "unmapped_bare_built": 0.8},
    "other": {"bias": 0.6, "lc_unknown": 0.5},
}
AGRI_MONTHS = [4, 5, 10, 11]
KINDS = {
    "refinery_petrochem": (0.95, 1500.0),
    "gas_flare": (1.00, 400.0),
    "steel_metal": (0.90, 1500.0),
    "power_thermal": (0.85, 1500.0),
    "cement": (0.80, 1200.0),
    "chemical_fertilizer": (0.70, 1200.0),
    "brick_kiln": (0.60, 400.0),
    "mining_quarry": (0.45, 1800.0),
    "landfill": (0.35, 1000.0),
    "factory_generic": (0.30, 800.0),
}
#: Evidence texts. Numbers in braces are columns, formatted as given.
EVIDENCE = {
    "near_site": ("lies on a mapped %s (%s)", ("kind", "site")),
    "persistent": ("detected on %d of the last %d days", ("n_days", "window_days")),
    "very_persistent": ("detected on %d separate days (very persistent)", ("n_days",)),
    "site_continuous": ("this facility type commonly emits a continuous thermal signature", ()),
    "site_episodic": ("this facility type is usually not thermally active, so a detection is notable", ()),
    "point_like": ("compact hotspot (%.0f m across), typical of a point source", ("extent_m",)),
    "night_present": ("%.0f%% of detections at night (not solar/crop-field typical)", ("night_pct",)),
    "brief": ("short-lived: only %d day(s) of detections", ("n_days",)),
    "crop_brief": ("short-lived: only %d day(s) of detections, typical of field burning", ("n_days",)),
    "crop_frp_small": ("low radiative power (max %.0f MW), typical of small field fires", ("frp_max",)),
    "veg_frp_mid": ("moderate/high radiative power (max %.0f MW)", ("frp_max",)),
    "veg_big_extent": ("spread over %.0f m (area fire)", ("extent_m",)),
    "frp_high": ("high radiative power (max %.0f MW)", ("frp_max",)),
    "recent": ("active within the last 24 h", ()),
    "lc_crop": ("%.0f%% cropland around the source (ESA WorldCover)", ("crop_pct",)),
    "agri_season_crop": ("within the residue-burning season", ()),
    "lc_vegetation": ("%.0f%% natural vegetation around the source (ESA WorldCover)", ("veg_pct",)),
    "unmapped_persistent": ("persistent for %d days but no mapped industrial facility within range", ("n_days",)),
    "unmapped_very_persistent": ("very persistent without any mapped facility", ()),
    "unmapped_point_like": ("compact point-source footprint with no mapped facility", ()),
    "unmapped_night": ("night-time activity without a mapped facility", ()),
    "unmapped_bare_built": ("bare/built-up surroundings (possible unmapped industry, kiln or landfill)", ()),
    "lc_unknown": ("land cover unavailable", ()),
    "bias": ("no strong evidence for any specific cause", ()),
}


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _value(name: str) -> Column:
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))


def feature_columns(month: Column) -> dict[str, Column]:
    """Evidence in [0, 1] from the columns of a matched source."""
    near = _flag(F.coalesce(F.col("site_within"), F.lit(False)))
    far, prior = 1 - near, _value("site_continuous")
    days, frp, extent = F.col("n_days"), F.col("frp_max"), F.col("extent_m")
    persistent, very, point = _flag(days >= 3), _flag(days >= 5), _flag(extent <= 1500)
    night, crop, veg = _flag(F.col("night_fraction") >= 0.25), _value("lc_crop"), _value("lc_vegetation")
    brief, small, mid, wide = _flag(days <= 2), _flag(frp < 10), _flag(frp >= 15), _flag(extent > 3000)
    return {
        "near_site": near, "far_from_site": far, "persistent": persistent, "very_persistent": very, "brief": brief, "site_continuous": prior * near, "site_episodic": near * (1 - prior),
        "point_like": point, "night_present": night, "frp_high": _flag(frp >= 40), "recent": _flag(F.col("hours_since_last") <= 24), "lc_crop": crop, "lc_vegetation": veg,
        "crop_brief": crop * brief, "crop_frp_small": crop * small, "veg_frp_mid": veg * mid, "veg_big_extent": veg * wide, "agri_season_crop": _flag(month.isin(AGRI_MONTHS)) * crop,
        "lc_unknown": _flag(F.col("lc_dominant").isNull()), "unmapped_persistent": far * persistent, "unmapped_very_persistent": far * very, "unmapped_point_like": far * persistent * point,
        "unmapped_night": far * persistent * night, "unmapped_bare_built": far * persistent * F.least(_value("lc_bare") + _value("lc_built"), F.lit(1.0)), "bias": F.lit(1.0),
    }


def classify(sources: DataFrame, month: Column) -> DataFrame:
    """Adds class_scores, thermal_class, thermal_label, class_margin, class_confidence, reasons and the alert flag."""
    f = feature_columns(month)
    s = sources.withColumn("_f", F.struct(*[c.alias(n) for n, c in f.items()]))
    s = s.withColumn("_logits", F.array(*[sum((w * F.col(f"_f.{n}") for n, w in WEIGHTS[c].items()), F.lit(0.0)) for c in CLASSES]))
    s = s.withColumn("_e", F.transform("_logits", lambda x: F.exp(x - F.array_max("_logits"))))
    s = s.withColumn("_p", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
    ranked = F.array_sort(F.transform("_p", lambda p, i: F.struct((-p).alias("n"), i.alias("i"))))
    s = s.withColumn("_ranked", ranked)
    names, labels = F.array(*map(F.lit, CLASSES)), F.array(*[F.lit(LABELS[c]) for c in CLASSES])
    first, second = F.col("_ranked")[0], F.col("_ranked")[1]
    margin = second["n"] - first["n"]
    s = s.withColumns({
        "class_scores": F.map_from_arrays(names, F.col("_p")), "thermal_class": F.get(names, first["i"]), "thermal_label": F.get(labels, first["i"]), "class_margin": margin,
        "class_confidence": F.when(margin >= 0.45, "high").when(margin >= 0.2, "medium").otherwise("low"),
    })
    context = {
        "kind": F.replace(F.coalesce("site_kind", F.lit("facility")), F.lit("_"), F.lit(" ")), "site": F.coalesce(F.col("site_name").cast("string"), F.col("site_ref").cast("string"), F.lit("None")),
        "n_days": F.col("n_days"), "window_days": F.col("window_days"), "extent_m": F.col("extent_m"), "night_pct": 100 * F.col("night_fraction"), "frp_max": F.col("frp_max"),
        "crop_pct": 100 * _value("lc_crop"), "veg_pct": 100 * _value("lc_vegetation"),
    }
    kind = "array<struct<n:double,i:int,t:string>>"

    def evidence(c: str) -> Column:
        terms = [F.struct((-w * F.col(f"_f.{n}")).alias("n"), F.lit(i).alias("i"), F.format_string(EVIDENCE[n][0], *[context[a] for a in EVIDENCE[n][1]]).alias("t")) for i, (n, w) in enumerate(WEIGHTS[c].items()) if w > 0]
        return F.array_sort(F.filter(F.array(*terms).cast(kind), lambda x: x["n"] < -0.25))

    chosen = F.lit(None).cast(kind)
    for c in reversed(CLASSES):
        chosen = F.when(F.col("thermal_class") == c, evidence(c)).otherwise(chosen)
    runner = F.when(-second["n"] >= 0.2, F.array(F.format_string("second most likely: %s (%.0f%% of evidence)", F.lower(F.get(labels, second["i"])), -100 * second["n"]))).otherwise(F.array().cast("array<string>"))
    s = s.withColumn("reasons", F.concat(F.transform(chosen, lambda x: x["t"]), runner))
    fire = (F.col("thermal_class") == "industrial_fire_candidate") & (F.col("hours_since_last") <= 24) & (F.col("frp_max") >= 8)
    surge = (F.col("thermal_class") == "industrial_persistent") & (F.col("n_days") >= 4) & (F.col("frp_recent_max") >= 3 * F.greatest("frp_mean", F.lit(1.0))) & (F.col("frp_recent_max") >= 30)
    level = F.when(fire, F.when(F.col("frp_max") >= 100, "critical").when(F.col("frp_max") >= 40, "high").otherwise("watch")).when(surge, "high")
    text = F.when(fire, "new/short-lived thermal anomaly at an industrial facility - verify with imagery").when(surge, "intensity well above this source's own recent baseline - possible incident or flaring event")
    return s.withColumns({"alert_level": level, "alert_text": text}).drop("_f", "_logits", "_e", "_p", "_ranked")
