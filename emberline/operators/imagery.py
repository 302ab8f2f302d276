"""Burn indices on arrays of reflectances, scene choice, and evidence lines. No Python in the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Thresholds of the indices and severity bands.
MIN_SUM, HOT_B12, HOT_RATIO, BURNED = 0.05, 0.5, 1.3, 0.1
CLOUD_CODES, LAND_CODES = [8, 9, 10, 11], [4, 5]
BANDS = [(0.1, "unburned / no change"), (0.27, "low severity"), (0.44, "moderate-low severity"), (0.66, "moderate-high severity")]


def reflectance(dn: Column, scale: float, offset: float) -> Column:
    """Digital numbers to reflectance; 0 is no data."""
    return F.transform(dn, lambda v: F.when(v != 0, v * scale + offset))


def nbr(nir: Column, swir: Column) -> Column:
    """Normalised burn ratio per pixel, null where the bands are too dark or missing."""

    def one(a: Column, b: Column) -> Column:
        ok = (a + b >= MIN_SUM) & (a >= 0) & (b >= 0)
        return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a.cast("double") - b.cast("double")) / (a.cast("double") + b.cast("double")))))

    return F.zip_with(nir, swir, one)


def severity(dnbr: Column) -> Column:
    out = F.lit("high severity")
    for limit, name in reversed(BANDS):
        out = F.when(dnbr < limit, name).otherwise(out)
    return F.when(dnbr.isNotNull(), out)


def hot_pixels(swir22: Column, swir16: Column) -> Column:
    """Number of pixels that glow in the longer short-wave band."""
    return F.size(F.filter(F.zip_with(swir22, swir16, lambda b12, b11: (b12 >= HOT_B12) & (b12 > HOT_RATIO * b11)), lambda v: F.coalesce(v, F.lit(False))))


def _percentile(values: Column, p: float) -> Column:
    """Linear percentile of an array without nulls."""
    s = F.array_sort(values)
    at = (F.size(s) - 1) * F.lit(p)
    lo = F.floor(at).cast("int")
    a, b = F.get(s, lo), F.get(s, F.ceil(at).cast("int"))
    return F.when(F.size(s) > 0, a + (b - a) * (at - lo))


def dnbr_summary(chips: DataFrame, min_valid: float = 0.25, min_pixels: int = 200) -> DataFrame:
    """chips: key columns and arrays nir_before, swir_before, nir_after, swir_after. Adds median ratios, mean and 95th
    percentile of the drop, shares of burned and valid pixels, and severity; null where too little is valid."""
    d = chips.withColumns({"_pre": nbr(F.col("nir_before"), F.col("swir_before")), "_post": nbr(F.col("nir_after"), F.col("swir_after"))})
    both = F.filter(F.arrays_zip("_pre", "_post"), lambda x: x["_pre"].isNotNull() & x["_post"].isNotNull())
    d = d.withColumn("_both", both).withColumn("_d", F.transform("_both", lambda x: x["_pre"] - x["_post"]))
    n = F.size("_d")
    share = n / F.greatest(F.size("_pre"), F.lit(1))
    enough = (share >= min_valid) & (n >= min_pixels)
    p95 = _percentile(F.col("_d"), 0.95)
    part = lambda side: _percentile(F.transform("_both", lambda x: x[side]), 0.5)
    values = {
        "nbr_before": part("_pre"), "nbr_after": part("_post"), "dnbr_mean": F.aggregate("_d", F.lit(0.0), lambda s, v: s + v) / n, "dnbr_p95": p95,
        "burned_fraction": F.size(F.filter("_d", lambda v: v > BURNED)) / n, "severity": severity(p95),
    }
    return d.withColumns({k: F.when(enough, v) for k, v in values.items()} | {"valid_fraction": share}).drop("_pre", "_post", "_both", "_d")


def after_scenes(scenes: DataFrame, centre: str, window_days: int = 5, max_cloud: float = 30.0, first_seen: str | None = None) -> DataFrame:
    """Usable scenes around a time with their rank: clearest, then closest; none before the first detection less 12 h."""
    offset = (F.unix_timestamp("acquired") - F.unix_timestamp(F.lit(centre).cast("timestamp"))) / 86400
    d = scenes.withColumn("offset_days", offset).filter((F.col("cloud") < max_cloud) & (F.abs("offset_days") <= window_days + 1))
    if first_seen:
        d = d.filter(F.col("acquired") >= F.lit(first_seen).cast("timestamp") - F.expr("INTERVAL 12 HOURS"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("place").orderBy(F.round("cloud", 1), F.abs("offset_days"), "scene_id")))


def before_scenes(scenes: DataFrame, after: DataFrame, min_days: int = 2, max_days: int = 40, max_cloud: float = 30.0) -> DataFrame:
    """The reference scene of each chosen one: same tile and orbit, then same tile, then any; clearest, then closest."""
    a = after.select("place", F.col("scene_id").alias("after_id"), F.col("acquired").alias("_t"), F.col("tile").alias("_tile"), F.col("orbit").alias("_orbit"))
    j = scenes.filter(F.col("cloud") < max_cloud).join(a, "place").withColumn("gap_days", (F.unix_timestamp("_t") - F.unix_timestamp("acquired")) / 86400)
    j = j.filter(F.col("gap_days").between(min_days, max_days) & (F.col("scene_id") != F.col("after_id")))
    same = F.when((F.col("tile") == F.col("_tile")) & (F.col("orbit") == F.col("_orbit")), 0).when(F.col("tile") == F.col("_tile"), 1).otherwise(2)
    rank = F.row_number().over(W.partitionBy("after_id").orderBy(same, F.round("cloud", 1), "gap_days", "scene_id"))
    return j.withColumn("_rank", rank).filter("_rank = 1").select("place", "after_id", "scene_id", "gap_days")


def evidence(df: DataFrame) -> DataFrame:
    """Adds imagery_lines from dnbr_p95, burned_fraction, severity and hot_count."""
    burn = F.when(F.col("dnbr_p95") >= 0.1, F.format_string("burn ratio fell by %.2f (%s), %.0f%% of the chip", "dnbr_p95", "severity", 100 * F.col("burned_fraction")))
    hot = F.when(F.col("hot_count") > 0, F.format_string("%d hot short-wave pixels", "hot_count"))
    calm = F.when(F.col("dnbr_p95") < 0.1, F.lit("no burn signal between the two scenes"))
    return df.withColumn("imagery_lines", F.array_compact(F.array(burn, hot, calm)))


def candidates(sources: DataFrame, limit: int, priority: list[str] = ()) -> DataFrame:
    """Sources to look at, asked-for ones first, then by alert level and power: a per-cycle budget."""
    rank = F.when(F.col("alert_level") == "critical", 0).when(F.col("alert_level") == "high", 1).when(F.col("alert_level") == "watch", 2).otherwise(3)
    fits = F.col("source_id").isin(*priority) | F.col("alert_level").isNotNull() | (F.col("thermal_class") == "industrial_fire_candidate")
    return sources.filter(fits).orderBy((~F.col("source_id").isin(*priority)).cast("int"), rank, F.desc("frp_max"), "source_id").limit(limit)
