"""Rule labels of cell-week units, their splits, and incident windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.functions import geo

# Thresholds, regions and months of the label rules.
PERSISTENT_M, PERSISTENT_ACTIVE, NO_FACILITY_M, EPISODIC = 1000.0, 0.20, 3000.0, 0.05
CROP, WOODY, WEST_LON, AGRI_MONTHS = 0.70, 0.70, 79.5, [10, 11, 4, 5]
LABELS = ["industrial_persistent", "agricultural_burning", "vegetation_fire"]
_MARKED, _PLAIN = "āĀēĒīĪōŌūŪṭṬḍḌṇṆṛṚḷḶṣṢśŚṃṂñÑ", "aAeEiIoOuUtTdDnNrRlLsSsSmMnN"


def in_agri_region(state: str = "state", lon: str = "lon"):
    s = F.lower(F.translate(F.coalesce(F.col(state), F.lit("")), _MARKED, _PLAIN))
    return s.rlike("punjab|haryana") | (s.contains("uttar pradesh") & (F.col(lon) <= WEST_LON))


def apply_rules(units: DataFrame) -> DataFrame:
    """Adds one boolean per class; null inputs make a rule false."""
    far, calm = F.col("distance_to_any_facility_m") > NO_FACILITY_M, F.col("cell_baseline_active_fraction") < EPISODIC
    yes = lambda c: F.coalesce(c, F.lit(False))
    return units.withColumns({
        "is_industrial_persistent": yes((F.col("distance_to_authoritative_facility_m") <= PERSISTENT_M) & (F.col("facility_baseline_active_fraction") >= PERSISTENT_ACTIVE)),
        "is_agricultural_burning": yes((F.col("lc_crop") >= CROP) & in_agri_region() & F.col("window_month").isin(AGRI_MONTHS) & far & calm),
        "is_vegetation_fire": yes((F.col("lc_woody") >= WOODY) & far & calm),
    })


def unambiguous(units: DataFrame) -> DataFrame:
    """Units with exactly one rule, with its name as label."""
    flags = sum((F.col(f"is_{c}").cast("int") for c in LABELS), F.lit(0))
    label = F.coalesce(*[F.when(F.col(f"is_{c}"), c) for c in LABELS])
    return units.filter(flags == 1).withColumn("label", label)


def split(units: DataFrame, held_out: list[str], test_from: str) -> DataFrame:
    """train: other regions before the date; test: held-out regions from it on; anything else is unused."""
    held, late = F.coalesce(F.col("state").isin(held_out), F.lit(False)), F.col("window_start") >= F.lit(test_from).cast("date")
    return units.withColumn("split", F.when(~held & ~late, "train").when(held & late, "test").otherwise("unused"))


def capped(units: DataFrame, keys: list[str], limit: int, seed: int, order: str) -> DataFrame:
    """At most limit units per group, in an order drawn by the seed: a sampling operator."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64(F.col(order), F.lit(seed)), order))
    return units.withColumn("_rn", rn).filter(F.col("_rn") <= limit).drop("_rn")


def held_out(support: list[dict], enough: int) -> list[str]:
    """Greedy choice of test regions from rows of region, label, before and after (at most some dozens).

    Adds the region that raises the smallest train or test support most, ties by sum and then by name.
    """
    regions, classes = sorted({r["region"] for r in support}), sorted({r["label"] for r in support})

    def value(held: set[str]) -> tuple[int, int]:
        least = [min(sum(r["before"] for r in support if r["label"] == c and r["region"] not in held), sum(r["after"] for r in support if r["label"] == c and r["region"] in held)) for c in classes]
        return min(least), sum(least)

    held: set[str] = set()
    best = (-1, -1)
    while rest := [r for r in regions if r not in held]:
        top = max(rest, key=lambda r: (value(held | {r}), -regions.index(r)))
        if value(held | {top}) <= best and best[0] >= 0:
            break
        held.add(top)
        best = value(held)
        if best[0] >= enough:
            break
    return sorted(held)


def incident_windows(incidents: DataFrame, det: DataFrame) -> DataFrame:
    """Per incident (incident_id, event_date, lat, lon, radius_km up to 100): event and baseline statistics and a status.

    Incidents are listed under each day of their window and the degree cells around them: an equi join on day and cell.
    """
    reach = (F.col("radius_km") + 0.5) * 1000
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    i = incidents.select("incident_id", "event_date", F.col("lat").alias("i_lat"), F.col("lon").alias("i_lon"), "radius_km")
    listed = i.withColumn("day", F.explode(F.sequence(F.date_sub("event_date", 60), F.date_add("event_date", 2)))).withColumn("_s", around)
    listed = listed.withColumns({"_cy": F.floor("i_lat") + F.col("_s.y"), "_cx": F.floor("i_lon") + F.col("_s.x")}).drop("_s")
    d = det.withColumns({"day": F.to_date("acq"), "_cy": F.floor("lat"), "_cx": F.floor("lon")})
    near = d.join(listed, ["day", "_cy", "_cx"]).filter(geo.haversine_m("lat", "lon", "i_lat", "i_lon") <= reach)
    event, base = F.col("day") >= F.date_sub("event_date", 1), F.col("day") <= F.date_sub("event_date", 8)
    g = near.groupBy("incident_id").agg(
        F.count_if(event).alias("event_detections"), F.max(F.when(event, F.col("frp"))).alias("event_max_frp"), F.min(F.when(event, geo.haversine_m("lat", "lon", "i_lat", "i_lon") / 1000)).alias("event_nearest_km"),
        (F.countDistinct(F.when(base, F.col("day"))) / 53).alias("baseline_active_fraction"), F.percentile(F.when(base, F.col("frp")), F.lit(0.5)).alias("baseline_median_frp"),
    )
    out = incidents.join(g, "incident_id", "left").fillna({"event_detections": 0, "event_max_frp": 0.0, "baseline_active_fraction": 0.0, "baseline_median_frp": 0.0})
    routine = F.col("baseline_active_fraction") >= 0.30
    above = F.col("event_max_frp") >= F.greatest(3 * F.col("baseline_median_frp"), F.lit(20.0))
    status = F.when(F.col("event_detections") == 0, "no_detection").when(routine & above, "matched_above_routine").when(routine, "routine_source").otherwise("matched_anomalous")
    return out.withColumn("status", status)


def located(geocoded: DataFrame, curated: DataFrame, rejected: DataFrame) -> DataFrame:
    """Locations by precedence: curated, then accepted geocodes, then none."""
    c = curated.select("incident_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), F.col("radius_km").alias("c_radius"), F.col("quality").alias("c_quality"))
    j = geocoded.join(c, "incident_id", "left").join(rejected.select("incident_id", F.lit(True).alias("_no")), "incident_id", "left")
    auto = F.col("_no").isNull() & F.col("location_quality").isin("industrial_area", "locality") & F.col("latitude").isNotNull()
    pick = lambda a, b: F.when(F.col("c_lat").isNotNull(), a).when(auto, b)
    basis = F.when(F.col("c_lat").isNotNull(), F.col("c_quality")).when(F.col("_no"), "unlocated").otherwise(F.col("location_quality"))
    return j.select("incident_id", pick(F.col("c_lat"), F.col("latitude")).alias("match_lat"), pick(F.col("c_lon"), F.col("longitude")).alias("match_lon"), pick(F.col("c_radius"), F.coalesce("uncertainty_km", F.lit(5.0))).alias("radius_km"), basis.alias("location_basis"))
