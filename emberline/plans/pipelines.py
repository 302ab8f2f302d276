"""Composite pipelines besides the live analysis: labels, master data, facility build and incident list."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.operators import baseline, dedupe, detections, facilities, labels, matching, snapshots, spatial
from emberline.plans import analysis


def build_labels(det: DataFrame, fac: DataFrame, cover: DataFrame, areas: DataFrame, first_window: str, held_out: Sequence[str], test_from: str, per_facility: int = 30) -> DataFrame:
    """Cell-week units with distances, baselines, land cover and region, exactly one rule each, split and capped.
    fac: facilities with authoritative; cover: cell_key, lc_crop, lc_woody."""
    d = analysis.assign(det, fac)
    units = detections.weekly_units(d, "cell_key", first_window).withColumn("unit", F.xxhash64("cell_key", "window"))
    near = lambda f, name: spatial.nearest_facility(units, f, "unit").select("unit", F.col("ref").alias(f"{name}_id"), F.col("distance_m").alias(f"distance_to_{name}_facility_m"))
    units = units.join(near(fac, "any"), "unit").join(near(fac.filter("authoritative"), "authoritative"), "unit", "left")
    profile = baseline.compute(d)
    share = lambda scope, key, name: profile.filter(F.col("scope") == scope).select(F.col("key").alias(key), F.col("active_fraction").alias(name))
    units = units.withColumn("_f", F.col("authoritative_id").cast("string")).join(share("facility", "_f", "facility_baseline_active_fraction"), "_f", "left").join(share("cell", "cell_key", "cell_baseline_active_fraction"), "cell_key", "left")
    units = units.fillna({"cell_baseline_active_fraction": 0.0}).join(cover, "cell_key", "left")
    units = spatial.first_area(units, areas, "unit").withColumnRenamed("area_name", "state")
    units = units.withColumn("window_start", F.date_add(F.lit(first_window).cast("date"), F.col("window") * 7))
    out = labels.split(labels.unambiguous(labels.apply_rules(units)), list(held_out), test_from)
    persistent = labels.capped(out.filter("label = 'industrial_persistent'"), ["authoritative_id"], per_facility, 20261015, "unit")
    return persistent.unionByName(out.filter("label <> 'industrial_persistent'")).drop("_f")


def build_facilities(frames: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All loaders' records to facilities and links. Columns that a loader lacks are null."""
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    for c, k in (("footprint", "string"), ("footprint_area", "double"), ("fuel", "string"), ("status", "string")):
        if c not in records.columns:
            records = records.withColumn(c, F.lit(None).cast(k))
    return facilities.merge(records.withColumn("footprint_area", F.coalesce("footprint_area", F.lit(0.0))))


def master_data(left: DataFrame, right: DataFrame, ledger: DataFrame, existing: DataFrame | None = None, weights: matching.Weights = matching.Weights()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Duplicates out, candidates blocked and scored, clusters to master rows with stable ids, merged over the existing
    table. left and right: id, name, industry, state, district, lat, lon, first_seen, last_seen; ids differ between them.
    Returns master rows, pairs and provenance links."""
    clean = lambda df: dedupe.near_duplicates(df, "id").filter("duplicate_of is null").drop("duplicate_of", "flagged")
    a, b = clean(left), clean(right)
    pairs = matching.scored(matching.combined([matching.block_radius(a, b, weights.max_distance_m)]), a, b, weights)
    keyed = a.unionByName(b, allowMissingColumns=True).withColumnRenamed("id", "key")
    clustered = matching.clusters(keyed, pairs)
    rows = matching.master_records(clustered).join(matching.match_fields(clustered, pairs), "cluster", "left").join(matching.site_ids(clustered, ledger), "cluster")
    links = clustered.join(rows.select("cluster", "site_id"), "cluster").select("site_id", F.col("key").alias("source_key"))
    out = rows.drop("cluster")
    return (out if existing is None else snapshots.temporal_merge(existing, out, ["site_id"], ("members",))), pairs, links


def incident_list(workbook: DataFrame, checks: DataFrame, geocoded: DataFrame, curated: DataFrame, rejected: DataFrame, det: DataFrame) -> DataFrame:
    """Incidents with the result of the text checks, a location by precedence, and what the satellites saw."""
    where = labels.located(geocoded, curated, rejected)
    seen = labels.incident_windows(workbook.join(where, "incident_id").filter("match_lat is not null").withColumnsRenamed({"match_lat": "lat", "match_lon": "lon"}), det)
    return workbook.join(checks, "incident_id", "left").join(where.select("incident_id", "location_basis"), "incident_id", "left").join(seen.select("incident_id", "status", "event_detections"), "incident_id", "left")


# ---- small derivations of the read side and of operations
def address(*parts: str) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]), F.lit(""))


def display_properties(df: DataFrame) -> DataFrame:
    """Arrays of sources and member ids without nulls, and defaults."""
    return df.withColumns({"data_sources": F.array_compact(F.array(F.when(F.col("n_osm") > 0, "osm"), F.when(F.col("n_government") > 0, "government"))), "status": F.coalesce("status", F.lit("unknown")), "record_count": F.coalesce("n_osm", F.lit(0)) + F.coalesce("n_government", F.lit(0))})


def site_detail(df: DataFrame, key: str, value) -> DataFrame:
    """One active site, or nothing."""
    return df.filter((F.col(key) == value) & F.col("is_active"))


def model_card(metrics: DataFrame, column: str = "metrics") -> DataFrame:
    """Headline numbers of a nested metrics text, with the operating point of a quarter false alarm a day."""
    m = F.from_json(column, "version string, macro_f1 double, accuracy double, ece double, operating_points array<struct<false_alarms_per_day:double,threshold:double,recall:double>>")
    point = F.get(F.filter(m["operating_points"], lambda p: p["false_alarms_per_day"] == 0.25), F.lit(0))
    return metrics.select(m["version"].alias("version"), m["macro_f1"].alias("macro_f1"), m["accuracy"].alias("accuracy"), m["ece"].alias("ece"), point["threshold"].alias("threshold"), point["recall"].alias("recall"))


def alert_line() -> Column:
    """Level, place and power of an alert in one line."""
    return F.concat_ws(" · ", F.upper("severity"), F.coalesce("site_name", F.lit("unmapped location")), F.format_string("%.0f MW", "frp_max"))


def rate_limited(calls: DataFrame, limit: int, key: str = "key", ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Adds refused: more than limit calls of a key within the seconds up to and including this one."""
    w = W.partitionBy(key).orderBy(F.unix_timestamp(F.col(ts).cast("timestamp"))).rangeBetween(-(seconds - 1), 0)
    return calls.withColumn("refused", F.count("*").over(w) > limit)


def areas_inside(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Child areas whose centroid lies in a parent area: parent_id and area_id."""
    from emberline.functions import geo

    c = child.withColumn("_c", geo.ring_centroid(F.col("rings")[0])).select(F.col("area_id").alias("child_id"), F.col("_c.x").alias("lon"), F.col("_c.y").alias("lat"))
    return spatial.containing(c, parent).select(F.col("area_id").alias("parent_id"), "child_id")


#: Words that name no place or facility.
GENERIC_WORDS = ["industrial", "factory", "plant", "area", "estate", "company", "limited", "india", "near", "village", "district", "unit"]


def evidence_check(pages: DataFrame, min_chars: int = 150) -> DataFrame:
    """pages: text, place, event_date. Adds place_found, event_found, date_found and valid; short texts prove nothing."""
    body = F.lower("text")
    words = F.filter(F.split(F.lower("place"), r"[^a-z]+"), lambda w: (F.length(w) >= 4) & ~w.isin(GENERIC_WORDS))
    place = F.exists(words, lambda w: F.contains(body, w))
    event = body.rlike(r"\b(fire|blaze|explosion|blast|inferno|gutted|flames?)\b")
    d = F.col("event_date")
    numeric = [F.contains(body, F.date_format(d, f)) for f in ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "d.M.yyyy")]
    month = F.contains(body, F.lower(F.date_format(d, "MMMM"))) & F.contains(body, F.date_format(d, "yyyy"))
    found = reduce(lambda a, b: a | b, [*numeric, month])
    enough = F.length("text") >= min_chars
    return pages.withColumns({"place_found": enough & place, "event_found": enough & event, "date_found": enough & found, "valid": enough & place & event & found})


def best_geocode(hits: DataFrame) -> DataFrame:
    """hits: incident_id, query_kind, class, extent_km, ord. A facility beats an area, an area a locality, and a locality
    counts only from its own query; the earliest of equals wins. The radius is half the extent between 0.3 and 8 km."""
    kind = F.when(F.col("class").isin("man_made", "power", "building", "industrial"), "facility").when(F.col("class") == "landuse", "industrial_area").when((F.col("class") == "place") & (F.col("query_kind") == "locality"), "locality")
    rank = F.when(F.col("quality") == "facility", 3).when(F.col("quality") == "industrial_area", 2).otherwise(1)
    h = hits.withColumn("quality", kind).filter("quality is not null").withColumns({"_r": rank, "radius_km": F.least(F.greatest(F.col("extent_km") / 2, F.lit(0.3)), F.lit(8.0))})
    return h.withColumn("_n", F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc("_r"), "ord"))).filter("_n = 1").drop("_n", "_r")


def next_job(manual: bool, failures: int, since_failure_s: float, since_reconcile_s: float, since_poll_s: float, poll_s: float = 600, reconcile_s: float = 86_400, backoff_s: float = 60, cap_s: float = 3600) -> str:
    """What a worker does next: a manual request first, then waiting out a backoff, then reconcile, then poll."""
    if manual:
        return "manual"
    if failures and since_failure_s < min(backoff_s * 2 ** (failures - 1), cap_s):
        return "wait"
    return "reconcile" if since_reconcile_s >= reconcile_s else "poll" if since_poll_s >= poll_s else "wait"


def pending(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units of a resumable run that are not finished."""
    return units.join(done.select(key), key, "left_anti")


def merged_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status maps merged per key, newer entries first."""
    j = old.withColumnRenamed("status", "_o").join(new.withColumnRenamed("status", "_n"), "key", "full_outer")
    empty = F.create_map().cast("map<string,string>")
    o, n = F.coalesce("_o", empty), F.coalesce("_n", empty)
    return j.select("key", F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n).alias("status"))


def slim(df: DataFrame, columns: Sequence[str], digits: int = 5) -> DataFrame:
    """A short projection with rounded numbers, for static listings."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def replication_state(df: DataFrame, column: str, now: Column) -> DataFrame:
    """Adds sequence, source_time and lag_s from a replication state text of key=value lines; nulls where it has none."""
    field = lambda key: F.nullif(F.regexp_extract(column, rf"(?m)^{key}=(.+)$", 1), F.lit(""))
    at = F.try_to_timestamp(F.replace(field("timestamp"), F.lit("\\:"), F.lit(":")))
    return df.withColumns({"sequence": field("sequenceNumber").try_cast("long"), "source_time": at, "lag_s": F.unix_timestamp(now) - F.unix_timestamp(at)})
