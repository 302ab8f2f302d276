"""Registered queries over single derivations, filters, orders, sets and scalar functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import staging
from emberline.functions import geo, ids, text
from emberline.operators import alerts, baseline, detections, heat_sources, imagery, matching, quality, spatial
from emberline.plans import serving, thermal_queries, views
from emberline.sources import registries, satellite, sinks
from emberline.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(*used: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = views.with_views(sql, *used) if used else sql
        return f

    return add


_HAZARD = "|".join(alerts.HAZARDOUS)


@query("facilities", sql=f"SELECT ref, CASE least(CASE WHEN capacity_mw / 50 >= 100 THEN 2 WHEN capacity_mw / 50 >= 40 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(kind, '{_HAZARD}') THEN 1 ELSE 0 END, 2) WHEN 0 THEN 'watch' WHEN 1 THEN 'high' ELSE 'critical' END AS severity FROM facilities")
def severity_levels(spark, sf_dir):
    return views.facilities(spark, sf_dir).select("ref", alerts.level(alerts.severity_rank(F.col("capacity_mw") / 50, F.col("kind"))).alias("severity"))


@query("facilities", sql="SELECT ref, CASE WHEN ref % 4 = 0 THEN NULL WHEN ref % 4 = 1 THEN NULL ELSE name END AS shown, CASE WHEN ref % 3 = 0 THEN concat('src:', ref) ELSE concat('gem:', ref) END AS facility_key FROM facilities")
def facility_keys(spark, sf_dir):
    """Names that look like identifiers are not shown."""
    f = views.facilities(spark, sf_dir)
    name = F.when(F.col("ref") % 4 == 0, "0a1b2c3d-0000-1111-2222-333344445555").when(F.col("ref") % 4 == 1, "osm:way/1").otherwise(F.col("name"))
    d = f.select("ref", name.alias("site_name"), F.concat(F.lit("gem:"), F.col("ref").cast("string")).alias("site_ref"), (F.col("ref") % 3 != 0).alias("site_within"), F.col("ref").alias("source_id"))
    return d.select("ref", alerts.display_name().alias("shown"), alerts.facility_key().alias("facility_key"))


@query("detections", sql="SELECT detection_id, round(sin(2 * pi() * (month(acq) - 1) / 12), 6) AS month_sin, round(cos(2 * pi() * (month(acq) - 1) / 12), 6) AS month_cos FROM detections")
def season_encoding(spark, sf_dir):
    turn = 2 * 3.141592653589793 * (F.month("acq") - 1) / 12
    return views.detections(spark, sf_dir).select("detection_id", F.round(F.sin(turn), 6).alias("month_sin"), F.round(F.cos(turn), 6).alias("month_cos"))


@query("detections", sql="SELECT detection_id, CASE WHEN frp / 10 - 3 >= 4 THEN 'far above' WHEN frp / 10 - 3 >= 2 THEN 'above' WHEN frp / 10 - 3 <= -2 THEN 'below' ELSE 'usual' END AS deviation, round((800 + sqrt(greatest(frp, 0)) * 1800) * 0.5) AS height FROM detections")
def deviation_and_height(spark, sf_dir):
    d = views.detections(spark, sf_dir).withColumn("z", F.col("frp") / 10 - 3)
    return d.select("detection_id", baseline.deviation_label("z").alias("deviation"), serving.column_height(F.col("frp"), 0.5).alias("height"))


@query("sites", sql="SELECT site_id, CASE WHEN m IS NULL THEN 'none' WHEN r = 'industrial_fire_candidate' THEN 'rules_only' WHEN m = r THEN 'agrees' ELSE 'differs' END AS opinion FROM (SELECT site_id, CASE site_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'vegetation_fire' END AS m, CASE site_id % 5 WHEN 0 THEN 'industrial_fire_candidate' WHEN 1 THEN 'other' ELSE 'vegetation_fire' END AS r FROM sites) x")
def model_opinion(spark, sf_dir):
    i = F.col("site_id")
    m = F.when(i % 3 == 1, "other").when(i % 3 == 2, "vegetation_fire")
    r = F.when(i % 5 == 0, "industrial_fire_candidate").when(i % 5 == 1, "other").otherwise("vegetation_fire")
    return views.sites(spark, sf_dir).select("site_id", serving.model_opinion(m, r).alias("opinion"))


@query("admin_areas", sql="SELECT area_id, round((xmax - xmin) * (ymax - ymin), 6) AS area, round((xmin + xmax) / 2, 6) AS cx, round((ymin + ymax) / 2, 6) AS cy, round(sqrt((xmax - xmin) * (ymax - ymin) * 111320e0 * 111320e0 * cos(radians((ymin * 3 + ymax * 2) / 5)) / pi()), 2) AS radius_m, true AS valid FROM admin_areas")
def ring_measures(spark, sf_dir):
    ring = F.col("rings")[0]
    a = views.admin_areas(spark, sf_dir)
    c = geo.ring_centroid(ring)
    return a.select("area_id", F.round(F.abs(geo.ring_area(ring)), 6).alias("area"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), F.round(geo.equivalent_radius_m(ring), 2).alias("radius_m"), geo.ring_valid(ring).alias("valid"))


@query("admin_areas", sql="SELECT area_id, xmin, ymin, xmax, ymax FROM admin_areas")
def ring_bounds(spark, sf_dir):
    return views.admin_areas(spark, sf_dir).select("area_id", geo.ring_bounds(F.col("rings")[0]).alias("b")).select("area_id", "b.*")


_P = thermal_queries._PROFILE


@query("detections", "facilities", sql=f"""+{_P}, day_sum AS (SELECT 'facility' AS scope, facility_id::varchar AS key, acq::date AS day, sum(frp) AS s FROM assigned WHERE facility_id IS NOT NULL GROUP BY ALL UNION ALL SELECT 'cell', cell_key, acq::date, sum(frp) FROM assigned GROUP BY ALL),
  today AS (SELECT scope, key, arg_max(s, day) AS frp_today FROM day_sum GROUP BY ALL) SELECT today.scope AS baseline_scope, today.key AS baseline_key, round(frp_today, 4) AS frp_today, med IS NOT NULL AS baseline_known FROM today LEFT JOIN profile ON profile.scope = today.scope AND profile.key = today.key""")
def baseline_attach(spark, sf_dir):
    """Each entity as a source of its own: a facility by its key, a cell by the modal cell of its detections."""
    det = thermal_queries.assigned(spark, sf_dir)
    profile = baseline.compute(det, window_days=20, exclude_days=5)
    cells = det.withColumn("cluster", F.xxhash64("cell_key"))
    sources = cells.select("cluster", F.lit(None).cast("string").alias("site_ref"), F.lit(False).alias("site_within"), "cell_key").distinct()
    inside = det.filter("facility_id is not null").select(F.xxhash64(F.lit("f"), "facility_id").alias("cluster"), F.col("facility_id").cast("string").alias("site_ref"), F.lit(True).alias("site_within"), F.lit("none").alias("cell_key")).distinct()
    out = baseline.attach(sources.unionByName(inside), cells, profile)
    return out.select("baseline_scope", "baseline_key", F.round("frp_today", 4).alias("frp_today"), "baseline_known")


_LEVEL = "CASE WHEN thermal_class = 'industrial_fire_candidate' AND hours <= 24 AND frp_max >= 8 THEN CASE WHEN frp_max >= 100 THEN 0 WHEN frp_max >= 40 THEN 1 ELSE 2 END WHEN thermal_class = 'industrial_persistent' AND n_days >= 4 AND frp_recent_max >= 3 * greatest(frp_mean, 1) AND frp_recent_max >= 30 THEN 1 ELSE 3 END"


@query("detections", "facilities", sql=f"+{thermal_queries._CLASSED}, c AS (SELECT cluster, frp_max, thermal_class, {_LEVEL} AS rank FROM classed) SELECT cluster FROM c WHERE rank < 3 OR thermal_class = 'industrial_fire_candidate' ORDER BY rank, frp_max DESC, cluster::varchar LIMIT 10")
def imagery_candidates(spark, sf_dir):
    s = thermal_queries.classified(spark, sf_dir).withColumn("source_id", F.col("cluster").cast("string"))
    return imagery.candidates(s, 10).select("cluster")


@query("detections", "facilities", sql=f"+{thermal_queries._CLASSED} SELECT cluster FROM classed ORDER BY CASE WHEN thermal_class = 'industrial_fire_candidate' AND hours <= 24 AND frp_max >= 8 THEN CASE WHEN frp_max >= 100 THEN 3 WHEN frp_max >= 40 THEN 2 ELSE 1 END WHEN thermal_class = 'industrial_persistent' AND n_days >= 4 AND frp_recent_max >= 3 * greatest(frp_mean, 1) AND frp_recent_max >= 30 THEN 2 ELSE 0 END DESC, frp_total DESC, cluster LIMIT 25 OFFSET 5")
def thermal_page(spark, sf_dir):
    return serving.thermal_page(thermal_queries.classified(spark, sf_dir), 25, 5).select("cluster")


@query(sql="WITH a AS (SELECT s_suppkey AS alert_id, CASE WHEN s_suppkey % 2 = 0 THEN 'open' ELSE 'closed' END AS status, CASE s_suppkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'watch' END AS severity FROM supplier) SELECT alert_id, status, severity FROM a ORDER BY status = 'open' DESC, severity = 'critical' DESC, severity = 'high' DESC, alert_id DESC LIMIT 15")
def alert_inbox(spark, sf_dir):
    k = F.col("s_suppkey")
    a = staging.table(spark, sf_dir, "supplier").select(k.alias("alert_id"), F.when(k % 2 == 0, "open").otherwise("closed").alias("status"), F.when(k % 3 == 0, "critical").when(k % 3 == 1, "high").otherwise("watch").alias("severity"), F.timestamp_seconds(k).alias("created_at"))
    return alerts.inbox(a, 15).select("alert_id", "status", "severity")


@query(sql="WITH c AS (SELECT s_nationkey AS cycle, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 DESC, s_acctbal DESC, s_suppkey) AS rn FROM supplier) SELECT cycle, s_suppkey, rn > 2 AS deferred FROM c")
def alert_cap(spark, sf_dir):
    s = staging.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cycle"), "s_suppkey", (F.col("s_suppkey") % 3).alias("severity_rank"), F.col("s_acctbal").alias("frp"), F.col("s_suppkey").alias("facility_key"))
    return alerts.capped(s, "cycle", 2).select("cycle", "s_suppkey", "deferred")


@query(sql="SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 7 < 5 AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 24 HOURS")
def delivery_retries(spark, sf_dir):
    o = staging.table(spark, sf_dir, "orders")
    newest = o.agg(F.max("o_orderdate").alias("now"))
    d = o.select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("ok"), (F.col("o_orderkey") % 7).alias("attempts"), F.col("o_orderdate").alias("created_at")).join(F.broadcast(newest))
    return alerts.retries_due(d, F.col("now")).select("o_orderkey")


@query("detections", sql="SELECT day, family, CASE WHEN day < DATE '2024-01-20' THEN 'VIIRS_SNPP_SP' ELSE 'VIIRS_SNPP_NRT' END AS product FROM (SELECT DISTINCT acq::date AS day, 'SNPP' AS family FROM detections) x WHERE day >= DATE '2024-01-10'")
def pick_product(spark, sf_dir):
    days = views.detections(spark, sf_dir).select(F.to_date("acq").alias("day")).distinct()
    have = spark.createDataFrame([("SNPP", "VIIRS_SNPP_SP", "2023-01-01", "2024-01-19"), ("SNPP", "VIIRS_SNPP_NRT", "2024-01-10", "2024-12-31")], "family string, product string, a string, b string").select("family", "product", F.col("a").cast("date").alias("min_day"), F.col("b").cast("date").alias("max_day"))
    return detections.pick_product(days, have).filter("day >= date'2024-01-10'")


@query("detections", sql="SELECT lat_text, count(*) AS n FROM (SELECT DISTINCT printf('%.5f', lat) AS lat_text, printf('%.5f', lon), date_trunc('minute', acq) FROM detections WHERE lat BETWEEN 8 AND 32 AND lon BETWEEN 69 AND 96) x GROUP BY 1")
def satellite_csv(spark, sf_dir):
    """Detections written as a satellite text file and scanned again; rows of one place and minute share their id."""
    d = views.detections(spark, sf_dir)
    path = staging.new_path(spark, "csv")
    stamp = lambda f: F.date_format("acq", f)
    d.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit(300.0).alias("bright_ti4"), stamp("yyyy-MM-dd").alias("acq_date"), stamp("HHmm").alias("acq_time"), F.lit("N").alias("satellite"), F.substring("confidence", 1, 1).alias("confidence"), "frp", "daynight").write.csv(path, header=True)
    scanned, _ = satellite.read_products(spark, {"VIIRS_SNPP_NRT": path}, (69, 8, 96, 32))
    return scanned.groupBy(F.format_string("%.5f", "lat").alias("lat_text")).agg(F.count("*").alias("n"))


@query("detections", sql="SELECT split_part(instrument, '_', 2) AS family, count(*) AS n FROM (SELECT DISTINCT lat, lon, acq, instrument FROM detections WHERE acq::date BETWEEN DATE '2024-01-05' AND DATE '2024-01-15') x GROUP BY 1")
def archive_scan(spark, sf_dir):
    """Written by family and day, read back with pruned days."""
    path = staging.new_path(spark, "archive")
    satellite.write_archive(views.detections(spark, sf_dir), path)
    return satellite.read_archive(spark, [path], "2024-01-05", "2024-01-15").groupBy("family").agg(F.count("*").alias("n"))


@query("facilities", sql="SELECT count(*) AS cells FROM (SELECT DISTINCT printf('%.3f', round_even(lat / 2e-3, 0) * 2e-3) AS a, printf('%.3f', round_even(lon / 2e-3, 0) * 2e-3) AS b FROM facilities) x")
def cover_prefetch(spark, sf_dir):
    f = views.facilities(spark, sf_dir)
    return satellite.prefetch_points(f, f.filter("ref % 2 = 0")).agg(F.count("*").alias("cells"))


@query("facilities", sql="SELECT ref, CASE WHEN ref % 3 = 0 THEN 5e-1 END AS lc_crop FROM facilities")
def cover_lookup(spark, sf_dir):
    f = views.facilities(spark, sf_dir)
    cache = f.filter("ref % 3 = 0").select(satellite.cover_cell("lat", "lon").alias("cell"), F.lit(0.5).alias("lc_crop")).distinct()
    found, _ = satellite.with_cover(f, cache)
    return found.select("ref", F.when(F.col("ref") % 3 == 0, F.col("lc_crop")).alias("lc_crop"))


# ---- sets and arrays
@query(sql="SELECT o_orderkey, 'removed' AS side FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, 'added' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0")
def key_differences(spark, sf_dir):
    o = staging.table(spark, sf_dir, "orders").select("o_orderkey")
    old, new = o.filter("o_orderkey % 7 <> 0"), o.filter("o_orderkey % 11 <> 0")
    return old.join(new, "o_orderkey", "left_anti").withColumn("side", F.lit("removed")).unionByName(new.join(old, "o_orderkey", "left_anti").withColumn("side", F.lit("added")))


@query("detections", sql="SELECT d.user_id, count(*) AS n FROM detections d WHERE d.user_id IN (SELECT user_id FROM detections GROUP BY 1 HAVING max(frp) >= 40) AND acq::date > DATE '2024-01-30' - 21 GROUP BY 1")
def bundle_rows(spark, sf_dir):
    """Semi join: recent detections of current sources."""
    d = views.detections(spark, sf_dir)
    current = d.groupBy("user_id").agg(F.max("frp").alias("m")).filter("m >= 40").select("user_id")
    return d.filter(F.to_date("acq") > F.date_sub(F.lit("2024-01-30").cast("date"), 21)).join(current, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("detections", sql="SELECT count(*) AS shared FROM (SELECT user_id FROM detections WHERE acq::date < DATE '2024-01-15' AND user_id % 2 = 0 INTERSECT SELECT user_id FROM detections WHERE acq::date >= DATE '2024-01-15' AND user_id % 2 = 1) x")
def split_disjointness(spark, sf_dir):
    d = views.detections(spark, sf_dir)
    early, late = d.filter("to_date(acq) < date'2024-01-15' and user_id % 2 = 0"), d.filter("to_date(acq) >= date'2024-01-15' and user_id % 2 = 1")
    return early.select("user_id").intersect(late.select("user_id")).agg(F.count("*").alias("shared"))


@query(sql="SELECT s_suppkey, md5(concat('{\"a\":\"', s_nationkey, '\",\"b\":\"', s_name, '\"}|POINT')) AS content_hash FROM supplier")
def content_hashes(spark, sf_dir):
    s = staging.table(spark, sf_dir, "supplier")
    tags = F.create_map(F.lit("b"), F.col("s_name"), F.lit("a"), F.col("s_nationkey").cast("string"))
    return s.select("s_suppkey", ids.content_hash(tags, F.lit("POINT")).alias("content_hash"))


@query(sql="WITH m AS (SELECT p_brand, p_type, p_partkey FROM part) SELECT p_brand, min(p_partkey) AS first_part, count(*) AS record_count, count(DISTINCT p_type) AS types FROM m GROUP BY 1")
def master_rows(spark, sf_dir):
    p = staging.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("cluster"), F.col("p_name").alias("name"), F.col("p_type").alias("industry"), F.lit("2024-01-01").cast("date").alias("first_seen"), F.lit("2024-01-02").cast("date").alias("last_seen"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    types = p.groupBy("cluster").agg(F.countDistinct("industry").alias("types"))
    return matching.master_records(p).join(types, "cluster").select(F.col("cluster").alias("p_brand"), F.col("members")[0].alias("first_part"), "record_count", "types")


@query(sql="SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN 'not_applicable' ELSE p_type END AS value FROM part")
def value_classes(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, " ").when(k % 5 == 1, "Unknown ").when(k % 5 == 2, "N/A").otherwise(F.col("p_type"))
    return staging.table(spark, sf_dir, "part").select("p_partkey", quality.value_class(raw).alias("value"))


@query(sql="SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pvt ltd' WHEN 1 THEN 'llp' WHEN 2 THEN 'ltd' END AS form FROM part")
def legal_forms(spark, sf_dir):
    k = F.col("p_partkey")
    n = F.concat("p_name", F.when(k % 4 == 0, " Pvt. Ltd.").when(k % 4 == 1, " LLP").when(k % 4 == 2, " Limited").otherwise(""))
    return staging.table(spark, sf_dir, "part").select("p_partkey", text.legal_form(n).alias("form"))


@query(sql="SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts::date END AS day FROM events")
def lenient_dates(spark, sf_dir):
    e = staging.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, "31/31/2024").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", F.to_date(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))).alias("day"))


@query("sites", sql="SELECT count(*) AS sites, count(*) FILTER (is_active) AS active, count(*) FILTER (state IS NULL) AS no_state, true AS consistent FROM sites")
def sync_consistency(spark, sf_dir):
    s = views.sites(spark, sf_dir)
    one = s.agg(F.count("*").alias("sites"), F.count_if("is_active").alias("active"), F.count_if(F.col("state").isNull()).alias("no_state"))
    raw = staging.table(spark, sf_dir, "customer").agg(F.count("*").alias("_raw"))
    return one.join(raw).select("sites", "active", "no_state", (F.col("sites") == F.col("_raw")).alias("consistent"))


@query("detections", sql="SELECT confidence, count(*) AS n, sum(CASE WHEN daynight = 'N' THEN 1 ELSE 0 END)::bigint AS nights FROM detections GROUP BY 1")
def label_manifest(spark, sf_dir):
    """The manifest pivot over splits, summed back."""
    d = views.detections(spark, sf_dir).select(F.col("confidence").alias("label"), F.when(F.col("daynight") == "N", "train").otherwise("test").alias("split"), "detection_id")
    m = sinks.manifest(d)
    return m.select(F.col("label").alias("confidence"), (F.col("train") + F.col("test") + F.col("unused")).alias("n"), F.col("train").alias("nights"))


@query("detections", sql="+t AS (SELECT user_id, acq, frp FROM detections), l AS (SELECT user_id AS cluster, arg_max(CASE WHEN frp >= 20 THEN 'other' ELSE 'vegetation_fire' END, acq) FILTER (acq <= (SELECT min(acq) FROM t WHERE frp >= 45)) AS c FROM t GROUP BY 1) SELECT count(c) AS shown FROM l")
def replay_verdict(spark, sf_dir):
    """How many logs have a class shown by the time of the first alert."""
    d = views.detections(spark, sf_dir).withColumn("class", F.when(F.col("frp") >= 20, "other").otherwise("vegetation_fire"))
    first = F.broadcast(d.filter("frp >= 45").agg(F.min("acq").alias("_at")))
    log = d.join(first, F.col("acq") <= F.col("_at")).groupBy("user_id").agg(F.max_by("class", "acq").alias("class"), F.max("acq").alias("clock"))
    v = live.verdict(log.select(F.col("clock").cast("timestamp").alias("clock"), "class"), d.filter("frp >= 45").select(F.col("acq").cast("timestamp").alias("at")), ["other", "vegetation_fire"])
    return log.join(F.broadcast(v.filter("class_ok")), F.lit(True), "left").agg(F.count("class").alias("shown"))


@query("facilities", sql="SELECT ref, concat(floor((lon + 180) / 360 * 1024)::bigint, '_', floor((lat + 90) / 180 * 1024)::bigint) AS cell FROM facilities")
def geohash_cells(spark, sf_dir):
    """The cells behind a geohash of four letters; the letters are held by tests."""
    f = views.facilities(spark, sf_dir)
    cell = F.concat_ws("_", F.floor((F.col("lon") + 180) / 360 * 1024).cast("string"), F.floor((F.col("lat") + 90) / 180 * 1024).cast("string"))
    return f.filter(F.length(geo.geohash(F.col("lat"), F.col("lon"))) == 4).select("ref", cell.alias("cell"))


@query("detections", sql="SELECT detection_id, round(" + thermal_queries._hav("d", "c") + ", 3) AS m FROM (SELECT * FROM detections) d, (SELECT 20e0 AS lat, 80e0 AS lon) c")
def haversine(spark, sf_dir):
    return views.detections(spark, sf_dir).select("detection_id", F.round(geo.haversine_m("lat", "lon", 20.0, 80.0), 3).alias("m"))


@query("detections", sql="SELECT min(d.detection_id) AS detection_id, lat, lon FROM detections d GROUP BY lat, lon HAVING count(*) > 1")
def repeated_places(spark, sf_dir):
    """Same-place edges of the cluster graph, by their first member."""
    d = views.detections(spark, sf_dir)
    edges = spatial.self_edges(d.select("detection_id", "lat", "lon"), "detection_id", 0.001)
    return d.join(edges.select(F.col("a").alias("detection_id")).distinct(), "detection_id").select("detection_id", "lat", "lon")


@query("facilities", sql="SELECT kind, count(*) AS n, CASE kind WHEN 'gas_flare' THEN 400e0 WHEN 'brick_kiln' THEN 400e0 WHEN 'factory_generic' THEN 800e0 WHEN 'landfill' THEN 1000e0 WHEN 'cement' THEN 1200e0 WHEN 'chemical_fertilizer' THEN 1200e0 WHEN 'mining_quarry' THEN 1800e0 ELSE 1500e0 END AS kind_radius_m FROM facilities GROUP BY 1")
def kind_radii(spark, sf_dir):
    from emberline.operators import facilities

    return views.facilities(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n")).withColumn("kind_radius_m", facilities.kind_radius(F.col("kind")))


@query(sql="SELECT concat('wri:', s_suppkey) AS source_id, 1500e0 AS radius_m FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0")
def power_plant_loader(spark, sf_dir):
    k = F.col("s_suppkey")
    d = staging.table(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, "India").otherwise("Peru").alias("country"), F.when(k % 3 == 0, "Solar").otherwise("Coal").alias("primary_fuel"), F.concat(F.lit("wri:"), k.cast("string")).alias("gppd_idnr"), F.col("s_name").alias("name"), F.lit("20.5").alias("latitude"), F.lit("75.5").alias("longitude"), F.lit("10").alias("capacity_mw"))
    return registries.power_plants(d).select("source_id", "radius_m")


@query("detections", sql=f"+{thermal_queries._EDGES} SELECT count(DISTINCT cluster) AS sources, count(*) AS detections, min(acq) AS first, max(acq) AS last FROM clustered")
def run_summary(spark, sf_dir):
    d = heat_sources.cluster(views.detections(spark, sf_dir))
    return d.agg(F.countDistinct("cluster").alias("sources"), F.count("*").alias("detections"), F.min("acq").alias("first"), F.max("acq").alias("last"))
