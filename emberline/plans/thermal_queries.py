"""Registered queries over detections, facilities and areas, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import staging
from emberline.functions import geo, ids
from emberline.operators import alerts, baseline, detections, heat_sources, spatial
from emberline.plans import views

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The driver's events span a month, so windows are shorter than the defaults.
WINDOW, EXCLUDE = 20, 5


def query(*used: str, sql: str | None = None):
    """Registers the function under its name; sql follows the views it uses."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = views.with_views(sql, *used) if used else sql
        return f

    return add


# ---- fragments of the twins
_CELL = """concat(floor(6378137 * 0.8667510025721987e0 * radians(lon) / 1000)::bigint, '_',
  floor(6378137 * ((1 - 0.0066943799901413165e0) * (sin(radians(lat)) / (1 - 0.0066943799901413165e0 * sin(radians(lat)) * sin(radians(lat)))
  - ln((1 - 0.08181919084262157e0 * sin(radians(lat))) / (1 + 0.08181919084262157e0 * sin(radians(lat)))) / (2 * 0.08181919084262157e0))) / (2 * 0.8667510025721987e0) / 1000)::bigint)"""


def _hav(a: str, b: str) -> str:
    return f"""2 * 6371000e0 * asin(sqrt(least(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2), 1e0)))"""


_PHYSICAL = """physical AS (SELECT * EXCLUDE (rn) FROM (SELECT *, split_part(instrument, '_', 2) AS satellite, split_part(instrument, '_', 3) AS product, acq::date AS day,
  row_number() OVER (PARTITION BY split_part(instrument, '_', 2), acq, round(lat, 4), round(lon, 4) ORDER BY CASE WHEN split_part(instrument, '_', 3) = 'SP' THEN 0 ELSE 1 END, detection_id) AS rn
  FROM detections WHERE confidence <> 'low') x WHERE rn = 1)"""
_ASSIGN = f"""match AS (SELECT d.detection_id, arg_max(f.ref, {{m}}) AS ref FROM detections d JOIN facilities f
  ON abs(d.lat - f.lat) < 0.07 AND abs(d.lon - f.lon) < 0.13 WHERE {{m}} >= 0 GROUP BY 1)""".replace("{m}", f"(f.radius_m + 500 - {_hav('d', 'f')})")
_BOUNDS = f"bounds AS (SELECT max(acq)::date - {EXCLUDE} - {WINDOW - 1} AS first_day, max(acq)::date - {EXCLUDE} AS last_day FROM detections)"
_PROFILE = f"""{_ASSIGN}, assigned AS (SELECT detections.* EXCLUDE (detection_id), detections.detection_id, match.ref AS facility_id, {_CELL} AS cell_key FROM detections LEFT JOIN match ON detections.detection_id = match.detection_id),
  {_BOUNDS}, win AS (SELECT assigned.* FROM assigned, bounds WHERE acq::date BETWEEN first_day AND last_day),
  covered AS (SELECT count(DISTINCT acq::date) AS covered_days FROM win),
  phys AS (SELECT * EXCLUDE (rn) FROM (SELECT *, acq::date AS day, row_number() OVER (PARTITION BY split_part(instrument, '_', 2), acq, round(lat, 4), round(lon, 4)
    ORDER BY CASE WHEN split_part(instrument, '_', 3) = 'SP' THEN 0 ELSE 1 END, detection_id) AS rn FROM win WHERE confidence <> 'low') x WHERE rn = 1),
  ent AS (SELECT 'facility' AS scope, facility_id::varchar AS key, frp, day, daynight FROM phys WHERE facility_id IS NOT NULL UNION ALL SELECT 'cell', cell_key, frp, day, daynight FROM phys),
  ent_day AS (SELECT scope, key, day, sum(frp) AS s FROM ent GROUP BY ALL),
  st AS (SELECT scope, key, count(*) AS n_detections, quantile_cont(frp, 0.5) AS med, quantile_cont(frp, 0.95) AS p95, avg(CASE WHEN daynight = 'N' THEN 1e0 ELSE 0e0 END) AS night_share FROM ent GROUP BY ALL),
  dy AS (SELECT scope, key, count(*) AS active_days, sum(s) AS s1, sum(s * s) AS s2 FROM ent_day GROUP BY ALL),
  profile AS (SELECT st.*, active_days, covered_days, s1 / covered_days AS mean, sqrt(greatest(s2 / covered_days - (s1 / covered_days) * (s1 / covered_days), 0e0)) AS std
    FROM st JOIN dy ON st.scope = dy.scope AND st.key = dy.key CROSS JOIN covered)"""
_PROFILE = _PROFILE.replace("SELECT st.*,", "SELECT st.scope, st.key, n_detections, med, p95, night_share,")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with facility_id and cell_key."""
    det = views.detections(spark, sf_dir)
    match = spatial.match_facilities(det, views.facilities(spark, sf_dir), "detection_id").select("detection_id", F.col("ref").alias("facility_id"))
    return det.join(match, "detection_id", "left").withColumn("cell_key", geo.cell_key("lat", "lon"))


@query("detections", sql=f"+{_PHYSICAL} SELECT satellite, product, daynight, count(*) AS n, sum(detection_id)::bigint AS id_sum, round(sum(frp), 4) AS frp_sum FROM physical GROUP BY ALL")
def physical_dedupe(spark, sf_dir):
    d = detections.physical(views.detections(spark, sf_dir))
    return d.groupBy("satellite", "product", "daynight").agg(F.count("*").alias("n"), F.sum("detection_id").alias("id_sum"), F.round(F.sum("frp"), 4).alias("frp_sum"))


@query("detections", sql=f"SELECT detection_id, {_CELL} AS cell_key FROM detections")
def cell_key(spark, sf_dir):
    return views.detections(spark, sf_dir).select("detection_id", geo.cell_key("lat", "lon").alias("cell_key"))


@query("detections", sql="SELECT detection_id, substring(sha1(concat(instrument, '|', printf('%.5f', lat), '|', printf('%.5f', lon), '|', strftime(acq, '%Y-%m-%dT%H:%M:%S'), '+00:00')), 1, 20) AS content_id FROM detections")
def detection_ids(spark, sf_dir):
    return views.detections(spark, sf_dir).select("detection_id", ids.detection_id(F.col("instrument"), F.col("lat"), F.col("lon"), F.col("acq")).alias("content_id"))


@query("detections", sql="SELECT count(*) AS n, round(sum(frp), 4) AS frp_sum FROM detections WHERE lat BETWEEN 10 AND 20 AND lon BETWEEN 72 AND 84")
def bbox_filter(spark, sf_dir):
    d = views.detections(spark, sf_dir).filter(geo.in_box("lat", "lon", 10, 72, 20, 84))
    return d.agg(F.count("*").alias("n"), F.round(F.sum("frp"), 4).alias("frp_sum"))


@query("detections", "admin_areas", sql="SELECT detection_id, (SELECT arg_min(area_name, area_id) FROM admin_areas a WHERE lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax) AS area_name FROM detections")
def admin_area_join(spark, sf_dir):
    inside = F.col("lon").between(F.col("xmin"), F.col("xmax")) & F.col("lat").between(F.col("ymin"), F.col("ymax"))
    return spatial.first_area(views.detections(spark, sf_dir), views.admin_areas(spark, sf_dir), "detection_id", inside).select("detection_id", "area_name")


@query("detections", "admin_areas", sql="SELECT area_name, count(*) AS n FROM detections JOIN admin_areas ON lon > xmin AND lon < xmax AND lat > ymin AND lat < ymax GROUP BY 1")
def point_in_polygon(spark, sf_dir):
    """The ray test itself, away from edges."""
    areas = views.admin_areas(spark, sf_dir)
    edge = (F.col("lon") > F.col("xmin")) & (F.col("lon") < F.col("xmax")) & (F.col("lat") > F.col("ymin")) & (F.col("lat") < F.col("ymax"))
    d = spatial.containing(views.detections(spark, sf_dir), areas).filter(edge)
    return d.groupBy("area_name").agg(F.count("*").alias("n"))


@query("detections", "facilities", sql=f"+{_ASSIGN} SELECT detection_id, ref FROM match")
def facility_match(spark, sf_dir):
    return spatial.match_facilities(views.detections(spark, sf_dir), views.facilities(spark, sf_dir), "detection_id").select("detection_id", "ref")


@query("detections", "facilities", sql=f"SELECT d.detection_id, round(min({_hav('d', 'f')}), 3) AS distance_m FROM (SELECT * FROM detections) d CROSS JOIN facilities f GROUP BY 1")
def nearest_facility(spark, sf_dir):
    return spatial.nearest_facility(views.detections(spark, sf_dir), views.facilities(spark, sf_dir), "detection_id").select("detection_id", F.round("distance_m", 3).alias("distance_m"))


@query("detections", "facilities", sql=f"+{_ASSIGN} SELECT m.ref, count(*) AS n FROM match m JOIN detections d ON m.detection_id = d.detection_id WHERE d.detection_id % 3 <> 0 GROUP BY 1")
def assign_incremental(spark, sf_dir):
    """Only detections that the assignment table lacks are matched."""
    det = views.detections(spark, sf_dir)
    done = det.filter("detection_id % 3 = 0").select("detection_id")
    new = spatial.match_facilities(detections.unseen(det, done), views.facilities(spark, sf_dir), "detection_id")
    return new.groupBy("ref").agg(F.count("*").alias("n"))


@query("detections", "facilities", sql=f"+{_ASSIGN}, a AS (SELECT m.ref, acq::date AS day, frp FROM match m JOIN detections d ON m.detection_id = d.detection_id WHERE confidence <> 'low') SELECT ref, day, round(sum(frp), 4) AS frp_day FROM a GROUP BY ALL")
def baseline_entity_day(spark, sf_dir):
    d = assigned(spark, sf_dir).filter("facility_id is not null and confidence <> 'low'")
    return d.groupBy(F.col("facility_id").alias("ref"), F.to_date("acq").alias("day")).agg(F.round(F.sum("frp"), 4).alias("frp_day"))


@query("detections", "facilities", sql=f"""+{_PROFILE} SELECT scope, key, active_days, covered_days, round(active_days / covered_days, 6) AS active_fraction, round(med, 6) AS frp_median, round(p95, 6) AS frp_p95,
  round(night_share, 6) AS night_share, n_detections, round(mean, 6) AS daily_frp_mean, round(std, 4) AS daily_frp_std FROM profile""")
def baseline_full(spark, sf_dir):
    b = baseline.compute(assigned(spark, sf_dir), window_days=WINDOW, exclude_days=EXCLUDE)
    return b.select("scope", "key", "active_days", "covered_days", *[F.round(c, 6).alias(c) for c in ("active_fraction", "frp_median", "frp_p95", "night_share")], "n_detections", F.round("daily_frp_mean", 6).alias("daily_frp_mean"), F.round("daily_frp_std", 4).alias("daily_frp_std"))


@query("detections", "facilities", sql=f"""+{_PROFILE}, cm AS (SELECT month(acq::date) AS m, count(DISTINCT acq::date) AS n FROM win GROUP BY 1), em AS (SELECT scope, key, month(day) AS m, count(*) AS n FROM ent_day GROUP BY ALL),
  grid AS (SELECT profile.scope, profile.key, range AS m FROM profile CROSS JOIN range(1, 13))
  SELECT grid.scope, grid.key, string_agg(coalesce(printf('%.4f', round(coalesce(em.n, 0) / cm.n, 4)), '-'), ',' ORDER BY grid.m) AS monthly_profile
  FROM grid LEFT JOIN cm ON grid.m = cm.m LEFT JOIN em ON grid.scope = em.scope AND grid.key = em.key AND grid.m = em.m GROUP BY ALL""")
def baseline_monthly_profile(spark, sf_dir):
    b = baseline.compute(assigned(spark, sf_dir), window_days=WINDOW, exclude_days=EXCLUDE)
    return b.select("scope", "key", F.array_join(F.transform("monthly_profile", lambda v: F.when(v.isNotNull(), F.format_string("%.4f", v)).otherwise("-")), ",").alias("monthly_profile"))


@query("detections", "facilities", sql=f"+{_PROFILE}, t AS (SELECT scope, key, day, s FROM (SELECT 'facility' AS scope, facility_id::varchar AS key, acq::date AS day, sum(frp) AS s FROM assigned WHERE facility_id IS NOT NULL GROUP BY ALL UNION ALL SELECT 'cell', cell_key, acq::date, sum(frp) FROM assigned GROUP BY ALL) x) SELECT scope, key, round(arg_max(s, day), 4) AS frp_today, max(day) AS frp_today_date FROM t GROUP BY ALL")
def latest_day_frp(spark, sf_dir):
    return baseline.latest_day(assigned(spark, sf_dir)).select("scope", "key", F.round("frp_today", 4).alias("frp_today"), "frp_today_date")


@query("detections", "facilities", sql=f"""+{_PROFILE}, t AS (SELECT facility_id::varchar AS key, acq::date AS day, sum(frp) AS s FROM assigned WHERE facility_id IS NOT NULL GROUP BY ALL), l AS (SELECT key, arg_max(s, day) AS today FROM t GROUP BY 1)
  SELECT l.key, round_even((today - coalesce(mean, 0)) / greatest(coalesce(std, 0), 1), 2) AS frp_z FROM l LEFT JOIN profile ON profile.key = l.key AND profile.scope = 'facility'""")
def frp_zscore(spark, sf_dir):
    det = assigned(spark, sf_dir)
    b = baseline.compute(det, window_days=WINDOW, exclude_days=EXCLUDE).filter("scope = 'facility'").select("key", "daily_frp_mean", "daily_frp_std")
    today = baseline.latest_day(det).filter("scope = 'facility'")
    return today.join(b, "key", "left").select("key", baseline.z_score("frp_today", "daily_frp_mean", "daily_frp_std").alias("frp_z"))


_EDGES = f"""places AS (SELECT lat, lon, min(detection_id) AS id FROM detections GROUP BY ALL), edges AS (SELECT a.id AS a, b.id AS b FROM places a JOIN places b ON abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.02 AND a.id <> b.id
  WHERE {_hav('a', 'b')} <= 1000), reach(id, label) AS (SELECT id, id FROM places UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.id WHERE r.label < e.b),
  labels AS (SELECT id, min(label) AS label FROM reach GROUP BY 1), clustered AS (SELECT d.*, l.label AS cluster FROM detections d JOIN places p ON d.lat = p.lat AND d.lon = p.lon JOIN labels l ON l.id = p.id)"""


@query("detections", sql=f"+{_EDGES} SELECT detection_id, cluster FROM clustered")
def components(spark, sf_dir):
    return heat_sources.cluster(views.detections(spark, sf_dir)).select("detection_id", "cluster")


_SUMMARY = """summary AS (SELECT cluster, sum(c.lat * greatest(frp, 1e-1)) / sum(greatest(frp, 1e-1)) AS lat, sum(c.lon * greatest(frp, 1e-1)) / sum(greatest(frp, 1e-1)) AS lon, count(*) AS n_detections, count(DISTINCT acq::date) AS n_days,
  min(acq) AS first_seen, max(acq) AS last_seen, avg(frp) AS frp_mean, max(frp) AS frp_max, sum(frp) AS frp_total, max(CASE WHEN acq >= last_of - INTERVAL 24 HOURS THEN frp END) AS frp_recent_max,
  avg(CASE WHEN daynight = 'N' THEN 1e0 ELSE 0e0 END) AS night_fraction, avg(CASE WHEN confidence = 'high' THEN 1e0 ELSE 0e0 END) AS high_conf_fraction,
  sqrt(pow((max(c.lat) - min(c.lat)) * 111320e0, 2) + pow((max(c.lon) - min(c.lon)) * 111320e0 * cos(radians(avg(c.lat))), 2)) AS extent_m, string_agg(DISTINCT instrument, ',' ORDER BY instrument) AS instruments
  FROM (SELECT *, max(acq) OVER (PARTITION BY cluster) AS last_of FROM clustered) c GROUP BY cluster)"""


@query("detections", sql=f"""+{_EDGES}, {_SUMMARY} SELECT cluster, round(lat, 6) AS lat, round(lon, 6) AS lon, n_detections, n_days, first_seen, last_seen, round(frp_mean, 6) AS frp_mean, frp_max, round(frp_total, 4) AS frp_total, frp_recent_max,
  round(night_fraction, 6) AS night_fraction, round(high_conf_fraction, 6) AS high_conf_fraction, round(extent_m, 3) AS extent_m, instruments FROM summary""")
def cluster_summary(spark, sf_dir):
    s = heat_sources.summarise(heat_sources.cluster(views.detections(spark, sf_dir)), 14)
    r = lambda c, n: F.round(c, n).alias(c)
    return s.select("cluster", r("lat", 6), r("lon", 6), "n_detections", "n_days", "first_seen", "last_seen", r("frp_mean", 6), "frp_max", r("frp_total", 4), "frp_recent_max", r("night_fraction", 6), r("high_conf_fraction", 6), r("extent_m", 3), "instruments")


@query("detections", sql="""SELECT user_id, count(*) AS n_detections, count(DISTINCT acq::date) AS n_days, round(quantile_cont(frp, 0.9), 6) AS frp_p90, round(avg(frp), 6) AS frp_mean, count(DISTINCT split_part(instrument, '_', 2)) AS n_satellites,
  round(sqrt(pow((max(lat) - min(lat)) * 110540e0, 2) + pow((max(lon) - min(lon)) * 111320e0 * cos(radians(avg(lat))), 2)), 3) AS extent_m, min(acq::date) AS first_day, max(acq::date) AS last_day FROM detections GROUP BY 1""")
def unit_features(spark, sf_dir):
    u = heat_sources.unit_features(views.detections(spark, sf_dir), "user_id")
    return u.select("user_id", "n_detections", "n_days", F.round("frp_p90", 6).alias("frp_p90"), F.round("frp_mean", 6).alias("frp_mean"), "n_satellites", F.round("extent_m", 3).alias("extent_m"), "first_day", "last_day")


@query("detections", sql=f"+{_PHYSICAL} SELECT {_CELL} AS cell, (day - DATE '2024-01-01') // 7 AS \"window\", round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n_detections, count(DISTINCT day) AS n_days, max(frp) AS frp_max, round(avg(CASE WHEN daynight = 'N' THEN 1e0 ELSE 0e0 END), 6) AS night_fraction, max(month(DATE '2024-01-01' + ((day - DATE '2024-01-01') // 7 * 7 + 3)::integer)) AS window_month FROM physical GROUP BY ALL")
def weekly_units(spark, sf_dir):
    d = views.detections(spark, sf_dir).withColumn("cell", geo.cell_key("lat", "lon"))
    u = detections.weekly_units(d, "cell", "2024-01-01")
    return u.withColumns({c: F.round(c, 6) for c in ("lat", "lon", "night_fraction")} | {c: F.col(c).cast("long") for c in ("window", "window_month")})


@query("detections", sql=f"+{_EDGES}, cells AS (SELECT cluster, {_CELL} AS cell_key, count(*) AS n FROM clustered GROUP BY ALL) SELECT cluster, cell_key FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, cell_key) AS rn FROM cells) x WHERE rn = 1")
def modal_cell(spark, sf_dir):
    return baseline.modal_cell(heat_sources.cluster(views.detections(spark, sf_dir)).withColumn("cell_key", geo.cell_key("lat", "lon")))


_STABLE = "concat('tsm', round_even(round(lat, 6) * 100, 0)::bigint, '_', round_even(round(lon, 6) * 100, 0)::bigint)"


@query("detections", sql=f"+{_EDGES}, {_SUMMARY}, based AS (SELECT cluster, {_STABLE} AS base FROM summary), numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY cluster) AS n FROM based) SELECT cluster, CASE WHEN n > 1 THEN concat(base, 'x', n) ELSE base END AS source_id FROM numbered")
def stable_ids(spark, sf_dir):
    s = heat_sources.summarise(heat_sources.cluster(views.detections(spark, sf_dir)), 14)
    return heat_sources.with_stable_ids(s.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})).select("cluster", "source_id")


def matched_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with facility, land cover (a function of the cluster number) and stable id."""
    s = heat_sources.with_stable_ids(heat_sources.summarise(heat_sources.cluster(views.detections(spark, sf_dir)), 14))
    s = staging.persisted(s, "sources")  # a row per source, read by the match and by the join after it
    fac = views.facilities(spark, sf_dir).select("ref", F.col("name").alias("site_name"), F.col("kind").alias("site_kind"))
    m = spatial.match_facilities(s, views.facilities(spark, sf_dir), "cluster").select("cluster", "ref").join(fac, "ref")
    prior = F.create_map(*[F.lit(x) for k, (p, _) in heat_sources.KINDS.items() for x in (k, p)])
    s = s.join(m, "cluster", "left").withColumn("site_ref", F.col("ref").cast("string")).drop("ref")
    c = F.col("cluster")
    return s.withColumns({
        "site_within": F.col("site_ref").isNotNull(), "site_continuous": F.try_element_at(prior, F.col("site_kind")), "lc_crop": (c % 10) / F.lit(1e1), "lc_vegetation": (c % 4) / F.lit(8e0), "lc_built": F.lit(0e0), "lc_bare": (c % 3) / F.lit(1e1),
        "lc_dominant": F.when(c % 9 > 0, "cropland"), "state": F.lit("Gujarat"),
    })


def evidence_sql(crop: str, veg: str, bare: str, unknown: str) -> dict[str, str]:
    """The evidence of a source, as SQL over its summary."""
    flag = lambda c: f"(CASE WHEN {c} THEN 1e0 ELSE 0e0 END)"
    near, far, per = flag("ref IS NOT NULL"), flag("ref IS NULL"), flag("n_days >= 3")
    return {
        "near_site": near, "far_from_site": far, "persistent": per, "very_persistent": flag("n_days >= 5"), "brief": flag("n_days <= 2"), "site_continuous": f"(coalesce(prior, 0e0) * {near})",
        "site_episodic": f"({near} * (1 - coalesce(prior, 0e0)))", "point_like": flag("extent_m <= 1500"), "night_present": flag("night_fraction >= 0.25"), "frp_high": flag("frp_max >= 40"),
        "recent": flag("hours <= 24"), "lc_crop": crop, "lc_vegetation": veg, "crop_brief": f"({crop} * {flag('n_days <= 2')})", "crop_frp_small": f"({crop} * {flag('frp_max < 10')})",
        "veg_frp_mid": f"({veg} * {flag('frp_max >= 15')})", "veg_big_extent": f"({veg} * {flag('extent_m > 3000')})", "agri_season_crop": "0e0", "lc_unknown": flag(unknown),
        "unmapped_persistent": f"({far} * {per})", "unmapped_very_persistent": f"({far} * {flag('n_days >= 5')})", "unmapped_point_like": f"({far} * {per} * {flag('extent_m <= 1500')})",
        "unmapped_night": f"({far} * {per} * {flag('night_fraction >= 0.25')})", "unmapped_bare_built": f"({far} * {per} * {bare})", "bias": "1e0",
    }


def _classified_sql(crop: str = "(cluster % 10) / 1e1", veg: str = "(cluster % 4) / 8e0", bare: str = "((cluster % 3) / 1e1)", unknown: str = "cluster % 9 = 0") -> str:
    """From detections to classed sources, with the given land cover."""
    kinds = " ".join(f"WHEN '{k}' THEN {p}e0" for k, (p, _) in heat_sources.KINDS.items())
    f = evidence_sql(crop, veg, bare, unknown)
    logits = ", ".join(f"{' + '.join(f'({w}e0) * {f[n]}' for n, w in ws.items())} AS l{i}" for i, ws in enumerate(heat_sources.WEIGHTS.values()))
    m = _ASSIGN.replace("detections d", "summary d").replace("d.detection_id", "d.cluster").replace("match AS", "smatch AS")
    n = len(heat_sources.CLASSES)
    most = "greatest(" + ", ".join(f"l{i}" for i in range(n)) + ")"
    total = " + ".join(f"exp(l{i} - mx)" for i in range(n))
    ranks = " UNION ALL ".join(f"SELECT cluster, {i} AS i, '{c}' AS class, exp(l{i} - mx) / t AS p FROM soft" for i, c in enumerate(heat_sources.CLASSES))
    return f"""{_EDGES}, {_SUMMARY}, {m}, j AS (SELECT s.*, x.ref, f.kind AS site_kind, CASE f.kind {kinds} END AS prior, (epoch_us((SELECT max(last_seen) FROM summary)) - epoch_us(s.last_seen)) / 3.6e9 AS hours
      FROM summary s LEFT JOIN smatch x ON x.cluster = s.cluster LEFT JOIN facilities f ON f.ref = x.ref), logit AS (SELECT *, {logits} FROM j), mxs AS (SELECT *, {most} AS mx FROM logit), soft AS (SELECT *, {total} AS t FROM mxs),
      ranked AS ({ranks}), ordered AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p DESC, i) AS rn FROM ranked),
      classed AS (SELECT j.*, a.class AS thermal_class, a.p AS p1, a.p - b.p AS margin, q.p AS p_fire FROM j JOIN ordered a ON a.cluster = j.cluster AND a.rn = 1 JOIN ordered b ON b.cluster = j.cluster AND b.rn = 2 JOIN ranked q ON q.cluster = j.cluster AND q.class = 'industrial_fire_candidate')"""


_CLASSED = _classified_sql()


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat_sources.classify(matched_sources(spark, sf_dir), F.lit(1))


@query("detections", "facilities", sql=f"+{_CLASSED} SELECT cluster, thermal_class, round(p1, 6) AS score, round(margin, 6) AS margin, round(p_fire, 6) AS p_fire, CASE WHEN margin >= 0.45 THEN 'high' WHEN margin >= 0.2 THEN 'medium' ELSE 'low' END AS confidence FROM classed")
def classify_scores(spark, sf_dir):
    c = classified(spark, sf_dir)
    score = F.col("class_scores")
    return c.select("cluster", "thermal_class", F.round(F.array_max(F.map_values(score)), 6).alias("score"), F.round("class_margin", 6).alias("margin"), F.round(score["industrial_fire_candidate"], 6).alias("p_fire"), F.col("class_confidence").alias("confidence"))


@query("detections", "facilities", sql=f"""+{_CLASSED} SELECT cluster, CASE WHEN thermal_class = 'industrial_fire_candidate' AND hours <= 24 AND frp_max >= 8 THEN CASE WHEN frp_max >= 100 THEN 'critical' WHEN frp_max >= 40 THEN 'high' ELSE 'watch' END
  WHEN thermal_class = 'industrial_persistent' AND n_days >= 4 AND frp_recent_max >= 3 * greatest(frp_mean, 1) AND frp_recent_max >= 30 THEN 'high' END AS alert_level FROM classed""")
def alert_flag(spark, sf_dir):
    return classified(spark, sf_dir).select("cluster", "alert_level")


_NOW = "2024-01-31 00:00:00"
_RULES = alerts.Rules(p_fire=0.2, max_age_hours=72.0)
_HAZARD = "CASE WHEN regexp_matches(coalesce(site_kind, ''), '" + "|".join(alerts.HAZARDOUS) + "') THEN 1 ELSE 0 END"


def _with_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = staging.persisted(classified(spark, sf_dir), "classified")  # read by several rules: classified once
    return judged.withColumn("frp_z", (F.col("cluster") % 7).cast("double"))


@query("detections", "facilities", sql=f"""+{_CLASSED}, cand AS (SELECT *, CASE WHEN ref IS NOT NULL THEN ref::varchar ELSE concat('src:', cluster) END AS facility_key, p_fire >= 0.2 AS by_p, ref IS NOT NULL AND cluster % 7 >= 3 AS by_z,
    least(CASE WHEN frp_max >= 100 THEN 2 WHEN frp_max >= 40 THEN 1 ELSE 0 END + {_HAZARD}, 2) AS sev FROM classed WHERE last_seen >= TIMESTAMP '{_NOW}' - INTERVAL 72 HOURS AND frp_max >= 5),
  passed AS (SELECT *, row_number() OVER (PARTITION BY facility_key ORDER BY sev DESC, frp_max DESC, cluster) AS rn FROM cand WHERE (by_p OR by_z) AND NOT ((cluster % 10) / 1e1 >= 0.6 AND night_fraction < 0.2))
  SELECT facility_key, cluster, CASE WHEN by_p AND by_z THEN 'both' WHEN by_p THEN 'p_fire' ELSE 'frp_z' END AS trigger, sev AS severity_rank, frp_max FROM passed WHERE rn = 1""")
def alert_candidates(spark, sf_dir):
    s = _with_z(spark, sf_dir).withColumn("source_id", F.col("cluster"))
    return alerts.candidates(s, F.lit(_NOW).cast("timestamp"), _RULES).select("facility_key", "cluster", "trigger", "severity_rank", "frp_max")


@query("detections", sql="""+ev AS (SELECT user_id, acq, row_number() OVER (PARTITION BY user_id ORDER BY acq) AS rn FROM (SELECT DISTINCT user_id, acq FROM detections WHERE frp >= 20) x),
  fold(user_id, rn, acq, last, created) AS (SELECT user_id, rn, acq, acq, true FROM ev WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, e.acq, CASE WHEN e.acq - f.last >= INTERVAL 6 HOURS THEN e.acq ELSE f.last END, e.acq - f.last >= INTERVAL 6 HOURS
    FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1) SELECT user_id, acq, created FROM fold""")
def alert_dedupe_6h(spark, sf_dir):
    e = views.detections(spark, sf_dir).filter("frp >= 20").select("user_id", "acq").distinct()
    return alerts.dedupe(e, key="user_id", ts="acq")


@query("detections", sql="+d AS (SELECT DISTINCT acq::date AS day FROM detections WHERE detection_id % 40 <> 0 AND day(acq) % 6 <> 1) SELECT CAST(r.range AS date) AS day FROM (SELECT min(day) AS a, max(day) AS b FROM d) s, range(s.a::timestamp, s.b::timestamp + INTERVAL 1 DAY, INTERVAL 1 DAY) r WHERE CAST(r.range AS date) NOT IN (SELECT day FROM d)")
def coverage_gaps(spark, sf_dir):
    d = views.detections(spark, sf_dir).filter("detection_id % 40 <> 0 and day(acq) % 6 <> 1")
    return detections.coverage_gaps(d)


@query("detections", sql="SELECT split_part(instrument, '_', 2) AS satellite, split_part(instrument, '_', 3) AS product, min(acq) AS first, max(acq) AS last, count(*) AS detections FROM detections GROUP BY 1, 2")
def coverage_by_product(spark, sf_dir):
    return detections.coverage_by_product(views.detections(spark, sf_dir))


@query("detections", sql="+h AS (SELECT *, 0 AS b FROM detections WHERE detection_id % 2 = 0 UNION ALL SELECT * REPLACE (frp + 1 AS frp), 1 FROM detections WHERE detection_id % 3 = 0), l AS (SELECT *, row_number() OVER (PARTITION BY detection_id ORDER BY b DESC) AS rn FROM h) SELECT detection_id, frp FROM l WHERE rn = 1 AND acq >= (SELECT max(acq) FROM l WHERE rn = 1) - INTERVAL 14 DAYS")
def history_merge(spark, sf_dir):
    d = views.detections(spark, sf_dir)
    fresh = d.filter("detection_id % 3 = 0").withColumn("frp", F.col("frp") + 1)
    return detections.merge_history(d.filter("detection_id % 2 = 0"), fresh, 14).select("detection_id", "frp")
