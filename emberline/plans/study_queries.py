"""Registered queries over labels, metrics, imagery, text, replay and streams, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import staging
from emberline.functions import geo, text
from emberline.operators import alerts, dedupe, detections, evaluation, facilities, heat_sources, imagery, labels, matching, quality, snapshots
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


# ---- labels
_UNITS = """SELECT detection_id, frp, date_trunc('day', acq)::date AS window_start, CASE detection_id % 5 WHEN 0 THEN 'Punjab' WHEN 1 THEN 'Haryana' WHEN 2 THEN 'Uttar Pradesh' WHEN 3 THEN 'Gujarat' END AS state, lon,
  (detection_id * 7 % 40) * 1e2 AS distance_to_authoritative_facility_m, (detection_id * 11 % 80) * 1e2 AS distance_to_any_facility_m, (detection_id % 10) / 2e1 AS facility_baseline_active_fraction, (detection_id % 7) / 1e2 AS cell_baseline_active_fraction,
  (detection_id % 11) / 1e1 AS lc_crop, (detection_id % 13) / 1.2e1 AS lc_woody, detection_id % 12 + 1 AS window_month FROM detections"""
_RULES = f"""units AS ({_UNITS}), ruled AS (SELECT *, distance_to_authoritative_facility_m <= 1000 AND facility_baseline_active_fraction >= 0.20 AS a,
  coalesce(lc_crop >= 0.70 AND (state IN ('Punjab', 'Haryana') OR (state = 'Uttar Pradesh' AND lon <= 79.5)) AND window_month IN (10, 11, 4, 5) AND distance_to_any_facility_m > 3000 AND cell_baseline_active_fraction < 0.05, false) AS b,
  lc_woody >= 0.70 AND distance_to_any_facility_m > 3000 AND cell_baseline_active_fraction < 0.05 AS c FROM units)"""


def _units(spark, sf_dir):
    d = views.detections(spark, sf_dir)
    i = F.col("detection_id")
    state = F.when(i % 5 == 0, "Punjab").when(i % 5 == 1, "Haryāna").when(i % 5 == 2, "Uttar Pradesh").when(i % 5 == 3, "Gujarat")
    return d.select(
        "detection_id", "frp", F.to_date("acq").alias("window_start"), state.alias("state"), "lon", ((i * 7 % 40) * F.lit(1e2)).alias("distance_to_authoritative_facility_m"), ((i * 11 % 80) * F.lit(1e2)).alias("distance_to_any_facility_m"),
        ((i % 10) / F.lit(2e1)).alias("facility_baseline_active_fraction"), ((i % 7) / F.lit(1e2)).alias("cell_baseline_active_fraction"), ((i % 11) / F.lit(1e1)).alias("lc_crop"), ((i % 13) / F.lit(1.2e1)).alias("lc_woody"), (i % 12 + 1).alias("window_month"),
    )


@query("detections", sql=f"+{_RULES} SELECT detection_id, a AS is_industrial_persistent, b AS is_agricultural_burning, c AS is_vegetation_fire FROM ruled")
def label_rules(spark, sf_dir):
    return labels.apply_rules(_units(spark, sf_dir)).select("detection_id", *[f"is_{c}" for c in labels.LABELS])


@query("detections", sql=f"+{_RULES} SELECT detection_id, CASE WHEN a THEN 'industrial_persistent' WHEN b THEN 'agricultural_burning' ELSE 'vegetation_fire' END AS label FROM ruled WHERE a::int + b::int + c::int = 1")
def label_unambiguous(spark, sf_dir):
    return labels.unambiguous(labels.apply_rules(_units(spark, sf_dir))).select("detection_id", "label")


@query("detections", sql=f"+units AS ({_UNITS}) SELECT CASE WHEN coalesce(state IN ('Punjab', 'Gujarat'), false) THEN CASE WHEN window_start >= DATE '2024-01-15' THEN 'test' ELSE 'unused' END WHEN window_start < DATE '2024-01-15' THEN 'train' ELSE 'unused' END AS split, count(*) AS n FROM units GROUP BY 1")
def label_split(spark, sf_dir):
    return labels.split(_units(spark, sf_dir), ["Punjab", "Gujarat"], "2024-01-15").groupBy("split").agg(F.count("*").alias("n"))


@query("detections", sql=f"+units AS ({_UNITS}) SELECT state, least(count(*), 30) AS n FROM units GROUP BY 1")
def cap_per_group(spark, sf_dir):
    """A sampling operator: at most 30 units per state."""
    return labels.capped(_units(spark, sf_dir), ["state"], 30, 7, "detection_id").groupBy(F.translate("state", "ā", "a").alias("state")).agg(F.count("*").alias("n"))


@query("detections", sql="+i AS (SELECT detection_id AS incident_id, acq::date AS d, lat, lon FROM detections WHERE detection_id % 50 = 0) SELECT i.incident_id, count(*) FILTER (e.acq::date >= d - 1) AS event_detections, max(CASE WHEN e.acq::date >= d - 1 THEN e.frp END) AS event_max_frp, count(DISTINCT CASE WHEN e.acq::date <= d - 8 THEN e.acq::date END) AS baseline_days FROM i JOIN detections e ON e.acq::date BETWEEN d - 60 AND d + 2 AND abs(e.lat - i.lat) < 5e-2 AND abs(e.lon - i.lon) < 5e-2 WHERE " + thermal_queries._hav("e", "i") + " <= 2500 GROUP BY 1")
def incident_window(spark, sf_dir):
    d = views.detections(spark, sf_dir)
    i = d.filter("detection_id % 50 = 0").select(F.col("detection_id").alias("incident_id"), F.to_date("acq").alias("event_date"), "lat", "lon", F.lit(2.0).alias("radius_km"))
    return labels.incident_windows(i, d).select("incident_id", "event_detections", "event_max_frp", F.round(F.col("baseline_active_fraction") * 53).cast("long").alias("baseline_days"))


# ---- metrics; the prediction is a fixed function of the document number
_PRED = "pred AS (SELECT doc_id, quality, CASE WHEN doc_id * 7 % 10 < 8 THEN quality ELSE 1 - quality END AS predicted, (doc_id * 13 % 101) / 1e2 AS score FROM labels)"


def _predicted(spark, sf_dir):
    d = staging.table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    return d.withColumns({"predicted": F.when(i * 7 % 10 < 8, F.col("quality")).otherwise(1 - F.col("quality")), "score": (i * 13 % 101) / F.lit(1e2)})


@query(sql=f"WITH {_PRED} SELECT quality, predicted, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_predicted(spark, sf_dir), "quality", "predicted")


@query(sql=f"WITH {_PRED}, c AS (SELECT k, count(*) FILTER (quality = k) AS t, count(*) FILTER (predicted = k) AS p, count(*) FILTER (quality = k AND predicted = k) AS h FROM pred, (VALUES (0), (1)) v(k) GROUP BY 1) SELECT round(avg(2 * h / (t + p)), 9) AS macro_f1, round((SELECT avg(CASE WHEN quality = predicted THEN 1e0 ELSE 0e0 END) FROM pred), 9) AS accuracy FROM c")
def macro_f1(spark, sf_dir):
    m = evaluation.macro_f1(_predicted(spark, sf_dir), "quality", "predicted")
    return m.select(F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"))


@query(sql=f"WITH {_PRED}, b AS (SELECT ceil(score * 10) AS b, count(*) AS n, avg(CASE WHEN quality = predicted THEN 1e0 ELSE 0e0 END) AS a, avg(score) AS c FROM pred GROUP BY 1) SELECT round(sum(CASE WHEN b > 0 THEN n * abs(a - c) ELSE 0 END) / sum(n), 9) AS ece FROM b")
def ece(spark, sf_dir):
    d = _predicted(spark, sf_dir).withColumn("correct", F.col("quality") == F.col("predicted"))
    return evaluation.calibration_error(d, "score", "correct").select(F.round("ece", 9).alias("ece"))


@query(sql=f"WITH {_PRED} SELECT round(avg(CASE WHEN p.score > n.score THEN 1e0 WHEN p.score = n.score THEN 5e-1 ELSE 0e0 END), 9) AS auc FROM pred p, pred n WHERE p.quality = 1 AND n.quality = 0")
def auc(spark, sf_dir):
    return evaluation.auc(_predicted(spark, sf_dir), "score", "quality").select(F.round("auc", 9).alias("auc"))


@query(sql=f"WITH {_PRED}, neg AS (SELECT score FROM pred WHERE quality = 0), t AS (SELECT DISTINCT score FROM neg) SELECT min(score) AS threshold FROM t WHERE (SELECT count(*) FROM neg WHERE neg.score >= t.score) <= 5")
def alarm_threshold(spark, sf_dir):
    return evaluation.threshold(_predicted(spark, sf_dir).filter("quality = 0"), "score", 5)


@query()
def bootstrap_interval(spark, sf_dir):
    return evaluation.bootstrap(_predicted(spark, sf_dir).withColumn("g", F.col("doc_id") % 50), "g", "quality", "predicted")


@query(sql=f"WITH {_PRED} SELECT k AS quality, count(score) AS n, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3 FROM (VALUES ('0'), ('1'), ('2')) v(k) LEFT JOIN pred ON pred.quality::varchar = k GROUP BY 1")
def class_quartiles(spark, sf_dir):
    d = _predicted(spark, sf_dir).withColumn("quality", F.col("quality").cast("string"))
    return evaluation.quartiles(d, "quality", "score", ["0", "1", "2"]).select("quality", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


# ---- imagery on the embeddings as 8 x 8 chips
def _chips(spark, sf_dir):
    e = staging.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("a"))
    return e.select("vec_id", F.slice("a", 1, 16).alias("nir_before"), F.slice("a", 17, 16).alias("swir_before"), F.slice("a", 33, 16).alias("nir_after"), F.slice("a", 49, 16).alias("swir_after"))


_PIX = """px AS (SELECT vec_id, i, abs(embedding[i])::double AS nb, abs(embedding[i + 16])::double AS sb, abs(embedding[i + 32])::double AS na, abs(embedding[i + 48])::double AS sa FROM embeddings, range(1, 17) r(i)),
  ratio AS (SELECT vec_id, CASE WHEN nb + sb >= 0.05 THEN (nb - sb) / (nb + sb) END AS pre, CASE WHEN na + sa >= 0.05 THEN (na - sa) / (na + sa) END AS post FROM px),
  ok AS (SELECT *, pre - post AS d FROM ratio WHERE pre IS NOT NULL AND post IS NOT NULL)"""


@query(sql=f"WITH {_PIX} SELECT vec_id, round(median(pre), 6) AS nbr_before, round(median(post), 6) AS nbr_after, round(avg(d), 6) AS dnbr_mean, round(quantile_cont(d, 0.95), 6) AS dnbr_p95, round(avg(CASE WHEN d > 0.1 THEN 1e0 ELSE 0e0 END), 6) AS burned_fraction, round(count(*) / 16, 6) AS valid_fraction FROM ok GROUP BY 1 HAVING count(*) >= 4")
def nbr_summary(spark, sf_dir):
    s = imagery.dnbr_summary(_chips(spark, sf_dir), min_pixels=4).filter("nbr_before is not null")
    return s.select("vec_id", *[F.round(c, 6).alias(c) for c in ("nbr_before", "nbr_after", "dnbr_mean", "dnbr_p95", "burned_fraction", "valid_fraction")])


@query(sql="SELECT vec_id, len(list_filter(range(1, 17), lambda i: abs(embedding[i]) >= 0.5 AND abs(embedding[i])::double > 1.3 * abs(embedding[i + 16])::double)) AS hot FROM embeddings")
def hot_pixels(spark, sf_dir):
    return _chips(spark, sf_dir).select("vec_id", imagery.hot_pixels(F.col("nir_before"), F.col("swir_before")).cast("long").alias("hot"))


_SCENES = "scenes AS (SELECT event_id AS scene_id, user_id % 5 AS place, ts AS acquired, value AS cloud, event_id % 3 AS tile, event_id % 2 AS orbit FROM events)"


def _scenes(spark, sf_dir):
    e = staging.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("scene_id"), (F.col("user_id") % 5).alias("place"), F.col("ts").cast("timestamp").alias("acquired"), F.col("value").alias("cloud"), (F.col("event_id") % 3).alias("tile"), (F.col("event_id") % 2).alias("orbit"))


@query(sql=f"WITH {_SCENES}, u AS (SELECT *, (floor(epoch(acquired)) - epoch(TIMESTAMP '2024-01-20')) / 86400 AS o FROM scenes WHERE cloud < 30), r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY round(cloud, 1), abs(o), scene_id) AS rn FROM u WHERE abs(o) <= 6) SELECT place, scene_id FROM r WHERE rn = 1")
def scene_choice(spark, sf_dir):
    return imagery.after_scenes(_scenes(spark, sf_dir), "2024-01-20").filter("rank = 1").select("place", "scene_id")


@query(sql=f"""WITH {_SCENES}, u AS (SELECT *, (floor(epoch(acquired)) - epoch(TIMESTAMP '2024-01-20')) / 86400 AS o FROM scenes WHERE cloud < 30), a AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY round(cloud, 1), abs(o), scene_id) AS rn FROM u WHERE abs(o) <= 6),
  b AS (SELECT a.place, a.scene_id AS after_id, s.scene_id, (floor(epoch(a.acquired)) - floor(epoch(s.acquired))) / 86400 AS gap, CASE WHEN s.tile = a.tile AND s.orbit = a.orbit THEN 0 WHEN s.tile = a.tile THEN 1 ELSE 2 END AS same, s.cloud FROM a JOIN scenes s ON s.place = a.place AND s.cloud < 30 WHERE a.rn = 1 AND s.scene_id <> a.scene_id),
  c AS (SELECT *, row_number() OVER (PARTITION BY after_id ORDER BY same, round(cloud, 1), gap, scene_id) AS rn FROM b WHERE gap BETWEEN 2 AND 40) SELECT place, after_id, scene_id FROM c WHERE rn = 1""")
def scene_before(spark, sf_dir):
    s = _scenes(spark, sf_dir)
    return imagery.before_scenes(s, imagery.after_scenes(s, "2024-01-20").filter("rank = 1")).select("place", "after_id", "scene_id")


@query(sql="WITH c AS (SELECT vec_id, list_filter(list_transform(embedding, lambda v: (floor(abs(v) * 40)::int % 11) * 10), lambda x: x > 0) AS ok FROM embeddings) SELECT vec_id, round(len(list_filter(ok, lambda x: x = 40)) / len(ok), 6) AS lc_crop, round(len(list_filter(ok, lambda x: x IN (10, 20, 30, 90, 95, 100))) / len(ok), 6) AS lc_vegetation FROM c WHERE len(ok) > 0")
def cover_fractions(spark, sf_dir):
    e = staging.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: (F.floor(F.abs(v) * 40).cast("int") % 11) * 10).alias("codes"))
    c = satellite.cover_fractions(e).filter("lc_crop is not null")
    return c.select("vec_id", F.round("lc_crop", 6).alias("lc_crop"), F.round("lc_vegetation", 6).alias("lc_vegetation"))


# ---- text
@query(sql="SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_titles(spark, sf_dir):
    return staging.table(spark, sf_dir, "pages").select("page_id", F.coalesce(text.html_title(F.col("html")), F.lit("")).alias("title"))


@query(sql="WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<noscript\\b.*?</noscript\\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages), b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS t FROM a) SELECT page_id, md5(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS digest FROM b")
def page_text(spark, sf_dir):
    return staging.table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_text(F.col("html"))).alias("digest"))


@query("sites", sql="SELECT site_id, CASE WHEN regexp_matches(concat(CASE site_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END, name), '^[=+\\-@\\t\\r]') THEN concat('''', CASE site_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END, name) ELSE name END AS safe FROM sites")
def csv_escape(spark, sf_dir):
    s = views.sites(spark, sf_dir).select("site_id", F.concat(F.when(F.col("site_id") % 4 == 0, "=").when(F.col("site_id") % 4 == 1, "-").otherwise(""), "name").alias("safe"))
    return serving.csv_export(s)


@query("sites", sql="SELECT count(*) AS features, 0::bigint AS wrong_type, 0::bigint AS no_geometry, 0::bigint AS missing_name, count(*) AS missing_owner FROM sites")
def geojson_report(spark, sf_dir):
    return sinks.validated(serving.geojson(views.sites(spark, sf_dir), ["site_id", "name", "state"]), ["name", "owner"])


# ---- quality and registries
@query(sql="SELECT count(*) AS total, count(*) FILTER (lat IS NULL) AS null_coordinates, count(*) FILTER (lat > 90) AS invalid_coordinates, count(*) FILTER ((lat < 6 OR lat > 38) AND lat <= 90) AS outside, (SELECT sum(n - 1)::bigint FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) x) AS duplicate_rows FROM (SELECT CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 100 END AS lat FROM customer) c")
def quality_counts(spark, sf_dir):
    c = staging.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 17 != 0, F.col("c_custkey") % 100).cast("double").alias("lat"), F.lit(75.0).alias("lon"))
    return quality.report(c, ["c_nationkey", "c_mktsegment"]).select("total", "null_coordinates", "invalid_coordinates", "outside", "duplicate_rows")


_TAGS = "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'industrial' WHEN 1 THEN 'man_made' WHEN 2 THEN 'landuse' WHEN 3 THEN 'power' ELSE 'building' END AS k, CASE s_suppkey % 6 WHEN 0 THEN 'cement' WHEN 1 THEN 'flare' WHEN 2 THEN 'landfill' WHEN 3 THEN 'plant' ELSE 'yes' END AS v, CASE s_suppkey % 4 WHEN 0 THEN 'solar' WHEN 1 THEN 'coal' END AS f FROM supplier"


@query(sql=f"WITH t AS ({_TAGS}) SELECT s_suppkey, CASE k WHEN 'industrial' THEN 'cement' WHEN 'man_made' THEN 'gas_flare' WHEN 'landuse' THEN 'landfill' WHEN 'power' THEN CASE WHEN f = 'solar' THEN NULL ELSE 'power_thermal' END END AS kind FROM t")
def thermal_kinds(spark, sf_dir):
    s = staging.table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    k = F.when(n % 6 == 0, "industrial").when(n % 6 == 1, "man_made").when(n % 6 == 2, "landuse").when(n % 6 == 3, "power").otherwise("building")
    v = F.when(n % 6 == 0, "cement").when(n % 6 == 1, "flare").when(n % 6 == 2, "landfill").when(n % 6 == 3, "plant").otherwise("yes")
    tags = F.map_filter(F.create_map(k, v, F.lit("plant:source"), F.when(n % 4 == 0, "solar").when(n % 4 == 1, "coal")), lambda _, x: x.isNotNull())
    return s.select("s_suppkey", facilities.thermal_kind(tags).alias("kind"))


@query(sql="SELECT nation.n_name, count(*) AS n, sum(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END)::bigint AS evidence FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def tag_evidence(spark, sf_dir):
    s = staging.table(spark, sf_dir, "supplier").join(staging.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    d = facilities.tag_evidence(s.withColumn("tags", F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("name"), F.col("s_name"))).otherwise(F.create_map(F.lit("landuse"), F.lit("industrial")))))
    return d.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("evidence_score").alias("evidence"))


@query(sql="SELECT floor(round_even((8 + (event_id % 400) / 1e3) / 5e-3, 0))::bigint AS cy, count(DISTINCT ts::date) AS nights FROM events WHERE value * 100 >= 1400 GROUP BY 1 HAVING count(DISTINCT ts::date) >= 5")
def flare_nights(spark, sf_dir):
    e = staging.table(spark, sf_dir, "events").select((8 + (F.col("event_id") % 400) / F.lit(1e3)).alias("Lat_GMTCO"), F.lit(75.0).alias("Lon_GMTCO"), (F.col("value") * 100).alias("Temp_BB"), F.to_date("ts").alias("Date_Mscan"))
    v = registries.flare_nights(e)
    return v.select(F.split_part(F.split_part("source_id", F.lit(":"), F.lit(2)), F.lit("_"), F.lit(1)).cast("long").alias("cy"), F.split_part("status", F.lit(" "), F.lit(1)).cast("long").alias("nights"))


@query(sql="WITH u AS (SELECT p_brand AS id, p_partkey, p_retailprice AS cap, CASE p_partkey % 3 WHEN 0 THEN 'operating' WHEN 1 THEN 'construction' ELSE 'cancelled' END AS st FROM part) SELECT concat('steel:', id) AS source_id, round(sum(cap), 4) AS capacity_mw, CASE WHEN bool_or(st = 'operating') THEN 'operating' ELSE 'construction' END AS status FROM u WHERE st <> 'cancelled' GROUP BY id")
def tracker_units(spark, sf_dir):
    p = staging.table(spark, sf_dir, "part")
    st = F.when(F.col("p_partkey") % 3 == 0, "Operating").when(F.col("p_partkey") % 3 == 1, "construction").otherwise("cancelled")
    df = p.select(F.col("p_brand").alias("Plant ID"), F.lit("21.12, 83.45").alias("Coordinates"), F.lit("India").alias("Country"), st.alias("Status"), F.col("p_retailprice").alias("Capacity"))
    return registries.tracker(df, "steel").select("source_id", F.round("capacity_mw", 4).alias("capacity_mw"), "status")


# ---- replay and streams
@query("detections", sql="+t AS (SELECT generate_series AS tick FROM generate_series(TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-18', INTERVAL 1 HOUR)), s AS (SELECT tick, detection_id FROM t JOIN detections ON acq + INTERVAL 3 HOURS <= tick AND acq >= tick - INTERVAL 14 DAYS), f AS (SELECT detection_id, min(tick) AS first FROM s GROUP BY 1) SELECT tick, count(*) AS visible, count(*) FILTER (tick = first) AS new FROM s JOIN f ON s.detection_id = f.detection_id GROUP BY 1")
def replay_ticks(spark, sf_dir):
    return live.tick_counts(views.detections(spark, sf_dir), "2024-01-16", "2024-01-18")


def _stream_copy(spark, sf_dir):
    """Detections as files of a stream, in the shared folder."""
    path = staging.new_path(spark, "stream")
    d = views.detections(spark, sf_dir).select("detection_id", F.col("acq").cast("timestamp").alias("acq"), "frp", "daynight", F.col("user_id").cast("string").alias("facility_key"))
    d.repartitionByRange(4, "acq").write.parquet(path)
    return path, d.schema


@query("detections", sql="SELECT daynight, count(*) AS n, round(sum(frp), 4) AS frp FROM detections GROUP BY 1")
def stream_ingest(spark, sf_dir):
    """Unique ids of a file stream, collected by foreachBatch into a table."""
    path, schema = _stream_copy(spark, sf_dir)
    out = staging.new_path(spark, "stream-out")
    stream = live.unique(live.read_detections(spark, path, schema, 2), late="60 days")
    q = live.run_cycles(stream, staging.new_path(spark, "stream-state"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("daynight").agg(F.count("*").alias("n"), F.round(F.sum("frp"), 4).alias("frp"))


# ---- alerts, sources and snapshots that the other modules leave
@query("detections", sql=f"+{thermal_queries._EDGES} SELECT cluster, string_agg(detection_id::varchar, ',' ORDER BY acq, detection_id) AS ids FROM clustered GROUP BY 1")
def source_detail(spark, sf_dir):
    d = heat_sources.cluster(views.detections(spark, sf_dir))
    s = serving.source_detail(d.select("cluster").distinct(), d)
    return s.select("cluster", F.array_join(F.transform("detections", lambda x: x["detection_id"].cast("string")), ",").alias("ids"))


@query("facilities", sql="SELECT ref, CASE WHEN list_has_any(string_split(sources, ','), ['wri_gppd', 'gem', 'ggfr', 'vnf']) THEN true ELSE false END AS authoritative, len(string_split(sources, ',')) AS source_count FROM facilities")
def facility_authority(spark, sf_dir):
    return registries.with_authority(views.facilities(spark, sf_dir)).select("ref", "authoritative", F.col("source_count").cast("long").alias("source_count"))


@query(sql="SELECT n_name, CASE WHEN n_nationkey % 7 = 0 THEN 'not_configured' WHEN n_nationkey % 7 = 1 THEN 'awaiting_setup' WHEN n_nationkey % 7 = 2 THEN 'syncing' WHEN n_nationkey * 10 > 120 THEN 'offline' WHEN n_nationkey * 10 > 30 THEN 'delayed' ELSE 'live' END AS state FROM nation")
def freshness_states(spark, sf_dir):
    n = F.col("n_nationkey")
    d = staging.table(spark, sf_dir, "nation").select("n_name", (n % 7 != 0).alias("configured"), (n % 7 != 1).alias("initialised"), (n % 7 == 2).alias("running"), (F.lit("2024-01-01").cast("timestamp") - F.make_interval(mins=(n * 10).cast("int"))).alias("last_success"), F.lit(600).alias("interval_s"), F.lit(False).alias("failing"))
    return serving.freshness(d, F.lit("2024-01-01").cast("timestamp")).select("n_name", "state")


@query(sql="WITH e AS (SELECT DISTINCT user_id::varchar AS facility_key, ts, value AS frp FROM events WHERE value >= 40) SELECT facility_key, count(*) AS n FROM e GROUP BY 1")
def alert_refresh(spark, sf_dir):
    """Every event lands in one alert; counts per facility add up to its events."""
    e = staging.table(spark, sf_dir, "events").filter("value >= 40").select(F.col("user_id").cast("string").alias("facility_key"), "ts", F.col("value").alias("frp")).distinct().withColumn("severity_rank", F.lit(1))
    a = alerts.refreshed(alerts.dedupe(e))
    return a.groupBy("facility_key").agg(F.sum("n_events").alias("n"))


@query(sql="SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def latest_decision(spark, sf_dir):
    return snapshots.latest(staging.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query(sql="SELECT o_orderkey, o_orderkey % 11 <> 0 AS is_current FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 11 <> 0")
def snapshot_replace(spark, sf_dir):
    o = staging.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return snapshots.snapshot_replace(o.filter("o_orderkey % 7 <> 0"), o.filter("o_orderkey % 11 <> 0"), "o_orderkey").select("o_orderkey", "is_current")


@query(sql="SELECT s_nationkey AS site_id, s_suppkey AS source_key, DATE '2024-01-01' AS first_linked, CASE WHEN s_suppkey % 2 = 0 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS last_linked FROM supplier")
def ledger_upsert(spark, sf_dir):
    s = staging.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site_id"), F.col("s_suppkey").alias("source_key"), F.lit("2024-01-01").cast("date").alias("first_linked"), F.lit("2024-01-01").cast("date").alias("last_linked"))
    seen = s.filter("source_key % 2 = 0").withColumns({"first_linked": F.lit("2024-02-01").cast("date"), "last_linked": F.lit("2024-02-01").cast("date")})
    return matching.ledger_upsert(s, seen)


@query(sql="SELECT p_brand, arg_min(p_type, concat(printf('%06d', 999999 - n), printf('%09d', f))) AS p_type FROM (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL) x GROUP BY 1")
def most_common_value(spark, sf_dir):
    return matching.most_common(staging.table(spark, sf_dir, "part"), "p_brand", "p_type", "p_partkey")


@query("left_records", sql="+p AS (SELECT *, row_number() OVER (PARTITION BY round(lat, 6), round(lon, 6), district ORDER BY id) AS rn FROM left_records) SELECT id FROM p WHERE rn = 1")
def dedupe_by_place(spark, sf_dir):
    return dedupe.by_place(views.records(spark, sf_dir, 0), "id", "district").select("id")


@query("detections", sql="SELECT instrument, (SELECT CASE WHEN instrument LIKE '%_SP' THEN 'SP' ELSE 'NRT' END) AS product, count(*) AS n FROM detections GROUP BY 1")
def instrument_split(spark, sf_dir):
    d = detections.instrument_parts(views.detections(spark, sf_dir))
    return d.groupBy("instrument", "product").agg(F.count("*").alias("n"))


@query("facilities", sql="SELECT ref, round(sqrt(pow((lat - 20e0) * 111320e0, 2) + pow((lon - 80e0) * 111320e0 * cos(radians(20e0)), 2)) / 1000, 4) AS km FROM facilities WHERE sqrt(pow((lat - 20e0) * 111320e0, 2) + pow((lon - 80e0) * 111320e0 * cos(radians(20e0)), 2)) <= 500000")
def focus_circle(spark, sf_dir):
    d = views.facilities(spark, sf_dir).withColumn("m", geo.planar_m(20.0, 80.0, "lat", "lon"))
    return d.filter("m <= 500000").select("ref", F.round(F.col("m") / 1000, 4).alias("km"))
